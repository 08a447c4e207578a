"""Text functions on columns: white space, tokens, shingles, raw text of pages, script text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlvis.functions import markup
from crawlvis.functions.fence import let

# White space, the shortest text that is compared by shingles, and their length.
WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: The same characters, one after the other.
BLANKS = "\t\n\v\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SHINGLE_SIZE, SHORT_TOKENS = 6, 12
# Common words of five letters and more.
STOPWORDS = (
    "about above after again their there these thing think those through under until where which while would could should "
    "other every first because between being before during since still without"
).split()


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def one_line(x: Column) -> Column:
    """White space runs as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(x, rf"{WS}+", " "))


def normalized(x: Column) -> Column:
    return one_line(F.lower(x))


def tokens(x: Column) -> Column:
    """Runs of letters and digits, in lower case. Null text has no tokens."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_count(x: Column) -> Column:
    return F.size(tokens(x)).cast("long")


def shingles(words: Column, size: int = SHINGLE_SIZE) -> Column:
    """Every ``size`` words in a row, joined by blanks; none if there are fewer words.

    The words are zipped with their own tails, so an array expression is not evaluated again for each place.
    """
    n = F.size(words) - (size - 1)
    parts = F.arrays_zip(*[F.slice(words, F.lit(k + 1), F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(size)])
    return F.transform(parts, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(size)]))


def distinctive(words: Column) -> Column:
    """Words that begin with a digit, and words of five and more characters that aren't common ones."""
    common = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words, lambda t: F.rlike(t, F.lit("^[0-9]")) | ((F.length(t) >= 5) & ~F.array_contains(common, t)))


def collapse_blocks(x: Column) -> Column:
    """Each line on one line with single blanks, empty lines dropped, case kept."""
    lines = F.filter(F.transform(F.split(x, "\n"), one_line), lambda line: line != "")
    return F.array_join(lines, "\n")


def raw_text(html: Column) -> Column:
    """The readable text of a page's source: what stands in elements that aren't code, one line for each block.

    Read in columns, for tables of responses. ``crawlvis.sources.html`` reads the same text off a tree; there alone an end tag that
    closes nothing breaks no line.
    """
    return collapse_blocks(let(markup.pieces(html), markup.shown))


def inline_scripts(html: Column) -> Column:
    """The contents of scripts without a source, in order, one below the other; blank ones are left out."""
    return F.array_join(let(markup.pieces(html), markup.scripts), "\n")


def unescaped(script: Column) -> Column:
    r"""Script text with its escapes resolved: \uXXXX (surrogates in pairs), then \n, \t, \/, and quotes and backslashes.

    A surrogate without its other half becomes U+FFFD, since no text can hold it.
    """
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    script = F.regexp_replace(script, f"{high}(?!{low})|(?<!{high}){low}", r"\\ufffd")
    units = r"((?:\\u[0-9a-fA-F]{4})+)"
    parts = F.split(F.regexp_replace(script, units, "\x00$1\x00"), "\x00")
    point = lambda p: F.when(F.rlike(p, F.lit(rf"^{units}$")), F.decode(F.unhex(F.regexp_replace(p, r"\\u", "")), "UTF-16BE")).otherwise(p)
    x = F.array_join(F.transform(parts, point), "")
    for old, new in ((r"\\n", "\n"), (r"\\t", " "), (r"\\/", "/"), (r"\\([\"'\\])", "$1")):
        x = F.regexp_replace(x, old, new)
    return x


def script_haystack(scripts: Column) -> Column:
    """Script text as it is and, below it, unescaped."""
    return F.concat(scripts, F.lit("\n"), unescaped(scripts))


def matched(needles: Column, hay: Column) -> Column:
    """How many of ``needles``, repeats counted, are in ``hay``. Both are arrays of strings.

    Sets are met by hashing; only needles that repeat are counted one by one, against the smaller of what is
    there and what is missing.
    """
    size = F.size(needles)

    def count(there: Column, missing: Column) -> Column:
        by_there = F.size(F.filter(needles, lambda s: F.array_contains(there, s)))
        by_missing = size - F.size(F.filter(needles, lambda s: F.array_contains(missing, s)))
        plain = F.size(there) + F.size(missing) == size
        return F.when(plain, F.size(there)).when(F.size(there) <= F.size(missing), by_there).otherwise(by_missing)

    sets = F.struct(F.array_intersect(needles, hay).alias("there"), F.array_except(needles, hay).alias("missing"))
    return let(sets, lambda x: count(x["there"], x["missing"]))


def fraction(found: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(found.cast("double"), total.cast("double")), F.lit(0.0))


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def markdown_inline(x: Column) -> Column:
    """One line, without characters that have a meaning in Markdown, of 200 characters at most."""
    return F.substring(trimmed(F.regexp_replace(F.regexp_replace(x, rf"{WS}+", " "), r"[`#>\[\]|]", "")), 1, 200)


def fenced(x: Column) -> Column:
    """The text between fences that are longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(x, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat_ws("\n", fence, x, fence)


def escaped(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x
