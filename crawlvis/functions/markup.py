"""Sources of pages in columns: cut into tags, texts and whole code elements, and read off state by state.

One pattern cuts a source as a browser's reader does: a quote opens a value only behind ``=``, a slash closes no
script, a comment or quoted value that is never closed goes to the end. It never goes back, so any source takes
linear time. What a pattern can't tell, which templates are open and whether the body has begun, is folded over the pieces.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlvis.functions.arrays import running_least, running_sums
from crawlvis.functions.fence import let

# White space of markup; elements that break lines, whose content is no markup, that a head holds, and whose text isn't content.
GAP, APART = r"[\t\n\f\r ]", r"[\t\n\f\r />]"
BLOCK_TAGS = "p|h[1-6]|li|ul|ol|div|section|article|aside|header|footer|nav|main|table|tr|td|th|caption|blockquote|pre|figure|figcaption|dl|dt|dd|br|hr"
RAW_TAGS = "script|style|noscript|title|textarea|iframe|noembed|noframes|xmp"
HEAD_TAGS = "html|head|base|basefont|bgsound|link|meta|title|style|script|noscript|noframes|template"
SILENT_TAGS, REFERRING_TAGS = "script|style|noscript", "title|textarea"
#: Characters by the names of references, as text that Spark turns into one constant map; and the names that need no semicolon.
NAMED = "\x01".join(f"{name}\x02{text}" for name, text in sorted(html5.items()))
LEGACY = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: What references to the control characters from 128 on have always stood for.
WINDOWS = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)]
REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[a-zA-Z][a-zA-Z0-9]{1,31}+;?)"


def attributes(end: str) -> str:
    """The pattern of all that stands in a tag behind its name. ``end``: how a pattern says that the source ends."""
    value = rf"(?:\"[^\"]*+(?:\"|{end})|'[^']*+(?:'|{end})|[^\t\n\f\r >\"'][^\t\n\f\r >]*+)?+"
    return rf"(?:[\t\n\f\r /]++|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{GAP}*+={GAP}*+{value})?+)*+"


def piece(end: str) -> str:
    """The pattern of one piece of a source: an element that holds no markup, a tag, a comment, a text, or a bracket that opens nothing."""
    inside = attributes(end)
    raw = rf"<({RAW_TAGS})(?={APART}){inside}(?:>(?s:.*?)(?:</\1(?={APART}){inside}(?:>|{end})|{end})|{end})"
    tag = rf"</?[a-z][^\t\n\f\r />]*+{inside}(?:>|{end})"
    comment = rf"<!--(?:-?>|(?s:.*?)(?:--!?>|{end}))"
    other = rf"<[!?][^>]*+(?:>|{end})|</(?:>|[^a-z>][^>]*+(?:>|{end}))"
    return f"(?i){raw}|{tag}|{comment}|{other}|[^<]++|<"


def attribute(end: str) -> str:
    """The pattern of one attribute: its name and, by what stands around it, its value."""
    value = rf"(?:\"([^\"]*+)(?:\"|{end})|'([^']*+)(?:'|{end})|([^\t\n\f\r >\"'][^\t\n\f\r >]*+))?+"
    return rf"([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{GAP}*+={GAP}*+{value})?+"


END = r"\z"
PIECE = piece(END)
CONTENT = rf"(?i)\A<([a-z]+)(?={APART}){attributes(END)}>((?s:.*?))(?:</\1(?={APART}){attributes(END)}>?)?\z"
ATTRIBUTE = attribute(END)


def decoded(x: Column) -> Column:
    """Text with its character references resolved. Unknown names stay; of old names that lack a semicolon the longest counts."""
    names = F.str_to_map(F.lit(NAMED), F.lit("\x01"), F.lit("\x02"))
    controls = F.array(*[F.lit(c) for c in WINDOWS])

    def point(digits: Column, base: int, most: int) -> Column:
        def character(n: Column) -> Column:
            there = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
            return F.when(n.between(0x80, 0x9F), F.get(controls, (n - 0x80).cast("int"))).when(there, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise(F.lit("�"))

        bare = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(bare) > most, F.lit("�")).otherwise(let(F.conv(bare, base, 10).cast("long"), character))

    def named(name: Column) -> Column:
        old = lambda n: F.when(n == "", F.concat(F.lit("&"), name)).otherwise(F.concat(F.element_at(names, n), F.substring(name, F.length(n) + 1, F.length(name))))
        return F.coalesce(F.try_element_at(names, name), let(F.regexp_extract(name, f"^({LEGACY})", 1), old))

    def one(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1)
        return (
            F.when(F.rlike(reference, F.lit("^&#[xX]")), point(digits, 16, 6))
            .when(F.startswith(reference, F.lit("&#")), point(digits, 10, 7))
            .otherwise(named(F.substring(reference, F.lit(2), F.length(reference))))
        )

    def whole(x: Column) -> Column:
        found = F.concat(F.transform(F.regexp_extract_all(x, F.lit(f"({REFERENCE})"), F.lit(1)), one), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(x, REFERENCE), found, lambda a, b: F.concat(a, b)), "")

    return let(x, lambda t: F.when(F.contains(t, F.lit("&")), whole(t)).otherwise(t))


def pieces(html: Column) -> Column:
    """A source's pieces in order; null has none. Line ends of any kind are one."""
    html = F.coalesce(html, F.lit(""))
    lines = F.when(F.contains(html, F.lit("\r")), F.regexp_replace(html, "\r\n?", "\n")).otherwise(html)
    return F.regexp_extract_all(lines, F.lit(PIECE), F.lit(0))


def is_text(p: Column) -> Column:
    return ~F.startswith(p, F.lit("<")) | (p == "<")


def tag_of(p: Column) -> Column:
    """The name of a piece's tag in lower case, with a slash ahead if it closes; empty for what isn't a tag."""
    return F.lower(F.regexp_extract(p, r"\A<(/?[a-zA-Z][^\t\n\f\r />]*)", 1))


def content(p: Column) -> Column:
    """What stands between the tags of an element that holds no markup."""
    return F.regexp_extract(p, CONTENT, 2)


def attribute_names(p: Column) -> Column:
    """The names of the attributes in a piece's opening tag, in lower case."""
    head = F.regexp_extract(p, rf"(?i)\A<[a-z][^\t\n\f\r />]*+({attributes(END)})", 1)
    return F.transform(F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(1)), F.lower)


def begins_body(p: Column) -> Column:
    """Whether a piece can't stand in a head."""
    text = is_text(p) & F.rlike(p, F.lit(r"[^\t\n\f\r ]"))
    return text | F.rlike(tag_of(p), F.lit(rf"\A(?!(?:{HEAD_TAGS})\z)[a-z]|\A/(?:body|html|br)\z"))


def shown(found: Column) -> Column:
    """The text of pieces, line ends where blocks begin and end: nothing of code, of templates, and of a title in the head."""

    def one(p: Column, tag: Column, in_body: Column) -> Column:
        raw = F.when(F.rlike(tag, F.lit(rf"\A(?:{SILENT_TAGS})\z")), F.lit("")).when(F.rlike(tag, F.lit(rf"\A(?:title|noframes)\z")) & ~in_body, F.lit(""))
        raw = raw.when(F.rlike(tag, F.lit(rf"\A(?:{REFERRING_TAGS})\z")), decoded(content(p))).when(F.rlike(tag, F.lit(rf"\A(?:{RAW_TAGS})\z")), content(p))
        return F.when(is_text(p), decoded(p)).when(F.rlike(tag, F.lit(rf"\A/?(?:{BLOCK_TAGS})\z")), F.lit("\n")).otherwise(raw.otherwise(F.lit("")))

    def told(found: Column) -> Column:
        titled = F.exists(found, lambda p: F.rlike(p, F.lit(rf"(?i)\A<(?:title|noframes){APART}")))
        begins = F.array_min(F.transform(found, lambda p, i: F.when(begins_body(p), i)))
        body = F.when(titled, F.coalesce(begins, F.size(found))).otherwise(F.lit(0))
        texts = lambda b: F.transform(found, lambda p, i: let(tag_of(p), lambda tag: one(p, tag, i >= b)))
        return let(body, texts)

    def open_templates(found: Column) -> Column:
        """How many templates are open at each piece: sums of what opens and closes, that never fall below the least before."""
        steps = F.transform(found, lambda p: let(tag_of(p), lambda t: F.when(t == "template", 1).when(t == "/template", -1).otherwise(0)))
        return let(running_sums(steps), lambda sums: F.zip_with(sums, running_least(sums), lambda s, m: s - F.least(m, F.lit(0))))

    def outside(found: Column) -> Column:
        return F.zip_with(told(found), open_templates(found), lambda x, depth: F.when(depth > 0, F.lit("")).otherwise(x))

    nested = F.exists(found, lambda p: F.rlike(p, F.lit(rf"(?i)\A<template{APART}")))
    return F.array_join(F.when(nested, outside(found)).otherwise(told(found)), "")


def scripts(found: Column) -> Column:
    """The contents of scripts without a source, blank ones left out."""
    inline = F.filter(found, lambda p: F.rlike(p, F.lit(rf"(?i)\A<script{APART}")) & ~F.array_contains(attribute_names(p), F.lit("src")))
    return F.filter(F.transform(inline, content), lambda s: F.rlike(s, F.lit(r"[^\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]")))
