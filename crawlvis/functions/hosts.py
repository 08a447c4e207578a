"""Hosts of URLs in one form: names in lower case and in ASCII, numeric addresses as four numbers, IPv6 in its shortest spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlvis.functions import net
from crawlvis.functions.fence import let

# The parameters of the coding of names beyond ASCII, and what a host can't hold.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
#: More digits than any number has that fits 64 bits.
MOST_DIGITS = 20
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
FORBIDDEN = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"
# Dots of other scripts, characters that are left out of names, and full-width forms with what they stand for.
DOTS, IGNORED = "。．｡", "­​⁠﻿"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))


def _digit(n: Column) -> Column:
    return F.substring(F.lit(DIGITS), n + 1, F.lit(1))


def _varied(delta: Column, bias: Column) -> Column:
    """A number in digits of growing weight, least first."""

    def step(s: Column, i: Column) -> Column:
        t = F.least(F.greatest(i * BASE - bias, F.lit(T_MIN)), F.lit(T_MAX))
        rest = s["q"] - t
        last = F.struct(s["q"].alias("q"), F.concat(s["out"], _digit(s["q"].cast("int"))).alias("out"), F.lit(True).alias("done"))
        more = F.struct(F.floor(rest / (F.lit(BASE) - t)).alias("q"), F.concat(s["out"], _digit((t + rest % (F.lit(BASE) - t)).cast("int"))).alias("out"), F.lit(False).alias("done"))
        return F.when(s["done"], s).when(s["q"] < t, last).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS)), F.struct(delta.alias("q"), F.lit("").alias("out"), F.lit(False).alias("done")), step)["out"]


def _adapted(delta: Column, length: Column, first: Column) -> Column:
    start = let(F.floor(F.when(first, delta / DAMP).otherwise(delta / 2)), lambda d: F.struct((d + F.floor(d / length)).alias("d"), F.lit(0).alias("k")))
    halved = lambda s, i: F.when(s["d"] > ((BASE - T_MIN) * T_MAX) // 2, F.struct(F.floor(s["d"] / (BASE - T_MIN)).alias("d"), (s["k"] + BASE).alias("k"))).otherwise(s)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS)), start, halved)
    return let(end, lambda s: (s["k"] + F.floor((BASE - T_MIN + 1) * s["d"] / (s["d"] + SKEW))).cast("int"))


def punycode(label: Column) -> Column:
    """A label beyond ASCII, in lower case, as ``xn--`` and the coding of where its other characters go; one in ASCII as it is.

    Characters are put in from the least code point up and from left to right; each is told by how far the pair of code point and
    place moves on from the one before.
    """

    def coded(points: Column) -> Column:
        basic = F.filter(points, lambda p: p < FIRST_POINT)
        others = F.array_sort(F.filter(F.transform(points, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"] >= FIRST_POINT))
        head = F.array_join(F.transform(basic, lambda p: F.char(p)), "")
        start = F.struct(
            F.lit(FIRST_POINT).cast("long").alias("n"), F.lit(0).cast("long").alias("i"), F.size(basic).cast("long").alias("h"), F.lit(FIRST_BIAS).alias("bias"),
            F.concat(head, F.when(F.size(basic) > 0, F.lit("-")).otherwise(F.lit(""))).alias("out"),
        )

        def put(s: Column, x: Column) -> Column:
            # Where the character goes among those that are in already: all of smaller code points, and equal ones to its left.
            place = F.size(F.filter(points, lambda p, j: (j < x["i"]) & (p <= x["p"]))).cast("long")
            delta = (x["p"] - s["n"]) * (s["h"] + 1) + place - s["i"]
            moved = lambda d: F.struct(
                x["p"].cast("long").alias("n"), (place + 1).alias("i"), (s["h"] + 1).alias("h"), _adapted(d, s["h"] + 1, s["h"] == F.size(basic)).alias("bias"), F.concat(s["out"], _varied(d, s["bias"])).alias("out"),
            )
            return let(delta, moved)

        return F.concat(F.lit("xn--"), F.aggregate(others, start, put)["out"])

    points = F.transform(F.split(label, ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    return F.when(F.rlike(label, F.lit(r"[^\x00-\x7f]")), let(points, coded)).otherwise(label)


def ascii_name(host: Column) -> Column:
    """A name in lower case, label by label in ASCII. Full-width forms and dots of other scripts are taken for plain ones; other compatibility forms stay as they are."""
    plain = F.lower(F.translate(F.translate(host, DOTS + WIDE, "..." + "".join(map(chr, range(0x21, 0x7F)))), IGNORED, ""))
    return F.when(F.rlike(host, F.lit(r"[^\x00-\x7f]")), F.array_join(F.transform(F.split(plain, r"\."), punycode), ".")).otherwise(F.lower(host))


def _number(part: Column) -> Column:
    """A part of a numeric address: decimal, octal behind a 0, hexadecimal behind 0x. Null where it is none; numbers beyond 40 bits are as good as any."""
    digits = lambda text, pattern, base: F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_replace(text, "^0+(?=.)", ""), lambda d: F.when(F.length(d) > 14, F.lit(1 << 40)).otherwise(F.conv(d, base, 10).cast("long"))))
    return (
        F.when(F.rlike(part, F.lit("^0[xX]$")), F.lit(0).cast("long"))
        .when(F.rlike(part, F.lit("^0[xX]")), digits(F.substring(part, F.lit(3), F.length(part)), "^[0-9a-fA-F]+$", 16))
        .when(F.rlike(part, F.lit("^0.")), digits(F.substring(part, F.lit(2), F.length(part)), "^[0-7]+$", 8))
        .otherwise(digits(part, "^[0-9]+$", 10))
    )


def numeric_address(host: Column) -> Column:
    """The four numbers of a host that ends in a number, whatever its spelling; null where it can't be read as an address."""

    def read(values: Column) -> Column:
        n = F.size(values)
        good = (n <= 4) & F.forall(values, lambda v: v.isNotNull()) & F.forall(F.slice(values, F.lit(1), n - 1), lambda v: v <= 255)
        last = F.element_at(values, -1)
        ahead = F.aggregate(F.transform(F.slice(values, F.lit(1), F.least(n - 1, F.lit(3))), lambda v, i: v * F.element_at(F.array(*[F.lit(256**k) for k in (3, 2, 1)]), i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
        room = F.element_at(F.array(*[F.lit(256**k).cast("long") for k in (4, 3, 2, 1)]), F.least(n, F.lit(4)))
        return F.when(F.coalesce(good & (last < room), F.lit(False)), F.concat_ws(".", *[F.shiftright(ahead + last, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)]))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _number), read)


def short_v6(host: Column) -> Column:
    """An IPv6 address in brackets in its shortest spelling: the first of the longest runs of zeros left out. Null where it is malformed."""

    def shortened(spelled: Column) -> Column:
        out = None
        for n in range(8, 1, -1):
            run = rf"^(?:(.*?):)?0(?::0){{{n - 1}}}(?::(.*))?$"
            cut = F.concat(F.regexp_extract(spelled, run, 1), F.lit("::"), F.regexp_extract(spelled, run, 2))
            found = F.rlike(spelled, F.lit(run))
            out = F.when(found, cut) if out is None else out.when(found, cut)
        return out.otherwise(spelled)

    groups = net.ipv6_groups(host)
    return let(groups, lambda g: F.when(g.isNotNull(), F.concat(F.lit("["), let(F.array_join(F.transform(g, lambda x: F.lower(F.hex(x))), ":"), shortened), F.lit("]"))))


def canonical(host: Column) -> Column:
    """A host of a web address in the form that it is compared in; null where it can't be one."""

    def named(name: Column) -> Column:
        numeric = F.rlike(name, F.lit(r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)\.?$"))
        bad = (name == "") | F.rlike(name, F.lit(FORBIDDEN))
        return F.when(bad, F.lit(None).cast("string")).when(numeric, numeric_address(name)).otherwise(name)

    def read(host: Column) -> Column:
        plain = F.try_url_decode(F.replace(F.regexp_replace(host, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B")))
        return F.when(F.startswith(host, F.lit("[")), F.when(F.endswith(host, F.lit("]")), short_v6(host))).otherwise(let(let(plain, ascii_name), named))

    return let(host, read)
