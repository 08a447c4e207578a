"""Address functions on columns: which addresses are private."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlvis.functions.fence import let

# Blocked IPv4 ranges as base and prefix length.
BLOCKED_V4 = (("0.0.0.0", 8), ("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16))
DOTTED = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def _number(base: str) -> int:
    a, b, c, d = map(int, base.split("."))
    return a << 24 | b << 16 | c << 8 | d


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null where it isn't four numbers up to 255."""

    def value(parts: Column) -> Column:
        return F.when(F.array_max(parts) <= 255, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))

    parts = F.transform(F.split(ip, r"\."), lambda p: p.try_cast("long"))
    return F.when(F.rlike(ip, F.lit(DOTTED)), let(parts, value))


def in_blocked_range(number: Column) -> Column:
    """Whether a 32-bit number lies in a blocked range; ranges are compared as intervals."""
    hit = F.lit(False)
    for base, bits in BLOCKED_V4:
        first = _number(base)
        hit = hit | number.between(first, first + (1 << (32 - bits)) - 1)
    return F.coalesce(hit, F.lit(False))


def is_private_v4(ip: Column) -> Column:
    """Malformed addresses aren't private."""
    return in_blocked_range(ipv4_number(ip))


def ipv6_groups(ip: Column) -> Column:
    """The eight groups as numbers; null where the address is malformed. A dotted tail counts as two groups."""

    def spelled(body: Column) -> Column:
        tail = F.regexp_extract(body, r"^.*:(\d+\.\d+\.\d+\.\d+)$", 1)
        pair = lambda n: F.lower(F.concat_ws(":", F.hex(F.shiftright(n, 16)), F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
        whole = let(ipv4_number(tail), lambda n: F.when(n.isNotNull(), F.concat(F.regexp_extract(body, r"^(.*:)\d+\.\d+\.\d+\.\d+$", 1), pair(n))))
        return F.when(tail == "", body).otherwise(whole)

    def filled(halves: Column) -> Column:
        part = lambda i: let(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":")))

        def joined(sides: Column) -> Column:
            missing = F.lit(8) - F.size(sides["head"]) - F.size(sides["tail"])
            good = (F.size(halves) <= 2) & (missing >= 0) & ~((F.size(halves) == 1) & (missing != 0))
            return F.when(good, F.concat(sides["head"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), sides["tail"]))

        return let(F.struct(part(0).alias("head"), part(1).alias("tail")), joined)

    body = F.regexp_replace(F.lower(ip), r"^\[|\]$", "")
    every = let(let(body, spelled), lambda x: let(F.split(x, "::"), filled))
    well = lambda g: F.coalesce(F.forall(g, lambda x: F.rlike(x, F.lit("^[0-9a-f]{1,4}$"))), F.lit(False))
    return let(every, lambda g: F.when(well(g), F.transform(g, lambda x: F.conv(x, 16, 10).cast("long"))))


def is_private_v6(ip: Column) -> Column:
    """Loopback, unspecified, embedded private IPv4, unique local, link local and NAT64 addresses."""

    def judged(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i))
        zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        found = (
            F.when(zero(7) & at(7).isin(0, 1), F.lit(True))
            .when(zero(5) & at(5).isin(0, 0xFFFF), in_blocked_range(at(6) * 65536 + at(7)))
            .otherwise(at(0).between(0xFC00, 0xFDFF) | at(0).between(0xFE80, 0xFEBF) | ((at(0) == 0x64) & (at(1) == 0xFF9B)))
        )
        return F.when(g.isNull(), F.lit(False)).otherwise(found)

    return let(ipv6_groups(ip), judged)


def is_private(address: Column, family: Column) -> Column:
    return F.when((family == 6) | F.contains(address, F.lit(":")), is_private_v6(address)).otherwise(is_private_v4(address))
