"""URL functions on columns: normal form, resolution of links, paths and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlvis.functions import hosts
from crawlvis.functions.fence import let

#: The order of parameters.
COLLATION = "UNICODE"
# Query parameters that only track visits.
TRACKING = r"(?i)^(utm_\w+|gclid|fbclid|msclkid|mc_cid|mc_eid)$"
PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#]*@)?(\[[0-9a-fA-F:.]+\]|[^/?#:@\s\[\]]+)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
# Ports that schemes stand for.
PORTS = {"https": "443", "http": "80", "wss": "443", "ws": "80", "ftp": "21"}
MOST_PORT = 65535


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def with_scheme(url: Column) -> Column:
    url = F.trim(url)
    return F.when(F.rlike(url, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")), url).otherwise(F.concat(F.lit("https://"), url))


def cleaned(url: Column) -> Column:
    """An address as it is parsed: with a scheme, without line ends, with slashes for backslashes ahead of the query."""

    def slashed(x: Column) -> Column:
        head = F.regexp_extract(x, "^[^?#]*", 0)
        return F.concat(F.regexp_replace(F.replace(head, F.lit("\\"), F.lit("/")), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)/{3,}", "$1//"), F.substring(x, F.length(head) + 1, F.length(x)))

    return let(F.regexp_replace(with_scheme(F.regexp_replace(url, r"^[\x00-\x20\x{a0}\x{feff}]+|[\x00-\x20\x{a0}\x{feff}]+$", "")), r"[\t\n\r]", ""), slashed)


def _port(x: Column) -> Column:
    """The port without leading zeros, nothing if there is none; null beyond the last one."""
    return let(F.regexp_replace(part(x, 3), "^0+(?=[0-9])", ""), lambda p: F.when((F.length(p) <= 5) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= MOST_PORT), p))


def is_valid(url: Column) -> Column:
    """Whether an address can be parsed: its host is one and its port, if any, a number that ports go up to."""
    return let(cleaned(url), lambda x: F.rlike(x, F.lit(PARTS)) & hosts.canonical(part(x, 2)).isNotNull() & _port(x).isNotNull())


def _encoded(text: Column, characters: str) -> Column:
    """Text with ``characters``, and all beyond ASCII, in percent-encoding. What is encoded already stays."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    beyond = r"[^\x00-\x7f]+"
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(f"({beyond})"), F.lit(1)), F.url_encode), F.array(F.lit("")))
    return F.when(F.rlike(text, F.lit(beyond)), F.array_join(F.zip_with(F.split(text, beyond), found, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def _steps(path: Column) -> Column:
    """A path without dot segments, of which the last leaves its slash."""
    steps = F.split(F.regexp_replace(path, r"(?i)(?<=/)(?:\.|%2e)(?:/(?:\.|%2e)(?=/|$))*(?:/|$)", ""), "/")
    none = F.array().cast("array<string>")
    dots = lambda s: F.rlike(s, F.lit(r"(?i)^(?:\.|%2e){2}$"))
    kept = F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), none, lambda a, s: F.when(dots(s), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    end = F.when(dots(F.element_at(steps, -1)) & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.rlike(path, F.lit(r"(?i)/(?:\.|%2e){1,2}(?:/|$)")), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def _query(text: Column) -> Column:
    """Parameters as a form writes them, without those that only track, sorted by name in the order of the root collation; equal names keep theirs."""
    plain = lambda p: F.try_url_decode(F.regexp_replace(p, "%(?![0-9a-fA-F]{2})", "%25"))
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(name(p)) + 2, F.length(p))).otherwise(F.lit(""))
    read = F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), lambda p: F.struct(plain(name(p)).alias("n"), plain(value(p)).alias("v")))
    kept = F.filter(read, lambda p: ~F.rlike(p["n"], F.lit(TRACKING)))
    placed = F.array_sort(F.transform(kept, lambda p, i: F.struct(F.collate(p["n"], COLLATION).alias("n"), i.alias("i"), F.concat(F.url_encode(p["n"]), F.lit("="), F.url_encode(p["v"])).alias("p"))))
    return F.array_join(F.transform(placed, lambda s: s["p"]), "&")


def normalized(url: Column) -> Column:
    """The key under which scans of a URL are kept; null where it can't be parsed.

    Scheme and host in lower case, no default port, fragment or tracking parameter, the other parameters sorted by
    name, and no slash at the end of a path but the root's. Names and values of parameters are decoded and encoded anew as
    a form does, a parameter without ``=`` gets one. Paths lose their dot segments and have blanks and other letters
    encoded. Hosts are in the form of ``hosts.canonical``: names in ASCII, numeric addresses as four numbers.
    """

    def parsed(x: Column) -> Column:
        scheme = F.lower(part(x, 1))
        user = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"^[^/]*//([^/?#]*@)", 1), "@(?=.*@)", "%40"), ":@$", "@"), "^@$", "")
        usual = F.lit(False)
        for name, number in PORTS.items():
            usual = usual | ((scheme == name) & (_port(x) == number))
        shown = F.when((_port(x) == "") | usual, F.lit("")).otherwise(F.concat(F.lit(":"), _port(x)))
        path = _steps(_encoded(part(x, 4), ' "<>`{}'))
        path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
        path = F.when(path == "", F.lit("/")).otherwise(path)
        query = let(_query(part(x, 5)), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
        return F.when(F.rlike(x, F.lit(PARTS)), F.concat(scheme, F.lit("://"), user, hosts.canonical(part(x, 2)), shown, path, query))

    return let(cleaned(url), parsed)


def pathname(url: Column) -> Column:
    """The path alone; the root where the URL can't be parsed."""
    path = part(url, 4)
    return F.when(F.coalesce(F.rlike(url, F.lit(PARTS)), F.lit(False)) & (path != ""), path).otherwise(F.lit("/"))


def host_of(url: Column) -> Column:
    """The host in its one form; the address itself where it has none."""
    return F.when(F.rlike(url, F.lit(PARTS)), F.coalesce(hosts.canonical(part(url, 2)), F.lower(part(url, 2)))).otherwise(url)


def resolved(href: Column, base: Column) -> Column:
    """A link's address on the page ``base``; null where it has none. Dot segments are resolved."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    document = F.regexp_extract(base, r"^([^#]*)", 1)
    path = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.concat(origin, F.when(pathname(base) == "/", F.lit("/")).otherwise(F.regexp_extract(pathname(base), r"^(.*/)", 1)))
    link = F.trim(href)
    whole = (
        F.when(F.rlike(link, F.lit(r"(?i)^https?://[/?#]*$|^https?:$")), F.lit(None).cast("string"))
        .when(F.rlike(link, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(link == "", document)
        .when(F.startswith(link, F.lit("#")), F.concat(document, link))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("?")), F.concat(path, link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .otherwise(F.concat(folder, link))
    )
    dots = F.rlike(whole, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/\.\.?(?:[/?#]|$)"))
    return F.when(dots, _without_dots(whole)).otherwise(whole)


def _without_dots(url: Column) -> Column:
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    steps = F.split(F.regexp_replace(rest, r"/\.(?=/|$)", ""), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), none, lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), tail)


def is_client_route(href: Column) -> Column:
    """Whether only script can follow the link: a fragment route or script itself. A plain anchor isn't one."""
    return F.coalesce(F.rlike(href, F.lit(r"^#/|(?i)^javascript:")), F.lit(False))


def requires_js_routing(url: Column) -> Column:
    """Asked of the URL as it was typed, since the normal form has no fragment."""
    return F.coalesce(F.contains(url, F.lit("#/")), F.lit(False))


def file_host(url: Column) -> Column:
    """The host as part of a file name."""
    return F.regexp_replace(host_of(url), r"[^a-z0-9.-]", "")


def client_ip(forwarded: Column) -> Column:
    """The first address of a forwarding header, or ``local``."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    return F.when(forwarded.isNull() | (forwarded == ""), F.lit("local")).otherwise(first)
