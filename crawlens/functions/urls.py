"""URL parts as columns, and the safety rules for hosts.

Hosts are canonical as browsers read them: lower case, default port dropped, IPv4 literals
in any base or number of parts made dotted. All of it is built-in functions; IPv6 literals
are expanded by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlens.constants import INTERNAL_HOSTS, INTERNAL_SUFFIXES
from crawlens.functions.columns import let, trimmed

URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?(?=[/?#]|$))?"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, URL, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-cased host, without a trailing dot's neighbour rules: as written otherwise."""
    return F.lower(part(url, 2))


def web(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://") & (part(url, 2) != "")


def origin(url: Column) -> Column:
    """scheme://host[:port], null where a url has none; default ports are left out."""

    def of(u: Column) -> Column:
        port = part(u, 3)
        default = F.concat(scheme(u), F.lit(":"), port).isin("http:80", "https:443") | (port == "")
        return F.when(web(u), F.concat(scheme(u), F.lit("://"), canonical_host(u), F.when(default, "").otherwise(F.concat(F.lit(":"), port))))

    return let(url, of)


def path(url: Column) -> Column:
    """The path, / where there is none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def section(url: Column) -> Column:
    """First path segment in lower case; root for paths of fewer than two segments."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return let(parts, lambda p: F.when(F.size(p) < 2, "root").otherwise(F.lower(F.try_element_at(p, F.lit(1)))))


def is_homepage(url: Column, home: Column) -> Column:
    return (origin(url) == home) & (path(url) == "/") & ~url.rlike(r"[?#].")


def resolved(href: Column, base: Column) -> Column:
    """An href against its page: absolute, scheme-relative, root-relative, query, fragment or relative to the folder; dot segments removed."""

    def join(h: Column) -> Column:
        home = origin(base)
        return (
            F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
            .otherwise(F.concat(home, F.when(h.startswith("/"), "").when(h.startswith("?"), path(base)).otherwise(F.regexp_replace(path(base), r"[^/]*$", "")), h))
        )

    def clean(u: Column) -> Column:
        return F.when(web(u), F.concat(origin(u), without_dots(path(u)), F.regexp_extract(u, r"^[^?#]*([?#].*)?$", 1)))

    return let(let(trimmed(href), join), clean)


def without_dots(p: Column) -> Column:
    def step(done: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    def clean(q: Column) -> Column:
        parts = F.split(q, "/")
        kept = F.aggregate(F.slice(parts, 2, 100_000), F.array(F.lit("")).cast("array<string>"), step)
        end = F.when(q.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
        return F.concat(F.array_join(kept, "/"), end)

    return let(p, lambda q: F.when(q.rlike(r"(^|/)\.\.?(/|$)"), clean(q)).otherwise(q))


# ---- hosts ----------------------------------------------------------------------------------


def number(label: Column) -> Column:
    """A label of an IPv4 literal: hexadecimal, octal or decimal; null if it is none (or beyond 32 bits)."""
    hexa = F.conv(F.substring(label, 3, 20), 16, 10)
    return (
        F.when(label.rlike("^0[xX][0-9a-fA-F]{1,12}$"), hexa)
        .when(label.rlike("^0[0-7]{1,14}$"), F.conv(label, 8, 10))
        .when(label.rlike("^(0|[1-9][0-9]{0,11})$"), label)
        .cast("long")
    )


def ipv4(h: Column) -> Column:
    """The 32-bit address of an IPv4 literal of one to four parts, null for other hosts."""

    def address(v: Column) -> Column:
        lead, tail = F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), F.element_at(v, -1)
        room = F.pow(F.lit(2.0), 40 - 8 * F.size(v)).cast("long")
        ok = ~F.exists(v, lambda x: x.isNull()) & ~F.exists(lead, lambda x: x > 255) & (tail < room)
        return F.when(ok, F.aggregate(lead, F.lit(0).cast("long"), lambda a, x: a * 256 + x) * room + tail)

    # Only what looks like a literal is taken apart.
    parts = F.transform(F.split(h, r"\."), number)
    return F.when(h.rlike(r"^[0-9][0-9a-fA-FxX]*(\.[0-9][0-9a-fA-FxX]*){0,3}$"), let(parts, address))


def dotted(address: Column) -> Column:
    byte = [F.shiftright(address, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *byte)


def canonical_host(url: Column) -> Column:
    return let(host(url), lambda h: let(ipv4(h), lambda v: F.when(v.isNotNull(), dotted(v)).otherwise(h)))


def private_ipv4(address: Column) -> Column:
    """Of this network, loopback, private, link-local, carrier, test, multicast or reserved."""

    def inside(first: str, last: str) -> Column:
        def value(x: str) -> int:
            out = 0
            for b in x.split("."):
                out = out * 256 + int(b)
            return out

        return address.between(value(first), value(last))

    ranges = (
        ("0.0.0.0", "0.255.255.255"),
        ("10.0.0.0", "10.255.255.255"),
        ("100.64.0.0", "100.127.255.255"),
        ("127.0.0.0", "127.255.255.255"),
        ("169.254.0.0", "169.254.255.255"),
        ("172.16.0.0", "172.31.255.255"),
        ("192.0.0.0", "192.0.255.255"),
        ("192.168.0.0", "192.168.255.255"),
        ("224.0.0.0", "255.255.255.255"),
    )
    out = F.lit(False)
    for first, last in ranges:
        out = out | inside(first, last)
    return out


def ipv6_groups(h: Column) -> Column:
    """The eight groups of an IPv6 literal (a dotted tail as two), null if it isn't one."""

    def hexed(x: Column) -> Column:
        tail = F.regexp_extract(x, r":([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})$", 1)
        low = F.lit(65535).cast("long")
        two = let(ipv4(tail), lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 16))), F.lit(":"), F.lower(F.hex(v.bitwiseAND(low)))))
        return F.when(x.contains("."), F.concat(F.regexp_replace(x, r"[0-9.]+$", ""), two)).otherwise(x)

    def groups(x: Column) -> Column:
        return F.filter(F.split(x, ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        left, right = groups(sides[0]), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
        gap = 8 - F.size(left) - F.size(right)
        return F.when(F.size(sides) == 1, left).when((F.size(sides) == 2) & (gap >= 0), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right))

    def numbers(g: Column) -> Column:
        good = (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.transform(g, lambda x: F.conv(x, 16, 10).cast("long")))

    return let(filled(F.split(let(h, hexed), "::")), numbers)


def private_ipv6(h: Column, groups: Column) -> Column:
    """Loopback, unspecified, link-local, unique local, or holding a private IPv4 address. groups: of ipv6_groups."""

    def inner(g: Column) -> Column:
        zero = lambda n: F.forall(F.slice(g, 1, n), lambda x: x == 0)
        holds = (zero(5) & (g[5] == 65535)) | ((g[0] == 0x64) & (g[1] == 0xFF9B))
        return (zero(7) & g[7].isin(0, 1)) | (holds & let(g[6] * 65536 + g[7], private_ipv4))

    return h.rlike("^(fe[89ab]|fc|fd)") | F.coalesce(let(groups, lambda g: F.when(g.isNotNull(), inner(g))), F.lit(False))


def safety(url: Column) -> Column:
    """struct(ok, reason) of a url that would be fetched."""

    def literal6(h: Column) -> Column:
        return let(ipv6_groups(h), lambda g: F.when(g.isNull(), "invalid_url").when(private_ipv6(h, g), "private_ipv6").otherwise("ok"))

    def named(h: Column) -> Column:
        internal = ~h.contains(".")
        for suffix in INTERNAL_SUFFIXES:
            internal = internal | h.endswith(suffix)
        return F.when(h.rlike(r"(^|\.)(0[xX][0-9a-fA-F]*|[0-9]+)\.?$"), "invalid_url").when(internal, "internal_hostname").otherwise("ok")

    def of_host(h: Column) -> Column:
        v4 = let(ipv4(h), lambda v: F.when(v.isNull(), named(h)).when(private_ipv4(v), "private_ipv4").otherwise("ok"))
        return F.when(h == "", "invalid_url").when(h.isin(*INTERNAL_HOSTS), "internal_hostname").when(h.startswith("["), literal6(F.regexp_replace(h, r"^\[|\]$", ""))).otherwise(v4)

    def judged(u: Column) -> Column:
        return F.when(part(u, 1) == "", "invalid_url").when(~scheme(u).isin("http", "https"), F.concat(F.lit("scheme_not_allowed:"), scheme(u))).otherwise(let(host(u), of_host))

    reason = let(F.coalesce(url, F.lit("")), judged)
    return let(reason, lambda r: F.struct((r == "ok").alias("ok"), r.alias("reason")))


def resolved_safety(address: Column, family: Column) -> Column:
    """struct(ok, reason) of an address that a host resolved to."""
    bad4 = F.coalesce(let(ipv4(address), private_ipv4), F.lit(False))
    bad6 = let(F.lower(address), lambda h: private_ipv6(h, ipv6_groups(h)))
    reason = F.when(family == 4, F.when(bad4, "private_ipv4_resolved").otherwise("ok")).when(bad6, "private_ipv6_resolved").otherwise("ok")
    return let(reason, lambda r: F.struct((r == "ok").alias("ok"), r.alias("reason")))
