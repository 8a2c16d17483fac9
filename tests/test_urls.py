"""Url parts and safety rules."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from crawlens.functions import urls

#: Ranges of IPv4 that aren't public: first and last address. What lies beside them is.
RANGES = (
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


def value(dotted):
    return int(ipaddress.IPv4Address(dotted))


def written(n):
    """Ways to write an IPv4 address in a url."""
    a, b, c, d = n >> 24, n >> 16 & 255, n >> 8 & 255, n & 255
    yield f"{a}.{b}.{c}.{d}"
    yield str(n)
    yield f"0x{n:X}"
    yield f"0{n:o}"
    yield f"{a}.{n & 0xFFFFFF}"
    yield f"{a}.{b}.{n & 0xFFFF}"
    yield f"0x{a:x}.0{b:o}.{c}.0x{d:x}"


def ipv4_cases():
    held = [(value(a), value(b)) for a, b in RANGES]
    for low, high in held:
        for n in (low, low + 1, (low + high) // 2, high):
            for text in written(n):
                yield f"http://{text}/", "private_ipv4"
        for n in (low - 1, high + 1):
            if 0 <= n < 1 << 32 and not any(a <= n <= b for a, b in held):
                for text in written(n):
                    yield f"https://{text}/p", "ok"


IPV6 = {
    "[::1]": "private_ipv6",
    "[::]": "private_ipv6",
    "[0:0:0:0:0:0:0:1]": "private_ipv6",
    "[fc00::]": "private_ipv6",
    "[fdff:ffff::1]": "private_ipv6",
    "[fe80::]": "private_ipv6",
    "[febf::9]": "private_ipv6",
    "[::ffff:10.20.30.40]": "private_ipv6",
    "[::ffff:c0a8:102]": "private_ipv6",
    "[64:ff9b::a00:1]": "private_ipv6",
    "[::ffff:9.9.9.9]": "ok",
    "[2620:fe::fe]": "ok",
    "[fbff::1]": "ok",
}
HOSTS = {
    "crawlens.example.org": "ok",
    "a-b.c.example.net:8443": "ok",
    "user:pw@deep.er.example.com:443": "ok",
    "LocalHost:3000": "internal_hostname",
    "wiki": "internal_hostname",
    "db.prod.internal": "internal_hostname",
    "nas.LOCAL": "internal_hostname",
    "tv.home.arpa": "internal_hostname",
    "dev.localhost": "internal_hostname",
}
OTHER = {
    "ftp://files.example.org/a": "scheme_not_allowed",
    "mailto:someone@example.org": "scheme_not_allowed",
    "javascript:void(0)": "scheme_not_allowed",
    "data:,x": "scheme_not_allowed",
    "ws://chat.example.org/": "scheme_not_allowed",
    "file:///tmp/x": "scheme_not_allowed",
    "no scheme at all": "invalid_url",
    "": "invalid_url",
    None: "invalid_url",
}


def test_safety(spark):
    rows = [*ipv4_cases(), *((f"http://{h}/x", r) for h, r in (IPV6 | HOSTS).items()), *OTHER.items()]
    df = spark.createDataFrame(rows, "url string, want string").withColumn("got", urls.safety(F.col("url")))
    wrong = [(r.url, r.want, r.got.reason) for r in df.collect() if r.got.reason.split(":")[0] != r.want or r.got.ok != (r.want == "ok")]
    assert not wrong


def test_resolved_addresses(spark):
    rows = [("8.8.8.8", 4, "ok"), ("10.1.1.1", 4, "private_ipv4_resolved"), ("::1", 6, "private_ipv6_resolved"), ("2001:4860::1", 6, "ok"), ("::ffff:10.0.0.1", 6, "private_ipv6_resolved")]
    df = spark.createDataFrame(rows, "a string, f int, want string").withColumn("got", urls.resolved_safety(F.col("a"), F.col("f")))
    assert [r.got.reason for r in df.collect()] == [r[2] for r in rows]


@pytest.mark.parametrize(
    "url, origin, path, section",
    [
        ("HTTPS://Example.com:443/Blog/x?q#f", "https://example.com", "/Blog/x", "blog"),
        ("http://example.com:8080", "http://example.com:8080", "/", "root"),
        ("https://example.com/about", "https://example.com", "/about", "root"),
        ("http://0x7f.1/a/b", "http://127.0.0.1", "/a/b", "a"),
        ("no url", None, "/", "root"),
    ],
)
def test_parts(spark, url, origin, path, section):
    u = F.col("u")
    row = spark.createDataFrame([(url,)], "u string").select(urls.origin(u).alias("o"), urls.path(u).alias("p"), urls.section(u).alias("s")).first()
    assert row.o == origin and row.s == section and (row.p == path or origin is None)


def test_resolution(spark):
    base = "https://example.com/a/b?x=1"
    cases = {
        "/c": "https://example.com/c", "c": "https://example.com/a/c", "../c": "https://example.com/c", "?y": "https://example.com/a/b?y", "#z": "https://example.com/a/b?x=1#z",
        "//other.com/q": "https://other.com/q", "http://e.org/./p/../q": "http://e.org/q", "mailto:a@b": None,
    }
    df = spark.createDataFrame([(h, base) for h in cases], "h string, b string").withColumn("r", urls.resolved(F.col("h"), F.col("b")))
    assert {r.h: r.r for r in df.collect()} == cases
