"""Discovery, sampling, redirects, admission."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from crawlens.plans import fetch, site
from crawlens.streaming import admission

O = "https://example.com"


def loc(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc> {u}\n</loc></sitemap>" for u in urls) + "</sitemapindex>"


def discover(spark, cases):
    """cases: origin to (robots, {url: sitemap}, links of the home page); all sites in one run."""
    sites = spark.createDataFrame([(o,) for o in cases], "origin string")
    r = spark.createDataFrame([(o, 200 if c[0] else 404, c[0]) for o, c in cases.items()], "origin string, status int, body string")
    m = spark.createDataFrame([(u, 200, b) for c in cases.values() for u, b in c[1].items()], "url string, status int, body string")
    h = spark.createDataFrame([(o, o + "/", list(c[2])) for o, c in cases.items()], "origin string, url string, links array<string>")
    c, s = site.discovered(sites, r, m, h)
    urls = {}
    for x in c.orderBy("origin", "ord").collect():
        urls.setdefault(x.origin, []).append(x.url)
    return urls, {x.origin: x for x in s.collect()}


def test_discovery(spark):
    a, b, c, d, e = (f"https://{x}.example.com" for x in "abcde")
    cases = {
        a: (
            f"User-agent: *\nSitemap: {a}/s.xml\nSitemap: https://other.com/s.xml",
            {
                f"{a}/s.xml": index(f"{a}/a.xml", f"{a}/s.xml", "https://other.com/x.xml", f"{a}/b.xml", f"{a}/gone.xml"),
                f"{a}/a.xml": loc(f"{a}/blog/1", f"{a}/blog/2?a=1&amp;b=2", "https://other.com/z"),
                f"{a}/b.xml": loc(f"{a}/news/1", f"{a}/blog/1"),
            },
            (),
        ),
        b: (None, {f"{b}/sitemap.xml": loc(*[f"{b}/p/{i}" for i in range(2050)])}, ()),
        # Three levels of indexes are one too many.
        c: (None, {f"{c}/sitemap.xml": index(f"{c}/1.xml"), f"{c}/1.xml": index(f"{c}/2.xml"), f"{c}/2.xml": index(f"{c}/3.xml"), f"{c}/3.xml": loc(f"{c}/deep/x")}, ()),
        d: ("User-agent: *\nDisallow:", {}, ["/a", "b/c", "#top", "mailto:x@y", "https://other.com/", "", "/a", "/a#x", "JavaScript:void(0)"]),
        e: (None, {}, ()),
    }
    urls, s = discover(spark, cases)
    assert urls[a] == [f"{a}/", f"{a}/blog/1", f"{a}/blog/2?a=1&b=2", f"{a}/news/1"]
    assert (s[a].source, s[a].found, s[a].robots_found, s[a].sitemap_found) == ("sitemap-index", 4, True, True)
    assert len(urls[b]) == 2001 and (s[b].source, s[b].found) == ("sitemap", 2000)
    assert urls[c] == [f"{c}/"] and s[c].source == "none"
    assert urls[d] == [f"{d}/", f"{d}/a", f"{d}/b/c", f"{d}/a#x"] and (s[d].source, s[d].found) == ("nav-fallback", 4)
    assert urls[e] == [f"{e}/"] and s[e].source == "none"


def sample(spark, urls, n=15):
    df = spark.createDataFrame([(O, u) for u in urls], "origin string, url string")
    return [(r.section, r.url) for r in site.sampled(df, n).orderBy("ord").collect()], {r.section for r in site.truncated(df, n).collect()}


def test_sampling(spark):
    urls = [f"{O}/blog/{x}" for x in ("gamma", "alpha", "beta")] + [f"{O}/about", f"{O}/", f"{O}/news/1", f"{O}/?q"]
    got, cut = sample(spark, urls)
    assert got == [("root", f"{O}/"), ("blog", f"{O}/blog/alpha"), ("blog", f"{O}/blog/beta"), ("news", f"{O}/news/1"), ("root", f"{O}/?q"), ("root", f"{O}/about")] and not cut
    assert sample(spark, urls[::-1] + urls)[0] == got


def test_sampling_budget_against_the_loop(spark):
    rng = random.Random(9)
    for _ in range(3):
        urls = [f"{O}/s{rng.randrange(12)}/{i}" for i in range(rng.randrange(1, 40))]
        sections = {}
        for u in urls:
            sections.setdefault(u.split("/")[3], []).append(u)
        left, want, cut = 14, {f"{O}/"}, set()
        for k in sorted(sections, key=lambda k: (-len(sections[k]), k)):
            take = min(2, len(sections[k]), left)
            want |= set(sorted(sections[k])[:take])
            left -= take
            if take < min(2, len(sections[k])):
                cut.add(k)
        got, truncated = sample(spark, urls)
        assert {u for _, u in got} == want and truncated == cut


def test_redirects(spark):
    rows = [("https://a.com/", 301, "/b"), ("https://a.com/b", 302, "https://c.com/"), ("https://c.com/", 200, None), ("https://loop.com/", 302, "https://loop.com/"), ("https://in.com/", 302, "http://169.254.169.254/"), ("https://no.com/", 302, None)]
    r = spark.createDataFrame(rows, "url string, status int, location string")
    starts = spark.createDataFrame([(u,) for u in ("https://a.com/", "https://loop.com/", "https://in.com/", "https://no.com/", "https://gone.com/", "http://10.0.0.1/")], "url string")
    got = {x.url: (x.final_url, x.hops, x.outcome) for x in fetch.followed(starts, r).collect()}
    assert got["https://a.com/"] == ("https://c.com/", 2, "ok") and got["https://loop.com/"][1:] == (5, "too_many_redirects")
    assert got["https://in.com/"][2] == "blocked:private_ipv4" and got["https://no.com/"] == ("https://no.com/", 0, "ok")
    assert got["https://gone.com/"][2] == "network_error" and got["http://10.0.0.1/"][2] == "blocked:private_ipv4"


def test_fetched(spark):
    rows = [("https://a.com/", 301, "/b", None), ("https://a.com/b", 404, None, "none here"), ("https://in.com/", 302, "http://10.0.0.1/", "moved"), ("http://10.0.0.1/", 200, None, "secret")]
    r = spark.createDataFrame(rows, "url string, status int, location string, body string")
    starts = spark.createDataFrame([(u,) for u in ("https://a.com/", "https://in.com/", "https://gone.com/")], "url string")
    got = {x.url: tuple(x)[1:] for x in fetch.fetched(starts, r).collect()}
    assert got == {"https://a.com/": ("https://a.com/b", 1, None, 404, "none here"), "https://in.com/": ("http://10.0.0.1/", 1, "blocked:private_ipv4", None, None), "https://gone.com/": ("https://gone.com/", 0, "network_error", None, None)}


def test_fetch_profiles(spark):
    raw = spark.createDataFrame([("u", 200, None, bytearray(b"x" * (3 << 20) + b"yy"), 9_500), ("v", 200, None, bytearray(b"ok"), 9_000)], "url string, status int, location string, bytes binary, took_ms int")
    got = {(p, r.url): (r.status, r.body and len(r.body)) for p in ("library", "service", "command") for r in fetch.read(raw, p).collect()}
    assert got[("library", "u")] == got[("command", "u")] == (200, (3 << 20) + 2) and got[("service", "u")] == (None, None) and got[("service", "v")] == (200, 2)


def test_asked_scans(spark):
    rows = [(O, i, f"{O}/" + (f"p/{i}" if i else ""), "OK" if i < 3 else "HARD_BLOCK", 40 + i, 20, 8, 60 + i, 50, False, False) for i in range(5)]
    sampled = spark.createDataFrame(rows, "origin string, ord int, url string, block string, portion int, access int, llms int, total int, answers int, disallowed boolean, noindex boolean")
    summary = spark.createDataFrame([(O, "sitemap", 5, True, True, 0)], "origin string, source string, found long, robots_found boolean, sitemap_found boolean, dropped long")
    targets = spark.createDataFrame([(f"{O}/x", 2.9), (f"{O}/y", None), (f"{O}/z", 0.0), (f"{O}/", 99.0), ("http://localhost/", 3.0), ("https://other.example.org/", 3.0)], "target string, max_pages double")
    got = {r.target: r for r in site.asked_scans(targets, sampled, summary).collect()}
    assert [(got[t].cap, got[t].pages, got[t].page_mean) for t in (f"{O}/x", f"{O}/y", f"{O}/z", f"{O}/")] == [(2, 2, 40.5), (15, 5, 41.0), (1, 1, 40.0), (15, 5, 41.0)]
    assert got[f"{O}/y"].hard_blocked == [f"{O}/p/3", f"{O}/p/4"]
    assert got["http://localhost/"].check.reason == "internal_hostname" and got["https://other.example.org/"].check.ok and got["https://other.example.org/"].pages is None


def test_dns(spark):
    dns = spark.createDataFrame([("a.com", "8.8.8.8", 4, 0), ("a.com", "10.0.0.1", 4, 1), ("b.com", "1.1.1.1", 4, 0)], "host string, address string, family int, ord int")
    t = spark.createDataFrame([("https://a.com/",), ("https://b.com/",), ("https://c.com/",), ("http://127.0.0.1/",)], "url string")
    assert {r.url: r.reason for r in fetch.resolved(t, dns).collect()} == {"https://a.com/": "private_ipv4_resolved", "https://b.com/": "ok", "https://c.com/": "ok", "http://127.0.0.1/": "private_ipv4"}


def test_bodies_are_cut(spark):
    raw = spark.createDataFrame([("u", bytearray("aé".encode())), ("v", bytearray(b"ab"))], "url string, bytes binary")
    got = {r.url: (r.body, r.cut) for r in fetch.bodies(raw, 2).collect()}
    assert got["u"][0].startswith("a") and got["u"][1] and got["v"] == ("ab", False)


def requests(spark, n=400, seed=1):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    rows = [(i, start + timedelta(minutes=rng.randrange(3 * 1440)), rng.randrange(8), rng.choice(["page", "site"]), rng.randrange(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id bigint, ts timestamp, ip bigint, route string, weight int")


def sequential(rows, per_ip, overall, weight):
    out, total, own = {}, {}, {}
    for e, ts, ip, _, w in sorted(rows, key=lambda r: (r[1], r[0])):
        d, n = ts.strftime("%Y-%m-%d"), max(1, w) if weight else 1
        by = "global" if total.get(d, 0) + n > overall else "ip_daily" if own.get((d, ip), 0) + n > per_ip else None
        if by is None:
            total[d] = total.get(d, 0) + n
            own[d, ip] = own.get((d, ip), 0) + n
        out[e] = by
    return out


def test_quotas(spark):
    rows, df = requests(spark)
    for per_ip, overall in ((3, 20), (10, 60), (100, 5)):
        assert {r.event_id: r.blocked_by for r in admission.daily(df, per_ip, overall).collect()} == sequential(rows, per_ip, overall, False)
        assert {r.event_id: r.blocked_by for r in admission.weighted(df, per_ip, overall).collect()} == sequential(rows, per_ip, overall, True)


def test_quotas_go_on_from_stored_counters(spark):
    rows, df = requests(spark)
    # Some of the requests were counted before: what they leave is what a run over all decides for the rest.
    start = datetime(2026, 1, 1)
    before = [r for r in rows if (r[1] - start).seconds < 6 * 3600]
    after = [r for r in rows if (r[1] - start).seconds >= 6 * 3600]
    for per_ip, overall in ((3, 20), (10, 60), (100, 40), (2, 1000)):
        done, want = sequential(before, per_ip, overall, False), sequential(rows, per_ip, overall, False)
        counts = {}
        for e, ts, ip, *_ in before:
            if done[e] is None:
                for k in ((ts.strftime("%Y-%m-%d"), ip), (ts.strftime("%Y-%m-%d"), None)):
                    counts[k] = counts.get(k, 0) + 1
        stored = spark.createDataFrame([(d, ip, n) for (d, ip), n in counts.items()], "day string, ip bigint, n int")
        got = admission.daily(spark.createDataFrame(after, df.schema), per_ip, overall, stored)
        assert got.columns == [*df.columns, "day", "blocked_by", "allowed"]
        assert {r.event_id: r.blocked_by for r in got.collect()} == {e: want[e] for e, *_ in after}


def test_daily_quota_sorts_no_day_in_one_task(spark):
    _, df = requests(spark)
    plan = admission.daily(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_a_streams_counters_end(spark, tmp_path):
    start = datetime(2026, 1, 1, 12)
    files = [[(i, start + timedelta(minutes=i), 1, "page", 1) for i in range(5)], [(10, start + timedelta(days=9), 1, "page", 1)], [(20, start, 1, "page", 1), (21, start + timedelta(days=9), 2, "page", 1)]]
    schema = "event_id bigint, ts timestamp, ip bigint, route string, weight int"
    source = str(tmp_path / "in")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = admission.stream_daily(stream, 3, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        last = q.lastProgress
    got = {r.event_id: r.blocked_by for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The late request has no counter any more, so no decision; only the newest day's is kept.
    assert got == {0: None, 1: None, 2: None, 3: "ip_daily", 4: "ip_daily", 10: None, 21: None}
    assert last["stateOperators"][0]["numRowsTotal"] == 1


def test_minute_limit(spark):
    rows, df = requests(spark)
    seen, want = {}, {}
    for e, ts, ip, route, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        k = (ip, route, ts)
        seen[k] = seen.get(k, 0) + 1
        want[e] = seen[k] <= (1 if route == "site" else 2)
    assert {r.event_id: r.allowed for r in admission.per_minute(df, 2, 1).collect()} == want


def test_stream_decides_like_batch(spark, tmp_path):
    rows, df = requests(spark, 150)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = admission.stream_daily(stream, 10, 60).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.blocked_by for r in spark.table("decided").collect()} == sequential(rows, 10, 60, True)


def test_outcomes(spark):
    good = '{"url":"https://example.com/","token":"t"}'
    rows = [
        ("OPTIONS", "/scan", None, "", good, True, 204, None), ("GET", "/health", None, "", good, True, 200, None), ("POST", "/x", None, "", good, True, 404, "not_found"), ("GET", "/scan", None, "", good, True, 405, "method_not_allowed"),
        ("POST", "/scan", "https://z.com", "", good, True, 403, "forbidden_origin"), ("POST", "/scan", None, "https://z.com/", good, True, 403, "forbidden_referer"), ("POST", "/scan", "https://a.com", "", "{bad", True, 400, "invalid_json"),
        ("POST", "/scan", "https://a.com", "", "{}", True, 400, "url_required"), ("POST", "/scan", "https://a.com", "", '{"url":"' + "x" * 3000 + '"}', True, 400, "url_too_long"), ("POST", "/scan", "https://a.com", "", '{"url":"nope"}', True, 400, "invalid_url"),
        ("POST", "/scan", "https://a.com", "", '{"url":"ftp://a.b/"}', True, 400, "invalid_url_scheme"), ("POST", "/scan", "https://a.com", "", '{"url":"https://a.b/"}', True, 400, "turnstile_required"),
        ("POST", "/scan", None, "https://b.com/q", '{"url":"http://10.0.0.1/","token":"t"}', True, 400, "blocked_target"), ("POST", "/scan", "https://b.com", "", good, False, 403, "turnstile_failed"), ("POST", "/scan-site", "https://b.com", "", good, True, 200, None),
    ]
    df = spark.createDataFrame(rows, "method string, path string, origin string, referer string, body string, human boolean, status int, error string")
    got = df.withColumn("o", admission.outcome(["https://a.com"], ["https://b.com"])).collect()
    assert [(r.o.http_status, r.o.error) for r in got] == [(r.status, r.error) for r in got]


def test_one_parse_in_the_report_plan(spark):
    from crawlens.plans import registry

    df = registry.queries()["page_report"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert F is not None
