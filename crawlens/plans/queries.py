"""The engine's operators as queries over the derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens import sinks
from crawlens.constants import BOTS, DIMENSIONS, PROFILES
from crawlens.functions import urls
from crawlens.functions.columns import has_any, matching, present
from crawlens.constants import ANSWER_TYPES, TIER_A, TIER_B
from crawlens.operators import block, dimensions, llms_txt, report, robots
from crawlens.plans import fetch, site
from crawlens.sources import inputs
from crawlens.sources.pages import parsed
from crawlens.streaming import admission

#: Limits scaled to the test tables, where hardly any user sends two requests a day.
PER_IP, OVERALL, MINUTE = 2, 200, 1


def _in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inputs.frame(spark, sf_dir, getattr(inputs, name))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in(spark, sf_dir, "PAGES").withColumn("final_url", F.lit(None).cast("string"))


def _live_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in(spark, sf_dir, "ROBOTS").where((F.col("status") == 200) & present(F.col("body")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scored(report.contexts(_pages(spark, sf_dir), _in(spark, sf_dir, "ROBOTS"), _in(spark, sf_dir, "LLMS")))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a candidate of its site, and the home page."""
    pages = _in(spark, sf_dir, "PAGES").select(urls.origin(F.col("url")).alias("origin"), "url")
    return pages.unionByName(pages.select("origin", F.concat("origin", F.lit("/")).alias("url")))


def page_features(spark, sf_dir):
    f = parsed(_in(spark, sf_dir, "PAGES"))
    cols = ("html_length", "word_count", "main_word_count", "script_count", "script_length", "title", "html_lang", "canonical", "main", "article", "nav", "header", "footer", "ul_count", "ol_count", "table_count", "next_data", "empty_root")
    return f.select("page_id", *[F.col(f"facts.{c}").alias(c) for c in cols], F.length("facts.visible_text").alias("text_length"), (F.floor(F.col("facts.text_ratio") * 1000 + 0.5) / 1000).alias("text_ratio"), F.size("facts.headings").alias("heading_count"))


def heading_levels(spark, sf_dir):
    f = parsed(_in(spark, sf_dir, "PAGES"))
    before = F.lag("level").over(site.W.partitionBy("page_id").orderBy("pos"))
    rows = f.select("page_id", F.posexplode("facts.headings").alias("pos", "h")).select("page_id", F.col("pos").cast("int").alias("pos"), F.col("h.level").alias("level"), F.col("h.text").alias("text"))
    return rows.withColumn("skips", F.coalesce(F.col("level") > before + 1, F.lit(False)))


def block_status(spark, sf_dir):
    rows = parsed(_in(spark, sf_dir, "PAGES").withColumn("marks", block.markers(F.col("html"))))
    b = block.verdict()
    return rows.select("page_id", b.alias("b")).select("page_id", F.col("b.status").alias("block"), F.col("b.http_status").alias("http_status"), F.col("b.reason").alias("reason"))


def url_parts(spark, sf_dir):
    u = F.col("url")
    home = urls.is_homepage(u, urls.origin(u))
    return _in(spark, sf_dir, "PAGES").select("page_id", urls.origin(u).alias("origin"), urls.path(u).alias("path"), urls.section(u).alias("section"), home.alias("homepage"), F.concat(urls.origin(u), F.lit("/robots.txt")).alias("robots_url"))


def robots_rules(spark, sf_dir):
    return robots.rules(_live_robots(spark, sf_dir)).select("origin", F.col("group_id").cast("long").alias("group_id"), F.col("line_no").cast("long").alias("line_no"), "field", "value")


def robots_sitemaps(spark, sf_dir):
    return robots.sitemaps(_live_robots(spark, sf_dir)).select("origin", "url")


def robots_rulings(spark, sf_dir):
    groups, _ = report.site_files(_in(spark, sf_dir, "ROBOTS"), _in(spark, sf_dir, "LLMS"))
    pages = _in(spark, sf_dir, "PAGES").select("page_id", urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path"))
    rows = pages.join(groups, "origin").select("page_id", F.explode(robots.rulings()).alias("r"))
    return rows.select("page_id", F.col("r.bot").alias("bot"), F.col("r.allowed").alias("allowed"), F.col("r.rule").alias("rule"), F.col("r.explicit").alias("explicit"))


def crawler_access(spark, sf_dir):
    s = _scored(spark, sf_dir)
    shut = robots.blocked(F.col("rulings"))
    d = F.col("directives")
    return s.select("page_id", F.col("aiCrawlerAccess.score").alias("score"), (len(BOTS) - F.size(shut)).alias("bots_allowed"), F.concat_ws(",", shut).alias("bots_blocked"), d.noindex.alias("noindex"), d.noai.alias("noai"), d.nosnippet.alias("nosnippet"), d.none.alias("none"))


def llms_files(spark, sf_dir):
    _, files = report.site_files(_in(spark, sf_dir, "ROBOTS"), _in(spark, sf_dir, "LLMS"))
    score = dimensions.llms()
    return files.select("origin", F.col("llms.present").alias("present"), F.col("llms.well_formed").alias("well_formed"), F.col("llms.detail").alias("detail"), F.col("llms.full_present").alias("full_present"), score.score.alias("score"))


def jsonld_nodes(spark, sf_dir):
    f = parsed(_in(spark, sf_dir, "PAGES"))
    return f.select("page_id", F.posexplode("facts.jsonld_nodes").alias("ord", "n")).select("page_id", F.col("ord").cast("int").alias("ord"), F.array_join("n.types", ",").alias("types"), F.array_join("n.keys", ",").alias("keys"), F.col("n.same_as").alias("same_as"))


def schema_types(spark, sf_dir):
    f = parsed(_in(spark, sf_dir, "PAGES"))
    t = F.col("facts.jsonld_types")
    return f.select("page_id", F.array_join(t, ",").alias("types"), F.array_join("facts.microdata_types", ",").alias("microdata"), F.col("facts.jsonld_blocks").alias("blocks"), F.col("facts.jsonld_invalid").alias("invalid"), F.array_join(matching(t, TIER_A), ",").alias("tier_a"), F.array_join(matching(t, TIER_B), ",").alias("tier_b"), has_any(t, ANSWER_TYPES).alias("answer_friendly"))


def dimension_scores(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("page_id", *[F.col(n).score.alias(n) for n, _ in DIMENSIONS], "total", "grade")


def answer_readiness(spark, sf_dir):
    s = _scored(spark, sf_dir)
    a = F.col("answers")
    return s.select("page_id", *[a[c].alias(c) for c in ("score", "grade", "question_headings", "answer_paragraphs", "faq_schema", "faq_block", "tldr", "howto_schema", "ordered_lists")])


def findings(spark, sf_dir):
    return _scored(spark, sf_dir).select("page_id", F.explode(report.findings()).alias("f")).select("page_id", "f.dimension", "f.code", "f.severity", "f.positive")


def fixes_ranked(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("page_id", F.posexplode(report.fixes()).alias("pos", "f"))
    return rows.select("page_id", (F.col("pos") + 1).cast("int").alias("rank"), "f.code", "f.severity", "f.impact")


def top_fixes(spark, sf_dir):
    """A page's first five fixes: the report's own limit."""
    rows = _scored(spark, sf_dir).select("page_id", F.posexplode(F.slice(report.fixes(), 1, 5)).alias("pos", "f"))
    return rows.select("page_id", (F.col("pos") + 1).cast("int").alias("rank"), "f.code")


def page_report(spark, sf_dir):
    s = sinks.with_text(_scored(spark, sf_dir))
    return s.select("page_id", "url", "origin", F.col("block.status").alias("block"), F.col("block.reason").alias("reason"), *[F.col(n).score.alias(n) for n, _ in DIMENSIONS], "total", "grade", F.col("answers.score").alias("answers"), F.size("fixes").alias("n_fixes"), F.size("notes").alias("n_notes"))


def grade_histogram(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("grade").agg(F.count(F.lit(1)).alias("pages"), F.min("total").alias("least"), F.max("total").alias("most"))


def extracted_content(spark, sf_dir):
    c = F.col("content")
    return _scored(spark, sf_dir).withColumn("content", report.content()).select("page_id", F.length(c.text).alias("text_length"), c.truncated.alias("truncated"), c.original_length.alias("original_length"), c.word_count.alias("word_count"), c.blocked.alias("blocked"), c.answer_structure.ordered_lists.alias("ordered_lists"))


def sitemap_locs(spark, sf_dir):
    files = _in(spark, sf_dir, "SITEMAPS")
    return files.select("url", site.is_index(F.col("body")).alias("is_index"), F.posexplode(site.locs(F.col("body"))).alias("ord", "loc")).select("url", "is_index", F.col("ord").cast("int").alias("ord"), "loc")


def nav_links(spark, sf_dir):
    f = parsed(_in(spark, sf_dir, "PAGES"))
    homes = f.select(F.concat(urls.origin(F.col("url")), F.lit("#"), F.col("page_id")).alias("key"), urls.origin(F.col("url")).alias("origin"), "url", F.col("facts.links").alias("links"), "page_id")
    each = homes.select("page_id", "origin", F.col("url").alias("base"), F.posexplode("links").alias("ord", "href"))
    full = each.withColumn("link", urls.resolved(F.col("href"), F.col("base")))
    return full.where(urls.origin(F.col("link")) == F.col("origin")).select("page_id", F.col("ord").cast("int").alias("ord"), "link")


def _discovery(spark, sf_dir):
    pages = _in(spark, sf_dir, "PAGES")
    sites = pages.select(urls.origin(F.col("url")).alias("origin")).distinct()
    # The last page of a site (its home page, where it has one) stands for its home page, so only that one is parsed.
    own = pages.select(urls.origin(F.col("url")).alias("origin"), "page_id", "url", "html")
    last = own.groupBy("origin").agg(F.max_by(F.struct("url", "html"), "page_id").alias("p")).select("origin", "p.url", "p.html")
    homes = parsed(last).select("origin", "url", F.col("facts.links").alias("links"))
    return site.discovered(sites, _in(spark, sf_dir, "ROBOTS"), _in(spark, sf_dir, "SITEMAPS"), homes)


def discovery_summary(spark, sf_dir):
    return _discovery(spark, sf_dir)[1]


def discovery_candidates(spark, sf_dir):
    return _discovery(spark, sf_dir)[0].select("origin", F.col("ord").cast("int").alias("ord"), "url")


def section_counts(spark, sf_dir):
    c = _candidates(spark, sf_dir).distinct().where(~urls.is_homepage(F.col("url"), F.col("origin")))
    return c.groupBy("origin", urls.section(F.col("url")).alias("section")).agg(F.count(F.lit(1)).alias("available"))


def site_sample(spark, sf_dir):
    return site.sampled(_candidates(spark, sf_dir), max_pages=5).select("origin", F.col("ord").cast("int").alias("ord"), "section", "url")


def truncated_sections(spark, sf_dir):
    return site.truncated(_candidates(spark, sf_dir), max_pages=5)


def _rows(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return site.page_rows(F.col("site"), F.col("page_id"), s)


def site_score(spark, sf_dir):
    return site.rolled_up(_rows(spark, sf_dir))


def site_lists(spark, sf_dir):
    # The table's sites have few pages each.
    r = site.rolled_up(_rows(spark, sf_dir), lists=True)
    return r.select("origin", *[F.array_join(c, " ").alias(c) for c in ("hard_blocked", "soft_blocked", "robots_disallowed", "noindexed")])


def site_capped(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    place = (F.row_number().over(site.W.partitionBy("origin").orderBy("ord")) - 1).alias("ord")
    first = rows.select("origin", place, *[c for c in rows.columns if c not in ("origin", "ord")])
    return site.capped(first, 3).select("origin", "pages", "counted", "total", "page_mean", "worst_url")


def site_scan(spark, sf_dir):
    r = site.site_scan(_pages(spark, sf_dir), _in(spark, sf_dir, "ROBOTS"), _in(spark, sf_dir, "LLMS"), _in(spark, sf_dir, "SITEMAPS"))
    return r.select("origin", "source", "found", "dropped", "pages", "counted", "inaccessible", "total", "grade")


def site_summary(spark, sf_dir):
    return site.rolled_up(_rows(spark, sf_dir)).select("origin", sinks.site_summary().alias("summary"))


def page_summary(spark, sf_dir):
    return sinks.with_text(_scored(spark, sf_dir)).select("page_id", "summary")


def console_report(spark, sf_dir):
    return sinks.with_text(_scored(spark, sf_dir)).select("page_id", sinks.console_report().alias("report"))


def tool_scan_url(spark, sf_dir):
    s = sinks.with_text(_scored(spark, sf_dir)).withColumn("check", urls.safety(F.col("url")))
    data = F.struct("url", "total", "grade")
    r = F.when(F.col("check.ok"), sinks.tool_result(F.col("summary"), data, F.lit(False))).otherwise(sinks.tool_error(F.concat(F.lit("blocked:"), F.col("check.reason"))))
    return s.select("page_id", r.alias("r")).select("page_id", "r.text", "r.structured", "r.is_error")


def tool_scan_site(spark, sf_dir):
    """Every site by some url of it, with a cap or none; and urls that are refused, or of sites that nothing is known of."""
    sites = _in(spark, sf_dir, "PAGES").groupBy("site").agg(F.min("page_id").alias("k"))
    cap = F.when(F.col("k") % 4 == 0, F.lit(None)).otherwise(F.col("k") % 4 * 3 - 3.5)
    asked = sites.select(F.concat("site", F.lit("/any?x=1")).alias("target"), cap.alias("max_pages"))
    other = spark.createDataFrame([("http://10.9.8.7/a", 3.0), ("no url", None), ("ftp://example.org/", None), ("https://unseen.example.org/x", 2.0)], "target string, max_pages double")
    rows, summary = site.sampled_rows(_pages(spark, sf_dir), _in(spark, sf_dir, "ROBOTS"), _in(spark, sf_dir, "LLMS"), _in(spark, sf_dir, "SITEMAPS"))
    scans = site.asked_scans(asked.unionByName(other), rows, summary).withColumn("origin", urls.origin(F.col("target")))
    data = F.struct("origin", "total", "grade", "pages", "source")
    bad = F.concat(F.lit("blocked:"), F.col("check.reason"))
    r = F.when(~F.col("check.ok"), sinks.tool_error(bad)).when(F.col("pages").isNull(), sinks.tool_error(F.lit("nothing could be read"))).otherwise(sinks.tool_result(sinks.site_summary(F.col("cap"), lists=True), data, F.lit(False)))
    return scans.select("target", "cap", "pages", "total", r.alias("r")).select("target", "cap", "pages", "total", "r.structured", "r.is_error", F.element_at(F.split("r.text", "\n"), 1).alias("first_line"))


def tool_errors(spark, sf_dir):
    """What a failed fetch becomes in a tool's answer."""
    r = _in(spark, sf_dir, "REDIRECTS")
    failed = fetch.followed(r.select("url"), r).where("outcome <> 'ok'")
    return failed.select("url", sinks.tool_error(F.col("outcome")).alias("r")).select("url", "r.text", "r.structured", "r.is_error")


#: Urls of every kind that the safety rules tell apart; {} is the page's number.
SAFETY_URLS = (
    "https://example.com/{}", "http://10.0.0.{}/", "http://172.15.0.1/{}", "http://172.31.255.255/{}", "http://2130706433/{}", "http://0x7f.1/{}", "http://0177.0.0.1/{}", "http://134744072/{}",
    "http://LOCALHOST:8080/{}", "http://router/{}", "http://foo.internal/{}", "ftp://example.com/{}", "not a url {}", "http://[::1]/{}", "http://[2001:4860:4860::8888]/{}", "http://100.64.0.1/{}",
    "http://192.0.9.9/{}", "https://user:pw@deep.er.example.com:443/a/{}",
)


def ssrf_urls(spark, sf_dir):
    made = F.replace(F.array(*[F.lit(u) for u in SAFETY_URLS])[(F.col("page_id") % len(SAFETY_URLS)).cast("int")], F.lit("{}"), F.expr("cast(page_id % 200 as string)"))
    rows = _in(spark, sf_dir, "PAGES").select("page_id", made.alias("target"))
    return rows.select("page_id", "target", urls.safety(F.col("target")).alias("c")).select("page_id", "target", "c.ok", "c.reason")


def dns_check(spark, sf_dir):
    return fetch.resolved(_in(spark, sf_dir, "PAGES").select("url"), _in(spark, sf_dir, "DNS"))


def redirect_chain(spark, sf_dir):
    r = _in(spark, sf_dir, "REDIRECTS")
    return fetch.followed(r.select("url"), r)


def fetched_bodies(spark, sf_dir):
    """The final answer of every redirecting url, as a scan gets it."""
    r = _in(spark, sf_dir, "REDIRECTS").withColumn("body", F.concat(F.lit("body of "), F.col("url")))
    return fetch.fetched(r.select("url"), r).select("url", "final_url", "hops", "error", "status", "body")


def fetch_profiles(spark, sf_dir):
    """Which answers each runtime reads in time, and how much of them."""
    raw = _in(spark, sf_dir, "PAGES").select("url", "status", F.lit(None).cast("string").alias("location"), F.col("html").cast("binary").alias("bytes"), (F.col("page_id") * 97 % 23_000).alias("took_ms"))
    out = None
    for name in PROFILES:
        seen = fetch.read(raw, name).agg(F.count("status").alias("answers"), F.count("body").alias("bodies"), F.sum(F.octet_length("body")).alias("bytes")).select(F.lit(name).alias("profile"), "*")
        out = seen if out is None else out.unionByName(seen)
    return out


def capped_bodies(spark, sf_dir):
    raw = _in(spark, sf_dir, "PAGES").select("url", F.col("html").cast("binary").alias("bytes"))
    return fetch.bodies(raw, 1500).select("url", "cut", F.length(F.rtrim(F.replace("body", F.lit("�"), F.lit("")))).alias("chars"))


def rate_minute(spark, sf_dir):
    return admission.per_minute(_in(spark, sf_dir, "REQUESTS"), MINUTE, MINUTE).select("event_id", F.col("in_minute").cast("long").alias("in_minute"), "allowed")


def quota_daily(spark, sf_dir):
    return admission.daily(_in(spark, sf_dir, "REQUESTS"), PER_IP, OVERALL).select("event_id", "day", "allowed", "blocked_by")


def quota_resumed(spark, sf_dir):
    """As quota_daily, going on from stored counters: every third ip has sent a request of the day before, every tenth two."""
    requests = _in(spark, sf_dir, "REQUESTS")
    ips = requests.select(admission.day().alias("day"), "ip").distinct().where("ip % 3 = 0").select("day", "ip", F.when(F.col("ip") % 10 == 0, 2).otherwise(1).alias("n"))
    days = requests.select(admission.day().alias("day")).distinct().select("day", F.lit(None).cast("long").alias("ip"), F.lit(150).alias("n"))
    return admission.daily(requests, PER_IP, OVERALL, ips.unionByName(days)).select("event_id", "day", "allowed", "blocked_by")


def quota_weighted(spark, sf_dir):
    return admission.weighted(_in(spark, sf_dir, "REQUESTS"), 20, 1500)


def admission_outcome(spark, sf_dir):
    n = F.col("page_id")
    pick = lambda k, values: F.array(*[F.lit(v) for v in values])[(F.floor(n / k) % len(values)).cast("int")]
    rows = _in(spark, sf_dir, "PAGES").select(
        "page_id",
        pick(1, ["POST", "POST", "POST", "GET", "OPTIONS", "POST"]).alias("method"),
        pick(2, ["/scan", "/scan-site", "/health", "/scan", "/other"]).alias("path"),
        pick(3, ["https://a.example", None, "https://b.example", "https://a.example"]).alias("origin"),
        pick(5, ["https://a.example/x", "https://c.example/", ""]).alias("referer"),
        pick(1, ['{"url":"https://example.com/","token":"t"}', '{"url":"http://10.0.0.1/","token":"t"}', "{bad", '{"token":"t"}', '{"url":"ftp://x.com/","token":"t"}', '{"url":"https://example.com/"}', '{"url":"https://example.com/a","token":"t"}']).alias("body"),
        (n % 4 != 1).alias("human"),
    )
    o = admission.outcome(["https://a.example"], ["https://d.example"])
    return rows.select("page_id", o.alias("o")).select("page_id", "o.http_status", "o.error")


def stream_quota(spark, sf_dir):
    """The day's counts by ip, made by a stream over the events and read back."""
    import uuid

    from crawlens.session import shared_dir

    path = f"{shared_dir(spark)}/crawlens-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, since a stream's source may be one file or a folder of them.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    # The table's times are UTC without a zone; a watermark needs instants.
    instant = F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)").alias("ts")
    counts = admission.stream_counts(events.select(instant, F.col("user_id").alias("ip")))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = counts.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("day", "ip").agg(F.max("n").alias("n"))


QUERIES = (
    page_features, heading_levels, block_status, url_parts, robots_rules, robots_sitemaps, robots_rulings, crawler_access, llms_files, jsonld_nodes, schema_types,
    dimension_scores, answer_readiness, findings, fixes_ranked, top_fixes, page_report, grade_histogram, extracted_content, sitemap_locs, nav_links, discovery_summary,
    discovery_candidates, section_counts, site_sample, truncated_sections, site_score, site_lists, site_capped, site_scan, site_summary, page_summary, console_report, tool_scan_url, tool_scan_site, tool_errors,
    ssrf_urls, dns_check, redirect_chain, fetched_bodies, fetch_profiles, capped_bodies, rate_minute, quota_daily, quota_resumed, quota_weighted, admission_outcome, stream_quota,
)
