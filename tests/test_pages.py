"""Page facts, scores and reports, on pages written here."""

import time

import pytest
from pyspark.sql import functions as F

from crawlens.functions import htmltree
from crawlens.operators import llms_txt, report, robots
from crawlens.plans import site
from crawlens.sinks import with_text

ALLOW = "User-agent: *\nDisallow: /drafts\nSitemap: https://example.com/pages.xml"
GOOD_LLMS = "# Site\n\n## Pages\n- [a](https://example.com/a)"
RICH = (
    '<!DOCTYPE html><html lang="en"><head><title>A guide to reading pages by machine</title><meta name="Description" content="' + "d" * 80 + '"><link rel="canonical" href="https://example.com/g">'
    '<meta property="og:title" content="t"><meta property="og:description" content="d"><meta name="twitter:card" content="s"><meta name="author" content="J">'
    '<script type="application/ld+json">{"@graph":[{"@type":"Organization","sameAs":["x"]},{"@type":"WebSite"},{"@type":"BreadcrumbList"},'
    '{"@type":"Article","author":{"@type":"Person"},"publisher":{"@type":"Organization"},"datePublished":"2026"},{"@type":"FAQPage","mainEntity":[{"@type":"Question"}]},{"@type":"https://schema.org/Event"}]}</script></head>'
    "<body><header><nav><a href='/'>Home</a></nav></header><main><article><h1>Guide</h1><p>" + "word " * 150 + "</p><h2>What is it?</h2><p>" + "again " * 40 + "</p><h3>Why?</h3><p>short</p>"
    "<ol><li>one<li>two</ol><table><tr><td>a<td>b</table></article></main><footer><p>end</p></footer></body></html>"
)


def pages(spark, *rows):
    return spark.createDataFrame([(i, "https://example.com/" + str(i), None, s, x, h) for i, (s, x, h) in enumerate(rows)], "page_id bigint, url string, final_url string, status int, x_robots_tag string, html string")


def scored(spark, rows, robots_txt=ALLOW, llms=GOOD_LLMS, full=False):
    r = spark.createDataFrame([("https://example.com", 200 if robots_txt else 404, robots_txt)], "origin string, status int, body string")
    s = spark.createDataFrame([("https://example.com", 200 if llms else 404, llms, full)], "origin string, status int, body string, full_present boolean")
    return with_text(report.scored(report.contexts(pages(spark, *rows), r, s)))


def test_text_rules():
    f = htmltree.facts("<html><body><p>a<b>c</b>d<br>e</p><script>no</script><noscript>no</noscript><!-- no --><div>x&amp;y</div></body></html>")
    assert f["visible_text"] == "ac de x&y" and f["word_count"] == 3
    assert htmltree.facts(None)["word_count"] == 0 and htmltree.facts("")["text_ratio"] == 0.0
    assert htmltree.facts("<p>a<p>b<ul><li>c<li>d</ul>")["visible_text"] == "a b c d"
    assert htmltree.facts("<main>a</main><article>b</article>")["main_word_count"] == 1
    assert htmltree.facts("<p>cut off <b")["word_count"] >= 2
    assert htmltree.facts("<p>a &lt b<p>1 < 2 <3")["visible_text"] == "a < b 1 < 2 <3"
    assert htmltree.facts("<p title='a>b'>c</p><p title=\"d>e>f</p>")["word_count"] == 3
    assert htmltree.facts("<p>&#" + "9" * 6000 + ";</p>")["visible_text"] == "\ufffd"
    assert htmltree.facts("<h1>a<h2>b</h2><p>c d</p>")["headings"] == [{"level": 1, "text": "a", "next_tag": "h2", "next_words": 1}, {"level": 2, "text": "b", "next_tag": "p", "next_words": 2}]
    assert htmltree.facts("<title>\u00a0 t\ufeff\n</title>")["title"] == "t"
    nested = htmltree.facts("<main>a b<main>c</main></main><div id='root'> <i></i></div>")
    assert nested["main_word_count"] == 4 and nested["empty_root"]


MIB3 = 3 << 20
HOSTILE = {
    "deep": "<div>" * 10_000 + "x",
    "unclosed": "<a " * (MIB3 // 3),
    "unclosed, a tag at the end": "<a " * (MIB3 // 3) + ">",
    "quote": '<a x="' * (MIB3 // 6),
    "other quote": "<p a='" * (MIB3 // 6),
    "both quotes": "<a x='\" " * (MIB3 // 8) + "\">",
    "closed in quotes only": '<a ">"' * (MIB3 // 6),
    "names": "<a" * (MIB3 // 2),
    "signs": "<" * MIB3,
    "comments": "<!--" * (MIB3 // 4),
    "declarations": "<!" * (MIB3 // 2),
    "scripts": "<script " * (MIB3 // 8),
    "end tags": "</b>" * (MIB3 // 16),
    "unmatched end tags in the deep": "<div>" * 20_000 + "</b>" * 20_000,
    "paragraphs in the deep": "<div><p>" * 20_000,
    "nested headings": "<h1>a<table>" * 10_000,
    "nested mains": "<main>a " * 20_000,
    "blank": " " * MIB3,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_no_page_takes_long(name):
    """Two seconds of this process's time, and as much again for a busy machine."""
    start = time.process_time()
    htmltree.facts(HOSTILE[name])
    assert time.process_time() - start < 4


def test_deep_markup_in_a_job(spark):
    deep = "<div>" * 10_000 + "<p>x</p>"
    row = scored(spark, [(200, None, deep)]).first()
    assert row.facts.word_count == 1


def test_text_forms(spark):
    from crawlens import sinks

    rows = scored(spark, [(200, None, RICH)], robots_txt="User-agent: *\nDisallow: /")
    r = rows.withColumn("console", sinks.console_report()).withColumn("pretty", sinks.json_text(F.struct("url", "total"), pretty=True)).withColumn("plain", sinks.json_text(F.struct("url", "total"))).first()
    lines = r.summary.split("\n")
    assert lines[0] == "page https://example.com/0" and "types Organization, WebSite, BreadcrumbList, Article, Person, FAQPage, Question, Event" in lines
    assert "refused GPTBot, OAI-SearchBot, ChatGPT-User, ClaudeBot, Claude-User, anthropic-ai, …" in lines
    assert len(r.fixes) == sum(x.startswith("  - [") for x in lines) or len(r.fixes) > 5
    assert r.console.startswith(r.summary[: len("page https")]) and r.plain == '{"url":"https://example.com/0","total":%d}' % r.total
    assert r.pretty.split("\n")[1].strip().startswith('"url"')
    share = spark.range(1).select(sinks.percent(F.lit(1.0), F.lit(8.0)).alias("a"), sinks.shortened(F.array(F.lit("x"), F.lit("y")), 2).alias("b")).first()
    assert (share.a, share.b) == ("13%", "x, y")


def test_json_sink(spark, tmp_path):
    from crawlens import sinks

    sinks.write_json(spark.createDataFrame([("https://a.example", 3)], "origin string, total int"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("origin", "total").collect()] == [("https://a.example", 3)]
    rows = spark.createDataFrame([(f"https://{i % 3}.example", f"https://{i % 3}.example/{i}") for i in range(20)], "origin string, url string")
    sinks.write_parquet(rows, str(tmp_path / "table"), 2)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 20


def test_structured_data_of_a_page():
    bad = htmltree.facts('<script type="application/ld+json">{ no }</script><script type="application/ld+json"> </script>')
    assert (bad["jsonld_blocks"], bad["jsonld_invalid"], bad["jsonld_types"]) == (2, 1, [])
    assert htmltree.facts('<div itemtype="https://schema.org/Product" typeof="a:B c#D"></div>')["microdata_types"] == ["Product"]
    nodes = htmltree.facts(RICH)["jsonld_nodes"]
    assert [n["types"] for n in nodes] == [["organization"], ["website"], ["breadcrumblist"], ["article"], ["person"], ["organization"], ["faqpage"], ["question"], ["event"]]


def test_scores(spark):
    shell = '<html><head><title>App</title></head><body><div id="__next"></div></body></html>'
    rows = scored(spark, [(200, None, RICH), (200, "noai, none", RICH), (200, None, shell), (403, None, "x"), (None, None, None), (200, None, "<p>Members only</p>"), (302, None, ""), (500, None, "Just a moment")])
    r = {x.page_id: x for x in rows.collect()}
    s = lambda i: tuple(r[i][d].score for d in ("aiCrawlerAccess", "contentExtractability", "structuredData", "semanticStructure", "metadataProvenance", "llmsTxt"))
    assert s(0) == (22, 18, 20, 14, 12, 7) and r[0].total == 93 and r[0].grade == "A"
    assert s(1)[0] == 17 and s(2)[:5] == (22, 2, 0, 1, 0) and s(4) == (22, 3, 0, 0, 0, 7)
    assert [(r[i].block.status, r[i].block.reason) for i in range(8)] == [
        ("OK", "ok"), ("OK", "ok"), ("SOFT_BLOCK", "js_only_shell"), ("HARD_BLOCK", "http_403"), ("HARD_BLOCK", "network_error"), ("SOFT_BLOCK", "gated_content"), ("OK", "http_302"), ("HARD_BLOCK", "bot_challenge"),
    ]
    assert r[0].answers.score == 22 + 20 + 13 + 6 and r[0].answers.question_headings == 2
    assert r[2].fixes[0].code in ("extract.js_only", "schema.none") and [f.impact for f in r[2].fixes] == sorted((f.impact for f in r[2].fixes), reverse=True)
    gap = sum(d[1] - x for d, x in zip((("a", 22), ("b", 22), ("c", 20), ("d", 16), ("e", 12), ("f", 8)), s(2)))
    assert abs(sum(f.impact for f in r[2].fixes) - gap) < 0.1 * len(r[2].fixes) + 0.5
    assert r[0].content.original_length == len(r[0].content.text) and not r[0].content.truncated and r[3].content.blocked
    assert r[0].summary.startswith("page https://example.com/0\nscore 93/100 (A)")


def test_long_content_is_cut(spark):
    c = scored(spark, [(200, None, "<body>" + "word " * 5000 + "</body>")]).first().content
    assert c.truncated and len(c.text) == 20000 and c.original_length == 24999


ROBOTS = [
    ("User-agent: *\nDisallow: /blog\nAllow: /blog/public", "GPTBot", "/blog/private", False),
    ("User-agent: *\nDisallow: /blog\nAllow: /blog/public", "GPTBot", "/blog/public/post", True),
    ("User-agent: *\nDisallow:", "GPTBot", "/anything", True),
    ("User-agent: *\nDisallow: /*.pdf$", "GPTBot", "/files/report.pdf", False),
    ("User-agent: *\nDisallow: /*.pdf$", "GPTBot", "/files/report.pdfx", True),
    ("User-agent: gptbot\nDisallow: /\nUser-agent: *\nAllow: /", "GPTBot", "/", False),
    ("User-agent: claude\nDisallow: /a", "Claude-User", "/a/b", False),
    ("User-agent:\nDisallow: /", "Diffbot", "/", False),
    ("Disallow: /\nUser-agent: other\nDisallow: /", "Diffbot", "/", True),
    ("User-agent: *\nDisallow: /a\nAllow: /a", "Diffbot", "/a", True),
    ("User-agent: *\nDisallow: *", "Diffbot", "/a", False),
    ("User-agent:\tGPTBot\r\n\tDisallow:\t/x\u00a0", "GPTBot", "/x/y", False),
    ("\ufeffUser-agent: GPTBot\nDisallow: /x", "GPTBot", "/x/y", False),
    ("User-agent: *\nDisallow: /a**b*c$", "CCBot", "/a-b--c", False),
    ("User-agent: *\nDisallow: /a**b*c$", "CCBot", "/a-b--c-", True),
    ("User-agent: *\nDisallow: /*a*b", "CCBot", "/bbaab", False),
    ("User-agent: *\nDisallow: /*ab*ba$", "CCBot", "/aba", True),
    ("User-agent: *\nDisallow: /*.(x)$", "CCBot", "/q.(x)", False),
    ("User-agent: *\nDisallow: /" + "*a" * 30 + "b", "CCBot", "/" + "a" * 3000, True),
    ("User-agent: CCBot\nSitemap: x\nUser-agent: Diffbot\nDisallow: /q", "CCBot", "/q", False),
    ("User-agent: CCBot\nCrawl-delay: 1\nUser-agent: Diffbot\nDisallow: /q", "CCBot", "/q", True),
]


def test_robots(spark):
    df = spark.createDataFrame([(str(i), body) for i, (body, *_) in enumerate(ROBOTS)], "origin string, body string")
    asked = spark.createDataFrame([(str(i), bot, path) for i, (_, bot, path, _) in enumerate(ROBOTS)], "origin string, bot string, path string")
    rows = robots.groups(df).join(asked, "origin").select("origin", robots.ruling(robots.matched(F.col("groups"), F.col("path")), F.col("bot")).alias("r")).collect()
    assert {int(x.origin): x.r.allowed for x in rows} == {i: c[3] for i, c in enumerate(ROBOTS)}


def test_llms_shape(spark):
    cases = {"# T\n\n## S": True, "# T\n[a](b)": True, "": False, None: False, "<!doctype html><html></html>": False, "text\n- [a](https://x.com)": False, "#\nx": False, "# T\nno more": False, "\n\t<!doctype html># T\n## S": False, "#\u00a0T\n##\tS": True, "\n\u00a0": False}
    df = spark.createDataFrame([(b,) for b in cases], "b string").select(llms_txt.shape(F.col("b")).alias("s"))
    assert [r.s.ok for r in df.collect()] == list(cases.values())


ROW = "origin string, ord int, url string, block string, portion int, access int, llms int, total int, answers int, disallowed boolean, noindex boolean"


def roll(spark, rows, cap=None):
    out = [("https://e.com", i, "https://e.com/" + (str(i) if i else ""), b, p, a, m, t, 50, d, n) for i, (b, p, a, m, t, d, n) in enumerate(rows)]
    df = spark.createDataFrame(out, ROW)
    return (site.capped(df, cap) if cap else site.rolled_up(df, lists=True)).first()


def test_roll_up(spark):
    ok = lambda p, t=80: ("OK", p, 20, 8, t, False, False)
    hard = ("HARD_BLOCK", 5, 20, 8, 9, True, True)
    r = roll(spark, [ok(62), ok(70), hard])
    assert (r.page_mean, r.counted, r.inaccessible, r.pages, r.site_level) == (66.0, 2, 1, 3, 28.0) and r.total == 94
    assert r.hard_blocked == ["https://e.com/2"] and r.robots_disallowed == ["https://e.com/2"] and r.noindexed == ["https://e.com/2"]
    assert roll(spark, [ok(70), ("SOFT_BLOCK", 8, 1, 1, 20, False, False)]).page_mean == 39.0
    r = roll(spark, [ok(70), ok(70), ok(10, 30)])
    assert (r.page_mean, r.page_median, r.page_stdev, r.page_min, r.page_max, r.worst_url) == (50.0, 70.0, 28.3, 10.0, 70.0, "https://e.com/2")
    r = roll(spark, [hard, hard])
    assert r.total is None and r.grade is None and r.page_mean is None and r.unscorable == "every page was blocked" and r.worst_url is None
    r = roll(spark, [(None,) * 5 + (None, None), ok(40)])
    assert r.site_source == "https://e.com/1" and r.inaccessible == 1
    assert roll(spark, [(None,) * 7]).unscorable == "nothing could be read"
    assert roll(spark, [ok(62), ok(70), hard], cap=1).pages == 1 and roll(spark, [ok(62), ok(70), hard], cap=0.2).pages == 1


def test_markers_make_the_head_once(spark):
    from crawlens.operators import block

    rows = spark.createDataFrame([("<p>Just a MOMENT, members only</p>",), ("x",), (None,)], "html string").select(block.markers(F.col("html")).alias("m"))
    assert rows._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    assert [tuple(r.m) for r in rows.collect()] == [("just a moment", "members only"), (None, None), (None, None)]
