"""Inputs derived from the test tables by SQL that both engines read alike.

The tables have pages, but no statuses, headers, robots.txt, llms.txt, sitemaps, redirects
or addresses. These are made from the rows themselves, by rules on their numbers, so that
every branch of the operators is reached and an oracle can start from the same rows.
Placeholders are {pages} and {events}; doubled braces stand for braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORIGIN = "regexp_extract(lower(url), '^(https?://[^/?#]+)', 1)"

HEAD_META = (
    '<meta name="description" content="A page of the test tables with a description that is long enough.">'
    '<link rel="canonical" href="https://example.com/x"><meta property="og:title" content="t"><meta property="og:description" content="d">'
    '<meta name="twitter:card" content="summary">'
)
HEAD_GRAPH = (
    '<script type="application/ld+json">{{"@graph":[{{"@type":"Organization","name":"o","sameAs":["https://example.org/o"]}},'
    '{{"@type":"Article","author":{{"@type":"Person","name":"p"}},"datePublished":"2026-01-01"}},{{"@type":"WebSite"}}]}}</script>'
)
HEAD_BROKEN = '<script type="application/ld+json">{{ no json }}</script><meta name="robots" content="noindex, nosnippet">'
HEAD_FAQ = (
    '<script type="application/ld+json">[{{"@type":["FAQPage","https://schema.org/WebPage"],"mainEntity":[{{"@type":"Question","name":"q"}}]}},'
    '{{"@type":"HowTo","name":"h"}},{{"@type":"BreadcrumbList"}},{{"@type":"Recipe"}}]</script><meta name="author" content="Somebody">'
)
BYLINE = '<article><p><span class="post-author">N. N.</span> <time datetime="2026-02-03">then</time></p>'
MAIN = '<main><div class="faq-box"><p>Parcels take three days.</p></div><article>'
BODY_QUESTIONS = (
    "<h2>What is this page about?</h2><p>In short it is a page that was made to have a paragraph of more than fifteen words after a heading.</p>"
    '<h2>Why is it so?</h2><h4>Steps</h4><ol><li>one</li><li>two</li></ol><table><tr><td>cell</td></tr></table><div itemscope itemtype="https://schema.org/Product">thing</div>'
)
SHELL = '<html><head><title>App</title></head><body><div id="__next"></div><script id="__NEXT_DATA__">var a;</script></body></html>'

PAGES = f"""
SELECT page_id, url, {ORIGIN} AS site,
       CASE page_id % 20 WHEN 3 THEN 301 WHEN 5 THEN 401 WHEN 7 THEN 403 WHEN 9 THEN 404 WHEN 11 THEN 429 WHEN 13 THEN 500 WHEN 15 THEN 503 WHEN 17 THEN NULL ELSE 200 END AS status,
       CASE WHEN page_id % 13 = 0 THEN 'noai, noimageai' WHEN page_id % 31 = 0 THEN 'none' END AS x_robots_tag,
       CASE page_id % 8
            WHEN 1 THEN replace(html, '</head>', '{HEAD_META}</head>')
            WHEN 2 THEN replace(html, '</head>', '{HEAD_GRAPH}</head>')
            WHEN 3 THEN replace(html, '</head>', '{HEAD_BROKEN}</head>')
            WHEN 4 THEN replace(html, '</article>', '{BODY_QUESTIONS}</article>')
            WHEN 5 THEN replace(html, '<article>', '<article><p>Checking your browser before you go on.</p>')
            WHEN 6 THEN replace(html, '<article>', '<article><p>Subscribe to read this, members only.</p>')
            WHEN 7 THEN '{SHELL}'
            ELSE CASE page_id % 24
                 WHEN 0 THEN replace(replace(replace(html, '</head>', '{HEAD_FAQ}</head>'), '<article>', '{MAIN}'), '</article>', '</article></main>')
                 WHEN 8 THEN replace(replace(replace(html, '<nav>', '<header><nav>'), '</nav>', '</nav></header>'), '<article>', '{BYLINE}')
                 ELSE html END END AS html
FROM (SELECT page_id, url, html FROM {{pages}}
      UNION ALL
      SELECT page_id + 1000000 AS page_id, {ORIGIN} || '/' AS url, html FROM {{pages}} WHERE page_id IN (SELECT min(page_id) FROM {{pages}} GROUP BY {ORIGIN}) AND page_id % 3 <> 1) p
"""

SITES = f"SELECT {ORIGIN} AS origin, min(page_id) AS k, count(*) AS n FROM {{pages}} GROUP BY 1"

ROBOTS = f"""
SELECT origin, CASE WHEN k % 7 = 6 THEN 404 ELSE 200 END AS status,
       CASE k % 5
            WHEN 0 THEN 'User-agent:' || chr(9) || '*' || chr(160) || chr(13) || chr(10) || chr(9) || 'Disallow:' || chr(9) || '/fr/1' || chr(13) || chr(10) || 'Allow:' || chr(160) || '/fr/*1*9' || chr(10) || 'Sitemap:' || chr(9) || origin || '/sitemap.xml' || chr(9)
            WHEN 1 THEN '# crawlers' || chr(10) || 'User-agent:' || chr(9) || 'GPTBot' || chr(10) || 'Disallow:' || chr(9) || '/' || chr(10) || chr(10) || 'User-agent: claude' || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /fr/ # not these' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /admin/'
            WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /en' || chr(10) || 'Allow: /en/*5' || chr(10) || 'Disallow: /*.html$'
            WHEN 3 THEN 'Disallow: /' || chr(10) || 'User-agent: Bytespider' || chr(10) || 'Sitemap: ' || origin || '/index.xml' || chr(10) || 'User-agent: Diffbot' || chr(10) || 'Allow: /de' || chr(10) || 'Disallow: /de' || chr(10) || 'Disallow: /es' || chr(10) || 'Crawl-delay: 5' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow:'
            ELSE ' ' || chr(9) || chr(10) || chr(160) END AS body
FROM ({SITES}) s
"""

LLMS = f"""
SELECT origin, CASE WHEN k % 4 = 3 THEN 404 ELSE 200 END AS status,
       CASE k % 6
            WHEN 0 THEN '# Site' || chr(10) || chr(10) || '> About.' || chr(10) || '## Pages' || chr(10) || '- [a](' || origin || '/a)'
            WHEN 1 THEN 'no title here, [a](' || origin || '/a)'
            WHEN 2 THEN chr(10) || chr(9) || '<!doctype html><html></html>'
            WHEN 3 THEN '#' || chr(10) || 'x'
            WHEN 4 THEN '# Title' || chr(10) || 'See [a](' || origin || '/a)'
            ELSE chr(9) || chr(10) END AS body,
       k % 3 = 0 AS full_present
FROM ({SITES}) s
"""

#: Sitemaps: plain ones list the site's pages; an index lists two children, one of another site and itself.
SITEMAPS = f"""
SELECT origin, origin || '/sitemap.xml' AS url, 200 AS status,
       '<urlset>' || locs || '<url><loc>https://other.example.com/en/1</loc></url><url><LOC> http://127.0.0.1/x </LOC></url></urlset>' AS body
FROM (SELECT s.origin, l.locs FROM ({SITES}) s JOIN (
        SELECT {ORIGIN} AS origin, {{agg}} AS locs FROM {{pages}} GROUP BY 1) l ON s.origin = l.origin WHERE s.k % 5 <> 3 AND s.k % 4 <> 1) a
UNION ALL
SELECT origin, origin || '/index.xml', 200,
       '<sitemapindex ><sitemap><loc>' || origin || '/a.xml</loc></sitemap><sitemap><loc>' || origin || '/index.xml</loc></sitemap><sitemap><loc>https://other.example.com/b.xml</loc></sitemap><sitemap><loc>' || origin || '/b.xml</loc></sitemap></sitemapindex>'
FROM ({SITES}) s WHERE k % 5 = 3
UNION ALL
SELECT origin, origin || '/a.xml', 200, '<urlset><url><loc>' || origin || '/en/1?a=1&amp;b=2</loc></url><url><loc>' || origin || '/blog/x</loc></url></urlset>' FROM ({SITES}) s WHERE k % 5 = 3
UNION ALL
SELECT origin, origin || '/b.xml', CASE WHEN k % 2 = 0 THEN 200 ELSE 500 END, '<urlset><url><loc>' || origin || '/blog/x</loc></url><url><loc>' || origin || '/blog/y</loc></url></urlset>' FROM ({SITES}) s WHERE k % 5 = 3
"""
SITEMAPS_SPARK_AGG = "array_join(transform(array_sort(collect_list(struct(page_id, url))), x -> '<url><loc>' || replace(x.url, '&', '&amp;') || '</loc></url>'), '')"
SITEMAPS_DUCK_AGG = "string_agg('<url><loc>' || replace(url, '&', '&amp;') || '</loc></url>', '' ORDER BY page_id)"

REDIRECTS = """
SELECT 'https://r.example.com/' || page_id AS url,
       CASE WHEN page_id % 9 = 8 THEN 200 ELSE 302 END AS status,
       CASE WHEN page_id % 9 = 7 THEN NULL WHEN page_id % 9 = 6 THEN 'http://169.254.169.254/meta' WHEN page_id % 9 = 8 THEN NULL
            WHEN page_id % 11 = 0 THEN 'https://r.example.com/' || page_id ELSE 'https://r.example.com/' || (page_id + 1) END AS location
FROM {pages}
"""

DNS = f"""
SELECT regexp_extract(origin, '^https?://([^/:]+)', 1) AS host, CASE k % 4 WHEN 0 THEN '93.184.216.34' WHEN 1 THEN '10.1.2.3' WHEN 2 THEN '8.8.8.8' ELSE '192.168.0.7' END AS address, 4 AS family, 0 AS ord
FROM ({SITES}) s WHERE k % 5 <> 4
UNION ALL
SELECT regexp_extract(origin, '^https?://([^/:]+)', 1), CASE k % 3 WHEN 0 THEN '172.16.9.9' ELSE '1.1.1.1' END, 4, 1 FROM ({SITES}) s WHERE k % 2 = 0
"""

REQUESTS = """
SELECT event_id, ts, user_id AS ip, CASE WHEN event_type IN ('purchase', 'click') THEN 'site' ELSE 'page' END AS route, CAST(1 + event_id % 15 AS INT) AS weight
FROM {events}
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the inputs as a DataFrame over the tables in sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "events") if f"{{{t}}}" in sql}
    return spark.sql(sql.replace("{agg}", SITEMAPS_SPARK_AGG), **tables)


def duck(sql: str) -> str:
    """The same input as DuckDB text."""
    return sql.replace("{agg}", SITEMAPS_DUCK_AGG).format(pages="pages", events="events")
