"""Line dedup [native]: lines that are boilerplate of their site.

A page's visible text is cut into lines at block-level tags. By host, the pages that
contain a line are counted and divided by the host's pages; a line over the ratio is
dropped from the host's pages. Counting is on the lines' MD5 (16 bytes), each once per
page, combined before the shuffle. A host's dropped lines are at most (lines per page) /
ratio in number, whatever the host's size, so they travel as one array per host.

Defined results: pages are read whole, however long; null or url without host: host '' (a site like any other); null html:
no lines; sites with fewer than `min_pages` pages aren't judged; repeated rows count as
pages; blank lines are neither counted nor kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.llm.urls import host_of

#: A host of more pages than this, and than one in SHARE of all, is dealt in parts of so many; at most SHARE hosts are.
PART_ROWS, SHARE = 100, 100_000

#: What isn't closed is hidden to the end; no tag holds a <, so that a page of unclosed tags is read once.
HIDDEN = r"(?is)<(?:script[^<>]*>.*?(?:</script\s*>|\z)|style[^<>]*>.*?(?:</style\s*>|\z)|noscript[^<>]*>.*?(?:</noscript\s*>|\z)|!--.*?(?:-->|\z))"
BLOCK = r"(?i)</?(?:html|head|title|body|p|div|section|article|main|header|footer|nav|aside|ul|ol|li|table|tr|h1|h2|h3|h4|h5|h6|br)(?:[\s/][^<>]*)?>"
TAG = r"<[^<>]*>"
#: White space that isn't one blank already: most isn't touched.
SPACE = r"[ \t\r\f]{2,}|[\t\r\f]"


def lines_of(html: str) -> Column:
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    text = F.regexp_replace(text, SPACE, " ")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def dropped_lines(lines: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """host, dropped: array of the keys of the lines over the ratio. lines: host, lines."""
    total = lines.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    seen = lines.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", key(F.col("line")).alias("line")).agg(F.count(F.lit(1)).alias("n"))
    over = seen.where("n > 1").join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.collect_set("line").alias("dropped"))


def cleaned(pages: DataFrame, ratio: float = 0.3, min_pages: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, n_lines, n_dropped, text: the kept lines, joined by line feeds."""
    lines = pages.select(F.col(id_col), host_of(url_col).alias("host"), lines_of(html_col).alias("lines"))
    # One host may hold a third of the pages: its pages are dealt in parts, its one array is copied to each.
    most = max(PART_ROWS, pages.count() // SHARE)
    hot = pages.groupBy(host_of(url_col).alias("host")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dropped = dropped_lines(lines, ratio, min_pages).join(F.broadcast(hot), "host", "left").select("host", "dropped", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    known = lines.join(F.broadcast(hot), "host", "left").withColumn("part", F.pmod(F.xxhash64(id_col), parts).cast("int")).join(dropped, ["host", "part"], "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("dropped"), key(x))))
    out = known.select(id_col, "host", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select(id_col, "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def report(pages: DataFrame, ratio: float = 0.3, min_pages: int = 5) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_sha256 of every page."""
    return cleaned(pages, ratio, min_pages).select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def oracle(ratio: float = 0.3, min_pages: int = 5) -> str:
    return rf"""
        WITH cut AS (
            SELECT page_id,
                   translate(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), '{SPACE}', ' ', 'g') AS body
            FROM pages
        ), lined AS (
            SELECT page_id, host, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines FROM cut
        ), total AS (
            SELECT host, count(*) AS pages FROM lined GROUP BY host HAVING count(*) >= {min_pages}
        ), seen AS (
            SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY host, line
        ), dropped AS (
            SELECT host, list(line) AS gone FROM seen JOIN total USING (host) WHERE n > 1 AND n > {ratio}::DOUBLE * pages GROUP BY host
        ), kept AS (
            SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM lined LEFT JOIN dropped USING (host)
        )
        SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM kept
    """
