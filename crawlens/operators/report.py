"""From pages and their sites' files to page reports: one pass, two joins, no other shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.constants import CONTENT_CHARS, SEVERITIES
from crawlens.functions import urls
from crawlens.functions.columns import grade, present, whole
from crawlens.operators import block, dimensions, llms_txt, robots
from crawlens.sources.pages import parsed


def site_files(robots_txt: DataFrame, llms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per origin: groups of robots.txt (status 200 and not blank); presence and shape of llms.txt."""
    groups = robots_txt.where((F.col("status") == 200) & present(F.col("body")))
    shape = llms_txt.shape(F.col("body"))
    here = F.coalesce(F.col("status") == 200, F.lit(False)) & present(F.col("body"))
    files = llms.select("origin", F.struct(here.alias("present"), (here & shape.ok).alias("well_formed"), shape.detail.alias("detail"), F.coalesce("full_present", F.lit(False)).alias("full_present")).alias("llms"))
    # A site without an agent line has groups too: none.
    return groups.select("origin").join(robots.groups(groups), "origin", "left").select("origin", F.coalesce("groups", F.expr("cast(array() as array<struct<agents:array<string>,rules:array<struct<line_no:int,kind:string,pattern:string,regex:string,length:int>>>>)")).alias("groups")), files


def contexts(pages: DataFrame, robots_txt: DataFrame, llms: DataFrame) -> DataFrame:
    """All that the scores need, a row for each page. pages: url, final_url, status, x_robots_tag, html and more."""
    groups, files = site_files(robots_txt, llms)
    marked = pages.withColumn("marks", block.markers(F.col("html")))
    rows = parsed(marked).withColumn("origin", urls.origin(F.col("url"))).withColumn("path", urls.path(F.coalesce("final_url", "url")))
    none = F.struct(F.lit(False).alias("present"), F.lit(False).alias("well_formed"), F.lit("absent").alias("detail"), F.lit(False).alias("full_present"))
    joined = rows.join(groups, "origin", "left").join(files, "origin", "left").withColumn("llms", F.coalesce("llms", none))
    return joined.withColumn("rulings", robots.rulings()).withColumn("directives", dimensions.directives()).drop("groups")


def total(names) -> Column:
    parts = sum((F.col(n).score for n in names), F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), whole(parts.cast("double"))))


def scored(contexts_: DataFrame) -> DataFrame:
    """contexts with block, each dimension's struct(score, max, findings), answers, total and grade."""
    out = contexts_.withColumn("block", block.verdict())
    for name, scorer in dimensions.SCORERS:
        out = out.withColumn(name, scorer())
    out = out.withColumn("answers", dimensions.answers()).withColumn("total", total([n for n, _ in dimensions.SCORERS]))
    return out.withColumn("grade", grade(F.col("total"))).withColumn("notes", notes())


def notes() -> Column:
    b = F.col("block")
    return F.array_compact(F.array(F.when(b.status != "OK", F.concat(F.lit("The score describes what was served: "), b.reason)), F.when(F.col("rulings").isNull(), F.lit("No robots.txt was found."))))


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in SEVERITIES.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def findings_of(dimension: str, order: int) -> Column:
    """A dimension's findings with its place, score and the share of its gap each one has."""
    d = F.col(dimension)
    bad = F.filter(d.findings, lambda f: ~f.positive)
    all_weights = F.aggregate(bad, F.lit(0), lambda a, f: a + weight(f.severity))
    gap = (d.max - d.score).cast("double")

    def one(f: Column, i: Column) -> Column:
        share = F.when(~f.positive & (all_weights > 0), gap * weight(f.severity) / all_weights)
        impact = F.floor((share + 0.01) * 10 + 0.5) / 10
        return F.struct(F.lit(dimension).alias("dimension"), F.lit(order).alias("dimension_no"), i.alias("finding_no"), f.code.alias("code"), f.severity.alias("severity"), f.positive.alias("positive"), f.message.alias("message"), impact.alias("impact"))

    return F.transform(d.findings, one)


def findings() -> Column:
    """All findings of the six dimensions, in order; arrays, so no shuffle."""
    return F.concat(*[findings_of(n, i) for i, (n, _) in enumerate(dimensions.SCORERS)])


def fixes(found: Column | None = None) -> Column:
    """The findings to mend, by impact, then severity, then order of report."""
    found = findings() if found is None else found
    bad = F.filter(found, lambda f: ~f.positive)
    keyed = F.transform(bad, lambda f: F.struct((-f.impact).alias("i"), (-weight(f.severity)).alias("w"), f.dimension_no.alias("d"), f.finding_no.alias("n"), f.alias("fix")))
    return F.transform(F.array_sort(keyed), lambda k: k.fix)


def content() -> Column:
    """The text as extracted, cut at the limit, with its flags."""
    text = F.col("facts.visible_text")
    return F.struct(
        F.substring(text, 1, CONTENT_CHARS).alias("text"),
        (F.length(text) > CONTENT_CHARS).alias("truncated"),
        F.length(text).alias("original_length"),
        F.col("facts.word_count").alias("word_count"),
        (F.col("block.status") != "OK").alias("blocked"),
        F.col("answers").dropFields("findings", "score", "grade").alias("answer_structure"),
    )
