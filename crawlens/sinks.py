"""Reports as text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.constants import DIMENSIONS, MAX_NAMES, MAX_PAGES, MAX_TYPES
from crawlens.functions.columns import bar
from crawlens.operators import report, robots


def shortened(names: Column, most: int) -> Column:
    """The first of some names, parted by commas, with an ellipsis if there are more."""
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, ", …").otherwise(""))


def percent(part: Column, whole_: Column) -> Column:
    """A share as text: whole percent, halves up."""
    return F.concat(F.floor(part * 100 / whole_ + 0.5).cast("string"), F.lit("%"))


def fix_lines(top: int) -> Column:
    fixes = F.transform(F.slice("fixes", 1, top), lambda f: F.concat(F.lit("  - ["), f.severity, F.lit("] "), f.code, F.lit(" +"), F.format_string("%.1f", f.impact)))
    return F.when(F.size("fixes") > 0, F.concat(F.lit("fixes\n"), F.array_join(fixes, "\n"))).otherwise("fixes none")


def page_summary(top: int = 5) -> Column:
    """A page's report in lines. Columns: those of report.scored, and fixes."""
    block = F.when(F.col("block.status") == "OK", "OK").otherwise(F.concat(F.col("block.status"), F.lit(" ("), F.col("block.reason"), F.lit(")")))
    dims = [F.format_string("  %-22s %s %d/%d", F.lit(n), bar(F.col(n).score, F.lit(m)), F.col(n).score, F.lit(m)) for n, m in DIMENSIONS]
    types, shut = F.col("facts.jsonld_types"), robots.blocked(F.col("rulings"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("page "), F.col("url")),
        F.when(F.col("final_url") != F.col("url"), F.concat(F.lit("read at "), F.col("final_url"))),
        F.format_string("score %d/100 (%s)", F.col("total"), F.col("grade")),
        F.concat(F.lit("block "), block),
        F.format_string("answers %d/100 (%s)", F.col("answers.score"), F.col("answers.grade")),
        *dims,
        F.concat(F.lit("text "), percent(F.col("facts.text_ratio"), F.lit(1.0)), F.lit(" of the markup")),
        F.when(F.size(types) > 0, F.concat(F.lit("types "), shortened(types, MAX_TYPES))),
        F.when(F.size(shut) > 0, F.concat(F.lit("refused "), shortened(shut, MAX_NAMES))),
        fix_lines(top),
    )


def console_report() -> Column:
    """A page's report as a command prints it: one fix more, and the notes."""
    notes_ = F.transform("notes", lambda x: F.concat(F.lit("  - "), x))
    return F.concat_ws("\n", page_summary(6), F.when(F.size("notes") > 0, F.concat(F.lit("notes\n"), F.array_join(notes_, "\n"))))


def site_summary(cap: Column | int = MAX_PAGES, lists: bool = False) -> Column:
    """A site's roll-up in lines. lists: the roll-up has lists, not counts."""
    score = F.when(F.col("total").isNull(), F.concat(F.lit("score n/a: "), F.col("unscorable"))).otherwise(F.format_string("score %d/100 (%s) of %d pages", F.col("total"), F.col("grade"), F.col("counted")))
    spread = F.format_string("pages mean %.1f median %.1f stdev %.1f min %.1f max %.1f", "page_mean", "page_median", "page_stdev", "page_min", "page_max")
    counts = [F.size(k) if lists else F.col(f"n_{k}") for k in ("hard_blocked", "soft_blocked", "robots_disallowed", "noindexed")]
    return F.concat_ws(
        "\n",
        F.concat(F.lit("site "), F.col("origin")),
        F.format_string("pages %d (at most %d)", F.col("pages"), F.lit(cap) if isinstance(cap, int) else cap),
        score,
        F.when(F.col("total").isNotNull(), spread),
        F.format_string("site level access %d/22 llms %d/8", F.col("access"), F.col("llms")),
        F.when(F.col("answer_mean").isNotNull(), F.format_string("answers mean %.1f/100", "answer_mean")),
        F.format_string("inaccessible %d of %d", F.col("inaccessible"), F.col("pages")),
        F.format_string("hard %d soft %d robots %d noindex %d", *counts),
        F.when(F.col("worst_url").isNotNull(), F.concat(F.lit("worst "), F.col("worst_url"), F.format_string(" %d/100", F.col("worst_total")))),
    )


def tool_error(reason: Column) -> Column:
    """A failed tool's answer by its reason: a target that may not be read, or a scan that didn't come to an end."""
    shut = F.startswith(reason, F.lit("blocked:"))
    detail = F.when(shut, F.substring(reason, len("blocked:") + 1, 10_000)).otherwise(reason)
    data = F.struct(F.when(shut, "blocked_host").otherwise("scan_failed").alias("error"), detail.alias("detail"))
    return tool_result(F.concat(F.when(shut, "refused: ").otherwise("scan failed: "), detail), data, F.lit(True))


def tool_result(text: Column, structured: Column, failed: Column) -> Column:
    """struct(text, structured, is_error): a tool's answer, its data as JSON text."""
    return F.struct(text.alias("text"), F.to_json(structured).alias("structured"), failed.alias("is_error"))


def json_text(data: Column, pretty: bool = False) -> Column:
    """A report as JSON text, on one line or indented."""
    return F.to_json(data, {"pretty": "true"} if pretty else None)


def write_json(df: DataFrame, path: str) -> None:
    """Reports, one JSON object in a line."""
    df.write.json(path)


def write_parquet(df: DataFrame, path: str, buckets: int = 0, files: int = 8) -> None:
    """Reports, for large runs in folders by hash of their origin so that later reads of a site prune; a folder's rows are dealt over `files` tasks."""
    if not buckets:
        df.write.parquet(path)
        return
    bucket = F.pmod(F.xxhash64("origin"), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("url"), F.lit(files))).write.partitionBy("bucket").parquet(path)


def with_text(scored: DataFrame) -> DataFrame:
    """scored with fixes, summary and content."""
    return scored.withColumn("fixes", report.fixes()).withColumn("content", report.content()).withColumn("summary", page_summary())
