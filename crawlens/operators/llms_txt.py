"""llms.txt: shape of the file and its score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlens.constants import WHITE
from crawlens.functions.columns import trimmed


def shape(body: Column) -> Column:
    """struct(ok, detail): not blank, no HTML, a # title line, and a ## line or a link. Headings are looked for line by line."""
    text = F.coalesce(body, F.lit(""))
    rows = F.split(text, r"\r?\n")
    has = lambda p: F.exists(rows, lambda x: x.rlike(p))
    title, sub, link = has(f"^#[{WHITE}]+[^{WHITE}]"), has(f"^##[{WHITE}]+[^{WHITE}]"), text.rlike(r"\[[^\]]+\]\([^)]+\)")
    detail = (
        F.when(trimmed(text) == "", "empty")
        .when(trimmed(text).rlike(r"(?i)^<(!doctype|html|head|body)"), "html")
        .when(~title, "no title")
        .when(~sub & ~link, "no sections or links")
        .otherwise("ok")
    )
    return F.struct((detail == "ok").alias("ok"), detail.alias("detail"))
