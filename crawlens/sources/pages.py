"""Fetched pages as a table, and their facts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crawlens.functions import htmltree


def parsed(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages, without the markup, with its `facts`: parsed once, in Arrow batches.

    mapInArrow is opaque to the optimizer, so that no later use of the facts parses again.
    """
    kept = [c for c in pages.columns if c != html_col]
    facts = T._parse_datatype_string(htmltree.FACTS)
    schema = T.StructType([*(T.StructField(pages.schema[c].name, pages.schema[c].dataType, True) for c in kept), T.StructField("facts", facts)])
    kind = to_arrow_schema(T.StructType([T.StructField("facts", facts)])).field("facts").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                made = pa.array([htmltree.facts(x) for x in batch.column(html_col).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, "facts"])

    return pages.select(*kept, html_col).mapInArrow(run, schema)


def capped(body: str, most: int):
    """A binary body as text: at most so many bytes, what isn't UTF-8 replaced."""
    return F.make_valid_utf8(F.expr(f"cast(substring({body}, 1, {most}) as string)"))
