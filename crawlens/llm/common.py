"""What the corpus operators share: staged tables, row locators and Arrow helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.session import shared_dir

#: Logical nodes that keep one output row per stored row, so that a row's place in its file identifies it.
ROW_KEEPING = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared folder (driver and executors see it)."""
    return f"{shared_dir(spark)}/crawlens-{name}-{uuid.uuid4().hex}"


#: A write's shuffle files are dropped when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for one step (names with dots, as a dictionary)."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str, records: int | None = None) -> DataFrame:
    """Cut lineage by a written table in the shared folder; survives the loss of executors. records: rows handed to Python at once, where they are large."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with settings(spark, **{CLEANUP: "true"} | ({RECORDS: str(records)} if records else {})):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(df: DataFrame, name: str = "rows") -> DataFrame:
    """df with `__crawlens_file` and `__crawlens_row`, the place of each stored row.

    A frame that isn't a plain file scan (joins, unions, in-memory rows) is written to
    the shared folder first, so that the locator is stable when a task is repeated.
    """

    def plain(plan) -> bool:
        kids = plan.children()
        return plan.nodeName().split(" ")[0] in ROW_KEEPING and all(plain(kids.apply(i)) for i in range(kids.size()))

    if not plain(df._jdf.queryExecution().analyzed()):
        df = staged(df, name)
    elif not df.inputFiles():
        df = staged(df, name)
    meta = df.metadataColumn("_metadata")
    return df.select("*", meta["file_path"].alias("__crawlens_file"), meta["row_index"].alias("__crawlens_row"))


def free(name: str, taken: list[str]) -> str:
    """name, with underscores after it as long as a column is called so already (in any case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def text_of(col: str = "text"):
    """Null text counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def batches_of(table_or_batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller slices, so that what Python holds at once stays bounded."""
    for start in range(0, table_or_batch.num_rows, rows):
        yield table_or_batch.slice(start, rows)


def trimmed(run: Callable) -> Callable:
    """run, a pass over batches, that gives freed memory back to the system when it has ended: a worker without work counts in its executor's memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            removed(spark, folder)
