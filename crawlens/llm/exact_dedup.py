"""Exact dedup [native]: keyed streaming state on disk, full bytes compared on every hit.

The rows' keys (digest, stable identifier, content locator) go through a Structured
Streaming aggregation whose keyed state is kept in RocksDB, without expiry: per digest
the number of rows, and identifier and locator of the row that stays. A digest that was
seen more than once is a hit; for hits the whole texts are read again and compared byte
by byte. Should texts of one digest differ, they are told apart by the texts themselves,
so the result never rests on the digest.

Defined results: null text counts as empty; a null identifier is smaller than any other;
of rows with equal text and equal identifier the one with the greatest locator stays;
an empty table gives an empty result; further columns are ignored here and kept by
`deduplicated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import fresh_dir, located, removed, settings, staged, text_of

#: State on disk, in bounded memory, logged as changes: a lost executor's state is restored from the shared folder.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else 4 MB are set aside for each partition's manifest
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # Without native code Hadoop starts a process for each permission it sets and each link it asks for: about 20 for a partition's
    # changelog through FileContext, and one that starts counts with the executor's whole memory for a moment. FileSystem needs 3.
    # The file system's own checksums are enough for a folder that is deleted when the run has ended.
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
}


#: A digest of more rows than this, and than one in SHARE of all, is dealt in parts of so many; at most SHARE digests are.
PART_ROWS, SHARE = 1000, 100_000


def fold(keys: DataFrame, checkpoint: str) -> DataFrame:
    """Run the rows of `keys` through the keyed state; per digest: keep, n.

    `checkpoint` holds the state and the versions it emitted; a stopped run goes on where
    it stopped, and a later run over a longer `keys` table takes in only the new files.
    """
    spark = keys.sparkSession
    versions = f"{checkpoint}/versions"

    def write(batch: DataFrame, batch_id: int) -> None:
        # One folder a batch, overwritten if the batch is repeated.
        batch.write.mode("overwrite").parquet(f"{versions}/batch={batch_id}")

    with settings(spark, **STATE):
        stream = spark.readStream.schema(keys.schema).option("maxBytesPerTrigger", str(64 << 30)).parquet(keys.inputFiles()[0].rsplit("/", 1)[0])
        state = stream.groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{checkpoint}/state").foreachBatch(write).start()
        query.awaitTermination()
    # Counts only grow and the kept place only rises, so the last version is the greatest.
    return spark.read.option("basePath", versions).parquet(versions).groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """One row per row of docs: its place, its group's size and the place of the row that stays.

    digest: the state's key, SHA-256 of the text by default; any function of the text is
    right, a weaker one only makes more hits to compare.
    """
    digest = F.unhex(F.sha2(text_of(text_col), 256)) if digest is None else digest
    rows = located(docs, "dedup-input")
    place = F.struct(F.col(id_col).alias("id"), F.col("__crawlens_file").alias("file"), F.col("__crawlens_row").alias("row"))
    texts = rows.select(place.alias("place"), digest.alias("digest"), text_of(text_col).alias("text"))
    keys = staged(texts.select("place", "digest", F.sha2("text", 256).alias("sha256")), "dedup-keys")
    spark = docs.sparkSession
    if not keys.inputFiles() or keys.isEmpty():
        return keys.select("place", "sha256", F.col("place").alias("keep"), F.lit(1).cast("long").alias("n"))
    # Written, so that the joins below read it behind an exchange of their own, which adaptive execution can split.
    checkpoint = fresh_dir(spark, "dedup-state")
    state = staged(fold(keys.select("place", "digest"), checkpoint), "dedup-classes")
    removed(spark, checkpoint)

    # Hits: the texts themselves, read again; equal texts have an equal least and greatest.
    # A third of all rows may share a digest, so its texts meet the hit in parts, as many as its count asks for, each combined by itself.
    most = max(PART_ROWS, keys.count() // SHARE)
    parts = F.ceil(F.col("n") / most).cast("int")
    hits = state.where("n > 1").select("digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    # Digests of more than `most` rows are at most SHARE in number.
    hot = state.where(F.col("n") > most).select("digest", parts.alias("parts"))
    dealt = texts.join(F.broadcast(hot), "digest", "left") if not hot.isEmpty() else texts.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1))).cast("int")
    met = dealt.select("digest", part.alias("part"), "text").join(hits.hint("shuffle_hash"), ["digest", "part"], "left_semi")
    some = met.groupBy("digest", "part").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    clash = some.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("digest")
    clash = staged(clash, "dedup-clash")
    out = keys.join(state, "digest").select("place", "digest", "sha256", "keep", "n")
    if clash.isEmpty():
        return out.drop("digest")
    apart = texts.join(clash, "digest", "left_semi")
    groups = apart.groupBy("digest", "text").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
    settled = apart.join(groups, ["digest", "text"]).select("place", F.sha2("text", 256).alias("sha256"), "keep", "n")
    return out.join(clash, "digest", "left_anti").drop("digest").unionByName(settled)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's rows: doc_id, keep_id, group_size, kept, text_sha256."""
    return classes(docs, id_col, text_col).select(
        F.col("place.id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("keep")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text another row has that stays."""
    rows = located(docs, "dedup-rows")
    gone = classes(rows.drop("__crawlens_file", "__crawlens_row"), id_col, text_col).where("place != keep").select(F.col("place.file").alias("__crawlens_file"), F.col("place.row").alias("__crawlens_row"))
    return rows.join(gone.hint("shuffle_hash"), ["__crawlens_file", "__crawlens_row"], "left_anti").select(*docs.columns)
