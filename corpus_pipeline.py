"""A training-data pipeline over `documents`: language, copies, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns
of documents; the last adds the packed token ids. Documents are only dropped by a decision
of an operator; what each rejects is stated at its stage. Null texts and texts without a
letter have no language and go at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.llm import bpe, decontaminate, exact_dedup, language, simhash
from crawlens.llm.common import free, released, staged, table

#: Mean of the words' greatest posteriors below which a document counts as of no known language.
LEAST_SCORE = 0.4
IDS, BACK = "__crawlens_ids", "__crawlens_decoded"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose words are named with a mean certainty under LEAST_SCORE, however many languages they are of."""
    named = language.tagged(docs, language.model_of(docs))
    return named.where((F.col(language.LANGUAGE) != language.UND) & (F.col(language.CERTAINTY) >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingle sets of Jaccard similarity 0.8 or more, the row with the least doc_id stays."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in which a benchmark item occurs within the edit budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids (packed little-endian unsigned 32-bit), n_tokens and round_trip: whether decoding gives the text back.

    Where documents has a column of that name, ours gets underscores after it.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    back = bpe.both_ways(docs, ranks, public_tokenizers.PATTERN, ids_col=IDS, back_col=BACK)
    same = F.col(BACK) == F.coalesce("text", F.lit("")).cast("binary")
    made = {"token_ids": F.col(IDS), "n_tokens": F.expr(f"cast(octet_length({IDS}) div 4 as bigint)"), "round_trip": same}
    return back.select(*docs.columns, *[c.alias(free(name, docs.columns)) for name, c in made.items()])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontaminate", decontaminated),
    ("bpe", tokens),
]

#: Language ID, SimHash and BPE aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            released(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
