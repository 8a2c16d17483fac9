"""Token counts without ids: pieces of each distinct pre-token, joined to frequencies.

Per document the pre-tokens are counted; pieces are counted once for each distinct
pre-token and joined to the document's frequencies by a hash lookup; the products are
summed. No id list of a text is made. The join is inside the task: the pre-tokens of all
documents, grouped and shuffled to one table of distinct pre-tokens, would be more data
than the texts themselves. The table of a task is emptied when it holds LIMIT entries
(entries are then counted again), so memory is bounded and no row is dropped.

Defined results: null text counts as empty (0 bytes, 0 tokens). The strings of added
tokens inside a text count as one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import batches_of

#: Distinct pre-tokens a task holds at most.
LIMIT = 400_000
#: Characters below U+0250 by the pattern's classes (general categories L and N, White_Space); texts with others are split by the library.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = r"\t-\r \x85\xa0"
FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{NUMBERS}{LETTERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=4)
def counter(spec: bytes) -> PieceCounter:
    return PieceCounter(spec)


class PieceCounter:
    """Counts tokens by a tokenizer file of the byte-level kind."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        pre = conf["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or conf["normalizer"]:
            raise ValueError("pieces can be counted by pre-token for byte-level tokenizers without normalizer or prefix space")
        added = conf.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring characters can't be split off beforehand")
        self.tokenizer = Tokenizer.from_buffer(spec)
        self.pre = self.tokenizer.pre_tokenizer
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pieces: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if BEYOND.search(text):
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return FAST.findall(text)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Of a text's pre-tokens; and the number of added tokens in it."""
        if self.special is None or not (n := sum(1 for _ in self.special.finditer(text))):
            return Counter(self.pre_tokens(text)), 0
        found: Counter = Counter()
        for part in self.special.split(text):
            found.update(self.pre_tokens(part))
        return found, n

    def count(self, text: str) -> int:
        freq, n = self.frequencies(text)
        pieces = self.pieces
        if len(pieces) > LIMIT:
            pieces.clear()
        if new := [x for x in freq if x not in pieces]:
            for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                pieces[x] = len(e)
        return n + sum(map(mul, map(pieces.__getitem__, freq), freq.values()))


def counted(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every whole text. The tokenizer's file is of fixed size and sent once."""
    with open(tokenizer_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        c = counter(spec.value)
        for big in batches:
            for batch in batches_of(big):
                n = [c.count(x) if x else 0 for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def report(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """The contract's rows: doc_id, n_bytes, n_tokens, over_limit."""
    return counted(docs, tokenizer_path).withColumn("over_limit", F.col("n_tokens") > limit)
