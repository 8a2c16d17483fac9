"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved until its parts are short; a part is encoded by the library's merges.
Two neighbours are joined by encoding anew a window around their boundary. The window
grows until both its ends lie on cuts where the pattern must end one match and begin the
next, whatever stands around: after a character that is no white space and before ASCII
white space, or between ASCII letters and digits. No match spans such a cut and no
alternative of the pattern looks back, so the tokens outside the window are those of the
whole text. Joining is associative, with the empty text as identity.

Decoding concatenates the halves' bytes up the tree.

Defined results: null or empty text has no ids; `token_ids` is packed as little-endian
unsigned 32-bit integers (empty binary for no ids); other columns are kept.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import batches_of, free

#: Parts of at most so many characters are encoded directly.
LEAF = 1 << 14
#: First window on either side of a boundary.
WINDOW = 32
#: Cuts that hold in any context. Python's \S excludes more than the pattern's, which is the safe side.
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


class Codec:
    """Encodes and decodes by a rank file's bytes and a split pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        merge = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merge, special_tokens={})
        self.width = np.zeros(max(merge.values(), default=0) + 1, np.int64)
        for token, rank in merge.items():
            self.width[rank] = len(token)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        if len(text) <= max(leaf, 2):
            return self.encoding.encode_ordinary(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """Ids of left + right from the ids of both."""
        start, stop = last_cut(left), first_cut(right)
        keep_left = self.ids_up_to(left_ids, len(left[start:].encode()))
        keep_right = self.ids_up_to(right_ids[::-1], len(right[:stop].encode()))
        middle = self.encoding.encode_ordinary(left[start:] + right[:stop])
        return left_ids[: len(left_ids) - keep_left] + middle + right_ids[keep_right:]

    def ids_up_to(self, ids: list[int], size: int) -> int:
        """How many ids from the end make up exactly `size` bytes (from the front: pass them reversed)."""
        return _tail(ids, size, self.width)

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def _tail(ids: list[int], size: int, width: np.ndarray) -> int:
    n = 0
    while size > 0:
        n += 1
        size -= int(width[ids[-n]])
    if size:
        raise AssertionError("a cut lies inside a token")
    return n


def last_cut(text: str) -> int:
    """The last sure cut of a text, 0 if it has none; looked for in growing windows."""
    size = WINDOW
    while size < 2 * len(text):
        start = max(0, len(text) - size)
        found = [m.start() for m in CUT.finditer(text, start)]
        if found and found[-1] > start:
            return found[-1]
        size *= 2
    return 0


def first_cut(text: str) -> int:
    """The first sure cut of a text, its length if it has none."""
    size = WINDOW
    while size < 2 * len(text):
        found = CUT.search(text, 1, min(len(text), size))
        # At the window's end the following character isn't seen; a wider window decides.
        if found and found.start() < min(len(text), size):
            return found.start()
        size *= 2
    return len(text)


def pack(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", leaf: int = LEAF) -> DataFrame:
    """docs, all columns, with the packed ids of text_col in a last one: out_col, with underscores after it where docs has that name. Ranks: a fixed file, sent to the executors once."""
    return _mapped(docs, ranks_path, pattern, text_col, [out_col], lambda c, x: (pack(c.encode(x, leaf)) if x else b"",))


def decoded(tokens: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """tokens, all columns, with the bytes that the packed ids stand for (null ids: no bytes) in a last one, named as by `encoded`."""
    return _mapped(tokens, ranks_path, pattern, ids_col, [out_col], lambda c, x: (c.decode(unpack(x)) if x else b"",))


def both_ways(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", back_col: str = "decoded") -> DataFrame:
    """docs, all columns, with the packed ids and what they decode to, by one pass of one Python worker for each task."""

    def one(c: Codec, x: str | None) -> tuple[bytes, bytes]:
        ids = c.encode(x, LEAF) if x else []
        return pack(ids), c.decode(ids)

    return _mapped(docs, ranks_path, pattern, text_col, [ids_col, back_col], one)


def _mapped(df: DataFrame, ranks_path: str, pattern: str, col: str, out_cols: list[str], one) -> DataFrame:
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.columns
    names = [free(c, kept) for c in out_cols]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema] + [T.StructField(c, T.BinaryType()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for big in batches:
            for batch in batches_of(big):
                made = [one(c, x) for x in batch.column(col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[k] for m in made], pa.binary()) for k in range(len(names)))], names=[*kept, *names])

    return df.mapInArrow(run, schema)


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The contract's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return both_ways(docs.select("doc_id", "text"), ranks_path, pattern).select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
