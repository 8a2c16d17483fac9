"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are lower-cased and their white space is collapsed. If an item
of m characters occurs in a text with at most e edits, text and item share at least
m + 1 - q - q*e q-grams, all on diagonals that span e at most. Shared q-grams are counted
in bands of 2(e+1) diagonals, each overlapping the next by half, so that every span of
e+1 diagonals lies in one band; regions whose band reaches the bound are aligned in a band
of that width, and stay if the whole item aligns within e edits. Nothing that the budget
allows is lost: hashing and bands only ever add regions to align.

The benchmark is read in blocks of at most BLOCK characters, each sent to the executors
whole and run against all documents. Items for which the lemma's bound would fall below one
q-gram at the full budget have an index of their own, of the largest q that keeps it.

Defined results: null texts or items and items without characters match nothing; items
shorter than q characters that have no edit must occur exactly; the edit budget is `edits` of
the item's length; of overlapping matches
of an item in one text the one with fewest edits (then the first) is reported; places are
offsets in the collapsed text; repeated rows each have their matches; very long texts are
searched whole, at most CHUNK characters and one text more at once; other columns, whatever
their names, are ignored by `found` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import batches_of

Q = 8
EDITS = 0.1
#: Characters of benchmark text in one block (and so in one broadcast). A gram takes 24 bytes of an index, so a block's
#: takes 100 MB at most in each Python worker, and its items' texts 4 MB to 16 MB.
BLOCK = 4_000_000
#: Characters of document text searched at once.
CHUNK = 1_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SIEVE = 20


def collapsed(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    c = chars.astype(np.uint64)
    if q == 8:  # by doubling
        h = c[:-1] * np.uint64(0x1F123BB5159A55E5) + c[1:]
        h = h[:-2] * np.uint64(0x8A5CD789635D2DFF) + h[2:]
        h = h[:-4] * np.uint64(0x121FD2155C472F97) + h[4:]
    else:
        h = np.zeros(len(c) - q + 1, np.uint64)
        for i in range(q):
            h = h * np.uint64(0x1F123BB5159A55E5) + c[i : len(c) - q + 1 + i]
    return (h ^ (h >> np.uint64(29))) * FACTOR


@dataclass
class Index:
    """The q-grams of a block of benchmark items."""

    ids: list[int]
    texts: list[str]
    q: int
    rate: float

    def __post_init__(self) -> None:
        m = np.array([len(t) for t in self.texts], np.int64)
        self.long = m >= self.q
        self.edits = np.minimum((self.rate * m).astype(np.int64), np.maximum(m - self.q, 0) // self.q)
        self.bound = np.maximum(m + 1 - self.q - self.q * self.edits, 1)
        hashes, item, place = [], [], []
        for k, t in enumerate(self.texts):
            h = gram_hashes(points(t), self.q)
            hashes.append(h)
            item.append(np.full(len(h), k, np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int32))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, np.int32))[order]
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.first, self.count = self.first.astype(np.int32), self.count.astype(np.int32)
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[self.grams >> np.uint64(64 - SIEVE)] = True

    def regions(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of each band that reaches its item's bound."""
        none = np.zeros(0, np.int64)
        h = gram_hashes(chars, self.q)
        at = np.nonzero(self.sieve[h >> np.uint64(64 - SIEVE)])[0]
        if not len(at) or not len(self.grams):
            return none, none
        h = h[at]
        k = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        hit = self.grams[k] == h
        at, k = at[hit], k[hit]
        n = self.count[k].astype(np.int64)
        if not len(n):
            return none, none
        # One event for each item's place that has the gram.
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.first[k], n) + step
        item, diagonal = self.item[entry].astype(np.int64), np.repeat(at, n) - self.place[entry]
        half = self.edits[item] + 1
        band = diagonal // half
        base, shift = np.int64(len(chars) + 2 * BLOCK), np.int64(BLOCK)
        key = item * base + band + shift
        # A sieve of counts: a band and its neighbour together must reach the bound.
        spot = lambda x: ((x.astype(np.uint64) * FACTOR) >> np.uint64(64 - SIEVE)).astype(np.int64)
        sieve = np.bincount(spot(key), minlength=1 << SIEVE)
        beside = np.maximum(sieve[spot(key - 1)], sieve[spot(key + 1)])
        maybe = sieve[spot(key)] + beside >= self.bound[item]
        key = key[maybe]
        key, many = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item, band = key // base, key % base - shift
        enough = many >= self.bound[item]
        return item[enough], band[enough] * (self.edits[item[enough]] + 1)


def aligned(item: str, text: str, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item to a part of text whose diagonals (text place minus item place) lie in [low, low + width)."""
    big = 1 << 24
    a = points(item).astype(np.int64)
    m, n = len(a), len(text)
    # Only the part of the text on these diagonals is looked at.
    first = min(max(low, 0), n)
    t = points(text[first : max(low + m + width + 1, first)]).astype(np.int64)
    # t[low + k + i] for row i, column k; outside the text nothing matches.
    padded = np.full(m + width + 1, -1, np.int64)
    src = np.arange(low, low + m + width + 1)
    inside = (src >= first) & (src < first + len(t))
    padded[inside] = t[src[inside] - first]
    k = np.arange(width, dtype=np.int64)
    out_of = (low + k < 0) | (low + k > n)
    row = np.where(out_of, big // 2 * big, 0) + k  # edits * big + first column
    slope = k * big
    for i in range(m):
        step = row + (padded[i : i + width] != a[i]) * big
        step[:-1] = np.minimum(step[:-1], row[1:] + big)
        row = np.minimum.accumulate(step - slope) + slope
        if i % 8 == 7 and (row.min() // big) > budget:
            return None
    ends = low + k + m
    row = np.where((ends < 0) | (ends > n), row + big // 2 * big, row)
    best = int(row.argmin())
    edits = int(row[best] // big)
    return (edits, low + int(row[best] % big), low + best + m) if edits <= budget else None


def matches(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text's number, item id, start, end, edits) for collapsed texts."""
    found = []
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    item, diagonal = index.regions(points("\0".join(texts)))
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k, d in zip(item.tolist(), diagonal.tolist()):
        e, m = int(index.edits[k]), len(index.texts[k])
        # A band may begin before its text; it may also lie at the boundary of two.
        for x in {int(np.clip(np.searchsorted(starts, p, "right") - 1, 0, len(texts) - 1)) for p in (d, d + 2 * e + 1, d + m)}:
            text, low = texts[x], d - int(starts[x])
            if low + 2 * (e + 1) <= 0 or low + m - e > len(text):
                continue  # the whole item can't lie in this text on these diagonals
            at = text.find(index.texts[k], max(0, low), max(0, low + 2 * (e + 1) + m))
            got = (0, at, at + m) if at >= 0 else aligned(index.texts[k], text, low, 2 * (e + 1), e)
            if got:
                best.setdefault((x, k), []).append(got)
    for k, t in enumerate(index.texts):
        if t and not index.long[k]:
            for x, text in enumerate(texts):
                at = text.find(t)
                while at >= 0:
                    best.setdefault((x, k), []).append((0, at, at + len(t)))
                    at = text.find(t, at + len(t))
    for (x, k), got in best.items():
        taken: list[tuple[int, int, int]] = []
        for e, a, b in sorted(set(got)):
            if all(b <= c or a >= d for _, c, d in taken):
                taken.append((e, a, b))
        found += [(x, index.ids[k], a, b, e) for e, a, b in taken]
    return sorted(found)


def grouped(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters together, with the first one's number."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def gram_size(m: int, q: int, rate: float) -> int:
    """The largest size up to q at which an item of m characters and all its edits leaves one gram untouched."""
    edits = int(rate * m)
    return q if not edits else max(1, min(q, m // (1 + edits)))


def blocks(benchmark: DataFrame, q: int, rate: float, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The benchmark as indexes of at most about BLOCK characters, for each size of grams its own."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        sizes: dict[int, list[tuple[int, str]]] = {q: []}
        for r in rows:
            text = collapsed(r.text)
            sizes.setdefault(gram_size(len(text), q, rate), []).append((r.id, text))
        for size, items_of in sizes.items():
            yield Index([i for i, _ in items_of], [t for _, t in items_of], size, rate)


def found(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, item_id, start_char, end_char, n_edits: one row for each occurrence of an item in a text."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for index in blocks(benchmark, q, edits):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in batches_of(big):
                    ids = batch.column(0)
                    for first, texts in grouped([collapsed(t) for t in batch.column(1).to_pylist()]):
                        if got := matches(sent.value, texts):
                            x, *cols = zip(*got)
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + i for i in x])), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "item_id", "start_char", "end_char", "n_edits"])

        part = src.mapInArrow(run, f"id {kind}, item_id bigint, start_char bigint, end_char bigint, n_edits bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text holds an item of the benchmark."""
    sc = docs.sparkSession.sparkContext
    for index in blocks(benchmark, q, edits):
        sent = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for batch in batches_of(big):
                    keep = np.ones(batch.num_rows, bool)
                    for first, texts in grouped([collapsed(t) for t in batch.column(text_col).to_pylist()]):
                        for x, *_ in matches(sent.value, texts):
                            keep[first + x] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
    return docs
