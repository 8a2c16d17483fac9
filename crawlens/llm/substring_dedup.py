"""Substring dedup by suffix automata of reference shards.

The reference of a document is every document with a smaller id. Passages are removed
whose 13-word windows also start there; windows are judged on the input.

1. Of documents with equal words the first stands for all; later ones go wholly.
2. Each window is given its minimizer (the least hash of its 7-word grams). Windows can
   only be equal if their minimizers are; minimizers of one document only are dropped.
3. What is left is cut into runs of windows with one minimizer and dealt to shards by it,
   equal runs combined. A minimizer that more than HOT documents share is dealt by whole
   windows instead, so that the many contexts around a common passage don't meet.
4. A shard's runs are built into a suffix automaton over words, whose states know the
   least document that has them. The runs are streamed through it; at each word the state
   of the matched 13 words tells the least document in which that window starts.
5. Windows with a smaller document are joined back to their documents and removed.

Shards are sent to where their passages are, not to everyone: the reference is the corpus
itself, which no broadcast could hold. `against` takes a bounded
reference, whose automata are broadcast and through which whole documents are streamed.

Defined results: null text has no words; a null id counts as greater than any other; rows
with equal ids never remove each other's words; documents under 13 words keep all;
repeated windows inside one document alone are no reason to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import batches_of, located, released, staged
from crawlens.llm.simhash import numbered

WINDOW = 13
GRAM = 7
#: Documents sharing a minimizer from which on it is dealt by whole windows.
HOT = 1000
#: Runs that a shard's automaton is built of, about.
SHARD = 2000
#: Distinct words whose hashes a task holds at most.
LIMIT = 500_000
LAST = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


class Hashes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def minimizers(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimizer of each window of `window` words (as signed longs)."""
    n = len(h) - gram + 1
    span = window - gram + 1
    if n < span:
        return np.zeros(0, np.int64)
    g = h[:n].copy()
    for i in range(1, gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    size = 1
    while size * 2 <= span:
        g = np.minimum(g[:-size], g[size:])
        size *= 2
    if size < span:
        g = np.minimum(g[: len(g) - (span - size)], g[span - size :])
    return g.view(np.int64)


class Automaton:
    """Suffix automaton of several word sequences; each state knows the least owner of its sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [LAST]

    def _state(self, size: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.size.append(size)
        self.link.append(link)
        self.least.append(LAST)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c) -> int:
        """The state of q's sequences that end p's longest with c."""
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list, owner: int) -> None:
        at = 0
        for c in sequence:
            q = self.next[at].get(c)
            if q is not None:
                at = q if self.size[q] == self.size[at] + 1 else self._split(at, q, c)
            else:
                new = self._state(self.size[at] + 1, {}, 0)
                p = at
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, c)
                at = new
            if owner < self.least[at]:
                self.least[at] = owner

    def done(self) -> Automaton:
        """Owners of longer sequences own their ends too."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = self.link[v]
            if self.least[v] < self.least[p]:
                self.least[p] = self.least[v]
        return self

    def owners(self, sequence: list, window: int = WINDOW) -> list[int]:
        """For each window of the sequence, the least owner of that window (LAST: none), from matching statistics."""
        out = []
        at = matched = 0
        for i, c in enumerate(sequence):
            while at and c not in self.next[at]:
                at = self.link[at]
                matched = self.size[at]
            if c in self.next[at]:
                at = self.next[at][c]
                matched += 1
            if matched > window:
                matched = window
            while self.link[at] >= 0 and self.size[self.link[at]] >= matched > 0:
                at = self.link[at]
            if i >= window - 1:
                out.append(self.least[at] if matched >= window else LAST)
        return out


def covered(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `starts`."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change)[:n] > 0


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def scanned(rows: DataFrame) -> DataFrame:
    """ord, __crawlens_file, __crawlens_row -> with n_words, digest (of the words), sha256 and the distinct minimizers. rows: ord, __crawlens_file, __crawlens_row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for big in batches:
            for batch in batches_of(big):
                n, digest, shas, mins = [], [], [], []
                for t in batch.column(3).to_pylist():
                    words = words_of(t)
                    n.append(len(words))
                    digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    shas.append(sha(words))
                    mins.append(np.unique(minimizers(hashes.of(words))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(shas), pa.array(mins, pa.list_(pa.int64()))], names=["ord", "__crawlens_file", "__crawlens_row", "n_words", "digest", "sha256", "mins"])

    return rows.mapInArrow(run, "ord bigint, __crawlens_file string, __crawlens_row bigint, n_words bigint, digest binary, sha256 string, mins array<bigint>")


def runs_of(words: list[bytes], mins: np.ndarray, shared: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard key, first word, windows) of the runs of windows whose minimizer is shared."""
    at = np.nonzero(np.isin(mins, shared))[0]
    if not len(at):
        return
    m = mins[at]
    alone = np.isin(m, hot)
    cut = np.nonzero((np.diff(at) != 1) | (np.diff(m) != 0) | alone[1:] | alone[:-1])[0] + 1
    for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(at)]]).tolist()):
        start = int(at[a])
        if alone[a]:
            key = xxhash.xxh64_intdigest(b" ".join(words[start : start + WINDOW]))
            yield key - (1 << 64) if key >> 63 else key, start, 1
        else:
            yield int(m[a]), start, b - a


def runs(candidates: DataFrame) -> DataFrame:
    """candidates: node, ord, text, shared, hot. One row for each run: m, seg (its words), key (of seg), node, ord, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for big in batches:
            for batch in batches_of(big, 256):
                node, owner, text, shared, hot = (batch.column(i) for i in range(5))
                out = []
                for i, t in enumerate(text.to_pylist()):
                    words = words_of(t)
                    for m, start, n in runs_of(words, minimizers(hashes.of(words)), np.array(shared[i].as_py()), np.array(hot[i].as_py())):
                        seg = b" ".join(words[start : start + n + WINDOW - 1])
                        out.append((m, seg, xxhash.xxh3_128_digest(seg), i, start))
                if out:
                    m, seg, key, i, start = zip(*out)
                    at = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(seg, pa.binary()), pa.array(key, pa.binary()), node.take(at), owner.take(at), pa.array(start, pa.int64())], names=["m", "seg", "key", "node", "ord", "start"])

    return candidates.mapInArrow(run, "m bigint, seg binary, key binary, node bigint, ord bigint, start bigint")


def shard_owners(shard: list[tuple[bytes, int]]) -> list[list[int]]:
    """For each run of a shard (words, least owner), the least owner of each of its windows."""
    automaton = Automaton()
    split = [seg.split(b" ") for seg, _ in shard]
    for words, (_, owner) in zip(split, shard):
        automaton.add(words, owner)
    automaton.done()
    return [automaton.owners(words) for words in split]


def owned(distinct: DataFrame) -> DataFrame:
    """distinct: m, seg, low. key (of seg), lows (least owner of each window), shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for piece in batches_of(batch, 4096):
                    yield from zip(*(c.to_pylist() for c in piece.columns))

        def emit(shard: list[tuple[bytes, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s, _ in shard], pa.binary()), pa.array(shard_owners(shard), pa.list_(pa.int64()))], names=["key", "lows"])

        shard: list[tuple[bytes, int]] = []
        for _, same in groupby(rows(), key=lambda r: r[0]):
            shard += [(seg, low) for _, seg, low in same]
            if len(shard) >= SHARD:
                yield emit(shard)
                shard = []
        if shard:
            yield emit(shard)

    return distinct.repartition("m").sortWithinPartitions("m").mapInArrow(run, "key binary, lows array<bigint>")


def cut_out(marked: DataFrame) -> DataFrame:
    """marked: node, text, starts. node, n_removed, kept_sha256, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(big, 256):
                n, shas, texts = [], [], []
                for t, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    words = words_of(t)
                    gone = covered(len(words), np.array(starts, np.int64))
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    n.append(int(gone.sum()))
                    texts.append(b" ".join(kept).decode())
                    shas.append(sha(kept))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shas), pa.array(texts)], names=["node", "n_removed", "kept_sha256", "kept_text"])

    return marked.mapInArrow(run, "node bigint, n_removed bigint, kept_sha256 string, kept_text string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST - 1))
    return docs.select(order.alias("ord"), "__crawlens_file", "__crawlens_row", F.col(text_col).alias("text"))


def _firsts(seen: DataFrame) -> DataFrame:
    """One row for each text of at least a window: that of the least id."""
    place = F.struct("ord", "__crawlens_file", "__crawlens_row")
    first = seen.where(F.col("n_words") >= WINDOW).groupBy("digest").agg(F.min(place).alias("p"))
    alone = seen.join(first, "digest").where(place == F.col("p")).select("digest", "ord", "__crawlens_file", "__crawlens_row", "mins")
    return numbered(alone, "substring-firsts")


def _shared(firsts: DataFrame, hot: int) -> DataFrame:
    """The documents with minimizers of more than one document, and those minimizers."""
    grams = firsts.select(F.explode("mins").alias("m"), "ord", "node")
    shared = grams.groupBy("m").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("m", (F.col("n") > hot).alias("hot"))
    of_node = grams.select("m", "node").join(shared, "m").groupBy("node").agg(F.collect_list("m").alias("shared"), F.collect_list(F.when(F.col("hot"), F.col("m"))).alias("hot"))
    return staged(firsts.select("node", "ord", "__crawlens_file", "__crawlens_row").join(of_node, "node"), "substring-shared")


def _candidates(rows: DataFrame, held: DataFrame) -> DataFrame:
    texts = rows.select("text", "__crawlens_file", "__crawlens_row").join(held.hint("shuffle_hash"), ["__crawlens_file", "__crawlens_row"])
    return staged(texts.select("node", "ord", "text", "shared", "hot"), "substring-candidates")


def _starts(cut: DataFrame) -> DataFrame:
    """node, starts: the windows of each document that a smaller document has."""
    distinct = cut.groupBy("m", "seg").agg(F.min("ord").alias("low"))
    met = cut.select("key", "node", "ord", "start").join(owned(distinct), "key").where(F.exists("lows", lambda x: x < F.col("ord")))
    offsets = F.filter(F.transform("lows", lambda x, i: F.when(x < F.col("ord"), F.col("start") + i)), lambda x: x.isNotNull())
    return staged(met.select("node", offsets.alias("at")).groupBy("node").agg(F.flatten(F.collect_list("at")).alias("starts")), "substring-starts")


def _cuts(candidates: DataFrame, starts: DataFrame) -> DataFrame:
    return staged(cut_out(candidates.select("node", "text").join(starts.hint("shuffle_hash"), "node").select("node", "text", "starts")), "substring-cuts")


def matched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: rows (ord, n_words, digest, sha256), firsts (node, ord, digest) and cuts (node, n_removed, kept_sha256, kept_text).

    Each step writes what the next ones need; then its inputs and shuffle files can go, so
    that no more than two steps' files lie on disk at once.
    """
    spark = docs.sparkSession
    rows = _texts(located(docs, "substring-input"), id_col, text_col)
    scan = staged(scanned(rows), "substring-scan")
    seen = staged(scan.select("ord", "n_words", "digest", "sha256"), "substring-rows")
    wide = _firsts(scan)
    released(spark, scan)
    held = _shared(wide, hot)
    firsts = staged(wide.select("node", "ord", "digest"), "substring-first-ids")
    released(spark, wide)
    candidates = _candidates(rows, held)
    released(spark, held)
    cut = staged(runs(candidates), "substring-runs")
    starts = _starts(cut)
    released(spark, cut)
    cuts = _cuts(candidates, starts)
    released(spark, candidates, starts)
    return seen, firsts, cuts


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256, kept_text (null where nothing is removed: the text as it was)."""
    seen, firsts, cuts = matched(docs, id_col, text_col)
    done = firsts.select("node", "digest", F.col("ord").alias("lo")).join(cuts, "node", "left").drop("node")
    wholly = F.col("ord") > F.col("lo")
    null_id = F.when(F.col("ord") < LAST - 1, F.col("ord"))
    return seen.join(done, "digest", "left").select(
        null_id.alias(id_col),
        "n_words",
        F.when(wholly, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(wholly, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(wholly, "").otherwise(F.col("kept_text")).alias("kept_text"),
    )


def against(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4_000_000) -> DataFrame:
    """id, n_words, n_removed: words of docs in windows that a bounded reference has too.

    The reference's automata, of at most `limit` characters together, are broadcast; a
    larger reference is refused (use `deduplicated`, which needs no bound).
    """
    size = reference.agg(F.sum(F.length(text_col))).first()[0] or 0
    if size > limit:
        raise ValueError(f"the reference has {size} characters; at most {limit} are broadcast")
    automaton = Automaton()
    for r in reference.select(text_col).collect():
        automaton.add(words_of(r[0]), 0)
    sent = docs.sparkSession.sparkContext.broadcast(automaton.done())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in batches_of(big, 256):
                n, gone = [], []
                for t in batch.column(1).to_pylist():
                    words = words_of(t)
                    hits = np.array([i for i, x in enumerate(sent.value.owners(words)) if x == 0], np.int64)
                    n.append(len(words))
                    gone.append(int(covered(len(words), hits).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["id", "n_words", "n_removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint").withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(docs).drop("kept_text")


ORACLE = r"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), win AS (
        SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS seg
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
    ), low AS (
        SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seg) AS lo FROM win
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM low WHERE lo < doc_id
    ), word AS (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
    ), kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
    )
    SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
"""
