"""Language ID by a linear-chain conditional random field over words.

Every word of a text has a hidden language. A word's potentials are sums of weights of its
features: byte n-grams of the lower-cased word between boundary marks (those that hold a
mark are its affixes; n is 2 to 4) and its membership in a lexicon of frequent words.
Transition weights between neighbours are learned with them, by gradient ascent on the
likelihood over sequences of up to STEPS words whose words carry their document's
language. Prediction runs forward-backward over the whole text, so that in code-switched
text each word has its own distribution: sequences of STEPS words are run side by side, and
what enters and leaves each is carried along the text by their transfer matrices. A document's language has the largest sum of word
posteriors and its score is their mean.

The model is fitted on the driver on at most SAMPLE labelled documents, dealt to the languages
in turn, so that each of up to SAMPLE languages has some, however rare: of a language those of
up to LONG characters by the least hash of their identifier, then longer ones by length, so
that what the driver holds doesn't depend on the longest texts. The model is of fixed size and sent to the
executors once.

Defined results: `und` with score 0 for null texts and texts without a letter, and for all
texts where there is no labelled document; ties between languages go to the first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlens.llm.common import batches_of, trimmed

#: Labelled documents the model is fitted on at most.
SAMPLE = 400
#: Characters beyond which a labelled text comes after all others in the sample, the shortest of them first.
LONG = 20_000
#: Words of one sequence; a longer text is several, fitted apart and labelled as one.
STEPS = 64
#: Parts that a language's labelled rows are ranked in, round by round, until its sample is taken. Each number is a multiple of the next.
SPLITS = (256, 16, 1)
#: Sequences run side by side.
BLOCK = 1024
BITS = 17
SIZES = (2, 3, 4)
LEXICON = 4000
ROUNDS = 15
#: Distinct words whose potentials a task holds at most.
LIMIT = 400_000
UND = "und"
LANGUAGE, SCORE, CERTAINTY = "__crawlens_language", "__crawlens_score", "__crawlens_certainty"
#: ASCII lower-cased; all other ASCII but letters and ' parts words.
PARTS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(PARTS).split() if text else []


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Features:
    """Feature places of distinct words, as flat arrays."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in words), np.uint8).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        self.start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(self.start + size, size) - np.arange(len(data))
        power = np.power(np.uint64(0x1F123BB5159A55E5), (np.arange(len(data)) - self.start[word]).astype(np.uint64)) if len(data) else data
        self.whole = np.add.reduceat((data + np.uint64(1)) * power, self.start) * FACTOR if len(words) else np.zeros(0, np.uint64)
        places, owners = [], []
        code = data
        for n in range(2, max(SIZES) + 1):
            code = code[:-1] * np.uint64(0x100000001B3) + data[n - 1 :] if len(code) > 1 else code[:0]
            if n in SIZES:
                fits = left[: len(code)] >= n
                places.append((((code[fits] + np.uint64(n)) * FACTOR) >> np.uint64(64 - BITS)).astype(np.int64))
                owners.append(word[: len(code)][fits])
        self.place, self.owner, self.n = np.concatenate(places), np.concatenate(owners), len(words)


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # n-grams, then lexicon words; a row for each feature
    lexicon: np.ndarray  # sorted hashes of whole words
    step: np.ndarray  # transition weights

    def potentials(self, f: Features) -> np.ndarray:
        out = np.stack([np.bincount(f.owner, self.weight[f.place, k], f.n) for k in range(len(self.languages))], 1)
        at, known = self.member(f)
        out[known] += self.weight[(1 << BITS) + at[known]]
        return out.astype(np.float32)

    def member(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.lexicon, f.whole)
        known = (at < len(self.lexicon)) & (self.lexicon[np.minimum(at, max(len(self.lexicon) - 1, 0))] == f.whole) if len(self.lexicon) else np.zeros(f.n, bool)
        return at, known


def sequences(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of so many words, laid end to end, cut in sequences: first word, words, text of each."""
    n = -(-lengths // STEPS)
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(lengths) - lengths, n) + k * STEPS
    return first, np.minimum(lengths[text] - k * STEPS, STEPS), text


def forward_backward(score: np.ndarray, mask: np.ndarray, step: np.ndarray, pairs: bool = False, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequence, place, language) of potentials; expected transitions if pairs. enter, leave: weights of the first and last place's languages."""
    e = np.exp(score - score.max(2, keepdims=True))
    go = np.exp(step - step.max()).astype(np.float32)
    s, t, k = e.shape
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = e[:, 0] if enter is None else e[:, 0] * enter
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ go) * e[:, i]
        a /= a.sum(1, keepdims=True)
        alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
    beta[:, -1] = 1 if leave is None else leave
    for i in range(t - 2, -1, -1):
        b = (beta[:, i + 1] * e[:, i + 1]) @ go.T
        b /= b.sum(1, keepdims=True)
        beta[:, i] = np.where(mask[:, i + 1, None], b, beta[:, i + 1])
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    moves = np.zeros((k, k))
    if pairs:
        for i in range(1, t):
            x = alpha[:, i - 1, :, None] * go * (beta[:, i] * e[:, i])[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            moves += x[mask[:, i]].sum(0)
    return post, moves


def transfer(score: np.ndarray, mask: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each sequence, the weight of all its paths by first and last language, up to a factor."""
    e = np.exp(score - score.max(2, keepdims=True))
    go = np.exp(step - step.max()).astype(np.float32)
    out = np.eye(e.shape[2], dtype=np.float32) * e[:, 0, None, :]
    for i in range(1, e.shape[1]):
        x = (out @ go) * e[:, i, None, :]
        x /= x.sum((1, 2), keepdims=True)
        out = np.where(mask[:, i, None, None], x, out)
    return out


def carried(moved: np.ndarray, text: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """enter and leave of each sequence, from the transfer matrices of all; sequences of one text follow each other."""
    go = np.exp(step - step.max()).astype(np.float32)
    enter, leave = (np.ones(moved.shape[:2], np.float32) for _ in range(2))
    start = np.nonzero(np.diff(text, prepend=-1))[0]
    count = np.diff(start, append=len(text))
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    most = int(count[0]) if len(count) else 0
    longer = np.searchsorted(-count, -np.arange(most + 1), "left")  # texts of more than k sequences
    for k in range(1, most):
        at = start[: longer[k]] + k
        x = np.einsum("si,sij->sj", enter[at - 1], moved[at - 1]) @ go
        enter[at] = x / x.sum(1, keepdims=True)
    for k in range(most - 1, 0, -1):
        at = start[: longer[k]] + k
        x = np.einsum("sij,sj->si", moved[at], leave[at]) @ go.T
        leave[at - 1] = x / x.sum(1, keepdims=True)
    return enter, leave


def laid_out(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers by sequence and place, padded; and which places are words."""
    at = first[:, None] + np.arange(STEPS)
    mask = np.arange(STEPS) < size[:, None]
    return ids[np.minimum(at, len(ids) - 1)], mask


def fitted(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Model | None:
    """The model of labelled texts; None if there are none with a word."""
    kept = [(w, lang) for t, lang in zip(texts, langs) if lang is not None and (w := words_of(t))]
    if not kept:
        return None
    names = sorted({lang for _, lang in kept})
    k = len(names)
    vocabulary: dict[bytes, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for ws, _ in kept for w in ws])
    label = np.repeat([names.index(lang) for _, lang in kept], [len(ws) for ws, _ in kept])
    f = Features(list(vocabulary))
    count = np.bincount(ids, minlength=f.n)
    frequent = np.argsort(-count, kind="stable")[:LEXICON]
    lexicon = np.unique(f.whole[frequent[count[frequent] > 1]])
    model = Model(names, np.zeros(((1 << BITS) + len(lexicon), k), np.float32), lexicon, np.zeros((k, k), np.float32))
    at, known = model.member(f)
    first, size, _ = sequences(np.array([len(ws) for ws, _ in kept]))
    grid, mask = laid_out(ids, first, size)
    truth, _ = laid_out(label, first, size)
    inner = mask[:, 1:]
    seen_moves = np.zeros((k, k))
    np.add.at(seen_moves, (truth[:, :-1][inner], truth[:, 1:][inner]), 1)
    seen = np.stack([np.bincount(ids[label == j], minlength=f.n) for j in range(k)], 1).astype(float)
    means = [np.zeros_like(model.weight), np.zeros_like(model.step)]
    squares = [np.zeros_like(model.weight), np.zeros_like(model.step)]
    total = len(ids)
    for r in range(1, rounds + 1):
        post, moves = forward_backward(model.potentials(f)[grid], mask, model.step, pairs=True)
        guess = np.stack([np.bincount(grid[mask], post[..., j][mask], f.n) for j in range(k)], 1)
        pull = (seen - guess) / total
        grad = np.zeros_like(model.weight)
        for j in range(k):
            grad[: 1 << BITS, j] = np.bincount(f.place, pull[f.owner, j], 1 << BITS)
        np.add.at(grad, (1 << BITS) + at[known], pull[known])
        grads = [grad - 1e-6 * model.weight, ((seen_moves - moves) / total).astype(np.float32)]
        for i, (value, g) in enumerate(zip((model.weight, model.step), grads)):  # Adam
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            value += 0.1 * (means[i] / (1 - 0.9**r)) / (np.sqrt(squares[i] / (1 - 0.99**r)) + 1e-7)
    return model


class Tagger:
    """Labels batches of texts; keeps the potentials of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > LIMIT:
            known.clear()
            self.table = self.table[:0]
        if new := list({w for w in words if w not in known}):
            for w in new:
                known[w] = len(known)
            self.table = np.concatenate([self.table, self.model.potentials(Features(new))])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def whole(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, mask, posteriors) of sequences of texts laid end to end, forward-backward over each whole text."""
        first, size, text = sequences(lengths)
        step = self.model.step
        parts = [slice(at, at + BLOCK) for at in range(0, len(first), BLOCK)]
        moved = np.ones((len(first), len(step), len(step)), np.float32)
        several = np.repeat(-(-lengths // STEPS) > 1, -(-lengths // STEPS))
        for at in range(0, len(rows := np.nonzero(several)[0]), BLOCK):
            some = rows[at : at + BLOCK]
            grid, mask = laid_out(ids, first[some], size[some])
            moved[some] = transfer(self.table[grid], mask, step)
        enter, leave = carried(moved, text, step)
        for part in parts:
            grid, mask = laid_out(ids, first[part], size[part])
            yield text[part], mask, forward_backward(self.table[grid], mask, step, enter=enter[part], leave=leave[part])[0]

    def posteriors(self, texts: list[list[bytes]]) -> np.ndarray:
        """Mean word posterior of each text (zeros without words)."""
        return self.means(texts)[0]

    def means(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the mean word posterior, and the mean of its words' greatest posteriors (zeros without words)."""
        lengths = np.array([len(w) for w in texts], np.int64)
        out, sure = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts))
        if not lengths.sum():
            return out, sure
        ids = self.word_ids([w for ws in texts for w in ws])
        for text, mask, post in self.whole(ids, lengths):
            np.add.at(out, text, np.where(mask[..., None], post, 0).sum(1, dtype=float))
            np.add.at(sure, text, np.where(mask, post.max(2), 0).sum(1, dtype=float))
        return out / np.maximum(lengths, 1)[:, None], sure / np.maximum(lengths, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and certainty (the mean of the words' greatest posteriors) of each text."""
        mean, sure = self.means([words_of(t) for t in texts])
        best = mean.argmax(1)
        ok = [has_letter(t) for t in texts]
        names = [self.model.languages[b] if y else UND for b, y in zip(best, ok)]
        score = [float(min(1.0, mean[i, b])) if y else 0.0 for i, (b, y) in enumerate(zip(best, ok))]
        return names, score, [float(min(1.0, c)) if y else 0.0 for c, y in zip(sure, ok)]

    def words(self, text: str) -> list[tuple[str, str]]:
        """Each word of a text with its most likely language."""
        ws = words_of(text)
        if not ws:
            return []
        ids = self.word_ids(ws)
        best = np.concatenate([post[mask].argmax(1) for _, mask, post in self.whole(ids, np.array([len(ws)]))])
        return [(w.decode("utf-8", "replace"), self.model.languages[k]) for w, k in zip(ws, best)]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rounds_of(rows: DataFrame, sample: int) -> list[DataFrame]:
    """Of rows (size, h, lang), round by round, the first `sample` of each part of a language with their turn; last the first of each language.

    A task ranks what one part of the next round keeps, so none sorts what all others have found of a language.
    """
    found = []
    for parts in SPLITS:
        ranked = rows.select("size", "h", "lang", F.pmod(F.xxhash64("h"), F.lit(parts)).alias("part"))
        rows = ranked.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "part").orderBy("size", "h"))).where(F.col("turn") <= sample)
        found.append(rows)
    return found


def model_of(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on the labelled rows that aren't held out, at most `sample`, dealt to the languages in turn, of least length beyond LONG and least hash."""
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.greatest(F.length(text_col), F.lit(LONG)).alias("size"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    ranked = rounds_of(rows, sample)[-1]
    last: dict[str, tuple[int, int, int]] = {}
    for r in ranked.orderBy("turn", "size", "h", "lang").limit(sample).collect():
        last[r.lang] = (r.turn, r.size, r.h)
    if not last:
        return None
    ends = docs.sparkSession.createDataFrame([(k, *v) for k, v in last.items()], "lang string, turns int, size_end int, h_end long")
    near = rows.join(F.broadcast(ends), "lang").where((F.col("size") < F.col("size_end")) | ((F.col("size") == F.col("size_end")) & (F.col("h") <= F.col("h_end"))))
    # Rows of one identifier have one hash: of those at the end no more than its turns are taken.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("size", "h", "text"))
    got = near.withColumn("turn", turn).where("turn <= turns").select("size", "h", "text", "lang").collect()
    got.sort(key=lambda r: (r.size, r.h, r.text, r.lang))
    return fitted([r.text for r in got], [r.lang for r in got])


def _mapped(df: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """df, all columns as they are, with LANGUAGE, SCORE and CERTAINTY."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = df.columns
    fields = [T.StructField(df.schema[c].name, df.schema[c].dataType, True) for c in kept]
    schema = T.StructType([*fields, T.StructField(LANGUAGE, T.StringType()), T.StructField(SCORE, T.DoubleType()), T.StructField(CERTAINTY, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value) if sent.value is not None else None
        for big in batches:
            for batch in batches_of(big, 256):
                texts = batch.column(text_col).to_pylist()
                lang, score, sure = tagger.predict(texts) if tagger else ([UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts))
                made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, LANGUAGE, SCORE, CERTAINTY])

    return df.mapInArrow(trimmed(run), schema)


def tagged(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs, all columns, with LANGUAGE (UND for texts without a letter), SCORE and CERTAINTY: names of their own, so that no column is lost."""
    return _mapped(docs, model, text_col)


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score."""
    model = model_of(docs, sample)
    return _mapped(docs.select("doc_id", "text"), model, "text").select("doc_id", held_out().alias("held_out"), F.col(LANGUAGE).alias("lang_pred"), F.col(SCORE).alias("score"))
