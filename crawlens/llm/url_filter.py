"""URL filters: rules, and where none fits a logistic regression on hashed n-grams.

Features are the character 3- to 5-grams of host and path, marked by where they stand and
hashed to 2^15 weights. The model is fitted on the driver on a small labelled table of
urls (here made by a rule from word lists), by full-batch gradient descent from zero, so
it is the same each time; its weights, of fixed size, go to the executors in the task.

Defined results: null url or url without :// : host and path empty, no rule, verdict by
the model (score 0.5 or more blocks); url text is never changed but for A-Z in the host;
very long urls are read whole; repeated rows are judged each; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlens.llm.urls import host_of, path_of

BITS = 15
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: (action, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words of hosts that nobody wants, and of hosts that are fine; the labelled table is made of them.
BAD = ("cheap-pills", "spam-farm", "casino", "free-viagra", "xxx-cams", "payday-loans", "replica-watches", "adult-dating", "torrent-crack", "win-prizes", "poker-bonus", "weight-loss-miracle", "click-farm", "link-farm", "porn-tube", "buy-followers")
GOOD = ("library", "university", "news", "weather", "garden", "history", "science", "recipes", "museum", "travel", "music", "health", "sports", "school", "city", "books", "bakery", "council", "gallery", "hospital", "journal", "kitchen", "market", "orchestra", "park", "physics", "poetry", "railway", "recycling", "stadium", "village", "weaving", "zoo", "archive", "bank", "chess", "dentist", "forum", "geology", "hotel", "insurance", "law", "painting")
ENDS = ("com", "net", "org")


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): a few hundred rows from the word lists by a fixed rule."""
    rows = []
    for label, words in ((1, BAD), (0, GOOD)):
        for i, w in enumerate(words):
            for j, end in enumerate(ENDS):
                front = ("", "www.", "blog.", "m.")[(i + j) % 4]
                lang = ("en", "fr", "de", "es")[(i * 3 + j) % 4]
                rows.append((f"{front}{w}.example.{end}", f"/{lang}/{(i * 37 + j * 101) % 1000}", label))
        rows += [("example.com", f"/{w}/offer" if label else f"/{w}/index.html", label) for w in words]
    return rows


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the hashed n-grams of many urls at once, each once in a row."""
    n = len(hosts)
    texts = [f"^{x}$" for x in (*hosts, *paths)]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(2 * n), [len(t) for t in texts])
    found = []
    for size in (3, 4, 5):
        if len(chars) < size:
            continue
        h = np.zeros(len(chars) - size + 1, np.uint64)
        for i in range(size):
            h = h * FACTOR + chars[i : len(chars) - size + 1 + i]
        who = owner[: len(h)]
        inside = who == owner[size - 1 :]
        h, who = h[inside], who[inside]
        # Host and path, and each size, have hashes of their own.
        h = (h + np.where(who < n, 2 * size, 2 * size + 1).astype(np.uint64)) * FACTOR
        h = (h ^ (h >> np.uint64(31))) * FACTOR
        found.append((who % n).astype(np.int64) * (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def fitted(rows: list[tuple[str, str, int]], rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> np.ndarray:
    """Weights, the bias last."""
    row, at = features([r[0] for r in rows], [r[1] for r in rows])
    x = np.zeros((len(rows), (1 << BITS) + 1), np.float32)
    x[row, at] = 1 / np.sqrt(np.bincount(row, minlength=len(rows)))[row]
    x[:, -1] = 1
    y = np.array([r[2] for r in rows], np.float32)
    used = np.nonzero(x.any(0))[0]
    x, w = x[:, used], np.zeros(len(used), np.float32)
    for _ in range(rounds):
        w -= rate * (x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / len(y) * 10 + decay * w)
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[used] = w
    return out


def probabilities(weights: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The model's probability to block each url."""
    row, at = features(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    z = np.bincount(row, weights[at], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1)) + weights[-1]
    return 1 / (1 + np.exp(-z))


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def fits(rule: tuple[str, str, str]) -> Column:
    _, host, path = rule
    same = (F.col("host") == host) | F.col("host").endswith("." + host)
    return same & F.col("path").startswith(path)


def first_rule(rules, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(rule_name(r))):
        out = F.when(fits(rule), F.lit(value(rule))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES, rows=None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score (the model's probability to block; null where a rule decides)."""
    weights = fitted(labelled() if rows is None else rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths, rule in batches:
            out = np.full(len(hosts), np.nan)
            open_ = np.nonzero(rule.isna().to_numpy())[0]
            for at in range(0, len(open_), 1024):
                some = open_[at : at + 1024]
                out[some] = probabilities(weights, hosts.iloc[some].tolist(), paths.iloc[some].tolist())
            yield pd.Series(out)

    parts = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    ruled = parts.withColumn("rule", first_rule(rules, rule_name)).withColumn("action", first_rule(rules, lambda r: r[0]))
    scored = ruled.withColumn("score", F.when(F.col("rule").isNull(), score("host", "path", "rule")))
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
