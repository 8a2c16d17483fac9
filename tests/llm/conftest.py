"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing names."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, score string, node int, digest string, token_ids string"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = words(rng, 40, vocabulary)
    texts = [words(rng, rng.randint(1, 120), vocabulary) for _ in range(60)]
    texts += [texts[3], texts[3], texts[5] + " x", texts[3].upper(), "  " + texts[7].replace(" ", "\n")]
    texts += [f"{words(rng, 20, vocabulary)} {passage} {words(rng, 9, vocabulary)}" for _ in range(8)]
    near = texts[10] + " " + words(rng, 200, vocabulary)
    texts += [near] + [near.replace(near.split()[k], "qq", 1) for k in (5, 60, 90)]
    texts += [words(rng, 9000, vocabulary), "a" * 30000, "et " * 4000, "", "   \n\t", None, None, "12345 !!", "日本語のテキスト", "É à <|endoftext|> ü"]
    out = [(i, t, ("en", "fr", None)[i % 3], "src0" if i % 3 else None, None if t is None else len(t), "x", "y", 1, "z", "w") for i, t in enumerate(texts)]
    out += [out[2], (None, "a null id", "en", None, 9, "x", "y", 1, "z", "w"), (None, texts[0], None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def unique(spark, rows):
    """Rows with distinct ids."""
    return spark.createDataFrame([r for r in rows[:-3]], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
