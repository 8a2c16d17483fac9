"""Small column helpers with the reference's number and text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlens.constants import GRADES, WHITE


def let(value: Column, body) -> Column:
    """body(value) with the value computed, and written in the plan, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def half_up(x: Column, scale: int = 1) -> Column:
    """Rounding with halves towards plus infinity, to 1/scale."""
    return F.floor(x * scale + 0.5) / scale


def whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNotNull(), out)


def has_any(have: Column, wanted) -> Column:
    """Case-insensitive: some wanted name is in the array."""
    return F.arrays_overlap(F.transform(have, lambda x: F.lower(x)), lits([w.lower() for w in wanted]))


def matching(have: Column, wanted) -> Column:
    """The wanted names that are in the array, in the wanted order and spelling."""
    lower = F.transform(have, lambda x: F.lower(x))
    return F.filter(lits(wanted), lambda w: F.array_contains(lower, F.lower(w)))


def trimmed(x: Column) -> Column:
    """x without the white space around it, of every kind (not only spaces)."""
    return F.btrim(x, F.lit(WHITE))


def present(x: Column) -> Column:
    """x says something: it isn't null, empty or all white space."""
    return F.coalesce(trimmed(x) != "", F.lit(False))


def bar(score: Column, most: Column, width: int = 20) -> Column:
    """A score as # and -."""
    n = whole(score / most * width)
    return F.concat(F.repeat(F.lit("#"), n), F.repeat(F.lit("-"), width - n))
