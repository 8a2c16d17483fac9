"""Host and path of a url, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: str) -> Column:
    """What follows the first ://; empty for null or without one."""
    col = F.col(url)
    return F.when(F.instr(col, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)
