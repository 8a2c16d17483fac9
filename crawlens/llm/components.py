"""Connected components of a link table, distributed: alternating large and small stars.

Each round points every node's greater neighbours, then its smaller ones, at the least
node it sees (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). The
links end as stars around each component's least node. Minima are combined before the
shuffle, the joins back are equi-joins that adaptive execution can split, and each round
is written in the shared folder (the one before is deleted), so nothing is gathered in one
place and no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.llm.common import released, staged


def _sum(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def stars(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """links: (u, v) of type long, any order, repeats and loops allowed. Returns (u, v), staged: v is the least node of u's component, u != v.

    With a number of rounds, it stops after so many: a u may then have several v, each of its component.
    """
    edges = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    seen = None
    done = 0
    while (done < rounds if rounds else (now := _sum(edges)) != seen and now[0]):
        done += 1
        if not rounds:
            seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        released(links.sparkSession, before)
    return edges
