"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm.common import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round. The least neighbour of each node is a pre-aggregated minimum, joined back to the links, so that a
    node with a great many neighbours is neither one task's window nor a collected list."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a").where("b > a")
        found = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        found = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return found.where("a != b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): of every node that has a link, the least node it can reach, itself included.

    `links` has columns a and b of one orderable type; order, repeats and self-links don't matter. Nulls must not
    occur. No links: no rows. Every round's links are written to the shared folder, which cuts the lineage.
    """
    # first least to greatest, without repeats and self-links
    now = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = mark
        now = materialize(_stars(_stars(now, large=True), large=False), "links")
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
