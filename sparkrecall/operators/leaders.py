"""Greedy choice over a table of pairs: what stays is what is like nothing that stays before it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecall.sources.store import settled

#: The share of the pairs that a round must settle for another to follow.
WORTH = 0.1


def _ordered(left: DataFrame) -> DataFrame:
    """(id) of what goes, by one pass over each key's pairs in order. A task streams them and holds the ids of one key
    that went."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gone = None, set()
        for batch in batches:
            out = []
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    key, gone = k, set()
                if a not in gone and b not in gone:  # a stays; pairs come by the place of b, so it is settled
                    gone.add(b)
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(2).type)], names=["id"])

    kind = left.schema["b"].dataType.simpleString()
    rows = left.withColumn("k", F.sha2(F.to_json(F.struct("k")), 256))
    return rows.repartition("k").sortWithinPartitions("k", "ob", "b").select("k", "a", "b").mapInArrow(walk, f"id {kind}")


def leaders(pairs: DataFrame) -> DataFrame:
    """(id, into): of what goes, the first that stays and is like it. `pairs` (k, a, b, oa, ob): a and b of one key are alike,
    and a is before b by oa and ob.

    An item goes if one that stays is like it and before it. In each round all those are settled whose earlier ones are:
    what no open pair has as its later one stays, and what is paired with that goes, with its pairs. Chains in which each
    item waits for the one before it can be as long as the table, and no rule settles all such at once; when a round
    settles less than a WORTH part of the open pairs, the rest is gone through in order.
    """
    pairs = settled(pairs.select("k", "a", "b", "oa", "ob"))
    left, n, gone = pairs.select("k", "a", "b", "ob"), pairs.count(), []
    while n:
        waits = left.select(F.col("b").alias("a")).distinct()
        now = settled(left.join(waits, "a", "left_anti").select(F.col("b").alias("id")).distinct())
        gone.append(now)
        left = settled(left.join(now.withColumnRenamed("id", "b"), "b", "left_anti").join(now.withColumnRenamed("id", "a"), "a", "left_anti").select("k", "a", "b", "ob"))
        n, before = left.count(), n
        if 0 < n and before - n < WORTH * before:
            gone.append(settled(_ordered(left)))
            break
    went = pairs.limit(0).select(F.col("a"))
    for some in gone:
        went = went.unionByName(some.withColumnRenamed("id", "a"))
    return pairs.join(went, "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min_by("a", "oa").alias("into"))
