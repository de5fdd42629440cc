"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each input partition go to each block of the output is drawn first, exactly (every row sum is a
partition's size, every column sum a block's). A partition then permutes its rows and deals them by its row of the
matrix, the rows are exchanged, and each block permutes what it got. Every permutation of the rows is equally likely.

Blocks are at most `block_rows` slots of one shard, so no task holds more than that however large a shard is. The
matrix is never built: a task draws its own partition's row, walking down a binary tree over the partitions whose
nodes split their share of every block by draws seeded with the node. Only the partition sizes are sent to the tasks,
8 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, materialize

#: Rows of an input partition are numbered in the low 33 bits of Spark's increasing ids, partitions above them.
ROW_BITS = 33


def blocks_of(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: its shard, its first slot, its size. Shard sizes differ by one at most; the first get more."""
    sizes = np.full(shards, rows // shards, np.int64)
    sizes[: rows % shards] += 1
    shard, first, size = [], [], []
    for s, n in enumerate(sizes.tolist()):
        for at in range(0, n, block_rows):
            shard.append(s)
            first.append(at)
            size.append(min(block_rows, n - at))
    return np.array(shard, np.int64), np.array(first, np.int64), np.array(size, np.int64)


def _split(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """How many of each color are among n drawn without replacement."""
    total = int(colors.sum())
    if n == 0 or total == 0:
        return np.zeros_like(colors)
    if n == total:
        return colors
    if total < 10**9:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    half = len(colors) // 2  # numpy's draws hold below 10^9 in all: halve the colors, then draw each half
    if half == 0:
        return np.array([n])
    left, right = int(colors[:half].sum()), int(colors[half:].sum())
    k = _large(rng, left, right, n)
    return np.concatenate((_split(rng, colors[:half], k), _split(rng, colors[half:], n - k)))


def _large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw beyond numpy's limit of 10^9, by inversion over 12 standard deviations about the mean."""
    total = good + bad
    mean = n * good / total
    spread = 12 * (mean * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5 + 12
    k = np.arange(max(0, n - bad, int(mean - spread)), min(n, good, int(mean + spread)) + 1, dtype=np.float64)
    # the logarithm of each probability over the one before
    steps = np.log(good - k[:-1]) + np.log(n - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - n + k[:-1] + 1)
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    upto = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(k) - 1)])


class Matrix:
    """Rows of the communication matrix, each drawn when it is asked for; the same in every task and in every rerun."""

    def __init__(self, sizes: list[int], blocks: np.ndarray, seed: int):
        self.ends, self.blocks, self.seed = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))), blocks, seed

    def row(self, partition: int) -> np.ndarray:
        low, high, colors, node = 0, len(self.ends) - 1, self.blocks, 1
        while high - low > 1:
            middle = (low + high) // 2
            left = _split(np.random.default_rng([self.seed, 1, node]), colors, int(self.ends[middle] - self.ends[low]))
            low, high, colors, node = (low, middle, left, 2 * node) if partition < middle else (middle, high, colors - left, 2 * node + 1)
        return colors


def uniform_shuffle(rows: DataFrame, shards: int, seed: int = 0, block_rows: int = 1 << 16, block_bytes: int = 1 << 25) -> DataFrame:
    """`rows` with int columns shard and bigint slot: shard sizes differ by one at most, slots are gapless from 0.

    Values play no part: nulls, repeats and equal rows are dealt like others. An empty table gives no rows. Columns
    named shard, slot, __row and __block are replaced. The rows are written to the shared folder once, with the numbers by which
    they are dealt; a rerun of a lost task therefore deals the same. A task settles blocks of at most block_rows rows, fewer
    where so many are more than block_bytes on average: which rows meet in a block is random, so the average holds for each.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "__row", "__block")
    names = rows.columns
    held = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    number = F.shiftright("__row", ROW_BITS)
    counts = held.groupBy(number.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # one row for each input partition
    place = {r.p: i for i, r in enumerate(counts)}
    sizes = [r.n for r in counts]
    long = [F.octet_length(f.name) for f in rows.schema.fields if f.dataType.typeName() in ("string", "binary")]
    mean = held.agg(F.avg(sum((F.coalesce(x, F.lit(0)) for x in long), F.lit(16)))).first()[0] or 16
    shard, first, size = blocks_of(sum(sizes), shards, max(1, min(block_rows, int(block_bytes // mean))))
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((place, sizes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = Matrix(shared.value[1], size, seed)

        @lru_cache(maxsize=4)
        def dealt(p: int) -> np.ndarray:
            i = shared.value[0][p]
            out = np.repeat(np.arange(len(size)), matrix.row(i))
            return np.random.default_rng([seed, 2, i]).permutation(out)  # the partition's own permutation

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("__row")).to_numpy()
            parts, at = ids >> ROW_BITS, ids & ((1 << ROW_BITS) - 1)
            block = np.zeros(len(ids), np.int64)
            for p in np.unique(parts).tolist():
                mine = parts == p
                block[mine] = dealt(p)[at[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=[*batch.schema.names, "__block"])

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")  # the order in which rows arrive plays no part
        b = table.column("__block")[0].as_py()
        slots = first[b] + np.random.default_rng([seed, 3, b]).permutation(table.num_rows)
        out = table.select(names).append_column("shard", pa.array(np.full(table.num_rows, shard[b], np.int32)))
        return out.append_column("slot", pa.array(slots.astype(np.int64)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    moved = held.mapInArrow(deal, f"{kinds}, __row bigint, __block bigint")
    return moved.groupBy("__block").applyInArrow(settle, f"{kinds}, shard int, slot bigint")


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`. The documents are dealt with their texts, and told by what arrives. Null texts: size 16, checksum 0."""
    dealt, text = uniform_shuffle(documents(spark, sf_dir), 40), F.coalesce("text", F.lit(""))
    return dealt.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
