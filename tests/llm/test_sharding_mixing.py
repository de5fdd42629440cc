from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrecall.llm import mixing as M
from sparkrecall.llm import sharding as H


def test_matrix_has_exact_sums():
    sizes = [0, 17, 1000, 3, 250, 0, 730]
    _, _, blocks = H.blocks_of(2000, 7, 64)
    m = H.Matrix(sizes, blocks, 5)
    rows = np.stack([m.row(i) for i in range(len(sizes))])
    assert rows.sum(axis=1).tolist() == sizes and (rows.sum(axis=0) == blocks).all()
    assert (rows >= 0).all() and (m.row(2) == H.Matrix(sizes, blocks, 5).row(2)).all()


def test_matrix_is_hypergeometric():
    """The mean and variance of one entry over seeds."""
    blocks = np.full(10, 10)
    x = np.array([H.Matrix([30, 30, 40], blocks, s).row(1)[3] for s in range(3000)])
    assert abs(x.mean() - 3) < 0.1
    assert abs(x.var() - 30 * 0.1 * 0.9 * 70 / 99) < 0.15


def test_draws_beyond_the_limit_of_numpy():
    rng = np.random.default_rng(0)
    x = [H._large(rng, 3 * 10**9, 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(x) / 750_000 - 1) < 1e-3 and 300 < np.std(x) < 600
    assert H._split(rng, np.array([10**9, 10**9]), 5 * 10**8).sum() == 5 * 10**8


@pytest.mark.parametrize("block_rows", [1 << 16, 13])
def test_shuffle(spark, block_rows):
    df = spark.range(0, 1003, 1, 6).withColumnRenamed("id", "doc_id")
    rows = H.uniform_shuffle(df, 40, seed=1, block_rows=block_rows).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1003))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and {len(s) for s in slots.values()} == {25, 26}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: (r.shard, r.slot) for r in H.uniform_shuffle(df, 40, seed=1, block_rows=block_rows).collect()}
    assert all(again[r.doc_id] == (r.shard, r.slot) for r in rows)
    other = {r.doc_id: (r.shard, r.slot) for r in H.uniform_shuffle(df, 40, seed=2, block_rows=block_rows).collect()}
    assert sum(other[r.doc_id] == (r.shard, r.slot) for r in rows) < 30


def test_shuffle_of_odd_rows(odd, none):
    rows = odd.drop("shard")
    again = H.uniform_shuffle(odd.withColumn("slot", F.lit("x")).withColumn("__row", F.lit(1)), 3)
    assert again.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"] and again.count() == odd.count()
    assert H.uniform_shuffle(odd, 3, block_bytes=1).count() == odd.count()  # a block for each row
    assert H.uniform_shuffle(rows, 3).count() == rows.count()
    assert H.uniform_shuffle(none.drop("shard"), 3).count() == 0


def water(sizes, weights, share=1.5, most=2.0):
    left, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_are_those_of_repeated_sharing(spark):
    rng = random.Random(1)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for i in range(n)}
        if n > 2:
            sizes[None] = 77
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
        got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        for s, t in water(sizes, weights).items():
            assert got[s] == pytest.approx(t, abs=1e-6)


@pytest.mark.parametrize("piece_rows", [7, 20_000])
def test_mix(spark, piece_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "ü", None]), rng.choice([0, 1, 5, 50, 200, None])) for i in range(3000)]
    mixed = M.curriculum(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint"), piece_rows=piece_rows).collect()
    assert len(mixed) == 3000
    taken, most = Counter(), Counter()
    for r in mixed:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and (r.size > 0 or r.copies == 0)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for r in mixed:
        assert abs(taken[r.source] - r.target) <= most[r.source]


def test_schedule_is_inverted(spark):
    for slope in M.SLOPES:
        for part in (0.0, 0.1, 0.5, 0.99, 1.0):
            t = spark.range(1).select(M.when_demanded(F.lit(part), F.lit(slope)).alias("t")).first().t
            assert t + slope / 2 * (t * t - t) == pytest.approx(part, abs=1e-12)


def test_mix_of_odd_rows(odd, none):
    sized = lambda d: d.select("doc_id", "source", M.n_words(F.col("text")).alias("size"))
    assert M.curriculum(sized(odd)).count() == odd.count()
    assert M.curriculum(sized(none)).count() == 0
    clash = sized(odd).withColumn("target", F.lit("x")).withColumn("positions", F.lit(1)).withColumn("weight", F.lit("w")).withColumn("n", F.lit(3)).withColumn("pieces", F.lit(0)).withColumn("s", F.lit(0)).withColumn("start", F.lit(0))
    mixed = M.curriculum(clash)
    assert mixed.count() == odd.count() and dict(mixed.dtypes)["target"] == "double" and dict(mixed.dtypes)["weight"] == "string"
    assert sorted(map(str, M.curriculum(sized(odd.repartition(3))).collect())) == sorted(map(str, M.curriculum(sized(odd)).collect()))  # reruns agree
    copies = M.by_position(M.curriculum(sized(odd))).collect()
    assert all(r.size > 0 for r in copies)
