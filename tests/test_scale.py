"""Operators on data that are all one key's, against models that go row by row."""

from __future__ import annotations

import datetime as dt
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall import model as M
from sparkrecall.functions import text as X
from sparkrecall.functions.patterns import CONTRADICTIONS
from sparkrecall.operators import ingest as I
from sparkrecall.operators import layers as Y
from sparkrecall.operators import lifecycle as L
from sparkrecall.operators import search as S
from sparkrecall.operators import similar as N
from sparkrecall.operators.leaders import leaders
from sparkrecall.plans.engine import Config, Engine
from sparkrecall.streaming import limits as T

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def greedy(pairs):
    """{id: into} of what goes, item by item."""
    before = {}
    for k, a, b in pairs:
        before.setdefault((k, b), []).append(a)
    into = {}
    for k, b in sorted(before):
        stay = [a for a in sorted(before[k, b]) if (k, a) not in into]
        if stay:
            into[k, b] = stay[0]
    return into


def chosen(spark, pairs):
    rows = [(k, f"{k}-{a}", f"{k}-{b}", a, b) for k, a, b in pairs]
    df = spark.createDataFrame(rows, "k struct<x:int>, a string, b string, oa long, ob long") if not rows else spark.createDataFrame([((k,), *r) for k, *r in rows], "k struct<x:int>, a string, b string, oa long, ob long")
    return {tuple(map(int, r.id.split("-"))): int(r.into.split("-")[1]) for r in leaders(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaders_against_a_greedy_model(spark, seed):
    rng = random.Random(seed)
    pairs = {(k, *sorted(rng.sample(range(30 * k + 5), 2))) for k in range(4) for _ in range(60 * k + 5)}
    assert chosen(spark, pairs) == greedy(pairs)
    assert chosen(spark, []) == {}


@pytest.mark.parametrize("steps", [(1,), (1, 2), (1, 3)])
def test_leaders_in_a_chain(spark, steps):
    """No item is settled before the one before it is."""
    pairs = [(0, i, i + s) for i in range(4000) for s in steps]
    assert chosen(spark, pairs) == greedy(pairs)


def test_ten_thousand_insights_of_one_actor_in_a_chain(spark):
    """Each is like its neighbours only, and all have a word in common."""
    n = 10_000
    rows = [(i, 0, 0, "t", "a", "u", "fact", "all " + " ".join(f"w{j}" for j in range(i, i + 12)), 0.9, 0.9, ["x"], [f"e{i}"], NOW, f"i{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, strategy int, pos int, tenant_id string, app_id string, actor_id string, type string, content string, confidence double, importance double, tags array<string>, extracted_from array<string>, last_updated timestamp, id string")
    out = Y.stored(df).select("id", "n", F.size("extracted_from").alias("sources")).collect()
    assert sorted(int(r.id[1:]) for r in out) == list(range(0, n, 2)) and all((r.n, r.sources) == (2, 2) for r in out)


def model(rows, limit, window=60_000):
    out, state = {}, {}
    for who, ms, seq in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        begin, n = state.get(who, (None, 0))
        begin, n = (ms, 0) if begin is None or ms - begin >= window else (begin, n)
        state[who] = (begin, n + 1)
        out[seq] = (n < limit, None if n < limit else max(1, -((ms - begin - window) // 1000)))
    return out


def limited(spark, rows, limit):
    df = spark.createDataFrame(rows, "identity string, ms long, seq long").withColumn("ts", F.timestamp_millis("ms"))
    return {r.seq: (r.allowed, r.retry_after) for r in T.rate_limited(df, limit).collect()}


@pytest.mark.parametrize(("seed", "step"), [(1, 900), (2, 20_000), (3, 70_000), (4, 400_000_000)])
def test_rate_limit_of_one_busy_identity(spark, seed, step):
    """Days of requests without a pause, over pauses of all lengths, before and after 1970."""
    rng = random.Random(seed)
    at, rows = -3_000_000, []
    for i in range(3000):
        at += rng.choice([0, 1, rng.randint(0, step), rng.randint(0, step // 10 + 1), 59_999, 60_000, 60_001][: 4 if step < 10_000 else 7])
        rows.append((rng.choice(["x"] * 9 + ["y", None]), at, i))
    assert limited(spark, rows, 3) == model(rows, 3)


def test_begins_are_few_jumps_away(spark):
    """Five thousand windows of one identity, one after the other."""
    df = spark.range(5000).select(F.lit("x").alias("identity"), (F.col("id") * 60_000).alias("ms"))
    more = df.unionByName(df.withColumn("ms", F.col("ms") + 31_000))
    assert T.window_begins(more, 60_000).agg(F.count("*"), F.count_if(F.col("ms") % 60_000 == 0)).first() == (5000, 5000)
    late = more.where("ms != 0")  # the first is at 31 seconds
    assert T.window_begins(late, 60_000).agg(F.count("*"), F.count_if(F.col("ms") % 60_000 == 31_000)).first() == (5000, 5000)


def test_rate_limit_of_nothing(spark):
    assert limited(spark, [], 3) == {}


@pytest.mark.parametrize(("keep", "chunk"), [(0.9, 256), (0.999, 64), (0.1, 256)])
def test_moving_average_of_one_key_over_many_tasks(spark, keep, chunk):
    rng = random.Random(5)
    rows = [(rng.choice(["x"] * 30 + ["y", None]), i, rng.uniform(-5, 5)) for i in range(6000)]
    expected, state = {}, {}
    for who, i, v in rows:
        state[who] = expected[i] = keep * state.get(who, 0.0) + (1 - keep) * v
    df = spark.createDataFrame(rows, "who string, i long, v double").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the rows are in several ranges
    try:
        got = {r.i: r.ema for r in T.moving_average(df, "who", "i", "v", keep, chunk).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert set(got) == set(expected) and all(abs(got[i] - x) < 1e-9 for i, x in expected.items())


def scanned(df):
    """Rows that the scan of memories gave."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if "Scan parquet" in p.nodeName():
            out.append(p.metrics().apply("numOutputRows").value())
        inner = [p.executedPlan()] if "AdaptiveSparkPlan" in p.nodeName() else [p.plan()] if "QueryStage" in p.nodeName() else []
        for x in inner + [p.children().apply(i) for i in range(p.children().size())]:
            walk(x)

    walk(plan)
    return sum(out)


def test_a_lookup_of_ten_ids_reads_few_row_groups(spark, tmp_path):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = spark.range(40_000).select(
        F.col("id").alias("arrival_seq"), F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), (F.col("id") % 50).cast("string").alias("actor_id"), F.lit("fact").alias("memory_type"),
        F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.struct(F.lit("chat").alias("source_type"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_session_id")).alias("source"), now.alias("observed_at"),
    )
    have = set(rows.columns)
    for f in spark.createDataFrame([], M.OBSERVATIONS).schema:
        if f.name not in have:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    e = Engine(spark, Config(store="parquet", path=str(tmp_path / "s")), lambda: now)
    name = "parquet.block.size"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set(name, str(64 << 10))  # row groups of a few thousand rows
    try:
        e.store.write(I.ingest(rows, now).select(*e.columns))
    finally:
        conf.unset(name)
    ids = e.dump().where("ord % 4001 = 7").select("id")
    found = e.get(ids)
    assert found.count() == 10 and {r.ord % 4001 for r in found.select("ord").collect()} == {7}
    assert scanned(e.get(ids)) < 0.7 * 40_000
    many = e.dump().where("ord < 300").select("id")
    assert e.get(many).count() == 300


def test_nearest_of_many_vectors(spark):
    """Sixteen million pairs of 64 dimensions: no matter of evaluating them one by one."""
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i * i).cast("float")).alias("embedding")).persist()
    rows.count()
    begun = time.monotonic()
    got = S.nearest(rows, rows.where("vec_id % 25 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q")), 5)
    assert got.count() == 4000 and time.monotonic() - begun < 20
    rows.unpersist()


def test_nearest_against_every_pair(spark):
    """Ties, copies, zeros, other lengths, nulls, what is not finite: as vector_similarity has them."""
    rng = random.Random(5)
    one = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(6)]) for i in range(300)] + [(300 + i, one) for i in range(40)]
    rows += [(340, [0.0] * 6), (341, []), (342, None), (343, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (344, [1.0] * 5), (345, [float("inf"), 1.0, 0.0, 0.0, 0.0, 0.0]), (346, [float("nan")] * 6), (347, [-x for x in one]), (7, one), (None, one)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"))
    met = v.join(q, F.col("vec_id") != F.col("q_id")).select("q_id", "vec_id", X.vector_similarity(F.col("q"), F.col("embedding")).alias("s"))
    first = W.partitionBy("q_id").orderBy(F.desc("s"), "vec_id")
    rows = lambda df: sorted((r.q_id, r.rank, repr(r.s)) for r in df.collect())  # noqa: E731  7 is there twice
    expected = rows(met.withColumn("rank", F.row_number().over(first)).where("rank <= 5"))
    for size in (50, 20_000):
        assert rows(S.nearest(v, q, 5, block_rows=size, part_rows=size).withColumnRenamed("similarity", "s")) == expected


def test_contradictions_of_one_actor_are_many_tasks(spark):
    """All pairs of one actor, as compared one by one; no key has them all."""
    rng = random.Random(6)
    said = ["my gps works", "the gps does not work", "gps issue", "car is fine", "a car problem", "nothing"]
    texts = [" ".join([rng.choice(said), *(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 9)))]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, text string").select(F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.lit("u").alias("actor_id"), F.col("n").alias("arrival_seq"), F.col("n").alias("id"), "text")
    sides = [[(bool(re.search(p, t)), bool(re.search(q, t))) for p, q in CONTRADICTIONS] for t in texts]
    words = [set(t.lower().split()) for t in texts]
    expected = {(i, j): 0.8 if len(words[i] & words[j]) / len(words[i] | words[j]) > 0.5 else 0.3 for i in range(300) for j in range(300) if any((a and d) or (b and c) for (a, b), (c, d) in zip(sides[i], sides[j], strict=True))}
    assert set(expected.values()) == {0.3, 0.8}
    for size in (20, 4096):
        got = L.contradictions(rows, rows, "text", part_rows=size)
        assert {(r.new_seq, r.old_id): r.confidence for r in got.collect()} == expected and got.count() == len(expected)
    plan = L.contradictions(rows, rows, part_rows=20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per = [r["count"] for r in plan.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per) == 4 and max(per) < 0.5 * sum(per)


def texts_of(rng, n, least, most, vocabulary=400):
    """Words of which some are in most texts; every tenth text is said before."""
    out = []
    for _ in range(n):
        words = [f"w{int(vocabulary ** rng.random())}" for _ in range(rng.randint(least, most))]
        out.append(rng.choice(out) if out and rng.random() < 0.1 else " ".join(words))
    return out


def said(spark, rows):
    """Insights of (id, actor, content)."""
    df = spark.createDataFrame(rows, "id long, actor_id string, content string")
    return df.select("*", F.col("id").alias("order"), F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.lit("fact").alias("type"), (F.crc32("content") / 2**32).alias("confidence"), F.lit(0.5).alias("importance"), F.array(F.concat("actor_id", F.col("id").cast("string"))).alias("extracted_from"), F.array(F.lit("x")).alias("tags"))


def merged(rows, threshold):
    """(id, content, sources) of what consolidated() leaves, pair by pair."""
    sets = [None if t is None else set(t.split(" ")) for *_, t in rows]
    alike = lambda i, j: rows[i][1] == rows[j][1] and rows[i][0] < rows[j][0] and None not in (sets[i], sets[j]) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > threshold
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if alike(i, j)]
    gone = {rows[j][0] for _, j in pairs}
    source = lambda i: f"{rows[i][1]}{rows[i][0]}"
    return sorted((r[0], str(r[2]), tuple(sorted([source(i), *(source(y) for x, y in pairs if rows[x][0] == r[0])]))) for i, r in enumerate(rows) if r[0] not in gone)


def left(insights, threshold):
    return sorted((r.id, str(r.content), tuple(sorted(r.extracted_from))) for r in Y.consolidated(insights, threshold=threshold).collect())


def test_long_texts_of_one_actor_are_consolidated_at_once(spark):
    """Common words bring nearly all pairs of 3,000 texts together; few of these are alike."""
    rng = random.Random(8)
    texts = [" ".join(f"w{int(4000 ** rng.random())}" for _ in range(90)) for _ in range(3000)]
    begun = time.monotonic()
    got = left(said(spark, [(i, "u", t) for i, t in enumerate(texts + texts[:5])]), 0.45)
    assert time.monotonic() - begun < 40
    assert [r[0] for r in got if len(r[2]) > 1][:5] == list(range(5)) and len(got) > 2900


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.7])
def test_consolidated_in_blocks_and_by_words(spark, monkeypatch, threshold):
    """Both ways give every pair, for many blocks too."""
    rng = random.Random(3)
    rows = [(i, rng.choice("uuuv"), t) for i, t in enumerate([*texts_of(rng, 250, 1, 12, 60), None, None, "", ""])]
    expected = merged(rows, threshold)
    assert 10 < len(expected) < len(rows) - 10
    for meets, size in ((2**40, 2**14), (-1, 2**14), (-1, 40)):
        monkeypatch.setattr(N, "MEETS", meets)
        monkeypatch.setattr(N, "PART", 0)
        monkeypatch.setattr(N, "ROWS", size)
        assert left(said(spark, rows), threshold) == expected


def test_consolidated_where_ids_repeat(spark):
    """Rows of one id are told apart by actor and text; the id goes if any of its rows does, as the SQL of the query has it."""
    rng = random.Random(4)
    rows = [(rng.randint(0, 90), rng.choice("uv"), t) for t in texts_of(rng, 120, 2, 9, 40)]
    assert left(said(spark, rows), 0.4) == merged(rows, 0.4)


@pytest.mark.parametrize(("at_once", "cells"), [(2**21, 2**24), (700, 2**24), (700, 900), (700, 0)])
def test_shared_words_are_counted_in_any_pieces(monkeypatch, at_once, cells):
    monkeypatch.setattr(N, "AT_ONCE", at_once)
    monkeypatch.setattr(N, "CELLS", cells)
    rng = random.Random(5)
    sets = [sorted(set(t.split(" "))) for t in texts_of(rng, 300, 1, 30)]
    own = [rng.choice([2, 2, 3]) for _ in sets]
    for low, high in ((2, 2), (2, 3)):
        chosen = [i for i in range(300) if own[i] in (low, high)]
        table = pa.table({"own": pa.array([own[i] for i in chosen], pa.int32()), "c": pa.array([b"%d" % i for i in chosen]), "w": [sets[i] for i in chosen]})
        got = N._shared(table, low, high, 0.3)
        pairs = [tuple(sorted((int(x), int(y)))) for x, y in zip(got["c"].to_pylist(), got["d"].to_pylist(), strict=True)]
        expected = {(i, j) for i in chosen for j in chosen if i < j and (low == high or own[i] != own[j]) and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) > 0.3}
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected
