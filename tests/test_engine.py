"""Goldens by hand, and each set-based rewrite against a plain model that goes row by row."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkrecall import model as M
from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X
from sparkrecall.operators import context as K
from sparkrecall.operators import ingest as I
from sparkrecall.operators import layers as Y
from sparkrecall.operators import lifecycle as L
from sparkrecall.operators import search as S
from sparkrecall.plans import assistants as A
from sparkrecall.plans.engine import Config, Engine, open_engine
from sparkrecall.plans.tuned import TunedEngine
from sparkrecall.sources.store import JsonStore, ParquetStore, observations_stream, read_observations
from sparkrecall.streaming import limits as T

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def observation(seq, text, actor="u", at=None, ttl=180, kind="time", **more):
    base = dict(arrival_seq=seq, tenant_id="t", app_id="a", actor_id=actor, thread_id=None, memory_type="fact", scope=None, text=text, summary=None, metadata=None, source=("chat", None, None), confidence=None, importance=None, decay=(kind, ttl), observed_at=at)
    return base | more


def frame(spark, obs):
    order = [f.split(" ")[0] for f in _columns()]
    return spark.createDataFrame([tuple(o[c] for c in order) for o in obs], M.OBSERVATIONS)


def _columns():
    out, depth, now_ = [], 0, ""
    for ch in M.OBSERVATIONS:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(now_.strip())
            now_ = ""
        else:
            now_ += ch
    return [*out, now_.strip()]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("I have an issue with my GPS not working correctly", ["have", "issue", "my", "gps", "not", "working", "correctly"]),
        ("What was the first issue with my car GPS?", ["what", "first", "issue", "my", "car", "gps"]),
        ("  Hello The  gps, Élan  ", ["hello", "gps", "lan"]),
        ("", []),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, X.tokenize(F.lit(text))) == tokens


def test_hashes(spark):
    for token, h in (("have", 3195240), ("issue", 100509913), ("my", 3500), ("works", 113318786)):
        assert one(spark, X.token_hash(F.lit(token))) == h


def test_similarities(spark):
    gps, tea = "I have an issue with my GPS not working correctly", "Prefers concise outreach messages"
    q = "What was the first issue with my car GPS?"
    emb = lambda t: X.embedding(X.tokenize(F.lit(t)))
    tok = lambda t: X.tokenize(F.lit(t))
    assert one(spark, X.overlap(tok("outreach style"), tok(tea))) == 0.25
    assert round(one(spark, X.overlap(tok(q), tok(gps))), 6) == 0.428571
    assert one(spark, X.jaccard(X.raw_words(F.lit(q)), X.raw_words(F.lit(gps)))) == 0.1875
    assert round(one(spark, X.similarity(emb("outreach style"), emb(gps))), 6) == 0.510817
    assert round(one(spark, X.similarity(emb(q), emb(gps))), 6) == 0.978206
    assert one(spark, X.similarity(emb(""), emb(gps))) == 0


def test_embedding_is_the_plane_of_all_dimensions(spark):
    """The closed form against the sums over 384 dimensions."""

    def long(text):
        h = [one(spark, X.token_hash(F.lit(t))) for t in one(spark, X.tokenize(F.lit(text)))]
        return [sum(math.sin(x + j) for x in h) for j in range(384)]

    a, b = "Works from home on Mondays and Fridays", "the laptop then failed with an error"
    u, v = long(a), long(b)
    cos = sum(x * y for x, y in zip(u, v, strict=True)) / math.sqrt(sum(x * x for x in u) * sum(y * y for y in v))
    emb = lambda t: X.embedding(X.tokenize(F.lit(t)))
    assert one(spark, X.similarity(emb(a), emb(b))) == pytest.approx(max(0, cos), abs=1e-9)


def test_times(spark):
    at = lambda days: F.lit(NOW - dt.timedelta(days=days))
    for days, value in ((0, 1), (15, 0.707107), (30, 0.5), (90, 0.125)):
        assert round(one(spark, X.recency(now(), at(days))), 6) == value
    for days, value in ((0, 1.2), (15, 1.121306), (30, 1.073576)):
        assert round(one(spark, X.insight_decay(now(), at(days))), 6) == value
    exact = NOW - dt.timedelta(days=5)
    assert not one(spark, X.expired(now(), F.lit(exact), F.lit("time"), F.lit(5)))
    assert one(spark, X.expired(now(), F.lit(exact - dt.timedelta(milliseconds=1)), F.lit("inactivity"), F.lit(5)))
    assert not one(spark, X.expired(now(), F.lit(exact), F.lit("none"), F.lit(1)))
    assert not one(spark, X.expired(now(), F.lit(exact), F.lit("time"), F.lit(0)))


def test_patterns(spark):
    assert one(spark, P.temporal_order(F.lit("The first issue came after the last service"))) == 2
    assert one(spark, P.temporal_order(F.lit("Started the initial setup, then the final test"))) == -4
    assert one(spark, P.every_match(F.lit("éfirst First"), "first")) == ["first", "First"]
    assert one(spark, X.summarize(F.lit("x" * 121))) == "x" * 117 + "..."
    assert one(spark, X.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}


def test_ingest_goldens(spark):
    old, new = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc), dt.datetime(2024, 1, 20, tzinfo=dt.timezone.utc)
    m = I.ingest(frame(spark, [observation(0, "same text", at=old, ttl=1), observation(1, "Same Text", at=new, ttl=1)]), now()).orderBy("ord").collect()
    assert [r.status for r in m] == ["archived", "active"]
    earlier = dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc)
    (m,) = I.ingest(frame(spark, [observation(0, "same text", at=new), observation(1, "same text", at=earlier)]), now()).collect()
    assert m.n_observations == 2 and m.last_seen_at.day == 10 and m.first_seen_at.day == 20
    assert I.ingest(frame(spark, []), now()).count() == 0


def test_ingest_against_a_sequential_model(spark):
    rng = random.Random(3)
    obs = []
    for i in range(400):
        text, actor = rng.choice(["alpha text", "Alpha  text", "beta text"]), rng.choice("xyz")
        obs.append(observation(i, text, actor, NOW - dt.timedelta(days=rng.randint(0, 40)), ttl=20, confidence=rng.random(), metadata={rng.choice("ab"): str(rng.randint(0, 9))}))
    records = []
    for o in obs:
        text = " ".join(o["text"].split())
        gone = lambda r: (NOW - r["last"]).total_seconds() > 20 * 86400
        for r in records:
            if r["status"] == "active" and gone(r):
                r["status"] = "archived"
        hit = next((r for r in records if r["status"] == "active" and r["actor"] == o["actor_id"] and r["text"].lower() == text.lower()), None)
        if hit:
            hit |= {"last": o["observed_at"], "conf": max(hit["conf"], o["confidence"]), "n": hit["n"] + 1, "meta": hit["meta"] | o["metadata"]}
        else:
            records.append({"actor": o["actor_id"], "text": text, "last": o["observed_at"], "conf": o["confidence"], "n": 1, "meta": o["metadata"], "status": "active", "ord": o["arrival_seq"]})
    got = {r.ord: r for r in I.ingest(frame(spark, obs), now()).collect()}
    assert sorted(got) == [r["ord"] for r in records]
    for r in records:
        g = got[r["ord"]]
        assert (g.text, g.actor_id, g.n_observations, g.metadata) == (r["text"], r["actor"], r["n"], r["meta"])
        assert g.confidence == pytest.approx(r["conf"]) and g.last_seen_at == r["last"].replace(tzinfo=None)


def test_diverse_against_a_greedy_model(spark):
    rng = random.Random(5)
    hits, queries = [], []
    for q in range(30):
        queries.append((f"q{q}", rng.randint(2, 6), rng.choice([300, 400, 900])))
        for rank in range(1, rng.randint(2, 16)):
            hits.append((f"q{q}", rank, f"m{q}-{rank}", "fact", rng.choice(["a", "b", "c", None]), "x" * rng.randint(20, 200), None, round(rng.random(), 2)))
    h = spark.createDataFrame(hits, "query_id string, rank int, id string, memory_type string, thread_id string, text string, summary string, score double")
    q = spark.createDataFrame(queries, "query_id string, max_items int, max_chars int")
    got = {r.query_id: [x.id for x in r.selected] for r in K.diverse(q, h).collect()}
    for name, items, chars in queries:
        mine = [x for x in hits if x[0] == name]
        if len(mine) <= items:
            expected = [x[2] for x in mine]
        else:
            expected, used, total = [], set(), 0
            for x in sorted(mine, key=lambda x: (-x[7], x[1])):
                if len(expected) >= items:
                    break
                if total + len(x[5]) > max(chars, 300) or (x[4] in used and len(used) < items / 2):
                    continue
                expected.append(x[2])
                total += len(x[5])
                used.add(x[4])
        assert got[name] == expected


def _jaccard(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b)


def test_stored_and_consolidated_against_models(spark):
    rng = random.Random(9)
    words = "one two three four five six seven".split()
    rows = [(i, 0, 0, "t", "a", rng.choice("uv"), "fact", " ".join(rng.sample(words, rng.randint(4, 7))), rng.random(), rng.random(), [f"e{i}"], NOW, [rng.choice(words)], f"i{i}") for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, strategy int, pos int, tenant_id string, app_id string, actor_id string, type string, content string, confidence double, importance double, extracted_from array<string>, last_updated timestamp, tags array<string>, id string")
    kept = []
    for r in rows:
        hit = next((k for k in kept if k["actor"] == r[5] and _jaccard(k["content"], r[7]) > 0.8), None)
        if hit:
            hit["conf"], hit["n"] = max(hit["conf"], r[8]), hit["n"] + 1
        else:
            kept.append({"actor": r[5], "content": r[7], "conf": r[8], "imp": r[9], "n": 1})
    got = sorted((r.actor_id, r.content, round(r.confidence, 9), round(r.importance, 9), r.n) for r in Y.stored(df).collect())
    assert got == sorted((k["actor"], k["content"], round(k["conf"], 9), round(k["imp"], 9), k["n"]) for k in kept)

    # in parts: what is stored takes part, and what is met again is updated now
    half = Y.stored(df.where("seq < 70"), as_of=now())
    both = Y.stored(df.where("seq >= 70"), as_of=now(), existing=half)
    assert sorted((r.actor_id, r.content, round(r.confidence, 9), round(r.importance, 9), r.n) for r in both.collect()) == got

    live = [dict(actor=r[5], content=r[7], conf=r[8], imp=r[9], sources=list(r[10]), tags=list(r[12]), id=r[13], n=0) for r in rows]
    gone = set()
    for i, a in enumerate(live):
        for b in live[i + 1 :]:
            if a["actor"] == b["actor"] and _jaccard(a["content"], b["content"]) > 0.7:
                a["conf"], a["imp"], a["n"] = max(a["conf"], b["conf"]), max(a["imp"], b["imp"]), a["n"] + 1
                a["sources"] += b["sources"]
                a["tags"] = list(dict.fromkeys(a["tags"] + b["tags"]))
                gone.add(b["id"])
    then = NOW - dt.timedelta(days=3)
    out = Y.consolidated(df.withColumn("order", F.col("seq")).withColumn("last_updated", F.lit(then)), as_of=now()).collect()
    told = lambda r: (r.id, round(r.confidence, 9), round(r.importance, 9), r.extracted_from, r.tags, r.absorbed, r.last_updated.day)
    assert sorted(map(told, out)) == sorted((x["id"], round(x["conf"], 9), round(x["imp"], 9), x["sources"], x["tags"], x["n"], (NOW if x["n"] else then).day) for x in live if x["id"] not in gone)


def test_similar_pairs_are_all_pairs(spark):
    rng = random.Random(2)
    words = "one two three four five six seven eight nine ten".split()
    rows = [(f"i{i}", i, rng.choice("uv"), " ".join(rng.sample(words, rng.randint(0, 10)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, order int, actor_id string, content string")
    for threshold in (0.3, 0.7, 0.8):
        got = {(r.a, r.b) for r in Y.similar_pairs(df, ["actor_id"], threshold).collect()}
        sets = [set(t.split(" ")) for *_, t in rows]
        assert got == {(rows[i][0], rows[j][0]) for i in range(120) for j in range(i + 1, 120) if rows[i][2] == rows[j][2] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > threshold}


def test_rate_limit_against_a_model_and_as_a_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((rng.choice("ab"), NOW + dt.timedelta(seconds=rng.randint(0, 400)), i) for i in range(120))
    rows = [(k, t, i) for i, (k, t, _) in enumerate(sorted(rows, key=lambda r: (r[0], r[1])))]
    expected, state = {}, {}
    for k, t, i in rows:
        begin, n = state.get(k, (None, 0))
        if begin is None or (t - begin).total_seconds() >= 60:
            begin, n = t, 0
        state[k] = (begin, n + 1)
        expected[i] = n + 1 <= 3
    df = spark.createDataFrame(rows, "identity string, ts timestamp, seq long")
    assert {r.seq: r.allowed for r in T.rate_limited(df, 3).collect()} == expected
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = T.rate_limit_stream(stream, 3).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.seq: r.allowed for r in spark.table("limited").collect()} == expected
    told = lambda rows: {r.seq: r.retry_after for r in rows}
    assert told(spark.table("limited").collect()) == told(T.rate_limited(df, 3).collect())


def test_streams_equal_batches(spark, tmp_path):
    """Several micro-batches leave the memories of one ingest, whichever batch a text is repeated in."""
    obs = [observation(i, f"I prefer tea number {i % 5}", at=NOW - dt.timedelta(days=i % 3), confidence=i / 20, metadata={f"k{i % 4}": str(i)}) for i in range(20)]
    for n in range(4):
        frame(spark, obs[5 * n - (n > 0) : 5 * n + 5 - (n < 3)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "obs"))
        if n in (1, 3):
            engine = Engine(spark, Config(store="parquet", path=str(tmp_path / "store")), now)
            stream = spark.readStream.schema(M.OBSERVATIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "obs"))
            q = T.ingest_stream(stream, engine, checkpointLocation=str(tmp_path / "c2"))
            q.processAllAvailable()
            assert len(q.recentProgress) >= 2
            q.stop()
    whole = Engine(spark, now=now)
    whole.ingest(frame(spark, obs))
    columns = [c for c in whole.dump().columns if c not in ("source",)]
    told = lambda e: sorted(map(str, e.dump().select(*columns).collect()))
    assert told(engine) == told(whole) and engine.dump().count() == 5
    assert {r.id for r in engine.dump().collect()} == {r.id for r in I.ingest(frame(spark, obs), now()).collect()}


def test_memories_expire_in_a_stream(spark, tmp_path):
    day = lambda n: NOW + dt.timedelta(days=n)
    files = [[("a", day(0), 1), ("b", day(0), 0), ("c", day(0), 5)], [("a", day(0.5), 2)], [("d", day(3), None)], [("e", day(9), 1)]]
    schema = "id string, last_seen_at timestamp, ttl_days int"
    got = []
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = T.expiry_stream(T.files_stream(spark, str(tmp_path / "in"), schema, 1)).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.id, r.expired_at) for r in got) == [("a", day(2.5).replace(tzinfo=None)), ("c", day(5).replace(tzinfo=None))]


def test_times_of_json_lines(spark, tmp_path):
    line = '{"arrival_seq": %d, "tenant_id": "t", "app_id": "a", "actor_id": "u", "memory_type": "fact", "text": "some text", "source": {"source_type": "chat"}%s}'
    more = ["", ', "observed_at": "2024-01-20T10:00:00.5Z"', ', "observed_at": "2024-01-20 10:00"', ', "observed_at": "2024-13-40T10:00:00Z"', ', "observed_at": "2024-01-20T10:00:00+01:00"']
    (tmp_path / "o.json").write_text("\n".join([line % (i, x) for i, x in enumerate(more)] + ["no json"]))
    valid, wrong = M.validated(read_observations(spark, str(tmp_path / "o.json")))
    assert {r.arrival_seq: str(r.observed_at) for r in valid.collect()} == {0: "None", 1: "2024-01-20 10:00:00.500000"}
    assert {r.arrival_seq for r in wrong.collect()} == {2, 3, 4, None} and wrong.where("arrival_seq = 2").first().errors == ["observed_at: not a time in UTC"]


def test_several_memories_of_one_text_in_a_batch(spark):
    """The first of a batch is the stored one; what opens after its expiry is new."""
    e = Engine(spark, now=now)
    e.ingest(frame(spark, [observation(0, "same text", at=NOW, ttl=5)]))
    old = NOW - dt.timedelta(days=20)
    assert e.ingest(frame(spark, [observation(1, "same text", at=old, ttl=5), observation(2, "Same text", at=NOW, ttl=5)])) == {"created": 1, "updated": 1}
    assert [(r.ord, r.status) for r in e.dump().orderBy("ord").collect()] == [(0, "archived"), (2, "active")]


def test_what_was_read_survives_writes(spark, tmp_path):
    e = Engine(spark, Config(store="parquet", path=str(tmp_path / "s")), now)
    e.ingest(frame(spark, [observation(0, "My tea is green", at=NOW)]))
    q = spark.createDataFrame([("q", "green tea", "t", "a")], "query_id string, query string, tenant_id string, app_id string")
    hits, (m,) = e.search(q), e.dump().collect()
    e.feedback(spark.createDataFrame([(m.id, "positive")], "memory_id string, signal string"))
    assert hits.count() == 1 and e.dump().first().stats.positive == 1


def test_a_write_that_breaks_off_loses_nothing(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    m = I.ingest(frame(spark, [observation(0, "first text", at=NOW)]), now()).select(*[f.split(" ")[0] for f in store.read().columns])

    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    point = store.versions._point
    store.versions._point = lambda number, name: fail() if number else point(number, name)
    with pytest.raises(Broken):
        store.write(m)
    assert ParquetStore(spark, str(tmp_path / "s")).read().count() == 0
    store.versions._point = point
    store.write(m)
    store.versions._point = fail
    with pytest.raises(Broken):
        store.write(m.limit(0))
    again = ParquetStore(spark, str(tmp_path / "s"))
    assert again.read().count() == 1
    for _ in range(5):
        again.write(m)
    assert len(again.versions._pointers()) == 3 and again.read().count() == 1
    late = ParquetStore(spark, str(tmp_path / "s")).versions
    late._pointers = lambda: again.versions._pointers()[:-1]  # a writer that began before the last one ended
    with pytest.raises(RuntimeError):
        late.write(memories=m)
    for f in (tmp_path / "s" / "pointers").iterdir():
        f.unlink()
    with pytest.raises(RuntimeError):
        again.read()


QUERY = "query_id string, query string, tenant_id string, app_id string, actor_id string"


def test_two_layers_end_to_end(spark, tmp_path):
    e = open_engine(spark, Config(mode="dual_layer", store="parquet", path=str(tmp_path / "s")), now)
    said = ["an issue with my GPS", "the car is fine", "a problem with the gps again", "my phone is at home", "hello there"]
    assert e.ingest(frame(spark, [observation(i, t, at=NOW, thread_id="s") for i, t in enumerate(said[:3])])) == {"created": 3, "updated": 0}
    assert e.process() == 2  # GPS and car
    assert e.ingest(frame(spark, [observation(i, t, at=NOW, thread_id="s") for i, t in enumerate(said[3:], 3)])) == {"created": 2, "updated": 0}
    assert e.process(most=1) == 3 and e.process() == 3 and e.process() == 3
    actor = spark.createDataFrame([("t", "a", "u")], "tenant_id string, app_id string, actor_id string")
    mine = {r.text: r for r in e.list(actor).collect()}
    summary = "Session summary: 5 messages exchanged about automotive, technology, real estate"
    assert set(mine) == {"GPS system had functionality issues", "User has/mentioned car", summary}
    q = spark.createDataFrame([("q", "GPS issues", "t", "a", "u")], QUERY)
    hits = e.search(q).orderBy("rank").collect()
    assert hits[0].text == "GPS system had functionality issues" and hits[0].reasons == ["Long-term insight (confidence: 0.9)"]
    assert {r.memory_type for r in hits} == {"fact", "episode"}
    (c,) = e.context(q).collect()
    assert c.context_text.startswith("KNOWN ACTOR PROFILE:\nFacts:\n- ") and "RELEVANT MEMORIES:\n- [fact] GPS system" in c.context_text
    ids = spark.createDataFrame([(mine[summary].id,), (hits[-1].id,), ("none",)], "id string")
    assert {r.memory_type for r in e.get(ids).collect()} == {"summary", "episode"}
    assert e.feedback(spark.createDataFrame([(mine[summary].id, "positive")], "memory_id string, signal string")) == 0
    assert e.compact() == {"archived_expired": 0, "archived_superseded": 0}
    later = open_engine(spark, e.config, lambda: F.lit("2024-04-01 00:00:00").cast("timestamp"))
    assert later.compact()["archived_expired"] == 5 and later.health() == {"ok": True, "provider": "dual_layer", "detail": "records=3"}
    with pytest.raises(ValueError):
        open_engine(spark, Config(mode="dual_layer", store="json", path="x"))


def test_requests_are_checked(spark):
    e = Engine(spark, now=now)
    for rows, schema in (([("q", "", "t", "a", "u")], QUERY), ([("q", "x", "t", "a", "u", 101)], QUERY + ", limit int"), ([("q", "x", "t", "a", "u", 1.5)], QUERY + ", min_score double")):
        with pytest.raises(Exception, match="must not be empty|from"):
            e.search(spark.createDataFrame(rows, schema)).collect()
    with pytest.raises(Exception, match="from 1 to 30"):
        e.context(spark.createDataFrame([("q", "x", "t", "a", "u", 31)], QUERY + ", max_items int")).collect()
    with pytest.raises(Exception, match="one of"):
        e.feedback(spark.createDataFrame([("m", "good")], "memory_id string, signal string"))


def test_assistants_store_read_reply_and_store(spark):
    messages = "seq long, actor_id string, thread_id string, role string, text string"
    e = Engine(spark, now=now)
    first = spark.createDataFrame([(1, "ann", "s1", "customer", "I prefer green tea"), (2, "bob", "s2", "customer", "There is a problem with my phone")], messages)
    got = {r.actor_id: r for r in A.support_turn(e, first).collect()}
    assert got["ann"].reply == "Based on your preferences (Customer prefers: green tea), I'd recommend... How does that sound?" and got["ann"].found_memories == 2
    stored = e.dump().collect()
    assert {r.text for r in stored} >= {"I prefer green tea", "Customer prefers: green tea", "There is a problem with my phone"}
    assert not any(r.memory_type == "system" for r in stored)  # replies are turned away
    assert next(r for r in stored if r.text == "I prefer green tea").metadata == {"role": '"customer"', "category": '"chat"', "channel": '"web-chat"'}
    again = A.support_turn(e, spark.createDataFrame([(3, "bob", "s3", "customer", "hello, the phone again")], messages)).first()
    assert again.reply.startswith("Hello! I see you've contacted us before about some issues.") and "there is a problem with my phone" in again.reply
    p = Engine(spark, now=now)
    A.assistant_turn(p, spark.createDataFrame([(1, "eve", "s", "user", "My name is Sarah")], messages), F.lit(9))
    said = A.assistant_turn(p, spark.createDataFrame([(2, "eve", "s", "user", "what is my name")], messages), F.lit(9)).first()
    # the question was stored first, and is the best hit for itself
    assert said.reply == "Based on what you've told me: what is my name" and said.found_memories == 3


def test_the_second_service(spark):
    e = TunedEngine(Engine(spark, now=now), supersede_above=0.25)
    first = observation(0, "My  GPS works well", at=NOW, confidence=0.5, importance=0.4, metadata={"role": '"user"'})
    assert e.ingest(frame(spark, [first])) == {"created": 1, "updated": 0}
    (m,) = e.engine.dump().collect()
    assert m.text == "My GPS works well" and m.importance == pytest.approx(0.4 + 0.15 + 0.1) and m.metadata == {"role": '"user"', "textLength": "18", "wordCount": "4", "hasQuestions": "false"}
    e.ingest(frame(spark, [observation(1, "The GPS is broken?", at=NOW), observation(2, "the gps issue again", at=NOW)]))
    assert e.engine.dump().where("ord = 0").first().confidence == pytest.approx(0.1) and e.found.count() == 2
    q = spark.createDataFrame([("q", "gps", "t", "a", "u"), ("r", "gps", "t", "a", "nobody")], QUERY)
    c = {r.query_id: r for r in e.context(q).collect()}
    assert c["q"].total_memories == 3 and "FACT MEMORIES:" in c["q"].context_text and c["q"].profile_summary.startswith("Facts:")
    assert c["r"].profile_summary == "No profile available" and c["r"].context_text == ""
    assert e.resolve() == 2 and e.engine.dump().where("ord = 0").first().status == "superseded"  # resolved ones stay a day
    e.engine.now = lambda: F.lit("2024-02-03 00:00:00").cast("timestamp")
    assert e.resolve() == 0
    e.forget(days=1, least_importance=2.0)
    assert e.engine.dump().where("status = 'active'").count() == 0
    with pytest.raises(Exception, match="invalid"):
        e.ingest(frame(spark, [observation(9, "abc", at=NOW)]))
    found = e.metrics()
    assert found["requests"] == 4 and found["error_rate"] == pytest.approx(0.1) and found["records"] == 3


def test_two_identical_preferences(spark):
    e = Engine(spark, now=now)
    rows = [observation(i, "Prefers concise outreach messages", at=NOW, memory_type="preference") for i in range(2)]
    assert e.ingest(frame(spark, rows)) == {"created": 1, "updated": 1}
    q = spark.createDataFrame([("q", "outreach style", "t", "a", "u")], "query_id string, query string, tenant_id string, app_id string, actor_id string")
    (c,) = e.context(q).collect()
    assert c.total_memories >= 1 and c.context_text.startswith("KNOWN ACTOR PROFILE:") and "RELEVANT MEMORIES:" in c.context_text
    assert e.ingest(frame(spark, rows[:1])) == {"created": 0, "updated": 1}
    (m,) = e.dump().collect()
    assert e.feedback(spark.createDataFrame([(m.id, "positive"), ("none", "negative")], "memory_id string, signal string")) == 1
    assert e.dump().first().stats.positive == 1
    assert e.health()["detail"] == "records=1"
    assert e.profile(q).first()["count"] == 1


def test_expiry(spark):
    e = Engine(spark, now=now)
    e.ingest(frame(spark, [observation(0, "an old fact", at=dt.datetime(2020, 1, 1), ttl=1)]))
    assert e.compact()["archived_expired"] == 1 and e.compact()["archived_expired"] == 0


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_persistence(spark, tmp_path, kind):
    config = Config(store=kind, path=str(tmp_path / "store"))
    rows = [observation(0, "Ship the release by May", at=NOW, memory_type="goal", metadata={"a": "1"})]
    Engine(spark, config, now).ingest(frame(spark, rows))
    again = Engine(spark, config, now)
    (p,) = again.profile(spark.createDataFrame([("t", "a", "u")], "tenant_id string, app_id string, actor_id string")).collect()
    assert p["count"] == 1 and p.summary == "Goals:\n- Ship the release by May"
    assert again.dump().first().metadata == {"a": "1"}


def test_json_store_wants_an_array(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"version": 1, "records": 5}')
    with pytest.raises(ValueError):
        JsonStore(spark, str(tmp_path / "s.json")).read()


def test_validation(spark):
    good, bad = observation(0, "long enough", at=NOW), observation(1, "abc", at=NOW, memory_type="system", scope="galaxy", confidence=2.0, decay=("time", 0))
    valid, quarantine = M.validated(frame(spark, [good, bad]))
    assert valid.count() == 1 and len(quarantine.first().errors) == 5
    with pytest.raises(Exception, match="invalid observation"):
        M.validated(frame(spark, [bad]), strict=True)[0].collect()
    for wrong in (lambda: M.check_search("", "t", "a"), lambda: M.check_search("q", "t", "a", 101), lambda: M.check_budget(31), lambda: M.check_signal("good"), lambda: Config(store="json"), lambda: Config.from_env({"RATE_LIMIT_PER_MIN": "5"})):
        with pytest.raises(ValueError):
            wrong()
    assert Config.from_env({"ENGINE_MODE": "other", "API_KEYS": "a, b"}).mode == "lexical" and M.first_value(["a", "b"]) == "a"


def test_contradictions_by_default_supersede_nothing(spark):
    m = I.ingest(frame(spark, [observation(0, "My GPS works well", at=NOW, confidence=0.2)]), now())
    new = frame(spark, [observation(1, "My GPS is not working well", at=NOW), observation(2, "The GPS issue again", at=NOW)])
    found = L.contradictions(new, m)
    assert found.count() == 2
    assert L.penalized(m, L.contradiction_counts(new, m)).first().confidence == pytest.approx(0.1)
    assert L.resolved(m, found).first().status == "active"


def test_search_filters_and_limits(spark):
    m = I.ingest(frame(spark, [observation(i, f"note number {i} about tea", at=NOW, thread_id=f"t{i % 2}") for i in range(120)]), now())
    q = spark.createDataFrame([("a", "tea", "t", "a", "", "", [], 1000), ("b", "tea", "t", "a", None, "t1", None, 0), ("c", "tea", "nobody", "a", None, None, None, 5)], "query_id string, query string, tenant_id string, app_id string, actor_id string, thread_id string, memory_types array<string>, limit int")
    n = {r.query_id: r.n for r in S.lexical_hits(q, m, now()).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 100, "b": 1}


def test_another_embedding(spark):
    class Lengths:
        def embed(self, text):
            return F.length(text)

        def similarity(self, a, b):
            return F.when(a == b, 1.0).otherwise(0.0)

    m = I.ingest(frame(spark, [observation(0, "abcde", at=NOW), observation(1, "abcdefgh", at=NOW)]), now())
    q = spark.createDataFrame([("a", "zzzzz", "t", "a")], "query_id string, query string, tenant_id string, app_id string")
    assert [r.ord for r in S.enhanced_hits(q, m, now(), Lengths()).orderBy("rank").collect()] == [0, 1]


def test_insights_are_drawn_from_a_stream(spark, tmp_path):
    rows = [(i, f"e{i}", "t", "a", "u", "s", NOW, "user", "an issue with my GPS") for i in range(6)]
    e = spark.createDataFrame(rows, "seq long, event_id string, tenant_id string, app_id string, actor_id string, session_id string, ts timestamp, role string, content string")
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    found = []
    q = T.extract_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), lambda df, n: found.extend(df.collect()), every="0 seconds", checkpointLocation=str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r.content for r in found) == sorted(r.content for r in Y.drawn(e).collect()) and len(found) == 7


@pytest.mark.parametrize("mode", ["lexical", "enhanced", "dual_layer"])
def test_the_second_service_over_every_engine(spark, mode):
    e = TunedEngine(open_engine(spark, Config(mode=mode), now), supersede_above=0.25)
    said = ["My GPS works well", "The GPS is broken, an issue", "I prefer green tea"]
    assert e.ingest(frame(spark, [observation(0, said[0], at=NOW, confidence=0.9, importance=0.1)])) == {"created": 1, "updated": 0}
    if mode == "dual_layer":
        e.engine.process()
    assert e.ingest(frame(spark, [observation(i, t, at=NOW) for i, t in enumerate(said[1:], 1)])) == {"created": 2, "updated": 0}
    if mode == "dual_layer":
        assert e.engine.process() == 1
    q = spark.createDataFrame([("q", "gps issue", "t", "a", "u", 50)], QUERY + ", max_items int")
    with pytest.raises(Exception, match="from 1 to 30"):
        e.engine.context(q).collect()
    (c,) = e.context(q).collect()  # asks for 150 hits
    assert c.total_memories >= 2 and "GPS" in c.context_text
    before = e.engine.dump().count()
    on_record = e.resolve()
    e.engine.now = lambda: F.lit("2024-06-01 00:00:00").cast("timestamp")
    e.forget(days=1, least_importance=2.0)
    assert e.engine.dump().count() == before
    if mode == "dual_layer":  # its update has no effect
        assert on_record == 0 and e.engine.dump().where("status != 'active'").count() == 0
    else:
        assert on_record == 1 and {r.status for r in e.engine.dump().collect()} == {"superseded", "archived"}
    assert e.metrics()["records"] == before
    with pytest.raises(ValueError, match="at least one"):
        e.ingest(frame(spark, []))


def test_periodic_jobs(spark, tmp_path):
    ran, ticks = [], iter(range(0, 10**6, 50_000))
    e = TunedEngine(Engine(spark, now=now), clock=lambda: next(ticks))
    e.resolve, e.forget = lambda: ran.append("resolve"), lambda: ran.append("forget")
    q = e.jobs(every="0 seconds", checkpointLocation=str(tmp_path / "c"))
    q.processAllAvailable()
    for _ in range(50):
        if "forget" in ran:
            break
        time.sleep(0.5)
    q.stop()
    assert ran.count("resolve") >= 2 and "forget" in ran


def test_whole_memories_take_the_place_of_stored_ones(spark):
    e = Engine(spark, now=now)
    e.ingest(frame(spark, [observation(i, f"memory number {i}", at=NOW) for i in range(3)]))
    old = e.dump().where("ord < 2")
    new = old.withColumn("text", F.lit("changed")).withColumn("id", F.when(F.col("ord") == 1, "another").otherwise(F.col("id")))
    e.change(new)
    assert sorted(r.text for r in e.dump().collect()) == ["changed", "changed", "memory number 1", "memory number 2"]


def test_an_empty_request_fails_and_rejected_rows_are_told(spark):
    for mode in ("lexical", "dual_layer"):
        e = open_engine(spark, Config(mode=mode), now)
        with pytest.raises(ValueError, match="at least one"):
            e.ingest(frame(spark, []))
        rows = frame(spark, [observation(0, "good words"), observation(1, "abc"), observation(2, "good words again", scope="?")])
        assert e.ingest(rows, strict=False) == {"created": 1, "updated": 0, "rejected": 2}
        assert {r.arrival_seq: r.errors for r in e.rejected(rows).collect()} == {1: ["text: at least 4 characters"], 2: ["scope: not in the domain"]}
        assert e.ingest(frame(spark, []), strict=False) == {"created": 0, "updated": 0, "rejected": 0}


@pytest.mark.parametrize(("mode", "kind"), [("lexical", "parquet"), ("enhanced", "json"), ("dual_layer", "parquet")])
def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path, mode, kind):
    config = Config(mode=mode, store=kind, path=str(tmp_path / "s"))
    parts = [frame(spark, [observation(i, f"words of {i % 2}", at=NOW) for i in range(k, k + 3)]) for k in (0, 3)]
    e = open_engine(spark, config, now)
    for n, rows in enumerate(parts):
        e.ingest(rows, strict=False, batch=("s", n))
    told = sorted(map(str, e.dump().collect()))
    again = open_engine(spark, config, now)  # after a crash
    for n, rows in enumerate(parts):
        assert again.ingest(rows, strict=False, batch=("s", n)) == {"created": 0, "updated": 0}
    assert sorted(map(str, again.dump().collect())) == told
    assert again.ingest(parts[0], strict=False, batch=("another", 0)) != {"created": 0, "updated": 0}
    assert again._marks() == {"s": 1, "another": 0}
    again.feedback(spark.createDataFrame([("none", "positive")], "memory_id string, signal string"))
    again.compact()
    assert again._marks() == {"s": 1, "another": 0}  # other writes keep them


def test_invalid_lines_of_a_stream_are_quarantined(spark, tmp_path):
    """Each line is stored or in quarantine, with what is wrong with it; a batch run again adds to neither."""
    good = '{{"arrival_seq": {i}, "tenant_id": "t", "app_id": "a", "actor_id": "u", "memory_type": "fact", "text": "words of {i}", "source": {{"source_type": "chat"}}, "observed_at": "2024-01-31T00:00:00Z"}}'
    lines = [[good.format(i=0), '{"arrival_seq": 1, "text"', good.format(i=2).replace("words of 2", "abc")], ["no json", good.format(i=4), good.format(i=5).replace("2024-01-31T", "2024-01-31 ")]]
    (tmp_path / "in").mkdir()

    def run():
        engine = Engine(spark, Config(store="parquet", path=str(tmp_path / "store")), now)
        q = T.ingest_stream(observations_stream(spark, str(tmp_path / "in"), 1), engine, quarantine=str(tmp_path / "bad"), checkpointLocation=str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
        return engine

    for n, some in enumerate(lines):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(some))
        engine = run()
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert engine.dump().count() + len(bad) == 6 and {r.ord for r in engine.dump().collect()} == {0, 4}
    assert sorted(r.errors[0] for r in bad) == ["not an observation in JSON"] * 2 + ["observed_at: not a time in UTC", "text: at least 4 characters"]
    assert {r.broken for r in bad} >= {"no json", lines[0][1]}
    commits = tmp_path / "c" / "commits"
    for name in ("1", ".1.crc"):  # as if the last batch had broken off before its commit
        (commits / name).unlink(missing_ok=True)
    again = run()
    assert sorted(map(str, again.dump().collect())) == sorted(map(str, engine.dump().collect())) and spark.read.parquet(str(tmp_path / "bad")).count() == len(bad)


def test_searches_in_two_layers_have_no_largest_limit(spark):
    e = open_engine(spark, Config(mode="dual_layer"), now)
    e.ingest(frame(spark, [observation(i, f"words in common and {i}", at=NOW) for i in range(160)]))
    q = spark.createDataFrame([("q", "words in common", "t", "a", "u", 150), ("r", "words in common", "t", "a", "u", 0)], QUERY + ", limit int")
    events, insights = e.layers.read()
    found = Y.search(q, insights, events, now())
    assert {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()} == {"q": 150, "r": 20}


def test_sessions_of_a_stream_have_topics_and_end(spark, tmp_path):
    """After every micro-batch counts and topics are those of all events so far; a month later the state goes."""
    schema = "seq long, event_id string, tenant_id string, app_id string, actor_id string, session_id string, ts timestamp, content string"
    rng = random.Random(3)
    said = ["my phone is new", "the CAR is red", "a house by the sea", "nothing much", "Devices and cars", None]
    at = [NOW + dt.timedelta(minutes=rng.randint(0, 50)) for _ in range(40)]
    rows = [(i, f"e{i}", "t", "a", rng.choice("uv"), rng.choice(["s1", "s2"]), at[i], rng.choice(said)) for i in range(40)]
    parts = [rows[:15], rows[15:], [(90, "e90", "t", "a", "w", "s", NOW + dt.timedelta(days=40), "hi")], [(91, "e91", "t", "a", "w", "s", NOW + dt.timedelta(days=40, hours=2), "hi")]]
    got = []
    (tmp_path / "in").mkdir()
    stream = T.sessions_stream(T.files_stream(spark, str(tmp_path / "in"), schema, 1))
    sink = lambda df, n: got.extend((n, r) for r in df.collect())
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    q = T.with_rocksdb(spark, lambda: stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).start())
    assert spark.conf.get(name, None) == before
    for n, some in enumerate(parts):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        if n < 2:
            live = {(r.actor_id, r.session_id): (r.n, r.last_ts, r.topics) for _, r in got if not r.dropped}
            want = {(r.actor_id, r.session_id): (r.n, r.last_ts, r.topics) for r in T.sessions(spark.createDataFrame(sum(parts[: n + 1], []), schema)).collect()}
            assert live == want
    q.stop()
    summaries = Y.session_summaries(spark.createDataFrame(rows, schema)).collect()
    last = {(r.actor_id, r.n, r.topics) for _, r in got if not r.dropped}
    assert summaries and all((r.actor_id, len(r.extracted_from), r.content.partition(" exchanged about ")[2]) in last for r in summaries)
    ended = {(r.actor_id, r.session_id): r.n for _, r in got if r.dropped}
    assert ended == {k: v[0] for k, v in live.items()}


def test_what_search_reads_off_texts_is_stored_with_them(spark, tmp_path, monkeypatch):
    config = Config(mode="enhanced", store="parquet", path=str(tmp_path / "s"))
    said = ["My GPS had an issue first", "I met Sarah on 2024-01-05", "the dell laptop is fine"]
    q = spark.createDataFrame([("q", "what was the first issue with my GPS", "t", "a", "u"), ("r", "when did I meet Sarah", "t", "a", "u")], QUERY)
    hits = lambda e: sorted(map(str, e.search(q).collect()))
    e = Engine(spark, config, now)
    e.ingest(frame(spark, [observation(i, t, at=NOW) for i, t in enumerate(said[:2])]))
    derived, calls = I.enriched, []
    monkeypatch.setattr(e.store, "derive", lambda m: calls.append(sorted(r.text for r in m.collect())) or derived(m))
    e.ingest(frame(spark, [observation(2, said[2], at=NOW), observation(3, said[0], at=NOW)]))  # one new, one that merges
    assert calls == [[said[2]]]
    e.feedback(e.dump().limit(1).select(F.col("id").alias("memory_id"), F.lit("positive").alias("signal")))
    e.compact()
    assert len(calls) == 1
    plan = e.search(q)._jdf.queryExecution().executedPlan().toString()
    assert "query#" in plan and not re.search(r"(?i)(regexp|rlike|split)[^\n]*\btext#", plan)
    assert re.search(r"ReadSchema: [^\n]*(tokens|id:)", plan)
    other = S.enhanced_hits(q, e.dump(), now())  # made anew
    assert hits(e) == sorted(map(str, other.collect())) and len(hits(e)) > 1
    assert e.dump().columns == e.memories().columns == Engine(spark, now=now).dump().columns
    changed = e.dump().where("ord = 2").withColumn("text", F.lit("Sarah again, on 2024-01-09"))
    e.change(changed)
    assert hits(e) == sorted(map(str, S.enhanced_hits(q, e.dump(), now()).collect()))
    # a store that a lexical engine wrote has them made as it is read, and stored by the next write
    plain = Config(mode="lexical", store="parquet", path=config.path)
    Engine(spark, plain, now).ingest(frame(spark, [observation(9, "words about Sarah", at=NOW)]))
    again = Engine(spark, config, now)
    assert hits(again) == sorted(map(str, S.enhanced_hits(q, again.dump(), now()).collect()))
    again.ingest(frame(spark, [observation(10, "words about nobody", at=NOW)]))
    assert "entities" in spark.read.parquet(again.store.versions.current()).columns


@pytest.mark.parametrize("mode", ["lexical", "enhanced"])
def test_files_of_untouched_buckets_stay(spark, tmp_path, mode):
    """An ingest, a signal, a change and a compaction leave the files of all buckets but their own, and what one store would."""
    config = Config(mode=mode, store="parquet", path=str(tmp_path / "s"))
    e, whole = Engine(spark, config, now), Engine(spark, Config(mode=mode), now)
    first = [observation(i, f"memory number {i}", at=NOW, ttl=5) for i in range(60)]
    for x in (e, whole):
        x.ingest(frame(spark, first))
    told = lambda x: sorted(map(str, x.dump().collect()))
    files = lambda: {p for path, _ in e.store.versions.buckets().values() for p in Path(path).rglob("*.parquet")}
    before = files()
    more = [observation(60, "memory number 7", at=NOW, confidence=0.9), observation(61, "another", at=NOW)]
    assert e.ingest(frame(spark, more)) == {"created": 1, "updated": 1}
    after = files()
    assert len(before) > 20 and len(before - after) <= 2 and len(after - before) <= 2
    whole.ingest(frame(spark, more))
    assert told(e) == told(whole) and e.dump().where("ord = 61").count() == 1
    some = e.dump().where("ord = 3").select(F.col("id").alias("memory_id"), F.lit("positive").alias("signal"))
    for x in (e, whole):
        assert x.feedback(some) == 1
        x.change(x.dump().where("ord = 5").withColumn("text", F.lit("in another bucket")))
    assert len(after - files()) <= 3 and told(e) == told(whole)
    assert e.feedback(some.withColumn("memory_id", F.lit("none"))) == 0
    for _ in range(4):  # versions beyond the last three go, buckets that are still named stay
        e.ingest(frame(spark, [observation(99, "another", at=NOW)]))
    names = e.store.versions
    assert len(names._pointers()) == 3 and e.dump().count() == 61 and all(p.exists() for p in files())
    named = {Path(path).parent.name for p in names._pointers() for path in [f"{f}/x" for _, (f, _) in names._said(p)[2].items()]}
    assert set(names._data()) == named
    e.now = lambda: F.lit("2024-02-20 00:00:00").cast("timestamp")
    assert e.compact()["archived_expired"] >= 50 and e.compact()["archived_expired"] == 0
