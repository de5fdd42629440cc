"""Two layers: an event log, and insights drawn from it.

An events table has seq, event_id, tenant_id, app_id, actor_id, session_id, ts, role, content; an insights table seq,
id, tenant_id, app_id, actor_id, type, content, confidence, importance, extracted_from, last_updated, tags. Insights of
one tenant, application and actor are compared; isolation="actor" compares across tenants and applications.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X
from sparkrecall.operators import similar as S
from sparkrecall.operators.leaders import leaders
from sparkrecall.sources.store import settled

# Devices looked for, and what insights say.
DEVICES = ["samsung", "galaxy", "s22", "dell", "xps", "bike", "car"]
ISOLATION = {"tenant": ["tenant_id", "app_id", "actor_id"], "actor": ["actor_id"]}


def events_of(memories: DataFrame, ts: Column) -> DataFrame:
    """Memories as events that happen at `ts`: the session is the thread, or else `default`; the role `user` unless
    given."""
    role = F.coalesce("role", F.lit("user")) if "role" in memories.columns else F.lit("user")
    return memories.select(F.col("ord").alias("seq"), F.col("id").alias("event_id"), "tenant_id", "app_id", "actor_id", F.coalesce(F.when(F.col("thread_id") != "", F.col("thread_id")), F.lit("default")).alias("session_id"), ts.alias("ts"), F.lit("conversational").alias("type"), role.alias("role"), F.col("text").alias("content"))


def _insight(test: Column, kind: str, content: Column, confidence: float, importance: float, tags: list[str]) -> Column:
    return F.when(test, F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit(confidence).alias("confidence"), F.lit(importance).alias("importance"), F.array(*map(F.lit, tags)).alias("tags")))


def _drawn(events: DataFrame, found: Column) -> DataFrame:
    rows = events.select("seq", "event_id", "tenant_id", "app_id", "actor_id", "ts", F.posexplode(F.array_compact(found)).alias("pos", "i"))
    return rows.select("seq", "pos", "tenant_id", "app_id", "actor_id", "i.*", F.array("event_id").alias("extracted_from"), F.col("ts").alias("last_updated"))


def semantic_facts(events: DataFrame) -> DataFrame:
    low = F.lower("content")
    gps = _insight(X.contains_any(low, "issue", "problem") & F.contains(low, F.lit("gps")), "fact", F.lit("GPS system had functionality issues"), 0.9, 0.9, ["device", "problem", "gps"])
    devices = [_insight(F.contains(low, F.lit(d)), "fact", F.lit(f"User has/mentioned {d}"), 0.8, 0.7, ["device", d]) for d in DEVICES]
    return _drawn(events, F.array(gps, *devices))


def preferences(events: DataFrame) -> DataFrame:
    return _drawn(events, F.array(_insight(X.contains_any(F.lower("content"), "prefer", "like", "favorite"), "preference", F.col("content"), 0.7, 0.6, ["preference"])))


def session_summaries(events: DataFrame, isolation: str = "tenant", least: int = 5) -> DataFrame:
    """One insight for each session of `least` events or more: all its events would say the same."""
    keys = [*ISOLATION[isolation], "session_id"]
    low = F.lower("content")
    order = F.struct("ts", "seq")
    first = [F.min(F.when(X.contains_any(low, *parts), order)).alias(f"t{i}") for i, parts in enumerate(P.TOPICS.values())]
    per = events.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "event_id"))), lambda e: e["event_id"]).alias("extracted_from"), F.max("seq").alias("seq"), F.max("ts").alias("last_updated"), *first, *(F.first(k).alias(k) for k in ("tenant_id", "app_id", "actor_id") if k not in keys))
    # topics in the order of the events that first name them, then of the list
    named = F.array_compact(F.array(*(F.when(F.col(f"t{i}").isNotNull(), F.struct(F.col(f"t{i}.ts").alias("ts"), F.col(f"t{i}.seq").alias("s"), F.lit(i).alias("i"), F.lit(t).alias("t"))) for i, t in enumerate(P.TOPICS))))
    topics = P.topics_joined(F.transform(F.array_sort(named), lambda x: x["t"]))
    content = F.concat(F.lit("Session summary: "), F.col("n").cast("string"), F.lit(" messages exchanged about "), topics)
    return per.where(F.col("n") >= least).select("seq", F.lit(0).alias("pos"), "tenant_id", "app_id", "actor_id", F.lit("summary").alias("type"), content.alias("content"), F.lit(0.6).alias("confidence"), F.lit(0.5).alias("importance"), F.array(F.lit("summary"), F.lit("session")).alias("tags"), "extracted_from", "last_updated")


@dataclass(frozen=True)
class Strategy:
    """A way to draw insights from events; those below the threshold are dropped."""

    name: str
    draw: Callable[[DataFrame], DataFrame]
    threshold: float
    enabled: bool = True


#: As the model has them: no preference reaches its threshold.
STRATEGIES = (Strategy("semantic", semantic_facts, 0.7), Strategy("preference", preferences, 0.8), Strategy("summary", session_summaries, 0.6))


def drawn(events: DataFrame, strategies: tuple[Strategy, ...] = STRATEGIES, whole: DataFrame | None = None) -> DataFrame:
    """Insights of every enabled strategy, with an id, in the order of the events and of the strategies. `whole`: all
    events of the sessions that `events` are part of, which summaries are made of."""
    out = None
    for n, s in enumerate(s for s in strategies if s.enabled):
        rows = s.draw(whole if whole is not None and s.draw is session_summaries else events).where(F.col("confidence") >= s.threshold).withColumn("strategy", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("tenant_id", "app_id", "actor_id", "seq", "strategy", "pos")))
    return out.withColumn("id", F.concat(F.lit("insight_"), F.substring(F.sha2(key, 256), 1, 16)))


def similar_pairs(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(k, a, b, oa, ob) of rows (id, order, content) of equal keys whose words overlap more than the threshold: the keys, ids
    and orders, a before b."""
    held = S.by_words(rows, keys)
    one = held.select("k", "c", F.col("id").alias("a"), F.col("order").alias("oa"))
    two = held.select(F.col("c").alias("d"), F.col("id").alias("b"), F.col("order").alias("ob"))
    return one.join(S.near(held, threshold), "c").join(two, "d").where("oa < ob").select("k", "a", "b", "oa", "ob")


def stored(insights: DataFrame, isolation: str = "tenant", threshold: float = 0.8, as_of: Column | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Insights merged into the first similar one stored before them: (actor keys, type, content, confidence,
    importance, tags, extracted_from, n, last_updated, order, id).

    Similar means a word overlap above the threshold with what is stored, in order. Equal contents always meet the same
    one, so they are merged first; of equal ones the first is stored, which keeps its importance and tags. Which of the
    others stay is settled in rounds over the table of pairs (leaders()); no words are compared in these. What was merged
    into is updated at `as_of` (without it, at the latest of its events). `existing` insights, stored before, stay as they
    are or are merged into; their order must be before that of the new.
    """
    keys = [*ISOLATION[isolation], "type"]
    rest = [k for k in ("tenant_id", "app_id", "actor_id") if k not in keys]
    new = insights.withColumn("order", F.struct("seq", "strategy", "pos")).withColumn("was", F.lit(False)).withColumn("k", F.lit(1).cast("long"))
    columns = [*keys, *rest, "id", "order", "was", "content", "confidence", "importance", "tags", "extracted_from", "k", "last_updated"]
    rows = new.select(*columns)
    if existing is not None:
        rows = existing.withColumn("was", F.lit(True)).withColumn("k", F.col("n").cast("long")).select(*columns).unionByName(rows)
    # stored ones of equal contents, which can be of several actors' past, stay apart
    of = F.when(F.col("was"), F.col("id"))
    same = rows.groupBy(*keys, F.lower("content").alias("low"), of.alias("of")).agg(
        F.min("order").alias("order"), F.max("was").alias("was"), *(F.min_by(x, "order").alias(x) for x in ("id", "content", "importance", "tags", *rest)), F.max("confidence").alias("confidence"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", "extracted_from"))), lambda x: x["extracted_from"])).alias("extracted_from"), F.sum("k").alias("n"), F.max("last_updated").alias("last_updated"),
    ).drop("low", "of")
    pairs = similar_pairs(same, keys, threshold)
    if existing is not None:  # what was stored stays
        pairs = pairs.join(same.where("was").select(F.col("id").alias("b")), "b", "left_anti")
    into = leaders(pairs)
    named = same.join(into, "id", "left").withColumn("into", F.coalesce("into", "id"))
    own = F.col("id") == F.col("into")
    kept = lambda x: F.max(F.when(own, F.struct(x)))[x].alias(x)
    merged = named.groupBy(F.col("into").alias("id")).agg(
        *(kept(x) for x in (*keys, *rest, "content", "importance", "tags", "order", "was")), F.max("confidence").alias("confidence"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", "extracted_from"))), lambda x: x["extracted_from"])).alias("extracted_from"),
        F.sum("n").alias("n"), F.max("last_updated").alias("last_updated"), F.count_if(~F.col("was")).alias("__new"),
    )
    # an insight stored before is updated if anything met it, a new one if more than itself did
    if as_of is not None:
        touched = F.when(F.col("was"), F.col("__new") > 0).otherwise(F.col("n") > 1)
        merged = merged.withColumn("last_updated", F.when(touched, as_of).otherwise(F.col("last_updated")))
    return merged.select(*keys, *rest, "id", "content", "confidence", "importance", "tags", "extracted_from", "n", "last_updated", "order")


def consolidated(insights: DataFrame, isolation: str = "tenant", threshold: float = 0.7, as_of: Column | None = None) -> DataFrame:
    """Greedy pairwise merging as a join: an insight stays unless an earlier one of its actor and type is similar, and
    what stays takes the maximum confidence and importance, the sources and the tags of all later similar ones, and is
    updated at `as_of`, if given."""
    merged = ["confidence", "importance", "extracted_from", "tags"]
    held = S.by_words(insights, [*ISOLATION[isolation], "type"], *merged)
    near = S.near(held, threshold)
    # equal words are compared once; of each such group only the first is asked for
    first = held.groupBy(F.col("c").alias("d")).agg(F.min("order").alias("first"))
    first = near.join(first, "d").groupBy("c").agg(F.min("first").alias("first"))
    gone = settled(held.join(first, "c").where("first < order").select("id").distinct())
    stay = insights.join(gone, "id", "left_anti")
    into = held.join(gone, "id", "left_anti").select(F.col("id").alias("into"), F.col("order").alias("own"), "c").join(near, "c")
    more = into.join(held.select(F.col("c").alias("d"), "order", *merged), "d").where("own < order").groupBy(F.col("into").alias("id")).agg(
        F.max("confidence").alias("__c"), F.max("importance").alias("__i"),
        F.transform(F.array_sort(F.collect_list(F.struct("order", "extracted_from"))), lambda x: x["extracted_from"]).alias("__f"),
        F.transform(F.array_sort(F.collect_list(F.struct("order", "tags"))), lambda x: x["tags"]).alias("__t"), F.count("*").alias("__n"),
    )
    out = stay.join(more, "id", "left")
    none = F.array().cast("array<string>")
    if as_of is not None:
        out = out.withColumn("last_updated", F.when(F.col("__n") > 0, as_of).otherwise(F.col("last_updated")))
    return (
        out.withColumn("confidence", F.greatest("confidence", "__c")).withColumn("importance", F.greatest("importance", "__i"))
        .withColumn("extracted_from", F.concat("extracted_from", F.coalesce(F.flatten("__f"), none)))
        .withColumn("tags", F.array_distinct(F.concat("tags", F.coalesce(F.flatten("__t"), none))))
        .withColumn("absorbed", F.coalesce("__n", F.lit(0))).drop("__c", "__i", "__f", "__t", "__n")
    )


def compacted(events: DataFrame, insights: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Events of the last 30 days, insights of confidence 0.3 or more."""
    return events.where(~_old(as_of)), insights.where(F.col("confidence") >= 0.3)


def _old(as_of: Column) -> Column:
    return F.unix_millis(as_of) - F.unix_millis("ts") > 30 * X.DAY_MS


def compact(events: DataFrame, insights: DataFrame, as_of: Column) -> DataFrame:
    """One row (archived_expired, archived_superseded): what compacted() removes of both layers."""
    gone = events.agg(F.count_if(_old(as_of)).alias("e")).crossJoin(insights.agg(F.count_if(F.col("confidence") < 0.3).alias("i")))  # one row each
    return gone.select((F.col("e") + F.col("i")).alias("archived_expired"), F.lit(0).cast("long").alias("archived_superseded"))


def insight_memories(insights: DataFrame) -> DataFrame:
    c = F.col
    return insights.select("id", "tenant_id", "app_id", "actor_id", F.lit("long_term").alias("thread_id"), F.lit("actor").alias("scope"), c("type").alias("memory_type"), c("content").alias("text"), F.concat(c("type"), F.lit(": "), F.substring("content", 1, 100), F.lit("...")).alias("summary"), "confidence", "importance", F.lit("active").alias("status"), F.lit("none").alias("decay_kind"), F.lit(None).cast("int").alias("ttl_days"), c("last_updated").alias("last_seen_at"))


def event_memories(events: DataFrame) -> DataFrame:
    c = F.col
    return events.select(c("event_id").alias("id"), "tenant_id", "app_id", "actor_id", c("session_id").alias("thread_id"), F.lit("thread").alias("scope"), F.lit("episode").alias("memory_type"), c("content").alias("text"), F.concat(F.substring("content", 1, 100), F.lit("...")).alias("summary"), F.lit(0.8).alias("confidence"), F.lit(0.6).alias("importance"), F.lit("active").alias("status"), F.lit("time").alias("decay_kind"), F.lit(7).alias("ttl_days"), c("ts").alias("last_seen_at"))


def by_id(insights: DataFrame, events: DataFrame, ids: DataFrame) -> DataFrame:
    """Memories by id: of the insights, or else of the events."""
    both = insight_memories(insights).withColumn("layer", F.lit(0)).unionByName(event_memories(events).withColumn("layer", F.lit(1)))
    found = both.join(ids.select("id").distinct(), "id", "left_semi")
    return found.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("layer"))).where("n = 1").drop("n", "layer")


def by_actor(insights: DataFrame, actors: DataFrame) -> DataFrame:
    """Insights of actors as memories."""
    keys = ISOLATION["tenant"]
    return insight_memories(insights).join(actors.select(*keys).distinct(), keys, "left_semi")


def search(queries: DataFrame, insights: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """(query_id, rank, id, memory_type, text, summary, thread_id, score, reason): insights above the threshold; where they are fewer than the
    limit, of the newest events (twice what is missing) those above theirs, newest first, fill up; by score.

    Only tenant, application and actor filter. A limit or min_score of 0 is none: 20, and 0.1 or 0.05. Limits have no bound;
    the largest is read off the queries beforehand, so that Spark keeps that many rows of each query before the exchange.
    """
    from sparkrecall.operators.search import with_defaults

    c = F.col
    q = with_defaults(queries).select("query_id", "tenant_id", "app_id", "actor_id", X.raw_words(c("query")).alias("q_words"), F.when(c("limit") > 0, c("limit")).otherwise(20).alias("most"), F.when(c("min_score") > 0, c("min_score")).alias("least"))
    largest = q.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
    fits = lambda n: c(f"q.{n}").isNull() | (c(f"q.{n}") == "") | (c(f"q.{n}") == c(f"m.{n}"))
    test = (c("q.tenant_id") == c("m.tenant_id")) & fits("app_id") & fits("actor_id")

    i = q.alias("q").join(insights.alias("m"), test)
    score = X.jaccard(c("q_words"), X.raw_words(c("m.content"))) * c("m.confidence") * c("m.importance") * X.insight_decay(as_of, c("m.last_updated"))
    i = i.withColumn("score", score).where(c("score") > F.coalesce("q.least", F.lit(0.1)))
    reason = F.concat(F.lit("Long-term insight (confidence: "), c("m.confidence").cast("string"), F.lit(")"))
    i = i.select("q.query_id", "q.most", c("m.id"), c("m.type").alias("memory_type"), c("m.content").alias("text"), "score", reason.alias("reason"), F.lit("long_term").alias("thread_id"), F.concat(c("m.type"), F.lit(": "), F.substring("m.content", 1, 100), F.lit("...")).alias("summary"), F.lit(0).alias("layer"), c("m.order").alias("o"), F.lit(0).alias("place"))
    left = q.join(i.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("missing", c("most") - F.coalesce("n", F.lit(0)))

    e = left.where("missing > 0").alias("q").join(events.alias("m"), test)
    e = e.select("q.query_id", "q.most", "q.missing", "q.least", "q.q_words", c("m.event_id").alias("id"), c("m.content").alias("text"), c("m.session_id").alias("thread_id"), c("m.ts"), c("m.seq"))
    newest = W.partitionBy("query_id").orderBy(F.desc("ts"), "seq")
    e = e.withColumn("place", F.row_number().over(newest)).where(c("place") <= 2 * largest).where(c("place") <= c("missing") * 2)
    e = e.withColumn("score", X.jaccard(c("q_words"), X.raw_words(c("text")))).where(c("score") > F.coalesce("least", F.lit(0.05)))
    e = e.withColumn("kept", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).where("kept <= missing")
    e = e.select("query_id", "most", "id", F.lit("episode").alias("memory_type"), "text", (c("score") * 0.8).alias("score"), F.lit("Recent conversation context").alias("reason"), "thread_id", F.concat(F.substring("text", 1, 100), F.lit("...")).alias("summary"), F.lit(1).alias("layer"), F.lit(None).cast(i.schema["o"].dataType).alias("o"), "place")
    ranked = i.unionByName(e).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "layer", "o", "place")))
    return ranked.where(c("rank") <= largest).where("rank <= most").select("query_id", "rank", "id", "memory_type", "text", "summary", "thread_id", "score", "reason")
