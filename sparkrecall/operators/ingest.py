"""From observations to memories: defaults, normal form, and the sequential de-duplication as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X
from sparkrecall.model import DECAY, STATS

#: An observation repeats a memory that agrees in these.
DEDUP = ("tenant_id", "app_id", "actor_id", "memory_type", "dedup_text")


def normalized(obs: DataFrame, as_of: Column) -> DataFrame:
    """Observations with every default, in normal form: text of 1000 characters at most, summary given (200) or made,
    confidence and importance within [0, 1]."""
    c = F.col
    blank = lambda name: F.when(c(name) != "", c(name))
    out = obs.withColumn("text", F.substring(X.normalize_text(c("text")), 1, 1000))
    return (
        out.withColumn("thread_id", blank("thread_id"))
        .withColumn("scope", F.coalesce("scope", F.lit("actor")))
        .withColumn("summary", F.coalesce(F.substring(X.normalize_text(blank("summary")), 1, 200), X.summarize(c("text"))))
        .withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
        .withColumn("confidence", X.clamp(F.coalesce("confidence", F.lit(0.7)), 0.0, 1.0))
        .withColumn("importance", X.clamp(F.coalesce("importance", F.lit(0.5)), 0.0, 1.0))
        .withColumn("decay", F.coalesce("decay", F.struct(F.lit("time").alias("kind"), F.lit(180).alias("ttl_days")).cast(DECAY)))
        .withColumn("observed_at", F.coalesce("observed_at", as_of))
        .withColumn("dedup_text", F.lower("text"))
    )


def memory_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("mem_"), F.substring(F.sha2(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)), 256), 1, 16))


def ingest(obs: DataFrame, as_of: Column) -> DataFrame:
    """`memories` that the observations, taken in arrival order, leave behind; with int n_observations.

    An observation whose predecessor on the dedup keys is expired at as_of opens a new memory, since expired memories are
    archived before each look-up; else it merges. What it merges into keeps its text, scope, thread, source, decay and
    first times; confidence and importance rise to the maximum, metadata is overwritten key by key, and the last times
    are those of the later arrival, even if it was observed earlier. The decay that counts is that of the keys' first
    observation.
    """
    rows = normalized(obs, as_of)
    keyed = W.partitionBy(*DEDUP).orderBy("arrival_seq")
    policy = F.first("decay").over(keyed)
    before = F.lag("observed_at").over(keyed)
    opens = before.isNull() | X.expired(as_of, before, policy["kind"], policy["ttl_days"])
    marked = rows.withColumn("segment", F.sum(opens.cast("int")).over(keyed.rowsBetween(W.unboundedPreceding, 0)))
    first = lambda name: F.min_by(name, "arrival_seq").alias(name)
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("arrival_seq", F.map_entries("metadata").alias("m")))),
        F.create_map().cast("map<string,string>"),
        lambda old, x: X.merge_maps(old, F.map_from_entries(x["m"])),
    )
    merged = marked.groupBy(*DEDUP, "segment").agg(
        F.min("arrival_seq").alias("ord"),
        *(first(n) for n in ("text", "thread_id", "scope", "source", "decay", "summary") if n in marked.columns),
        folded.alias("metadata"),
        F.max("confidence").alias("confidence"),
        F.max("importance").alias("importance"),
        F.min_by("observed_at", "arrival_seq").alias("first_seen_at"),
        F.max_by("observed_at", "arrival_seq").alias("last_seen_at"),
        F.count("*").cast("int").alias("n_observations"),
    )
    out = merged.withColumn("id", memory_id("tenant_id", "app_id", "actor_id", "memory_type", "ord")).withColumn("created_at", F.col("first_seen_at")).withColumn("updated_at", F.col("last_seen_at"))
    gone = X.expired(as_of, F.col("last_seen_at"), F.col("decay.kind"), F.col("decay.ttl_days"))
    later = F.max("segment").over(W.partitionBy(*DEDUP)) > F.col("segment")  # only its archiving let another one open
    return out.withColumn("status", F.when(later & gone, "archived").otherwise("active")).withColumn("stats", F.struct(*(F.lit(0).cast("long").alias(n) for n in ("selected", "positive", "negative"))).cast(STATS)).drop("dedup_text", "segment")


def counts(memories: DataFrame) -> DataFrame:
    """created and updated of an ingest."""
    return memories.agg(F.count("*").alias("created"), F.coalesce(F.sum(F.col("n_observations") - 1), F.lit(0)).alias("updated"))


def duplicates(obs: DataFrame, as_of: Column) -> DataFrame:
    """Of each observation with an earlier one on the dedup keys: the first such, by arrival."""
    rows = normalized(obs, as_of)
    keyed = W.partitionBy(*DEDUP).orderBy("arrival_seq")
    return rows.withColumn("first_seq", F.first("arrival_seq").over(keyed)).where("first_seq < arrival_seq").select("arrival_seq", "first_seq")


def upsert(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Last write by id wins; an id keeps its first place in the order. Columns that `changed` lacks stay."""
    lacking = [c for c in stored.columns if c not in changed.columns]
    out = stored.join(changed.select(F.col("id"), *(F.col(c).alias(f"__{c}") for c in changed.columns if c != "id"), F.lit(True).alias("__new")), "id", "full_outer")
    pick = [F.col("id")]
    for c in stored.columns:
        if c == "id":
            continue
        if c in lacking:
            pick.append(F.col(c))
        elif c == "ord":
            pick.append(F.coalesce("ord", "__ord").alias("ord"))
        else:
            pick.append(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
    return out.select(*pick)


class PlaneEmbedding:
    """The model's own embedding: two numbers. Another needs the same two methods."""

    def embed(self, text: Column) -> Column:
        return X.embedding(X.tokenize(text))

    def similarity(self, a: Column, b: Column) -> Column:
        return X.similarity(a, b)


def enriched(memories: DataFrame, embedding=None) -> DataFrame:
    """With tokens, embedding, temporal, temporal_order, entities, has_problem and has_device, read off the text once."""
    c = F.col
    out = memories.withColumn("tokens", X.tokenize(c("text"))).withColumn("embedding", (embedding or PlaneEmbedding()).embed(c("text"))).withColumn("temporal", P.temporal(c("text"))).withColumn("temporal_order", P.temporal_order(c("text"))).withColumn("entities", P.entities(c("text")))
    return out.withColumn("has_problem", P.has_type(c("entities"), "PROBLEM")).withColumn("has_device", P.has_type(c("entities"), "OBJECT"))


def episodes(memories: DataFrame, batch: Column) -> DataFrame:
    """(episode_id, ids): memories of one tenant, application, actor and thread that came in one batch."""
    part = lambda n: F.coalesce(F.col(n), F.lit("null"))
    key = F.concat_ws(":", part("tenant_id"), part("app_id"), part("actor_id"), part("thread_id"))
    return memories.groupBy(F.concat_ws("_", F.lit("episode"), key, batch.cast("string")).alias("episode_id")).agg(F.sort_array(F.collect_set("id")).alias("ids"))


def preprocessed(obs: DataFrame) -> DataFrame:
    """The second service's preparation: normal text, raised importance, counts of the raw text."""
    c = F.col
    out = obs.withColumn("text_length", F.length("text")).withColumn("word_count", F.size(F.split("text", f"{X.WS}+", -1))).withColumn("has_questions", F.contains(c("text"), F.lit("?")))
    role = c("role") if "role" in obs.columns else F.lit(None).cast("string")
    return out.withColumn("importance", P.importance(c("text"), c("importance"), role)).withColumn("text", X.normalize_text(c("text")))
