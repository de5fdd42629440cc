"""The two example assistants' loop over an engine: store the messages, read their contexts, reply, store the replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.model import DECAY, OBSERVATIONS, SOURCE
from sparkrecall.operators import context as C
from sparkrecall.operators import recipes as R
from sparkrecall.plans.engine import Engine
from sparkrecall.sources.store import settled

#: Arrival numbers that one message may take: itself, and what is found in it by category.
PER_MESSAGE = 1000
CATEGORIES = {"personal_info": 0, "preference": 100, "schedule": 200, "habit": 300}


def as_observations(rows: DataFrame, at: Column, channel: str) -> DataFrame:
    """Rows of recipes (and of the messages' role, if there) as the engine's input; values of metadata are JSON literals."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    role = F.col("role") if "role" in rows.columns else F.lit("user")
    category = F.col("category") if "category" in rows.columns else F.lit("message")
    pos = F.col("pos") if "pos" in rows.columns else F.lit(-1)
    for name, more in CATEGORIES.items():
        pos = pos + F.when(category == name, more).otherwise(0)
    made = rows.select(
        (F.col("seq") * PER_MESSAGE + pos + 1).cast("long").alias("arrival_seq"), "tenant_id", "app_id", "actor_id", "thread_id", "memory_type", F.lit(None).cast("string").alias("scope"), "text", F.lit(None).cast("string").alias("summary"),
        F.create_map(F.lit("role"), quoted(role), F.lit("category"), quoted(category), F.lit("channel"), quoted(F.lit(channel))).alias("metadata"),
        F.struct(F.lit("chat").alias("source_type"), F.concat_ws("-", "thread_id", F.col("seq").cast("string")).alias("source_id"), F.col("thread_id").alias("source_session_id")).cast(SOURCE).alias("source"),
        "confidence", "importance", F.lit(None).cast(DECAY).alias("decay"), at.alias("observed_at"),
    )
    order = rows.sparkSession.createDataFrame([], OBSERVATIONS).columns
    return made.select(*order)


def selected(engine: Engine, messages: DataFrame, of: dict[str, str], budget: tuple[int, int]) -> DataFrame:
    """(seq, memories): of each message the memories in its context, best first, as structs of memory_type, text, category."""
    items, chars = budget
    q = messages.select(F.col("seq").alias("query_id"), F.col("text").alias("query"), *(F.lit(v).alias(k) for k, v in of.items()), "actor_id", F.lit(items).alias("max_items"), F.lit(chars).alias("max_chars"))
    hits = C.packed(q, engine.search(q.withColumn("limit", F.lit(2 * items))))
    category = engine.dump().select("id", F.trim(F.lit('"'), F.try_element_at("metadata", F.lit("category"))).alias("category"))
    one = F.struct("rank", "memory_type", "text", "category")
    per = hits.join(category, "id", "left").groupBy(F.col("query_id").alias("seq")).agg(F.array_sort(F.collect_list(one)).alias("memories"))
    none = F.array().cast("array<struct<rank:int,memory_type:string,text:string,category:string>>")
    return messages.select("seq").join(per, "seq", "left").select("seq", F.coalesce("memories", none).alias("memories"))


def _turn(engine: Engine, messages: DataFrame, observed: DataFrame, of: dict[str, str], budget: tuple[int, int], channel: str, reply: Callable[[Column, Column], Column]) -> DataFrame:
    engine.ingest(as_observations(observed.join(messages.select("seq", "role"), "seq"), engine.now(), channel), strict=False)
    found = selected(engine, messages, of, budget)
    said = messages.join(found, "seq").select("seq", "actor_id", "thread_id", reply(F.col("text"), F.col("memories")).alias("text"), F.size("memories").alias("found_memories"))
    out = settled(said)
    # of type system, which validation turns away
    engine.ingest(as_observations(R.assistant_replies(out).select(*(F.lit(v).alias(k) for k, v in of.items()), "seq", "actor_id", "thread_id", "memory_type", "text", "confidence", "importance").withColumn("role", F.lit("bot")), engine.now(), channel), strict=False)
    return out.withColumnRenamed("text", "reply")


def support_turn(engine: Engine, messages: DataFrame) -> DataFrame:
    """(seq, actor_id, thread_id, reply, found_memories) for customers' messages (seq, actor_id, thread_id, role, text)."""
    return _turn(engine, messages, R.support_observations(messages), R.SUPPORT, R.SUPPORT_BUDGET, "web-chat", R.support_reply)


def assistant_turn(engine: Engine, messages: DataFrame, hour: Column) -> DataFrame:
    """The same for users' messages to the personal assistant at an hour of the day."""
    return _turn(engine, messages, R.assistant_observations(messages), R.ASSISTANT, R.ASSISTANT_BUDGET, "mobile", lambda text, memories: R.assistant_reply(text, memories, hour))
