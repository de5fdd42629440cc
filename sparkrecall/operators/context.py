"""Profiles and contexts: what is said about an actor, and the ranked hits packed into a prompt's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.functions import text as X
from sparkrecall.operators import search as S
from sparkrecall.operators.lifecycle import live

ACTOR = ["tenant_id", "app_id", "actor_id"]

# The profile's sections in order.
SECTIONS = {"preference": "Preferences", "goal": "Goals", "project": "Projects", "fact": "Facts", "instruction": "Instructions", "profile": "Profile", "tool_outcome": "Tool Outcomes", "episode": "Episodes"}


def texts_by_type(memories: DataFrame, as_of: Column, most: int | None = None) -> DataFrame:
    """(actor, memory_type, texts, n): live texts, last seen first; with `most`, so many of them at most."""
    seen = W.partitionBy(*ACTOR, "memory_type").orderBy(F.desc("last_seen_at"), "ord")
    rows = live(memories, as_of).withColumn("rank", F.row_number().over(seen))
    n = F.count("*").alias("n")
    kept = F.when(F.col("rank") <= most, F.struct("rank", "text")) if most else F.struct("rank", "text")
    return rows.groupBy(*ACTOR, "memory_type").agg(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]).alias("texts"), n)


def profiles(memories: DataFrame, as_of: Column, most: int | None = None) -> DataFrame:
    """(actor, by_type map, summary, count). The summary has three texts of each section, last seen first; types without
    a section count, but aren't printed. by_type has all texts, or `most` of each type."""
    per = texts_by_type(memories, as_of, most)
    rows = per.groupBy(*ACTOR).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("memory_type", "texts")))).alias("by_type"), F.sum("n").alias("count"))

    def section(kind: str, title: str) -> Column:
        items = F.try_element_at(F.col("by_type"), F.lit(kind))
        lines = F.concat(F.array(F.lit(f"{title}:")), F.transform(F.slice(items, 1, 3), lambda t: F.concat(F.lit("- "), t)))
        return F.when(items.isNotNull(), F.array_join(lines, "\n"))

    return rows.withColumn("summary", F.array_join(F.array_compact(F.array(*(section(k, t) for k, t in SECTIONS.items()))), "\n"))


def _line() -> Column:
    return F.concat(F.lit("- ["), F.col("memory_type"), F.lit("] "), F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("text")))


def budgets(queries: DataFrame, most_items: int = 30) -> DataFrame:
    q = S.with_defaults(queries)
    items = F.least(F.greatest(F.coalesce("max_items", F.lit(8)), F.lit(1)), F.lit(most_items))
    return q.withColumn("max_items", items).withColumn("max_chars", F.least(F.greatest(F.coalesce("max_chars", F.lit(3000)), F.lit(300)), F.lit(20000)))


def packed(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits in rank order until the items are full or a line would go beyond the characters. Lengths are positive, so
    the running sum alone says where to stop."""
    q = budgets(queries).select("query_id", "max_items", "max_chars")
    up = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    joined = hits.join(q, "query_id").withColumn("used", F.sum(F.length(_line())).over(up))
    return joined.where((F.col("used") <= F.col("max_chars")) & (F.col("rank") <= F.col("max_items")))


def contexts(queries: DataFrame, memories: DataFrame, as_of: Column, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, profile_summary, total_memories, context_text): twice the items are searched for, as many as fit are
    packed, and the profile of the query's actor, if it names one, goes before."""
    c = F.col
    b = budgets(queries)
    found = hits if hits is not None else S.lexical_hits(b.withColumn("limit", c("max_items") * 2), memories, as_of)
    line = F.concat(F.lit("- ["), c("memory_type"), F.lit("] "), X.summarize(c("text")))
    lines = packed(queries, found).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("total_memories"))
    # only actors that some query names have a profile made, and only three texts of each type
    named = b.where("actor_id != ''").select(*ACTOR).distinct()
    about = profiles(memories.join(named, ACTOR, "left_semi"), as_of, most=3).select(*ACTOR, "summary")
    out = b.join(lines, "query_id", "left").join(about, ACTOR, "left")
    profile = F.coalesce("summary", F.lit(""))
    head = F.when(profile != "", F.concat(F.lit("KNOWN ACTOR PROFILE:\n"), profile, F.lit("\n"))).otherwise("")
    body = F.when(c("lines").isNotNull(), F.concat(F.lit("RELEVANT MEMORIES:\n"), c("lines"))).otherwise("")
    text = F.regexp_replace(F.concat_ws("\n", F.when(head != "", head), F.when(body != "", body)), f"^{X.WS}+|{X.WS}+$", "")
    return out.select("query_id", profile.alias("profile_summary"), F.coalesce("total_memories", F.lit(0)).alias("total_memories"), text.alias("context_text"))


def diverse(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, selected array of hits): all hits if they are no more than the items, whatever their length. Else
    greedily by score: a hit too long for what is left is skipped, and so is one of a thread already used while fewer
    threads than half the items are. A greedy choice is a fold over the at most 100 hits of a query."""
    c = F.col
    q = budgets(queries, 50).select("query_id", "max_items", "max_chars")
    hit = F.struct((-c("score")).alias("s"), "rank", "id", "memory_type", "thread_id", F.when(c("summary") != "", c("summary")).otherwise(c("text")).alias("said"), "score")
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.count("*").alias("n")).join(q, "query_id")
    kind = dict(hits.dtypes)
    item = f"struct<s:double,rank:int,id:{kind['id']},memory_type:string,thread_id:string,said:string,score:double>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("kept"), F.lit(0).alias("chars"), F.array().cast("array<string>").alias("threads"))

    def step(state: Column, h: Column) -> Column:
        thread = F.coalesce(h["thread_id"], F.lit("\0none"))
        used = F.array_contains(state["threads"], thread)
        full = F.size(state["kept"]) >= c("max_items")
        long = state["chars"] + F.length(h["said"]) > c("max_chars")
        again = used & (F.size(state["threads"]) < c("max_items") / 2)
        taken = F.struct(F.concat(state["kept"], F.array(h)).alias("kept"), (state["chars"] + F.length(h["said"])).alias("chars"), F.when(used, state["threads"]).otherwise(F.concat(state["threads"], F.array(thread))).alias("threads"))
        return F.when(full | long | again, state).otherwise(taken)

    in_rank = F.array_sort("hits", lambda a, b: F.when(a["rank"] < b["rank"], -1).otherwise(1))
    picked = F.when(c("n") <= c("max_items"), in_rank).otherwise(F.aggregate(c("hits").cast(f"array<{item}>"), start, step, lambda s: s["kept"]))
    return per.select("query_id", picked.alias("selected"))


def sectioned(selected: DataFrame) -> DataFrame:
    """(query_id, context_text): selected hits by type, in the order in which the types first appear."""
    rows = selected.select("query_id", F.posexplode("selected").alias("pos", "h"))
    line = F.concat(F.lit("- ["), F.col("h.memory_type"), F.lit("] "), F.col("h.said"), F.when(F.col("h.score") > 0.8, " (high relevance)").otherwise(""))
    per = rows.groupBy("query_id", F.col("h.memory_type").alias("memory_type")).agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    section = F.concat(F.lit("\n"), F.upper("memory_type"), F.lit(" MEMORIES:\n"), F.col("lines"))
    return per.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", section.alias("section")))), lambda x: x["section"]), "\n").alias("context_text"))


def answered_contexts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, context_text, answer) of the enhanced search: every hit with its score to three places, and the answer."""
    line = F.concat(F.lit("- ["), F.col("memory_type"), F.lit("] "), F.col("text"), F.lit(" (score: "), F.format_string("%.3f", "score"), F.lit(")"))
    per = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    out = queries.select("query_id").join(per, "query_id", "left").join(S.answers(queries, hits), "query_id")
    return out.select("query_id", F.concat_ws("\n", F.lit("ENHANCED MEMORY SEARCH RESULTS:"), F.col("lines")).alias("context_text"), "answer")
