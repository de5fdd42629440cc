"""What happens to memories later: expiry, feedback, contradiction, forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X


def is_expired(as_of: Column) -> Column:
    return (F.col("status") == "active") & X.expired(as_of, F.col("last_seen_at"), F.col("decay.kind"), F.col("decay.ttl_days"))


def archived(memories: DataFrame, as_of: Column) -> DataFrame:
    """Expired active memories become archived, updated at as_of."""
    marked = memories.withColumn("__gone", is_expired(as_of))
    return marked.withColumn("status", F.when(F.col("__gone"), "archived").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("__gone"), as_of).otherwise(F.col("updated_at"))).drop("__gone")


def live(memories: DataFrame, as_of: Column) -> DataFrame:
    """Memories that a reader sees: active and not expired."""
    return memories.where((F.col("status") == "active") & ~is_expired(as_of))


def compact(memories: DataFrame, as_of: Column) -> DataFrame:
    """One row (archived_expired, archived_superseded); superseded memories are archived by nothing."""
    return memories.agg(F.count_if(is_expired(as_of)).alias("archived_expired"), F.lit(0).cast("long").alias("archived_superseded"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """(memory_id, selected, positive, negative, total)."""
    return feedback.groupBy("memory_id").agg(*(F.count_if(F.col("signal") == s).alias(s) for s in ("selected", "positive", "negative")), F.count("*").alias("total"))


def with_feedback(memories: DataFrame, feedback: DataFrame, as_of: Column) -> DataFrame:
    """Counters raised; a memory that got feedback is seen and updated at as_of. Inactive and expired memories, and
    feedback on none, have no effect."""
    counts = feedback_counts(feedback).withColumnRenamed("memory_id", "id")
    out = archived(memories, as_of).join(counts, "id", "left")
    hit = F.col("total").isNotNull() & (F.col("status") == "active")
    add = lambda n: (F.col(f"stats.{n}") + F.when(hit, F.col(n)).otherwise(0)).alias(n)
    out = out.withColumn("stats", F.struct(*(add(n) for n in ("selected", "positive", "negative"))))
    for c in ("last_seen_at", "updated_at"):
        out = out.withColumn(c, F.when(hit, as_of).otherwise(F.col(c)))
    return out.select(*memories.columns)


def _sides(text: Column, swapped: bool = False) -> Column:
    """A bit for each side of each pattern that the text matches; swapped, the bits of the sides that contradict it."""
    out = F.lit(0)
    for i, sides in enumerate(P.CONTRADICTIONS):
        for j, side in enumerate(sides):
            out = out.bitwiseOR(F.when(text.rlike(side), 1 << (2 * i + (1 - j if swapped else j))).otherwise(0))
    return out


_BITS = 2 * len(P.CONTRADICTIONS)


#: 64-bit words of a set's signature.
_SIGNS = 4


def _signed(words: Column) -> Column:
    """Of an array of distinct words, a struct of its size and a bit for each word in _SIGNS longs, s0, s1, ..."""
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(64 * _SIGNS)))
    sign = lambda k: F.aggregate(places, F.lit(0).cast("long"), lambda s, x: F.when(x.between(64 * k, 64 * k + 63), s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (x - 64 * k).cast("int")))).otherwise(s))
    return F.struct(F.size(words).alias("n"), *(sign(k).alias(f"s{k}") for k in range(_SIGNS)))


def _most_shared(a: str, b: str) -> Column:
    """A bound of the words that two signed sets share: each bit that only one has is a word that only it has."""
    c = F.col
    only = lambda x, y: c(f"{x}.n") - sum((F.bit_count(c(f"{x}.s{k}").bitwiseAND(F.bitwise_not(c(f"{y}.s{k}")))) for k in range(1, _SIGNS)), F.bit_count(c(f"{x}.s0").bitwiseAND(F.bitwise_not(c(f"{y}.s0")))))
    return F.least(only(a, b), only(b, a))


def contradictions(new: DataFrame, stored: DataFrame, *more: str, part_rows: int = 4096) -> DataFrame:
    """(new_seq, old_id, confidence): pairs of one actor whose texts contradict, new ones by arrival_seq; and columns `more` of
    the stored.

    Each text is matched and split once; pairs meet by the sides that contradict, at the least of these. Where these are of
    over part_rows new texts, both sides are dealt into parts and every two parts meet under a key of their own. Sizes and
    signatures of the sets of words rule out that a pair shares half of its words; only the others' sets are compared.
    """
    keys = ["tenant_id", "app_id", "actor_id"]
    c = F.col
    bits = lambda m: F.explode(F.filter(F.array(*map(F.lit, range(_BITS))), lambda i: F.getbit(m, i) == 1))
    words = lambda: F.array_distinct(X.raw_words(c("said")))
    a = new.select(*keys, c("arrival_seq").alias("new_seq"), c("text").alias("said"), _sides(c("text")).alias("new_sides")).where("new_sides != 0").withColumn("bit", bits(c("new_sides")))
    b = stored.select(*keys, c("id").alias("old_id"), *more, c("text").alias("said"), _sides(c("text"), swapped=True).alias("against")).where("against != 0").withColumn("bit", bits(c("against")))
    parts = a.groupBy(*keys, "bit").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    every, own = F.explode(F.sequence(F.lit(0), c("parts") - 1)), lambda key: F.pmod(F.xxhash64(key), c("parts")).cast("int")
    a = a.withColumn("new_words", words()).withColumn("new_signs", _signed(c("new_words"))).join(parts, [*keys, "bit"]).withColumn("i", own("new_seq")).withColumn("j", every).drop("said", "parts")
    b = b.withColumn("old_words", words()).withColumn("old_signs", _signed(c("old_words"))).join(parts, [*keys, "bit"]).withColumn("j", own("old_id")).withColumn("i", every).drop("said", "parts")
    both = c("new_sides").bitwiseAND(c("against"))
    lower = F.call_function("shiftleft", F.lit(1), c("bit")) - 1
    met = a.join(b, [*keys, "bit", "i", "j"]).where(both.bitwiseAND(lower) == 0)
    maybe = 3 * _most_shared("new_signs", "old_signs") > c("new_signs.n") + c("old_signs.n")
    confidence = F.when(maybe, P.contradiction_confidence(c("new_words"), c("old_words"))).otherwise(P.contradiction_confidence())
    return met.select("new_seq", "old_id", *more, confidence.alias("confidence"))


def contradiction_counts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(old_id, n) of stored memories that new texts of their actor contradict. No pairs: of an actor's new texts only
    the few different sets of sides are counted."""
    keys = ["tenant_id", "app_id", "actor_id"]
    a = new.select(*keys, _sides(F.col("text")).alias("new_sides")).where("new_sides != 0").groupBy(*keys, "new_sides").agg(F.count("*").alias("k"))
    b = stored.select(*keys, F.col("id").alias("old_id"), _sides(F.col("text"), swapped=True).alias("against")).where("against != 0")
    met = b.join(a, keys).where(F.col("new_sides").bitwiseAND(F.col("against")) != 0)
    return met.groupBy("old_id").agg(F.sum("k").alias("n"))


def penalized(memories: DataFrame, counts: DataFrame) -> DataFrame:
    """Each contradiction (old_id, n) takes 0.2 off the old memory's confidence, which ends at 0.1 at least."""
    n = counts.select(F.col("old_id").alias("id"), F.col("n").alias("__n"))
    less = F.greatest(F.col("confidence") - 0.2 * F.col("__n"), F.lit(0.1))
    return memories.join(n, "id", "left").withColumn("confidence", F.when(F.col("__n") > 0, less).otherwise(F.col("confidence"))).drop("__n")


def resolved(memories: DataFrame, found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Memories contradicted with a confidence above the threshold (never, by default) become superseded."""
    hit = found.where(F.col("confidence") > threshold).select(F.col("old_id").alias("id")).distinct().withColumn("__hit", F.lit(True))
    return memories.join(hit, "id", "left").withColumn("status", F.when(F.col("__hit"), "superseded").otherwise(F.col("status"))).drop("__hit")


def open_contradictions(events: DataFrame, as_of: Column) -> DataFrame:
    """Contradictions that stay on record: unresolved ones, and those found within the last 24 hours."""
    return events.where(~F.col("resolved") | (F.unix_millis(as_of) - F.unix_millis("found_at") <= X.DAY_MS))


def forgotten(memories: DataFrame, as_of: Column, days: int = 90, least_importance: float = 0.3) -> DataFrame:
    """Active memories older than `days` and less important than `least_importance` become archived."""
    old = (F.col("status") == "active") & (F.col("last_seen_at") < as_of - F.expr(f"interval {days} days")) & (F.col("importance") < least_importance)
    return memories.withColumn("status", F.when(old, "archived").otherwise(F.col("status")))
