"""The second service: an engine whose ingest prepares observations and lowers the confidence of what they contradict,
and whose contexts choose from three times the items by thread; with counters, and the jobs that a scheduler runs."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sparkrecall import model as M
from sparkrecall.operators import context as C
from sparkrecall.operators import ingest as I
from sparkrecall.operators import lifecycle as L
from sparkrecall.plans.engine import Engine
from sparkrecall.sources.store import settled

NO_PROFILE = "No profile available"


def prepared(obs: DataFrame) -> DataFrame:
    """Observations with normal text, raised importance, and what was counted in their texts as metadata."""
    out = I.preprocessed(obs.withColumn("role", F.get_json_object(F.try_element_at("metadata", F.lit("role")), "$")) if "role" not in obs.columns else obs)
    counted = F.create_map(F.lit("textLength"), F.col("text_length").cast("string"), F.lit("wordCount"), F.col("word_count").cast("string"), F.lit("hasQuestions"), F.col("has_questions").cast("string"))
    none = F.create_map().cast("map<string,string>")
    return out.withColumn("metadata", I.X.merge_maps(F.coalesce("metadata", none), counted)).select(*obs.columns)


def tuned_contexts(queries: DataFrame, memories: DataFrame, as_of: Column, hits: DataFrame) -> DataFrame:
    """(query_id, profile_summary, total_memories, context_text) of hits for three times the items: a choice by score and
    thread, in sections by type. total_memories counts all hits."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    text = C.sectioned(C.diverse(queries, hits))
    q = C.budgets(queries, 50)
    about = C.profiles(memories.join(q.where("actor_id != ''").select(*C.ACTOR).distinct(), C.ACTOR, "left_semi"), as_of, most=3).select(*C.ACTOR, F.col("summary").alias("profile"))
    out = q.join(n, "query_id", "left").join(text, "query_id", "left").join(about, C.ACTOR, "left")
    profile = F.when(F.col("profile") != "", F.col("profile")).otherwise(NO_PROFILE)
    return out.select("query_id", F.coalesce(profile, F.lit(NO_PROFILE)).alias("profile_summary"), F.coalesce("n", F.lit(0)).alias("total_memories"), F.coalesce("context_text", F.lit("")).alias("context_text"))


class TunedEngine:
    def __init__(self, engine: Engine, supersede_above: float = 0.8, clock: Callable[[], float] = time.monotonic):
        self.engine, self.supersede_above, self.clock = engine, supersede_above, clock
        self._records: list[DataFrame] = []
        self.requests, self.error_rate, self.seconds = 0, 0.0, 0.0

    def _timed(self, call: Callable[[], object]) -> object:
        """Failures move the error rate a tenth of the way to 1; successes leave it. Answers move the average time a tenth."""
        self.requests, start = self.requests + 1, self.clock()
        try:
            out = call()
        except Exception:
            self.error_rate = self.error_rate * 0.9 + 0.1
            raise
        self.seconds = self.seconds * 0.9 + (self.clock() - start) * 0.1
        return out

    def ingest(self, observations: DataFrame) -> dict[str, int]:
        """Prepared; memories that they contradict lose confidence; then ingested. All count as created."""
        return self._timed(lambda: self._ingest(observations))

    def _ingest(self, observations: DataFrame) -> dict[str, int]:
        if observations.isEmpty():
            raise ValueError("observations: at least one")
        valid, _ = M.validated(observations, strict=True)
        new, now = prepared(valid), self.engine.moment()
        stored = self.engine.memories()
        seen = L.live(stored, now)
        counts = settled(L.contradiction_counts(new, seen))
        if not counts.isEmpty():
            self._records.append(settled(L.contradictions(new, seen).withColumn("found_at", now).withColumn("resolved", F.lit(False))))
            hit = stored.join(counts.select(F.col("old_id").alias("id")), "id", "left_semi")
            self.engine.change(L.penalized(hit, counts).select(*stored.columns))
        done = self.engine.ingest(new)
        return {"created": done["created"] + done["updated"], "updated": 0}

    @property
    def found(self) -> DataFrame | None:
        """Contradictions on record: each ingest's own, and what resolve() left."""
        return functools.reduce(DataFrame.unionByName, self._records) if self._records else None

    def search(self, queries: DataFrame) -> DataFrame:
        return self._timed(lambda: self.engine.search(queries))

    def context(self, queries: DataFrame) -> DataFrame:
        return self._timed(lambda: self._context(queries))

    def _context(self, queries: DataFrame) -> DataFrame:
        checked = M.checked_search(queries)
        wide = C.budgets(checked, 50).withColumn("limit", F.col("max_items") * 3)  # engines bound it as they bound searches
        return tuned_contexts(checked, self.engine.memories(), self.engine.now(), self.engine._found(wide))

    def resolve(self) -> int:
        """Supersedes what is contradicted surely enough, and forgets resolved contradictions of over a day; how many stay
        on record."""
        if not self._records:
            return 0
        found, stored = self.found, self.engine.memories()
        sure = found.where(F.col("confidence") > self.supersede_above)
        hit = stored.join(sure.select(F.col("old_id").alias("id")).distinct(), "id", "left_semi").where("status != 'superseded'")
        if not hit.isEmpty():
            self.engine.change(L.resolved(hit, sure, self.supersede_above).select(*stored.columns))
        marked = found.withColumn("resolved", F.col("resolved") | (F.col("confidence") > self.supersede_above))
        self._records = [settled(L.open_contradictions(marked, self.engine.moment()))]
        return self.found.count()

    def forget(self, days: int = 90, least_importance: float = 0.3) -> None:
        stored = self.engine.memories()
        gone = L.forgotten(stored.where("status = 'active'"), self.engine.moment(), days, least_importance).where("status != 'active'")
        if not gone.isEmpty():
            self.engine.change(gone.select(*stored.columns))

    def jobs(self, every: str = "5 minutes", forget_after: float = 86_400.0, **options: str) -> StreamingQuery:
        """Runs the periodic jobs until the query is stopped: resolve() at each trigger, and forget() when `forget_after`
        seconds have passed since the last time, by the clock."""
        last = self.clock()

        def batch(_: DataFrame, number: int) -> None:
            nonlocal last
            self.resolve()
            if self.clock() - last >= forget_after:
                last = self.clock()
                self.forget()

        ticks = self.engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(batch).trigger(processingTime=every).options(**options).start()

    def metrics(self) -> dict[str, float]:
        """Of this service: requests, the moving averages of failures and seconds, contradictions on record, memories."""
        return {"requests": self.requests, "error_rate": self.error_rate, "average_seconds": self.seconds, "contradictions": self.found.count() if self._records else 0, "records": self.engine.dump().count()}
