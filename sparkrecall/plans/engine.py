"""The engine's calls over one store: ingest, search, context, profile, feedback, compact, look-ups, health."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall import model as M
from sparkrecall.operators import context as C
from sparkrecall.operators import ingest as I
from sparkrecall.operators import layers as Y
from sparkrecall.operators import lifecycle as L
from sparkrecall.operators import search as S
from sparkrecall.sources.store import JsonStore, LayerStore, MemoryStore, ParquetStore

MODES = ("lexical", "enhanced", "dual_layer")
#: The store's mark of the highest order of a memory.
_ORD = "highest ord"
#: As many values Spark pushes down one by one.
FEW = 10


class Store(Protocol):
    """`buckets`: parts of the store that a call is about, as touched() names them; None is all."""

    def touched(self, memories: DataFrame) -> list[int] | None: ...

    def read(self, buckets: list[int] | None = None) -> DataFrame: ...

    def write(self, memories: DataFrame, marks: dict[str, int] | None = None, buckets: list[int] | None = None) -> None: ...

    def marks(self) -> dict[str, int]: ...

    def whole(self, memories: DataFrame) -> DataFrame: ...


class Embedding(Protocol):
    """What a text's vector is, and how alike two are, as expressions."""

    def embed(self, text: Column) -> Column: ...

    def similarity(self, a: Column, b: Column) -> Column: ...


@dataclass
class Config:
    """mode: how search scores. store: memory, parquet or json. path: where the latter two are."""

    mode: str = "lexical"
    store: str = "memory"
    path: str | None = None
    rate_limit_per_min: int = 120

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            self.mode = "lexical"  # an unknown kind is the plain one
        if self.store in ("parquet", "json") and not self.path:
            raise ValueError("a stored engine needs a path")
        if not 10 <= self.rate_limit_per_min <= 10_000:
            raise ValueError("rate limit: from 10 to 10000")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ if env is None else env)
        raw = env.get("RATE_LIMIT_PER_MIN", "120")
        if not raw.isdigit():
            raise ValueError("rate limit: a whole number")
        path = env.get("STORE_PATH")
        return cls(env.get("ENGINE_MODE", "lexical"), env.get("ENGINE_STORE", "json" if path else "memory"), path, int(raw))


class Engine:
    """Queries, actors and signals come as tables, many at once; a table's rows are checked as a single request's
    arguments would be."""

    def __init__(self, spark: SparkSession, config: Config | None = None, now: Callable[[], Column] = F.current_timestamp):
        self.spark, self.config, self.now = spark, config or Config(), now
        # what enhanced search reads off a text is stored with it; the JSON document has memories alone
        derive = I.enriched if self.config.mode == "enhanced" else None
        self.store: Store
        if self.config.store == "json":
            self.store = JsonStore(spark, self.config.path)
        else:
            self.store = ParquetStore(spark, self.config.path, derive=derive) if self.config.store == "parquet" else MemoryStore(spark, derive)
        self.columns = spark.createDataFrame([], M.MEMORIES).columns

    def moment(self) -> Column:
        """The present as a constant, which is the same in all jobs of a call."""
        return F.timestamp_micros(F.lit(self.spark.range(1).select(F.unix_micros(self.now())).first()[0]))

    def _marks(self) -> dict[str, int]:
        """Of each stream the number of the last batch in the store."""
        return {k: n for k, n in self.store.marks().items() if k != _ORD}

    def _last_ord(self) -> int:
        known = self.store.marks().get(_ORD)
        return self.store.read().agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] if known is None else known

    def ingest(self, observations: DataFrame, strict: bool = True, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """How many memories are created and updated. Strict: a request without observations or with an invalid one fails;
        else invalid ones are left out, as `rejected` says; rejected() has them with their errors.

        `batch`: the name of a stream and the number of this batch in it. The number is stored together with the memories,
        and a batch that is in the store already changes nothing.
        """
        if batch is not None and self._marks().get(batch[0], -1) >= batch[1]:
            return {"created": 0, "updated": 0}
        valid, invalid = M.validated(observations, strict)
        if strict and observations.isEmpty():
            raise ValueError("observations: at least one")
        out = self._ingest(valid, {batch[0]: batch[1]} if batch else None)
        return out if strict else out | {"rejected": invalid.count()}

    @staticmethod
    def rejected(observations: DataFrame) -> DataFrame:
        """The invalid rows, with the list of what is wrong with each."""
        return M.validated(observations)[1]

    def _ingest(self, valid: DataFrame, marks: dict[str, int] | None) -> dict[str, int]:
        """Stored memories take part as what came before: a repeat of one merges into it. Arrival numbers that go on after
        the stored ones are kept, so that an ingest in parts leaves what one ingest of all leaves; else they are raised.
        Only the buckets of the new texts are read and written; what expired in others is archived as they are touched."""
        now = self.moment()
        new = I.ingest(valid, now).persist()
        touched = self.store.touched(new)
        stored = L.archived(self.store.read(touched), now)
        keys = ["tenant_id", "app_id", "actor_id", "memory_type"]
        old = stored.where("status = 'active'").withColumn("low", F.lower("text"))
        first = old.groupBy(*keys, "low").agg(F.min_by("id", "ord").alias("stored_id"))
        # of the memories that new observations of one text leave, only the first can be the stored one
        place = F.row_number().over(W.partitionBy(*keys, "low").orderBy("ord"))
        met = new.withColumn("low", F.lower("text")).withColumn("place", place).join(first, [*keys, "low"], "left")
        met = met.withColumn("old_id", F.when(F.col("place") == 1, F.col("stored_id"))).drop("low", "place", "stored_id").persist()
        counts = met.agg(F.count_if(F.col("old_id").isNull()).alias("created"), F.coalesce(F.sum(F.col("n_observations") - F.when(F.col("old_id").isNull(), 1).otherwise(0)), F.lit(0)).alias("updated"), F.min("ord").alias("first"), F.max("ord").alias("last")).first()
        last = self._last_ord()
        base = 0 if counts["first"] is None or counts["first"] > last else last + 1
        fresh = met.where("old_id is null").withColumn("ord", F.col("ord") + base).withColumn("id", I.memory_id(*keys, "ord"))
        fresh = self.store.whole(fresh.select(*self.columns))
        again = met.where("old_id is not null").select(F.col("old_id").alias("id"), *(F.col(c).alias(f"__{c}") for c in ("confidence", "importance", "metadata", "status", "last_seen_at", "updated_at")))
        both = stored.join(again, "id", "left")
        for c in ("confidence", "importance"):
            both = both.withColumn(c, F.greatest(c, f"__{c}"))
        both = both.withColumn("metadata", F.when(F.col("__metadata").isNotNull(), I.X.merge_maps(F.col("metadata"), F.col("__metadata"))).otherwise(F.col("metadata")))
        for c in ("status", "last_seen_at", "updated_at"):
            both = both.withColumn(c, F.coalesce(f"__{c}", c))
        if touched is None or touched or marks:
            highest = max(last, base + counts["last"] if counts["last"] is not None else -1)
            self.store.write(both.select(*stored.columns).unionByName(fresh.select(*stored.columns)), (marks or {}) | {_ORD: highest}, touched)
        met.unpersist()
        new.unpersist()
        return {"created": int(counts.created), "updated": int(counts.updated)}

    def change(self, memories: DataFrame) -> None:
        """Puts whole memories, of different ids, in the place of those stored under these ids, or beside the others."""
        new = self.store.whole(memories.select(*self.columns))
        before = self.store.read().join(new.select("id"), "id", "left_semi")
        touched = self.store.touched(before.select(*self.columns).unionByName(new.select(*self.columns)))
        highest = new.agg(F.max("ord")).first()[0]
        if highest is None:
            return
        stored = self.store.read(touched)
        self.store.write(stored.join(new.select("id"), "id", "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns)), {_ORD: max(highest, self._last_ord())}, touched)

    def search(self, queries: DataFrame) -> DataFrame:
        return self._found(M.checked_search(queries))

    def _found(self, queries: DataFrame) -> DataFrame:
        find = S.enhanced_hits if self.config.mode == "enhanced" else S.lexical_hits
        return find(queries, self.store.read(), self.now())

    def context(self, queries: DataFrame) -> DataFrame:
        checked = M.checked_budget(M.checked_search(queries))
        wide = C.budgets(checked).withColumn("limit", F.col("max_items") * 2)
        return C.contexts(checked, self.memories(), self.now(), self._found(wide))

    def memories(self) -> DataFrame:
        """What profiles, and a service above, see of an actor's past."""
        return self.store.read().select(*self.columns)

    def profile(self, actors: DataFrame) -> DataFrame:
        keys = ["tenant_id", "app_id", "actor_id"]
        return C.profiles(self.memories().join(actors.select(*keys).distinct(), keys, "left_semi"), self.now())

    def feedback(self, signals: DataFrame) -> int:
        """How many signals found a live memory."""
        stored, checked, now = self.store.read(), M.checked_signals(signals), self.moment()
        hit = checked.join(L.live(stored, now).select(F.col("id").alias("memory_id")), "memory_id", "left_semi").count()
        touched = self.store.touched(stored.join(checked.select(F.col("memory_id").alias("id")), "id", "left_semi"))
        if touched is None or touched:
            self.store.write(L.with_feedback(self.store.read(touched), checked, now), buckets=touched)
        return hit

    def compact(self) -> dict[str, int]:
        stored, now = self.store.read(), self.moment()
        row = L.compact(stored, now).first()
        if row.archived_expired:
            touched = self.store.touched(stored.where(L.is_expired(now)))
            self.store.write(L.archived(self.store.read(touched), now), buckets=touched)
        return row.asDict()

    def get(self, ids: DataFrame) -> DataFrame:
        """Live memories by id. Up to FEW ids are a filter that the store's files are skipped by; more are a join."""
        few = [r.id for r in ids.select("id").distinct().limit(FEW + 1).collect()]
        stored = self.dump()
        return S.by_id(stored.where(F.col("id").isin(few)) if len(few) <= FEW else stored, ids, self.now())

    def list(self, actors: DataFrame) -> DataFrame:
        return S.by_actor(self.dump(), actors, self.now())

    def dump(self) -> DataFrame:
        """All memories, expired ones as archived."""
        return L.archived(self.store.read(), self.now()).select(*self.columns)

    def health(self) -> dict[str, object]:
        """ok says whether the store can be read now."""
        try:
            return {"ok": True, "provider": self.config.mode, "detail": f"records={self.dump().count()}"}
        except Exception as e:  # noqa: BLE001 - whatever keeps the store from being read
            return {"ok": False, "provider": self.config.mode, "detail": str(e).split("\n")[0]}


class DualLayerEngine(Engine):
    """The same calls over an event log and the insights drawn from it. Ingest appends events; process() draws from those
    not yet processed, merges what it draws into the insights and consolidates these, as often as a caller wants.
    Feedback has no effect here, and no observation is a duplicate."""

    def __init__(self, spark: SparkSession, config: Config | None = None, now: Callable[[], Column] = F.current_timestamp, isolation: str = "tenant", strategies: tuple[Y.Strategy, ...] = Y.STRATEGIES):
        self.spark, self.config, self.now = spark, config or Config(mode="dual_layer"), now
        self.isolation, self.strategies = isolation, strategies
        if self.config.store == "json":
            raise ValueError("two layers are kept in memory or as parquet")
        self.layers = LayerStore(spark, self.config.path if self.config.store == "parquet" else None)

    def _marks(self) -> dict[str, int]:
        return self.layers.marks()

    def _ingest(self, valid: DataFrame, marks: dict[str, int] | None) -> dict[str, int]:
        events, insights = self.layers.read()
        now = self.moment()
        last = events.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        new = I.normalized(valid, now).persist()
        first, n = new.agg(F.min("arrival_seq"), F.count("*")).first()
        base = 0 if first is None or first > last else last + 1
        rows = new.withColumn("ord", F.col("arrival_seq") + base).withColumn("id", F.concat(F.lit("event_"), F.substring(F.sha2(F.concat_ws("|", "tenant_id", "app_id", "actor_id", F.col("ord").cast("string")), 256), 1, 16)))
        self.layers.write(events.unionByName(Y.events_of(rows, now).withColumn("processed", F.lit(False))), insights, marks)
        new.unpersist()
        return {"created": int(n), "updated": 0}

    def change(self, memories: DataFrame) -> None:
        """No effect: events and what was drawn from them are not for others to change."""

    def process(self, most: int | None = None) -> int:
        """Insights from the events not yet processed, or from the first `most` of them; how many insights there are then."""
        events, insights = self.layers.read()
        keys = [*Y.ISOLATION[self.isolation], "session_id"]
        new = events.where("not processed")
        if most is not None:
            new = new.orderBy("seq").limit(most)
        # a summary is of the whole session
        of_new = events.join(new.select(*keys).distinct(), keys, "left_semi")
        summaries = [s for s in self.strategies if s.draw is Y.session_summaries]
        drawn = Y.drawn(new, self.strategies, whole=of_new) if summaries else Y.drawn(new, self.strategies)
        now = self.moment()
        merged = Y.stored(drawn, self.isolation, as_of=now, existing=insights)
        last = new.agg(F.max("seq")).first()[0]
        seen = F.col("processed") | (F.col("seq") <= F.lit(last if last is not None else -1))
        self.layers.write(events.withColumn("processed", seen), Y.consolidated(merged, self.isolation, as_of=now))
        return self.layers.read()[1].count()

    def _found(self, queries: DataFrame) -> DataFrame:
        events, insights = self.layers.read()
        return Y.search(queries, insights, events, self.now()).withColumn("reasons", F.array("reason")).drop("reason")

    def memories(self) -> DataFrame:
        return self._records(Y.insight_memories(self.layers.read()[1]))

    @staticmethod
    def _records(rows: DataFrame) -> DataFrame:
        decay = F.struct(F.col("decay_kind").alias("kind"), "ttl_days").cast(M.DECAY)
        return rows.withColumn("decay", decay).withColumn("ord", F.xxhash64("id")).drop("decay_kind", "ttl_days")

    def feedback(self, signals: DataFrame) -> int:
        M.checked_signals(signals).count()
        return 0

    def compact(self) -> dict[str, int]:
        (events, insights), now = self.layers.read(), self.moment()
        row = Y.compact(events, insights, now).first()
        if row.archived_expired:
            self.layers.write(*Y.compacted(events, insights, now))
        return row.asDict()

    def get(self, ids: DataFrame) -> DataFrame:
        events, insights = self.layers.read()
        return Y.by_id(insights, events, ids)

    def list(self, actors: DataFrame) -> DataFrame:
        return Y.by_actor(self.layers.read()[1], actors)

    def dump(self) -> DataFrame:
        events, insights = self.layers.read()
        return Y.insight_memories(insights).unionByName(Y.event_memories(events))


def open_engine(spark: SparkSession, config: Config | None = None, now: Callable[[], Column] = F.current_timestamp) -> Engine:
    """The engine that the configuration's mode names."""
    config = config or Config()
    return DualLayerEngine(spark, config, now) if config.mode == "dual_layer" else Engine(spark, config, now)
