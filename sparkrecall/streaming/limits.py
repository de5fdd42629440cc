"""Rate limiting, moving averages, and the engine's streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X
from sparkrecall.functions.text import DAY_MS
from sparkrecall.operators.layers import drawn
from sparkrecall.plans.engine import Engine
from sparkrecall.sources.store import settled

WINDOW_MS = 60_000


#: Slots of a window's length that are looked through together for the next one with requests.
SLOTS = 4096


def _with_next(times: DataFrame, window_ms: int) -> DataFrame:
    """`times` (identity, ms, slot), all different, with next: the first time window_ms or more later.

    It is looked for in the slot of ms + window_ms, else at the beginning of a later slot: within SLOTS of these, then
    beyond. So no task sorts more than a slot's times, or one row for each of SLOTS slots.
    """
    c = F.col
    asked = times.select("identity", (c("ms") + window_ms).alias("at"), (c("slot") + 1).alias("slot"), F.lit(False).alias("there"))
    both = times.select("identity", c("ms").alias("at"), "slot", F.lit(True).alias("there")).unionByName(asked)
    rest = W.partitionBy("identity", "slot").orderBy("at", "there").rowsBetween(0, W.unboundedFollowing)
    own = both.withColumn("next", F.first(F.when(c("there"), c("at")), ignorenulls=True).over(rest)).where("not there")
    later = lambda *keys: W.partitionBy("identity", *keys).rowsBetween(1, W.unboundedFollowing)
    slots = both.groupBy("identity", "slot").agg(F.min(F.when(c("there"), c("at"))).alias("first")).withColumn("many", F.floor(c("slot") / SLOTS))
    slots = slots.withColumn("near", F.first("first", ignorenulls=True).over(later("many").orderBy("slot")))
    far = slots.groupBy("identity", "many").agg(F.min("first").alias("first"))
    far = far.withColumn("far", F.first("first", ignorenulls=True).over(later().orderBy("many"))).drop("first")
    found = own.join(slots.join(far, ["identity", "many"]).select("identity", "slot", "near", "far"), ["identity", "slot"])
    return found.select("identity", (c("at") - window_ms).alias("ms"), F.coalesce("next", "near", "far").alias("next"))


def window_begins(times: DataFrame, window_ms: int) -> DataFrame:
    """(identity, ms) of the times with which windows begin: an identity's first, and of each that begins one the first that
    is window_ms or more later. `times` are (identity, ms), all different.

    A time after a pause of a whole window begins one, whatever was before. From these all others are reached by jumps: the
    table of next begins is joined with itself, so that its jumps span 1, 2, 4, ... windows, and each jump doubles how far
    is known, until it reaches nothing new. That is a logarithm of joins, of however many requests of however few identities.
    """
    c = F.col
    slotted = times.withColumn("slot", F.floor(c("ms") / window_ms))
    ends = slotted.groupBy("identity", "slot").agg(F.min("ms").alias("ms"), F.max("ms").alias("last"))
    before = ends.select("identity", (c("slot") + 1).alias("slot"), c("last").alias("before"))
    # slots are as long as windows, so only the first time of a slot can come after a pause
    found = settled(ends.join(before, ["identity", "slot"], "left").where(c("before").isNull() | (c("ms") - c("before") >= window_ms)).select("identity", "ms"))
    known = found.select("identity", c("ms").alias("next"))
    jumps = settled(_with_next(slotted, window_ms).where("next is not null").join(known, ["identity", "next"], "left_anti"))
    while True:
        new = found.join(jumps, ["identity", "ms"]).select("identity", c("next").alias("ms")).distinct()
        new = settled(new.join(found, ["identity", "ms"], "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        jumps = settled(jumps.withColumnRenamed("next", "mid").join(jumps.select("identity", c("ms").alias("mid"), "next"), ["identity", "mid"]).select("identity", "ms", "next"))


def rate_limited(requests: DataFrame, limit: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """`requests` (identity, ts, seq) with boolean allowed, int retry_after (seconds, of those that aren't).

    A window begins with the first request that no window holds and ends window_ms later; the limit's excess in it is
    turned away. A request's window began in its own slot of a window's length or in the one before, each of which has one
    beginning at most: so requests are joined with beginnings by slot, and numbered within one window. Null identities are
    one; requests without a time are turned away by no rule and have null results.
    """
    c = F.col
    rows = requests.withColumn("__ms", F.unix_millis("ts")).withColumn("__slot", F.floor(c("__ms") / window_ms)).withColumn("__who", F.to_json(F.struct("identity")))
    times = rows.where("__ms is not null").select(c("__who").alias("identity"), c("__ms").alias("ms")).distinct()
    begins = window_begins(times, window_ms).select(c("identity").alias("__who"), F.floor(c("ms") / window_ms).alias("__slot"), c("ms").alias("__own"))
    earlier = begins.select("__who", (c("__slot") + 1).alias("__slot"), c("__own").alias("__before"))
    placed = rows.join(begins, ["__who", "__slot"], "left").join(earlier, ["__who", "__slot"], "left")
    placed = placed.withColumn("__begin", F.when(c("__own") <= c("__ms"), c("__own")).otherwise(c("__before")))
    numbered = placed.withColumn("__n", F.when(c("__ms").isNotNull(), F.row_number().over(W.partitionBy("__who", "__begin").orderBy("__ms", "seq"))))
    wait = F.ceil((c("__begin") + window_ms - c("__ms")) / 1000).cast("int")
    out = numbered.withColumn("allowed", c("__n") <= limit).withColumn("retry_after", F.when(c("__n") > limit, F.greatest(wait, F.lit(1))))
    return out.select(*requests.columns, "allowed", "retry_after")


def rate_limit_stream(requests: DataFrame, limit: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """rate_limited() over a stream: the state of an identity is its window's begin and count, dropped after two idle windows."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, n = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        ms = rows.ts.astype("datetime64[ms]").astype("int64").to_numpy()
        number, begins, at = np.zeros(len(ms), np.int64), np.zeros(len(ms), np.int64), 0
        while at < len(ms):  # window by window
            if begin < 0 or ms[at] - begin >= window_ms:
                begin, n = int(ms[at]), 0
            to = max(at + 1, int(np.searchsorted(ms, begin + window_ms)))
            number[at:to], begins[at:to] = np.arange(n + 1, n + 1 + to - at), begin
            n, at = n + to - at, to
        wait = np.maximum(1, -((ms - begins - window_ms) // 1000))
        out = pd.DataFrame({"identity": key[0], "seq": rows.seq.to_numpy(), "allowed": number <= limit, "retry_after": pd.Series(wait, dtype="Int64").where(number > limit)})
        state.update((begin, n))
        state.setTimeoutDuration(2 * window_ms)
        yield out

    return requests.groupBy("identity").applyInPandasWithState(run, "identity string, seq long, allowed boolean, retry_after long", "begin long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def moving_average(rows: DataFrame, key: str, order: str, value: str, keep: float = 0.9, chunk: int = 256) -> DataFrame:
    """`rows` with double ema: x <- keep * x + (1 - keep) * value in order, from 0. Null keys are one.

    n steps in a row are the map x -> keep^n * x + e, and such maps compose. Rows are dealt by ranges of key and order, so
    that a key's rows are in as many tasks as they need; each range is cut into chunks. Within a chunk the closed form
    keep^i * sum((1 - keep) * keep^-k * v_k) is used, which would overflow in longer ones; then the chunks of a range are
    composed, the ranges of a key, and the x with which each chunk begins is carried back to its rows.
    """
    c, k = F.col, F.lit(keep)
    spread = settled(rows.withColumn("__who", F.to_json(F.struct(key))).repartitionByRange("__who", order).withColumn("__p", F.spark_partition_id()))
    out = spread.withColumn("__k", F.row_number().over(W.partitionBy("__who", "__p").orderBy(order)) - 1)
    out = out.withColumn("__c", F.floor(c("__k") / chunk)).withColumn("__i", c("__k") % chunk + 1)
    within = W.partitionBy("__who", "__p", "__c").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("__e", F.pow(k, c("__i")) * F.sum((1 - keep) * F.pow(k, -c("__i")) * c(value)).over(within))

    def composed(maps: Column, x: Column) -> Column:
        """struct(x behind all maps, array of (at, x before the map of that number))."""
        none = F.array().cast("array<struct<at:bigint,x:double>>")
        return F.aggregate(maps, F.struct(x.alias("x"), none.alias("before")), lambda s, m: F.struct((F.pow(k, m["n"]) * s["x"] + m["e"]).alias("x"), F.concat(s["before"], F.array(F.struct(m["at"].alias("at"), s["x"].alias("x")))).alias("before")))

    def gathered(at: str) -> Column:
        return F.array_sort(F.collect_list(F.struct(c(at).cast("bigint").alias("at"), "n", "e"))).alias("maps")

    chunks = out.groupBy("__who", "__p", "__c").agg(F.count("*").alias("n"), F.max_by("__e", "__i").alias("e")).groupBy("__who", "__p").agg(gathered("__c"), F.sum("n").alias("n"))
    chunks = settled(chunks.withColumn("e", composed(c("maps"), F.lit(0.0))["x"]))
    ranges = chunks.groupBy("__who").agg(gathered("__p")).select("__who", F.explode(composed(c("maps"), F.lit(0.0))["before"]).alias("b")).select("__who", c("b.at").cast("int").alias("__p"), c("b.x").alias("__x"))
    begins = chunks.join(ranges, ["__who", "__p"]).select("__who", "__p", F.explode(composed(c("maps"), c("__x"))["before"]).alias("b")).select("__who", "__p", c("b.at").alias("__c"), c("b.x").alias("__x"))
    return out.join(begins, ["__who", "__p", "__c"]).select(*rows.columns, (c("__e") + F.pow(k, c("__i")) * c("__x")).alias("ema"))


def extract_stream(events: DataFrame, write: Callable[[DataFrame, int], None], every: str = "30 seconds", **options: str) -> StreamingQuery:
    """Insights of each micro-batch of events, handed to `write`. A source's own rate option bounds a batch."""

    def batch(rows: DataFrame, number: int) -> None:
        write(drawn(rows), number)

    return events.writeStream.foreachBatch(batch).trigger(processingTime=every).options(**options).start()


def files_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 5) -> DataFrame:
    """Parquet files as a stream, so many in a micro-batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def expiry_stream(seen: DataFrame) -> DataFrame:
    """(id, expired_at) of each memory as it expires, from a stream of (id, last_seen_at, ttl_days): its state is the latest
    time it was seen and its days to live then, and goes when these have passed without another sight of it. A ttl of 0
    or less never ends, without one it is 180 days."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, days = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "expired_at": [pd.Timestamp(last + days * DAY_MS, unit="ms")]})
            return
        last, days = state.get if state.exists else (-1, 0)
        for batch in batches:
            for at, ttl in zip(batch.last_seen_at, batch.ttl_days, strict=True):
                ms = int(pd.Timestamp(at).value // 1_000_000)
                if ms >= last:
                    last, days = ms, 180 if pd.isna(ttl) else int(ttl)
        state.update((last, days))
        if days > 0:  # strictly after the ttl, and after what the stream has seen already
            state.setTimeoutTimestamp(max(last + days * DAY_MS, state.getCurrentWatermarkMs() + 1))

    marked = seen.withWatermark("last_seen_at", "0 seconds")
    return marked.groupBy("id").applyInPandasWithState(run, "id string, expired_at timestamp", "last long, days long", "append", GroupStateTimeout.EventTimeTimeout)


#: How long a session is kept after its last event.
KEPT_MS = 30 * DAY_MS
SESSION = ["tenant_id", "app_id", "actor_id", "session_id"]


def sessions(events: DataFrame) -> DataFrame:
    """(session keys, n, last_ts, topics) of each session of a table of events: what sessions_stream() says last of it."""
    low = F.lower("content")
    order = F.struct("ts", "seq")
    first = [F.min(F.when(X.contains_any(low, *parts), order)).alias(f"t{i}") for i, parts in enumerate(P.TOPICS.values())]
    per = events.groupBy(*SESSION).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), *first)
    named = F.array_compact(F.array(*(F.when(F.col(f"t{i}").isNotNull(), F.struct(F.col(f"t{i}.ts").alias("ts"), F.col(f"t{i}.seq").alias("s"), F.lit(i).alias("i"), F.lit(t).alias("t"))) for i, t in enumerate(P.TOPICS))))
    return per.select(*SESSION, "n", "last_ts", P.topics_joined(F.transform(F.array_sort(named), lambda x: x["t"])).alias("topics"))


class _Sessions(StatefulProcessor):
    """Of each session its number of events, its last time, and each topic's first event; a timer that goes off KEPT_MS after the
    last event drops them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint, last bigint")
        self.topics = handle.getMapState("topics", "place int", "ts bigint, seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get() if self.seen.exists() else (0, -1)
        first = {place[0]: tuple(at) for place, at in self.topics.iterator()}
        before = dict(first)
        for batch in rows:
            ms, low = batch.ts.astype("datetime64[ms]").astype("int64"), batch.content.fillna("").str.lower()
            n, last = n + len(batch), max(last, int(ms.max()))
            for i, parts in enumerate(P.TOPICS.values()):
                hit = low.map(lambda x: any(p in x for p in parts))  # noqa: B023
                if hit.any():
                    at = min(zip(ms[hit].tolist(), batch.seq[hit].tolist(), strict=True))
                    first[i] = min(at, first.get(i, at))
        for i, at in first.items():
            if before.get(i) != at:
                self.topics.updateValue((i,), at)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + KEPT_MS)
        self.seen.update((n, last))
        said = ", ".join(list(P.TOPICS)[i] for i, _ in sorted(first.items(), key=lambda x: (*x[1], x[0]))) or P.NO_TOPIC
        yield pd.DataFrame({**{k: [v] for k, v in zip(SESSION, key, strict=True)}, "n": [n], "last_ts": [pd.Timestamp(last, unit="ms")], "topics": [said], "dropped": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get()
        self.seen.clear()
        self.topics.clear()
        yield pd.DataFrame({**{k: [v] for k, v in zip(SESSION, key, strict=True)}, "n": [n], "last_ts": [pd.Timestamp(last, unit="ms")], "topics": [None], "dropped": [True]})

    def close(self) -> None:
        pass


def sessions_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(session keys, n, last_ts, topics, dropped) of each session at every micro-batch that has events of it, in update mode;
    and once with dropped = true, as its state goes, when the watermark is 30 days past its last event. Events may come
    `late`. Its state needs the session's state store to be RocksDB: with_rocksdb() starts a query with it."""
    marked = events.withWatermark("ts", late)
    kinds = "tenant_id string, app_id string, actor_id string, session_id string, n bigint, last_ts timestamp, topics string, dropped boolean"
    return marked.groupBy(*SESSION).transformWithStateInPandas(_Sessions(), kinds, "Update", "eventTime")


def with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """A query that start() starts, with RocksDB as its state store; the session's own setting is as before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def ingest_stream(observations: DataFrame, engine: Engine, quarantine: str | None = None, **options: str) -> StreamingQuery:
    """Each micro-batch is ingested into the engine's store, where what came in earlier batches takes part; batches run
    one after the other, so batches leave what one ingest of all leaves. Invalid rows go to Parquet files below
    `quarantine`, if given, in a folder for each batch, with their errors.

    A batch that is run again after a failure changes nothing: its number is kept in the store's version with its memories,
    by the stream's own id, which stays with the checkpoint, and its quarantine folder is written anew.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId") or options.get("checkpointLocation", "stream")
        if quarantine is not None:
            Engine.rejected(rows).write.mode("overwrite").parquet(f"{quarantine.rstrip('/')}/batch={number}")
        engine.ingest(rows, strict=False, batch=(stream, number))

    return observations.writeStream.foreachBatch(batch).options(**options).start()
