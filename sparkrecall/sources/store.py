"""Where memories are kept: versions of Parquet tables, or one JSON document {version, records}."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.model import MEMORIES, OBSERVATIONS, UTC

VERSION = 1


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the schema of observations; a line that is no JSON has only nulls, which validation turns away. Times
    are in UTC and end in Z; `observed_at_text` keeps them as they were given, which validation needs to tell wrong ones."""
    rows = spark.read.schema(OBSERVATIONS.replace("observed_at timestamp", "observed_at string")).json(path)
    return rows.withColumn("observed_at_text", F.col("observed_at")).withColumn("observed_at", F.when(F.col("observed_at").rlike(UTC), F.try_to_timestamp("observed_at")))


def observations_stream(spark: SparkSession, path: str, per_batch: int = 5) -> DataFrame:
    """Files of JSON lines as a stream of what read_observations() gives, with `broken`: a line that is no JSON, whole."""
    schema = OBSERVATIONS.replace("observed_at timestamp", "observed_at string") + ", broken string"
    rows = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "broken").option("maxFilesPerTrigger", per_batch).json(path)
    return rows.withColumn("observed_at_text", F.col("observed_at")).withColumn("observed_at", F.when(F.col("observed_at").rlike(UTC), F.try_to_timestamp("observed_at")))


def session_folder(spark: SparkSession) -> str:
    """A new folder of this session, below spark.checkpoint.dir; where that is unset and the master is local, a temporary one.
    It is removed when the application ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    path = f"{named.rstrip('/')}/memories-{uuid.uuid4().hex}" if named else "file://" + tempfile.mkdtemp(prefix="memories-")
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def settled(rows: DataFrame) -> DataFrame:
    """`rows` written to a folder of the session and read again: later writes to what they were made of don't matter."""
    path = f"{session_folder(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Versions:
    """Folders of data, of which the one that the pointer file with the highest number names is current.

    A pointer appears by a rename to a name that isn't there yet, after its data are whole, and none is removed before
    a later one stands: a crash at any step leaves the version before. Of two writers that began with one version the
    second fails. The last `keep` versions stay, for what still reads them. A pointer's second line has marks, which come
    and go with its data: of each stream the number of the last batch in them. Its third says, of a table in buckets, in
    which folder each bucket is: a version that changes some of them names the old folders for the others.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        there = self._path(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(there)) if self._fs.exists(there) else []

    def _pointers(self) -> list[str]:
        return [n for n in self._names(f"{self.path}/pointers") if n.isdigit()]

    def _data(self) -> list[str]:
        return [n for n in self._names(self.path) if n.startswith("v=")]

    def _said(self, pointer: str) -> tuple[str, dict, dict]:
        """The folder, the marks and the buckets' folders that a pointer names."""
        lines = self.spark.read.text(f"{self.path}/pointers/{pointer}", wholetext=True).first()[0].split("\n")
        marks, buckets = (json.loads(lines[i]) if len(lines) > i and lines[i] else {} for i in (1, 2))
        return lines[0], marks, buckets

    def _last(self) -> tuple[str, dict, dict]:
        pointers = self._pointers()
        return self._said(pointers[-1]) if pointers else ("-", {}, {})

    def marks(self) -> dict[str, int]:
        return self._last()[1]

    def buckets(self) -> dict[int, tuple[str, bool]]:
        """Of each bucket of the current version that has rows, its folder, and what replace() was told of it."""
        return {int(b): (f"{self.path}/{folder}/bucket={b}", kind) for b, (folder, kind) in self._last()[2].items()}

    def _point(self, number: int, said: str) -> None:
        new = self._path(f"{self.path}/pointers/new-{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(said.encode()))
        out.close()
        to = self._path(f"{self.path}/pointers/{number:020d}")
        if self._fs.exists(to) or not self._fs.rename(new, to):
            self._fs.delete(new, False)
            raise RuntimeError(f"{self.path}: another writer was faster")

    def current(self) -> str | None:
        """The folder of the current version; None if nothing was ever written."""
        pointers = self._pointers()
        if not pointers:
            if self._data():
                raise RuntimeError(f"{self.path}: there are versions but no pointer")
            return None
        name = self._said(pointers[-1])[0]
        return None if name == "-" else f"{self.path}/{name}"

    def _begin(self) -> tuple[list[str], str]:
        """The pointers, of which there is one at least, and the name of a new folder."""
        pointers = self._pointers()
        if not pointers:
            if self._data():
                raise RuntimeError(f"{self.path}: there are versions but no pointer")
            self._point(0, "-")  # so that a first write that breaks off leaves an empty store
            pointers = self._pointers()
        return pointers, f"v={uuid.uuid4().hex}"

    def _end(self, pointers: list[str], name: str, marks: dict, buckets: dict) -> None:
        """Points to a new version, and removes what only pointers beyond the last `keep` name."""
        number = int(pointers[-1]) + 1
        self._point(number, "\n".join((name, json.dumps(marks), json.dumps(buckets))))
        old = [p for p in pointers if int(p) <= number - self.keep]
        if not old:
            return

        def named(those: list[str]) -> set[str]:
            said = [self._said(p) for p in those]
            return {f"{folder}/bucket={b}" for _, _, bs in said for b, (folder, _) in bs.items()} | {n for n, _, bs in said if not bs and n != "-"}

        stay = named([p for p in self._pointers() if p not in old])
        gone = named(old) - stay
        roots = {x.partition("/")[0] for x in gone} - {x.partition("/")[0] for x in stay}
        for x in roots | {x for x in gone if x.partition("/")[0] not in roots}:
            self._fs.delete(self._path(f"{self.path}/{x}"), True)
        for p in old:
            self._fs.delete(self._path(f"{self.path}/pointers/{p}"), False)

    def _save(self, rows: DataFrame, path: str, *parts: str) -> None:
        """Files are ordered by id and have Bloom filters of it, so that a look-up skips most row groups."""
        key = "event_id" if "event_id" in rows.columns else "id"
        rows.sortWithinPartitions(*parts, key).write.partitionBy(*parts).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)

    def write(self, marks: dict[str, int] | None = None, **tables: DataFrame) -> str:
        """A new version with these tables in it, each partitioned by tenant and application, and with further marks; its
        folder."""
        pointers, name = self._begin()
        marks = self._said(pointers[-1])[1] | (marks or {})
        for table, rows in tables.items():
            self._save(rows, f"{self.path}/{name}/{table}", "tenant_id", "app_id")
        self._end(pointers, name, marks, {})
        return f"{self.path}/{name}"

    def replace(self, rows: DataFrame, these: list[int] | None, kind: bool, marks: dict[str, int] | None = None) -> None:
        """A new version of a table with a column `bucket`: `rows` are all that `these` buckets have from now on, or all that
        there are. Files of other buckets stay where they are."""
        pointers, name = self._begin()
        _, before, buckets = self._said(pointers[-1])
        self._save(rows.repartition("bucket", "tenant_id", "app_id"), f"{self.path}/{name}", "bucket", "tenant_id", "app_id")
        kept = {b: x for b, x in buckets.items() if these is not None and int(b) not in these}
        new = {n.partition("=")[2]: (name, kind) for n in self._names(f"{self.path}/{name}") if n.startswith("bucket=")}
        self._end(pointers, name, before | (marks or {}), kept | new)


Derive = Callable[[DataFrame], DataFrame]


#: Buckets of a store. A write costs the buckets that it touches.
BUCKETS = 32


class ParquetStore:
    """Memories in versions: readers see a whole version, and what was read before a write can still be computed after.

    They lie in buckets by what tells duplicates: tenant, application, actor, type and lower-cased text. So an ingest reads
    and writes the buckets of its own texts only. Below these they are partitioned by tenant and application.

    `derive` adds columns that are made of a memory's text. They are stored with the memories and made for those alone that
    are written without them; buckets that were written without them have them made as they are read.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, derive: Derive | None = None):
        self.spark, self.versions, self.derive = spark, Versions(spark, path, keep), derive
        none = spark.createDataFrame([], MEMORIES)
        self.schema = (derive(none) if derive else none).schema

    @staticmethod
    def _bucket() -> Column:
        return F.pmod(F.xxhash64("tenant_id", "app_id", "actor_id", "memory_type", F.lower("text")), F.lit(BUCKETS)).cast("int")

    def touched(self, memories: DataFrame) -> list[int] | None:
        """The buckets that memories are in, or come into."""
        return sorted(r.b for r in memories.select(self._bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The memories, or those of some buckets; of a store that isn't there yet, none."""
        out = self.spark.createDataFrame([], self.schema)
        if self.versions.current() is None:
            return out
        there = [x for b, x in self.versions.buckets().items() if buckets is None or b in buckets]
        whole = [path for path, derived in there if derived or self.derive is None]
        plain = [path for path, derived in there if not derived and self.derive is not None]
        files = self.spark.read.option("basePath", self.versions.path)  # above which folders are no columns
        parts = ([files.schema(self.schema).parquet(*whole)] if whole else []) + ([self.derive(files.schema(MEMORIES).parquet(*plain))] if plain else [])
        return functools.reduce(DataFrame.unionByName, parts).select(*self.schema.names) if parts else out

    def write(self, memories: DataFrame, marks: dict[str, int] | None = None, buckets: list[int] | None = None) -> None:
        """All memories, or all of some buckets."""
        rows = self.whole(memories).select(*self.schema.names).withColumn("bucket", self._bucket())
        self.versions.replace(rows, buckets, self.derive is not None, marks)

    def whole(self, memories: DataFrame) -> DataFrame:
        """`memories` with the derived columns."""
        return memories if set(self.schema.names) <= set(memories.columns) else self.derive(memories)

    def marks(self) -> dict[str, int]:
        return self.versions.marks()


class MemoryStore(ParquetStore):
    """Memories of this session alone, in its own folder: each write cuts the lineage, and a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, derive: Derive | None = None):
        super().__init__(spark, session_folder(spark), derive=derive)


#: Columns of the two layers' tables.
EVENTS = "seq bigint, event_id string, tenant_id string, app_id string, actor_id string, session_id string, ts timestamp, type string, role string, content string, processed boolean"
INSIGHTS = "tenant_id string, app_id string, actor_id string, type string, id string, content string, confidence double, importance double, tags array<string>, extracted_from array<string>, n bigint, last_updated timestamp, `order` struct<seq:bigint,strategy:int,pos:int>"


class LayerStore:
    """Events and insights in versions that hold both, so that no reader sees events without what was drawn from them."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: int = 3):
        self.spark, self.versions = spark, Versions(spark, path or session_folder(spark), keep)

    def read(self) -> tuple[DataFrame, DataFrame]:
        now = self.versions.current()
        if now is None:
            return self.spark.createDataFrame([], EVENTS), self.spark.createDataFrame([], INSIGHTS)
        return self.spark.read.schema(EVENTS).parquet(f"{now}/events"), self.spark.read.schema(INSIGHTS).parquet(f"{now}/insights")

    def marks(self) -> dict[str, int]:
        return self.versions.marks()

    def write(self, events: DataFrame, insights: DataFrame, marks: dict[str, int] | None = None) -> None:
        kind = self.spark.createDataFrame([], INSIGHTS).schema
        typed = insights.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind))
        self.versions.write(marks, events=events.select(*self.spark.createDataFrame([], EVENTS).columns), insights=typed)


class JsonStore:
    """One JSON document {version, records}, for exchange with other systems; one task writes it. Where streams wrote it, it
    has marks as well: of each the number of its last batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def whole(self, memories: DataFrame) -> DataFrame:
        return memories

    def touched(self, memories: DataFrame) -> list[int] | None:
        return None  # one document

    def _there(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def marks(self) -> dict[str, int]:
        found = self.spark.read.schema("marks map<string,bigint>").json(self.path, multiLine=True).first() if self._there() else None
        return dict(found.marks or {}) if found else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        if not self._there():
            return self.spark.createDataFrame([], MEMORIES)
        kind = self.spark.read.json(self.path, multiLine=True).schema
        if "records" not in kind.names or kind["records"].dataType.typeName() != "array":
            raise ValueError("records: an array is expected")
        rows = self.spark.read.schema(f"version int, records array<struct<{', '.join(_fields())}>>").json(self.path, multiLine=True)
        return rows.select(F.explode("records").alias("r")).select("r.*")

    def write(self, memories: DataFrame, marks: dict[str, int] | None = None, buckets: list[int] | None = None) -> None:
        """The document is written beside and takes the old one's place in one rename."""
        record = F.struct(*(F.col(c) for c in memories.columns))
        known = self.marks() | (marks or {})
        said = [F.from_json(F.lit(json.dumps(known)), "map<string,bigint>").alias("marks")] if known else []
        whole = memories.agg(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.array_sort(F.collect_list(record), lambda a, b: F.when(a["ord"] < b["ord"], -1).otherwise(1)).alias("records"), *said)).alias("value"))
        new = f"{self.path}.{uuid.uuid4().hex}"
        whole.coalesce(1).write.text(new)
        context = self.spark.sparkContext
        hadoop, conf = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
        fs = hadoop.Path(new).getFileSystem(conf)
        (part,) = [f.getPath() for f in fs.listStatus(hadoop.Path(new)) if f.getPath().getName().startswith("part-")]
        rename = getattr(context._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = context._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = hadoop.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), conf)
        files.rename(part, fs.makeQualified(hadoop.Path(self.path)), how)
        fs.delete(hadoop.Path(new), True)


def _fields() -> list[str]:
    """The fields of MEMORIES as name:type; commas within <> part no fields."""
    out, depth, now = [], 0, ""
    for ch in MEMORIES:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [f.replace(" ", ":", 1) for f in (*out, now.strip())]
