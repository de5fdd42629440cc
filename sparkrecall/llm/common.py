"""What the corpus operators share: the cluster's shared folder, tables that cut lineage, let-bindings."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts have it: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_own_folders: dict[str, str] = {}
#: Folders that this application made, by its id.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset and the master is local (tests), a temporary folder of this application's own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="sparkrecall-")
    return _own_folders[context.applicationId]


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the application ends, if remove() wasn't told to before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, there = _folder(spark, path)
    fs.deleteOnExit(there)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def folders(spark: SparkSession) -> set[str]:
    """All that new_folder() made in this application and remove() didn't take away."""
    return set(_made.get(spark.sparkContext.applicationId, ()))


def remove(spark: SparkSession, paths: set[str]) -> None:
    """Deletes folders that new_folder() made, whose tables nothing reads any more."""
    made = _made.get(spark.sparkContext.applicationId, [])
    for path in paths & set(made):
        fs, there = _folder(spark, path)
        fs.delete(there, True)
        fs.cancelDeleteOnExit(there)
        made.remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    Cuts the lineage at committed files: a lost executor costs only the tasks that read them, and values that
    depend on the partitioning (ranks, row numbers) are fixed once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than the HOT-th part of the rows is joined by broadcast; fewer than HOT keys can have that.
HOT = 1000


def join_once(rows: DataFrame, table: DataFrame, on: list[str], total: int) -> DataFrame:
    """`rows` (`total` of them) joined with `table`, which has each key once, with n, how many rows have it: no task holds
    all rows of a key. Both are read twice, so they should be written tables."""
    values = [c for c in table.columns if c not in (*on, "n")]
    often = F.col("n") > max(total // HOT, 1)
    few = F.broadcast(table.where(often).select(*on, F.struct(*values).alias("__hot")))
    met = rows.join(few, on, "left")
    hot = met.where("__hot is not null").select(*rows.columns, *(f"__hot.{c}" for c in values))
    cold = met.where("__hot is null").drop("__hot").join(table.where(~often).drop("n"), on).select(*rows.columns, *values)
    return hot.unionByName(cold)


#: Spark's own bound of a batch of rows that goes to Python.
_BATCH, _SPARKS_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Rows go to Python in batches of at most `most` bytes from now on, unless the session has a bound of its own."""
    if spark.conf.get(_BATCH) == _SPARKS_BOUND:
        spark.conf.set(_BATCH, most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` computed once for each row, however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """`text` with A-Z, and only those, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def lowest(wanted: int, of: int) -> int:
    """The signed 64-bit hash at or below which about `wanted` of `of` evenly hashed rows lie; the greatest if that is all."""
    return (1 << 63) - 1 if wanted >= of else -(1 << 63) + (1 << 64) * wanted // of


def stretches(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of at most `most` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to - at
        at = to


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have `least` bytes."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.nbytes for b in some) >= least:
            yield pa.concat_batches(some)
            some = []
    if some:
        yield pa.concat_batches(some)


def trim() -> None:
    """Gives a Python worker's free memory back: workers are kept for the next stage, beside which it would count."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
