"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features say whether a text holds an n-gram (of the lower-cased bytes, n = 4, 6 and 8, hashed; letters beyond ASCII have two
bytes and more, so that shorter ones would tell compounds of other languages badly apart). A feature's ratio r is the log of
how much likelier toxic training texts hold it than others. Features whose counts differ by chance only are left out; over
the others a logistic regression is trained on r times the feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, lowest, materialize, trim

BITS = 22
ORDERS = (4, 6, 8)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def features(text: str | None) -> np.ndarray:
    """Hashes of every n-gram, repeats included. White space counts as one blank; one stands at either end."""
    x = np.frombuffer(b" " + b" ".join((text or "").encode().lower().split()) + b" ", np.uint8).astype(np.uint64)
    out = []
    for n, factor in zip(ORDERS, _FACTORS, strict=True):
        if len(x) >= n:
            v = x[: len(x) - n + 1].copy()
            for i in range(1, n):
                v |= x[i : len(x) - n + 1 + i] << np.uint64(8 * i)
            v *= np.uint64(factor)
            out.append((v >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    """Weights of some features, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    @cached_property
    def table(self) -> np.ndarray:
        """2^BITS weights, made where they are looked up."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.features] = self.weights
        return out

    def score(self, text: str | None) -> float:
        f = features(text)
        f = np.unique(f[self.table[f] != 0])
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.table[f].sum(dtype=np.float64), -50, 50))))


def ratios(p: np.ndarray, q: np.ndarray, pos: float, neg: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratio, z) of features held by p of pos toxic texts and q of neg others. z: by how many deviations the toxic
    texts that hold it are more than their share."""
    r = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))
    share = (p + q) / (pos + neg)
    z = (p - share * pos) / np.sqrt(np.maximum(share * (1 - share) * pos * neg / (pos + neg), 1e-9))
    return r, z


def fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, scale: np.ndarray, penalty: float = 0.1, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on `scale` times the features: text rows[i] holds feature columns[i]."""
    n, value = len(y), scale[columns]
    b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 1.5)))
    w = np.zeros(len(scale))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)  # Adam over all texts at once
    for step in range(1, steps + 1):
        margin = b + np.bincount(rows, value * w[columns], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y) / n
        grad = np.append(np.bincount(columns, value * error[rows], minlength=len(scale)) + penalty * w / n, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w * scale, b


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 6000, most_bytes: int = 1 << 26, least_texts: int = 3, least_z: float = 3.0, most_features: int = 40_000) -> Model:
    """The model of about `most_rows` labelled documents that aren't held out, those with low hashes of their keys, and of
    no more than `most_bytes` of text (by hash, until they are reached). Of a key with several labels the largest counts;
    rows without a label don't. Without any toxic or any other text: no weights, the smoothed share as the score.

    The tasks count in how many texts each feature is; which differ by more than chance is decided on the sums, and the
    tasks look these up in the texts again. What reaches the driver is the documents' hashes and sizes, the chosen
    features, at most `most_features`, and which document holds which of them.
    """
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where(~held_out("key"))
    known = own.groupBy("key").agg(F.max("y").alias("y"))
    chosen = known.where(F.xxhash64("key") <= lowest(most_rows, known.count()))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").withColumn("h", F.xxhash64("key", "text"))
    sizes = rows.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("h").limit(2 * most_rows).collect()  # keys that repeat don't grow it
    within = int(np.searchsorted(np.cumsum([r.n for r in sizes]), most_bytes, side="right"))
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(0.5 / 1.5)))
    if not within:
        return none
    bounded_batches(docs.sparkSession)
    # rows equal in key and text are one
    picked = materialize(rows.where(F.col("h") <= sizes[within - 1].h).dropDuplicates(["h"]).select("h", "y", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (p if y else q)[np.unique(features(t.as_py()))] += 1
        held = np.nonzero(p + q)[0]
        for at in range(0, len(held), 1 << 18):
            some = held[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(p[some]), pa.array(q[some])], names=["f", "p", "q"])
        del p, q, held
        trim()

    labels_ = picked.agg(F.sum(F.when(F.col("y") != 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = float(labels_.pos), float(labels_.n - labels_.pos)
    none.bias = float(np.log((pos + 0.5) / (neg + 1.5)))
    if not pos or not neg:
        return none
    c = F.col
    share = (c("p") + c("q")) / (pos + neg)
    z = F.abs(c("p") - share * pos) / F.sqrt(F.greatest(share * (1 - share) * pos * neg / (pos + neg), F.lit(1e-9)))
    counts = picked.select("y", "text").mapInArrow(count, "f int, p int, q int").groupBy("f").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    strong = counts.where(c("p") + c("q") >= least_texts).withColumn("z", z).where(c("z") >= least_z)
    some = strong.orderBy(F.desc("z"), "f").limit(most_features).select("f", "p", "q").toPandas().sort_values("f")
    if not len(some):
        return none
    kept = some.f.to_numpy().astype(np.int64)
    scale = ratios(some.p.to_numpy().astype(np.float64), some.q.to_numpy().astype(np.float64), pos, neg)[0]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[kept] = np.arange(len(kept))
        for batch in batches:
            held = [np.unique(x[x >= 0]) for x in (place[features(t.as_py())] for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype("<i4").tobytes() for x in held], pa.binary())], names=["h", "y", "held"])
        del place
        trim()

    found = picked.select("h", "y", "text").mapInArrow(look, "h bigint, y int, held binary").orderBy("h").collect()
    columns = [np.frombuffer(r.held, "<i4") for r in found]
    y = np.array([r.y for r in found], np.float64)
    weights, bias = fit(np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in columns]), np.concatenate(columns), y, scale)
    return Model(kept, weights.astype(np.float32), float(bias))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with a double column `name`. Null texts score as empty ones do."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")
        trim()

    return docs.withColumn(name, score(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` (with doc_id and text) with held_out, score and predicted; columns of these names are replaced, all others
    stay, whatever their names. The score depends on the text alone, so equal texts score alike. Repeated rows stay. Null
    keys are not held out and have no label. No labels at all: the score is 0.25, predicted 0."""
    model = trained(docs, labels)
    held = docs.drop("held_out", "score", "predicted").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return scored(held, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")
