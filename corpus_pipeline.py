"""From raw documents to packed training sequences, in stages. Counted as part of sparkrecall.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.llm import linededup, mixing, packing, simhash
from sparkrecall.llm import toxicity as toxic
from sparkrecall.llm.common import folders, new_folder, remove

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from those labels whose documents are among `docs`. Rows with a
    null doc_id are scored like others; null and empty texts are scored as they are; other columns go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxic.toxicity(docs, labels).where("predicted = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages go from the texts; a document of which nothing but blanks is left goes too. Null and empty
    texts stay as they are, and so do rows that share a doc_id with another text."""
    out = linededup.line_dedup(docs.select(*COLUMNS))
    left = (F.col("removed_lines") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.where(left).withColumn("n_chars", F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 or more of their shingles of five words, that with the least doc_id stays.

    A row is told by its doc_id, null last, and its text's hash: rows equal in both are alike, so one of them is enough.
    """
    held = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h")).alias("row"))
    groups = simhash.similar_documents(held, shingle=5, similarity=0.8, key="row")
    stay = groups.where(F.col("row").eqNullSafe(F.col("component_id"))).select("row").distinct()
    kept = held.join(stay.withColumnRenamed("row", "stays"), F.col("row").eqNullSafe(F.col("stays")), "left_semi")
    return kept.dropDuplicates(["row"]).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by training time.

    Rows are told by a hash of all columns: a doc_id may be null or occur with several texts, and of rows equal in every
    column each is taken as often as the mix takes it. Null texts and ones without words are taken never. An empty table
    gives no rows.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("h1"), F.xxhash64(F.lit(1), *COLUMNS).alias("h2"))
    mixed = mixing.curriculum(rows.select("doc_id", "h1", "h2", "source", mixing.n_words(F.col("text")).alias("size"))).select("h1", "h2", F.explode("positions").alias("position"))
    # equal rows are joined once; the mix has a row for each of them
    one = rows.withColumn("n", F.row_number().over(W.partitionBy("h1", "h2").orderBy("h1"))).where("n = 1")
    both = one.join(mixed, ["h1", "h2"])
    return both.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: of every row, whatever its doc_id, which may be null or repeat. Null and empty texts are
    one id. An empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_sources),
    ("packing", best_fit_packing),
]

#: A trained model, connected components and a packing are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written as Parquet and read again as the next one's docs. What a stage wrote
    on its way, and what it read, goes when its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = folders(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        remove(spark, folders(spark) - before - {path})
    return docs
