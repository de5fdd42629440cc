"""Ranked lexical search: document-sharded postings in compressed sparse rows, with integer impacts.

The index deals documents into shards, where they lie: a task cuts its rows into stretches of bounded bytes and writes one
row for each, so building it shuffles nothing. A shard has its documents' keys, its terms, and for each term the documents
that hold it and their impacts, (1e9 * tf) div (1000 * tf + 8 * m), which need the corpus's sizes but no query. A term's
weight goes with the query, since it needs the term's documents in all shards.

A search goes through the shards twice for each block of queries: once for how many documents hold the queries' terms
(no postings are read for that), once for scores. A shard's scores are added up term at a time in a dense array with one
place for each document, and its best k are chosen with argpartition, documents as good as the k-th by their keys. Tasks
merge the choices of their shards, and a ranking of these gives the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, merged, new_folder, stretches, trim

#: A term as the contract has it: digits, ASCII letters and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Each byte of UTF-8 as it stands in a term, A-Z in lower case; blanks for all that ends one.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of text in a shard (a longer text is a shard of its own), and of queries' texts in a block.
SHARD, BLOCK = 1 << 24, 1 << 22


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms, one text's after the other's, and the number of the text each is from. Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    # every byte is replaced by one byte, so the texts' places stay; bytes of a character beyond ASCII stay as they are
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(_BYTES))
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, plain], 0, texts.offset))
    flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)  # blanks at either end make empty strings
    return flat.filter(real), of[real.to_numpy(zero_copy_only=False)]


def lengths(n: np.ndarray, documents_: int, terms: int) -> np.ndarray:
    """m of documents with n terms each: 100 - 75 + ((75 * n * documents) div terms)."""
    if len(n) and int(n.max()) * 75 * documents_ >= 1 << 62:
        return np.array([25 + 75 * int(x) * documents_ // terms for x in n], np.int64)
    return 25 + 75 * n.astype(np.int64) * documents_ // max(terms, 1)


def weight(documents_: int, held_by: int) -> int:
    return math.floor(1000 * math.log((2 * documents_ + 2) / (2 * held_by + 1)))


def shard_of(keys: pa.Array, texts: pa.Array, documents_: int, terms: int) -> pa.RecordBatch:
    """One row: keys, terms, and for each term where its postings begin; the postings' documents and impacts as int32."""
    flat, of = terms_of(texts)
    coded = flat.dictionary_encode()
    n = len(texts)
    m = lengths(np.bincount(of, minlength=n), documents_, terms)
    place, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + of, return_counts=True)
    doc = place % n
    impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    starts = np.searchsorted(place // n, np.arange(len(coded.dictionary) + 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys),
            pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
            pa.array([starts.astype("<i4").tobytes()], pa.binary()),
            pa.array([doc.astype("<i4").tobytes()], pa.binary()),
            pa.array([impacts.astype("<i4").tobytes()], pa.binary()),
        ],
        names=["keys", "terms", "starts", "docs", "impacts"],
    )


@dataclass
class Index:
    """Shards, how many documents have a term, and how many terms they have."""

    shards: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD, path: str | None = None) -> Index:
    """The index of every row of `docs`, written as Parquet to `path`, or else to the shared folder until the application ends.

    Each row is a document of its own, also where keys are null or repeat. Null and empty texts are in no posting. Other
    columns are ignored. Impacts are below 2^31 at any size; a task holds one shard's terms at a time.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spark, kind = docs.sparkSession, docs.schema["key"].dataType.simpleString()
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    have, terms = docs.agg(F.count_if(n > 0), F.coalesce(F.sum(n), F.lit(0))).first()
    bounded_batches(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, shard_bytes):
            for at, rows in stretches(batch.column(1), shard_bytes):
                yield shard_of(batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), have, terms)
        trim()

    path = path or new_folder(spark, "postings")
    shards = docs.mapInArrow(cut, f"keys array<{kind}>, terms array<string>, starts binary, docs binary, impacts binary")
    shards.write.option("parquet.block.size", 2 * shard_bytes).parquet(path)  # a reader holds a row group
    return Index(spark.read.schema(shards.schema).parquet(path), have, terms)


def best(scores: np.ndarray, keys: pa.Array, k: int) -> np.ndarray:
    """The places of the k highest scores above 0, highest first, equal ones by ascending key, nulls last."""
    some = np.nonzero(scores > 0)[0]
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        above, equal = some[scores[some] > least], some[scores[some] == least]
        equal = equal[pc.sort_indices(keys.take(pa.array(equal)), null_placement="at_end").to_numpy()]
        some = np.concatenate((above, equal[: k - len(above)]))
    some = some[pc.sort_indices(keys.take(pa.array(some)), null_placement="at_end").to_numpy()]
    return some[np.argsort(-scores[some], kind="stable")]


def _known(shard_terms: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places among the shard's terms of those asked, and their numbers among the asked ones."""
    number = pc.fill_null(pc.index_in(shard_terms, value_set=asked), -1).to_numpy(zero_copy_only=False)
    at = np.nonzero(number >= 0)[0]
    return at, number[at]


def _held_by(index: Index, asked: pa.Array) -> np.ndarray:
    """In how many documents each term stands. Tasks give one row for each term they know."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, number = _known(batch.column(0)[i].values, asked)
                starts = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4")
                total[number] += starts[at + 1] - starts[at]
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["term", "n"])
        trim()

    out = np.zeros(len(asked), np.int64)
    for r in index.shards.select("terms", "starts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a block's terms
        out[r.term] = r.n
    return out


def _searched(index: Index, texts: pa.Array, k: int) -> DataFrame:
    """(query, key, score): each query's best k of each task; query is the place among the texts."""
    flat, of = terms_of(texts)
    coded = flat.dictionary_encode()
    asked = coded.dictionary.cast(pa.string())
    held_by = _held_by(index, asked)
    weights = np.array([weight(index.documents, int(n)) for n in held_by], np.int64)
    # a query's terms, each with its weight times its occurrences
    wanted: list[dict[int, int]] = [{} for _ in range(len(texts))]
    for (query, term), n in Counter(zip(of.tolist(), coded.indices.to_pylist(), strict=True)).items():
        if held_by[term] and weights[term] > 0:
            wanted[query][term] = n * int(weights[term])
    shared = index.shards.sparkSession.sparkContext.broadcast((asked, wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = shared.value
        found: dict[int, tuple[np.ndarray, pa.Array]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                keys, terms, starts, docs, impacts = (batch.column(c)[i] for c in range(5))
                keys = keys.values
                starts, docs, impacts = (np.frombuffer(x.as_buffer(), "<i4") for x in (starts, docs, impacts))
                place = np.full(len(asked), -1, np.int64)
                at, number = _known(terms.values, asked)
                place[number] = at
                scores = np.zeros(len(keys), np.int64)
                for query, own in enumerate(wanted):
                    scores[:] = 0
                    for term, w in own.items():
                        if (p := place[term]) >= 0:
                            cut = slice(starts[p], starts[p + 1])
                            scores[docs[cut]] += w * impacts[cut].astype(np.int64)  # a term's documents differ
                    top = best(scores, keys, k)
                    if len(top):
                        s, names = scores[top], keys.take(pa.array(top))
                        if query in found:
                            s, names = np.concatenate((found[query][0], s)), pa.concat_arrays([found[query][1], names])
                            top = best(s, names, k)
                            s, names = s[top], names.take(pa.array(top))
                        found[query] = s, names
        for query, (s, names) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(s), pa.int64()), names, pa.array(s)], names=["query", "key", "score"])
        trim()

    kind = index.shards.schema["keys"].dataType.elementType.simpleString()
    return index.shards.mapInArrow(search, f"query bigint, key {kind}, score bigint")


def search(index: Index, queries: DataFrame, item: str = "item_id", text: str = "text", k: int = 10, key: str = "doc_id", block_bytes: int = BLOCK) -> DataFrame:
    """(item, rank, key, score): of each item the k highest scores above 0, equal ones by ascending key, null keys last.

    The terms of an item, which may be null, are those of all texts of its rows, rows equal in item and text counted once;
    null texts have none. Items without a document that holds one of their terms give no rows. Queries are searched in
    blocks of about block_bytes of texts, or of one item; a block is all of them that is on the driver or broadcast.
    """
    texts = queries.select(F.col(item).alias("item"), F.coalesce(text, F.lit("")).alias("text")).distinct()
    size, items = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.count_distinct(F.struct("item"))).first()
    blocks = min(-(-size // block_bytes), items)
    kinds = queries.schema[item].dataType.simpleString(), index.shards.schema["keys"].dataType.elementType.simpleString()
    spark = queries.sparkSession
    out = spark.createDataFrame([], f"item {kinds[0]}, key {kinds[1]}, score bigint")
    for b in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")).orderBy("item").toArrow()
        if own.num_rows:
            names = spark.createDataFrame([(i, x) for i, x in enumerate(own.column("item").to_pylist())], f"query bigint, item {kinds[0]}")
            found = _searched(index, own.column("text").combine_chunks().cast(pa.string()), k)
            out = out.unionByName(found.join(F.broadcast(names), "query").select("item", "key", "score"))
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))))
    return ranked.where(F.col("rank") <= k).select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def op11_csr_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(documents(spark, sf_dir))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
