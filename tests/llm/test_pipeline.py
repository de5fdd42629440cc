from __future__ import annotations

import zlib

import __spark_entry__
import corpus_pipeline as C
from pyspark.sql import functions as F

from tests.llm.test_texts import planted

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [name for name, _ in C.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_stages_on_planted_cases(spark, tmp_path):
    rows = planted(900, 7)
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows], "doc_id bigint, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    long = [" ".join(f"q{j}x{i}" for i in range(300)) for j in range(4)]
    docs += [(1000 + j, f"own line {j}\n{passage}\nand another {j}", "en", "s1", 9) for j in range(3)]
    docs += [(2000, long[0], "en", "s1", 9), (2001, long[0].replace("q0x7 ", "other "), "en", "s1", 9), (2002, long[1], "en", "s2", 9), (2003, long[1], "en", "s2", 9), (2004, None, None, None, None), (2005, "", "en", "s0", 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = C.toxicity(spark, df, str(tmp_path)).persist()
    ids = {r.doc_id for r in kept.collect()}
    bad = {i for i, _, b in rows if b}
    assert len(bad & ids) <= 0.05 * len(bad) and len(ids - bad) >= 0.99 * (len(docs) - len(bad))
    lines = C.line_dedup(spark, kept, str(tmp_path)).persist()
    by = {r.doc_id: r for r in lines.collect()}
    assert passage in by[1000].text and by[1001].text == "own line 1\nand another 1" and by[1001].n_chars == len(by[1001].text)
    assert 2002 in by and 2003 not in by and 2004 in by and 2005 in by  # a copy is nothing but a later copy
    near = C.near_dedup(spark, lines, str(tmp_path)).persist()
    stay = {r.doc_id for r in near.collect()}
    assert 2000 in stay and 2001 not in stay and len(stay & {2004, 2005}) == 1
    mixed = C.mixing_sources(spark, near, str(tmp_path)).persist()
    assert mixed.columns == list(C.COLUMNS) and {r.doc_id for r in mixed.collect()} <= stay
    sizes = {r.source: r.w for r in near.groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("w")).collect()}
    assert mixed.count() > 0 and set(sizes)
    out = C.best_fit_packing(spark, mixed, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in mixed.collect()}
    first = sum(r.piece == 0 for r in out)
    assert first == mixed.count()  # a document taken twice is packed twice
    for d in (kept, lines, near, mixed):
        d.unpersist()


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows are told apart by their texts too; each goes on once, and a repeated row only once."""
    texts = [" ".join(f"{c}{i}" for i in range(100)) for c in "abcdef"]
    docs = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3]), (9, texts[4]), (9, texts[4]), (None, texts[4]), (None, texts[5]), (None, texts[5])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    near = C.near_dedup(spark, df, str(tmp_path)).persist()
    order = lambda x: (x[0] or 0, x[1])
    expected = sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4]), (None, texts[5])], key=order)
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=order) == expected
    mixed = [(r.doc_id, r.text) for r in C.mixing_sources(spark, near, str(tmp_path)).collect()]
    assert set(mixed) <= set(expected) and all(mixed.count(x) <= 2 for x in expected)
    near.unpersist()


def test_repeated_rows_are_mixed_once_each(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([(3, words, "en", s, 1) for s in ("a", "a", "a", "b", None)] + [(None, words, "en", "a", 1)] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = C.mixing_sources(spark, df, str(tmp_path)).groupBy("doc_id", "source").count().collect()
    of = {(r.doc_id, r.source): r["count"] for r in got}
    assert of[(3, "a")] <= 6 and of.get((3, "b"), 0) <= 2 and of.get((None, "a"), 0) <= 4
    assert 9 <= sum(of.values()) <= 12  # 150 % of 7 documents


def test_run(spark):
    rows = C.run(spark, DATA).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= docs
    assert all(1 <= r.length <= 2048 and r.start == 2048 * r.piece for r in rows)
    assert zlib.crc32(b"") == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
