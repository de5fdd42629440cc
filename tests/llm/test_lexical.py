from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkrecall.llm import lexical as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=10):
    """Every item's scores of all documents, by the formula."""
    counts = [(key, Counter(terms(t))) for key, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key) in enumerate(sorted(scores)[:k])]
    return out


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("texts", [["", None, "  ,. ", "a"], ["Ab-cD é ÀB_x1 日本 \x00z\x7f!", "K ſ"], ["x" * 100, "A.b,C"]])
def test_terms(texts):
    for given in (pa.array(texts), pa.array([None, "zz", *texts, "q"]).slice(2, len(texts))):
        flat, of = S.terms_of(given)
        assert list(zip(of.tolist(), flat.to_pylist(), strict=True)) == [(i, t) for i, x in enumerate(texts) for t in terms(x)]


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9], np.int64)
    assert S.lengths(n, 10**13, 7 * 10**12).tolist() == [25 + 75 * int(x) * 10**13 // (7 * 10**12) for x in n]
    assert S.lengths(np.array([3, 0]), 2, 3).tolist() == [175, 25]


def test_ties_at_the_last_place():
    keys = pa.array([9, None, 3, 5, 1, 7], pa.int64())
    assert S.best(np.array([4, 4, 4, 0, 8, 4]), keys, 3).tolist() == [4, 2, 5]
    assert S.best(np.array([4, 4, 0, 0, 0, 0]), keys, 3).tolist() == [0, 1]
    assert S.best(np.zeros(6, np.int64), keys, 3).tolist() == []


@pytest.mark.parametrize(("shard_bytes", "block_bytes"), [(1 << 24, 1 << 22), (300, 600), (1, 1 << 22)])
def test_against_the_formula(spark, shard_bytes, block_bytes):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "Of", "é", *(f"w{rng.randint(0, 60)}" for _ in range(3))])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 9, 40])))) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [(None, docs[7][1]), (7, docs[9][1]), (900, None), (901, "the " * 3000)]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)] + [(50, docs[3][1]), (51, "nowhere"), (52, None), (53, ""), (None, "the w1 w1 W2")]
    index = S.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), shard_bytes=shard_bytes)
    got = rows(S.search(index, spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes))
    assert got == sorted(ranked(docs, items), key=repr) and len(got) > 100
    assert (index.documents, index.terms) == (sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs))


def test_odd_rows(spark, odd, none):
    items = [(1, "alpha one text"), (1, "alpha one text"), (2, "long line"), (3, "é 日本語 it")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, score int, rank int")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(S.search(S.build_index(odd), asked)) == sorted(ranked(docs, dict.fromkeys(items)), key=repr)
    assert rows(S.search(S.build_index(none), asked)) == []
    assert rows(S.search(S.build_index(odd), asked.limit(0))) == []
    assert len(rows(S.search(S.build_index(odd), asked, k=1))) == 3
    named = S.search(S.build_index(odd.withColumnRenamed("doc_id", "n"), key="n"), asked.withColumnRenamed("item_id", "q"), item="q", key="n")
    assert named.columns == ["q", "rank", "n", "score"]
