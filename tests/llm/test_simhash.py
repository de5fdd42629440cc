from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkrecall.llm import simhash as S
from sparkrecall.llm.components import components


def naive(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, " \t", "a", "A b", "a b c", "The quick brown fox jumps over the lazy dog again and again and again", "x y " * 700])
def test_fingerprint(text):
    assert S.fingerprint_of(text) % (1 << 64) == naive(text, 3)


def test_hash_is_that_of_spark(spark):
    assert spark.sql("select xxhash64('abc def ghi')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"abc def ghi", 42)).astype(np.int64)


def roots(fps, bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin((a ^ b) % (1 << 64)).count("1") <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("bits", [1, 2, 3])
@pytest.mark.parametrize("block_rows", [512, 4])
def test_links_connect_what_brute_force_links(spark, bits, block_rows):
    """Around some centres a dense ball each; block_rows 4 sends them through common points instead of pairs."""
    rng = random.Random(bits)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            fps.add(f - (1 << 64) if f >> 63 else f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = S.links(df, bits, block_rows)
    wrong = links.where(S.distance(F.col("a"), F.col("b")) > bits).count()
    assert wrong == 0
    got = {f: f for f in fps} | {r.node: r.component for r in components(links).collect()}
    expected = roots(fps, bits)
    assert len({(got[f], expected[f]) for f in fps}) == len(set(got.values())) == len(set(expected.values()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(parent))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_odd_rows(odd, none):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16
    assert {by[i].component_id for i in (2, 3, 4)} == {2} and by[5].component_id == 1
    assert S.near_duplicates(none).count() == 0
    assert S.similar_documents(none).count() == 0
    assert S.similar_documents(odd).count() == odd.count()


@pytest.mark.parametrize(("block_rows", "task_rows"), [(64, 4096), (2, 4096), (2, 3)])
def test_similar_documents(spark, block_rows, task_rows):
    """Copies with some words changed; similarity by brute force decides, but for what bands may miss."""
    rng = random.Random(4)
    docs = []
    for g in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        for c in range(4):
            own = list(words)
            for i in rng.sample(range(200), c):
                own[i] = f"z{rng.randint(0, 10**6)}"
            docs.append((g * 10 + c, " ".join(own)))
    docs += [(10_000 + i, docs[0][1]) for i in range(90)]  # a block of equal texts
    got = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), block_rows=block_rows, task_rows=task_rows).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(196)} for k, t in docs}
    alike = total = 0
    for a, _ in docs[:240]:
        for b, _ in docs[:240]:
            if a < b:
                j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if j >= 0.8:
                    total += 1
                    alike += got[a] == got[b]
                elif j < 0.5:
                    assert got[a] != got[b]
    assert total > 100 and alike / total > 0.95
    assert {got[10_000 + i] for i in range(90)} == {got[0]}


def test_recall_and_precision_in_large_groups(spark):
    """One group of 300 near copies and 40 of 8, in blocks above and below the limits: the components are the same
    whatever block_rows and task_rows are; links are those of brute force but for few, and none else."""
    rng = random.Random(6)
    docs, width = [], 120
    for g in range(41):
        words = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(width)]
        for c in range(300 if g == 0 else 8):
            own = list(words)
            for i in rng.sample(range(width), rng.randint(0, 6)):
                own[i] = f"z{rng.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(width - 4)} for k, t in docs}
    alike = [(a, b) for a in sets for b in sets if a < b and (a < 300) == (b < 300) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in alike:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    truth = [root(x) for x in range(len(docs))]
    before = None
    for block_rows, task_rows in ((10_000, 10_000), (8, 4096), (8, 12), (64, 100)):
        got = {r.doc_id: r.component_id for r in S.similar_documents(df, block_rows=block_rows, task_rows=task_rows).collect()}
        assert before is None or got == before
        before = got
    assert sum(got[a] == got[b] for a, b in alike) / len(alike) > 0.95
    assert all(truth[x] == truth[got[x]] for x in got)  # what is joined is connected by brute force: no wrong link


def test_every_two_nodes_of_a_large_block_meet(spark):
    """A node near the block's least one and another near only that node: their link was never looked at."""
    blocks = spark.createDataFrame([(i, key, n) for key, n in ((1, 3), (2, 40)) for i in range(n)], "node bigint, key bigint, n bigint")
    met = S.sub_blocks(blocks, 6).groupBy("key", "i", "j").agg(F.collect_list("node").alias("nodes")).collect()
    for key, n in ((1, 3), (2, 40)):
        seen = {(a, b) for r in met if r.key == key for a in r.nodes for b in r.nodes if a < b}
        assert seen == {(a, b) for a in range(n) for b in range(a + 1, n)}
    assert all(len(r.nodes) == len(set(r.nodes)) for r in met) and max(len(r.nodes) for r in met) < 20


def test_chain_in_a_large_block(spark, monkeypatch):
    """Texts that differ from the next in a few words each, all in one block: one component, though it is split."""
    monkeypatch.setattr(S, "block_keys", lambda _: [0])
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for c in range(60):
        docs.append((c, " ".join(words)))
        for i in rng.sample(range(300), 3):
            words[i] = f"z{c}x{i}"
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = S.similar_documents(df, block_rows=4, task_rows=8).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize(("block_rows", "task_rows"), [(2, 4096), (2, 40)])
def test_large_blocks_verify_shingles(spark, monkeypatch, block_rows, task_rows):
    """All in one large block: pairs just above 0.8 link, pairs just below don't, though their bits say little."""
    monkeypatch.setattr(S, "block_keys", lambda _: [0])
    docs = []
    for g in range(80):
        words = [f"g{g}w{i}" for i in range(204)]
        own = list(words)
        for i in range(4 if g % 2 else 5):  # each takes five of the 200 shingles: 180 of 220 are common, or 175 of 225
            own[20 + 40 * i] = f"z{g}x{i}"
        docs += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(own))]
    got = {r.doc_id: r.component_id for r in S.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), block_rows=block_rows, task_rows=task_rows).collect()}
    assert sum(got[2 * g] == got[2 * g + 1] for g in range(1, 80, 2)) >= 38  # of 40
    assert all(got[2 * g] != got[2 * g + 1] for g in range(0, 80, 2))


def test_similar_documents_are_those_with_similar_sets(spark):
    """Two texts with one shingle 300 times and 200 own ones differ; other multiplicities of the same shingles don't."""
    same = "x " * 304
    own = [" ".join(f"{c}{i}" for i in range(200)) for c in "abc"]
    docs = [(1, same + own[0]), (2, same + own[1]), (3, own[2] + " " + own[2]), (4, (own[2] + " ") * 9), (None, "one text without a number"), (None, "and another text without any")]
    got = S.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (2, 2), (3, 3), (4, 3)]


def test_similar_documents_meet_by_references(spark, monkeypatch):
    """Near copies without a common block key are found by their fingerprints' distances to the references."""
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join([*words[:2990], *(f"x{i}y{j}" for j in range(10))])) for i in range(3)] + [(9, " ".join(reversed(words)))]
    monkeypatch.setattr(S, "block_keys", lambda hashes: np.array([S.xxhash.xxh64_intdigest(hashes.tobytes()) >> 1], np.int64))
    sets = [S.shingle_set(t, 5) for _, t in docs]
    fps = [S.narrow_fingerprint_of(s) & ((1 << 64) - 1) for s in sets]
    reps = spark.createDataFrame([(i, S.wide_fingerprint_of(s).tobytes(), S.narrow_fingerprint_of(s), S.block_keys(s).tolist(), i) for i, s in enumerate(sets)], "node bigint, fp binary, narrow bigint, keys array<bigint>, first bigint")
    near = {(a, b) for a in range(3) for b in range(a + 1, 3) if (fps[a] ^ fps[b]).bit_count() <= 2}
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "key bigint, text string")
    got = {(r.a, r.b) for r in S._wide_links(reps, texts, 5, 0.8, 64, 4096).collect()}
    assert near and near <= got and all(b < 3 for _, b in got)
