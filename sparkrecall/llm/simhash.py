"""SimHash near-duplicates, linked through a table of distances to reference fingerprints.

A fingerprint is 64 bits; two texts link if their fingerprints differ in at most `max_bits` bits. Distinct
fingerprints are compared, never documents, so a group of copies is one row of every table here.

The reference fingerprints come in groups: those of group s have their bits in segment s of the 64. For a reference p
and the zero reference o, d(f, p) - d(f, o) depends on f's bits in p's segment only. Fingerprints that differ in at
most r bits agree in all but r of the r + 3 segments, hence in the whole coordinate offsets of at least three groups:
every such pair meets in one of the blocks keyed by the offsets of three groups. Pairs in a block are discarded by the
largest coordinate difference over all references (|d(f,p) - d(g,p)| <= d(f,g)), and survivors are verified.

A block of more than `block_rows` fingerprints is not paired. There every member goes to the points of its ball of
radius ceil(r/2), and all that share a point link to the least of them after verification of the radius: two
fingerprints within r bits share a point, two that share one are within 2*ceil(r/2). For odd r the radii are split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, join_once, materialize, trim
from sparkrecall.llm.components import components

#: References in each segment's group.
GROUP = 8


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """uint64 hashes of a text's shingles, repeats included, some at a time: a very long text takes no more memory.

    Fewer words than a shingle: the whole sequence. No words: nothing.
    """
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and U+0020, U+0009 to U+000D
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    for at in range(0, len(starts), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)


_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits. Every eighth bit at once is summed in the bytes of a word, 255 at most."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[: len(hashes)] = hashes
    rows = padded.reshape(-1, 255)
    out = np.empty((8, 8), np.int64)  # byte, bit in it
    for bit in range(8):
        out[:, bit] = ((rows >> np.uint64(bit)) & _LANES).sum(axis=1).astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle, seed):
        ones += bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    """`docs` with a bigint column `name`. Null, empty and blank texts: 0."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(x, shingle) for x in batch], dtype="int64")

    bounded_batches(docs.sparkSession)
    return docs.withColumn(name, fingerprints(F.col(text)))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the max_bits + 3 segments."""
    cuts = [64 * i // (max_bits + 3) for i in range(max_bits + 4)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def references(max_bits: int, seed: int = 7) -> list[list[int]]:
    """Of each segment, GROUP reference fingerprints (signed) with about half of the segment's bits set."""
    rng = np.random.default_rng(seed)
    out = []
    for first, width in segments(max_bits):
        group: list[int] = []
        while len(group) < GROUP:
            bits = int(rng.integers(1 << width)) << first
            if bits and (signed := bits - (1 << 64) if bits >> 63 else bits) not in group:
                group.append(signed)
        out.append(group)
    return out


def distance(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b).cast("long")))


def distance_table(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, t0, t1, ...): t_s packs the distances to segment s's references, one byte each; and k_s, their offsets to
    the distance to the zero reference."""
    fp = F.col("fp")

    def packed(group: list[int], offset: bool) -> Column:
        weight = F.bit_count(fp)
        return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft((distance(fp, p) - weight + 64 if offset else distance(fp, p)).cast("long"), 8 * i) for i, p in enumerate(group)])

    groups = references(max_bits)
    return fps.select("fp", *(packed(g, False).alias(f"t{s}") for s, g in enumerate(groups)), *(packed(g, True).alias(f"k{s}") for s, g in enumerate(groups)))


def _close(a: str, b: str, groups: int, max_bits: int) -> Column:
    """The largest difference of a coordinate is at most max_bits."""
    tests = []
    for s in range(groups):
        x, y = F.col(f"{a}.t{s}"), F.col(f"{b}.t{s}")
        tests += [F.abs(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(y, 8 * i).bitwiseAND(F.lit(255))) <= max_bits for i in range(GROUP)]
    return reduce(lambda x, y: x & y, tests)


def links(fps: DataFrame, max_bits: int = 2, block_rows: int = 512) -> DataFrame:
    """(a, b) of distinct fingerprints: all that differ in at most max_bits bits, or, in blocks of over block_rows, as
    many of these as connect the same."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3")
    n = max_bits + 3
    table = distance_table(fps, max_bits)
    keys = [F.struct(F.lit(i).alias("c"), F.xxhash64(*(f"k{s}" for s in three)).alias("k")) for i, three in enumerate(combinations(range(n), 3))]
    blocks = table.select("fp", *(f"t{s}" for s in range(n)), F.explode(F.array(*keys)).alias("key")).select("fp", *(f"t{s}" for s in range(n)), "key.c", "key.k")
    sizes = blocks.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(blocks.join(sizes, ["c", "k"]), "blocks")  # what is alone in its block is gone here
    small = met.where(F.col("n") <= block_rows)
    l, r = small.alias("l"), small.alias("r")
    close = (F.col("l.c") == F.col("r.c")) & (F.col("l.k") == F.col("r.k")) & (F.col("l.fp") < F.col("r.fp")) & _close("l", "r", n, max_bits) & (distance(F.col("l.fp"), F.col("r.fp")) <= max_bits)
    pairs = l.join(r, close).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    return pairs.unionByName(_dense(met.where(F.col("n") > block_rows).select("fp").distinct(), max_bits)).distinct()


def _dense(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links that connect what is within max_bits bits, through common points; as many rows as points, not pairs.

    Radii: two bits are one and one. One bit is one and zero. Three are two (for these few) and one.
    """
    ball = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = fps.select("fp", F.explode(ball).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
    if max_bits == 1:
        own = near.join(fps.select(F.col("fp").alias("point")), "point", "left_semi")
        return own.where("fp != point").select(F.least("fp", "point").alias("a"), F.greatest("fp", "point").alias("b"))
    if max_bits == 3:
        two = near.select("fp", F.explode(ball).alias("x"), "point").select("fp", F.col("point").bitwiseXOR(F.col("x")).alias("point")).distinct()
        # a within 1 and b within 2 of a point: a's of one point are within 2 of each other already
        least = near.groupBy("point").agg(F.min("fp").alias("m"))
        far = two.join(least, "point").where("fp != m").select(F.least("fp", "m").alias("a"), F.greatest("fp", "m").alias("b"))
        return far
    least = near.groupBy("point").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1")
    return near.join(least, "point").where("fp != m").select(F.col("m").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint, fingerprint string, component_id): the least key reachable over links of fingerprints.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated keys keep their rows. Null
    keys are rows like others, but are never a component's id unless it has no other. An empty table gives no rows.
    Columns other than key and text are ignored.
    """
    marked = materialize(with_fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), shingle, "text").select("key", "fp"), "fingerprints")
    first = materialize(marked.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("n")), "distinct")
    parts = materialize(components(links(first.select("fp"), max_bits)), "parts")
    # a component's id is the least key of all its fingerprints, not that of its least fingerprint
    of = first.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(of.join(ids, "component").select("fp", "n", "component_id"), "named")
    return join_once(marked, named, ["fp"], marked.count()).select(F.col("key").alias(key), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies that differ in more than a few bits -------------------------------------------------------------------

#: 64-bit words of a wide fingerprint.
WIDE = 8


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    out = np.zeros(0, np.uint64)
    for hashes in shingle_hashes(text, shingle):
        out = np.union1d(out, hashes)
    return out


def wide_fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    """WIDE words (uint64) of a fingerprint over WIDE mixes of each of a set of shingles' hashes."""
    ones = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(hashes), 1 << 16):
        for k in range(WIDE):
            with np.errstate(over="ignore"):
                x = hashes[at : at + (1 << 16)] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            ones[k] += bit_counts(x ^ (x >> np.uint64(31)))
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8").reshape(WIDE)


def differing_share(similarity: float) -> float:
    """The share of bits in which texts differ whose sets of shingles have this Jaccard similarity: the angle between
    equally long vectors of that overlap, over pi."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


#: Minima in a key, and keys: texts of similarity j share a key with probability 1 - (1 - j^MINIMA)^KEYS, which is 0.987
#: at 0.8 and 0.03 at 0.3. The number of keys doesn't grow with the corpus.
MINIMA, KEYS = 5, 11
_ODD = np.random.default_rng(11).integers(0, 1 << 63, MINIMA * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS numbers (int64) of a set of shingles' hashes, each of MINIMA least hashes under mixes of their own."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    out = np.zeros(KEYS, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            x = hashes[at : at + 2048]
            x = (x ^ (x >> np.uint64(32)))[None, :] * _ODD[:, None]
            least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=1))
        for column in least.reshape(KEYS, MINIMA).T:
            out = (out ^ (column * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(31)
        return (out + np.arange(KEYS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Differing bits of wide fingerprints."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(c), np.uint64).reshape(-1, WIDE) for c in (a, b))
    return pd.Series(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32))


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of sets of hashes, packed in order."""
    out = []
    for p, q in zip(a, b, strict=True):
        x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(1.0 if len(x) + len(y) == 0 else both / (len(x) + len(y) - both))
    return pd.Series(out, dtype="float64")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of (node, text)."""

    @F.pandas_udf("binary")
    def packed(batch: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).tobytes() for t in batch], dtype=object)

    return texts.select("node", packed("text").alias("set"))


def narrow_fingerprint_of(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint, signed, of a set of shingles' hashes."""
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<i8")[0])


def _near_by_references(reps: DataFrame) -> DataFrame:
    """(a, b) of nodes whose 64-bit fingerprints links() has, by the distances to the references, or that share one: each
    fingerprint's least node stands for it."""
    first = materialize(reps.groupBy("narrow").agg(F.min("node").alias("first")), "narrow")
    found = links(first.select(F.col("narrow").alias("fp")))
    of = lambda side: first.select(F.col("narrow").alias(side), F.col("first").alias(f"{side}_node"))
    apart = found.join(of("a"), "a").join(of("b"), "b").select("a_node", "b_node")
    equal = reps.select("node", "narrow").join(first, "narrow").where("node != first").select(F.col("first").alias("a_node"), F.col("node").alias("b_node"))
    return apart.unionByName(equal).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def _most(similarity: float) -> int:
    """Bits in which texts that similar may differ: three deviations more than expected."""
    share = differing_share(similarity)
    return int(share * 64 * WIDE + 3 * (share * (1 - share) * 64 * WIDE) ** 0.5)


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b) that are as similar: bits only rule out, the sets of shingles decide on all others."""
    left = pairs.join(reps.select(F.col("node").alias("a"), F.col("fp").alias("fa")), "a")
    both = left.join(reps.select(F.col("node").alias("b"), F.col("fp").alias("fb")), "b")
    near = materialize(both.where(F.pandas_udf(_distance, "int")("fa", "fb") <= _most(similarity)).select("a", "b"), "near")
    nodes = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    wanted = reps.join(nodes, "node").select("node", F.col("first").alias("key"))
    texts = docs.join(wanted, docs["key"].eqNullSafe(wanted["key"])).groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(_sets(texts, shingle), "sets")
    met = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return materialize(met.where(F.pandas_udf(_jaccard, "double")("sa", "sb") >= similarity).select("a", "b"), "verified")


def tree(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row before, differing bits): a spanning tree of least distances from row 0, without links of over `most` bits."""
    best, via = np.full(len(fps), 1 << 20), np.zeros(len(fps), np.int64)
    rows, at = [], 0
    out = np.zeros(len(fps), bool)
    for _ in range(len(fps) - 1):
        out[at] = True
        d = np.bitwise_count(fps ^ fps[at]).sum(axis=1, dtype=np.int64)
        closer = (d < best) & ~out
        best[closer], via[closer] = d[closer], at
        at = int(np.argmin(np.where(out, 1 << 21, best)))
        rows.append(at)
    some = np.array([r for r in rows if best[r] <= most], np.int64)
    return some, via[some], best[some]


def across(nodes: np.ndarray, labels: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b) of at most `most` differing bits and of different labels."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(nodes) - 1):
        other = np.nonzero(labels[i + 1 :] != labels[i])[0] + i + 1
        near = other[np.bitwise_count(fps[other] ^ fps[i]).sum(axis=1) <= most]
        a.append(np.full(len(near), nodes[i]))
        b.append(nodes[near])
    return np.concatenate(a), np.concatenate(b)


def sub_blocks(blocks: DataFrame, task_rows: int) -> DataFrame:
    """`blocks` (node, key, n) with i and j: of more than task_rows nodes, about half as many are a part of the block, and
    each node goes to the pairs (i, j) of its part and every part. So every two nodes of a block are together in some."""
    parts = F.when(F.col("n") <= task_rows, F.lit(1)).otherwise(F.ceil(2 * F.col("n") / task_rows)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    met = blocks.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select(*blocks.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _wide_links(reps: DataFrame, docs: DataFrame, shingle: int, similarity: float, block_rows: int, task_rows: int) -> DataFrame:
    """(a, b) of nodes that are as similar.

    Candidates have 64-bit fingerprints within 2 bits, found by their distances to the references as in near_duplicates,
    or share a block key; wide fingerprints rule out and the sets of shingles decide. All pairs of a block of at most
    block_rows are candidates. In larger blocks, groups of near copies, each node first meets its nearest and the least
    of those near it. What these links leave apart is compared whole: of blocks that hold several components, all near
    pairs between two of them are candidates. A block of more than task_rows is split, and every two of its parts meet in
    a task of their own. So block_rows and task_rows don't change which nodes are connected.
    """
    most = _most(similarity)

    def wide_of(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, WIDE)

    def proposed(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, fps = table.column("node").to_numpy(), wide_of(table)
        row, before, d = tree(fps, most)
        to_least = np.bitwise_count(fps ^ fps[0]).sum(axis=1, dtype=np.int64)[row]
        least = pa.array(np.full(len(row), nodes[0]), mask=to_least > most)
        return pa.table({"node": pa.array(nodes[row]), "d": pa.array(d), "near": pa.array(nodes[before]), "least": least})

    def apart(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        a, b = across(table.column("node").to_numpy(), table.column("label").to_numpy(), wide_of(table), most)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    blocks = reps.select("node", F.explode("keys").alias("key"))
    sizes = blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(blocks.join(sizes, "key"), "met")
    small, large = met.where(F.col("n") <= block_rows), met.where(F.col("n") > block_rows)
    l, r = small.alias("l"), small.alias("r")
    pairs = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node"))).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    pairs = materialize(pairs.unionByName(_near_by_references(reps)).distinct(), "pairs")
    if large.isEmpty():
        return _verified(pairs, reps, docs, shingle, similarity)
    fps = reps.select("node", "fp")
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n") / task_rows))
    chunks = large.withColumn("chunk", chunk).join(fps, "node")
    trees = chunks.groupBy("key", "chunk").applyInArrow(proposed, "node bigint, d bigint, near bigint, least bigint")
    each = materialize(trees.groupBy("node").agg(F.min(F.struct("d", "near")).alias("nearest"), F.min("least").alias("least")), "trees")
    first = each.select("node", F.col("nearest.near").alias("other")).unionByName(each.where("least is not null").select("node", F.col("least").alias("other")))
    first = pairs.unionByName(first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))).distinct()
    found = _verified(first, reps, docs, shingle, similarity)
    labelled = large.join(components(found).withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    whole = sub_blocks(labelled.join(mixed, "key"), task_rows).join(fps, "node")
    rest = whole.groupBy("key", "i", "j").applyInArrow(apart, "a bigint, b bigint").distinct()
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "apart")
    return found.unionByName(_verified(rest, reps, docs, shingle, similarity))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", block_rows: int = 64, task_rows: int = 4096) -> DataFrame:
    """(key, component_id) of documents whose sets of shingles are `similarity` alike or more, by SimHash.

    Those whose 64-bit fingerprints are within 2 bits meet by the references' distances (links), however their keys are.
    Of the others, at such similarities, fingerprints differ in many bits: a distance of a sixth of the bits leaves no reference whose
    distances could tell pairs apart, and no few segments untouched. So the fingerprint has 64 * WIDE bits, candidates
    share one of KEYS keys made of least hashes, and the shingles decide on all pairs that their bits don't rule out.
    Pairs just at 0.8 are found with probability 0.98, closer ones more surely, equal sets always: how often a shingle
    occurs in a text plays no part. Nulls, repeats and empty tables as in near_duplicates.
    """

    @F.pandas_udf("node bigint, fp binary, narrow bigint, keys array<bigint>")
    def wide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 3) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": nodes, "fp": pd.Series([wide_fingerprint_of(s).tobytes() for s in sets], dtype=object), "narrow": pd.Series([narrow_fingerprint_of(s) for s in sets], dtype="int64"), "keys": pd.Series([block_keys(s) for s in sets], dtype=object)})
        trim()

    bounded_batches(docs.sparkSession)
    # texts of equal sets are one node; keys may be null or occur with other texts, so a text's hash goes with its key
    own = docs.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("h")).alias("key"), F.col(text).alias("text"))
    marked = materialize(own.select("key", wide("text").alias("w")).select("key", "w.node", "w.fp", "w.narrow", "w.keys"), "wide")
    reps = materialize(marked.groupBy("node").agg(F.min(F.struct("fp", "narrow", "keys")).alias("w"), F.min("key").alias("first")).select("node", "w.fp", "w.narrow", "w.keys", "first"), "distinct")
    parts = materialize(components(_wide_links(reps, own, shingle, similarity, block_rows, task_rows)), "parts")
    of = reps.join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    ids = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(ids, "component").select("node", "component_id")
    return marked.select("key", "node").join(named, "node").select(F.col("key.key").alias(key), F.col("component_id.key").alias("component_id"))


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
