"""Texts of one key whose words overlap: by their rarest words where these tell texts apart, else by counts in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.functions import text as X
from sparkrecall.sources.store import settled

#: A key goes by blocks if rare words would bring more than so many of its pairs together, and more than this part of all.
MEETS, PART = 2**11, 1 / 64
#: Texts and words of a block, about; cells counted at once, and the most cells of a block's matrix.
ROWS, WORDS, AT_ONCE, CELLS = 2**14, 2**22, 2**18, 2**24


def by_words(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """(k, c, w, id, order, *more) of rows with content: the keys, the distinct words in order, and what is equal where both
    of these are. Written, since several joins read it."""
    w = F.sort_array(F.array_distinct(X.raw_words(F.col("content"))))
    held = rows.where("content is not null").select(F.struct(*keys).alias("k"), w.alias("w"), "id", "order", *more)
    return settled(held.withColumn("c", F.unhex(F.sha2(F.to_json(F.struct("k", F.concat_ws(" ", "w").alias("w"))), 256))))


def near(held: DataFrame, threshold: float) -> DataFrame:
    """(c, d), both ways: word sets of one key that overlap more than the threshold, each with itself too."""
    texts = settled(held.dropDuplicates(["c"]).select("k", "c", "w"))
    if threshold >= 1:
        return texts.select("c", F.col("c").alias("d")).limit(0)
    crowded = settled(_crowded(texts, threshold))
    pairs = _by_rare_words(texts.join(crowded, "k", "left_anti"), threshold)
    if not crowded.isEmpty():
        pairs = pairs.unionByName(_in_blocks(texts.join(crowded, "k"), threshold))
    pairs = settled(pairs)
    return pairs.unionByName(pairs.select(F.col("d").alias("c"), F.col("c").alias("d"))).unionByName(texts.select("c", F.col("c").alias("d")))


def _crowded(texts: DataFrame, threshold: float) -> DataFrame:
    """(k, blocks) of the keys that go by blocks. The rarest words are reckoned from how many texts hold each."""
    c = F.col
    held = texts.select("k", F.explode("w").alias("t")).groupBy("k", "t").agg(F.count("*").alias("n"))
    alike = held.groupBy("k", "n").agg((F.count("*") * c("n")).alias("words"))
    of = W.partitionBy("k")
    before = F.sum("words").over(of.orderBy("n")) - c("words")
    rare = F.least(c("words"), F.greatest((1 - threshold) * F.sum("words").over(of) - before, F.lit(0)))
    meets = alike.select("k", "words", (rare * c("n") / 2).alias("meets")).groupBy("k").agg(F.sum("words").alias("words"), F.sum("meets").alias("meets"))
    per = meets.join(texts.groupBy("k").agg(F.count("*").alias("n")), "k")
    crowded = (c("meets") > MEETS) & (c("meets") > PART * c("n") * (c("n") - 1) / 2)
    return per.where(crowded).select("k", F.ceil(F.greatest(c("n") / ROWS, c("words") / WORDS)).cast("int").alias("blocks"))


def _by_rare_words(texts: DataFrame, threshold: float) -> DataFrame:
    """(c, d), c before d: texts so alike share a word among the rarest of each, the first |x| - floor(threshold * |x|) by
    frequency, and are no shorter than the threshold's share of one another; so pairs meet by rare words, not all with all.
    A pair is made where its first shared word of these is."""
    told = texts.select("k", "c", F.explode("w").alias("t"))
    # counted before they meet, so that a frequent word of one actor is no task's rows
    told = told.join(told.groupBy("k", "t").agg(F.count("*").alias("n")), ["k", "t"])
    ranked = told.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("r"))
    rare = F.slice("r", 1, F.greatest(F.size("r") - F.floor(F.lit(threshold) * F.size("r")), F.lit(1)).cast("int"))
    sides = texts.join(ranked, "c").withColumn("r", rare).withColumn("t", F.explode("r"))
    c = F.col
    met = sides.alias("a").join(sides.alias("b"), (c("a.k") == c("b.k")) & (c("a.t") == c("b.t")) & (c("a.c") < c("b.c")) & (F.size("a.w") >= threshold * F.size("b.w")) & (F.size("b.w") >= threshold * F.size("a.w")))
    once = c("a.t") == F.filter("a.r", lambda t: F.array_contains(c("b.r"), t))[0]
    return met.where(once).where(X.jaccard(c("a.w"), c("b.w")) > threshold).select(c("a.c").alias("c"), c("b.c").alias("d"))


def _in_blocks(texts: DataFrame, threshold: float) -> DataFrame:
    """(c, d): every text meets every other of its key. The key's texts are dealt into blocks of about ROWS, and each pair of
    blocks is one group of a task, which counts the words shared."""
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    dealt = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides: list[Column] = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    return dealt.select("k", *sides, "own", "c", "w").groupBy("k", "low", "high").applyInArrow(lambda key, rows: _shared(rows, key[1].as_py(), key[2].as_py(), threshold), "c binary, d binary")


def _shared(rows: pa.Table, low: int, high: int, threshold: float) -> pa.Table:
    """The pairs of two blocks, or of one with itself."""
    rows = rows.combine_chunks()
    lists = rows["w"].combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(size)), size)
    own = rows["own"].to_numpy()
    # by size, so that those that can be alike are neighbours
    a, b = (np.flatnonzero(own == x) for x in (low, high))
    a, b = (x[np.argsort(size[x], kind="stable")] for x in (a, b))
    # words of many texts are columns of a matrix, those of few are looked up
    held = np.bincount(codes)
    column = np.full(len(held), -1)
    often = np.flatnonzero(held > max(len(size) / 12, 16))
    often = often[np.argsort(-held[often], kind="stable")][: CELLS // max(len(b), 1)]
    column[often] = np.arange(len(often))
    sides = [_of(x, size, text, codes) for x in (a, b)]
    found = [*_alike(*sides, size[a], size[b], column, threshold, low == high)]
    names = rows["c"].combine_chunks()
    i, j = (np.concatenate([np.zeros(0, np.int64), *(f[n] for f in found)]) for n in (0, 1))
    return pa.table({"c": names.take(pa.array(a[i])), "d": names.take(pa.array(b[j]))})


def _of(chosen: np.ndarray, size: np.ndarray, text: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, word) of the chosen texts, by their places among these."""
    place = np.full(len(size), -1)
    place[chosen] = np.arange(len(chosen))
    at = place[text]
    at, words = at[at >= 0], codes[at >= 0]
    order = np.argsort(at, kind="stable")
    return at[order], words[order]


def _alike(a: tuple, b: tuple, size_a: np.ndarray, size_b: np.ndarray, column: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of the pairs, some texts of a at a time with those of b that are neither too long nor too
    short. All shared words are counted, so no pair is looked at again."""
    (at_a, words_a), (at_b, words_b) = a, b
    few = column[words_b] < 0
    order = np.argsort(words_b[few], kind="stable")
    holders, n_holders = at_b[few][order], np.bincount(words_b[few], minlength=len(column))
    start = np.cumsum(n_holders) - n_holders
    width = int(column.max(initial=-1)) + 1
    begin_a = np.concatenate([[0], np.cumsum(size_a)])
    all_b = _ones(at_b, column[words_b], (len(size_b), width))
    step = max(AT_ONCE // max(len(size_b), width, 1), 1)
    for lo in range(0, len(size_a), step):
        hi = min(lo + step, len(size_a))
        first = int(np.searchsorted(size_b, threshold * size_a[lo] * (1 - 1e-9), "left"))
        last = int(np.searchsorted(size_b, size_a[hi - 1] / max(threshold, 1e-9) * (1 + 1e-9), "right"))
        first = max(first, lo + 1) if same else first
        if first >= last:
            continue
        mine = slice(begin_a[lo], begin_a[hi])
        at, words = at_a[mine], words_a[mine]
        n = _ones(at - lo, column[words], (hi - lo, width)) @ all_b[first:last].T
        times = n_holders[words]
        at, words, times = at[times > 0], words[times > 0], times[times > 0]
        ends = np.cumsum(times)
        cuts = [0, *np.unique(np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE), "right")).tolist(), len(times)] if len(times) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            t = times[x:y]
            with_ = holders[np.arange(t.sum()) + np.repeat(start[words[x:y]] - (np.cumsum(t) - t), t)]
            where = np.repeat(at[x:y] - lo, t)
            fits = (with_ >= first) & (with_ < last)
            n += np.bincount(where[fits] * (last - first) + with_[fits] - first, minlength=n.size).reshape(n.shape)
        both = size_a[lo:hi, None] + size_b[None, first:last]
        i, j = np.nonzero((n > 0) & (n > (both * (threshold / (1 + threshold)) - 0.01) * (1 - 1e-5)))
        shared = n[i, j].astype(np.int64)
        i, j = i + lo, j + first
        fits = shared / (size_a[i] + size_b[j] - shared) > threshold
        if same:
            fits &= i < j
        yield i[fits], j[fits]


def _ones(at: np.ndarray, column: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    out[at[column >= 0], column[column >= 0]] = 1
    return out
