"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A text is the set of its paragraphs' digests (repeats numbered, so that they differ). Each digest goes to one cell in
each of HASHES equal stretches of the table; a cell has a count, the xor of its digests and the xor of their checks.
Two tables of one size subtract cell by cell, and what the texts share goes. Cells that hold one digest of one side
are then peeled off until none is left: the differing digests of either side are recovered. Where cells are left, the
table was too small for the difference, and both are encoded again at FACTOR times the cells.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, trim

HASHES = 3
#: Cells of the fingerprint itself, and by how much a retry is larger.
CELLS, FACTOR = 24, 4
#: Paragraphs end at line ends; long ones are cut behind sentences, and after so many words without one.
MOST_WORDS = 24
_UNIT = re.compile(r"[^\n.!?]+[.!?]*|[.!?]+")


def paragraphs(text: str) -> list[str]:
    """Lines, cut behind sentence ends and after MOST_WORDS words; blank ones are none."""
    out = []
    for unit in _UNIT.findall(text):
        words = unit.split()
        if len(words) <= MOST_WORDS:
            if words:
                out.append(" ".join(words))
        else:
            out += [" ".join(words[i : i + MOST_WORDS]) for i in range(0, len(words), MOST_WORDS)]
    return out


def digests(text: str) -> np.ndarray:
    """One uint64 for each paragraph; the i-th copy of a paragraph has another than the first. Never 0."""
    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        i = seen[p] = seen.get(p, -1) + 1
        out.append(xxhash.xxh64_intdigest(p, i) or 1)
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    stretch = cells // HASHES
    return [(_mix(keys, i) % np.uint64(stretch)).astype(np.int64) + i * stretch for i in range(HASHES)]


def check_of(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 99) & np.uint64(0xFFFF)


class Tables:
    """Many tables of one size, in one array; `of` says which table a key goes to."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count, self.keys, self.checks = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    def add(self, of: np.ndarray, keys: np.ndarray, sign: int | np.ndarray = 1) -> None:
        checks = check_of(keys)
        for at in places(keys, self.cells):
            at = at + of * self.cells
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def minus(self, other: Tables) -> Tables:
        out = Tables(0, self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def text(self, i: int) -> str:
        """The table as a string: counts modulo 2^16, digests, checks."""
        cut = slice(i * self.cells, (i + 1) * self.cells)
        raw = (self.count[cut] % 65536).astype("<u2").tobytes() + self.keys[cut].astype("<u8").tobytes() + self.checks[cut].astype("<u2").tobytes()
        return base64.b64encode(raw).decode()

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(table, digest, side) of all that could be peeled, and whether each table is empty after that. Uses it up."""
        of, found, sides = [], [], []
        for _ in range(10_000):  # in each round at least one digest of every table that isn't stuck
            pure = np.nonzero((np.abs(self.count) == 1) & (self.checks == check_of(self.keys)) & (self.keys != 0))[0]
            if len(pure):  # cells that only look pure: the digest's place must be this cell
                stretch = (pure % self.cells) // (self.cells // HASHES)
                own = np.choose(stretch, places(self.keys[pure], self.cells)) == pure % self.cells
                pure = pure[own]
            if not len(pure):
                break
            order = np.lexsort((self.keys[pure], pure // self.cells))  # one digest may stand alone in several cells
            t, k, side = pure[order] // self.cells, self.keys[pure[order]], self.count[pure[order]]
            new = np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])))
            t, k, side = t[new], k[new], side[new]
            of.append(t), found.append(k), sides.append(side)
            self.add(t, k, -side)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        empty = ~left.reshape(-1, self.cells).any(axis=1)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return cat(of, np.int64), cat(found, np.uint64), cat(sides, np.int64), empty


def _laid(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def tables(sets: list[np.ndarray], cells: int) -> Tables:
    out = Tables(len(sets), cells)
    out.add(*_laid(sets))
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each pair of sets: the digests only in the first, and those only in the second; peeled, with larger tables
    as long as some pair isn't recovered."""
    out: list = [None] * len(a)
    todo = list(range(len(a)))
    while todo:
        # a table whose cells are fewer than the sizes differ can't be peeled
        able = [i for i in todo if abs(len(a[i]) - len(b[i])) <= cells]
        if able:
            of, keys, sides, empty = tables([a[i] for i in able], cells).minus(tables([b[i] for i in able], cells)).peel()
            order = np.argsort(of, kind="stable")
            of, keys, sides = of[order], keys[order], sides[order]
            ends = np.searchsorted(of, np.arange(len(able) + 1))
            for j, i in enumerate(able):
                if empty[j]:
                    k, s = keys[ends[j] : ends[j + 1]], sides[ends[j] : ends[j + 1]]
                    out[i] = (k[s > 0], k[s < 0])
        todo = [i for i in todo if out[i] is None]
        cells *= FACTOR
        if cells > 1 << 40:
            raise RuntimeError("two sets of digests can't be told apart")
    return out


def likeness(a: np.ndarray, b: np.ndarray, difference: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared digests over all digests; two empty sets are alike."""
    only_a, only_b = len(difference[0]), len(difference[1])
    total = len(a) + only_b
    return 1.0 if total == 0 else (len(a) - only_a) / total


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(rows: list[tuple[object, str, str]], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    """A batch of results for (key, text, next text)."""
    changed = [edited(t, n) for _, t, n in rows]
    own, then = [digests(t) for _, t, _ in rows], [digests(t) for t in changed]
    after = [own[i + 1] if i + 1 < len(rows) and rows[i + 1][1] == n else digests(n) for i, (_, _, n) in enumerate(rows)]
    a, b = tables(own, CELLS), tables(then, CELLS)
    to_edited, to_next = differences(own, then), differences(own, after)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in rows], kind),
            pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array([a.text(i) for i in range(len(rows))]),
            pa.array([b.text(i) for i in range(len(rows))]),
            pa.array([likeness(x, y, d) for x, y, d in zip(own, then, to_edited, strict=True)]),
            pa.array([likeness(x, y, d) for x, y, d in zip(own, after, to_next, strict=True)]),
            pa.array([len(d[0]) + len(d[1]) for d in to_edited], pa.int64()),
        ],
        names=names,
    )


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", per_stretch: int = 5000) -> DataFrame:
    """Rows (stretch, late, key, text), partitioned by stretch and sorted so that within a stretch every row with late = 0 is
    followed by the document after it.

    Documents are in the order of their keys, null ones first, and of one key, or of none, by the text's first 32
    characters and a hash of it. A stretch begins at about every per_stretch-th row, whatever its key, and there are at most
    100 thousand of them. The first row of a stretch stands in it and, late, at the end of the one before; the first of
    all stands late in the last stretch. So one shuffle of the texts brings neighbours together, hardly a text is sent
    twice, and no window runs over all rows. Only the places at which stretches begin are collected.

    Rows equal in key and text take several places that are the same. They are dealt by turns over the stretches that begin
    with such a place: which of them is where makes no difference, but that the last of these stretches has one.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    named = F.col("key").isNotNull()
    order = ["named", "key", "begins", "h"]
    placed = docs.withColumns({"named": named, "begins": F.left("text", F.lit(32)), "h": F.xxhash64("text")})
    per = max(per_stretch, docs.count() // 100_000)
    ranked = placed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    bounds = sorted((r.named, r.key if r.named else 0, r.begins, r.h) for r in ranked.where(F.pmod("r", F.lit(per)) == 0).collect())
    last, nulls = max(len(bounds) - 1, 0), sum(not x[0] for x in bounds)
    known = np.array([x[1] for x in bounds[nulls:]])

    @F.pandas_udf("stretch int, before array<int>")
    def stretch(there: pd.Series, keys: pd.Series, begins: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        named = there.to_numpy()
        at = np.full(len(keys), -1, np.int64)
        tied = ~named
        if len(known) and named.any():
            own = np.array(keys[named].tolist(), None if known.dtype.kind == "U" else known.dtype)  # strings keep their own lengths
            at[named] = np.searchsorted(known, own, side="right") - 1
            tied[named] = known[at[named]] == own
        at += nulls
        before: list[list[int]] = [[]] * len(keys)
        turns: dict[tuple, int] = {}
        for i in np.nonzero(tied)[0]:
            place = (bool(named[i]), keys.iloc[i] if named[i] else 0, begins.iloc[i], int(hashes.iloc[i]))
            lo, hi = bisect_left(bounds, place), bisect_right(bounds, place)
            if lo == hi:
                at[i] = lo - 1
            else:
                turn = turns[place] = turns.get(place, -1) + 1
                at[i] = hi - 1 - turn % (hi - lo)
                if turn == 0:  # more of them would do nothing
                    before[i] = [x if x >= 0 else last for x in range(lo - 1, hi - 1)]
        return pd.DataFrame({"stretch": np.maximum(at, 0).astype(np.int32), "before": before})

    # keys beside nulls would come as floating point numbers
    first = known[0].item() if len(known) and hasattr(known[0], "item") else 0
    key_or = F.coalesce("key", F.lit(first).cast(docs.schema["key"].dataType))
    bounded_batches(docs.sparkSession)
    dealt = placed.withColumn("at", stretch(named, key_or, F.col("begins"), F.col("h")))
    late = F.transform("at.before", lambda x: F.struct(x.alias("stretch"), F.lit(1).alias("late")))
    both = F.concat(F.array(F.struct(F.col("at.stretch").alias("stretch"), F.lit(0).alias("late"))), late)
    rows = dealt.select(*order, "text", F.explode(both).alias("s")).select("s.stretch", "s.late", *order, "text")
    return rows.repartition(last + 1, "stretch").sortWithinPartitions("stretch", "late", *order).select("stretch", "late", "key", "text")


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_rows: int = 256, batch_chars: int = 1 << 21) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_differences).

    The next document is that of the next key, after the last the first; of a single document, itself. Rows of one key
    follow each other by text (with_next()); a task holds at most batch_rows of them and batch_chars characters, or two
    documents. Null texts are empty; texts without paragraphs are alike. Other columns are ignored. Empty table: no rows.

    The likenesses are of the whole sets of digests: two sketches are subtracted and peeled, and where the sets differ in
    more than their cells can tell, larger sketches of the same sets are. The fingerprints returned have CELLS cells.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_differences"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        chars = 0
        before, kind = None, None
        for batch in batches:
            kind = batch.schema.field(2).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before and before[0] == row[0] and not before[1]:
                    rows.append((before[2], before[3], row[3]))
                    chars += len(before[3])
                    if len(rows) >= batch_rows or chars >= batch_chars:
                        yield _compared(rows, names, kind)
                        rows, chars = [], 0
                before = row
        if rows:
            yield _compared(rows, names, kind)
        trim()

    kind = docs.schema[key].dataType.simpleString()
    return with_next(docs, key, text).mapInArrow(walk, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_differences bigint")


def op9_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketched(documents(spark, sf_dir))
