"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax over the whole vocabulary.

A word's class is read off its form, a hash of its last three bytes, so every word has one, also those that the model never
met. Classes are the leaves of a tree in which every node has WIDTH children. The most frequent words of a class have a cell
each, and the others share the class's last cell. The model says

    P(word | context) = P(child of the root | context) * ... * P(class | its parent, context) * P(cell | class, context) * P(word | cell),

where the last factor is a smoothed count share that concerns the shared cells only. The others are maximum-entropy models
over hashed features of the context: the word before; the forms of the word before, of the two before together, and of the
second and the third before (skips). The tree gets deeper as the corpus has more types: WIDTH^2 to
WIDTH^4 classes, and WIDTH times as many cells. The weights start at the counts' own shares and are trained by distributed gradient updates: in each round every task runs through its documents in
minibatches from the same weights, and the moves of all tasks, summed block by block on the executors, are averaged by how
often each row of weights was touched.

Counts, distinct words and sizes are exact and over all training documents: words are counted in the tasks and summed up by
word first. The most frequent of all words, a bounded dictionary, have numbers that the tasks know; they alone can have a
cell of their own. All other words of a document travel as (document, word) rows to where the word's count is, and their
shares travel back to the document: a word's rows need not be in one task for that. Held-out documents have no part in
counts, dictionary or weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, lowest, materialize, stretches, trim

#: Children of a node, and cells of a class: a row of weights is a cache line.
WIDTH = 16
#: The least and the greatest depth of the tree of classes; Counts.depth has a corpus's.
LEAST, MOST = 2, 4
#: Forms, hashes of words' ends; classes are ranges of them.
FORMS = WIDTH**MOST
#: Binary logarithm of the rows of weights of the first levels; the cells, and all levels from the last of these on, have the
#: last one's. The model is 16 MB at most, however large the corpus.
BITS = (14, 15, 16)
#: The features, by place in _contexts, that the levels look at, the last for all levels from it on.
USED = ((1, 2, 3, 4), (1, 2, 3), (1, 2), (0, 1))
DICTIONARY = 1 << 19
#: Bytes of a dictionary's longest word; longer ones are counted like those that aren't in it.
LONGEST = 64
#: Least bytes of text in a training task.
TASK = 1 << 24
#: Bytes of text that are coded at once.
STRETCH = 1 << 22
#: Tail words' logarithms are summed as whole numbers of this fraction, so that no order of rows changes a sum.
FRACTION = float(1 << 32)
#: Words of one minibatch.
BATCH = 16384
#: Rows of weights in one block of moves.
BLOCK = 2048
#: The end of a text; the empty byte string is no word.
END = b""
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


_ONES = np.ones(WIDTH, np.float32)  # a product with it is a sum over children, and faster


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower, and the end."""
    return [*(text or "").encode().lower().split(), END]


def form_of(word: bytes) -> int:
    """A number below FORMS, from the word's last three bytes."""
    return int(_forms(np.array([int.from_bytes(word[-3:], "little") | min(len(word), 3) << 24], np.uint64))[0])


def _forms(ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (ends + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(FORMS)).astype(np.int64)


def _forms_of(words: pa.Array) -> np.ndarray:
    """form_of() of each word of a string array."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None and len(words.buffers()[2]) else np.zeros(1, np.uint8)
    size = np.minimum(np.diff(offsets), 3)
    out = size.astype(np.uint64) << np.uint64(24)
    for k in range(3):
        some = size > k
        # the k-th of the last bytes, as a little-endian number has them
        at = np.where(some, offsets[1:] - size + k, 0)
        out |= np.where(some, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    return _forms(out)


_END_FORM = form_of(END)


def _split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, lower, one text after the other; and each one's text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, parents = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # blanks at either end make empty strings
    if not real.all():
        flat, parents = flat.filter(pa.array(real)), parents[real]
    return flat.dictionary_encode(), parents


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, never below DICTIONARY."""
    texts = words.to_numpy(zero_copy_only=False).tolist()  # of many strings, much faster than to_pylist
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, texts, repeat(1)), np.uint64, len(texts))
    return np.maximum(hashes, np.uint64(DICTIONARY))


def numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a dictionary's words in order, and the words' numbers."""
    hashes = _hashes(words)
    order = np.argsort(hashes)
    return hashes[order], order.astype(np.int32)


class Coder:
    """Codes and forms of texts' tokens; a code is a word's number in the dictionary, or else its 64-bit hash (never below
    DICTIONARY). Takes the dictionary's words, or what numbered() makes of them."""

    def __init__(self, words: pa.Array | tuple[np.ndarray, np.ndarray]):
        self.hashes, self.numbers = words if isinstance(words, tuple) else numbered(words)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and forms of all tokens one text after the other, each text's end included; and the texts' numbers of tokens."""
        coded, parents = _split(texts)
        sizes = np.bincount(parents, minlength=len(texts)) + 1
        of_word = _hashes(coded.dictionary)
        at = np.minimum(np.searchsorted(self.hashes, of_word), len(self.hashes) - 1)
        of_word = np.where(self.hashes[at] == of_word, self.numbers[at].astype(np.uint64), of_word)
        out = np.zeros(int(sizes.sum()), np.uint64)  # the end's number is 0
        forms = np.full(len(out), _END_FORM, np.int64)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes) - 1] = False
        which = coded.indices.to_numpy()
        out[inside] = of_word[which]
        forms[inside] = _forms_of(coded.dictionary)[which]
        return out, forms, sizes


def _contexts(codes: np.ndarray, forms: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Of each token, hashes of its context features; before a text stands its start."""
    start = np.uint64(1 << 40)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def before(x: np.ndarray, k: int) -> np.ndarray:
        shifted = np.concatenate((np.full(min(k, len(x)), start, np.uint64), x[: max(0, len(x) - k)]))
        return np.where(at >= k, shifted, start + np.uint64(k))

    shapes = forms.astype(np.uint64)
    near, second, third = (before(shapes, k) for k in (1, 2, 3))
    with np.errstate(over="ignore"):
        pair = near * np.uint64(0x2545F4914F6CDD1D) ^ second
        mixed = [(f ^ (f >> np.uint64(29))) * m for f, m in zip((before(codes, 1), near, pair, second, third), _MULTIPLIERS, strict=True)]
        return [f ^ (f >> np.uint64(32)) for f in mixed]


@dataclass
class Weights:
    """A table of rows of WIDTH weights for each level of the tree, and one for the cells; and biases [node, child] likewise."""

    tables: list[np.ndarray]
    biases: list[np.ndarray]

    @property
    def depth(self) -> int:
        """Levels of the tree of classes."""
        return len(self.tables) - 1

    def copy(self) -> Weights:
        return Weights([t.copy() for t in self.tables], self.biases)


def _rows(features: list[np.ndarray], level: int, of: np.ndarray) -> list[np.ndarray]:
    """The rows of weights, a uint16 for each token, of the level's features given the outcome `of` of the level before."""
    out = []
    with np.errstate(over="ignore"):
        salt = (of.astype(np.uint64) + np.uint64(1 + (level << 20))) * np.uint64(0x9E3779B97F4A7C15)
        bits = BITS[min(level, len(BITS) - 1)]
        for k in USED[min(level, len(USED) - 1)]:
            x = features[k] * np.uint64(0xD6E8FEB86659FD93) + salt
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out.append((x >> np.uint64(64 - bits)).astype(np.uint16))
    return out


def _levels(w: Weights, features: list[np.ndarray], classes: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(level, rows, bias of each token, what is right) of the factors."""
    for level in range(w.depth + 1):
        node = classes // WIDTH ** (w.depth - level)
        right = classes // WIDTH ** (w.depth - level - 1) % WIDTH if level < w.depth else cells
        yield level, _rows(features, level, node), w.biases[level].take(node, axis=0), right


def _weights(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    x = table.take(rows[0], axis=0)
    for r in rows[1:]:
        x += table.take(r, axis=0)
    x += bias
    return x


def log_p(w: Weights, features: list[np.ndarray], classes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(cell | context) of each token."""
    out, every = np.zeros(len(cells), np.float32), np.arange(len(cells))
    for level, rows, bias, right in _levels(w, features, classes, cells):
        x = _weights(w.tables[level], rows, bias)
        out += x[every, right]
        # row by row: a product's order of sums may differ by where in the batch a token stands
        out -= np.log(np.einsum("ij->i", np.exp(x, out=x)))
    return out


class Trainer:
    """Minibatch updates with per-row step sizes, from given weights."""

    def __init__(self, w: Weights, rate: float = 0.25):
        self.start, self.w, self.rate = w, w.copy(), rate
        self.seen = [np.zeros(len(t), np.float32) for t in w.tables]

    def _move(self, table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Sums each row's gradient over the batch and steps by it, less the more often the row was touched."""
        order = np.argsort(rows, kind="stable")  # of 16-bit numbers, a radix sort
        sorted_ = rows[order]
        first = np.concatenate(([0], np.nonzero(sorted_[1:] != sorted_[:-1])[0] + 1))
        at = sorted_[first]
        count = np.diff(np.append(first, len(rows)))
        total = gradient.take(order.take(first), axis=0)
        many = count > 1  # most rows occur once, and have nothing to sum
        if many.any():
            n = count[many]
            total[many] = np.add.reduceat(gradient.take(order[np.repeat(many, count)], axis=0), np.cumsum(n) - n, axis=0)
        touched = seen.take(at) + count.astype(np.float32)
        seen[at] = touched
        total *= (-self.rate * 32.0 / (32.0 + touched))[:, None]
        total += table.take(at, axis=0)
        table[at] = total

    def batch(self, features: list[np.ndarray], classes: np.ndarray, cells: np.ndarray) -> None:
        every = np.arange(len(cells))
        for level, rows, bias, right in _levels(self.w, features, classes, cells):
            x = _weights(self.w.tables[level], rows, bias)
            np.exp(x, out=x)
            x /= (x @ _ONES)[:, None]
            x[every, right] -= 1
            for r in rows:
                self._move(self.w.tables[level], self.seen[level], r, x)

    def moves(self) -> Iterator[tuple[int, bytes]]:
        """(block, of the rows touched: touches as float32, moves as float16, numbers in the block as uint16) of all blocks."""
        number = 0
        for now, was, seen in zip(self.w.tables, self.start.tables, self.seen, strict=True):
            for at in range(0, len(now), BLOCK):
                rows = np.nonzero(seen[at : at + BLOCK])[0]
                if len(rows):
                    yield number, seen[at + rows].tobytes() + (now[at + rows] - was[at + rows]).astype(np.float16).tobytes() + rows.astype(np.uint16).tobytes()
                number += 1


def _kept(n: str = "key") -> F.Column:
    return F.crc32(F.col(n).cast("string").cast("binary")) % 5 != 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(code, word, form, c) of every word of the documents' texts, written down; words of over LONGEST bytes are null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in stretches(batch.column(0)):
                coded, _ = _split(batch.column(0).slice(at, rows))
                words = coded.dictionary
                short = pc.if_else(pc.less_equal(pc.binary_length(words), LONGEST), words, pa.scalar(None, words.type))
                n = np.bincount(coded.indices.to_numpy(), minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(words).view(np.int64)), short.cast(pa.string()), pa.array(_forms_of(words).astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "word", "form", "n"])
        trim()

    found = docs.select("text").mapInArrow(count, "code bigint, word string, form int, n bigint")
    return materialize(found.groupBy("code", "word", "form").agg(F.sum("n").alias("c")), "counts")


def frequent(counted: DataFrame, size: int) -> pa.Table:
    """(word, c) of the `size` most frequent of word_counts(), most frequent first; of equals, those of low hashes."""
    short = counted.where("word is not null")
    above, left, least = 0, 0, 0
    # as many counts are looked at as there are words at most
    for c, n in short.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(size + 1).collect():
        if above + n > size:
            left, least, equals = size - above, c, n
            break
        above, least = above + n, c - 1
    top = short.where(F.col("c") > least).select("word", "c", "code").toArrow()
    if left:
        # about twice as many as are wanted, so that no task sees all words of a low count
        some = short.where((F.col("c") == least) & (F.col("code") <= lowest(2 * left + 1000, equals)))
        top = pa.concat_tables([top, some.orderBy("code", "word").limit(left).select("word", "c", "code").toArrow()])
    return top.sort_by([("c", "descending"), ("code", "ascending"), ("word", "ascending")]).select(["word", "c"])


def _with_end(words: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([pa.array([END.decode()], pa.string()), words.combine_chunks().cast(pa.string())])


def dictionary(docs: DataFrame, n: int, size: int, sample_docs: int | None = None) -> pa.Array:
    """The size - 1 most frequent words, of LONGEST bytes at most, of all of the n documents; most frequent first, END before.
    `sample_docs` is of a time when some of them were read, and has no effect."""
    return _with_end(frequent(word_counts(docs), size - 1).column("word"))


@dataclass
class Counts:
    """Exact counts over the training tokens."""

    head: np.ndarray  # of the dictionary's words
    form_tokens: np.ndarray  # of all other words, by form
    form_types: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.head.sum() + self.form_tokens.sum())

    @property
    def types(self) -> int:
        return int((self.head > 0).sum() + self.form_types.sum())

    @property
    def depth(self) -> int:
        """Levels of the tree: of so many classes that one has about a WIDTH^2th of the types, within bounds."""
        return int(min(MOST, max(LEAST, np.round(np.log(max(self.types, 1)) / np.log(WIDTH)) - 2)))


def classes_of(forms: np.ndarray, depth: int) -> np.ndarray:
    return forms // WIDTH ** (MOST - depth)


def count_words(counted: DataFrame, n: int) -> tuple[pa.Array, Counts]:
    """The dictionary, and Counts, of word_counts() over n documents."""
    top = frequent(counted, DICTIONARY - 1)
    words = _with_end(top.column("word"))
    head = np.zeros(DICTIONARY, np.int64)
    head[0] = n
    head[1 : len(words)] = top.column("c").to_numpy()
    tokens, types = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
    for r in counted.groupBy("form").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect():  # FORMS rows at most
        tokens[r.form], types[r.form] = r.c, r.k
    forms = _forms_of(words)[1:]
    np.subtract.at(tokens, forms, head[1 : len(words)])
    np.subtract.at(types, forms, 1)
    return words, Counts(head, tokens, types)


def tails(scored: DataFrame, counted: DataFrame) -> DataFrame:
    """(dk, tail_log, tail_known, tail_n): of each document's words outside the dictionary (`tail`, an array of code and n),
    the sum of log10(c + 0.5), the number with c > 0, and their number."""
    rows = scored.select("dk", F.explode("tail").alias("w")).select("dk", "w.code", "w.n")
    each = counted.groupBy("code").agg(F.sum("c").alias("c"))  # without a row: never seen in training
    c = F.coalesce("c", F.lit(0))
    log = F.round(F.log10(c + 0.5) * FRACTION).cast("long")
    return rows.join(each, "code", "left").groupBy("dk").agg(
        (F.sum(log * F.col("n")) / FRACTION).alias("tail_log"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum("n").alias("tail_n"),
    )


@dataclass
class Cells:
    """The cell of each number in the dictionary, and of each class what the shared cell's words have together."""

    cells: np.ndarray
    rest: np.ndarray  # log10 of the shared cells' tokens and smoothing

    def __call__(self, codes: np.ndarray, forms: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        known = codes < len(self.cells)
        number = np.where(known, codes, 0).astype(np.int64)
        return classes_of(forms, depth), np.where(known, self.cells[number], WIDTH - 1)


def cells(counts: Counts, words: pa.Array) -> tuple[Cells, Weights]:
    """The most frequent words of each class have a cell of their own, the others its last one; and weights without context:
    biases at the logarithms of the counts' shares. Cells without a word have next to none."""
    depth = counts.depth
    n = WIDTH**depth
    own = classes_of(_forms_of(words), depth)
    head = counts.head[: len(words)]
    cell = np.full(len(counts.head), WIDTH - 1, np.int64)
    order = np.lexsort((-head, own))  # by class, the most frequent first
    sorted_ = own[order]
    first = np.concatenate(([0], np.nonzero(sorted_[1:] != sorted_[:-1])[0] + 1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    cell[order] = np.where(head[order] > 0, np.minimum(place, WIDTH - 1), WIDTH - 1)
    of_form, shared = classes_of(np.arange(FORMS), depth), cell[: len(words)] == WIDTH - 1
    share = np.zeros((n, WIDTH))
    np.add.at(share, (own, cell[: len(words)]), head)
    share[:, -1] += np.bincount(of_form, counts.form_tokens, n)
    types = np.bincount(of_form, counts.form_types, n) + np.bincount(own, shared & (head > 0), n)
    # half a token for each word and for one never seen, so that a class without any word has a share too
    share[:, -1] += 0.5 * (types + 1)
    rest = np.log10(share[:, -1])
    named = np.zeros((n, WIDTH), bool)
    named[own, cell[: len(words)]] = True
    named[:, -1] = True
    share = np.where(named, np.maximum(share, 0.5), 1e-6)
    biases = []
    for _ in range(depth + 1):
        total = share.sum(axis=1)
        biases.insert(0, np.log(share / total[:, None]).astype(np.float32))
        share = total.reshape(-1, WIDTH) if len(total) > 1 else total
    return Cells(cell, rest), Weights([np.zeros((1 << BITS[min(i, len(BITS) - 1)], WIDTH), np.float32) for i in range(depth + 1)], biases)


def _batches(features: list[np.ndarray], *more: np.ndarray) -> Iterator[tuple]:
    for i in range(0, len(more[0]), BATCH):
        yield ([f[i : i + BATCH] for f in features], *(x[i : i + BATCH] for x in more))


def train(docs: DataFrame, words: pa.Array, cell_of: Cells, w: Weights, size: int, rounds: int = 2) -> Weights:
    """One run through all training documents, which have `size` bytes, an equal share of them in each round. Every task gives moves
    as large as the weights, so it goes through TASK bytes at least, unless there are idle cores."""
    context = docs.sparkSession.sparkContext
    head = context.broadcast(numbered(words))
    for turn in range(rounds):
        shared = context.broadcast((w, cell_of))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, of = shared.value
            coder, trainer = Coder(head.value), Trainer(start)
            for batch in batches:
                for at, rows in stretches(batch.column(0), STRETCH):
                    c, forms, sizes = coder(batch.column(0).slice(at, rows))
                    for some in _batches(_contexts(c, forms, sizes), *of(c, forms, start.depth)):
                        trainer.batch(*some)
            task = TaskContext.get().partitionId()
            for block, x in trainer.moves():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([task], pa.int32()), pa.array([x], pa.binary())], names=["block", "task", "moves"])
            del trainer, start
            trim()

        def summed(table: pa.Table) -> pa.Table:
            """Touches, and moves times touches, as float32."""
            seen, moves = np.zeros(BLOCK), np.zeros((BLOCK, WIDTH))
            for x in table.sort_by("task").column("moves"):  # in one order, as sums of floats depend on it
                raw = x.as_buffer()
                k = len(raw) // (4 + 2 * WIDTH + 2)
                n = np.frombuffer(raw, np.float32, k)
                rows = np.frombuffer(raw, np.uint16, k, (4 + 2 * WIDTH) * k)
                seen[rows] += n
                moves[rows] += np.frombuffer(raw, np.float16, WIDTH * k, 4 * k).reshape(k, WIDTH).astype(np.float32) * n[:, None]
            return pa.table({"block": table.column("block")[:1], "some": pc.bit_wise_and(table.column("task")[:1], pa.scalar(63, pa.int32())), "moves": pa.array([np.concatenate((seen[:, None], moves), axis=1).astype(np.float32).tobytes()], pa.binary())})

        def total(table: pa.Table) -> pa.Table:
            out = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table.sort_by("some").column("moves"))
            return pa.table({"block": table.column("block")[:1], "moves": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

        mine = docs.where(F.col("train") & (F.pmod("dk", F.lit(rounds)) == turn)).select("text").coalesce(max(context.defaultParallelism, size // rounds // TASK))
        moved = mine.mapInArrow(run, "block int, task int, moves binary")
        some = moved.groupBy("block", (F.col("task") % 64).alias("some")).applyInArrow(summed, "block int, some int, moves binary")
        merged = some.groupBy("block").applyInArrow(total, "block int, moves binary").collect()  # the size of the weights
        w = w.copy()
        # BLOCK divides the tables: their blocks are numbered on
        for r in merged:
            x = np.frombuffer(r.moves, np.float32).reshape(BLOCK, WIDTH + 1)
            level, at = 0, r.block * BLOCK
            while at >= len(w.tables[level]):
                at -= len(w.tables[level])
                level += 1
            table, seen = w.tables[level], x[:, :1]
            moved = table[at : at + BLOCK] + np.where(seen > 0, x[:, 1:] / np.maximum(seen, 1), 0)
            table[at : at + BLOCK] = np.clip(moved, -20, 20)  # so that no sum of them is too large for exp
        shared.unpersist()
    return w


def _outside(codes: np.ndarray, in_head: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Of each text, (code, n) of its distinct words outside the dictionary."""
    c, doc = codes[~in_head], np.repeat(np.arange(len(sizes)), sizes)[~in_head]
    order = np.lexsort((c, doc))
    c, doc = c[order], doc[order]
    new = np.nonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (doc[1:] != doc[:-1]))))[0] if len(c) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(c))).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(sizes)))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(c[new].view(np.int64)), pa.array(n)], names=["code", "n"]))


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    Documents whose crc32 of the key as text is 1 modulo 5 are held out, all others train; null keys train. No score but a
    held-out document's own follows from its text. Null texts
    are empty: the end is their one token. Rows equal in key and text score alike. Without training tokens every token
    is unknown. An empty table gives no rows. `sample_docs` has no effect: all training documents are read.
    """
    named = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    named = named.withColumn("dk", F.xxhash64("key", "text")).withColumn("train", F.coalesce(_kept(), F.lit(True)))
    bounded_batches(docs.sparkSession)
    n, size = named.agg(F.count_if("train"), F.coalesce(F.sum(F.when(F.col("train"), F.octet_length("text"))), F.lit(0))).first()
    counted = word_counts(named.where("train"))
    words, counts = count_words(counted, n)
    cell_of, weights = cells(counts, words)
    weights = train(named, words, cell_of, weights, size)
    context = docs.sparkSession.sparkContext
    base = np.log10(counts.head + 0.5)
    whole = np.log10(counts.tokens + 0.5 * (counts.types + 1))
    shared = context.broadcast((weights, cell_of, base, counts.head > 0, numbered(words)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, of, logs, known, head = shared.value
        coder = Coder(head)
        for batch in batches:
            for at, rows in stretches(batch.column(3), STRETCH):
                part = batch.slice(at, rows)
                c, forms, sizes = coder(part.column(3))
                classes, cells_ = of(c, forms, w.depth)
                p = np.concatenate([log_p(w, *some) for some in _batches(_contexts(c, forms, sizes), classes, cells_)]).astype(np.float64) / np.log(10)
                in_head, num = c < DICTIONARY, np.minimum(c, DICTIONARY - 1).astype(np.int64)
                plain = np.where(in_head, logs[num], 0.0)
                # of the words of a shared cell, their share in it; the counts of words outside the dictionary come later
                p += np.where(cells_ == WIDTH - 1, plain - of.rest[classes], 0.0)
                starts = np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sizes), pa.array(np.add.reduceat(plain, starts)), pa.array(np.add.reduceat((in_head & known[num]).astype(np.int64), starts)), pa.array(np.add.reduceat(p, starts)), pa.array(np.add.reduceat((~in_head).astype(np.int64), starts)), _outside(c, in_head, sizes)],
                    names=["key", "dk", "train", "n_tokens", "head_log", "head_known", "model", "n_tail", "tail"],
                )
        trim()

    kind = named.schema["key"].dataType.simpleString()
    scored = materialize(named.select("key", "dk", "train", "text").mapInArrow(walk, f"key {kind}, dk bigint, train boolean, n_tokens bigint, head_log double, head_known bigint, model double, n_tail bigint, tail array<struct<code:bigint,n:bigint>>"), "scored")
    both = scored.drop("tail").join(tails(scored, counted), "dk", "left")
    # the words of rows equal in key and text are summed up together; each row has its share of them
    share = F.coalesce(F.col("n_tail") / F.col("tail_n"), F.lit(0.0))
    tail = F.coalesce("tail_log", F.lit(0.0)) * share
    return both.select(
        F.col("key").alias(key),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.round(F.coalesce("tail_known", F.lit(0)) * share)).cast("long").alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail - F.col("n_tokens") * F.lit(float(whole))).alias("base_score"),
        (F.col("model") + tail).alias("score"),
    )


def op8_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
