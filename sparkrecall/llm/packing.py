"""Packing token sequences: best-fit decreasing in partitions, certified by lower bounds, repacked where they gap.

A partition is packed by best-fit decreasing. Dual-feasible functions bound from below the bins that any packing of the
same lengths needs; a partition that uses no more is certified and done, but for its loosest bin. Those that use more
give up their loosest bins. The documents in these are exchanged between the partitions and packed again. Rounds go on
while they save bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, materialize, merged, stretches, trim

SEQUENCE = 2048


def lower_bound(lengths: np.ndarray, capacity: int = SEQUENCE) -> int:
    """The most bins that a family of dual-feasible functions proves necessary.

    Integer forms of u(k): x to floor((k+1) x / C) C / k, or x where (k+1) x / C is whole; and of f(l): x above C - l
    to C, below l to 0. Sums over all lengths of such a function, divided by C, bound the bins from below.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ x) // capacity)
    # f(l) for every l at once: lengths above C - l count C, those from l to C - l themselves
    upto, words = np.cumsum(count), np.cumsum(count * x)
    l = np.arange(1, capacity // 2 + 1)
    f = (upto[-1] - upto[capacity - l]) * capacity + words[capacity - l] - words[l - 1]
    best = max(best, int(-(-f.max() // capacity)))
    for k in range(1, 101):  # times k, to stay whole
        v = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int(count @ v) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each item (sorted by falling length): its bin and its place in it; and the bins' fill. Lengths: 1 to capacity."""
    bins, places, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, n in enumerate(lengths.tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, places, np.array(fill, np.int64)


def loosest(fill: np.ndarray, gap: int, capacity: int = SEQUENCE) -> np.ndarray:
    """Which bins a partition gives up. With a gap, the loosest, until they have room for gap + 1 whole bins, and as many
    more. Certified, the loosest one, if it isn't full: bounds are rounded up in each partition, and what that loses over
    all partitions is saved where these bins' documents meet."""
    out = np.zeros(len(fill), bool)
    order = np.argsort(fill, kind="stable")
    if gap > 0:
        enough = int(np.searchsorted(np.cumsum(capacity - fill[order]), (gap + 1) * capacity)) + 1
        out[order[: max(32, 2 * enough)]] = True
    elif len(fill) and fill[order[0]] < capacity:
        out[order[0]] = True
    return out


def _packed(parts: DataFrame, capacity: int) -> DataFrame:
    """`parts` (doc row columns, length, __row, __part) with __bin, offset, __bins, __bound, __open."""
    names = [f for f in parts.schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("__row", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, places, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        n = table.num_rows
        for name, values in (("__bin", bins), ("offset", places), ("__bins", np.full(n, len(fill))), ("__bound", np.full(n, bound)), ("__open", loosest(fill, len(fill) - bound, capacity)[bins])):
            table = table.append_column(name, pa.array(values))
        return table

    return parts.groupBy("__part").applyInArrow(pack, f"{kinds}, __bin bigint, offset bigint, __bins bigint, __bound bigint, __open boolean")


def pack(pieces: DataFrame, capacity: int = SEQUENCE, part_rows: int = 50_000, max_rounds: int = 8) -> DataFrame:
    """`pieces` (with a bigint column length, 1 to capacity) with bigint sequence_id and offset.

    Every row is packed, equal rows too. Which of equal lengths goes where follows the rows' numbers in the table that
    is written first. Partitions have about part_rows rows. Columns named sequence_id and offset, and those that begin with
    two underscores, are replaced; all others stay.
    """
    pieces = pieces.drop("sequence_id", "offset", *(c for c in pieces.columns if c.startswith("__")))
    names = pieces.columns
    left = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    done: list[DataFrame] = []
    bins_before = None
    previous = None
    for turn in range(max_rounds):
        n = left.count()
        if n == 0:
            break
        parts = max(1, -(-n // part_rows))
        part = F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(parts))
        now = materialize(_packed(left.select(*names, "__row", part.alias("__part")), capacity), "packed")
        per = now.groupBy("__part").agg(F.max("__bins").alias("bins"), F.max("__bound").alias("bound"))
        bins = per.agg(F.sum("bins")).first()[0]
        if bins_before is not None and bins >= bins_before:  # nothing saved: what was there before holds
            done.append(previous)
            return _numbered(done, names)
        opened = now.where("__open")
        done.append(now.where("not __open").withColumn("__turn", F.lit(turn)))
        previous = opened.withColumn("__turn", F.lit(turn))
        bins_before = opened.select("__part", "__bin").distinct().count()
        left = opened.select(*names, "__row")
        if bins_before == 0:
            return _numbered(done, names)
    if previous is not None:
        done.append(previous)
    if not done:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).limit(0)
    return _numbered(done, names)


def _numbered(done: list[DataFrame], names: list[str]) -> DataFrame:
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # bins are fewer than rows in a part, parts fewer than 2^30, turns fewer than 8
    number = F.shiftleft(F.col("__turn").cast("long"), 60) + F.shiftleft(F.col("__part").cast("long"), 30) + F.col("__bin")
    return out.select(*names, number.alias("sequence_id"), "offset")


#: A sign that is one token where it stands alone. It parts words that are encoded in one call; words that hold it,
#: or what a special token begins with, are encoded alone.
_PART, _SPECIAL = "♥", "<|"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE has for each byte: printable ones are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and has no token across any.

    A text's ids are those of its words one after the other, so each distinct word of some texts is encoded once, and the
    texts are put together from the words' ids by Arrow. White space here is U+0020 and U+0009 to U+000D; other space
    stays inside the words, where the tokenizer drops it. What the tokenizer does before its merges (normal form, lower
    case, cutting into letters, digits and marks, bytes as letters) changes nothing about words of lower-case letters but
    the last; these go straight to the merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.letters = _byte_letters() | {32: " "}  # blanks stay
        (self.part,) = self.tokenizer.encode(_PART, add_special_tokens=False).ids

    def _encoded(self, words: list[str], letters: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The words' ids, and how many each has, in groups."""
        ids, sizes = [], []
        for at in range(0, len(words), 50_000):
            texts = [f" {_PART} ".join(words[i : i + 500]) for i in range(at, min(at + 50_000, len(words)), 500)]
            if letters:
                found = self.merges.encode_batch_fast([t.encode().decode("latin-1").translate(self.letters) for t in texts], add_special_tokens=False)
            else:
                found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for one in found:
                x = np.array(one.ids, np.uint32)
                cuts = np.nonzero(x == self.part)[0]
                sizes.append(np.diff(np.concatenate(([-1], cuts, [len(x)]))) - 1)
                ids.append(x[x != self.part])
        return ids, sizes

    def words(self, distinct: pa.Array) -> pa.ListArray:
        """list<uint32> of each word."""
        plain = pc.and_(pc.utf8_is_alpha(distinct), pc.equal(pc.utf8_lower(distinct), distinct))
        odd = pc.or_(pc.match_substring(distinct, _PART), pc.match_substring(distinct, _SPECIAL))
        plain, odd = plain.to_numpy(zero_copy_only=False), odd.to_numpy(zero_copy_only=False)
        texts = distinct.to_pylist()
        for i in np.nonzero(plain & ~distinct_ascii(distinct))[0].tolist():
            plain[i] = is_normalized("NFC", texts[i])
        places, ids, sizes = [], [], []
        for mine, letters in ((np.nonzero(plain & ~odd)[0], True), (np.nonzero(~plain & ~odd)[0], False)):
            x, n = self._encoded([texts[i] for i in mine.tolist()], letters)
            places.append(mine)
            ids += x
            sizes += n
        alone = np.nonzero(odd)[0]
        for i in alone.tolist():
            ids.append(np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32))
            sizes.append(np.array([len(ids[-1])]))
        place, size = np.concatenate((*places, alone)), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.uint32)))
        back = np.empty(len(place), np.int64)
        back[place] = np.arange(len(place))
        return found.take(pa.array(back))

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """uint32 ids of each text; null as empty."""
        texts = pc.fill_null(texts, "")
        # special tokens are such in the case they are written in; else A-Z in lower case, as the tokenizer has them
        texts = pc.if_else(pc.match_substring(texts, _SPECIAL), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        many = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        words = self.words(coded.dictionary)
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.concatenate(([0], np.cumsum(size[coded.indices.to_numpy()])))
        ends = sizes[np.concatenate(([0], np.cumsum(many)))]
        ids = words.take(coded.indices).flatten().to_numpy()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]


def distinct_ascii(words: pa.Array) -> np.ndarray:
    return pc.string_is_ascii(words).to_numpy(zero_copy_only=False)


_tokenizers: dict[str, WordTokenizer] = {}


def token_ids(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Each text's ids and id 0 after them, little-endian."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    for ids in _tokenizers[path].ids(texts):
        yield ids.astype("<u4").tobytes() + b"\0\0\0\0"


def pieces_of(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids, cut only where they are more than capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, 10 << 20):  # a word is encoded once in each stretch
            for at, n in stretches(batch.column(1), 12 << 20):
                rows, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(token_ids(batch.column(1).slice(at, n), path), at):
                    for i in range(0, len(ids), 4 * capacity):
                        one = ids[i : i + 4 * capacity]
                        rows.append(row)
                        piece.append(i // (4 * capacity))
                        start.append(i // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[key, "piece", "start", "length", "ids_crc32"])
        _tokenizers.clear()
        trim()

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset). Null and empty texts are the one id 0.

    Keys may be null or repeat; each row is a document. Other columns are ignored. An empty table gives no rows.
    """
    return pack(pieces_of(docs, path or tokenizer_path(), key, text))


def op7_bound_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
