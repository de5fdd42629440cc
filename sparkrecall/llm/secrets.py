"""Secret scans: fixed patterns, and a linear-chain conditional random field over all tokens of a text.

A token is a run of ASCII letters, digits, underscores and characters beyond ASCII; a text is one chain of them. The field
tags each as the begin of a secret, inside one, or outside, from hashed features: the token's shape (which characters, how
many, how often they change), the words before and after it, what stands between it and its neighbours, and what the
whole file is like. Its weights are trained here on windows of tokens that the patterns label. Each window with a secret is
there again, OTHERS times, with a random one of another alphabet and length in its place, and each window with its
neighbours and its file hidden, so that the field knows secrets by their shapes or their places where no pattern has them.

Decoding is Viterbi's, and exact: where `outside` leads by more than any change of tags could win back through
transitions, it is on the best path for certain, which parts the chain into short runs. Runs of one length are decoded
together.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, lowest, stretches, trim

#: Kinds of spans, in the order in which they are listed where they start together; the last is the field's.
KINDS = ("assign", "access", "hex", "crf")
# the contract's patterns; no hexadecimal run or access key is longer than the token that it stands in
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
_MAY_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

BEGIN, INSIDE, OUTSIDE = range(3)
BITS = 16
#: Bytes of text whose tokens are looked at together.
STRETCH = 1 << 22
#: Tokens on either side of a labelled one in a training window, and the most in one.
AROUND, LONGEST = 8, 40
#: The length from which a token without a pattern may be a secret.
UNSURE = 12
#: Alphabets of secrets that stand in for those of the patterns, and signs that may part them.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
SIGNS = ("", "", "-", ".", "+/")
OTHERS = 3

_TOKEN = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
_BYTES = bytes(b if _TOKEN[b] else 32 for b in range(256))
#: Kinds of characters: small letter beyond f, a to f, capital, digit, underscore, beyond ASCII.
_CLASS = np.array([5 if b >= 128 else 4 if b == 95 else 3 if 48 <= b < 58 else 2 if 65 <= b < 91 else 1 if 97 <= b < 103 else 0 for b in range(256)], np.uint8)
_VOWEL = np.isin(np.arange(256), list(b"aeiouAEIOU"))


def base_spans(raw: bytes, assign: bool = True, others: bool = True) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the patterns' matches, in bytes, by start and kind."""
    out = []
    if assign:
        out += [(0, *m.span(), m.start(2)) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if others:
        out += [(1, *m.span(), m.start()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
        out += [(2, *m.span(), m.start()) for m in _HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[1], s[0]))


class Tokens:
    """The tokens of some texts: `of` the text, `start` and `end` in `data`; and their codes in `words`."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.string()), "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.bounds, raw = at - at[0], (data.to_pybytes() if data else b"")[at[0] : at[-1]]
        self.raw, self.data = raw, np.frombuffer(raw, np.uint8)
        inside = np.concatenate((_TOKEN[self.data], [False]))
        before = np.concatenate(([False], inside[:-1]))
        before[self.bounds[:-1][self.bounds[:-1] < len(before)]] = False  # texts follow each other without a gap
        self.start = np.nonzero(inside & ~before)[0]
        stop = ~inside
        stop[self.bounds[:-1]] = True
        stops = np.nonzero(stop)[0]
        self.end = stops[np.searchsorted(stops, self.start, side="right")] if len(self.start) else self.start
        self.of = np.searchsorted(self.bounds, self.start, side="right") - 1
        plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(self.bounds.astype(np.int32)), pa.py_buffer(raw.translate(_BYTES))])
        flat = pc.ascii_split_whitespace(plain).flatten()
        coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)


def _slot(kind: int, value: np.ndarray) -> np.ndarray:
    """The row of weights of a feature's value. Row 0 is no feature's."""
    with np.errstate(over="ignore"):
        x = (value.astype(np.uint64) + np.uint64(kind << 58)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(x >> np.uint64(64 - BITS), 1).astype(np.int32)


def _shapes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: which characters it has and how long it is; digits and changes; vowels and length."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    first, n = offsets[:-1] - offsets[0], np.diff(offsets)
    kinds = _CLASS[data]
    total = lambda x: np.add.reduceat(x.astype(np.int64), first)  # noqa: E731  no word is empty
    has = sum((total(kinds == k) > 0).astype(np.int64) << k for k in range(6))
    changed = np.concatenate(([False], (kinds[1:] > 1) != (kinds[:-1] > 1)))
    changed[first] = False
    size = np.searchsorted([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64], n)
    part = lambda x: np.searchsorted([0.01, 0.1, 0.2, 0.35, 0.5, 0.7, 0.99], total(x) / n)
    return has * 16 + size, part(kinds == 3) * 8 + np.minimum(total(changed), 7), part(_VOWEL[data]) * 16 + size


def files_of(t: Tokens) -> np.ndarray:
    """What each text is like: how many tokens it has, how many of them have digits, and how many signs go with a token."""
    texts, number = len(t.bounds) - 1, (_shapes(t.words)[0] >> 4 & 8) > 0
    tokens = np.bincount(t.of, minlength=texts)
    numbers = np.bincount(t.of, weights=number[t.code], minlength=texts) / np.maximum(tokens, 1)
    total = np.concatenate(([0], np.cumsum(np.isin(t.data, list(b"=:{}\"'")))))
    signs = np.diff(total[t.bounds]) / np.maximum(tokens, 1)
    return np.searchsorted([16, 128, 1024, 8192], tokens) * 16 + np.searchsorted([0.001, 0.02, 0.2], numbers) * 4 + np.searchsorted([0.001, 0.02, 0.2], signs)


def features(t: Tokens, files: np.ndarray | None = None) -> list[np.ndarray]:
    """The rows of weights of each token, one array for each kind of feature. Kinds from CONTEXT on look beyond
    the token. `files` says what the texts' files are like; without it they are the texts."""
    n = len(t)
    shape, digits, vowels = _shapes(t.words)
    short = pc.less_equal(pc.binary_length(t.words), 20).to_numpy(zero_copy_only=False) & ((shape >> 4 & 8) == 0) if n else np.zeros(0, bool)
    lower = pc.ascii_lower(t.words).to_pylist()
    # words without digits are known by themselves, others by their shapes
    word = np.fromiter((xxhash.xxh32_intdigest(w) if s else 0 for w, s in zip(lower, short, strict=True)), np.int64, len(lower))
    word = np.where(short, word + (1 << 20), shape)
    own, who = shape[t.code], word[t.code]
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = t.of[1:] != t.of[:-1]
    last[:-1] = first[1:]

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        """x of the k-th token before (after, if k < 0) in the same text; -1 without one."""
        out = np.full(n, -1, np.int64)
        if abs(k) < n:
            to, of = (slice(k, None), slice(None, n - k)) if k > 0 else (slice(None, n + k), slice(-k, None))
            out[to] = np.where(t.of[to] == t.of[of], x[of], -1)
        return out

    byte = lambda at, there: np.where(there, t.data[np.clip(at, 0, max(len(t.data) - 1, 0))].astype(np.int64), 256) if n else at
    gap = np.minimum(t.start - shifted(t.end, 1), 4)
    bounds = t.bounds[t.of], t.bounds[t.of + 1]
    before = byte(t.start - 1, t.start > bounds[0]) * 512 * 8 + byte(shifted(t.end, 1), ~first) * 8 + gap
    after = byte(t.end, t.end < bounds[1]) * 512 + byte(shifted(t.start, -1) - 1, ~last)
    file = files_of(t) if files is None else files
    kind = own >> 4
    plain = [own, digits[t.code], vowels[t.code], np.zeros(n, np.int64)]
    context = [file[t.of] * 64 + kind, shifted(who, 1) + 1, shifted(who, 2) + 1, shifted(who, -1) + 1, before, after, before * 64 + kind, shifted(kind, 1) * 64 + kind + 64]
    return [_slot(k, x) for k, x in enumerate([*plain, *context])]


#: Kinds of features that look at the token alone, and all.
CONTEXT, ALL = 4, 12


@dataclass
class Model:
    """Weights of the features' rows for each tag, of tag after tag, and of a text's first tag."""

    weights: np.ndarray
    after: np.ndarray
    first: np.ndarray

    def scores(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t), 3), np.float32)
        for rows in features(t):
            out += self.weights.take(rows, axis=0)
        return out

    def tags(self, t: Tokens) -> np.ndarray:
        """The best path's tags."""
        return viterbi(self.scores(t), t.of, self.after, self.first)


def viterbi(scores: np.ndarray, of: np.ndarray, after: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tags of the best path through each text's chain (of equally good ones the one with the lower tags, from the end)."""
    n = len(scores)
    tags = np.full(n, OUTSIDE, np.int8)
    # another tag than OUTSIDE changes two transitions at most
    most = 2 * float(after.max() - after.min()) + float(first.max() - first.min()) + 1e-3
    begins = np.ones(n, bool)
    begins[1:] = of[1:] != of[:-1]
    ends = np.ones(n, bool)
    ends[:-1] = begins[1:]
    open_ = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= most
    starts = np.nonzero(open_ & (begins | ~np.concatenate(([False], open_[:-1]))))[0] if n else np.zeros(0, np.int64)
    stops = np.nonzero(open_ & (ends | ~np.concatenate((open_[1:], [False]))))[0] + 1 if n else starts
    sizes = stops - starts
    for size in np.unique(sizes):
        at = starts[sizes == size]
        best = scores[at] + np.where(begins[at][:, None], first, after[OUTSIDE])
        back = []
        for i in range(1, size):
            ways = best[:, :, None] + after
            back.append(ways.argmax(axis=1))
            best = ways.max(axis=1) + scores[at + i]
        tag = (best + np.where(ends[at + size - 1][:, None], 0, after[:, OUTSIDE])).argmax(axis=1)
        for i in range(size - 1, -1, -1):
            tags[at + i] = tag
            if i:
                tag = back[i - 1][np.arange(len(at)), tag]
    return tags


def likelihood(rows: np.ndarray, tags: np.ndarray, mask: np.ndarray, m: Model) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The mean log-likelihood of windows, and its slopes by score, transition and first tag.

    `rows` is [window, token, feature], `tags` and `mask` (whether a token is there) [window, token].
    """
    n, length = tags.shape
    e = m.weights[rows].sum(axis=2, dtype=np.float64)
    every = np.arange(n)

    def total(x: np.ndarray) -> np.ndarray:
        top = x.max(axis=1)
        return top + np.log(np.exp(x - top[:, None]).sum(axis=1))

    ahead = np.empty((n, length, 3))
    ahead[:, 0] = m.first + e[:, 0]
    for i in range(1, length):
        ahead[:, i] = np.where(mask[:, i, None], total(ahead[:, i - 1, :, None] + m.after) + e[:, i], ahead[:, i - 1])
    rest = np.zeros((n, length, 3))
    for i in range(length - 2, -1, -1):
        rest[:, i] = np.where(mask[:, i + 1, None], total((m.after + (e[:, i + 1] + rest[:, i + 1])[:, None, :]).transpose(0, 2, 1)), 0)
    whole = total(ahead[:, -1])
    share = np.exp(ahead + rest - whole[:, None, None]) * mask[:, :, None]
    pairs = np.zeros((3, 3))
    value = m.first[tags[:, 0]] + np.where(mask, e[every[:, None], np.arange(length), tags], 0).sum(axis=1)
    for i in range(1, length):
        some = mask[:, i]
        p = np.exp(ahead[some, i - 1, :, None] + m.after + (e[some, i] + rest[some, i])[:, None, :] - whole[some, None, None])
        pairs -= p.sum(axis=0)
        np.add.at(pairs, (tags[some, i - 1], tags[some, i]), 1)
        value[some] += m.after[tags[some, i - 1], tags[some, i]]
    share = -share
    share[every[:, None], np.arange(length), tags] += mask
    return float((value - whole).mean()), share / n, pairs / n, share[:, 0].sum(axis=0) / n


def fit(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 80, rate: float = 0.3, penalty: float = 1e-5) -> Model | None:
    """The field trained on windows of (rows [token, feature], tags); each counts twice, once with its neighbours hidden.
    None without a secret among them."""
    if not any((t != OUTSIDE).any() for _, t in windows):
        return None
    length = max(len(t) for _, t in windows)
    rows = np.zeros((len(windows), length, ALL), np.int32)
    tags, mask = np.zeros((len(windows), length), np.int64), np.zeros((len(windows), length), bool)
    for i, (r, t) in enumerate(windows):
        rows[i, : len(t)], tags[i, : len(t)], mask[i, : len(t)] = r, t, True
    hidden = rows.copy()
    hidden[:, :, CONTEXT:] = 0
    rows, tags, mask = np.concatenate((rows, hidden)), np.concatenate((tags, tags)), np.concatenate((mask, mask))
    used, small = np.unique(rows, return_inverse=True)
    small = small.reshape(rows.shape)
    m = Model(np.zeros((len(used), 3), np.float64), np.zeros((3, 3)), np.zeros(3))
    seen = [np.full_like(x, 1e-6) for x in (m.weights, m.after, m.first)]
    for _ in range(steps):
        _, score, after, first = likelihood(small, tags, mask, m)
        flat = small.reshape(-1)
        slope = np.stack([np.bincount(flat, np.repeat(score[:, :, k].reshape(-1), ALL), len(used)) for k in range(3)], axis=1) - penalty * m.weights
        slope[used == 0] = 0
        for x, s, g in zip((m.weights, m.after, m.first), seen, (slope, after, first), strict=True):
            s += g * g
            x += rate * g / np.sqrt(s)
    weights = np.zeros((1 << BITS, 3), np.float32)
    weights[used] = m.weights
    weights[0] = 0
    return Model(weights, m.after.astype(np.float32), m.first.astype(np.float32))


def _marked(t: Tokens, texts: int) -> tuple[dict[int, list], np.ndarray]:
    """The patterns' spans of the texts that have any, in bytes of the text; and each token's tag by them."""
    plain = pa.Array.from_buffers(pa.string(), texts, [None, pa.py_buffer(t.bounds.astype(np.int32)), pa.py_buffer(t.raw)])
    may = pc.match_substring_regex(plain, _MAY_ASSIGN).to_numpy(zero_copy_only=False)
    long = np.zeros(texts, bool)
    long[t.of[t.end - t.start >= min(LEAST_ACCESS, LEAST_HEX)]] = True
    found, tags = {}, np.full(len(t), OUTSIDE, np.int8)
    for i in np.nonzero(may | long)[0]:
        at = t.bounds[i]
        spans = base_spans(t.raw[at : t.bounds[i + 1]], may[i], long[i])
        if spans:
            found[int(i)] = spans
            for _, _, end, value in sorted(spans, key=lambda s: (s[3], -s[2])):
                a, b = np.searchsorted(t.end, at + value, side="right"), np.searchsorted(t.start, at + end, side="left")
                if a < b and (tags[a:b] == OUTSIDE).all():
                    tags[a], tags[a + 1 : b] = BEGIN, INSIDE
    return found, tags


def _windows(t: Tokens, tags: np.ndarray, texts: int) -> Iterator[tuple[int, int]]:
    """First and last token (exclusive) of what a text teaches: around its secrets, around two tokens with digits that are
    none, and at one place that its bytes choose. Tokens that no pattern marks and that may be secrets by their looks (of
    UNSURE characters or more, letters and digits by turns) teach neither: there is no window without a secret around them."""
    ends = np.searchsorted(t.of, np.arange(texts + 1))
    shape, digits, _ = _shapes(t.words)
    number = (shape >> 4 & 8) > 0
    unsure = number & (digits % 8 >= 3) & (pc.binary_length(t.words).to_numpy(zero_copy_only=False) >= UNSURE) if len(t) else number
    out = tags == OUTSIDE
    numbers, before = (number[t.code] & out, np.concatenate(([0], np.cumsum(unsure[t.code] & out)))) if len(t) else (out, np.zeros(1, int))
    for i in range(texts):
        a, b = int(ends[i]), int(ends[i + 1])
        if a < b:
            places = [*(a + np.nonzero(tags[a:b] == BEGIN)[0][:3]), *(a + np.nonzero(numbers[a:b])[0][:2]), a + xxhash.xxh32_intdigest(t.raw[t.bounds[i] : t.bounds[i + 1]]) % (b - a)]
            for at in places:
                to = at + 1
                while to < b and tags[at] == BEGIN and tags[to] == INSIDE:
                    to += 1
                x, y = max(a, int(at) - AROUND), min(b, int(to) + AROUND, int(at) + LONGEST - AROUND)
                if (tags[x:y] == BEGIN).any() or before[x] == before[y]:
                    yield x, y


def _another(t: Tokens, tags: np.ndarray, a: int, b: int, files: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tags) of the window of tokens a to b with a random secret, its i-th, in the place of its first one."""
    at = a + int(np.argmax(tags[a:b] == BEGIN))
    to = at + 1
    while to < b and tags[to] == INSIDE:
        to += 1
    raw = t.raw[t.start[a] : t.end[b - 1]]
    rng = random.Random(xxhash.xxh64_intdigest(raw, i))
    letters, sign = rng.choice(ALPHABETS), rng.choice(SIGNS)
    sizes = [rng.randint(4, 24) for _ in range(rng.randint(2, 5))] if sign else [rng.randint(12, 64)]
    new = sign[:1].join("".join(rng.choice(letters + sign[1:]) for _ in range(n)) for n in sizes).encode()
    first = int(t.start[at] - t.start[a])
    w = Tokens(pa.array([(raw[:first] + new + raw[int(t.end[to - 1] - t.start[a]) :]).decode()]))
    own = np.full(len(w), OUTSIDE, np.int8)
    x, y = np.searchsorted(w.end, first, side="right"), np.searchsorted(w.start, first + len(new), side="left")
    own[x:y] = INSIDE
    own[x : x + 1] = BEGIN
    return np.stack(features(w, files[t.of[a : a + 1]]), axis=1)[:LONGEST], own[:LONGEST]


def trained(docs: DataFrame, text: str = "text", sample_docs: int = 20_000, most_windows: int = 2000) -> Model | None:
    """The field of windows from about `sample_docs` of the documents, those with low hashes of their texts. Of the windows
    with secrets and of those without, each counted once however often it occurs, at most half of `most_windows` are taken,
    by their hashes. These, of LONGEST tokens at most, are all that reaches the driver."""
    named = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in stretches(batch.column(0), STRETCH):
                t = Tokens(batch.column(0).slice(at, n))
                _, tags = _marked(t, n)
                files = files_of(t)
                rows = np.stack(features(t, files), axis=1)
                out = []
                for a, b in _windows(t, tags, n):
                    some = bool((tags[a:b] == BEGIN).any())
                    for r, own in [(rows[a:b], tags[a:b]), *(_another(t, tags, a, b, files, i) for i in range(OTHERS * some))]:
                        raw = r.astype("<i4").tobytes() + own.tobytes()
                        out.append((xxhash.xxh64_intdigest(raw) >> 1, some, raw))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.bool_(), pa.binary()))], names=["h", "some", "raw"])
        trim()

    sample = named.where(F.xxhash64("text") <= lowest(sample_docs, named.count()))
    place = F.row_number().over(W.partitionBy("some").orderBy("h"))
    windows = sample.mapInArrow(cut, "h bigint, some boolean, raw binary").dropDuplicates(["h"]).withColumn("place", place).where(F.col("place") <= most_windows // 2).orderBy("h").collect()

    def read(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw) // (4 * ALL + 1)
        return np.frombuffer(raw, "<i4", n * ALL).reshape(n, ALL), np.frombuffer(raw, np.int8, n, 4 * n * ALL)

    return fit([read(r.raw) for r in windows])


def _stated(raw: bytes, base: list, added: list[tuple[int, int]]) -> tuple[str, str, list[int]]:
    """The patterns' spans and all, as text in code points; and the numbers of the first by kind."""
    point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))  # code points before each byte
    say = lambda spans: ",".join(f"{KINDS[k]}:{point[a]}:{point[b]}" for k, a, b in spans)
    plain = [s[:3] for s in base]
    every = sorted([*plain, *((3, a, b) for a, b in added)], key=lambda s: (s[1], s[0]))
    return say(plain), say(every), [sum(s[0] == k for s in plain) for k in range(3)]


def _added(t: Tokens, tags: np.ndarray, base: dict[int, list]) -> dict[int, list[tuple[int, int]]]:
    """The field's spans, in bytes of the text, that touch none of the patterns'."""
    out: dict[int, list] = defaultdict(list)
    some = np.nonzero(tags != OUTSIDE)[0]
    if len(some):
        new = np.concatenate(([True], (np.diff(some) > 1) | (tags[some[1:]] == BEGIN) | (t.of[some[1:]] != t.of[some[:-1]])))
        for run in np.split(some, np.nonzero(new)[0][1:]):
            i = int(t.of[run[0]])
            a, b = int(t.start[run[0]] - t.bounds[i]), int(t.end[run[-1]] - t.bounds[i])
            if not any(a < end and start < b for _, start, end, _ in base.get(i, [])):
                out[i].append((a, b))
    return out


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 20_000, most_windows: int = 2000) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_spans, spans) of every row of `docs`: numbers of the patterns' matches, these, and
    these with the field's spans that touch none of them, as kind:start:end in code points.

    Null texts are empty, and an empty text has no span. Equal texts have equal results. Null and repeated keys are rows like
    others, other columns are ignored, and an empty table gives no rows. Without any match of a pattern in the sample
    there is nothing to learn from, and the patterns' spans are all.
    """
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained(named, sample_docs=sample_docs, most_windows=most_windows))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, n in stretches(batch.column(1), STRETCH):
                part = batch.slice(at, n)
                t = Tokens(part.column(1))
                base, _ = _marked(t, n)
                added = _added(t, model.tags(t), base) if model is not None else {}
                counts, said, every = np.zeros((3, n), np.int64), [""] * n, [""] * n
                for i in {*base, *added}:
                    said[i], every[i], counts[:, i] = _stated(t.raw[t.bounds[i] : t.bounds[i + 1]], base.get(i, []), added.get(i, []))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(said, pa.string()), pa.array(every, pa.string())], names=["key", "n_assign", "n_access", "n_hex", "base_spans", "spans"])
        trim()

    kind = named.schema["key"].dataType.simpleString()
    return named.mapInArrow(walk, f"key {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string").withColumnRenamed("key", key)


def op13_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
