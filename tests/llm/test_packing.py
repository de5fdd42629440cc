from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkrecall.llm import packing as P


def check(rows, capacity=P.SEQUENCE):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_bounds_never_exceed_an_optimum():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]

        def least(left, rooms):
            if not left:
                return len(rooms)
            best = len(rooms) + len(left)
            for i, room in enumerate(rooms):
                if room >= left[0] and room not in rooms[:i]:
                    best = min(best, least(left[1:], [*rooms[:i], room - left[0], *rooms[i + 1 :]]))
            return min(best, least(left[1:], [*rooms, 20 - left[0]]))

        optimum = least(sorted(sizes, reverse=True), [])
        assert P.lower_bound(np.array(sizes), 20) <= optimum
        _, _, fill = P.best_fit_decreasing(np.array(sorted(sizes, reverse=True)), 20)
        assert optimum <= len(fill)
    assert P.lower_bound(np.array([1025] * 7)) == 7 and P.lower_bound(np.array([683] * 4)) == 2 and P.lower_bound(np.array([], np.int64)) == 0


def test_best_fit():
    bins, places, fill = P.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and places.tolist() == [0, 0, 6, 5, 8] and fill.tolist() == [10, 10]


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_pack(spark, part_rows):
    rng = random.Random(2)
    lengths = [rng.choice([2048, rng.randint(900, 1100), rng.randint(600, 800), rng.randint(1, 2048)]) for _ in range(900)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, length bigint")
    rows = P.pack(df, part_rows=part_rows).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    used, bound = check(rows), P.lower_bound(np.array(lengths))
    assert bound <= used <= bound * (1.03 if part_rows > 900 else 1.06) + 1


def test_pack_with_clashing_names(spark):
    df = spark.createDataFrame([(i, 100 + i, "x", 5, "y", 2.0) for i in range(50)], "doc_id bigint, length bigint, offset string, __bin int, part string, bins double")
    out = P.pack(df)
    assert out.columns == ["doc_id", "length", "part", "bins", "sequence_id", "offset"] and out.count() == 50
    assert {(r.part, r.bins) for r in out.collect()} == {("y", 2.0)}


def test_exchange_saves_bins(spark):
    """Parts of few rows each leave a loose bin; after the exchange fewer are left than the parts had."""
    df = spark.createDataFrame([(i, 700) for i in range(200)], "doc_id bigint, length bigint")
    assert check(P.pack(df, part_rows=5).collect()) <= 110


def test_ids_are_those_of_whole_texts():
    texts = ["", None, "a b  c", "It's <|endoftext|> x<|startoftext|>y <| |>", "ΣΑΣ. σας. é é ́x", "\x1c a\x1db \x85 c", "ﬁ İI ı 12345 ½", "  \n\t", "日本語 😀👍🏽 ♥ a♥b", "'s 'tis we'll. word.. word.,", "éÉ É ẞ straße ǅ ª Ｆｕｌｌ.", "word " * 3000]
    whole = P.WordTokenizer(P.tokenizer_path()).tokenizer
    for t, got in zip(texts, P.token_ids(pa.array(texts), P.tokenizer_path()), strict=True):
        assert got == array("I", whole.encode(t or "", add_special_tokens=False).ids).tobytes() + b"\0\0\0\0"


def test_odd_documents(odd, none):
    rows = P.pack_documents(odd).collect()
    check(rows)
    whole = P.WordTokenizer(P.tokenizer_path()).tokenizer
    docs = {r.doc_id: r.text for r in odd.collect()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for key, text in docs.items():
        ids = array("I", [*whole.encode(text or "", add_special_tokens=False).ids, 0])
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[key]})
        expected = [(i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
        assert mine == expected
    assert len(pieces[1]) == 2  # the repeated row is a document of its own
    assert P.pack_documents(none).count() == 0
