from __future__ import annotations

import hashlib
import math
import random
import re
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkrecall.llm import common
from sparkrecall.llm import licenses as L
from sparkrecall.llm import linededup as D
from sparkrecall.llm import maxent as X
from sparkrecall.llm import media as M
from sparkrecall.llm import sketches as K
from sparkrecall.llm import toxicity as T

# ---- media ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("raw", [b"", b"a", bytes(64), b"x" * 64, bytes(range(256)) * 33, "é😀".encode() * 1000])
def test_png_round_trip(raw):
    payload = M.padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= max(64, len(raw)) and payload.rstrip(b"\0") == raw.rstrip(b"\0")
    png = M.encode(payload)
    assert M.decode(png) == payload
    width, height, depth, colour = M.header(png[: M.HEADER])
    assert width * height == len(payload) and (depth, colour) == (8, 0)
    with pytest.raises(ValueError):
        M.decode(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    with pytest.raises(ValueError):
        M.header(b"x" * 33)


def test_media_columns(odd, none, tmp_path):
    folder = f"file://{tmp_path}/media"
    rows = M.media_columns(odd, folder).collect()
    assert len(rows) == odd.count()
    for r, text in [(r, dict((x.doc_id, x.text) for x in odd.collect())[r.doc_id]) for r in rows]:
        payload = M.padded((text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        with tarfile.open(f"{tmp_path}/media/{r.shard}") as tar:  # a shard is a plain tar
            member = tar.getmember(f"{r.digest}.png")
            stored = tar.extractfile(member).read()
        assert (member.offset_data, member.size) == (r.offset, r.length) and hashlib.sha256(stored).hexdigest() == r.media_sha256
        assert r.width * r.height == r.payload_bytes
    same = [r for r in rows if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]
    where = M.places(M.store(odd, folder + "2"))
    assert M.metadata(where, folder + "2").count() == len({r.digest for r in rows})
    assert M.media_columns(none).count() == 0


# ---- licences ---------------------------------------------------------------------------------------------------------


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_phrases_against_brute_force(spark, odd, none):
    rng = random.Random(1)
    bits = ["GNU", "general", "Public", "license", "apache", "CC", "BY", "MIT", "licence", "the", "under", "licensed", "émit", "cc-by", "\n", ",", "mit license mit license", "Apache License, Version 2.0"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    for df in (spark.createDataFrame(docs, "doc_id bigint, text string"), odd):
        for r in L.license_scan(df).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(r.text)
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert L.license_scan(none).count() == 0


def test_rules_and_suppression(spark):
    said = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Released under the BSD 3-Clause License": "bsd-3-clause",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "Distributed under the terms of the Mozilla Public License 2.0": "mpl-2.0",
        "All rights reserved.": "proprietary",
        "das ist mit der Lizenz": "",
        "licensed electrician": "",
    }
    df = spark.createDataFrame(list(said.items()), "text string, expected string")
    for r in L.license_scan(df).collect():
        assert r.labels == r.expected, r.text
    assert len(L.rules()) > 300


def scan(text, rules, by_lead):
    """labels and score, every rule of a place's word tried over all that follows."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found, labels, weights = [], set(), []
    for at, word in enumerate(words):
        if word not in by_lead:
            continue
        rest, here = " ".join(words[at:]), []
        for i, r, regex in by_lead[word]:
            m = regex.match(rest)
            if m:
                here.append((r.priority, at + m.group().count(" ") + 1, -i, r))
        if here:
            priority, end, _, r = max(here, key=lambda x: x[:3])
            found.append((at, end, priority, r))
            labels |= {x[3].label for x in here if x[3].base}
            weights += [x[3].weight for x in here if x[3].base]
    for d in found:
        inside = any(e[0] <= d[0] and e[1] >= d[1] and e[0] != d[0] and e[2] >= d[2] for e in found)
        around = any(d[0] < e[0] and d[1] >= e[1] and e[2] > d[2] for e in found)
        if not inside and not around:
            labels.add(d[3].label)
            weights.append(d[3].weight)
    return ",".join(sorted(labels)), max(weights, default=0.0)


def compiled():
    out = {}
    for i, r in enumerate(L.rules()):
        out.setdefault(r.lead, []).append((i, r, re.compile(f"(?:{r.regex})(?= |$)")))
    return out


def test_scan_against_brute_force(spark):
    """Every rule's shortest and longest text, its words parted in several ways, and random mixtures of them."""
    rng, rules, by_lead = random.Random(4), L.rules(), compiled()
    texts = sorted({x for r in rules for x in L.examples(r.regex)})
    assert all(any(re.fullmatch(r.regex, x) for x in [L.examples(r.regex)[1]]) for r in rules)
    docs = [(x.replace(" ", gap), i) for i, x in enumerate(texts) for gap in (" ", "\n", "  ", ", ", "\n// ")]
    more = ["the", "version 2", "Apache", "license", "gnu", "as published by", "cc", "terms of"]
    docs += [(" ".join(rng.choice(texts if rng.random() < 0.6 else more) for _ in range(rng.randint(1, 12))), -1) for _ in range(1500)]
    got = L.license_scan(spark.createDataFrame(docs, "text string, n int").repartition(8)).select("text", "n", "labels", "score").collect()
    assert len(got) == len(docs)
    for r in got:
        labels, score = scan(r.text, rules, by_lead)
        assert (r.labels, round(r.score, 6)) == (labels, round(score, 6)), r.text
        assert r.n < 0 or labels, r.text
    assert L.window_of(rules) > 30


# ---- line dedup -------------------------------------------------------------------------------------------------------


def brute(docs, least):
    """Texts after deletion: for every run of lines of enough words, all places but the first go."""
    first, out, where = {}, {}, {}
    for k, t in sorted(docs):
        first.setdefault(t, k)
    kept = sorted((k, t) for t, k in first.items())
    lines = {k: t.split("\n") for k, t in kept}
    gone = {k: set() for k, _ in kept}
    for k, _ in kept:
        n = [len(x.split()) for x in lines[k]]
        for a in range(len(n)):
            for b in range(a, len(n)):
                if sum(n[a : b + 1]) >= least:
                    where.setdefault(tuple(lines[k][a : b + 1]), []).append((k, a, b))
    for places in where.values():
        for k, a, b in sorted(places)[1:]:
            gone[k] |= set(range(a, b + 1))
    for k, t in docs:
        if first[t] != k and len(t.split()) >= least:
            out[k] = None
        else:
            g = gone[first[t]] if first[t] == k else set(gone[first[t]])
            left = [x for i, x in enumerate(t.split("\n")) if i not in g]
            out[k] = "\n".join(left) if left else None
    return out


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_dedup_against_brute_force(spark, least):
    rng = random.Random(least)
    lines = ["", "a b", "c", "d e f", "g h i j k", "l m n o p q r s t u"] + [f"u{i} v w" for i in range(12)]
    docs = []
    for i in range(120):
        if docs and rng.random() < 0.25:
            some = rng.choice(docs)[1].split("\n")
            at = rng.randrange(len(some))
            docs.append((i, "\n".join([*some[at:], *(rng.choice(lines) for _ in range(rng.randint(0, 3)))])))
        else:
            docs.append((i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"x{i} y{j} z" for j in range(rng.randint(1, 9)))))
    got = {r.doc_id: r for r in D.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=least).collect()}
    expected = brute(docs, least)
    assert {k: r.text for k, r in got.items()} == expected
    assert all(r.n_lines == len(t.split("\n")) for r, t in ((got[k], t) for k, t in docs))


def test_common_prefixes_against_brute_force(spark):
    """Ranks are in suffix order, and neighbours have in common what a plain comparison finds."""
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice(["a b", "c d", "e f", "g h"]) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    segs = D.segments(D.lines_of(df, "doc_id", "text"), 2).repartition(5)
    ranks = D.suffix_ranks(D.materialize(segs, "s"), 8)
    code = {(r.t1, r.t2, r.pos): (r.h1, r.h2) for r in segs.collect()}
    first = {r.l: r.r for r in ranks.select(F.struct("t1", "t2", "pos").alias("l"), F.col("ranks")[0].alias("r")).collect()}
    seg = {tuple(k): r for k, r in first.items()}
    suffixes = {}
    for r in ranks.collect():
        out, at = [], r.pos
        while (r.t1, r.t2, at) in code and len(out) < 8:
            out.append(seg[(r.t1, r.t2, at)])
            at += 1
        suffixes.setdefault(r.ranks[-1], set()).add(tuple(out))
    assert all(len(x) == 1 for x in suffixes.values())
    ordered = [(rank, next(iter(x))) for rank, x in sorted(suffixes.items())]
    assert [x for _, x in ordered] == sorted(x for _, x in ordered)
    lcp = {r.rank: r.lcp for r in D.common_prefixes(ranks).collect()}
    assert len(lcp) == len(ordered) > 60 and lcp[ordered[0][0]] == 0
    for (_, x), (rank, y) in zip(ordered, ordered[1:]):
        common = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert lcp[rank] == common


def test_long_passages_take_few_queries(spark, monkeypatch):
    """Windows of 66 lines: the driver's memory follows the rounds and the joins that it plans."""
    made, real = [], D.materialize

    def counted(df, name):
        made.append((name, df._jdf.queryExecution().analyzed().toString().count("Join ")))
        return real(df, name)

    monkeypatch.setattr(D, "materialize", counted)
    passage = [f"w{i % 5}" for i in range(80)]
    passage[40] = "odd"
    docs = [(i, "\n".join([f"x{i}", *passage[i:], *passage[: i * 7]])) for i in range(6)]
    got = {r.doc_id: r.text for r in D.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=66).collect()}
    assert got == brute(docs, 66) and any(got[k] != t for k, t in docs)
    assert sum(name == "ranks" for name, _ in made) <= 5
    assert max(n for name, n in made if name == "lcp") <= 10


@pytest.mark.parametrize("hot", [1, 1000])
def test_frequent_lines_and_passages(spark, monkeypatch, hot):
    """One line, and one passage, in most texts, whichever way they are joined."""
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(3)
    passage = "\n".join(f"p{i} q r s t" for i in range(4))
    docs = [(i, "\n".join([f"x{i} y", "common line of five words", *([passage] if i % 3 else []), rng.choice(["end one two", "end three four", f"end {i}"])])) for i in range(90)]
    got = {r.doc_id: r.text for r in D.line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=12).collect()}
    assert got == brute(docs, 12)


def test_line_dedup_keeps_odd_rows(odd, none):
    rows = D.line_dedup(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].text is None and by[2].n_lines == 0 and by[3].text == "" and by[3].n_lines == 1
    assert by[7].removed_lines > 1900  # its own line, again and again
    assert rows[0].asDict().keys() >= {"size", "shard", "score"}
    assert D.line_dedup(none).count() == 0


# ---- toxicity ---------------------------------------------------------------------------------------------------------


def planted(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("rin", "sol", "tem")]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.2
        for _ in range(2 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["Zwurgle", "quaxhead"]))
        out.append((i, " ".join(text), int(bad)))
    return out


def test_toxicity_finds_planted_words(spark):
    rows = planted(1500, 1)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    right = sum(got[i].predicted == bad for i, _, bad in held) / len(held)
    assert right > 0.97
    assert all(got[i].predicted == int(got[i].score >= 0.5) for i, _, _ in rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = planted(400, 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    turned = [(i, 1 - bad if zlib.crc32(str(i).encode()) % 5 == 0 else bad) for i, _, bad in rows]
    a, b = (sorted((r.doc_id, r.score) for r in T.toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()) for x in ([(r[0], r[2]) for r in rows], turned))
    assert a == b


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    rows = T.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in T.toxicity(odd, labels.limit(0)).collect()} == {0}
    assert T.toxicity(none, labels).count() == 0


def test_toxicity_against_brute_force(spark):
    """Features, ratios and scores from their definitions; the fit by its optimum: no slope is left along any weight."""
    rows = [r for r in planted(500, 7) if zlib.crc32(str(r[0]).encode()) % 5]
    texts, y = [r[1] for r in rows], [r[2] for r in rows]

    def grams(text):
        x = b" " + b" ".join(text.encode().lower().split()) + b" "
        return {(int.from_bytes(x[i : i + n], "little") * f % (1 << 64)) >> (64 - T.BITS) for n, f in zip(T.ORDERS, T._FACTORS, strict=True) for i in range(len(x) - n + 1)}

    sets = [grams(t) for t in texts]
    pos, neg = sum(y), len(y) - sum(y)
    of = {}
    for f in set().union(*sets):
        p, q = (sum(f in s for s, label in zip(sets, y, strict=True) if label == k) for k in (1, 0))
        share = (p + q) / len(y)
        of[f] = p + q, math.log((p + 1) / (pos + 2)) - math.log((q + 1) / (neg + 2)), (p - share * pos) / math.sqrt(max(share * (1 - share) * pos * neg / len(y), 1e-9))
        if not f % 37:
            assert [float(x) for x in T.ratios(np.float64(p), np.float64(q), pos, neg)] == pytest.approx(of[f][1:])
    strong = sorted(f for f, (a, _, c) in of.items() if a >= 3 and abs(c) >= 3)
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id bigint, toxic int")
    model = T.trained(docs, labels)
    assert model.features.tolist() == strong and len(strong) > 20
    few = T.trained(docs, labels, most_features=9).features.tolist()  # the strongest
    assert len(few) == 9 and min(abs(of[f][2]) for f in few) >= sorted((abs(of[f][2]) for f in strong), reverse=True)[8] - 1e-9
    place = {f: i for i, f in enumerate(strong)}
    at = [(i, place[f]) for i, s in enumerate(sets) for f in s if f in place]
    of_model = dict(zip(strong, model.weights.tolist(), strict=True))
    for t, s in zip(texts, sets, strict=True):
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-model.bias - sum(of_model.get(f, 0) for f in s))), abs=1e-5)
    fitted, bias = T.fit(np.array([i for i, _ in at]), np.array([j for _, j in at]), np.array(y, np.float64), np.array([of[f][1] for f in strong]), steps=3000)
    weights = dict(zip(strong, fitted.tolist(), strict=True))
    logit = [bias + sum(weights.get(f, 0) for f in s) for s in sets]
    error = [1 / (1 + math.exp(-x)) - label for x, label in zip(logit, y, strict=True)]
    assert abs(sum(error)) < 0.1
    for f, w in weights.items():  # of the weight w / ratio, which the penalty pulls to 0
        ratio = of[f][1]
        assert abs(ratio * sum(e for e, s in zip(error, sets, strict=True) if f in s) + 0.1 * w / ratio) < 0.1


def test_toxicity_with_clashing_names_and_bounds(spark):
    rows = planted(300, 2)
    docs = spark.createDataFrame([(i, t, 5, "x", 0.5, "h") for i, t, _ in rows], "doc_id bigint, text string, k int, y string, score double, h string")
    labels = spark.createDataFrame([(r[0], r[2], "z") for r in rows], "doc_id bigint, toxic int, text string")
    out = T.toxicity(docs, labels)
    assert sorted(out.columns) == sorted(["doc_id", "text", "k", "y", "h", "held_out", "score", "predicted"]) and out.count() == 300
    assert {(r.k, r.y, r.h) for r in out.collect()} == {(5, "x", "h")}
    assert T.trained(docs, labels, most_bytes=10).weights.any() == False  # noqa: E712
    few = T.trained(docs, labels, most_bytes=4000)
    assert np.isfinite(few.bias)


# ---- language model ---------------------------------------------------------------------------------------------------


def test_scores_against_counts(spark, odd):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "of", "Tea", "x" * rng.randint(1, 30), f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    docs += docs[:5]
    got = X.scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) == len(docs)
    count, n = {}, 0
    for k, t in docs:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            for w in X.words_of(t):
                count[w] = count.get(w, 0) + 1
                n += 1
    texts = dict(docs)
    for r in got:
        words = X.words_of(texts[r.doc_id])
        base_ = sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (len(count) + 1))) for w in words)
        assert r.base_score == pytest.approx(base_, rel=1e-9) and r.score < 0
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in count for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert X.scores(odd).count() == odd.count()


def test_dictionary_has_no_effect_on_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c w{i % 7} w{i % 11}") for i in range(60)], "doc_id bigint, text string")
    key = lambda r: (r.doc_id, round(r.base_score, 9), r.n_known)
    whole = sorted(map(key, X.scores(docs).collect()))
    assert sorted(map(key, X.scores(docs, sample_docs=3).collect())) == whole


def test_held_out_texts_teach_nothing(spark):
    """Other texts, words and lengths in the held-out documents change no other document's score."""
    rng = random.Random(4)
    text = lambda stem: " ".join(rng.choice(["the", "of", f"{stem}{rng.randint(0, 90)}", "y" * 80]) for _ in range(rng.randint(1, 40)))
    docs = [(i, text("w")) for i in range(150)]
    out = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    other = [(k, text("q") + " w1 w1 w1" * 50 if out(k) else t) for k, t in docs]
    a, b = ({r.doc_id: r for r in X.scores(spark.createDataFrame(d, "doc_id bigint, text string")).collect()} for d in (docs, other))
    kept = [k for k, _ in docs if not out(k)]
    assert 0 < len(kept) < len(docs) and all(a[k].score == b[k].score and a[k].base_score == b[k].base_score for k in kept)
    assert any(a[k].score != b[k].score for k, _ in docs if out(k))


def test_long_words_stay_off_the_driver(spark):
    docs = spark.createDataFrame([(i, "a b " + "z" * (X.LONGEST + i)) for i in range(9)], "doc_id bigint, text string")
    words = X.dictionary(docs.withColumn("dk", F.xxhash64("text")), 9, 100, 100).to_pylist()
    assert sorted(words) == ["", "a", "b", "z" * X.LONGEST]


def _counts(words, count):
    """Counts of a corpus of which `words` are the dictionary."""
    head, tokens, types = np.zeros(X.DICTIONARY, np.int64), np.zeros(X.FORMS, np.int64), np.zeros(X.FORMS, np.int64)
    for w, n in count.items():
        if w in words:
            head[words.index(w)] = n
        else:
            tokens[X.form_of(w)] += n
            types[X.form_of(w)] += 1
    return X.Counts(head, tokens, types)


def test_forms_and_codes():
    texts = ["Tea tea  été xx", "", None, " \n", "tea " * 3, "a bc déf ghij"]
    coder = X.Coder(pa.array(["", "tea", "bc"]))
    codes, forms, sizes = coder(pa.array(texts))
    words = [X.words_of(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert forms.tolist() == [X.form_of(w) for w in flat] == coder(pa.array(["x", *texts]).slice(1))[1].tolist()
    known = {X.END: 0, b"tea": 1, b"bc": 2}
    assert codes.tolist() == [known.get(w, max(xxhash.xxh64_intdigest(w, 1), X.DICTIONARY)) for w in flat]


def test_cells_are_probabilities():
    rng = np.random.default_rng(1)
    count = {b"w%d" % i: int(n) for i, n in enumerate(np.bincount(rng.zipf(1.4, 50_000) % 600)) if n}
    words = [X.END, *list(count)[:400]]
    counts = _counts(words, count | {X.END: 90})
    of, w = X.cells(counts, pa.array([x.decode() for x in words]))
    for t in w.tables:
        t += rng.normal(0, 0.3, t.shape).astype(np.float32)
    n, width = X.WIDTH**w.depth, X.WIDTH
    one = [np.full(n * width, f, np.uint64) for f in rng.integers(1 << 63, size=5, dtype=np.uint64)]
    classes, cells = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
    p = np.exp(X.log_p(w, one, classes, cells).astype(np.float64))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    # within a shared cell the words and one that was never seen share all there is
    for c in range(n):
        mine = [v for x, v in count.items() if X.classes_of(X.form_of(x), w.depth) == c and (x not in words or of.cells[words.index(x)] == width - 1)]
        assert sum(v + 0.5 for v in mine) + 0.5 == pytest.approx(10 ** of.rest[c])


def test_training_learns_a_pattern():
    """Words that follow from the word before become likelier."""
    codes = np.tile(np.arange(1, 9, dtype=np.uint64), 4000)
    words = [X.END, *(b"w%d" % i for i in range(8))]
    of, w = X.cells(_counts(words, {x: 4000 for x in words[1:]}), pa.array([x.decode() for x in words]))
    forms = np.array([X.form_of(words[int(c)]) for c in codes])
    trainer, f = X.Trainer(w), X._contexts(codes, forms, np.array([len(codes)]))
    before = X.log_p(trainer.w, f, *of(codes, forms, w.depth)).mean()
    for some in X._batches(f, *of(codes, forms, w.depth)):
        trainer.batch(*some)
    assert X.log_p(trainer.w, f, *of(codes, forms, w.depth)).mean() > before + 0.5


def test_scores_against_brute_force(spark, monkeypatch):
    """Every document's score from the trained weights, token by token: features, rows, three softmaxes, the share."""
    kept = {}
    train = X.train

    def seen(docs, words, cell_of, w, size, rounds=2):
        kept.update(words=[x.encode() for x in words.to_pylist()], w=train(docs, words, cell_of, w, size, rounds))
        return kept["w"]

    monkeypatch.setattr(X, "train", seen)
    monkeypatch.setattr(X, "DICTIONARY", 200)
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["the", "of", "tea", f"w{rng.randint(0, 300)}", f"zz{rng.randint(0, 2000)}"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    got = {r.doc_id: r for r in X.scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    words, w = kept["words"], kept["w"]
    assert any(t.any() for t in w.tables) and len(words) == 200
    count = {}
    for k, t in docs:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            for x in X.words_of(t):
                count[x] = count.get(x, 0) + 1
    n, mask, depth = X.WIDTH, (1 << 64) - 1, w.depth
    class_of = lambda x: X.form_of(x) * n**depth // X.FORMS
    number = {x: i for i, x in enumerate(words)}
    cell, rest = {}, {}
    for c in {class_of(x) for x in [*count, *words]}:
        mine = sorted((x for x in words if class_of(x) == c and count.get(x)), key=lambda x: (-count[x], number[x]))
        cell |= {x: i for i, x in enumerate(mine[: n - 1])}
        rest[c] = sum(v + 0.5 for x, v in count.items() if class_of(x) == c and x not in cell) + 0.5

    def shift(x, k):
        return x ^ (x >> k)

    def probability(context, x):
        code = lambda y: number.get(y, max(xxhash.xxh64_intdigest(y, 1), 200))
        start, before = 1 << 40, context[::-1]
        one = code(before[0]) if before else start + 1
        near, second, third = (X.form_of(before[k - 1]) if len(before) >= k else start + k for k in (1, 2, 3))
        features = [one, near, (near * 0x2545F4914F6CDD1D & mask) ^ second, second, third]
        features = [shift(shift(f, 29) * int(m) & mask, 32) for f, m in zip(features, X._MULTIPLIERS, strict=True)]
        c = class_of(x)
        total = 0.0
        for level in range(depth + 1):
            node = c // n ** (depth - level)
            right = c // n ** (depth - level - 1) % n if level < depth else cell.get(x, n - 1)
            salt = (node + 1 + (level << 20)) * 0x9E3779B97F4A7C15 & mask
            bits = X.BITS[min(level, len(X.BITS) - 1)]
            at = [(shift((features[k] * 0xD6E8FEB86659FD93 + salt) & mask, 31) * 0xBF58476D1CE4E5B9 & mask) >> (64 - bits) for k in X.USED[min(level, len(X.USED) - 1)]]
            logits = [float(w.biases[level][node][j]) + sum(float(w.tables[level][a][j]) for a in at) for j in range(n)]
            total += logits[right] - math.log(sum(map(math.exp, logits)))
        share = 0.0 if x in cell else math.log10((count.get(x, 0) + 0.5) / rest.get(c, 0.5))
        return total / math.log(10) + share

    for k, t in docs:
        ws = X.words_of(t)
        assert got[k].score == pytest.approx(sum(probability(ws[:i], x) for i, x in enumerate(ws)), rel=1e-4)


def test_cells_grow_with_the_types():
    words = pa.array(["", *(f"w{i}" for i in range(5000))])
    head = np.zeros(X.DICTIONARY, np.int64)
    head[1:5001] = np.arange(5000, 0, -1)
    before = 0
    for types, depth in ((0, 2), (20_000, 2), (1_000_000, 3), (20_000_000, 4)):
        spread = np.full(X.FORMS, types // X.FORMS)
        of, w = X.cells(X.Counts(head, spread * 3, spread), words)
        own = len({(X.classes_of(X.form_of(x.encode()), depth), c) for x, c in zip(words.to_pylist(), of.cells, strict=False) if c < X.WIDTH - 1})
        assert w.depth == depth and own > before and len(w.biases[-1]) == X.WIDTH**depth
        before = own - 1


def test_features_of_the_context():
    codes, forms = np.array([1, 2, 3, 9, 5, 2, 3, 9, 1, 2, 4, 9], np.uint64), np.array([1, 2, 3, 9, 5, 2, 3, 9, 1, 2, 4, 9])
    f = X._contexts(codes, forms, np.array([4, 4, 4]))
    assert len(f) == 5
    assert [bool(x[3] != x[7]) for x in f] == [False, False, False, False, True]  # behind 1 2 3 and 5 2 3
    assert [bool(x[3] != x[11]) for x in f] == [True, True, True, False, False]  # behind 1 2 3 and 1 2 4
    assert all(x[0] == x[4] == x[8] for x in f)


def test_scores_of_nothing(none):
    assert X.scores(none).count() == 0


# ---- sketches ---------------------------------------------------------------------------------------------------------


def test_peeling_recovers_differences():
    rng = np.random.default_rng(5)
    a, b = [], []
    for _ in range(60):
        both = rng.integers(1, 1 << 63, rng.integers(0, 300), dtype=np.uint64)
        a.append(np.concatenate((both, rng.integers(1, 1 << 63, rng.integers(0, 200), dtype=np.uint64))))
        b.append(np.concatenate((both, rng.integers(1, 1 << 63, rng.integers(0, 40), dtype=np.uint64))))
    for x, y, (only_x, only_y) in zip(a, b, K.differences(a, b), strict=True):
        assert set(only_x.tolist()) == set(x.tolist()) - set(y.tolist()) and set(only_y.tolist()) == set(y.tolist()) - set(x.tolist())


def test_paragraphs_and_repeats():
    assert K.paragraphs("One two. Three!\n\n four\n" + "w " * 50) == ["One two.", "Three!", "four", *(" ".join(["w"] * n) for n in (24, 24, 2))]
    assert len(set(K.digests("a.\na.\na.").tolist())) == 3 and len(K.digests("")) == 0


@pytest.mark.parametrize("per_stretch", [2, 5000])
def test_next_documents(spark, odd, none, per_stretch):
    rng = random.Random(6)
    docs = [(i * 3, ". ".join(f"s{rng.randint(0, 30)} t{rng.randint(0, 3)}" for _ in range(rng.randint(0, 40)))) for i in range(97)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    stretched = K.with_next(df, per_stretch=per_stretch)
    assert stretched.where("late = 0").count() == 97
    got = {r.doc_id: r for r in K.sketched(df).collect()} if per_stretch == 5000 else None
    if got is None:
        K_with = K.with_next
        K.with_next = lambda d, key, text: K_with(d, key, text, per_stretch)
        try:
            got = {r.doc_id: r for r in K.sketched(df).collect()}
        finally:
            K.with_next = K_with
    for i, (k, t) in enumerate(docs):
        n = docs[(i + 1) % len(docs)][1]
        e = K.edited(t, n)
        sets = [set(K.digests(x).tolist()) for x in (t, e, n)]
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(sets[0], sets[1])) and r.near_next == pytest.approx(like(sets[0], sets[2]))
    rows = K.sketched(odd).collect()
    assert len(rows) == odd.count()
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert K.sketched(none).count() == 0
    # keys that floating point numbers can't hold, beside null; and strings longer than any bound
    big = df.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id") + 2**60))
    texts = df.withColumn("doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.repeat(F.lit("é"), (F.col("doc_id") % 7).cast("int"))))
    told = lambda d: [tuple(r)[1:] for r in sorted(K.sketched(d).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))]
    with_next = K.with_next
    K.with_next = lambda d, key, text: with_next(d, key, text, 4)
    try:
        plain = told(df)
        assert told(texts) == plain
        assert sorted(r[1] for r in told(big)) != [] and len(told(big)) == len(plain)
        moved = {r.doc_id: r.edited_sha256 for r in K.sketched(big).collect()}
        same = {r.doc_id: r.edited_sha256 for r in K.sketched(df).collect()}
        assert all(moved[i + 2**60] == h for i, h in same.items() if i not in (0, 3, max(same)))
    finally:
        K.with_next = with_next
    (only,) = K.sketched(df.where("doc_id = 0")).collect()
    assert only.near_next == 1.0


def test_wrapped_licence_headers(spark):
    """Texts whose only stem is parted by a line end, blanks or a comment sign."""
    cases = {
        "Permission is\nhereby granted, free of charge, to any person obtaining a copy of this software": "mit",
        "// Permission is  hereby\n// granted, free of charge, to any\tperson obtaining a copy of this software": "mit",
        "Permission to\n * use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "# Redistribution\n# and use in source and binary forms, with or without modification, are permitted": "bsd",
        "a permission slip": "",
    }
    for r in L.license_scan(spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id bigint, text string")).collect():
        assert r.labels == cases[r.text] and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize("per_stretch", [5, 40, 5000])
def test_most_keys_are_null_or_alike(spark, monkeypatch, per_stretch):
    """Rows without a key, rows of one key and equal rows are dealt over the stretches, and have the right next one."""
    rng = random.Random(2)
    text = lambda: f"{rng.randint(0, 10**9)} " + "w. " * rng.randint(0, 9)
    docs = [(None, text()) for _ in range(150)] + [(None, "the same.")] * 60 + [(7, text()) for _ in range(50)] + [(7, "one two.")] * 30 + [(i, text()) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    dealt = {r.stretch: (r["own"], r.late) for r in K.with_next(df, per_stretch=per_stretch).groupBy("stretch").agg(F.count_if(F.col("late") == 0).alias("own"), F.count_if(F.col("late") == 1).alias("late")).collect()}
    assert sum(n for n, _ in dealt.values()) == len(docs) and all(late >= 1 for _, late in dealt.values())
    if per_stretch < 5000:
        assert max(n for n, _ in dealt.values()) <= 5 * per_stretch and sum(late for _, late in dealt.values()) <= 6 * len(dealt)
    with_next = K.with_next
    monkeypatch.setattr(K, "with_next", lambda d, key, text: with_next(d, key, text, per_stretch))
    ordered = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32]))
    expected = sorted(repr((k, len(t), hashlib.sha256(K.edited(t, n).encode()).hexdigest())) for (k, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in K.sketched(df).collect()) == expected


def test_dictionary_is_of_all_documents(spark):
    """The most frequent words of all documents, however few of them hold one, and ties that don't fit by one rule."""
    docs = [(i, f"a b n{i} m{i}") for i in range(400)] + [(400, "rare " * 300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("dk", F.xxhash64("doc_id", "text"))
    words = X.dictionary(df, len(docs), 10, 5).to_pylist()
    assert words[0] == "" and set(words[1:3]) == {"a", "b"} and words[3] == "rare" and len(words) == len(set(words)) == 10
    assert X.dictionary(df.repartition(3), len(docs), 10, 400).to_pylist() == words
    assert X.dictionary(df, len(docs), 5000, 5).to_pylist()[:4] == words[:4]
    counted = X.word_counts(df)
    assert counted.count() == 803 and counted.agg(F.sum("c")).first()[0] == 1900
