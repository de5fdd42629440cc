from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkrecall.llm import secrets as S

PATTERNS = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base(text):
    spans = [(m.start(), k, name, m.end()) for k, (name, pattern, good) in enumerate(PATTERNS) for m in pattern.finditer(text or "") if good(m)]
    return [(name, a, b) for a, _, name, b in sorted(spans)]


def said(spans):
    return ",".join(f"{n}:{a}:{b}" for n, a, b in spans)


HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
TEXTS = [
    None, "", " ", f'é token = "{HEX}" x', f"PassWord:{HEX[:6]} passwd=abcde api_key = 'A+/b_c.=-' apikey:::x", "toſen=abcdefg toKen=abcdefg secretsecret=token=abcdef=",
    "AKIA" + "A1" * 8 + " AKIA" + "Z" * 15 + " xAKIAAKIA" + "9" * 16 + "é", f"{HEX[:23]} {HEX[:24]} {HEX[:24]}G{HEX} A{HEX.upper()}", "日本 secret : " + "q" * 6 + "日", "token=\nabcdefgh token = = abcdefgh",
    "word " * 20_000 + f"token={HEX}" + " word" * 20_000, f"{HEX}é" * 3,
]


def test_patterns():
    for text in TEXTS:
        raw = (text or "").encode()
        at = len
        got = [(S.KINDS[k], at(raw[:a].decode()), at(raw[:b].decode())) for k, a, b, _ in S.base_spans(raw)]
        assert got == base(text)


def test_tokens():
    texts = ["a_1 b", "c", "", None, "é日.x", " y ", "z"]
    t = S.Tokens(pa.array(["zz", *texts]).slice(1))
    assert [(int(i), t.raw[a:b].decode(), t.words[c].as_py()) for i, a, b, c in zip(t.of, t.start, t.end, t.code, strict=True)] == [(i, w, w) for i, x in enumerate(texts) for w in re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", x or "")]


@pytest.mark.parametrize("spread", [0.0, 1.0, 6.0])
def test_viterbi_against_all_paths(spread):
    rng = np.random.default_rng(3)
    of = np.repeat(np.arange(40), rng.integers(1, 7, 40))
    scores = rng.normal(0, 1, (len(of), 3)) + np.array([0, 0, spread])
    after, first = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    tags = S.viterbi(scores, of, after, first)
    for i in range(40):
        e = scores[of == i]
        value = lambda y: first[y[0]] + sum(e[k][t] for k, t in enumerate(y)) + sum(after[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert value(tags[of == i]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(e)))))


def test_slopes():
    """Against differences of the likelihood, which is that of all paths."""
    rng = np.random.default_rng(1)
    rows, tags = rng.integers(0, 9, (4, 5, S.ALL)), rng.integers(0, 3, (4, 5))
    mask = np.arange(5) < np.array([5, 3, 1, 4])[:, None]
    m = S.Model(rng.normal(0, 1, (9, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
    value, score, after, first = S.likelihood(rows, tags, mask, m)
    total = 0.0
    for i in range(4):
        e = m.weights[rows[i, mask[i]]].sum(axis=1)
        path = lambda y: m.first[y[0]] + sum(e[k][t] for k, t in enumerate(y)) + sum(m.after[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        total += path(tags[i, mask[i]]) - np.log(sum(np.exp(path(y)) for y in itertools.product(range(3), repeat=len(e))))
    assert value == pytest.approx(total / 4)
    slope = np.zeros((9, 3))
    np.add.at(slope, rows, score[:, :, None, :])
    for x, g in ((m.weights, slope), (m.after, after), (m.first, first)):
        for at in np.ndindex(x.shape):
            was = x[at]
            x[at] = was + 1e-6
            up = S.likelihood(rows, tags, mask, m)[0]
            x[at] = was
            assert (up - value) / 1e-6 == pytest.approx(g[at], abs=1e-4)


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "Tea", "été", "house,", "12", "2024.", "555-3436", "x@y.org", "(017)"]
    word = lambda: rng.choice([*words, "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 12)))])
    text = lambda k: " ".join(word() for _ in range(k))
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return [text(rng.randint(5, 60)) if i % 4 else f'{text(9)} token = "{hexed()}" {text(9)}' for i in range(n)]


def test_scan(spark, odd, none):
    """The patterns' spans of every text; the field's on secrets that no pattern has, and none on clean documents."""
    texts = corpus(400)
    rng = random.Random(7)
    hidden = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36)) for _ in range(12)]
    texts += [*TEXTS, *(x.replace(" ", f" {h} ", 1) for x, h in zip((t for t in corpus(40, seed=8) if "token" not in t and len(t) > 150), hidden, strict=False))]
    first = 400 + len(TEXTS)
    found = 0
    rows = S.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = base(texts[r.doc_id])
        assert r.base_spans == said(own) and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in own) for k in ("assign", "access", "hex"))
        every = [x.split(":") for x in r.spans.split(",") if x]
        assert set(filter(None, said(own).split(","))) <= set(r.spans.split(",")) and every == sorted(every, key=lambda x: (int(x[1]), S.KINDS.index(x[0])))
        assert all(int(b) <= a or int(c) >= z for k, b, c in ((x[0], x[2], x[1]) for x in every if x[0] == "crf") for _, a, z in own)
        if r.doc_id < 400:
            assert "crf" not in r.spans
        elif r.doc_id >= first:
            a = texts[r.doc_id].index(hidden[r.doc_id - first])
            found += r.spans == f"crf:{a}:{a + 36}"
    assert len(texts) == first + 12 and found >= 9


def test_odd_rows(spark, odd, none):
    assert S.secret_scan(odd).count() == odd.count() and S.secret_scan(none).count() == 0
    assert {(r.base_spans, r.spans) for r in S.secret_scan(odd).collect()} == {("", "")}
    same = S.secret_scan(spark.createDataFrame([(None, f"token={HEX}", "x")] * 3, "doc_id bigint, text string, spans string")).collect()
    assert len(set(same)) == 1 and same[0].base_spans == "assign:0:46,hex:6:46" and hashlib.sha256(same[0].base_spans.encode()).hexdigest()
