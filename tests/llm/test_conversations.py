from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkrecall.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        said = BLANK.findall(text)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """The least (cost, audit) and its messages, by best-first search over (rows read, what the roles say so far). States of
    the roles: 0 nothing, 1 s, 2 behind u, 3 behind a."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    todo, done = [(0, "", 0, 0, ())], set()
    while todo:
        cost, audit, at, state, out = heapq.heappop(todo)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, out
        put = lambda c, e, i, s, o: heapq.heappush(todo, (cost + c, audit + e, i, s, o))
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                put(3, "I", at, step[state, role[0]], (*out, (role, "")))
        if at < len(rows):
            put(4, "D", at + 1, state, out)
            if kinds[at] in "-t":
                _, _, own, text = rows[at]
                more = 3 * (kinds[at] == "t")
                for role, c, e in ((own, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    to = state if not role else step.get((state, role[:1]))
                    if to is not None:
                        put(c + more, e, at + 1, to, (*out, (role, text)))


def expected(rows):
    out = []
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds, turns = faults(own), [r[1] for r in own if r[1] is not None]
        cost, audit, said = cheapest(own, kinds)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(spark, rows, folders=4, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(folders)
    done = C.repair(C.damaged(df).withColumnRenamed("key", "conv_id"), copies=F.col("copies"), **how)
    return sorted((tuple(r) for r in done.found.join(C.digests(done.turns), "c").select(*COLUMNS).collect()), key=repr)


def made(rng, n, texts=("Yes.", "no", "Why?", "", " \t", "More words!", "é 日本")):
    roles = ("user", "assistant") * 4 + ("system", "tool", "", None, "User")
    return [(rng.choice(roles), rng.choice([*texts, *(f"t{rng.randint(0, 99)}." for _ in range(9)), None])) for _ in range(n)]


def talks(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn, (role, text) in enumerate(made(rng, rng.randint(1, most))):
            rows.append((conv, None if rng.random() < 0.02 else turn, role, text))
    return rows


@pytest.mark.parametrize(("seed", "n", "most", "how"), [(1, 120, 7, {}), (2, 12, 60, {"piece_rows": 5}), (3, 9, 40, {"piece_rows": 1, "piece_chars": 1}), (4, 3, 400, {"piece_rows": 64})])
def test_against_search(spark, seed, n, most, how):
    rows = talks(seed, n, most)
    assert got(spark, rows, **how) == expected(rows)


def test_one_conversation_over_many_tasks(spark):
    """Most rows are one conversation's, many of them alike, and a text stands in half of them."""
    rng = random.Random(5)
    rows = [(0, t, *made(rng, 1)[0]) if t % 2 else (0, t, "user", "Same words.") for t in range(1500)] + talks(6, 20, 5)[3:]
    rows = [r for r in rows if r[0] == 0] + [r for r in rows if r[0] != 0]
    assert got(spark, rows, piece_rows=100) == expected(rows)
    same = [(7, 3, "user", "Hello.")] * 700 + [(7, 2, "assistant", "")] * 300
    assert got(spark, same, piece_rows=90) == expected(same)


def test_odd_rows(spark, odd, none):
    rows = [(1, 0, "system", "S."), (None, None, None, None), (None, 4, "user", "a\nb."), (2, None, "user", "x."), (2, None, "user", "x."), (2, None, "assistant", "y."), (3, 10**15, "assistant", "long " * 50_000), (3, -(10**15), "s", ".")]
    assert got(spark, rows) == expected(rows)
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    only = [(gone, 0, "user", "Hi.")]
    assert got(spark, only) == expected(only) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(spark, [r for r in rows if r[0] == 99]) == []
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit(1) for x in ("c", "n", "first", "piece", "cost", "there")})
    assert C.repair(clashing).found.count() == 4 and C.repair(odd.withColumns({"turn": F.lit(1), "role": F.lit("user")}), key="doc_id").found.count() == 9
    assert C.repair(none.withColumns({"turn": F.lit(1), "role": F.lit("user")}), key="doc_id").found.count() == 0


def test_messages(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "a."), (1, 2, "user", "a.")]
    done = C.repair(spark.createDataFrame(rows, SCHEMA))
    assert done.found.select("cost", "audit").first() == (10, "IKKDI")
    said = [tuple(m) for r in done.turns.orderBy("piece").collect() for m in r.lines]
    assert said == [("user", ""), ("assistant", "Hi."), ("user", "a."), ("assistant", "")]
