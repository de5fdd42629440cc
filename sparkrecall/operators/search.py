"""Search: many queries against many memories in one join, scored, filtered, ranked per query.

A `queries` table has query_id, query, tenant_id, app_id and, where given, actor_id, thread_id, memory_types, scopes,
metadata, limit, min_score. Empty strings and empty arrays filter nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X
from sparkrecall.operators.ingest import PlaneEmbedding, enriched
from sparkrecall.operators.lifecycle import live

_OPTIONAL = {"actor_id": "string", "thread_id": "string", "memory_types": "array<string>", "scopes": "array<string>", "metadata": "map<string,string>", "limit": "int", "min_score": "double", "max_items": "int", "max_chars": "int"}


def with_defaults(queries: DataFrame) -> DataFrame:
    for name, kind in _OPTIONAL.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    return queries


def candidates(queries: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
    """Query columns under q., memory columns under m., of every pair that passes the filters.

    Joined on tenant and application. Spark broadcasts the queries if they are few, else it joins by those keys and
    splits the large ones.
    """
    q, m = with_defaults(queries).alias("q"), live(memories, as_of).alias("m")
    any_or = lambda name: F.col(f"q.{name}").isNull() | (F.col(f"q.{name}") == "") | (F.col(f"q.{name}") == F.col(f"m.{name}"))
    listed = lambda name, of: F.col(f"q.{name}").isNull() | (F.size(f"q.{name}") == 0) | F.array_contains(f"q.{name}", F.col(f"m.{of}"))
    keys = (F.col("q.tenant_id") == F.col("m.tenant_id")) & (F.col("q.app_id") == F.col("m.app_id"))
    test = keys & any_or("actor_id") & any_or("thread_id") & listed("memory_types", "memory_type") & listed("scopes", "scope")
    if "metadata" in memories.columns:
        test = test & (F.col("q.metadata").isNull() | F.forall(F.map_entries("q.metadata"), lambda e: F.try_element_at(F.col("m.metadata"), e["key"]).eqNullSafe(e["value"])))
    return q.join(m, test)


def _reasons(*pairs: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*(F.when(test, F.lit(name) if isinstance(name, str) else name) for test, name in pairs)))


def _boost() -> Column:
    return X.feedback_boost(F.col("m.stats.positive"), F.col("m.stats.negative"))


# Fixed values in what follows: the weights, thresholds and reasons of both kinds of score.


def lexical_hits(queries: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
    """(query_id, rank, id, memory_type, text, score, reasons, and what contexts need), by score, recency of update,
    order. At least 0.2 (or min_score); limit 8, within 1 to 100."""
    q = with_defaults(queries).withColumn("q_tokens", X.tokenize(F.col("query")))
    m = memories if "tokens" in memories.columns else memories.withColumn("tokens", X.tokenize(F.col("text")))
    met = candidates(q, m, as_of).withColumn("overlap", X.overlap(F.col("q.q_tokens"), F.col("m.tokens"))).withColumn("recency", X.recency(as_of, F.col("m.last_seen_at"))).withColumn("boost", _boost())
    c, i = F.col("m.confidence"), F.col("m.importance")
    score = F.col("overlap") * 0.55 + F.col("recency") * 0.15 + c * 0.15 + i * 0.1 + F.col("boost")
    reasons = _reasons((F.col("overlap") > 0.35, "high lexical overlap"), (F.col("recency") > 0.7, "recent memory"), (c >= 0.75, "high confidence"), (i >= 0.75, "high importance"), (F.col("boost") > 0.05, "strong positive feedback"), (F.col("boost") < -0.05, "negative feedback penalty"))
    scored = met.withColumn("score", score).withColumn("reasons", reasons).where(F.col("score") >= F.coalesce("q.min_score", F.lit(0.2)))
    return _top(scored, [F.desc("score"), F.desc("m.updated_at"), F.asc("m.ord")], 8)


_KEPT = ("id", "memory_type", "text", "summary", "thread_id", "entities", "has_problem", "updated_at", "ord")


def _top(scored: DataFrame, order: list[Column], default: int) -> DataFrame:
    most = F.least(F.greatest(F.coalesce("q.limit", F.lit(default)), F.lit(1)), F.lit(100))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("q.query_id").orderBy(*order)))
    # the constant bound lets Spark keep the first hundred of each query before the exchange
    kept = ranked.where((F.col("rank") <= 100) & (F.col("rank") <= most))
    have = set(scored.select("m.*").columns)
    return kept.select("q.query_id", "rank", *(F.col(f"m.{n}") for n in _KEPT if n in have), "score", "reasons")


def enhanced_hits(queries: DataFrame, memories: DataFrame, as_of: Column, embedding=None) -> DataFrame:
    """As lexical_hits, by the query's class: embedding, overlap, entities, time and problem boosts. At least 0.05;
    limit 20, within 1 to 100. `embedding` says what a text's vector is and how alike two are. What is read off the memories' texts is taken from their columns if there, else made."""
    c, vectors = F.col, embedding or PlaneEmbedding()
    q = with_defaults(queries).withColumn("q_tokens", X.tokenize(c("query"))).withColumn("q_embedding", vectors.embed(c("query"))).withColumn("q_class", P.classify(c("query")))
    # only tokens of the lower-cased query count, repeats and all; entities lower-cased
    q = q.withColumn("q_entities", F.transform(P.query_entities(c("query")), F.lower))
    m = memories if "entities" in memories.columns else enriched(memories, vectors)
    met = candidates(q, m, as_of)
    kind, when, first = c("q.q_class.type"), c("q.q_class.temporal_type"), c("q.q_class.first_issue")
    relevant = c("m.temporal.relevant")
    matched = F.filter(c("m.entities"), lambda e: F.array_contains(c("q.q_entities"), F.lower(e["text"])) | F.array_contains(c("q.q_tokens"), F.lower(e["text"])))
    devices = F.filter(c("m.entities"), lambda e: (e["type"] == "OBJECT") & F.exists(c("q.q_entities"), lambda x: F.contains(x, F.lower(e["text"]))))
    met = (
        met.withColumn("semantic", vectors.similarity(c("q.q_embedding"), c("m.embedding")))
        .withColumn("lexical", X.overlap(c("q.q_tokens"), c("m.tokens")))
        .withColumn("recency", X.recency(as_of, c("m.last_seen_at")))
        .withColumn("boost", _boost())
        .withColumn("timely", (kind == "temporal") & relevant)
        .withColumn("matched", matched)
        .withColumn("problem", first & c("m.has_problem"))
    )
    met = met.withColumn("devices", F.when(c("problem"), devices).otherwise(F.array().cast("array<struct<text:string,type:string,confidence:double>>")))
    e = F.least(F.size("matched") * 0.15, F.lit(0.4))
    t = F.when(c("timely") & (when == "sequence"), 0.3 + 0.2).when(c("timely"), 0.3).otherwise(0.0)
    p = F.when(c("problem") & (F.size("devices") > 0), 0.5 + 0.3).when(c("problem"), 0.5).otherwise(0.0)
    s, l, r, cf, im, f = c("semantic"), c("lexical"), c("recency"), c("m.confidence"), c("m.importance"), c("boost")
    score = (
        F.when(first, p * 0.4 + s * 0.2 + l * 0.15 + e * 0.15 + t * 0.05 + im * 0.03 + cf * 0.02 + f)
        .when(kind == "temporal", s * 0.3 + t * 0.25 + e * 0.2 + l * 0.15 + r * 0.05 + cf * 0.03 + im * 0.02 + f)
        .when(kind == "comparative", e * 0.4 + s * 0.3 + l * 0.2 + r * 0.05 + cf * 0.03 + im * 0.02 + f)
        .otherwise(s * 0.4 + l * 0.25 + e * 0.2 + r * 0.08 + cf * 0.04 + im * 0.03 + f)
    )
    named = lambda a: F.array_join(F.transform(a, lambda x: x["text"]), ", ")
    reasons = _reasons(
        (s > 0.7, "high semantic similarity"),
        (l > 0.4, "high lexical overlap"),
        (r > 0.7, "recent memory"),
        (cf >= 0.75, "high confidence"),
        (im >= 0.75, "high importance"),
        (f > 0.05, "strong positive feedback"),
        (f < -0.05, "negative feedback penalty"),
        (c("timely"), "temporally relevant for temporal query"),
        (c("timely") & (when == "sequence"), "has temporal ordering information"),
        (F.size("matched") > 0, F.concat(F.lit("matches "), F.size("matched").cast("string"), F.lit(" entities: "), named(c("matched")))),
        (c("problem"), "contains problem/issue language for first issue question"),
        (F.size("devices") > 0, F.concat(F.lit("device mentioned in problem context: "), named(c("devices")))),
    )
    scored = met.withColumn("score", X.clamp(score, 0.0, 1.0)).withColumn("reasons", reasons).where(c("score") >= F.coalesce("q.min_score", F.lit(0.05)))
    # a query about a sequence takes relevant memories by their own order alone
    in_order = c("timely") & (when == "sequence")
    order = [
        F.when(kind == "temporal", relevant).desc(),
        F.when(in_order, c("m.temporal_order")).asc(),
        F.when(~in_order, c("score")).desc(),
        F.when(~in_order, c("m.updated_at")).desc(),
        c("m.ord").asc(),
    ]
    return _top(scored, order, 20)


def by_id(memories: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Live memories by id."""
    return live(memories, as_of).join(ids.select("id").distinct(), "id", "left_semi")


def by_actor(memories: DataFrame, actors: DataFrame, as_of: Column) -> DataFrame:
    """Live memories of actors, with rank: last seen first."""
    keys = ["tenant_id", "app_id", "actor_id"]
    mine = live(memories, as_of).join(actors.select(*keys).distinct(), keys, "left_semi")
    return mine.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("last_seen_at"), "ord")))


def answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, answer): a constant for a first issue with a GPS, the entity a comparison turns on, or the best hit's
    first sentence if its score is above 0.3; else empty. Takes hits of enhanced_hits."""
    c = F.col
    q = queries.select("query_id", P.classify(c("query")).alias("q_class"), P.query_entities(c("query")).alias("q_entities"))
    low = F.lower("text")
    met = hits.join(q, "query_id").withColumn("low", low)
    gps = c("q_class.first_issue") & c("has_problem") & F.contains(c("low"), F.lit("gps")) & X.contains_any(c("low"), "issue", "problem", "not", "malfunction")
    compared = (c("q_class.type") == "comparative") & (F.size("q_entities") >= 2)
    held = F.filter(F.transform(c("q_entities"), lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: F.contains(c("low"), F.lower(x["e"])))
    met = met.withColumn("held", F.when(compared, held)).withColumn("timed", X.contains_any(c("low"), "first", "before", "initially"))
    per = met.groupBy("query_id").agg(
        F.max(gps).alias("gps"),
        # hits first, entities in each hit; the fallback goes entity by entity
        F.min(F.when(c("timed") & (F.size("held") > 0), F.struct("rank", c("held")[0]["i"].alias("i"), c("held")[0]["e"].alias("e")))).alias("timed"),
        F.min(F.when(F.size("held") > 0, F.struct(c("held")[0]["i"].alias("i"), c("held")[0]["e"].alias("e")))).alias("any"),
        F.min_by(F.struct("text", "score"), "rank").alias("best"),
    )
    best = F.when(c("best.score") > 0.3, X.first_sentence(c("best.text"))).otherwise("")
    said = per.select("query_id", F.when(c("gps"), "GPS system not functioning correctly").otherwise(F.coalesce("timed.e", "any.e", best)).alias("answer"))
    return queries.select("query_id").join(said, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 2_000, part_rows: int = 20_000) -> DataFrame:
    """(q_id, rank, vec_id, similarity): of each of `queries` (q_id, q) the k nearest of `vectors` (vec_id, embedding), itself
    not among them; ties by vec_id. Ids are of one type; rows with null ids are left out.

    Every query meets every vector, in blocks of queries and parts of vectors of a bounded size, each pair of which is one
    group of a task; neither side is broadcast. Matrix products rule out, and `vector_similarity` decides on the rest. Only k
    of each query and part go on to the ranking.
    """
    n, m = vectors.count(), queries.count()
    parts, blocks = max(-(-n // part_rows), 8), max(-(-m // block_rows), 1)
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    doubles = lambda name: F.col(name).cast("array<double>").alias(name)
    v = vectors.where("vec_id is not null").select("vec_id", doubles("embedding"), dealt("vec_id", parts).alias("part"), all_of(blocks).alias("block"))
    q = queries.where("q_id is not null").select("q_id", doubles("q"), dealt("q_id", blocks).alias("block"), all_of(parts).alias("part"))
    kinds = f"q_id {queries.schema['q_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double"
    pairs = q.groupBy("block", "part").cogroup(v.groupBy("block", "part"))
    met = pairs.applyInArrow(lambda some, part: _nearest_of(some, part, k), kinds)
    best = W.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("q_id", "rank", "vec_id", "similarity")


def _matrix(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements one row after the other, and each row's length; 0 for nulls and rows that hold one, which are like none."""
    lists = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        holds = np.zeros(len(size), bool)
        holds[np.repeat(np.arange(len(size)), size)[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        values = values[np.repeat(~holds, size)]
        size[holds] = 0
    return values, size


def _nearest_of(queries: pa.Table, part: pa.Table, k: int, at_once: int = 64) -> pa.Table:
    """(q_id, vec_id, similarity): the k nearest of a part to each query. A product of doubles is off by less than `margin`
    from the sum in order, which vector_similarity takes, so what is further than that below the k-th is out."""
    part = part.sort_by("vec_id")  # so the place is the order of ties
    ids = part.column("vec_id").combine_chunks().dictionary_encode()
    own = pc.fill_null(pc.index_in(queries.column("q_id").combine_chunks(), value_set=ids.dictionary), -1).to_numpy(zero_copy_only=False)
    code = ids.indices.to_numpy(zero_copy_only=False)
    (values, sizes), (asked, lengths) = _matrix(part.column("embedding")), _matrix(queries.column("q"))
    ends = np.cumsum(lengths)
    which, places, found = [], [], []
    for length in np.unique(lengths):
        same = np.nonzero(sizes == length)[0] if length else np.zeros(0, np.int64)
        others = np.nonzero(sizes != length)[0] if length else np.arange(len(sizes))  # of similarity 0
        m = values[np.repeat(sizes == length, sizes)].reshape(len(same), length)
        mine = np.nonzero(lengths == length)[0]
        longest = np.sqrt((m * m).sum(axis=1).max()) if m.size else 0.0
        for at in range(0, len(mine), at_once):
            some = mine[at : at + at_once]
            x = asked[(ends[some] - length)[:, None] + np.arange(length)]
            with np.errstate(all="ignore"):
                products = x @ m.T
            for i, q in enumerate(some):
                row = products[i]
                itself = code[same] == own[q]
                margin = 8 * (length + 2) * np.finfo(np.float64).eps * longest * np.sqrt((x[i] * x[i]).sum())
                if len(same) == 0:
                    near = np.zeros(0, np.int64)
                elif np.isfinite(row).all() and np.isfinite(margin):
                    row[itself] = -np.inf
                    kth = np.partition(row, max(len(row) - k, 0))[max(len(row) - k, 0)]
                    near = np.nonzero(row >= max(kth - margin, -margin))[0]
                    if kth <= margin:  # those below 0 are equals at 0
                        near = np.concatenate((near, np.nonzero((row < -margin) & ~itself)[0][:k]))
                else:
                    near = np.nonzero(~itself)[0]
                with np.errstate(all="ignore"):
                    exact = np.cumsum(m[near] * x[i], axis=1)[:, -1] if len(near) else np.zeros(0)  # a sum in order
                rest = others[code[others] != own[q]][:k]
                place = np.concatenate((same[near], rest))
                similarity = np.concatenate((np.maximum(exact, 0.0) + 0.0, np.zeros(len(rest))))
                top = np.lexsort((place, -similarity, ~np.isnan(similarity)))[:k]
                which.append(np.full(len(top), q))
                places.append(place[top])
                found.append(similarity[top])
    of = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return pa.table({"q_id": queries.column("q_id").take(pa.array(of(which, np.int64))), "vec_id": part.column("vec_id").take(pa.array(of(places, np.int64))), "similarity": pa.array(of(found, np.float64))})
