"""Queries of single functions: text, time, similarity, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X
from sparkrecall.operators import search as S
from sparkrecall.queries import views as V
from sparkrecall.queries.views import AS_OF_SQL, OBS_SQL, r6

SQL: dict[str, str] = {}
C = F.col
_Q = "What was the first issue with my car GPS and the deadline of the phone"


def i3_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", X.tokenize(C("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


SQL["i3_tokens"] = f"select doc_id, len(t) as n_tokens, md5({V.joined('t', ' ')}) as tokens_md5 from (select doc_id, {V.tok('text')} as t from documents)"


def k1_overlap(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", r6(X.overlap(X.tokenize(F.lit(_Q)), X.tokenize(C("text")))).alias("overlap"))


SQL["k1_overlap"] = f"with obs as ({OBS_SQL}), t as (select seq, list_distinct({V.tok('text')}) as a, list_distinct({V.tok(f"'{_Q}'")}) as q from obs) select seq, round({V.ovl('q', 'a')},6) as overlap from t"


def k2_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", r6(X.jaccard(X.raw_words(F.lit(_Q)), X.raw_words(C("text")))).alias("jaccard"))


SQL["k2_jaccard"] = f"with obs as ({OBS_SQL}), t as (select seq, {V.raw('text')} as a, {V.raw(f"'{_Q}'")} as q from obs) select seq, round({V.jac('q', 'a')},6) as jaccard from t"


def k3_similarity(spark: SparkSession, d: str) -> DataFrame:
    q, m = X.embedding(X.tokenize(F.lit(_Q))), X.embedding(X.tokenize(C("text")))
    rows = V.obs(spark, d).select("seq", m.alias("m"), q.alias("q"))
    return rows.select("seq", F.round(C("m.a"), 4).alias("a"), F.round(C("m.b"), 4).alias("b"), F.round(X.similarity(C("q"), C("m")), 4).alias("similarity"))


SQL["k3_similarity"] = f"""with obs as ({OBS_SQL}), t as (select seq, {V.tok('text')} as t, {V.tok(f"'{_Q}'")} as q from obs),
e as (select seq, {V.emb('t', 'sin')} as a, {V.emb('t', 'cos')} as b, {V.emb('q', 'sin')} as c, {V.emb('q', 'cos')} as d from t)
select seq, round(a,4) as a, round(b,4) as b, round({V.sim('c', 'd', 'a', 'b')},4) as similarity from e"""


def k4_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select(F.explode(X.tokenize(C("text"))).alias("token")).distinct().select("token", X.token_hash(C("token")).cast("long").alias("hash"))


SQL["k4_hash"] = f"with obs as ({OBS_SQL}), t as (select distinct unnest({V.tok('text')}) as token from obs) select token, ({V.hash_('token')})::bigint as hash from t"


def k5_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    v = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").select(C("vec_id").alias("q_id"), C("embedding").alias("q"))
    return S.nearest(v, q, 5).select("q_id", "rank", "vec_id", r6(C("similarity")).alias("similarity"))


SQL["k5_vector_topk"] = """with q as (select vec_id as q_id, embedding as q from embeddings where vec_id % 50 = 0),
m as (select q_id, vec_id, greatest(0.0, list_sum(list_transform(list_zip(q, embedding), lambda x: x[1]::double*x[2]::double))) as s from embeddings, q where vec_id <> q_id),
r as (select *, row_number() over (partition by q_id order by s desc, vec_id) as rank from m)
select q_id, rank::int as rank, vec_id, round(s,6) as similarity from r where rank <= 5"""


def j1_recency(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", r6(X.recency(V.as_of(), C("observed_at"))).alias("recency"))


SQL["j1_recency"] = f"with obs as ({OBS_SQL}) select seq, round({V.rec('observed_at')},6) as recency from obs"


def j2_insight_decay(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", r6(X.insight_decay(V.as_of(), C("observed_at"))).alias("decay"))


SQL["j2_insight_decay"] = f"with obs as ({OBS_SQL}) select seq, round(1+0.2*exp(-{V.age('observed_at')}/30),6) as decay from obs"


def b3_summary(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", X.summarize(C("text")).alias("summary"))


SQL["b3_summary"] = f"select doc_id, case when length(t)<=120 then t else substring(t,1,117)||'...' end as summary from (select doc_id, {V.norm('text')} as t from documents)"


def c6_expired(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", X.expired(V.as_of(), C("observed_at"), F.lit("time"), C("ttl_days")).alias("expired"))


SQL["c6_expired"] = f"with obs as ({OBS_SQL}) select seq, {V.exp_('observed_at', 'ttl_days')} as expired from obs"


def m1_temporal(spark: SparkSession, d: str) -> DataFrame:
    t = V.obs(spark, d).select("seq", P.temporal(C("text")).alias("t"))
    return t.select("seq", F.array_join(F.array_sort("t.dates"), "|").alias("dates"), F.array_join(F.array_sort("t.events"), "|").alias("events"), C("t.relevant").alias("relevant"))


_DATES = " , ".join(
    [
        r"regexp_extract_all(text,'\b(?:\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{1,2}-\d{1,2})\b')",
        V.every("text", rf"(?:{P.MONTHS})\s+\d{{1,2}},?\s+\d{{4}}"),
        V.every("text", rf"(?:{P.SHORT_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}"),
        V.every("text", r"yesterday|today|tomorrow|last\s+\w+|next\s+\w+|this\s+\w+"),
        V.every("text", r"\d+\s+(?:days?|weeks?|months?|years?)\s+(?:ago|before|after|later)"),
        V.every("text", "first|second|third|last|final|initial"),
        V.every("text", "before|after|during|while|when|then|next|previously|subsequently"),
    ]
)
TEMPORAL_SQL = f"list_sort(list_distinct(flatten([{_DATES}]))) as dates, list_sort(list_distinct({V.every('text', P.EVENT_WORDS)})) as events"
RELEVANT_SQL = f"(len(dates)>0 or len(events)>0 or {V.has('text', 'first|second|third|last|before|after|when|then')})"
SQL["m1_temporal"] = f"with obs as ({OBS_SQL}), t as (select seq, text, {TEMPORAL_SQL} from obs) select seq, {V.joined('dates', '|')} as dates, {V.joined('events', '|')} as events, {RELEVANT_SQL} as relevant from t"


def m3_order(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", P.temporal_order(C("text")).alias("temporal_order"))


ORDER_SQL = "(" + "+".join(f"case when {V.has('text', w)} then {n} else 0 end" for w, n in P.ORDER_WEIGHTS.items()) + ")"
SQL["m3_order"] = f"with obs as ({OBS_SQL}) select seq, {ORDER_SQL} as temporal_order from obs"


def m4_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = V.obs(spark, d).select("seq", P.entities(C("text")).alias("e"))
    said = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["text"], x["type"], F.round(x["confidence"] * 10).cast("int").cast("string"))), "|")
    return rows.select("seq", said.alias("entities"), P.has_type(C("e"), "PROBLEM").alias("has_problem"), P.has_type(C("e"), "OBJECT").alias("has_device"))


ENTITIES_SQL = "flatten([" + ",".join(f"list_transform({V.every('text', words)}, lambda x: {{'text': x, 'type': '{kind}', 'conf': {round(conf * 10)}}})" for words, kind, conf in P.ENTITIES) + "])"
SQL["m4_entities"] = f"""with obs as ({OBS_SQL}), t as (select seq, {ENTITIES_SQL} as e from obs)
select seq, {V.joined("list_transform(e, lambda x: x.text||':'||x.type||':'||x.conf)", '|')} as entities, len(list_filter(e, lambda x: x.type='PROBLEM'))>0 as has_problem, len(list_filter(e, lambda x: x.type='OBJECT'))>0 as has_device from t"""


def m6_query_entities(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", F.array_join(F.array_sort(P.query_entities(C("text"))), "|").alias("entities"))


_QENT = "flatten([regexp_extract_all({x},'''([^'']+)''',1)," + ",".join("regexp_extract_all({x}," + V.words(w) + ")" for w in P.QUERY_ENTITIES) + "])"
QENT_SQL = f"list_filter({_QENT}, lambda e, i: list_position({_QENT}, e) = i)"  # distinct, in order
SQL["m6_query_entities"] = f"with obs as ({OBS_SQL}) select seq, {V.joined('list_sort(' + QENT_SQL.replace('{x}', 'text') + ')', '|')} as entities from obs"


def m7_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = V.obs(spark, d).select("seq", P.classify(C("text")).alias("c"))
    return rows.select("seq", C("c.type").alias("type"), F.coalesce("c.temporal_type", F.lit("")).alias("temporal_type"), C("c.confidence").alias("confidence"), C("c.first_issue").alias("first_issue"))


_T = V.has("{x}", r"first|second|third|last|before|after|when|how\s+long|how\s+many\s+days|which.*first")
FIRST_SQL = V.has("{x}", r"first\s+issue|first\s+problem")
TYPE_SQL = f"""(case when {_T} or {FIRST_SQL} then 'temporal' when {V.has('{x}', 'which.*or')} or ({V.has('{x}', 'which')} and {V.has('{x}', 'or')}) then 'comparative'
 when {V.has('{x}', 'prefer|like|favorite|choose|recommendation')} then 'preference' else 'factual' end)"""
WHEN_SQL = rf"(case when {V.has('{x}', r'how\s+many\s+days|how\s+long')} then 'duration' when {V.has('{x}', r'when|what\s+time|what\s+date')} then 'specific_time' when {V.has('{x}', 'before|after|since|until')} then 'relative_time' else 'sequence' end)"
SQL["m7_classify"] = f"""with obs as ({OBS_SQL}), t as (select seq, text, {TYPE_SQL.replace('{x}', 'lower(text)')} as type from obs)
select seq, type, case when type='temporal' then {WHEN_SQL.replace('{x}', 'lower(text)')} else '' end as temporal_type, case type when 'temporal' then 0.9::double when 'factual' then 0.6::double else 0.8::double end as confidence, {FIRST_SQL.replace('{x}', 'lower(text)')} as first_issue from t"""


def m9_importance(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", r6(P.importance(C("text"), C("importance"), C("role"))).alias("importance"))


def _plus(test: str, x: float) -> str:
    return f"(case when {test} then {x} else 0 end)"


IMPORTANCE_SQL = "+".join(["(case when importance=0 or importance is null then 0.5 else importance end)", _plus(f"len({V.raw('text')})>20", 0.1), _plus(f"len({V.raw('text')})>50", 0.1), _plus("contains(text,'?')", 0.15), _plus(V.part("text", "issue", "problem", "trouble"), 0.2), _plus(V.part("text", "gps", "samsung", "galaxy"), 0.15), _plus(V.part("text", "first", "before", "after"), 0.1), _plus("role='user'", 0.1)])
SQL["m9_importance"] = f"with obs as ({OBS_SQL}) select seq, round(least({IMPORTANCE_SQL},1.0)::double,6) as importance from obs"


def c12_type_lists(spark: SparkSession, d: str) -> DataFrame:
    from sparkrecall.model import parse_types

    rows = V.obs(spark, d).select("seq", F.concat("memory_type", F.lit(" , "), F.when(C("seq") % 3 == 0, "goal").otherwise("gaol")).alias("csv"))
    return rows.select("seq", F.coalesce(F.array_join(parse_types(C("csv")), "|"), F.lit("")).alias("types"))


SQL["c12_type_lists"] = f"with obs as ({OBS_SQL}) select seq, case when seq%3=0 then memory_type||'|goal' else '' end as types from obs"


def j8_greeting(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "events").select("event_id", X.greeting(F.hour("ts")).alias("greeting"))


SQL["j8_greeting"] = "select event_id, case when hour(ts)<12 then 'Good morning' when hour(ts)<18 then 'Good afternoon' else 'Good evening' end as greeting from events"

QUERIES = {f.__name__: f for f in (i3_tokens, k1_overlap, k2_jaccard, k3_similarity, k4_hash, k5_vector_topk, j1_recency, j2_insight_decay, b3_summary, c6_expired, m1_temporal, m3_order, m4_entities, m6_query_entities, m7_classify, m9_importance, c12_type_lists, j8_greeting)}
