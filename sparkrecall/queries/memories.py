"""Queries of the memory store: ingest, look-ups, search, contexts, profiles, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall import model as M
from sparkrecall.operators import context as K
from sparkrecall.operators import ingest as I
from sparkrecall.operators import lifecycle as L
from sparkrecall.operators import search as S
from sparkrecall.plans import tuned as U
from sparkrecall.queries import functions as Q
from sparkrecall.queries import views as V
from sparkrecall.queries.views import ASKED_SQL, LIVE_SQL, MEM_SQL, OBS_SQL, r6

SQL: dict[str, str] = {}
C = F.col


def b2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = I.normalized(V.observations(spark, d).withColumn("confidence", C("confidence") * 1.5), V.as_of())
    return rows.select(C("arrival_seq").alias("seq"), "text", "summary", "scope", r6(C("confidence")).alias("confidence"), r6(C("importance")).alias("importance"))


SQL["b2_normalize"] = f"""with obs as ({OBS_SQL}), n as (select *, substring({V.norm('text')},1,1000) as t from obs)
select seq, t as text, case when length(t)<=120 then t else substring(t,1,117)||'...' end as summary, 'actor' as scope, round(least(confidence*1.5,1.0)::double,6) as confidence, round(importance,6) as importance from n"""


def b7_preprocess(spark: SparkSession, d: str) -> DataFrame:
    rows = I.preprocessed(V.obs(spark, d))
    return rows.select("seq", "text", "text_length", "word_count", "has_questions", r6(C("importance")).alias("importance"))


SQL["b7_preprocess"] = rf"with obs as ({OBS_SQL}) select seq, {V.norm('text')} as text, length(text)::int as text_length, len(string_split_regex(text,'\s+'))::int as word_count, contains(text,'?') as has_questions, round(least({Q.IMPORTANCE_SQL},1.0)::double,6) as importance from obs"


def b6_episodes(spark: SparkSession, d: str) -> DataFrame:
    e = I.episodes(V.memories(spark, d), F.lit(0))
    return e.select("episode_id", F.size("ids").alias("n"))


SQL["b6_episodes"] = f"with {MEM_SQL} select 'episode_'||tenant_id||':'||app_id||':'||actor_id||':'||thread_id||'_0' as episode_id, count(*)::int as n from mem group by 1"


def c8_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = V.obs(spark, d)
    bad = rows.withColumn("text", F.when(C("seq") % 7 == 0, "abc").otherwise(C("text"))).withColumn("confidence", F.when(C("seq") % 11 == 0, 1.5).otherwise(C("confidence"))).withColumn("scope", F.when(C("seq") % 13 == 0, "galaxy").otherwise("actor"))
    return bad.select("seq", F.array_join(M.errors(bad), "; ").alias("errors"))


SQL["c8_validate"] = f"""with obs as ({OBS_SQL}) select seq, array_to_string(list_filter([case when seq%13=0 then 'scope: not in the domain' end, case when seq%7=0 then 'text: at least 4 characters' end, case when seq%11=0 then 'confidence: from 0 to 1' end], lambda x: x is not null),'; ') as errors from obs"""


def d1_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicates(V.observations(spark, d), V.as_of())


SQL["d1_duplicates"] = f"with {MEM_SQL}, f as (select seq as arrival_seq, first_value(seq) over (partition by tenant_id, app_id, actor_id, memory_type, lower(ntext) order by seq) as first_seq from n) select * from f where first_seq < arrival_seq"


def p1_ingest(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d)
    return m.select("id", "ord", "tenant_id", "actor_id", "thread_id", "memory_type", "text", "summary", "status", "scope", r6(C("confidence")).alias("confidence"), r6(C("importance")).alias("importance"), F.unix_millis("first_seen_at").alias("first_ms"), F.unix_millis("last_seen_at").alias("last_ms"), C("n_observations").cast("long").alias("n_observations"), C("metadata")["role"].alias("role"))


SQL["p1_ingest"] = f"""with {MEM_SQL} select 'mem_'||substring(sha256(concat_ws('|',tenant_id,app_id,actor_id,memory_type,ord::varchar)),1,16) as id, ord, tenant_id, actor_id, thread_id, memory_type, text, summary, status, 'actor' as scope,
 round(confidence,6) as confidence, round(importance,6) as importance, epoch_ms(first_seen_at) as first_ms, epoch_ms(last_seen_at) as last_ms, n_observations, '"'||role||'"' as role from mem"""


def e4_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.counts(V.memories(spark, d))


SQL["e4_ingest_counts"] = f"with {MEM_SQL} select count(*) as created, sum(n_observations-1)::bigint as updated from mem"


def e11_merge(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one lower-cased text, as observations of one actor."""
    docs = V.table(spark, d, "documents")
    o = docs.select(C("doc_id").alias("arrival_seq"), F.lit("t").alias("tenant_id"), F.lit("a").alias("app_id"), F.lit("u").alias("actor_id"), C("source").alias("thread_id"), F.lit("fact").alias("memory_type"), F.lit(None).cast("string").alias("scope"), "text", F.lit(None).cast("string").alias("summary"), F.create_map(C("source"), F.lit("1")).alias("metadata"), F.lit(None).cast(M.SOURCE).alias("source"), (C("doc_id") % 10 / 10).alias("confidence"), (C("doc_id") % 7 / 10).alias("importance"), F.lit(None).cast(M.DECAY).alias("decay"), V.as_of().alias("observed_at"))
    m = I.ingest(o, V.as_of())
    return m.select("ord", "thread_id", F.size("metadata").alias("n_keys"), r6(C("confidence")).alias("confidence"), r6(C("importance")).alias("importance"), C("n_observations").cast("long").alias("n_observations"))


SQL["e11_merge"] = f"select min(doc_id) as ord, arg_min(source,doc_id) as thread_id, count(distinct source)::int as n_keys, round(max(doc_id%10/10.0::double),6) as confidence, round(max(doc_id%7/10.0::double),6) as importance, count(*) as n_observations from documents group by lower(substring({V.norm('text')},1,1000))"


def a9_lookup(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d)
    ids = m.where("ord % 3 = 0").select("id")
    return S.by_id(m, ids, V.as_of()).select("ord", "text")


SQL["a9_lookup"] = f"with {LIVE_SQL} select ord, text from live where ord%3=0"


def a11_actor_list(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d)
    actors = m.where("actor_id in ('u1','u4','u7')").select("tenant_id", "app_id", "actor_id")
    return S.by_actor(m, actors, V.as_of()).select("tenant_id", "actor_id", "rank", "ord")


SQL["a11_actor_list"] = f"with {LIVE_SQL} select tenant_id, actor_id, row_number() over (partition by tenant_id, actor_id order by last_seen_at desc, ord)::int as rank, ord from live where actor_id in ('u1','u4','u7')"


def c1_filter(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark).withColumn("memory_types", F.when(C("query_id").isin("q1", "q4"), F.array(F.lit("fact"), F.lit("goal"))).when(C("query_id") == "q2", F.array().cast("array<string>"))).withColumn("thread_id", F.when(C("query_id") == "q6", "c5").otherwise(""))
    return S.candidates(q, V.memories(spark, d), V.as_of()).select("q.query_id", "m.ord")


SQL["c1_filter"] = f"""with {LIVE_SQL}, q as ({ASKED_SQL}) select query_id, ord from q join live m on q.tenant_id=m.tenant_id and q.app_id=m.app_id and (q.actor_id is null or q.actor_id=m.actor_id)
 and (query_id not in ('q1','q4') or memory_type in ('fact','goal')) and (query_id<>'q6' or thread_id='c5')"""


def c2_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Values are JSON literals: "user" fits, user without quotes doesn't."""
    q = V.asked(spark).withColumn("metadata", F.create_map(F.lit("role"), F.when(C("query_id") == "q1", '"user"').when(C("query_id") == "q2", "user").otherwise('"assistant"')))
    return S.candidates(q, V.memories(spark, d), V.as_of()).select("q.query_id", "m.ord")


SQL["c2_metadata"] = f"""with {LIVE_SQL}, q as ({ASKED_SQL}) select query_id, ord from q join live m on q.tenant_id=m.tenant_id and q.app_id=m.app_id and (q.actor_id is null or q.actor_id=m.actor_id)
 and role = case query_id when 'q1' then 'user' when 'q2' then '-' else 'assistant' end"""


def _said(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "ord", r6(C("score")).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def g1_search_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _said(S.lexical_hits(V.asked(spark), V.memories(spark, d), V.as_of()))


def _reasons_sql(*pairs: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ",".join(f"case when {t} then {n if n.startswith('(') else repr(n)} end" for t, n in pairs) + "], lambda x: x is not null),'; ')"


LEX_SQL = f"""{LIVE_SQL}, q as (select *, list_distinct({V.tok('query')}) as qt from ({ASKED_SQL})), lt as (select *, list_distinct({V.tok('text')}) as mt from live),
p as (select query_id, ord, memory_type, text, summary, thread_id, last_seen_at, confidence, importance, {V.ovl('qt', 'mt')} as o, {V.rec('last_seen_at')} as r from q join lt m on q.tenant_id=m.tenant_id and q.app_id=m.app_id and (q.actor_id is null or q.actor_id=m.actor_id)),
sc as (select *, o*0.55::double+r*0.15::double+confidence*0.15::double+importance*0.1::double+0.0::double as score, {_reasons_sql(('o>0.35', 'high lexical overlap'), ('r>0.7', 'recent memory'), ('confidence>=0.75', 'high confidence'), ('importance>=0.75', 'high importance'))} as reasons from p),
rk as (select *, row_number() over (partition by query_id order by score desc, last_seen_at desc, ord) as rank from sc where score>=0.2)"""
SQL["g1_search_lexical"] = f"with {LEX_SQL} select query_id, rank::int as rank, ord, round(score,6) as score, reasons from rk where rank<=8"


def n1_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lexical scores with feedback: every memory against one query of its tenant."""
    m = L.with_feedback(V.memories(spark, d), _signals(spark, d), F.expr("timestamp '2024-01-31 00:00:00'"))
    return _said(S.lexical_hits(V.asked(spark).withColumn("limit", F.lit(100)), m, V.as_of()))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return V.feedback(spark, d).join(V.memories(spark, d).select("ord", C("id").alias("memory_id")), "ord").select("seq", "memory_id", "signal")


FB_SQL = """fb as (select event_id%50*100 as ord, count(*) filter (where event_type='click') as selected, count(*) filter (where event_type='purchase') as positive, count(*) filter (where event_type='error') as negative from events where event_type in ('click','purchase','error') group by 1)"""
_AT = "timestamp '2024-01-31 00:00:00'"
_GONE31 = V.exp_("last_seen_at", "ttl_days").replace(V.AS_OF_SQL, _AT)
FED_SQL = f"""{MEM_SQL}, {FB_SQL}, fed as (select mem.* exclude (last_seen_at, status), case when mem.status='active' and not {_GONE31} then 'active' else 'archived' end as status, coalesce(f.positive,0)*1.0 as pos0, coalesce(f.negative,0)*1.0 as neg0, coalesce(f.selected,0) as sel0, f.ord is not null and mem.status='active' and not {_GONE31} as hit,
 mem.last_seen_at as was, case when f.ord is not null and mem.status='active' and not {_GONE31} then {_AT} else mem.last_seen_at end as last_seen_at, case when mem.status='active' and {_GONE31} then {_AT} when f.ord is not null and mem.status='active' and not {_GONE31} then {_AT} else mem.last_seen_at end as updated_at from mem left join fb f on mem.ord=f.ord)"""
SQL["n1_scores"] = f"""with {FED_SQL}, live as (select *, case when hit then greatest(least((pos0-neg0)*0.02,0.12),-0.12) else 0.0 end::double as b from fed where status='active' and not {V.exp_('last_seen_at', 'ttl_days')}),
q as (select *, list_distinct({V.tok('query')}) as qt from ({ASKED_SQL})), lt as (select *, list_distinct({V.tok('text')}) as mt from live),
p as (select query_id, ord, last_seen_at, updated_at, confidence, importance, b, {V.ovl('qt', 'mt')} as o, {V.rec('last_seen_at')} as r from q join lt m on q.tenant_id=m.tenant_id and q.app_id=m.app_id and (q.actor_id is null or q.actor_id=m.actor_id)),
sc as (select *, o*0.55::double+r*0.15::double+confidence*0.15::double+importance*0.1::double+b as score, {_reasons_sql(('o>0.35', 'high lexical overlap'), ('r>0.7', 'recent memory'), ('confidence>=0.75', 'high confidence'), ('importance>=0.75', 'high importance'), ('b>0.05', 'strong positive feedback'), ('b<-0.05', 'negative feedback penalty'))} as reasons from p),
rk as (select *, row_number() over (partition by query_id order by score desc, updated_at desc, ord) as rank from sc where score>=0.2)
select query_id, rank::int as rank, ord, round(score,6) as score, reasons from rk where rank<=100"""


def n2_enhanced(spark: SparkSession, d: str) -> DataFrame:
    return S.enhanced_hits(V.asked(spark), V.memories(spark, d), V.as_of()).select("query_id", "rank", "ord", F.round("score", 4).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


_NAMES = "array_to_string(list_transform({x}, lambda x: x.text),', ')"
ENH_SQL = f"""{LIVE_SQL}, q0 as (select *, {V.tok('query')} as qt, {Q.QENT_SQL.replace('{x}', 'query')} as qe0, {Q.TYPE_SQL.replace('{x}', 'lower(query)')} as type, {Q.WHEN_SQL.replace('{x}', 'lower(query)')} as w, {Q.FIRST_SQL.replace('{x}', 'lower(query)')} as fi from ({ASKED_SQL})),
q as (select *, list_distinct(qt) as qd, list_transform(qe0, lambda x: lower(x)) as qe, {V.emb('qt', 'sin')} as qa, {V.emb('qt', 'cos')} as qb from q0),
l0 as (select *, {V.tok('text')} as mt, {Q.ENTITIES_SQL} as e, {Q.TEMPORAL_SQL}, {Q.ORDER_SQL} as torder from live),
lt as (select *, list_distinct(mt) as md, {V.emb('mt', 'sin')} as ma, {V.emb('mt', 'cos')} as mb, {Q.RELEVANT_SQL} as relevant, len(list_filter(e, lambda x: x.type='PROBLEM'))>0 as has_problem from l0),
p as (select query_id, ord, memory_type, text, last_seen_at, confidence, importance, type, w, fi, qe0, relevant, torder, has_problem, {V.sim('qa', 'qb', 'ma', 'mb')} as s, {V.ovl('qd', 'md')} as l, {V.rec('last_seen_at')} as r,
 list_filter(e, lambda x: list_contains(qe, lower(x.text)) or list_contains(qt, lower(x.text))) as em, type='temporal' and relevant as timely, fi and has_problem as prob,
 case when fi and has_problem then list_filter(e, lambda x: x.type='OBJECT' and len(list_filter(qe, lambda y: contains(y, lower(x.text))))>0) else [] end as dev
 from q join lt m on q.tenant_id=m.tenant_id and q.app_id=m.app_id and (q.actor_id is null or q.actor_id=m.actor_id)),
b as (select *, least(len(em)*0.15,0.4)::double as eb, (case when timely and w='sequence' then 0.5 when timely then 0.3 else 0 end)::double as tb, (case when prob and len(dev)>0 then 0.8 when prob then 0.5 else 0 end)::double as pb from p),
sc as (select *, greatest(0,least(1,case when fi then pb*0.4+s*0.2+l*0.15+eb*0.15+tb*0.05+importance*0.03+confidence*0.02 when type='temporal' then s*0.3+tb*0.25+eb*0.2+l*0.15+r*0.05+confidence*0.03+importance*0.02
 when type='comparative' then eb*0.4+s*0.3+l*0.2+r*0.05+confidence*0.03+importance*0.02 else s*0.4+l*0.25+eb*0.2+r*0.08+confidence*0.04+importance*0.03 end))::double as score,
 {_reasons_sql(('s>0.7', 'high semantic similarity'), ('l>0.4', 'high lexical overlap'), ('r>0.7', 'recent memory'), ('confidence>=0.75', 'high confidence'), ('importance>=0.75', 'high importance'), ('timely', 'temporally relevant for temporal query'), ("timely and w='sequence'", 'has temporal ordering information'), ('len(em)>0', "('matches '||len(em)||' entities: '||" + _NAMES.replace('{x}', 'em') + ")"), ('prob', 'contains problem/issue language for first issue question'), ('len(dev)>0', "('device mentioned in problem context: '||" + _NAMES.replace('{x}', 'dev') + ")"))} as reasons from b),
rk as (select *, row_number() over (partition by query_id order by (case when type='temporal' then relevant end) desc nulls last, (case when timely and w='sequence' then torder end) asc nulls first, (case when not (timely and w='sequence') then score end) desc nulls last, (case when not (timely and w='sequence') then last_seen_at end) desc nulls last, ord) as rank from sc where score>=0.05)"""
SQL["n2_enhanced"] = f"with {ENH_SQL} select query_id, rank::int as rank, ord, round(score,4) as score, reasons from rk where rank<=20"


def g2_temporal_rank(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark).where("query_id in ('q1','q5','q6')").withColumn("limit", F.lit(50))
    return S.enhanced_hits(q, V.memories(spark, d), V.as_of()).select("query_id", "rank", "ord")


SQL["g2_temporal_rank"] = f"with {ENH_SQL} select query_id, rank::int as rank, ord from rk where rank<=50 and query_id in ('q1','q5','q6')"


def m11_answer(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark)
    return S.answers(q, S.enhanced_hits(q, V.memories(spark, d), V.as_of()))


SQL["m11_answer"] = f"""with {ENH_SQL}, h as (select query_id, rank, text, score, lower(text) as low, fi, has_problem, type='comparative' and len(qe0)>=2 as cmp, list_filter(list_transform(range(len(qe0)), lambda i: {{'i':i,'e':qe0[i+1]}}), lambda x: contains(lower(text),lower(x.e))) as held from rk where rank<=20),
a as (select query_id, bool_or(fi and has_problem and contains(low,'gps') and {V.part('low', 'issue', 'problem', 'not', 'malfunction')}) as gps, arg_min(held[1].e, rank) filter (where cmp and len(held)>0 and {V.part('low', 'first', 'before', 'initially')}) as timed,
 (min(held[1]) filter (where cmp and len(held)>0)).e as any_, arg_min(case when score>0.3 then string_split(text,'.')[1]||'.' else '' end, rank) as best from h group by 1)
select q.query_id, coalesce(case when gps then 'GPS system not functioning correctly' else coalesce(timed, any_, best) end, '') as answer from q left join a using (query_id)"""


def o7_enhanced_context(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark)
    out = K.answered_contexts(q, S.enhanced_hits(q.withColumn("limit", F.lit(5)), V.memories(spark, d), V.as_of()))
    return out.select("query_id", "context_text")


SQL["o7_enhanced_context"] = f"""with {ENH_SQL} select q.query_id, 'ENHANCED MEMORY SEARCH RESULTS:'||coalesce(string_agg(chr(10)||'- ['||memory_type||'] '||text||' (score: '||format('{{:.3f}}',score)||')', '' order by rank),'') as context_text from q left join rk on q.query_id=rk.query_id and rank<=5 group by 1"""


def f1_budget(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark).withColumn("max_chars", F.lit(600)).withColumn("max_items", F.lit(5))
    hits = S.lexical_hits(q.withColumn("limit", F.lit(10)), V.memories(spark, d), V.as_of())
    return K.packed(q, hits).select("query_id", "rank", "ord", C("used").alias("used_chars"))


PACK_SQL = f"""{LEX_SQL}, ln as (select query_id, rank, ord, memory_type, text, sum(length('- ['||memory_type||'] '||summary)) over (partition by query_id order by rank) as used from rk where rank<=10)"""
SQL["f1_budget"] = f"with {PACK_SQL} select query_id, rank::int as rank, ord, used::bigint as used_chars from ln where used<=600 and rank<=5"


def e1_profile_by_type(spark: SparkSession, d: str) -> DataFrame:
    t = K.texts_by_type(V.memories(spark, d), V.as_of())
    return t.select("tenant_id", "actor_id", "memory_type", "n", F.md5(F.array_join("texts", "\n")).alias("texts_md5"))


SQL["e1_profile_by_type"] = f"with {LIVE_SQL} select tenant_id, actor_id, memory_type, count(*) as n, md5(string_agg(text, chr(10) order by last_seen_at desc, ord)) as texts_md5 from live group by 1,2,3"


def e2_profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return K.profiles(V.memories(spark, d), V.as_of()).select("tenant_id", "actor_id", "summary", "count")


_SECT = "case memory_type " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(K.SECTIONS)) + " end"
_TITLE = "case memory_type " + " ".join(f"when '{k}' then '{t}:'" for k, t in K.SECTIONS.items()) + " end"
PROF_SQL = f"""pr as (select tenant_id, actor_id, memory_type, text, row_number() over (partition by tenant_id, actor_id, memory_type order by last_seen_at desc, ord) as n from live),
ps as (select tenant_id, actor_id, {_SECT} as i, {_TITLE}||chr(10)||string_agg('- '||text, chr(10) order by n) filter (where n<=3) as sect, count(*) as n from pr group by tenant_id, actor_id, memory_type),
prof as (select tenant_id, actor_id, string_agg(sect, chr(10) order by i) as summary, sum(n)::bigint as count from ps group by 1,2)"""
SQL["e2_profile_summary"] = f"with {LIVE_SQL}, {PROF_SQL} select * from prof"


def o3_context(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark).withColumn("max_chars", F.lit(600)).withColumn("max_items", F.lit(5))
    return K.contexts(q, V.memories(spark, d), V.as_of())


SQL["o3_context"] = f"""with {PACK_SQL}, {PROF_SQL}, body as (select query_id, 'RELEVANT MEMORIES:'||chr(10)||string_agg('- ['||memory_type||'] '||case when length(text)<=120 then text else substring(text,1,117)||'...' end, chr(10) order by rank) as b, count(*) as n from ln where used<=600 and rank<=5 group by 1)
select q.query_id, coalesce(prof.summary,'') as profile_summary, coalesce(n,0)::bigint as total_memories, regexp_replace(concat_ws(chr(10), case when prof.summary is not null then 'KNOWN ACTOR PROFILE:'||chr(10)||prof.summary||chr(10) end, b),'^[ \n]+|[ \n]+$','','g') as context_text
from q left join body using (query_id) left join prof on prof.tenant_id=q.tenant_id and prof.actor_id=q.actor_id"""


def o5_diverse(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark).withColumn("max_items", F.lit(6)).withColumn("max_chars", F.lit(700))
    hits = S.lexical_hits(q.withColumn("limit", F.lit(18)), V.memories(spark, d), V.as_of())
    return K.diverse(q, hits).select("query_id", F.posexplode(F.transform("selected", lambda h: h["rank"])).alias("pos", "rank"))


def _either(yes: str, no: str) -> str:
    t = lambda x, p: f"regexp_matches({x},'(?i){p}')"
    return f"(({t('a.text', yes)} and {t('b.text', no)}) or ({t('a.text', no)} and {t('b.text', yes)}))"


CON_SQL = f"""{MEM_SQL}, con as (select a.seq as new_seq, b.ord as old_ord, case when {V.jac(V.raw('a.text'), V.raw('b.text'))}>0.5 then 0.8 else 0.3 end::double as confidence from obs a join mem b on a.tenant_id=b.tenant_id and a.app_id=b.app_id and a.actor_id=b.actor_id
 and ({_either('gps.*work', 'gps.*not.*work|gps.*broken|gps.*issue')} or {_either('car.*fine', 'car.*problem|car.*issue|car.*trouble')}))"""
#: con, with obs said again; obs3: these.
CON3_SQL = CON_SQL.replace(", con as (", ", obs3 as (select * replace ('again,  '||text as text) from obs), con as (").replace("from obs a join", "from obs3 a join")


#: sl: (query_id, pos, rank) of the hits that are chosen of h3 (18 of each query, 6 wanted, 700 characters).
PICK_SQL = f"""{LEX_SQL}, h3 as (select query_id, rank, memory_type, score, coalesce(nullif(summary,''),text) as said, coalesce(thread_id,'~') as th, row_number() over (partition by query_id order by score desc, rank) as k, count(*) over (partition by query_id) as n from rk where rank<=18),
fd as (select distinct query_id, 0::bigint as k, []::bigint[] as kept, 0::bigint as chars, []::varchar[] as ths from h3
 union all select query_id, k, case when skip then kept else list_append(kept, rank) end, case when skip then chars else chars+length(said) end, case when skip or list_contains(ths, th) then ths else list_append(ths, th) end
 from (select h3.query_id, h3.k, h3.rank::bigint as rank, h3.said, h3.th, fd.kept, fd.chars, fd.ths, len(fd.kept)>=6 or fd.chars+length(h3.said)>700 or (list_contains(fd.ths, h3.th) and len(fd.ths)<3) as skip from fd join h3 on h3.query_id=fd.query_id and h3.k=fd.k+1)),
sl as (select query_id, (rank-1)::bigint as pos, rank from h3 where n<=6 union all select query_id, unnest(range(len(kept))) as pos, unnest(kept) as rank from (select query_id, arg_max(kept, k) as kept from fd where query_id in (select query_id from h3 where n>6) group by 1))"""
SQL["o5_diverse"] = f"with recursive {PICK_SQL} select query_id, pos::int as pos, rank::int as rank from sl"


def r4_tuned_context(spark: SparkSession, d: str) -> DataFrame:
    """The second service's contexts: three times the items, chosen by thread, in sections."""
    q = V.asked(spark).withColumn("max_items", F.lit(6)).withColumn("max_chars", F.lit(700))
    m = V.memories(spark, d)
    return U.tuned_contexts(q, m, V.as_of(), S.lexical_hits(q.withColumn("limit", F.lit(18)), m, V.as_of()))


def o6_sections(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark).withColumn("max_items", F.lit(10))
    hits = S.lexical_hits(q, V.memories(spark, d), V.as_of())
    return K.sectioned(K.diverse(q, hits))


SQL["o6_sections"] = f"""with {LEX_SQL}, h as (select query_id, memory_type, min(rank) as first, string_agg('- ['||memory_type||'] '||summary||case when score>0.8 then ' (high relevance)' else '' end, chr(10) order by rank) as lines from rk where rank<=8 group by 1,2)
select query_id, string_agg(chr(10)||upper(memory_type)||' MEMORIES:'||chr(10)||lines, chr(10) order by first) as context_text from h group by 1"""


SQL["r4_tuned_context"] = f"""with recursive {PICK_SQL}, {PROF_SQL}, sc3 as (select query_id, memory_type, min(pos) as first, string_agg('- ['||memory_type||'] '||said||case when score>0.8 then ' (high relevance)' else '' end, chr(10) order by pos) as lines from sl join h3 using (query_id, rank) group by 1,2),
tx as (select query_id, string_agg(chr(10)||upper(memory_type)||' MEMORIES:'||chr(10)||lines, chr(10) order by first) as t from sc3 group by 1)
select q.query_id, coalesce(nullif(prof.summary,''),'No profile available') as profile_summary, coalesce((select max(n) from h3 where h3.query_id=q.query_id),0)::bigint as total_memories, coalesce(t,'') as context_text from q left join tx using (query_id) left join prof on prof.tenant_id=q.tenant_id and prof.actor_id=q.actor_id"""


def r3_tuned_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All observations, said again in other words, against the memories of all: the memories that they contradict lose
    confidence, and the observations become memories with the importance that the preparation gives them."""
    m = V.memories(spark, d)
    new = V.observations(spark, d).withColumn("text", F.concat(F.lit("again,  "), "text"))
    ready = U.prepared(new.withColumn("confidence", F.lit(0.5)))
    old = L.penalized(m, L.contradiction_counts(ready, m)).select("ord", "confidence", "importance", "text")
    fresh = I.ingest(ready, V.as_of()).select(C("ord") + 10_000_000, "confidence", "importance", "text")
    return old.union(fresh).select("ord", r6(C("confidence")).alias("confidence"), r6(C("importance")).alias("importance"), F.md5("text").alias("text_md5"))


SQL["r3_tuned_ingest"] = f"""with {CON3_SQL}, pn as (select old_ord, count(*) as k from con group by 1),
p3 as (select seq, tenant_id, actor_id, memory_type, observed_at, ttl_days, least({Q.IMPORTANCE_SQL},1.0)::double as imp, substring({V.norm('text')},1,1000) as nt from obs3),
k3 as (select *, lag(observed_at) over w as prev3, first_value(ttl_days) over w as pol3 from p3 window w as (partition by tenant_id, actor_id, memory_type, lower(nt) order by seq)),
s3 as (select *, sum(case when prev3 is null or {V.exp_('prev3', 'pol3')} then 1 else 0 end) over (partition by tenant_id, actor_id, memory_type, lower(nt) order by seq) as seg from k3),
g3 as (select tenant_id, actor_id, memory_type, lower(nt) as low, seg, min(seq)+10000000 as ord, 0.5::double as confidence, max(imp) as importance, arg_min(nt,seq) as text from s3 group by all)
select ord, round((case when k>0 then greatest(confidence-0.2*k,0.1) else confidence end)::double,6) as confidence, round(importance,6) as importance, md5(text) as text_md5 from mem left join pn on ord=old_ord
union all select ord, confidence, round(importance,6), md5(text) from g3"""


def e5_compact(spark: SparkSession, d: str) -> DataFrame:
    return L.compact(V.memories(spark, d), V.as_of())


SQL["e5_compact"] = f"with {MEM_SQL} select count(*) filter (where status='active' and {V.exp_('last_seen_at', 'ttl_days')}) as archived_expired, 0::bigint as archived_superseded from mem"


def p2_archive(spark: SparkSession, d: str) -> DataFrame:
    return L.archived(V.memories(spark, d), V.as_of()).select("ord", "status", F.unix_millis("updated_at").alias("updated_ms"))


SQL["p2_archive"] = f"with {MEM_SQL} select ord, case when {V.exp_('last_seen_at', 'ttl_days')} then 'archived' else status end as status, case when status='active' and {V.exp_('last_seen_at', 'ttl_days')} then epoch_ms({V.AS_OF_SQL}) else epoch_ms(last_seen_at) end as updated_ms from mem"


def e14_feedback(spark: SparkSession, d: str) -> DataFrame:
    return L.feedback_counts(V.feedback(spark, d).withColumn("memory_id", C("ord").cast("string"))).select("memory_id", "selected", "positive", "negative", "total")


SQL["e14_feedback"] = f"with {FB_SQL} select ord::varchar as memory_id, selected, positive, negative, selected+positive+negative as total from fb"


def p3_feedback_apply(spark: SparkSession, d: str) -> DataFrame:
    m = L.with_feedback(V.memories(spark, d), _signals(spark, d), F.expr("timestamp '2024-01-31 00:00:00'"))
    return m.select("ord", "status", C("stats.selected").alias("selected"), C("stats.positive").alias("positive"), C("stats.negative").alias("negative"), F.unix_millis("last_seen_at").alias("last_ms"), F.unix_millis("updated_at").alias("updated_ms"))


SQL["p3_feedback_apply"] = f"with {FED_SQL} select ord, status, case when hit then sel0 else 0 end::bigint as selected, case when hit then pos0 else 0 end::bigint as positive, case when hit then neg0 else 0 end::bigint as negative, epoch_ms(last_seen_at) as last_ms, epoch_ms(updated_at) as updated_ms from fed"


def a2_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d).select("id", "text", "status", "ord")
    changed = m.where("ord % 4 = 0").withColumn("text", F.concat(F.lit("new: "), "text")).select("id", "text", (C("ord") + 1_000_000).alias("ord"))
    new = m.where("ord % 8 = 0").select(F.concat("id", F.lit("x")).alias("id"), "text", (C("ord") + 2_000_000).alias("ord"))
    return I.upsert(m, changed.unionByName(new)).select("id", "text", "status", "ord")


_ID = "'mem_'||substring(sha256(concat_ws('|',tenant_id,app_id,actor_id,memory_type,ord::varchar)),1,16)"
SQL["a2_upsert"] = f"with {MEM_SQL} select {_ID} as id, case when ord%4=0 then 'new: '||text else text end as text, status, ord from mem union all select {_ID}||'x', text, null, ord+2000000 from mem where ord%8=0"


def _contradictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All observations against all memories."""
    m = V.memories(spark, d)
    return L.contradictions(V.observations(spark, d), m, "ord"), m


def m8_contradictions(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _contradictions(spark, d)
    return found.select("new_seq", C("ord").alias("old_ord"), "confidence")


SQL["m8_contradictions"] = f"with {CON_SQL} select * from con"


def p5_confidence_penalty(spark: SparkSession, d: str) -> DataFrame:
    m = V.memories(spark, d)
    return L.penalized(m, L.contradiction_counts(V.observations(spark, d), m)).select("ord", r6(C("confidence")).alias("confidence"))


SQL["p5_confidence_penalty"] = f"with {CON_SQL}, pn as (select old_ord, count(*) as k from con group by 1) select ord, round((case when k>0 then greatest(confidence-0.2*k,0.1) else confidence end)::double,6) as confidence from mem left join pn on ord=old_ord"


def p6_resolve(spark: SparkSession, d: str) -> DataFrame:
    found, m = _contradictions(spark, d)
    return L.resolved(m, found, threshold=0.25).groupBy("status").agg(F.count("*").alias("n"))


SQL["p6_resolve"] = f"with {CON_SQL} select case when ord in (select old_ord from con where confidence>0.25) then 'superseded' else status end as status, count(*) as n from mem group by 1"


def p7_forget(spark: SparkSession, d: str) -> DataFrame:
    return L.forgotten(V.memories(spark, d), V.as_of(), days=60, least_importance=0.5).select("ord", "status")


SQL["p7_forget"] = f"with {MEM_SQL} select ord, case when status='active' and last_seen_at < {V.AS_OF_SQL} - interval 60 day and importance<0.5 then 'archived' else status end as status from mem"


def m5_flags(spark: SparkSession, d: str) -> DataFrame:
    e = I.enriched(V.memories(spark, d))
    return e.select("ord", "has_problem", "has_device", C("temporal.relevant").alias("relevant"), "temporal_order", F.size("tokens").alias("n_tokens"))


SQL["m5_flags"] = f"""with {MEM_SQL}, t as (select ord, text, {Q.ENTITIES_SQL} as e, {Q.TEMPORAL_SQL}, {Q.ORDER_SQL} as temporal_order, len({V.tok('text')})::int as n_tokens from mem)
select ord, len(list_filter(e, lambda x: x.type='PROBLEM'))>0 as has_problem, len(list_filter(e, lambda x: x.type='OBJECT'))>0 as has_device, {Q.RELEVANT_SQL} as relevant, temporal_order, n_tokens from t"""

QUERIES = {f.__name__: f for f in (b2_normalize, b7_preprocess, b6_episodes, c8_validate, d1_duplicates, p1_ingest, e4_ingest_counts, e11_merge, a9_lookup, a11_actor_list, c1_filter, c2_metadata, g1_search_lexical, n1_scores, n2_enhanced, g2_temporal_rank, m11_answer, o7_enhanced_context, f1_budget, e1_profile_by_type, e2_profile_summary, o3_context, o5_diverse, o6_sections, r3_tuned_ingest, r4_tuned_context, e5_compact, p2_archive, e14_feedback, p3_feedback_apply, a2_upsert, m8_contradictions, p5_confidence_penalty, p6_resolve, p7_forget, m5_flags)}
