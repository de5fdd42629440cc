"""Queries of the two-layer store, the streams' batch forms, and the two example assistants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.functions import patterns as P
from sparkrecall.operators import layers as Y
from sparkrecall.operators import recipes as R
from sparkrecall.queries import views as V
from sparkrecall.queries.views import AS_OF_SQL, ASKED_SQL, OBS_SQL, r6
from sparkrecall.streaming import limits as T

SQL: dict[str, str] = {}
C = F.col


def b10_events(spark: SparkSession, d: str) -> DataFrame:
    e = Y.events_of(V.memories(spark, d), V.as_of())
    return e.select("seq", "session_id", "role", F.unix_millis("ts").alias("ts_ms"), "content")


SQL["b10_events"] = f"with {V.MEM_SQL} select ord as seq, thread_id as session_id, 'user' as role, epoch_ms({AS_OF_SQL}) as ts_ms, text as content from mem"


def q4_facts(spark: SparkSession, d: str) -> DataFrame:
    f = Y.semantic_facts(V.events(spark, d))
    return f.select("seq", "actor_id", "content", "confidence", "importance", F.array_join("tags", ",").alias("tags"))


_EV = f"ev as ({OBS_SQL})"
_FACTS = "list_filter([case when " + V.part("text", "issue", "problem") + " and " + V.part("text", "gps") + " then {'content':'GPS system had functionality issues','c':0.9,'i':0.9,'tags':'device,problem,gps','pos':0} end," + ",".join(f"case when {V.part('text', x)} then {{'content':'User has/mentioned {x}','c':0.8,'i':0.7,'tags':'device,{x}','pos':{i + 1}}} end" for i, x in enumerate(Y.DEVICES)) + "], lambda x: x is not null)"
SQL["q4_facts"] = f"with {_EV}, f as (select seq, actor_id, unnest({_FACTS}) as x from ev) select seq, actor_id, x.content as content, x.c::double as confidence, x.i::double as importance, x.tags as tags from f"


def q5_preferences(spark: SparkSession, d: str) -> DataFrame:
    """Preferences found, and how many of them the strategies of the model keep: none."""
    found = Y.preferences(V.events(spark, d))
    kept = Y.drawn(V.events(spark, d)).where("type = 'preference'")
    return found.agg(F.count("*").alias("found")).crossJoin(kept.agg(F.count("*").alias("kept")))


SQL["q5_preferences"] = f"with {_EV} select count(*) as found, 0::bigint as kept from ev where {V.part('text', 'prefer', 'like', 'favorite')}"


def q6_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = Y.session_summaries(V.events(spark, d))
    return s.select("tenant_id", "actor_id", "content", F.size("extracted_from").alias("n"), "seq")


_TOPICS = ",".join(f"{{'t':'{t}','at':min(observed_at) filter (where {V.part('text', *parts)}),'s':min(seq) filter (where {V.part('text', *parts)}),'i':{i}}}" for i, (t, parts) in enumerate(P.TOPICS.items()))
SUM_SQL = f"""ss as (select tenant_id, actor_id, thread_id, count(*) as n, max(seq) as seq, max(observed_at) as last_updated, array_to_string(list_transform(list_sort(list_transform(list_filter([{_TOPICS}], lambda x: x.at is not null), lambda x: {{'at':x.at,'s':x.s,'i':x.i,'t':x.t}})), lambda x: x.t),', ') as topics from ev group by 1,2,3 having count(*)>=5),
sm as (select tenant_id, actor_id, 'Session summary: '||n||' messages exchanged about '||case when topics='' then 'general conversation' else topics end as content, n, seq, last_updated from ss)"""
SQL["q6_summaries"] = f"with {_EV}, {SUM_SQL} select tenant_id, actor_id, content, n::int as n, seq from sm"


def q7_store(spark: SparkSession, d: str) -> DataFrame:
    i = V.insights(spark, d)
    return i.select("tenant_id", "actor_id", "type", "content", "confidence", "importance", F.size("extracted_from").alias("n_sources"), "n", F.array_join("tags", ",").alias("tags"), F.unix_millis("last_updated").alias("last_ms"))


#: dr: what is drawn; it: equal ones merged, numbered; fo: for each the number of the one it is stored as; st: what is stored.
#: Needs `with recursive`.
INS_SQL = f"""{_EV}, {SUM_SQL}, fa as (select seq, tenant_id, actor_id, observed_at, unnest({_FACTS}) as x from ev),
dr as (select tenant_id, actor_id, 'fact' as type, x.content as content, x.c::double as confidence, x.i::double as importance, x.tags::varchar as tags, 1 as ns, observed_at as lu, {{'seq':seq::bigint,'strategy':0,'pos':x.pos::int}} as o from fa
 union all select tenant_id, actor_id, 'summary', content, 0.6::double, 0.5::double, 'summary,session', n::int, last_updated, {{'seq':seq::bigint,'strategy':2,'pos':0::int}} from sm),
sa as (select tenant_id, actor_id, type, lower(content) as low, min(o) as o, arg_min(content,o) as content, max(confidence) as confidence, arg_min(importance,o) as importance, arg_min(tags,o) as tags, sum(ns)::int as ns, count(*) as n, max(lu) as lu from dr group by 1,2,3,4),
it as (select *, row_number() over (partition by tenant_id, actor_id, type order by o) as k, {V.raw('content')} as w from sa),
fo as (select tenant_id, actor_id, type, k, k as into_, [{{'k':k,'w':w}}] as kept from it where k=1
 union all select tenant_id, actor_id, type, k, coalesce(hit,k), case when hit is null then list_append(kept,{{'k':k,'w':w}}) else kept end
 from (select it.tenant_id, it.actor_id, it.type, it.k, it.w, fo.kept, list_filter(fo.kept, lambda x: {V.jac('x.w', 'it.w')}>0.8)[1].k as hit from fo join it on it.tenant_id=fo.tenant_id and it.actor_id=fo.actor_id and it.type=fo.type and it.k=fo.k+1)),
st as (select tenant_id, actor_id, type, into_ as k, max(case when k=into_ then content end) as content, max(confidence) as confidence, max(case when k=into_ then importance end) as importance, max(case when k=into_ then tags end) as tags,
 sum(ns)::int as n_sources, sum(n)::bigint as n, case when sum(n)>1 then {AS_OF_SQL} else max(lu) end as last_updated, min(o) as o from fo join it using (tenant_id, actor_id, type, k) group by 1,2,3,4)"""
SQL["q7_store"] = f"with recursive {INS_SQL} select tenant_id, actor_id, type, content, confidence, importance, n_sources, n, tags, epoch_ms(last_updated) as last_ms from st"


def q8_consolidate(spark: SparkSession, d: str) -> DataFrame:
    c = Y.consolidated(V.insights(spark, d), as_of=V.as_of())
    return c.select("tenant_id", "actor_id", "type", "content", "confidence", "importance", F.size("extracted_from").alias("n_sources"), F.array_join(F.array_sort("tags"), ",").alias("tags"), "absorbed", F.unix_millis("last_updated").alias("last_ms"))


SQL["q8_consolidate"] = f"""with recursive {INS_SQL}, w as (select *, {V.raw('content')} as w from st),
pr as (select a.tenant_id, a.actor_id, a.type, a.k as into_, b.k, b.confidence, b.importance, b.n_sources, b.tags from w a join w b on a.tenant_id=b.tenant_id and a.actor_id=b.actor_id and a.type=b.type and a.o<b.o and {V.jac('a.w', 'b.w')}>0.7),
m as (select tenant_id, actor_id, type, into_ as k, max(confidence) as c, max(importance) as i, sum(n_sources) as s, count(*) as n, string_agg(tags,',') as t from pr group by 1,2,3,4)
select st.tenant_id, st.actor_id, st.type, content, greatest(confidence,coalesce(c,0)) as confidence, greatest(importance,coalesce(i,0)) as importance, (n_sources+coalesce(s,0))::int as n_sources, array_to_string(list_sort(list_distinct(string_split(concat_ws(',',tags,t),','))),',') as tags, coalesce(m.n,0)::bigint as absorbed, epoch_ms(case when m.n>0 then {AS_OF_SQL} else last_updated end) as last_ms
from st left join m using (tenant_id, actor_id, type, k) where (tenant_id, actor_id, type, k) not in (select (tenant_id, actor_id, type, k) from pr)"""


def q8_consolidate_messages(spark: SparkSession, d: str) -> DataFrame:
    """Raw messages as insights of one type: similar ones of an actor are merged into the first."""
    rows = V.obs(spark, d).select(C("seq").alias("id"), C("seq").alias("order"), "tenant_id", "app_id", "actor_id", F.lit("fact").alias("type"), C("text").alias("content"), "confidence", "importance", F.array(C("thread_id")).alias("extracted_from"), F.array("memory_type").alias("tags"))
    c = Y.consolidated(rows, threshold=0.3)
    return c.select("id", r6(C("confidence")).alias("confidence"), r6(C("importance")).alias("importance"), F.size("extracted_from").alias("n_sources"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


SQL["q8_consolidate_messages"] = f"""with {_EV}, r as (select seq as id, tenant_id, actor_id, confidence, importance, memory_type, {V.raw('text')} as w from ev),
pr as (select a.id as into_, b.* from r a join r b on a.tenant_id=b.tenant_id and a.actor_id=b.actor_id and a.id<b.id and {V.jac('a.w', 'b.w')}>0.3),
st as (select * from r where id not in (select id from pr)), m as (select into_, max(confidence) as c, max(importance) as i, count(*) as n, list(memory_type) as t from pr group by 1)
select id, round(greatest(confidence,coalesce(c,0)),6) as confidence, round(greatest(importance,coalesce(i,0)),6) as importance, (1+coalesce(n,0))::int as n_sources, array_to_string(list_sort(list_distinct(list_concat([memory_type],coalesce(t,[])))),',') as tags from st left join m on id=into_"""


def q9_search(spark: SparkSession, d: str) -> DataFrame:
    q = V.asked(spark).withColumn("min_score", F.lit(0.02)).withColumn("limit", F.lit(12))
    return Y.search(q, V.insights(spark, d), V.events(spark, d), V.as_of()).select("query_id", "rank", "memory_type", "text", "thread_id", "summary", r6(C("score")).alias("score"))


SQL["q9_search"] = f"""with recursive {INS_SQL}, q as (select *, {V.raw('query')} as qw from ({ASKED_SQL})),
h as (select query_id, type as memory_type, content as text, 'long_term' as thread_id, type||': '||substring(content,1,100)||'...' as summary, {V.jac('qw', V.raw('content'))}*confidence*importance*(1+0.2*exp(-{V.age('last_updated')}/30)) as score, 0 as layer, o from q join st on q.tenant_id=st.tenant_id and (q.actor_id is null or q.actor_id=st.actor_id)),
ih as (select *, row_number() over (partition by query_id order by o) as place from h where score>0.02),
lf as (select q.*, 12-(select count(*) from ih where ih.query_id=q.query_id) as missing from q),
e as (select query_id, missing, qw, text, thread_id, row_number() over (partition by query_id order by observed_at desc, seq) as place from lf join ev on lf.tenant_id=ev.tenant_id and (lf.actor_id is null or lf.actor_id=ev.actor_id) where missing>0),
e2 as (select *, {V.jac('qw', V.raw('text'))} as score from e where place<=missing*2), e3 as (select *, row_number() over (partition by query_id order by place) as kept from e2 where score>0.02),
b as (select query_id, memory_type, text, thread_id, summary, score, layer, place from ih union all select query_id, 'episode', text, thread_id, substring(text,1,100)||'...', score*0.8, 1, place from e3 where kept<=missing),
r as (select *, row_number() over (partition by query_id order by score desc, layer, place) as rank from b)
select query_id, rank::int as rank, memory_type, text, thread_id, summary, round(score,6) as score from r where rank<=12"""


def b8_layer_records(spark: SparkSession, d: str) -> DataFrame:
    both = Y.insight_memories(V.insights(spark, d)).unionByName(Y.event_memories(V.events(spark, d)))
    return both.select("memory_type", "thread_id", "scope", "text", "summary", "confidence", "importance", "decay_kind", "ttl_days", F.unix_millis("last_seen_at").alias("last_ms"))


SQL["b8_layer_records"] = f"""with recursive {INS_SQL} select type as memory_type, 'long_term' as thread_id, 'actor' as scope, content as text, type||': '||substring(content,1,100)||'...' as summary, confidence, importance, 'none' as decay_kind, null::int as ttl_days, epoch_ms(last_updated) as last_ms from st
union all select 'episode', thread_id, 'thread', text, substring(text,1,100)||'...', 0.8::double, 0.6::double, 'time', 7, epoch_ms(observed_at) from ev"""


def a10_layer_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By id over both layers; an id that both have is the insight's."""
    e = V.events(spark, d)
    twin = V.insights(spark, d).withColumn("id", F.concat(F.lit("e"), C("order.seq").cast("string"))).dropDuplicates(["id"])
    ids = e.select(C("event_id").alias("id"))
    return Y.by_id(twin, e, ids).select("id", "scope")


SQL["a10_layer_lookup"] = f"with recursive {INS_SQL}, t as (select distinct 'e'||o.seq as id from st) select 'e'||seq as id, case when 'e'||seq in (select id from t) then 'actor' else 'thread' end as scope from ev"


def a12_layer_list(spark: SparkSession, d: str) -> DataFrame:
    return Y.by_actor(V.insights(spark, d), V.asked(spark).where("actor_id is not null")).select("tenant_id", "actor_id", "memory_type", "text")


SQL["a12_layer_list"] = f"with recursive {INS_SQL} select tenant_id, actor_id, type as memory_type, content as text from st where (tenant_id, actor_id) in (select (tenant_id, actor_id) from ({ASKED_SQL}) where actor_id is not null)"


def e6_dual_compact(spark: SparkSession, d: str) -> DataFrame:
    i = V.insights(spark, d).withColumn("confidence", C("confidence") - 0.55)
    return Y.compact(V.events(spark, d), i, V.as_of())


SQL["e6_dual_compact"] = f"with recursive {INS_SQL} select (select count(*) from ev where epoch_ms({AS_OF_SQL})-epoch_ms(observed_at) > 30*86400000::bigint)+(select count(*) from st where confidence-0.55<0.3) as archived_expired, 0::bigint as archived_superseded"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """events as requests of their users, a day for a minute."""
    e = V.table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    scaled = F.timestamp_millis(F.floor((F.unix_millis("ts") - 1704067200000) / 1440).cast("long") + 1704067200000)
    return e.select(C("user_id").cast("string").alias("identity"), scaled.alias("ts"), C("event_id").alias("seq"))


def s1_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return T.rate_limited(_requests(spark, d), 3).select("identity", "seq", "allowed", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


SQL["s1_rate_limit"] = """with recursive r as (select user_id::varchar as identity, event_id as seq, (floor((epoch_ms(ts)-1704067200000)/1440.0)::bigint+1704067200000) as ms, row_number() over (partition by user_id order by floor((epoch_ms(ts)-1704067200000)/1440.0)::bigint, event_id) as n from events),
w as (select identity, seq, ms, n, ms as begin, 1 as k from r where n=1
 union all select r.identity, r.seq, r.ms, r.n, case when r.ms-w.begin>=60000 then r.ms else w.begin end, case when r.ms-w.begin>=60000 then 1 else w.k+1 end from w join r on r.identity=w.identity and r.n=w.n+1)
select identity, seq, k<=3 as allowed, case when k>3 then greatest(1,ceil((begin+60000-ms)/1000.0))::int else 0 end as retry_after from w"""


def f7_ema(spark: SparkSession, d: str) -> DataFrame:
    rows = V.table(spark, d, "events").select("event_id", "user_id", "value")
    return T.moving_average(rows, "user_id", "event_id", "value").select("event_id", F.round(C("ema") + 1e-9, 4).alias("ema"))


SQL["f7_ema"] = """with recursive r as (select event_id, user_id, value, row_number() over (partition by user_id order by event_id) as n from events),
w as (select event_id, user_id, n, 0.1::double*value as ema from r where n=1 union all select r.event_id, r.user_id, r.n, 0.9::double*w.ema+0.1::double*r.value from w join r on r.user_id=w.user_id and r.n=w.n+1)
select event_id, round(ema+1e-9,4) as ema from w"""


def s4_sessions(spark: SparkSession, d: str) -> DataFrame:
    """What the session stream says of each session in the end, of a whole table."""
    return T.sessions(V.events(spark, d)).select("tenant_id", "actor_id", "session_id", "n", F.unix_millis("last_ts").alias("last_ms"), "topics")


SQL["s4_sessions"] = f"""with {_EV}, ss as (select tenant_id, actor_id, thread_id, count(*) as n, max(observed_at) as last_ts, array_to_string(list_transform(list_sort(list_transform(list_filter([{_TOPICS}], lambda x: x.at is not null), lambda x: {{'at':x.at,'s':x.s,'i':x.i,'t':x.t}})), lambda x: x.t),', ') as topics from ev group by 1,2,3)
select tenant_id, actor_id, thread_id as session_id, n, epoch_ms(last_ts) as last_ms, case when topics='' then 'general conversation' else topics end as topics from ss"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return V.obs(spark, d).select("seq", "actor_id", "thread_id", F.when(C("role") == "user", "customer").otherwise("agent").alias("role"), "text")


MSG_SQL = f"ms as (select seq, actor_id, thread_id, case when role='user' then 'customer' else 'agent' end as role, text from ({OBS_SQL}))"


def _rx(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def v1_support_importance(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("seq", P.support_importance(C("text"), C("role")).alias("importance"))


SQL["v1_support_importance"] = f"with {MSG_SQL} select seq, case when role='customer' and {V.part('text', 'issue', 'problem', 'bug', 'error', 'complaint', 'frustrated')} then 0.9::double when {V.part('text', 'prefer', 'like', 'want')} then 0.7::double else 0.5::double end as importance from ms"


def v2_support_extract(spark: SparkSession, d: str) -> DataFrame:
    o = R.support_observations(_messages(spark, d)).where("pos >= 0")
    return o.select("seq", "memory_type", "text", "confidence", "importance", "category")


SEV_SQL = f"case when {V.part('text', 'urgent', 'critical', 'emergency')} then 'high' when {V.part('text', 'frustrated', 'annoying')} then 'medium' else 'low' end"


def _pull(pattern: str, made: str, more: str) -> str:
    return f"select seq, {made} as text, {more} from ms where regexp_matches(text,{_rx(pattern)})"


def _g(pattern: str, n: int = 1) -> str:
    return f"regexp_extract(text,{_rx(pattern)},{n})"


SUP_SQL = " union all ".join([_pull(p, f"'Customer prefers: '||{_g(p)}", "'preference' as memory_type, 0.8::double as confidence, 0.7::double as importance, 'preference' as category") for p in P.SUPPORT_PREFERENCES] + [_pull(p, f"'Customer reported issue: '||{_g(p)}", f"'fact', 0.85::double, 0.9::double, {SEV_SQL}") for p in P.SUPPORT_ISSUES])
SQL["v2_support_extract"] = f"with {MSG_SQL} {SUP_SQL}"


def v3_severity(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d).withColumn("text", F.concat("text", F.when(C("seq") % 5 == 0, " this is URGENT").when(C("seq") % 5 == 1, " so annoying").otherwise("")))
    return rows.select("seq", P.severity(C("text")).alias("severity"))


SQL["v3_severity"] = f"with {MSG_SQL} select seq, {SEV_SQL} as severity from (select seq, text||case seq%5 when 0 then ' this is URGENT' when 1 then ' so annoying' else '' end as text from ms)"


def v4_history(spark: SparkSession, d: str) -> DataFrame:
    return R.support_history(R.support_observations(_messages(spark, d)))


_ALL_SUP = f"al as (select m.actor_id, s.memory_type, s.text, s.category from ({SUP_SQL}) s join ms m using (seq) union all select actor_id, 'fact', text, 'chat' from ms)"
SQL["v4_history"] = f"with {MSG_SQL}, {_ALL_SUP} select actor_id, count(*) as total, count(*) filter (where {V.part('text', 'issue', 'problem')}) as issues, count(*) filter (where {V.part('text', 'issue')}) as issue_count, count(*) filter (where memory_type='preference') as preferences, count(*) filter (where category='chat') as conversations from al group by 1"


def v6_assistant_importance(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("seq", P.assistant_importance(C("text")).alias("importance"))


SQL["v6_assistant_importance"] = f"with {MSG_SQL} select seq, case when {V.part('text', 'birthday', 'appointment', 'meeting', 'anniversary', 'deadline', 'important', 'remember')} then 0.95::double when {V.part('text', 'prefer', 'goal', 'plan', 'want to', 'need to')} then 0.8::double when {V.part('text', 'usually', 'always', 'often', 'routine')} then 0.7::double else 0.6::double end as importance from ms"


def _assistant(spark: SparkSession, d: str, category: str) -> DataFrame:
    return R.assistant_observations(_messages(spark, d)).where(C("category") == category).select("seq", "memory_type", "text", "confidence", "importance")


def v7_personal_info(spark: SparkSession, d: str) -> DataFrame:
    return _assistant(spark, d, "personal_info")


INFO_SQL = " union all ".join(_pull(p, f"'User''s {k}: '||{_g(p)}", "'fact' as memory_type, 0.9::double as confidence, 0.9::double as importance") for k, p in P.PERSONAL_INFO.items())
SQL["v7_personal_info"] = f"with {MSG_SQL} {INFO_SQL}"


def v8_preferences(spark: SparkSession, d: str) -> DataFrame:
    return _assistant(spark, d, "preference")


_PV = "'preference' as memory_type, 0.85::double as confidence, 0.7::double as importance"
_FAV = f"case when {_g(P.FAVORITE)}<>'' and {_g(P.FAVORITE, 2)}<>'' then 'Favorite '||{_g(P.FAVORITE)}||': '||{_g(P.FAVORITE, 2)} else 'Likes: '||{_g(P.FAVORITE)} end"
PREF_SQL = " union all ".join([_pull(P.LIKES, f"'Likes: '||{_g(P.LIKES)}", _PV), _pull(P.DISLIKES, f"'Dislikes: '||{_g(P.DISLIKES)}", _PV), _pull(P.FAVORITE, _FAV, _PV)])
SQL["v8_preferences"] = f"with {MSG_SQL} {PREF_SQL}"


def v9_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _assistant(spark, d, "schedule")


def _sched(p: str, groups: int) -> str:
    time = f"case when {_g(p, 2)}='' then 'unspecified time' else {_g(p, 2)} end" if groups > 1 else "'unspecified time'"
    return _pull(p, f"'Scheduled: '||{_g(p)}||' at '||{time}", "'fact' as memory_type, 0.8::double as confidence, 0.9::double as importance")


SCHED_SQL = " union all ".join(_sched(p, n) for p, n in zip(P.SCHEDULES, (2, 2, 1), strict=True))
SQL["v9_schedule"] = f"with {MSG_SQL} {SCHED_SQL}"


def v10_habits(spark: SparkSession, d: str) -> DataFrame:
    return _assistant(spark, d, "habit")


HABIT_SQL = " union all ".join(_pull(p, f"'Habit/Routine: '||{_g(p)}", "'preference' as memory_type, 0.75::double as confidence, 0.6::double as importance") for p in P.HABITS)
SQL["v10_habits"] = f"with {MSG_SQL} {HABIT_SQL}"


def v12_personality(spark: SparkSession, d: str) -> DataFrame:
    return R.personality(R.assistant_observations(_messages(spark, d)))


_ALL_AS = f"al as (select m.actor_id, s.memory_type, s.category from (select seq, memory_type, 'personal_info' as category from ({INFO_SQL}) union all select seq, memory_type, 'preference' from ({PREF_SQL}) union all select seq, memory_type, 'schedule' from ({SCHED_SQL}) union all select seq, memory_type, 'habit' from ({HABIT_SQL})) s join ms m using (seq) union all select actor_id, 'fact', 'message' from ms)"
SQL["v12_personality"] = f"with {MSG_SQL}, {_ALL_AS} select *, least(100, preferences*5+personal_info*10+habits*3) as score from (select actor_id, count(*) filter (where memory_type='preference') as preferences, count(*) filter (where category='habit') as habits, count(*) filter (where category='schedule') as schedule, count(*) filter (where category='personal_info') as personal_info from al group by 1)"


def v11_suggestions(spark: SparkSession, d: str) -> DataFrame:
    s = R.suggestions(R.assistant_observations(_messages(spark, d)))
    return s.select("actor_id", F.array_join("suggestions", "|").alias("suggestions"))


SQL["v11_suggestions"] = f"""with {MSG_SQL}, {_ALL_AS}, f as (select actor_id, bool_or(memory_type='preference') as p, bool_or(category='schedule') as s, bool_or(category='habit') as h from al group by 1)
select actor_id, array_to_string(list_filter([case when p then 'Tell me more about your preferences' end, case when p then 'Get personalized recommendations' end, case when s then 'Review your schedule' end, case when s then 'Add a new appointment' end, case when h then 'Check on your routines' end, case when h then 'Set a new habit reminder' end, 'Share personal information', 'Set a goal'], lambda x: x is not null)[1:4],'|') as suggestions from f"""


def v13_schedule_item(spark: SparkSession, d: str) -> DataFrame:
    items = _messages(spark, d).select("actor_id", F.concat(F.lit("call "), "thread_id").alias("event"), F.lit("Friday").alias("at"), F.when(C("seq") % 2 == 0, C("text")).alias("description"))
    return R.schedule_item(items).select("actor_id", "thread_id", "text", "confidence", "importance")


SQL["v13_schedule_item"] = f"with {MSG_SQL} select actor_id, 'schedule' as thread_id, 'Scheduled: call '||thread_id||' on Friday. '||case when seq%2=0 then text else '' end as text, 1.0::double as confidence, 0.9::double as importance from ms"


def v5_support_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies to every message, given the issue its thread's first message is taken for."""
    mem = F.when(C("seq") % 2 == 0, F.array(F.struct(F.lit("preference").alias("memory_type"), F.lit("Customer prefers: tea").alias("text")))).otherwise(F.array(F.struct(F.lit("fact").alias("memory_type"), F.lit("An issue with tea").alias("text"))))
    return _messages(spark, d).select("seq", F.md5(R.support_reply(C("text"), mem)).alias("reply_md5"))


def _reply(replies: dict[str, str], name: str, x: str | None = None) -> str:
    """A reply as SQL, with what a memory says, if it has a place for that."""
    quoted = replies[name].replace("'", "''")
    return f"'{quoted}'" if x is None else "'" + quoted.replace("{}", f"'||{x}||'") + "'"


_S = R.SUPPORT_REPLIES
SQL["v5_support_replies"] = f"""with {MSG_SQL}, r as (select seq, case when {V.part('text', 'hello', 'hi')} then case when seq%2<>0 then {_reply(_S, 'greet_known', "'an issue with tea'")} else {_reply(_S, 'greet')} end
 when {V.part('text', 'issue', 'problem')} then case when seq%2<>0 then {_reply(_S, 'issue_known', "'An issue with tea'")} else {_reply(_S, 'issue')} end
 when {V.part('text', 'status', 'update')} then case when seq%2<>0 then {_reply(_S, 'status_known', "'An issue with tea'")} else {_reply(_S, 'status')} end
 when {V.part('text', 'thank')} then {_reply(_S, 'thanks')}
 when seq%2=0 then {_reply(_S, 'preference', "'Customer prefers: tea'")} else {_reply(_S, 'any', "'An issue with tea'")} end as reply from ms) select seq, md5(reply) as reply_md5 from r"""


def v14_assistant_replies(spark: SparkSession, d: str) -> DataFrame:
    mem = F.array(F.struct(F.lit("fact").alias("memory_type"), F.lit("User's name: Sarah").alias("text"), F.lit("personal_info").alias("category")))
    return _messages(spark, d).select("seq", R.assistant_reply(C("text"), mem, C("seq") % 24).alias("reply"))


_A = R.ASSISTANT_REPLIES
_HELLO = "(case when seq%24<12 then 'Good morning' when seq%24<18 then 'Good afternoon' else 'Good evening' end||', Sarah')"
SQL["v14_assistant_replies"] = f"""with {MSG_SQL} select seq, case when {V.part('text', 'what is my', 'when is my')} then {_reply(_A, 'personal_known', "'User''s name: Sarah'")} when {V.part('text', 'what do i have', 'schedule', 'appointment')} then {_reply(_A, 'schedule')}
 when {V.part('text', 'recommend', 'suggest', 'what should i')} then {_reply(_A, 'recommend')} when {V.part('text', 'remind me', 'routine')} then {_reply(_A, 'habit')}
 when {V.part('text', 'goal', 'achieve')} then {_reply(_A, 'goal')} when {V.part('text', 'hello', 'hi', 'good')} then {_reply(_A, 'greet_known', _HELLO)}
 else {_reply(_A, 'any', "'user''s name: sarah'")} end as reply from ms"""

QUERIES = {f.__name__: f for f in (b10_events, q4_facts, q5_preferences, q6_summaries, q7_store, q8_consolidate, q8_consolidate_messages, q9_search, b8_layer_records, a10_layer_lookup, a12_layer_list, e6_dual_compact, s1_rate_limit, f7_ema, s4_sessions, v1_support_importance, v2_support_extract, v3_severity, v4_history, v5_support_replies, v6_assistant_importance, v7_personal_info, v8_preferences, v9_schedule, v10_habits, v11_suggestions, v12_personality, v13_schedule_item, v14_assistant_replies)}
