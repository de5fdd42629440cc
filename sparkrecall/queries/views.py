"""The tables that the queries share, in Spark and as DuckDB SQL, and pieces of SQL that state each function anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.functions import text as X
from sparkrecall.functions.text import STOPWORDS
from sparkrecall.operators import ingest as I
from sparkrecall.operators import layers
from sparkrecall.sources.store import settled

# Every turn of a conversation, with a phrase that the patterns know before it; every third phrase occurs alone too, so that
# texts repeat.
AS_OF_SQL = "timestamp '2024-02-01 00:00:00'"
OBS_SQL = """
with phrase as (select * from (values
 (0,'I have an issue with my GPS not working correctly'),(1,'The first service appointment was on March 15, 2024'),
 (2,'I prefer morning meetings before 11 AM'),(3,'I like Italian food and jazz'),(4,'My car is fine after the last visit'),
 (5,'GPS works again since yesterday'),(6,'There was a problem with the Samsung Galaxy phone 3 days ago'),
 (7,'Which came first, the workshop or the webinar?'),(8,'Remind me to call Rachel on Friday'),(9,'I usually walk home every morning'),
 (10,'My name is Sarah and I live in Hawaii'),(11,'Deadline is next Tuesday'),(12,'The laptop then failed with an error'),
 (13,'I want email notifications over SMS'),(14,'My routine includes yoga'),(15,'Nothing unusual today')) as v(pid, phrase))
select conv_id*100+turn+case when alone then 50 else 0 end as seq, 't'||cast(conv_id%2 as varchar(9)) as tenant_id, 'app' as app_id,
 'u'||cast(conv_id%20 as varchar(9)) as actor_id, 'c'||cast(conv_id as varchar(19)) as thread_id, role,
 case turn%8 when 0 then 'fact' when 1 then 'preference' when 2 then 'goal' when 3 then 'project' when 4 then 'fact'
             when 5 then 'episode' when 6 then 'preference' else 'instruction' end as memory_type,
 case when alone then phrase else phrase||' '||text end as text,
 cast(50+10*((conv_id+turn)%5) as double)/cast(100 as double) as confidence,
 cast(40+15*(turn%4) as double)/cast(100 as double) as importance, cast(30+60*(conv_id%3) as int) as ttl_days,
 timestamp '2023-11-01 00:00:00' + (conv_id*20 + turn) * interval '1' hour as observed_at
from conversations join phrase on pid=(conv_id*7+turn)%16 join (values (false),(true)) as b(alone) on not alone or turn%3=0
"""
ASKED_SQL = """
select * from (values
 ('q1','What was the first issue with my car GPS?','t0','app',null),
 ('q2','Which came first, the ''workshop'' or the webinar?','t1','app',null),
 ('q3','which do I like, the phone or the laptop','t0','app','u4'),
 ('q4','I prefer morning meetings','t1','app','u3'),
 ('q5','How many days before the service appointment','t0','app',null),
 ('q6','last visit of the car','t1','app','u5'),
 ('q7','tell me about Italian food','t0','app','u2')) as v(query_id, query, tenant_id, app_id, actor_id)
"""


def as_of() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS_SQL.replace("from conversations", "from {conversations}"), conversations=table(spark, sf_dir, "conversations")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs in the shape of the engine's input."""
    c = F.col
    return obs(spark, sf_dir).select(
        c("seq").alias("arrival_seq"), "tenant_id", "app_id", "actor_id", "thread_id", "memory_type", F.lit(None).cast("string").alias("scope"), "text", F.lit(None).cast("string").alias("summary"),
        F.create_map(F.lit("role"), F.concat(F.lit('"'), "role", F.lit('"'))).alias("metadata"), F.struct(F.lit("chat").alias("source_type"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("source_session_id")).alias("source"),
        "confidence", "importance", F.struct(F.lit("time").alias("kind"), c("ttl_days")).alias("decay"), "observed_at", "role",
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.ingest(observations(spark, sf_dir), as_of())


def asked(spark: SparkSession) -> DataFrame:
    return spark.sql(ASKED_SQL)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs as an event log: the session is the conversation."""
    return obs(spark, sf_dir).select("seq", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("event_id"), "tenant_id", "app_id", "actor_id", F.col("thread_id").alias("session_id"), F.col("observed_at").alias("ts"), "role", F.col("text").alias("content"))


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored insights; those that several met are updated at as_of."""
    return settled(layers.stored(layers.drawn(events(spark, sf_dir)), as_of=as_of()))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as signals on memories: the event's number picks the memory by its number in the order."""
    c = F.col
    signal = F.when(c("event_type") == "click", "selected").when(c("event_type") == "purchase", "positive").when(c("event_type") == "error", "negative")
    return table(spark, sf_dir, "events").select(c("event_id").alias("seq"), (c("event_id") % 50 * 100).alias("ord"), signal.alias("signal")).where("signal is not null")


def r6(x: Column) -> Column:
    return F.round(x, 6)


# ---- DuckDB -----------------------------------------------------------------------------------------------------------

STOP_SQL = "(" + ",".join(f"'{w}'" for w in STOPWORDS) + ")"


def norm(x: str) -> str:
    return rf"trim(regexp_replace({x},'\s+',' ','g'))"


def tok(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({norm(x)}),'[^a-z0-9\s]',' ','g'),'\s+'), lambda t: length(t)>1 and t not in {STOP_SQL})"


def ovl(a: str, b: str) -> str:
    """Of lists of distinct tokens."""
    return f"(case when len({a})=0 or len({b})=0 then 0.0 else len(list_intersect({a},{b}))::double/greatest(len({a}),len({b})) end)"


def raw(x: str) -> str:
    return rf"string_split_regex(lower({x}),'\s+')"


def jac(a: str, b: str) -> str:
    return f"(len(list_distinct(list_intersect({a},{b})))::double/len(list_distinct(list_concat({a},{b}))))"


def hash_(t: str) -> str:
    return f"abs(list_reduce(list_prepend(0::bigint, list_transform(string_split({t},''), lambda c: ascii(c)::bigint)), lambda h, c: ((((h*31+c+2147483648) % 4294967296) + 4294967296) % 4294967296) - 2147483648))::double"


def emb(tokens: str, f: str) -> str:
    return f"coalesce(list_sum(list_transform({tokens}, lambda t: {f}({hash_('t')}))), 0.0)"


def sim(a: str, b: str, c: str, d: str) -> str:
    """Of embeddings (a, b) and (c, d)."""
    ip = lambda p, q, r, s: f"({p}*{r}*{X.GRAM_COS}+{q}*{s}*{X.GRAM_SIN}+({p}*{s}+{r}*{q})*({X.GRAM_MIXED}))"
    uv, uu, vv = ip(a, b, c, d), ip(a, b, a, b), ip(c, d, c, d)
    return f"(case when {uu}<=0 or {vv}<=0 then 0.0 else greatest(0.0, {uv}/sqrt({uu}*{vv})) end)"


def age(ts: str) -> str:
    return f"((epoch_us({AS_OF_SQL})-epoch_us({ts}))/86400000000.0::double)"


def rec(ts: str) -> str:
    return f"exp(-ln(2.0::double)*greatest({age(ts)},0)/30)"


def exp_(ts: str, ttl: str) -> str:
    return f"({ttl}>0 and epoch_ms({AS_OF_SQL})-epoch_ms({ts}) > {ttl}::bigint*86400000)"


def words(alternatives: str) -> str:
    return rf"'(?i)\b(?:{alternatives})\b'".replace("Mary's", "Mary''s")


def every(x: str, alternatives: str) -> str:
    return f"regexp_extract_all({x},{words(alternatives)})"


def has(x: str, alternatives: str) -> str:
    return f"regexp_matches({x},{words(alternatives)})"


def part(x: str, *parts: str) -> str:
    return "(" + " or ".join(f"contains(lower({x}),'{p}')" for p in parts) + ")"


def joined(list_: str, sep: str = ",") -> str:
    return f"array_to_string({list_},'{sep}')"


_KEYS = "tenant_id, app_id, actor_id, memory_type, lower(ntext)"
#: obs, and mem: the memories that ingesting obs leaves.
MEM_SQL = f"""obs as ({OBS_SQL}),
n as (select *, substring({norm('text')},1,1000) as ntext from obs),
k as (select *, lag(observed_at) over w as prev, first_value(ttl_days) over w as pol from n window w as (partition by {_KEYS} order by seq)),
s as (select *, sum(case when prev is null or {exp_('prev', 'pol')} then 1 else 0 end) over (partition by {_KEYS} order by seq) as segment from k),
g as (select tenant_id, app_id, actor_id, memory_type, lower(ntext) as low, segment, min(seq) as ord, arg_min(ntext,seq) as text, arg_min(thread_id,seq) as thread_id,
 arg_min(ttl_days,seq) as ttl_days, max(confidence) as confidence, max(importance) as importance, arg_min(observed_at,seq) as first_seen_at,
 arg_max(observed_at,seq) as last_seen_at, arg_max(role,seq) as role, count(*) as n_observations from s group by all),
mem as (select *, case when length(text)<=120 then text else substring(text,1,117)||'...' end as summary,
 case when max(segment) over (partition by tenant_id, app_id, actor_id, memory_type, low) > segment and {exp_('last_seen_at', 'ttl_days')} then 'archived' else 'active' end as status from g)"""
LIVE_SQL = f"{MEM_SQL}, live as (select * from mem where status='active' and not {exp_('last_seen_at', 'ttl_days')})"
