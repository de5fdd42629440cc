"""Tables of the engine: domains, schemas, validation of what comes in.

Every operator that depends on the present time takes it as `as_of`. Metadata maps hold JSON literals as their values,
so that 1 and "1" differ. `ord` numbers memories in the order in which they first came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The domains.
MEMORY_TYPES = ["fact", "preference", "goal", "project", "episode", "tool_outcome", "instruction", "profile", "pattern", "summary"]
INGEST_TYPES = MEMORY_TYPES[:8]
SCOPES = ["thread", "actor", "workspace", "app", "tenant"]
STATUSES = ["active", "superseded", "archived"]
DECAY_KINDS = ["none", "time", "inactivity"]
SIGNALS = ["selected", "positive", "negative"]

#: A time as requests give it.
UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"

DECAY = "struct<kind:string,ttl_days:int>"
SOURCE = "struct<source_type:string,source_id:string,source_session_id:string>"
STATS = "struct<selected:bigint,positive:bigint,negative:bigint>"

OBSERVATIONS = (
    f"arrival_seq bigint, tenant_id string, app_id string, actor_id string, thread_id string, memory_type string, scope string, "
    f"text string, summary string, metadata map<string,string>, source {SOURCE}, confidence double, importance double, "
    f"decay {DECAY}, observed_at timestamp"
)
MEMORIES = (
    f"id string, tenant_id string, app_id string, actor_id string, thread_id string, scope string, memory_type string, text string, "
    f"summary string, metadata map<string,string>, confidence double, importance double, status string, source {SOURCE}, decay {DECAY}, "
    f"first_seen_at timestamp, last_seen_at timestamp, created_at timestamp, updated_at timestamp, stats {STATS}, ord bigint"
)


def errors(obs: DataFrame) -> Column:
    """array<string> of path and message for each rule that an observation breaks."""
    c = F.col

    def rule(broken: Column, message: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(False)), F.lit(message))

    missing = lambda name: c(name).isNull() | (c(name) == "")
    rules = [
        *(rule(missing(n), f"{n}: must not be empty") for n in ("tenant_id", "app_id", "actor_id")),
        rule(c("memory_type").isNull() | ~c("memory_type").isin(INGEST_TYPES), "memory_type: not in the domain"),
        rule(c("scope").isNotNull() & ~c("scope").isin(SCOPES), "scope: not in the domain"),
        rule(c("text").isNull() | (F.length("text") < 4), "text: at least 4 characters"),
        rule(~c("confidence").between(0, 1), "confidence: from 0 to 1"),
        rule(~c("importance").between(0, 1), "importance: from 0 to 1"),
    ]
    if "broken" in obs.columns:
        rules.insert(0, rule(c("broken").isNotNull(), "not an observation in JSON"))
    if "source" in obs.columns:
        rules.append(rule(c("source.source_type").isNull() | (c("source.source_type") == ""), "source.source_type: must not be empty"))
    if "observed_at_text" in obs.columns:
        rules.append(rule(c("observed_at_text").isNotNull() & c("observed_at").isNull(), "observed_at: not a time in UTC"))
    if "decay" in obs.columns:
        rules += [rule(c("decay").isNotNull() & (c("decay.kind").isNull() | ~c("decay.kind").isin(DECAY_KINDS)), "decay.kind: not in the domain"), rule(c("decay.ttl_days") <= 0, "decay.ttl_days: must be positive")]
    return F.array_compact(F.array(*rules))


def validated(obs: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with array<string> errors). Strict: any invalid row fails the whole request, as it runs."""
    marked = obs.withColumn("errors", errors(obs))
    if strict:
        wrong = F.raise_error(F.concat(F.lit("invalid observation: "), F.array_join("errors", "; ")))
        marked = marked.withColumn("errors", F.when(F.size("errors") > 0, F.array(wrong.cast("string"))).otherwise(F.col("errors")))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def check_search(query: str, tenant_id: str, app_id: str, limit: int | None = None, min_score: float | None = None) -> None:
    """Arguments of a search, or ValueError."""
    if not query or not tenant_id or not app_id:
        raise ValueError("query, tenant_id and app_id must not be empty")
    if limit is not None and not 1 <= limit <= 100:
        raise ValueError("limit: from 1 to 100")
    if min_score is not None and not 0 <= min_score <= 1:
        raise ValueError("min_score: from 0 to 1")


def check_budget(max_items: int | None = None, max_chars: int | None = None) -> None:
    if max_items is not None and not 1 <= max_items <= 30:
        raise ValueError("max_items: from 1 to 30")
    if max_chars is not None and not 1 <= max_chars <= 20000:
        raise ValueError("max_chars: from 1 to 20000")


def check_signal(signal: str) -> None:
    if signal not in SIGNALS:
        raise ValueError(f"signal: one of {', '.join(SIGNALS)}")


def _raised(rows: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """`rows`, of which one that breaks a rule fails the whole request, as it runs."""
    test = F.lit(True)
    for broken, message in rules:
        test = test & F.when(F.coalesce(broken, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    return rows.where(test)


def checked_search(queries: DataFrame) -> DataFrame:
    """check_search for every query of a table; columns that it lacks have their defaults."""
    c = F.col
    missing = lambda n: c(n).isNull() | (c(n) == "")
    rules = [(missing("query") | missing("tenant_id") | missing("app_id"), "query, tenant_id and app_id must not be empty")]
    if "limit" in queries.columns:
        rules.append((~c("limit").between(1, 100), "limit: from 1 to 100"))
    if "min_score" in queries.columns:
        rules.append((~c("min_score").between(0, 1), "min_score: from 0 to 1"))
    return _raised(queries, *rules)


def checked_budget(queries: DataFrame) -> DataFrame:
    """check_budget for every query of a table."""
    most = {"max_items": 30, "max_chars": 20000}
    return _raised(queries, *((~F.col(n).between(1, m), f"{n}: from 1 to {m}") for n, m in most.items() if n in queries.columns))


def checked_signals(signals: DataFrame) -> DataFrame:
    """check_signal for every row."""
    c = F.col
    return _raised(signals, (c("signal").isNull() | ~c("signal").isin(SIGNALS), f"signal: one of {', '.join(SIGNALS)}"), (c("memory_id").isNull() | (c("memory_id") == ""), "memory_id must not be empty"))


def parse_types(csv: Column) -> Column:
    """array<string> of a comma-separated list; null, no filter, if it is empty or any value is not in the domain."""
    parts = F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(INGEST_TYPES)), parts)


def first_value(values: list[str] | str | None) -> str | None:
    """The first of a repeated parameter."""
    return (values[0] if values else None) if isinstance(values, list) else values
