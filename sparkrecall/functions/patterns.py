"""What the engine reads off texts and queries: dates, events, entities, query classes, importance, contradictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrecall.functions.text import WS, contains_any, jaccard, let, raw_words, words_pattern

# The model's word lists and patterns.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
EVENT_WORDS = "service|appointment|meeting|event|visit|trip|purchase|issue|problem"
ORDER_WEIGHTS = {"first": -10, "initial": -8, "started": -6, "then": 0, "next": 2, "after": 4, "last": 8, "final": 10}
DEVICES = "GPS|Samsung|Galaxy|S22|Dell|XPS|13|iPhone|iPad|MacBook|Toyota|Honda|Civic|Corolla"
THINGS = "bike|car|vehicle|laptop|phone|smartphone|tablet"
ENTITIES = [
    (DEVICES, "OBJECT", 0.9),
    (THINGS, "OBJECT", 0.8),
    ("service|appointment|meeting|workshop|webinar|festival|mass|church|Effective Communication|Data Analysis|Time Management", "EVENT", 0.9),
    ("March|February|January|April|May|June|July|August|September|October|November|December", "TIME", 0.8),
    (DAYS, "TIME", 0.7),
    ("yesterday|today|tomorrow|ago|later|first|last|before|after", "TIME", 0.6),
    ("issue|problem|trouble|malfunction|not working|broken|failed|error", "PROBLEM", 0.9),
    ("Rachel|John|Mary|Mike|Sarah|David", "PERSON", 0.8),
    (r"Yellowstone|Hawaii|Virginia|California|New York|St\. Mary's|cathedral", "PLACE", 0.8),
]
QUERY_ENTITIES = [DEVICES, THINGS, "workshop|webinar|meeting|service|appointment|festival|mass|church", "Time Management|Data Analysis|Python|Effective Communication", "tomatoes|marigolds|seeds"]
CONTRADICTIONS = [(r"(?i)gps.*work", r"(?i)gps.*not.*work|gps.*broken|gps.*issue"), (r"(?i)car.*fine", r"(?i)car.*problem|car.*issue|car.*trouble")]
DATE_PATTERNS = [
    (r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{1,2}-\d{1,2}", ""),
    (rf"(?:{MONTHS}){WS}+\d{{1,2}},?{WS}+\d{{4}}", "(?i)"),
    (rf"(?:{SHORT_MONTHS}){WS}+\d{{1,2}},?{WS}+\d{{4}}", "(?i)"),
    (rf"yesterday|today|tomorrow|last{WS}+\w+|next{WS}+\w+|this{WS}+\w+", "(?i)"),
    (rf"\d+{WS}+(?:days?|weeks?|months?|years?){WS}+(?:ago|before|after|later)", "(?i)"),
    ("first|second|third|last|final|initial", "(?i)"),
    ("before|after|during|while|when|then|next|previously|subsequently", "(?i)"),
]


def every_match(text: Column, alternatives: str, flags: str = "(?i)") -> Column:
    return F.regexp_extract_all(text, F.lit(words_pattern(alternatives, flags=flags)), F.lit(0))


def has_word(text: Column, *alternatives: str) -> Column:
    return text.rlike(words_pattern(*alternatives))


def temporal(text: Column) -> Column:
    """struct(dates, events, relevant): mentions in the order of the patterns, each spelling once."""
    dates = F.array_distinct(F.concat(*(every_match(text, p, flags) for p, flags in DATE_PATTERNS)))
    events = F.array_distinct(every_match(text, EVENT_WORDS))
    relevant = (F.size(dates) > 0) | (F.size(events) > 0) | has_word(text, "first", "second", "third", "last", "before", "after", "when", "then")
    return F.struct(dates.alias("dates"), events.alias("events"), relevant.alias("relevant"))


def temporal_order(text: Column) -> Column:
    out = F.lit(0)
    for word, weight in ORDER_WEIGHTS.items():
        out = out + F.when(has_word(text, word), weight).otherwise(0)
    return out


def entities(text: Column) -> Column:
    """array<struct<text, type, confidence>>: every match of every list, repeats included."""

    def named(words: str, kind: str, confidence: float) -> Column:
        return F.transform(every_match(text, words), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))

    return F.concat(*(named(*e) for e in ENTITIES))


def has_type(entities_: Column, kind: str) -> Column:
    return F.exists(entities_, lambda e: e["type"] == kind)


def query_entities(query: Column) -> Column:
    """Quoted items, then known names in the order of the lists; each spelling once."""
    return F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit("'([^']+)'"), F.lit(1)), *(every_match(query, words) for words in QUERY_ENTITIES)))


def classify(query: Column) -> Column:
    """struct(type, temporal_type, confidence, first_issue)."""
    q = F.lower(query)
    first_issue = has_word(q, f"first{WS}+issue", f"first{WS}+problem")
    is_temporal = has_word(q, "first", "second", "third", "last", "before", "after", "when", f"how{WS}+long", f"how{WS}+many{WS}+days", "which.*first") | first_issue
    comparative = has_word(q, "which.*or") | (has_word(q, "which") & has_word(q, "or"))
    kind = F.when(is_temporal, "temporal").when(comparative, "comparative").when(has_word(q, "prefer", "like", "favorite", "choose", "recommendation"), "preference").otherwise("factual")
    when = (
        F.when(has_word(q, f"how{WS}+many{WS}+days", f"how{WS}+long"), "duration")
        .when(has_word(q, "when", f"what{WS}+time", f"what{WS}+date"), "specific_time")
        .when(has_word(q, "before", "after", "since", "until"), "relative_time")
        .otherwise("sequence")
    )
    return F.struct(
        kind.alias("type"),
        F.when(is_temporal, when).alias("temporal_type"),
        F.when(kind == "temporal", 0.9).when(kind == "factual", 0.6).otherwise(0.8).alias("confidence"),
        first_issue.alias("first_issue"),
    )


def importance(text: Column, given: Column, role: Column) -> Column:
    """The given importance (0 and null count as 0.5), raised by what the text holds; 1 at most."""
    low = F.lower(text)
    n = F.size(raw_words(text))
    plus = lambda test, x: F.when(test, F.lit(x)).otherwise(0.0)
    base = F.when(F.coalesce(given, F.lit(0.0)) == 0, 0.5).otherwise(given)
    raised = base + plus(n > 20, 0.1) + plus(n > 50, 0.1) + plus(F.contains(low, F.lit("?")), 0.15)
    raised = raised + plus(contains_any(low, "issue", "problem", "trouble"), 0.2) + plus(contains_any(low, "gps", "samsung", "galaxy"), 0.15)
    raised = raised + plus(contains_any(low, "first", "before", "after"), 0.1) + plus(F.coalesce(role == "user", F.lit(False)), 0.1)
    return F.least(raised, F.lit(1.0))


def contradiction_confidence(a: Column | None = None, b: Column | None = None) -> Column:
    """Of two texts' words; without them, of texts that share half of theirs at most."""
    return F.lit(0.3) if a is None else F.when(jaccard(a, b) > 0.5, 0.8).otherwise(0.3)


#: Topics and the parts of words that name them.
TOPICS = {"automotive": ("car", "vehicle"), "technology": ("device", "phone", "laptop"), "real estate": ("house", "home")}
NO_TOPIC = "general conversation"


def topics(text: Column) -> Column:
    """array<string> of the topics named, in the order of TOPICS."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(contains_any(low, *parts), F.lit(topic)) for topic, parts in TOPICS.items())))


# Fixed values of the two example assistants: patterns (group numbers in the text built from them) and importance words.
SUPPORT_PREFERENCES = [r"(?i)i prefer (.*)", r"(?i)i like (.*)", r"(?i)i want (.*)", r"(?i)i need (.*)"]
SUPPORT_ISSUES = [r"(?i)issue with (.*)", r"(?i)problem with (.*)", r"(?i)(.*) is not working", r"(?i)(.*) doesn't work"]
PERSONAL_INFO = {
    "name": r"(?i)my name is (\w+)",
    "birthday": r"(?i)birthday.*(\w+ \d{1,2}(?:st|nd|rd|th)?)",
    "age": r"(?i)i am (\d+) years old",
    "location": r"(?i)i live in ([^,.]+)",
    "job": r"(?i)i work (?:as|at) ([^,.]+)",
    "relationship": r"(?i)(?:my|i have a) (husband|wife|partner|boyfriend|girlfriend)",
}
LIKES = r"(?i)i (?:prefer|like|love|enjoy) (.*?)(?:\.|,|$)"
DISLIKES = r"(?i)i (?:don't like|hate|dislike) (.*?)(?:\.|,|$)"
FAVORITE = r"(?i)my favorite (.*?) is (.*?)(?:\.|,|$)"
SCHEDULES = [
    r"(?i)(?:i have|schedule|book) (?:a |an )?(meeting|appointment|call|interview) (?:on|at) (.*?)(?:\.|,|$)",
    r"(?i)(?:remind me to|i need to) (.*?) (?:on|at|by) (.*?)(?:\.|,|$)",
    r"(?i)(?:deadline|due) (?:is |on )?(.*?)(?:\.|,|$)",
]
HABITS = [r"(?i)i (?:usually|always|often|typically) (.*?)(?:\.|,|$)", r"(?i)my routine (?:is|includes) (.*?)(?:\.|,|$)", r"(?i)every (?:day|morning|evening|week) i (.*?)(?:\.|,|$)"]


# Words that raise a message's importance or severity, inside other words too.
SUPPORT_TROUBLE = ("issue", "problem", "bug", "error", "complaint", "frustrated")
SUPPORT_WISHES = ("prefer", "like", "want")
SEVERITY = {"high": ("urgent", "critical", "emergency"), "medium": ("frustrated", "annoying")}
ASSISTANT_IMPORTANCE = {
    0.95: ("birthday", "appointment", "meeting", "anniversary", "deadline", "important", "remember"),
    0.8: ("prefer", "goal", "plan", "want to", "need to"),
    0.7: ("usually", "always", "often", "routine"),
}


def _by_words(text: Column, table: dict, otherwise: object) -> Column:
    """The first key of the table any of whose words the text holds."""
    low = F.lower(text)
    return F.coalesce(*(F.when(contains_any(low, *words), F.lit(key)) for key, words in table.items()), F.lit(otherwise))


def support_importance(text: Column, role: Column) -> Column:
    trouble = (role == "customer") & contains_any(F.lower(text), *SUPPORT_TROUBLE)
    return F.when(trouble, 0.9).otherwise(_by_words(text, {0.7: SUPPORT_WISHES}, 0.5))


def severity(text: Column) -> Column:
    return _by_words(text, SEVERITY, "low")


def assistant_importance(text: Column) -> Column:
    return _by_words(text, ASSISTANT_IMPORTANCE, 0.6)


def _found(text: Column, pattern: str, made: Column, **more: Column) -> Column:
    """struct(text, ...) if the pattern is found, else null."""
    return F.when(text.rlike(pattern), F.struct(made.alias("text"), *(v.alias(k) for k, v in more.items())))


def support_extracts(text: Column) -> Column:
    """array<struct<text, memory_type, confidence, importance, severity>>, one for each pattern found."""
    group = lambda p: F.regexp_extract(text, p, 1)
    kind = lambda m, c, i, s: dict(memory_type=F.lit(m), confidence=F.lit(c), importance=F.lit(i), severity=s)
    likes = [_found(text, p, F.concat(F.lit("Customer prefers: "), group(p)), **kind("preference", 0.8, 0.7, F.lit(None).cast("string"))) for p in SUPPORT_PREFERENCES]
    issues = [_found(text, p, F.concat(F.lit("Customer reported issue: "), group(p)), **kind("fact", 0.85, 0.9, severity(text))) for p in SUPPORT_ISSUES]
    return F.array_compact(F.array(*likes, *issues))


def personal_info(text: Column) -> Column:
    """array<struct<text, type>>."""
    return F.array_compact(F.array(*(_found(text, p, F.concat(F.lit(f"User's {kind}: "), F.regexp_extract(text, p, 1)), type=F.lit(kind)) for kind, p in PERSONAL_INFO.items())))


def assistant_preferences(text: Column) -> Column:
    """array<struct<text, sentiment>>."""
    kind, item = F.regexp_extract(text, FAVORITE, 1), F.regexp_extract(text, FAVORITE, 2)
    favorite = F.when((kind != "") & (item != ""), F.concat(F.lit("Favorite "), kind, F.lit(": "), item)).otherwise(F.concat(F.lit("Likes: "), kind))
    return F.array_compact(
        F.array(
            _found(text, LIKES, F.concat(F.lit("Likes: "), F.regexp_extract(text, LIKES, 1)), sentiment=F.lit("positive")),
            _found(text, DISLIKES, F.concat(F.lit("Dislikes: "), F.regexp_extract(text, DISLIKES, 1)), sentiment=F.lit("negative")),
            _found(text, FAVORITE, favorite, sentiment=F.lit("positive")),
        )
    )


def schedules(text: Column) -> Column:
    """array<struct<text, event, time>>."""

    def one(pattern: str, groups: int) -> Column:
        event = F.regexp_extract(text, pattern, 1)
        time = F.regexp_extract(text, pattern, 2) if groups > 1 else F.lit("")
        time = F.when(time == "", "unspecified time").otherwise(time)
        return _found(text, pattern, F.concat(F.lit("Scheduled: "), event, F.lit(" at "), time), event=event, time=time)

    return F.array_compact(F.array(*(one(p, n) for p, n in zip(SCHEDULES, (2, 2, 1), strict=True))))


def habits(text: Column) -> Column:
    """array<struct<text>>."""
    return F.array_compact(F.array(*(_found(text, p, F.concat(F.lit("Habit/Routine: "), F.regexp_extract(text, p, 1))) for p in HABITS)))


def topics_joined(found: Column) -> Column:
    return let(F.array_join(found, ", "), lambda x: F.when(x == "", NO_TOPIC).otherwise(x))
