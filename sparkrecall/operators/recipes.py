"""Two example assistants as recipes: messages to observations, reports over memories, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.functions import patterns as P
from sparkrecall.functions import text as X

SUPPORT = {"tenant_id": "customer-support", "app_id": "support-bot"}
ASSISTANT = {"tenant_id": "personal-assistant", "app_id": "assistant"}
#: (max_items, max_chars) of the context each reads before it answers.
SUPPORT_BUDGET, ASSISTANT_BUDGET = (10, 2000), (15, 3000)


def _extracted(messages: DataFrame, found: Column, kind: Column | None, confidence: float, importance: float, category: str) -> DataFrame:
    rows = messages.select("seq", "actor_id", "thread_id", F.posexplode(found).alias("pos", "x"))
    return rows.select("seq", "actor_id", "thread_id", (kind if kind is not None else F.lit("fact")).alias("memory_type"), F.col("x.text").alias("text"), F.lit(confidence).alias("confidence"), F.lit(importance).alias("importance"), F.lit(category).alias("category"), "pos")


def support_observations(messages: DataFrame) -> DataFrame:
    """One row for each message (seq, actor_id, thread_id, role, text) and one for each pattern found in it."""
    base = messages.select("seq", "actor_id", "thread_id", F.lit("fact").alias("memory_type"), "text", F.lit(0.9).alias("confidence"), P.support_importance(F.col("text"), F.col("role")).alias("importance"), F.lit("chat").alias("category"), F.lit(-1).alias("pos"))
    rows = messages.select("seq", "actor_id", "thread_id", F.posexplode(P.support_extracts(F.col("text"))).alias("pos", "x"))
    more = rows.select("seq", "actor_id", "thread_id", "x.memory_type", "x.text", "x.confidence", "x.importance", F.coalesce("x.severity", F.lit("preference")).alias("category"), "pos")
    return base.unionByName(more).select(*(F.lit(v).alias(k) for k, v in SUPPORT.items()), "*")


def assistant_observations(messages: DataFrame) -> DataFrame:
    """One row for each message and one for each piece of personal information, preference, appointment and habit."""
    text = F.col("text")
    out = messages.select("seq", "actor_id", "thread_id", F.lit("fact").alias("memory_type"), "text", F.lit(0.9).alias("confidence"), P.assistant_importance(text).alias("importance"), F.lit("message").alias("category"), F.lit(-1).alias("pos"))
    out = out.unionByName(_extracted(messages, P.personal_info(text), None, 0.9, 0.9, "personal_info"))
    out = out.unionByName(_extracted(messages, P.assistant_preferences(text), F.lit("preference"), 0.85, 0.7, "preference"))
    out = out.unionByName(_extracted(messages, P.schedules(text), None, 0.8, 0.9, "schedule"))
    out = out.unionByName(_extracted(messages, P.habits(text), F.lit("preference"), 0.75, 0.6, "habit"))
    return out.select(*(F.lit(v).alias(k) for k, v in ASSISTANT.items()), "*")


def assistant_replies(replies: DataFrame) -> DataFrame:
    """Replies (seq, actor_id, thread_id, text) as rows of type system, which ingest validation turns away."""
    return replies.select(*(F.lit(v).alias(k) for k, v in ASSISTANT.items()), "seq", "actor_id", "thread_id", F.lit("system").alias("memory_type"), F.concat(F.lit("Assistant response: "), "text").alias("text"), F.lit(0.9).alias("confidence"), F.lit(0.4).alias("importance"))


def schedule_item(items: DataFrame) -> DataFrame:
    """Appointments entered by hand (actor_id, event, at, description)."""
    text = F.concat(F.lit("Scheduled: "), "event", F.lit(" on "), "at", F.lit(". "), F.coalesce("description", F.lit("")))
    return items.select(*(F.lit(v).alias(k) for k, v in ASSISTANT.items()), "actor_id", F.lit("schedule").alias("thread_id"), F.lit("fact").alias("memory_type"), text.alias("text"), F.lit(1.0).alias("confidence"), F.lit(0.9).alias("importance"), F.lit("schedule").alias("category"))


def support_history(memories: DataFrame) -> DataFrame:
    """Of each actor: memories in all, issues (issue or problem), how many say issue, preferences, chat messages."""
    low = F.lower("text")
    chat = F.col("category") == "chat" if "category" in memories.columns else F.lit(False)
    return memories.groupBy("actor_id").agg(F.count("*").alias("total"), F.count_if(X.contains_any(low, "issue", "problem")).alias("issues"), F.count_if(X.contains_any(low, "issue")).alias("issue_count"), F.count_if(F.col("memory_type") == "preference").alias("preferences"), F.count_if(chat).alias("conversations"))


def personality(memories: DataFrame) -> DataFrame:
    """Of each actor: counts by category, and the score min(100, 5 preferences + 10 personal + 3 habits)."""
    n = lambda c: F.count_if(F.col("category") == c)
    out = memories.groupBy("actor_id").agg(F.count_if(F.col("memory_type") == "preference").alias("preferences"), n("habit").alias("habits"), n("schedule").alias("schedule"), n("personal_info").alias("personal_info"))
    return out.withColumn("score", F.least(F.lit(100), F.col("preferences") * 5 + F.col("personal_info") * 10 + F.col("habits") * 3))


# What is suggested, and the kind of memory that each needs.
SUGGESTIONS = [
    ("p", "Tell me more about your preferences"),
    ("p", "Get personalized recommendations"),
    ("s", "Review your schedule"),
    ("s", "Add a new appointment"),
    ("h", "Check on your routines"),
    ("h", "Set a new habit reminder"),
    (None, "Share personal information"),
    (None, "Set a goal"),
]


def suggestions(memories: DataFrame) -> DataFrame:
    """(actor_id, suggestions): the first four that apply."""
    p = memories.groupBy("actor_id").agg(F.max(F.col("memory_type") == "preference").alias("p"), F.max(F.col("category") == "schedule").alias("s"), F.max(F.col("category") == "habit").alias("h"))
    all_ = [F.when(F.col(needs), F.lit(t)) if needs else F.lit(t) for needs, t in SUGGESTIONS]
    return p.select("actor_id", F.slice(F.array_compact(F.array(*all_)), 1, 4).alias("suggestions"))


def _first(memories: Column, test) -> Column:
    return F.get(F.filter(memories, test), F.lit(0))


# The replies of both assistants. {} stands for what a memory says.
SUPPORT_REPLIES = {
    "greet_known": "Hello! I see you've contacted us before about some issues. How can I help you today? Is this related to your previous {}?",
    "greet": "Hello! Welcome to customer support. How can I assist you today?",
    "issue_known": 'I understand you\'re experiencing an issue. I can see this might be related to a previous problem you had: "{}". Let me help you troubleshoot this. Can you provide more details about what\'s happening?',
    "issue": "I'm sorry to hear you're experiencing an issue. Can you please describe what's happening in detail so I can assist you better?",
    "status_known": 'Let me check the status of your recent issue: "{}". I\'ll look into this and provide you with an update shortly.',
    "status": "I'd be happy to check the status for you. Can you please specify which issue or request you'd like an update on?",
    "thanks": "You're welcome! Is there anything else I can help you with today?",
    "preference": "Based on your preferences ({}), I'd recommend... How does that sound?",
    "any": "I understand your concern. Based on our previous conversations, I can see that we've discussed {}. Let me help you with your current question.",
    "none": "I'd be happy to help you with that. Can you provide more details so I can assist you better?",
}
ASSISTANT_REPLIES = {
    "personal_known": "Based on what you've told me: {}",
    "personal": "I don't have that information yet. Could you share it with me?",
    "schedule_known": "Here's what I found in your schedule: {}",
    "schedule": "I don't see any scheduled items. Would you like to add something?",
    "recommend_known": "Based on your preferences ({}), I'd suggest looking for something similar. What specific area would you like recommendations for?",
    "recommend": "I'd be happy to make recommendations. Can you tell me more about what you're looking for?",
    "habit_known": "I remember your routine includes: {}. I'll help you stay on track!",
    "habit": "I'll help you build and maintain good routines. What would you like to be reminded about?",
    "goal_known": "I see you're working on: {}. How can I help you make progress?",
    "goal": "I'd love to help you set and achieve your goals. What would you like to work on?",
    "greet_known": "{}! How can I assist you today?",
    "greet": "{}! How can I help you today?",
    "any": "I understand. Based on our previous conversations about {}, how can I help you today?",
    "none": "I'm here to help! The more you tell me about yourself, the better I can assist you with personalized recommendations and reminders.",
}


def _saying(replies: dict[str, str], name: str, x: Column) -> Column:
    before, _, after = replies[name].partition("{}")
    return F.concat(F.lit(before), x, F.lit(after))


def _either(replies: dict[str, str], name: str, known: Column, x: Column) -> Column:
    """The reply that names x, if it is known, else the plain one."""
    return F.when(known, _saying(replies, f"{name}_known", x)).otherwise(F.lit(replies[name]))


def support_reply(message: Column, memories: Column) -> Column:
    """The support desk's reply to a message, given the selected memories (array of structs with memory_type and text)."""
    low, R = F.lower(message), SUPPORT_REPLIES
    says = lambda *p: X.contains_any(low, *p)
    issue = _first(memories, lambda m: X.contains_any(F.lower(m["text"]), "issue", "problem"))
    named = _first(memories, lambda m: X.contains_any(F.lower(m["text"]), "issue"))
    liked = _first(memories, lambda m: m["memory_type"] == "preference")
    rules = [
        (says("hello", "hi"), _either(R, "greet", issue.isNotNull(), F.lower(issue["text"]))),
        (says("issue", "problem"), _either(R, "issue", issue.isNotNull(), issue["text"])),
        (says("status", "update"), _either(R, "status", named.isNotNull(), named["text"])),
        (says("thank"), F.lit(R["thanks"])),
        (liked.isNotNull(), _saying(R, "preference", liked["text"])),
        (F.size(memories) > 0, _saying(R, "any", F.get(memories, F.lit(0))["text"])),
    ]
    return F.coalesce(*(F.when(test, reply) for test, reply in rules), F.lit(R["none"]))


def assistant_reply(message: Column, memories: Column, hour: Column) -> Column:
    """The personal assistant's reply, given the selected memories (structs with memory_type, text, category)."""
    low, R = F.lower(message), ASSISTANT_REPLIES
    says = lambda *p: X.contains_any(low, *p)
    about = lambda category, *p: _first(memories, lambda m: (m["category"] == category) | X.contains_any(F.lower(m["text"]), *p))
    personal, habit = about("personal_info", "birthday", "name"), about("habit", "routine")
    planned = F.filter(memories, lambda m: (m["category"] == "schedule") | X.contains_any(F.lower(m["text"]), "scheduled"))
    likes = _first(memories, lambda m: (m["memory_type"] == "preference") & ~F.contains(F.lower(m["text"]), F.lit("dislikes")))
    goal = _first(memories, lambda m: F.contains(F.lower(m["text"]), F.lit("goal")))
    named = _first(memories, lambda m: F.contains(F.lower(m["text"]), F.lit("name")))
    name = F.coalesce(F.trim(F.try_element_at(F.split(named["text"], ":"), F.lit(2))), F.lit("undefined"))
    hello = X.greeting(hour)
    rules = [
        (says("what is my", "when is my"), _either(R, "personal", personal.isNotNull(), personal["text"])),
        (says("what do i have", "schedule", "appointment"), _either(R, "schedule", F.size(planned) > 0, F.array_join(F.transform(planned, lambda m: m["text"]), ", "))),
        (says("recommend", "suggest", "what should i"), _either(R, "recommend", likes.isNotNull(), likes["text"])),
        (says("remind me", "routine"), _either(R, "habit", habit.isNotNull(), habit["text"])),
        (says("goal", "achieve"), _either(R, "goal", goal.isNotNull(), goal["text"])),
        (says("hello", "hi", "good"), F.when(named.isNotNull(), _saying(R, "greet_known", F.concat(hello, F.lit(", "), name))).otherwise(_saying(R, "greet", hello))),
        (F.size(memories) > 0, _saying(R, "any", F.lower(F.get(memories, F.lit(0))["text"]))),
    ]
    return F.coalesce(*(F.when(test, reply) for test, reply in rules), F.lit(R["none"]))
