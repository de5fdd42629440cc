"""Text, time and similarity functions. All are Column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the model defines it, and the stop words.
WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
STOPWORDS = "the a an and or to for of in on at with is are was were be been it this that as by from you your we our they their".split()

#: Seconds, milliseconds and microseconds of a day.
DAY_S, DAY_MS, DAY_US = 86_400, 86_400_000, 86_400_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_pattern(*alternatives: str, flags: str = "(?i)") -> str:
    """A pattern of whole words. The JVM's own word boundary knows letters beyond ASCII, which the model's does not."""
    return f"{flags}(?<![A-Za-z0-9_])(?:{'|'.join(alternatives)})(?![A-Za-z0-9_])"


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def normalize_key(text: Column) -> Column:
    return F.lower(normalize_text(text))


def tokenize(text: Column) -> Column:
    """Lower-case words of letters a-z and digits, longer than one, without stop words; repeats stay."""
    word = rf"(?<![a-z0-9])(?!(?:{'|'.join(STOPWORDS)})(?![a-z0-9]))[a-z0-9]{{2,}}+"
    return F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))


def summarize(text: Column) -> Column:
    return let(normalize_text(text), lambda t: F.when(F.length(t) <= 120, t).otherwise(F.concat(F.substring(t, 1, 117), F.lit("..."))))


def overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the larger number of them; 0 if either has none. Takes token arrays."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.when((F.size(x) > 0) & (F.size(y) > 0), F.greatest(F.size(x), F.size(y)))), F.lit(0.0)).cast("double")


def raw_words(text: Column) -> Column:
    """Lower-case words between white space; punctuation and empty ends stay."""
    return F.split(F.lower(text), f"{WS}+", -1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct words over all distinct words. Takes word arrays."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def token_hash(token: Column) -> Column:
    """The 31-polynomial of the characters, wrapped to 32 bits, absolute, as double."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c + 2147483648, F.lit(4294967296)) - 2147483648)
    return F.abs(wrapped).cast("double")


# Sums of cos^2, sin^2 and cos*sin over the 384 dimensions of the embedding.
GRAM_COS, GRAM_SIN, GRAM_MIXED = 192.3796001330224, 191.6203998669776, -0.10681836633343685


def embedding(tokens: Column) -> Column:
    """struct(a, b): the embedding in the plane that holds every one of them, up to its length.

    Dimension j sums sin(h + j) over the tokens' hashes, which is a*cos(j) + b*sin(j) with a the sum of sin(h) and b
    that of cos(h): two numbers instead of 384.
    """
    hashes = F.transform(tokens, token_hash)
    sum_of = lambda f: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + f(h))
    return F.struct(sum_of(F.sin).alias("a"), sum_of(F.cos).alias("b"))


def similarity(u: Column, v: Column) -> Column:
    """Cosine of two embeddings, at least 0; 0 if either has no tokens."""
    ip = lambda x, y: x["a"] * y["a"] * GRAM_COS + x["b"] * y["b"] * GRAM_SIN + (x["a"] * y["b"] + y["a"] * x["b"]) * GRAM_MIXED
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(ip(u, v), F.sqrt(ip(u, u) * ip(v, v))), F.lit(0.0)))


def vector_similarity(a: Column, b: Column) -> Column:
    """Inner product of two arrays, at least 0; 0 if their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(dot, F.lit(0.0))).otherwise(0.0)


def age_days(as_of: Column, ts: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / float(DAY_US)


def recency(as_of: Column, ts: Column, half_life_days: float = 30.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days(as_of, ts), F.lit(0.0)) / half_life_days)


def insight_decay(as_of: Column, ts: Column) -> Column:
    return 1 + 0.2 * F.exp(-age_days(as_of, ts) / 30)


def expired(as_of: Column, last_seen: Column, kind: Column, ttl_days: Column) -> Column:
    """Strictly older than the ttl; kind none and a ttl of 0 or less never; without a ttl, 180 days."""
    ttl = F.coalesce(ttl_days, F.lit(180)).cast("long")
    old = F.unix_millis(as_of) - F.unix_millis(last_seen) > ttl * DAY_MS
    return F.coalesce((kind != "none") & (ttl > 0) & old, F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def feedback_boost(positive: Column, negative: Column) -> Column:
    return clamp((positive - negative) * 0.02, -0.12, 0.12)


def contains_any(text: Column, *parts: str) -> Column:
    """Whether lower-case `text` holds any of the parts, inside words too."""
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def merge_maps(old: Column, new: Column) -> Column:
    """The new map's values win."""
    return F.map_zip_with(old, new, lambda k, x, y: F.coalesce(y, x))


def first_sentence(text: Column) -> Column:
    return F.concat(F.substring_index(text, ".", 1), F.lit("."))


def greeting(hour: Column) -> Column:
    return F.when(hour < 12, "Good morning").when(hour < 18, "Good afternoon").otherwise("Good evening")
