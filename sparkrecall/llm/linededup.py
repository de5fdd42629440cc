"""Line dedup: maximal runs of lines that repeat, from a suffix array over line ids; later copies are deleted.

Texts are sequences of line ids. Lines that stand only once in the corpus end every repeated run, so the suffixes that
matter begin in segments, stretches of consecutive lines of which each stands twice or more, and segments of fewer than
`min_words` words hold nothing to delete. Over these the suffix array is built by prefix doubling, two doublings at once:
suffixes are ranked by their first line, then, in each round, by the ranks of their first 4^k lines and of the three times 4^k
after those. A rank is a place in a sort over ranges, so the ranks are in suffix order and no partition holds all of them.
The driver plans a query for each round and two joins for each power, so the fewer they are, the less memory it takes.

Neighbours in the array are compared: the length of their longest common prefix is found by descent, from the largest power of
four down, each step by the ranks behind what is common so far. The suffixes that share their first m lines are an interval of
the array, within which no neighbours have less than m lines in common. So, of the suffixes that begin with a window of m
lines, a new interval begins wherever the common prefix with the suffix before is shorter than m: what shares the window has
the same window, so no other suffix can stand between.

A repeated run of at least min_words words is the union of the smallest windows of min_words words in it, from each first
line onward and from each last line backward. So a line is in such a run that stands earlier too exactly if one of these
windows covers it and isn't the first in its interval; doubling ends at the depth that the longest window needs. Overlapping
windows join to maximal runs.

No step holds all rows of one line, run or text in a task: keys with more than a thousandth of the rows, of which there
are fewer than a thousand, are joined by broadcast.

Equal texts are one sequence; that of the least key is kept, and the others are later copies as a whole if they have
min_words words. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.llm.common import WORD, documents, join_once, materialize

#: A shorter run is no passage: headers and licence lines stay.
MIN_WORDS = 50
#: A round ranks suffixes by so many times the lines of the round before; the last one perhaps by twice as many.
STEP = 4


def _ranked(keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct `keys` with a bigint rank in the order of `columns`, and n, their rows. Written at once, since the ranks'
    values follow the ranges that Spark happens to cut."""
    ordered = keys.groupBy(*columns).agg(F.count("*").alias("n")).repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` with int part, so that parts, and rows in a part by `columns`, are in order; these columns tell rows apart."""
    ordered = rows.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return materialize(ordered.withColumn("part", F.spark_partition_id()), "ordered")


def _from_before(rows: DataFrame, *columns: str, value: Column) -> DataFrame:
    """`rows` of _in_order() with `before`: `value` of the last row before that has one."""
    here = W.partitionBy("part").orderBy(*columns)
    inside = rows.withColumn("before", F.last(value, ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, -1)))
    # one row for each part: the last value in it, and that of the parts before
    ends = rows.withColumn("__v", value).where("__v is not null").groupBy("part").agg(F.max_by("__v", F.struct(*columns)).alias("__v"))
    parts = rows.select("part").distinct().join(F.broadcast(ends), "part", "left")
    carried = parts.select("part", F.last("__v", ignorenulls=True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("__carried"))
    return inside.join(F.broadcast(carried), "part").withColumn("before", F.coalesce("before", "__carried")).drop("__carried")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t1, t2, pos, h1, h2, words): hashes of 128 bits stand for texts and lines."""
    hashed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    cut = hashed.select("key", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return materialize(cut.select("key", "t1", "t2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).alias("words")), "lines")


def segments(lines: DataFrame, min_words: int) -> DataFrame:
    """(t1, t2, seg, pos, h1, h2, words, upto): lines of texts, each text once, in segments of min_words words or more.

    upto: the segment's words up to and with this line.
    """
    at = F.xxhash64("t1", "t2", "pos")  # copies of one text don't repeat its lines
    own = ["h1", "h2"]
    twice = lines.groupBy(*own).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("n")).where("a != b").select(*own, "n", F.lit(True).alias("twice"))
    mine = join_once(lines, materialize(twice, "twice"), own, lines.count()).select("t1", "t2", "pos", "h1", "h2", "words").distinct()
    text = W.partitionBy("t1", "t2").orderBy("pos")  # the lines of one document
    marked = mine.withColumn("seg", F.col("pos") - F.row_number().over(text))
    seg = W.partitionBy("t1", "t2", "seg")
    summed = marked.withColumn("all", F.sum("words").over(seg)).where(F.col("all") >= min_words)
    return summed.withColumn("upto", F.sum("words").over(seg.orderBy("pos"))).drop("all")


def suffix_ranks(segs: DataFrame, depth: int) -> DataFrame:
    """`segs` with array<bigint> ranks: element k + 1 ranks the suffix by its first STEP^k lines, the last one by the first
    power of two that is depth or more; and array<array<bigint>> behind: element k + 1 has those of the next stretches of
    STEP^k lines, which the next round looks at, but for the last.

    A suffix that ends at its segment's end within those lines sorts before all that go on; behind the end ranks are -1.
    """
    total = segs.count()
    first = _ranked(segs, "h1", "h2")
    now = join_once(segs, first, ["h1", "h2"], total).drop("h1", "h2")
    now = now.withColumn("ranks", F.array("rank")).withColumn("behind", F.array().cast("array<array<bigint>>"))
    step = 1
    while step < depth:
        times = STEP if 2 * step < depth else 2
        seg = W.partitionBy("t1", "t2", "seg").orderBy("pos")
        then = {f"then{i}": F.coalesce(F.lead("rank", i * step).over(seg), F.lit(-1)) for i in range(1, times)}
        keys = ["own", *then]
        stretches = materialize(now.withColumns(then).withColumnRenamed("rank", "own"), "suffixes")
        longer = _ranked(stretches, *keys)
        behind = F.array(*keys[1:-1]).cast("array<bigint>")
        now = join_once(stretches, longer, keys, total).withColumn("behind", F.concat("behind", F.array(behind))).withColumn("ranks", F.concat("ranks", F.array("rank"))).drop(*keys)
        step *= times
    return materialize(now.drop("rank"), "suffixes")


def common_prefixes(ranks: DataFrame) -> DataFrame:
    """(rank, lcp) of each different last rank of suffix_ranks(): how many lines the suffixes of that rank and of the one
    before have in common. Of two that end alike, where their segments end, a greater number may be given."""
    last = ranks.select("t1", "t2", "pos", F.element_at("ranks", -1).alias("rank"))
    one = last.groupBy("rank").agg(F.min(F.struct("t1", "t2", "pos")).alias("at"))
    pairs = _from_before(_in_order(one, "rank"), "rank", value=F.col("at")).drop("part").withColumn("lcp", F.lit(0))
    levels = ranks.select(F.size("ranks").alias("k")).first()
    # neighbours have different last ranks
    for k in reversed(range(levels.k - 1 if levels else 0)):
        of = ranks.select("t1", "t2", "pos", F.concat(F.array(F.element_at("ranks", k + 1)), F.element_at("behind", k + 1)).alias("r"))
        for side in ("at", "before"):
            place = of.select(F.col("t1").alias("__1"), F.col("t2").alias("__2"), F.col("pos").alias("__3"), F.col("r").alias(f"__{side}"))
            # behind the end of its segment a suffix has no rank
            pairs = pairs.join(place, (F.col(f"{side}.t1") == F.col("__1")) & (F.col(f"{side}.t2") == F.col("__2")) & (F.col(f"{side}.pos") + F.col("lcp") == F.col("__3")), "left").drop("__1", "__2", "__3")
        # two suffixes are equally ranked at a depth only if both go on that far, or end alike
        more = F.lit(0)
        for i in reversed(range(STEP - 1)):
            more = F.when((F.get("__at", i) == F.get("__before", i)) & (F.get("__at", i) >= 0), more + STEP**k).otherwise(0)
        pairs = pairs.withColumn("lcp", F.col("lcp") + more).drop("__at", "__before")
    return materialize(pairs.select("rank", "lcp"), "lcp")


def windows(segs: DataFrame, min_words: int) -> DataFrame:
    """(t1, t2, a, b): from each first line the least last line, and to each last line the greatest first line, with
    min_words words between."""
    own = [F.struct(x.cast("long").alias("x"), F.lit(kind).alias("kind")) for x, kind in ((F.col("upto"), 0), (F.col("upto") - F.col("words") + min_words, 1))]
    rows = segs.select("t1", "t2", "seg", "pos", F.explode(F.array(*own)).alias("e")).select("t1", "t2", "seg", "pos", "e.x", "e.kind")
    place = W.partitionBy("t1", "t2", "seg").orderBy("x")
    # the line behind kind 0 has words up to x; kind 1 is a first line that asks for the least of those at x or more
    least = F.min(F.when(F.col("kind") == 0, F.col("pos"))).over(place.rangeBetween(0, W.unboundedFollowing))
    # as a last line, kind 0 asks for the greatest first line whose window of min_words ends at x or before
    most = F.max(F.when(F.col("kind") == 1, F.col("pos"))).over(place.rangeBetween(W.unboundedPreceding, 0))
    asked = rows.withColumn("a", F.when(F.col("kind") == 1, F.col("pos")).otherwise(most)).withColumn("b", F.when(F.col("kind") == 0, F.col("pos")).otherwise(least))
    return asked.where("a is not null and b is not null").select("t1", "t2", "a", "b").distinct()


def _later(found: DataFrame, ranks: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those windows that aren't the first in their interval."""
    own = ranks.select("t1", "t2", F.col("pos").alias("a"), F.element_at("ranks", -1).alias("rank"))
    m = (F.col("b") - F.col("a") + 1).alias("m")
    placed = found.join(own, ["t1", "t2", "a"]).join(firsts, ["t1", "t2"]).select("t1", "t2", "a", "b", m, "rank", F.struct("first", "t1", "t2", "a").alias("place"))
    placed = materialize(placed, "windows")
    # suffixes of one rank have the same windows
    heads = _in_order(placed.groupBy("m", "rank").agg(F.min("place").alias("least"), F.count("*").alias("n")).join(common_prefixes(ranks), "rank"), "m", "rank")
    new = F.col("lcp") < F.col("m")
    inside = _from_before(heads, "m", "rank", value=F.when(new, F.col("rank"))).withColumn("head", F.when(new, F.col("rank")).otherwise(F.col("before")))
    inside = materialize(inside.select("m", "rank", "least", F.col("n").alias("k"), "head"), "intervals")
    intervals = inside.groupBy("m", "head").agg(F.min("least").alias("kept"), F.sum("k").alias("all"), F.count("*").alias("n")).where("all > 1").drop("all")
    repeated = join_once(inside, materialize(intervals, "repeated"), ["m", "head"], inside.count()).select("m", "rank", F.col("k").alias("n"), "kept")
    return join_once(placed, materialize(repeated, "repeated"), ["m", "rank"], placed.count()).where("place != kept").select("t1", "t2", "a", "b")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(t1, t2, runs array<struct<a, b>>): the maximal runs of lines a to b that stand earlier in the corpus too."""
    segs = materialize(segments(lines, min_words), "segments")
    found = materialize(windows(segs, min_words), "windows")
    depth = found.agg(F.max(F.col("b") - F.col("a") + 1)).first()[0] or 1
    firsts = lines.where("pos = 0").groupBy("t1", "t2").agg(F.min("key").alias("first"))
    later = _later(found, suffix_ranks(segs, depth), firsts)
    text = W.partitionBy("t1", "t2").orderBy("a", "b")
    reach = F.max("b").over(text.rowsBetween(W.unboundedPreceding, -1))
    marked = later.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(text.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy("t1", "t2", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    return F.filter(lines, lambda line, i: ~F.exists(runs, lambda r: (i >= r["a"]) & (i <= r["b"])))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with its text changed, and bigint n_lines, removed_lines, array<struct<a, b>> removed_runs (0-based).

    Of equal texts that with the least key stays, and of equal runs that of the text with the least key, the lesser
    line in one text. Rows equal in key and text are one document: they stay or go alike. Null texts have no lines and
    stay null; a text all of whose lines go becomes null too. Empty lines count as lines of no words. An empty table
    gives no rows. Columns named like those added are replaced.
    """
    lines = lines_of(docs, key, text)
    texts = lines.groupBy("t1", "t2", "key").agg(F.max("pos").alias("last"), F.sum("words").alias("sum"), F.count_if(F.col("pos") == 0).alias("rows"))
    # equal rows of one text sum up alike
    whole = texts.groupBy("t1", "t2").agg(F.min("key").alias("first"), F.count("*").alias("keys"), F.max("last").alias("last"), F.max(F.col("sum") / F.col("rows")).alias("words"))
    copies = whole.where((F.col("keys") > 1) & (F.col("words") >= min_words)).select("t1", "t2", "first", "last")
    decided = copies.join(repeated_runs(lines, min_words), ["t1", "t2"], "full_outer")
    decided = materialize(decided.withColumnRenamed("t1", "__t1").withColumnRenamed("t2", "__t2").withColumnRenamed("first", "__first").withColumnRenamed("last", "__last").withColumnRenamed("runs", "__runs"), "decided")
    clean = docs.drop("n_lines", "removed_lines", "removed_runs")
    joined = clean.join(decided.hint("merge"), (F.xxhash64(clean[text]) == F.col("__t1")) & (F.xxhash64(F.lit(1), clean[text]) == F.col("__t2")) & clean[text].isNotNull(), "left")
    none = F.array().cast("array<struct<a:int,b:int>>")
    gone = F.when(F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col(key)), F.array(F.struct(F.lit(0).alias("a"), F.col("__last").alias("b")))).otherwise(F.coalesce("__runs", none))
    out = joined.withColumn("removed_runs", gone).withColumn("__lines", F.split(text, "\n", -1))
    out = out.withColumn("n_lines", F.coalesce(F.size("__lines"), F.lit(0)).cast("long"))
    removed = F.aggregate("removed_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1)
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines"))).withColumn("removed_lines", removed)
    less = F.when(F.col("removed_lines") == 0, F.col(text)).when(F.col("removed_lines") < F.col("n_lines"), F.array_join(_kept(F.col("__lines"), F.col("removed_runs")), "\n"))
    return out.withColumn(text, less).select(*clean.columns, "n_lines", "removed_lines", "removed_runs")


def op5_suffix_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs: first and last line of each run deleted, as 3-5,9-9."""
    runs = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["a"].cast("string"), r["b"].cast("string"))), ",")
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "removed_lines", runs.alias("runs"), "text")
