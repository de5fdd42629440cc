"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Source s demands words at the rate T_s * w_s(t), where w_s is a linear schedule with
integral 1 and slope a_s in [-2, 2]; the cumulative demand up to t is T_s * D_s(t), D_s(t) = t + a_s/2 * (t^2 - t).
A source's documents are lined up by a seeded hash, epoch after epoch, and a copy whose middle stands at word c of that
line trains at t = D_s^-1(c / T_s). Copies whose middle is beyond T_s aren't taken, so that the taken words differ from
T_s by half a document at most. Documents are then sorted by t over ranges.

The line is a running sum over each source, and one source may hold a third of all rows. It is summed in two steps:
sources are cut by the hash into pieces of a few thousand rows, the pieces' sums are run up, and each piece runs up
its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkrecall.llm.common import WORD, documents, materialize

#: Target weights, dealt to the sources in order again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: Slopes of the schedules, dealt likewise: the heaviest sources early, the lightest late.
SLOPES = (-0.8, 0.0, 0.8)


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, slope, target) of (source, source_size).

    Sources in the order of their code points, null last, get WEIGHTS in turn. The words to share out are `share` times
    all; what a source would get beyond `most` times its size goes to the others by weight, until none is above. That
    ends at min(most * size, level * weight), and level is found from running sums over the sources by most * size /
    weight. One row for each source, so one window over all is small.
    """
    # binary strings compare by bytes, which is the order of code points
    n = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    known = sizes.select("source", "source_size", of(WEIGHTS).alias("weight"), of(SLOPES).alias("slope"))
    up = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most  # what the sources before this take if all are at their limit
    total = F.sum("source_size").over(W.partitionBy()) * share
    level = (total - full) / F.sum("weight").over(after)  # if this and all later sources are below their limit
    marked = known.withColumn("level", level).withColumn("place", F.row_number().over(up)).withColumn("below", F.col("level") <= F.col("source_size") * most / F.col("weight"))
    held = marked.withColumn("level", F.min(F.when(F.col("below"), F.struct("place", "level"))).over(W.partitionBy())["level"])
    target = F.least(F.col("source_size") * F.lit(most), F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(most)))
    return held.select("source", "source_size", "weight", "slope", target.cast("double").alias("target"))


def when_demanded(part: Column, slope: Column) -> Column:
    """The time at which `part` of a source's target has been demanded: the inverse of t + slope/2 * (t^2 - t)."""
    half = slope / 2
    root = F.sqrt(F.greatest((1 - half) * (1 - half) + 4 * half * part, F.lit(0.0)))
    return F.least(F.greatest(2 * part / (1 - half + root), F.lit(0.0)), F.lit(1.0))


def curriculum(rows: DataFrame, seed: int = 0, piece_rows: int = 2_000, share: float = 1.5, most: int = 2) -> DataFrame:
    """`rows` (with columns source, size) with bigint source_size, double target, int copies, bigint taken and
    array<double> positions: the training times of the copies taken, one for each.

    Sources may be null (one source of its own). Null sizes are 0. Documents of size 0 are taken never. Rows that are
    equal in every column are interchangeable, so reruns agree. Empty table: no rows. Columns of `rows` named like the
    results are replaced, all others stay, whatever their names.
    """
    rows = rows.drop("source_size", "target", "copies", "taken", "positions")
    words = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    # what the caller has goes along whole, so that no name of it meets one of these tables'
    held = materialize(rows.withColumn("size", words).select(F.struct(*rows.columns).alias("row"), F.xxhash64(F.lit(seed), *rows.columns).alias("h")), "sized")
    own, size = F.col("row.source"), F.col("row.size")
    many = held.groupBy(own.alias("source")).agg(F.sum(size).alias("source_size"), F.count("*").alias("n"))
    plan = targets(many.select("source", "source_size"), share, most).withColumnRenamed("source", "s")
    pieces = F.greatest(F.ceil(F.col("n") / piece_rows), F.lit(1))
    plan = materialize(plan.join(many.select("source", pieces.alias("pieces")), F.col("source").eqNullSafe(F.col("s"))).drop("source"), "targets")
    # one row for each source: a broadcast only if Spark finds it small, else a join whose large partitions are split
    joined = held.join(plan, own.eqNullSafe(F.col("s")), "left")
    piece = F.floor((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) * F.col("pieces")).cast("long")
    cut = materialize(joined.withColumn("piece", piece), "pieces")
    sums = cut.groupBy("s", "piece").agg(F.sum(size).alias("w"))
    run = F.sum("w").over(W.partitionBy("s").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    starts = sums.select(F.col("s").alias("of"), F.col("piece").alias("p"), F.coalesce(run, F.lit(0)).alias("start"))
    ahead = F.sum(size).over(W.partitionBy("s", "piece").orderBy("h", "row").rowsBetween(W.unboundedPreceding, -1))
    lined = cut.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    placed = lined.join(starts, F.col("s").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("p")))
    middle = F.col("start") + F.col("ahead") + size / 2
    at = [middle + epoch * F.col("source_size") for epoch in range(most)]
    positions = F.filter(F.array(*(F.when((x <= F.col("target")) & (size > 0), when_demanded(F.try_divide(x, F.col("target")), F.col("slope"))) for x in at)), lambda t: t.isNotNull())
    out = placed.withColumn("positions", positions).withColumn("copies", F.size("positions")).withColumn("taken", F.col("copies") * size)
    return out.select("row.*", "source_size", "target", "copies", "taken", "positions")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_position(mixed: DataFrame) -> DataFrame:
    """Every copy taken, sorted by its training time over ranges; column position."""
    copies = mixed.withColumn("position", F.explode("positions"))
    tie = [c for c, kind in copies.dtypes if c in ("doc_id",)]
    return copies.repartitionByRange("position", *tie).sortWithinPartitions("position", *tie)


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts: size 0. first_position and last_position: training times of the copies taken, else null."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = curriculum(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min("positions").alias("first_position"), F.array_max("positions").alias("last_position")).repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
