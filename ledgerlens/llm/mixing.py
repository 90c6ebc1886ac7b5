"""Mixing sources to target weights along a time-varying curriculum (native).

Each source has a piecewise-linear weight schedule over training time 0..1. Its
integral is the source's weight in the mix; a source whose share would exceed
``max_repeats`` times its own size is held there and the excess goes to the
others by weight (water filling). The normalised running integral is the
source's cumulative token demand: a document that covers the words ``lo..hi`` of
its source's target is due at the time when the demand reaches the middle of
that span, so inverting the running integral gives its training position.
Range-sorting the occurrences by position gives the training order.

Everything is DataFrame expressions. Two aggregates and one window: the window
runs inside (source, bucket), buckets being leading digits of a hash of the
document id whose number follows the row count, so a source that holds a third
of all rows is spread over many tasks; bucket totals carry the prefix sums
across buckets. Only a narrow table (id, source, size, key) is shuffled.

Defined results: null text has size 0; null source is a source of its own, after
all others; size 0 documents and sources are never taken; rows with equal keys
(repeated rows) are interchangeable; an empty table gives an empty result;
columns of ``docs`` other than the three named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD_WITH_LEAD, word_count
from ledgerlens.session import write_shared

#: Rows that one (source, bucket) group should hold about, at most.
BUCKET_ROWS = 50_000
#: Times of the default curriculum's knots, and what they multiply a source's
#: weight by; each has the integral 1, so the weights stay the totals.
CURRICULUM_TIMES = (0.0, 0.5, 1.0)
CURRICULUM_SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def source_key(source: Column) -> Column:
    """Text that sorts by code point with null after everything."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def document_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Narrow table of the mix: doc_id, src (key), size, order_key."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source_key(F.col(source_col)).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident)).alias("order_key"),
    )


def cyclic_schedules(sources: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Schedules for ``sources`` (src): weights in turn by code point, shapes in turn too."""
    rank = F.row_number().over(Window.orderBy("src")) - 1
    turn = lambda n: (F.col("rank") % n + 1).cast("int")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn(len(weights)))
    shape = F.element_at(F.array(*[F.array(*[F.lit(x) for x in s]) for s in CURRICULUM_SHAPES]), turn(len(CURRICULUM_SHAPES)))
    return sources.withColumn("rank", rank).select(
        *sources.columns,
        F.array(*[F.lit(t) for t in CURRICULUM_TIMES]).alias("times"),
        F.transform(shape, lambda x: x * pick).alias("rates"),
    )


def integrate_schedules(schedules: DataFrame) -> DataFrame:
    """Adds weight (whole integral) and cum (running integral at every knot)."""
    area = lambda k: (F.get("rates", k) + F.get("rates", k - 1)) * 0.5 * (F.get("times", k) - F.get("times", k - 1))
    upto = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda acc, j: acc + F.when(k > 0, area(j)).otherwise(0.0))
    cum = F.transform(F.sequence(F.lit(0), F.size("times") - 1), lambda k: F.when(k == 0, F.lit(0.0)).otherwise(upto(F.greatest(k, F.lit(1)))))
    return schedules.withColumn("cum", cum).withColumn("weight", F.element_at("cum", -1))


def source_targets(sized: DataFrame, schedule_of, max_repeats: int) -> DataFrame:
    """One row per source: size, schedule, target (double), quota (whole words).

    ``schedule_of(sources)`` adds times and rates arrays. The rows are sources,
    not documents: the unpartitioned window over them is as small as the
    curriculum that names them.
    """
    sources = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    s = integrate_schedules(schedule_of(sources)).withColumn("cap", F.col("source_size") * max_repeats)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = F.try_divide(F.col("cap").cast("double"), F.col("weight")).asc_nulls_last()
    before = Window.orderBy(reach, "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(every),
        "total_weight": F.sum("weight").over(every),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "turn": F.row_number().over(Window.orderBy(reach, "src")),
    })
    # Words per unit of weight if exactly the sources before this one are full;
    # the first source that then fits under its cap settles the level.
    level = F.try_divide((F.col("total") - F.col("full")).cast("double"), F.col("total_weight") - F.col("full_weight"))
    s = s.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("settled", F.min(F.when(fits, F.struct("turn", "level"))).over(every)["level"])
    target = F.when(F.col("weight") > 0, F.least(F.col("cap").cast("double"), F.col("settled") * F.col("weight"))).otherwise(0.0)
    target = F.coalesce(target, F.col("cap").cast("double"))
    return s.withColumn("target", target).select("src", "source_size", "times", "rates", "cum", "weight", "target", F.round("target").cast("long").alias("quota"))


def position_at(share: Column) -> Column:
    """Training time at which the running integral reaches ``share`` (0..1) of its whole.

    Within a knot interval the rate is linear, so the area is a quadratic in
    time; its root is taken in the form that stays stable for a constant rate.
    """
    goal = share * F.col("weight")
    k = F.least(F.size(F.filter("cum", lambda c: c <= goal)), F.size("cum") - 1) - 1
    rest = goal - F.get("cum", k)
    w0, dt = F.get("rates", k), F.get("times", k + 1) - F.get("times", k)
    slope = (F.get("rates", k + 1) - w0) / dt
    root = F.sqrt(F.greatest(w0 * w0 + slope * rest * 2.0, F.lit(0.0)))
    step = F.when(rest <= 0, F.lit(0.0)).otherwise(rest * 2.0 / (w0 + root))
    return F.get("times", k) + F.least(step, dt)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedule_of=cyclic_schedules, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies.

    ``copies`` is an array of (copy, words, position). A source is read in a
    fixed pseudo-random order, pass after pass, until its target is reached; at
    most the one document at that point is taken in part.
    """
    sized = write_shared(document_sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed), "mix-sizes")
    rows = sized.count()
    digits = max(2, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))
    sized = sized.withColumn("bucket", F.substring("order_key", 1, digits))
    targets = source_targets(sized, schedule_of, max_repeats)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        sized.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
        .withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
        .join(targets, "src").drop("bucket_size")
    )
    within = Window.partitionBy("src", "bucket").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0))).join(buckets, ["src", "bucket"])

    def copy(c: Column) -> Column:
        lo = c * F.col("source_size") + F.col("base") + F.col("local")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - lo)).cast("long")
        return F.struct(c.alias("copy"), words.alias("words"), position_at(F.try_divide(lo + words * 0.5, F.col("quota").cast("double"))).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), copy), lambda x: x["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
    source = F.when(F.col("src") == "1", F.lit(None)).otherwise(F.expr("substring(src, 2)"))
    return placed.withColumn("copies", copies).select("doc_id", source.alias("source"), "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus: rows of ``docs``, repeated as the mix says, range-sorted by position.

    A document that is taken in part keeps its first words. Repeated ids of
    ``docs`` are matched one to one by their rank within the id, so rows are not
    multiplied.
    """
    cols = docs.columns
    nth = lambda *order: F.row_number().over(Window.partitionBy("__mix_id").orderBy(*order))
    left = docs.withColumn("__mix_id", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).withColumn("__mix_size", word_count(F.col(text_col)))
    left = left.withColumn("__mix_nth", nth("__mix_size"))
    right = mixed.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__mix_id"), F.col("size").alias("__mix_words"), F.col("copies").alias("__mix_copies"))
    right = right.withColumn("__mix_nth", nth("__mix_words")).filter(F.size("__mix_copies") > 0)
    out = left.join(right, ["__mix_id", "__mix_nth"]).withColumn("__mix_copy", F.explode("__mix_copies"))
    start = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD_WITH_LEAD), F.lit(0)), 1, F.col("__mix_copy.words").cast("int")), "")
    text = F.when(F.col("__mix_copy.words") < F.col("__mix_size"), start).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).orderBy(F.col("__mix_copy.position"), "__mix_id", F.col("__mix_copy.copy")).select(*cols)
