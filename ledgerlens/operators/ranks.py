"""Distributed exact ranks (E6): cumulative counts, order statistics, percentiles.

A window ``ORDER BY value`` without a partition key sends every row to one task,
and a window partitioned by a hot group does the same for that group. Here the
distinct (group, value) counts are range-partitioned over the cluster; running
sums are taken inside each (range partition, group) and shifted by the totals of
the same group in earlier range partitions (a small per-partition summary). A
group that spans many partitions (a skewed group) is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import drop_shared, write_shared


# The per-partition offset table has at most (groups + partitions) rows; it is
# broadcast when a count proves it under this bound, else joined by shuffle.
OFFSET_BROADCAST_ROWS = 1_000_000


def _small_side(df: DataFrame) -> DataFrame:
    n = df.limit(OFFSET_BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= OFFSET_BROADCAST_ROWS else df


def cumulative_counts(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    *,
    weight_col: str | None = None,
    num_partitions: int | None = None,
    extra_aggs: dict | None = None,
    unique_values: bool = False,
) -> DataFrame:
    """Per distinct (group, value): own count ``k`` and running count ``cum``.

    ``cum`` counts the rows of the group with a value ``<=`` this value, so
    ``cum - k`` counts the rows strictly below. Nulls in ``value_col`` are
    dropped. With ``weight_col`` the counts are sums of that column;
    ``extra_aggs`` (name -> aggregate column) are carried per distinct value.
    With ``unique_values`` every row is its own value (k = 1) and the grouping
    shuffle is skipped: the running count is then the row's rank in its group.
    """
    group_cols = list(group_cols)
    nonnull = df.where(F.col(value_col).isNotNull())
    if unique_values:
        counts = nonnull.withColumn("k", F.lit(1).cast("long"))
    else:
        weight = F.sum(F.col(weight_col)) if weight_col else F.count(F.lit(1))
        extra = [agg.alias(name) for name, agg in (extra_aggs or {}).items()]
        counts = nonnull.groupBy(*group_cols, value_col).agg(weight.cast("long").alias("k"), *extra)
    # Range-partition and sort; record each row's partition and its position in
    # the sorted partition, then write the result to the shared folder. The
    # stored (_pid, _pos) columns make every later step independent of how the
    # table is read back, and a retried task reproduces the same positions
    # (same rows per range partition, same sort, distinct keys). Without an
    # explicit count, AQE sizes the range partitions (it only merges adjacent
    # ones, so the order across partitions is kept).
    by_range = (counts.repartitionByRange(num_partitions, *group_cols, value_col) if num_partitions
                else counts.repartitionByRange(*group_cols, value_col))
    ranged = (
        by_range
        .sortWithinPartitions(*group_cols, value_col)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id()
                    - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    ranged = write_shared(ranged, "ranks")

    keys = ["_pid", *group_cols]
    if unique_values:
        # One row per value: the running count is the position in the partition.
        per_part = ranged.groupBy(*keys).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_tot"))
        local = F.col("_pos") - F.col("_first") + 1
        source = ranged
    else:
        # Running sum inside each (range partition, group): a window whose
        # partitions are bounded by one range partition, even for a hot group.
        w = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        source = ranged.withColumn("_wsum", F.sum("k").over(w))
        per_part = ranged.groupBy(*keys).agg(F.sum("k").alias("_tot"))
        local = F.col("_wsum")
    # Offset of a group in a range partition = its rows in earlier partitions.
    # One row per (partition, group): at most groups + partitions rows.
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("_off", F.coalesce(F.sum("_tot").over(before), F.lit(0))).drop("_tot")
    offsets = _small_side(offsets)
    out = source.join(offsets, keys).withColumn("cum", (local + F.col("_off")).cast("long"))
    return out.drop("_pid", "_pos", "_first", "_wsum", "_off")


#: Bits of a value's code that one round of a selection settles; six rounds settle 64.
SELECT_BITS = 12
SELECT_ROUNDS = -(-64 // SELECT_BITS)
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def value_code(value: Column, integral: bool) -> Column:
    """A 64-bit integer with the order of ``value``: -Infinity first, NaN after Infinity, both zeros equal.

    Integers are their own code. A double's bits are ordered like the number if it is
    positive; of a negative one all bits but the sign are turned over.
    """
    if integral:
        return value.cast("long")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit((1 << 63) - 1)))


def code_value(code: Column, integral: bool) -> Column:
    """The value (long or double) of a code."""
    if integral:
        return code
    bits = code.bitwiseXOR(F.shiftright(code, 63).bitwiseAND(F.lit((1 << 63) - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def order_statistics(df: DataFrame, group_cols: Sequence[str], value_col: str, index_of: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact order statistics per group by counting leading bits: no sort, no shuffle of rows.

    ``index_of`` maps a name to the zero-based position wanted, as a function of the
    group's number of non-null values. The values' sortable codes are written once.
    Each round reads them, counts those of every open interval by the ``SELECT_BITS``
    bits after the ones that the interval's ends share, and keeps the bucket that holds
    the position, narrowed to the smallest and largest code in it, until those are
    equal. So ``SELECT_ROUNDS`` rounds settle any distribution: infinities, NaN (after
    all numbers), the largest doubles beside the smallest. Names that still have the
    same interval share its counts. The state, a row for each group and name, is
    written between rounds; it is joined to the rows, where the planner broadcasts it
    if it is small.

    Returns one row per group: the group, ``n`` and one column per name (a double, or a
    long if the values are integers).
    """
    groups = list(group_cols)
    integral = dict(df.dtypes)[value_col] in _INTEGRAL
    code = value_code(F.col(value_col), integral)
    # the constant key is stored, so that an overall statistic is an equi-join as well
    coded = write_shared(df.where(F.col(value_col).isNotNull()).select(F.lit(0).alias("_all"), *groups, code.alias("_v")), "codes")
    keys = ["_all", *groups]
    span = coded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("at")) for name, at in index_of.items()])
    state = span.withColumn("_w", F.explode(wanted)).select(*keys, "n", F.col("_w.name").alias("name"), F.col("_w.at").alias("at"), "_lo", "_hi")
    state = write_shared(state, "select")
    rounds = 0
    while state.where(F.col("_lo") < F.col("_hi")).limit(1).count():
        if rounds == SELECT_ROUNDS:
            raise RuntimeError("a selection did not end with the bits of its codes")
        rounds += 1
        open_ = state.where(F.col("_lo") < F.col("_hi"))
        # bits in which the interval's ends differ, of which this round settles the first
        differ = F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi"))))
        ends = open_.select(*keys, "_lo", "_hi", F.greatest(differ - SELECT_BITS, F.lit(0)).alias("_shift")).distinct()
        held = ends.groupBy(*keys).agg(F.collect_list(F.struct("_lo", "_hi", "_shift")).alias("_open"))
        met = coded.join(held, [coded[k].eqNullSafe(held[k]) for k in keys]).select(
            *[coded[k] for k in keys], "_v", F.explode(F.filter("_open", lambda x: F.col("_v").between(x["_lo"], x["_hi"]))).alias("_x"))
        bucket = F.expr("shiftright(_v, _x._shift) - shiftright(_x._lo, _x._shift)")
        counted = met.groupBy(*keys, F.col("_x._lo").alias("_from"), F.col("_x._hi").alias("_to"), bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_k").over(Window.partitionBy(*keys, "_from", "_to").orderBy("_b"))
        counted = counted.withColumn("_cum", upto)
        same = [open_[k].eqNullSafe(counted[k]) for k in keys] + [F.col("_lo") == F.col("_from"), F.col("_hi") == F.col("_to")]
        within = (F.col("_cum") > F.col("at")) & (F.col("_cum") - F.col("_k") <= F.col("at"))
        narrowed = open_.join(counted, same).where(within).select(
            *[open_[k] for k in keys], "n", "name", (F.col("at") - F.col("_cum") + F.col("_k")).alias("at"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"))
        state = write_shared(state.where(F.col("_lo") >= F.col("_hi")).unionByName(narrowed), "select")
    drop_shared(coded)  # the state alone is read from here on
    found = state.withColumn("_at", code_value(F.col("_lo"), integral))
    return found.groupBy(*keys, "n").pivot("name", list(index_of)).agg(F.first("_at")).drop("_all")


def exact_percentiles(df: DataFrame, group_cols: Sequence[str], value_col: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact percentiles by linear interpolation (position ``q·(n−1)``).

    Same definition as SQL ``percentile`` / ``quantile_cont``, from
    :func:`order_statistics`. One row per group, one column per entry of ``quantiles``.
    """
    at = lambda q: lambda n: F.lit(float(q)) * (n - 1)
    index = {}
    for name, q in quantiles.items():
        index[f"{name}__lo"] = lambda n, q=q: F.floor(at(q)(n))
        index[f"{name}__hi"] = lambda n, q=q: F.ceil(at(q)(n))
    found = order_statistics(df, group_cols, value_col, index)


    def between(name: str, q: float) -> Column:
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        share = at(q)(F.col("n")) - F.floor(at(q)(F.col("n")))
        # nothing is subtracted where it isn't needed: infinities stay what they are
        return F.when((share == 0) | (lo == hi), lo.cast("double")).otherwise(lo + share * (hi - lo))

    return found.select(*group_cols, *[between(name, q).alias(name) for name, q in quantiles.items()])


#: Size parameter of the quantile sketches: a rank error of about 1.65 % at 200, with 99 % confidence.
SKETCH_K = 200


def quantile_sketches(df: DataFrame, group_cols: Sequence[str], value_col: str, *, k: int = SKETCH_K) -> DataFrame:
    """Mergeable quantile sketches (KLL) of a column by group: one partial aggregate, a few kilobytes a group.

    Sketches of parts (days, partitions of a source) may be stored and merged later by
    :func:`merge_sketches`; the rows are never read again. Nulls are left out.
    """
    x = F.col(value_col).cast("double")
    return df.where(x.isNotNull()).groupBy(*group_cols).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, group_cols: Sequence[str], *, k: int = SKETCH_K) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*group_cols).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def approximate_percentiles(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The named approximate option beside :func:`exact_percentiles`: one column per entry, read from the sketches."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *found)
