"""Exact order statistics and running totals that never sort one key in one task.

Quantiles descend by digits: a value's order-keeping place (exponent and leading digits) is counted per key, the digit that holds the
wanted rank is found, and only its values are counted by further digits. Every key and quantile takes part in each pass; a digit
that holds one distinct value is an answer at once, so keys of few values end in the first pass.

Running totals cut the value range into buckets at approximate quantiles. The cut points only decide how the work is
spread: rows are ordered inside a bucket, and bucket totals (a handful of rows per key) supply the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens.session import cut_lineage

BUCKETS = 64
DIGITS = (8, 16)  # binary digits behind the exponent that the first and the second pass count by


def _with_bucket(values: DataFrame, column: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, the number of cut points below ``column`` (equal values share one)."""
    shares = [i / buckets for i in range(1, buckets)]
    cuts = values.agg(F.percentile_approx(column, shares, 1000).alias("_cuts"))
    return (
        values.withColumn("_cuts", cuts.scalar())
        .withColumn("_bucket", F.size(F.filter("_cuts", lambda cut: cut < F.col(column))))
        .drop("_cuts")
    )


def order_place(value: Column) -> Column:
    """A double that grows with ``value``: exponent plus leading digits, mirrored below zero; NaN is the largest."""
    size = F.abs(value)
    exponent = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size))).cast("int")
    # 2 ** exponent in two factors, as it may lie outside the doubles itself
    half = F.floor(exponent / 2)
    scaled = size / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), exponent - half)
    place = F.when(size == 0, 0.0).when(size == float("inf"), 3000.0).otherwise(1100.0 + exponent + (scaled - 1.0))
    return F.when(F.isnan(value), 4000.0).when(value < 0, -place).otherwise(place)


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of ``column`` per key, one output column per entry.

    Nulls are ignored; a key without values has no output row.
    """
    groups = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    values = (
        source.where(F.col(column).isNotNull())
        .groupBy(*groups, (F.col(column).cast("double") + F.lit(0.0)).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_place", order_place(F.col("_value")))
    )
    summary = (F.sum("_n").alias("_size"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))

    def digit(bits: int) -> Column:
        return F.floor(F.col("_place") * float(1 << bits)).cast("bigint")

    def offset(*within: str, by: str) -> Column:
        before = Window.partitionBy(*groups, *within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_size").over(before), F.lit(0))

    # ranks to find: for each quantile the one below and the one above its position
    first, more = DIGITS
    counted = values.groupBy(*groups, digit(first).alias("_digit")).agg(*summary)
    total = F.sum("_size").over(Window.partitionBy(*groups))
    ranks = []
    for i, share in enumerate(quantiles.values()):
        position = F.lit(float(share)) * (F.col("_total") - 1).cast("double")
        for t, rank in ((2 * i, F.floor(position)), (2 * i + 1, F.ceil(position))):
            ranks.append(F.struct(F.lit(t).alias("t"), rank.cast("bigint").alias("rank"), (position - F.floor(position)).alias("part")))
    placed = counted.withColumns({"_total": total, "_offset": offset(by="_digit")}) \
        .withColumn("_target", F.explode(F.array(*ranks))).where("_offset <= _target.rank AND _target.rank < _offset + _size")
    found = placed.select(*groups, "_digit", "_low", "_high", "_target.t", "_target.part", (F.col("_target.rank") - F.col("_offset")).alias("rank"))

    def settled(rows: DataFrame) -> DataFrame:
        return rows.where("_low <=> _high").select(*groups, "t", "part", F.col("_low").alias("_value"))

    answers = [settled(found)]
    inside = "_offset <= rank AND rank < _offset + _size"
    # the digits that hold several values, by more digits, then by the values themselves
    for bits, by in ((first, digit(first + more)), (first + more, F.col("_value"))):
        open_ = found.where("NOT _low <=> _high").select(*groups, "_digit", "t", "part", "rank")
        cells = values.withColumn("_digit", digit(bits)).join(open_, [*groups, "_digit"])
        narrowed = cells.groupBy(*groups, "t", "part", "rank", by.alias("_next")).agg(*summary)
        found = narrowed.withColumn("_offset", offset("t", by="_next")).where(inside).select(
            *groups, F.col("_next").alias("_digit"), "_low", "_high", "t", "part", (F.col("rank") - F.col("_offset")).alias("rank"))
        answers.append(settled(found))
    out = reduce(DataFrame.union, answers).groupBy(*groups).agg(*[
        pick for i in range(len(quantiles)) for pick in (
            F.max(F.when(F.col("t") == 2 * i, F.col("_value"))).alias(f"_low{i}"), F.max(F.when(F.col("t") == 2 * i + 1, F.col("_value"))).alias(f"_high{i}"),
            F.max(F.when(F.col("t") == 2 * i, F.col("part"))).alias(f"_part{i}"))])
    return out.select(*keys, *[
        (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(name) for i, name in enumerate(quantiles)])


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], *, descending: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``cum_<measure>``: the inclusive running sum by ``order`` within each key.

    ``order`` must be unique within a key (group by it first).
    """
    groups = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    cells = _with_bucket(source, order, buckets)
    direction = F.desc if descending else F.asc
    before = Window.partitionBy(*groups).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy(*groups, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = offsets.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = cells.join(offsets, [*groups, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures],
    )


def dense_numbers(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in ``order`` (unique columns).

    Ranges of the order are stored and numbered by themselves, behind the rows of the ranges before; no task sorts all rows.
    """
    ranges = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut_lineage(ranges.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + place - 1).select(*df.columns, name))
