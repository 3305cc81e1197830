"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringlens.session import cut_lineage


HALF = (1 << 32) - 1


def _shuffled(number: Column, salt: int) -> Column:
    """A one-to-one scrambling of 64-bit numbers: two steps that XOR one half with a hash of the other."""
    high, low = F.shiftrightunsigned(number, 32), number.bitwiseAND(F.lit(HALF))
    for k in range(2):
        high, low = low, high.bitwiseXOR(F.hash(low, F.lit(2 * salt + k)).cast("bigint").bitwiseAND(F.lit(HALF)))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _unshuffled(value: Column, salt: int) -> Column:
    high, low = F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(HALF))
    for k in (1, 0):
        high, low = low.bitwiseXOR(F.hash(high, F.lit(2 * salt + k)).cast("bigint").bitwiseAND(F.lit(HALF))), high
    return F.shiftleft(high, 32).bitwiseOR(low)


def contract(arcs: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """One round over arcs (u, v) of numbered nodes: ``(id, rep)`` of every node that still has arcs, and the arcs left.

    A node hooks onto the neighbour of smallest priority, if that is below its own, and then onto what that one hooked onto.
    Priorities scramble the numbers anew each round, so hooks are acyclic and no order of names makes long chains.
    """
    nearest = arcs.groupBy("u").agg(F.min(_shuffled(F.col("v"), number)).alias("near"))
    lowest = F.least(_shuffled(F.col("u"), number), F.col("near"))
    hooked = nearest.select(F.col("u").alias("id"), _unshuffled(lowest, number).alias("rep"))
    onward = hooked.select(F.col("id").alias("rep"), F.col("rep").alias("further"))
    step = cut_lineage(hooked.join(onward, "rep").select("id", F.col("further").alias("rep")))
    ends = [step.select(F.col("id").alias(end), F.col("rep").alias(f"r{end}")) for end in ("u", "v")]
    left = arcs.join(ends[0], "u").join(ends[1], "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
    return step, cut_lineage(left)


def _numbered(nodes: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``(id, n)`` of the distinct nodes, and what numbers a column of ids the same way.

    A number is a hash of the id. Two ids of one number are looked for, and all get other hashes if there are any.
    """
    for salt in count():
        def number(column: str, salt: int = salt) -> Column:
            return hashed(F.col(column), salt)

        numbers = cut_lineage(nodes.select("id").distinct().withColumn("n", number("id")))
        if numbers.groupBy("n").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1").isEmpty():
            return numbers, number


def hashed(ids: Column, salt: int) -> Column:
    return F.xxhash64(ids, F.lit(salt))


def connected_components(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``(id, component)`` for ``nodes(id)`` and ``arcs(u, v)`` between them, listed in both directions.

    The component is named after its smallest id. Ids become numbers where they are read, so arcs are never joined with names. Rounds
    rewrite only the nodes and arcs that are still live, whose number falls by a constant factor on average; the rounds'
    representatives are composed from the last round to the first, which costs about as much as the first.
    """
    numbers, number = _numbered(nodes)
    live = cut_lineage(arcs.where("u <> v").select(number("u").alias("u"), number("v").alias("v")).distinct())
    steps: list[DataFrame] = []
    while not live.isEmpty():
        step, live = contract(live, len(steps))
        steps.append(step)
    if not steps:
        return numbers.selectExpr("id", "id AS component")

    def composed(later: DataFrame, step: DataFrame) -> DataFrame:
        tops = later.select(F.col("id").alias("rep"), F.col("rep").alias("top"))
        return cut_lineage(step.join(tops, "rep", "left").select("id", F.coalesce("top", "rep").alias("rep")))

    whole = reduce(composed, reversed(steps)).withColumnRenamed("id", "n")
    members = cut_lineage(numbers.join(whole, "n", "left").select("id", "rep"))
    linked = members.where("rep IS NOT NULL")
    named = linked.join(linked.groupBy("rep").agg(F.min("id").alias("component")), "rep").select("id", "component")
    return named.unionByName(members.where("rep IS NULL").selectExpr("id", "id AS component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_summary(labels: DataFrame) -> DataFrame:
    """One row: number of components and the largest size."""
    return component_sizes(labels).agg(
        F.count(F.lit(1)).alias("components"), F.max("size").alias("largest_component")
    )
