"""Modularity communities by parallel local moves and contraction."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlens.operators.components import connected_components
from ringlens.operators.projection import UserGraph, both_directions, edge_counts
from ringlens.session import cut_lineage

# Smallest rise of modularity that counts.
TOLERANCE = 1e-6


def _modularity(arcs: DataFrame, labels: DataFrame, resolution: float) -> dict[str, float]:
    """Modularity per view of ``labels(view, node, community)`` on ``arcs(view, u, v, w)``."""
    ends = labels.selectExpr("view", "node AS u", "community AS cu"), labels.selectExpr("view", "node AS v", "community AS cv")
    joined = arcs.join(ends[0], ["view", "u"]).join(ends[1], ["view", "v"])
    per = joined.groupBy("view", F.col("cu").alias("c")).agg(
        F.sum("w").alias("total"), F.sum(F.expr("if(cu = cv, w, 0D)")).alias("inside")
    )
    mass = arcs.groupBy("view").agg(F.sum("w").alias("m2"))
    rows = per.join(F.broadcast(mass), "view").groupBy("view").agg(
        F.sum(F.expr(f"inside / m2 - {resolution}D * (total / m2) * (total / m2)")).alias("q")
    )
    return {row.view: row.q for row in rows.collect()}  # one row per view


def _local_moves(arcs: DataFrame, resolution: float, seed: int, level: int, max_rounds: int = 400) -> DataFrame:
    """Move nodes to the neighbouring community of the best gain, until a view gains nothing more.

    All nodes decide at once, but only a hashed half may move per round, the other half in the
    next, and a singleton joins another singleton only if that one has the smaller id, so two
    nodes never just swap. A view is finished when a pair of rounds raises its modularity by at
    most ``TOLERANCE``; it keeps the better of the states before and after that pair. Reaching
    ``max_rounds`` is an error.
    """
    strength = arcs.groupBy("view", F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    mass = arcs.groupBy("view").agg(F.sum("w").alias("m2"))
    state = cut_lineage(strength.join(F.broadcast(mass), "view").selectExpr("view", "node", "k", "m2", "node AS community"))
    outward = arcs.where("u <> v")
    finished: list[DataFrame] = []
    earlier: DataFrame | None = None
    before: dict[str, float] = {}
    for turn in range(max_rounds):
        totals = state.groupBy("view", "community").agg(F.sum("k").alias("mass"), F.count(F.lit(1)).alias("members"))
        toward = (
            outward.join(state.selectExpr("view", "node AS v", "community"), ["view", "v"])
            .groupBy("view", F.col("u").alias("node"), "community").agg(F.sum("w").alias("w_in"))
        )
        home = state.selectExpr("view", "node", "k", "m2", "community AS home")
        options = (
            toward.join(totals, ["view", "community"]).join(home, ["view", "node"])
            .withColumn("gain", F.expr(
                f"w_in - {resolution}D * k * (mass - if(community = home, k, 0D)) / m2"))
        )
        best = options.groupBy("view", "node").agg(
            F.max(F.expr("if(community = home, gain, NULL)")).alias("stay"),
            F.min_by(F.struct("community", "gain", "members"),
                     F.struct(F.expr("if(community = home, 1, 0)"), -F.col("gain"), F.col("community"))).alias("go"),
        )
        alone = totals.selectExpr("view", "community", "mass AS own_mass", "members AS own_members")
        decided = (
            state.join(best, ["view", "node"], "left").join(alone, ["view", "community"])
            # Without a neighbour at home, staying still costs the expected weight to the rest of it.
            .withColumn("keep", F.expr(f"coalesce(stay, -{resolution}D * k * (own_mass - k) / m2)"))
            .withColumn("moves", F.expr(
                f"coalesce(go.community <> community AND go.gain > keep + 1e-12 AND pmod(xxhash64(node, {seed}, {level}, {turn // 2}), 2) = {turn % 2} "
                "AND NOT (own_members = 1 AND go.members = 1 AND go.community > community), false)"))
        )
        judged = cut_lineage(decided.selectExpr(
            "view", "node", "k", "m2", "community", "if(moves, go.community, community) AS target", "keep"))
        if turn % 2 == 0:  # two rounds gave every node its chance
            # the kept gains add up to the modularity of the state, but for a constant per view
            quality = {r.view: r.q for r in judged.groupBy("view").agg(F.sum(F.expr("keep / m2")).alias("q")).collect()}
            done = [view for view, q in quality.items() if view in before and q - before[view] <= TOLERANCE]
            worse = [view for view in done if quality[view] < before[view]]
            if done:
                finished.append(judged.where(F.col("view").isin(done) & ~F.col("view").isin(worse)).select("view", "node", "community"))
                finished.append(earlier.where(F.col("view").isin(worse)).select("view", "node", "community"))
                judged = judged.where(~F.col("view").isin(done))
                outward = outward.where(~F.col("view").isin(done))
            if len(done) == len(quality):
                return reduce(DataFrame.unionByName, finished)
            before, earlier = quality, judged.select("view", "node", "community")
        state = judged.selectExpr("view", "node", "k", "m2", "target AS community")
    raise RuntimeError(f"local moves did not settle in {max_rounds} rounds")


def louvain(graph: UserGraph, *, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """``(view, user_id, raw)``: a community label per projection node, isolated users alone.

    Weighted by the edges' ``weight``. A level is kept only where it raises a view's
    modularity by more than ``TOLERANCE``; contraction stops when no view improves. Every kept
    level merges nodes, so their number is bounded by that of the nodes.
    """
    base = cut_lineage(both_directions(graph.edges.selectExpr("view", "a", "b", "cast(weight AS double) AS w")).select("view", "u", "v", "w"))
    label = cut_lineage(graph.nodes.selectExpr("view", "user_id AS node", "user_id AS community"))
    if base.isEmpty():
        return label.selectExpr("view", "node AS user_id", "community AS raw")
    score = _modularity(base, label, resolution)
    arcs = base
    for level in count():
        moved = cut_lineage(_local_moves(arcs, resolution, seed, level))
        renamed = moved.selectExpr("view", "node AS community", "community AS wider")
        merged = cut_lineage(
            label.join(renamed, ["view", "community"], "left").selectExpr("view", "node", "coalesce(wider, community) AS community")
        )
        after = _modularity(base, merged, resolution)
        improved = [view for view, q in after.items() if q > score[view] + TOLERANCE]
        if not improved:
            break
        better = F.col("view").isin(*improved)
        label = merged.where(better).unionByName(label.where(~better))
        score.update({view: after[view] for view in improved})
        to = moved.where(better)
        arcs = cut_lineage(
            arcs.where(better)
            .join(to.selectExpr("view", "node AS u", "community AS cu"), ["view", "u"])
            .join(to.selectExpr("view", "node AS v", "community AS cv"), ["view", "v"])
            .groupBy("view", F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
        )
    return cut_lineage(connected_parts(graph, label.selectExpr("view", "node AS user_id", "community AS raw")))


def connected_parts(graph: UserGraph, labels: DataFrame) -> DataFrame:
    """``labels(view, user_id, raw)`` with every community that is not connected inside split into its components.

    A part is named after its smallest user. Nodes that leave a community may cut the rest of it in two; parts that share no
    edge only cost modularity together, so splitting never lowers it.
    """
    def node(user: str):
        return F.concat_ws("\n", "view", user)

    ends = [labels.select("view", F.col("user_id").alias(end), F.col("raw").alias(f"raw_{end}")) for end in ("a", "b")]
    inside = graph.edges.select("view", "a", "b").join(ends[0], ["view", "a"]).join(ends[1], ["view", "b"]).where("raw_a = raw_b")
    arcs = both_directions(inside.select(node("a").alias("a"), node("b").alias("b"))).select("u", "v")
    parts = connected_components(labels.select(node("user_id").alias("id")), arcs)
    cut = [F.substring_index(c, "\n", n).alias(name) for c, n, name in (("id", 1, "view"), ("id", -1, "user_id"), ("component", -1, "raw"))]
    return parts.select(*cut)


def modularity(graph: UserGraph, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(view, modularity)`` of ``labels(view, user_id, raw)``."""
    arcs = both_directions(graph.edges.selectExpr("view", "a", "b", "cast(weight AS double) AS w")).select("view", "u", "v", "w")
    scores = _modularity(arcs, labels.selectExpr("view", "user_id AS node", "raw AS community"), resolution)
    return labels.sparkSession.createDataFrame(sorted(scores.items()), "view string, modularity double")


def number_communities(labels: DataFrame) -> DataFrame:
    """``(view, raw, community_id, community_size)`` with ids by falling size, then smallest member.

    The numbering is a distributed rank: the communities are range-partitioned in that order and
    stored, each range is ranked by itself, and the row counts of the ranges before it are added.
    No size and no prefix of the ids decides how many tasks share the work.
    """
    sizes = labels.groupBy("view", "raw").agg(F.count(F.lit(1)).alias("community_size"), F.min("user_id").alias("first_member"))
    order = [F.desc("community_size"), F.asc("first_member")]
    ranges = cut_lineage(sizes.repartitionByRange(F.asc("view"), *order).withColumn("range", F.spark_partition_id()))
    earlier = Window.partitionBy("view").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("view", "range").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return (
        ranges.join(offsets, ["view", "range"])
        .withColumn("place", F.row_number().over(Window.partitionBy("view", "range").orderBy(*order)))
        .selectExpr("view", "raw", "before + place - 1 AS community_id", "community_size")
    )


def community_features(labels: DataFrame, graph: UserGraph) -> DataFrame:
    """``(view, user_id, community_id, community_size, community_edge_count, community_density)``."""
    numbered = number_communities(labels)
    if graph.links is not None:  # only users of one entity and community are paired
        tied = graph.links.join(labels, ["view", "user_id"]).select(F.struct("view", "raw").alias("view"), "kind", "entity_id", "user_id")
        inner = edge_counts(tied).selectExpr("view.view AS view", "view.raw AS raw", "n_edges AS community_edge_count")
    else:
        ends = labels.selectExpr("view", "user_id AS a", "raw"), labels.selectExpr("view", "user_id AS b", "raw AS raw_b")
        inner = (
            graph.edges.select("view", "a", "b").join(ends[0], ["view", "a"]).join(ends[1], ["view", "b"])
            .where("raw = raw_b").groupBy("view", "raw").agg(F.count(F.lit(1)).alias("community_edge_count"))
        )
    table = numbered.join(inner, ["view", "raw"], "left").na.fill(0, ["community_edge_count"]).withColumn(
        "community_density",
        F.expr("if(community_size > 1, round(2 * community_edge_count / (cast(community_size AS double) * (community_size - 1)), 8), 0D)"),
    )
    return labels.join(table, ["view", "raw"]).select(
        "view", "user_id", "community_id", "community_size", "community_edge_count", "community_density"
    )
