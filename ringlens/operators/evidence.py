"""Graph evidence for every user at once: entities, related accounts, paths, ego networks.

Lists that may grow with the data stay in rows; only short, bounded lists are nested.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators.projection import ProjectedGraph, UserGraph, both_directions
from ringlens.session import cut_lineage

MAX_PATHS, MAX_HOPS = 10, 3
_NODE_OF_EDGE = "CASE edge_type " + " ".join(f"WHEN '{e}' THEN '{n}'" for _, e, n, _ in S.ENTITY_KINDS.values()) + " END"


def entities(edges: DataFrame, *, shared_only: bool = False) -> DataFrame:
    """``(user_id, node_type, entity_id, weight)`` for the four entity kinds.

    By default every entity of the user; ``shared_only`` keeps those of at least two users.
    """
    rows = edges.where(F.col("edge_type").isin(*S.ENTITY_EDGE_TYPES))
    if shared_only:
        shared = rows.groupBy("edge_type", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("edge_type", "dst")
        rows = rows.join(shared, ["edge_type", "dst"], "left_semi")
    return rows.selectExpr("src AS user_id", f"{_NODE_OF_EDGE} AS node_type", "dst AS entity_id", "weight")


def entity_lists(entity_rows: DataFrame) -> DataFrame:
    """``(user_id, node_type, rank, entity_id)``: every entity of a user and kind, one row each, ranked by id."""
    order = Window.partitionBy("user_id", "node_type").orderBy("entity_id")
    return entity_rows.select("user_id", "node_type", F.row_number().over(order).alias("rank"), "entity_id")


def _place(rows: DataFrame) -> list[str]:
    return [c for c in ("place",) if c in rows.columns]


def related_accounts(graph: DataFrame | UserGraph, subjects: DataFrame | None = None) -> DataFrame:
    """``(user_id, related_id, relationship_types, shared_entity_count)`` by physical links, of all users or of ``subjects(user_id)``.

    ``graph`` is a user graph, which lists the arcs of the subjects alone, or its edges. The arcs of all users of a graph keep
    the column ``place`` they are dealt out by, if they have one.
    """
    if isinstance(graph, DataFrame):
        arcs = both_directions(graph)
        arcs = arcs if subjects is None else arcs.join(subjects.select(F.col("user_id").alias("u")), "u", "left_semi")
    else:
        arcs = graph.arcs_in_place() if subjects is None else graph.arcs_of(subjects)
    return _related(arcs)


def _related(arcs: DataFrame, *more: str) -> DataFrame:
    kinds = ", ".join(f"CASE WHEN {c} > 0 THEN '{label}' END" for c, label in S.RELATIONSHIP_LABELS.items())
    total = " + ".join(S.RELATIONSHIP_LABELS)
    return arcs.selectExpr(
        *_place(arcs), "u AS user_id", "v AS related_id", f"array_compact(array({kinds})) AS relationship_types", f"{total} AS shared_entity_count", *more
    )


def ranked_related(related: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` strongest related accounts per user with their rank; ids break ties."""
    order = Window.partitionBy("user_id").orderBy(F.desc("shared_entity_count"), "related_id")
    return related.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def strongest_related(graph: DataFrame | UserGraph, limit: int, subjects: DataFrame | None = None) -> DataFrame:
    """``ranked_related`` of ``related_accounts``; of a projection, only the pairs that can be among the strongest are formed."""
    if not isinstance(graph, ProjectedGraph):
        return ranked_related(related_accounts(graph, subjects), limit)
    return _related(graph.strongest(limit, subjects).withColumnRenamed("user_id", "u"), "rank")


def related_lists(related: DataFrame) -> DataFrame:
    """All related accounts with their rank, strongest first, one row each. Rows dealt out by ``place`` are ranked where they lie."""
    order = Window.partitionBy(*_place(related), "user_id").orderBy(F.desc("shared_entity_count"), "related_id")
    return related.withColumn("rank", F.row_number().over(order)).drop("place")


# --- Multi-hop paths ----------------------------------------------------------------


def _first(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows per key with their position; the limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", rank).where(F.col("position") <= n)


def _onward(links: DataFrame, by_id: DataFrame, asked: DataFrame, reach: int) -> DataFrame:
    """``(at, next, via)``: the first ``reach`` users around each of ``asked(at)``, by entity and user id."""
    entity = ["edge_type", "entity_id"]
    around = links.join(asked, links.user_id == asked["at"], "left_semi").select(F.col("user_id").alias("at"), *entity, "node_type").join(
        by_id.selectExpr("edge_type", "entity_id", "user_id AS next", "weight"), entity
    ).where("at <> next")
    nearest = around.groupBy("at", "next").agg(
        F.min_by(F.struct("entity_id", "edge_type", "node_type", "weight"), "entity_id").alias("via")
    )
    return cut_lineage(_first(nearest, ["at"], [F.asc("via.entity_id"), F.asc("next")], reach).drop("position"))


def multi_hop_paths(edges: DataFrame, *, max_hops: int = MAX_HOPS) -> DataFrame:
    """Up to ten paths of at most ``max_hops`` hops per user, one per end user, shortest first.

    ``(user_id, hop_count, position, nodes, node_types, edge_types, path_strength)``. One hop
    is user - entity - user, ordered by strength (the end user's uses of the entity), then
    entity and user id. Longer paths extend the kept ones in their order by the first entity
    and user in id order not yet reached; their strength is the weakest step.

    An entity with many users would give a pair for every two of them. Since a user keeps ten
    end users, only the eleven strongest users of an entity can appear in a one-hop path, and
    only the first users around an end user can extend it, so both sides are cut to these
    before the joins, without changing the result. The users around an end user are looked up only where a
    path that still wants extending ends, and once for each such user. Fewer hops leave the paths of those hops as they are.
    """
    links = edges.where(F.col("edge_type").isin(*S.ENTITY_EDGE_TYPES)).selectExpr(
        "src AS user_id", "dst AS entity_id", "edge_type", f"{_NODE_OF_EDGE} AS node_type", "weight"
    )
    entity = ["edge_type", "entity_id"]
    strongest = _first(links, entity, [F.desc("weight"), F.asc("user_id")], MAX_PATHS + 1)
    steps = links.select("user_id", *entity, "node_type").join(
        strongest.selectExpr("edge_type", "entity_id", "user_id AS end", "weight"), entity
    ).where("user_id <> end")
    best = steps.groupBy("user_id", "end").agg(
        F.min_by(F.struct("entity_id", "edge_type", "node_type", "weight"), F.struct(-F.col("weight"), F.col("entity_id"))).alias("via")
    )
    one = _first(
        best, ["user_id"], [F.desc("via.weight"), F.asc("via.entity_id"), F.asc("end")], MAX_PATHS
    ).selectExpr(
        "user_id", "1 AS hop_count", "position", "array(user_id, via.entity_id, end) AS nodes",
        "array('user', via.node_type, 'user') AS node_types", "array(via.edge_type, via.edge_type) AS edge_types",
        "cast(via.weight AS double) AS path_strength",
    )
    one = cut_lineage(one)

    reach = 2 * MAX_PATHS + 1
    by_id = _first(links, entity, [F.asc("user_id")], reach + 1)
    found, frontier = one, one
    looked_up: list[DataFrame] = []
    steps_on: list[DataFrame] = []
    for hop in range(2, max_hops + 1):
        reached = found.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("kept"), F.collect_set(F.element_at("nodes", -1)).alias("seen")
        ).where(F.col("kept") < MAX_PATHS)
        live = frontier.join(reached, "user_id").withColumn("at", F.element_at("nodes", -1))
        asked = live.select("at").distinct()
        for earlier in looked_up:
            asked = asked.join(earlier, "at", "left_anti")
        looked_up.append(cut_lineage(asked))
        steps_on.append(_onward(links, by_id, looked_up[-1], reach))
        extended = (
            live.join(reduce(DataFrame.unionByName, steps_on), "at")
            .where("next <> user_id AND NOT array_contains(seen, next)")
        )
        # An end user reached several times keeps the earliest way in.
        earliest = extended.groupBy("user_id", "next").agg(
            F.min_by(F.struct("position", "nodes", "node_types", "edge_types", "path_strength", "via", "kept"),
                     F.struct("position", F.col("via.entity_id"))).alias("p")
        )
        new = (
            _first(earliest, ["user_id"], [F.asc("p.position"), F.asc("p.via.entity_id"), F.asc("next")], MAX_PATHS)
            .where("position <= 10 - p.kept")
            .selectExpr(
                "user_id", f"{hop} AS hop_count", "cast(p.kept + position AS int) AS position",
                "p.nodes || array(p.via.entity_id, next) AS nodes",
                "p.node_types || array(p.via.node_type, 'user') AS node_types",
                "p.edge_types || array(p.via.edge_type, p.via.edge_type) AS edge_types",
                "least(p.path_strength, cast(p.via.weight AS double)) AS path_strength",
            )
        )
        frontier = cut_lineage(new)
        found = found.unionByName(frontier)
    return found


# --- Context, ego network -------------------------------------------------------------


def community_context(assigned: DataFrame, graph_edges: DataFrame) -> DataFrame:
    degree = both_directions(graph_edges.select("view", "a", "b")).groupBy(F.col("u").alias("user_id")).agg(
        F.count(F.lit(1)).alias("user_degree")
    )
    return (
        assigned.select("user_id", "community_id", "community_size", "community_density")
        .join(degree, "user_id", "left").na.fill(0, ["user_degree"])
        .withColumn("neighbor_count", F.col("user_degree"))
    )


def only_listed(evidence: DataFrame, wanted: DataFrame, *, limit: int | None = 100) -> DataFrame:
    """Evidence of at most ``limit`` requested users; unknown ids are skipped.

    The limit is part of the request: a longer list is an error, not a silent cut. Without one (None) a list of any length is
    answered, as the requests it would be cut into are together.
    """
    ids = wanted.select("user_id").distinct()
    if limit is None:
        return evidence.join(ids, "user_id", "left_semi")
    if len(ids.take(limit + 1)) > limit:
        raise ValueError(f"at most {limit} users per request")
    return evidence.join(F.broadcast(ids), "user_id", "left_semi")


def ego_network(
    edges: DataFrame, graph: DataFrame | UserGraph, subjects: DataFrame, *,
    max_entities: int = 40, max_related: int = 40, max_bridges: int = 3,
) -> DataFrame:
    """Links of each subject's neighbourhood: ``(subject, source, target, kind, relationship)``.

    The subject's first entities per type, its strongest related accounts, and for each
    relationship up to ``max_bridges`` entities both hold.
    """
    wanted = subjects.select("user_id").distinct()
    relation = {node: label for (_, _, node, _), label in zip(S.ENTITY_KINDS.values(), S.RELATIONSHIP_LABELS.values())}
    naming = "CASE node_type " + " ".join(f"WHEN '{n}' THEN '{label}'" for n, label in relation.items()) + " END"
    held = entities(edges).withColumn("relationship", F.expr(naming)).select("user_id", "relationship", "entity_id")
    mine = held.join(wanted, "user_id", "left_semi")
    shown = _first(mine, ["user_id", "relationship"], [F.asc("entity_id")], max_entities).selectExpr(
        "user_id AS subject", "user_id AS source", "entity_id AS target", "'subject_entity' AS kind", "relationship"
    )
    related = strongest_related(graph, max_related, wanted)
    types = related.select("user_id", "related_id", F.explode("relationship_types").alias("relationship"))
    # Start from the few kept accounts: their entities that the subject holds too.
    theirs = types.join(held.withColumnRenamed("user_id", "related_id"), ["related_id", "relationship"])
    common = theirs.join(mine, ["user_id", "relationship", "entity_id"], "left_semi")
    bridges = _first(common, ["user_id", "related_id", "relationship"], [F.asc("entity_id")], max_bridges)
    both = bridges.select(F.explode(F.expr(
        "array(struct(user_id AS subject, user_id AS source, entity_id AS target, 'subject_entity' AS kind, relationship),"
        " struct(user_id AS subject, entity_id AS source, related_id AS target, 'related_entity' AS kind, relationship))"
    )).alias("l")).select("l.*")
    return shown.unionByName(both).distinct()


def ego_hidden_counts(edges: DataFrame, graph: DataFrame | UserGraph, subjects: DataFrame, *, max_entities: int = 40, max_related: int = 40) -> DataFrame:
    """How many entities and related accounts the limits of the ego network leave out."""
    wanted = subjects.select("user_id").distinct()
    per_type = entities(edges).join(wanted, "user_id", "left_semi").groupBy("user_id", "node_type").agg(F.count(F.lit(1)).alias("n"))
    left_out = per_type.groupBy("user_id").agg(F.sum(F.greatest(F.col("n") - max_entities, F.lit(0))).alias("hidden_entities"))
    related = related_accounts(graph, wanted).groupBy("user_id").agg(F.count(F.lit(1)).alias("r"))
    return wanted.join(left_out, "user_id", "left").join(related, "user_id", "left").selectExpr(
        "user_id", "coalesce(hidden_entities, 0L) AS hidden_entities", f"greatest(coalesce(r, 0L) - {max_related}, 0L) AS hidden_related"
    )


def _next_level(arcs: DataFrame, levels: list[DataFrame], live: DataFrame, kept: Column) -> DataFrame:
    """The next level of the fronts of the ``live`` origins. A neighbour of level d lies on level d - 1, d or d + 1."""
    last = levels[-1].join(live, "origin", "left_semi").withColumnRenamed("node", "u")
    reached = last.join(arcs, "u").groupBy("origin", F.col("v").alias("node")).agg(kept)
    for level in levels[-2:]:
        reached = reached.join(level, ["origin", "node"], "left_anti")
    return cut_lineage(reached)


def shortest_paths(arcs: DataFrame, pairs: DataFrame, *, max_depth: int = 6) -> DataFrame:
    """``(source, target, path, length)`` for each requested pair within ``max_depth`` steps.

    ``arcs(u, v)`` lists both directions; among equally short paths the one with the smallest ids wins. Unreachable pairs are
    absent, and so are pairs with a null; a pair of equal ids has a path of that id alone, whether or not it has arcs.

    The search goes from both ends in turn, so each side takes half of the steps, and keeps one front per distinct source
    or target, not per pair. A pair is at distance d when its fronts, d steps together, first share a node. Fronts of ends all of
    whose pairs have met stop growing. A source's level keeps the smallest way to each node (half a path); a target's
    level only the smallest next node, and the rest of a path is read off those for the pairs that met.
    """
    arcs = cut_lineage(arcs.select("u", "v").distinct())
    asked = cut_lineage(pairs.select("source", "target").distinct())
    found = asked.where("source = target").selectExpr("source", "target", "array(source) AS path")
    waiting = asked.where("source <> target")
    forward = [waiting.selectExpr("source AS origin").distinct().selectExpr("origin", "origin AS node", "array(origin) AS path")]
    backward = [waiting.selectExpr("target AS origin").distinct().selectExpr("origin", "origin AS node")]
    for step in range(max_depth):
        if step % 2 == 0:
            backward.append(_next_level(arcs, backward, waiting.selectExpr("target AS origin"), F.min("u").alias("next")))
        else:
            forward.append(_next_level(arcs, forward, waiting.selectExpr("source AS origin"), F.min(F.expr("path || array(v)")).alias("path")))
        met = (
            waiting.join(forward[-1].withColumnRenamed("origin", "source"), "source")
            .join(backward[-1].withColumnRenamed("origin", "target"), ["target", "node"], "left_semi")
            .groupBy("source", "target").agg(F.min("path").alias("path"))
        )
        for level in backward[:0:-1]:
            met = (
                met.withColumn("node", F.element_at("path", -1)).join(level.withColumnRenamed("origin", "target"), ["target", "node"])
                .selectExpr("source", "target", "path || array(next) AS path")
            )
        met = cut_lineage(met)
        found = found.unionByName(met)
        waiting = cut_lineage(waiting.join(met, ["source", "target"], "left_anti"))
        if waiting.isEmpty():
            break
    return found.selectExpr("source", "target", "path", "size(path) - 1 AS length")
