"""Per-user features of the typed graph and of the user projection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.exprs import present, unpivot_ids
from ringlens.functions.ordered import dense_numbers, exact_quantiles
from ringlens.operators.projection import COMMON, COUNTS, UserGraph, both_directions
from ringlens.session import cut_lineage

_DIRECT_COUNTS = {
    "device": "unique_devices", "ip": "unique_ips", "address": "unique_addresses",
    "payment_instrument": "unique_payment_instruments", "merchant": "unique_merchants",
    "promotion": "unique_promotions",
}
_SHARING = {
    "shared_device_count": "number_of_accounts_sharing_devices",
    "shared_ip_count": "number_of_accounts_sharing_ips",
    "shared_address_count": "number_of_accounts_sharing_addresses",
    "shared_payment_instrument_count": "number_of_accounts_sharing_payment_instruments",
    "shared_promotion_count": "number_of_accounts_sharing_promotions",
}


def direct_features(transactions: DataFrame) -> DataFrame:
    """Degree, weighted degree and distinct counts in the typed graph, per view if there are views.

    Entities count once in the degree and once per use in the weighted degree; each
    transaction node adds one to both.
    """
    columns = {kind: column for kind, (column, *_) in S.ENTITY_KINDS.items()}
    columns |= {"merchant": "merchant_id", "promotion": "promo_id", "transaction": "user_id"}
    user = [c for c in ("view", "user_id") if c in transactions.columns]
    item = unpivot_ids(columns).alias("item")
    links = (
        transactions.select(*user, item)
        .select(*user, "item.kind", "item.value")
        .where(present("value"))
        .groupBy(*user, "kind", "value")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    entity = "kind IN ({})".format(", ".join(f"'{k}'" for k in S.ENTITY_KINDS))
    return links.groupBy(*user).agg(
        F.expr(f"sum(CASE WHEN {entity} THEN 1L WHEN kind = 'transaction' THEN uses END) AS degree"),
        F.expr(f"sum(CASE WHEN {entity} OR kind = 'transaction' THEN uses END) AS weighted_degree"),
        *[F.expr(f"count_if(kind = '{kind}') AS {name}") for kind, name in _DIRECT_COUNTS.items()],
    )


def graph_totals(graph: UserGraph) -> DataFrame:
    """``node_totals`` of all edges of a graph, written out. With homes, no pair at home is formed."""
    return cut_lineage(node_totals(both_directions(graph.edges)) if graph.homes is None else _home_totals(graph))


def _home_totals(graph: UserGraph) -> DataFrame:
    """A home of n users gives each n - 1 neighbours and shared entities, and for each promotion the others there who used it.

    What else users of one home share comes from ``graph.extra``, all other edges from ``graph.across``.
    """
    kinds = {count: f"if(home.kind = '{kind}', n - 1, 0L)" for kind, count in S.SHARED_COUNTS.items() if kind != "promotion"}
    promotion, none = S.SHARED_COUNTS["promotion"], {c: "0L" for c in ("neighbours", *COUNTS)}

    def rows(source: DataFrame, values: dict[str, str]) -> DataFrame:
        return source.selectExpr("view", "user_id", *[f"{e} AS {c}" for c, e in {**none, **values}.items()])

    people = graph.homes.select("view", "home", "user_id", "promos")
    sizes = people.groupBy("view", "home").agg(F.count(F.lit(1)).alias("n"))
    at_home = rows(people.join(sizes, ["view", "home"]), {"neighbours": "n - 1", **kinds})
    bits = f"filter(sequence(0L, {COMMON - 1}L), b -> shiftrightunsigned(promos.common, cast(b AS int)) & 1L = 1L)"
    used = people.select("view", "home", "user_id", F.explode(F.expr(f"concat({bits}, promos.rare)")).alias("number"))
    users = used.groupBy("view", "home", "number").agg((F.count(F.lit(1)) - 1).alias("others"))
    alike = rows(used.join(users, ["view", "home", "number"]), {promotion: "others"})
    extra = rows(both_directions(graph.extra).withColumnRenamed("u", "user_id"), {c: c for c in kinds})
    away = rows(both_directions(graph.across).withColumnRenamed("u", "user_id"), {"neighbours": "1L", **{c: c for c in COUNTS}})
    return at_home.unionByName(alike).unionByName(extra).unionByName(away).groupBy("view", "user_id").agg(
        F.sum("neighbours").alias("number_of_user_neighbors"),
        *[F.sum(count).alias(name) for count, name in _SHARING.items()],
        F.expr(f"sum({' + '.join(COUNTS)}) AS incident_total"),
    ).where("number_of_user_neighbors > 0")


def node_totals(arcs: DataFrame) -> DataFrame:
    """Per node of the projection: degree and the sums of incident shared counts."""
    return arcs.groupBy("view", F.col("u").alias("user_id")).agg(
        F.count(F.lit(1)).alias("number_of_user_neighbors"),
        *[F.sum(count).alias(name) for count, name in _SHARING.items()],
        F.sum("weight").alias("incident_total"),
    )


def high_degree_threshold(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(view, threshold): the integer part of the 90th percentile degree, at least 2."""
    degrees = nodes.join(totals, ["view", "user_id"], "left").selectExpr(
        "view", "coalesce(number_of_user_neighbors, 0) AS degree"
    )
    return exact_quantiles(degrees, ["view"], "degree", {"p90": 0.9}).selectExpr(
        "view", "greatest(cast(floor(p90) AS bigint), 2L) AS threshold"
    )


def neighbour_features(arcs: DataFrame, totals: DataFrame, thresholds: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """Neighbour degrees and two-hop sums, from per-node sums rather than neighbour triples.

    ``thresholds`` has one row per view and is broadcast. With the ``homes`` of a projection, ``arcs`` lists only the edges
    across them, and the neighbours at home enter as sums over the home.
    """
    if homes is not None:
        return _neighbour_sums(arcs, totals, thresholds, homes)
    ends = totals.selectExpr(
        "view", "user_id AS v", "number_of_user_neighbors AS degree_v", "incident_total AS all_v",
        "number_of_accounts_sharing_devices AS devices_v", "number_of_accounts_sharing_ips AS ips_v",
    )
    return (
        arcs.join(ends, ["view", "v"])
        .join(F.broadcast(thresholds), "view")
        .groupBy("view", F.col("u").alias("user_id"))
        .agg(
            F.expr("count_if(degree_v >= threshold) AS number_of_high_degree_neighbors"),
            F.avg("degree_v").alias("average_neighbor_degree"),
            F.max("degree_v").alias("maximum_neighbor_degree"),
            F.expr("sum(all_v - weight) AS two_hop_unique_entity_count"),
            F.expr("sum(devices_v - shared_device_count) AS two_hop_shared_device_count"),
            F.expr("sum(ips_v - shared_ip_count) AS two_hop_shared_ip_count"),
        )
    )


def _neighbour_sums(arcs: DataFrame, totals: DataFrame, thresholds: DataFrame, homes: DataFrame) -> DataFrame:
    """Neighbours at home are the home without the user; what a two-hop sum leaves out per edge adds up to the user's own total."""
    added = ("n", "high", "degree", "total", "devices", "ips")
    each = totals.join(F.broadcast(thresholds), "view").selectExpr(
        "view", "user_id", "1L AS n", "cast(number_of_user_neighbors >= threshold AS bigint) AS high", "number_of_user_neighbors AS degree",
        "incident_total AS total", "number_of_accounts_sharing_devices AS devices", "number_of_accounts_sharing_ips AS ips")
    sums = [F.sum(c).alias(c) for c in added]
    people = homes.select("view", "home", "user_id").join(each, ["view", "user_id"])
    per_home = people.groupBy("view", "home").agg(*[F.sum(c).alias(f"_{c}") for c in added], F.max(F.struct("degree", "user_id")).alias("top"))
    second = people.join(per_home.select("view", "home", "top"), ["view", "home"]).where("user_id <> top.user_id").groupBy("view", "home").agg(
        F.max("degree").alias("second"))
    at_home = people.join(per_home, ["view", "home"]).join(second, ["view", "home"], "left").selectExpr(
        "view", "user_id", *[f"_{c} - {c} AS {c}" for c in added], "if(user_id = top.user_id, second, top.degree) AS most")
    away = (
        arcs.select("view", "u", "v").join(each.withColumnRenamed("user_id", "v"), ["view", "v"])
        .groupBy("view", F.col("u").alias("user_id")).agg(*sums, F.max("degree").alias("most"))
    )
    around = at_home.unionByName(away).groupBy("view", "user_id").agg(*sums, F.max("most").alias("most"))
    own = each.selectExpr("view", "user_id", "total AS own_total", "devices AS own_devices", "ips AS own_ips")
    return around.join(own, ["view", "user_id"]).where("n > 0").selectExpr(
        "view", "user_id", "high AS number_of_high_degree_neighbors", "cast(degree AS double) / n AS average_neighbor_degree",
        "most AS maximum_neighbor_degree", "total - own_total AS two_hop_unique_entity_count",
        "devices - own_devices AS two_hop_shared_device_count", "ips - own_ips AS two_hop_shared_ip_count")


def sharing_totals(members: DataFrame) -> DataFrame:
    """The four sums of shared physical entities per user, for users who share one.

    Every entity of n users adds n - 1 to each of them, so the sums come straight from ``members(view, kind, entity_id,
    user_id)`` (distinct rows, as ``entity_users`` gives them): no pair of users is formed.
    """
    entity = ["view", "kind", "entity_id"]
    sizes = members.groupBy(*entity).agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    kinds = {kind: _SHARING[count] for kind, count in S.SHARED_COUNTS.items() if kind != "promotion"}
    return members.join(sizes, entity).groupBy("view", "user_id").agg(
        *[F.expr(f"sum(if(kind = '{kind}', others, 0L))").alias(name) for kind, name in kinds.items()])


MASK_BITS = 64  # users of one mask


def two_hop_users(arcs: DataFrame) -> DataFrame:
    """Distinct users exactly two hops away, per user (users with none are absent).

    Users are numbered densely, those with the same smallest neighbour side by side, and a set of users is rows of (chunk of
    64 numbers, bit mask). A user's two-hop set is the OR of its neighbours' masks, less its own and itself: masks are
    combined before they are shuffled, and nothing is kept per pair of users.
    """
    nodes = arcs.groupBy("view", F.col("u").alias("user_id")).agg(F.least(F.min("v"), F.col("u")).alias("first"))
    ids = dense_numbers(nodes, ["view", "first", "user_id"], "id").select("view", "user_id", "id")
    linked = cut_lineage(
        arcs.select("view", "u", "v").join(ids.select("view", F.col("user_id").alias("u"), F.col("id").alias("from")), ["view", "u"])
        .join(ids.select("view", F.col("user_id").alias("v"), F.col("id").alias("to")), ["view", "v"]).select("from", "to"))
    chunk, mask = F.expr(f"to DIV {MASK_BITS}").alias("chunk"), F.expr(f"shiftleft(1L, cast(to % {MASK_BITS} AS int))")
    near = cut_lineage(linked.groupBy("from", chunk).agg(F.bit_or(mask).alias("mask")))
    reached = linked.join(near.select(F.col("from").alias("to"), "chunk", F.col("mask").alias("far")), "to").select(
        "from", "chunk", "far", F.lit(0).cast("bigint").alias("near"))
    own = ids.select(F.col("id").alias("from"), F.expr(f"id DIV {MASK_BITS}").alias("chunk"), F.expr(f"shiftleft(1L, cast(id % {MASK_BITS} AS int))").alias("mask"))
    known = near.select("from", "chunk", "mask").union(own).select("from", "chunk", F.lit(0).cast("bigint").alias("far"), F.col("mask").alias("near"))
    sets = reached.union(known).groupBy("from", "chunk").agg(F.bit_or("far").alias("far"), F.bit_or("near").alias("near"))
    counts = sets.groupBy("from").agg(F.sum(F.expr("bit_count(far & ~near)")).alias("two_hop_user_count")).where("two_hop_user_count > 0")
    return ids.join(counts, ids.id == counts["from"]).select("view", "user_id", "two_hop_user_count")


BUCKET_USERS = 1000
CHUNK = 200_000  # two-hop entries spelled out at once, few enough for a core's cache
SLICE = 200_000_000  # two-hop entries dealt out at once
_HIGH = 40  # bits of a user's number in a key


def home_two_hop_users(across: DataFrame, homes: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``two_hop_users`` of a projection with ``homes``; degrees follow from homes and edges, so ``totals`` are not needed.

    Users are numbered home by home, so a home is a range of numbers. Two hops from a user lie the whole homes of itself and of its
    neighbours elsewhere, the neighbours of its home, and those of its neighbours elsewhere: ranges are counted by size, and only
    the last are listed, for ``BUCKET_USERS`` users of successive numbers at a time (``_bucket_counts``). Each bucket gets the list of a neighbour
    once. Buckets go in slices, so that at most about ``SLICE`` entries of lists lie in shuffle files.
    """
    home = ["view", "kind", "entity"]
    people = dense_numbers(homes.select("view", "home.kind", "home.entity", "user_id"), [*home, "user_id"], "id")
    ranges = people.groupBy(*home).agg(F.min("id").alias("lo"), (F.max("id") + 1).alias("hi"))
    ids = cut_lineage(people.join(ranges, home).select("view", "user_id", "id", "lo", "hi"))
    ends = [ids.select("view", F.col("user_id").alias(end), F.struct("id", "lo", "hi").alias(f"_{end}")) for end in ("a", "b")]
    pairs = cut_lineage(across.select("view", "a", "b").join(ends[0], ["view", "a"]).join(ends[1], ["view", "b"]).select("_a", "_b"))
    linked = both_directions(pairs.withColumnsRenamed({"_a": "a", "_b": "b"}))
    lists = cut_lineage(linked.groupBy(F.col("u.id").alias("v")).agg(F.array_sort(F.collect_list("v.id")).alias("list")))

    def bucket(number: str):
        return F.expr(f"{number} DIV {BUCKET_USERS}").alias("bucket")

    own = ids.select(bucket("id"), F.col("id").alias("u"), F.col("lo").alias("h"), F.lit(-1).cast("bigint").alias("v"), "lo", "hi")
    rows = linked.select(bucket("u.id"), F.col("u.id").alias("u"), F.col("u.lo").alias("h"), F.col("v.id").alias("v"), "v.lo", "v.hi").unionByName(own)
    needed = linked.select(bucket("u.id"), F.col("v.id").alias("v")).distinct()
    # the neighbours of a home that lies in several buckets, for all of them
    wide = linked.where(f"u.lo DIV {BUCKET_USERS} <> (u.hi - 1) DIV {BUCKET_USERS}").select("u.lo", "u.hi", F.col("v.id").alias("w")).distinct()
    around = wide.groupBy("lo", "hi", F.expr("w % 64")).agg(F.collect_list("w").alias("list")).select(
        F.explode(F.expr(f"sequence(lo DIV {BUCKET_USERS}, (hi - 1) DIV {BUCKET_USERS})")).alias("bucket"), F.lit(-1).cast("bigint").alias("v"), F.col("lo").alias("h"), "list")

    entries = lists.agg(F.sum(F.expr("cast(size(list) AS bigint) * size(list)"))).first()[0] or 0
    slices = -(-entries // SLICE) or 1
    counts = []
    for k in range(slices):
        chosen = f"pmod(hash(bucket), {slices}) = {k}"
        given = needed.where(chosen).join(lists, "v").select("bucket", "v", F.lit(-1).cast("bigint").alias("h"), "list")
        given = given.unionByName(around.where(chosen).select("bucket", "v", "h", "list"))
        done = rows.where(chosen).groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_bucket_counts, "id bigint, two_hop_user_count bigint")
        counts.append(cut_lineage(done))
        if slices > 1:
            del given, done
            ids.sparkSession.sparkContext._jvm.System.gc()  # the shuffle files of a slice go before the next
    return ids.join(reduce(DataFrame.unionByName, counts), "id").select("view", "user_id", "two_hop_user_count").where("two_hop_user_count > 0")


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers; ``np.unique`` hashes, which takes many times as long here."""
    ordered = np.sort(numbers)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def _bucket_counts(rows: pa.Table, given: pa.Table) -> pa.Table:
    """Users exactly two hops away from each user of a bucket.

    ``rows(u, h, v, lo, hi)``: u's neighbours v in other homes and the ranges of these; the row of u's own home h has no v (-1). ``given(v, h,
    list)``: the neighbours in other homes of v, and those of the homes h that other buckets share.
    """
    u, h, v, lo, hi = (rows[c].to_numpy() for c in ("u", "h", "v", "lo", "hi"))
    lists = given["list"].combine_chunks()
    flat, lengths = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
    at, of_home = given["v"].to_numpy(), given["h"].to_numpy()
    starts = np.cumsum(lengths) - lengths
    users, first = np.unique(u, return_index=True)
    homes = np.unique(h)
    base = users[0]
    out = v >= 0

    # neighbours around a home, and how many lie in a range of numbers
    listed = np.repeat(of_home, lengths)
    near = _distinct(np.concatenate([
        (np.searchsorted(homes, h[out]) << _HIGH) | v[out], (np.searchsorted(homes, listed[listed >= 0]) << _HIGH) | flat[listed >= 0]]))
    place = np.searchsorted(homes, h[first])  # of each user
    sizes = np.searchsorted(near, (place + 1) << _HIGH) - np.searchsorted(near, place << _HIGH)

    # the whole homes within reach, once each
    spans, single = np.unique(((u - base) << _HIGH) | lo, return_index=True)
    owner, low, top = np.searchsorted(users, u[single]), lo[single], hi[single]
    key = place[owner] << _HIGH
    inside = np.searchsorted(near, key | top) - np.searchsorted(near, key | low)
    own = np.bincount(owner, top - low - inside, len(users)).astype(np.int64)  # exact: far below 2^53
    mine = v < 0
    degree = np.bincount(np.searchsorted(users, u), np.where(mine, hi - lo - 1, 1), len(users)).astype(np.int64)

    # the neighbours of neighbours, in chunks of users
    order = np.argsort(at, kind="stable")
    order = order[np.searchsorted(at[order], 0):]
    pick = order[np.searchsorted(at[order], v[out])] if out.any() else np.zeros(0, np.int64)
    source, amount = np.searchsorted(users, u[out]), lengths[pick].astype(np.int64)
    by_user = np.argsort(source, kind="stable")
    source, amount, begin = source[by_user], amount[by_user], starts[pick][by_user]
    further = np.zeros(len(users), np.int64)
    ends = np.cumsum(amount)
    i = 0
    while i < len(source):
        j = max(np.searchsorted(ends, ends[i] - amount[i] + CHUNK, "right"), i + 1)
        last = np.searchsorted(source, source[min(j, len(source)) - 1])  # a user is not cut in two
        j = len(source) if j >= len(source) else last if last > i else np.searchsorted(source, source[i], "right")
        many = amount[i:j]
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found = _distinct((np.repeat(users[source[i:j]] - base, many) << _HIGH) | flat[np.repeat(begin[i:j], many) + offset])
        number, local = found & ((1 << _HIGH) - 1), np.searchsorted(users, (found >> _HIGH) + base)
        span = np.searchsorted(spans, found, "right") - 1
        within = (span >= 0) & (owner[span] == local) & (number < top[span])
        seek = (place[local] << _HIGH) | number
        known = np.searchsorted(near, seek)
        known = (known < len(near)) & (near[np.minimum(known, len(near) - 1)] == seek) if len(near) else np.zeros(len(seek), bool)
        further += np.bincount(local[~within & ~known], minlength=len(users))
        i = j
    return pa.table({"id": users, "two_hop_user_count": own + sizes + further - degree - 1})


def graph_two_hop_users(graph: UserGraph) -> DataFrame:
    """``two_hop_users`` of a graph; with homes, no pair at home is formed."""
    return two_hop_users(both_directions(graph.edges)) if graph.homes is None else home_two_hop_users(graph.across, graph.homes)


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles per user. Edges point from lower to higher (degree, id), which bounds every
    node's out-degree by the square root of twice the edge count."""
    arcs = both_directions(edges.select("view", "a", "b"))
    degree = arcs.groupBy("view", "u").agg(F.count(F.lit(1)).alias("d"))
    ranked = (
        edges.select("view", "a", "b")
        .join(degree.selectExpr("view", "u AS a", "d AS da"), ["view", "a"])
        .join(degree.selectExpr("view", "u AS b", "d AS db"), ["view", "b"])
        .selectExpr(
            "view",
            "if(struct(da, a) < struct(db, b), a, b) AS low",
            "if(struct(da, a) < struct(db, b), struct(db AS d, b AS id), struct(da AS d, a AS id)) AS high",
        )
    )
    wedges = ranked.withColumnRenamed("high", "mid").join(ranked, ["view", "low"]).where("mid < high")
    closing = ranked.selectExpr("view", "low AS mid_id", "high.id AS high_id")
    return (
        wedges.selectExpr("view", "low", "mid.id AS mid_id", "high.id AS high_id")
        .join(closing, ["view", "mid_id", "high_id"])
        .select("view", F.explode(F.expr("array(low, mid_id, high_id)")).alias("user_id"))
        .groupBy("view", "user_id")
        .agg(F.count(F.lit(1)).alias("triangles"))
    )


def home_triangles(across: DataFrame, homes: DataFrame) -> DataFrame:
    """Triangles per user of a projection with ``homes``; only those of three homes are formed one by one.

    All others have an edge at home: three users of one home, or two of one home with a common neighbour elsewhere, which a node's
    number of neighbours per home counts.
    """
    live = homes.select("view", "home", "user_id")
    sizes = live.groupBy("view", "home").agg(F.count(F.lit(1)).alias("n"))
    inside = live.join(sizes, ["view", "home"]).selectExpr("view", "user_id", "(n - 1) * (n - 2) DIV 2 AS triangles")
    arcs = both_directions(across.select("view", "a", "b")).join(live.select("view", F.col("user_id").alias("v"), "home"), ["view", "v"])
    met = arcs.groupBy("view", "u", "home").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    tips = met.selectExpr("view", "u AS user_id", "c * (c - 1) DIV 2 AS triangles")
    feet = arcs.join(met, ["view", "u", "home"]).selectExpr("view", "v AS user_id", "c - 1 AS triangles")
    rows = inside.unionByName(tips).unionByName(feet).unionByName(triangles(across))
    return rows.groupBy("view", "user_id").agg(F.sum("triangles").alias("triangles")).where("triangles > 0")


def view_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("view").agg(F.count(F.lit(1)).alias("n"))


def degree_and_clustering(graph: UserGraph, totals: DataFrame) -> DataFrame:
    """Degree centrality and local clustering, 8 decimals, for every projection node."""
    return (
        graph.nodes.join(totals.select("view", "user_id", "number_of_user_neighbors"), ["view", "user_id"], "left")
        .join(triangles(graph.edges) if graph.homes is None else home_triangles(graph.across, graph.homes), ["view", "user_id"], "left")
        .join(F.broadcast(view_sizes(graph.nodes)), "view")
        .withColumn("d", F.expr("coalesce(number_of_user_neighbors, 0)"))
        .selectExpr(
            "view", "user_id",
            "if(n > 1, round(d / cast(n - 1 AS double), 8), 0D) AS degree_centrality",
            "if(d > 1, round(2 * coalesce(triangles, 0) / cast(d * (d - 1) AS double), 8), 0D) AS clustering_coefficient",
        )
    )


def projection_features(graph: UserGraph) -> DataFrame:
    """All neighbour, sharing and two-hop features for every projection node, missing as 0."""
    totals = graph_totals(graph)
    table = graph.nodes
    for part in (
        totals.drop("incident_total"),
        neighbour_features(both_directions(graph.across), totals, high_degree_threshold(graph.nodes, totals), graph.homes),
        graph_two_hop_users(graph),
    ):
        table = table.join(part, ["view", "user_id"], "left")
    wanted = S.FEATURE_GROUPS["shared_entity"] + S.FEATURE_GROUPS["neighbor"] + S.FEATURE_GROUPS["two_hop"]
    return table.select("view", "user_id", *wanted).na.fill(0)


__all__ = ["COUNTS", "degree_and_clustering", "direct_features", "projection_features", "sharing_totals", "triangles", "two_hop_users"]
