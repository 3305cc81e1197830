"""User-user projection: accounts linked by shared devices, networks, addresses, instruments.

Every table carries ``view``, the name of the graph a row belongs to (one value for the
whole data set, or the split for split-isolated graphs), so several graphs are built by
one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.exprs import present, unpivot_ids
from ringlens.functions.ordered import dense_numbers
from ringlens.session import cut_lineage

WHOLE = "all"
COUNTS = tuple(S.SHARED_COUNTS.values())
PHYSICAL = tuple(c for kind, c in S.SHARED_COUNTS.items() if kind != "promotion")
BLOCK_USERS = 1000
PLACE_PAIRS = 1_000_000  # pairs ranked in one place
COMMON = 64  # promotions kept as bits


@dataclass(frozen=True)
class UserGraph:
    """``edges(view, a, b, five counts, weight, shared_entity_types)`` with a < b;
    ``nodes(view, user_id)`` including isolated users; ``skipped_hubs(view, attr, entity_id, n_users)``."""

    edges: DataFrame
    nodes: DataFrame
    skipped_hubs: DataFrame

    @property
    def homes(self) -> DataFrame | None:
        """``(view, user_id, home, ...)``: users of one home are all linked; None if the graph has only its edges."""
        return None

    @property
    def links(self) -> DataFrame | None:
        """``shared_links`` behind the edges; None if the graph has only its edges."""
        return None

    @property
    def across(self) -> DataFrame:
        """The edges between users of different homes, or all edges of a graph without homes."""
        return self.edges

    def arcs_in_place(self) -> DataFrame:
        """All edges as arcs (u, v) with the counts of physical entities. If there is a column ``place``, the arcs of a user
        share one, and rows lie dealt out by it: a window by place and user moves none of them."""
        return both_directions(self.edges).select("view", "u", "v", *PHYSICAL)

    def arcs_of(self, users: DataFrame) -> DataFrame:
        """The edges of ``users(user_id)`` as arcs (u, v) from them."""
        return both_directions(self.edges).join(users.select(F.col("user_id").alias("u")), "u", "left_semi")

    def stored(self) -> UserGraph:
        """The same graph with edges and nodes written out, for consumers reading them repeatedly."""
        return UserGraph(cut_lineage(self.edges), cut_lineage(self.nodes), self.skipped_hubs)


class ProjectedGraph(UserGraph):
    """A user graph kept as homes and the edges across them, so that nothing is stored or shuffled per pair of a large entity.

    A user's home is its largest entity, ``home(kind, entity)`` by its number. The users of one home are all linked, so their edges follow from the list of them;
    only pairs that share an entity which is not the home of both are formed one by one (``light``). ``edges`` spells all of
    them out anew wherever it is read; sums over neighbours come from the homes and ``across``.
    """

    def __init__(
        self, link: Callable[[], DataFrame], build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], nodes: DataFrame, skipped_hubs: DataFrame,
        people: Callable[[], DataFrame] | None = None,
    ) -> None:
        self.__dict__.update(link=link, build=build, nodes=nodes, skipped_hubs=skipped_hubs, people=people or (lambda: nodes))

    @cached_property
    def links(self) -> DataFrame:
        """The links of users and shared entities, stored when first needed; no pair is formed for them."""
        return self.link()

    @cached_property
    def parts(self) -> tuple[DataFrame, DataFrame]:
        """Homes and light pairs, stored when first needed."""
        return self.build(self.links)

    @property
    def homes(self) -> DataFrame:
        return self.parts[0]

    @cached_property
    def across(self) -> DataFrame:
        return _with_totals(self.parts[1].where("home IS NULL").drop("home"))

    @property
    def extra(self) -> DataFrame:
        """``(view, a, b, four counts)``: the pairs of one home that share other entities too, and how many of these."""
        return self.parts[1].where("home IS NOT NULL").select("view", "a", "b", *[c for kind, c in S.SHARED_COUNTS.items() if kind != "promotion"])

    def accounts_by_kind(self) -> DataFrame:
        """``(view, user_id, one count per kind)``: the neighbours a user shares an entity of each physical kind with; no pair at home is spelled out."""
        homes, light = self.parts
        kinds = {k: c for k, c in S.SHARED_COUNTS.items() if k != "promotion"}
        sizes = homes.groupBy("view", "home").agg((F.count(F.lit(1)) - 1).alias("others"))
        at_home = homes.join(sizes, ["view", "home"]).selectExpr("view", "user_id", *[f"if(home.kind = '{k}', others, 0L) AS {c}" for k, c in kinds.items()])
        # a pair of one home shares its kind already
        more = light.selectExpr("view", "a", "b", *[f"cast({c} > 0 AND NOT home.kind <=> '{k}' AS bigint) AS {c}" for k, c in kinds.items()])
        rows = at_home.unionByName(both_directions(more).withColumnRenamed("u", "user_id").drop("v"))
        return rows.groupBy("view", "user_id").agg(*[F.sum(c).alias(c) for c in kinds.values()])

    @cached_property
    def edges(self) -> DataFrame:
        homes, light = self.parts
        return _with_totals(_home_arcs(homes, homes, light, "a < b")).unionByName(self.across)

    def arcs_of(self, users: DataFrame) -> DataFrame:
        """Only the entities of ``users`` are paired, unless the parts of the whole graph are there: they hold all that these users share."""
        wanted = users.select("user_id").distinct()
        homes, light = self._parts_of(users)
        across = _with_totals(light.where("home IS NULL").drop("home"))
        ends = F.explode(F.expr("array(struct(a AS a, b AS b), struct(b AS a, a AS b))"))
        turned = light.where("home IS NOT NULL").withColumn("_end", ends).withColumns({"a": F.col("_end.a"), "b": F.col("_end.b")}).drop("_end")
        own = _home_arcs(homes.join(wanted, "user_id", "left_semi"), homes, turned, "a <> b")
        rest = both_directions(across).join(wanted.withColumnRenamed("user_id", "u"), "u", "left_semi")
        return _with_totals(own).withColumnsRenamed({"a": "u", "b": "v"}).unionByName(rest)

    def arcs_in_place(self) -> DataFrame:
        """No pair at home is shuffled: it is formed where it is read.

        A place is a share of the users of a home, few enough that their pairs at home number at most ``PLACE_PAIRS``. There meet each of
        these users, with a list of its light pairs, and all users of the home, in lists of about ``BLOCK_USERS``.
        """
        homes, light = self.parts
        sizes = homes.groupBy("view", "home").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.withColumn("shares", F.least(F.ceil(F.col("n") * F.col("n") / PLACE_PAIRS), F.col("n")).cast("int"))
        pairs = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        tasks = max(int(homes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PLACE_PAIRS))
        dealt = homes.select("view", "home", "user_id", "blocks").join(sizes, ["view", "home"])

        at_home = [f"cast({c} + if(home.kind = '{kind}', 1, 0) AS int) AS {c}" for kind, c in S.SHARED_COUNTS.items() if c in PHYSICAL]
        entry = light.select("view", "a", "b", F.col("home").isNotNull().alias("near"), F.struct(*[F.expr(e) for e in at_home]).alias("counts"))
        also = both_directions(entry).groupBy("view", F.col("u").alias("user_id")).agg(F.collect_list(F.struct("v", "near", "counts")).alias("also"))
        sources = dealt.join(also, ["view", "user_id"], "left").select(
            F.struct("view", "home", _block("user_id", "shares").alias("share")).alias("place"), "user_id", F.expr("coalesce(also, array())").alias("also"))
        lists = dealt.groupBy("view", "home", "shares", _block("user_id", "blocks").alias("block")).agg(F.collect_list("user_id").alias("others"))
        first = F.col("block") == F.min("block").over(Window.partitionBy("view", "home"))
        lists = lists.withColumn("first", first).withColumn("share", _every("shares")).select(F.struct("view", "home", "share").alias("place"), "first", "others")
        alone = ", ".join(f"if(place.home.kind = '{kind}', 1, 0) AS {c}" for kind, c in S.SHARED_COUNTS.items() if c in PHYSICAL)
        # the light pairs once, and all others at home
        arcs = (
            "concat(slice(also, 1, if(first, size(also), 0)), transform(array_except(others, array_append(near, user_id)), "
            f"v -> struct(v AS v, false AS near, struct({alone}) AS counts)))"
        )
        met = sources.withColumn("near", F.expr("transform(filter(also, x -> x.near), x -> x.v)")).repartition(tasks, "place").join(
            lists.repartition(tasks, "place"), "place")
        return met.select("place", "user_id", F.explode(F.expr(arcs)).alias("arc")).select(
            "place", "place.view", F.col("user_id").alias("u"), "arc.v", "arc.counts.*")

    def strongest(self, limit: int, users: DataFrame | None = None) -> DataFrame:
        """``(user_id, v, counts, rank)``: the ``limit`` arcs of each user (or of ``users(user_id)``) with most physical entities, then smallest ids.

        Pairs at home that share nothing else all count 1, so of these only the first ``limit + 1`` users of a home can be among them: one may
        be the user itself, and one that shares more comes with its light pair. No other pair at home is formed.
        """
        homes, light = self.parts if users is None else self._parts_of(users)
        names = [c for c in S.SHARED_COUNTS.values() if c in PHYSICAL]
        kinds = {c: kind for kind, c in S.SHARED_COUNTS.items()}
        total = " + ".join(f"counts.{c}" for c in names)
        entry = light.select("view", "a", "b", F.struct(*[F.expr(f"{c} + if(home.kind <=> '{kinds[c]}', 1L, 0L) AS {c}") for c in names]).alias("counts"))
        arcs = both_directions(entry).selectExpr("u AS user_id", "view", f"struct(-({total}) AS falling, v, counts) AS arc", "CAST(NULL AS struct<kind: string, entity: bigint>) AS home")
        own = homes.select("user_id", "view", F.lit(None).cast(arcs.schema["arc"].dataType).alias("arc"), "home")
        asked = arcs.unionByName(own)
        if users is not None:
            asked = asked.join(users.select("user_id").distinct(), "user_id", "left_semi")
        best = Window.partitionBy("user_id", "view").orderBy(F.asc_nulls_first("arc"))
        each = asked.repartition("user_id").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit + 1).groupBy("user_id", "view").agg(
            F.max("home").alias("home"), F.collect_list("arc").alias("arcs"))
        first = Window.partitionBy("view", "home").orderBy("user_id")
        firsts = cut_lineage(homes.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit + 1).groupBy("view", "home").agg(
            F.collect_list("user_id").alias("firsts")))
        alone = ", ".join(f"cast(if(home.kind = '{kinds[c]}', 1, 0) AS bigint) AS {c}" for c in names)
        more = f"transform(array_except(firsts, array_append(transform(arcs, x -> x.v), user_id)), v -> struct(-1L AS falling, v AS v, struct({alone}) AS counts))"
        every = each.join(firsts, ["view", "home"]).select("user_id", F.expr(f"slice(array_sort(concat(arcs, {more})), 1, {limit}) AS arcs"))
        # a user of several views has a list in each
        ranked = every.groupBy("user_id").agg(F.expr(f"slice(array_sort(flatten(collect_list(arcs))), 1, {limit}) AS arcs"))
        return ranked.select("user_id", F.posexplode("arcs").alias("_at", "arc")).selectExpr("user_id", "arc.v", "arc.counts.*", "_at + 1 AS rank")

    def _parts_of(self, users: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Homes and light pairs that hold all the edges of ``users``: of the whole graph if they are there, else of these users' entities."""
        if "parts" in self.__dict__:
            return self.parts
        entity = ["view", "kind", "entity_id"]
        held = self.links.join(users.select("user_id").distinct(), "user_id", "left_semi").select(*entity).distinct()
        return self.build(self.links.join(held, entity, "left_semi"))

    def stored(self) -> UserGraph:
        return ProjectedGraph(lambda: self.links, lambda _: self.parts, cut_lineage(self.people()), self.skipped_hubs)


def single_view(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("view", F.lit(WHOLE))


def split_views(transactions: DataFrame, users: DataFrame) -> DataFrame:
    """Transactions tagged with their user's split."""
    return transactions.join(users.select("user_id", F.col("split").alias("view")), "user_id")


def entity_users(transactions: DataFrame, others: dict[str, str] | None = None) -> DataFrame:
    """Distinct (view, kind, entity_id, user_id) for the four linking kinds and ``others`` (column by kind), blanks dropped."""
    return _entity_uses(transactions, others).distinct()


def _entity_uses(transactions: DataFrame, others: dict[str, str] | None = None) -> DataFrame:
    columns = {kind: column for kind, (column, *_) in S.ENTITY_KINDS.items()} | (others or {})
    item = unpivot_ids(columns, value="entity_id").alias("item")
    return transactions.select("view", "user_id", item).select("view", "item.kind", "item.entity_id", "user_id").where(present("entity_id"))


def shared_links(uses: DataFrame) -> DataFrame:
    """``(view, kind, entity_id, user_id, n, low, entity)``: the distinct links of entities with n > 1 users; ``low`` is the smallest
    other user, ``entity`` a number of the entity that holds within what the caller stores.

    Dealt out by entity once: repeats go, users are counted and the two smallest found where an entity's rows lie. The exchange
    leaves out the view: a constant one would be folded away below it, and the steps above would then exchange the rows anew.
    """
    entity = ["view", "kind", "entity_id"]
    users = Window.partitionBy(*entity).orderBy("user_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = uses.where("view IS NOT NULL AND user_id IS NOT NULL").select(*entity, "user_id").repartition("kind", "entity_id").distinct()
    return known.withColumn("_row", F.monotonically_increasing_id()).withColumns({
        "n": F.count(F.lit(1)).over(users), "_first": F.min("user_id").over(users), "_second": F.nth_value("user_id", 2).over(users),
        "entity": F.min("_row").over(users),
    }).where("n > 1").selectExpr(*entity, "user_id", "n", "if(user_id = _first, _second, _first) AS low", "entity")


def hub_entities(members: DataFrame, hub_cap: int | None) -> DataFrame:
    """Entities used by more than ``hub_cap`` users, which link nobody; without a cap there are none."""
    sizes = members.groupBy("view", "kind", "entity_id").agg(F.count(F.lit(1)).alias("n_users"))
    return sizes.where(F.lit(False) if hub_cap is None else F.col("n_users") > hub_cap)


def _promo_sets(used: DataFrame) -> DataFrame:
    """``(view, user_id, common, rare)``: a user's promotions as a bit mask of the ``COMMON`` most used ones and a list of the numbers of others."""
    uses = used.groupBy("entity_id").agg((-F.count(F.lit(1))).alias("_uses"))
    numbers = dense_numbers(uses, ["_uses", "entity_id"], "number").select("entity_id", "number")
    return used.join(numbers, "entity_id").groupBy("view", "user_id").agg(
        F.expr(f"bit_or(if(number < {COMMON}, shiftleft(1L, cast(number AS int)), 0L)) AS common"),
        F.expr(f"collect_list(if(number >= {COMMON}, number, NULL)) AS rare"),
    )


def _shared(left: str, right: str) -> str:
    """Number of promotions in both of two sets ``(common, rare)``."""
    return (
        f"bit_count({left}.common & {right}.common) + "
        f"if(size({left}.rare) > 0 AND size({right}.rare) > 0, size(array_intersect({left}.rare, {right}.rare)), 0)"
    )


def shared_promotions(edges: DataFrame | UserGraph, transactions: DataFrame) -> DataFrame:
    """Number of promotions used by both ends of each existing edge (edges without any are absent).

    The pairs of a user graph of these ``transactions`` are counted as they are formed, so none is shuffled to be looked up.
    """
    if isinstance(edges, UserGraph):
        return edges.edges.select("view", "a", "b", S.SHARED_COUNTS["promotion"]).where(F.col(S.SHARED_COUNTS["promotion"]) > 0)
    sets = _promo_sets(transactions.where(present("promo_id")).selectExpr("view", "user_id", "promo_id AS entity_id").distinct())
    ends = [sets.select("view", F.col("user_id").alias(end), F.struct("common", "rare").alias(f"_p{end}")) for end in ("a", "b")]
    return (
        edges.select("view", "a", "b").join(ends[0], ["view", "a"]).join(ends[1], ["view", "b"])
        .selectExpr("view", "a", "b", f"cast({_shared('_pa', '_pb')} AS bigint) AS shared_promotion_count").where("shared_promotion_count > 0")
    )


def _block(user: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(user), F.col(blocks)).cast("int")


def _every(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def _blocks_of(n: Column) -> Column:
    return F.ceil(n / BLOCK_USERS).cast("int")


def _homes_and_light(sized: DataFrame, used: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``homes(view, user_id, home, promos, blocks)`` and ``light(view, a, b, home, counts)`` of ``shared_links`` and distinct promotion uses.

    A light pair shares an entity that is not the home of both; its ``home`` is the one both have, or null. It counts only such entities.
    """
    kinds = {k: c for k, c in S.SHARED_COUNTS.items() if k != "promotion"}
    chosen = _with_homes(sized)
    if used is not None:
        chosen = chosen.join(_promo_sets(used), ["view", "user_id"], "left")
    else:
        chosen = chosen.withColumns({"common": F.lit(0).cast("bigint"), "rare": F.array().cast("array<bigint>")})
    promos = F.struct(F.expr("coalesce(common, 0L) AS common"), F.expr("coalesce(rare, array()) AS rare"))
    links = cut_lineage(chosen.withColumn("promos", promos).drop("common", "rare"))

    at_home = links.where("at_home").select("view", "user_id", "home", "promos")
    homes = cut_lineage(at_home.join(at_home.groupBy("view", "home").agg(_blocks_of(F.count(F.lit(1))).alias("blocks")), ["view", "home"]))

    light = _light_pairs(links).selectExpr(
        "view", "kind", "least(x.user_id, y.user_id) AS a", "greatest(x.user_id, y.user_id) AS b",
        "if(x.home = y.home, x.home, NULL) AS home", f"{_shared('x.promos', 'y.promos')} AS promos",
    ).groupBy("view", "a", "b", "home").agg(
        *[F.expr(f"count_if(kind = '{kind}') AS {name}") for kind, name in kinds.items()],
        F.max("promos").cast("bigint").alias(S.SHARED_COUNTS["promotion"]))
    return homes, cut_lineage(light)


_SIDE = ("user_id", "home", "promos", "at_home")


def _with_homes(sized: DataFrame) -> DataFrame:
    """``sized`` links with the home of each user and whether the link is to it."""
    top = F.max(F.struct("n", "kind", "entity")).over(Window.partitionBy("view", "user_id"))
    chosen = sized.select("view", "kind", "entity", "user_id", "n").withColumn("_top", top).withColumn("home", F.struct("_top.kind", "_top.entity")).drop("_top")
    return chosen.withColumn("at_home", F.expr("entity = home.entity"))


def _light_pairs(links: DataFrame) -> DataFrame:
    """``(view, kind, x, y)``: every two users of an entity that is not the home of both, once."""
    pairs = _few(links.where(F.col("n") <= BLOCK_USERS)).unionByName(_many(links.where(F.col("n") > BLOCK_USERS)))
    return pairs.where("x.at_home OR x.user_id < y.user_id")


def _few(links: DataFrame) -> DataFrame:
    """``(view, kind, x, y)``: every user x of an entity with every user y away from home there, for entities of at most ``BLOCK_USERS``."""
    entity = ["view", "kind", "entity"]
    lists = links.select(*entity, F.struct(*_SIDE).alias("x")).repartition(*entity).groupBy(*entity).agg(F.collect_list("x").alias("_all"))
    away = F.filter("_all", lambda y: ~y["at_home"])
    return lists.withColumn("_away", away).where("size(_away) > 0").select("view", "kind", "_all", F.explode("_away").alias("y")).select(
        "view", "kind", F.explode("_all").alias("x"), "y")


def _many(links: DataFrame) -> DataFrame:
    """The same for larger entities, by blocks of users that meet under keys of their own."""
    entity = ["view", "kind", "entity"]
    away = links.where("NOT at_home")
    halves = links.join(away.groupBy(*entity).agg(F.count(F.lit(1)).alias("_away")), entity).withColumns(
        {"_rows": _blocks_of(F.col("n")), "_columns": _blocks_of(F.col("_away"))})
    left = halves.select(*entity, F.struct(*_SIDE).alias("x"), _block("user_id", "_rows").alias("_i"), _every("_columns").alias("_j"))
    right = halves.where("NOT at_home").select(*entity, F.struct(*_SIDE).alias("y"), _every("_rows").alias("_i"), _block("user_id", "_columns").alias("_j"))
    return left.join(right, [*entity, "_i", "_j"]).select("view", "kind", "x", "y")


def edge_counts(uses: DataFrame) -> DataFrame:
    """``(view, n_edges)``: distinct pairs of users that share an entity in each view (of any type) of ``uses(view, kind, entity_id, user_id)``.

    The users of one home are counted by its size; only light pairs are formed.
    """
    homes, light = _homes_and_light(cut_lineage(shared_links(uses).drop("low")), None)
    at_home = homes.groupBy("view", "home").agg(F.count(F.lit(1)).alias("n")).selectExpr("view", "n * (n - 1) DIV 2 AS n_edges")
    rows = at_home.unionByName(light.where("home IS NULL").selectExpr("view", "1L AS n_edges"))
    return rows.groupBy("view").agg(F.sum("n_edges").alias("n_edges")).where("n_edges > 0")


def crossing_edges(links: DataFrame, tags: DataFrame) -> DataFrame:
    """``(view, n)``: the edges of ``shared_links`` between users of different ``tags(user_id, tag)``, in views that have any.

    A user may have several tags or none (a null tag); an edge counts once per two rows of its ends that differ. Users of one home are
    counted by tag, and only light pairs that differ are shuffled.
    """
    return _edge_rows(links, tags, ["user_id"], crossing=True)


def edge_rows(links: DataFrame, rows: DataFrame) -> DataFrame:
    """``(view, n)``: the edges of ``shared_links``, each once per two rows of its ends in ``rows(view, user_id)``; users without a row count once."""
    return _edge_rows(links, rows.select("view", "user_id", F.lit("").alias("tag")), ["view", "user_id"], crossing=False)


def _edge_rows(links: DataFrame, tags: DataFrame, key: list[str], *, crossing: bool) -> DataFrame:
    marks = tags.groupBy(*key, "tag").agg(F.count(F.lit(1)).alias("copies")).groupBy(*key).agg(F.collect_list(F.struct("tag", "copies")).alias("marks"))
    none = F.array(F.struct(F.lit(None).cast(tags.schema["tag"].dataType).alias("tag"), F.lit(1).cast("bigint").alias("copies")))
    tagged = cut_lineage(_with_homes(links).join(marks, key, "left").withColumn("promos", F.coalesce("marks", none)).drop("marks"))

    home = ["view", "home"]
    people = tagged.where("at_home").select(*home, "promos", F.expr("aggregate(promos, 0L, (n, p) -> n + p.copies) AS rows"))
    at_home = people.groupBy(*home).agg(F.expr("sum(rows) * sum(rows) - sum(rows * rows) AS twice"))
    if crossing:
        alike = people.select(*home, F.explode("promos").alias("p")).groupBy(*home, "p.tag").agg(
            F.expr("sum(p.copies) * sum(p.copies) - sum(p.copies * p.copies) AS alike")).groupBy(*home).agg(F.sum("alike").alias("alike"))
        at_home = at_home.join(alike, home).withColumn("twice", F.col("twice") - F.col("alike"))
    counts = "if(p.tag <=> q.tag, 0L, p.copies * q.copies)" if crossing else "p.copies * q.copies"
    away = _light_pairs(tagged).where("NOT x.home = y.home").selectExpr(
        "view", "least(x.user_id, y.user_id) AS a", "greatest(x.user_id, y.user_id) AS b",
        f"aggregate(x.promos, 0L, (n, p) -> n + aggregate(y.promos, 0L, (m, q) -> m + {counts})) AS n").where("n > 0")
    rows = at_home.selectExpr("view", "twice DIV 2 AS n").unionByName(away.groupBy("view", "a", "b").agg(F.max("n").alias("n")).select("view", "n"))
    return rows.groupBy("view").agg(F.sum("n").alias("n")).where("n > 0")


def _home_arcs(sources: DataFrame, homes: DataFrame, light: DataFrame, which: str) -> DataFrame:
    """``(view, a, b, counts)`` from each of ``sources`` to the users of its home, as far as ``which`` (on a, b) allows.

    What two of them share besides the home comes along with a, from ``light`` of the same home, by the block of b. The users of a
    home are dealt into hash blocks of about ``BLOCK_USERS``, and every two blocks meet under a key of their own: a large home's pairs
    spread over as many tasks as it has pairs of blocks, and go through no shuffle themselves.
    """
    kinds = {k: c for k, c in S.SHARED_COUNTS.items() if k != "promotion"}
    blocks = homes.select("view", "home", "blocks").distinct()
    more = (
        light.where("home IS NOT NULL").join(blocks, ["view", "home"]).withColumn("_j", _block("b", "blocks"))
        .groupBy("view", "a", "_j").agg(F.collect_list(F.struct("b", *kinds.values())).alias("_more"))
    )
    left = sources.select("view", "home", F.col("user_id").alias("a"), F.col("promos").alias("_pa"), _block("user_id", "blocks").alias("_i"), _every("blocks").alias("_j"))
    right = homes.select("view", "home", F.col("user_id").alias("b"), F.col("promos").alias("_pb"), _every("blocks").alias("_i"), _block("user_id", "blocks").alias("_j"))
    pairs = left.join(more, ["view", "a", "_j"], "left").join(right, ["view", "home", "_i", "_j"]).where(which)
    return pairs.withColumn("_also", F.expr("get(filter(_more, m -> m.b = b), 0)")).selectExpr(
        "view", "a", "b",
        *[f"coalesce(_also.{name}, 0L) + if(home.kind = '{kind}', 1L, 0L) AS {name}" for kind, name in kinds.items()],
        f"cast({_shared('_pa', '_pb')} AS bigint) AS {S.SHARED_COUNTS['promotion']}",
    )


def _with_totals(edges: DataFrame) -> DataFrame:
    return edges.selectExpr(
        "view", "a", "b", *COUNTS,
        f"{' + '.join(COUNTS)} AS weight",
        " + ".join(f"cast({c} > 0 AS int)" for c in COUNTS) + " AS shared_entity_types",
    )


def project_users(transactions: DataFrame, users: DataFrame | None = None, *, hub_cap: int | None = None) -> UserGraph:
    """Build the projection of ``transactions`` (with a ``view`` column).

    ``users(view, user_id)`` adds isolated users to the node set. Every entity links its users
    unless the caller sets ``hub_cap``; entities above it then leave before pairs are formed and
    are listed in ``skipped_hubs``.
    """
    hubs = hub_entities(entity_users(transactions), hub_cap)

    @cache
    def kept() -> DataFrame:
        """What links and promotions need of the transactions, stored when first needed."""
        return cut_lineage(transactions.select("view", "user_id", *[column for column, *_ in S.ENTITY_KINDS.values()], "promo_id"))

    def link() -> DataFrame:
        uses = _entity_uses(kept())
        capped = hub_entities(uses.distinct(), hub_cap)
        return cut_lineage(shared_links(uses if hub_cap is None else uses.join(capped, ["view", "kind", "entity_id"], "left_anti")))

    def build(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        used = kept().where(present("promo_id")).selectExpr("view", "user_id", "promo_id AS entity_id").distinct()
        return _homes_and_light(links, cut_lineage(used))

    def people() -> DataFrame:
        return (users if users is not None else kept().select("view", "user_id")).select("view", "user_id").distinct()

    nodes = (users if users is not None else transactions).select("view", "user_id").distinct()
    return ProjectedGraph(link, build, nodes, hubs.withColumnRenamed("kind", "attr"), people)


def lowest_neighbours(graph: UserGraph) -> DataFrame:
    """``(view, user_id, low)``: the smallest id among a user's neighbours; users without any are absent.

    Links know the smallest other user of their entity, so no pair is formed where there are any.
    """
    if graph.links is not None:
        return graph.links.groupBy("view", "user_id").agg(F.min("low").alias("low"))
    return both_directions(graph.edges.select("view", "a", "b")).groupBy("view", F.col("u").alias("user_id")).agg(F.min("v").alias("low"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each undirected edge as (u, v) and (v, u), all other columns kept."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    ends = F.explode(F.expr("array(struct(a AS u, b AS v), struct(b AS u, a AS v))")).alias("end")
    return edges.select(ends, *rest).select("end.u", "end.v", *rest)
