"""Mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) take the weights in turn, share ``volume`` times all words in
proportion to them, and stop at ``most`` times their own words; what is cut off is shared again by weight among
the others until no target is above its stop.

Rates: document i of a source gets the rate r_i = min(most, exp(l * n_i / mean n)): the distribution closest to
"every document once" in relative entropy under the source's constraint sum(n_i r_i) = target and the bound on
rates. The multiplier l of each source minimises a convex dual; all sources take Newton steps together, one
aggregation over the counts of (source, size) per step, kept inside a bracket that every step narrows.

Copies: a document is taken floor(r_i + u_i + shift) times, between 0 and ``most``, with u_i uniform from a hash
of its id, its text and, among rows that agree in both, their number. The shift of each source is found by three rounds of histograms, once for all its documents and once more for
those up to the mean size, so that where ids differ the words taken miss the target by about half a small document.
Nothing is random: reruns agree.

Null texts have size 0, null ids hash as such, repeated rows are documents of their own, extra columns are ignored; a
source without words keeps its documents once (nothing is taken from them); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringlens.llm.store import cut_lineage, free_names, row_hash
from ringlens.llm.words import Words, text_slices

WEIGHTS = (3.0, 1.0, 2.0)
VOLUME = 1.5
MOST = 2
BINS = 1024
LOT = 10_000  # repeated rows dealt out by one task


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text), text_key, u (uniform in [0, 1)): one row per document.

    Rows of one id, source and text are counted before they are numbered, so a document repeated by a third of all rows
    is a number of each task until its copies are dealt out in lots.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sizes = np.diff(Words(batch.column("text")).first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "source", "text_key")] + [pa.array(sizes)],
                                             names=["doc_id", "source", "text_key", "size"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), text_key(), F.col("text").cast("string")) \
        .mapInArrow(of, "doc_id bigint, source string, text_key string, size bigint")
    counted = cut_lineage(rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("rows")))
    lots = counted.where("rows > 1").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) DIV {LOT}")))) \
        .repartition("text_key", "lot").withColumn("number", F.explode(F.sequence(
            F.col("lot") * LOT, F.least((F.col("lot") + 1) * LOT, "rows") - 1))).drop("lot", "rows")
    single = counted.where("rows = 1").select("doc_id", "source", "text_key", "size", F.lit(0).cast("bigint").alias("number"))
    u = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_key", "number", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    return cut_lineage(single.union(lots).select("doc_id", "source", "size", "text_key", u.alias("u")))


def text_key() -> Column:
    """Two 64-bit hashes of the text; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.concat_ws(":", *[F.hex(F.xxhash64(F.lit(seed), text)) for seed in (1, 2)]).alias("text_key")


def share_targets(sizes: DataFrame, weights=WEIGHTS, volume: float = VOLUME, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row per source.

    A target is min(most * size, weight * level) with one level for all sources, so the level is read off
    the sources in order of size / weight; both windows run over one row per source.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")))
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    pick = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pick + 1).cast("int")))
    weighted = weighted.withColumn("stop", most * F.col("source_size").cast("double")).withColumn("full_at", F.col("stop") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    stepped = weighted.withColumn("rank", F.row_number().over(by_level)).withColumn("wanted", volume * F.sum("source_size").over(everything)) \
        .withColumn("stopped", F.coalesce(F.sum("stop").over(before), F.lit(0.0))) \
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source that is not full at the level of those from here on sets the level
    open_level = (F.col("wanted") - F.col("stopped")) / F.col("open")
    level = F.min_by(open_level, F.when(open_level <= F.col("full_at"), F.col("rank"))).over(everything)
    return stepped.withColumn("level", level).select(
        "source", "source_size", "documents",
        F.when(F.col("level").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("weight") * F.col("level"))).alias("target"))


def _rate(multiplier: Column, x: Column, most: int) -> Column:
    return F.exp(F.least(multiplier * x, F.lit(math.log(most))))


def solve_rates(sizes: DataFrame, targets: DataFrame, most: int = MOST, tolerance: float = 1e-9, max_steps: int = 100) -> DataFrame:
    """targets with the multiplier of each source (null where all documents are taken ``most`` times)."""
    counts = cut_lineage(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    mean = F.col("source_size") / F.col("documents")
    state = cut_lineage(targets.where("source_size > 0").withColumn("mean", mean)
                        .withColumn("multiplier", F.lit(0.0)).withColumn("low", F.lit(None).cast("double"))
                        .withColumn("high", F.lit(None).cast("double")).withColumn("done", F.col("target") >= most * F.col("source_size") * (1 - 1e-12)))
    step = 0
    while not state.where("NOT done").isEmpty():
        step += 1
        if step > max_steps:
            raise RuntimeError(f"the dual did not converge in {max_steps} steps")
        active = state.where("NOT done").select(F.col("source").alias("s"), "multiplier", "mean")
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), x, most)
        sums = counts.join(active, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate)).alias("slope"))
        gap = F.col("taken") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("low", low).withColumn("high", high)
        newton = F.col("multiplier") - gap / F.nullif("slope", F.lit(0.0))
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, 2 * F.abs(F.col("low")) + 1, -2 * F.abs(F.col("high")) - 1)
        # a full step is at most 4: further out the dual is far from its quadratic
        near = F.abs(newton - F.col("multiplier")) <= 4
        ended = F.col("done") | (F.abs(gap) <= tolerance * F.greatest("target", F.lit(1.0))) | \
            ((F.col("high") - F.col("low")) <= 1e-14 * F.greatest(F.abs("high"), F.lit(1.0)))
        fallback = F.when(~near & F.col("high").isNull(), F.col("multiplier") + 4).when(
            ~near & F.col("low").isNull(), F.col("multiplier") - 4).otherwise(middle)
        state = cut_lineage(moved.select(
            "source", "source_size", "documents", "target", "mean",
            F.when(ended, F.col("multiplier")).otherwise(
                F.when(newton.isNotNull() & inside & near, newton).otherwise(fallback)).alias("multiplier"),
            "low", "high", F.coalesce(ended, F.lit(False)).alias("done")))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    return state.select("source", "mean", F.when(~full, F.col("multiplier")).alias("multiplier"))


def mix(docs: DataFrame, weights=WEIGHTS, volume: float = VOLUME, most: int = MOST) -> DataFrame:
    """doc_id, source, text_key, size, source_size, target, rate, copies, taken: one row per document."""
    sizes = sized(docs)
    targets = cut_lineage(share_targets(sizes, weights, volume, most))
    solved = solve_rates(sizes, targets, most)
    plan = cut_lineage(targets.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    rate = F.when(F.col("source_size") == 0, 1.0).when(full, float(most)).otherwise(
        _rate(F.col("multiplier"), F.col("size") / F.col("mean"), most))
    with_plan = sizes.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rated = cut_lineage(with_plan.withColumn("rate", rate).select(
        "doc_id", "source", "text_key", "size", "source_size", "documents", "target", "rate", (F.col("rate") + F.col("u")).alias("place")))
    # first all documents, then those up to the mean size again, to place what one large document leaves over
    rounded = _round(rated.withColumns({"free": (F.col("rate") < most) & (F.col("size") > 0),
                                        "copies": F.when(F.col("rate") >= most, most).otherwise(1).cast("bigint")}), targets, most)
    small = F.col("free") & (F.col("size") * F.col("documents") <= F.col("source_size"))
    rounded = _round(cut_lineage(rounded.withColumn("free", small)), targets, most)
    return rounded.select("doc_id", "source", "text_key", "size", "source_size", "target", "rate", "copies",
                          (F.col("copies") * F.col("size")).alias("taken"))


def _round(rated: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """``rated`` with new copies for its free rows."""
    shifts = _shifts(rated, targets, most).withColumnRenamed("source", "s")
    shifted = rated.join(shifts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    copies = F.least(F.greatest(F.floor(F.col("place") + F.coalesce("shift", F.lit(0.0))), F.lit(0)), F.lit(most)).cast("bigint")
    return shifted.withColumn("copies", F.when(F.col("free"), copies).otherwise(F.col("copies"))).drop("shift")


def _shifts(rated: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Per source, the shift in [-1, 1] of its free rows at which the words taken come nearest to the target.

    A document gains a copy where the shift passes k - place; the words gained per bin of that value are summed, and
    the bin in which the running total passes the target is divided again.
    """
    fixed = rated.where("NOT free").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("fixed"))
    state = targets.where("source_size > 0").join(fixed.withColumnRenamed("source", "f"), F.col("source").eqNullSafe(F.col("f")), "left") \
        .select("source", (F.col("target") - F.coalesce("fixed", F.lit(0))).alias("missing"), F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"))
    gains = rated.where("free").select("source", "size", F.explode(F.array(*[F.lit(float(k)) for k in range(1, most + 1)])).alias("k"), "place") \
        .select("source", "size", (F.col("k") - F.col("place")).alias("at"))
    below = gains.where("at <= -1").groupBy("source").agg(F.sum("size").alias("below"))
    state = cut_lineage(state.join(below.withColumnRenamed("source", "b"), F.col("source").eqNullSafe(F.col("b")), "left").select(
        "source", (F.col("missing") - F.coalesce("below", F.lit(0))).alias("missing"), "low", "high"))
    gains = gains.where("at > -1 AND at <= 1")
    for _ in range(3):
        width = (F.col("high") - F.col("low")) / BINS
        place = F.least(F.floor((F.col("at") - F.col("low")) / width), F.lit(BINS - 1))
        inside = gains.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("at > low AND at <= high")
        bins = inside.groupBy("source", place.alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        walked = bins.withColumn("upto", upto)
        joined = state.withColumnRenamed("source", "s").join(walked, F.col("s").eqNullSafe(F.col("source")), "left")
        passing = F.col("upto") <= F.col("missing")
        edge = F.coalesce(F.min(F.when(F.col("upto") > F.col("missing"), F.col("bin"))), F.lit(BINS - 1))
        state = cut_lineage(joined.groupBy("s", "missing", "low", "high").agg(
            edge.alias("edge"), F.coalesce(F.max(F.when(passing, F.col("upto"))), F.lit(0)).alias("passed"),
            F.min(F.when(F.col("upto") > F.col("missing"), F.col("upto"))).alias("over")).select(
            F.col("s").alias("source"), (F.col("missing") - F.col("passed")).alias("missing"),
            (F.col("low") + F.col("edge") * width).alias("low"), (F.col("low") + (F.col("edge") + 1) * width).alias("high"),
            (F.col("over") - F.col("passed")).alias("next")))
    # the last bin holds one document where hashes differ: take it if that comes nearer
    return state.select("source", F.when(F.col("next") < 2 * F.col("missing"), F.col("high")).otherwise(F.col("low")).alias("shift"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns, whatever these are called.

    The words delivered are those of ``mix``: where rows agree in id, source and text, the copies of all of them are
    dealt out among them in the order of a hash of the whole row. Rows without words are taken once, null sources are a
    source, an empty table stays empty.
    """
    copies = mix(docs).groupBy("doc_id", "source", "text_key").agg(F.sum("copies").alias("copies"))
    row, number, lot = free_names(docs, "_row", "_number", "_lot")
    id_, source = F.col("doc_id").cast("bigint"), F.col("source").cast("string")
    kinds = cut_lineage(docs.select(id_.alias("d"), source.alias("s"), text_key().alias("k"), row_hash(docs).alias("h"))
                        .groupBy("d", "s", "k", "h").agg(F.count("*").alias("n")))
    # identical rows stand for one another: each kind of row gets the copies of its stretch of the n rows
    upto = Window.partitionBy("d", "s", "k").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = kinds.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("d", "s", "k")))
    dealt = ranged.join(copies, F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("k") == F.col("text_key"))) \
        .select(F.col("h").alias("wanted"), F.expr("(copies * upto) DIV all - (copies * (upto - n)) DIV all").alias("quota")).where("quota > 0")
    # a row of very many copies joins as several lots, which Spark may split
    wanted = dealt.select(F.col("wanted").alias(row), F.col("quota").alias(number)) \
        .withColumn(lot, F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(`{number}` - 1) DIV {LOT}"))))
    first = docs.withColumn(row, row_hash(docs)).dropDuplicates([row])
    joined = first.join(wanted, row).withColumn(number, F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.least(F.col(number) - F.col(lot) * LOT, F.lit(LOT)))))
    return joined.select([F.col(f"`{c}`") for c in docs.columns])
