"""Bootstrap replicates of the metrics of scored users, all replicates side by side.

Resampling n of n rows gives each row a nearly Poisson(1) multiplicity. It is read off a hash of (user, replicate), so it
survives task retries. Users are cut into ranges of descending score once; a task draws the multiplicities of a few hundred rows
and all replicates as one matrix, and what is exchanged is a row per range and replicate: the counts of the ranges before
give the running totals their offsets. Rows never multiply by replicates outside a task, and a task holds no range as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no package of ours

MOST_RANGES = 500  # bounds what is sent to the tasks: ranges x replicates counts
ROWS = 256  # rows of a matrix


def poisson_edges() -> np.ndarray:
    """Cumulative Poisson(1) probabilities up to the point where doubles stop growing."""
    edges, term, total, k = [], 2.718281828459045 ** -1, 0.0, 0
    while total + term > total and k < 15:
        total += term
        edges.append(total)
        k += 1
        term /= k
    return np.array(edges)


def multiplicities(keys: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row (a 64-bit hash of its user) is drawn in each replicate: rows x replicates."""
    v = keys.view(np.uint64)[:, None] ^ (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    v ^= v >> np.uint64(31)
    chance = ((v >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.searchsorted(poisson_edges(), chance, "right").astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for first in range(0, batch.num_rows, ROWS):
        part = batch.slice(first, ROWS)
        yield tuple(part.column(c).to_numpy() for c in ("range", "key", "label", "prob"))


def bootstrap_metrics(scored: DataFrame, threshold: float, *, replicates: int = 500, seed: int = 42) -> DataFrame:
    """Precision, recall, F1, PR-AUC and ROC-AUC of every bootstrap replicate of ``scored(user_id, label, prob)``.

    Rows without a label or score are left out; areas are null where a replicate has one class only.
    """
    spark = scored.sparkSession
    ranges = min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = scored.where("prob IS NOT NULL AND label IS NOT NULL").select(
        F.xxhash64("user_id", F.lit(seed)).alias("key"), F.col("label").cast("int").alias("label"), F.col("prob").cast("double").alias("prob"))
    ranged = cut_lineage(rows.repartitionByRange(ranges, F.desc("prob")).withColumn("range", F.spark_partition_id()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for own, keys, label, prob in _parts(batch):
                drawn = multiplicities(keys, replicates)
                for r in np.unique(own):
                    here = own == r
                    kinds = [here & (label == 1), here & (label != 1), here & (label == 1) & (prob >= threshold), here & (label != 1) & (prob >= threshold)]
                    sums[int(r)] = sums.get(int(r), 0) + np.stack([drawn[k].sum(axis=0) for k in kinds])
        for r, table in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, r, np.int32)), pa.array(np.arange(replicates, dtype=np.int32)),
                                              *(pa.array(line) for line in table)], names=["range", "replicate", "pos", "neg", "tp", "fp"])

    names = ("pos", "neg", "tp", "fp")
    counts = ranged.mapInArrow(count, "range int, replicate int, pos bigint, neg bigint, tp bigint, fp bigint").groupBy("range", "replicate").agg(
        *[F.sum(n).alias(n) for n in names]).toArrow()  # ranges x replicates rows
    cube = np.zeros((4, ranges + 1, replicates), dtype=np.int64)
    for table, name in zip(cube, names):
        table[counts.column("range").to_numpy() + 1, counts.column("replicate").to_numpy()] = counts.column(name).to_numpy()
    before = cube[:2].cumsum(axis=1)  # of the ranges before each range
    n_pos, n_neg, tp, fp = cube.sum(axis=1)
    offsets = spark.sparkContext.broadcast((before, n_pos, n_neg))

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range and falling score; counts of a score that goes on in the next matrix wait for it."""
        before, n_pos, n_neg = offsets.value
        roc, pr = np.zeros(replicates), np.zeros(replicates)
        current, score, waiting = None, None, None
        cum_pos = cum_neg = None

        def settle(pos: np.ndarray, neg: np.ndarray) -> None:
            """Add scores (rows) x replicates, highest first."""
            nonlocal cum_pos, cum_neg, roc, pr
            upto_pos, upto_neg = cum_pos + pos.cumsum(axis=0), cum_neg + neg.cumsum(axis=0)
            roc = roc + (pos * (n_neg - upto_neg + neg / 2.0)).sum(axis=0)
            pr = pr + (pos * upto_pos / np.maximum(upto_pos + upto_neg, 1)).sum(axis=0)
            cum_pos, cum_neg = upto_pos[-1], upto_neg[-1]

        for batch in batches:
            for own, keys, label, prob in _parts(batch):
                drawn = multiplicities(keys, replicates)
                begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (prob[1:] != prob[:-1])]))
                pos, neg = (np.add.reduceat(drawn * (label == 1)[:, None] if k else drawn * (label != 1)[:, None], begins, axis=0) for k in (1, 0))
                firsts = np.flatnonzero(np.concatenate([[True], own[begins][1:] != own[begins][:-1]]))  # scores that begin a stretch of one range
                for a, b in zip(firsts, [*firsts[1:], len(begins)]):
                    r = int(own[begins[a]])
                    ps, ns = pos[a:b], neg[a:b]
                    if r == current and score == prob[begins[a]]:
                        ps, ns = ps.copy(), ns.copy()
                        ps[0] += waiting[0]
                        ns[0] += waiting[1]
                    elif waiting is not None:
                        settle(waiting[0][None], waiting[1][None])
                    if r != current:
                        current, cum_pos, cum_neg = r, before[0, r], before[1, r]
                    if len(ps) > 1:
                        settle(ps[:-1], ns[:-1])
                    waiting, score = (ps[-1], ns[-1]), prob[begins[b - 1]]
        if waiting is not None:
            settle(waiting[0][None], waiting[1][None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(roc), pa.array(pr)], names=["replicate", "roc", "pr"])

    parts = ranged.repartition(ranges, "range").sortWithinPartitions("range", F.desc("prob")).mapInArrow(areas, "replicate int, roc double, pr double")
    summed = parts.groupBy("replicate").agg(F.sum("roc").alias("roc"), F.sum("pr").alias("pr"))
    totals = spark.createDataFrame(pa.table({"replicate": np.arange(replicates, dtype=np.int32), "n_pos": n_pos, "n_neg": n_neg, "tp": tp, "fp": fp}))
    return totals.join(F.broadcast(summed), "replicate").selectExpr(  # a row per replicate
        "replicate + 1 AS replicate", "if(tp + fp > 0, tp / (tp + fp), 0D) AS precision", "if(n_pos > 0, tp / n_pos, 0D) AS recall",
        "if(tp + fp + n_pos > 0, 2 * tp / (tp + fp + n_pos), 0D) AS f1",
        "pr / nullif(n_pos, 0) AS pr_auc", "roc / nullif(cast(n_pos AS double) * n_neg, 0D) AS roc_auc")
