"""Exact path-dependent Shapley attributions of a boosted model.

A leaf with d distinct features on its path is a product game: feature i contributes 1 or 0
("the row satisfies the path's splits on i") when present and its cover ratio when absent.
The Shapley values of all 2^d satisfaction patterns are tabulated per leaf once; scoring a
row is then one table lookup per leaf. Leaves are few (trees x 2^depth), so they travel with
the task, while the rows stay partitioned in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.operators.boosting import BoostedModel


@dataclass(frozen=True)
class Leaf:
    features: tuple[int, ...]
    low: np.ndarray
    high: np.ndarray
    table: np.ndarray  # (2^d, d): attributions by satisfaction pattern
    base: float


def _leaf_tables(values: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Attributions ``(leaf, pattern, feature)`` of leaves that have ``d`` features each.

    The worth of a coalition of ``size`` others is a coefficient of the polynomial
    ``prod (ratio + held * t)`` over those others, so each feature needs ``d - 1`` products.
    """
    d = ratios.shape[1]
    held = ((np.arange(2**d)[:, None] >> np.arange(d)) & 1).astype(float)
    tables = np.zeros((len(values), 2**d, d))
    shares = [factorial(size) * factorial(d - size - 1) / factorial(d) for size in range(d)]
    for i in range(d):
        worth = np.zeros((len(values), 2**d, d))
        worth[:, :, 0] = 1.0
        for j in range(d):
            if j != i:
                with_j = worth[:, :, :-1] * held[None, :, j, None]
                worth *= ratios[:, None, j, None]
                worth[:, :, 1:] += with_j
        tables[:, :, i] = values[:, None] * (worth @ np.array(shares)) * (held[None, :, i] - ratios[:, None, i])
    return tables


def leaves(model: BoostedModel) -> list[Leaf]:
    """The leaves of all trees; their number is bounded by the model's size."""
    paths = []
    for tree in range(model.trees):
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            feature = int(model.feature[tree, node])
            if feature < 0:
                paths.append((path, float(model.value[tree, node])))
                continue
            threshold = float(model.threshold[tree, node])
            for child, is_left in ((2 * node + 1, True), (2 * node + 2, False)):
                low, high, ratio = path.get(feature, (-np.inf, np.inf, 1.0))
                bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
                stack.append((child, {**path, feature: (*bounds, ratio * model.cover[tree, child] / model.cover[tree, node])}))
    # a tree without a split adds the same to every row
    found = [Leaf((), np.zeros(0), np.zeros(0), np.zeros((1, 0)), value) for path, value in paths if not path]
    for depth in sorted({len(path) for path, _ in paths if path}):
        alike = [(path, value) for path, value in paths if len(path) == depth]
        names = [tuple(sorted(path)) for path, _ in alike]
        low, high, ratios = (np.array([[path[f][part] for f in n] for n, (path, _) in zip(names, alike)]).reshape(-1, depth) for part in range(3))
        values = np.array([value for _, value in alike])
        tables = _leaf_tables(values, ratios)
        found += [Leaf(names[i], low[i], high[i], tables[i], float(values[i] * np.prod(ratios[i]))) for i in range(len(alike))]
    return found


def _attributor():
    """The batch function, self-contained so that workers need no package of ours."""
    import numpy

    def attribute(rows, trees):
        out = numpy.zeros(rows.shape)
        for columns, low, high, table in trees:
            if columns:
                values = rows[:, columns]
                inside = (values > low) & (values <= high)
                pattern = inside.astype(numpy.int64) @ (1 << numpy.arange(len(columns)))
                out[:, columns] += table[pattern]
        return out

    return attribute


def _plain(trees: Sequence[Leaf]) -> list[tuple]:
    return [(list(leaf.features), leaf.low, leaf.high, leaf.table) for leaf in trees]


def attribute(rows: np.ndarray, trees: Sequence[Leaf]) -> np.ndarray:
    """Attributions (log-odds) of a batch of feature rows."""
    return _attributor()(rows, _plain(trees))


def base_value(trees: Sequence[Leaf]) -> float:
    return float(sum(leaf.base for leaf in trees))


def attributions(model: BoostedModel, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(user_id, feature, value, attribution)``, one row per user and feature.

    Per user the attributions sum to the log-odds of the score minus :func:`base_value`.
    """
    trees = table.sparkSession.sparkContext.broadcast(_plain(leaves(model)))
    batch_attributions = _attributor()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values = np.stack(batch["x"].to_numpy()).astype(float)
                yield pd.DataFrame({"user_id": batch["user_id"], "x": batch["x"], "phi": list(batch_attributions(values, trees.value))})

    packed = table.select("user_id", F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
    wide = packed.mapInPandas(run, "user_id string, x array<double>, phi array<double>")
    labels = F.array(*[F.lit(n) for n in names])
    return wide.select("user_id", F.explode(F.arrays_zip(labels.alias("feature"), F.col("x"), F.col("phi"))).alias("a")).select(
        "user_id", F.col("a.feature").alias("feature"), F.col("a.x").alias("value"), F.col("a.phi").alias("attribution")
    )
