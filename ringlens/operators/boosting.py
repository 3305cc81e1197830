"""Second-order gradient boosting over binned features.

Features are cut into at most ``bins`` bins once and stored as blocks of rows, a byte per value. A round adds one tree to
every model; each level of all models' trees is one pass over the blocks: a task derives the rows' gradients from the margins,
adds up gradient and Hessian histograms per (node, feature, bin), and the tasks' histograms, whose size does not depend on
the rows, are summed in a tree of tasks. Of two siblings only the lighter one is added up, the other is its parent less that.
Splits maximise the gain of regularised Newton steps, leaves take such a step.

Gradients are rounded to multiples of 2^-20 and summed as whole numbers, so sums, and with them the trees, are the same for any number
and order of tasks. Rows and features of a tree are drawn from hashes of (row, round) and (seed, round); no state is kept
between tasks but the blocks. Their margins move on every ``KEEP`` rounds; a lost block is read again and the trees so far applied.

With validation rows and ``patience``, a model ends when its average precision there (scores in 16,384 bins) has not risen
for that many rounds, and keeps the trees up to its best round.
"""

from __future__ import annotations

import functools
import pickle
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ringlens.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no package of ours

SCALE = float(1 << 20)
SCORE_BINS = 1 << 14
KEEP = 20
BLOCK_ROWS = 2048  # rows of a block
TASK_ROWS = 512  # rows that are worth a task of their own
LARGE_PARTITION = 1 << 18  # rows of a task when there are more tasks than cores


@dataclass(frozen=True)
class Settings:
    """The usual parameters of boosted trees; ``patience`` counts rounds and needs validation rows."""

    rounds: int = 500
    depth: int = 5
    step: float = 0.05
    subsample: float = 0.8
    feature_share: float = 0.8
    l1: float = 0.1
    l2: float = 1.0
    min_child: float = 1.0
    bins: int = 64
    seed: int = 42
    patience: int | None = None


@dataclass(frozen=True)
class BoostedModel:
    """Trees as arrays (tree x node): the children of node i are 2 i + 1 and 2 i + 2; a feature below zero marks a leaf.

    A row goes left where its value is at most the threshold. ``value`` is what a leaf adds to the log-odds, ``cover`` the sum of
    Hessians in a node (zero: no such node), ``gain`` that of its split.
    """

    names: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.feature)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row of features."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        depth = (self.feature.shape[1] + 1).bit_length() - 2 if self.trees else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                own = feature[node]
                node = np.where(own < 0, node, 2 * node + 1 + (rows[at, own] > threshold[node]))
            total += value[node]
        return total


@dataclass
class _Plan:
    """One model while it grows: the features it may use and its trees by bin."""

    columns: np.ndarray
    rounds: int
    patience: int | None
    trees: list[dict]
    tree: dict | None = None
    best: tuple[float, int] = (-1.0, 0)
    ended: bool = False


def _empty_tree(depth: int) -> dict:
    size = 2 ** (depth + 1) - 1
    return {"feature": np.full(size, -1, np.int64), "bin": np.zeros(size, np.int64), "value": np.zeros(size),
            "cover": np.zeros(size), "gain": np.zeros(size)}


def _nodes(tree: dict, bins: np.ndarray, depth: int) -> np.ndarray:
    """The deepest node of each row."""
    node, at = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for _ in range(depth):
        own = tree["feature"][node]
        node = np.where(own < 0, node, 2 * node + 1 + (bins[at, own] > tree["bin"][node]))
    return node


def _moved_margin(margin: np.ndarray, trees: Sequence[dict], bins: np.ndarray, depth: int) -> np.ndarray:
    """``margin`` after ``trees``, which are walked side by side and added in their order."""
    margin = margin.copy()
    if trees:
        feature, cut, value = (np.stack([t[k] for t in trees]) for k in ("feature", "bin", "value"))
        tree, at = np.arange(len(trees))[:, None], np.arange(len(bins))[None, :]
        node = np.zeros((len(trees), len(bins)), dtype=np.int64)
        for _ in range(depth):
            own = feature[tree, node]
            node = np.where(own < 0, node, 2 * node + 1 + (bins[at, own] > cut[tree, node]))
        for step in value[tree, node]:
            margin += step
    return margin


def _chosen(keys: np.ndarray, number: int, share: float) -> np.ndarray:
    """Rows of a round's sample, by a hash of row and round."""
    v = keys.view(np.uint64) ^ np.uint64((number * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    v ^= v >> np.uint64(31)
    return (v >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def gradients(margin: np.ndarray, label: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log-loss as whole multiples of 1 / SCALE."""
    prob = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(label == 1, weight, 1.0)
    return np.rint(w * (prob - label) * SCALE), np.rint(np.maximum(w * prob * (1 - prob), 1e-16) * SCALE)


def _histograms(blocks: Iterator[dict], jobs: dict, settings: Settings, weight: float, number: int) -> Iterator[dict]:
    """{model: (histogram of its nodes over the drawn features, score histogram or None)} of one task."""
    out: dict = {}
    for block in blocks:
        bins, label, held = block["bins"], block["label"], block["held"]
        sample = ~held & _chosen(block["keys"], number, settings.subsample)
        for name, job in jobs.items():
            margin = block["margins"].get(name)
            margin = _moved_margin(np.zeros(len(label)) if margin is None else margin, job["recent"], bins, settings.depth)
            sums, scores = out.setdefault(name, [None, None])
            if job["judged"] and held.any():
                place = np.minimum((SCORE_BINS / (1.0 + np.exp(-margin[held]))).astype(np.int64), SCORE_BINS - 1)
                own = np.bincount(place * 2 + label[held], minlength=2 * SCORE_BINS).reshape(-1, 2)
                out[name][1] = own if scores is None else scores + own
            if not len(job["nodes"]):
                continue
            slot = np.full(2 ** (settings.depth + 1), -1, dtype=np.int64)
            slot[job["nodes"]] = np.arange(len(job["nodes"]))
            at = slot[_nodes(job["tree"], bins, settings.depth)]
            rows = np.flatnonzero(sample & (at >= 0))
            g, h = gradients(margin[rows], label[rows], weight)
            repeats = len(job["columns"])
            index = ((at[rows, None] * repeats + np.arange(repeats)) * settings.bins + bins[rows][:, job["columns"]]).reshape(-1)
            shape = len(job["nodes"]), repeats, settings.bins
            own = np.stack([np.bincount(index, np.repeat(v, repeats), int(np.prod(shape))) for v in (g, h)], axis=1)
            own = own.astype(np.int64).reshape(*shape, 2)
            out[name][0] = own if sums is None else sums + own
    yield out


def _run(code: bytes, work: bytes, blocks: Iterator[dict]) -> Iterator[dict]:
    """:func:`_histograms`, serialised once for all rounds, on one task's blocks."""
    return pickle.loads(code)(blocks, *pickle.loads(work))


def _added(left: dict, right: dict) -> dict:
    for name, parts in right.items():
        mine = left.setdefault(name, [None, None])
        left[name] = [b if a is None else a if b is None else a + b for a, b in zip(mine, parts)]
    return left


def _newton(g: np.ndarray, h: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(step, what it wins) for sums of gradients and Hessians, under both penalties."""
    g, h = g / SCALE, h / SCALE
    shrunk = np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0)
    return -shrunk / (h + s.l2), shrunk * shrunk / (h + s.l2)


def best_splits(hist: np.ndarray, columns: np.ndarray, cuts: Sequence[np.ndarray], s: Settings) -> list[tuple[float, int, int]]:
    """(gain, place in ``columns``, bin) of each node of ``hist`` (node x column x bin x 2); the first of equal gains in this order."""
    usable = np.arange(hist.shape[2])[None, :] < np.array([len(cuts[c]) for c in columns])[:, None]
    total = hist[:, 0].sum(axis=1)
    left = hist.cumsum(axis=2)
    right = total[:, None, None] - left
    whole = _newton(total[:, 0], total[:, 1], s)[1]
    gain = _newton(left[..., 0], left[..., 1], s)[1] + _newton(right[..., 0], right[..., 1], s)[1] - whole[:, None, None]
    allowed = usable & (left[..., 1] >= s.min_child * SCALE) & (right[..., 1] >= s.min_child * SCALE)
    gain = np.where(allowed, gain, -np.inf).reshape(len(hist), -1)
    at = gain.argmax(axis=1)
    return [(float(own[i]), *map(int, divmod(i, hist.shape[2]))) for own, i in zip(gain, at)]


def average_precision(scores: np.ndarray) -> float:
    """Of counts (bin x label), highest bin first."""
    neg, pos = scores[::-1].T.cumsum(axis=1)
    return float((np.diff(pos, prepend=0) / max(pos[-1], 1) * pos / np.maximum(pos + neg, 1)).sum())


def cut_points(table: DataFrame, names: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending values between which bins lie, one pass for all features; at most ``bins - 1`` each."""
    shares = F.expr(f"array({', '.join(f'{i / bins}D' for i in range(1, bins))})")
    row = table.agg(*[F.percentile_approx(F.col(f"`{n}`").cast("double"), shares, F.lit(10_000)).alias(f"c{i}") for i, n in enumerate(names)],
                    *[F.max(F.col(f"`{n}`").cast("double")).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return [np.array(sorted({c for c in row[f"c{i}"] or () if c < row[f"m{i}"]})) for i in range(len(names))]


def _blocks(rows: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Stored blocks (keys, label, held, bins); null features count as 0."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(first, BLOCK_ROWS)
                values = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(cuts))
                binned = np.stack([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
                columns = [part.column("key").to_numpy(), part.column("label").to_numpy().astype(np.int8),
                           part.column("held").to_numpy(zero_copy_only=False), binned]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["keys", "label", "held", "bins"])

    features = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names])
    return cut_lineage(rows.select("key", "label", "held", features.alias("x")).mapInArrow(pack, "keys binary, label binary, held binary, bins binary"))


def _unpacked(rows: Iterator) -> Iterator[dict]:
    for r in rows:
        keys = np.frombuffer(r.keys, np.int64)
        yield {"keys": keys, "label": np.frombuffer(r.label, np.int8).astype(np.int64), "held": np.frombuffer(r.held, bool),
               "bins": np.frombuffer(r.bins, np.uint8).reshape(len(keys), -1), "margins": {}}


def _moved(blocks: Iterator[dict], recent: dict[str, list[dict]], depth: int) -> Iterator[dict]:
    for block in blocks:
        margins = dict(block["margins"])
        for name, trees in recent.items():
            margin = margins[name] if name in margins else np.zeros(len(block["label"]))
            margins[name] = _moved_margin(margin, trees, block["bins"], depth)
        yield {**block, "margins": margins}


def fit_models(
    train: DataFrame, models: Mapping[str, Sequence[str]], settings: Settings = Settings(), *, validation: DataFrame | None = None,
    patience: Mapping[str, int] | None = None, rounds: Mapping[str, int] | None = None,
) -> dict[str, BoostedModel]:
    """Boosted trees for several feature lists over the same rows ``(user_id, label, features...)``, grown side by side.

    Positive rows weigh as much as there are negative rows for each. ``patience`` and ``rounds`` may differ by model. Rows
    repeat where ids do; an empty table gives models without trees.
    """
    s, patience, rounds = settings, dict(patience or {}), dict(rounds or {})
    names = list(dict.fromkeys(n for own in models.values() for n in own))
    if s.bins > 256 or s.bins < 2:
        raise ValueError("bins are kept in a byte: 2 to 256")

    def keyed(table: DataFrame, held: bool) -> DataFrame:
        return table.select(F.xxhash64("user_id", F.lit(s.seed)).alias("key"), F.col("label").cast("int").alias("label"),
                            F.lit(held).alias("held"), *[F.col(f"`{n}`") for n in names])

    rows = keyed(train, False) if validation is None else keyed(train, False).union(keyed(validation, True))
    counts = train.agg(F.expr("count_if(label = 1)").alias("pos"), F.expr("count_if(label <> 1)").alias("neg")).first()
    weight = counts.neg / max(counts.pos, 1)
    cuts = cut_points(train, names, s.bins)
    cores = train.sparkSession.sparkContext.defaultParallelism
    total = counts.pos + counts.neg
    parts = max(1, min(-(-total // TASK_ROWS), cores), -(-total // LARGE_PARTITION))
    state: RDD = _blocks(rows.repartition(parts, "key"), names, cuts).rdd.mapPartitions(_unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    plans = {name: _Plan(np.array([names.index(n) for n in own]), rounds.get(name, s.rounds), patience.get(name, s.patience), [])
             for name, own in models.items()}
    moved = {name: 0 for name in models}  # trees that the blocks' margins hold
    last = max((p.rounds for p in plans.values()), default=0) if total else -1

    code = cloudpickle.dumps(_histograms)

    def gather(jobs: dict, number: int) -> dict:
        partial = state.mapPartitions(functools.partial(_run, code, pickle.dumps((jobs, s, weight, number))))
        return partial.treeReduce(_added, depth=2) if parts > 64 else partial.reduce(_added)

    for number in range(last + 1):
        for plan in plans.values():
            plan.ended |= number >= plan.rounds and plan.patience is None  # with patience the last tree is still judged
        growing = {n: p for n, p in plans.items() if not p.ended}
        drawn, hists = {}, {}
        for name, plan in growing.items():
            plan.tree = _empty_tree(s.depth)
            order = np.random.default_rng([s.seed, number]).permutation(len(plan.columns))
            drawn[name] = plan.columns[np.sort(order[: max(1, int(s.feature_share * len(plan.columns)))])]
        wanted = {name: [0] for name in growing}
        for level in range(s.depth):
            jobs = {name: {"recent": plan.trees[moved[name]:], "tree": plan.tree, "columns": drawn[name],
                           "judged": level == 0 and plan.patience is not None,
                           "nodes": [] if number >= plan.rounds else [n for n in wanted[name] if n == 0 or n in plan.tree["light"]]}
                    for name, plan in growing.items() if wanted[name]}
            jobs = {name: job for name, job in jobs.items() if job["judged"] or job["nodes"]}
            if not jobs:
                break
            sums = gather(jobs, number)
            for name, job in jobs.items():
                plan, tree = plans[name], plans[name].tree
                hist, scores = sums.get(name, (None, None))
                if job["judged"] and scores is not None:
                    value = average_precision(scores)
                    if value > plan.best[0]:
                        plan.best = value, number
                    plan.ended = number - plan.best[1] >= plan.patience
                if number >= plan.rounds or plan.ended:
                    plan.ended, wanted[name] = True, []
                    continue
                if hist is None:  # no row was drawn
                    hist = np.zeros((len(job["nodes"]), len(drawn[name]), s.bins, 2), np.int64)
                own = dict(zip(job["nodes"], hist))
                for n in wanted[name]:
                    if n not in own:
                        sibling = n + 1 if n % 2 else n - 1
                        own[n] = hists[name][(n - 1) // 2] - own[sibling]
                ready = [n for n in wanted[name] if n in own]
                following, tree["light"] = [], set()
                for n, (gain, place, cut) in zip(ready, best_splits(np.stack([own[n] for n in ready]), drawn[name], cuts, s)):
                    g, h = own[n][place].sum(axis=0)
                    tree["cover"][n], tree["value"][n] = h / SCALE, s.step * _newton(g, h, s)[0]
                    if gain > 1e-6:
                        tree["feature"][n], tree["bin"][n], tree["gain"][n], tree["value"][n] = drawn[name][place], cut, gain, 0.0
                        left = own[n][place, : cut + 1].sum(axis=0)
                        for child, (cg, ch) in ((2 * n + 1, left), (2 * n + 2, np.array([g, h]) - left)):
                            tree["cover"][child], tree["value"][child] = ch / SCALE, s.step * _newton(cg, ch, s)[0]
                        following += [2 * n + 1, 2 * n + 2]
                        tree["light"].add(2 * n + 1 if tree["cover"][2 * n + 1] <= tree["cover"][2 * n + 2] else 2 * n + 2)
                hists[name], wanted[name] = own, following if level + 1 < s.depth else []
        for name, plan in growing.items():
            if not plan.ended:
                plan.trees.append({k: v for k, v in plan.tree.items() if k != "light"})
        if all(p.ended for p in plans.values()):
            break
        if (number + 1) % KEEP == 0:
            recent = {name: plan.trees[moved[name]:] for name, plan in plans.items() if not plan.ended}
            older, state = state, state.mapPartitions(lambda blocks, recent=recent: _moved(blocks, recent, s.depth)).persist(StorageLevel.MEMORY_AND_DISK)
            state.count()
            older.unpersist()
            moved |= {name: len(plans[name].trees) for name in recent}
    state.unpersist()
    return {name: _model(plan, tuple(models[name]), cuts, s.depth) for name, plan in plans.items()}


def _model(plan: _Plan, names: tuple[str, ...], cuts: Sequence[np.ndarray], depth: int) -> BoostedModel:
    trees = plan.trees if plan.patience is None or plan.best[0] < 0 else plan.trees[: max(plan.best[1], 1)]
    shape = (len(trees), 2 ** (depth + 1) - 1)
    place = {int(c): i for i, c in enumerate(plan.columns)}
    arrays = {k: np.array([t[k] for t in trees]).reshape(shape) for k in ("feature", "bin", "value", "cover", "gain")}
    threshold = np.zeros(shape)
    own = arrays["feature"]
    for at in zip(*np.nonzero(own >= 0)):
        threshold[at] = cuts[own[at]][arrays["bin"][at]]
    feature = np.vectorize(lambda f: place.get(int(f), -1), otypes=[np.int64])(own) if own.size else own.astype(np.int64)
    return BoostedModel(names, feature, threshold, arrays["value"], arrays["cover"], arrays["gain"])


def score(model: BoostedModel, table: DataFrame, column: str = "prob") -> DataFrame:
    """``table`` with the probability of the positive class in ``column``; null features count as 0."""
    table = table.drop(column)
    places = [table.columns.index(n) for n in model.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([np.nan_to_num(batch.column(p).to_numpy(zero_copy_only=False).astype(np.float64)) for p in places], axis=1)
            probs = 1.0 / (1.0 + np.exp(-model.margins(rows)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probs)], names=[*batch.schema.names, column])

    return table.mapInArrow(run, StructType([*table.schema.fields, StructField(column, DoubleType())]))


def nodes(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """``(tree, node, value, cover, gain, left, right, feature, threshold)``; left is -1 in leaves."""
    tree, node = np.nonzero(model.cover > 0)
    feature = model.feature[tree, node]
    inner = feature >= 0
    table = pa.table({
        "tree": pa.array(tree, pa.int32()), "node": pa.array(node, pa.int32()), "value": model.value[tree, node], "cover": model.cover[tree, node],
        "gain": model.gain[tree, node], "left": pa.array(np.where(inner, 2 * node + 1, -1), pa.int32()),
        "right": pa.array(np.where(inner, 2 * node + 2, -1), pa.int32()), "feature": pa.array(feature, pa.int32()), "threshold": model.threshold[tree, node]})
    return spark.createDataFrame(table)


def save(spark: SparkSession, model: BoostedModel, path: str) -> None:
    """The names and nodes as Parquet files."""
    spark.createDataFrame(pa.table({"place": list(range(len(model.names))), "name": list(model.names)})).coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    size = spark.createDataFrame(pa.table({"trees": [model.trees], "nodes": [model.feature.shape[1]]}))
    size.coalesce(1).write.mode("overwrite").parquet(f"{path}/size")
    nodes(spark, model).write.mode("overwrite").parquet(f"{path}/nodes")


def load(spark: SparkSession, path: str) -> BoostedModel:
    names = tuple(r.name for r in spark.read.parquet(f"{path}/names").orderBy("place").collect())
    size = spark.read.parquet(f"{path}/size").first()
    empty = np.zeros((size.trees, size.nodes))
    model = BoostedModel(names, np.full(empty.shape, -1, np.int64), *(empty.copy() for _ in range(4)))
    table = spark.read.parquet(f"{path}/nodes").toArrow()  # trees x nodes rows
    at = table.column("tree").to_numpy(), table.column("node").to_numpy()
    for column in ("feature", "threshold", "value", "cover", "gain"):
        getattr(model, column)[at] = table.column(column).to_numpy()
    return model


def with_settings(**options) -> Settings:
    return replace(Settings(), **{k: v for k, v in options.items() if v is not None})
