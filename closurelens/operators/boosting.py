"""Second-order histogram boosting of trees for a 0/1 label.

One quantile sketch cuts every feature into bins, and the binned rows are written
once, in chunks.  All models of a call (settings x folds) grow in lockstep on the
same chunks.  A pass over the rows sums gradients and Hessians per (model, open
node, feature, bin) in each chunk, adds them over the chunks by a shuffle, and
finds the best cut of each node where the sums meet; the driver receives one line
per open node and keeps the trees, whose size the settings bound.

Trees grow best first: by known gains the driver walks the order in which leaves
would be cut, and a pass opens every node that this order reaches and that has no
sums yet.  The order is final when it reaches none, so a tree of any number of
leaves takes about as many passes as it is deep.  A depth limit without a leaf
limit is the level-wise tree, a leaf limit without a depth limit the leaf-wise.

A table of one chunk (``CHUNK_ROWS`` rows at most) has nothing to exchange: each of
its models grows in a task of its own, by the same steps and to the same trees.

Gradients are rounded to multiples of 2^-20, so that their sums are exact and the
trees do not depend on the order of adding.  The margins of the rows are the only
state; they are kept per chunk in executor storage and written to the checkpoint
folder every ``CHECKPOINT`` trees, and a lost chunk is computed again from there.
The rows' state has no DataFrame form, hence an RDD of numpy chunks.

Defined results: null and NaN features count as 0; rows without a label take no
part in a fit; a fit without rows, or of one class, gives constant scores."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import checkpoint_dir, materialize
from . import ranks

BINS = 64
CHUNK_ROWS = 65_536
CHECKPOINT = 25
_UNIT = float(1 << 20)


@dataclass(frozen=True)
class Settings:
    """One model.  ``depth`` or ``leaves`` 0: no limit.  ``weight``: pos_ratio (positives
    count neg / pos), balanced (n / (2 n_class)) or none.  ``hold`` is the fold left out."""

    trees: int = 100
    depth: int = 6
    leaves: int = 0
    rate: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    weight: str = "pos_ratio"
    hold: int = -1


@dataclass
class Tree:
    """Nodes in order of creation; feature -1 is a leaf."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list[tuple[float, float, float]] = field(default_factory=list)
    best: list[tuple | None] = field(default_factory=list)  # gain, feature, bin, left sums; None unknown

    def add(self, depth: int, sums: tuple[float, float, float], open_: bool) -> int:
        self.feature.append(-1), self.bin.append(0), self.left.append(-1), self.right.append(-1)
        self.depth.append(depth), self.sums.append(sums), self.best.append(None if open_ else (0.0,))
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int32) for x in (self.feature, self.bin, self.left, self.right))


def open_nodes(t: Tree, s: Settings) -> list[int]:
    """Cuts the tree best first by the gains known so far and returns the nodes whose
    gain that order still needs.  What it does not reach stays a leaf."""
    if not t.best:
        t.add(0, (0.0, 0.0, 0.0), True)
    for i in range(len(t.feature)):
        t.feature[i] = -1
    if t.best[0] is None:
        return [0]
    queue = [(-t.best[0][0], 0)] if t.best[0][0] > 0 else []
    leaves, wanted = 1, []
    while queue and (not s.leaves or leaves < s.leaves):
        _, i = heapq.heappop(queue)
        _, t.feature[i], t.bin[i], inside = t.best[i]
        leaves += 1
        if t.left[i] < 0:
            deeper = not s.depth or t.depth[i] + 1 < s.depth
            outside = tuple(a - b for a, b in zip(t.sums[i], inside))
            t.left[i], t.right[i] = [t.add(t.depth[i] + 1, x, deeper) for x in (inside, outside)]
        for j in (t.left[i], t.right[i]):
            if t.best[j] is None:
                wanted.append(j)
            elif t.best[j][0] > 0:
                heapq.heappush(queue, (-t.best[j][0], j))
    return wanted


def best_cuts(h: np.ndarray, s: Settings, columns: np.ndarray) -> list[tuple]:
    """Per node of sums (node, feature, bin, (g, h) or (g, h, n)): its sums and the cut of highest
    gain (first feature and bin among equal ones; gain 0 if none is allowed)."""
    if not len(h) or h.shape[2] < 2:
        return [((0.0, 0.0, 0.0), (0.0,))] * len(h)
    total = h[:, 0].sum(axis=1)
    left = np.cumsum(h, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    def score(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / (x[..., 1] + s.l2 + 1e-12)

    gain = score(left) + score(right) - score(total)[:, None, None]
    ok = np.minimum(left[..., 1], right[..., 1]) >= s.min_hessian
    if s.min_rows > 1:
        ok &= np.minimum(left[..., 2], right[..., 2]) >= s.min_rows
    gain = np.where(ok & columns[None, :, None], gain, 0.0)
    flat = gain.reshape(len(h), -1)
    at = flat.argmax(axis=1)
    out = []
    for i, a in enumerate(at):
        f, b = divmod(int(a), left.shape[2])
        value = float(flat[i, a])
        triple = lambda v: (*v.tolist(), 0.0)[:3]
        out.append((triple(total[i]), (value if value > 1e-9 else 0.0, f, b, triple(left[i, f, b]))))
    return out


def _walk(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The leaf of every binned row."""
    feature, cut, left, right = tree
    node = np.zeros(len(x), np.int32)
    rows = np.arange(len(x))
    while len(rows):
        f = feature[node[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at = node[rows]
        node[rows] = np.where(x[rows, f] <= cut[at], left[at], right[at])
    return node


def _drawn(seed: int, share: float, *key: int, n: int) -> np.ndarray:
    return np.ones(n, bool) if share >= 1 else np.random.default_rng((seed, *key)).random(n) < share


@dataclass
class Chunk:
    """Binned rows of one chunk with the margins of one group of models."""

    number: int
    models: list[int]
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    margin: np.ndarray


def _bin_rows(batches: Iterator[pa.RecordBatch], edges: list[np.ndarray], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to chunks of ``rows`` binned rows."""
    held: list[tuple[np.ndarray, ...]] = []

    def chunk(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in parts], ["x", "y", "fold"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        x = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, cols)]).astype(np.uint8)
        held.append((x, cols[-2].astype(np.int8), cols[-1].astype(np.int8)))
        while sum(len(h[1]) for h in held) >= rows:
            whole = [np.concatenate(z) for z in zip(*held)]
            yield chunk([z[:rows] for z in whole])
            held = [tuple(z[rows:] for z in whole)]
    if sum(len(h[1]) for h in held):
        yield chunk([np.concatenate(z) for z in zip(*held)])


def _gradients(c: Chunk, row: int, s: Settings, weight: tuple[float, float], number: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows a tree of one model learns from, and their gradient, Hessian and, where
    the settings ask for a least number of rows, a one for each."""
    use = np.flatnonzero((c.fold != s.hold) & _drawn(seed, s.subsample, c.models[row], number, c.number, n=len(c.y)))
    prob, y = 1 / (1 + np.exp(-c.margin[row, use].astype(np.float64))), c.y[use]
    w = np.where(y == 1, weight[1], weight[0])
    channels = [np.rint(v * _UNIT) / _UNIT for v in (w * (prob - y), w * prob * (1 - prob))]
    return use, np.stack(channels + [np.ones(len(use))] if s.min_rows > 1 else channels)


def _sums(cells: np.ndarray, channels: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Channel sums by cell; ``cells`` has one row of cells per row of the data."""
    flat, p = cells.ravel(), cells.shape[-1]
    return np.stack([np.bincount(flat, weights=np.repeat(v, p), minlength=math.prod(shape)).reshape(shape) for v in channels], -1)


def _partials(c: Chunk, settings: Sequence[Settings], weights: Mapping, ask: Mapping, bins: int, seed: int):
    """(model, sums of its open nodes over the rows of one chunk)."""
    p = c.x.shape[1]
    for row, m in enumerate(c.models):
        if m not in ask:
            continue
        number, nodes, tree = ask[m]
        slot = np.full(len(tree[0]), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        use, channels = _gradients(c, row, settings[m], weights[m], number, seed)
        at = slot[_walk(c.x, tree)][use]
        here = at >= 0
        cells = (at[here] * (p * bins))[:, None] + np.arange(0, p * bins, bins) + c.x[use[here]]
        yield m, _sums(cells, channels[:, here], (len(nodes), p, bins))


def _advance(c: Chunk, done: Mapping) -> Chunk:
    """Margins after the finished trees (model -> tree, leaf values)."""
    margin = c.margin.copy()
    for row, m in enumerate(c.models):
        if m in done:
            tree, values = done[m]
            margin[row] += values[_walk(c.x, tree)]
    return replace(c, margin=margin)


def leaf_values(t: Tree, s: Settings) -> np.ndarray:
    return np.array([-s.rate * g / (h + s.l2 + 1e-12) for g, h, _ in t.sums], np.float32)


def _take(t: Tree, nodes: list[int], found: list[tuple]) -> None:
    for i, (total, cut) in zip(nodes, found):
        t.best[i] = cut
        if i == 0:
            t.sums[0] = total


def _columns(s: Settings, p: int, seed: int, m: int, number: int) -> np.ndarray:
    """The features a tree may cut by."""
    out = np.zeros(p, bool)
    out[np.random.default_rng((seed, 1 << 20, m, number)).permutation(p)[:max(1, round(s.colsample * p))]] = True
    return out


def _grow_tree(c: Chunk, row: int, s: Settings, weight: tuple[float, float], columns: np.ndarray, number: int,
               cells: np.ndarray, bins: int, seed: int) -> Tree:
    """One tree of one model when the chunk is the whole table.  Every node keeps its
    rows, the smaller child of a cut is summed and its sibling is the difference."""
    use, channels = _gradients(c, row, s, weight, number, seed)
    t, shape = Tree(), (cells.shape[1], bins)
    rows, sums = {0: np.arange(len(use))}, {}
    cells = cells[use]
    while nodes := open_nodes(t, s):
        if nodes == [0]:
            sums[0] = _sums(cells, channels, shape)
        for i in [i for i in rows if t.left[i] >= 0]:
            mine, left, right = rows.pop(i), t.left[i], t.right[i]
            go = c.x[use[mine], t.feature[i]] <= t.bin[i]
            rows[left], rows[right] = mine[go], mine[~go]
            if t.best[left] is None:
                less, more = (left, right) if len(rows[left]) <= len(rows[right]) else (right, left)
                sums[less] = _sums(cells[rows[less]], channels[:, rows[less]], shape)
                sums[more] = sums.pop(i) - sums[less]
        _take(t, nodes, best_cuts(np.stack([sums[i] for i in nodes]), s, columns))
    return t


def _grow_alone(c: Chunk, settings: Sequence[Settings], weights: Mapping, bins: int, seed: int) -> tuple[Chunk, dict[int, list[Tree]]]:
    """All trees of a chunk's models when the chunk is the whole table."""
    grown: dict[int, list[Tree]] = {m: [] for m in c.models}
    cells = c.x + np.arange(0, c.x.shape[1] * bins, bins)
    for row, m in enumerate(c.models):
        for number in range(settings[m].trees):
            columns = _columns(settings[m], c.x.shape[1], seed, m, number)
            t = _grow_tree(c, row, settings[m], weights[m], columns, number, cells, bins, seed)
            c = _advance(c, {m: (t.arrays(), leaf_values(t, settings[m]))})
            grown[m].append(t)
    return c, grown


@dataclass
class BoostedModel:
    """Trees over raw features: per tree, node -> (value, cover, left, right, feature,
    threshold, gain); rows with a value up to the threshold go left."""

    features: list[str]
    trees: list[dict[int, tuple]]

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(t, n, *map(float, x[:2]), x[2], x[3], x[4], float(x[5]), float(x[6]))
                for t, tree in enumerate(self.trees) for n, x in tree.items()]
        return spark.createDataFrame(rows, "tree int, node int, value double, cover double, left int, right int, "
                                           "feature int, threshold double, gain double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).write.parquet(f"{path}/nodes")
        spark.createDataFrame(list(enumerate(self.features)), "i int, feature string").write.parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        names = [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("i").collect()]
        trees: dict[int, dict] = {}
        for r in spark.read.parquet(f"{path}/nodes").collect():
            trees.setdefault(r.tree, {})[r.node] = tuple(r)[2:]
        return BoostedModel(names, [trees[t] for t in sorted(trees)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            ids = sorted(tree)
            value, _, left, right, feature, cut, _ = (np.array(v) for v in zip(*[tree[i] for i in ids]))
            node = np.zeros(len(x), int)
            rows = np.arange(len(x))
            while len(rows):
                rows = rows[feature[node[rows]] >= 0]
                at = node[rows]
                node[rows] = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            out += value[node]
        return out

    def importances(self) -> dict[str, float]:
        """Mean gain of a feature's cuts, as a share of all features'."""
        gains: dict[int, list[float]] = {}
        for tree in self.trees:
            for _, _, _, _, f, _, gain in tree.values():
                if f >= 0:
                    gains.setdefault(f, []).append(gain)
        mean = {f: sum(g) / len(g) for f, g in gains.items()}
        return {n: mean.get(i, 0.0) / (sum(mean.values()) or 1.0) for i, n in enumerate(self.features)}


def score(model: BoostedModel, df: DataFrame) -> DataFrame:
    """Adds ``p1`` = P(class 1) and ``prediction``."""
    def run(values: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in values:
            cols = [cols] if isinstance(cols, pd.Series) else cols
            x = np.nan_to_num(np.column_stack([c.to_numpy(np.float64) for c in cols]), nan=0.0)
            yield pd.Series(1 / (1 + np.exp(-model.margins(x))))

    probability = F.pandas_udf(run, "double")
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in model.features]
    return df.withColumn("p1", probability(*x)).withColumn("prediction", (F.col("p1") > 0.5).cast("double"))


class Boosting:
    """Models that grow together on one binned table."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, fold: str | None = None,
                 bins: int = BINS, seed: int = 42, chunk_rows: int = CHUNK_ROWS):
        if not 2 <= bins <= 256:
            raise ValueError("bins must be 2 to 256")
        self.spark, self.features, self.bins, self.seed = df.sparkSession, list(features), bins, seed
        x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
        rows = df.where(F.col(label).isNotNull()).select(
            *x, F.col(label).cast("int").alias("y"), (F.coalesce(F.col(fold).cast("int"), F.lit(-2)) if fold else F.lit(-2)).alias("fold"))
        names = [f"x{i}" for i in range(len(x))]
        cuts = rows.approxQuantile(names, [i / bins for i in range(1, bins)], 0.25 / bins)
        self.edges = [np.unique(np.array(c, np.float64))[:bins - 1] for c in cuts]
        edges = self.edges
        self.counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
        parts = max(1, -(-sum(self.counts.values()) // chunk_rows))
        dealt = rows.repartition(parts, *names).sortWithinPartitions(*names, "y", "fold")
        self.table = materialize(dealt.mapInArrow(lambda b: _bin_rows(b, edges, chunk_rows), "x binary, y binary, fold binary"), "binned")

    def _weights(self, s: Settings) -> tuple[float, float]:
        """Weights of classes 0 and 1; like the reference's, from all rows of the table."""
        neg, pos = self.counts.get(0, 0), self.counts.get(1, 0)
        if not neg or not pos or s.weight == "none":
            return 1.0, 1.0
        return (1.0, neg / pos) if s.weight == "pos_ratio" else ((neg + pos) / (2 * neg), (neg + pos) / (2 * pos))

    def _state(self, m: int):
        """Chunks x groups of models, so that few rows still use all cores."""
        sc, p = self.spark.sparkContext, len(self.features)
        checkpoint_dir(self.spark)
        packed = self.table.rdd.zipWithIndex().map(lambda r: (r[1], *map(bytes, r[0])))
        n = self.table.count()
        groups = m if n <= 1 else min(m, max(1, -(-sc.defaultParallelism // n)))
        members = [list(range(g, m, groups)) for g in range(groups)]

        def chunks(r: tuple) -> list[Chunk]:
            number, x, y, fold = r
            y, fold = np.frombuffer(y, np.int8), np.frombuffer(fold, np.int8)
            return [Chunk(number, g, np.frombuffer(x, np.uint8).reshape(len(y), p), y, fold, np.zeros((len(g), len(y)), np.float32))
                    for g in members]

        return n, packed.flatMap(chunks).repartition(max(1, n * groups if n <= 1 else max(sc.defaultParallelism, n)))

    def grow(self, settings: Sequence[Settings]):
        """The trees of all models and the rows' final state."""
        settings, bins, seed, p = list(settings), self.bins, self.seed, len(self.features)
        weights = {m: self._weights(s) for m, s in enumerate(settings)}
        chunks, state = self._state(len(settings))
        if chunks <= 1:
            ended = state.map(lambda c: _grow_alone(c, settings, weights, bins, seed)).persist(StorageLevel.MEMORY_AND_DISK)
            trees = {m: t for _, g in ended.map(lambda r: (None, r[1])).collect() for m, t in g.items()}
            return [trees.get(m, []) for m in range(len(settings))], ended.map(lambda r: r[0])
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        parts = self.spark.sparkContext.defaultParallelism
        grown: list[list[Tree]] = [[] for _ in settings]
        for number in range(max((s.trees for s in settings), default=0)):
            now = {m: Tree() for m, s in enumerate(settings) if number < s.trees}
            columns = {m: _columns(settings[m], p, seed, m, number) for m in now}
            # open_nodes cuts the tree first, so that its arrays hold the nodes it returns
            while ask := {m: (number, w, t.arrays()) for m, t in now.items() if (w := open_nodes(t, settings[m]))}:
                sums = state.flatMap(lambda c, ask=ask: _partials(c, settings, weights, ask, bins, seed)).reduceByKey(
                    np.add, min(parts, len(ask)))
                found_all = sums.map(lambda r, columns=columns: (r[0], best_cuts(r[1], settings[r[0]], columns[r[0]]))).collect()
                for m, found in found_all:
                    _take(now[m], ask[m][1], found)
            done = {}
            for m, t in now.items():
                grown[m].append(t)
                done[m] = (t.arrays(), leaf_values(t, settings[m]))
            after = state.map(lambda c, done=done: _advance(c, done)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % CHECKPOINT == CHECKPOINT - 1:
                after.checkpoint()
            after.count()
            state.unpersist()
            state = after
        return grown, state

    def model(self, trees: list[Tree], s: Settings) -> BoostedModel:
        out = []
        for t in trees:
            values, nodes, todo, number = leaf_values(t, s), {}, [0], {0: 0}
            while todo:
                i = todo.pop()
                if t.feature[i] < 0:
                    nodes[number[i]] = (float(values[i]), t.sums[i][1], -1, -1, -1, 0.0, 0.0)
                    continue
                for j in (t.left[i], t.right[i]):
                    number[j] = len(number)
                    todo.append(j)
                e = self.edges[t.feature[i]]
                cut = float(e[t.bin[i]]) if t.bin[i] < len(e) else math.inf
                nodes[number[i]] = (float(values[i]), t.sums[i][1], number[t.left[i]], number[t.right[i]], t.feature[i], cut, t.best[i][0])
            out.append(nodes)
        return BoostedModel(self.features, out)

    def fit(self, settings: Sequence[Settings]) -> list[BoostedModel]:
        settings = list(settings)
        grown, state = self.grow(settings)
        state.unpersist()
        return [self.model(t, s) for t, s in zip(grown, settings)]

    def held_out_auc(self, settings: Sequence[Settings]) -> DataFrame:
        """(model, auc): exact ROC-AUC of each model on the fold it does not see, null if
        the fold lacks a class."""
        settings = list(settings)
        _, state = self.grow(settings)

        def counts(c: Chunk) -> Iterator[tuple]:
            for row, m in enumerate(c.models):
                held = c.fold == settings[m].hold
                value, at = np.unique(c.margin[row, held], return_inverse=True)
                pos = np.bincount(at, weights=c.y[held], minlength=len(value))
                rows = np.bincount(at, minlength=len(value))
                yield m, value.astype(float).tolist(), pos.tolist(), (rows - pos).tolist()

        packed = self.spark.createDataFrame(state.flatMap(counts), "model int, v array<double>, pos array<double>, neg array<double>")
        cells = (packed.select("model", F.explode(F.arrays_zip("v", "pos", "neg")).alias("c")).select("model", "c.*")
                 .groupBy("model", "v").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
        order = [F.col("v").asc()]
        ranked = ranks.running_sums(ranks.shards(cells, ["model"], order, "auc"), ["model"], order, {"upto": F.col("neg")})
        wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
        out = materialize(ranked.groupBy("model").agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc")), "auc")
        state.unpersist()
        return out
