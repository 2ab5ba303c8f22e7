"""Boosted trees by histograms, many models side by side.

Features are cut into bins once. Rows are packed into blocks of bins, labels, folds and each model's margins, and
every level of a tree is one aggregate: tasks add gradients and curvatures up by model, node, feature and bin, Spark
sums them and finds the best splits by window functions, and the driver gets a row per node. All models of a search
(settings, folds) share each pass. Sums are of whole numbers, so trees don't depend on how rows are dealt.

Passes are as many as rounds and levels, some thousands in a whole search. Rows that a task can hold (`WHOLE` bytes) are
therefore handed to each task once, and tasks share the models instead: the same sums, so the same trees.

Two kinds: trees whose nodes split on their own (second-order gain, a side for missing values that is learned), and
symmetric trees (one split for all nodes of a level) with ordered boosting: a row's residual comes from leaf values
of rows before it in a hashed order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import average_precision, class_weight, recall_threshold
from .tables import union_all
from .trees import evaluate, sample_params

#: Bins of a feature at most, and the bin of missing values.
BINS, MISSING = 64, 255
#: Rows of a block, and rounds after which margins are brought up to date.
BLOCK_ROWS, ROUNDS = 8192, 8
#: Gradients and curvatures are whole numbers of 1/UNIT, weights are WEIGHT at most.
UNIT, WEIGHT = 1 << 20, 1 << 12
#: Bytes of rows up to which a task holds all of them, and numbers up to which the noise of splits is handed to tasks.
WHOLE, NOISES = 1 << 26, 1 << 21
#: Prefixes of the hashed order that have leaf values of their own: each is twice the one before.
PREFIXES = 8
_BLOCK = "id binary, y binary, folds binary, x binary, margins binary"
_HISTOGRAM = "model int, node int, feature int, bin int, g bigint, h bigint"
_FITTED = "model int, feature binary, cut binary, left binary, value binary, gain binary, id binary, y binary, margin binary"


@dataclass(frozen=True)
class Setting:
    """Parameters of a model. `weight` is that of positives (or its root, if `root`, or both classes balanced for symmetric trees); `noise` is for symmetric trees, `least` (smallest curvature of a child), `rows` and `columns` (shares drawn per tree) for the others."""

    symmetric: bool = False
    depth: int = 3
    rate: float = 0.1
    rounds: int = 100
    rows: float = 1.0
    columns: float = 1.0
    least: float = 1.0
    ridge: float = 1.0
    weight: float = 1.0
    noise: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class Run:
    """A setting fitted to the rows whose entry in fold column `column` is neither -1 nor `without`."""

    setting: Setting
    column: int = 0
    without: int = -2


@dataclass
class Tree:
    """A tree in heap order: children of node k are 2k+1 (not above the cut) and 2k+2. feature is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    ordered: np.ndarray | None = None

    @staticmethod
    def of(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            bins = x[rows, np.maximum(feature, 0)]
            right = np.where(bins == MISSING, ~self.left[at], bins > self.cut[at])
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class Booster:
    """A fitted model: the features, their cuts, trees."""

    features: list[str]
    cuts: list[list[float]]
    setting: Setting
    trees: list[Tree] = field(default_factory=list)

    def margin(self) -> Column:
        """The log odds as one expression of the feature columns: the sum of an array of one value per tree. Symmetric trees look their leaf up by the bits of their levels' comparisons."""
        if not self.trees:
            return F.lit(0.0)
        values = ", ".join(self._symmetric(t) if self.setting.symmetric else self._node(t, 0) for t in self.trees)
        return F.aggregate(F.expr(f"array({values})"), F.lit(0.0), lambda total, x: total + x)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))

    def _test(self, t: Tree, node: int) -> str:
        """Whether a row goes right at a node."""
        name, cut = self.features[t.feature[node]], self.cuts[t.feature[node]][t.cut[node]]
        x = f"CAST(`{name}` AS DOUBLE)"
        there = f"({x} IS NOT NULL AND NOT isnan({x}))"
        return f"({there} AND {x} >= {cut!r}D)" if t.left[node] else f"(NOT {there} OR {x} >= {cut!r}D)"

    def _node(self, t: Tree, node: int) -> str:
        if t.feature[node] < 0:
            return f"{float(t.value[node])!r}D"
        return f"CASE WHEN {self._test(t, node)} THEN {self._node(t, 2 * node + 2)} ELSE {self._node(t, 2 * node + 1)} END"

    def _symmetric(self, t: Tree) -> str:
        nodes, at = [], 0
        while t.feature[at] >= 0:
            nodes.append(at)
            at = 2 * at + 1
        first, depth = (1 << len(nodes)) - 1, len(nodes)
        bits = " + ".join(f"CASE WHEN {self._test(t, n)} THEN {1 << (depth - 1 - k)} ELSE 0 END" for k, n in enumerate(nodes)) or "0"
        leaves = ", ".join(f"{float(v)!r}D" for v in t.value[first : first + (1 << depth)])
        return f"get(array({leaves}), {bits})"

    def scored(self, df: DataFrame, label: str, id_col: str) -> DataFrame:
        """Rows (id, label, probability): what probability() says, from packed rows. An expression of some hundred trees takes longer to plan than this to run."""
        blocks = pack(df.withColumn("__scored", F.lit(0)), self.features, self.cuts, label, id_col, ["__scored"])
        trees, width = self.trees, len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, b in _read(batches, width, 1, 0):
                margin = np.zeros(len(b.id))
                for t in trees:
                    margin += t.value[t.place(b.x)]
                yield pa.record_batch({"id": pa.array(b.id), label: pa.array(b.y.astype(np.int32)), "probability": pa.array(1 / (1 + np.exp(-margin)))})

        return blocks.mapInArrow(run, f"id bigint, `{label}` int, probability double")

    def importances(self) -> list[tuple[str, float]]:
        """Features by their share of all gain, ties by name."""
        gains = np.zeros(len(self.features))
        for t in self.trees:
            np.add.at(gains, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return sorted(zip(self.features, (gains / max(gains.sum(), 1e-300)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def bin_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Each feature's cuts, from one pass of quantile sketches. A value's bin is the number of cuts that are at most the value; a feature of few values has a cut at each but the least."""
    there = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"q{k}") for k, x in enumerate(there.values())], *[F.min(x).alias(f"m{k}") for k, x in enumerate(there.values())]).first()
    return [sorted({v for v in row[f"q{k}"] or [] if v > row[f"m{k}"]}) for k in range(len(features))]


def _normal(*parts: Column) -> Column:
    """A standard normal number that follows from the parts."""
    even = lambda salt: (F.pmod(F.xxhash64(*parts, F.lit(salt)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return F.sqrt(-2 * F.log(even("r"))) * F.cos(2 * math.pi * even("a"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _even(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from rows' ids."""
    x = ids.view(np.uint64)
    for s in salt:
        x = _mix(x + np.uint64((s * 0x9E3779B97F4A7C15 + 1) % 2**64))
    return (_mix(x) >> np.uint64(11)) * 2.0**-53


def _segment(ids: np.ndarray, seed: int) -> np.ndarray:
    """The prefix of the hashed order that a row is first in: 0 is the shortest."""
    return np.clip(PREFIXES - 1 - np.floor(-np.log2(np.maximum(_even(ids, seed, 7), 1e-12))), 0, PREFIXES - 1).astype(np.int64)


def pack(df: DataFrame, features: list[str], cuts: list[list[float]], label: str, id_col: str, folds: list[str]) -> DataFrame:
    """Blocks of rows, without margins yet. id_col is a long that tells rows apart; a null label is 0, a null fold -1. The last of `folds` says with 1 which rows may be scored."""
    n = len(features)
    chosen = df.select(F.col(id_col).cast("long"), F.coalesce(F.col(label).cast("int"), F.lit(0)), *[F.coalesce(F.col(c).cast("int"), F.lit(-1)) for c in folds], *[F.col(f).cast("double") for f in features]).toDF("id", "y", *[f"fold{k}" for k in range(len(folds))], *[f"x{k}" for k in range(n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, BLOCK_ROWS) for at in range(0, whole.num_rows, BLOCK_ROWS)):
                column = lambda k, kind: batch.column(k).to_numpy(zero_copy_only=False).astype(kind)  # noqa: B023, E731
                x = np.full((batch.num_rows, n), MISSING, np.uint8)
                for k in range(n):
                    v = column(2 + len(folds) + k, np.float64)
                    x[:, k] = np.where(np.isnan(v), MISSING, np.searchsorted(cuts[k], v, side="right"))
                where = np.stack([column(2 + k, np.int32) for k in range(len(folds))], 1) if folds else np.zeros((batch.num_rows, 1), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (column(0, np.int64), column(1, np.uint8), where, x, np.zeros(0))], [c.split()[0] for c in _BLOCK.split(", ")])

    return chosen.mapInArrow(run, _BLOCK)


class _Rows:
    """A block's arrays. Margins are one row per model, two for those of symmetric trees: of the order, and of all rows."""

    def __init__(self, row: dict, width: int, folds: int, models: int):
        self.id, self.y = np.frombuffer(row["id"], np.int64), np.frombuffer(row["y"], np.uint8)
        self.folds, self.x = np.frombuffer(row["folds"], np.int32).reshape(-1, folds), np.frombuffer(row["x"], np.uint8).reshape(-1, width)
        held = np.frombuffer(row["margins"], np.float32)
        self.margins = held.reshape(models, 2, -1) if len(held) else np.zeros((models, 2, len(self.id)), np.float32)

    def margin(self, k: int, run: Run, pending: list[Tree]) -> np.ndarray:
        """The model's margins (both kinds) with trees that aren't in them yet."""
        out = self.margins[k].astype(np.float64)
        for t in pending:
            at = t.place(self.x)
            out[1] += t.value[at]
            out[0] += t.value[at] if t.ordered is None else t.ordered[at, _segment(self.id, run.setting.seed)]
        return out

    def trains(self, run: Run) -> np.ndarray:
        own = self.folds[:, run.column]
        return (own != -1) & (own != run.without)

    def slopes(self, margin: np.ndarray, run: Run, positive: float, negative: float) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        w = np.where(self.y == 1, positive, negative)
        return np.rint((p - self.y) * w * UNIT), np.rint(p * (1 - p) * w * UNIT)


def _read(batches: Iterator[pa.RecordBatch], width: int, folds: int, models: int) -> Iterator[tuple[dict, _Rows]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, _Rows(row, width, folds, models)


def _drawn(s: Setting, width: int, turn: int) -> np.ndarray:
    """The features drawn for a tree."""
    if s.symmetric or s.columns >= 1:
        return np.arange(width)
    draw = _even(np.arange(width, dtype=np.int64), s.seed, turn, 3)
    return np.sort(np.argsort(draw, kind="stable")[: max(1, round(s.columns * width))])


def _deviations(s: Setting, count: int, turn: int) -> float:
    """The deviation of a symmetric level's noise, as a share of the gradients'."""
    size = math.log(max(2, count)) - turn * s.rate
    return s.noise * math.exp(size) / (1 + math.exp(size)) / math.sqrt(max(1, count))


def _leaf(g: float, h: float, s: Setting) -> float:
    return -g / (h + s.ridge) * s.rate if h + s.ridge > 0 else 0.0


def _ordered_leaves(t: Tree, sums: np.ndarray, s: Setting) -> None:
    """A symmetric tree's leaf values, of all rows and of each prefix, from sums (ordered g and h, whole g and h) by node and prefix."""
    g, h, fg, fh = sums
    t.value = -fg.sum(1) / (fh.sum(1) + s.ridge) * s.rate
    # what comes before a prefix's own rows; before the first there is nothing
    before = lambda v: np.concatenate([np.zeros((len(v), 1)), np.cumsum(v, 1)[:, :-1]], 1)
    t.ordered = -before(g) / (before(h) + s.ridge) * s.rate


def _own_level(tree: Tree, first: int, sums: np.ndarray, columns: np.ndarray, s: Setting) -> bool:
    """own_splits of a level of one model, from sums (g and h, feature, node, bin; the last bin is that of missing values). Says whether a node was split."""
    g, h = sums / UNIT
    there = h > 0
    g = np.where(there, g, 0.0)
    gl, hl = (np.cumsum(v[..., :-1], -1) for v in (g, h))
    all_g, all_h = (left[..., -1] + v[..., -1] for left, v in ((gl, g), (hl, h)))
    gl, hl = (np.stack([left, left + v[..., -1:]], -1) for left, v in ((gl, g), (hl, h)))
    gr, hr = all_g[..., None, None] - gl, all_h[..., None, None] - hl
    gain = (gl * gl / (hl + s.ridge) + gr * gr / (hr + s.ridge) - (all_g * all_g / (all_h + s.ridge))[..., None, None]) / 2
    fits = there[..., :-1, None] & (hl >= s.least) & (hr >= s.least) & (hl > 0) & (hr > 0)
    # the first of equals: by feature, cut, missing values to the right
    flat = np.where(fits, np.round(gain, 9), -np.inf).swapaxes(0, 1).reshape(gain.shape[1], -1)
    best, split = flat.argmax(1), False
    for node, k in enumerate(best.tolist()):
        at = first + node
        if first == 0:
            tree.value[0] = _leaf(all_g[0, 0], all_h[0, 0], s)
        if not flat[node, k] > 0:
            continue
        i, cut, way = k // (2 * gl.shape[2]), k // 2 % gl.shape[2], k % 2
        tree.feature[at], tree.cut[at], tree.left[at], tree.gain[at], split = columns[i], cut, bool(way), flat[node, k], True
        left_g, left_h = gl[i, node, cut, way], hl[i, node, cut, way]
        tree.value[2 * at + 1], tree.value[2 * at + 2] = _leaf(left_g, left_h, s), _leaf(all_g[i, node] - left_g, all_h[i, node] - left_h, s)
    return split


def _shared_level(tree: Tree, first: int, sums: np.ndarray, noise: np.ndarray, s: Setting) -> bool:
    """shared_splits of a level of one model, from sums as in _own_level; noise by feature and cut."""
    g, h = sums / UNIT
    there = (h > 0).any(1, keepdims=True)
    g = np.where(there, g, 0.0)
    gl, hl = (v[..., -1:] + np.cumsum(v[..., :-1], -1) for v in (g, h))
    g, h = gl[..., -1:], hl[..., -1:]
    part = lambda g, h: np.divide(g * g, h + s.ridge, out=np.zeros_like(g), where=h + s.ridge != 0)
    gain = np.round((part(gl, hl) + part(g - gl, h - hl) - part(g, h)).sum(1), 9)
    hl, h = hl.sum(1), h.sum(1)
    fits = there[:, 0, :-1] & (hl > 0) & (hl < h) & (gain > 0)
    noisy = np.where(fits, gain + noise * np.sqrt(h), -np.inf)
    k = int(noisy.argmax())
    if not fits.flat[k]:
        return False
    at = slice(first, 2 * first + 1)
    tree.feature[at], tree.cut[at], tree.left[at], tree.gain[first] = k // fits.shape[1], k % fits.shape[1], True, gain.flat[k]
    return True


def _grow(b: _Rows, run: Run, weights: tuple[float, float], count: int, bins: int, normal: np.ndarray) -> tuple[list[Tree], np.ndarray]:
    """All trees of a model from all rows, and both margins of every row: what passes over spread rows find. A row's node is kept from level to level."""
    s, n, trees = run.setting, len(b.id), []
    width, rows, segment, trains = b.x.shape[1], np.arange(n), _segment(b.id, s.seed), b.trains(run)
    x = np.ascontiguousarray(np.where(b.x == MISSING, bins, b.x).astype(np.uint8).T)
    margins = np.zeros((2, n))
    for turn in range(s.rounds if count else 0):
        if turn % ROUNDS == 0:
            margins = margins.astype(np.float32).astype(np.float64)  # as blocks keep them
        use = trains if s.symmetric or s.rows >= 1 else trains & (_even(b.id, s.seed, turn, 5) < s.rows)
        slopes = [np.where(use, v, 0.0) for v in b.slopes(margins[0], run, *weights)]
        columns, tree, at = _drawn(s, width, turn), Tree.of(s.depth), np.zeros(n, np.int64)
        for level in range(s.depth):
            first, nodes = (1 << level) - 1, 1 << level
            live = at >= first
            cell = np.where(live, at - first, nodes) * (bins + 1)
            size = nodes * (bins + 1)
            sums = np.stack([[np.bincount(cell + x[f], v, size + bins + 1)[:size] for f in columns] for v in slopes]).reshape(2, len(columns), nodes, -1)
            if s.symmetric:
                split = _shared_level(tree, first, sums, _deviations(s, count, turn) * normal[turn, level], s)
            else:
                split = _own_level(tree, first, sums, columns, s)
            if not split:
                break
            feature = tree.feature[at]
            value = x[feature, rows]
            right = np.where(value == bins, ~tree.left[at], value > tree.cut[at])
            at = np.where(live & (feature >= 0), 2 * at + 1 + right, at)
        if s.symmetric:
            cell, size = at * PREFIXES + segment, len(tree.feature) * PREFIXES
            slopes += [np.where(use, v, 0.0) for v in b.slopes(margins[1], run, *weights)]
            sums = np.stack([np.bincount(cell, v, size) for v in slopes]) / UNIT
            _ordered_leaves(tree, np.where(sums[1] + sums[3] > 0, sums, 0.0).reshape(4, -1, PREFIXES), s)
        margins[1] += tree.value[at]
        margins[0] += tree.value[at] if tree.ordered is None else tree.ordered[at, segment]
        tree.ordered = None
        trees.append(tree)
    return trees, margins.astype(np.float32)


class Fit:
    """Models fitted side by side to blocks. `models` are the boosters; at the end `blocks` hold their margins of every row, or `fitted` the scores of those that each left out. Without `trees`, models that tasks fitted have none."""

    def __init__(self, blocks: DataFrame, features: list[str], cuts: list[list[float]], runs: list[Run], folds: int, trees: bool = True):
        self.runs, self.width, self.folds, self.features = runs, len(features), folds, features
        self.models = [Booster(features, cuts, r.setting) for r in runs]
        self.pending: list[list[Tree]] = [[] for _ in runs]
        self.blocks, self.rewritten = blocks.persist(StorageLevel.MEMORY_AND_DISK), 0
        self.fitted: DataFrame | None = None
        conf, key = blocks.sparkSession.conf, "spark.sql.adaptive.enabled"
        before = conf.get(key)
        # sums of known size, pass after pass: planning them anew would take longer than they do
        conf.set(key, "false")
        try:
            self._weights()
            if self._small():
                self._models_dealt(trees)
                return
            for turn in range(max((r.setting.rounds for r in runs), default=0)):
                if turn and turn % ROUNDS == 0:
                    self._write_margins()
                self._round(turn)
            self._write_margins()
        finally:
            conf.set(key, before)

    def _map(self, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
        width, folds, models = self.width, self.folds, len(self.runs)
        return self.blocks.mapInArrow(lambda batches: run(_read(batches, width, folds, models)), schema)

    def _dealt(self, run: Callable[[Iterator], Iterator], schema: str, groups: int, *keys: str) -> DataFrame:
        """Tasks' sums dealt by group, into no more tasks than groups or cores: the rows are few, a task's start isn't free."""
        cores = self.blocks.sparkSession.sparkContext.defaultParallelism
        return self._map(run, schema).repartition(max(1, min(groups, cores)), *keys)

    def _weights(self) -> None:
        """Class weights of each run, from its own rows: positives' weight, or for symmetric trees both classes' shares made equal."""
        runs = self.runs

        def count(rows: Iterator) -> Iterator[pa.RecordBatch]:
            n = np.zeros((len(runs), 2), np.int64)
            for _, b in rows:
                for k, run in enumerate(runs):
                    n[k] += np.bincount(b.y[b.trains(run)] == 1, minlength=2)
            yield pa.record_batch({"model": pa.array(range(len(runs)), pa.int32()), "negatives": n[:, 0], "positives": n[:, 1]})

        found = {r.model: r for r in self._dealt(count, "model int, negatives bigint, positives bigint", len(runs), "model").groupBy("model").agg(F.sum("negatives").alias("n"), F.sum("positives").alias("p")).collect()}
        self.counts = [(found[k].n, found[k].p) if k in found else (0, 0) for k in range(len(runs))]
        self.weights = []
        for run, (n, p) in zip(runs, self.counts, strict=True):
            if run.setting.symmetric:
                self.weights.append((max(n, p) / max(1, p), max(n, p) / max(1, n)))
            else:
                self.weights.append((run.setting.weight, 1.0))
        self.weights = [(min(WEIGHT, a), min(WEIGHT, b)) for a, b in self.weights]

    def _noises(self) -> int:
        """How many numbers the noise of symmetric splits takes."""
        own = [r.setting for r in self.runs if r.setting.symmetric]
        return len({s.seed for s in own}) * max((s.rounds for s in own), default=0) * max((s.depth for s in own), default=0) * self.width * self._bins()

    def _bins(self) -> int:
        return max((len(c) for m in self.models for c in m.cuts), default=0) + 1

    def _small(self) -> bool:
        """Whether rounds are many, and a task can hold all rows and what they take to fit."""
        if max((r.setting.rounds for r in self.runs), default=0) <= ROUNDS or self._noises() > NOISES:
            return False
        rows = (self.blocks.agg(F.sum(F.length("id"))).first()[0] or 0) // 8
        return rows * (self.width + 64) <= WHOLE

    def _normals(self) -> dict[int, np.ndarray]:
        """By seed the normal numbers of turn, level, feature and cut that a pass would draw."""
        spark, bins, width = self.blocks.sparkSession, self._bins(), self.width
        own = [r.setting for r in self.runs if r.setting.symmetric]
        rounds, depth = (max((f(s) for s in own), default=0) for f in (lambda s: s.rounds, lambda s: s.depth))
        of = lambda over, size: (F.floor(F.col("id") / over) % size).cast("int")
        places = [F.floor(F.col("id") / (depth * width * bins)).cast("int"), of(width * bins, depth), of(bins, width), of(1, bins)]
        draw = lambda seed: spark.range(rounds * depth * width * bins).select("id", _normal(F.lit(float(seed)), *places).alias("v")).toArrow()
        out = {}
        for seed in {s.seed for s in own}:
            found = draw(seed)
            out[seed] = np.zeros(rounds * depth * width * bins)
            out[seed][found["id"].to_numpy()] = found["v"].to_numpy()
            out[seed] = out[seed].reshape(rounds, depth, width, bins)
        return out

    def _models_dealt(self, keep: bool) -> None:
        """All rounds of a model in one task. Tasks get all rows once and share the models out by their work, the largest first. Trees are brought if they are to be kept."""
        spark, runs, width, folds, bins = self.blocks.sparkSession, self.runs, self.width, self.folds, self._bins()
        weights, counts, normals, none = self.weights, [sum(c) for c in self.counts], self._normals(), np.zeros((0, 0))
        work = [r.setting.rounds * (r.setting.depth + r.setting.symmetric) for r in runs]
        tasks = max(1, min(len(runs), 2 * spark.sparkContext.defaultParallelism))
        share, load = [[] for _ in range(tasks)], [0] * tasks
        for k in sorted(range(len(runs)), key=lambda k: -work[k]):
            least = load.index(min(load))
            share[least].append(k)
            load[least] += work[k]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [row for batch in batches for row in batch.to_pylist()]
            if not parts:
                return
            b = _Rows({c: b"".join(p[c] for p in parts) for c in ("id", "y", "folds", "x")} | {"margins": b""}, width, folds, 0)
            task = parts[0]["task"]
            del parts
            for k in share[task]:
                r = runs[k]
                trees, margins = _grow(b, r, weights[k], counts[k], bins, normals.get(r.setting.seed, none))
                out = {c: b"".join(getattr(t, c).tobytes() for t in trees if keep) for c in ("feature", "cut", "left", "value", "gain")}
                own = (b.folds[:, r.column] == r.without) & (b.folds[:, -1] == 1)
                out |= {"id": b.id[own].tobytes(), "y": b.y[own].tobytes(), "margin": margins[1][own].tobytes()}
                yield pa.record_batch({"model": pa.array([k], pa.int32()), **{c: pa.array([v], pa.binary()) for c, v in out.items()}})

        dealt = self.blocks.select("id", "y", "folds", "x", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")).repartitionById(tasks, F.col("task"))
        # what comes of it is planned without all that it was made of
        found = dealt.mapInArrow(run, _FITTED)
        self.fitted = found.checkpoint() if spark.sparkContext.getCheckpointDir() else found.localCheckpoint()
        for r in self.fitted.where(F.lit(keep)).select("model", "feature", "cut", "left", "value", "gain").collect():
            s = runs[r.model].setting
            size = (2 << s.depth) - 1
            read = lambda v, kind: np.frombuffer(v, kind).reshape(-1, size)  # noqa: B023, E731
            self.models[r.model].trees = [Tree(*t) for t in zip(read(r.feature, np.int32), read(r.cut, np.int32), read(r.left, bool), read(r.value, np.float64), read(r.gain, np.float64), strict=True)]

    def _write_margins(self) -> None:
        """Blocks with margins that hold the pending trees. Kept in memory or on executors' disks; every eighth time, where the cluster names a folder for it, in a checkpoint."""
        runs, pending = self.runs, self.pending
        if not any(pending):
            return

        def run(rows: Iterator) -> Iterator[pa.RecordBatch]:
            for row, b in rows:
                row["margins"] = np.stack([b.margin(k, r, pending[k]) for k, r in enumerate(runs)]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(c.split()[0], pa.binary()) for c in _BLOCK.split(", ")]))

        before = self.blocks
        self.blocks = self._map(run, _BLOCK)
        self.rewritten += 1
        if self.rewritten % 8 == 0 and before.sparkSession.sparkContext.getCheckpointDir():
            self.blocks = self.blocks.checkpoint()
        self.blocks = self.blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks.count()
        before.unpersist()
        self.pending = [[] for _ in runs]

    def _round(self, turn: int) -> None:
        active = [k for k, r in enumerate(self.runs) if turn < r.setting.rounds and sum(self.counts[k])]
        growing = {k: Tree.of(self.runs[k].setting.depth) for k in active}
        for level in range(max((self.runs[k].setting.depth for k in active), default=0)):
            some = [k for k in active if level < self.runs[k].setting.depth and (level == 0 or (growing[k].feature[(1 << level - 1) - 1 : (1 << level) - 1] >= 0).any())]
            if not some:
                break
            for symmetric in (False, True):
                if own := {k: growing[k] for k in some if self.runs[k].setting.symmetric == symmetric}:
                    self._split(turn, level, own, symmetric)
        self._ordered_values({k: t for k, t in growing.items() if self.runs[k].setting.symmetric})
        for k, t in growing.items():
            self.models[k].trees.append(t)
            self.pending[k].append(t)

    def _split(self, turn: int, level: int, growing: dict[int, Tree], symmetric: bool) -> None:
        """One pass: the histograms of all nodes of a level of one kind of trees, and their best splits."""
        runs, pending, weights, width = self.runs, self.pending, self.weights, self.width
        columns = {k: _drawn(runs[k].setting, width, turn) for k in growing}
        first, nodes = (1 << level) - 1, 1 << level

        def histograms(rows: Iterator) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros((2, len(columns[k]), nodes * 256)) for k in growing}
            for _, b in rows:
                for k, tree in growing.items():
                    s = runs[k].setting
                    own = b.trains(runs[k])
                    if s.rows < 1 and not s.symmetric:
                        own &= _even(b.id, s.seed, turn, 5) < s.rows
                    node = tree.place(b.x) - first
                    own &= node >= 0
                    g, h = (v[own] for v in b.slopes(b.margin(k, runs[k], pending[k])[0], runs[k], *weights[k]))
                    node = node[own] * 256
                    for i, f in enumerate(columns[k]):
                        cell = node + b.x[own, f]
                        sums[k][0, i] += np.bincount(cell, g, nodes * 256)
                        sums[k][1, i] += np.bincount(cell, h, nodes * 256)
            for k, own in sums.items():
                # a symmetric level needs every node at every cut
                full = own[1] > 0 if not symmetric else np.repeat((own[1].reshape(len(columns[k]), nodes, 256) > 0).any(1, keepdims=True), nodes, 1).reshape(len(columns[k]), -1)
                at, cell = np.nonzero(full)
                if len(at):
                    yield pa.record_batch({"model": pa.array(np.full(len(at), k, np.int32)), "node": pa.array((cell // 256).astype(np.int32)), "feature": pa.array(columns[k][at].astype(np.int32)), "bin": pa.array((cell % 256).astype(np.int32)), "g": pa.array(own[0][at, cell].astype(np.int64)), "h": pa.array(own[1][at, cell].astype(np.int64))})

        # tasks' rows are sums already, a node's at most BINS + 1 per feature and task: dealt so, one shuffle serves the sums and all windows
        dealt = self._dealt(histograms, _HISTOGRAM, len(growing) * (width if symmetric else nodes), "model", "feature" if symmetric else "node")
        sums = dealt.groupBy("model", "node", "feature", "bin").agg(*[(F.sum(c) / UNIT).alias(c) for c in ("g", "h")])
        per_model = lambda f: F.get(F.lit([float(f(k)) for k in range(len(runs))]), F.col("model"))
        ridge = per_model(lambda k: runs[k].setting.ridge)
        if symmetric:
            noise = per_model(lambda k: _deviations(runs[k].setting, sum(self.counts[k]), turn)) * _normal(per_model(lambda k: runs[k].setting.seed), F.lit(turn), F.lit(level), F.col("feature"), F.col("cut"))
            found = shared_splits(sums, ridge, noise).collect()
        else:
            found = own_splits(sums, ridge, per_model(lambda k: runs[k].setting.least)).collect()
        for r in found:
            tree, s = growing[r.model], runs[r.model].setting
            at = [first + r.node] if not s.symmetric else range(first, first + nodes)
            if not s.symmetric and level == 0:
                tree.value[0] = _leaf(r.g, r.h, s)
            if r.feature is None:
                continue
            for k in at:
                tree.feature[k], tree.cut[k], tree.left[k] = r.feature, r.cut, r.to_left
                if not s.symmetric:
                    tree.value[2 * k + 1], tree.value[2 * k + 2] = _leaf(r.gl, r.hl, s), _leaf(r.g - r.gl, r.h - r.hl, s)
            tree.gain[at[0]] = r.gain

    def _ordered_values(self, growing: dict[int, Tree]) -> None:
        """Leaf values of symmetric trees, of all rows and of each prefix: one pass."""
        if not growing:
            return
        runs, pending, weights = self.runs, self.pending, self.weights

        def leaves(rows: Iterator) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros((4, len(t.feature) * PREFIXES)) for k, t in growing.items()}
            for _, b in rows:
                for k, tree in growing.items():
                    own = b.trains(runs[k])
                    cell = (tree.place(b.x) * PREFIXES + _segment(b.id, runs[k].setting.seed))[own]
                    margins = b.margin(k, runs[k], pending[k])
                    parts = [v[own] for m in margins for v in b.slopes(m, runs[k], *weights[k])]
                    for i, v in enumerate(parts):
                        sums[k][i] += np.bincount(cell, v, sums[k].shape[1])
            for k, own in sums.items():
                at = np.flatnonzero(own[1] + own[3])
                yield pa.record_batch({"model": pa.array(np.full(len(at), k, np.int32)), "cell": pa.array(at.astype(np.int32)), **{c: pa.array(own[i][at].astype(np.int64)) for i, c in enumerate(("g", "h", "fg", "fh"))}})

        sums = self._dealt(leaves, "model int, cell int, g bigint, h bigint, fg bigint, fh bigint", len(growing), "model").groupBy("model", "cell").agg(*[(F.sum(c) / UNIT).alias(c) for c in ("g", "h", "fg", "fh")])
        tables = {k: np.zeros((4, len(t.feature), PREFIXES)) for k, t in growing.items()}
        for r in sums.collect():
            tables[r.model][:, r.cell // PREFIXES, r.cell % PREFIXES] = r.g, r.h, r.fg, r.fh
        for k, t in growing.items():
            _ordered_leaves(t, tables[k], runs[k].setting)

    def scores(self, label: str = "y") -> DataFrame:
        """Rows (model, id, fold, y, probability) of the rows that each model left out: its out-of-fold scores."""
        runs, schema = self.runs, f"model int, id bigint, fold int, `{label}` int, probability double"
        if self.fitted is not None:
            def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        k, y, margin = row["model"], np.frombuffer(row["y"], np.uint8), np.frombuffer(row["margin"], np.float32).astype(np.float64)
                        same = lambda v: pa.array(np.full(len(y), v, np.int32))  # noqa: B023, E731
                        yield pa.record_batch({"model": same(k), "id": pa.array(np.frombuffer(row["id"], np.int64)), "fold": same(runs[k].without), label: pa.array(y.astype(np.int32)), "probability": pa.array(1 / (1 + np.exp(-margin)))})

            return self.fitted.select("model", "id", "y", "margin").mapInArrow(unpack, schema)

        def run(rows: Iterator) -> Iterator[pa.RecordBatch]:
            for _, b in rows:
                for k, r in enumerate(runs):
                    own = (b.folds[:, r.column] == r.without) & (b.folds[:, -1] == 1)
                    if own.any():
                        p = 1 / (1 + np.exp(-b.margins[k][1][own].astype(np.float64)))
                        yield pa.record_batch({"model": pa.array(np.full(len(p), k, np.int32)), "id": pa.array(b.id[own]), "fold": pa.array(b.folds[own, r.column]), label: pa.array(b.y[own].astype(np.int32)), "probability": pa.array(p)})

        return self._map(run, schema)

    def close(self) -> None:
        self.blocks.unpersist()


def own_splits(sums: DataFrame, ridge: Column, least: Column) -> DataFrame:
    """The best split of each node from sums (model, node, feature, bin, g, h): rows with feature, cut (the last bin that goes left), to_left (missing values do), gain, the left child's sums gl and hl, and the node's g and h. feature is NULL where no split gains.

    Ties go to the first feature, the lowest cut, and missing values to the right.
    """
    each = Window.partitionBy("model", "node", "feature")
    here = F.col("bin") != MISSING
    up = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = sums.select(
        "model", "node", "feature", "bin",
        *[F.sum(c).over(each).alias(f"all_{c}") for c in ("g", "h")],
        *[F.coalesce(F.sum(F.when(~here, F.col(c))).over(each), F.lit(0.0)).alias(f"none_{c}") for c in ("g", "h")],
        *[F.sum(F.when(here, F.col(c)).otherwise(0.0)).over(up).alias(f"left_{c}") for c in ("g", "h")],
    )
    part = lambda g, h: g * g / (h + ridge)
    s = s.withColumn("way", F.explode(F.array(F.lit(False), F.lit(True))))
    gl, hl = (F.col(f"left_{c}") + F.when(F.col("way"), F.col(f"none_{c}")).otherwise(0.0) for c in ("g", "h"))
    s = s.withColumns({"gl": gl, "hl": hl})
    gr, hr = F.col("all_g") - F.col("gl"), F.col("all_h") - F.col("hl")
    gain = (part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("all_g"), F.col("all_h"))) / 2
    fits = here & (F.col("hl") >= least) & (hr >= least) & (F.col("hl") > 0) & (hr > 0)
    s = s.withColumn("gain", F.round(F.when(fits, gain), 9))
    s = s.withColumn("gain", F.when(F.col("gain") > 0, F.col("gain")))
    order = F.struct("gain", -F.col("feature"), -F.col("bin"), ~F.col("way"))
    best = F.max(F.when(F.col("gain").isNotNull(), F.struct(order.alias("o"), "feature", F.col("bin").alias("cut"), F.col("way").alias("to_left"), "gain", "gl", "hl"))).alias("b")
    found = s.groupBy("model", "node").agg(best, F.max("all_g").alias("g"), F.max("all_h").alias("h"))
    return found.select("model", "node", *[F.col(f"b.{c}").alias(c) for c in ("feature", "cut", "to_left", "gain", "gl", "hl")], "g", "h")


def shared_splits(sums: DataFrame, ridge: Column, noise: Column) -> DataFrame:
    """The best split of a whole level from sums: the greatest sum of both children's scores over all nodes, with noise of so many deviations of the gradients. Missing values are below all others, so they go left."""
    each = Window.partitionBy("model", "node", "feature")
    up = each.orderBy(F.when(F.col("bin") == MISSING, -1).otherwise(F.col("bin"))).rowsBetween(Window.unboundedPreceding, 0)
    s = sums.select("model", "node", "feature", F.col("bin").alias("cut"), *[F.sum(c).over(each).alias(c) for c in ("g", "h")], *[F.sum(c).over(up).alias(f"{c}l") for c in ("g", "h")])
    part = lambda g, h: F.coalesce(F.try_divide(g * g, h + ridge), F.lit(0.0))
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    s = s.withColumn("gain", part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("g"), F.col("h")))
    s = s.where(F.col("cut") != MISSING).groupBy("model", "feature", "cut").agg(F.round(F.sum("gain"), 9).alias("gain"), F.sum("hl").alias("hl"), F.sum("h").alias("h"), F.sum("g").alias("g"))
    s = s.where((F.col("hl") > 0) & (F.col("hl") < F.col("h")) & (F.col("gain") > 0)).withColumn("noisy", F.col("gain") + noise * F.sqrt("h"))
    best = F.max(F.struct("noisy", -F.col("feature"), -F.col("cut"), "feature", "cut", "gain")).alias("b")
    return s.groupBy("model").agg(best, F.max("g").alias("g"), F.max("h").alias("h")).select("model", F.lit(0).alias("node"), F.col("b.feature").alias("feature"), F.col("b.cut").alias("cut"), F.lit(True).alias("to_left"), F.col("b.gain").alias("gain"), F.lit(0.0).alias("gl"), F.lit(0.0).alias("hl"), "g", "h")


def own_space(positive_weight: float, rounds: tuple = (100, 200, 300, 500)) -> dict[str, tuple]:
    """What is searched for trees with splits of their own; the weight of positives among 1, the root of negatives per positive, and that ratio."""
    return {"depth": (2, 3, 4, 5), "rate": (0.01, 0.03, 0.05, 0.1), "rounds": rounds, "rows": (0.7, 0.85, 1.0), "columns": (0.7, 0.85, 1.0), "least": (1.0, 3.0, 5.0, 10.0), "ridge": (1.0, 3.0, 10.0), "weight": (1.0, math.sqrt(positive_weight), positive_weight)}


def symmetric_space(rounds: tuple = (100, 200, 300, 500)) -> dict[str, tuple]:
    """What is searched for symmetric trees, whose classes are balanced."""
    return {"depth": (2, 3, 4, 5), "rate": (0.01, 0.03, 0.05, 0.1), "rounds": rounds, "ridge": (1.0, 3.0, 10.0), "noise": (0.5, 1.0, 2.0)}


def settings(df: DataFrame, label: str, symmetric: bool, draws: int, rounds: tuple = (100, 200, 300, 500), seed: int = 42) -> list[Setting]:
    """Distinct draws from the kind's space, the same for the same seed."""
    space = symmetric_space(rounds) if symmetric else own_space(float(class_weight(df, label).first()[0]), rounds)
    return [Setting(symmetric=symmetric, seed=seed, **p) for p in sample_params(space, draws, seed)]


@dataclass
class Search:
    """Models by setting and fold, fitted in one go. `scores` has each row's out-of-fold probability by setting and group."""

    settings: list[Setting]
    runs: list[Run]
    fit: Fit

    def scores(self, label: str) -> DataFrame:
        """Rows (setting, column, id, fold, label, probability)."""
        of = lambda f: F.get(F.lit([f(r) for r in self.runs]), F.col("model"))
        return self.fit.scores(label).select(of(lambda r: self.settings.index(r.setting)).alias("setting"), of(lambda r: r.column).alias("column"), "id", "fold", label, "probability")

    def best(self, label: str) -> dict[int, tuple[int, float, float]]:
        """Per fold column the setting of the best mean average precision over folds, that mean, and its threshold for a recall of 0.75."""
        s = self.scores(label)
        by = ["setting", "column", "fold"]
        mean = average_precision(s, "probability", label, by).groupBy("setting", "column").agg(F.avg("average_precision").alias("ap"))
        threshold = recall_threshold(s, "probability", label, by=["setting", "column"])
        found = mean.join(threshold, ["setting", "column"]).where("ap IS NOT NULL").groupBy("column").agg(F.max(F.struct("ap", -F.col("setting"), "setting", "threshold")).alias("b"))
        return {r["column"]: (r.b.setting, r.b.ap, float(r.b.threshold)) for r in found.collect()}


def search(df: DataFrame, features: list[str], label: str, folds: dict[str, list[int]], options: list[Setting], id_col: str, scored: str | None = None) -> Search:
    """Every setting fitted to every fold of every fold column (folds: its ids), all side by side. Rows whose `scored` isn't 1 train, but get no score."""
    cuts = bin_cuts(df, features)
    names = list(folds)
    df = df.withColumn("__scored", F.lit(1) if scored is None else F.col(scored).cast("int"))
    blocks = pack(df, features, cuts, label, id_col, [*names, "__scored"])
    runs = [Run(s, c, k) for s in options for c, name in enumerate(names) for k in folds[name]]
    return Search(options, runs, Fit(blocks, features, cuts, runs, len(names) + 1, trees=False))


def fit(df: DataFrame, features: list[str], label: str, setting: Setting, id_col: str) -> Booster:
    """One model of all rows."""
    cuts = bin_cuts(df, features)
    done = Fit(pack(df.withColumns({"__all": F.lit(0), "__scored": F.lit(0)}), features, cuts, label, id_col, ["__all", "__scored"]), features, cuts, [Run(setting)], 2)
    done.close()
    return done.models[0]


def tuned(df: DataFrame, features: list[str], label: str, fold: str, folds: list[int], options: list[Setting], id_col: str, scored: str | None = None) -> tuple[Setting, float, float, Booster]:
    """The best setting by mean average precision over the folds, that mean, the threshold of its out-of-fold scores, and its model of all rows."""
    found = search(df, features, label, {fold: folds}, options, id_col, scored)
    best = found.best(label)
    found.fit.close()
    if not best:
        raise ValueError("no fold has both classes")
    k, ap, threshold = best[0]
    return options[k], ap, threshold, fit(df, features, label, options[k], id_col)


def nested_cv(df: DataFrame, nested: DataFrame, features: list[str], label: str, options: list[Setting], key: str, id_col: str, extra: DataFrame | None = None) -> DataFrame:
    """A report row per outer fold: the setting is chosen and the threshold set on inner folds of the other outer folds.

    nested has key, test_of (an outer fold) and inner, the fold of the key's rows while that outer fold is held out;
    rows of the outer fold aren't in it. All settings, outer and inner folds are fitted in one go. Rows of `extra`
    (synthetic; source_record is a key) train where their source does, and are never scored.
    """
    outer = sorted(r[0] for r in nested.select("test_of").distinct().collect())
    inner = sorted(r[0] for r in nested.select("inner").distinct().collect())
    wide = nested.groupBy(key).agg(*[F.max(F.when(F.col("test_of") == k, F.col("inner"))).alias(f"__fold{k}") for k in outer])
    rows = df.join(wide, key).withColumn("__real", F.lit(1))
    if extra is not None:
        own = extra.join(wide.withColumnRenamed(key, "source_record"), "source_record").withColumn("__real", F.lit(0))
        rows = rows.unionByName(own, allowMissingColumns=True)
    folds = {f"__fold{k}": inner for k in outer}
    found = search(rows, features, label, folds, options, id_col, "__real")
    best = found.best(label)
    found.fit.close()
    names = list(folds)
    cuts = found.fit.models[0].cuts
    # rows that a column leaves out with -1 are those of its outer fold
    runs = [Run(options[best[c][0]], c, -1) for c in range(len(outer)) if c in best]
    whole = Fit(pack(rows.withColumn("__scored", F.col("__real")), features, cuts, label, id_col, [*names, "__scored"]), features, cuts, runs, len(names) + 1, trees=False)
    scores = whole.scores(label)
    out = [evaluate(scores.where(F.col("model") == k), label, best[r.column][2]).withColumns({"model": F.lit("symmetric" if r.setting.symmetric else "boosted"), "fold": F.lit(outer[r.column])}) for k, r in enumerate(runs)]
    spark = df.sparkSession
    report = union_all(out)
    report = spark.createDataFrame(report.collect(), report.schema)  # a row per outer fold
    whole.close()
    return report
