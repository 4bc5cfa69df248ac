"""Quantile gradient boosting, many models in one chain of passes (M1-M3, M5, M6).

Pinball-loss boosting, Friedman-style:

    F0 = q-quantile of y
    per stage: g = q if y > F else q - 1          (negative pinball gradient)
               a tree of the given depth on g      (least squares)
               leaf value = q-quantile of (y - F) among the leaf's rows
               F += rate * leaf value

Features are binned once.  Rows then travel as blocks: one record holds the bins, the
targets, the fold tiles and the scores ``F`` of all models for some thousand rows.
All models (quantile x depth x fold) grow together: one pass over the blocks counts
every (model, node, feature, bin) of a tree level, one more gives all leaf quantiles,
so a search costs as many passes as its longest model and its deepest tree ask for.
Tasks add up the counts of their own blocks and send them, and their residuals, to one task
for each model, which picks the splits of the level or the leaf values.  So the driver gets
a few numbers for each node of a tree, and no counts.  As g has two values, the counts are
whole numbers, and no split depends on how rows are dealt out.

The blocks are written to the shared folder every few stages; in between, a pass first
adds the trees since then to the scores that it reads.  So a lost executor costs its
tasks of one pass, and no lineage grows with the number of stages.  The passes are many
and short, and each is imperative work on a partition's blocks, so they run on the
blocks' RDD: planning a query for each would take most of the time.

Fitted trees are packed in arrays (feature, threshold or label, leaf values) and
scored inside one projection by a fold over the trees; nothing is compiled per tree.
"""

from __future__ import annotations

import copy
import json
import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast import fixed
from tillcast.functions.stats import pinball
from tillcast.session import scratch_path, ship_sources

PCT_ACCURACY = 10000
MAX_BINS = 32
BLOCK_ROWS = 8192        # rows of one record
PART_ROWS = 1 << 18      # rows of one partition at most
EVEN_ROWS = 4096         # rows of one partition at least, as far as there are cores
LEAF_POINTS = 1024       # values by which a task describes the residuals of one leaf
FAN_IN = 16              # tasks that add up at most; residuals of more partitions are thinned on the way
WRITE_EVERY = 8          # stages between two written states
NO_GAIN = 1e-9


# ------------------------------------------------------------------ features as bins
@dataclass(frozen=True)
class Layout:
    """How features become bins: labels of categorical columns, cut values of numeric ones."""

    cats: tuple          # column names
    nums: tuple
    labels: dict         # categorical column -> labels in order
    edges: dict          # numeric column -> ascending cut values; bin = number of cut values below the value

    @property
    def columns(self) -> list[str]:
        return [*self.cats, *self.nums]

    def sizes(self) -> list[int]:
        """Bins of each column; the last one of a categorical column is for unknown labels."""
        return [len(self.labels[c]) + 1 for c in self.cats] + [len(self.edges[c]) + 1 for c in self.nums]


def _split_columns(feature_cols) -> tuple[tuple, tuple]:
    cats = tuple(c for c in fixed.CATEGORICAL_FEATURES if c in feature_cols)
    return cats, tuple(c for c in feature_cols if c not in cats)


def layout_of(rows: DataFrame, feature_cols, max_bins: int = MAX_BINS) -> Layout:
    """M1 preprocessing: labels of item / month / weekday, and quantile cut values of the numeric features."""
    cats, nums = _split_columns(feature_cols)
    labels = {c: sorted(r[0] for r in rows.select(F.col(c).cast("string").alias("l")).distinct().collect() if r[0] is not None)
              for c in cats}
    points = [i / max_bins for i in range(1, max_bins)]
    edges = {c: [] for c in nums}
    if nums:
        got = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), points, PCT_ACCURACY).alias(c) for c in nums],
                       *[F.max(F.col(c).cast("double")).alias(f"max_{c}") for c in nums]).first()
        for c in nums:  # a cut at the greatest value would part nothing
            edges[c] = sorted({float(v) for v in got[c] or [] if v is not None and not math.isnan(v) and v < got[f"max_{c}"]})
    return Layout(cats, nums, labels, edges)


def _packer(layout: Layout, n_models: int, init: list[float]):
    sizes = layout.sizes()
    kind = np.uint16 if max(sizes, default=1) < 1 << 16 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(t: pa.Table) -> pa.RecordBatch:
            bins = np.empty((t.num_rows, len(sizes)), kind)
            for i, c in enumerate(layout.cats):
                at = pc.index_in(t.column(c), pa.array(layout.labels[c], pa.string())).to_numpy(zero_copy_only=False)
                bins[:, i] = np.where(np.isnan(at.astype(float)), sizes[i] - 1, at)
            for i, c in enumerate(layout.nums, len(layout.cats)):
                v = t.column(c).to_numpy().astype(float)  # null as NaN, above all cuts
                bins[:, i] = np.searchsorted(np.array(layout.edges[c]), v, "left")
            score = np.tile(np.array(init, float), (t.num_rows, 1))
            cols = [bins, t.column("_y").to_numpy().astype(float), t.column("_tile").to_numpy().astype(np.int32), score]
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cols], names=["bins", "y", "tile", "score"])

        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(i, BLOCK_ROWS)
                if n + part.num_rows > BLOCK_ROWS:
                    yield block(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block(pa.Table.from_batches(held).combine_chunks())
    return run


BLOCK = "bins binary, y binary, tile binary, score binary"


@dataclass(frozen=True)
class Spec:
    """One model of a chain: ``last_tile`` is the last fold tile that it learns from."""

    quantile: float
    depth: int
    rate: float
    stages: int
    last_tile: int
    min_rows: int = 1


class Tree:
    """A complete binary tree of some depth; a node without a split sends all rows left."""

    def __init__(self, depth: int):
        nodes = (1 << depth) - 1
        self.depth = depth
        self.feature = np.full(nodes, -1, np.int64)
        self.bin = np.zeros(nodes, np.int64)
        self.gain = np.zeros(nodes)
        self.leaf = np.zeros(1 << depth)

    def walk(self, bins: np.ndarray, n_cats: int, levels: int) -> np.ndarray:
        """Number of each row's node within the level."""
        at, flat, row = np.zeros(len(bins), np.int64), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(levels):
            f = self.feature[at]
            v, j = flat[row + np.maximum(f, 0)], self.bin[at]
            at = 2 * at + 1 + (np.where(f < n_cats, v == j, v > j) & (f >= 0))
        return at - ((1 << levels) - 1)


class Block:
    """One record's rows."""

    def __init__(self, record: tuple, n_features: int, n_models: int, kind):
        bins, y, tile, score = record
        self.bins = np.frombuffer(bins, kind).reshape(-1, n_features)
        self.y = np.frombuffer(y, float)
        self.tile = np.frombuffer(tile, np.int32)
        self.score = np.frombuffer(score, float).reshape(-1, n_models)


class Chain:
    """What tasks need to know about the models that grow together."""

    def __init__(self, specs: list[Spec], layout: Layout):
        self.specs, self.n_cats, self.sizes = specs, len(layout.cats), layout.sizes()
        self.offset = np.r_[0, np.cumsum(self.sizes)].astype(np.int64)
        self.kind = np.uint16 if max(self.sizes, default=1) < 1 << 16 else np.int32

        # trees that are not in the written scores yet
        self.pending: list[dict[int, Tree]] = []

    def bare(self) -> "Chain":
        """The models without any tree."""
        out = copy.copy(self)
        out.pending = []
        return out

    def blocks(self, records: Iterator[tuple]) -> Iterator[Block]:
        """Blocks with the scores of today."""
        for r in records:
            block = Block(r, len(self.sizes), len(self.specs), self.kind)
            if self.pending:
                block.score = block.score.copy()
            for trees in self.pending:
                for m, tree in trees.items():
                    block.score[:, m] += self.specs[m].rate * tree.leaf[tree.walk(block.bins, self.n_cats, tree.depth)]
            yield block

    def level_counts(self, trees: dict[int, Tree], level: int):
        """Rows, and rows above their score, of each (model, node, bin) of a level."""
        slots = int(self.offset[-1])

        def run(records):
            total = {m: np.zeros((1 << level) * slots * 2, np.int64) for m in trees}
            for b in self.blocks(records):
                flat = (b.bins.astype(np.int64) + self.offset[:-1]) * 2
                for m, tree in trees.items():
                    pick = np.flatnonzero(b.tile <= self.specs[m].last_tile)
                    if not len(pick):
                        continue
                    # node, slot, and whether the row is above its score
                    at = tree.walk(b.bins[pick], self.n_cats, level) * (2 * slots) + (b.y[pick] > b.score[pick, m])
                    total[m] += np.bincount((flat[pick] + at[:, None]).ravel(), minlength=len(total[m]))
            return total.items()
        return run

    def leaf_values(self, trees: dict[int, Tree], points: int):
        """Residuals of each (model, leaf): values with weights, ``points`` of them at most."""
        def run(records):
            held: dict[int, list] = {m: [np.empty((3, 0))] for m in trees}
            for b in self.blocks(records):
                for m, tree in trees.items():
                    pick = np.flatnonzero(b.tile <= self.specs[m].last_tile)
                    leaf = tree.walk(b.bins[pick], self.n_cats, tree.depth)
                    held[m].append(np.stack([leaf.astype(float), b.y[pick] - b.score[pick, m], np.ones(len(pick))]))
            return [(m, thinned(np.concatenate(x, axis=1), points)) for m, x in held.items()]
        return run

    def advance(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the scores of today, to be written."""
        for raw in batches:
            records = zip(*(raw.column(c).to_pylist() for c in ("bins", "y", "tile", "score")))
            scores = [b.score.tobytes() for b in self.blocks(records)]
            yield pa.RecordBatch.from_arrays([*[raw.column(c) for c in ("bins", "y", "tile")], pa.array(scores, pa.binary())],
                                             names=["bins", "y", "tile", "score"])

    def losses(self, records):
        """Pinball loss and rows of each model on the tile after its last one; scores below 0 count as 0."""
        total = np.zeros((len(self.specs), 2))
        for b in self.blocks(records):
            for m, s in enumerate(self.specs):
                pick = b.tile == s.last_tile + 1
                e = b.y[pick] - np.maximum(b.score[pick, m], 0.0)
                total[m] += np.maximum(s.quantile * e, (s.quantile - 1) * e).sum(), pick.sum()
        return list(enumerate(total))


def thinned(x: np.ndarray, points: int) -> np.ndarray:
    """(leaf, value, weight) columns in order, each leaf cut down to ``points`` values of equal weight if it has more."""
    x = x[:, np.lexsort((x[1], x[0]))]
    leaf, first, n = np.unique(x[0], return_index=True, return_counts=True)
    if not len(n) or n.max() <= points:
        return x
    out = []
    for a, k in zip(first, n):
        part = x[:, a:a + k]
        if k > points:
            reach = np.cumsum(part[2])
            at = np.searchsorted(reach, (np.arange(points) + 0.5) * reach[-1] / points, "left")
            part = np.stack([np.full(points, part[0, 0]), part[1, at], np.full(points, reach[-1] / points)])
        out.append(part)
    return np.concatenate(out, axis=1)


class Grower:
    """Grows the trees of a chain over its blocks."""

    def __init__(self, rows: DataFrame, specs: list[Spec], layout: Layout, n_rows: int, *, target: str):
        self.chain, self.layout, self.specs = Chain(specs, layout), layout, specs
        spark = rows.sparkSession
        ship_sources(spark)
        cores = spark.sparkContext.defaultParallelism
        self.parts = max(1, min(cores, -(-n_rows // EVEN_ROWS)), -(-n_rows // PART_ROWS))
        quantiles = sorted({(s.quantile, s.last_tile) for s in specs})
        inits = rows.agg(*[F.percentile_approx(F.when(F.col("_tile") <= t, F.col(target).cast("double")), q, PCT_ACCURACY).alias(f"i{i}")
                           for i, (q, t) in enumerate(quantiles)]).first()
        start = {k: float(inits[f"i{i}"] or 0.0) for i, k in enumerate(quantiles)}
        self.init = [start[s.quantile, s.last_tile] for s in specs]
        flat = rows.select(*[F.col(c).cast("string").alias(c) for c in layout.cats], *[F.col(c).cast("double").alias(c) for c in layout.nums],
                           F.col(target).cast("double").alias("_y"), F.col("_tile").cast("int").alias("_tile"))
        even = flat.repartition(self.parts, F.xxhash64(*flat.columns))
        self._write(even.mapInArrow(_packer(layout, len(specs), self.init), BLOCK))

    def _write(self, state: DataFrame) -> None:
        """Write the blocks to the shared folder and go on with what is read back."""
        spark = state.sparkSession
        path = scratch_path(spark, "boost")
        state.write.option("compression", "zstd").parquet(path)
        before = getattr(self, "records", None)
        self.written = spark.read.schema(state.schema).parquet(path)
        self.records = (self.written.repartition(self.parts).rdd.map(lambda r: tuple(bytes(x) for x in r))
                            .persist(StorageLevel.MEMORY_AND_DISK))
        self.chain.pending = []
        if before is not None:
            before.unpersist()

    def _by_model(self, task: Callable, merge: Callable, pick: Callable) -> dict[int, tuple]:
        """What ``pick(model, result)`` makes of each model's merged results of a task over all blocks.

        Merging and picking are work of the tasks, so the driver gets what is picked only.
        """
        out = self.records.mapPartitions(task)
        if self.parts > 1:
            out = out.reduceByKey(merge, min(self.parts, FAN_IN, len(self.specs)))
        return dict(out.map(lambda r: (r[0], pick(*r))).collect())

    def _split(self, trees: dict[int, Tree], level: int) -> None:
        chain = self.chain.bare()
        at = slice((1 << level) - 1, (2 << level) - 1)

        def pick(m, counts):
            tree, counts = Tree(level + 1), counts.reshape(1 << level, -1, 2)
            best_splits(tree, level, counts.sum(axis=2), counts[:, :, 1], chain.specs[m], chain)
            return tree.feature[at], tree.bin[at], tree.gain[at]

        for m, found in self._by_model(self.chain.level_counts(trees, level), np.add, pick).items():
            trees[m].feature[at], trees[m].bin[at], trees[m].gain[at] = found

    def _set_leaves(self, trees: dict[int, Tree]) -> None:
        specs, many = self.specs, self.parts > FAN_IN

        def merge(a, b):
            both = np.concatenate([a, b], axis=1)
            return thinned(both, LEAF_POINTS) if many else both

        def pick(m, x):
            tree = Tree(specs[m].depth)
            leaf_quantiles(tree, x, specs[m].quantile)
            return tree.leaf

        for m, leaf in self._by_model(self.chain.leaf_values(trees, LEAF_POINTS), merge, pick).items():
            trees[m].leaf = leaf

    def _losses(self) -> list[float]:
        """Mean loss of each model; every partition has two numbers of each, added up in their order."""
        total = self.records.mapPartitions(self.chain.losses)
        if self.parts > FAN_IN:
            total = total.reduceByKey(np.add, FAN_IN)
        got = np.zeros((len(self.specs), 2))
        for m, x in total.collect():
            got[m] += x
        return [float(a / n) if n else float("inf") for a, n in got]

    def grow(self, score_at=(), progress: Callable | None = None) -> tuple[list[list[Tree]], dict[int, list]]:
        """Trees of each model, and the losses of all models after the stages of ``score_at``."""
        grown: list[list[Tree]] = [[] for _ in self.specs]
        losses: dict[int, list] = {}
        for stage in range(1, max(s.stages for s in self.specs) + 1):
            trees = {m: Tree(s.depth) for m, s in enumerate(self.specs) if stage <= s.stages}
            for level in range(max(t.depth for t in trees.values())):
                self._split({m: t for m, t in trees.items() if t.depth > level}, level)
            self._set_leaves(trees)
            for m, tree in trees.items():
                grown[m].append(tree)
            self.chain.pending.append(trees)
            if stage in score_at:
                losses[stage] = self._losses()
            if len(self.chain.pending) == WRITE_EVERY:
                self._write(self.written.mapInArrow(self.chain.advance, BLOCK))
            if progress:
                progress(stage)
        self.records.unpersist()
        return grown, losses


def best_splits(tree: Tree, level: int, n: np.ndarray, above: np.ndarray, spec: Spec, chain: Chain) -> None:
    """For each node of a level the split of the greatest gain; of equals the first feature, then the first bin.

    ``n`` and ``above`` have a row for each node and a column for each bin of each feature.
    """
    base, width = (1 << level) - 1, np.diff(chain.offset)
    feature = np.repeat(np.arange(len(width)), width)
    first, last = chain.offset[feature], chain.offset[feature + 1] - 1
    s = above - (1 - spec.quantile) * n                      # sum of g
    all_k, all_s = n[:, :width[0]].sum(axis=1, keepdims=True), s[:, :width[0]].sum(axis=1, keepdims=True)
    up_to = lambda x: np.cumsum(x, axis=1) - np.where(first > 0, np.cumsum(x, axis=1)[:, first - 1], 0)
    cat = feature < chain.n_cats                             # one label, or any other; else above a cut, or up to it
    right_k, right_s = np.where(cat, n, all_k - up_to(n)), np.where(cat, s, all_s - up_to(s))
    left_k, left_s = all_k - right_k, all_s - right_s
    ok = (right_k >= spec.min_rows) & (left_k >= spec.min_rows) & (np.arange(len(feature)) < last)
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = np.where(ok, left_s ** 2 / left_k + right_s ** 2 / right_k - all_s ** 2 / all_k, -1.0)
    top = gains.max(axis=1, keepdims=True)
    j = np.argmax(gains >= top - NO_GAIN, axis=1)            # sums of another order may differ in the last digits
    for node in np.flatnonzero(top[:, 0] > NO_GAIN).tolist():
        f = int(feature[j[node]])
        tree.gain[base + node], tree.feature[base + node], tree.bin[base + node] = gains[node, j[node]], f, j[node] - chain.offset[f]


def leaf_quantiles(tree: Tree, x: np.ndarray, q: float) -> None:
    """The least value at which the weights of a leaf reach the share ``q``."""
    x = x[:, np.lexsort((x[2], x[1], x[0]))]
    for leaf in np.unique(x[0]).astype(int):
        part = x[:, x[0] == leaf]
        reach = np.cumsum(part[2])
        tree.leaf[leaf] = part[1, min(int(np.searchsorted(reach, q * reach[-1] - 1e-9, "left")), part.shape[1] - 1)]


# ------------------------------------------------------------------ fitted models
FOREST = "array<struct<f:array<int>,t:array<double>,l:array<string>,v:array<double>>>"


@dataclass
class QuantileBoostModel:
    """One model: packed trees.  ``f`` numbers a numeric feature, or a categorical one where the node has a label ``l``;
    -1 is no split.  A row goes right if its value is above ``t``, or its label is ``l``."""

    quantile: float
    init: float
    learning_rate: float
    trees: list = field(default_factory=list)   # dicts f, t, l, v, g (gain of each node)

    def expression(self, nums: Column, cats: Column) -> Column:
        """The model's value from arrays of numeric values and labels."""
        if not self.trees:
            return F.lit(float(self.init))
        packed = F.from_json(F.lit(json.dumps([{k: t[k] for k in "ftlv"} for t in self.trees])), FOREST, {"allowNonNumericNumbers": "true"})
        depth = max(len(t["v"]) for t in self.trees).bit_length() - 1

        def score(tree):
            def step(i, _):
                f, label = tree["f"][i], tree["l"][i]
                right = (F.when(f < 0, 0)
                         .when(label.isNotNull(), F.when(F.get(cats, f).eqNullSafe(label), 1).otherwise(0))
                         .otherwise(F.when(F.coalesce(F.get(nums, f) <= tree["t"][i], F.lit(False)), 0).otherwise(1)))
                return 2 * i + 1 + right
            leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
            return tree["v"][leaf - ((1 << depth) - 1)]

        return F.aggregate(packed, F.lit(float(self.init)), lambda acc, tree: acc + F.lit(float(self.learning_rate)) * score(tree))

    def first(self, n: int) -> "QuantileBoostModel":
        """The model after its first ``n`` stages: what a fit of n stages gives."""
        return replace(self, trees=self.trees[:n])


def _pack(tree: Tree, layout: Layout) -> dict:
    n = len(layout.cats)
    f, t, labels = [], [], []
    for feature, j in zip(tree.feature.tolist(), tree.bin.tolist()):
        cat = 0 <= feature < n
        f.append(feature if feature < n else feature - n)
        t.append(0.0 if cat or feature < 0 else layout.edges[layout.nums[feature - n]][j])
        labels.append(layout.labels[layout.cats[feature]][j] if cat else None)
    return {"f": f, "t": t, "l": labels, "v": tree.leaf.tolist(), "g": tree.gain.tolist()}


@dataclass
class QuantileModels:
    models: dict             # quantile -> QuantileBoostModel
    feature_cols: tuple

    @property
    def columns(self) -> tuple[tuple, tuple]:
        """Categorical and numeric feature columns, as trees number them."""
        return _split_columns(self.feature_cols)

    def expression(self, q: float, field: Callable) -> Column:
        """A model's value from raw feature fields (``field(name) -> Column``)."""
        cats, nums = self.columns
        row = F.struct((F.array(*[field(c).cast("double") for c in nums]) if nums else F.array().cast("array<double>")).alias("n"),
                       (F.array(*[field(c).cast("string") for c in cats]) if cats else F.array().cast("array<string>")).alias("c"))
        # as a lambda variable the arrays are built once, and not for each node
        return F.transform(F.array(row), lambda r: self.models[q].expression(r["n"], r["c"]))[0]

    def predict(self, df: DataFrame, *, keep=("date", "item_id", "demand_qty")) -> DataFrame:
        """M5: add q50 / q95 (one column per quantile), never below 0 and q95 >= q50."""
        missing = sorted(set(self.feature_cols) - set(df.columns))
        if missing:
            raise ValueError(f"Missing feature columns: {missing}")
        names = {f"q{int(round(q * 100))}": self.expression(q, F.col) for q in sorted(self.models)}
        out = df.select(*[c for c in keep if c in df.columns], *[F.greatest(e, F.lit(0.0)).alias(n) for n, e in names.items()])
        if "q50" in names and "q95" in names:
            out = out.withColumn("q95", F.greatest("q95", "q50"))
        return out

    def feature_importance(self, quantile: float = 0.5) -> list:
        """M6: (feature name, importance, percentage) in descending order: each tree's shares of gain, averaged."""
        cats, nums = self.columns
        total: dict[str, float] = {c: 0.0 for c in nums}
        for t in self.models[quantile].trees:
            gain = sum(t["g"])
            for f, label, g in zip(t["f"], t["l"], t["g"]):
                if f >= 0 and gain > 0:
                    name = nums[f] if label is None else f"{cats[f]}_{label}"
                    total[name] = total.get(name, 0.0) + g / gain
        whole = sum(total.values())
        rows = [(n, v / whole if whole > 0 else 0.0) for n, v in total.items()]
        return [(n, v, round(v * 100, 2)) for n, v in sorted(rows, key=lambda r: (-r[1], r[0]))]


def _spec(quantile: float, params: dict, last_tile: int) -> Spec:
    return Spec(quantile, params.get("max_depth", 3), params.get("learning_rate", 0.1), params.get("n_stages", 20), last_tile,
                params.get("min_instances_per_node", 1))


def _model(spec: Spec, init: float, trees: list[Tree], layout: Layout) -> QuantileBoostModel:
    return QuantileBoostModel(spec.quantile, init, spec.rate, [_pack(t, layout) for t in trees])


def train_quantile_models(train: DataFrame, *, feature_cols=fixed.FEATURE_COLUMNS, quantiles=(0.5, 0.95),
                          target: str = "demand_qty", by_quantile: dict | None = None, **params) -> QuantileModels:
    """M1: one boosted model per quantile, grown together.

    ``by_quantile`` has settings of single quantiles, which go before ``params``.
    """
    specs = [_spec(q, params | (by_quantile or {}).get(q, {}), 1) for q in quantiles]
    rows = train.withColumn("_tile", F.lit(1))
    layout = layout_of(rows, feature_cols)
    g = Grower(rows, specs, layout, rows.count(), target=target)
    grown, _ = g.grow()
    return QuantileModels({s.quantile: _model(s, g.init[m], grown[m], layout) for m, s in enumerate(specs)}, tuple(feature_cols))


def pinball_score(pred: DataFrame, q: float, *, actual="demand_qty", col=None) -> float:
    col = col or f"q{int(round(q * 100))}"
    r = pred.agg(F.avg(pinball(actual, col, q)).alias("p")).first()
    return float(r["p"]) if r and r["p"] is not None else float("inf")


SEARCH_MIN_ROWS = 60  # with short histories allowed, fewer rows are fitted without a search


@dataclass
class SearchResult:
    models: QuantileModels   # the best setting of each quantile, fitted on all rows
    chosen: dict             # quantile -> setting
    scores: list             # (quantile, number of the setting, mean loss over the folds)


def search_and_fit(train: DataFrame, tiles: DataFrame, *, grid: list[dict], quantiles=(0.5, 0.95), n_folds: int = 3,
                   feature_cols=fixed.FEATURE_COLUMNS, target: str = "demand_qty", fit: bool = True) -> SearchResult:
    """M2-M4: expanding date folds (tile <= k trains, tile k+1 tests); the setting with the lowest mean
    pinball loss wins, the first of equals.

    All folds of all settings, and the fits on all rows, grow in one chain.  Settings
    that differ in ``n_stages`` only share one model of the most stages, of which each
    is the start.
    """
    alike: dict = {}
    for i, p in enumerate(grid):
        alike.setdefault(tuple(sorted((k, v) for k, v in p.items() if k != "n_stages")), []).append(i)
    specs, at = [], {}
    for q in quantiles:
        for members in alike.values():
            most = max((grid[i] for i in members), key=lambda p: p.get("n_stages", 20))
            for k in range(1, n_folds + (2 if fit else 1)):
                for i in members:
                    at[q, i, k] = len(specs)
                specs.append(_spec(q, most, k))
    rows = train.join(tiles.select("date", F.col("tile").alias("_tile")), "date").drop("tile")
    layout = layout_of(rows, feature_cols)
    g = Grower(rows, specs, layout, rows.count(), target=target)
    sizes = {p.get("n_stages", 20) for p in grid}
    grown, losses = g.grow(score_at=sizes)
    scores, chosen, models = [], {}, {}
    for q in quantiles:
        mean = [sum(losses[p.get("n_stages", 20)][at[q, i, k]] for k in range(1, n_folds + 1)) / n_folds for i, p in enumerate(grid)]
        scores += [(q, i, v) for i, v in enumerate(mean)]
        best = min(range(len(grid)), key=lambda i: (mean[i], i))
        chosen[q] = grid[best]
        if fit:
            m = at[q, best, n_folds + 1]
            models[q] = _model(specs[m], g.init[m], grown[m], layout).first(grid[best].get("n_stages", 20))
    return SearchResult(QuantileModels(models, tuple(feature_cols)), chosen, scores)


def short_history_setting(train: DataFrame) -> bool:
    """M3: whether the rows are too few to be searched over."""
    return train.limit(SEARCH_MIN_ROWS).count() < SEARCH_MIN_ROWS


def grid_search(train: DataFrame, tiles: DataFrame, *, quantile: float, grid: list[dict], n_folds: int = 3,
                feature_cols=fixed.FEATURE_COLUMNS, allow_short_history: bool = False, base: dict | None = None) -> dict:
    """The best setting of one quantile.

    With ``allow_short_history`` (M3) under 60 rows take the setting ``base`` (the
    first one by default), others are searched over 2 folds, and a failed search
    logs its cause and takes ``base``; otherwise a failure is raised.
    """
    base = grid[0] if base is None else base
    if allow_short_history:
        if short_history_setting(train):
            return base
        n_folds = min(n_folds, 2)
    try:
        return search_and_fit(train, tiles, grid=grid, quantiles=(quantile,), n_folds=n_folds, feature_cols=feature_cols, fit=False).chosen[quantile]
    except Exception as e:
        if not allow_short_history:
            raise
        logging.getLogger(__name__).warning("model search failed, the base setting is used: %s", e)
        return base
