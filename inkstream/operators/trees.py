"""Forests and boosted trees over sparse vectors, fitted by columns.

Spark ML bins every row densely (10 000 terms are 40 KB a row), looks at every cell of it for every level of every tree, and shuffles
the statistics of every node from every task.  Here only cells that differ from zero are kept, as columns: a task holds
some columns for all rows, so the statistics of a node are complete where they are added up and nothing is shuffled.  For a level the tasks
get the node of each row and give back the best split of their columns for each node, and a bit for each row that goes right by it.

The splits are those of Spark ML: the same thresholds, taken from all rows instead of a sample, impurities, least leaf and pruning.  The
draws of a forest (rows by Poisson, the root of the number of features for a node) come from other random numbers than Spark ML's.  The driver
holds about 60 bytes for a training row, and about 20 for a row and tree of the ``CELLS // rows`` trees that are grown together.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions.distributed import cut_lineage, release
from inkstream.session import ensure_checkpoint_dir

#: Up to so many rows Spark ML's own trees are fitted: it takes its thresholds from all rows then, and from a sample beyond.
SMALL = 10_000
#: Rows times trees that are grown together, cells of a block of columns, and pairs of a row and a tree that a task looks at together.
CELLS, BLOCK, CHUNK = 1 << 23, 1 << 22, 1 << 21
#: Impurities below it are zero (Spark ML's bound).
EPSILON = 2.0**-52


@dataclass
class Columns:
    """The vectors by column: labels by row, thresholds of each feature (infinite beyond its last), and blocks of columns.

    A block has, in the order of feature and bin, the feature, bin and end of each of its cells, and the rows of all cells.
    Rows that are in no cell of a feature have its lowest bin.
    """

    labels: np.ndarray
    thresholds: np.ndarray
    blocks: RDD


@dataclass
class Tree:
    """Nodes in the order of growth, children after parents; -1 stands for no child."""

    stats: list[np.ndarray] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)

    def add(self, stats: np.ndarray) -> int:
        for store, value in ((self.stats, stats), (self.gain, -1.0), (self.left, -1), (self.right, -1), (self.feature, -1), (self.threshold, 0.0)):
            store.append(value)
        return len(self.stats) - 1


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all cells that are not zero."""
    kinds, sizes, indices, values = (vectors.field(c) for c in ("type", "size", "indices", "values"))
    ends = values.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(vectors)), np.diff(ends))
    value = values.values.to_numpy()[ends[0] : ends[-1]]
    if not np.any(kinds.to_numpy()):
        own = indices.offsets.to_numpy()
        feature = indices.values.to_numpy()[own[0] : own[-1]].astype(np.int64)
    else:  # dense vectors have no indices
        lists = zip(indices.to_pylist(), np.diff(ends), strict=True)
        feature = np.concatenate([np.arange(n) if x is None or len(x) != n else np.array(x, np.int64) for x, n in lists])
    some = value != 0
    return owner[some], feature[some], value[some]


def thresholds_of(values: np.ndarray, counts: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Spark ML's thresholds of a feature from its values that are not zero and how many rows have each."""
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    zeros = rows - int(counts.sum())
    if zeros:
        at = int(np.searchsorted(values, 0.0))
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    stride, before = rows / bins, np.cumsum(counts)[:-1]
    target, chosen = stride, []
    for i, seen in enumerate(before):
        if abs(seen - target) < abs(seen + counts[i + 1] - target):
            chosen.append(middle[i])
            target += stride
    return np.array(chosen)


def columns_of(table: DataFrame, label: str, features: str, bins: int) -> Columns | None:
    """The rows of ``table`` by column, or None where a value is below zero."""
    rows = cut_lineage(table.select(F.monotonically_increasing_id().alias("at"), F.col(label).cast("double").alias("y"), F.col(features).alias("v")))
    heads = rows.select("at", "y").orderBy("at").toArrow()
    parts, starts = np.unique(heads.column("at").to_numpy() >> 33, return_index=True)
    first = np.zeros(int(parts.max(initial=0)) + 1, dtype=np.int64)
    first[parts] = starts
    labels, n = heads.column("y").to_numpy(), heads.num_rows

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, feature, value = _entries(batch.column(0))
            if len(feature):
                order = np.lexsort((value, feature))
                feature, value = feature[order], value[order]
                new = np.flatnonzero(np.r_[True, (np.diff(feature) != 0) | (np.diff(value) != 0)])
                count = np.diff(np.r_[new, len(feature)])
                yield pa.RecordBatch.from_arrays([pa.array(feature[new]), pa.array(value[new]), pa.array(count)], names=["f", "x", "n"])

    def cut(found: pa.Table) -> pa.Table:
        value, count = found.column("x").to_numpy(), found.column("n").to_numpy()
        own = thresholds_of(value, count, n, bins)
        return pa.table(
            {
                "f": found.column("f").slice(0, 1), "low": pa.array([float(value.min())]), "n": pa.array([int(count.sum())]),
                "cuts": pa.array([own.tolist()], pa.list_(pa.float64())),
            }
        )

    counts = rows.select("v").mapInArrow(valued, "f bigint, x double, n bigint").groupBy("f", "x").agg(F.sum("n").alias("n"))
    found = counts.groupBy("f").applyInArrow(cut, "f bigint, low double, n bigint, cuts array<double>").toArrow()
    if found.num_rows and min(found.column("low").to_pylist()) < 0:
        release(rows)
        return None
    size = int(rows.select("v").first()["v"].size) if n else 0
    thresholds, held = np.full((size, bins - 1), np.inf), np.zeros(size, dtype=np.int64)
    for f, many, cuts in zip(*(found.column(c).to_pylist() for c in ("f", "n", "cuts")), strict=True):
        thresholds[f, : len(cuts)], held[f] = cuts, many
    context = table.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, -(-int(held.sum()) // BLOCK))
    place, load = np.zeros(size, dtype=np.int64), np.zeros(tasks)
    for f in np.argsort(-held, kind="stable"):  # the columns of most cells first, each to the block that has least
        place[f] = load.argmin()
        load[place[f]] += held[f] + 1
    shared = context.broadcast((first, thresholds, place))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, thresholds, place = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            owner, feature, value = _entries(batch.column(1))
            row = (first[at >> 33] + (at & ((1 << 33) - 1)))[owner]
            bin_ = np.zeros(len(feature), dtype=np.int64)
            for i in range(thresholds.shape[1]):
                above = np.flatnonzero(value > thresholds[feature, i]) if i == 0 else above[value[above] > thresholds[feature[above], i]]
                if not len(above):
                    break
                bin_[above] += 1
            some = bin_ > 0
            cell = pa.array(feature[some] * 256 + bin_[some])
            yield pa.RecordBatch.from_arrays([pa.array(place[feature[some]]), cell, pa.array(row[some].astype(np.int32))], names=["block", "cell", "row"])

    def packed(key: tuple, found: pa.Table) -> pa.Table:
        cell, row = found.column("cell").to_numpy(), found.column("row").to_numpy()
        order = np.lexsort((row, cell))
        cell, row = cell[order], row[order]
        new = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
        block = (cell[new] >> 8).astype(np.int32), (cell[new] & 255).astype(np.int32), np.r_[new[1:], len(cell)], row
        return pa.table({"block": pa.array([key[0].as_py()]), "held": pa.array([pickle.dumps(block, protocol=5)], pa.binary())})

    cells = rows.select("at", "v").mapInArrow(dealt, "block bigint, cell bigint, row int")
    blocks = cut_lineage(cells.groupBy("block").applyInArrow(packed, "block bigint, held binary"))
    release(rows)
    own = blocks.rdd.map(lambda r: (r[0], bytes(r[1]))).partitionBy(tasks, int).values().persist(StorageLevel.MEMORY_AND_DISK)
    return Columns(labels, thresholds, own)


def _spans(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last cell of each column."""
    new = np.flatnonzero(np.r_[True, np.diff(features) != 0])
    return new, np.r_[new[1:], len(features)] - 1


def _from_here(sums: np.ndarray, features: np.ndarray) -> np.ndarray:
    """For each cell (last axis), the sums of it and of the cells of higher bins of its feature."""
    out = sums.copy()
    new, last = _spans(features)
    from_end = np.repeat(last, last - new + 1) - np.arange(len(features))
    for d in range(1, int(from_end.max(initial=0)) + 1):
        at = np.flatnonzero(from_end == d)
        out[..., at] += out[..., at + 1]
    return out


def _boosted_split(block: tuple, node: np.ndarray, target: np.ndarray, rows: np.ndarray, sums: np.ndarray, least: int) -> tuple:
    """Gain, feature, bin of the best split of each node by a block's columns, and the bits of the rows that go right."""
    features, bins, ends, at = block
    nodes, cells = len(rows), len(features)
    starts = np.r_[0, ends[:-1]]
    own = node[at]
    key = own.astype(np.int64) * cells + np.repeat(np.arange(cells), ends - starts)
    shape, size = (nodes + 1, cells), (nodes + 1) * cells
    held = _from_here(np.bincount(key, minlength=size).reshape(shape)[:nodes], features)
    total = _from_here(np.bincount(key, target[at], minlength=size).reshape(shape)[:nodes], features)
    n, s = rows[:, None], sums[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (total**2 / held + (s - total) ** 2 / (n - held) - s**2 / n) / n
    gain[(held < least) | (n - held < least)] = -np.inf
    best = gain.argmax(axis=1)
    right = np.zeros(len(node), dtype=bool)
    last = np.repeat(*(lambda new, last: (last, last - new + 1))(*_spans(features)))
    for k, c in enumerate(best):
        if gain[k, c] > 0:
            span = slice(starts[c], ends[last[c]])
            right[at[span][own[span] == k]] = True
    return gain[np.arange(nodes), best], features[best], bins[best] - 1, np.packbits(right)


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1, keepdims=True)
    return 1 - ((counts / np.maximum(n, 1)) ** 2).sum(axis=-1)


def _forest_split(block: tuple, level: tuple, bag: np.ndarray, label: np.ndarray, least: int) -> tuple:
    """As :func:`_boosted_split` for the nodes of many trees, each by the features drawn for it: ``level`` has the node of each row and tree
    (their number for rows in none), class counts of the nodes, and the nodes of each feature as ends and a list."""
    node, counts, asked_ends, asked = level
    features, bins, ends, at = block
    starts = np.r_[0, ends[:-1]]
    nodes, classes = counts.shape
    trees = node.shape[1]
    best, feature, bin_ = np.full(nodes, -np.inf), np.full(nodes, -1, dtype=np.int32), np.full(nodes, -1, dtype=np.int32)
    impurity, size = _gini(counts), counts.sum(axis=1)
    look = np.full(nodes + 1, -1, dtype=np.int32)
    spans = [(first, last + 1) for first, last in zip(*_spans(features), strict=True)]
    step = max(1, CHUNK // trees)

    def met(first: int, stop: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, tree, cell of the column and ``look`` of what is in the nodes looked for."""
        cell = np.repeat(np.arange(stop - first), ends[first:stop] - starts[first:stop])
        own = at[starts[first] : ends[stop - 1]]
        for low in range(0, len(own), step):
            row = own[low : low + step]
            seen = look[node[row]]
            i, tree = np.nonzero(seen >= 0)
            yield row[i], tree, cell[low + i], seen[i, tree]

    for first, stop in spans:
        f, width = features[first], stop - first
        wanted = asked[asked_ends[f] : asked_ends[f + 1]]
        if not len(wanted):
            continue
        look[wanted] = np.arange(len(wanted))
        sums = np.zeros(len(wanted) * width * classes)
        for row, tree, cell, slot in met(first, stop):
            sums += np.bincount((slot.astype(np.int64) * width + cell) * classes + label[row], bag[row, tree], minlength=len(sums))
        look[wanted] = -1
        right = np.cumsum(sums.reshape(-1, width, classes)[:, ::-1], axis=1)[:, ::-1]
        left = counts[wanted][:, None] - right
        n, held = size[wanted][:, None], right.sum(axis=2)
        gain = impurity[wanted][:, None] - held / n * _gini(right) - (n - held) / n * _gini(left)
        gain[(held < least) | (n - held < least)] = -np.inf
        top = gain.argmax(axis=1)
        gain = gain[np.arange(len(wanted)), top]
        better = gain > best[wanted]
        some = wanted[better]
        best[some], feature[some], bin_[some] = gain[better], f, bins[first + top[better]] - 1
    goes = np.zeros(node.shape, dtype=bool)
    order = np.argsort(feature, kind="stable")
    groups = np.searchsorted(feature[order], features[[s[0] for s in spans]]), np.searchsorted(feature[order], features[[s[0] for s in spans]], "right")
    for (first, stop), low, high in zip(spans, *groups, strict=True):
        if low < high:
            chosen = order[low:high]
            look[chosen] = bin_[chosen]
            for row, tree, cell, limit in met(first, stop):
                over = bins[first + cell] > limit
                goes[row[over], tree[over]] = True
            look[chosen] = -1
    return best, feature, bin_, np.packbits(goes)


def _chosen(found: list[tuple], node: np.ndarray, nodes: int) -> tuple[np.ndarray, ...]:
    """Gain, feature and bin of the best split of each node over all blocks, and whether a row goes right (False in no node)."""
    gains, features, bins, bits = (np.stack(x) for x in zip(*found, strict=True))
    order = np.lexsort((features, -gains), axis=0)[0]  # of equal gains the first feature, as in Spark ML
    nodes_at = np.arange(nodes)
    flat = node.reshape(-1)
    some = np.flatnonzero(flat < nodes)
    right = np.zeros(len(flat), dtype=bool)
    right[some] = (bits[order[flat[some]], some >> 3] >> (7 - (some & 7))) & 1
    return gains[order, nodes_at], features[order, nodes_at], bins[order, nodes_at], right.reshape(node.shape)


def _tasks(columns: Columns, work) -> list[tuple]:
    def run(blocks: Iterator[bytes]) -> Iterator[tuple]:
        for block in blocks:
            yield work(pickle.loads(block))

    return columns.blocks.mapPartitions(run).collect()


def boost(columns: Columns, rounds: int, depth: int, step: float, least: int, min_gain: float) -> list[Tree]:
    """Regression trees for the logistic loss; the first counts in full, later ones by ``step``."""
    context = columns.blocks.ctx
    sign = 2 * columns.labels - 1
    margin = np.zeros(len(sign))
    trees = []
    for m in range(rounds):
        target = sign if m == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        targets = context.broadcast(target)
        tree, leaf = Tree(), np.zeros(len(sign), dtype=np.int32)
        tree.add(np.array([len(sign), target.sum(), (target**2).sum()]))
        active = [0]
        for _ in range(depth):
            active = [k for k in active if _variance(tree.stats[k]) >= EPSILON]
            if not active:
                break
            place = np.full(len(tree.stats), len(active), dtype=np.int32)
            place[active] = np.arange(len(active))
            node = place.astype(np.min_scalar_type(len(active)))[leaf]
            stats = np.stack([tree.stats[k] for k in active])
            nodes = context.broadcast(node)
            found = _tasks(columns, lambda b, v=nodes, t=targets, s=stats: _boosted_split(b, v.value, t.value, s[:, 0], s[:, 1], least))
            nodes.destroy()
            gain, feature, bin_, right = _chosen(found, node, len(active)) if found else (np.full(len(active), -1.0), None, None, None)
            grown = np.flatnonzero((gain > 0) & (gain >= min_gain))
            new = np.zeros((len(active) + 1, 2), dtype=np.int32)
            new[:-1] = np.array(active)[:, None]
            new[grown] = len(tree.stats) + np.arange(2 * len(grown)).reshape(-1, 2)
            if not len(grown):
                break
            some = np.flatnonzero(node < len(active))
            leaf[some] = new[node[some], right[some].astype(np.int8)]
            sums = [np.bincount(leaf, w, minlength=len(tree.stats) + 2 * len(grown)) for w in (None, target, target**2)]
            for k in grown:
                at = active[k]
                tree.gain[at], tree.feature[at] = float(gain[k]), int(feature[k])
                tree.threshold[at] = float(columns.thresholds[feature[k], bin_[k]])
                tree.left[at], tree.right[at] = (tree.add(np.array([x[child] for x in sums])) for child in new[k])
            active = [int(c) for k in grown for c in new[k]]
        targets.destroy()
        values = np.array([s[1] / s[0] for s in tree.stats])
        margin += (1.0 if m == 0 else step) * values[leaf]
        trees.append(tree)
    return trees


def _variance(stats: np.ndarray) -> float:
    n, s, q = stats
    return float((q - s * s / n) / n)


def _drawn(rng: np.random.Generator, nodes: int, features: int, some: int) -> np.ndarray:
    """``some`` different features for each node."""
    if some >= features:
        return np.tile(np.arange(features), (nodes, 1))
    out = np.sort(rng.integers(0, features, (nodes, some)), axis=1)
    while True:
        again = np.zeros(out.shape, dtype=bool)
        again[:, 1:] = out[:, 1:] == out[:, :-1]
        if not again.any():
            return out
        out[again] = rng.integers(0, features, int(again.sum()))
        rows = again.any(axis=1)
        out[rows] = np.sort(out[rows], axis=1)


def forest(columns: Columns, number: int, depth: int, least: int, min_gain: float, seed: int) -> list[Tree]:
    """Classification trees on rows drawn with replacement; the root of the number of features for a node (all for one tree)."""
    context = columns.blocks.ctx
    label = columns.labels.astype(np.int64)
    rows, features, classes = len(label), len(columns.thresholds), max(2, int(label.max(initial=0)) + 1)
    some = features if number == 1 else int(np.ceil(np.sqrt(features)))
    out: list[Tree] = []
    labels = context.broadcast(label.astype(np.uint8 if classes < 256 else np.int32))
    together = max(1, CELLS // max(rows, 1))
    for low in range(0, number, together):
        trees = [Tree() for _ in range(low, min(number, low + together))]
        draws = (np.random.default_rng([seed, low + t]) for t in range(len(trees)))
        bag = np.stack([rng.poisson(1.0, rows).astype(np.uint8) if number > 1 else np.ones(rows, np.uint8) for rng in draws], axis=1)
        bags = context.broadcast(bag)
        node = np.where(bag > 0, np.arange(len(trees), dtype=np.int32), np.int32(len(trees)))
        active, counts = [], _class_counts(node, bag, label, len(trees), classes)
        for t, tree in enumerate(trees):
            active.append((t, tree.add(counts[t])))
        keep = np.flatnonzero(_gini(counts) >= EPSILON)
        for deep in range(depth):
            place = np.full(len(active) + 1, len(keep), dtype=np.int32)
            place[keep] = np.arange(len(keep))
            node = place[node]
            active, counts = [active[k] for k in keep], counts[keep]
            if not active:
                break
            drawn = _drawn(np.random.default_rng([seed, number, low, deep]), len(active), features, some)
            order = np.argsort(drawn, axis=None, kind="stable")
            asked_ends = np.searchsorted(drawn.reshape(-1)[order], np.arange(features + 1))
            level = context.broadcast((node, counts, asked_ends, (order // drawn.shape[1]).astype(np.int32)))
            found = _tasks(columns, lambda b, v=level, w=bags, y=labels: _forest_split(b, v.value, w.value, y.value, least))
            level.destroy()
            if not found:
                break
            gain, feature, bin_, right = _chosen(found, node, len(active))
            grown = np.flatnonzero((gain > 0) & (gain >= min_gain))
            new = np.full((len(active) + 1, 2), 2 * len(grown), dtype=np.int32)
            new[grown] = np.arange(2 * len(grown)).reshape(-1, 2)
            node = new[node, right.astype(np.int8)]
            counts = _class_counts(node, bag, label, 2 * len(grown), classes)
            below = []
            for i, k in enumerate(grown):
                t, at = active[k]
                tree = trees[t]
                tree.gain[at], tree.feature[at] = float(gain[k]), int(feature[k])
                tree.threshold[at] = float(columns.thresholds[feature[k], bin_[k]])
                tree.left[at], tree.right[at] = tree.add(counts[2 * i]), tree.add(counts[2 * i + 1])
                below += [(t, tree.left[at]), (t, tree.right[at])]
            active, keep = below, np.flatnonzero(_gini(counts) >= EPSILON)
        bags.destroy()
        out += trees
    labels.destroy()
    return out


def _class_counts(node: np.ndarray, bag: np.ndarray, label: np.ndarray, nodes: int, classes: int) -> np.ndarray:
    key = node.astype(np.int64) * classes + label[:, None]
    return np.bincount(key.reshape(-1), bag.reshape(-1), minlength=(nodes + 1) * classes)[: nodes * classes].reshape(nodes, classes)


def _pruned(tree: Tree, predictions: np.ndarray) -> np.ndarray:
    """Nodes that stay when leaves of one parent that predict the same are merged; parents that become leaves lose their children."""
    keep = np.ones(len(tree.stats), dtype=bool)
    for at in range(len(tree.stats) - 1, -1, -1):
        a, b = tree.left[at], tree.right[at]
        if a >= 0 and tree.left[a] < 0 and tree.left[b] < 0 and predictions[a] == predictions[b]:
            keep[[a, b]] = False
            tree.left[at] = tree.right[at] = -1
    return keep


def _saved(estimator: Estimator, trees: list[Tree], weights: list[float], kinds: tuple[str, str], features: int, about: dict, spark) -> str:
    """The folder of a model in Spark ML's own format."""
    classifies = "numClasses" in about
    params = {p.name: v for p, v in estimator._paramMap.items()}
    defaults = {p.name: v for p, v in estimator._defaultParamMap.items()}
    head = {"timestamp": 0, "sparkVersion": spark.version, "paramMap": params, "defaultParamMap": defaults}
    tables, metadata = [], []
    for t, tree in enumerate(trees):
        stats = np.stack(tree.stats)
        if classifies:
            predictions, impurity, count = stats.argmax(axis=1).astype(float), _gini(stats), stats.sum(axis=1)
            keep = _pruned(tree, predictions)
        else:
            predictions, count = stats[:, 1] / stats[:, 0], stats[:, 0]
            impurity = np.maximum((stats[:, 2] - stats[:, 1] ** 2 / count) / count, 0.0)
            keep = np.ones(len(stats), dtype=bool)
        number = np.cumsum(keep) - 1
        left, right = (np.array(x)[keep] for x in (tree.left, tree.right))
        inner = left >= 0
        cuts = np.array(tree.threshold)[keep][inner]
        ends = np.r_[0, np.cumsum(inner)]
        split = pa.StructArray.from_arrays(
            [
                pa.array(np.where(inner, np.array(tree.feature)[keep], -1).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cuts, pa.float64())), pa.array(np.full(len(left), -1, np.int32)),
            ],
            names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
        )
        shape = pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1) * stats.shape[1], pa.int32()), pa.array(stats[keep].reshape(-1)))
        child = [np.where(inner, number[x], -1).astype(np.int32) for x in (left, right)]
        values = {
            "id": pa.array(np.arange(len(left), dtype=np.int32)), "prediction": pa.array(predictions[keep]), "impurity": pa.array(impurity[keep]),
            "impurityStats": shape, "rawCount": pa.array(count[keep].astype(np.int64)), "gain": pa.array(np.where(inner, np.array(tree.gain)[keep], -1.0)),
            "leftChild": pa.array(child[0]), "rightChild": pa.array(child[1]), "split": split,
        }
        node = pa.StructArray.from_arrays(list(values.values()), names=list(values))
        tables.append(pa.table({"treeID": pa.array(np.full(len(left), t, np.int32)), "nodeData": node}))
        own = {k: v for k, v in params.items() if k in ("featuresCol", "labelCol", "maxDepth")}
        metadata.append((t, json.dumps({"class": kinds[1], **head, "uid": f"tree_{uuid.uuid4().hex[:12]}", "paramMap": own, "defaultParamMap": {}}), float(weights[t])))
    folder = f"{ensure_checkpoint_dir(spark)}/inkstream-{uuid.uuid4().hex}"
    whole = json.dumps({"class": kinds[0], **head, "uid": estimator.uid, "numFeatures": features, "numTrees": len(trees), **about})
    spark.createDataFrame(pa.concat_tables(tables)).write.parquet(f"{folder}/data")
    spark.createDataFrame(metadata, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{folder}/treesMetadata")
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{folder}/metadata")
    return folder


def _loaded(estimator: Estimator, model: type, folder: str, spark):
    out = model.load(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out.setParent(estimator) if hasattr(out, "setParent") else out


class _ByColumns:
    """Fits by columns above ``SMALL`` rows, where nothing is asked for that only Spark ML's own fit knows."""

    def _columns(self, dataset: DataFrame) -> Columns | None:
        other = "weightCol", "validationIndicatorCol", "thresholds", "leafCol", "featureSubsetStrategy", "subsamplingRate", "minWeightFractionPerNode", "bootstrap"
        known = not any(self.hasParam(p) and self.isSet(p) for p in other) and self.getMaxBins() <= 256
        if not known or dataset.limit(SMALL + 1).count() <= SMALL:
            return None
        return columns_of(dataset, self.getLabelCol(), self.getFeaturesCol(), self.getMaxBins())


class Forest(_ByColumns, RandomForestClassifier):
    """A random forest that scales with the cells that are not zero."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        columns = self._columns(dataset) if self.getImpurity() == "gini" and self.getNumTrees() > 1 else None
        if columns is None:
            return super()._fit(dataset)
        trees = forest(columns, self.getNumTrees(), self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain(), self.getSeed())
        columns.blocks.unpersist()
        kinds = tuple(f"org.apache.spark.ml.classification.{x}ClassificationModel" for x in ("RandomForest", "DecisionTree"))
        about = {"numClasses": len(trees[0].stats[0])}
        folder = _saved(self, trees, [1.0] * len(trees), kinds, len(columns.thresholds), about, dataset.sparkSession)
        return _loaded(self, RandomForestClassificationModel, folder, dataset.sparkSession)


class Boosted(_ByColumns, GBTClassifier):
    """Boosted trees for two classes that scale with the cells that are not zero."""

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        columns = self._columns(dataset)
        if columns is None:
            return super()._fit(dataset)
        step = self.getStepSize()
        trees = boost(columns, self.getMaxIter(), self.getMaxDepth(), step, self.getMinInstancesPerNode(), self.getMinInfoGain())
        columns.blocks.unpersist()
        kinds = "org.apache.spark.ml.classification.GBTClassificationModel", "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
        weights = [1.0] + [step] * (len(trees) - 1)
        folder = _saved(self, trees, weights, kinds, len(columns.thresholds), {}, dataset.sparkSession)
        return _loaded(self, GBTClassificationModel, folder, dataset.sparkSession)
