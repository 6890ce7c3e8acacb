"""Groups of documents whose word n-gram sets are alike, linked by an exact Jaccard similarity.

Two documents link when ``100 * |intersection| >= percent * |union|`` of their sets of word n-grams (words A-Z lower-cased).  The result names for
each document the smallest one reachable by links.

Method (signature trees).
1. Equal sets are one node.  A node's n-grams fall by their hash into more parts than two linked sets of its size class can differ in, so
   linked nodes agree on the whole of some part that is not empty; nodes with too many empty parts also offer their first
   n-grams in hash order.  Parts with equal content bring nodes together: groups.
2. Groups, in blocks of bounded size, are searched by signature trees: leaves hold a node's token bitmap and set size, inner nodes the OR of
   the bitmaps and the range of sizes.  Two trees are walked together; a pair of tree nodes goes no further if its sizes are too far apart, or if
   the common bits, plus what bitmaps lose by collisions, cannot reach the overlap that the smallest sizes need.  Pairs that survive make clusters.
3. In each cluster the overlaps are counted exactly, again in pairs of bounded blocks, from 64-bit n-gram hashes.  Links, reduced to a
   spanning forest for each block, give the components.

Only parts that two nodes or more share leave the first step, and every later table holds a row for each node and block at most: no list of all pairs of a
group is ever made.  Blocks are paired, however: a part that M nodes share makes about (M / GROUP_BLOCK)^2 / 2 of them in one task.

Cases.  A text with fewer words than ``n`` is one n-gram of all its words; without words or text the set is empty, links with
nothing and is its own component.  Repeated rows are equal sets.  Rows with one key are one document for ``component_id`` but each keeps its own
set; a null key stays null, is never the smallest unless alone.  Very long texts are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from inkstream.functions.distributed import cut_lineage
from inkstream.llm import sketch
from inkstream.llm.arrays import Words, mix, ngram_hashes, pack, pieces, span_hashes, text_slices, unpack, words_of
from inkstream.llm.components import connected_components

_U = np.uint64
#: Nodes in a block of a group, and of a cluster.
GROUP_BLOCK = 512
CLUSTER_BLOCK = 1024
#: Children of a tree node.
FANOUT = 8
#: Bits of a bitmap for each n-gram of the largest set of a class.
BITS = 4


# ---- sets ----


def set_of(words: Words, d: int, grams: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of document ``d``."""
    a, b = words.first[d], words.first[d + 1]
    if b - a >= n:
        return np.unique(grams[a : b - n + 1])
    if b > a:
        return span_hashes(words.hashes, np.array([a]), np.array([b]))
    return np.zeros(0, dtype=_U)


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of every text."""
    for row, data, offsets in text_slices(texts):
        words = words_of(data, offsets, lower=True)
        grams = ngram_hashes(words.hashes, n)
        for d in range(len(offsets) - 1):
            yield row + d, set_of(words, d, grams, n)


def node_of(grams: np.ndarray) -> int:
    """The name of a set: a 63-bit hash."""
    return int(span_hashes(grams, np.array([0]), np.array([len(grams)]), 1)[0] >> _U(1))


# ---- classes of set sizes and their parts ----


@lru_cache
def size_classes() -> tuple[int, ...]:
    """Lower bounds of the classes: each half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return tuple(out)


def differences(size_class: int, percent: int) -> int:
    """In how many n-grams two linked sets can differ if the larger one is of the class."""
    largest = size_classes()[size_class + 1] - 1
    return (100 - percent) * 2 * largest // (100 + percent)


def part_count(size_class: int, percent: int) -> int:
    allowed = differences(size_class, percent)
    return allowed + 2 + allowed // 12


def classes_of(size: int, percent: int) -> list[int]:
    """The own class, and the next one if a linked set can be in it."""
    bounds = size_classes()
    own = bisect_right(bounds, size) - 1
    out = [own]
    if 100 * size >= percent * bounds[own + 1]:
        out.append(own + 1)
    return [c for c in out if differences(c, percent)]


def part_keys(grams: np.ndarray, size_class: int, percent: int) -> np.ndarray:
    """Keys of a set in a class; the class is in their lowest byte."""
    parts = part_count(size_class, percent)
    part = ((grams >> _U(32)) * _U(parts)) >> _U(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    content = np.add.reduceat(mix(grams, 11), first) + part[first] * _U(0x9E3779B97F4A7C15)
    keys = mix(content, 12)
    if len(first) <= differences(size_class, percent):  # so many empty parts that linked ones might agree on those alone
        prefix = len(grams) - -(-percent * len(grams) // 100) + 1
        keys = np.concatenate([keys, mix(grams[:prefix], 13)])
    return (keys & ~_U(0xFF)) | _U(size_class)


# ---- signature trees ----


def bitmap_words(size_class: int) -> int:
    """64-bit words of the bitmaps of a class."""
    return -(-BITS * (size_classes()[size_class + 1] - 1) // 64)


def bitmap(grams: np.ndarray, size_class: int) -> np.ndarray:
    words = bitmap_words(size_class)
    bit = ((grams & _U(0xFFFFFFFF)) * _U(64 * words)) >> _U(32)
    out = np.zeros(words, dtype=_U)
    np.bitwise_or.at(out, (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return out


class SignatureTree:
    """Levels from the leaves up: bitmaps, smallest and largest sizes, and the most n-grams that share bits."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        # neighbours share their first bits where they can
        self.order = np.lexsort((sizes, *bitmaps[:, :3].T[::-1]))
        maps, low = bitmaps[self.order], sizes[self.order]
        lost = low - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, low, low, lost)]
        while len(maps) > 1:
            at = np.arange(0, len(maps), FANOUT)
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            low = np.minimum.reduceat(self.levels[-1][1], at)
            high = np.maximum.reduceat(self.levels[-1][2], at)
            lost = np.maximum.reduceat(self.levels[-1][3], at)
            self.levels.append((maps, low, high, lost))


def _possible(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether some pair below tree nodes ``i`` and ``j`` can link."""
    out = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    keep = np.flatnonzero(out)
    step = max(64, (1 << 19) // a[0].shape[1])  # 4 MB of bitmaps at once
    for first in range(0, len(keep), step):
        some = keep[first : first + step]
        x, y = i[some], j[some]
        common = np.bitwise_count(a[0][x] & b[0][y]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][x], b[3][y])
        out[some] = (100 + percent) * common >= percent * (a[1][x] + b[1][y])
    return out


def dual_traversal(left: SignatureTree, right: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (as given to the trees) that may link; of a tree with itself, each pair once."""
    own = left is right
    at, bt = len(left.levels) - 1, len(right.levels) - 1
    i = j = np.zeros(1, dtype=np.int64)
    while True:
        keep = _possible(left.levels[at], right.levels[bt], i, j, percent)
        if own:
            keep &= i <= j
        i, j = i[keep], j[keep]
        if at == bt == 0:
            break
        if at >= bt:
            i, j = _children(i, j, len(left.levels[at - 1][0]))
            at -= 1
            if own:
                j, i = _children(j, i, len(right.levels[bt - 1][0]))
                bt -= 1
        else:
            j, i = _children(j, i, len(right.levels[bt - 1][0]))
            bt -= 1
    if own:
        i, j = i[i < j], j[i < j]
    return left.order[i], right.order[j]


def _children(i: np.ndarray, j: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    child = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    other = np.repeat(j, FANOUT)
    return child[child < below], other[child < below]


def forest(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the components that the pairs ``a``, ``b`` give."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(count))
    return moved, label[moved]


def named_forest(edges: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """The edges of several blocks as one spanning forest of stars around the smallest names."""
    if not edges:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    left, right = (np.concatenate(side) for side in zip(*edges, strict=True))
    names, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = forest(places[: len(left)], places[len(left) :], len(names))
    return pa.table({"a": names[a], "b": names[b]})


def linked_pairs(sets: list[np.ndarray], split: int | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among the sets, or between the first ``split`` ones and the others, by exact overlaps.

    Overlaps are products of 0/1 matrices over the n-grams that two sets or more hold, some columns at a time.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), sizes)
    order = np.argsort(grams := np.concatenate(sets), kind="stable")
    ranked = grams[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    held = np.bincount(np.cumsum(new) - 1)
    column = np.cumsum(new) - 1
    shared = held[column] > 1
    column = (np.cumsum(held > 1) - 1)[column[shared]]
    rows = owner[order][shared]
    wide = int(column[-1]) + 1 if len(column) else 0
    cut = count if split is None else split
    overlap = np.zeros((cut, count if split is None else count - cut), dtype=np.float32)
    step = 4096
    edges = np.searchsorted(column, np.arange(0, wide + step, step))
    for k in range(len(edges) - 1):
        matrix = np.zeros((count, step), dtype=np.float32)
        matrix[rows[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * step] = 1
        overlap += matrix[:cut] @ (matrix if split is None else matrix[cut:]).T
    both = overlap.astype(np.int64)
    total = sizes[:cut, None] + (sizes if split is None else sizes[cut:])[None, :]
    i, j = np.nonzero((100 + percent) * both >= percent * total)
    j = j if split is None else j + cut
    return i[i < j], j[i < j]


# ---- jobs ----


def _block_pairs(count: int, block: int) -> Iterator[tuple[slice, slice | None]]:
    parts = [slice(i, min(i + block, count)) for i in range(0, count, block)]
    for x, first in enumerate(parts):
        yield first, None
        for second in parts[x + 1 :]:
            yield first, second


def _fetch(
    rows: DataFrame, wanted: DataFrame, n: int, make: Callable[[np.ndarray, int], list[tuple]], schema: pa.Schema
) -> DataFrame:
    """``make(set, node)`` for the texts whose ``node`` is in ``wanted``, and by chance for a few others.

    A sketch of the wanted nodes, of bounded size, tells the tasks which; the texts are not shuffled.
    """

    def own_nodes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().view(_U)

    found = sketch.merged_counts(wanted.select("node").distinct(), own_nodes, least=1)
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.bits(shared.value)
        for batch in pieces(batches):
            seen: set[int] = set()
            out: list[tuple] = []
            for _, grams in sets_of(batch.column(0), n):
                if len(grams) and (node := node_of(grams)) not in seen:
                    seen.add(node)
                    if sketch.estimated(bits, np.array([node], dtype=_U))[0]:
                        out += make(grams, node)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return rows.select("text").mapInArrow(fetch, from_arrow_schema(schema))


def _maybe_linked(keyed: DataFrame, rows: DataFrame, n: int, percent: int, shards: int) -> DataFrame:
    """Edges between nodes of one cluster: spanning forests of the pairs that the signature trees leave.

    ``keyed`` has blocks of groups (``block``, ``size_class``, ``side``, ``node``).
    """

    def signatures(grams: np.ndarray, node: int) -> list[tuple]:
        return [(node, c, len(grams), bitmap(grams, c).tobytes()) for c in classes_of(len(grams), percent)]

    schema = pa.schema([("node", pa.int64()), ("size_class", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])
    signed = (
        _fetch(rows, keyed, n, signatures, schema).groupBy("node", "size_class")
        .agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    )
    placed = keyed.join(signed, ["node", "size_class"]).withColumn("shard", F.pmod("block", F.lit(shards)))

    def search(table: pa.Table) -> pa.Table:
        block, node, size, side = (table.column(c).to_numpy() for c in ("block", "node", "n", "side"))
        bits = table.column("bits").to_pylist()
        order = np.lexsort((node, side, block))
        ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(order))
        begin = 0
        found = []
        for end in ends:
            mine = order[begin:end]
            begin = end
            maps = np.frombuffer(b"".join([bits[i] for i in mine]), dtype=_U).reshape(len(mine), -1)
            cut = int((side[mine] == 0).sum())
            left = SignatureTree(maps[:cut], size[mine[:cut]])
            if cut == len(mine):
                i, j = dual_traversal(left, left, percent)
            else:
                i, j = dual_traversal(left, SignatureTree(maps[cut:], size[mine[cut:]]), percent)
                j = j + cut
            found.append((node[mine[i]], node[mine[j]]))
        return named_forest(found)

    columns = ["shard", "block", "node", "side", "n", "bits"]
    return placed.select(columns).groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def _linked(clusters: DataFrame, rows: DataFrame, n: int, percent: int, shards: int) -> DataFrame:
    """Edges between nodes that link, as spanning forests of blocks; ``clusters`` has ``node`` and ``component``."""
    schema = pa.schema([("node", pa.int64()), ("grams", pa.binary())])
    fetched = _fetch(rows, clusters, n, lambda grams, node: [(node, grams.tobytes())], schema)
    sets = fetched.groupBy("node").agg(F.first("grams").alias("grams"))
    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(CLUSTER_BLOCK)).alias("blocks"))
    placed = clusters.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    paired = placed.select(
        "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    low, high = F.least("own", "other"), F.greatest("own", "other")
    held = paired.select(
        "node", F.xxhash64("component", low, high).alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"),
        (F.col("own") == F.col("other")).alias("alone"),
    ).join(sets, "node").withColumn("shard", F.pmod("block", F.lit(shards)))

    def verify(table: pa.Table) -> pa.Table:
        block, node, side = (table.column(c).to_numpy() for c in ("block", "node", "side"))
        alone = table.column("alone").to_numpy()
        grams = table.column("grams")
        order = np.lexsort((node, side, block))
        ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(order))
        begin = 0
        found = []
        for end in ends:
            mine = order[begin:end]
            begin = end
            arrays = [np.frombuffer(grams[int(i)].as_buffer(), dtype=_U) for i in mine]
            split = None if alone[mine[0]] else int((side[mine] == 0).sum())
            if split == 0 or split == len(mine):
                continue
            i, j = linked_pairs(arrays, split, percent)
            found.append((node[mine[i]], node[mine[j]]))
        return named_forest(found)

    columns = ["shard", "block", "node", "side", "alone", "grams"]
    return held.select(columns).groupBy("shard").applyInArrow(verify, "a bigint, b bigint")


def similar_groups(
    documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` for every row.

    ``percent`` is the least similarity in hundredths, 67 to 100.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be between 67 and 100")
    spark = documents.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, dtype=np.int64)
            node = np.zeros(batch.num_rows, dtype=np.int64)
            for row, grams in sets_of(batch.column(1), n):
                size[row] = len(grams)
                node[row] = node_of(grams)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(node, mask=size == 0)], names=["key", "n_shingles", "node"]
            )

    measured = cut_lineage(rows.mapInArrow(measure, f"key {kind}, n_shingles bigint, node bigint"))
    buckets = 2 * parallel

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            seen: set[int] = set()  # equal sets of a piece offer their keys once
            keys, nodes = [], []
            for _, grams in sets_of(batch.column(0), n):
                if not len(grams) or (node := node_of(grams)) in seen:
                    continue
                seen.add(node)
                for size_class in classes_of(len(grams), percent):
                    own = part_keys(grams, size_class, percent)
                    keys.append(own)
                    nodes.append(np.full(len(own), node, dtype=np.int64))
            if keys:
                found, owner = np.concatenate(keys), np.concatenate(nodes)
                names, blobs = pack((found >> _U(40)).astype(np.int64) % buckets, [found, owner])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "rows"]
                )

    def group(table: pa.Table) -> pa.Table:
        rows = unpack(table.column("rows").to_pylist(), 2)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        found, nodes = rows[order, 0], rows[order, 1].view(np.int64)
        fresh = np.concatenate(([True], (found[1:] != found[:-1]) | (nodes[1:] != nodes[:-1])))
        found, nodes = found[fresh], nodes[fresh]
        first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        last = np.append(first[1:], len(found))
        block, size_class, left, right = [], [], [], []
        for a, b in zip(first[last - first > 1], last[last - first > 1], strict=True):
            own = int(found[a]) & 0xFF
            for x, y in _block_pairs(b - a, GROUP_BLOCK):
                lefts = np.ascontiguousarray(nodes[a:b][x])
                rights = np.ascontiguousarray(nodes[a:b][y]) if y else lefts[:0]
                names = np.concatenate([lefts, rights, [own, len(lefts)]]).astype(np.int64).view(_U)
                block.append(node_of(names))
                size_class.append(own)
                left.append(lefts)
                right.append(rights)
        return pa.table(
            {
                "block": pa.array(block, pa.int64()), "size_class": pa.array(size_class, pa.int32()),
                "left": pa.array(left, pa.list_(pa.int64())), "right": pa.array(right, pa.list_(pa.int64())),
            }
        )

    blocks = (
        rows.select("text")
        .mapInArrow(offer, "bucket bigint, rows binary")
        .groupBy("bucket")
        .applyInArrow(group, "block bigint, size_class int, left array<bigint>, right array<bigint>")
        .dropDuplicates(["block"])
    )
    blocks = cut_lineage(blocks)
    keyed = blocks.select("block", "size_class", F.lit(0).alias("side"), F.explode("left").alias("node")).unionByName(
        blocks.select("block", "size_class", F.lit(1).alias("side"), F.explode("right").alias("node"))
    )

    clusters = connected_components(_maybe_linked(keyed, rows, n, percent, parallel))
    linked = connected_components(_linked(clusters, rows, n, percent, parallel))
    named = measured.join(linked, "node", "left").withColumn("group", F.coalesce("component", "node"))
    smallest = named.where("group IS NOT NULL").groupBy("group").agg(F.min("key").alias("smallest"))
    return named.join(smallest, "group", "left").select(
        F.col("key").alias(key), "n_shingles", F.coalesce("smallest", "key").alias("component_id")
    )
