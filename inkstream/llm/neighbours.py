"""Nearest vectors by inner product, searched in learned partitions.

Method.  A sample's exact neighbour graph is cut into balanced partitions: starting from balanced halvings along the main directions, vectors
move to the partition that most of their neighbours are in, as far as its room allows.  A small classifier (one hidden layer) learns for a vector how its
neighbours spread over the partitions.  Every row is indexed in its most probable partition; a query is routed to its several most probable
ones, where all rows are ranked exactly, in double precision.  How many partitions are probed is what the sample's own neighbours need for a
recall of ``RECALL``.

Bounds.  The index is fitted on at most ``SAMPLE`` rows, chosen by a hash of the id; every row is indexed and every query of the set is answered.  Equal
vectors are one candidate with their ``k + 1`` smallest ids, which is all that ties can ever need, so a vector that a third of the rows share
is ranked once.  A partition's rows are split by hash into blocks of about ``BLOCK`` candidates and queries; a block pair is what a task holds.

Cases.  Null or empty vectors, zero vectors, vectors with null or non-finite components, null ids, and vectors of another length than the
most frequent one (the longer of two as frequent) take no part.  Repeated rows (the same id and vector) count once.  With fewer than ``k`` candidates all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.functions.distributed import cut_lineage

SAMPLE = 8192
#: Rows for each partition, and the most partitions.
ROWS = 1024
PARTITIONS = 256
RECALL = 0.94
BLOCK = 8192
HIDDEN = 128


# ---- the partitions of a neighbour graph ----


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of each row by inner product."""
    out = np.empty((len(x), k), dtype=np.int64)
    for first in range(0, len(x), 1024):
        scores = x[first : first + 1024] @ x.T
        scores[np.arange(len(scores)), np.arange(first, first + len(scores))] = -np.inf
        out[first : first + 1024] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A partition of the graph with few edges between parts and at most ``slack`` times the mean in each."""
    label = np.zeros(len(x), dtype=np.int64)
    groups, depth = [np.arange(len(x))], parts
    while depth > 1:  # halve along the direction of the largest spread
        halves = []
        for g in groups:
            centred = x[g] - x[g].mean(axis=0)
            direction = np.linalg.svd(centred.T @ centred)[0][:, 0]
            order = np.argsort(centred @ direction, kind="stable")
            halves += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups, depth = halves, depth // 2
    for n, g in enumerate(groups):
        label[g] = n
    room = int(np.ceil(slack * len(x) / parts))
    sizes = np.bincount(label, minlength=parts)
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), dtype=np.int32)
        np.add.at(votes, (np.repeat(rows, graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[rows, best] - votes[rows, label]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[label[v]] -= 1
                sizes[best[v]] += 1
                label[v] = best[v]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A classifier of vectors into partitions, and how many of them a query needs."""

    weights: list[np.ndarray]
    parts: int
    probes: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.zeros((len(x), 1))
        w1, b1, w2, b2 = self.weights
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(unit @ w1 + b1, 0) @ w2 + b2


def train_router(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, epochs: int = 40) -> list[np.ndarray]:
    """Fit the classifier to where each vector and its neighbours are (Adam on the cross entropy)."""
    rng = np.random.default_rng(5)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += graph.shape[1] / 2
    target /= target.sum(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = [
        rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts),
    ]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for first in range(0, len(x), 256):
            some = order[first : first + 256]
            hidden = np.maximum(unit[some] @ w[0] + w[1], 0)
            logits = hidden @ w[2] + w[3]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - target[some]) / len(some)
            back = (d @ w[2].T) * (hidden > 0)
            step += 1
            for i, g in enumerate((unit[some].T @ back, back.sum(axis=0), hidden.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w


def fit_router(sample: np.ndarray, rows: int, k: int) -> Router:
    """Partitions, classifier and probes from a sample of a table with ``rows`` distinct vectors."""
    parts = 1
    while parts < PARTITIONS and rows > 1.5 * ROWS * parts and len(sample) >= 64 * parts:
        parts *= 2
    if parts == 1:
        return Router([], 1, 1)
    graph = neighbour_graph(sample, min(k, len(sample) - 1))
    label = balanced_partitions(sample, graph, parts)
    router = Router(train_router(sample, graph, label, parts), parts, parts)
    odds = router.log_odds(sample)
    home = odds.argmax(axis=1)  # where rows are indexed
    rank = np.empty_like(odds, dtype=np.int64)
    order = np.argsort(-odds, axis=1, kind="stable")
    rank[np.arange(len(sample))[:, None], order] = np.arange(parts)[None, :]
    needed = np.sort(rank[np.arange(len(sample))[:, None], home[graph]].ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1
    router.probes = min(parts, probes + 1)  # one more, as the sample has been learned from
    return router


# ---- search ----


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n"))
    length = lengths.limit(1).select("n").scalar()
    return rows.where(F.size("v") == length)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, in an order of additions that depends on nothing but the length."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


#: A candidate in a list of hits.
HIT = np.dtype([("score", "<f8"), ("vec", "<i8")])


def best_of(lists: list[np.ndarray], count: int) -> np.ndarray:
    """The ``count`` best of some lists of hits: largest score first, ties to the smaller id."""
    every = np.concatenate(lists)
    return every[np.lexsort((every["vec"], -every["score"]))[:count]]


def search(
    vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, key: str = "vec_id", vector: str = "embedding",
    sample: int = SAMPLE,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` nearest other rows of every query row.

    ``is_query`` makes the condition on the id that queries meet.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector).withColumns({"one": F.xxhash64("v"), "two": F.xxhash64(F.lit(3), "v")})
    # equal vectors: the smallest ids, of which the smallest names them
    ids = Window.partitionBy("one", "two").orderBy("id")
    few = rows.dropDuplicates(["id", "one", "two"]).withColumn("n", F.row_number().over(ids)).where(F.col("n") <= k + 1)
    distinct = cut_lineage(
        few.groupBy("one", "two").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    )
    count = distinct.count()
    chosen = distinct.orderBy(F.xxhash64(F.lit(1), F.col("ids")[0]), F.col("ids")[0]).limit(sample).select("v")
    points = np.array([r["v"] for r in chosen.collect()], dtype=float)
    router = fit_router(points, count, k) if count else Router([], 1, 1)
    shared = spark.sparkContext.broadcast(router)

    def route(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            odds = shared.value.log_odds(_matrix(batch.column(at)))
            parts = np.argsort(-odds, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), probes).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "parts"])

    columns = "one bigint, two bigint, v array<double>"
    placed = distinct.select("one", "two", "v", "ids").mapInArrow(
        lambda batches: route(batches, 1), f"{columns}, ids array<bigint>, parts array<int>"
    )
    placed = placed.withColumn("part", F.col("parts")[0]).drop("parts")
    asked = rows.where(is_query(F.col("id"))).select("id", "one", "two").distinct()
    questions = distinct.select("one", "two", "v").join(asked.select("one", "two").distinct(), ["one", "two"], "left_semi")
    probes = router.probes
    routed = questions.mapInArrow(lambda batches: route(batches, probes), f"{columns}, parts array<int>")
    routed = routed.withColumn("part", F.explode("parts")).drop("parts")

    # blocks of a partition: candidates by queries
    held = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("c_blocks"))
    wanted = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("q_blocks"))
    sizes = F.broadcast(held.join(wanted, "part"))  # a row for each partition, PARTITIONS at most
    candidates = placed.join(sizes, "part").select(
        "part", F.pmod("two", F.col("c_blocks")).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"), "v", "ids",
    )
    queries = routed.join(sizes, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("c"),
        F.pmod("two", F.col("q_blocks")).cast("int").alias("q"), "one", "two", "v",
    )

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        c, q = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        names: list[list[int]] = [[], []]
        hits: list[bytes] = []
        if len(c) and len(q):
            one, two = (right.column(n).to_numpy() for n in ("one", "two"))
            ids = left.column("ids").to_pylist()
            for first in range(0, len(q), 512):
                scores = q[first : first + 512] @ c.T
                some = min(k + 1, len(c))
                floor = np.partition(scores, len(c) - some, axis=1)[:, len(c) - some]
                # whatever ties with the last one, up to rounding
                i, j = np.nonzero(scores >= (floor - 1e-9 * np.maximum(1, np.abs(floor)))[:, None])
                exact = inner_products(q[first + i], c[j])
                begin = np.searchsorted(i, np.arange(len(scores) + 1))
                for n in range(len(scores)):
                    pairs = [(exact[p], vec) for p in range(begin[n], begin[n + 1]) for vec in ids[j[p]]]
                    names[0].append(one[first + n])
                    names[1].append(two[first + n])
                    hits.append(best_of([np.array(pairs, dtype=HIT)], k + 1).tobytes())
        return pa.table(
            {"one": pa.array(names[0], pa.int64()), "two": pa.array(names[1], pa.int64()), "hits": pa.array(hits, pa.binary())}
        )

    block = ["part", "c", "q"]
    found = candidates.groupBy(*block).cogroup(queries.groupBy(*block)).applyInArrow(
        rank, "one bigint, two bigint, hits binary"
    )

    def merge(table: pa.Table) -> pa.Table:
        one, two = (table.column(n).to_numpy() for n in ("one", "two"))
        hits = table.column("hits").to_pylist()
        order = np.lexsort((two, one))
        new = np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
        first = np.flatnonzero(new)
        groups = np.split(order, first[1:])
        best = [best_of([np.frombuffer(hits[i], dtype=HIT) for i in g], k + 1) for g in groups]
        ends = np.concatenate(([0], np.cumsum([len(b) for b in best]))).astype(np.int32)
        flat = np.concatenate(best)
        lists = [pa.ListArray.from_arrays(ends, pa.array(flat[name])) for name in ("vec", "score")]
        heads = order[first]
        return pa.table([pa.array(one[heads]), pa.array(two[heads]), *lists], names=["one", "two", "vecs", "scores"])

    # a row for each query vector and probed block: a bounded list each, merged by shards of the query vectors
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = (
        found.withColumn("shard", F.pmod("one", F.lit(shards))).groupBy("shard")
        .applyInArrow(merge, "one bigint, two bigint, vecs array<bigint>, scores array<double>")
        .select("one", "two", F.arrays_zip(F.col("vecs").alias("vec"), F.col("scores").alias("score")).alias("found"))
    )
    answered = asked.join(lists, ["one", "two"]).select(
        F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec"] != F.col("id")), 1, k).alias("found")
    )
    return answered.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec").alias("vec_id"), F.col("hit.score").alias("score")
    )

