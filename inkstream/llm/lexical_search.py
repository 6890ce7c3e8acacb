"""Ranked lexical search: for each item, the documents whose terms score highest, over all documents.

Terms are runs of letters, digits and other characters outside ASCII, A-Z lower-cased.  A term weighs more the fewer documents hold it; a document's
score grows with a term's occurrences and falls with its length (:func:`weight`, :func:`length_factor`, :func:`impacts`; integers but for the weight).

Method (presence-mask grouping).
1. One pass over all documents counts documents, terms, and the documents that hold each term of the items: a few numbers a task, summed.
2. A second pass scores.  A task lists where the items' terms occur in a slice of documents, and the greatest impact of each.  An item whose terms together
   cannot reach its lowest kept score is passed over.  Otherwise bit operations give each document the mask of the item's terms that it holds.  A distinct
   mask's bound is the sum of its terms' greatest impacts; masks are evaluated in falling order of it, and once the next bound is below the
   lowest of ``k`` kept scores no document is left that could enter.
3. The ``k`` best of each task and item are ranked by Spark, first by groups of tasks, then over all.

Items go in blocks of ``BLOCK_BYTES`` of text, chosen by hash, two passes each, so what is broadcast is bounded.  Documents are never shuffled: only
``k`` rows for each item and task are.

Cases.  A null or empty text, or one without a term, is no document and no item with results.  A text of any length is taken whole.  Equal documents, and
documents with equal keys, rank each by itself; equal scores go by key, null keys last.  Equal items, and items with equal or null ids, have a ranking each.
No documents or no items give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkstream.llm.arrays import blocks, give_back

#: Text of the items searched for together.
BLOCK_BYTES = 1 << 20
#: Bytes of documents whose postings are alive together.
SLICE = 4 << 20
#: Documents of distinct masks evaluated between two looks at the lowest kept score.
STEP = 64
#: Groups of tasks whose rankings are merged first.
GROUPS = 64

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_PLAIN = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return (text or "").encode().translate(_PLAIN).split()


def weight(documents: int, holding: int) -> int:
    """What a term counts that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_factor(n: int, documents: int, terms: int) -> int:
    """The ``m`` of a document of ``n`` terms, among ``documents`` that have ``terms`` together."""
    return 75 + 25 * n * documents // terms


def impacts(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """What occurrences of a term are worth in documents with these length factors."""
    return 1_000_000_000 * counts // (1000 * counts + 12 * factors)


class Items:
    """A block of items: their terms as numbers, and how often each item has them."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[bytes, int] = {}
        terms, repeats, sizes = [], [], []
        for text in texts:
            own = Counter(self.number.setdefault(t, len(self.number)) for t in terms_of(text))
            terms += own.keys()
            repeats += own.values()
            sizes.append(len(own))
        self.terms = np.array(terms, dtype=np.int64)
        self.repeats = np.array(repeats, dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


class Postings:
    """Where the items' terms occur in a slice of documents, by term, then document."""

    def __init__(self, documents: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int):
        order = np.lexsort((documents, terms))
        self.documents, self.values = documents[order], values[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.greatest = np.zeros(n_terms, dtype=np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.greatest[held] = np.maximum.reduceat(self.values, self.first[held])

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.first[term], self.first[term + 1]
        return self.documents[low:high], self.values[low:high]


def presence_masks(postings: Postings, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold any of the terms, and their masks: bit ``j`` of the mask's 64-bit words stands for term ``j``."""
    masks = np.zeros((n, -(-len(terms) // 64)), dtype=np.uint64)
    for j, term in enumerate(terms.tolist()):
        documents, _ = postings.of(term)
        masks[documents, j >> 6] |= np.uint64(1 << (j & 63))
    present = np.flatnonzero(masks.any(axis=1))
    return present, masks[present]


def distinct_masks(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct masks, and the number of each row's."""
    if masks.shape[1] == 1:
        found, which = np.unique(masks[:, 0], return_inverse=True)
        return found[:, None], which
    # rows as one value each, so that they sort as a whole
    rows = np.ascontiguousarray(masks).view(np.dtype((np.void, masks.shape[1] * 8))).ravel()
    found, which = np.unique(rows, return_inverse=True)
    return found.view(np.uint64).reshape(-1, masks.shape[1]), which


def best_documents(
    postings: Postings, terms: np.ndarray, factors: np.ndarray, n: int, lowest: int, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and their scores, until no other document of the slice can reach ``lowest`` or be among the ``k`` best.

    ``factors`` multiply the impacts of the terms; ``n`` documents are in the slice.
    """
    present, masks = presence_masks(postings, terms, n)
    found, which = distinct_masks(masks)
    bits = (found[:, np.arange(len(terms)) >> 6] >> (np.arange(len(terms)) & 63).astype(np.uint64)) & np.uint64(1)
    bounds = bits.astype(np.int64) @ (factors * postings.greatest[terms])
    falling = np.argsort(-bounds, kind="stable")
    by_mask = np.argsort(which, kind="stable")
    sizes = np.bincount(which, minlength=len(found))
    firsts = np.cumsum(sizes) - sizes
    seen = np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(falling) and bounds[falling[at]] >= max(lowest, 1):
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[falling[at : at + STEP]]), STEP, side="right")))
        rows = np.concatenate([by_mask[firsts[g] : firsts[g] + sizes[g]] for g in falling[at:stop].tolist()])
        rows.sort()
        documents = present[rows]
        scores = np.zeros(len(rows), dtype=np.int64)
        for j, term in enumerate(terms.tolist()):
            has = np.flatnonzero((masks[rows, j >> 6] >> np.uint64(j & 63)) & np.uint64(1))
            if len(has):  # every one of them is in the term's postings
                own, values = postings.of(term)
                scores[has] += factors[j] * values[np.searchsorted(own, documents[has])]
        yield documents, scores
        seen = np.sort(np.concatenate([seen, scores]))[::-1][:k]
        if len(seen) == k:
            lowest = max(lowest, int(seen[-1]))
        at = stop


class Ranking:
    """The ``k`` best documents of each item so far."""

    def __init__(self, items: Items, weights: np.ndarray, k: int):
        self.items, self.k = items, k
        self.factors = items.repeats * weights[items.terms]
        self.kept: list[list[tuple]] = [[] for _ in items.first[1:]]
        self.lowest = np.zeros(len(self.kept), dtype=np.int64)

    def add(self, postings: Postings, keys: list) -> None:
        """Rank a slice of documents with these keys among the others."""
        items = self.items
        bounds = np.concatenate(([0], np.cumsum(self.factors * postings.greatest[items.terms])))
        bounds = bounds[items.first[1:]] - bounds[items.first[:-1]]
        for i in np.flatnonzero(bounds >= np.maximum(self.lowest, 1)).tolist():
            own = slice(items.first[i], items.first[i + 1])
            terms, factors = items.terms[own], self.factors[own]
            held = postings.greatest[terms] > 0
            better = self.kept[i]
            for documents, scores in best_documents(postings, terms[held], factors[held], len(keys), int(self.lowest[i]), self.k):
                good = scores >= max(int(self.lowest[i]), 1)
                better = better + [
                    (-s, keys[d] is None, keys[d] if keys[d] is not None else 0)
                    for s, d in zip(scores[good].tolist(), documents[good].tolist(), strict=True)
                ]
            self.kept[i] = sorted(better)[: self.k]
            if len(self.kept[i]) == self.k:
                self.lowest[i] = -self.kept[i][-1][0]


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """Items with a text, about ``BLOCK_BYTES`` of text at a time."""
    known = items.where(F.col(text).isNotNull()).select(F.col(item).alias("id"), F.col(text).cast("string").alias("text"))
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-2 * total // BLOCK_BYTES)  # half full on average, as items go by hash
    for block in range(count):
        part = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).collect()
        if part:
            yield [r["id"] for r in part], [r["text"] for r in part]


def _statistics(rows: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms with repeats, and the documents that hold each term of the block."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Items(shared.value).number
        holding: Counter[int | None] = Counter()
        documents = terms = 0
        for batch in batches:
            for text in batch.column(1):
                own = terms_of(text.as_py())
                documents += bool(own)
                terms += len(own)
                holding.update(set(map(number.get, own)))
            give_back()
        holding.pop(None, None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *holding], pa.int64()), pa.array([documents, terms, *holding.values()], pa.int64())],
            names=["term", "n"],
        )

    counts = rows.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(counts.collect())  # two numbers and one for each term of the block
    holding = np.zeros(len(Items(shared.value).number), dtype=np.int64)
    for term, n in found.items():
        if term >= 0:
            holding[term] = n
    return found.get(-1, 0), found.get(-2, 0), holding


def search(
    documents: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item``, ``rank`` (from 1), ``key`` and ``score`` of the ``k`` highest-scoring documents of each item."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    spark = documents.sparkSession
    schema = StructType([
        StructField("number", LongType()), StructField("item", items.schema[item].dataType),
        StructField("key", rows.schema["key"].dataType), StructField("score", LongType()),
    ])
    found = spark.createDataFrame([], schema)
    for number, (ids, texts) in enumerate(_blocks(items, item, item_text)):
        shared = spark.sparkContext.broadcast(texts)
        n_documents, n_terms, holding = _statistics(rows, shared)
        weights = np.array([weight(n_documents, int(h)) for h in holding], dtype=np.int64)
        told = spark.sparkContext.broadcast((ids, texts, weights, n_documents, n_terms))
        found = found.unionByName(rows.mapInArrow(_scorer(told, number << 32, k), schema))
    order = [F.desc("score"), F.asc_nulls_last("key")]
    # groups of tasks first, so that no task meets the rankings of all
    grouped = found.withColumn("group", F.spark_partition_id() % GROUPS)
    place = F.row_number().over(Window.partitionBy("number", "group").orderBy(*order))
    first = grouped.withColumn("rank", place).where(F.col("rank") <= k).drop("rank")
    place = F.row_number().over(Window.partitionBy("number").orderBy(*order))
    last = first.withColumn("rank", place).where(F.col("rank") <= k)
    return last.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def _scorer(told, base: int, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, weights, n_documents, n_terms = told.value
        items = Items(texts)
        ranking, get = Ranking(items, weights, k), items.number.get
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, stop in blocks(sizes + 1, SLICE):
                where, terms, counts, factors = [], [], [], []
                for d, text in enumerate(batch.column(1).slice(first, stop - first)):
                    own = terms_of(text.as_py())
                    factors.append(length_factor(len(own), n_documents, n_terms) if own else 0)
                    held = Counter(map(get, own))
                    held.pop(None, None)
                    where += [d] * len(held)
                    terms += held.keys()
                    counts += held.values()
                where, terms, counts = (np.array(x, dtype=np.int64) for x in (where, terms, counts))
                values = impacts(counts, np.array(factors, dtype=np.int64)[where])
                some = values > 0
                postings = Postings(where[some], terms[some], values[some], len(items.number))
                ranking.add(postings, batch.column(0).slice(first, stop - first).to_pylist())
            give_back()
        best = [(i, *kept) for i, own in enumerate(ranking.kept) for kept in own]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([base + i for i, *_ in best], pa.int64()), pa.array([ids[i] for i, *_ in best], _arrow(ids)),
                pa.array([None if null else k for _, _, null, k in best], key_type or pa.int64()),
                pa.array([-s for _, s, _, _ in best], pa.int64()),
            ],
            names=["number", "item", "key", "score"],
        )

    return score


def _arrow(ids: list) -> pa.DataType:
    """The Arrow type of the items' ids, bigint if all are null."""
    known = [i for i in ids if i is not None]
    return pa.array(known).type if known else pa.int64()
