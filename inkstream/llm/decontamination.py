"""Finding benchmark passages in documents by spaced seeds.

Method (spaced-seed hashing).  A seed is a run of words of which a fixed mask ignores some positions; words are compared in lower case.  The
seeds of the benchmark are joined with those of every document at every position.  Around each hit the item is laid over the document and
the overlap is verified: some ``region`` aligned words (the whole item, if it is shorter) of which at least ``percent`` of a hundred are equal.
The masks are chosen by the length of the region and the substitutions that ``percent`` allows in it, such that every placement of so many
substitutions leaves some mask a hit (``tests/llm/test_search.py`` enumerates them all); so substituted words hide neither a hit nor an overlap.

The benchmark is a query set: it goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text (an item is never parted), and every block meets all documents in a
pass of its own.  Documents are never shuffled.

Cases.  Null or empty text has no overlap.  Items with fewer than ``SHORTEST`` words or without text match nothing, items shorter
than the region are compared whole.  Repeated items are found each; repeated rows are judged each; very long texts are searched whole; an empty table on either side gives
no overlap; other columns are ignored or carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from inkstream.llm.arrays import blocks, mix, text_slices, words_of

#: Masks (1: the word counts, 0: it is ignored) by length and substitutions: however so many substitutions fall on a run of that
#: length, some mask at some place in the run meets none of them.
MASKS = {
    (5, 1): ("1111", "10111", "11011", "11101"),
    (10, 2): ("110111", "1101011", "1100111"),
    (15, 3): ("1101111", "11100010011", "10001101011"),
    (20, 4): ("11101111", "1101100001011", "110010001010011", "10110001111"),
}
SHORTEST = 5
REGION = 20
PERCENT = 80
BLOCK_BYTES = 16 << 20
#: Aligned words compared at once.
LAID_WORDS = 1 << 18
_U = np.uint64
_FILTER_BITS = 24


def masks_for(length: int, percent: int) -> tuple[str, ...]:
    """Masks that hit every run of ``length`` words of which ``percent`` of a hundred are equal.

    Where ``MASKS`` has none, or only lighter ones, it is the unbroken run that so many substitutions must leave somewhere.
    """
    wrong = length * (100 - percent) // 100
    run = "1" * max(1, -(-(length - wrong) // (wrong + 1)))
    known = [MASKS[key] for key in sorted(MASKS) if key[0] <= length and key[1] == wrong]
    return known[-1] if known and known[-1][0].count("1") > len(run) else (run,)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the counting words of every run as long as the mask."""
    m = max(0, len(words) - len(mask) + 1)
    weights = mix(np.arange(1, len(mask) + 1, dtype=_U), 21) | _U(1)
    total = np.zeros(m, dtype=_U)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += words[j : j + m] * weights[j]
    return mix(total, 4)


class Benchmark:
    """A block of items: their words and the places of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], region: int, percent: int):
        self.ids, self.region, self.percent = np.array(ids, dtype=np.int64), region, percent
        parts = [words_of(d, o) for _, d, o in text_slices(pc.utf8_lower(pa.array(texts, pa.string())))]
        self.words = np.concatenate([p.hashes for p in parts]) if parts else np.zeros(0, dtype=_U)
        counts = np.concatenate([p.counts() for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(self.words))
        room = self.first[owner + 1] - at  # words to the end of the item
        needed: dict[str, list[int]] = {}  # regions of the items that a mask serves
        regions = np.where(counts < SHORTEST, 0, np.minimum(counts, region))
        for r in sorted(set(regions.tolist()) - {0}):
            for mask in masks_for(r, percent):
                needed.setdefault(mask, []).append(r)
        self.owner, self.tables = owner, []
        for mask, served in needed.items():
            places = np.flatnonzero((room >= len(mask)) & np.isin(regions, served)[owner])
            seeds = seed_hashes(self.words, mask)[places]
            order = np.argsort(seeds, kind="stable")
            seeds, places = seeds[order], places[order].astype(np.int32)
            shift = _U(64 - min(_FILTER_BITS, max(12, (8 * len(seeds)).bit_length())))
            filled = np.zeros(1 << (64 - int(shift)), dtype=bool)
            filled[seeds >> shift] = True
            self.tables.append((mask, seeds, places, shift, filled))

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` and in the benchmark's words where seeds agree."""
        here, there = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for mask, known, places, shift, filled in self.tables:
            seeds = seed_hashes(words, mask)
            some = np.flatnonzero(filled[seeds >> shift])
            low = np.searchsorted(known, seeds[some], side="left")
            high = np.searchsorted(known, seeds[some], side="right")
            counts = high - low
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            here.append(np.repeat(some, counts))
            there.append(places[np.repeat(low, counts) + inner].astype(np.int64))
        return np.concatenate(here), np.concatenate(there)

    def _verified(self, words: np.ndarray, low: np.ndarray, own: np.ndarray, sizes: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Which runs of ``sizes`` words from ``low`` have a region that agrees with the item's words from ``own``."""
        out = np.zeros(len(low), dtype=bool)
        for a, b in blocks(sizes, LAID_WORDS):
            n = sizes[a:b]
            begin = np.cumsum(n) - n
            inner = np.arange(n.sum()) - np.repeat(begin, n)
            equal = words[np.repeat(low[a:b], n) + inner] == self.words[np.repeat(own[a:b], n) + inner]
            total = np.concatenate(([0], np.cumsum(equal)))
            wide = np.repeat(region[a:b], n)
            stop = np.minimum(np.arange(len(inner)) + wide, len(inner))
            good = (inner + wide <= np.repeat(n, n)) & (100 * (total[stop] - total[:-1]) >= self.percent * wide)
            out[a:b] = np.logical_or.reduceat(good, begin)
        return out

    def overlaps(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, behind the last word, equal words) of every verified overlap.

        ``first`` has the first word of each document.
        """
        here, there = self.hits(words)
        if not len(here):
            return []
        item, document = self.owner[there], np.searchsorted(first, here, side="right") - 1
        shift = here - there + self.first[item]  # where the item would begin
        order = np.lexsort((shift, item, document))
        document, item, shift = document[order], item[order], shift[order]
        new = np.concatenate(([True], (np.diff(document) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0)))
        document, item, shift = document[new], item[new], shift[new]
        length = self.first[item + 1] - self.first[item]
        low, high = np.maximum(shift, first[document]), np.minimum(shift + length, first[document + 1])
        own, region = self.first[item] + low - shift, np.minimum(self.region, length)
        fits = np.flatnonzero(high - low >= region)
        kept = fits[self._verified(words, low[fits], own[fits], (high - low)[fits], region[fits])]
        out = []
        for at in kept.tolist():
            d, i, low_, high_, region_ = int(document[at]), int(item[at]), int(low[at]), int(high[at]), int(region[at])
            equal = (words[low_:high_] == self.words[own[at] : own[at] + high_ - low_]).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(equal)))
            good = np.flatnonzero(100 * (total[region_:] - total[:-region_]) >= self.percent * region_)
            start, stop = int(low_ + good[0] - first[d]), int(low_ + good[-1] + region_ - first[d])
            out.append((d, int(self.ids[i]), start, stop, int(total[good[-1] + region_] - total[good[0]])))
        return out


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list[int], list[str]]]:
    """Items, at most about ``BLOCK_BYTES`` of text at a time."""
    known = benchmark.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")
    )
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-2 * total // BLOCK_BYTES)  # half full on average, as items go by hash
    for block in range(count):
        part = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == block).orderBy("id", "text").collect()
        yield [r["id"] for r in part], [r["text"] for r in part]


def find_overlaps(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", region: int = REGION, percent: int = PERCENT,
) -> DataFrame:
    """``key``, ``item``, ``start_word``, ``end_word`` (behind the last) and ``n_equal`` of every overlap."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` bigint, start_word bigint, end_word bigint, n_equal bigint"
    spark, found = documents.sparkSession, None
    for ids, texts in _blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast((ids, texts))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Benchmark(*shared.value, region, percent)
            for batch in batches:
                for row, data, offsets in text_slices(pc.utf8_lower(batch.column(1))):
                    words = words_of(data, offsets)
                    overlaps = block.overlaps(words.hashes, words.first)
                    columns = list(zip(*overlaps, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([row + d for d in columns[0]], pa.int64())),
                            *(pa.array(c, pa.int64()) for c in columns[1:]),
                        ],
                        names=[key, item, "start_word", "end_word", "n_equal"],
                    )

        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def judge(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    region: int = REGION, percent: int = PERCENT,
) -> DataFrame:
    """Every row as a struct ``row`` with ``n_words``, ``n_items``, ``n_covered`` (words), ``best_item`` and
    ``contaminated``: one pass for a benchmark of one block, and a sum over the passes otherwise.

    ``best_item`` has the most equal words in one overlap, the smallest such item.
    """
    spark = documents.sparkSession
    told = list(_block_broadcasts(spark, benchmark, item, item_text))
    plain = documents.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [Benchmark(*b.value, region, percent) for b in told] if len(told) == 1 else None
        for batch in batches:
            n, lower = batch.num_rows, pc.utf8_lower(batch.column(1))
            n_words, n_items, covered, best = (np.zeros(n, dtype=np.int64) for _ in range(4))
            has = np.zeros(n, dtype=bool)
            found: dict[int, list[tuple]] = {}
            for b in range(len(told)):
                block = loaded[0] if loaded else Benchmark(*told[b].value, region, percent)
                for row, data, offsets in text_slices(lower):
                    words = words_of(data, offsets)
                    for d, *rest in block.overlaps(words.hashes, words.first):
                        found.setdefault(row + d, []).append(tuple(rest))
            for row, data, offsets in text_slices(lower):
                n_words[row : row + len(offsets) - 1] = words_of(data, offsets).counts()
            for row, overlaps in found.items():
                has[row] = True
                n_items[row] = len({i for i, *_ in overlaps})
                marks = np.zeros(n_words[row] + 1, dtype=np.int64)
                for _, start, stop, _ in overlaps:
                    marks[start] += 1
                    marks[stop] -= 1
                covered[row] = (np.cumsum(marks) > 0).sum()
                best[row] = min((-equal, i) for i, _, _, equal in overlaps)[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(n_items), pa.array(covered), pa.array(best, mask=~has),
                    pa.array(has),
                ],
                names=["row", "n_words", "n_items", "n_covered", "best_item", "contaminated"],
            )

    numbers = [StructField(c, LongType()) for c in ("n_words", "n_items", "n_covered", "best_item")]
    schema = StructType([plain.schema["row"], *numbers, StructField("contaminated", BooleanType())])
    return plain.mapInArrow(search, schema)


def _block_broadcasts(spark, benchmark: DataFrame, item: str, item_text: str):
    for block in _blocks(benchmark, item, item_text):
        yield spark.sparkContext.broadcast(block)


def digest(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the findings for every document that holds a benchmark passage."""
    plain = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))
    done = judge(plain, benchmark, "_text")
    found = done.where("contaminated")
    return found.select(F.col("row").getField(key).alias(key), "n_words", "n_items", "n_covered", "best_item", "contaminated")


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows without an overlap, columns as they are."""
    return judge(documents, benchmark, text).where("NOT contaminated").select("row.*")
