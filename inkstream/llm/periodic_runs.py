"""Periodic runs of words: stretches that repeat themselves with a smallest period, and the texts without the repeats.

A run is a stretch of consecutive words of one document with smallest period ``q`` (words ``q`` apart are identical) and at least
``max(LEAST, 2 * q)`` words that no neighbouring word extends keeping that period.

Method (recursive frequency splitting).
1. In a run of two periods or more every word occurs twice at least, so a word that occurs once in a segment is in no run of
   it, and no run reaches across it: it splits the segment.  In the parts other words are single, which split them again, until
   every word of every part that is long enough occurs twice or more.  Each part but the largest is counted anew and the
   largest takes over the counts less what left it, so a text of ``n`` words takes ``n log n`` steps however it splits.
2. The surviving segments of many documents are scanned together for lags.  A run with lag ``q`` has at least ``q`` consecutive places that
   equal the place ``q`` behind them, so it holds a block of about a quarter of ``q`` that starts at a multiple of its length:
   only the lags between such a block and the next places with the same words (exact ids of ``2**k`` words, from those of
   ``2**(k-1)``) are followed, to both sides, by the same ids.  Lags of all sizes take ``n log n`` ids and a bounded number of
   lags per word; the pairs of a lag and a stretch that is already known fall together, and the smallest lag is the period.

Everything is a map over the rows: nothing is shuffled, and memory is a slice of documents (a document longer than that is a slice
of its own) times the logarithm of its longest surviving segment.

Cases.  Null and empty texts have no words, no run and an empty collapsed text; a text of any length is taken whole; equal rows and
rows with equal or null keys are judged each by itself; an empty table gives an empty result.  Words are compared as they are,
byte for byte.  A word inside several runs is dropped if any of them drops it.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from inkstream.llm.arrays import give_back

#: Words of the shortest run.
LEAST = 12
#: Words of documents that are scanned together; a longer document is scanned alone.
SLICE_WORDS = 100_000

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


# ---- splitting ----


def segments(codes: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """The stretches ``(low, high)`` of ``least`` words or more in each of which every word occurs twice at least."""
    places: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        places.setdefault(c, []).append(i)
    counts = {c: len(p) for c, p in places.items()}
    work = [(0, len(codes), counts, sorted(p[0] for p in places.values() if len(p) == 1))]
    out = []
    while work:
        low, high, counts, single = work.pop()
        if high - low < least:
            continue
        if not single:
            out.append((low, high))
            continue
        edges = [low - 1, *single, high]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > 1]
        if not parts:
            continue
        largest = max(parts, key=lambda p: p[1] - p[0])
        for a, b in parts:
            if b - a >= least and (a, b) != largest:
                own = Counter(codes[a:b])
                work.append((a, b, own, [i for i in range(a, b) if own[codes[i]] == 1]))
        a, b = largest
        if b - a < least:
            continue
        touched = set()
        for outside in (codes[low:a], codes[b:high]):
            for c in outside:
                counts[c] -= 1
            touched.update(outside)
        left = [places[c][bisect_left(places[c], a)] for c in touched if counts[c] == 1]
        work.append((a, b, counts, sorted(left)))
    return sorted(out)


# ---- lags ----


def _follow(ids: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many places from ``a`` and ``b`` on (backwards: before them) are equal, by blocks of falling size."""
    done = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ids) - 1, -1, -1):
        step, size = 1 << k, len(ids[k])
        x, y = (a - done - step, b - done - step) if back else (a + done, b + done)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < size)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ids[k][x[inside]] == ids[k][y[inside]]
        done += same * step
    return done


def _block_ids(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to ``longest``: equal numbers for equal blocks of that many codes."""
    ids = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    size = 1
    while 2 * size <= longest:
        last = ids[-1]
        pairs = last[:-size] * np.int64(len(codes) + 1) + last[size:]
        ids.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        size *= 2
    return ids


def _lag_ranges(longest: int, least: int) -> Iterator[tuple[int, int, int]]:
    """``(first lag, behind the last, k)``: a run with such a lag holds a whole aligned block of ``2**k`` equal places.

    A run has ``max(least - lag, lag)`` equal places at least, and ``2 * size - 1`` of them hold an aligned block of ``size``.
    """

    def exponent(lag: int) -> int:
        return ((max(least - lag, lag, 1) + 1) // 2).bit_length() - 1

    first = 1
    while first <= longest // 2:
        k, stop = exponent(first), first + 1
        while stop <= longest // 2 and exponent(stop) == k:
            stop += 1
        yield first, stop, k
        first = stop


def scan(codes: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs of ``codes``, by start, then period; ``longest`` bounds the length of a run."""
    n = len(codes)
    ids = _block_ids(codes, longest)
    found = []
    for low, high, k in _lag_ranges(longest, least):
        at = np.arange(0, len(ids[k]), 1 << k)
        key = np.sort(ids[k] * np.int64(n + 1) + np.arange(len(ids[k])))
        own = ids[k][at] * np.int64(n + 1)
        begin = np.searchsorted(key, own + np.minimum(at + low, n))
        end = np.searchsorted(key, own + np.minimum(at + high, n))
        counts = end - begin
        total = int(counts.sum())
        if not total:
            continue
        a = np.repeat(at, counts)
        b = key[np.repeat(begin, counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)] % np.int64(n + 1)
        lag = b - a
        before, behind = _follow(ids, a, b, True), _follow(ids, a, b, False)
        length = before + behind + lag
        good = length >= np.maximum(least, 2 * lag)
        if good.any():
            found.append(np.unique(np.stack([(a - before)[good], length[good], lag[good]], axis=1), axis=0))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.concatenate(([True], (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)))
    runs = runs[fresh]  # one stretch under several lags: the smallest is its period
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def find_runs(documents: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of each document, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    parts, owner, begin, number = [], [], [], 0
    for d, words in enumerate(documents):
        if len(words) < least:
            continue
        known: dict[bytes, int] = {}
        codes = [known.setdefault(w, len(known)) for w in words]
        for low, high in segments(codes, least):
            own = np.array(codes[low:high], dtype=np.int64) + number  # no word of one segment equals a word of another
            number += len(known) + 1
            parts += [own, np.array([number - 1])]  # an own code behind each
            owner.append(d)
            begin.append(low)
    if not parts:
        return out
    codes = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts[::2]]) + 1
    firsts = np.cumsum(sizes) - sizes
    start, length, period = scan(codes, int(sizes.max()) - 1, least)
    segment = np.searchsorted(firsts, start, side="right") - 1
    for s, g, n, q in zip((start - firsts[segment]).tolist(), segment.tolist(), length.tolist(), period.tolist(), strict=True):
        out[owner[g]].append((begin[g] + s, n, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


# ---- operators ----


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """``(first row, words of each document)`` of runs of rows with about ``SLICE_WORDS`` words."""
    first, total, own = 0, 0, []
    for row in range(len(texts)):
        words = (texts[row].as_py() or "").encode().split()  # the white space of bytes: 0x20 and 0x09-0x0D
        if own and total + len(words) > SLICE_WORDS:
            yield first, own
            first, total, own = row, 0, []
        own.append(words)
        total += len(words)
    if own:
        yield first, own


def periodic_runs(
    documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, rewrite: Rewrite | None = None
) -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length and period, by start, then period) and ``collapsed`` text of every row.

    ``rewrite`` may change the words of a row, given its key, before they are judged.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, split in _slices(batch.column(1)):
                keys = batch.column(0).slice(first, len(split))
                if rewrite is not None:
                    split = [rewrite(k, w) for k, w in zip(keys.to_pylist(), split, strict=True)]
                runs = find_runs(split, least)
                kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(split, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys, pa.array([len(w) for w in split], pa.int64()),
                        pa.array([[dict(zip(_RUN, r, strict=True)) for r in own] for own in runs], _RUNS),
                        pa.array(kept, pa.string()),
                    ],
                    names=[key, "n_words", "runs", "collapsed"],
                )
            give_back()

    run = StructType([StructField(c, LongType()) for c in _RUN])
    fields = [
        StructField(key, rows.schema["key"].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(run)),
        StructField("collapsed", StringType()),
    ]
    return rows.mapInArrow(work, StructType(fields))


_RUN = ("start", "length", "period")
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in _RUN]))


def repeat_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by its key, with its words from some place on replaced by repeats of the first of them.

    A null key leaves the words as they are.
    """
    n = len(words)
    if key is None or not n:
        return words
    h = crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest(documents: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``key``, ``n_runs``, the longest run (``start``, ``length``, ``period``, ``exponent_milli``; nulls without one) and
    the hashes ``runs_sha256`` and ``collapsed_sha256`` of every row."""
    found = periodic_runs(documents, key, text, rewrite=rewrite)
    # greatest length, then smallest start, then smallest period
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    lines = F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))")
    return found.withColumn("best", best).select(
        key,
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        F.expr("-best.length").alias("length"),
        "best.period",
        F.expr("(1000 * -best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
