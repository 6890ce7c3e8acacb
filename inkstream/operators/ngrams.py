"""Vocabularies of n-grams and count vectors of many texts, in a few passes over word numbers.

An n-gram occurs no more often than its words.  So words are counted first; those that occur as often as the last word that a vocabulary
has room for become numbers, and longer n-grams are counted among them only, length by length, each with a higher bar.  The result is
that of counting every n-gram: the terms of greatest count, of equal ones the greatest by text (as ``CountVectorizer`` has them).

Texts are read as words once; every later pass reads the numbers of frequent words.  The driver sees the terms that reach a bar,
about as many as a vocabulary holds (more where counts are equal) for each length and training set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from inkstream.functions.distributed import cut_lineage

#: Words handled together.
SLICE = 1 << 20


@dataclass
class Grams:
    """The terms found so far: of each length the texts, the codes (rank of all but the last word, number of the last) in order, counts and documents."""

    texts: list[np.ndarray] = field(default_factory=list)
    codes: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    documents: list[np.ndarray] = field(default_factory=list)


def _slices(lists: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """First row, values and offsets (from 0) of consecutive rows with about ``SLICE`` values together."""
    ends = lists.offsets.to_numpy()
    row = 0
    while row < len(lists):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE, side="right")) - 1)
        offsets = ends[row : stop + 1].astype(np.int64)
        yield row, lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
        row = stop


def _owners(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _tallied(owner: np.ndarray, code: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code, part, count and documents, from the document and code of every occurrence."""
    codes, place = np.unique(code, return_inverse=True)
    n, sets = len(codes), int(part.max(initial=0)) + 1
    pairs = np.unique(owner * n + place)
    count = np.bincount(part[owner] * n + place, minlength=sets * n)
    held = np.bincount(part[pairs // max(n, 1)] * n + pairs % max(n, 1), minlength=sets * n)
    at = np.flatnonzero(count)
    return codes[at % max(n, 1)], at // max(n, 1), count[at], held[at]


def _ranks(numbers: np.ndarray, offsets: np.ndarray, codes: Sequence[np.ndarray], words: int) -> list[np.ndarray]:
    """For each length, the rank of the n-gram that starts at each word, or -1; ``codes`` are those of two words and more."""
    found = [numbers]
    for n, known in enumerate(codes, 2):
        at, code = _joined(found, offsets, n, words)
        rank = np.full(len(numbers), -1, dtype=np.int64)
        if len(known) and len(at):
            place = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[place] == code
            rank[at[hit]] = place[hit]
        found.append(rank)
    return found


def _joined(found: list[np.ndarray], offsets: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and codes of the n-grams whose two parts of one word less are both known."""
    shorter, numbers = found[-1], found[0]
    if len(numbers) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(numbers))
    size = len(numbers) - n + 1
    at = np.flatnonzero((shorter[:size] >= 0) & (shorter[1 : size + 1] >= 0) & (numbers[n - 1 :] >= 0) & (left[:size] >= n))
    return at, shorter[at] * words + numbers[at + n - 1]


def _sums(sets: Sequence[Sequence[int]], name: str) -> list[Column]:
    return [F.sum(F.when(F.col("part").isin(*s), F.col(name)).otherwise(0)).alias(f"{name}{i}") for i, s in enumerate(sets)]


def _word_counts(table: DataFrame, words: str, part: str, sets: Sequence[Sequence[int]]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for row, values, offsets in _slices(batch.column(1)):
                if len(values):
                    coded = values.dictionary_encode()
                    owner, here = _owners(offsets), parts[row : row + len(offsets) - 1]
                    code, of, count, held = _tallied(owner, coded.indices.to_numpy(), here)
                    yield pa.RecordBatch.from_arrays(
                        [coded.dictionary.take(pa.array(code)), *(pa.array(x, pa.int64()) for x in (of, count, held))],
                        names=["code", "part", "n", "d"],
                    )

    rows = table.select(F.col(part).cast("bigint"), words).mapInArrow(work, "code string, part bigint, n bigint, d bigint")
    return rows.groupBy("code").agg(*_sums(sets, "n"), *_sums(sets, "d"))


def _gram_counts(numbers: DataFrame, part: str, sets: Sequence[Sequence[int]], codes: Sequence[np.ndarray], words: int) -> DataFrame:
    shared, n = numbers.sparkSession.sparkContext.broadcast(list(codes)), len(codes) + 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for row, values, offsets in _slices(batch.column(1)):
                found = _ranks(values.to_numpy().astype(np.int64), offsets, shared.value, words)
                at, code = _joined(found, offsets, n, words)
                if len(at):
                    tallies = _tallied(_owners(offsets)[at], code, parts[row : row + len(offsets) - 1])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in tallies], names=["code", "part", "n", "d"])

    rows = numbers.select(F.col(part).cast("bigint"), "_numbers").mapInArrow(work, "code bigint, part bigint, n bigint, d bigint")
    return rows.groupBy("code").agg(*_sums(sets, "n"), *_sums(sets, "d"))


def numbered(table: DataFrame, words: str, known: np.ndarray) -> DataFrame:
    """``table`` with ``_numbers``, the place in ``known`` of every word or -1, in place of the words; written."""
    shared = table.sparkSession.sparkContext.broadcast(pa.array(known.tolist(), pa.string()))
    kept = [c for c in table.columns if c != words]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in _slices(batch.column(len(kept))):
                place = pc.fill_null(pc.index_in(values, value_set=shared.value), -1)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), place.cast(pa.int32()))
                rest = [batch.column(i).slice(row, len(offsets) - 1) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, lists], names=[*kept, "_numbers"])

    schema = StructType(table.select(*kept).schema.fields).add("_numbers", ArrayType(IntegerType()))
    return cut_lineage(table.select(*kept, words).mapInArrow(work, schema))


def vocabularies(
    table: DataFrame, words: str, part: str, sets: Sequence[Sequence[int]], ngrams: int, size: int, min_df: float, max_df: float
) -> tuple[list[list[str]], Grams, DataFrame]:
    """A vocabulary for each training set, the terms found, and ``table`` with numbers in place of words.

    ``part`` numbers the parts of the table from 0, and a set names its parts.  Rows of a part that is in no set are numbered too.
    """
    totals = table.groupBy(F.col(part).alias("part")).count().collect()
    rows = [sum(r["count"] for r in totals if r["part"] in s) for s in sets]
    least = [min_df if min_df >= 1 else min_df * n for n in rows]
    most = [max_df if max_df >= 1 else max_df * n for n in rows]
    grams, bars = Grams(), [np.zeros(0, dtype=np.int64) for _ in sets]
    used = table.where(F.col(part).isin(*{p for s in sets for p in s}))
    numbers = None
    for n in range(1, ngrams + 1):
        if n == 1:
            counted = _word_counts(used, words, part, sets)
        else:
            some = numbers.where(F.col(part).isin(*{p for s in sets for p in s}))
            counted = _gram_counts(some, part, sets, grams.codes[1:], len(grams.texts[0]))
        enough = F.lit(False)
        for i in range(len(sets)):
            enough = enough | (F.col(f"d{i}") >= least[i])
        counted = cut_lineage(counted.where(enough))
        reached = F.lit(False)
        for i in range(len(sets)):
            fit = F.col(f"d{i}").between(least[i], most[i])
            top = counted.where(fit).select(f"n{i}").orderBy(F.desc(f"n{i}")).limit(size).toArrow()
            bars[i] = np.sort(np.concatenate([bars[i], top.column(0).to_numpy()]))[::-1][:size]
            bar = int(bars[i][-1]) if len(bars[i]) == size else 0
            reached = reached | ((F.col(f"d{i}") >= least[i]) & (F.col(f"n{i}") >= bar))
        _add(grams, counted.where(reached).orderBy("code").toArrow(), n, len(sets))
        if n == 1:
            numbers = numbered(table, words, grams.texts[0])
    out = []
    texts = np.concatenate(grams.texts)
    for i in range(len(sets)):
        count, held = (np.concatenate([x[:, i] for x in y]) for y in (grams.counts, grams.documents))
        fit = np.flatnonzero((held >= least[i]) & (held <= most[i]))
        fit = fit[count[fit] >= np.sort(count[fit])[-size]] if len(fit) > size else fit
        best = sorted(fit, key=lambda at: (int(count[at]), texts[at].encode("utf-16-be")), reverse=True)[:size]
        if not best:
            raise ValueError("no term of the texts is in enough documents: lower min_df")
        out.append([texts[at] for at in best])
    return out, grams, numbers


def _add(grams: Grams, found: pa.Table, n: int, sets: int) -> None:
    count, held = (np.stack([found.column(f"{c}{i}").to_numpy() for i in range(sets)], axis=1) for c in ("n", "d"))
    if n == 1:
        texts = np.array(found.column("code").to_pylist(), dtype=object)
        codes = np.arange(len(texts))
    else:
        codes = found.column("code").to_numpy()
        words = grams.texts[0]
        texts = np.array([f"{grams.texts[-1][c // len(words)]} {words[c % len(words)]}" for c in codes.tolist()], dtype=object)
    grams.texts.append(texts)
    grams.codes.append(codes)
    grams.counts.append(count)
    grams.documents.append(held)


def count_vectors(numbers: DataFrame, grams: Grams, vocabulary: Sequence[str], name: str) -> DataFrame:
    """``numbers`` with the vector ``name`` of counts of ``vocabulary`` in place of word numbers; written."""
    place = {term: at for at, term in enumerate(vocabulary)}
    features = [np.array([place.get(t, -1) for t in texts], dtype=np.int64) for texts in grams.texts]
    shared = numbers.sparkSession.sparkContext.broadcast((grams.codes[1:], features))
    size, kept = len(vocabulary), [c for c in numbers.columns if c != "_numbers"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, features = shared.value
        for batch in batches:
            for row, values, offsets in _slices(batch.column(len(kept))):
                owner, n = _owners(offsets), len(offsets) - 1
                cells = []
                for rank, feature in zip(_ranks(values.to_numpy().astype(np.int64), offsets, codes, len(features[0])), features, strict=True):
                    at = np.flatnonzero(rank >= 0)
                    term = feature[rank[at]] if len(feature) else rank[at]
                    cells.append((owner[at] * size + term)[term >= 0])
                cell, count = np.unique(np.concatenate(cells), return_counts=True)
                ends = pa.array(np.searchsorted(cell, np.arange(n + 1) * size), pa.int32())
                vector = pa.StructArray.from_arrays(
                    [
                        pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, size), pa.int32()),
                        pa.ListArray.from_arrays(ends, pa.array(cell % size, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(count, pa.float64())),
                    ],
                    names=["type", "size", "indices", "values"],
                )
                rest = [batch.column(i).slice(row, n) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, vector], names=[*kept, name])

    plain = StructType(numbers.select(*kept).schema.fields)
    schema = StructType(list(plain.fields)).add(name, VectorUDT.sqlType())
    return cut_lineage(numbers.select(*kept, "_numbers").mapInArrow(work, schema), StructType(list(plain.fields)).add(name, VectorUDT()))
