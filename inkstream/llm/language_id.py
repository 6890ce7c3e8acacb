"""Language identification by rank-order profiles of character n-grams.

Method.  The n-grams (one to three letters, words padded by a boundary) of all learning documents are counted per
language over the whole corpus; a language's profile is its most frequent ones in order.  A document's own most
frequent n-grams are compared with each profile: the out-of-place distance sums, over the document's n-grams, how far
apart the two ranks are, or the profile's size if the n-gram is not in it.  The language with the smallest distance wins, ties going
to the first name.  The score is one minus the distance over the largest possible one.

Cases.  Null text, or text without a letter: ``und`` with score 0.  A text with letters of which no n-gram is in any profile
gets the first language with score 0 (see :func:`accepted`).  Without learning rows every text is ``und``.  Repeated rows
are scored each and counted each; very long texts are counted whole; an empty table gives an empty result; other
columns are ignored, a null key stays null and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from inkstream.llm.arrays import text_slices
from inkstream.llm.sampling import remainder

UNKNOWN = "und"
#: N-grams in a profile, and of a document that are compared.
PROFILE = 400
_U = np.uint64
_GRAM_BITS = _U(40)
_letters: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, dtype=_U)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _letters.append(table)
    return _letters[0]


def _scramble(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    return x >> (_U(64) - _GRAM_BITS)


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted ``document << 40 | n-gram`` of every n-gram of a run of documents."""
    if not len(data):
        return np.zeros(0, dtype=_U)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]  # in characters
    letters = _folded()[points]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=_U), np.diff(begins))
    # a boundary before each document, between runs of letters, and at the end
    keep = letters != 0
    inner = begins[:-1][np.diff(begins) > 0]
    keep[1:] |= letters[:-1] != 0
    keep[inner] = True
    at_start = letters[inner] != 0
    letters, owner = letters[keep], owner[keep]
    place = np.cumsum(keep)[inner[at_start]] - 1
    letters = np.append(np.insert(letters, place, 0), _U(0))
    owner = np.append(np.insert(owner, place, owner[place]), owner[-1] if len(owner) else _U(0))
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    mine = owner[1:-1]
    same = (owner[:-2] == mine) | (a == 0)
    next_same = (owner[2:] == mine) | (c == 0)
    k1, k2, k3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
    b2 = b * k2
    out = []
    one = b != 0
    out.append(_scramble(b2[one] + _U(1)) | (mine[one] << _GRAM_BITS))
    two = one & same
    left = a * k1 + b2
    out.append(_scramble(left[two] + _U(2)) | (mine[two] << _GRAM_BITS))
    ends = one & (c == 0)
    out.append(_scramble(b2[ends] + _U(5)) | (mine[ends] << _GRAM_BITS))  # letter and boundary
    three = two & next_same
    out.append(_scramble(left[three] + c[three] * k3 + _U(3)) | (mine[three] << _GRAM_BITS))
    codes = np.concatenate(out)
    codes.sort()
    return codes


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


_GRAM_MASK = (_U(1) << _GRAM_BITS) - _U(1)


@dataclass
class Profiles:
    """Ranks of n-grams per language; a rank of ``PROFILE`` means absent."""

    languages: list[str]
    grams: np.ndarray  # sorted
    ranks: np.ndarray  # n-gram x language


def fit(documents: DataFrame, learn: Column, lang: str = "lang", text: str = "text", size: int = PROFILE) -> Profiles:
    """Profiles from the rows where ``learn`` holds and language and text are not null.

    Every learning row counts.  Tasks sum their own counts, so at most one row for each task, language and n-gram is
    shuffled; ``size`` rows for each language reach the driver.
    """
    rows = documents.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pending = 0

        def merged(parts):
            grams = np.concatenate([g for g, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            unique, back = np.unique(grams, return_inverse=True)
            return unique, np.bincount(back, weights=counts, minlength=len(unique)).astype(np.int64)

        def rows_of():
            for name, parts in totals.items():
                grams, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), name))
                for _, data, _ in text_slices(texts):
                    # one owner for all: only the language matters; a line break keeps texts apart
                    part = _counted(gram_codes(data, np.array([0, len(data)])) & _GRAM_MASK)
                    totals.setdefault(name, []).append(part)
                    pending += len(part[0])
                if len(totals.get(name, ())) > 16:
                    totals[name] = [merged(totals[name])]
            if pending > 20_000_000:
                yield from rows_of()
                totals, pending = {}, 0
        yield from rows_of()

    counted = rows.mapInArrow(count, "lang string, gram bigint, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).toPandas()
    languages = sorted(top["lang"].unique())
    grams = np.unique(top["gram"].to_numpy(dtype=np.int64)).astype(_U)
    ranks = np.full((len(grams), len(languages)), size, dtype=np.int64)
    at = np.searchsorted(grams, top["gram"].to_numpy(dtype=np.int64).astype(_U))
    column = np.searchsorted(languages, top["lang"].to_numpy(dtype=str)) if languages else []
    ranks[at, column] = top["rank"].to_numpy(dtype=np.int64) - 1
    return Profiles(languages, grams, ranks)


def score_texts(texts: pa.Array, profiles: Profiles, size: int = PROFILE) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest language (-1: no letter) and the score of each text."""
    best = np.full(len(texts), -1, dtype=np.int64)
    scores = np.zeros(len(texts))
    if not profiles.languages:
        return best, scores
    for row, data, offsets in text_slices(texts):
        grams, counts = _counted(gram_codes(data, offsets))
        owner = (grams >> _GRAM_BITS).astype(np.int64)
        edges = np.searchsorted(owner, np.arange(len(offsets)))
        picked, places, found = [], [], []
        for d in np.flatnonzero(np.diff(edges)):
            own = counts[edges[d] : edges[d + 1]]
            top = int(own.max())
            down = (top - own).astype(np.uint16 if top < 65536 else np.int64)
            order = np.argsort(down, kind="stable")[:size]
            picked.append(order + edges[d])
            places.append(np.arange(len(order)))
            found.append(d)
        if not found:
            continue
        lengths = np.array([len(p) for p in picked])
        codes = grams[np.concatenate(picked)] & _GRAM_MASK
        place = np.concatenate(places)
        at = np.minimum(np.searchsorted(profiles.grams, codes), len(profiles.grams) - 1)
        ranks = np.where((profiles.grams[at] == codes)[:, None], profiles.ranks[at], size)
        apart = np.where(ranks == size, size, np.abs(ranks - place[:, None]))
        total = np.add.reduceat(apart, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0)
        rows = row + np.array(found)
        best[rows] = total.argmin(axis=1)
        scores[rows] = 1 - total.min(axis=1) / (size * lengths)
    return best, scores


def predict(documents: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The columns of ``documents`` but the text, with ``lang_pred`` and ``lang_score``: a map over the rows."""
    names = [*profiles.languages, UNKNOWN]
    fields = [f for f in documents.schema.fields if f.name != text]
    at = documents.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, scores = score_texts(batch.column(at), profiles)
            yield pa.RecordBatch.from_arrays(
                [
                    *(c for i, c in enumerate(batch.columns) if i != at),
                    pa.array([names[b] for b in best], pa.string()), pa.array(scores),
                ],
                names=[*(f.name for f in fields), "lang_pred", "lang_score"],
            )

    out = StructType([*fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return documents.mapInArrow(work, out)


def identify(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", divisor: int = 4, fold: int = 2
) -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score`` for every row; rows of the fold are not learned from."""
    held = F.coalesce(remainder(F.col(key), divisor) == fold, F.lit(False))
    profiles = fit(documents, F.col(key).isNotNull() & ~held, lang, text)
    plain = documents.select(F.col(key).alias(key), held.alias("held_out"), F.col(text).alias("_text"))
    done = predict(plain, profiles, "_text")
    return done.select(key, "held_out", "lang_pred", F.col("lang_score").alias("score"))


def accepted(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is identified: they have a letter, and share an n-gram with some profile.

    Profiles come from all rows with a language.  Columns stay as they are.
    """
    profiles = fit(documents, F.lit(True), lang, text)
    plain = documents.select(F.struct("*").alias("row"), F.col(text).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, scores = score_texts(batch.column(1), profiles)
            yield batch.select([0]).filter(pa.array((best >= 0) & (scores > 0)))

    return plain.mapInArrow(work, plain.select("row").schema).select("row.*")
