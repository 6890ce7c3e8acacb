"""Removing word passages that also start in an earlier document.

A window is ``width`` consecutive words of one document.  A word goes if a window that covers it also starts in a
document with a smaller key; windows are judged on the input.

Method (count-min prefilter).
1. Every window has an anchor, the smallest hash among the word n-grams in it, so equal windows have equal anchors and
   neighbouring windows mostly share theirs.  Each task counts, once per document, the anchors of its rows in a sketch
   of two rows of cells; the tasks' sketches are merged by ranges of cells.  What remains is the set of cells that hold two counts or
   more: at most ``2 * sketch.CELLS`` bits whatever the size of the corpus, which is the only thing broadcast.
2. A second pass keeps the windows whose anchor is estimated to be repeated.  The estimate is never too low, so no repeated window is
   lost; a fuller sketch only lets more through.  Of the documents of one batch that share a window only the first can still be unrepeated, so one row per
   window and batch is grouped exactly, by a hash of 128 bits: a passage that a third of all documents hold gives as many rows as there are batches.
3. The windows found in an earlier document return to their documents, which are rewritten.

Cases.  Null text has no words; texts shorter than the window keep all words; an empty table gives an empty result.  Rows
with one key are one document, for each of their texts; rows with a null key are neither earlier than others nor rewritten.  Very long texts are
taken whole.  Other columns are carried along by :func:`remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkstream.llm import sketch
from inkstream.llm.arrays import Words, mix, ngram_hashes, pack, pieces, sliding_min, text_slices, unpack, words_of

WIDTH = 50
_U = np.uint64


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, owners and anchors of all windows inside one document."""
    gram = width // 2
    smallest = sliding_min(ngram_hashes(words.hashes, gram), width - gram + 1)
    counts = np.maximum(words.counts() - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(owner)) + np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return starts, owner, smallest[starts]


def repeated_anchors(rows: DataFrame, width: int) -> list[tuple[int, bytes]]:
    """The sketch of the anchors of all documents, each counted once for a document."""

    def anchors_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets in text_slices(batch.column(1)):
            _, owner, anchors = _windows(words_of(data, offsets), width)
            new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])))[: len(anchors)]
            anchors, owner = anchors[new], owner[new]
            yield anchors[np.unique(mix(anchors) ^ owner.astype(_U), return_index=True)[1]]

    return sketch.merged_counts(rows, anchors_of)


def _earliest(one: np.ndarray, two: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows in order of their windows, where each window begins, and its smallest key for every row."""
    order = np.lexsort((keys, two, one))
    one, two, keys = one[order], two[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))[: len(one)])
    return one, two, keys, first, np.repeat(keys[first], np.diff(np.append(first, len(one))))


def repeated_windows(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key`` and ``windows``: the hashes of the windows of a document that start in an earlier one too.

    ``rows`` has ``key`` (bigint) and ``text``.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(repeated_anchors(rows, width))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def late(one: np.ndarray, keys: np.ndarray, earliest: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Windows found in an earlier document with their keys, by shards of the keys."""
        found = keys > earliest
        return pack((mix(keys[found].view(_U)) >> _U(33)).astype(np.int64) % buckets, [keys[found], one[found]])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.bits(shared.value)
        for batch in pieces(batches):
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            parts = []
            for row, data, offsets in text_slices(batch.column(1)):
                words = words_of(data, offsets)
                starts, owner, anchors = _windows(words, width)
                keep = sketch.estimated(bits, anchors) & known[row + owner]
                starts, owner = starts[keep], owner[keep]
                hashes = [ngram_hashes(words.hashes, width, which)[starts] for which in (0, 1)]
                parts.append((*hashes, ids[row + owner].astype(np.int64)))
            if not parts:
                continue
            one, two, keys, first, earliest = _earliest(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            done, found = late(one, keys, earliest)
            # undecided: the first document of each window in this batch
            bucket = (one[first] >> _U(33)).astype(np.int64) % buckets
            names, blobs = pack(bucket, [one[first], two[first], keys[first]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([done, names]), pa.int64()),
                    pa.array(np.arange(len(done) + len(names)) < len(done)),
                    pa.array(found + blobs, pa.binary()),
                ],
                names=["bucket", "decided", "rows"],
            )

    def group(table: pa.Table) -> pa.Table:
        decided = table.filter(table.column("decided")).select(["bucket", "rows"])
        rows = unpack(table.filter(pc.invert(table.column("decided"))).column("rows").to_pylist(), 3)
        one, _, keys, _, earliest = _earliest(rows[:, 0], rows[:, 1], rows[:, 2].view(np.int64))
        shards, found = late(one, keys, earliest)
        more = pa.table([pa.array(shards, pa.int64()), pa.array(found, pa.binary())], schema=decided.schema)
        return pa.concat_tables([decided, more]).rename_columns(["shard", "rows"])

    def gather(table: pa.Table) -> pa.Table:
        rows = unpack(table.column("rows").to_pylist(), 2)
        keys, blobs = pack(rows[:, 0].view(np.int64), [np.ascontiguousarray(rows[:, 1])])
        return pa.table({"key": pa.array(keys, pa.int64()), "windows": pa.array(blobs, pa.binary())})

    spread = rows.mapInArrow(candidates, "bucket bigint, decided boolean, rows binary")
    grouped = spread.groupBy("bucket").applyInArrow(group, "shard bigint, rows binary")
    return grouped.groupBy("shard").applyInArrow(gather, "key bigint, windows binary")


def covered_words(words: Words, d: int, windows: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Which words of document ``d`` are covered by one of ``windows`` (sorted)."""
    a, b = words.first[d], words.first[d + 1]
    marks = np.zeros(b - a + 1, dtype=np.int64)
    if b - a >= width and len(windows):
        own = hashes[a : b - width + 1]
        at = np.minimum(np.searchsorted(windows, own), len(windows) - 1)
        starts = np.flatnonzero(windows[at] == own)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + width, -1)
    return np.cumsum(marks[:-1]) > 0


def remove_repeats(
    documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, digest_only: bool = False
) -> DataFrame:
    """Every row with its repeated passages removed.

    The columns of ``documents`` come back with ``text`` rewritten (kept words joined by one space; a text that loses
    nothing stays as it is) in a struct ``row``, next to ``n_words``, ``n_removed`` and ``kept_sha256``, the hash of the kept words
    joined by one space.  With ``digest_only`` the struct holds the key alone.
    """
    plain = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    found = repeated_windows(plain, width).withColumnRenamed("key", "found_key")
    row = F.struct(F.col(key)) if digest_only else F.struct("*")
    rows = documents.select(row.alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    joined = rows.join(found, F.col("key") == F.col("found_key"), "left").select("row", "text", "windows")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column(2).to_pylist()
            n_words, n_removed, shas, texts = [], [], [], []
            for first, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                words = hashes = None
                for d in range(len(offsets) - 1):
                    own = raw[offsets[d] : offsets[d + 1]].split()  # at the same six bytes
                    kept, removed = own, 0
                    if windows[first + d]:
                        if words is None:
                            words = words_of(data, offsets)
                            hashes = ngram_hashes(words.hashes, width)
                        gone = covered_words(words, d, np.sort(unpack([windows[first + d]], 1)[:, 0]), hashes, width)
                        kept = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
                        removed = len(own) - len(kept)
                    joined = b" ".join(kept)
                    n_words.append(len(own))
                    n_removed.append(removed)
                    shas.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode() if removed else None)
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["row", "n_words", "n_removed", "kept_sha256"]
            if not digest_only:
                columns.append(pa.array(texts, pa.string()))
                names.append("rewritten")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [
        joined.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()),
        StructField("kept_sha256", StringType()),
    ]
    if digest_only:
        return joined.mapInArrow(rewrite, StructType(fields))
    done = joined.mapInArrow(rewrite, StructType([*fields, StructField("rewritten", StringType())]))
    changed = F.col("row").withField(f"`{text}`", F.coalesce("rewritten", F.col("row").getField(text)))
    return done.withColumn("row", changed).drop("rewritten")


def digest(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept_sha256`` for every row."""
    done = remove_repeats(documents, key, text, width, digest_only=True)
    return done.select("row.*", "n_words", "n_removed", "kept_sha256")
