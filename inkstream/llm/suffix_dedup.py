"""Removing byte strings that also start anywhere else, by suffix arrays over shards.

A string is ``width`` consecutive bytes of one document.  Each byte covered by a string that also starts at any other
place, in the same document or another, goes; strings are judged on the input.

Method (induced sorting).
1. Strings meet by their anchor, the smallest hash among the byte n-grams in them: equal strings have equal anchors, so the
   shards of different anchors share nothing.  A segment is a run of string starts with one anchor.  A count-min sketch of the anchors
   (:mod:`sketch`) leaves the segments whose anchor occurs at two places or more.
2. A segment's content that occurs twice is repeated as a whole, which a count by a 128-bit hash shows.  Segments of an anchor that has
   several contents, or that holds its anchor twice, go to shards with their bytes, one copy of each content.
3. A shard's suffixes are classified, its leftmost-smaller substrings sorted and named, recursively, and the suffix array is induced from them;
   common prefixes are computed in text order (permuted), each from its predecessor's except where the preceding bytes differ.  A string is
   repeated if a neighbour in the array shares ``width`` bytes with it, and bytes decide that, not hashes.
4. The repeated starts return to the documents, which are rewritten.

Cases.  Null text counts as empty; shorter texts keep all bytes; an empty table gives an empty result.  Equal rows are two places, so a
repeated row of ``width`` bytes or more goes altogether, in both rows; so do rows with equal or null keys, each judged by its own text.  Very long
texts are taken whole.  Removing may cut a character; hashes are over the remaining bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from inkstream.functions.distributed import cut_lineage
from inkstream.llm import sketch
from inkstream.llm.arrays import _BYTES, pack, sliding_min, span_hashes, text_slices, unpack

WIDTH = 400
#: Bytes sorted together; an anchor's segments are never parted.
SHARD_BYTES = 2 << 20
#: Suffixes a bucket needs on average for its waves to be worth an array step each; both forms give one array.
WAVE = 64
_U = np.uint64


# ---- suffix arrays ----


def _induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array that the sorted leftmost-smaller suffixes ``lms`` induce.

    Buckets are visited in order of their symbol; within one, the suffixes found so far induce their predecessors all at
    once, and those that fall into the same bucket form the next wave.
    """
    n = len(s)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, -1, dtype=np.int32)
    lms_sizes = np.bincount(s[lms], minlength=len(sizes))
    lms_starts = np.concatenate(([0], np.cumsum(lms_sizes)[:-1]))
    symbols = np.flatnonzero(sizes)

    def place(found: np.ndarray, edge: np.ndarray, up: bool) -> None:
        """Put predecessors at the open edge of their buckets, in their order."""
        into = s[found]
        order = np.argsort(into, kind="stable")
        found, into = found[order], into[order]
        first = np.flatnonzero(np.concatenate(([True], into[1:] != into[:-1])))
        counts = np.diff(np.append(first, len(into)))
        rank = np.arange(len(into)) - np.repeat(first, counts)
        if up:
            out[edge[into] + rank] = found
            edge[into[first]] += counts
        else:
            out[edge[into] - 1 - rank] = found
            edge[into[first]] -= counts

    head = starts.copy()
    for c in symbols:
        low = starts[c]
        while low < head[c]:
            wave = out[low : head[c]] - 1
            low = head[c]
            wave = wave[(wave >= 0) & ~smaller[wave]]
            if len(wave):
                place(wave, head, True)
        wave = lms[lms_starts[c] : lms_starts[c] + lms_sizes[c]] - 1
        wave = wave[wave >= 0]
        if len(wave):
            place(wave, head, True)
    tail = ends.copy()
    tail[0] = starts[0]  # the end itself: nothing induces it
    out[0] = n - 1
    for c in symbols[::-1]:
        high = ends[c]
        while high > tail[c]:
            wave = out[tail[c] : high][::-1] - 1
            high = tail[c]
            wave = wave[(wave >= 0) & smaller[wave]]
            if len(wave):
                place(wave, tail, False)
        wave = out[starts[c] : head[c]][::-1] - 1
        wave = wave[(wave >= 0) & smaller[wave]]
        if len(wave):
            place(wave, tail, False)
    return out


def _induce_small(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same array as :func:`_induce`, suffix by suffix: cheaper where most buckets hold a few suffixes only."""
    n = len(s)
    ends = np.cumsum(sizes)
    into, small = s.tolist(), smaller.tolist()
    out = [-1] * n
    tail = ends.tolist()
    for i in lms[::-1].tolist():
        tail[into[i]] -= 1
        out[tail[into[i]]] = i
    head = (ends - sizes).tolist()
    for at in range(n):
        i = out[at] - 1
        if i >= 0 and not small[i]:
            c = into[i]
            out[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for at in range(n - 1, -1, -1):
        i = out[at] - 1
        if i >= 0 and small[i]:
            c = into[i]
            tail[c] -= 1
            out[tail[c]] = i
    return np.array(out, dtype=np.int32)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """All suffixes of ``s`` in full order; ``s`` ends with its only 0."""
    n = len(s)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1]
    # smaller: a suffix before its right neighbour; equal symbols follow the next unequal pair
    unequal = np.flatnonzero(s[1:] != s[:-1])
    rises = s[unequal] < s[unequal + 1]
    smaller = np.append(np.repeat(rises, np.diff(np.concatenate(([-1], unequal)))), True)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    sizes = np.bincount(s)
    induce = _induce if n >= WAVE * np.count_nonzero(sizes) else _induce_small
    rough = lms[np.argsort(s[lms], kind="stable")]
    induced = induce(s, smaller, rough, sizes)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = induced[is_lms[induced]]
    # names: equal substrings (up to and with the next leftmost-smaller symbol) share one
    upto = np.append(lms[1:] + 1, n)
    marked = s.astype(_U) * _U(2) + smaller
    hashes = np.zeros(n, dtype=_U)
    hashes[lms] = span_hashes(marked * _U(0x9E3779B97F4A7C15) + _U(1), lms, upto)
    own = hashes[ordered]
    name = np.zeros(n, dtype=np.int64)
    name[ordered] = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]).astype(np.int64))))
    names = name[lms]
    kinds = int(names.max()) + 1
    exact = ordered if kinds == len(lms) else lms[suffix_array(names)]
    return induce(s, smaller, exact, sizes)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in text order, the symbols it shares with its predecessor in ``order``."""
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    known = before >= 0
    left_here = np.concatenate(([-1], s[:-1].astype(np.int64)))
    left_there = np.where(before > 0, s[np.maximum(before - 1, 0)].astype(np.int64), -2)
    start = np.flatnonzero(known & (left_here != left_there))
    # four symbols at a time
    padded = np.concatenate([s.astype(np.uint16), np.zeros(8, dtype=np.uint16)])
    fours = np.ndarray(shape=(n + 4,), dtype="<u8", buffer=padded.data, strides=(2,))
    lengths = np.zeros(len(start), dtype=np.int64)
    active = np.arange(len(start))
    a, b = start.copy(), before[start]
    while len(active):
        differ = fours[a] ^ fours[b]
        same = differ == 0
        off = differ[~same]
        for symbols in (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF):
            lengths[active[~same]] += (off & _U(symbols)) == 0
        active = active[same]
        lengths[active] += 4
        a, b = a[same] + 4, b[same] + 4
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
    # the others: one less than at the place before
    reach = np.zeros(n, dtype=np.int64)
    reach[start] = start + lengths
    reach = np.maximum.accumulate(reach)
    return np.where(known, np.maximum(reach - here, 0), 0)


def repeated_starts(contents: list[bytes], width: int) -> list[np.ndarray]:
    """For each content, the starts of strings of ``width`` bytes that also start elsewhere in the contents."""
    lengths = np.array([len(c) for c in contents])
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    s = np.ones(int(begins[-1]) + 1, dtype=np.int32)  # 1 parts the contents, 0 ends all
    s[-1] = 0
    body = np.ones(len(s), dtype=bool)
    body[begins[1:] - 1] = False
    body[-1] = False
    s[body] = np.frombuffer(b"".join(contents), dtype=np.uint8).astype(np.int32) + 2
    order = suffix_array(s).astype(np.int64)
    prefix = common_prefixes(s, order)
    left = np.repeat(lengths + 1, lengths + 1) - (np.arange(begins[-1]) - np.repeat(begins[:-1], lengths + 1)) - 1
    left = np.append(left, 0)  # bytes to the end of the content
    shared = (prefix >= width) & (left >= width)
    again = shared.copy()
    again[order[:-1][shared[order[1:]]]] = True
    again &= left >= width
    return [np.flatnonzero(part) for part in np.split(again[: begins[-1]], begins[1:-1])]


# ---- segments ----


def _segments(data: np.ndarray, offsets: np.ndarray, width: int):
    """Runs of string starts with one anchor: (owner, first start, last start, anchor, holds it twice), and the
    anchors of all places."""
    gram = width // 2
    span = width - gram + 1
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < width:
        return none, none, none, none.astype(_U), none.astype(bool), none.astype(_U)
    at = np.arange(n - gram + 1)
    grams = span_hashes(_BYTES[data], at, at + gram)
    smallest = sliding_min(grams, span)
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(len(owner)) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    if not len(starts):
        return none, none, none, none.astype(_U), none.astype(bool), none.astype(_U)
    anchors = smallest[starts]
    new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    # places that are the smallest of some string: as small as the largest of the minima around
    valid = np.zeros(len(smallest), dtype=_U)
    valid[starts] = ~anchors
    valid[starts] = ~valid[starts]
    lowest = np.full(len(smallest) + 2 * (span - 1), np.iinfo(_U).max, dtype=_U)
    lowest[span - 1 : span - 1 + len(smallest)] = ~valid
    place = np.flatnonzero(grams == ~sliding_min(lowest, span))
    values = grams[place]
    known, rank = np.unique(values, return_inverse=True)
    keyed = np.sort(rank * np.int64(n + 1) + place)
    mine = np.searchsorted(known, anchors[first]) * np.int64(n + 1)
    inside = np.searchsorted(keyed, mine + starts[last] + width - gram, side="right") - np.searchsorted(keyed, mine + starts[first])
    return owner[first], starts[first], starts[last], anchors[first], inside > 1, values


def _kept_segments(batch: pa.RecordBatch, width: int, found: np.ndarray) -> Iterator[tuple]:
    """Slices of a batch with their segments whose anchor the sketch has, and the segments' content hashes."""
    for row, data, offsets in text_slices(batch.column(1)):
        owner, first, last, anchors, twice, _ = _segments(data, offsets, width)
        keep = sketch.estimated(found, anchors)
        owner, first, last, anchors, twice = (x[keep] for x in (owner, first, last, anchors, twice))
        values = _BYTES[data]
        one, two = (span_hashes(values, first, last + width, which) for which in (0, 1))
        yield row, data, offsets, owner, first, last, anchors, twice, one, two


def repeated_spans(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key`` and ``spans`` (packed start and end) of what is to be removed; ``rows`` has ``key`` (bigint) and ``text``."""
    spark = rows.sparkSession

    def anchors_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets in text_slices(batch.column(1)):
            yield _segments(data, offsets, width)[5]

    shared = spark.sparkContext.broadcast(sketch.merged_counts(rows, anchors_of))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sketch.bits(shared.value)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, offsets, owner, first, last, anchors, twice, one, two in _kept_segments(batch, width, found):
                begin = first - offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[row + owner], pa.int64()), pa.array(begin, pa.int64()),
                        pa.array(begin + last - first + width, pa.int64()), pa.array(anchors.view(np.int64)),
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(twice),
                    ],
                    names=["key", "start", "end", "anchor", "one", "two", "twice"],
                )

    owners = cut_lineage(
        rows.mapInArrow(
            segments, "key bigint, start bigint, end bigint, anchor bigint, one bigint, two bigint, twice boolean"
        )
    )
    # anchors with several contents, or with a content that holds the anchor twice
    mixed = owners.groupBy("anchor").agg(
        F.min("one").alias("low"), F.max("one").alias("high"), F.max("twice").alias("twice")
    )
    mixed = mixed.where("low <> high OR twice").select("anchor")

    def own_anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column(0).to_numpy().view(_U)

    wanted = spark.sparkContext.broadcast(sketch.merged_counts(mixed, own_anchors, least=1))
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, several = sketch.bits(shared.value), sketch.bits(wanted.value)
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for _, data, _, _, first, last, anchors, _, one, two in _kept_segments(batch, width, found):
                take = []
                for i in np.flatnonzero(sketch.estimated(several, anchors)):
                    name = (int(one[i]), int(two[i]))
                    if name not in seen:
                        seen.add(name)
                        take.append(i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((anchors[take] >> _U(20)).astype(np.int64) % shards),
                        pa.array(anchors[take].view(np.int64)), pa.array(one[take].view(np.int64)),
                        pa.array(two[take].view(np.int64)),
                        pa.array([data[first[i] : last[i] + width].tobytes() for i in take], pa.binary()),
                    ],
                    names=["shard", "anchor", "one", "two", "content"],
                )

    def sort(table: pa.Table) -> pa.Table:
        anchor, one, two = (table.column(c).to_numpy() for c in ("anchor", "one", "two"))
        order = np.lexsort((two, one, anchor))
        same = (anchor[order][1:] == anchor[order][:-1]) & (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        order = order[np.concatenate(([True], ~same))]
        column = table.column("content").combine_chunks()
        sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset))[order]
        fresh = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1])))
        per_anchor = np.add.reduceat(sizes, fresh)
        edges = np.append(fresh, len(order))
        out_one, out_two, spans = [], [], []
        group = 0
        while group < len(fresh):  # whole anchors, up to a shard's bytes
            stop, total = group + 1, int(per_anchor[group])
            while stop < len(fresh) and total + per_anchor[stop] <= SHARD_BYTES:
                total += int(per_anchor[stop])
                stop += 1
            mine = order[edges[group] : edges[stop]]
            group = stop
            texts = column.take(pa.array(mine)).to_pylist()
            for i, starts in zip(mine, repeated_starts(texts, width), strict=True):
                if len(starts):
                    cut = np.flatnonzero(np.diff(starts) > 1) + 1
                    low = starts[np.concatenate(([0], cut))]
                    high = starts[np.append(cut - 1, len(starts) - 1)] + width
                    out_one.append(one[i])
                    out_two.append(two[i])
                    spans.append(np.stack([low, high], axis=1).astype(_U).tobytes())
        return pa.table({"one": pa.array(out_one, pa.int64()), "two": pa.array(out_two, pa.int64()), "spans": pa.array(spans, pa.binary())})

    found = (
        rows.mapInArrow(contents, "shard bigint, anchor bigint, one bigint, two bigint, content binary")
        .groupBy("shard")
        .applyInArrow(sort, "one bigint, two bigint, spans binary")
    )
    # contents that occur twice go as a whole
    whole = owners.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    decided = whole.withColumn("spans", F.lit(None).cast("binary")).unionByName(found)
    placed = owners.join(decided, ["one", "two"]).select("key", "start", "end", "spans")

    def absolute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, low, high = (batch.column(i).to_numpy() for i in range(3))
            whole = batch.column(3).is_null().to_numpy(zero_copy_only=False)
            parts = [np.stack([keys[whole], low[whole], high[whole]], axis=1)]
            for i in np.flatnonzero(~whole):
                pairs = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.int64).reshape(-1, 2) + low[i]
                parts.append(np.column_stack([np.full(len(pairs), keys[i]), pairs]))
            rows_of = np.concatenate(parts)
            names, blobs = pack(rows_of[:, 0], [np.ascontiguousarray(rows_of[:, 1]), np.ascontiguousarray(rows_of[:, 2])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "spans"]
            )

    return placed.mapInArrow(absolute, "key bigint, spans binary").groupBy("key").agg(F.collect_list("spans").alias("spans"))


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the ``kept`` bytes of every row."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = documents.select(F.col(key).alias("id"), F.xxhash64(F.col(key), value).alias("key"), value.alias("text"))
    found = repeated_spans(rows.select("key", "text"), width).withColumnRenamed("key", "found_key")
    joined = rows.join(found, F.col("key") == F.col("found_key"), "left").select("id", "text", "spans")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            rows_out: list[tuple] = []
            kept_out = []
            for first, data, offsets in text_slices(batch.column(1)):
                for d in range(len(offsets) - 1):
                    own = data[offsets[d] : offsets[d + 1]]
                    removed = n_spans = 0
                    if spans[first + d]:
                        pairs = unpack(spans[first + d], 2).astype(np.int64)
                        steps = np.zeros(len(own) + 1, dtype=np.int64)
                        np.add.at(steps, pairs[:, 0], 1)
                        np.add.at(steps, pairs[:, 1], -1)
                        gone = np.cumsum(steps[:-1]) > 0
                        removed = int(gone.sum())
                        n_spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                        own = own[~gone]
                    kept = own.tobytes()
                    rows_out.append((int(offsets[d + 1] - offsets[d]), removed, n_spans, hashlib.sha256(kept).hexdigest()))
                    kept_out.append(kept)
            columns = list(zip(*rows_out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()),
                    pa.array(kept_out, pa.binary()),
                ],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    fields = [
        StructField(key, rows.schema["id"].dataType), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
        StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("kept", BinaryType()),
    ]
    return joined.mapInArrow(rewrite, StructType(fields))


def digest(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` for every row."""
    return remove_repeats(documents, key, text, width).drop("kept")
