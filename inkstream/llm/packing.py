"""Packing token sequences into windows of a fixed size with hardly any padding.

A document is its token ids and one end id.  Windows hold whole documents, or pieces of them; a window shorter than the capacity would be
padded, except where its length is a power of two.

Method (multiway differencing of Karmarkar and Karp).
1. Windows that a document fills alone are cut off its front; what is left, shorter than a window, is an item.
2. ``GROUP`` items at a time are parted into as few windows as their sum needs: every item starts as a partial partition of its own, and the
   two with the greatest spread between their largest and smallest windows are merged with opposing imbalances, largest on smallest,
   until one partition is left.  Its windows are near-equal; if one exceeds the capacity the window count rises and the items
   are parted anew.
3. Near-equal windows are all a little short.  As documents may be cut, the smallest windows are taken apart to fill the others up; what remains, less than
   one window, joins the items of the next group.  The last remainder of a task is cut into windows whose lengths are powers of two.

Token ids come from the library.  Where the vocabulary file shows that a text's pre-tokens never reach across white space (:func:`cuts_at_space`), each
distinct word is encoded once while a bounded table remembers it, and a text's ids are those of its words; a word of lower-case letters is one pre-token and goes
straight to the library's merges.

Everything is a map over the rows: nothing is shuffled, and memory is a block of texts, a group of items, and the table.  Sequence ids are the number of the task's
partition and a count, so a task that runs again gives the same ones.

Cases.  Null or empty text: the end id alone.  A text of any length is cut whole.  Special strings inside texts are taken as the library takes them by
default.  Equal rows, and rows with equal or null keys, are documents of their own.  An empty table gives no sequence.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from tokenizers import Tokenizer

from inkstream.llm.arrays import blocks, give_back

CAPACITY = 2048
#: Items parted together.
GROUP = 128
#: Distinct words remembered by a Python worker; the table starts anew beyond that.
MEMORY = 400_000
#: Bytes of text encoded together, and unknown words encoded in one call.
BLOCK, WORDS_AT_ONCE = 4 << 20, 2000

# fixed values: pre-tokenizer pattern and normalisers known to leave white space as a border
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})

#: A comma or full stop between an ASCII letter and white space is a pre-token of its own.
_MARK = re.compile(rb"(?<=[A-Za-z])([,.])(?=[ \n])")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where it is visible, one behind all bytes otherwise."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def cuts_at_space(spec: dict) -> bool:
    """Whether the ids of a text are those of its words, cut at ASCII white space, one after the other.

    The proof needs: normalisers that act on characters and their combining marks only (nothing combines with a space), a pattern whose matches hold no white
    space and look at nothing around them, what is between matches dropped, and merges within a match.
    """
    norm, pre, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
    steps = pre.get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    bytewise = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return (
        norm.get("type") == "Sequence" and all(n in _NORMALISERS for n in norm["normalizers"]) and steps[0] == split and bytewise
        and model["type"] == "BPE" and not model["dropout"] and spec["post_processor"] is None
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )


class WordEncoder:
    """Token ids of texts as bytes, four little-endian ones for each id."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.cuts = cuts_at_space(spec)
        self.merges = self.library.model.tokenize
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.memory = memory
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[bytes], one: bool) -> None:
        """Remember the ids of words; ``one``: lower-case letters only are one pre-token, which goes straight to the merges."""
        rest = []
        for w in words:
            letters = w.decode()
            if one and letters.isalpha() and letters == letters.lower():
                merged = self.merges(letters if w.isascii() else w.decode("latin-1").translate(_LETTERS))
                self.known[w] = array("I", [t.id for t in merged]).tobytes()
            else:
                rest.append(w)
        for first in range(0, len(rest), WORDS_AT_ONCE):
            part = rest[first : first + WORDS_AT_ONCE]
            done = self.library.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(done.ids, dtype="<u4").tobytes()
            owner = np.array(done.word_ids, dtype=np.int64)
            edges = (4 * np.searchsorted(owner, np.arange(len(part) + 1))).tolist()
            for w, low, high in zip(part, edges, edges[1:], strict=False):
                self.known[w] = ids[low:high]

    def _words(self, text: str) -> tuple[list[bytes], bool]:
        """The words of a text, and whether normalising only lowers them.

        A-Z are lowered here where neither the text nor the lowered one has anything to compose.
        """
        data = text.encode()
        plain = is_normalized("NFC", text)
        if plain:
            low = data.lower()
            data = low if is_normalized("NFC", low.decode()) else data
        return _MARK.sub(rb" \1", data).split(), plain

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id."""
        if not self.cuts:
            return [self._whole(t) for t in texts]
        special = [any(s in t for s in self.special) for t in texts]
        words, plain = zip(*((([], False) if s else self._words(t)) for s, t in zip(special, texts, strict=True)), strict=True) if texts else ((), ())
        parts = [set().union(*(w for w, p in zip(words, plain, strict=True) if p == kind)) for kind in (True, False)]
        if len(self.known) + sum(len(p.difference(self.known)) for p in parts) > self.memory:
            self.known = {}
        for part, kind in zip(parts, (True, False), strict=True):
            self._learn(list(part.difference(self.known)), kind)
        ids = [b"".join(map(self.known.__getitem__, w)) for w in words]
        return [self._whole(t) if s else i for i, s, t in zip(ids, special, texts, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---- windows ----


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Items by window: near-equal sums by multiway differencing; windows without an item are left out."""
    # a partial partition: its non-empty windows as (sum, items), largest first
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)] if windows > 1 else []
    if not heap:
        return [list(range(len(sizes)))] if sizes else []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, one, a = heapq.heappop(heap)
        _, two, b = heapq.heappop(heap)
        low, high = min(len(a), windows - len(b)), max(len(a), windows - len(b))
        # largest on smallest: window i of a meets window (windows - 1 - i) of b
        for i in range(low, len(a)):
            total, items = b[windows - 1 - i]
            a[i] = (a[i][0] + total, a[i][1] + items)
        merged = a + b[: windows - high] if len(a) + len(b) > windows else a + b
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, min(one, two), merged))
    return [items for _, items in heap[0][2]]


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by window, no sum above ``capacity``, largest sum first; every size is at most that."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return sorted(parts, key=lambda p: -sum(sizes[i] for i in p))
        windows += 1


class Packer:
    """Takes documents one by one and gives ``(document, start, length, sequence, offset)`` for their pieces.

    A document is any object; its pieces carry it.
    """

    def __init__(self, capacity: int = CAPACITY, group: int = GROUP):
        self.capacity, self.group = capacity, group
        self.items: list[tuple[object, int, int]] = []  # document, start, length
        self.sequences = 0

    def _emit(self, pieces: list[tuple[object, int, int]]) -> Iterator[tuple]:
        offset = 0
        for document, start, length in pieces:
            yield document, start, length, self.sequences, offset
            offset += length
        self.sequences += 1

    def add(self, document: object, length: int) -> Iterator[tuple]:
        whole = length - length % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self._emit([(document, start, self.capacity)])
        if whole < length:
            self.items.append((document, whole, length - whole))
        if len(self.items) >= self.group:
            yield from self.pack()

    def pack(self) -> Iterator[tuple]:
        """Full windows of the items so far; less than one window of them stays."""
        sizes = [length for _, _, length in self.items]
        parts = [[self.items[i] for i in p] for p in near_equal(sizes, self.capacity)]
        full = sum(sizes) // self.capacity
        spare = [piece for p in parts[full:] for piece in p][::-1]
        for p in parts[:full]:
            gap = self.capacity - sum(length for _, _, length in p)
            yield from self._emit(p + self._take(spare, gap))
        self.items = spare[::-1]

    @staticmethod
    def _take(spare: list[tuple[object, int, int]], gap: int) -> list[tuple[object, int, int]]:
        """``gap`` ids off the end of the list, the last piece cut where needed."""
        out = []
        while gap:
            document, start, length = spare.pop()
            if length > gap:
                spare.append((document, start + gap, length - gap))
                length = gap
            out.append((document, start, length))
            gap -= length
        return out

    def finish(self) -> Iterator[tuple]:
        """What is left, in windows whose lengths are powers of two."""
        yield from self.pack()
        spare = self.items[::-1]
        left = sum(length for _, _, length in spare)
        while left:
            size = 1 << (left.bit_length() - 1)
            yield from self._emit(self._take(spare, size))
            left -= size
        self.items = []


def pack(
    documents: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``start``, ``length``, ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` and ``ids`` of every piece.

    ``ids`` holds four little-endian bytes for each id.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    kind = rows.schema["key"].dataType
    last = np.array([end], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(path), Packer(capacity)
        base = TaskContext.get().partitionId() << 33
        key_type = None

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            numbers = [(s, n, len(d[1]) // 4, base + q, o) for d, s, n, q, o in pieces]
            columns = list(zip(*numbers, strict=True))
            ids = [d[1][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d, *_ in pieces], key_type), *(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary())],
                names=[key, *names, "ids"],
            )

        for batch in batches:
            key_type = batch.column(0).type
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, stop in blocks(sizes + 1, BLOCK):
                texts = [t or "" for t in batch.column(1).slice(first, stop - first).to_pylist()]
                keys = batch.column(0).slice(first, stop - first).to_pylist()
                pieces = []
                for k, ids in zip(keys, encoder.encode(texts), strict=True):
                    ids += last
                    pieces.extend(packer.add((k, ids), len(ids) // 4))
                if pieces:
                    yield batch_of(pieces)
            give_back()
        if pieces := list(packer.finish()):
            yield batch_of(pieces)

    fields = [StructField(key, kind), *(StructField(c, LongType()) for c in names), StructField("ids", BinaryType())]
    return rows.mapInArrow(work, StructType(fields))


def digest(
    documents: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The pieces of :func:`pack` with ``ids_crc32`` instead of the ids."""
    return pack(documents, path, end, capacity, key, text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
