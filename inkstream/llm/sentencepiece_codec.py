"""SentencePiece encoding and decoding on the ``tokenizers`` library, checked against ``sentencepiece``.

Method.  The model protobuf is parsed (:mod:`pieces`) and rebuilt as a ``tokenizers`` pipeline: the normaliser with its
character map, the mark in front and for spaces, the unigram scores (or, for a BPE file, merges in the order of the
scores), byte fallback, and the decoder that undoes them.  Batches are encoded multithreaded.  Where the vocabulary
proves that no piece crosses the front of a word (:func:`pieces.splits_at_marks`) the parts of a text are encoded on
their own, each distinct one once per block; otherwise whole texts are.

Parity.  Everything that the rebuilt pipeline encodes is also encoded by the ``sentencepiece`` library.  Merges of one
piece that can be made in two ways may rank differently in the two libraries; where the ids differ, the library's ids
are kept and the row says ``parity = false``.

Cases.  Null or empty text: no ids, ``round_trip`` true for the empty text, decoded to the empty text.  Texts of any length are encoded
whole.  Special strings such as ``<s>`` are ordinary text.  Repeated rows are encoded each; an empty table gives an
empty result; other columns are ignored and a null key stays null.  A mark that is itself in a text decodes to a space, so
``round_trip`` compares with the text after that replacement.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from inkstream.llm.arrays import blocks, pieces
from inkstream.llm.pieces import (
    BPE, MARK, NORMAL, UNIGRAM, USER_DEFINED, Model, parse_model, pretokens, splits_at_marks,
)

#: Distinct parts remembered by a Python worker, bytes of text encoded together, and parts in one string for the libraries.
MEMORY = 300_000
BLOCK = 4 << 20
JOINED = 256


def merges_by_score(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece out of two others, best score first, then in the order of the parts' ids."""
    ids = {t: i for i, (t, _, _) in enumerate(model.pieces)}
    usable = {t for t, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    ranked = []
    for text, score, kind in model.pieces:
        if kind in (NORMAL, USER_DEFINED):
            for cut in range(1, len(text)):
                left, right = text[:cut], text[cut:]
                if left in usable and right in usable:
                    ranked.append((-score, ids[left], ids[right], left, right))
    ranked.sort()
    return [(left, right) for _, _, _, left, right in ranked]


def build_tokenizer(model: Model) -> Tokenizer:
    """The model as a ``tokenizers`` pipeline."""
    if model.kind == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {t: i for i, (t, _, _) in enumerate(model.pieces)}
        core = models.BPE(
            vocabulary, merges_by_score(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    steps: list[normalizers.Normalizer] = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    built = Tokenizer(core)
    if steps:
        built.normalizer = normalizers.Sequence(steps)
    undo: list[decoders.Decoder] = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    built.decoder = decoders.Sequence(undo)
    return built


class Codec:
    """Encodes and decodes.  The ids of known parts lie one after the other in one array."""

    def __init__(self, serialized: bytes, memory: int = MEMORY):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=serialized)
        model = parse_model(serialized)
        self.rebuilt = build_tokenizer(model)
        self.memory = memory
        # what a lone mark behind a word gives, as it cannot be asked for by itself
        words = {t: i for i, (t, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
        self.splits = splits_at_marks(model) and MARK in words
        self.lone = words.get(MARK)
        if self.splits:
            self.rebuilt.pre_tokenizer = pre_tokenizers.Metaspace(MARK, "never", True)
        self.fronts = np.array([t.startswith(MARK) for t, _, _ in model.pieces], dtype=bool)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # part n has the ids ends[n] : ends[n + 1]
        self.differing: set[str] = set()
        self.broken: set[str] = set()
        if self.splits:
            self._remember([""], np.array([self.lone]), np.array([1]))

    def _remember(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = len(self.known), self.ends[len(self.known)]
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(parts) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(parts)] = used + np.cumsum(lengths)
        self.known.update(zip(parts, range(n, n + len(parts)), strict=True))

    def _both(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of each text, and whether the two libraries agree."""
        own = self.rebuilt.encode_batch_fast(texts, add_special_tokens=False)
        checked = self.library.encode(texts, num_threads=1)
        return [(c, e.ids == c) for e, c in zip(own, checked, strict=True)]

    def _learn(self, parts: list[str]) -> None:
        """Encode, check and decode new parts, many to a string: a part begins wherever a piece opens with a mark."""
        joint = [p for p in parts if MARK not in p]
        single = [p for p in parts if MARK in p]
        groups = [joint[i : i + JOINED] for i in range(0, len(joint), JOINED)]
        texts = [" ".join(some) for some in groups]
        found = self._both(texts)
        again = self.rebuilt.decode_batch([ids for ids, _ in found], skip_special_tokens=False)
        for some, text, (ids, same), decoded in zip(groups, texts, found, again, strict=True):
            opens = np.flatnonzero(self.fronts[ids])
            if same and decoded == text and len(opens) == len(some):
                self._remember(some, np.array(ids), np.diff(np.append(opens, len(ids))))
            else:
                single += some
        if single:
            kept, self.rebuilt.pre_tokenizer = self.rebuilt.pre_tokenizer, None
            found = self._both(single)
            self.rebuilt.pre_tokenizer = kept
            for part, (ids, same), decoded in zip(single, found, self.decode([i for i, _ in found]), strict=True):
                self._remember([part], np.array(ids, dtype=np.int32), np.array([len(ids)]))
                if not same:
                    self.differing.add(part)
                if decoded != part.replace(MARK, " "):
                    self.broken.add(part)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """Ids of all texts in one array, how many each has, whether both libraries agree on a text, and whether its
        ids decode to it again."""
        if not self.splits:
            found = self._both(list(texts))
            ids = np.array(list(chain.from_iterable(i for i, _ in found)), dtype=np.int32)
            again = self.decode([i for i, _ in found])
            same = [d == t.replace(MARK, " ") for d, t in zip(again, texts, strict=True)]
            return ids, np.array([len(i) for i, _ in found], dtype=np.int64), [s for _, s in found], same
        parts = [pretokens(t) if t else [] for t in texts]
        every = set().union(*parts)
        if len(self.known) + len(every) > self.memory:
            self._forget()
        self._learn(list(every.difference(self.known)))
        counts = np.array([len(p) for p in parts], dtype=np.int64)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        starts, lengths = self.ends[which], self.ends[which + 1] - self.ends[which]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)]
        sizes = np.diff(total[np.concatenate(([0], np.cumsum(counts)))])
        agree = [not self.differing or self.differing.isdisjoint(p) for p in parts]
        return ids, sizes, agree, [not self.broken or self.broken.isdisjoint(p) for p in parts]

    def decode(self, ids: Sequence[list[int]]) -> list[str]:
        """The text of each list of ids."""
        return self.rebuilt.decode_batch(list(ids), skip_special_tokens=False)


_codecs: dict[bytes, Codec] = {}


def codec_of(serialized: bytes) -> Codec:
    """The codec of this Python worker for the model: what it remembers serves later tasks too."""
    if serialized not in _codecs:
        _codecs.clear()
        _codecs[serialized] = Codec(serialized)
    return _codecs[serialized]


def _serialized(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(documents: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``token_ids``, ``n_tokens``, ``parity`` and ``round_trip`` for every row.

    A map over the rows.  ``round_trip`` says whether the ids decode to the text again.
    """
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))
    model = _serialized(model_path)  # half a megabyte, sent with the tasks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in pieces(batches):
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, stop in blocks(sizes, BLOCK):
                texts = [t or "" for t in batch.column(1).slice(first, stop - first).to_pylist()]
                ids, lengths, parity, again = codec.encode(texts)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, stop - first), pa.ListArray.from_arrays(offsets, ids),
                        pa.array(lengths), pa.array(parity, pa.bool_()), pa.array(again, pa.bool_()),
                    ],
                    names=[key, "token_ids", "n_tokens", "parity", "round_trip"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        work, f"`{key}` {kind}, token_ids array<int>, n_tokens bigint, parity boolean, round_trip boolean"
    )


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """``key`` and the ``text`` that the ids of each row stand for; null ids give the empty text."""
    rows = encoded.select(encoded[key].alias("key"), encoded[ids].cast("array<int>").alias("ids"))
    model = _serialized(model_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            lists = [i or [] for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codec.decode(lists), pa.string())], names=[key, "text"]
            )

    return rows.mapInArrow(work, f"`{key}` {rows.schema['key'].dataType.simpleString()}, text string")
