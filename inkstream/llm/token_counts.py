"""Token counts of whole texts under a SentencePiece vocabulary, without encoding most of them.

Method (whole-token shortcut).  From the model file alone it is proven where merges cannot reach across
(:func:`pieces.splits_at_marks`), and by encoding every vocabulary string once, which strings encode alone as one token.  Counting
then splits a text into pre-tokens, looks the proven ones up, and lets the library merge only the rest, each distinct
one once while a bounded table remembers it.

Cases.  Null or empty text: zero bytes, zero tokens.  A text of any length is counted whole; one without white space
is one pre-token.  Special strings such as ``<s>`` are ordinary text.  Repeated rows are counted each.  An empty table gives an empty
result.  Other columns are ignored, so clashing names cannot matter; a null key stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from inkstream.llm.arrays import blocks
from inkstream.llm.pieces import MARK, NORMAL, USER_DEFINED, pretokens, read_model, splits_at_marks

#: Distinct pre-tokens remembered by a Python worker; the table starts anew beyond that.
MEMORY = 500_000
#: Bytes of text whose pre-tokens are looked up together.
BLOCK = 4 << 20


class PretokenCounter:
    """Counts tokens."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = read_model(path)
        self.splits = splits_at_marks(model)
        self.memory = memory
        self.proven: dict[str, int] = {}
        if self.splits:
            words = [t[1:] for t, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED) and t[0] == MARK and t != MARK]
            self.proven = {w: 1 for w, n in zip(words, self._merge(words), strict=True) if n == 1}
            # a mark alone: what a space adds behind a word, as the two are parts of their own
            self.proven[""] = len(self.library.encode("x ")) - len(self.library.encode("x"))
        self.known = dict(self.proven)

    def _merge(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(parts, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the distinct unknown parts of all of them are merged in one call."""
        if not self.splits:
            return self._merge(texts)
        parts = [pretokens(t) if t else [] for t in texts]
        rest = set().union(*parts).difference(self.known)
        if len(self.known) + len(rest) > self.memory:
            self.known = dict(self.proven)
            rest = set().union(*parts).difference(self.known)
        todo = list(rest)
        self.known.update(zip(todo, self._merge(todo), strict=True))
        return [sum(map(self.known.__getitem__, p)) for p in parts]


_counters: dict[str, PretokenCounter] = {}


def counter_of(path: str) -> PretokenCounter:
    """The counter of this Python worker: what it remembers serves later tasks too."""
    if path not in _counters:
        _counters[path] = PretokenCounter(path)
    return _counters[path]


def token_counts(
    documents: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) for every row.

    A map over the rows: nothing is shuffled, and memory is one batch of rows and the bounded table.
    """
    rows = documents.select(documents[key].alias("key"), documents[text].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            tokens: list[int] = []
            for first, stop in blocks(sizes.to_numpy(zero_copy_only=False), BLOCK):
                texts = batch.column(1).slice(first, stop - first).to_pylist()
                tokens += counter.count([t or "" for t in texts])
            n_tokens = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes.cast(pa.int64()), n_tokens, pc.greater(n_tokens, limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
