"""Count-min sketches of 64-bit keys, merged from the tasks' own and reduced to the bits "counted twice or more".

A sketch has two rows of ``CELLS`` cells.  A key falls into one cell of each row, and is estimated to be repeated if both
cells hold two counts or more, so no repeated key is ever missed; other keys may be taken for repeated, the more so the fuller
the sketch.  Its size does not depend on the data: ``2 * CELLS`` bits, 16 MB, are all that reaches the driver and the
tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstream.llm.arrays import mix

CELLS = 1 << 26
#: Ranges of cells of a row, merged by a task each.
RANGES = 64
_SPAN = CELLS // RANGES
_U = np.uint64

Bits = list[tuple[int, bytes]]


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    return [(mix(keys, row) >> _U(32)) & _U(CELLS - 1) for row in (1, 2)]


def merged_counts(
    rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterable[np.ndarray]], least: int = 2
) -> Bits:
    """Ranges of cells with their bits: set where the keys of all rows count ``least`` (1 or 2) or more.

    A task passes on the cells of its own keys, each once; ranges of cells are then merged on their own.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [k for k in keys_of(batch) if len(k)]
            if not found:
                continue
            for row, own in enumerate(_cells(np.concatenate(found))):
                cells, counts = np.unique(own, return_counts=True)
                edges = np.searchsorted(cells, np.arange(RANGES + 1, dtype=_U) * _U(_SPAN))
                local = (cells & _U(_SPAN - 1)).astype(np.uint32)
                many = counts > 1
                parts = [(r, edges[r], edges[r + 1]) for r in range(RANGES) if edges[r] < edges[r + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row * RANGES + r for r, _, _ in parts], pa.int32()),
                        pa.array([local[a:b].tobytes() for _, a, b in parts], pa.binary()),
                        pa.array([local[a:b][many[a:b]].tobytes() for _, a, b in parts], pa.binary()),
                    ],
                    names=["range", "once", "more"],
                )

    def merge(table: pa.Table) -> pa.Table:
        counts = np.zeros(_SPAN, dtype=np.uint8)
        for name in ("once", "more"):  # cells of the second list hold two counts or more of one task
            for blob in table.column(name).to_pylist():
                cells = np.frombuffer(blob, dtype=np.uint32)
                counts[cells] = np.minimum(counts[cells] + 1, 2)
        packed = np.packbits(counts >= least).tobytes()
        return pa.table({"range": table.column("range").slice(0, 1), "bits": pa.array([packed], pa.binary())})

    tasks = rows.mapInArrow(partial, "range int, once binary, more binary")
    merged = tasks.groupBy("range").applyInArrow(merge, "range int, bits binary")
    return [(r["range"], bytes(r["bits"])) for r in merged.collect()]


def bits(merged: Bits) -> np.ndarray:
    """The bits of both rows of cells."""
    out = np.zeros((2 * RANGES, _SPAN // 8), dtype=np.uint8)
    for which, data in merged:
        out[which] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(2, -1)


def estimated(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both cells of each key are set."""
    out = np.ones(len(keys), dtype=bool)
    for row, cells in enumerate(_cells(keys)):
        out &= (found[row][cells >> _U(3)] >> (_U(7) - (cells & _U(7))).astype(np.uint8)) & 1 == 1
    return out
