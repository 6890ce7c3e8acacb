"""Quality scores from compression with dictionaries of good and of bad text.

Method.  Two zstandard dictionaries are trained, one on labelled good text and one on labelled bad text.  Every text is
compressed with both, in blocks so that the dictionaries matter in long texts too; the difference of the two sizes, over
their sum, says which kind of text it resembles.  A logistic fit on further labelled rows turns that into a probability.

Bounds.  At most ``FIT_ROWS`` labelled rows of each class give the dictionaries (at most ``FIT_BYTES`` of their blocks, taken over whole texts), and
as many other rows of each class the calibration, weighted back to the shares of the classes.  All else covers every row and every byte.

Cases.  Null or empty text: the score of no difference.  Very long texts are compressed whole, block by block.  If a
class has too little text for a dictionary its text serves as one; without labelled rows every score is 0.5.  Repeated
rows are scored each; an empty table gives an empty result; other columns are ignored and a null key is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.arrays import text_slices
from inkstream.llm.sampling import fit_logistic, labelled_sample, logistic, remainder

FIT_ROWS = 1500
FIT_BYTES = 6 << 20
DICTIONARY_BYTES = 112 << 10
BLOCK = 128
LEVEL = 3


def text_blocks(data: bytes, size: int = BLOCK) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from blocks of text; the text itself where there is too little of it to train on."""
    if sum(map(len, samples)) >= 8 * DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    return b"".join(samples)[-DICTIONARY_BYTES:]


@dataclass
class Sizer:
    """Compresses with the dictionary of each class; one per task."""

    dictionaries: tuple[bytes, bytes]  # bad, good

    def __post_init__(self) -> None:
        self.compressors = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=_prepared(d) if d else None, write_content_size=False, write_checksum=False,
                write_dict_id=False,
            )
            for d in self.dictionaries
        ]

    def difference(self, data: bytes) -> float:
        """Of the compressed sizes, over their sum: positive if the good dictionary fits better."""
        bad, good = (sum(len(c.compress(b)) for b in text_blocks(data)) for c in self.compressors)
        return (bad - good) / (bad + good) if data else 0.0

    def differences(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for row, data, offsets in text_slices(texts):
            raw = data.tobytes()
            for d in range(len(offsets) - 1):
                out[row + d] = self.difference(raw[offsets[d] : offsets[d + 1]])
        return out


def _prepared(data: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(data)
    made.precompute_compress(level=LEVEL)
    return made


@dataclass
class QualityModel:
    dictionaries: tuple[bytes, bytes]
    beta: np.ndarray
    scale: float


def fit(
    documents: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", fit_rows: int = FIT_ROWS,
) -> QualityModel:
    """Dictionaries and calibration from labelled rows where ``learn`` (a condition on the key) holds."""
    known = labels.where(learn).select(F.col(key), F.col(label).cast("int").alias(label))
    shares = {r[label]: r["n"] for r in known.groupBy(label).agg(F.countDistinct(key).alias("n")).collect() if r[label] in (0, 1)}
    if len(shares) < 2:
        return QualityModel((b"", b""), np.zeros(2), 1.0)
    # the first rows of each class, by hash, for the dictionaries and as many further ones for the calibration
    sample = labelled_sample(known, key, label, 2 * fit_rows).select(F.col(key).alias("_k"), F.col(label).alias("_y"))
    sample = sample.withColumn("_part", F.pmod(F.xxhash64(F.lit(7), "_k"), F.lit(2)))
    chosen = documents.join(F.broadcast(sample), F.col(key) == F.col("_k")).select("_k", "_y", "_part", F.col(text).alias("_t"))
    share = max(1, FIT_BYTES // BLOCK)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {0: [], 1: []}
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks[y] += text_blocks((t or "").encode())
        for y, own in blocks.items():
            step = max(1.0, len(own) / share)  # spread over all of the text
            taken = [own[int(i * step)] for i in range(min(len(own), share))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y], pa.int32()), pa.array([train_dictionary(taken)], pa.binary())], names=["y", "d"]
            )

    # bounded: at most 2 * fit_rows rows meet in one task
    fitting = chosen.where("_part = 0").select(F.col("_y").cast("int").alias("y"), "_t").repartition(1)
    made = {r["y"]: bytes(r["d"]) for r in fitting.mapInArrow(train, "y int, d binary").collect()}
    dictionaries = (made.get(0, b""), made.get(1, b""))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(dictionaries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizer.differences(batch.column(1)))], names=["y", "x"]
            )

    measured = chosen.where("_part = 1").select(F.col("_y").cast("int").alias("y"), "_t")
    points = measured.mapInArrow(measure, "y int, x double").toPandas()
    y, x = points["y"].to_numpy(dtype=float), points["x"].to_numpy()
    if len(set(y)) < 2:
        return QualityModel(dictionaries, np.zeros(2), 1.0)
    scale = float(x.std()) or 1.0
    weights = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    weights *= len(y) / weights.sum()
    return QualityModel(dictionaries, fit_logistic((x / scale)[:, None], y, weights), scale)


def score(documents: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key``, ``score`` and ``predicted`` (1 from ``threshold`` on) for every row: a map over the rows."""
    rows = documents.select(F.col(key).alias(key), F.col(text).alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.dictionaries)
        for batch in batches:
            x = sizer.differences(batch.column(1)) / model.scale
            p = logistic(model.beta, x[:, None])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=[key, "score", "predicted"],
            )

    return rows.mapInArrow(work, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double, predicted int")


def quality_scores(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = 5, fold: int = 0
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row; rows of the fold are not learned from."""
    learn = F.col(key).isNotNull() & (remainder(F.col(key), divisor) != fold)
    model = fit(documents, labels, learn, key, text)
    held = F.coalesce(remainder(F.col(key), divisor) == fold, F.lit(False))
    return score(documents, model, key, text).withColumn("held_out", held).select(key, "held_out", "score", "predicted")
