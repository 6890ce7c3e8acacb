"""All outputs of one stream from one job: each micro-batch reads the source once and commits every output with one manifest.

Rows wait in a shared table, by time, until no row of their window can be missing; then the batch operators run on the windows that have closed,
so an output has the rows that its operator gives on the whole stream.  A row is written once, and goes when the last output has used it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from inkstream.streaming import files

_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def micros(interval: str) -> int:
    """``"6 hours"`` in microseconds."""
    number, unit = interval.split()
    return int(number) * _SECONDS[unit.lower().rstrip("s")] * 1_000_000


@dataclass(frozen=True)
class Output:
    """A batch operator as an output of a stream.

    With a ``width`` it gets the rows of whole windows that have closed.  Without one, rows are judged one by one as the watermark
    passes them: it gets those, and the rows of the interval ``before`` them.
    """

    make: Callable[[DataFrame], DataFrame]
    width: str | None = None
    before: str | None = None


@dataclass(frozen=True)
class SharedOutputs:
    """The batch function of a stream, its waiting rows and its outputs under ``root``.

    ``schema`` is that of the stream.  The watermark is the newest time of ``ts`` less ``delay``; rows older than the watermark of
    the micro-batches before are counted as late and left out.  ``period`` is the time span of one folder of waiting rows.
    """

    root: str
    outputs: dict[str, Output]
    schema: str | StructType
    delay: str = "10 minutes"
    period: str = "1 hour"
    ts: str = "event_time"

    def manifest(self, spark: SparkSession, batch: int) -> dict:
        """Watermark (microseconds), late rows, how far each output has come, and the micro-batches that wrote it."""
        if batch < 0:
            return {"watermark": None, "late": 0, "closed": {}, "written": {n: [] for n in self.outputs}}
        return files.read_json(spark, f"{self.root}/_manifest/batch={batch}.json")

    def _waiting(self, spark: SparkSession, batch: int) -> DataFrame:
        stored = StructType(list(spark.createDataFrame([], self.schema).schema.fields)).add("_late", BooleanType())
        stored = stored.add("period", LongType()).add("batch", IntegerType())
        # a micro-batch that stopped half-way may have left rows: they count once it has run again
        return spark.read.schema(stored).parquet(f"{self.root}/rows").where(F.col("batch") <= batch)

    def step(self) -> Callable[[DataFrame, int], None]:
        def commit(batch: DataFrame, batch_id: int) -> None:
            spark, at = batch.sparkSession, F.unix_micros(self.ts)
            before = self.manifest(spark, batch_id - 1)
            mark, period = before["watermark"], micros(self.period)
            late = F.coalesce(at < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
            rows = batch.where(F.col(self.ts).isNotNull()).withColumns(
                {"_late": late, "period": F.floor(at / F.lit(period)), "batch": F.lit(batch_id)}
            )
            # the only read of the source
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "batch").parquet(f"{self.root}/rows")
            waiting = self._waiting(spark, batch_id)
            new = waiting.where(F.col("batch") == batch_id).agg(F.max(at), F.count_if("_late")).first()
            moved = [t for t in (mark, None if new[0] is None else new[0] - micros(self.delay)) if t is not None]
            after = {
                "watermark": max(moved, default=None), "late": before["late"] + new[1], "closed": dict(before["closed"]),
                "written": {n: list(w) for n, w in before["written"].items()},
            }
            if after["watermark"] is not None:
                on_time = waiting.where("NOT _late").drop("_late", "batch")
                for name, output in self.outputs.items():
                    self._advance(on_time, name, output, batch_id, after)
            files.write_json(spark, f"{self.root}/_manifest/batch={batch_id}.json", after)
            self._forget(spark, before)

        return commit

    def _advance(self, waiting: DataFrame, name: str, output: Output, batch_id: int, state: dict) -> None:
        """Write what has closed since the last micro-batch that wrote this output."""
        step = micros(output.width) if output.width else 1
        closed, done = state["watermark"] // step * step, state["closed"].get(name)
        if done is not None and closed <= done:
            return
        at, first = F.unix_micros(self.ts), None if done is None else done - (micros(output.before) if output.before else 0)
        ready = waiting.where(at < closed)
        if first is not None:
            ready = ready.where((F.col("period") >= first // micros(self.period)) & (at >= first))
        made = output.make(ready.drop("period"))
        if output.width is None and done is not None:
            made = made.where(at >= done)
        made.write.mode("overwrite").parquet(f"{self.root}/out/{name}/batch={batch_id}")
        state["closed"][name] = closed
        state["written"][name].append(batch_id)

    def _forget(self, spark: SparkSession, before: dict) -> None:
        """Remove the waiting rows that all outputs had used before this micro-batch, should it run again."""
        if len(before["closed"]) < len(self.outputs):
            return
        used = min(c - micros(self.outputs[n].before or "0 seconds") for n, c in before["closed"].items()) // micros(self.period)
        for period in files.children(spark, f"{self.root}/rows", "period="):
            if int(period) < used:
                files.remove(spark, f"{self.root}/rows/period={period}")

    def output(self, spark: SparkSession, name: str, batch: int) -> DataFrame:
        """All rows of an output after a micro-batch."""
        schema = self.outputs[name].make(spark.createDataFrame([], self.schema)).schema
        parts = [spark.read.schema(schema).parquet(f"{self.root}/out/{name}/batch={b}") for b in self.manifest(spark, batch)["written"][name]]
        return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))
