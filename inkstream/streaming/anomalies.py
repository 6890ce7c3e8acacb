"""Slow documents on a stream: each judged by the hour before it, once no row of that hour can be missing.

State is what the next micro-batch needs and no more, whatever the length of the stream: the rows that the watermark has not
passed yet, and for each instant since an hour before the watermark three sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from inkstream.functions.distributed import cut_lineage, scalar_struct, scratch
from inkstream.operators import windows as W
from inkstream.streaming.tables import Versioned

ROWS = "event_time TIMESTAMP, document_id BIGINT, processing_duration DOUBLE, document_type STRING, user_id BIGINT"
SUMS = "at TIMESTAMP, n BIGINT, s DOUBLE, q DOUBLE"
MARK = "watermark TIMESTAMP, centre DOUBLE, late BIGINT"


@dataclass(frozen=True)
class TrailingAnomalies:
    """The batch function of a stream, its state and its output under ``root``.

    The watermark is the newest event time less ``delay``.  Rows before the watermark of the micro-batches so far are late: they are
    counted and left out.  A row is judged in the micro-batch that moves the watermark past it; rows of one instant are judged together.
    Running a micro-batch again overwrites what it wrote.
    """

    root: str
    delay: str = "10 minutes"
    schema: str = ROWS

    @property
    def _rows(self) -> Versioned:
        return Versioned(f"{self.root}/rows", self.schema)

    @property
    def _sums(self) -> Versioned:
        return Versioned(f"{self.root}/sums", SUMS)

    @property
    def marks(self) -> Versioned:
        return Versioned(f"{self.root}/mark", MARK)

    def step(self) -> Callable[[DataFrame, int], None]:
        def judge(batch: DataFrame, batch_id: int) -> None:
            with scratch():
                self._judge(batch, batch_id)

        return judge

    def _judge(self, batch: DataFrame, batch_id: int) -> None:
        spark, ts, x = batch.sparkSession, F.col("event_time"), F.col("processing_duration")
        known = self._rows.at(spark, batch_id - 1)
        arrived = cut_lineage(batch.select(*known.columns))  # the only read of the source
        before = scalar_struct(self.marks.at(spark, batch_id - 1))
        on_time = before["watermark"].isNull() | (ts >= before["watermark"])
        seen = arrived.agg(
            (F.max(ts) - F.expr(f"INTERVAL {self.delay}")).alias("mark"), F.avg(x).alias("mean"), F.count_if(~on_time).alias("late")
        )
        self.marks.put(
            seen.select(
                F.greatest("mark", before["watermark"]).alias("watermark"),
                F.coalesce(before["centre"], "mean").alias("centre"),
                (F.col("late") + F.coalesce(before["late"], F.lit(0))).alias("late"),
            ),
            batch_id,
        )
        now = scalar_struct(self.marks.at(spark, batch_id))
        fresh = arrived.where(on_time)
        sums = cut_lineage(
            self._sums.at(spark, batch_id - 1).unionByName(W.instant_sums(fresh, now["centre"]))
            .groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
        )
        rows = known.unionByName(fresh.where(x > 0))
        passed = ts < now["watermark"]
        limits = W.trailing_limits(sums.where(F.col("at") < now["watermark"]), now["centre"]).withColumnRenamed("at", "event_time")
        slow = rows.where(passed).join(limits, "event_time").where(x > F.col("limit"))
        slow.select(*known.columns).write.mode("overwrite").parquet(f"{self.root}/found/batch={batch_id}")
        self._rows.put(rows.where(F.coalesce(~passed, F.lit(True))), batch_id)
        kept = F.col("at") >= now["watermark"] - F.expr("INTERVAL 1 HOUR")
        self._sums.put(sums.where(F.coalesce(kept, F.lit(True))), batch_id)

    def found(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """All slow documents up to a micro-batch."""
        schema = spark.createDataFrame([], self.schema).schema
        if batch_id < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema.add("batch", IntegerType())).parquet(f"{self.root}/found").where(F.col("batch") <= batch_id).drop("batch")
