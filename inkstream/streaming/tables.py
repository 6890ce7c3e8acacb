"""Small versioned tables kept by ``foreachBatch``: one folder per micro-batch.

A micro-batch that is run again overwrites its own version, so results are exactly once.
Only the last two versions are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Versioned:
    """A table whose state after micro-batch ``n`` lies in ``path/v=n``."""

    path: str
    schema: str | StructType

    def at(self, spark: SparkSession, batch: int) -> DataFrame:
        """State after ``batch``; empty before the first one."""
        if batch < 0:
            return spark.createDataFrame([], self.schema)
        # every micro-batch writes its version: a missing one is an error, not an empty state
        return spark.read.schema(self.schema).parquet(f"{self.path}/v={batch}")

    def put(self, df: DataFrame, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        spark = df.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={batch - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.at(spark, batch)
