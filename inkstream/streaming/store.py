"""A keyed table that micro-batches change: each writes the rows it has, and nothing of what was there before.

A micro-batch adds a run, a folder of its changed rows in buckets by key.  The newest row of a key wins.  Once ``fan`` runs of one level
are there they become one run of the next, so a row is rewritten about ``log(batches) / log(fan)`` times however long the history is,
and reading meets few runs.  A manifest per micro-batch lists the runs: it is written last, so a micro-batch that stops half-way has
changed nothing, and one that runs again starts from the manifest before it and ends in the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from inkstream.streaming import files


@dataclass(frozen=True)
class ChangeStore:
    """Rows by ``keys``; among rows of a key the greatest by ``order`` wins, then the latest micro-batch.

    ``clock`` names a time column, whose extremes the manifest keeps; ``keep`` (an interval) lets merges drop rows that are twice
    that older than the newest of all.  ``keep`` is for readers that leave such rows out anyway.
    """

    path: str
    schema: str | StructType
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    clock: str | None = None
    keep: str | None = None
    buckets: int = 8
    fan: int = 4

    def _schema(self, spark: SparkSession) -> StructType:
        return spark.createDataFrame([], self.schema).schema

    def manifest(self, spark: SparkSession, batch: int) -> dict:
        """``runs`` (folder, level), the bytes this micro-batch ``wrote`` and ``merged``; with a clock its extremes and the ``rows`` written."""
        if batch < 0:
            return {"runs": [], "oldest": None, "newest": None, "wrote": 0, "merged": 0}
        return files.read_json(spark, f"{self.path}/_manifest/batch={batch}.json")

    def _rows(self, spark: SparkSession, runs: list[dict]) -> DataFrame:
        stored = StructType(list(self._schema(spark).fields)).add("_batch", LongType()).add("run", StringType()).add("_bucket", IntegerType())
        if not runs:
            return spark.createDataFrame([], stored)
        paths = [f"{self.path}/run={r['folder']}" for r in runs]
        return spark.read.schema(stored).option("basePath", self.path).parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One row of each key, combined on the map side."""
        rest = [c for c in rows.columns if c not in self.keys]
        last = F.max_by(F.struct(*rest), F.struct(*self.order, "_batch")).alias("_row")
        return rows.groupBy(*self.keys).agg(last).select(*self.keys, *[F.col("_row")[c].alias(c) for c in rest])

    def _write(self, rows: DataFrame, folder: str) -> int:
        spark, path = rows.sparkSession, f"{self.path}/run={folder}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        return files.size(spark, path)

    def at(self, spark: SparkSession, batch: int, where: Column | None = None) -> DataFrame:
        """The rows after micro-batch ``batch``; ``where`` may hold for key columns only and reaches the files."""
        rows = self._rows(spark, self.manifest(spark, batch)["runs"]).drop("run", "_bucket")
        rows = rows if where is None else rows.where(where)
        return self._newest(rows).select(*self._schema(spark).names)

    def put(self, changes: DataFrame, batch: int) -> None:
        """Add the changed rows of micro-batch ``batch``."""
        spark = changes.sparkSession
        names = self._schema(spark).names
        state = self.manifest(spark, batch - 1)
        rows = changes.select(*names, F.lit(batch).cast("bigint").alias("_batch"))
        if self.order:
            rows = self._newest(rows).select(*names, "_batch")
        folder = str(batch)
        wrote = self._write(rows, folder)
        made = [folder]
        runs = [*state["runs"], {"folder": folder, "level": 0}]
        low, high, found = state["oldest"], state["newest"], [None] * 3
        if self.clock:
            at = F.unix_micros(self.clock)
            found = self._rows(spark, runs[-1:]).agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
            low = min((t for t in (low, found[0]) if t is not None), default=None)
            high = max((t for t in (high, found[1]) if t is not None), default=None)
        merged = 0
        while len(runs) >= self.fan and len({r["level"] for r in runs[-self.fan :]}) == 1:
            level = runs[-1]["level"] + 1
            rows = self._newest(self._rows(spark, runs[-self.fan :]).drop("run", "_bucket"))
            if self.clock and self.keep and high is not None:
                limit = F.timestamp_micros(F.lit(high)) - F.expr(f"2 * INTERVAL {self.keep}")
                rows = rows.where(F.col(self.clock) >= limit)
            folder = f"{batch}x{level}"
            made.append(folder)
            merged += self._write(rows.select(*names, "_batch"), folder)
            runs = [*runs[: -self.fan], {"folder": folder, "level": level}]
        new = {"runs": runs, "oldest": low, "newest": high, "wrote": wrote, "merged": merged, "rows": found[2]}
        files.write_json(spark, f"{self.path}/_manifest/batch={batch}.json", new)
        self._forget(spark, batch, state, new)
        for folder in made[:-1]:  # merged at once
            files.remove(spark, f"{self.path}/run={folder}")

    def _forget(self, spark: SparkSession, batch: int, *needed: dict) -> None:
        """Remove what only the micro-batch before the last needed."""
        if batch < 2:
            return
        try:
            old = self.manifest(spark, batch - 2)
        except Exception as error:  # it went when this micro-batch ran for the first time
            if "FileNotFound" not in str(error):
                raise
            return
        kept = {r["folder"] for m in needed for r in m["runs"]}
        for run in old["runs"]:
            if run["folder"] not in kept:
                files.remove(spark, f"{self.path}/run={run['folder']}")
        files.remove(spark, f"{self.path}/_manifest/batch={batch - 2}.json")
