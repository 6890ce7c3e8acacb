"""Partitioned reads and batched appends over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Rows per round trip of a bulk copy (fixed value).
BATCH_ROWS = 10_000


def jdbc_read_options(
    url: str, table: str, key: str, lower: object, upper: object, partitions: int
) -> dict[str, str]:
    """Options for a read split into ``partitions`` ranges of ``key``.

    The ranges are half open and the first and last are unbounded, so no row is lost when
    the bounds are stale, and no range depends on OFFSET.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(BATCH_ROWS),
    }


def read_jdbc_partitioned(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    lower: object,
    upper: object,
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    options = jdbc_read_options(url, table, key, lower, upper, partitions)
    return spark.read.format("jdbc").options(**options, **(properties or {})).load()


def append_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    connections: int | None = None,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Batched append; ``connections`` bounds the number of writers against the target."""
    options = {"url": url, "dbtable": table, "batchsize": str(BATCH_ROWS)}
    if connections:
        options["numPartitions"] = str(connections)
    df.write.format("jdbc").mode("append").options(**options, **(properties or {})).save()
