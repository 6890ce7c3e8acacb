"""Columnar tables, lake zones and file exports."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from inkstream.functions.distributed import cut_lineage

#: Bytes of rows in memory that one task sorts and writes, about.
TASK_BYTES = 256 << 20
ZONES = ("raw", "processed", "analytics")
#: JSON keeps microseconds; Spark's default format would cut them to milliseconds.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, merge_schema: bool = False
) -> DataFrame:
    """Every Parquet file under ``path`` as one relation; parts may differ with ``merge_schema``."""
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def _dealt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of equal ``cols`` together, in tasks of about ``TASK_BYTES`` however many rows a value has.

    A task sorts what it writes, so sizes count as in memory: compressed shuffle bytes, which adaptive execution goes by, may be a
    twentieth.  A first pass sums them by value, one row for each folder.
    """
    width = F.lit(16 * (len(df.columns) + 1)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType)):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
    sizes = df.groupBy(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(cols)]).agg(F.sum(width).alias("_size"))
    keys = [f"_p{i}" for i in range(len(cols))]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_lineage(sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))))
    tasks = placed.agg(F.coalesce(F.ceil(F.sum("_size") / TASK_BYTES), F.lit(1))).first()[0]
    on = F.lit(True)
    for k, c in zip(keys, cols, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(c))
    at = F.col("_before") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_size"))
    task = F.coalesce(F.floor(at / TASK_BYTES), F.lit(0)).cast("int")
    return df.join(placed, on, "left").repartitionById(int(tasks), task).select(*df.columns)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    fmt: str = "parquet",
    name: str | None = None,
) -> None:
    """Store ``df`` as a columnar table; with ``name`` it is also registered in the catalog.

    Rows are clustered by the partition columns first, and a partition value that holds much
    of the data is split into several files.
    """
    out = df
    if partition_by:
        out = _dealt(df, partition_by)
    writer = out.write.format(fmt).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if name:
        writer.option("path", path).saveAsTable(name)
    else:
        writer.save(path)


def write_zone(df: DataFrame, root: str, zone: str, date_col: str, dataset: str = "data") -> str:
    """Land rows as JSON under ``root/zone/dataset/date=.../``."""
    if zone not in ZONES:
        raise ValueError(f"zone must be one of {ZONES}")
    target = os.path.join(root, zone, dataset)
    dated = df.withColumn("date", F.to_date(date_col))
    _dealt(dated, ["date"]).write.mode("append").partitionBy("date").options(**JSON_TIMES).json(target)
    return target


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; Spark writes UTF-8, so non-ASCII text is kept as is."""
    df.select(F.to_json(F.struct("*"), JSON_TIMES).alias("value")).write.mode(mode).text(path)


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Export as CSV with a header or as JSON lines."""
    if fmt == "csv":
        df.write.mode(mode).options(**JSON_TIMES).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).options(**JSON_TIMES).json(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
