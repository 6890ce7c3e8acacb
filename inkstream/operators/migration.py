"""Bulk table migration: inventory, type mapping, typed copy and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTES_PER_MB = 0.1
MAX_TEXT = "NVARCHAR(MAX)"

# Target type per source system and source type.
TYPE_MAP: dict[str, dict[str, str]] = {
    "teradata": {
        "CHAR": "CHAR", "VARCHAR": "VARCHAR", "LONG VARCHAR": MAX_TEXT, "CLOB": MAX_TEXT, "INTEGER": "INT",
        "BIGINT": "BIGINT", "SMALLINT": "SMALLINT", "DECIMAL": "DECIMAL", "NUMERIC": "NUMERIC", "FLOAT": "FLOAT",
        "REAL": "REAL", "DOUBLE PRECISION": "FLOAT", "DATE": "DATE", "TIME": "TIME", "TIMESTAMP": "DATETIME2",
        "TIMESTAMP WITH TIME ZONE": "DATETIMEOFFSET", "BLOB": "VARBINARY(MAX)", "BYTE": "VARBINARY(MAX)",
        "VARBYTE": "VARBINARY(MAX)",
    },
    "netezza": {
        "VARCHAR": "VARCHAR", "NVARCHAR": "NVARCHAR", "CHAR": "CHAR", "NCHAR": "NCHAR", "TEXT": MAX_TEXT,
        "NTEXT": MAX_TEXT, "INTEGER": "INT", "BIGINT": "BIGINT", "SMALLINT": "SMALLINT", "TINYINT": "TINYINT",
        "DECIMAL": "DECIMAL", "NUMERIC": "NUMERIC", "FLOAT": "FLOAT", "REAL": "REAL", "DOUBLE": "FLOAT",
        "DATE": "DATE", "TIME": "TIME", "TIMESTAMP": "DATETIME2", "TIMESTAMPTZ": "DATETIMEOFFSET",
        "BLOB": "VARBINARY(MAX)", "BYTE": "VARBINARY(MAX)", "VARBYTE": "VARBINARY(MAX)", "BOOLEAN": "BIT",
    },
    "oracle": {
        "VARCHAR2": "NVARCHAR", "CHAR": "NCHAR", "NCHAR": "NCHAR", "NVARCHAR2": "NVARCHAR", "CLOB": MAX_TEXT,
        "NCLOB": MAX_TEXT, "NUMBER": "DECIMAL", "INTEGER": "INT", "FLOAT": "FLOAT", "BINARY_FLOAT": "REAL",
        "BINARY_DOUBLE": "FLOAT", "DATE": "DATETIME2", "TIMESTAMP": "DATETIME2",
        "TIMESTAMP WITH TIME ZONE": "DATETIMEOFFSET", "TIMESTAMP WITH LOCAL TIME ZONE": "DATETIMEOFFSET",
        "BLOB": "VARBINARY(MAX)", "BFILE": "VARBINARY(MAX)", "RAW": "VARBINARY", "LONG RAW": "VARBINARY(MAX)",
    },
    "mysql": {
        "VARCHAR": "NVARCHAR", "CHAR": "NCHAR", "TEXT": MAX_TEXT, "LONGTEXT": MAX_TEXT, "TINYINT": "TINYINT",
        "SMALLINT": "SMALLINT", "MEDIUMINT": "INT", "INT": "INT", "BIGINT": "BIGINT", "DECIMAL": "DECIMAL",
        "FLOAT": "FLOAT", "DOUBLE": "FLOAT", "DATE": "DATE", "TIME": "TIME", "DATETIME": "DATETIME2",
        "TIMESTAMP": "DATETIME2", "YEAR": "SMALLINT", "BLOB": "VARBINARY(MAX)", "LONGBLOB": "VARBINARY(MAX)",
        "JSON": MAX_TEXT,
    },
    "postgresql": {
        "VARCHAR": "NVARCHAR", "CHAR": "NCHAR", "TEXT": MAX_TEXT, "SMALLINT": "SMALLINT", "INTEGER": "INT",
        "BIGINT": "BIGINT", "DECIMAL": "DECIMAL", "NUMERIC": "NUMERIC", "REAL": "REAL",
        "DOUBLE PRECISION": "FLOAT", "MONEY": "DECIMAL(19,4)", "DATE": "DATE", "TIME": "TIME",
        "TIMESTAMP": "DATETIME2", "TIMESTAMPTZ": "DATETIMEOFFSET", "INTERVAL": "NVARCHAR(50)", "BOOLEAN": "BIT",
        "BYTEA": "VARBINARY(MAX)", "JSON": MAX_TEXT, "JSONB": MAX_TEXT, "UUID": "UNIQUEIDENTIFIER",
    },
}

#: Source types by how a copied value is converted (fixed values); others become text.
TEXT_TYPES = ("VARCHAR", "CHAR", "TEXT")
INTEGER_TYPES = ("INTEGER", "BIGINT", "SMALLINT")
NUMBER_TYPES = ("DECIMAL", "NUMERIC", "FLOAT", "DOUBLE")
DATE_TYPES = ("DATE",)
TIME_TYPES = ("TIMESTAMP", "DATETIME")


def schema_inventory(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns, rows, MB and estimated minutes per table, and a total row (NULL table).

    ``tables(table_name, row_count, size_kb)``, ``columns(table_name, column_name)``.
    """
    per = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
    joined = tables.join(per, "table_name", "left").select(
        "table_name",
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        "row_count",
        (F.col("size_kb") / 1024).alias("size_mb"),
    )
    out = joined.groupingSets([[F.col("table_name")], []], "table_name").agg(
        F.grouping("table_name").alias("g"),
        F.count(F.lit(1)).alias("tables"),
        F.sum("column_count").alias("column_count"),
        F.sum("row_count").alias("row_count"),
        F.sum("size_mb").alias("size_mb"),
    )
    minutes = F.col("size_mb") * F.lit(MINUTES_PER_MB)
    return out.withColumn(
        "estimated_minutes", F.when(F.col("g") == 1, F.floor(minutes).cast("double")).otherwise(minutes)
    ).drop("g")


def map_types(columns: DataFrame, source: str) -> DataFrame:
    """Target type per column from ``data_type, length, precision, scale``; unknown types are text."""
    table = TYPE_MAP[source]
    kind = F.upper("data_type")
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    base = F.coalesce(F.try_element_at(lookup, kind), F.lit(MAX_TEXT))

    def sized(default: str) -> Column:
        return F.concat(F.lit("("), F.coalesce(F.col("length").cast("string"), F.lit(default)), F.lit(")"))

    decimals = F.when(
        F.col("precision").isNotNull() & F.col("scale").isNotNull(),
        F.concat(F.lit("("), F.col("precision").cast("string"), F.lit(","), F.col("scale").cast("string"), F.lit(")")),
    ).otherwise("(18,2)")
    suffix = (
        F.when(base.isin("VARCHAR", "NVARCHAR"), sized("255"))
        .when(base.isin("CHAR", "NCHAR"), sized("1"))
        .when(base == "VARBINARY", sized("MAX"))
        .when(base.isin("DECIMAL", "NUMERIC"), decimals)
        .otherwise("")
    )
    return columns.withColumn("target_type", F.concat(base, suffix))


def copied_value(name: str, source_type: str) -> Column:
    """One column converted by its source type; NULL stays NULL, a failed cast is NULL."""
    kind, col = source_type.upper(), F.col(name)
    if kind in INTEGER_TYPES:
        return col.try_cast("bigint")
    if kind in NUMBER_TYPES:
        return col.try_cast("double")
    if kind in DATE_TYPES:
        return F.date_format(col, "yyyy-MM-dd")
    if kind in TIME_TYPES:
        # ISO form with fractions only where there are any
        whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        fraction = F.date_format(col, "SSSSSS")
        return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    return col.cast("string")


def copy_table(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The rows of a source table as they are written to the target (write with a sink)."""
    return df.select(*[copied_value(c, t).alias(c) for c, t in columns.items()])


def table_fingerprint(df: DataFrame, table: str) -> DataFrame:
    """Row count and an order-free checksum of a table."""
    return df.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).alias("checksum"),
    )


def migrate_and_reconcile(
    source: DataFrame, columns: Mapping[str, str], table: str, path: str
) -> tuple[DataFrame, DataFrame]:
    """Write the converted copy of a table to ``path``, read it back and compare.

    Returns what the target holds and the row of :func:`reconcile`.  Both fingerprints are
    taken of converted values, so a right copy agrees although its types are others.
    """
    converted = copy_table(source, columns)
    converted.write.mode("overwrite").parquet(path)
    target = source.sparkSession.read.schema(converted.schema).parquet(path)
    return target, reconcile({table: (converted, target)})


def reconcile(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Source and target rows per table, copied share in percent, and whether contents agree."""
    out = None
    for name, (source, target) in pairs.items():
        a = table_fingerprint(source, name)
        b = table_fingerprint(target, name)
        row = a.withColumn("_t", b.select(F.struct("rows", "checksum")).scalar()).select(
            "table_name",
            F.col("rows").alias("total_rows"),
            F.col("_t.rows").alias("migrated_rows"),
            F.coalesce(F.try_divide(F.col("_t.rows") * 100.0, F.col("rows")), F.lit(100.0)).alias("progress_percentage"),
            ((F.col("rows") == F.col("_t.rows")) & (F.col("checksum") == F.col("_t.checksum"))).alias("identical"),
        )
        out = row if out is None else out.unionByName(row)
    return out
