"""Partitioned writes: bounded tasks whatever the size of a partition value, and nothing lost."""

from collections import Counter

from pyspark.sql import functions as F

from inkstream.sources import tables


def test_a_large_partition_value_goes_to_several_bounded_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "TASK_BYTES", 64_000)
    hot = F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 100 == 99, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id") % 70))
    df = spark.range(20_000).select("id", hot.alias("kind"), F.repeat(F.lit("x"), 50).alias("wide"), F.array("id").alias("list"))
    tables.write_table(df, f"file://{tmp_path}/t", partition_by=["kind"])
    back = tables.read_table(spark, f"file://{tmp_path}/t")
    assert Counter((r.id, r.kind, len(r.wide)) for r in back.collect()) == Counter((r.id, r.kind, len(r.wide)) for r in df.collect())
    files = back.groupBy(F.input_file_name().alias("file")).count().collect()
    assert max(r["count"] for r in files) < 1_000  # about 140 bytes a row
    assert len(files) < 150


def test_an_empty_table_is_written(spark, rows, tmp_path):
    tables.write_table(rows([], "a int, b string"), f"file://{tmp_path}/t", partition_by=["b"])
    assert not any(p.suffix == ".parquet" and p.parent.name.startswith("b=") for p in (tmp_path / "t").rglob("*"))
