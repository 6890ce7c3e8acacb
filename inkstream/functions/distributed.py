"""Order-dependent and skew-prone building blocks that never gather a group in one task.

An ``OVER (PARTITION BY key ORDER BY ...)`` on raw rows puts a whole key in one task.
The helpers here range-partition on (key, order) instead, so a key that holds a third of
the table is spread over many tasks, and carry running totals from one range to the next
through a table that has at most (number of ranges + number of keys) rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkstream.session import ensure_checkpoint_dir

_PID = "_range_id"

#: Tables written inside each open :func:`scratch` block.
_owned: list[list[DataFrame]] = []


def cut_lineage(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` as a table written to the shared checkpoint folder, read with ``schema`` where user-defined types stand for plain ones.

    Unlike ``checkpoint()`` a written table keeps no constraints of the plan it came from
    (they multiply in iterative joins), is columnar, and its size is known to the planner.
    It survives the loss of any executor, and goes with the session unless :func:`release`
    removes it before.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/inkstream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._written_to = path
    if _owned:
        _owned[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Owns what :func:`cut_lineage` writes inside: it is removed at the end of the block.

    For steps that write their result themselves, as micro-batches do.
    """
    _owned.append([])
    try:
        yield
    finally:
        release(*_owned.pop())


def release(*tables: DataFrame) -> None:
    """Remove tables that :func:`cut_lineage` wrote, when nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For work that is heavy per row (long texts, vectors) on a scan with fewer splits than
    cores.  A table with enough splits, as any large one has, is returned unchanged.  Meant
    for scans and projections: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scalar_struct(stats: DataFrame) -> Column:
    """A one-row DataFrame as a struct-valued scalar subquery."""
    return stats.select(F.struct("*")).scalar()


def _range_ids(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *keys).withColumn(_PID, F.spark_partition_id())
    # range bounds come from sampling: fix the assignment before it is read twice
    return cut_lineage(spread)


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums ``<name>`` and group totals ``<name>_total``.

    ``order`` must be total within a group.  Rows keep all their columns.
    """
    group = list(group)
    tmp = {f"_m_{name}": col for name, col in measures.items()}
    spread = _range_ids(df.withColumns(tmp), [F.col(c) for c in [*group, *order]])

    per_range = spread.groupBy(*group, _PID).agg(*[F.sum(m).alias(m) for m in tmp])
    # at most one row per (group, range): bounded by ranges + groups
    if group:
        seen = Window.partitionBy(*group)
    else:
        seen = Window.partitionBy(F.lit(0))
    before = seen.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = per_range.select(
        *group,
        _PID,
        *[F.coalesce(F.sum(f"_m_{n}").over(before), zero).alias(f"_o_{n}") for n in measures],
        *[F.sum(f"_m_{n}").over(seen).alias(f"{n}_total") for n in measures],
    )

    local = Window.partitionBy(_PID, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = spread.withColumns({f"_l_{n}": F.sum(f"_m_{n}").over(local) for n in measures})
    left, right = running.alias("l"), offsets.alias("r")
    on = F.col(f"l.{_PID}") == F.col(f"r.{_PID}")
    for name in group:
        on = on & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    joined = left.join(right, on)
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"l._l_{n}") + F.col(f"r._o_{n}")).alias(n) for n in measures],
        *[F.col(f"r.{n}_total") for n in measures],
    )


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_no"
) -> DataFrame:
    """1-based position of a row in its group (``name``) and the group size (``name_total``)."""
    return prefix_sums(df, group, order, {name: F.lit(1).cast("bigint")})


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per group from distinct-value counts.

    ``linear`` interpolates between neighbours at position ``p * (n - 1)``; ``index`` takes
    the element at zero-based index ``floor(n * p)``, capped at the last one.  Counting
    distinct values first combines on the map side; the cumulative counts come from
    :func:`prefix_sums`, so neither a hot group nor a wide value domain meets one task.
    """
    group = list(group)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return quantiles_of_counts(counts, group, "_v", "_n", probs, method)


def quantiles_of_counts(
    counts: DataFrame, group: Sequence[str], value: str, n_rows: str, probs: Mapping[str, float], method: str = "linear"
) -> DataFrame:
    """:func:`exact_quantiles` of values that come with their numbers, each value of a group once."""
    group = list(group)
    plain = counts.select(*group, F.col(value).alias("_v"), F.col(n_rows).alias("_n"))
    cum = prefix_sums(plain, group, ["_v"], {"_cum": F.col("_n")})
    n = F.col("_cum_total")

    def at(index: Column) -> Column:
        inside = (F.col("_cum") - F.col("_n") <= index) & (index < F.col("_cum"))
        return F.max(F.when(inside, F.col("_v")))

    aggs = []
    for name, p in probs.items():
        if method == "index":
            aggs.append(at(F.least(F.floor(n * F.lit(p)), n - 1)).alias(name))
        else:
            pos = (n - 1) * F.lit(float(p))
            low, high = at(F.floor(pos)), at(F.ceil(pos))
            aggs.append((low + (high - low) * F.max(pos - F.floor(pos))).alias(name))
    return cum.groupBy(*group).agg(*aggs)


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.001) -> DataFrame:
    """Keys holding more than ``share`` of all rows: at most ``1 / share`` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    floor = df.select((F.count(F.lit(1)) * share).alias("t")).scalar()
    return counts.where((F.col("_n") > 1) & (F.col("_n") > floor)).select(*keys)


def skew_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 32, share: float = 0.001
) -> DataFrame:
    """LEFT JOIN that stays balanced when a key repeats very often on the right.

    Spark's adaptive skew handling cannot split the right side of a left join.  Keys above
    ``share`` of the right rows (at most ``1/share`` keys, so the broadcast is bounded) get a
    salt by row position on the right and every salt on the left; one left join on key and
    salt then serves all keys.  A hot key has a partner, so its left rows without one are
    only salts that missed, and go.
    """
    keys = list(keys)
    right = right.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    hot = F.broadcast(hot_keys(right, keys, share).withColumn("_hot", F.lit(True)))
    position = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    zero, last = F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")
    salted = (
        right.withColumn("_at", position).join(hot, keys, "left")
        .withColumns({"_salt": F.when(F.col("_hot"), F.col("_at")).otherwise(zero), "_found": F.lit(True)})
        .drop("_at", "_hot")
    )
    every = F.when(F.col("_hot"), F.sequence(zero, last)).otherwise(F.array(zero))
    tagged = left.join(hot, keys, "left").withColumn("_salt", F.explode(every))
    joined = tagged.join(salted, [*keys, "_salt"], "left")
    return joined.where("_hot IS NULL OR _found").drop("_hot", "_salt", "_found")
