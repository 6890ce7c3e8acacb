"""Experiments: eligibility, assignment and statistics of variants.

Events in long form: ``metric, user_id, variant, value``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkstream.functions import stats
from inkstream.functions.distributed import exact_quantiles, prefix_sums

CONTROL, TREATMENT = "control", "treatment"
T_TEST_SIZE, SIGNIFICANCE = 30, 0.05


def audience_filter(audience: Mapping[str, object]) -> Column:
    """Condition of an audience: attribute equality, location list, device list."""
    ok = F.lit(True)
    for name, value in dict(audience.get("user_attributes") or {}).items():
        ok = ok & F.col(name).eqNullSafe(F.lit(value))
    for key, col in (("geographic", "location"), ("device_types", "device_type")):
        if key in audience:
            ok = ok & F.coalesce(F.col(col).cast("string").isin(*[str(v) for v in audience[key]]), F.lit(False))
    return ok


def eligible(users: DataFrame, audience: Mapping[str, object]) -> DataFrame:
    return users.where(audience_filter(audience))


def hash_ratio(user: Column, experiment_id: str) -> Column:
    """First 32 bits of md5(user:experiment) as a number in [0, 1)."""
    digest = F.md5(F.concat(user.cast("string"), F.lit(f":{experiment_id}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def assign_variants(
    users: DataFrame,
    experiment_id: str,
    allocation: Mapping[str, float],
    audience: Mapping[str, object] | None = None,
    key: str = "user_id",
) -> DataFrame:
    """First variant whose cumulative allocation reaches the user's ratio, else control."""
    ratio, total = hash_ratio(F.col(key), experiment_id), 0.0
    variant = F.when(F.lit(False), CONTROL)
    for name, share in allocation.items():
        total += share
        variant = variant.when(ratio <= total, name)
    variant = variant.otherwise(CONTROL)
    if audience:
        variant = F.when(audience_filter(audience), variant).otherwise(CONTROL)
    return users.withColumn("variant", variant)


def variant_stats(events: DataFrame, keys: Sequence[str] = ("metric", "variant")) -> DataFrame:
    """n, mean, population deviation and median per metric and variant; a missing value is 0."""
    rows = events.withColumn("value", F.coalesce("value", F.lit(0.0)))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    return base.join(exact_quantiles(rows, list(keys), "value", {"median": 0.5}), list(keys))


@F.pandas_udf(DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([stats.t_quantile(a, b) for a, b in zip(p, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([stats.t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def _rank_p(r1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series(
        [stats.rank_sum_p(a, int(b), int(c), d) for a, b, c, d in zip(r1, n1, n2, ties)], dtype="float64"
    )


def confidence_interval(variants: DataFrame, level: float = 0.95) -> DataFrame:
    """mean ± t(n-1) * std / sqrt(n) on rows of :func:`variant_stats`."""
    critical = _t_quantile(F.lit(1 - (1 - level) / 2), (F.col("n") - 1).cast("double"))
    margin = critical * F.col("std") / F.sqrt("n")
    out = variants.withColumn("_m", margin)
    return out.withColumns(
        {"ci_low": F.col("mean") - F.col("_m"), "ci_high": F.col("mean") + F.col("_m")}
    ).drop("_m")


def _pair(variants: DataFrame, control: str, treatment: str) -> DataFrame:
    """One row per metric with the sufficient statistics of both variants."""

    def of(name: str, col: str) -> Column:
        return F.max(F.when(F.col("variant") == name, F.col(col)))

    return variants.groupBy("metric").agg(
        *[of(control, c).alias(f"c_{c}") for c in ("n", "mean", "std")],
        *[of(treatment, c).alias(f"t_{c}") for c in ("n", "mean", "std")],
    )


def effect_size(variants: DataFrame, control: str = CONTROL, treatment: str = TREATMENT) -> DataFrame:
    """Cohen's d per metric, pooled over the population deviations."""
    both = _pair(variants, control, treatment)
    c, t = F.col("c_n"), F.col("t_n")
    pooled = F.sqrt(((c - 1) * F.col("c_std") ** 2 + (t - 1) * F.col("t_std") ** 2) / F.nullif(c + t - 2, F.lit(0)))
    d = F.try_divide(F.col("t_mean") - F.col("c_mean"), pooled)
    return both.select("metric", d.alias("effect_size"))


def _rank_sums(events: DataFrame, control: str, treatment: str) -> DataFrame:
    """Rank sum of the control sample and the tie term per metric.

    Equal values are counted first; average ranks follow from the distributed running count
    of distinct values.
    """
    rows = events.where(F.col("variant").isin(control, treatment)).withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )
    counts = rows.groupBy("metric", "value").agg(
        F.count_if(F.col("variant") == control).alias("c"), F.count(F.lit(1)).alias("n")
    )
    cum = prefix_sums(counts, ["metric"], ["value"], {"cum": F.col("n")})
    n = F.col("n").cast("double")
    rank = F.col("cum") - n + (n + 1) / 2
    return cum.groupBy("metric").agg(
        F.sum(F.col("c") * rank).alias("r1"),
        F.sum(F.col("c")).alias("n1"),
        F.sum(F.col("n") - F.col("c")).alias("n2"),
        F.sum(n * n * n - n).alias("ties"),
    )


def significance(
    events: DataFrame,
    variants: DataFrame | None = None,
    control: str = CONTROL,
    treatment: str = TREATMENT,
) -> DataFrame:
    """p value per metric: pooled t test when both samples exceed 30, else rank-sum test."""
    variants = variant_stats(events) if variants is None else variants
    both = _pair(variants, control, treatment)
    c, t = F.col("c_n"), F.col("t_n")
    pooled = (c * F.col("c_std") ** 2 + t * F.col("t_std") ** 2) / F.nullif(c + t - 2, F.lit(0))
    t_stat = F.try_divide(F.col("c_mean") - F.col("t_mean"), F.sqrt(pooled * (1 / c + 1 / t)))
    tested = both.withColumn("_t", t_stat).withColumn("_tp", _t_p("_t", (c + t - 2).cast("double")))
    ranked = _rank_sums(events, control, treatment).withColumn("_up", _rank_p("r1", "n1", "n2", "ties"))
    joined = tested.join(ranked, "metric", "left")
    large = (c > T_TEST_SIZE) & (t > T_TEST_SIZE)
    out = joined.where("c_n > 0 AND t_n > 0").select(
        "metric",
        F.when(large, "t_test").otherwise("mann_whitney_u").alias("test"),
        F.when(large, F.col("_tp")).otherwise(F.col("_up")).alias("p_value"),
    )
    return out.withColumn("is_significant", F.col("p_value") < SIGNIFICANCE)


def experiment_report(events: DataFrame, control: str = CONTROL, treatment: str = TREATMENT) -> DataFrame:
    """Per metric and variant: statistics, interval, participants, test and effect.

    A metric has one test and one effect, so they are its overall p value, effect and verdict
    as well; NULL where a variant is missing.
    """
    variants = variant_stats(events)
    people = events.groupBy("metric", "variant").agg(F.count_distinct("user_id").alias("participants"))
    tests = significance(events, variants, control, treatment)
    effects = effect_size(variants, control, treatment)
    return (
        confidence_interval(variants)
        .join(people, ["metric", "variant"])
        .join(tests, "metric", "left")
        .join(effects, "metric", "left")
        .withColumns(
            {
                "overall_p_value": F.col("p_value"),
                "overall_effect_size": F.col("effect_size"),
                "overall_significant": F.coalesce("is_significant", F.lit(False)),
            }
        )
    )
