"""Alert rules over metric series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.columns import instant


@dataclass(frozen=True)
class AlertRule:
    name: str
    description: str
    severity: str
    metric_name: str
    threshold: float
    operator: str
    window_minutes: int
    enabled: bool = True


# The default rules.
DEFAULT_RULES = (
    AlertRule("HighErrorRate", "High error rate detected", "critical", "requests_failed", 10.0, ">", 15),
    AlertRule("HighResponseTime", "High response time detected", "high", "response_time_avg", 5.0, ">", 10),
    AlertRule("LowSuccessRate", "Low success rate detected", "high", "success_rate", 95.0, "<", 15),
    AlertRule("HighMemoryUsage", "High memory usage detected", "medium", "memory_usage_percent", 85.0, ">", 20),
    AlertRule("HighCPUUsage", "High CPU usage detected", "medium", "cpu_usage_percent", 80.0, ">", 20),
    AlertRule(
        "DocumentProcessingFailure", "Document processing failure rate high", "critical",
        "document_processing_failures", 5.0, ">", 10,
    ),
    AlertRule("StorageQuotaWarning", "Storage quota usage high", "medium", "storage_usage_percent", 80.0, ">", 60),
    AlertRule(
        "DatabaseConnectionFailure", "Database connection failures detected", "critical",
        "database_connection_failures", 3.0, ">", 10,
    ),
)

_COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


def evaluate_alerts(
    metrics: DataFrame, rules: Sequence[AlertRule] = DEFAULT_RULES, as_of=None
) -> DataFrame:
    """Active alerts: the metric's mean over the rule's window compared with its threshold.

    The enabled rules are a handful of configuration objects, so they become conditional
    aggregates of one pass over the newest window instead of a join.
    """
    live = [r for r in rules if r.enabled]
    for r in live:
        if r.operator not in _COMPARE:
            raise ValueError(f"unknown operator: {r.operator}")
    now = instant(as_of)
    at, value = F.col("metric_timestamp"), F.col("metric_value")
    widest = max(r.window_minutes for r in live)
    rows = metrics.where(
        (at >= now - F.expr(f"INTERVAL {widest} MINUTE"))
        & (at <= now)
        & F.col("metric_name").isin(*sorted({r.metric_name for r in live}))
    )

    def mean(r: AlertRule) -> Column:
        inside = (F.col("metric_name") == r.metric_name) & (at >= now - F.expr(f"INTERVAL {r.window_minutes} MINUTE"))
        return F.avg(F.when(inside, value))

    means = rows.agg(*[mean(r).alias(f"r{i}") for i, r in enumerate(live)])
    found = [
        F.when(
            _COMPARE[r.operator](F.col(f"r{i}"), F.lit(r.threshold)),
            F.struct(
                F.lit(r.name).alias("rule_name"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.metric_name).alias("metric_name"),
                F.col(f"r{i}").alias("metric_value"),
                F.lit(r.threshold).alias("threshold"),
                F.lit(f"{r.description}: {r.metric_name}").alias("message"),
                F.lit("active").alias("status"),
            ),
        )
        for i, r in enumerate(live)
    ]
    return means.select(F.inline(F.array_compact(F.array(*found)))).withColumn("created_at", now)


def alert_history(alerts: DataFrame, start: str, end: str, ts: str = "created_at") -> DataFrame:
    return alerts.where(F.col(ts).between(instant(start), instant(end))).orderBy(F.desc(ts))


def resource_trend(metrics: DataFrame) -> DataFrame:
    """Current value per metric with its trend class (over 80, under 20, else stable)."""
    now = metrics.groupBy("metric_name").agg(
        F.round(F.max_by("metric_value", F.struct("metric_timestamp", "id")), 2).alias("current_value")
    )
    v = F.col("current_value")
    return now.withColumns(
        {
            "trend": F.when(v > 80, "increasing").when(v < 20, "decreasing").otherwise("stable"),
            "threshold": F.lit(80.0),
            "status": F.lit("healthy"),
        }
    )
