"""Tumbling-window metrics over the document-processing stream.

Every function takes the stream as a batch or a streaming DataFrame with the columns of
``Tables.doc_events`` and emits ``window_end``.  On a stream pass ``watermark`` to bound state.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.functions.columns import ago, as_bigint, instant, pct
from inkstream.functions.distributed import number_rows, prefix_sums, scalar_struct

TS = "event_time"

# Fixed values of the stream queries: milliseconds, confidence bands and alert limits.
FAST_MS, MEDIUM_MS, SLOW_ALERT_MS = 5000, 15000, 30000
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE, LOW_CONFIDENCE = 0.9, 0.7, 0.5
FAILURE_RATE_LIMIT, SLOW_COUNT_LIMIT, LOW_CONFIDENCE_COUNT_LIMIT = 10.0, 5, 3
PEAK_FACTOR, ANOMALY_SIGMAS = 1.5, 2.0


def tumbling(
    df: DataFrame,
    width: str,
    keys: Sequence[str],
    aggs: Mapping[str, Column],
    watermark: str | None = None,
    slide: str | None = None,
    ts: str = TS,
) -> DataFrame:
    """Aggregate per window (tumbling, or sliding with ``slide``) and key."""
    if watermark:
        df = df.withWatermark(ts, watermark)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = df.groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.end").alias("window_end"), *keys, *aggs)


def _ok() -> Column:
    return as_bigint(F.count_if("success"))


def _failed() -> Column:
    return as_bigint(F.count_if(~F.col("success")))


def _few_distinct(df: DataFrame, col: str) -> Column:
    """Exact distinct count of a column with few values; streams keep them as a set."""
    return F.size(F.collect_set(col)).cast("bigint") if df.isStreaming else F.count_distinct(col)


def duration_category(df: DataFrame, as_of=None, recent: str | None = None) -> DataFrame:
    """Fast / Medium / Slow per document; ``recent`` keeps the last interval before ``as_of``."""
    if recent:
        df = df.where(F.col(TS) >= ago(instant(as_of), recent))
    ms = F.col("processing_duration")
    speed = F.when(ms < FAST_MS, "Fast").when(ms < MEDIUM_MS, "Medium").otherwise("Slow")
    return df.select(
        F.col(TS).alias("processing_time"),
        "document_id",
        "document_type",
        "processing_duration",
        speed.alias("processing_category"),
        "success",
        "error_message",
        "user_id",
        "file_size",
        "confidence",
    )


def performance_metrics(df: DataFrame, width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    aggs = {
        "total_documents": F.count(F.lit(1)),
        "avg_processing_duration": F.avg("processing_duration"),
        "max_processing_duration": F.max("processing_duration"),
        "min_processing_duration": F.min("processing_duration"),
        "successful_documents": _ok(),
        "failed_documents": _failed(),
        "avg_confidence": F.avg("confidence"),
        "avg_file_size": F.avg("file_size"),
    }
    out = tumbling(df, width, (), aggs, watermark)
    return out.withColumn("success_rate", pct(F.col("successful_documents"), F.col("total_documents")))


def document_type_distribution(df: DataFrame, width: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    aggs = {
        "document_count": F.count(F.lit(1)),
        "avg_processing_duration": F.avg("processing_duration"),
        "avg_confidence": F.avg("confidence"),
        "success_count": _ok(),
        "failure_count": _failed(),
    }
    out = tumbling(df, width, ["document_type"], aggs, watermark)
    return out.withColumn("success_rate", pct(F.col("success_count"), F.col("document_count")))


def sentiment_trends(df: DataFrame, width: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    aggs = {
        "document_count": F.count(F.lit(1)),
        "avg_sentiment_score": F.avg("sentiment_score"),
        "avg_confidence": F.avg("confidence"),
    }
    known = df.where(F.col("sentiment").isNotNull())
    return tumbling(known, width, ["sentiment", "document_type"], aggs, watermark)


def language_analytics(df: DataFrame, width: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    aggs = {
        "document_count": F.count(F.lit(1)),
        "avg_processing_duration": F.avg("processing_duration"),
        "avg_confidence": F.avg("confidence"),
        "success_count": _ok(),
    }
    known = df.where(F.col("detected_language").isNotNull())
    out = tumbling(known, width, ["detected_language"], aggs, watermark)
    return out.withColumn("success_rate", pct(F.col("success_count"), F.col("document_count")))


def error_analysis(df: DataFrame, width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    aggs = {
        "error_count": F.count(F.lit(1)),
        "avg_duration_before_error": F.avg("processing_duration"),
    }
    failed = df.where(~F.col("success"))
    return tumbling(failed, width, ["error_code", "error_message", "document_type"], aggs, watermark)


def user_activity(df: DataFrame, width: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    aggs = {
        "documents_processed": F.count(F.lit(1)),
        "avg_processing_duration": F.avg("processing_duration"),
        "total_file_size": F.sum("file_size"),
        "unique_document_types": _few_distinct(df, "document_type"),
        "avg_confidence": F.avg("confidence"),
    }
    return tumbling(df.where(F.col("user_id").isNotNull()), width, ["user_id"], aggs, watermark)


def throughput_analysis(df: DataFrame, width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    if df.isStreaming:
        # users first, then windows: two chained aggregates count users exactly
        marked = df.withWatermark(TS, watermark) if watermark else df
        per_user = marked.groupBy(F.window(TS, width).alias("w"), "user_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("processing_duration").alias("ms"),
            F.count("processing_duration").alias("timed"),
            F.sum("file_size").alias("bytes"),
            F.collect_set("document_type").alias("types"),
        )
        types = F.size(F.array_distinct(F.flatten(F.collect_set("types")))).cast("bigint")
        out = per_user.groupBy(F.window("w", width).alias("v")).agg(
            F.sum("n").alias("documents"),
            (F.sum("ms") / F.sum("timed")).alias("avg_processing_duration"),
            F.sum("bytes").alias("total_data_processed"),
            F.count("user_id").alias("active_users"),
            types.alias("document_types_processed"),
        )
        return out.select(F.col("v.end").alias("window_end"), *out.columns[1:])
    # two distinct counts would triple every raw row; collapse to (window, user, type) first
    pair = df.groupBy(F.window(TS, width).alias("w"), "user_id", "document_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("processing_duration").alias("ms"),
        F.count("processing_duration").alias("timed"),
        F.sum("file_size").alias("bytes"),
    )
    out = pair.groupBy("w").agg(
        F.sum("n").alias("documents"),
        (F.sum("ms") / F.sum("timed")).alias("avg_processing_duration"),
        F.sum("bytes").alias("total_data_processed"),
        F.count_distinct("user_id").alias("active_users"),
        F.count_distinct("document_type").alias("document_types_processed"),
    )
    return out.select(F.col("w.end").alias("window_end"), *out.columns[1:])


def quality_metrics_window(df: DataFrame, width: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    conf = F.col("confidence")
    aggs = {
        "avg_confidence": F.avg(conf),
        "high_confidence_docs": as_bigint(F.count_if(conf >= HIGH_CONFIDENCE)),
        "medium_confidence_docs": as_bigint(F.count_if((conf >= MEDIUM_CONFIDENCE) & (conf < HIGH_CONFIDENCE))),
        "low_confidence_docs": as_bigint(F.count_if(conf < MEDIUM_CONFIDENCE)),
        "total_docs": F.count(F.lit(1)),
    }
    out = tumbling(df.where(conf.isNotNull()), width, ["document_type"], aggs, watermark)
    return out.withColumn("high_confidence_rate", pct(F.col("high_confidence_docs"), F.col("total_docs")))


def entity_analytics(df: DataFrame, width: str = "5 minutes", watermark: str | None = None) -> DataFrame:
    """Type x entity type, from the nested ``entities`` array."""
    marked = df.withWatermark(TS, watermark) if watermark else df
    flat = marked.select(TS, "document_id", "document_type", F.inline("entities"))
    flat = flat.where(F.col("entity_type").isNotNull())
    keys = ["document_type", "entity_type"]
    if df.isStreaming:
        # documents first, then windows: two chained aggregates count documents exactly
        per_document = flat.groupBy(F.window(TS, width).alias("w"), *keys, "document_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("entity_confidence").alias("sum"),
            F.count("entity_confidence").alias("known"),
        )
        out = per_document.groupBy(F.window("w", width).alias("v"), *keys).agg(
            F.sum("n").alias("entity_count"),
            (F.sum("sum") / F.sum("known")).alias("avg_entity_confidence"),
            F.count("document_id").alias("documents_with_entity"),
        )
        return out.select(F.col("v.end").alias("window_end"), *out.columns[1:])
    aggs = {
        "entity_count": F.count(F.lit(1)),
        "avg_entity_confidence": F.avg("entity_confidence"),
        "documents_with_entity": F.count_distinct("document_id"),
    }
    return tumbling(flat, width, keys, aggs)


def realtime_alerts(df: DataFrame, width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """The three alert rules in one pass: every window and type is aggregated once."""
    slow = F.col("processing_duration") > SLOW_ALERT_MS
    unsure = F.col("confidence") < LOW_CONFIDENCE
    aggs = {
        "total": F.count(F.lit(1)),
        "failed": _failed(),
        "slow": as_bigint(F.count_if(slow)),
        "slow_ms": F.avg(F.when(slow, F.col("processing_duration"))),
        "unsure": as_bigint(F.count_if(unsure)),
        "unsure_conf": F.avg(F.when(unsure, F.col("confidence"))),
    }
    base = tumbling(df, width, ["document_type"], aggs, watermark)
    rate = pct(F.col("failed"), F.col("total"))

    def alert(cond: Column, kind: str, message: str, count: Column, value: Column) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit(kind).alias("alert_type"),
                F.lit(message).alias("alert_message"),
                count.alias("event_count"),
                value.alias("metric_value"),
            ),
        )

    rules = F.array(
        alert(rate > FAILURE_RATE_LIMIT, "HighFailureRate", "High failure rate detected", F.col("failed"), rate),
        alert(
            F.col("slow") > SLOW_COUNT_LIMIT, "SlowProcessing", "Processing duration exceeds threshold",
            F.col("slow"), F.col("slow_ms"),
        ),
        alert(
            F.col("unsure") > LOW_CONFIDENCE_COUNT_LIMIT, "LowConfidence", "Low confidence scores detected",
            F.col("unsure"), F.col("unsure_conf"),
        ),
    )
    return base.select(
        F.col("window_end").alias("alert_time"), "document_type", F.inline(F.array_compact(rules))
    ).select("alert_time", "alert_type", "alert_message", "document_type", "event_count", "metric_value")


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def concat_parts(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union of parts whose columns may differ; a missing column is NULL."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def throughput_last_hour(df: DataFrame, as_of=None, ts: str = "created_at") -> DataFrame:
    """Documents of the trailing hour and the share with a failed status, in percent."""
    recent = df.where(F.col(ts) >= ago(instant(as_of), "1 HOUR"))
    n, bad = F.count(F.lit(1)), F.count_if(F.col("status").isin("failed", "error"))
    return recent.agg(
        n.alias("documents_last_hour"),
        as_bigint(bad).alias("failed_documents"),
        F.coalesce(pct(bad, n), F.lit(0.0)).alias("error_rate"),
    )


def hourly_mean(df: DataFrame, value: str, ts: str = TS) -> DataFrame:
    """Mean per hour; hours without rows are present with NULL."""
    means = df.groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(F.avg(value).alias("mean_value"))
    ends = means.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = ends.select(F.explode(F.expr("sequence(a, b, INTERVAL 1 HOUR)")).alias("hour"))
    return spine.join(means, "hour", "left")


def daily_volume_trend(df: DataFrame, ts: str = TS) -> DataFrame:
    """Rows per day (0 for empty days), previous day, direction and change in percent."""
    counts = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.select(F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("day"))
    days = spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("volume"))
    # the previous day comes by an equi-join: no window over an unpartitioned table
    before = days.select(F.date_add("day", 1).alias("day"), F.col("volume").alias("previous_volume"))
    out = days.join(before, "day", "left")
    change = F.abs(F.col("volume") - F.col("previous_volume"))
    return out.select(
        "day",
        "volume",
        "previous_volume",
        F.when(F.col("volume") > F.col("previous_volume"), "increasing")
        .when(F.col("previous_volume").isNotNull(), "decreasing")
        .alias("direction"),
        pct(change, F.col("previous_volume")).alias("change_percent"),
    )


def volume_change(df: DataFrame, ts: str = TS) -> DataFrame:
    """The last day of :func:`daily_volume_trend` as one report row."""
    trend = daily_volume_trend(df, ts)
    last = F.max_by(F.struct("direction", "change_percent"), "day")
    return trend.agg(F.lit("daily_processing_volume").alias("metric"), last.alias("t")).select("metric", "t.*")


# --- moving rows over the aggregated windows: one row per window and type ---


def moving_rows(per: DataFrame) -> DataFrame:
    """Means of ``current_avg`` over the last 5 and 10 windows present, per type."""
    order = Window.partitionBy("document_type").orderBy("window_end")
    return per.select(
        "window_end",
        "document_type",
        "current_avg",
        F.avg("current_avg").over(order.rowsBetween(-4, 0)).alias("moving_avg_5"),
        F.avg("current_avg").over(order.rowsBetween(-9, 0)).alias("moving_avg_10"),
    )


def trend_rows(per: DataFrame) -> DataFrame:
    prev = F.lag("document_count").over(Window.partitionBy("document_type").orderBy("window_end"))
    out = per.select("window_end", "document_type", "document_count", prev.alias("previous_count"))
    return out.withColumn("trend", F.col("document_count") - F.col("previous_count"))


def window_averages(df: DataFrame, width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    aggs = {"current_avg": F.avg("processing_duration"), "document_count": F.count(F.lit(1))}
    return tumbling(df, width, ["document_type"], aggs, watermark)


def moving_average(df: DataFrame, width: str = "1 minute") -> DataFrame:
    """Mean duration per window and type, and its mean over the last 5 and 10 windows present."""
    return moving_rows(window_averages(df, width))


def count_trend(df: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Count per window and type, the previous count and the difference."""
    return trend_rows(window_averages(df, width))


def sessions(
    df: DataFrame,
    gap: str = "5 minutes",
    keys: Sequence[str] = ("user_id",),
    watermark: str | None = None,
    ts: str = TS,
) -> DataFrame:
    """Activity sessions per key: start, end (last event plus gap), events.

    On a batch, events of one key inside a slice as wide as the gap always belong together,
    so they are first combined per (key, slice) on the map side; only these slices, bounded
    by the time span and not by the number of events, are put in order per key.
    """
    if df.isStreaming:
        rows = df.withWatermark(ts, watermark) if watermark else df
        out = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"))
        return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    width = F.expr(f"INTERVAL {gap}")
    slices = df.groupBy(F.window(ts, gap).alias("w"), *keys).agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy(*keys).orderBy("first")
    opens = F.coalesce(F.col("first") >= F.lag("last").over(order) + width, F.lit(True))
    marked = slices.withColumn("opens", opens.cast("int"))
    session = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("session", session).groupBy(*keys, "session").agg(
        F.min("first").alias("session_start"),
        (F.max("last") + width).alias("session_end"),
        F.sum("n").alias("events"),
    )
    return out.drop("session")


def with_global_stat(df: DataFrame, stats: DataFrame, prefix: str = "") -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (scalar subquery, no join)."""
    one = scalar_struct(stats)
    attached = df.withColumn("_stat", one)
    return attached.select(*df.columns, *[F.col("_stat")[c].alias(prefix + c) for c in stats.columns])


def peak_usage(df: DataFrame, width: str = "1 minute") -> DataFrame:
    """Windows with more than 1.5 times the mean window count are peaks."""
    pair = df.groupBy(F.window(TS, width).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("processing_duration").alias("ms"),
        F.count("processing_duration").alias("timed"),
    )
    per = pair.groupBy("w").agg(
        F.sum("n").alias("documents_processed"),
        F.count("user_id").alias("active_users"),
        (F.sum("ms") / F.sum("timed")).alias("avg_processing_duration"),
    )
    per = per.select(F.col("w.end").alias("window_end"), *per.columns[1:])
    mean = per.select(F.avg("documents_processed")).scalar()
    level = F.when(F.col("documents_processed") > mean * PEAK_FACTOR, "Peak").otherwise("Normal")
    return per.withColumn("usage_level", level)


def duration_anomalies(df: DataFrame, scope: str = "trailing_hour") -> DataFrame:
    """Documents slower than mean + 2 sample deviations.

    The trailing hour of a row is everything from one hour before it up to its own instant.
    Sums over it are differences of running sums, so no window holds the rows of an hour.
    """
    cols = [F.col(TS), "document_id", "processing_duration", "document_type", "user_id"]
    rows = df.select(*cols).where(F.col("processing_duration") > 0)
    x = F.col("processing_duration")
    if scope == "global":
        limit = df.agg((F.avg(x) + ANOMALY_SIGMAS * F.stddev_samp(x)).alias("limit"))
        return rows.where(x > limit.scalar())

    # values around the global mean keep the sums small
    centre = df.select(F.avg(x)).scalar()
    limits = trailing_limits(instant_sums(df, centre), centre).withColumnRenamed("at", TS)
    return rows.join(limits, TS).where(x > F.col("limit")).select(*cols)


def instant_sums(df: DataFrame, centre: Column) -> DataFrame:
    """``at, n, s, q``: durations less ``centre`` of every instant, their number, sum and sum of squares."""
    centred = df.where(F.col("processing_duration").isNotNull()).select(
        F.col(TS).alias("at"), (F.col("processing_duration") - centre).alias("x")
    )
    return centred.groupBy("at").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))


def trailing_limits(per: DataFrame, centre: Column) -> DataFrame:
    """``at, limit``: mean + 2 sample deviations of the hour up to each instant of ``instant_sums``, where it has two values."""
    # each instant enters at its time and leaves just behind an hour later
    hour = F.expr("INTERVAL 1 HOUR")
    moves = F.array(
        F.struct(F.col("at").alias("t"), F.lit(0).alias("kind"), "n", "s", "q"),
        F.struct((F.col("at") + hour).alias("t"), F.lit(1).alias("kind"), (-F.col("n")).alias("n"), (-F.col("s")).alias("s"), (-F.col("q")).alias("q")),
    )
    running = prefix_sums(
        per.select(F.inline(moves)), [], ["t", "kind"],
        {"count": F.col("n"), "total": F.col("s"), "squares": F.col("q")},
    )
    n, total = F.col("count"), F.col("total")
    mean = F.try_divide(total, n)
    var = F.try_divide(F.col("squares") - total * mean, n - 1)
    return running.where("kind = 0 AND count > 1").select(
        F.col("t").alias("at"), (centre + mean + ANOMALY_SIGMAS * F.sqrt(F.greatest(var, F.lit(0.0)))).alias("limit")
    )


# --- configurable transforms ---

_NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def normalize(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "min_max",
    target_range: tuple[float, float] = (0.0, 1.0),
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Min-max scale numeric columns within groups; a constant group keeps its values."""
    if method != "min_max":
        return df
    cols = list(columns) if columns is not None else [
        n for n, t in df.dtypes if n not in group_by and t in _NUMERIC
    ]
    low, high = target_range
    stats = [F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(f"_s_{c}") for c in cols]

    def scaled(c: str) -> Column:
        a, b = F.col(f"_s_{c}.a"), F.col(f"_s_{c}.b")
        unit = (F.col(c) - a) / F.nullif(b - a, F.lit(0))
        return F.when(b != a, low + unit * (high - low)).otherwise(F.col(c)).alias(c)

    if group_by:
        # statistics per group combine on the map side; a hot group's rows are then split by
        # the adaptive skew join, which a window function could not do
        per = df.groupBy(*group_by).agg(*stats)
        renamed = per.withColumnsRenamed({g: f"_g_{g}" for g in group_by})
        cond = F.col(group_by[0]).eqNullSafe(F.col(f"_g_{group_by[0]}"))
        for g in group_by[1:]:
            cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        joined = df.join(renamed, cond)
    else:
        joined = df.withColumn("_one", scalar_struct(df.agg(*stats))).select("*", "_one.*")
    return joined.select(*[scaled(c) if c in cols else F.col(c) for c in df.columns])


def deduplicate(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order: Sequence[str] = (),
) -> DataFrame:
    """Keep the first, the last or no row of each duplicate set.

    An aggregate (combined on the map side) instead of ``row_number``, so a set with very
    many copies costs one buffered row per task.
    """
    subset = list(subset or df.columns)
    if keep not in ("first", "last", False, "none"):
        raise ValueError(f"unknown keep: {keep}")
    if not order and keep == "last":
        raise ValueError("keep='last' needs an order")
    if not order and keep == "first":
        return df.dropDuplicates(subset)
    row = F.struct(*df.columns)
    rank = F.struct(*(order or subset))
    best = (F.max_by if keep == "last" else F.min_by)(row, rank)
    out = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(subset)]).agg(
        best.alias("_row"), F.count(F.lit(1)).alias("_n")
    )
    if keep in (False, "none"):
        out = out.where("_n = 1")
    return out.select("_row.*")


def train_validation_split(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    train_share: float = 0.8,
    min_samples: int = 1,
) -> DataFrame:
    """First ``train_share`` of each group (in ``order``) is ``train``, the rest ``validation``.

    Groups under ``min_samples`` rows are marked ``insufficient``.
    """
    ranked = number_rows(df, keys, order, "_i")
    split = (
        F.when(F.col("_i_total") < min_samples, "insufficient")
        .when(F.col("_i") - 1 < F.col("_i_total") * F.lit(train_share), "train")
        .otherwise("validation")
    )
    return ranked.select(*df.columns, split.alias("split"))


def last_exchanges(df: DataFrame, n: int = 10, key: str = "conversation_id", order: str = "turn") -> DataFrame:
    """Latest ``n`` rows per conversation, numbered in time order (1 = oldest of them).

    The rank filter becomes a group limit before the shuffle: a task ships at most ``n``
    rows per conversation.
    """
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    kept = df.withColumn("_rn", newest).where(F.col("_rn") <= n)
    position = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return kept.withColumn("position", position).drop("_rn")


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    keep: float = 0.9,
    with_carry: bool = False,
) -> DataFrame:
    """Final value of ``avg = keep * avg + (1 - keep) * x`` per key, seeded by the first non-zero x.

    Unrolled into one weighted sum: x at distance ``d`` from the end weighs
    ``(1 - keep) * keep^d`` (the seed ``keep^d``), so the order-dependent fold becomes a
    distributed rank plus an ordinary aggregate.  ``carry`` is the sum without a seed: an older
    value ``a`` continues as ``a * keep^n + carry``.
    """
    rows = df.where(F.col(value).isNotNull())
    nonzero = F.when(F.col(value) != 0, 1).otherwise(0).cast("bigint")
    ranked = prefix_sums(
        rows.select(*keys, *order, value), keys, order, {"_i": F.lit(1).cast("bigint"), "_nz": nonzero}
    )
    decay = F.pow(F.lit(keep), F.col("_i_total") - F.col("_i"))
    seed = (F.col("_nz") == 1) & (F.col(value) != 0)
    step = decay * F.lit(1 - keep)
    out = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(value) * F.when(seed, decay).otherwise(step)).alias("ewma"),
        F.sum(F.col(value) * step).alias("carry"),
    )
    return out if with_carry else out.drop("carry")


def running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of all rows so far per key, for several columns."""
    measures: dict[str, Column] = {}
    for v in values:
        measures[f"_s_{v}"] = F.col(v)
        measures[f"_n_{v}"] = F.when(F.col(v).isNotNull(), 1).otherwise(0).cast("bigint")
    summed = prefix_sums(df, keys, order, measures)
    return summed.select(
        *df.columns,
        *[(F.col(f"_s_{v}") / F.nullif(F.col(f"_n_{v}"), F.lit(0))).alias(f"mean_{v}") for v in values],
    )
