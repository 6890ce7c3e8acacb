"""Grouped metrics, dashboards and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.columns import ago, as_bigint, instant, pct
from inkstream.functions.distributed import exact_quantiles
from inkstream.operators.relational import RANGES, time_range

# Fixed values of the reports.
MANUAL_COST, AUTOMATED_COST, MONTHS = 5.0, 0.5, 12
MANUAL_SCORE = 0.70
SLOW_SECONDS, WEAK_CONFIDENCE = 30, 0.8
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
CALL_PRICES = {"openai": 0.002, "form_recognizer": 0.01, "cognitive_search": 0.001}
AUTOMATION_GOAL = 90.0
HOSTING_HOURS = 2
#: model -> (training price per 1000 tokens, hosting price per hour)
TRAINING_PRICES = {"gpt-4o": (0.003, 3.0), "gpt-4o-mini": (0.0033, 1.7), "gpt-3.5-turbo": (0.008, 1.0)}


def _n() -> Column:
    return F.count(F.lit(1))


def aggregate(df: DataFrame, group_by: Sequence[str], aggregations: Mapping[str, str]) -> DataFrame:
    """Group-by from configuration; keys and aggregates are SQL expressions.

    ``STDEV`` means the sample deviation; without keys the result is one row.
    """
    keys = [F.expr(k) for k in group_by]
    aggs = [F.expr(_spark_sql(text)).alias(name) for name, text in aggregations.items()]
    return df.groupBy(*keys).agg(*aggs)


def _spark_sql(text: str) -> str:
    head, sep, rest = text.partition("(")
    return f"stddev_samp({rest}" if sep and head.strip().upper() == "STDEV" else text


def document_aggregates(df: DataFrame) -> DataFrame:
    return aggregate(
        df,
        ["user_id", "file_category", "size_category"],
        {
            "total_documents": "COUNT(*)",
            "total_size": "SUM(file_size)",
            "avg_size": "AVG(file_size)",
            "latest_upload": "MAX(created_at)",
        },
    )


def metric_aggregates(df: DataFrame) -> DataFrame:
    return aggregate(
        df,
        ["metric_name", "to_date(metric_timestamp) AS metric_date"],
        {
            "avg_value": "AVG(metric_value)",
            "min_value": "MIN(metric_value)",
            "max_value": "MAX(metric_value)",
            "count": "COUNT(*)",
            "std_value": "STDEV(metric_value)",
        },
    )


def analytics_rollup(df: DataFrame) -> DataFrame:
    """Cells (type, sentiment, language), totals per dimension and the grand total.

    The raw rows are aggregated once; the grouping sets run over the few cells.
    """
    dims = ["document_type", "sentiment", "detected_language"]
    cells = df.groupBy(*dims).agg(
        _n().alias("document_count"),
        F.avg("processing_duration").alias("d"),
        F.avg("confidence").alias("c"),
    )
    n = F.col("document_count")
    sets = [[F.col(c) for c in dims], *[[F.col(c)] for c in dims], []]
    rolled = cells.groupingSets(sets, *dims).agg(
        F.grouping_id().alias("g"),
        F.sum(n).alias("document_count"),
        (F.sum(F.col("d") * n) / F.sum(n)).alias("avg_processing_duration"),
        (F.sum(F.col("c") * n) / F.sum(n)).alias("avg_confidence"),
    )
    level = (
        F.when(F.col("g") == 0, "cell")
        .when(F.col("g") == 3, "document_type")
        .when(F.col("g") == 5, "sentiment")
        .when(F.col("g") == 6, "detected_language")
        .otherwise("total")
    )
    return rolled.select(level.alias("level"), *dims, *rolled.columns[4:])


def realtime_summary(df: DataFrame, label: str, as_of=None, ts: str = "event_time") -> DataFrame:
    minutes = {"1h": 60, "24h": 1440, "7d": 10080, "30d": 43200}.get(label, 60)
    return time_range(df, ts, label, as_of).agg(
        _n().alias("total_documents"),
        (_n() / F.lit(float(minutes))).alias("processing_rate"),
        F.coalesce(pct(F.count_if("success"), _n()), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg("processing_duration"), F.lit(0.0)).alias("avg_processing_time"),
    )


def type_distribution(df: DataFrame, key: str = "document_type", top: int | None = None) -> DataFrame:
    """Rows and share per type, most frequent first."""
    counts = df.groupBy(key).agg(_n().alias("count"))
    total = counts.select(F.sum("count")).scalar()
    out = counts.withColumn("percentage", pct(F.col("count"), total))
    return out.orderBy(F.desc("count"), key).limit(top) if top else out


def performance_percentiles(df: DataFrame, label: str, as_of=None, ts: str = "event_time") -> DataFrame:
    """Averages, interpolated p95 / p99, documents per hour and error rate of a range."""
    hours = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}.get(label, 1)
    rows = time_range(df, ts, label, as_of)
    base = rows.agg(
        F.avg("processing_duration").alias("avg_processing_time"),
        F.avg("confidence").alias("avg_confidence"),
        (_n() / F.lit(float(hours))).alias("throughput_per_hour"),
        pct(F.count_if(~F.col("success")), _n()).alias("error_rate"),
    )
    probs = {"p95_processing_time": 0.95, "p99_processing_time": 0.99}
    tail = exact_quantiles(rows, [], "processing_duration", probs)
    one = tail.select(F.struct("*")).scalar()
    return base.withColumn("_q", one).select(*base.columns, *[F.col("_q")[p].alias(p) for p in probs])


def index_percentiles(
    df: DataFrame, value: str, probs: Mapping[str, float], group_by: Sequence[str] = ()
) -> DataFrame:
    """Element at zero-based index ``int(n * p)`` of the sorted values, capped at the last."""
    return exact_quantiles(df, group_by, value, probs, method="index")


def type_performance(df: DataFrame, as_of=None, ts: str = "event_time") -> DataFrame:
    """Per type over the trailing hour: counts, time and confidence."""
    recent = df.where((F.col(ts) >= ago(instant(as_of), "1 HOUR")) & F.col("document_type").isNotNull())
    return recent.groupBy("document_type").agg(
        _n().alias("count"),
        as_bigint(F.count_if("success")).alias("success_count"),
        F.coalesce(F.sum("processing_duration"), F.lit(0.0)).alias("total_processing_time"),
        pct(F.count_if("success"), _n()).alias("success_rate"),
        (F.coalesce(F.sum("processing_duration"), F.lit(0.0)) / _n()).alias("avg_processing_time"),
        (F.coalesce(F.sum("confidence"), F.lit(0.0)) / _n()).alias("avg_confidence"),
    )


def bi_insights(df: DataFrame) -> DataFrame:
    """Insights and recommendations as rows; duration is in seconds here."""
    types = df.where("document_type IS NOT NULL").groupBy("document_type").agg(_n().alias("n"))
    common = types.select(F.min_by("document_type", F.struct(-F.col("n"), F.col("document_type")))).scalar()
    stats = df.agg(F.avg("processing_duration").alias("s"), F.avg("confidence").alias("c"))
    s, c, top = F.col("s"), F.col("c"), F.col("top")

    def row(when: Column, kind: str, name: str, title: str, value: Column, text: Column, priority: str | None):
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(name).alias("name"),
                F.lit(title).alias("title"),
                value.alias("value"),
                text.alias("description"),
                F.lit(priority).cast("string").alias("priority"),
            ),
        )

    none = F.lit(None).cast("string")
    sec, conf = F.format_string("%.2f", s), F.format_string("%.3f", c)
    # Texts are fixed values of the report.
    rows = F.array(
        row(top.isNotNull(), "insight", "document_type_trend", "Most Processed Document Type", top,
            F.concat(F.lit("Most documents processed are of type: "), top), None),
        row(s.isNotNull(), "insight", "processing_efficiency", "Average Processing Time",
            F.concat(sec, F.lit(" seconds")),
            F.concat(F.lit("Documents are processed in "), sec, F.lit(" seconds on average")), None),
        row(c.isNotNull(), "insight", "confidence_trend", "Average Confidence Score", conf,
            F.concat(F.lit("AI models achieve "), conf, F.lit(" confidence on average")), None),
        row(s > SLOW_SECONDS, "recommendation", "performance", "Optimize Processing Pipeline", none,
            F.lit("Consider optimizing the processing pipeline as average processing time is high"), "medium"),
        row(c < WEAK_CONFIDENCE, "recommendation", "accuracy", "Improve AI Model Accuracy", none,
            F.lit("Consider retraining AI models as confidence scores are below optimal levels"), "high"),
    )
    return stats.withColumn("top", common).select(F.inline(F.array_compact(rows)))


def automation_metrics(
    scores: DataFrame, label: str | None = None, as_of=None, group_by: Sequence[str] = ()
) -> DataFrame:
    """Automation rate, review and manual counts, averages; optionally per day, vendor or model."""
    rows = time_range(scores, "created_at", label, as_of, default="24h") if label else scores
    auto, zero = F.count_if(~F.col("requires_review")), F.lit(0.0)
    return rows.groupBy(*[F.expr(g) for g in group_by]).agg(
        F.coalesce(pct(auto, _n()), zero).alias("automation_rate"),
        _n().alias("total_processed"),
        as_bigint(auto).alias("fully_automated"),
        as_bigint(F.count_if("requires_review")).alias("requires_review"),
        as_bigint(F.count_if(F.col("automation_score") < MANUAL_SCORE)).alias("manual_intervention"),
        F.coalesce(F.avg("confidence_score"), zero).alias("average_confidence"),
        F.coalesce(F.avg("completeness_score"), zero).alias("average_completeness"),
        F.coalesce(pct(F.count_if("validation_pass"), _n()), zero).alias("validation_pass_rate"),
    )


def automation_trend(
    scores: DataFrame, days: int | str = 30, as_of=None, rounded: bool = True
) -> DataFrame:
    """Daily automation figures; ``days`` is a number or day / week / month / year.

    ``rounded`` gives the report's two and three decimals, else full precision.
    """
    width = PERIOD_DAYS.get(days, 7) if isinstance(days, str) else int(days)
    rows = scores.where(F.col("created_at") >= ago(instant(as_of), f"{width} DAY"))
    auto = F.count_if(~F.col("requires_review"))

    def shown(col: Column, digits: int) -> Column:
        return F.round(col, digits) if rounded else col

    return rows.groupBy(F.to_date("created_at").alias("date")).agg(
        shown(pct(auto, _n()), 2).alias("automation_rate"),
        _n().alias("total_processed"),
        as_bigint(auto).alias("automated_count"),
        shown(F.avg("automation_score"), 3).alias("average_score"),
        shown(F.avg("confidence_score"), 3).alias("average_confidence"),
        shown(F.avg("completeness_score"), 3).alias("average_completeness"),
    )


def automation_trend_summary(trend: DataFrame) -> DataFrame:
    """First to last day: improvement and its direction (a point either way is stable)."""
    change = F.max_by("automation_rate", "date") - F.min_by("automation_rate", "date")
    out = trend.agg(F.round(F.coalesce(change, F.lit(0.0)), 2).alias("improvement"))
    gain = F.col("improvement")
    return out.withColumn("direction", F.when(gain > 1, "improving").when(gain < -1, "declining").otherwise("stable"))


def cost_savings(metrics: DataFrame) -> DataFrame:
    """Costs per row of :func:`automation_metrics` against an all-manual process."""
    n, rate = F.col("total_processed"), F.col("automation_rate")
    auto = F.floor(n * (rate / 100))
    out = metrics.select(
        n.alias("documents_processed"),
        "automation_rate",
        auto.alias("manual_processing_avoided"),
        (auto * F.lit(AUTOMATED_COST)).alias("automated_cost"),
        ((n - auto) * F.lit(MANUAL_COST)).alias("manual_cost"),
    )
    total = F.col("automated_cost") + F.col("manual_cost")
    n = F.col("documents_processed")
    savings = n * F.lit(MANUAL_COST) - total
    return out.select(
        "*",
        total.alias("total_cost"),
        F.round(savings, 2).alias("total_savings"),
        F.round(savings * MONTHS, 2).alias("annual_projection"),
        F.round(F.coalesce(F.try_divide(total, n), F.lit(0.0)), 2).alias("cost_per_document"),
    )


def gateway_summary(docs: DataFrame, invoices: DataFrame, as_of=None) -> DataFrame:
    today = F.to_date("created_at") == F.to_date(instant(as_of))
    left = docs.agg(
        _n().alias("total_documents"),
        as_bigint(F.count_if(F.col("status") == "processed")).alias("processed_count"),
        as_bigint(F.count_if(F.col("status") == "processing")).alias("processing_count"),
        as_bigint(F.count_if(today)).alias("uploaded_today"),
        F.avg("confidence_score").alias("avg_confidence"),
    )
    right = invoices.agg(
        F.sum("total_amount").alias("total_invoice_amount"),
        F.avg("total_amount").alias("avg_invoice_amount"),
        _n().alias("invoice_count"),
    )
    one = right.select(F.struct("*")).scalar()
    return left.withColumn("_r", one).select(*left.columns, "_r.*")


def dashboard_stats(docs: DataFrame, user: object = None, as_of=None) -> DataFrame:
    """Status counts; one row for ``user``, or one row per user without it."""
    aggs = [
        as_bigint(F.count_if(F.col("created_at") > ago(instant(as_of), "1 DAY"))).alias("documents_today"),
        *[
            as_bigint(F.count_if(F.col("status") == s)).alias(f"{s}_count")
            for s in ("processing", "completed", "failed")
        ],
        F.avg("processing_time").alias("avg_processing_time"),
    ]
    if user is not None:
        return docs.where(F.col("user_id") == user).agg(*aggs)
    return docs.groupBy("user_id").agg(*aggs)


def execution_dashboard(runs: DataFrame, as_of=None) -> DataFrame:
    """Pipeline runs ``(execution_id, status, start_time, end_time)`` as one summary row."""

    def has(s: str) -> Column:
        return as_bigint(F.count_if(F.col("status") == s))

    seconds = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / F.lit(1e6)
    return runs.agg(
        _n().alias("total_executions"),
        has("running").alias("running_executions"),
        has("completed").alias("completed_executions"),
        has("failed").alias("failed_executions"),
        F.round(F.coalesce(pct(has("completed"), _n()), F.lit(0.0)), 2).alias("success_rate"),
        F.round(F.coalesce(F.avg(F.when(F.col("status") == "completed", seconds)), F.lit(0.0)), 2).alias(
            "avg_processing_time_seconds"
        ),
        as_bigint(F.count_if(F.col("start_time") >= ago(instant(as_of), "1 DAY"))).alias("last_24h_executions"),
        F.max("start_time").alias("last_execution"),
    )


def execution_health(runs: DataFrame, as_of=None) -> DataFrame:
    """Stuck runs, last-hour failure rate, status and advice.

    The ids of stuck runs stay a table (:func:`stuck_executions`); the report has their number.
    """
    now = instant(as_of)
    recent = F.col("start_time") >= ago(now, "1 HOUR")
    stuck = (F.col("status") == "running") & (F.col("start_time") < ago(now, "1 HOUR"))
    base = runs.agg(
        as_bigint(F.count_if(stuck)).alias("stuck_executions"),
        F.coalesce(
            pct(F.count_if(recent & (F.col("status") == "failed")), F.count_if(recent)), F.lit(0.0)
        ).alias("rate"),
    )
    n, rate = F.col("stuck_executions"), F.col("rate")
    advice = F.array_compact(
        F.array(
            F.when(n > 0, F.concat(F.lit("Investigate "), n.cast("string"), F.lit(" stuck executions"))),
            F.when(rate > 50, "High failure rate detected - check pipeline configurations").when(
                rate > 20, "Moderate failure rate - monitor pipeline executions"
            ),
        )
    )
    healthy = F.array(F.lit("System is healthy - no issues detected"))
    return base.select(
        F.when(rate > 50, "critical").when(n > 0, "warning").otherwise("healthy").alias("status"),
        n,
        F.round(rate, 2).alias("recent_failure_rate"),
        F.when(F.size(advice) > 0, advice).otherwise(healthy).alias("recommendations"),
    )


def stuck_executions(runs: DataFrame, as_of=None) -> DataFrame:
    old = F.col("start_time") < ago(instant(as_of), "1 HOUR")
    return runs.where((F.col("status") == "running") & old).select("execution_id", "start_time")


def request_metrics(log: DataFrame, uptime_seconds: float) -> DataFrame:
    """Requests, errors (status from 400), rate, mean and index percentiles in milliseconds."""
    n = _n()
    bad = F.count_if(F.col("status") >= 400)
    base = log.agg(
        n.alias("total_requests"),
        as_bigint(bad).alias("total_errors"),
        F.round(bad / F.greatest(n, F.lit(1)), 4).alias("error_rate"),
        F.round(n / F.lit(float(uptime_seconds)), 2).alias("requests_per_second"),
        F.round(F.coalesce(F.sum("latency"), F.lit(0.0)) / F.greatest(n, F.lit(1)) * 1000, 2).alias("avg_ms"),
    )
    probs = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
    tail = exact_quantiles(log, [], "latency", probs, method="index")
    one = tail.select(F.struct(*[F.round(F.col(p) * 1000, 2).alias(p) for p in probs])).scalar()
    return base.withColumn("_q", one).select(
        *base.columns, *[F.coalesce(F.col("_q")[p], F.lit(0.0)).alias(p) for p in probs]
    )


def top_endpoints(log: DataFrame, n: int = 10) -> DataFrame:
    count = _n()
    per = log.groupBy(F.concat_ws(":", "method", "path").alias("endpoint")).agg(
        count.alias("count"),
        F.round(F.sum("latency") / count * 1000, 2).alias("avg_latency_ms"),
        F.round(F.count_if(F.col("status") >= 400) / count, 4).alias("error_rate"),
    )
    return per.orderBy(F.desc("count"), "endpoint").limit(n)


def api_cost(calls: DataFrame) -> DataFrame:
    """Calls and estimated cost per service plus a total row (NULL service)."""
    price = F.lit(0.0)
    for service, unit in CALL_PRICES.items():
        price = F.when(F.col("service") == service, F.lit(unit)).otherwise(price)
    per = calls.groupBy("service").agg(_n().alias("calls"))
    priced = per.withColumn("cost", F.col("calls") * price)
    return priced.groupingSets([[F.col("service")], []], "service").agg(
        F.sum("calls").alias("calls"), F.round(F.sum("cost"), 2).alias("estimated_cost")
    )


def catalog_overview(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by type, by owner and in total, with the number of edges and mean quality."""
    cells = assets.groupBy("asset_type", "owner").agg(
        _n().alias("n"), F.sum("quality_score").alias("q"), F.count("quality_score").alias("qn")
    )
    g = F.grouping_id()
    rolled = cells.groupingSets([[F.col("asset_type")], [F.col("owner")], []], "asset_type", "owner").agg(
        g.alias("g"), F.sum("n").alias("count"), F.round(F.sum("q") / F.sum("qn"), 3).alias("avg_quality_score")
    )
    level = F.when(F.col("g") == 1, "asset_type").when(F.col("g") == 2, "owner").otherwise("total")
    n_edges = edges.select(F.count(F.lit(1))).scalar()
    return rolled.select(
        level.alias("level"),
        F.coalesce("asset_type", "owner").alias("value"),
        "count",
        F.when(level == "total", n_edges).alias("relationships"),
        F.when(level == "total", F.col("avg_quality_score")).alias("avg_quality_score"),
    )


def recent_assets(assets: DataFrame, n: int = 5) -> DataFrame:
    cols = ["asset_id", "name", "asset_type", "updated_at"]
    return assets.select(*cols).orderBy(F.desc("updated_at"), "asset_id").limit(n)


def workflow_statistics(workflows: DataFrame) -> DataFrame:
    """Counts by status and mean accuracy from the JSON ``metrics`` of completed workflows."""
    done = F.col("status") == "completed"
    accuracy = F.get_json_object("metrics", "$.current_accuracy").try_cast("double")
    return workflows.agg(
        _n().alias("total_workflows"),
        as_bigint(F.count_if(done)).alias("completed_workflows"),
        as_bigint(F.count_if(F.col("status") == "failed")).alias("failed_workflows"),
        F.coalesce(F.try_divide(F.count_if(done), _n()), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(done, accuracy)), F.lit(0.0)).alias("average_accuracy"),
    )


def model_trends(metrics: DataFrame, label: str = "7d", as_of=None) -> DataFrame:
    """Model metrics per date and model within a range."""
    label = label if label in ("24h", "7d", "30d") else "7d"
    rows = metrics.where(F.col("timestamp") >= ago(instant(as_of), RANGES[label]))
    return rows.groupBy(F.to_date("timestamp").alias("date"), "model_name").agg(
        F.avg("automation_rate").alias("avg_automation_rate"),
        F.avg("accuracy").alias("avg_accuracy"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("completeness").alias("avg_completeness"),
        F.avg("processing_speed").alias("avg_processing_speed"),
        F.sum("documents_processed").alias("total_documents"),
    )


def model_dashboard(trends: DataFrame) -> DataFrame:
    """Latest-date rate, progress to the goal, documents and active models."""
    last = trends.select(F.max("date")).scalar()
    current = F.round(F.avg(F.when(F.col("date") == last, F.col("avg_automation_rate"))), 2)
    return trends.agg(
        F.coalesce(current, F.lit(0.0)).alias("current_automation_rate"),
        F.least(F.coalesce(current, F.lit(0.0)) / AUTOMATION_GOAL * 100, F.lit(100.0)).alias("goal_progress"),
        F.coalesce(F.sum("total_documents"), F.lit(0)).alias("total_documents_processed"),
        F.count_distinct("model_name").alias("active_models"),
    )


def training_cost(jobs: DataFrame, prices: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """Mean hours of succeeded jobs and the cost of all jobs with training tokens."""
    prices = TRAINING_PRICES if prices is None else prices
    per_token, hosting = F.lit(0.0), F.lit(0.0)
    for model, (token_price, hour_price) in prices.items():
        hit = F.col("model_name") == model
        per_token = F.when(hit, F.lit(token_price)).otherwise(per_token)
        hosting = F.when(hit, F.lit(hour_price)).otherwise(hosting)
    cost = F.col("training_tokens") / 1000 * per_token + hosting * HOSTING_HOURS
    billed = F.coalesce("training_tokens", F.lit(0)) != 0
    hours = F.timestamp_diff("SECOND", F.col("created_at"), F.col("finished_at")) / 3600
    return jobs.agg(
        F.coalesce(F.avg(F.when(F.col("status") == "succeeded", hours)), F.lit(0.0)).alias("avg_training_hours"),
        F.coalesce(F.sum(F.when(billed, cost)), F.lit(0.0)).alias("total_cost"),
    )


def routing_statistics(routed: DataFrame) -> DataFrame:
    """Documents per processing mode and the share that fell back."""
    n = _n()

    def mode(m: str) -> Column:
        return F.count_if(F.col("processing_mode") == m)

    modes = ("traditional", "multi_agent", "mcp")
    return routed.agg(
        *[as_bigint(mode(m)).alias(f"{m}_count") for m in modes],
        as_bigint(F.count_if("fallback_used")).alias("fallback_count"),
        n.alias("total_processed"),
        *[F.coalesce(pct(mode(m), n), F.lit(0.0)).alias(f"{m}_percentage") for m in modes],
        F.coalesce(pct(F.count_if("fallback_used"), n), F.lit(0.0)).alias("fallback_rate"),
    )


def entity_statistics(entities: DataFrame) -> DataFrame:
    """Per entity type and in total (NULL type): count, mean confidence, confidence bands."""
    c = F.col("entity_confidence")
    cells = entities.groupBy("entity_type").agg(
        _n().alias("n"),
        F.sum(c).alias("s"),
        F.count(c).alias("sn"),
        F.count_if(c >= 0.9).alias("hi"),
        F.count_if((c >= 0.7) & (c < 0.9)).alias("mid"),
        F.count_if(c < 0.7).alias("lo"),
    )
    return cells.groupingSets([[F.col("entity_type")], []], "entity_type").agg(
        F.sum("n").alias("total_entities"),
        (F.sum("s") / F.sum("sn")).alias("average_confidence"),
        F.sum("hi").alias("high_confidence"),
        F.sum("mid").alias("medium_confidence"),
        F.sum("lo").alias("low_confidence"),
    )


def conversation_summary(
    messages: DataFrame, key: str = "conversation_id", order: str = "timestamp", text: str = "message"
) -> DataFrame:
    """Message count, last message time and a title (first message, 50 characters)."""
    return messages.groupBy(key).agg(
        _n().alias("message_count"),
        F.max(order).alias("last_message_at"),
        F.min_by(F.substring(text, 1, 50), order).alias("title"),
    )

