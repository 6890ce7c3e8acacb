"""Data-quality rules, dimension scores, profiling and alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StringType, StructType

from inkstream.functions.columns import ago, as_bigint, instant, pct, strip
from inkstream.functions.distributed import cut_lineage, quantiles_of_counts

# Fixed values of the validator.
DOCUMENT_FIELDS = ("document_id", "user_id", "file_name", "file_size", "content_type")
METRIC_FIELDS = ("metric_name", "metric_value", "metric_timestamp")
VALID_TYPES = ("application/pdf", "image/jpeg", "image/png", "text/plain", "application/msword")
ACCURATE_TYPES = ("application/pdf", "image/jpeg", "image/png", "text/plain")
MAX_DOCUMENT_BYTES = 100 * 1024 * 1024
LEVELS = (("excellent", 0.95), ("good", 0.80), ("fair", 0.60), ("poor", 0.40))
DATE_COLUMNS = ("created_at", "updated_at", "timestamp")
FRESHNESS_COLUMNS = ("created_at", "updated_at", "timestamp", "metric_timestamp")
NUMBER_COLUMNS = ("file_size",)
DIMENSIONS = ("completeness", "accuracy", "consistency", "validity", "timeliness", "uniqueness")
ALERT_THRESHOLD, CRITICAL_VALUE, TREND_FLOOR = 0.8, 0.60, 0.90
UPLOAD_EXTENSIONS = (".pdf", ".docx", ".doc", ".txt", ".jpg", ".jpeg", ".png", ".tiff")
UPLOAD_BYTES, UPLOAD_BATCH = 50 * 1024 * 1024, 15


def _result(
    cond: Column, name: str, rule: str, passed: bool, message: Column | str, severity: str = "error"
) -> Column:
    """A result struct where ``cond`` holds, else NULL."""
    return F.when(
        cond,
        F.struct(
            F.lit(name).alias("field_name"),
            F.lit(rule).alias("rule_type"),
            F.lit(passed).alias("passed"),
            (message if isinstance(message, Column) else F.lit(message)).alias("message"),
            F.lit(severity).alias("severity"),
        ),
    )


def _explode(df: DataFrame, key: Sequence[str], results: Iterable[Column]) -> DataFrame:
    return df.select(*key, F.inline(F.array_compact(F.array(*results))))


def _required(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Failures only; a column the table does not have is missing in every row."""
    return [
        _result(
            F.col(n).isNull() if n in df.columns else F.lit(True), n, "required", False,
            f"Required field {n} is missing",
        )
        for n in names
    ]


def validate_documents(df: DataFrame, key: str = "document_id") -> DataFrame:
    """Long-form rule results.  Required and format rules emit failures only."""
    rules = _required(df, DOCUMENT_FIELDS)
    if "file_size" in df.columns:
        size = F.col("file_size").try_cast("bigint")
        rules += [
            _result(size.isNotNull(), "file_size", "data_type", True, "File size is valid integer"),
            _result(size.isNull(), "file_size", "data_type", False, "File size must be a valid integer"),
            _result(size <= 0, "file_size", "range", False, "File size must be greater than 0"),
            _result(size > MAX_DOCUMENT_BYTES, "file_size", "range", False, "File size exceeds 100MB limit", "warning"),
            _result(
                (size > 0) & (size <= MAX_DOCUMENT_BYTES), "file_size", "range", True,
                "File size is within acceptable range",
            ),
        ]
    if "content_type" in df.columns:
        kind = F.coalesce("content_type", F.lit("None"))
        rules.append(
            _result(
                ~kind.isin(*VALID_TYPES), "content_type", "format", False,
                F.concat(F.lit("Invalid content type: "), kind), "warning",
            )
        )
    return _explode(df, [key], rules)


def validate_metrics(df: DataFrame, key: str = "id") -> DataFrame:
    rules = _required(df, METRIC_FIELDS)
    if "metric_value" in df.columns:
        value = F.col("metric_value").try_cast("double")
        inside = value.between(0, 1)
        rules += [
            _result(value.isNotNull() & ~inside, "metric_value", "range", False,
                    "Metric value should be between 0 and 1", "warning"),
            _result(inside, "metric_value", "range", True, "Metric value is within valid range"),
            _result(value.isNull(), "metric_value", "data_type", False, "Metric value must be a valid number"),
        ]
    return _explode(df, [key], rules)


def validation_summary(results: DataFrame, keys: Sequence[str] = ("document_id",)) -> DataFrame:
    """Per record (or for all results without keys): totals and critical failures."""
    failed = ~F.col("passed")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_validations"),
        as_bigint(F.count_if("passed")).alias("passed"),
        as_bigint(F.count_if(failed)).alias("failed"),
        as_bigint(F.count_if(failed & (F.col("severity") == "error"))).alias("critical_errors"),
    )


# --- rule registry ---


@dataclass
class RuleSet:
    """Validation rules of one table, evaluated together.

    Rule types: ``required``, ``data_type`` (config ``type``), ``format`` (``values``), ``range``
    (``min``/``max``), ``pattern`` (``regex``), ``unique``, ``referential`` (``table``, ``column``)
    and ``business_logic`` (``expression``, true when the row is right).
    """

    key: Sequence[str]
    rules: list[tuple[str, str, Mapping[str, object], str]] = field(default_factory=list)

    def register(
        self, name: str, rule: str, config: Mapping[str, object] | None = None, severity: str = "error"
    ) -> RuleSet:
        if rule not in (*_ROW_RULES, "unique", "referential"):
            raise ValueError(f"unknown rule type: {rule}")
        self.rules.append((name, rule, config or {}, severity))
        return self

    def apply(self, df: DataFrame, refs: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """One row per failed rule and record.

        Row rules share one pass.  Uniqueness and references need a shuffle each; both count
        or deduplicate on the map side before it.
        """
        row = [
            _result(~F.coalesce(_ROW_RULES[rule](name, cfg), F.lit(False)), name, rule, False, f"{rule} rule failed for {name}", sev)
            for name, rule, cfg, sev in self.rules
            if rule in _ROW_RULES
        ]
        parts = [_explode(df, self.key, row)] if row else []
        for name, rule, cfg, sev in self.rules:
            if rule == "unique":
                repeated = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
                bad = df.join(repeated.where("_n > 1").select(name), name, "left_semi")
            elif rule == "referential":
                known = (refs or {})[str(cfg["table"])].select(F.col(str(cfg["column"])).alias(name)).distinct()
                bad = df.where(F.col(name).isNotNull()).join(known, name, "left_anti")
            else:
                continue
            parts.append(_explode(bad, self.key, [_result(F.lit(True), name, rule, False, f"{rule} rule failed for {name}", sev)]))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def _in_range(name: str, cfg: Mapping[str, object]) -> Column:
    ok, col = F.lit(True), F.col(name)
    if cfg.get("min") is not None:
        ok = ok & (col >= cfg["min"])
    if cfg.get("max") is not None:
        ok = ok & (col <= cfg["max"])
    return col.isNull() | ok


_ROW_RULES = {
    "required": lambda n, c: F.col(n).isNotNull(),
    "data_type": lambda n, c: F.col(n).isNull() | F.col(n).try_cast(str(c["type"])).isNotNull(),
    "format": lambda n, c: F.col(n).isNull() | F.col(n).isin(*c["values"]),
    "range": _in_range,
    "pattern": lambda n, c: F.col(n).isNull() | F.col(n).rlike(str(c["regex"])),
    "business_logic": lambda n, c: F.expr(str(c["expression"])),
}


# --- dimension scores ---


def _mean(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out / len(parts)


def _share(cond: Column) -> Column:
    return F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0))


def _parsed(df: DataFrame, name: str) -> Column:
    col = F.col(name)
    if isinstance(df.schema[name].dataType, StringType):
        return F.try_to_timestamp(col) if name in DATE_COLUMNS else col.try_cast("double")
    return col


def _filled(name: str) -> Column:
    return F.length(F.col(name).cast("string")) > 0


def _typed(name: str) -> bool:
    return name in DATE_COLUMNS or name in NUMBER_COLUMNS


def completeness_expr(df: DataFrame) -> Column:
    return _mean([F.count(c) for c in df.columns]) / F.count(F.lit(1))


def validity_expr(df: DataFrame) -> Column:
    """Typed columns score 1 when every non-NULL value parses, else 0; others the share filled."""
    parts = []
    for name in df.columns:
        if _typed(name):
            broken = F.count_if(F.col(name).isNotNull() & _parsed(df, name).isNull())
            parts.append(F.when(broken == 0, 1.0).otherwise(0.0))
        else:
            parts.append(_share(_filled(name)))
    return _mean(parts)


def consistency_expr(df: DataFrame) -> Column:
    """Mean share of values that parse (typed columns) or are filled."""
    return _mean([_share(_parsed(df, n).isNotNull() if _typed(n) else _filled(n)) for n in df.columns])


def timeliness_expr(df: DataFrame, as_of=None) -> Column:
    """1 for fresh rows falling to 0 at 24 hours; 0.5 without a time column."""
    name = next((c for c in FRESHNESS_COLUMNS if c in df.columns), None)
    if name is None:
        return F.lit(0.5)
    at = F.try_to_timestamp(name) if isinstance(df.schema[name].dataType, StringType) else F.col(name)
    hours = F.timestamp_diff("MICROSECOND", at, instant(as_of)) / F.lit(3.6e9)
    # rows without a time do not count (least and greatest would skip the NULL)
    fresh = F.when(hours.isNotNull(), F.greatest(F.least(1 - hours / 24, F.lit(1.0)), F.lit(0.0)))
    return F.coalesce(F.avg(fresh), F.lit(0.0))


def completeness(df: DataFrame) -> DataFrame:
    return df.agg(completeness_expr(df).alias("completeness"))


def validity(df: DataFrame) -> DataFrame:
    return df.agg(validity_expr(df).alias("validity"))


def consistency(df: DataFrame) -> DataFrame:
    return df.agg(consistency_expr(df).alias("consistency"))


def timeliness(df: DataFrame, as_of=None) -> DataFrame:
    return df.agg(timeliness_expr(df, as_of).alias("timeliness"))


def uniqueness(df: DataFrame) -> DataFrame:
    """Distinct rows / rows.  Copies collapse on the map side before the shuffle."""
    per = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg((F.count(F.lit(1)) / F.sum("_n")).alias("uniqueness"))


def accuracy(df: DataFrame, table: str) -> DataFrame:
    """Business-rule compliance of documents and metrics; 0.5 for other tables."""
    parts: list[Column] = []
    ids = None
    if table == "documents":
        if "file_size" in df.columns:
            parts.append(_share(F.col("file_size").try_cast("double") > 0))
        if "content_type" in df.columns:
            parts.append(_share(F.col("content_type").isin(*ACCURATE_TYPES)))
        if "document_id" in df.columns:
            ids = df.select(F.count_distinct("document_id")).scalar()
            parts.append(ids / F.count(F.lit(1)))
    elif table == "analytics_metrics":
        if "metric_value" in df.columns:
            parts.append(_share(F.col("metric_value").between(0, 1)))
        if "metric_name" in df.columns:
            parts.append(_share(F.length("metric_name") > 0))
    else:
        return df.agg(F.lit(0.5).alias("accuracy"))
    return df.agg((_mean(parts) if parts else F.lit(0.0)).alias("accuracy"))


def quality_level(score: Column) -> Column:
    out = None
    for name, limit in LEVELS:
        out = F.when(score >= limit, name) if out is None else out.when(score >= limit, name)
    return out.otherwise("critical")


def quality_metrics(df: DataFrame, table: str, as_of=None, rounded: bool = True) -> DataFrame:
    """The six dimensions, their mean and level over the whole table; empty means all zero."""
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        completeness_expr(df).alias("completeness"),
        consistency_expr(df).alias("consistency"),
        validity_expr(df).alias("validity"),
        timeliness_expr(df, as_of).alias("timeliness"),
    ).withColumns({"accuracy": accuracy(df, table).scalar(), "uniqueness": uniqueness(df).scalar()})
    score = {d: F.when(F.col("n") > 0, F.col(d)).otherwise(0.0) for d in DIMENSIONS}
    out = one.select(F.lit(table).alias("table_name"), *[score[d].alias(d) for d in DIMENSIONS])
    out = out.withColumn("overall_score", _mean([F.col(d) for d in DIMENSIONS]))
    out = out.withColumn("quality_level", quality_level(F.col("overall_score")))
    if rounded:
        out = out.withColumns({d: F.round(d, 3) for d in (*DIMENSIONS, "overall_score")})
    return out


def quality_recommendations(metrics: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """One message per weak dimension, one for critical errors, else praise."""
    # Texts are fixed values of the report.
    texts = {
        "completeness": "Improve data completeness by implementing required field validation",
        "accuracy": "Enhance data accuracy by implementing business rule validation",
        "consistency": "Improve data consistency by standardizing data formats",
        "validity": "Enhance data validity by implementing format validation",
        "timeliness": "Improve data timeliness by implementing real-time data processing",
        "uniqueness": "Enhance data uniqueness by implementing duplicate detection",
    }
    errors = F.lit(0)
    if results is not None:
        bad = results.where(~F.col("passed") & (F.col("severity") == "error"))
        errors = bad.select(F.count(F.lit(1))).scalar()
    found = F.array_compact(
        F.array(
            *[F.when(F.col(d) < ALERT_THRESHOLD, text) for d, text in texts.items()],
            F.when(
                F.col("_errors") > 0,
                F.concat(F.lit("Address "), F.col("_errors").cast("string"), F.lit(" critical validation errors")),
            ),
        )
    )
    praise = F.array(F.lit("Data quality is excellent - maintain current standards"))
    return metrics.withColumn("_errors", errors).select(
        "table_name", F.explode(F.when(F.size(found) > 0, found).otherwise(praise)).alias("recommendation")
    )


def quality_report(
    df: DataFrame, table: str, results: DataFrame, as_of=None, rounded: bool = True
) -> DataFrame:
    """Dimension scores, validation summary and recommendations of one table as one row."""
    metrics = quality_metrics(df, table, as_of, rounded)
    summary = validation_summary(results, ())
    advice = quality_recommendations(metrics, results).agg(
        F.array_sort(F.collect_list("recommendation")).alias("recommendations")
    )  # at most seven
    one = summary.select(F.struct("*")).scalar()
    return metrics.withColumn("_s", one).select(
        *metrics.columns, "_s.*", advice.scalar().alias("recommendations")
    )


def _failed_table(spark: SparkSession, table: str) -> DataFrame:
    """The row of a table that cannot be read: all scores zero, critical."""
    scores = [F.lit(0.0).alias(d) for d in (*DIMENSIONS, "overall_score")]
    return spark.range(1).select(F.lit(table).alias("table_name"), *scores, F.lit("critical").alias("quality_level"))


def quality_dashboard(
    tables: Mapping[str, DataFrame | Callable[[], DataFrame]], as_of=None, rounded: bool = True
) -> DataFrame:
    """One row of quality metrics per table.

    A table may be given as a function that reads it; one whose path, columns or types fail
    counts as zero and critical without failing the others.
    """
    out = None
    for name, table in tables.items():
        try:
            df = table() if callable(table) else table
            row = quality_metrics(df, name, as_of, rounded)
            _ = row.schema
        except AnalysisException:
            row = _failed_table(SparkSession.active(), name)
        out = row if out is None else out.unionByName(row)
    return out


def quality_alerts(metrics: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """One alert per table and dimension below ``threshold``; up to 0.60 it is critical."""
    pairs = F.array(*[F.struct(F.lit(d).alias("metric"), F.col(d).alias("value")) for d in DIMENSIONS])
    low = metrics.select("table_name", F.inline(pairs)).where(F.col("value") < threshold)
    return low.withColumns(
        {
            "threshold": F.lit(threshold),
            "severity": F.when(F.col("value") <= CRITICAL_VALUE, "critical").otherwise("warning"),
        }
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        as_bigint(F.count_if(F.col("severity") == "critical")).alias("critical_alerts"),
        as_bigint(F.count_if(F.col("severity") == "warning")).alias("warning_alerts"),
    )


# --- profiling ---


def value_counts(df: DataFrame) -> DataFrame:
    """``c, one, two, n, x, size, v``: how often each column, by its number, has each value.

    One scan and one exchange for all columns.  A value is known by 128 bits of hash (null: none), so what is shuffled is keyed by numbers however
    long texts are; with it goes its number or the text itself, once per task, for the statistics that need them.
    """
    cells = []
    for i, f in enumerate(df.schema.fields):
        col, is_text = F.col(f"`{f.name}`"), isinstance(f.dataType, StringType)
        plain = col.cast("string") if isinstance(f.dataType, (ArrayType, MapType, StructType)) else col  # maps have no hash
        cells.append(
            F.struct(
                F.lit(i).alias("c"),
                F.when(col.isNotNull(), F.xxhash64(plain)).alias("one"),
                F.when(col.isNotNull(), F.xxhash64(F.lit(i), plain)).alias("two"),
                (col if isinstance(f.dataType, NumericType) else F.lit(None)).cast("double").alias("x"),
                (col if is_text else F.lit(None)).cast("string").alias("v"),
            )
        )
    if not cells:
        raise ValueError("a table without columns")
    one = F.count(F.lit(1)).alias("n")
    size = F.first(F.length("v")).alias("size")
    return df.select(F.inline(F.array(*cells))).groupBy("c", "one", "two").agg(one, F.first("x").alias("x"), size, F.first("v").alias("v"))


def profile(df: DataFrame, rounded: bool = True) -> DataFrame:
    """One row per column: counts, number statistics or text statistics, all from :func:`value_counts`."""
    numeric = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, NumericType)]
    text = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, StringType)]
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def shown(col: Column) -> Column:
        return F.round(col, 2) if rounded else col

    counts = cut_lineage(value_counts(df))
    known, n, x = F.col("one").isNotNull(), F.col("n"), F.col("x")
    per = counts.groupBy("c").agg(
        F.sum(F.when(known, n).otherwise(0)).alias("non_null_count"),
        F.sum(F.when(known, 0).otherwise(n)).alias("null_count"),
        F.count("one").alias("unique_count"),
        (F.sum(n * x) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        (F.sum(n * F.col("size")) / F.sum(F.when(F.col("size").isNotNull(), n))).alias("avg_length"),
        F.min(F.when(F.col("v").isNotNull(), F.struct((-n).alias("less"), "v"))).alias("top"),
    )
    numbers = counts.where(x.isNotNull())
    spread_of = numbers.join(per.select("c", "mean"), "c").groupBy("c").agg(
        F.sqrt(F.try_divide(F.sum(n * F.pow(x - F.col("mean"), 2)), F.sum(n) - 1)).alias("std")
    )
    if numeric:
        medians = quantiles_of_counts(numbers, ["c"], "x", "n", {"median": 0.5})
    else:
        medians = per.select("c", null_d.alias("median"))
    columns = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "c int, column_name string, data_type string"
    )
    out = columns.join(per, "c", "left").join(spread_of, "c", "left").join(medians, "c", "left")
    is_text, zero = F.col("c").isin(*text) if text else F.lit(False), F.lit(0).cast("bigint")
    filled = {c: F.coalesce(c, zero) for c in ("non_null_count", "null_count", "unique_count")}
    rows = F.col("non_null_count") + F.col("null_count")
    return out.withColumns(filled).select(
        "column_name",
        "data_type",
        "non_null_count",
        "null_count",
        shown(pct(F.col("null_count"), rows)).alias("null_percentage"),
        "unique_count",
        shown(pct(F.col("unique_count"), rows)).alias("unique_percentage"),
        shown(F.col("mean")).alias("mean"),
        shown(F.col("median")).alias("median"),
        shown(F.col("std")).alias("std"),
        "min",
        "max",
        F.when(is_text, F.col("top.v")).otherwise(null_s).alias("most_common"),
        F.when(is_text, F.coalesce(-F.col("top.less"), zero)).alias("most_common_count"),
        shown(F.col("avg_length")).alias("avg_length"),
    )


# --- uploads and invoices ---


def upload_checks(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Accepted or rejected with the reason; a batch over 15 files is rejected as a whole."""
    # counted per batch and joined back: a batch may hold any number of files
    sizes = files.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    name, size, n = F.col("file_name"), F.col("file_size"), F.col("_n").cast("string")
    ext = F.concat(F.lit("."), F.lower(F.element_at(F.split("file_name", "[.]"), -1)))
    # Texts are fixed values of the service.
    reason = (
        F.when(
            F.col("_n") > UPLOAD_BATCH,
            F.concat(
                F.lit(f"Too many files. Maximum {UPLOAD_BATCH} files allowed per batch. You provided "), n,
                F.lit(" files."),
            ),
        )
        .when(F.coalesce(F.length(name), F.lit(0)) == 0, "No filename provided")
        .when(~ext.isin(*UPLOAD_EXTENSIONS), F.concat(F.lit("File type not supported: "), ext))
        .when(
            size > UPLOAD_BYTES,
            F.concat(F.lit("File too large: "), size.cast("string"), F.lit(f" bytes (max: {UPLOAD_BYTES})")),
        )
    )
    return files.join(sizes, batch).select(*files.columns, reason.isNull().alias("accepted"), reason.alias("reason"))


def invoice_rules(invoices: DataFrame, vendors: DataFrame, as_of=None, tolerance: float = 0.01) -> DataFrame:
    """Failures of the documented invoice rules, one row per invoice and rule."""
    now = instant(as_of)
    total = F.col("total_amount")
    lines = F.col("line_total") if "line_total" in invoices.columns else F.lit(None).cast("double")
    rules = RuleSet(["document_id"])
    for name in ("vendor_name", "invoice_number", "invoice_date", "total_amount"):
        rules.register(name, "required")
    rules.register("invoice_number", "unique")
    rules.register("vendor_name", "referential", {"table": "vendors", "column": "vendor_name"}, "warning")

    def failed(cond: Column, name: str, rule: str, text: str) -> Column:
        return _result(F.coalesce(cond, F.lit(False)), name, rule, False, text)

    checks = [
        failed(F.col("invoice_date") > now, "invoice_date", "range", "Invoice date is in the future"),
        failed(F.col("invoice_date") < ago(now, "5 YEAR"), "invoice_date", "range", "Invoice date is older than 5 years"),
        failed(total <= 0, "total_amount", "range", "Total amount must be positive"),
        failed(total >= 1_000_000, "total_amount", "range", "Total amount must be under 1,000,000"),
        failed(F.col("due_date") <= F.col("invoice_date"), "due_date", "business_logic", "Due date must be after invoice date"),
        failed(
            F.abs(F.col("subtotal") + F.col("tax_amount") - total) > tolerance, "total_amount", "business_logic",
            "Subtotal plus tax must equal total",
        ),
        failed(F.abs(lines - total) > tolerance, "line_items", "business_logic", "Line items must sum to total"),
    ]
    return rules.apply(invoices, {"vendors": vendors}).unionByName(_explode(invoices, ["document_id"], checks))


def _deletions(col: Column) -> Column:
    """The text itself and every text with one character removed."""
    one = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(col), F.lit(1))),
        lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col))),
    )
    return F.array_distinct(F.array_union(F.array(col), one))


def _variants(df: DataFrame, col: str, edits: int) -> DataFrame:
    out = df.withColumn("_variant", F.col(col))
    for _ in range(edits):
        out = out.withColumn("_variant", F.explode(_deletions(F.col("_variant")))).distinct()
    return out


def nearest_names(names: DataFrame, known: DataFrame, name: str, known_name: str, edits: int = 2) -> DataFrame:
    """Nearest known name within ``edits`` edits of each distinct name (ties: smallest).

    Two texts within k edits share a text reached from both by deleting at most k characters,
    so an equi-join on such variants finds every pair without comparing all pairs.  Only
    distinct names are expanded, however many rows carry them.
    """
    left = _variants(names.select(F.col(name).alias("raw")).where("raw IS NOT NULL").distinct(), "raw", edits)
    right = _variants(known.select(F.col(known_name).alias("known")).where("known IS NOT NULL").distinct(), "known", edits)
    pairs = left.join(right, "_variant").select("raw", "known").distinct()
    close = pairs.withColumn("distance", F.levenshtein("raw", "known")).where(F.col("distance") <= edits)
    best = F.min(F.struct("distance", "known")).alias("b")
    return close.groupBy("raw").agg(best).select("raw", F.col("b.known").alias("known"), F.col("b.distance").alias("distance"))


def standard_amount(text: Column) -> Column:
    """``1K`` -> 1000, ``2.5M`` -> 2500000, plain numbers as they are."""
    number = F.regexp_extract(text, r"^\s*\$?([0-9][0-9,]*\.?[0-9]*)\s*([KkMm]?)\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*\$?([0-9][0-9,]*\.?[0-9]*)\s*([KkMm]?)\s*$", 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)
    return F.regexp_replace(number, ",", "").try_cast("double") * scale


#: Date formats tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd/MM/yy", "dd.MM.yyyy", "yyyyMMdd")
_DATE_SHAPES = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}/\d{2}/\d{2}$", r"^\d{2}\.\d{2}\.\d{4}$", r"^\d{8}$")


def standard_date(text: Column) -> Column:
    out = None
    for fmt, shape in zip(DATE_FORMATS, _DATE_SHAPES):
        parsed = F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
        out = F.when(text.rlike(shape), parsed) if out is None else out.when(text.rlike(shape), parsed)
    return out


def standardize_invoice(invoices: DataFrame, vendors: DataFrame, edits: int = 2) -> DataFrame:
    """Amounts to numbers, dates to ISO, vendor names to the nearest known vendor."""
    near = nearest_names(invoices, vendors, "vendor_name", "vendor_name", edits)
    joined = invoices.join(near, invoices["vendor_name"] == near["raw"], "left")
    fixed = {
        "vendor_name": F.coalesce("known", "vendor_name"),
        "invoice_date": standard_date(strip(F.col("invoice_date"))),
        "total_amount": standard_amount(F.col("total_amount")),
    }
    return joined.select(
        *[fixed[c].alias(c) if c in fixed else F.col(c) for c in invoices.columns],
        (F.coalesce("distance", F.lit(0)) > 0).alias("vendor_corrected"),
    )


def quality_trend(history: DataFrame, score: str = "quality_score", ts: str = "created_at") -> DataFrame:
    """Mean score per day; days under 0.90 carry a warning."""
    days = history.groupBy(F.to_date(ts).alias("date")).agg(F.avg(score).alias("quality_score"))
    low = F.col("quality_score") < TREND_FLOOR
    return days.withColumn("alert", F.when(low, "Quality dropped below 0.90"))


def quality_trend_summary(trend: DataFrame) -> DataFrame:
    first, last = F.min_by("quality_score", "date"), F.max_by("quality_score", "date")
    return trend.agg(
        F.min("date").alias("period_start"),
        F.max("date").alias("period_end"),
        F.avg("quality_score").alias("average_quality"),
        (last - first).alias("quality_improvement"),
        F.count("alert").alias("alerts"),
    )
