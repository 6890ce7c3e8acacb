"""Invoice automation scores, complexity routing, keyword classification, model evaluation.

All per-document scores are column arithmetic: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.columns import as_bigint, pct, strip

# --- fixed values: fields, thresholds and goal of the automation score ---
REQUIRED_FIELDS = ("vendor_name", "invoice_number", "total_amount", "invoice_date", "line_items")
OPTIONAL_FIELDS = ("vendor_address", "customer_name", "customer_address", "due_date", "tax_amount", "subtotal")
REQUIRED_WEIGHT, OPTIONAL_WEIGHT, INVALID_FACTOR = 0.7, 0.3, 0.5
SCORE_THRESHOLD, CONFIDENCE_THRESHOLD, COMPLETENESS_THRESHOLD = 0.85, 0.90, 0.95
VALIDATION_THRESHOLD, MANUAL_THRESHOLD, GOAL = 0.85, 0.70, 0.90

# --- fixed values: routing ---
STANDARD_FIELDS = (
    "invoice_number", "invoice_date", "due_date", "vendor_name", "total_amount", "tax_amount", "subtotal",
)
KNOWN_VENDORS = ("amazon", "microsoft", "oracle", "salesforce", "adobe", "google", "ibm")
SIMPLE_LIMIT, MEDIUM_LIMIT, PART_LIMIT = 30, 60, 25

# --- fixed values: keyword lists of the heuristic document classifier ---
KEYWORDS = {
    "invoice": (
        "invoice", "bill to", "invoice number", "invoice date", "amount due", "total amount",
        "subtotal", "tax amount", "payment terms", "due date", "remittance", "vendor",
    ),
    "receipt": (
        "receipt", "thank you for your purchase", "cashier", "transaction", "payment method",
        "card ending", "merchant", "store #", "terminal", "cash",
    ),
    "business_card": (
        "tel:", "phone:", "mobile:", "email:", "fax:", "linkedin", "twitter", "website:", "www.",
        "ceo", "manager", "director", "president", "vp",
    ),
    "id_document": (
        "driver license", "driver's license", "passport", "identification", "id number",
        "date of birth", "dob", "nationality", "issued by", "expiration date", "expires",
    ),
    "tax_document": (
        "w-2", "w2", "form 1099", "1099", "tax year", "employer identification", "ein",
        "social security", "federal income", "state income", "irs",
    ),
}


def _present(df: DataFrame, name: str, blank_is_missing: bool) -> Column:
    """1 where a field holds a value: not NULL, not '', not 0, not an empty list."""
    if name == "line_items" and name not in df.columns:
        name = "line_count"  # a pre-aggregated number of line items
    if name not in df.columns:
        return F.lit(0)
    kind, col = df.schema[name].dataType.typeName(), F.col(name)
    if kind == "string":
        full = F.length(strip(col) if blank_is_missing else col) > 0
    elif kind == "array":
        full = F.size(col) > 0
    elif kind in ("integer", "long", "short", "byte", "float", "double", "decimal"):
        full = col != 0
    else:
        full = col.isNotNull()
    return F.when(full, 1).otherwise(0)


def _total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def confidence_score(df: DataFrame) -> DataFrame:
    """Mean of the extraction confidence and the share of required fields present."""
    found = _total([_present(df, f, blank_is_missing=False) for f in REQUIRED_FIELDS])
    conf = F.coalesce("confidence", F.lit(0.0))
    return df.withColumn("confidence_score", (conf + found / len(REQUIRED_FIELDS)) / 2)


def completeness_score(df: DataFrame) -> DataFrame:
    need = _total([_present(df, f, blank_is_missing=True) for f in REQUIRED_FIELDS])
    extra = _total([_present(df, f, blank_is_missing=True) for f in OPTIONAL_FIELDS])
    score = need / len(REQUIRED_FIELDS) * REQUIRED_WEIGHT + extra / len(OPTIONAL_FIELDS) * OPTIONAL_WEIGHT
    return df.withColumn("completeness_score", score)


def automation_score(df: DataFrame) -> DataFrame:
    """The stored score row per document, with the review decision."""
    valid = F.coalesce("is_valid", F.lit(False))
    scored = completeness_score(confidence_score(df)).withColumns(
        {
            "validation_pass": valid,
            "automation_score": F.col("confidence_score")
            * F.col("completeness_score")
            * F.when(valid, 1.0).otherwise(INVALID_FACTOR),
        }
    )
    review = (
        (F.col("automation_score") < SCORE_THRESHOLD)
        | (F.col("confidence_score") < CONFIDENCE_THRESHOLD)
        | (F.col("completeness_score") < COMPLETENESS_THRESHOLD)
        | ~F.col("validation_pass")
    )
    return scored.withColumn("requires_review", review)


def automation_batch_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.round(F.coalesce(F.avg("automation_score"), F.lit(0.0)), 3).alias("average_automation_score"),
        as_bigint(F.count_if("requires_review")).alias("requires_review"),
        as_bigint(F.count_if(~F.col("requires_review"))).alias("fully_automated"),
    )


def automation_bands(scores: DataFrame) -> DataFrame:
    s = F.col("automation_score")
    band = F.when(s >= SCORE_THRESHOLD, "automated").when(s >= MANUAL_THRESHOLD, "review").otherwise("manual")
    return scores.withColumn("band", band)


def _goal_status(rate: Column) -> Column:
    goal = GOAL * 100
    return (
        F.when(rate < goal - 10, "critical").when(rate >= goal - 5, "on_track").otherwise("needs_attention")
    )


def _goal_message(rate: Column) -> Column:
    # Texts are fixed values of the report.
    goal = GOAL * 100
    now, gap = F.format_string("%.1f%%", rate), F.format_string("%.1f%%", F.lit(goal) - rate)
    tail = F.concat(F.lit(" Current rate: "), now, F.lit(", Gap: "), gap)
    return (
        F.when(rate >= goal, F.concat(F.lit("🎉 Automation goal achieved! Current rate: "), now))
        .when(rate >= goal - 5, F.concat(F.lit("✅ On track to meet goal."), tail))
        .when(rate >= goal - 10, F.concat(F.lit("⚠️ Needs attention."), tail))
        .otherwise(F.concat(F.lit("🚨 Critical. Significant gap in automation."), tail))
    )


def goal_check(metrics: DataFrame) -> DataFrame:
    """Every row of automation metrics against the 90 % goal."""
    goal, rate = F.lit(GOAL * 100), F.col("automation_rate")
    return metrics.withColumns(
        {
            "goal": goal,
            "is_met": rate >= goal,
            "gap": F.greatest(goal - rate, F.lit(0.0)),
            "status": _goal_status(rate),
            "message": _goal_message(rate),
        }
    )


def automation_insights(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Up to five findings per row of automation metrics."""
    conf, comp = F.col("average_confidence"), F.col("average_completeness")
    valid, rate = F.col("validation_pass_rate"), F.col("automation_rate")
    manual = F.coalesce(pct(F.col("manual_intervention"), F.col("total_processed")), F.lit(0.0))
    allowed = (1.0 - GOAL) * 100

    def finding(cond: Column, kind: str, priority: Column | str, message: Column, advice: Column | str) -> Column:
        def text(x: Column | str) -> Column:
            return F.lit(x) if isinstance(x, str) else x

        return F.when(
            cond,
            F.struct(
                F.lit(kind).alias("type"),
                text(priority).alias("priority"),
                message.alias("message"),
                text(advice).alias("recommendation"),
            ),
        )

    def share(col: Column) -> Column:
        return F.format_string("%.1f%%", col * 100)

    # Texts are fixed values of the report.
    found = F.array(
        finding(
            conf < CONFIDENCE_THRESHOLD, "confidence", "high",
            F.concat(F.lit("Average confidence score ("), share(conf),
                     F.lit(f") is below threshold ({CONFIDENCE_THRESHOLD:.1%})")),
            "Consider fine-tuning Form Recognizer model or improving document quality"),
        finding(
            comp < COMPLETENESS_THRESHOLD, "completeness", "high",
            F.concat(F.lit("Average completeness score ("), share(comp),
                     F.lit(f") is below threshold ({COMPLETENESS_THRESHOLD:.1%})")),
            "Review document templates and ensure all required fields are present"),
        finding(
            valid < VALIDATION_THRESHOLD * 100, "validation", "medium",
            F.concat(F.lit("Validation pass rate ("), F.format_string("%.1f%%", valid),
                     F.lit(f") is below {VALIDATION_THRESHOLD * 100:.0f}%")),
            "Review and optimize data quality validation rules"),
        finding(
            rate < GOAL * 100, "automation_rate",
            F.when(_goal_status(rate) == "critical", "critical").otherwise("high"),
            _goal_message(rate),
            F.concat(F.lit("Focus on improving confidence, completeness, and validation to close "),
                     F.format_string("%.1f%%", F.lit(GOAL * 100) - rate), F.lit(" gap"))),
        finding(
            manual > allowed, "manual_intervention", "medium",
            F.concat(F.format_string("%.1f%%", manual),
                     F.lit(" of invoices require significant manual intervention "
                           f"(threshold: {allowed:.1f}%)")),
            "Identify common patterns in low-scoring invoices and create targeted training data"),
    )
    return metrics.select(*keys, F.inline(F.array_compact(found)))


# --- complexity and routing ---


def structure_complexity(table_count: Column, page_count: Column) -> Column:
    tables = (
        F.when(table_count == 0, 15).when(table_count == 1, 5).when(table_count <= 3, 10).otherwise(20)
    )
    pages = F.when(page_count > 1, F.least((page_count - 1) * 5, F.lit(10))).otherwise(0)
    return F.least(tables + pages, F.lit(PART_LIMIT)).cast("int")


def quality_complexity(confidence: Column, content: Column) -> Column:
    ocr = F.when(confidence < 0.7, 20).when(confidence < 0.85, 10).when(confidence < 0.95, 5).otherwise(0)
    short = F.when(F.length(content) < 100, 5).otherwise(0)
    return F.least(ocr + short, F.lit(PART_LIMIT)).cast("int")


def missing_fields(fields: Column) -> Column:
    """Number of standard fields not among ``fields``."""
    return F.size(F.array_except(F.array(*[F.lit(f) for f in STANDARD_FIELDS]), fields))


def completeness_complexity(missing: Column) -> Column:
    return F.when(missing >= 4, 20).when(missing >= 2, 10).when(missing >= 1, 5).otherwise(0)


def known_vendor(content: Column, vendor: Column) -> Column:
    """First known vendor name found in the text or the vendor metadata, else NULL."""
    text = F.lower(F.concat_ws(" ", content, vendor))
    return F.coalesce(*[F.when(text.contains(v), F.lit(v)) for v in KNOWN_VENDORS])


def standardization_complexity(vendor: Column) -> Column:
    return F.when(vendor.isNotNull(), 5).otherwise(25)


def route_documents(df: DataFrame, force_mode: str | None = None) -> DataFrame:
    """Complexity (0-100), level, processing mode, confidence and reasons.

    Needs ``table_count, page_count, confidence, content, fields (array of names), vendor``;
    ``vendor`` NULL means there is no metadata.
    """
    if force_mode:
        return df.withColumns(
            {
                "complexity_level": F.lit("simple"),
                "processing_mode": F.lit(force_mode),
                "assessment_confidence": F.lit(1.0),
                "reasons": F.array(F.lit("Mode forced by user")),
            }
        )
    tables = F.coalesce("table_count", F.lit(0))
    pages = F.coalesce("page_count", F.lit(1))
    conf = F.coalesce("confidence", F.lit(1.0))
    content = F.coalesce("content", F.lit(""))
    scored = df.withColumn("_known", known_vendor(content, F.col("vendor"))).withColumn(
        "_missing", missing_fields(F.coalesce("fields", F.array().cast("array<string>")))
    )
    missing, known = F.col("_missing"), F.col("_known")
    scored = scored.withColumns(
        {
            "structure_score": structure_complexity(tables, pages),
            "quality_score": quality_complexity(conf, content),
            "completeness_score": completeness_complexity(missing),
            "standardization_score": standardization_complexity(known),
        }
    )
    parts = [F.col(f"{p}_score") for p in ("structure", "quality", "completeness", "standardization")]
    total = _total(parts)
    spread = F.greatest(*parts) - F.least(*parts)
    sure = 0.8 + F.when(F.col("vendor").isNotNull(), 0.1).otherwise(0.0) + F.when(spread < 10, 0.1).otherwise(0.0)

    def percent(c: Column) -> Column:
        return F.format_string("%.2f%%", c * 100)

    # Texts are fixed values of the analysis.
    reasons = F.array_compact(
        F.array(
            F.when(tables == 0, "No structured tables found").when(
                tables > 3, F.concat(F.lit("Multiple tables ("), tables.cast("string"), F.lit(") detected"))),
            F.when(pages > 2, F.concat(F.lit("Multi-page document ("), pages.cast("string"), F.lit(" pages)"))),
            F.when(conf < 0.7, F.concat(F.lit("Low OCR confidence ("), percent(conf), F.lit(")"))).when(
                conf < 0.85, F.concat(F.lit("Medium OCR confidence ("), percent(conf), F.lit(")"))),
            F.when(F.length(content) < 100, "Very short document content"),
            F.when(missing >= 4, F.concat(F.lit("Many missing fields ("), missing.cast("string"), F.lit(")"))).when(
                missing >= 2, F.concat(F.lit("Some missing fields ("), missing.cast("string"), F.lit(")"))),
            F.when(known.isNotNull(), F.concat(F.lit("Known vendor detected: "), known)).otherwise(
                "Unknown vendor format"),
            F.when(total > MEDIUM_LIMIT, "High complexity: requires multi-agent processing").when(
                total > SIMPLE_LIMIT,
                "Medium complexity: will try traditional first, fallback to multi-agent"),
        )
    )
    return scored.withColumns(
        {
            "complexity_score": total,
            "complexity_level": F.when(total <= SIMPLE_LIMIT, "simple")
            .when(total <= MEDIUM_LIMIT, "medium")
            .otherwise("complex"),
            "processing_mode": F.when(total <= MEDIUM_LIMIT, "traditional").otherwise("multi_agent"),
            "assessment_confidence": F.least(sure, F.lit(1.0)),
            "reasons": reasons,
        }
    ).drop("_known", "_missing")


def classify_by_keywords(df: DataFrame, text: str = "text", table_count: str | None = None) -> DataFrame:
    """``document_type``, ``type_confidence`` and a score per type, by keyword hits in the
    whole lower-cased text."""
    content = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = {
        kind: _total([content.contains(w).cast("int") for w in words]) for kind, words in KEYWORDS.items()
    }
    words = F.size(F.filter(F.split(content, r"\s+"), lambda w: w != ""))
    tables = F.col(table_count) if table_count else F.lit(0)
    card = hits["business_card"]
    hits["business_card"] = card + F.when((words < 50) & (card >= 2), 3).otherwise(0)
    hits["invoice"] = hits["invoice"] + F.when(tables > 0, 2).otherwise(0)
    hits["receipt"] = hits["receipt"] + F.when(tables > 0, 1).otherwise(0)
    scored = df.withColumns({f"{kind}_score": h for kind, h in hits.items()})
    cols = [F.col(f"{kind}_score") for kind in KEYWORDS]
    best = F.greatest(*cols)
    kind = F.when(best == 0, "general")
    for name in KEYWORDS:  # the first type wins a tie
        kind = kind.when(F.col(f"{name}_score") == best, name)
    conf = F.when(best >= 5, 0.95).when(best >= 3, 0.85).when(best >= 2, 0.75).when(best >= 1, 0.65)
    return scored.withColumns({"document_type": kind, "type_confidence": conf.otherwise(0.50)})


# --- model evaluation ---


def field_accuracy(matches: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document, from the rows of ``field_match``."""
    n = F.count(F.lit(1))
    out = matches.groupBy(key).agg(
        (F.count_if("matched") / n).alias("accuracy"), (F.count_if("extracted") / n).alias("completeness")
    )
    acc, comp = F.col("accuracy"), F.col("completeness")
    return out.select(
        key,
        acc,
        comp,
        acc.alias("confidence"),
        (acc >= 0.85).alias("validation_passed"),
        ((acc >= 0.90) & (comp >= 0.95)).alias("fully_automated"),
    )


def field_accuracy_without_truth(predicted: DataFrame, key: str = "document_id") -> DataFrame:
    """The same measures from the number of predicted fields when no truth exists."""
    out = predicted.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.col("n") / 5.0, F.lit(1.0))
    return out.select(
        key,
        F.lit(0.5).alias("accuracy"),
        share.alias("completeness"),
        share.alias("confidence"),
        (F.col("n") >= 3).alias("validation_passed"),
        (F.col("n") >= 4).alias("fully_automated"),
    )


def model_automation(results: DataFrame, key: str = "model_name") -> DataFrame:
    """Per model: automation rate, averages, speed and estimated cost per document."""
    n, zero = F.count(F.lit(1)), F.lit(0.0)
    out = results.groupBy(key).agg(
        pct(F.count_if("fully_automated"), n).alias("automation_rate"),
        F.coalesce(F.avg("confidence"), zero).alias("confidence"),
        F.coalesce(F.avg("completeness"), zero).alias("completeness"),
        pct(F.count_if("validation_passed"), n).alias("validation_pass_rate"),
        F.coalesce(F.avg("processing_time"), zero).alias("processing_speed"),
        n.alias("documents_processed"),
    )
    base = F.when(F.lower(key).contains("gpt-4"), 0.03).otherwise(0.01)
    return out.withColumns(
        {
            "accuracy": F.col("validation_pass_rate") / 100,
            "cost_per_document": base * (1 + F.col("processing_speed") / 5.0 * 0.2),
        }
    )


def compare_models(metrics: DataFrame, baseline: str, tuned: str, key: str = "model_name") -> DataFrame:
    """One row: gains of ``tuned`` over ``baseline``, recommendation and confidence level."""
    names = (
        "automation_rate", "accuracy", "confidence", "completeness", "validation_pass_rate",
        "processing_speed", "cost_per_document", "documents_processed",
    )

    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col(key) == model, F.col(name)))

    both = metrics.where(F.col(key).isin(baseline, tuned)).agg(
        *[of(baseline, n).alias(f"b_{n}") for n in names], *[of(tuned, n).alias(f"t_{n}") for n in names]
    )

    def gain(name: str) -> Column:
        return F.col(f"t_{name}") - F.col(f"b_{name}")

    def cut(name: str) -> Column:
        b, t = F.col(f"b_{name}"), F.col(f"t_{name}")
        return F.when(b > 0, (b - t) / b * 100).otherwise(0.0)

    rate, size = F.col("automation_rate"), F.col("t_documents_processed")
    out = both.select(
        *[gain(n).alias(n) for n in names[:5]],
        cut("processing_speed").alias("processing_speed_improvement"),
        cut("cost_per_document").alias("cost_reduction"),
        size,
    )
    # Texts are fixed values of the comparison.
    advice = (
        F.when((rate >= 5.0) & (F.col("accuracy") >= 0.05),
               "STRONGLY RECOMMENDED: Deploy fine-tuned model. Significant improvements in automation and accuracy.")
        .when(rate >= 3.0, "RECOMMENDED: Deploy fine-tuned model. Good improvement in automation rate.")
        .when(rate >= 1.0, "CONSIDER: Fine-tuned model shows improvement but may need more training.")
        .otherwise("NOT RECOMMENDED: Continue fine-tuning with more diverse training data.")
    )
    level = (
        F.when((size >= 100) & (rate >= 5.0), "HIGH")
        .when((size >= 100) & (rate >= 3.0), "MEDIUM")
        .when(size.between(50, 99), "MEDIUM")
        .otherwise("LOW")
    )
    return out.withColumns({"recommendation": advice, "confidence_level": level}).drop("t_documents_processed")


def automation_gap_plan(metrics: DataFrame, target: float = 90.0, key: str = "model_name") -> DataFrame:
    """Per model: gap to the target and the training plan that should close it."""
    gap = F.lit(target) - F.col("automation_rate")
    out = metrics.select(key, "automation_rate", gap.alias("gap"))
    gap = F.col("gap")
    examples = F.greatest((gap * 50).cast("bigint"), F.lit(100).cast("bigint"))
    epochs = F.when(gap > 10, 5).when(gap > 5, 3).otherwise(2).cast("bigint")
    out = out.withColumns(
        {
            "is_achievable": gap <= 15.0,
            "training_examples": examples,
            "epochs": epochs,
            "learning_rate": F.when(gap > 10, 0.0001).otherwise(0.00005),
            "batch_size": F.lit(16).cast("bigint"),
        }
    )
    work = F.col("training_examples") * F.col("epochs")
    hours = work / 500.0
    return out.withColumns(
        {
            "training_hours": hours,
            "cost_usd": work * 0.008,
            "timeline_days": F.greatest(((hours + 2.0) / 8.0).cast("bigint") + 1, F.lit(1).cast("bigint")),
        }
    )


def automation_gap_advice(metrics: DataFrame, key: str = "model_name") -> DataFrame:
    """Per model: one row for each area below its target."""

    def advice(cond: Column, area: str, now: str, target: float, action: str, impact: str, priority: str):
        return F.when(
            cond,
            F.struct(
                F.lit(area).alias("area"),
                F.col(now).alias("current"),
                F.lit(target).alias("target"),
                F.lit(action).alias("action"),
                F.lit(impact).alias("expected_impact"),
                F.lit(priority).alias("priority"),
            ),
        )

    # Texts are fixed values of the plan.
    rows = F.array(
        advice(F.col("confidence") < 0.90, "confidence", "confidence", 0.90,
               "Increase training data diversity and quality", "+5-10% automation rate", "high"),
        advice(F.col("completeness") < 0.95, "completeness", "completeness", 0.95,
               "Add more examples with complete field extraction", "+3-7% automation rate", "high"),
        advice(F.col("validation_pass_rate") < 85.0, "validation", "validation_pass_rate", 85.0,
               "Review and optimize validation rules or improve data quality", "+2-5% automation rate", "medium"),
        advice(F.col("processing_speed") > 5.0, "performance", "processing_speed", 5.0,
               "Optimize model size or use batch processing", "Faster processing without accuracy loss", "low"),
    )
    return metrics.select(key, F.inline(F.array_compact(rows)))


def evaluation_report(predicted: DataFrame, truth: DataFrame, key: str = "document_id") -> DataFrame:
    """Accuracy in total, by document type and by industry (of the truth).

    ``predicted(document_type, industry, confidence_score)``, ``truth(document_type, industry)``.
    """
    pred = predicted.select(
        key,
        F.col("document_type").alias("p_type"),
        F.col("industry").alias("p_industry"),
        "confidence_score",
    )
    joined = truth.join(pred, key, "left")
    kind, industry = (F.coalesce(c, F.lit("unknown")) for c in ("document_type", "industry"))
    cells = joined.groupBy(kind.alias("document_type"), industry.alias("industry")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("p_type") == F.col("document_type")).alias("type_hits"),
        F.count_if(F.col("p_industry") == F.col("industry")).alias("industry_hits"),
        F.sum(F.coalesce("confidence_score", F.lit(0.0))).alias("conf"),
    )
    sets = [[F.col("document_type")], [F.col("industry")], []]
    rolled = cells.groupingSets(sets, "document_type", "industry").agg(
        F.grouping_id().alias("g"),
        F.sum("n").alias("total"),
        F.sum("type_hits").alias("t"),
        F.sum("industry_hits").alias("i"),
        F.sum("conf").alias("c"),
    )
    level = F.when(F.col("g") == 1, "document_type").when(F.col("g") == 2, "industry").otherwise("overall")
    correct = F.when(level == "industry", F.col("i")).otherwise(F.col("t"))
    return rolled.select(
        level.alias("level"),
        F.coalesce("document_type", "industry").alias("category"),
        "total",
        correct.alias("correct"),
        (correct / F.col("total")).alias("accuracy"),
        F.when(level == "overall", F.col("c") / F.col("total")).alias("average_confidence"),
    )


def response_quality(df: DataFrame, text: str = "text", prompt_type: Column | None = None) -> DataFrame:
    """Score of a response: length, coherence, relevance to the prompt type, completeness."""
    body = F.col(text)
    kind = prompt_type if prompt_type is not None else F.lit("general")
    n = F.length(body)
    sentences = F.split(body, r"\.", -1)
    closed = F.slice(sentences, F.lit(1), F.size(sentences) - 1)
    coherent = (F.size(sentences) > 1) & F.forall(closed, lambda s: F.length(strip(s)) > 10)
    lower = F.lower(body)
    code = _total([lower.contains(w).cast("int") for w in ("def ", "function", "class ", "import")]) > 0
    relevant = F.when(kind == "summarization", n < 500).when(kind == "code_generation", code).otherwise(F.lit(True))
    complete = (n > 50) & ~body.endswith("...")

    def points(cond: Column, weight: float) -> Column:
        return F.when(cond, weight).otherwise(0.0)

    score = points(n.between(50, 2000), 0.2) + points(coherent, 0.3) + points(relevant, 0.3) + points(complete, 0.2)
    return df.withColumn("quality_score", F.least(score, F.lit(1.0)))
