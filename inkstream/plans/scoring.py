"""Automation scores, routing, keyword classification and model evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions.distributed import spread
from inkstream.operators import metrics as G
from inkstream.operators import relational as R
from inkstream.operators import scoring as A
from inkstream.plans.metrics import scores, vendor_metrics
from inkstream.plans.oracle_views import VIEWS
from inkstream.plans.registry import query
from inkstream.plans.relational import FIELD_MATCH_CTES, predicted_fields, true_fields
from inkstream.sources.views import Tables

SC = ("scores",)
_SCORES = ("confidence_score", "completeness_score", "automation_score")


@query("confidence_score", "SELECT document_id, confidence_score FROM scored", ("scored",), floats=("confidence_score",))
def _(t: Tables):
    return A.confidence_score(t.invoices()).select("document_id", "confidence_score")


@query("completeness_score", "SELECT document_id, completeness_score FROM scored", ("scored",), floats=("completeness_score",))
def _(t: Tables):
    return A.completeness_score(t.invoices()).select("document_id", "completeness_score")


@query(
    "automation_score",
    "SELECT document_id, confidence_score, completeness_score, validation_pass, automation_score, requires_review FROM scores",
    SC,
    floats=_SCORES,
)
def _(t: Tables):
    return scores(t).select("document_id", *_SCORES, "validation_pass", "requires_review")


@query(
    "automation_batch_summary",
    """SELECT count(*) AS total_processed, round(avg(automation_score), 3) AS average_automation_score,
  count(*) FILTER (requires_review) AS requires_review, count(*) FILTER (NOT requires_review) AS fully_automated FROM scores""",
    SC,
    floats=("average_automation_score:5",),
)
def _(t: Tables):
    return A.automation_batch_summary(scores(t))


@query(
    "automation_bands",
    """SELECT document_id, automation_score, CASE WHEN automation_score >= 0.85 THEN 'automated' WHEN automation_score >= 0.70 THEN 'review'
  ELSE 'manual' END AS band FROM scores""",
    SC,
    floats=("automation_score",),
)
def _(t: Tables):
    return A.automation_bands(scores(t)).select("document_id", "automation_score", "band")


_STATUS = """CASE WHEN automation_rate < 80 THEN 'critical' WHEN automation_rate >= 85 THEN 'on_track' ELSE 'needs_attention' END"""
_MESSAGE = """CASE WHEN automation_rate >= 90 THEN printf('🎉 Automation goal achieved! Current rate: %.1f%%', automation_rate)
  WHEN automation_rate >= 85 THEN printf('✅ On track to meet goal. Current rate: %.1f%%, Gap: %.1f%%', automation_rate, 90 - automation_rate)
  WHEN automation_rate >= 80 THEN printf('⚠️ Needs attention. Current rate: %.1f%%, Gap: %.1f%%', automation_rate, 90 - automation_rate)
  ELSE printf('🚨 Critical. Significant gap in automation. Current rate: %.1f%%, Gap: %.1f%%', automation_rate, 90 - automation_rate) END"""

#: Rates spread over all goal classes: the share of large invoices per customer and model.
VIEWS["rates"] = (
    ("invoices",),
    """SELECT model_name, customer_name, count(*) FILTER (total_amount > 30000) * CAST(100 AS DOUBLE) / count(*) AS automation_rate
FROM invoices GROUP BY 1, 2""",
)


@query(
    "goal_check",
    f"""SELECT *, CAST(90 AS DOUBLE) AS goal, automation_rate >= 90 AS is_met, greatest(90 - automation_rate, 0) AS gap,
  {_STATUS} AS status, {_MESSAGE} AS message FROM rates""",
    ("rates",),
    floats=("automation_rate", "goal", "gap"),
)
def _(t: Tables):
    rates = t.invoices().groupBy("model_name", "customer_name").agg(
        (F.count_if(F.col("total_amount") > 30000) * 100.0 / F.count(F.lit(1))).alias("automation_rate")
    )
    return A.goal_check(rates)


@query(
    "automation_insights",
    f"""WITH m AS (SELECT *, manual_intervention * CAST(100 AS DOUBLE) / total_processed AS manual FROM vendor_metrics)
---
SELECT vendor_name, 'confidence' AS type, 'high' AS priority, printf('Average confidence score (%.1f%%) is below threshold (90.0%%)', average_confidence * 100)
  AS message, 'Consider fine-tuning Form Recognizer model or improving document quality' AS recommendation FROM m WHERE average_confidence < 0.9
UNION ALL SELECT vendor_name, 'completeness', 'high', printf('Average completeness score (%.1f%%) is below threshold (95.0%%)', average_completeness * 100),
  'Review document templates and ensure all required fields are present' FROM m WHERE average_completeness < 0.95
UNION ALL SELECT vendor_name, 'validation', 'medium', printf('Validation pass rate (%.1f%%) is below 85%%', validation_pass_rate),
  'Review and optimize data quality validation rules' FROM m WHERE validation_pass_rate < 85
UNION ALL SELECT vendor_name, 'automation_rate', CASE WHEN {_STATUS} = 'critical' THEN 'critical' ELSE 'high' END, {_MESSAGE},
  printf('Focus on improving confidence, completeness, and validation to close %.1f%% gap', 90 - automation_rate) FROM m WHERE automation_rate < 90
UNION ALL SELECT vendor_name, 'manual_intervention', 'medium', printf('%.1f%% of invoices require significant manual intervention (threshold: 10.0%%)', manual),
  'Identify common patterns in low-scoring invoices and create targeted training data' FROM m WHERE manual > (1 - CAST(0.9 AS DOUBLE)) * 100""",
    ("vendor_metrics",),
)
def _(t: Tables):
    return A.automation_insights(vendor_metrics(t), ["vendor_name"])


# --- routing ---

VIEWS["ocr"] = (
    (),
    """SELECT doc_id, text AS content, CAST(doc_id % 6 AS INT) AS table_count, CAST(1 + doc_id % 5 AS INT) AS page_count,
  CAST(0.6 AS DOUBLE) + CAST(doc_id % 40 AS DOUBLE) / 100 AS confidence,
  list_slice(['invoice_number', 'invoice_date', 'due_date', 'vendor_name', 'total_amount', 'tax_amount', 'subtotal'], 1, doc_id % 8) AS fields,
  CASE doc_id % 4 WHEN 0 THEN 'Adobe Systems' WHEN 1 THEN 'Local Shop' WHEN 2 THEN 'IBM' END AS vendor FROM documents""",
)
VIEWS["complexity"] = (
    ("ocr",),
    """SELECT *, CAST(least(CASE WHEN table_count = 0 THEN 15 WHEN table_count = 1 THEN 5 WHEN table_count <= 3 THEN 10 ELSE 20 END
    + least((page_count - 1) * 5, 10), 25) AS INT) AS structure_score,
  CAST(least(CASE WHEN confidence < 0.7 THEN 20 WHEN confidence < 0.85 THEN 10 WHEN confidence < 0.95 THEN 5 ELSE 0 END
    + CASE WHEN length(content) < 100 THEN 5 ELSE 0 END, 25) AS INT) AS quality_score,
  7 - len(fields) AS missing, CAST(CASE WHEN 7 - len(fields) >= 4 THEN 20 WHEN 7 - len(fields) >= 2 THEN 10 WHEN 7 - len(fields) >= 1 THEN 5 ELSE 0 END AS INT)
    AS completeness_score,
  regexp_matches(lower(concat_ws(' ', content, vendor)), 'amazon|microsoft|oracle|salesforce|adobe|google|ibm') AS known,
  CASE WHEN regexp_matches(lower(concat_ws(' ', content, vendor)), 'amazon|microsoft|oracle|salesforce|adobe|google|ibm') THEN 5 ELSE 25 END
    AS standardization_score FROM ocr""",
)


def ocr_results(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    fields = F.slice(F.array(*[F.lit(f) for f in A.STANDARD_FIELDS]), F.lit(1), (key % 8).cast("int"))
    vendor = F.when(key % 4 == 0, "Adobe Systems").when(key % 4 == 1, "Local Shop").when(key % 4 == 2, "IBM")
    return t.documents.select(
        "doc_id",
        F.col("text").alias("content"),
        (key % 6).cast("int").alias("table_count"),
        (1 + key % 5).cast("int").alias("page_count"),
        (F.lit(0.6) + (key % 40).cast("double") / 100).alias("confidence"),
        fields.alias("fields"),
        vendor.alias("vendor"),
    )


@query("structure_complexity", "SELECT doc_id, structure_score FROM complexity", ("complexity",))
def _(t: Tables):
    score = A.structure_complexity(F.col("table_count"), F.col("page_count"))
    return ocr_results(t).select("doc_id", score.alias("structure_score"))


@query("quality_complexity", "SELECT doc_id, quality_score FROM complexity", ("complexity",))
def _(t: Tables):
    score = A.quality_complexity(F.col("confidence"), F.col("content"))
    return ocr_results(t).select("doc_id", score.alias("quality_score"))


@query(
    "completeness_complexity",
    "SELECT doc_id, CAST(missing AS INT) AS missing, completeness_score, CAST(standardization_score AS INT) AS standardization_score FROM complexity",
    ("complexity",),
)
def _(t: Tables):
    missing = A.missing_fields(F.col("fields"))
    vendor = A.known_vendor(F.col("content"), F.col("vendor"))
    return ocr_results(t).select(
        "doc_id",
        missing.alias("missing"),
        A.completeness_complexity(missing).alias("completeness_score"),
        A.standardization_complexity(vendor).alias("standardization_score"),
    )


_TOTAL = "structure_score + quality_score + completeness_score + standardization_score"
_SPREAD = """greatest(structure_score, quality_score, completeness_score, standardization_score)
    - least(structure_score, quality_score, completeness_score, standardization_score)"""


@query(
    "route_documents",
    f"""SELECT doc_id, CAST({_TOTAL} AS INT) AS complexity_score,
  CASE WHEN {_TOTAL} <= 30 THEN 'simple' WHEN {_TOTAL} <= 60 THEN 'medium' ELSE 'complex' END AS complexity_level,
  CASE WHEN {_TOTAL} <= 60 THEN 'traditional' ELSE 'multi_agent' END AS processing_mode,
  least(CAST(0.8 AS DOUBLE) + CASE WHEN vendor IS NOT NULL THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN {_SPREAD} < 10 THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 1)
    AS assessment_confidence,
  concat_ws('; ', CASE WHEN table_count = 0 THEN 'No structured tables found' WHEN table_count > 3 THEN printf('Multiple tables (%d) detected', table_count) END,
    CASE WHEN page_count > 2 THEN printf('Multi-page document (%d pages)', page_count) END,
    CASE WHEN confidence < 0.7 THEN printf('Low OCR confidence (%.2f%%)', confidence * 100)
      WHEN confidence < 0.85 THEN printf('Medium OCR confidence (%.2f%%)', confidence * 100) END,
    CASE WHEN length(content) < 100 THEN 'Very short document content' END,
    CASE WHEN missing >= 4 THEN printf('Many missing fields (%d)', missing) WHEN missing >= 2 THEN printf('Some missing fields (%d)', missing) END,
    CASE WHEN known THEN 'Known vendor detected: ' || CASE
        WHEN contains(lower(concat_ws(' ', content, vendor)), 'amazon') THEN 'amazon' WHEN contains(lower(concat_ws(' ', content, vendor)), 'microsoft') THEN 'microsoft'
        WHEN contains(lower(concat_ws(' ', content, vendor)), 'oracle') THEN 'oracle' WHEN contains(lower(concat_ws(' ', content, vendor)), 'salesforce') THEN 'salesforce'
        WHEN contains(lower(concat_ws(' ', content, vendor)), 'adobe') THEN 'adobe' WHEN contains(lower(concat_ws(' ', content, vendor)), 'google') THEN 'google' ELSE 'ibm' END
      ELSE 'Unknown vendor format' END,
    CASE WHEN {_TOTAL} > 60 THEN 'High complexity: requires multi-agent processing'
      WHEN {_TOTAL} > 30 THEN 'Medium complexity: will try traditional first, fallback to multi-agent' END) AS reasons
FROM complexity""",
    ("complexity",),
    floats=("assessment_confidence",),
)
def _(t: Tables):
    out = A.route_documents(ocr_results(t))
    return out.select(
        "doc_id", "complexity_score", "complexity_level", "processing_mode", "assessment_confidence",
        F.array_join("reasons", "; ").alias("reasons"),
    )


@query(
    "route_documents_forced",
    """SELECT doc_id, 'simple' AS complexity_level, 'mcp' AS processing_mode, CAST(1 AS DOUBLE) AS assessment_confidence FROM documents""",
    floats=("assessment_confidence",),
)
def _(t: Tables):
    out = A.route_documents(ocr_results(t), force_mode="mcp")
    return out.select("doc_id", "complexity_level", "processing_mode", "assessment_confidence")


@query(
    "routing_statistics",
    f"""WITH r AS (SELECT CASE WHEN doc_id % 20 = 3 THEN 'mcp' WHEN {_TOTAL} <= 60 AND doc_id % 11 <> 0 THEN 'traditional' ELSE 'multi_agent' END AS m,
  {_TOTAL} <= 60 AND doc_id % 20 <> 3 AND doc_id % 11 = 0 AS f FROM complexity)
---
SELECT count(*) FILTER (m = 'traditional') AS traditional_count, count(*) FILTER (m = 'multi_agent') AS multi_agent_count,
  count(*) FILTER (m = 'mcp') AS mcp_count, count(*) FILTER (f) AS fallback_count, count(*) AS total_processed,
  count(*) FILTER (m = 'traditional') * 100.0 / count(*) AS traditional_percentage, count(*) FILTER (m = 'multi_agent') * 100.0 / count(*)
  AS multi_agent_percentage, count(*) FILTER (m = 'mcp') * 100.0 / count(*) AS mcp_percentage, count(*) FILTER (f) * 100.0 / count(*) AS fallback_rate FROM r""",
    ("complexity",),
    floats=("traditional_percentage", "multi_agent_percentage", "mcp_percentage", "fallback_rate"),
)
def _(t: Tables):
    routed = A.route_documents(ocr_results(t))
    key, mode = F.col("doc_id"), F.col("processing_mode")
    fell = (mode == "traditional") & (key % 20 != 3) & (key % 11 == 0)
    final = F.when(key % 20 == 3, "mcp").when(fell, "multi_agent").otherwise(mode)
    return G.routing_statistics(routed.select(fell.alias("fallback_used"), final.alias("processing_mode")))


# --- keyword classification over whole texts and pages ---


def _hits(kind: str, text: str) -> str:
    return " + ".join(
        f"CAST(contains({text}, '{w.replace(chr(39), chr(39) * 2)}') AS INT)" for w in A.KEYWORDS[kind]
    )


def _classify_sql(table: str, key: str, text: str) -> str:
    per = ",\n  ".join(f"{_hits(kind, 'x')} AS {kind}_hits" for kind in A.KEYWORDS)
    kinds = list(A.KEYWORDS)
    greatest = "greatest(" + ", ".join(f"{k}_score" for k in kinds) + ")"
    cases = " ".join(f"WHEN {k}_score = {greatest} THEN '{k}'" for k in kinds)
    return f"""WITH h AS (SELECT {key}, n_tables, len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) AS words, {per}
  FROM (SELECT {key}, lower({text}) AS x, {key} % 3 AS n_tables FROM {table})),
s AS (SELECT {key}, invoice_hits + CASE WHEN n_tables > 0 THEN 2 ELSE 0 END AS invoice_score,
  receipt_hits + CASE WHEN n_tables > 0 THEN 1 ELSE 0 END AS receipt_score,
  business_card_hits + CASE WHEN words < 50 AND business_card_hits >= 2 THEN 3 ELSE 0 END AS business_card_score,
  id_document_hits AS id_document_score, tax_document_hits AS tax_document_score FROM h)
---
SELECT {key}, CASE WHEN {greatest} = 0 THEN 'general' {cases} END AS document_type,
  CASE WHEN {greatest} >= 5 THEN CAST(0.95 AS DOUBLE) WHEN {greatest} >= 3 THEN 0.85 WHEN {greatest} >= 2 THEN 0.75
    WHEN {greatest} >= 1 THEN 0.65 ELSE 0.5 END AS type_confidence FROM s"""


def _classify(table: str, key: str, text: str):
    @query(f"classify_by_keywords_{table}", _classify_sql(table, key, text), floats=("type_confidence",))
    def _(t: Tables):
        rows = spread(t.table(table)).withColumn("n_tables", F.col(key) % 3)
        return A.classify_by_keywords(rows, text, "n_tables").select(key, "document_type", "type_confidence")


_classify("documents", "doc_id", "text")
_classify("pages", "page_id", "html")


# --- model evaluation ---

VIEWS["field_accuracies"] = (
    ("invoices",),
    f"""WITH {FIELD_MATCH_CTES},
a AS (SELECT document_id, count(*) FILTER (matched) / CAST(count(*) AS DOUBLE) AS accuracy,
  count(*) FILTER (extracted) / CAST(count(*) AS DOUBLE) AS completeness FROM matches GROUP BY 1)
SELECT document_id, accuracy, completeness, accuracy AS confidence, accuracy >= 0.85 AS validation_passed,
  accuracy >= 0.9 AND completeness >= 0.95 AS fully_automated FROM a""",
)
VIEWS["model_automations"] = (
    ("field_accuracies", "orders_model"),
    """SELECT *, validation_pass_rate / 100 AS accuracy, CASE WHEN contains(lower(model_name), 'gpt-4') THEN CAST(0.03 AS DOUBLE) ELSE 0.01 END
  * (1 + processing_speed / 5 * 0.2) AS cost_per_document FROM (
  SELECT model_name, count(*) FILTER (fully_automated) * CAST(100 AS DOUBLE) / count(*) AS automation_rate, avg(confidence) AS confidence,
    avg(completeness) AS completeness, count(*) FILTER (validation_passed) * CAST(100 AS DOUBLE) / count(*) AS validation_pass_rate,
    avg(processing_time) AS processing_speed, count(*) AS documents_processed
  FROM field_accuracies f JOIN orders_model o ON o.document_id = f.document_id GROUP BY 1)""",
)
VIEWS["orders_model"] = (
    (),
    """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 5 < 2 THEN 'gpt-4o' WHEN o_orderkey % 10 < 7 THEN 'baseline' ELSE 'gpt-35' END AS model_name,
  o_totalprice / 50000 AS processing_time FROM orders""",
)


def field_accuracies(t: Tables) -> DataFrame:
    return A.field_accuracy(R.field_match(predicted_fields(t), true_fields(t)))


def model_automations(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    model = F.when(key % 5 < 2, "gpt-4o").when(key % 10 < 7, "baseline").otherwise("gpt-35")
    info = t.orders.select(
        key.alias("document_id"), model.alias("model_name"), (F.col("o_totalprice") / 50000).alias("processing_time")
    )
    return A.model_automation(field_accuracies(t).join(info, "document_id"))


_MODEL = (
    "automation_rate", "confidence", "completeness", "validation_pass_rate", "processing_speed",
    "accuracy", "cost_per_document",
)


@query("field_accuracy", "SELECT * FROM field_accuracies", ("field_accuracies",), floats=("accuracy", "completeness", "confidence"))
def _(t: Tables):
    return field_accuracies(t)


@query(
    "field_accuracy_without_truth",
    f"""WITH {FIELD_MATCH_CTES}
---
SELECT document_id, CAST(0.5 AS DOUBLE) AS accuracy, least(count(*) / CAST(5 AS DOUBLE), 1) AS completeness,
  least(count(*) / CAST(5 AS DOUBLE), 1) AS confidence, count(*) >= 3 AS validation_passed, count(*) >= 4 AS fully_automated FROM pred GROUP BY 1""",
    ("invoices",),
    floats=("accuracy", "completeness", "confidence"),
)
def _(t: Tables):
    return A.field_accuracy_without_truth(predicted_fields(t))


@query("model_automation", "SELECT * FROM model_automations", ("model_automations",), floats=_MODEL)
def _(t: Tables):
    return model_automations(t)


@query(
    "compare_models",
    """WITH d AS (SELECT t.automation_rate - b.automation_rate AS automation_rate, t.accuracy - b.accuracy AS accuracy, t.confidence - b.confidence AS confidence,
  t.completeness - b.completeness AS completeness, t.validation_pass_rate - b.validation_pass_rate AS validation_pass_rate,
  (b.processing_speed - t.processing_speed) / b.processing_speed * 100 AS processing_speed_improvement,
  (b.cost_per_document - t.cost_per_document) / b.cost_per_document * 100 AS cost_reduction, t.documents_processed AS n
  FROM model_automations b, model_automations t WHERE b.model_name = 'baseline' AND t.model_name = 'gpt-4o')
---
SELECT * EXCLUDE (n), CASE WHEN automation_rate >= 5 AND accuracy >= 0.05 THEN 'STRONGLY RECOMMENDED: Deploy fine-tuned model. Significant improvements in automation and accuracy.'
  WHEN automation_rate >= 3 THEN 'RECOMMENDED: Deploy fine-tuned model. Good improvement in automation rate.'
  WHEN automation_rate >= 1 THEN 'CONSIDER: Fine-tuned model shows improvement but may need more training.'
  ELSE 'NOT RECOMMENDED: Continue fine-tuning with more diverse training data.' END AS recommendation,
  CASE WHEN n >= 100 AND automation_rate >= 5 THEN 'HIGH' WHEN n >= 100 AND automation_rate >= 3 THEN 'MEDIUM' WHEN n BETWEEN 50 AND 99 THEN 'MEDIUM' ELSE 'LOW' END
  AS confidence_level FROM d""",
    ("model_automations",),
    floats=(
        "automation_rate", "accuracy", "confidence", "completeness", "validation_pass_rate",
        "processing_speed_improvement", "cost_reduction",
    ),
)
def _(t: Tables):
    return A.compare_models(model_automations(t), "baseline", "gpt-4o")


@query(
    "automation_gap_plan",
    """WITH g AS (SELECT model_name, automation_rate, 90 - automation_rate AS gap FROM model_automations),
e AS (SELECT *, gap <= 15 AS is_achievable, greatest(CAST(trunc(gap * 50) AS BIGINT), 100) AS training_examples,
  CAST(CASE WHEN gap > 10 THEN 5 WHEN gap > 5 THEN 3 ELSE 2 END AS BIGINT) AS epochs, CASE WHEN gap > 10 THEN CAST(0.0001 AS DOUBLE) ELSE 0.00005 END
  AS learning_rate, CAST(16 AS BIGINT) AS batch_size FROM g)
---
SELECT *, training_examples * epochs / CAST(500 AS DOUBLE) AS training_hours, training_examples * epochs * CAST(0.008 AS DOUBLE) AS cost_usd,
  greatest(CAST(trunc((training_examples * epochs / CAST(500 AS DOUBLE) + 2) / 8) AS BIGINT) + 1, 1) AS timeline_days FROM e""",
    ("model_automations",),
    floats=("automation_rate", "gap", "learning_rate", "training_hours", "cost_usd"),
)
def _(t: Tables):
    return A.automation_gap_plan(model_automations(t))


@query(
    "automation_gap_advice",
    """SELECT model_name, 'confidence' AS area, confidence AS current, CAST(0.9 AS DOUBLE) AS target, 'Increase training data diversity and quality' AS action,
  '+5-10% automation rate' AS expected_impact, 'high' AS priority FROM model_automations WHERE confidence < 0.9
UNION ALL SELECT model_name, 'completeness', completeness, 0.95, 'Add more examples with complete field extraction', '+3-7% automation rate', 'high'
  FROM model_automations WHERE completeness < 0.95
UNION ALL SELECT model_name, 'validation', validation_pass_rate, 85, 'Review and optimize validation rules or improve data quality', '+2-5% automation rate', 'medium'
  FROM model_automations WHERE validation_pass_rate < 85
UNION ALL SELECT model_name, 'performance', processing_speed, 5, 'Optimize model size or use batch processing', 'Faster processing without accuracy loss', 'low'
  FROM model_automations WHERE processing_speed > 5""",
    ("model_automations",),
    floats=("current", "target"),
)
def _(t: Tables):
    return A.automation_gap_advice(model_automations(t))


@query(
    "evaluation_report",
    """WITH j AS (SELECT d.document_type AS dt, coalesce(d.detected_language, 'unknown') AS ind,
  CASE WHEN document_id % 4 = 0 THEN 'other' ELSE document_type END = document_type AS hit,
  coalesce(CASE WHEN document_id % 3 = 0 THEN 'en' ELSE detected_language END = coalesce(detected_language, 'unknown'), false) AS ihit, confidence AS c FROM doc_events d)
---
SELECT 'document_type' AS level, dt AS category, count(*) AS total, count(*) FILTER (hit) AS correct, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS accuracy,
  CAST(NULL AS DOUBLE) AS average_confidence FROM j GROUP BY 2
UNION ALL SELECT 'industry', ind, count(*), count(*) FILTER (ihit), count(*) FILTER (ihit) / CAST(count(*) AS DOUBLE), NULL FROM j GROUP BY 2
UNION ALL SELECT 'overall', NULL, count(*), count(*) FILTER (hit), count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), avg(c) FROM j""",
    ("doc_events",),
    floats=("accuracy", "average_confidence"),
)
def _(t: Tables):
    truth = t.doc_events().select("document_id", "document_type", F.col("detected_language").alias("industry"))
    key = F.col("document_id")
    pred = t.doc_events().select(
        "document_id",
        F.when(key % 4 == 0, "other").otherwise(F.col("document_type")).alias("document_type"),
        F.when(key % 3 == 0, "en").otherwise(F.col("detected_language")).alias("industry"),
        F.col("confidence").alias("confidence_score"),
    )
    return A.evaluation_report(pred, truth)


@query(
    "response_quality",
    """WITH r AS (SELECT conv_id, turn, text, turn % 3 AS k, string_split(text, '.') AS s FROM conversations)
---
SELECT conv_id, turn, CASE WHEN length(text) BETWEEN 50 AND 2000 THEN CAST(0.2 AS DOUBLE) ELSE 0 END
  + CASE WHEN len(s) > 1 AND len(list_filter(s[1:len(s) - 1], lambda x: length(trim(x, E' \\t\\n\\r\\x0b\\x0c')) <= 10)) = 0 THEN CAST(0.3 AS DOUBLE) ELSE 0 END
  + CASE WHEN CASE k WHEN 0 THEN length(text) < 500 WHEN 1 THEN regexp_matches(lower(text), 'def |function|class |import') ELSE true END THEN CAST(0.3 AS DOUBLE) ELSE 0 END
  + CASE WHEN length(text) > 50 AND NOT ends_with(text, '...') THEN CAST(0.2 AS DOUBLE) ELSE 0 END AS quality_score FROM r""",
    floats=("quality_score",),
)
def _(t: Tables):
    k = F.col("turn") % 3
    kind = F.when(k == 0, "summarization").when(k == 1, "code_generation").otherwise("general")
    return A.response_quality(t.conversations, "text", kind).select("conv_id", "turn", "quality_score")
