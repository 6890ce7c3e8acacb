"""Training-data selection, text cleaning and chat examples over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.columns import as_bigint, strip
from inkstream.operators.relational import upsert

# Fixed values of the training workflow.
MIN_CONFIDENCE, MIN_TEXT = 0.7, 100
QUALITY_LEVELS = (("excellent", 0.9), ("high", 0.8), ("medium", 0.6))
CONTENT_CHARS = 2000
# System messages per document type; {industry} is filled in.
SYSTEM_MESSAGES = {
    "invoice": "You are an expert {industry} invoice analysis AI. Extract key information including vendor, amounts, dates, line items, and payment terms. Provide structured JSON output.",
    "contract": "You are a specialized {industry} contract analysis AI. Identify parties, key terms, obligations, dates, and legal clauses. Provide detailed analysis in structured format.",
    "report": "You are a {industry} report analysis AI. Extract key findings, metrics, recommendations, and executive summary. Provide comprehensive analysis.",
    "medical": "You are a healthcare document analysis AI. Extract patient information, diagnoses, treatments, medications, and medical codes while maintaining HIPAA compliance.",
    "legal": "You are a legal document analysis AI specializing in {industry}. Extract case details, legal precedents, statutes, and key legal arguments.",
    "financial": "You are a financial document analysis AI for {industry}. Extract financial metrics, ratios, trends, and key performance indicators.",
}
OTHER_SYSTEM_MESSAGE = "You are an expert {industry} document analysis AI. Extract key information and provide structured analysis."

#: Unicode white space and the separators the cleaning also folds.
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
_NOT_TEXT = r"[^\p{L}\p{N}_\s.,!?;:-]"


def training_candidates(docs: DataFrame, document_type: str | None = None, industry: str | None = None) -> DataFrame:
    """Documents fit for training, newest first."""
    rows = docs
    if document_type is not None:
        rows = rows.where(F.col("document_type") == document_type)
    if industry is not None:
        rows = rows.where(F.col("industry") == industry)
    return rows.where(
        (F.col("confidence") > MIN_CONFIDENCE) & (F.length("extracted_text") >= MIN_TEXT)
    ).orderBy(F.desc("created_at"), "document_id")


def candidate_counts(docs: DataFrame) -> DataFrame:
    """Collected versus available documents per type and industry."""
    available = F.col("confidence") > MIN_CONFIDENCE
    usable = available & (F.coalesce(F.length("extracted_text"), F.lit(0)) >= MIN_TEXT)
    return docs.groupBy("document_type", "industry").agg(
        as_bigint(F.count_if(usable)).alias("collected_documents"),
        as_bigint(F.count_if(available)).alias("total_documents_available"),
    )


def training_quality(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Quality score of a training set from confidence, text length and spread, with its level."""
    out = docs.groupBy(*keys).agg(
        F.avg("confidence").alias("avg_confidence"),
        F.avg(F.length("extracted_text")).alias("avg_text_length"),
        F.stddev_pop("confidence").alias("confidence_std"),
        F.count(F.lit(1)).alias("total_documents"),
    )
    score = (
        F.col("avg_confidence") * 0.4
        + F.least(F.col("avg_text_length") / 1000, F.lit(1.0)) * 0.3
        + F.greatest(1 - F.col("confidence_std"), F.lit(0.0)) * 0.3
    )
    out = out.withColumn("quality_score", F.coalesce(score, F.lit(0.0)))
    level = None
    for name, limit in QUALITY_LEVELS:
        cond = F.col("quality_score") >= limit
        level = F.when(cond, name) if level is None else level.when(cond, name)
    return out.withColumn("quality_level", level.otherwise("low"))


def cleaned(text: Column) -> Column:
    """White space folded to single spaces, then everything but words and .,!?;:- removed."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " "))
    return F.trim(F.regexp_replace(folded, _NOT_TEXT, ""))


def clean_text(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, cleaned(F.col(col)))


def normalize_entities(df: DataFrame, col: str = "entities") -> DataFrame:
    """Trim every value of a map of lists (or of texts); empty list items go, NULL becomes ''."""
    value_type = df.schema[col].dataType.valueType.typeName()

    def fixed(_: Column, v: Column) -> Column:
        if value_type == "array":
            kept = F.filter(F.coalesce(v, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
            return F.transform(kept, lambda x: strip(x))
        return F.coalesce(strip(v.cast("string")), F.lit(""))

    return df.withColumn(col, F.transform_values(col, fixed))


def preprocess(docs: DataFrame, stored: DataFrame | None = None, workflow_id: str = "default") -> DataFrame:
    """Clean texts and entities and merge them into the stored rows by workflow and document.

    ``docs(document_id, extracted_text, entities, created_at)``; of several versions of a
    document the newest wins.
    """
    done = normalize_entities(clean_text(docs, "extracted_text")).select(
        F.lit(workflow_id).alias("workflow_id"),
        "document_id",
        F.col("extracted_text").alias("preprocessed_text"),
        F.to_json("entities").alias("features"),
        "created_at",
    )
    base = done.where(F.lit(False)) if stored is None else stored
    return upsert(base, done, ["workflow_id", "document_id"], ["created_at", "preprocessed_text"])


def chat_examples(docs: DataFrame, max_chars: int | None = CONTENT_CHARS) -> DataFrame:
    """System, user and assistant messages per document.

    ``docs(document_id, document_type, industry, extracted_text, summary, entities
    map<string, array<string>>, confidence)``; the message format cuts content at ``max_chars``.
    """
    kind, industry = F.col("document_type"), F.col("industry")

    def filled(template: str) -> Column:
        head, sep, tail = template.partition("{industry}")
        return F.concat(F.lit(head), industry, F.lit(tail)) if sep else F.lit(template)

    system = None
    for name, template in SYSTEM_MESSAGES.items():
        system = F.when(kind == name, filled(template)) if system is None else system.when(kind == name, filled(template))
    system = system.otherwise(filled(OTHER_SYSTEM_MESSAGE))

    content = F.coalesce(F.nullif("extracted_text", F.lit("")), "summary", F.lit(""))
    if max_chars is not None:
        content = F.substring(content, 1, max_chars)
    user = F.concat(F.lit("Analyze this "), kind, F.lit(" document:\n\n"), content, F.lit("..."))

    def listed(key: str) -> Column:
        return F.coalesce(F.try_element_at("entities", F.lit(key)), F.array().cast("array<string>"))

    def first(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(listed(key), F.lit(1)), F.lit(default))

    common = [
        kind.alias("document_type"),
        industry.alias("industry"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence_score"),
        F.col("entities").alias("key_entities"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    ]
    invoice = [
        first("organizations", "Unknown").alias("vendor"),
        first("amounts", "0").alias("total_amount"),
        first("dates", "Unknown").alias("invoice_date"),
    ]
    contract = [listed("organizations").alias("parties"), listed("dates").alias("contract_dates")]
    medical = [listed("people").alias("patient_info")]
    answer = (
        F.when(kind == "invoice", F.to_json(F.struct(*common, *invoice)))
        .when(kind == "contract", F.to_json(F.struct(*common, *contract)))
        .when(kind == "medical", F.to_json(F.struct(*common, *medical)))
        .otherwise(F.to_json(F.struct(*common)))
    )

    def message(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("content"))

    messages = F.array(message("system", system), message("user", user), message("assistant", answer))
    return docs.select("document_id", messages.alias("messages"))
