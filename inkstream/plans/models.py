"""Text classifiers on the supplied documents.

Fitted models differ between libraries, so these are checked by accuracy in the tests; the
report arithmetic has reference SQL.  All run at the sizes of the operators' defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators import models as X
from inkstream.plans.registry import query
from inkstream.sources.views import Tables

def labelled(t: Tables) -> DataFrame:
    quality = F.when(F.col("quality") == 1, "good").otherwise("poor")
    mood = F.when(F.col("toxic") == 1, "negative").otherwise("positive")
    return t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("document_id"), "text", quality.alias("document_type"), mood.alias("sentiment")
    )


def languages(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("document_id"), "text", F.col("lang").alias("language"))


@query(
    "classification_report",
    """WITH p AS (SELECT lang AS y, CASE WHEN doc_id % 7 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS p FROM documents),
l AS (SELECT y AS label FROM p UNION SELECT p FROM p),
s AS (SELECT label, (SELECT count(*) FROM p WHERE y = label AND p = label) AS tp, (SELECT count(*) FROM p WHERE y = label) AS support,
  (SELECT count(*) FROM p WHERE p = label) AS called FROM l),
r AS (SELECT label, support, coalesce(tp / CAST(nullif(called, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0) AS recall FROM s)
---
SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, (SELECT avg(CAST(y = p AS INT)) FROM p) AS accuracy FROM r""",
    floats=("precision", "recall", "f1", "accuracy"),
)
def _(t: Tables):
    key = F.col("doc_id")
    guess = F.when(key % 7 == 0, "en").when(key % 11 == 0, "xx").otherwise(F.col("lang"))
    return X.classification_report(t.documents.select("lang", guess.alias("predicted")), "lang")


@query("fit_document_classifier")
def _(t: Tables):
    best, other = X.fit_document_classifier(labelled(t))
    return best.report.withColumn("model", F.lit(best.name)).unionByName(
        other.report.withColumn("model", F.lit(other.name))
    )


@query("fit_sentiment_classifier")
def _(t: Tables):
    return X.fit_sentiment_classifier(labelled(t)).report


@query("fit_language_detector")
def _(t: Tables):
    return X.fit_language_detector(languages(t)).report


@query("cross_validate")
def _(t: Tables):
    stages = X.fit_stages(X.NaiveBayes(smoothing=X.SMOOTHING), "language", 2, False)
    return X.cross_validate(stages, languages(t), "text", "document_id")


@query("predict")
def _(t: Tables):
    """Language and sentiment of every document by models fitted on the labelled ones."""
    models = {
        "language": X.fit_language_detector(languages(t)),
        "sentiment": X.fit_sentiment_classifier(labelled(t)),
    }
    return X.predict_all(languages(t), models, "document_id")
