"""Text classifiers: training, evaluation, cross-validation and prediction with Spark ML.

Vocabulary counting, fitting and scoring all run as Spark jobs; the driver only holds the
vocabulary (bounded by its size parameter), the class names and the fitted parameters.
Fitting counts n-grams once (:mod:`ngrams`) and writes count vectors, which all else reads.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    GBTClassifier,  # noqa: F401  (what Boosted is compared with)
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    NGram,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
    StringIndexerModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.functions.distributed import cut_lineage, release, spread
from inkstream.operators import ngrams
from inkstream.operators.relational import top_predictions
from inkstream.operators.trees import Boosted, Forest
from inkstream.operators.windows import train_validation_split

# Sizes of the reference models.
VOCABULARY, MIN_DF, MAX_DF = 10_000, 2.0, 0.95
TREES, TREE_DEPTH, BOOST_ROUNDS, BOOST_DEPTH, BOOST_STEP = 100, 20, 100, 6, 0.1
MIN_LEAF, ITERATIONS, SMOOTHING, FOLDS, SEED = 2, 1000, 0.1, 5, 42


@dataclass(frozen=True)
class FittedClassifier:
    """A fitted text pipeline with its hold-out accuracy and per-class report."""

    name: str
    model: PipelineModel
    accuracy: float
    report: DataFrame

    @property
    def labels(self) -> list[str]:
        return next(s.labels for s in self.model.stages if isinstance(s, StringIndexerModel))


def word_stages(text: str) -> list:
    """Lower-cased words of two or more characters without English stop words."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_raw", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="_raw", outputCol="_n1"),
    ]


def words(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the words of every text in place of the text, written once.

    Fitting passes over the rows many times; only this step reads and splits the texts.
    """
    split = PipelineModel(stages=word_stages(text)).transform(df)
    return cut_lineage(split.drop(text, "_raw"))


def fit_stages(
    classifier: Estimator,
    label: str,
    ngrams: int,
    tfidf: bool,
    vocabulary: int = VOCABULARY,
    min_df: float = MIN_DF,
    max_df: float = MAX_DF,
) -> list:
    """Label index, n-grams of the words, counts or TF-IDF, and the classifier.

    All n-gram lengths share one vocabulary, so its size limit holds for them together.
    """
    stages: list = [
        StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc")
    ]
    for n in range(2, ngrams + 1):
        stages.append(NGram(n=n, inputCol="_n1", outputCol=f"_n{n}"))
    parts = ", ".join(f"_n{n}" for n in range(1, ngrams + 1))
    stages.append(SQLTransformer(statement=f"SELECT *, concat({parts}) AS _terms FROM __THIS__"))
    counts = "_counts" if tfidf else "features"
    stages.append(
        CountVectorizer(inputCol="_terms", outputCol=counts, vocabSize=vocabulary, minDF=min_df, maxDF=max_df)
    )
    if tfidf:
        stages.append(IDF(inputCol="_counts", outputCol="features"))
    return [*stages, classifier.setLabelCol("_label").setFeaturesCol("features")]


def split_tags(df: DataFrame, label: str, key: str) -> DataFrame:
    """``key, split``: 80/20 of every class in a fixed pseudo-random order."""
    mixed = df.select(key, label, F.xxhash64(F.lit(SEED), key).alias("_mix"))
    return train_validation_split(mixed, [label], ["_mix", key]).select(key, "split")


def named_predictions(fitted: DataFrame, labels: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(x) for x in labels])
    return fitted.withColumn("predicted", F.element_at(names, (F.col("prediction") + 1).cast("int")))


def classification_report(predictions: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, each row with the overall accuracy."""
    cells = predictions.groupBy(F.col(label).cast("string").alias("y"), F.col(predicted).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sums = (
        cells.withColumn("hit", hit)
        .select("hit", "y", F.inline(pairs))
        .groupBy("label")
        .agg(
            F.sum(F.when(F.col("support") > 0, F.col("hit"))).alias("tp"),
            F.sum("support").alias("support"),
            F.sum("called").alias("called"),
        )
    )
    tp = F.coalesce("tp", F.lit(0))
    precision = F.coalesce(F.try_divide(tp, F.col("called")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, F.col("support")), F.lit(0.0))
    accuracy = cells.withColumn("hit", hit).select(F.sum("hit") / F.sum("n")).scalar()
    out = sums.where("label IS NOT NULL").select(
        "label", precision.alias("precision"), recall.alias("recall"), "support"
    )
    p, r = F.col("precision"), F.col("recall")
    return out.select(
        "label", p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support",
        accuracy.alias("accuracy"),
    )


def _fit(name: str, stages: list, table: DataFrame, text: str, label: str) -> FittedClassifier:
    """``table`` holds words and the ``split`` of every row; the model starts from texts again."""
    index = stages[0].fit(table.where("split = 'train'"))
    part = F.when(F.col("split") == "train", 0).otherwise(1)
    rows = index.transform(table).select(label, "_label", "split", "_n1", part.alias("_part"))
    counter = _counter(stages)
    (vocabulary,), grams, numbers = ngrams.vocabularies(
        rows, "_n1", "_part", [[0]], _longest(stages), counter.getVocabSize(), counter.getMinDF(), counter.getMaxDF()
    )
    vectors = ngrams.count_vectors(numbers, grams, vocabulary, counter.getOutputCol())
    release(numbers)
    last = Pipeline(stages=stages[stages.index(counter) + 1 :]).fit(vectors.where("split = 'train'"))
    counts = CountVectorizerModel.from_vocabulary(vocabulary, counter.getInputCol(), counter.getOutputCol())
    model = PipelineModel(stages=[index, *word_stages(text), *stages[1 : stages.index(counter)], counts, *last.stages])
    scored = named_predictions(last.transform(vectors.where("split = 'validation'")), index.labels)
    scored = cut_lineage(scored.select(label, "predicted"))
    release(vectors)
    accuracy = scored.agg(F.avg((F.col("predicted") == F.col(label).cast("string")).cast("double"))).first()[0]
    return FittedClassifier(name, model, float(accuracy or 0.0), classification_report(scored, label))


def _counter(stages: list) -> CountVectorizer:
    return next(s for s in stages if isinstance(s, CountVectorizer))


def _longest(stages: list) -> int:
    return max([s.getN() for s in stages if isinstance(s, NGram)], default=1)


def _split_words(df: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """Words of all texts with their ``split``; only keys and labels go through the split.

    Rows are dealt over a fixed number of tasks: a table that is small in bytes is much work, and would else come in a few.
    """
    rows = df.select(key, text, label)
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return words(rows.repartition(tasks, key).join(split_tags(rows, label, key).repartition(tasks, key), key), text)


def fit_document_classifier(
    df: DataFrame,
    text: str = "text",
    label: str = "document_type",
    key: str = "document_id",
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    rounds: int = BOOST_ROUNDS,
    boost_depth: int = BOOST_DEPTH,
    vocabulary: int = VOCABULARY,
) -> tuple[FittedClassifier, FittedClassifier]:
    """(better, other) of TF-IDF + random forest and counts + boosted trees by hold-out accuracy."""
    table = _split_words(df, text, label, key)
    forest = Forest(numTrees=trees, maxDepth=depth, minInstancesPerNode=MIN_LEAF, seed=SEED)
    boosted = Boosted(maxIter=rounds, maxDepth=boost_depth, stepSize=BOOST_STEP, seed=SEED)
    classes = table.where("split = 'train'").where(F.col(label).isNotNull()).select(label).distinct().limit(3).count()
    if classes != 2:  # of two classes one against the other is the other against the one
        boosted = OneVsRest(classifier=boosted)
    a = _fit("tfidf", fit_stages(forest, label, 3, True, vocabulary), table, text, label)
    b = _fit("count", fit_stages(boosted, label, 2, False, vocabulary), table, text, label)
    return (a, b) if a.accuracy >= b.accuracy else (b, a)


def fit_sentiment_classifier(
    df: DataFrame, text: str = "text", label: str = "sentiment", key: str = "document_id",
    iterations: int = ITERATIONS, vocabulary: int = VOCABULARY,
) -> FittedClassifier:
    """TF-IDF + L2 logistic regression; C = 1 is a penalty of 1 / rows."""
    table = _split_words(df, text, label, key)
    rows = max(table.where("split = 'train'").count(), 1)
    model = LogisticRegression(maxIter=iterations, regParam=1.0 / rows)
    return _fit("sentiment", fit_stages(model, label, 3, True, vocabulary), table, text, label)


def fit_language_detector(
    df: DataFrame, text: str = "text", label: str = "language", key: str = "document_id", vocabulary: int = VOCABULARY
) -> FittedClassifier:
    """Term counts + multinomial naive Bayes."""
    table = _split_words(df, text, label, key)
    model = NaiveBayes(smoothing=SMOOTHING, modelType="multinomial")
    return _fit("language", fit_stages(model, label, 2, False, vocabulary), table, text, label)


def cross_validate(stages: list, df: DataFrame, text: str, key: str, folds: int = FOLDS) -> DataFrame:
    """Mean and standard deviation of the accuracy of ``fit_stages`` over hash folds.

    n-grams are counted once, by fold; the vocabulary of each training set comes from all counts but its own fold's.
    """
    label, counter = stages[0].getInputCol(), _counter(stages)
    fold = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(folds)).cast("int")
    table = words(spread(df), text).where(F.col(label).isNotNull()).select(label, "_n1", fold.alias("_fold"))
    sets = [[g for g in range(folds) if g != f] for f in range(folds)]
    terms, grams, numbers = ngrams.vocabularies(
        table, "_n1", "_fold", sets, _longest(stages), counter.getVocabSize(), counter.getMinDF(), counter.getMaxDF()
    )
    evaluator = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy")
    accuracies = []
    for f, vocabulary in enumerate(terms):
        vectors = ngrams.count_vectors(numbers, grams, vocabulary, counter.getOutputCol())
        last = Pipeline(stages=[stages[0], *stages[stages.index(counter) + 1 :]])
        fitted = last.fit(vectors.where(F.col("_fold") != f))
        accuracies.append(evaluator.evaluate(fitted.transform(vectors.where(F.col("_fold") == f))))
        release(vectors)
    release(numbers)
    return df.sparkSession.createDataFrame(
        [(folds, float(np.mean(accuracies)), float(np.std(accuracies)))],
        "folds int, mean_accuracy double, std_accuracy double",
    )


def predict(df: DataFrame, fitted: FittedClassifier, key: str, top: int | None = 3) -> DataFrame:
    """Class, confidence and the ``top`` (or all) classes per text."""
    # a constant label column lets the label indexer pass through at scoring time
    index = fitted.model.stages[0]
    ready = df.withColumn(index.getInputCol(), F.lit(fitted.labels[0]))
    scored = named_predictions(fitted.model.transform(ready), fitted.labels)
    names = F.array(*[F.lit(x) for x in fitted.labels])
    probs = scored.select(
        key, "predicted", vector_to_array("probability").alias("probability"), names.alias("labels")
    )
    ranked = top_predictions(probs, len(fitted.labels) if top is None else top)
    return ranked.select(
        key, F.col("predicted").alias("predicted_class"), F.array_max("probability").alias("confidence"), "top_predictions"
    )


def predict_all(df: DataFrame, models: Mapping[str, FittedClassifier], key: str) -> DataFrame:
    """One row per text with the class and confidence of every model.

    The models are applied to a row one after another, so nothing is joined and rows with
    equal keys stay apart.
    """
    out = df.select(F.struct(key).alias("_row"), F.struct(*df.columns).alias("_in"))
    done: list[str] = []
    for kind, fitted in models.items():
        ready = out.select("_row", "_in", *done, "_in.*")
        ready = ready.withColumn(fitted.model.stages[0].getInputCol(), F.lit(fitted.labels[0]))
        scored = named_predictions(fitted.model.transform(ready), fitted.labels)
        confidence = F.array_max(vector_to_array("probability"))
        out = scored.select(
            "_row", "_in", *done, F.col("predicted").alias(f"{kind}_class"), confidence.alias(f"{kind}_confidence")
        )
        done += [f"{kind}_class", f"{kind}_confidence"]
    return out.select("_row.*", *done)


def save_models(models: Mapping[str, FittedClassifier], folder: str) -> None:
    for kind, fitted in models.items():
        fitted.model.write().overwrite().save(os.path.join(folder, kind))


def load_model(folder: str, kind: str) -> PipelineModel:
    return PipelineModel.load(os.path.join(folder, kind))
