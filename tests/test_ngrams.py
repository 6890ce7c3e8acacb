"""Vocabularies and count vectors from word numbers against Spark's own stages, which list every n-gram."""

import random
from collections import Counter

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from inkstream.operators import models as X
from inkstream.operators import ngrams as N


def corpus(seed, n):
    """Texts of common, rare and wide words, some empty, one common to all."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["ﬀx", "𐐷y", "été"]
    weights = [1 / (i + 1) for i in range(60)] + [0.2] * 3
    return [(i, ["all", *rng.choices(words, weights, k=rng.choice([0, 3, 30]))] if i % 9 else [], i % 3) for i in range(n)]


@pytest.mark.parametrize("seed,ngrams,size,min_df,max_df", [(1, 1, 20, 2.0, 0.95), (2, 3, 40, 2.0, 0.8), (3, 3, 5000, 1.0, 1000.0), (4, 2, 200, 0.02, 30.0)])
def test_terms_and_vectors_are_those_of_counting_every_ngram(rows, monkeypatch, seed, ngrams, size, min_df, max_df):
    monkeypatch.setattr(N, "SLICE", 100)
    table = rows(corpus(seed, 90), "id long, _n1 array<string>, part int")
    sets = [[0, 1], [0, 2], [1]]
    terms, grams, numbers = N.vocabularies(table, "_n1", "part", sets, ngrams, size, min_df, max_df)
    between = X.fit_stages(NaiveBayes(), "label", ngrams, False)[1:-2]
    listed = PipelineModel(stages=between).transform(table)
    texts = {r.id: (r.part, r._terms) for r in listed.collect()}
    for own, chosen in zip(sets, terms, strict=True):
        used = [t for p, t in texts.values() if p in own]
        count, held = Counter(w for t in used for w in t), Counter(w for t in used for w in set(t))
        low, high = (x if x >= 1 else x * len(used) for x in (min_df, max_df))
        fit = sorted((w for w in count if low <= held[w] <= high), key=lambda w: (count[w], w.encode("utf-16-be")), reverse=True)
        plain = CountVectorizer(inputCol="_terms", outputCol="v", vocabSize=size, minDF=min_df, maxDF=max_df).fit(listed.where(F.col("part").isin(*own)))
        assert [count[w] for w in chosen] == [count[w] for w in plain.vocabulary]  # of equal counts any goes there
        assert chosen == fit[:size]
        got = {r.id: r.v for r in N.count_vectors(numbers, grams, chosen, "v").collect()}
        want = {r.id: r.v for r in CountVectorizerModel.from_vocabulary(chosen, "_terms", "v").transform(listed).collect()}
        assert got == want


def test_rare_pairs_are_not_counted(rows):
    """Only pairs of words as frequent as the last word of the vocabulary are listed."""
    rng = random.Random(5)
    data = [(i, [f"w{min(int(rng.paretovariate(0.5)), 10**6)}" for _ in range(40)], 0) for i in range(200)]
    table = rows(data, "id long, _n1 array<string>, part int")
    _, grams, numbers = N.vocabularies(table, "_n1", "part", [[0]], 2, 20, 2.0, 1000.0)
    listed = N._gram_counts(numbers, "part", [[0]], [], len(grams.texts[0])).count()
    assert len(grams.texts[0]) < 40 and 5 * listed < len({p for _, w, _ in data for p in zip(w, w[1:], strict=False)})
    assert sum(map(len, grams.texts)) < 80


def test_an_empty_vocabulary_is_an_error(rows):
    with pytest.raises(ValueError, match="min_df"):
        N.vocabularies(rows([(1, ["a", "b"], 0)], "id long, _n1 array<string>, part int"), "_n1", "part", [[0]], 2, 9, 2.0, 0.9)


def test_cross_validation_equals_fitting_every_fold(rows):
    rng = random.Random(7)
    data = [(i, " ".join(rng.choices([f"{'abc'[i % 3]}{j % 7}x{j}" for j in range(30)] + ["und", "the"], k=8)), "xyz"[i % 3] if i % 11 else "xyz"[i % 2]) for i in range(120)]
    data += [(200, "nothing else", None), (201, "a0x0 the", "only")]
    df = rows(data, "id long, text string, lang string")
    stages = X.fit_stages(NaiveBayes(smoothing=0.1), "lang", 2, False, 50)
    fold = F.pmod(F.xxhash64(F.lit(X.SEED), "id"), F.lit(3)).cast("int")
    plain = CrossValidator(
        estimator=Pipeline(stages=stages), estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy"), numFolds=3, foldCol="_fold",
    ).fit(X.words(df, "text").withColumn("_fold", fold))
    got = X.cross_validate(stages, df, "text", "id", 3).first()
    assert (got.mean_accuracy, got.std_accuracy) == (pytest.approx(plain.avgMetrics[0]), pytest.approx(plain.stdMetrics[0]))


def test_two_classes_are_boosted_once(rows):
    """One model of trees for two classes; its classes are those of one model against the rest for each."""
    rng = random.Random(3)
    kinds = {"a": ["red", "green", "blue", "pink"], "b": ["pink", "iron", "tin", "blue"]}
    data = [(i, " ".join(rng.choices(kinds["ab"[i % 2]], k=6)), "ab"[i % 2]) for i in range(150)]
    df = rows(data, "document_id long, text string, document_type string")
    found = X.fit_document_classifier(df, trees=3, depth=3, rounds=4, boost_depth=2, vocabulary=50)
    once = next(f for f in found if f.name == "count").model
    assert type(once.stages[-1]).__name__ == "GBTClassificationModel"
    ready = PipelineModel(stages=once.stages[:-1]).transform(df)
    trees = X.GBTClassifier(maxIter=4, maxDepth=2, stepSize=X.BOOST_STEP, seed=X.SEED)
    train = ready.join(X.split_tags(df, "document_type", "document_id").where("split = 'train'"), "document_id")
    each = X.OneVsRest(classifier=trees).setLabelCol("_label").setFeaturesCol("features").fit(train)
    single = trees.setLabelCol("_label").setFeaturesCol("features").fit(train)
    assert [r.prediction for r in each.transform(ready).orderBy("document_id").collect()] == [r.prediction for r in single.transform(ready).orderBy("document_id").collect()]
