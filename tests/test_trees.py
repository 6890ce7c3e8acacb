"""Trees fitted by columns against Spark ML's own."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, RandomForestClassificationModel
from pyspark.ml.linalg import Vectors

from inkstream.operators import models as X
from inkstream.operators import trees as T


def counts(seed, n, classes=2):
    """Rare and common terms, one of many different counts, one in every row, one that nobody has, a dense vector, rows without terms."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cells = {f: rng.randint(1, 3) for f in {int(rng.paretovariate(0.6)) for _ in range(rng.choice([0, 4, 12]))} if f < 38}
        cells |= {38: rng.randint(1, 90)} if i % 3 else {}
        cells[39] = rng.randint(1, 40)
        label = (cells.get(1, 0) + (cells.get(38, 0) > 40) + (cells[39] > 30) + (rng.random() < 0.1)) % classes
        vector = Vectors.sparse(41, dict(sorted(cells.items())))
        out.append((float(label), Vectors.dense(vector.toArray()) if i == 5 else vector))
    return out


def nodes(model):
    """What a tree asks and what it answers."""
    return [line.split(":")[-1].strip() if "Predict" in line else line.strip() for line in model.toDebugString.splitlines()[1:]]


@pytest.mark.parametrize("seed,least,block", [(1, 20, 1 << 22), (2, 30, 300)])
def test_boosted_trees_are_those_of_spark(spark, monkeypatch, seed, least, block):
    monkeypatch.setattr(T, "SMALL", 0)
    monkeypatch.setattr(T, "BLOCK", block)
    df = spark.createDataFrame(counts(seed, 700), ["label", "features"]).repartition(3).cache()
    args = {"maxIter": 4, "maxDepth": 4, "stepSize": 0.1, "seed": 1, "minInstancesPerNode": least}
    own, plain = T.Boosted(**args).fit(df), GBTClassifier(**args).fit(df)
    assert type(own) is GBTClassificationModel and own.treeWeights == plain.treeWeights
    for a, b in zip(own.trees, plain.trees, strict=True):
        assert a.numNodes == b.numNodes
        for x, y in zip(nodes(a), nodes(b), strict=True):
            assert x == y if "feature" in x else float(x) == pytest.approx(float(y), abs=1e-9)
    got, want = (m.transform(df).select("prediction", "probability").collect() for m in (own, plain))
    assert [r.prediction for r in got] == [r.prediction for r in want]
    assert all(a.probability[0] == pytest.approx(b.probability[0]) for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("seed,classes,depth,chunk", [(3, 2, 6, 1 << 21), (4, 3, 9, 7)])
def test_a_tree_on_all_rows_and_features_is_that_of_spark(spark, monkeypatch, seed, classes, depth, chunk):
    monkeypatch.setattr(T, "CHUNK", chunk)
    df = spark.createDataFrame(counts(seed, 400, classes), ["label", "features"]).repartition(3).cache()
    columns = T.columns_of(df, "label", "features", 32)
    (tree,) = T.forest(columns, 1, depth, 2, 0.0, 1)
    forest = T.Forest(numTrees=1, maxDepth=depth, minInstancesPerNode=2)
    kinds = tuple(f"org.apache.spark.ml.classification.{x}ClassificationModel" for x in ("RandomForest", "DecisionTree"))
    own = T._loaded(forest, RandomForestClassificationModel, T._saved(forest, [tree], [1.0], kinds, 41, {"numClasses": classes}, spark), spark)
    plain = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2).fit(df)
    assert nodes(own.trees[0]) == nodes(plain)
    got, want = (m.transform(df).select("prediction", "probability").collect() for m in (own, plain))
    assert [(r.prediction, pytest.approx(r.probability.toArray())) for r in want] == [(r.prediction, r.probability.toArray()) for r in got]


def test_a_forest_in_groups_of_trees_learns_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(T, "SMALL", 0)
    monkeypatch.setattr(T, "CELLS", 2500)
    df = spark.createDataFrame(counts(6, 500), ["label", "features"]).repartition(3).cache()
    first, again = (T.Forest(numTrees=12, maxDepth=8, minInstancesPerNode=2, seed=3).fit(df) for _ in range(2))
    assert len(first.trees) == 12 and first.toDebugString.splitlines()[1:] == again.toDebugString.splitlines()[1:]
    assert len({t.toDebugString.split("\n", 1)[1] for t in first.trees}) == 12  # other rows and features for each
    scored = first.transform(df)
    assert scored.where("prediction = label").count() > 1.3 * max(r["count"] for r in df.groupBy("label").count().collect())


def test_drawn_features_differ_within_a_node():
    import numpy as np

    drawn = T._drawn(np.random.default_rng(1), 500, 30, 20)
    assert all(len(set(row)) == 20 for row in drawn.tolist())
    assert np.bincount(drawn.reshape(-1), minlength=30).min() > 250


def test_values_below_zero_are_left_to_spark(spark, monkeypatch):
    monkeypatch.setattr(T, "SMALL", 0)
    df = spark.createDataFrame([(float(i % 2), Vectors.sparse(2, {0: i % 2 - 0.5})) for i in range(40)], ["label", "features"])
    assert T.Boosted(maxIter=2, maxDepth=2).fit(df).transform(df).where("prediction <> label").count() == 0


def test_the_classifier_fits_large_tables_by_columns(rows, monkeypatch):
    """Beyond ``SMALL`` rows neither the forest nor the boosted trees go to Spark ML's dense rows."""
    monkeypatch.setattr(T, "SMALL", 60)
    for kind in (T.RandomForestClassifier, T.GBTClassifier):
        monkeypatch.setattr(kind, "_fit", lambda self, dataset: pytest.fail("dense rows"))
    rng = random.Random(3)
    kinds = {"a": ["red", "green", "blue", "pink"], "b": ["pink", "iron", "tin", "blue"]}
    df = rows([(i, " ".join(rng.choices(kinds["ab"[i % 2]], k=6)), "ab"[i % 2]) for i in range(150)], "document_id long, text string, document_type string")
    found = X.fit_document_classifier(df, trees=5, depth=4, rounds=4, boost_depth=2, vocabulary=50)
    assert min(f.accuracy for f in found) > 0.8
    assert X.predict(df, found[0], "document_id").where("confidence >= 0.5").count() == 150
