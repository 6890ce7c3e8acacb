import random
from itertools import combinations

import numpy as np
from data import SCHEMA, awkward, documents, words
from pyspark.sql import functions as F

from inkstream.llm import decontamination, neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int, id int, v int"


def brute(rows, k):
    usable = {}
    for key, vector, *_ in rows:
        if key is None or vector is None or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        if len(vector) == 4:
            usable[key] = np.array(vector, dtype=np.float32).astype(float)
    out = {}
    for q, v in usable.items():
        if q % 20 == 0:
            ranked = sorted((-float((v * w).sum()), key) for key, w in usable.items() if key != q)[:k]
            out[q] = [key for _, key in ranked]
    return out


def found(spark, rows, k=20, **more):
    df = spark.createDataFrame(rows, VECTORS)
    out = neighbours.search(df, lambda i: i % 20 == 0, k, **more).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(by[r["query_id"]])
    return by


def test_small_tables_are_searched_exactly(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)], 1, 2, 3) for i in range(200)]  # many equal vectors and ties
    rows += [(200, None, 1, 2, 3), (220, [0.0] * 4, 1, 2, 3), (240, [1.0, None, 1.0, 1.0], 1, 2, 3), (260, [float("nan")] * 4, 1, 2, 3)]
    rows += [(280, [float("inf"), 1.0, 1.0, 1.0], 1, 2, 3), (300, [], 1, 2, 3), (None, [1.0] * 4, 1, 2, 3), (320, [1.0] * 7, 1, 2, 3), rows[20]]
    for k in (20, 3, 500):
        assert found(spark, rows, k) == brute(rows, k)


def test_one_vector_for_a_third_of_the_rows(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(4)], 1, 2, 3) for i in range(400)]
    assert found(spark, rows) == brute(rows, 20)


def test_empty_and_lonely(spark):
    assert found(spark, []) == {}
    assert found(spark, [(20, [1.0, 1.0, 1.0, 1.0], 1, 2, 3)]) == {}


def test_recall_over_learned_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 4))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=4)).astype(np.float32).tolist(), 1, 2, 3) for i in range(3000)]
    got, exact = found(spark, rows, sample=1500), brute(rows, 20)
    recall = [len(set(got[q]) & set(e)) / len(e) for q, e in exact.items()]
    assert np.mean(recall) >= 0.9


def test_partitions_are_balanced():
    x = np.random.default_rng(4).normal(size=(600, 8))
    graph = neighbours.neighbour_graph(x, 10)
    label = neighbours.balanced_partitions(x, graph, 8)
    assert np.bincount(label, minlength=8).max() <= 83
    start = neighbours.balanced_partitions(x, graph, 8, rounds=0)
    assert (label[graph] == label[:, None]).mean() > (start[graph] == start[:, None]).mean()


ITEMS = "item_id bigint, text string, contaminated int"


def test_overlaps_with_and_without_substitutions(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    item = words(rng, 40, letters).split()
    short = words(rng, 7, letters)
    swapped = list(item)
    for i in range(3, 40, 7):
        swapped[i] = "else"
    other = list(item)
    for i in range(0, 40, 2):
        other[i] = "else"
    texts = [
        (1, words(rng, 50, letters) + " " + " ".join(item).upper() + " " + words(rng, 5, letters)), (2, " ".join(swapped)),
        (3, " ".join(other)), (4, words(rng, 300, letters)), (5, words(rng, 9, letters) + " " + short + "\n" + words(rng, 9, letters)),
        (6, " ".join(item[:30])), (7, " ".join(item[:12])), (8, None), (8, ""), (None, " ".join(item)),
    ]
    items = [(1, " ".join(item), 1), (2, " ".join(item), 1), (3, short, 1), (4, None, 1), (5, "", 1), (6, "a b", 1), (None, "x", 1)]
    docs = spark.createDataFrame(documents(None, [*texts, *[(100 + (k or 0), t) for k, t in awkward()]]), SCHEMA)
    bench = spark.createDataFrame(items, ITEMS)
    out = {r["doc_id"]: r for r in decontamination.digest(docs, bench).collect() if (r["doc_id"] or 0) < 100}
    assert {k for k, r in out.items() if r["contaminated"]} == {1, 2, 5, 6, None}
    assert out[1]["n_covered"] == 40 and out[1]["n_items"] == 2 and out[1]["best_item"] == 1 and out[1]["n_words"] == 95
    assert out[5]["best_item"] == 3 and out[5]["n_covered"] == 7
    spans = decontamination.find_overlaps(docs.where("doc_id = 1"), bench).collect()
    assert [(r["item_id"], r["start_word"], r["end_word"], r["n_equal"]) for r in sorted(spans)] == [(1, 50, 90, 40), (2, 50, 90, 40)]
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id < 100").count() == 5


def test_a_benchmark_in_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, words(rng, 25, "abcdefghijklmnopqrstuvwxyz"), 0) for i in range(30)]
    docs = spark.createDataFrame(documents(None, [(i, "start " + t + " end") for i, t, _ in items]), SCHEMA)
    bench = spark.createDataFrame(items, ITEMS)
    whole = decontamination.digest(docs, bench).orderBy("doc_id").collect()
    spans = decontamination.find_overlaps(docs, bench).orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert decontamination.digest(docs, bench).orderBy("doc_id").collect() == whole
    assert decontamination.find_overlaps(docs, bench).orderBy("doc_id").collect() == spans
    assert all(r["contaminated"] and r["best_item"] == r["doc_id"] for r in whole)
    none = bench.where(F.lit(False))
    assert decontamination.digest(docs, none).where("contaminated").count() == 0
    assert decontamination.find_overlaps(docs, none).count() == 0
    assert decontamination.digest(docs.where(F.lit(False)), bench).collect() == []


def test_masks_lose_no_placement_of_the_allowed_substitutions():
    for length in range(decontamination.SHORTEST, 31):
        wrong = length * 20 // 100
        if length > 20:
            length, wrong = 20, 4
        masks = [[j for j, bit in enumerate(m) if bit == "1"] for m in decontamination.masks_for(length, 80)]
        runs = [{o + j for j in m} for m in masks for o in range(length - m[-1])]
        assert all(any(r.isdisjoint(c) for r in runs) for c in combinations(range(length), wrong)), length


def test_every_fifth_word_and_random_words_substituted(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(n, words(rng, n, letters), 1) for n in (5, 6, 9, 10, 13, 15, 17, 19, 20, 33, 59)]
    texts = []
    for n, text, _ in items:
        for trial in range(25):
            swapped = text.split()
            size = min(n, 20)
            begin = rng.randint(0, n - size)
            for i in range(n):
                if not begin <= i < begin + size:
                    swapped[i] = "else"
            at = rng.sample(range(size), size // 5) if trial > 4 else list(range(trial, size, 5))[: size // 5]
            for i in at:
                swapped[begin + i] = "else"
            texts.append((1000 * n + trial, "before it " + " ".join(swapped) + " behind it"))
            swapped[begin + min(set(range(size)) - set(at))] = "else"  # one too many
            texts.append((1000 * n + 500 + trial, " ".join(swapped)))
    docs = spark.createDataFrame(documents(None, texts), SCHEMA)
    out = decontamination.digest(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["best_item"]) for r in out} == {(k, k // 1000) for k, _ in texts if k % 1000 < 500}
