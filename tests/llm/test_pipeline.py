import importlib
import random
from collections import Counter

from conftest import SMALL
from data import SCHEMA, awkward, documents, shuffled, words

import corpus_pipeline as C
from inkstream.llm import decontamination, language_id, ngram_join


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        before = docs.count()
        docs = C.cut_lineage(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        assert docs.count() <= before
    groups = ngram_join.similar_groups(docs, n=5, percent=80)
    assert docs.select("doc_id").distinct().count() == docs.count() == groups.count()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontamination.digest(docs, bench).where("contaminated").count() == 0
    assert language_id.accepted(docs).count() == docs.count()
    out = C.STAGES[-1][1](spark, docs, SMALL)
    assert out.where("NOT (parity AND round_trip)").count() == 0 and out.count() == docs.count()


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in C.STAGES:
        docs = C.cut_lineage(stage(spark, docs, SMALL))
    assert Counter(r["doc_id"] for r in C.run(spark, SMALL).collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_awkward_rows_pass_every_stage(spark):
    rows = awkward()
    docs = spark.createDataFrame(documents(None, rows), SCHEMA)
    kept = C.drop_near_copies(spark, docs, SMALL)
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(ids)[None] == 2 and max(Counter(i for i in ids if i is not None).values()) == 1
    assert {4, 5, 6, 1, 7, 8} <= set(ids) and not {2, 9, 10, 21} & set(ids)
    assert kept.columns == docs.columns
    for _, stage in C.STAGES:
        docs = C.cut_lineage(stage(spark, docs, SMALL))
        assert docs.count()


def test_repeated_ids_with_different_texts_are_judged_by_row(spark):
    rng = random.Random(8)
    first, second, third, fourth = (words(rng, 60, "abcdefghijklmnopqrstuvwxyz") for _ in range(4))
    near = first + " end"
    rows = documents(None, [(1, first), (5, near), (5, second), (5, third), (7, fourth), (7, fourth), (7, fourth + " z"), (8, ""), (None, first)])
    rows[5] = (*rows[5][:3], "a source that comes first", *rows[5][4:])
    kept = C.drop_near_copies(spark, spark.createDataFrame(shuffled([*rows, rows[3]]), SCHEMA), SMALL)
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in kept.collect())
    wanted = [rows[i] for i in (0, 2, 3, 5, 7, 8)]
    assert got == Counter((r[0], r[1], r[3]) for r in wanted)


def test_empty_documents_pass_every_stage(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = [n.split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert set(names) >= {f"op{n}" for n in range(1, 11)} and "pipeline" in entry.queries()
    assert [n for n, _ in C.STAGES] == ["language_id", "ngram_join", "substring_dedup", "decontamination", "sentencepiece"]
