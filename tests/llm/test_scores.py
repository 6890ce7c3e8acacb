import random
import zlib

import pyarrow as pa
import pytest
from conftest import SMALL
from data import SCHEMA, awkward, documents
from pyspark.sql import functions as F

from inkstream.llm import language_id, quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def held(key, divisor, fold):
    return key is not None and zlib.crc32(str(key).encode()) % divisor == fold


def corpus(seed=1, rows=600):
    """(doc_id, text, lang, quality, toxic): two languages; bad texts shout, toxic ones hold one of two words."""
    rng = random.Random(seed)
    stems = {"en": ["the", "and", "ing", "tion", "er", "re", "on", "th"], "de": ["und", "ein", "sch", "keit", "ung", "zu", "ver", "ge"]}
    out = []
    for i in range(rows):
        lang = rng.choice(["en", "de"])
        words = ["".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 120))]
        bad, toxic = int(rng.random() < 0.3), int(rng.random() < 0.25)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "clown"])
        if bad:
            words = [w.upper() + "!!" for w in words]
        out.append((i, " ".join(words), lang, 1 - bad, toxic))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    extra = [(10_000 + i, t) for i, (_, t) in enumerate(awkward())] + [(None, "the idiot"), (None, None)]
    docs = [(i, t, lang, "s", None, "x", "y", 1, 2, "z") for i, t, lang, _, _ in rows]
    docs += [(i, t, None, "s", None, "x", "y", 1, 2, "z") for i, t in extra]
    labels = [(i, q, x) for i, _, _, q, x in rows] + [(rows[0][0], rows[0][3], rows[0][4]), (None, 1, 1), (77_777, 0, 1), (5, None, None)]
    return rows, spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, LABELS).cache()


def test_languages(learned):
    rows, docs, _ = learned
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    right = [by[i]["lang_pred"] == lang for i, _, lang, _, _ in rows if held(i, 4, 2)]
    assert sum(right) >= 0.98 * len(right)
    assert all(by[i]["held_out"] == held(i, 4, 2) for i, *_ in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        letters = any(c.isalpha() for c in texts.get(r["doc_id"]) or "") if r["doc_id"] is not None else None
        if letters is not None:
            assert (r["lang_pred"] == "und") == (not letters)
        assert 0 <= r["score"] <= 1


def test_rejected_documents_have_no_letter_or_no_known_one(learned, spark):
    _, docs, _ = learned
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns
    gone = docs.exceptAll(kept).collect()
    assert gone and all(not set(r["text"] or "") & set("abcdefgh") for r in gone)


def test_profiles_by_brute_force(spark):
    docs = spark.createDataFrame([(1, "Ab a!", "x"), (2, "ab", "x"), (3, "é1é", "y"), (4, None, "y"), (5, "zz", None)], "doc_id bigint, text string, lang string")
    found = language_id.fit(docs, F.lit(True))
    assert found.languages == ["x", "y"]
    # x: a b a a b / _a ab b_ _a a_ _a ab b_ / _ab ab_ _a_ _ab ab_ as 1-, 2-, 3-grams; ranks by count
    texts = pa.array(["ab a ab", "é", "12", None, ""])
    best, scores = language_id.score_texts(texts, found)
    assert best.tolist() == [0, 1, -1, -1, -1]
    assert scores[0] > 0.95 and scores[2] == 0


def test_no_learning_rows(learned, spark):
    _, docs, labels = learned
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in language_id.identify(none).select("lang_pred").distinct().collect()} == {"und"}
    empty = labels.where("doc_id < 0")
    assert {r[0] for r in quality.quality_scores(docs, empty).select("score").distinct().collect()} == {0.5}
    assert toxicity.toxicity_scores(docs, empty).select("predicted").distinct().collect()[0][0] == 0
    nothing = docs.where("doc_id < -1")
    assert language_id.identify(nothing).collect() == []
    assert quality.quality_scores(nothing, labels).collect() == []
    assert toxicity.toxicity_scores(nothing, labels).collect() == []


def accuracy(got, rows, which, divisor, fold):
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    hits = [by[r[0]]["predicted"] == r[which] for r in rows if held(r[0], divisor, fold)]
    assert all(by[r[0]]["held_out"] == held(r[0], divisor, fold) for r in rows)
    return sum(hits) / len(hits)


def test_quality(learned):
    rows, docs, labels = learned
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, rows, 3, 5, 0) > 0.95


def test_toxicity(learned):
    rows, docs, labels = learned
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == docs.count() and accuracy(got, rows, 4, 4, 2) > 0.95


def test_disguised_words_are_restored(learned):
    _, docs, labels = learned
    counts = toxicity.character_counts(docs)
    restorer = toxicity.Restorer(counts)
    assert restorer.tokens("you i d i o t now") >= {"idiot", "you", "now"}
    for seen in ("1d10t", "id!ot", "i.d.i.o.t", "idiooot", "IDIOT!!".lower(), "i-d-i-0-t", "iiidiot", "(idiot)", "cl0wn", "c|own"):
        assert {"idiot", "clown"} & set(restorer.words(seen)), seen
    for plain in ("the", "tion", "zu", "keit"):
        assert restorer.words(plain) == [plain]


def test_disguised_documents_score_high(learned, spark):
    _, docs, labels = learned
    model = toxicity.fit(docs, labels, F.col("doc_id").isNotNull())
    texts = ["the 1d10t and", "the c l o w n er", "and id!ot", "the and tion", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["predicted"] for r in toxicity.score(df, model).orderBy("doc_id").collect()] == [1, 1, 1, 0, 0, 0]


def test_words_parted_by_spaces_and_long_disguises(learned, spark):
    _, docs, labels = learned
    restorer = toxicity.Restorer(toxicity.character_counts(docs))
    for seen in ("the i d i o t ing", "tion a i d i o t keit", "i. d. i. o. t.", "ge on re i d i o t zu er", "und " * 90 + "i d i o t " + "zu " * 90):
        assert "idiot" in restorer.tokens(seen), seen
    assert "idiot" in restorer.words("i" * 100 + "d" + "i" * 30 + "ot")
    assert len(restorer.words("ab1" * 30_000)) == 2
    model = toxicity.fit(docs, labels, F.col("doc_id").isNotNull())
    texts = ["the id iot and", "er c lo wn er", "the i. d. i. o. t. on", "und " + "i" * 90 + "diot", "on re a cl own", "the in er on and", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["predicted"] for r in toxicity.score(df, model).orderBy("doc_id").collect()] == [1, 1, 1, 1, 1, 0, 0]


@pytest.mark.parametrize("name", ["op5_toxicity", "op7_quality", "op10_language_id"])
def test_held_out_accuracy_on_the_small_tables(spark, name):
    from inkstream.llm.queries import QUERIES

    out = QUERIES[name](spark, SMALL)
    if name == "op10_language_id":
        truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
        right = out.where("held_out").join(truth, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
        assert right.first()[0] > 0.9
    else:
        assert out.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_toxicity_slices_equal_single_texts(monkeypatch):
    """Tokens, pairs and groups found by array steps are those of one text after the other."""
    rng = random.Random(4)
    counts = {"  i": 9, " id": 9, "idi": 9, "dio": 9, "iot": 9, "ot ": 9, "  s": 5, " st": 5, "stu": 5, "tup": 5, "upi": 5, "pid": 5, "id ": 5}
    evidence = {"idiot": 3.0, "stupid": 2.0, "stup*": 1.0, "id": 0.5, "été": 0.7}
    pieces = ["id", "iot", "st", "u", "pid", "stu", "a", "the", "-", "...", "i", "d", "o", "t", "1d10t", "(id)", "été", "ID,", "longer", "iiidiot", "𝒳", "İ"]
    gaps = [" ", "\n", " ", "  ", "\t", "\x1f"]
    texts = ["", " ", "id", "i d i o t " * 40]
    texts += ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    plain = toxicity.Scorer(counts, evidence)
    want = [{w for w in plain.restorer.tokens(t) if plain.weights[w]} for t in texts]
    assert toxicity.Scorer(counts, evidence).words(texts) == want
    monkeypatch.setattr(toxicity, "SLICE", 100)
    monkeypatch.setattr(toxicity, "HASHES", 5)
    monkeypatch.setattr(toxicity, "MEMORY", 8)
    small = toxicity.Scorer(counts, evidence)
    assert small.matrix(pa.array([*texts, None])).tolist() == [list(plain.features(w)) for w in [*want, set()]]
