import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from data import SCHEMA, awkward, documents, shuffled
from tokenizers import Tokenizer

from inkstream.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    "It's we'll THEY'D don't 's 'tis ''s", "a,b. c,. d., e ,f . g,\nh.\ti.", "x\x0by\x0cz\rw\x1cq\x85r s t u", "H̱ ẖ ́ á,̧ .́ Å",
    "각 ᅡ 한글", "ΣΑΣ σς İIı ǅ", "<|startoftext|>a<|endoftext|> b<|endoftext|>", "<|endo ftext|>",
    "12 345 6.7, 8", "Ⅷ½٣", "\U0001f600‍\U0001f600 ﬁ", "\u0000\u0001 \u0007x", "  lead  and trail  ", "it's, they're. X'S.",
]


def test_words_give_the_ids_of_the_library():
    rng = random.Random(4)
    letters = "abAB'.,;1ȩ́́ \n\t\x0b ​中😀<|>ſKÅ가"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    encoder = packing.WordEncoder(PATH, memory=2000)
    assert encoder.cuts
    for first in range(0, len(texts), 500):
        part = texts[first : first + 500]
        got = [np.frombuffer(i, dtype="<u4").tolist() for i in encoder.encode(part)]
        assert [[*g, 1] for g in got] == [library_ids(t) for t in part]


def test_files_without_the_proof_are_encoded_whole():
    encoder = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.cuts
    text = "two words,  and\nmore"
    assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_differencing_known_cases():
    sums = lambda sizes, k: sorted(sum(sizes[i] for i in p) for p in packing.difference(sizes, k))
    assert sums([8, 7, 6, 5, 4], 2) == [14, 16]  # the textbook case: differencing ends at 2
    assert sums([5, 5, 5, 5], 2) == [10, 10]
    assert sums([10, 9, 8, 7, 6, 5], 3) == [15, 15, 15]
    assert sums([3], 4) == [3] and packing.difference([], 3) == []


def plain_difference(sizes, k):
    """The same differencing on full vectors."""
    parts = [([s, *[0] * (k - 1)], i) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: (min(p[0]) - max(p[0]), p[1]))
        (a, i), (b, j), *rest = parts
        parts = [*rest, (sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), min(i, j))]
    return sorted(parts[0][0])


@pytest.mark.parametrize("seed", range(5))
def test_differencing_of_random_sizes(seed):
    rng = random.Random(seed)
    for _ in range(60):
        k, sizes = rng.randint(2, 9), [rng.randint(1, 400) for _ in range(rng.randint(1, 40))]
        parts = packing.difference(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        got = sorted(sum(sizes[i] for i in p) for p in parts)
        assert [0] * (k - len(got)) + got == plain_difference(sizes, k)


def test_the_window_count_rises_when_capacity_is_exceeded():
    sizes = [7, 7, 7]  # the sum needs three windows of 8, and no two items share one
    assert len(packing.near_equal(sizes, 8)) == 3
    sizes = [6, 6, 6, 6]  # the sum needs three windows of 8, the items four
    assert sorted(len(p) for p in packing.near_equal(sizes, 8)) == [1, 1, 1, 1]
    rng = random.Random(1)
    sizes = [rng.randint(1, 2047) for _ in range(128)]
    parts = packing.near_equal(sizes, 2048)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) <= 2048 and min(sums) > 1700 and len(parts) <= 1.1 * sum(sizes) / 2048 + 1


def check_pieces(rows, texts, capacity=2048, end=1):
    """Pieces cover every document once and every sequence without a gap, and only powers of two are short."""
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    expected = {}
    for k, t in texts:
        expected.setdefault(k, []).append(library_ids(t)[:-1] + [end])
    assert by_document.keys() == expected.keys()
    for k, own in by_document.items():
        if len(expected[k]) == 1:
            ids, at = expected[k][0], 0
            for r in sorted(own, key=lambda r: r["start"]):
                assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
                at += r["length"]
                assert r["ids_crc32"] == crc32(np.array(ids[r["start"] : at], dtype="<u4").tobytes())
            assert at == len(ids)
        else:
            assert sum(r["length"] for r in own) == sum(map(len, expected[k]))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


@pytest.mark.parametrize("parts", [1, 3])
def test_rows(spark, parts):
    rows = shuffled(awkward())
    df = spark.createDataFrame(documents(None, rows), SCHEMA).repartition(parts)
    check_pieces(packing.digest(df, PATH).collect(), rows)
    got = packing.pack(df, PATH, end=49407, capacity=64).collect()
    assert sum(r["length"] for r in got) == sum(len(library_ids(t)) for _, t in rows)
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)


def test_supplied_documents_have_no_padding(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.digest(df, PATH).collect()
    check_pieces(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    pieces = len(rows) / df.count()
    assert pieces < 3 and packing.digest(df.limit(0), PATH).collect() == []
