import random
import struct
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from data import SCHEMA, awkward, documents

from inkstream.llm import pieces, sentencepiece_codec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = [
    "a", "b", " ", "  ", "\n", "▁", "\t", "é", "日", "\x00", "<s>", "the", " the", "\r", "ing", "!", "\n\n", "😀", "<0x0A>",
    "   ", "</s>", "<unk>", "ﬁ", "é",
]


def texts(n=4000, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 9))) for _ in range(n)]


def test_counts_equal_the_library():
    counter = token_counts.PretokenCounter(MODEL, memory=20_000)
    some = texts()
    assert counter.count(some) == [len(i) for i in counter.library.encode(some)]
    assert counter.splits and len(counter.proven) > 10_000


def test_counts_of_awkward_rows(spark):
    rows = awkward()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame(documents(None, rows), SCHEMA)
    got = Counter(tuple(r) for r in token_counts.token_counts(df, MODEL, limit=500).collect())
    counts = [(k, len((t or "").encode()), len(library.encode(t or ""))) for k, t in rows]
    assert got == Counter((*c, c[2] > 500) for c in counts)
    assert token_counts.token_counts(df.where("doc_id < 0"), MODEL).collect() == []


def test_codec_equals_the_library_and_decodes(spark):
    rows = [*awkward(), *enumerate(texts(500), start=1000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = sentencepiece_codec.encode(spark.createDataFrame(documents(None, rows), SCHEMA), MODEL)
    got = Counter((r["doc_id"], tuple(r["token_ids"]), r["n_tokens"]) for r in encoded.collect())
    assert got == Counter((k, tuple(i := library.encode(t or "")), len(i)) for k, t in rows)
    assert encoded.where("NOT (parity AND round_trip)").count() == 0
    decoded = Counter(tuple(r) for r in sentencepiece_codec.decode(encoded, MODEL).collect())
    assert decoded == Counter((k, (t or "").replace("▁", " ")) for k, t in rows)


def test_memory_that_starts_anew():
    with open(MODEL, "rb") as file:
        codec = sentencepiece_codec.Codec(file.read(), memory=300)
    for first in range(0, 1000, 100):
        some = texts(1000)[first : first + 100]
        ids, sizes, parity, again = codec.encode(some)
        assert ids.tolist() == [i for t in some for i in codec.library.encode(t)]
        assert all(parity) and all(again) and sizes.sum() == len(ids)


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def _message(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def unigram_model():
    """A unigram model file written by hand, with byte fallback and squeezed spaces."""
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    listed += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    listed += [("▁", -3.0, 1), ("▁a", -2.0, 1), ("▁ab", -2.5, 1), ("a", -3.5, 1), ("b", -3.6, 1), ("ab", -4.0, 1), ("ba", -4.1, 1), ("c", -5.0, 1), ("abc", -6.5, 1)]
    data = b"".join(
        _message(1, _message(1, t.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _varint(3 << 3) + _varint(k))
        for t, s, k in listed
    )
    trainer = _varint(3 << 3) + _varint(1) + _varint(35 << 3) + _varint(1)
    normaliser = _message(1, b"identity") + b"".join(_varint(n << 3) + _varint(1) for n in (3, 4, 5))
    return data + _message(2, trainer) + _message(3, normaliser)


def test_a_unigram_model_is_rebuilt_too():
    codec = sentencepiece_codec.Codec(unigram_model())
    model = pieces.parse_model(unigram_model())
    assert model.kind == pieces.UNIGRAM and model.byte_fallback and model.squeeze_spaces and not codec.splits
    rng = random.Random(8)
    some = ["".join(rng.choices(["a", "b", "c", " ", "  ", "é", "abc"], k=rng.randint(0, 12))) for _ in range(500)]
    ids, sizes, parity, _ = codec.encode(some)
    assert all(parity)
    assert ids.tolist() == [i for t in some for i in codec.library.encode(t)] and sizes.sum() == len(ids)


def test_a_file_without_pieces_is_refused():
    with pytest.raises(ValueError):
        pieces.parse_model(b"")
