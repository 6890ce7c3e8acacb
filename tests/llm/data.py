"""Small documents with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row string, windows int, n_words int, component_id string"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(n))


def documents(rng, texts):
    return [(i, t, "en" if (i or 0) % 2 else "de", f"s{(i or 0) % 3}", None, "x", "y", 1, 2, "z") for i, t in texts]


def awkward(seed=1):
    """(doc_id, text) rows: nulls, empty and long texts, repeated rows and ids, copies, shared passages."""
    rng = random.Random(seed)
    base = words(rng, 120)
    passage = words(rng, 60)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"),
        (8, "two words"), (9, "two words"), (10, "Two WORDS"), (11, words(rng, 30) + " " + passage + " " + words(rng, 30)),
        (12, words(rng, 10) + "\n" + passage + "\n" + words(rng, 40)), (None, base), (None, None), (13, "Nd, " * 400),
        (14, "Nd, " * 300), (15, words(rng, 3000)), (16, "é ñ ü 日本 😀 " * 30), (17, "x" * 900), (18, "x" * 500),
        (19, words(rng, 49)), (20, words(rng, 50)), (21, base.upper()), (22, words(rng, 80) + " " + base),
    ]
    return texts


def shuffled(rows, seed=2):
    out = list(rows)
    random.Random(seed).shuffle(out)
    return out
