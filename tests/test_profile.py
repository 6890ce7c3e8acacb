"""Profiles from one exchange of hashed values against plain statistics."""

import math
import random
import re
from collections import Counter
from statistics import median, stdev

import pytest

from inkstream.operators import quality as Q


def plain(values, kind):
    known = [v for v in values if v is not None]
    counts = Counter(known)
    out = {"non_null_count": len(known), "null_count": len(values) - len(known), "unique_count": len(counts)}
    number, text = kind in ("int", "double"), kind == "string"
    out["mean"] = sum(known) / len(known) if number and known else None
    out["median"] = median(known) if number and known else None
    out["std"] = stdev(known) if number and len(known) > 1 else None
    out["min"], out["max"] = (min(known), max(known)) if number and known else (None, None)
    top = min(((-n, v) for v, n in counts.items()), default=(0, None)) if text else (None, None)
    out["most_common"], out["most_common_count"] = top[1], -top[0] if text else None
    out["avg_length"] = sum(map(len, known)) / len(known) if text and known else None
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_every_column_equals_plain_statistics(rows, n):
    rng = random.Random(n)
    data = [
        (
            rng.choice([None, rng.randint(-5, 5)]), rng.choice([None, rng.uniform(0, 1), 0.5]), rng.choice([None, "", "é", "aa", "b" * 2000]),
            None, rng.random() < 0.5, None,
        )
        for _ in range(n)
    ]
    schema = "a int, `b.c` double, t string, nothing string, flag boolean, pairs map<string,int>"
    found = {r.column_name: r for r in Q.profile(rows(data, schema).repartition(3), rounded=False).collect()}
    kinds = {"a": "int", "b.c": "double", "t": "string", "nothing": "string", "flag": "boolean", "pairs": "map"}
    assert list(sorted(found)) == sorted(kinds)
    for i, (name, kind) in enumerate(kinds.items()):
        for column, want in plain([r[i] for r in data], kind).items():
            got = found[name][column]
            assert got == (pytest.approx(want) if isinstance(want, float) and not math.isnan(want) else want), (name, column)


def test_one_scan_and_no_text_in_a_key(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = Q.value_counts(table)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan parquet", plan)) == 1
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 1 and {re.sub(r"#\w+", "", k) for k in keys[0].split(", ")[:3]} == {"c", "one", "two"}
