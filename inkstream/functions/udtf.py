"""SQL-callable validation of one row: a small table function for interactive use.

Bulk validation belongs to ``operators.quality.RuleSet``, which stays in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Validate:
    """``validate(row_json, rules_json)``: one result per rule.

    Rules are ``{"field", "rule", ...}`` with the row rules of ``RuleSet`` that need no SQL:
    required, data_type (number), format (values), range (min/max), pattern (regex).
    """

    def eval(self, row: str, rules: str) -> Iterator[tuple[str, str, bool]]:
        values = json.loads(row)
        for rule in json.loads(rules):
            yield rule["field"], rule["rule"], self._passes(values.get(rule["field"]), rule)

    @staticmethod
    def _passes(value: object, rule: dict) -> bool:
        kind = rule["rule"]
        if kind == "required" or value is None:
            return value is not None or kind != "required"
        if kind == "format":
            return value in rule["values"]
        if kind == "pattern":
            return re.search(rule["regex"], str(value)) is not None
        try:
            number = float(str(value))
        except ValueError:
            return False
        return rule.get("min", number) <= number <= rule.get("max", number)


def register(spark: SparkSession, name: str = "validate") -> None:
    spark.udtf.register(name, udtf(Validate, returnType="field_name STRING, rule_type STRING, passed BOOLEAN"))
