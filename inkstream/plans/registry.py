"""Registry of named queries with their reference SQL.

A query is a callable ``(spark, folder) -> DataFrame``; its SQL runs on another engine over
the same tables and must give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from inkstream.plans.oracle_views import VIEWS
from inkstream.sources.views import Tables

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    digits: Mapping[str, int]


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: Mapping[str, int], default: int) -> DataFrame:
    """Round every floating-point column, so that summation order does not show."""
    return df.select(
        *[
            F.round(f.name, digits.get(f.name, default)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def with_views(sql: str, views: Iterable[str], digits: dict[str, int]) -> str:
    """Prepend the view definitions (and what they need) as common table expressions."""
    names: list[str] = []

    def add(name: str) -> None:
        needs, _ = VIEWS[name]
        for other in needs:
            add(other)
        if name not in names:
            names.append(name)

    for name in views:
        add(name)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in names]  # a view may have its own WITH
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        ctes.append(body.rsplit("\n---\n", 1)[0].strip().rstrip(","))
        body = body.rsplit("\n---\n", 1)[1]
    if digits:
        fixed = ", ".join(f"round(CAST({c} AS DOUBLE), {d}) AS {c}" for c, d in digits.items())
        body = f"SELECT * REPLACE ({fixed}) FROM ({body}) AS q"
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(
    name: str,
    sql: str | None = None,
    views: Iterable[str] = (),
    floats: Iterable[str] = (),
    digits: int = 9,
    same_as: str | None = None,
) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query.  ``floats`` are the columns both sides round to ``digits``.

    An entry ``"col:2"`` rounds that column to its own number of digits.  SQL with common
    table expressions ends them with a line ``---``.  ``same_as`` takes SQL and digits of
    another query that must give the same rows.
    """
    places = dict(REGISTRY[same_as].digits) if same_as else {}
    for entry in floats:
        col, _, own = entry.partition(":")
        places[col] = int(own) if own else digits

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(build(Tables(spark, folder)), places, digits)

        text = with_views(sql, views, places) if sql else None
        if same_as:
            text = REGISTRY[same_as].sql
        REGISTRY[name] = Query(name, run, text, places)
        return build

    return register
