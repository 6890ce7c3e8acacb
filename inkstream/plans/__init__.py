"""Registered queries: each operator over the supplied tables, with its reference SQL."""

from inkstream.plans.registry import REGISTRY, Query
from inkstream.plans import etl, events, metrics, models, quality, relational, scoring, sinks, streaming, text, windows  # noqa: F401

__all__ = ["REGISTRY", "Query"]
