"""Collects the named queries of the library's plans, each with the SQL that states the same result."""

from __future__ import annotations

from lumenfare.plans import catalog, collaborative, documents, extras, features, hybrid, ingest, landing, notices, pages, pairwise, places, recommend, requests, streams, texts, training, vectors  # noqa: F401
from lumenfare.plans.query import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
