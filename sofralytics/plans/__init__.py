"""Adapter views, registered queries and the jobs composed from the operators."""

from __future__ import annotations

import importlib

QUERY_MODULES = (
    "scoring_queries",
    "cleaning_queries",
    "text_queries",
    "store_queries",
    "dictionary_queries",
    "sentiment_queries",
    "place_queries",
    "request_queries",
    "evaluation_queries",
    "search_queries",
    "similar_queries",
    "detail_queries",
    "page_queries",
)


def load_queries():
    """Import every query module and return the registry."""
    registry = importlib.import_module("sofralytics.plans.registry")
    for module in QUERY_MODULES:
        importlib.import_module(f"sofralytics.plans.{module}")
    return registry
