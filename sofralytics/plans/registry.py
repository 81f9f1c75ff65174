"""Registered queries: a Spark builder and, where SQL can say it, the equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sofralytics.functions.text import ACCENTED, WHITESPACE
from sofralytics.plans.adapters import VIEW_SQL, Tables

BUILDERS: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the named adapter views.

    ``sql`` starts with SELECT, or with a comma and further common table expressions.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in BUILDERS:
            raise ValueError(f"query {name} registered twice")
        BUILDERS[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            text = with_views(views, sql)
            ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return fn

    return wrap


def with_views(views, body: str) -> str:
    """The body preceded by the views it names and the views those need."""
    ordered: list[str] = []

    def visit(view: str) -> None:
        needs, _ = VIEW_SQL[view]
        for need in needs:
            if need in VIEW_SQL:
                visit(need)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        visit(view)
    body = body.strip()
    if not ordered:
        return body if not body.startswith(",") else "WITH " + body.lstrip(", \n")
    parts = []
    for view in ordered:
        needs, text = VIEW_SQL[view]
        for need in needs:
            text = text.replace("{" + need + "}", need)
        parts.append(f"{view} AS ({text})")
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(expr: str, digits: int) -> str:
    """SQL twin of ``functions.numeric.round_to``."""
    scale = float(10**digits)
    return f"(floor(CAST({expr} AS DOUBLE) * {scale:.1f} + 0.5 + 0.000001) / CAST({scale:.1f} AS DOUBLE))"


def stripped(expr: str) -> str:
    """SQL twin of ``functions.text.strip``."""
    return f"trim({expr}, '{WHITESPACE}')"


def search_key(expr: str) -> str:
    """SQL twin of ``functions.text.search_key``."""
    return stripped(f"lower(translate({expr}, '{''.join(ACCENTED)}', '{''.join(ACCENTED.values())}'))")


def strings(values) -> str:
    """A DuckDB list literal."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
