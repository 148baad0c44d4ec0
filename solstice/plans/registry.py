"""Registry of the queries exposed by ``__spark_entry__`` and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from solstice.plans import views

Runner = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[views.Tables], DataFrame]], Callable]:
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` may use the views in ``views.SQL``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(views.Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prefix a statement with the view definitions it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in views.SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(views.SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({views.SQL[n].strip()})" for n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
