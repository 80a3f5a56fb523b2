"""Named queries over the given tables, each beside the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """A named subquery that oracle statements may use; define in dependency order."""
    CTES[name] = body.strip()


def _needed(text: str) -> list[str]:
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"\b[a-z_][a-z0-9_]*\b", sql)):
            if word in CTES and word not in seen:
                seen.add(word)
                visit(CTES[word])

    visit(text)
    return [n for n in CTES if n in seen]


def statement(sql: str) -> str:
    """One SQL statement with every named subquery it reaches."""
    names = _needed(sql)
    if not names:
        return sql.strip()
    heads = []
    for n in names:
        body = CTES[n]
        columns = ""
        if body.startswith("("):  # explicit column list, as recursive parts need
            columns, body = body.split(")", 1)
            columns += ")"
            body = body.strip()
        heads.append(f"{n}{columns} AS ({body})" if columns else f"{n} AS MATERIALIZED ({body})")
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    rest = ",\n" + sql[own.end():].strip() if own else "\n" + sql.strip()
    return "WITH RECURSIVE " + ",\n".join(heads) + rest


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = statement(sql)
        return fn

    return add


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def settled(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Round values that often end in an exact half (means of cents): moved a little above the
    half first, so that both engines go the same way."""
    nudge = 10.0 ** -(places + 3)
    return df.withColumns({n: F.round(F.col(n) + nudge, places) for n in names})
