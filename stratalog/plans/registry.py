"""Registry of runnable queries, each with the equivalent SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from stratalog.plans.standins import STANDINS, StandIns, duckdb_text


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[StandIns], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of the tables under its own name."""

    def register(run: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
        QUERIES[run.__name__] = Query(run.__name__, run, sql)
        return run

    return register


def oracle_text(sql: str) -> str:
    """The SQL with the derived tables it names put in front as common table expressions."""
    used = [n for n in STANDINS if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f'"{n}" as ({duckdb_text(n)})' for n in used)
    body = sql.strip()
    recursive = re.match(r"with\s+recursive\s+", body, re.I)
    plain = re.match(r"with\s+", body, re.I)
    head = "with recursive " if recursive else "with "
    if not used:
        return body
    if recursive or plain:
        return f"{head}{ctes},\n{body[(recursive or plain).end():]}"
    return f"{head}{ctes}\n{body}"
