"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inputs as i

HOUR, DAY, START = i.HOUR_US, i.DAY_US, i.EPOCH_US
END = START + 30 * DAY - 1
Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f: Q) -> Q:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries of the name {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def over_changes(sql: str) -> str:
    return f"WITH {i.CHANGE_CTE}{sql}" if sql.lstrip().startswith(",") else f"WITH {i.CHANGE_CTE}\n{sql}"


def over_slow(sql: str) -> str:
    return f"WITH {i.SLOW_CTE}{sql}" if sql.lstrip().startswith(",") else f"WITH {i.SLOW_CTE}\n{sql}"
