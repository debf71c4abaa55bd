"""The register of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The observation view in DuckDB's SQL, before every statement.
VIEW = """
WITH day_obs AS (
  SELECT user_id AS track, date_diff('day', DATE '1950-01-01', CAST(ts AS DATE)) AS time, count(*) AS nb, max(value) AS amplitude
  FROM events GROUP BY 1, 2),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY track ORDER BY time) - 1 AS INTEGER) AS n FROM day_obs),
obs AS (
  SELECT track * 100000 + n AS obs_id, track, CAST(time AS INTEGER) AS time, nb, amplitude, n,
    ((track * 29) % 96) * 0.25e0 + (time - 27028) * 0.125e0 AS lon,
    -8e0 + ((track * 13) % 64) * 0.25e0 + nb * 0.0625e0 AS lat,
    20000e0 + 2500e0 * nb AS radius_s
  FROM numbered)
"""
#: Great-circle metres in SQL between {a} and {b}.
METRES = "2 * 6370997.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def query(name: str, sql: str | None = None, view: bool = True):
    """Register a query under `name`, with the equal SQL if SQL can state it; view: it reads the observation view."""

    def add(f):
        QUERIES[name] = f
        if sql:
            if view:
                ORACLE[name] = VIEW.rstrip() + (", " + sql if not sql.lstrip().upper().startswith("SELECT") else " " + sql)
            else:
                ORACLE[name] = sql
        return f

    return add
