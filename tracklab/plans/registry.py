"""Catalogue of runnable queries with their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklab.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def positive_zeros(df: DataFrame) -> DataFrame:
    """Turn -0.0 into 0.0, which compare equal but print differently."""
    doubles = {c: F.col(c) + F.lit(0.0) for c, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def positive_zeros_sql(sql: str) -> str:
    """The same for every rounded value of a twin."""
    out, n = [], 0
    while n < len(sql):
        word = sql.startswith("round(", n) and not (n and (sql[n - 1].isalnum() or sql[n - 1] == "_"))
        if not word:
            out.append(sql[n])
            n += 1
            continue
        depth, end = 0, n + len("round")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if depth == 0:
                break
        out.append(f"(round{positive_zeros_sql(sql[n + 5 : end])} + 0.0e0)")
        n = end
    return "".join(out)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a ``(spark, sf_dir) -> DataFrame`` callable, optionally with its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return positive_zeros(fn(spark, sf))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(views, positive_zeros_sql(sql))
        return fn

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def r9(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def d6(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


def d9(*names: str) -> str:
    return ", ".join(f'round("{n}", 9) AS "{n}"' for n in names)
