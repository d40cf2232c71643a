"""Registry of runnable queries.

A query is registered with the columns it returns, the Spark plan, and an independent SQL body for
the same answer. The column list drives one shared output convention on both sides: dates and
times as text (d, t), doubles rounded to a number of digits (f6) or raw where they are copied or a
single division (r), counts as long (i), flags (b), text by default.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    spec: str
    run: Callable
    sql: str | None


QUERIES: dict[str, Query] = {}


def _cols(spec: str):
    for item in spec.split():
        name, _, kind = item.partition(":")
        yield name, kind or "s"


def finish(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _cols(spec):
        c = F.col(f"`{name}`")
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "r":
            c = c.cast("double")
        elif kind.startswith("f"):
            r = F.round(c.cast("double"), int(kind[1:] or 6))
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        out.append(c.alias(name))
    return df.select(*out)


def finish_sql(body: str, spec: str) -> str:
    out = []
    for name, kind in _cols(spec):
        q = f'"{name}"'
        if kind == "d":
            e = f"strftime(CAST({q} AS DATE), '%Y-%m-%d')"
        elif kind == "t":
            e = f"strftime({q}, '%Y-%m-%d %H:%M:%S')"
        elif kind == "i":
            e = f"CAST({q} AS BIGINT)"
        elif kind == "b":
            e = f"CAST({q} AS BOOLEAN)"
        elif kind == "r":
            e = f"CAST({q} AS DOUBLE)"
        elif kind.startswith("f"):
            n = int(kind[1:] or 6)
            r = f"round(CAST({q} AS DOUBLE), {n})"
            e = f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END"
        else:
            e = f"CAST({q} AS VARCHAR)"
        out.append(f"{e} AS {q}")
    return f"WITH {body.strip()}\nSELECT {', '.join(out)} FROM out"


def register(name: str, covers: str, spec: str, sql: str | None = None):
    """`sql` is a list of CTEs whose last one is called `out`."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark, sf):
            from . import base
            base.new_run()
            return finish(fn(spark, sf), spec)
        QUERIES[name] = Query(name, covers, spec, run,
                              None if sql is None else finish_sql(sql, spec))
        return fn
    return wrap
