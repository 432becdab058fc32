"""Registry of the queries over the given tables and of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.plans.bindings import BASE, TABLES

Query = Callable[["Tables"], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the given tables and to the relations derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self._spread(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
            elif name in BASE:
                sql = BASE[name]
                args = {dep: getattr(self, dep) for dep in relations_in(sql)}
                text = re.sub(r"\b(" + "|".join(args) + r")\b", r"{\1}", sql)
                self._cache[name] = self.spark.sql(text, **args)
            else:
                raise AttributeError(name)
        return self._cache[name]


    def _spread(self, name: str, df: DataFrame) -> DataFrame:
        """Spread a large table that is stored in fewer splits than there are cores.

        A single small file is one scan task, and everything up to the first
        shuffle would run on one core. A table with enough splits is left alone.
        """
        cores = self.spark.sparkContext.defaultParallelism
        if name in SPREAD and df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        return df


SPREAD = ("lineitem", "orders", "documents", "events")

_NAME = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", re.IGNORECASE)


def relations_in(sql: str) -> list[str]:
    found = [n for n in _NAME.findall(sql) if n in BASE or n in TABLES]
    return list(dict.fromkeys(found))


def _ctes(sql: str, done: dict[str, str]) -> None:
    for name in relations_in(sql):
        if name in BASE and name not in done:
            _ctes(BASE[name], done)
            done[name] = BASE[name]


def with_base(sql: str) -> str:
    """Prepend the derived relations a statement reads, as common table expressions."""
    done: dict[str, str] = {}
    _ctes(sql, done)
    if not done:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({body.strip()})" for name, body in done.items())
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_base(sql)
        return fn

    return keep


def sql_case(expr: str, table: dict, default: str = "NULL") -> str:
    """``CASE expr WHEN k THEN v`` for both SQL dialects."""

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def sql_round(expr: str, digits: int) -> str:
    """Half-up rounding after a snap to 9 decimals, as ``functions.common.rnd``."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,9)), {digits}) AS DOUBLE)"
