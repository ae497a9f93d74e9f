"""Where driver-facing queries register themselves, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Cases of operators that queries over tables apply: records with the rows expected of them, for the tests alone.
CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CASE_ROWS: dict[str, str] = {}


class Tables:
    """Tables of one scale folder, read when asked for: t.supplier, t.lineitem ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers f(tables) -> DataFrame under name."""

    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def case(name: str, sql: str):
    """Registers f(tables) -> DataFrame over records of its own as a test."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        CASES[name], CASE_ROWS[name] = (lambda spark, sf_dir: f(Tables(spark, sf_dir))), sql
        return f

    return register
