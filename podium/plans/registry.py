"""Named queries: a DataFrame plan over the tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .carriers import CARRIERS, DEALT


class Tables:
    """Tables of a folder by name, and the carriers that are built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def dealt(self, name: str, key: str) -> DataFrame:
        """A table dealt to tasks by key: few bytes make few splits of a file, however much there is to do for a row."""
        return getattr(self, name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    def __getattr__(self, name: str) -> DataFrame:
        if name in CARRIERS:
            tables, sql = CARRIERS[name]
            got = {t: self.dealt(t, DEALT[name]) if name in DEALT else getattr(self, t) for t in tables}
            return self.spark.sql(sql.format(**{t: "{" + t + "}" for t in tables}), **got)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ctes(names: list[str]) -> list[str]:
    """SQL of carriers and of those that they use, in order."""
    out: list[str] = []
    for name in names:
        tables, sql = CARRIERS[name]
        for cte in [*ctes([t for t in tables if t in CARRIERS]), f"{name} AS ({sql.format(**{t: t for t in tables})})"]:
            if cte not in out:
                out.append(cte)
    return out


def query(name: str, sql: str | None = None, uses: str = ""):
    """Registers plan(tables) under a name; uses: carriers that the SQL refers to."""

    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            head = ", ".join(ctes(uses.split()))
            ORACLES[name] = (f"WITH {head}" + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else f" {sql}")) if head else sql
        return plan

    return register
