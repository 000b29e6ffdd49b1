"""Input strategies by name: what each does to the sequences of a task's entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as Q
from .tasks import with_sequences


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f refers to it."""
    return F.transform(F.array(value), f)[0]


def without_tags(s: Column) -> Column:
    return Q.trimmed(s)["sequence"]


def without_epitopes(s: Column) -> Column:
    return Q.trimmed(s, epitopes=True)["sequence"]


def without_low_complexity(s: Column) -> Column:
    def cut(x: Column) -> Column:
        return once(Q.low_complexity_cuts(x), lambda c: F.substr(x, c["n"] + 1, F.length(x) - c["n"] - c["c"]))

    return once(without_epitopes(s), cut)


def without_leader(s: Column) -> Column:
    return once(without_low_complexity(s), lambda x: F.substr(x, Q.leader_cut(x) + 1))


def variable_region(s: Column) -> Column:
    return F.coalesce(F.substr(s, F.lit(1), Q.variable_end(s)), s)


#: Strategies by name; add to it to plug in others.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "terminal_tags": without_tags,
    "epitope_tags": without_epitopes,
    "low_complexity_ends": without_low_complexity,
    "hydrophobic_leader": without_leader,
    "variable_region": variable_region,
    "tags_then_variable_region": lambda s: once(without_tags(s), variable_region),
}


def apply(tasks: DataFrame, name: str) -> DataFrame:
    """Tasks with the protein sequences of a strategy, and whether it changed them."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy: {name}")
    return tasks.withColumn("new", with_sequences(F.col("sequences"), STRATEGIES[name])).withColumn("changed", F.col("new") != F.col("sequences")).drop("sequences").withColumnRenamed("new", "sequences")
