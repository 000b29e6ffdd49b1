"""Nested task documents: sizes, chain names, copy counts, budgets and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import chain_name
from .ranks import placed

ENTITY = "struct<kind:string,sequence:string,count:int,ids:array<string>>"
TASK = f"struct<name:string,sequences:array<{ENTITY}>>"


def copies(entity: Column) -> Column:
    return F.greatest(F.coalesce(entity["count"], F.size(entity["ids"]), F.lit(1)), F.lit(1))


def task_size(entities: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """struct(tokens, chains, entities) over the entities, of some kinds alone if given."""
    own = F.filter(entities, lambda e: e["kind"].isin(*kinds)) if kinds else entities
    zero = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("chains"), F.lit(0).cast("long").alias("entities"))
    step = lambda a, e: F.struct((a["tokens"] + F.length(e["sequence"]) * copies(e)).alias("tokens"), (a["chains"] + copies(e)).alias("chains"), (a["entities"] + 1).alias("entities"))
    return F.aggregate(own, zero, step)


def named_chains(entities: Column) -> Column:
    """Entities with chain ids A, B, ... given on from entity to entity."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ENTITY}>").alias("done"))

    def step(a: Column, e: Column) -> Column:
        n = copies(e).cast("int")
        ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: chain_name(a["at"] + i))
        new = F.struct(e["kind"].alias("kind"), e["sequence"].alias("sequence"), n.alias("count"), ids.alias("ids"))
        return F.struct((a["at"] + n).alias("at"), F.concat(a["done"], F.array(new)).alias("done"))

    return F.aggregate(entities, zero, step, lambda a: a["done"])


def with_counts(entities: Column, counts: Column) -> Column:
    """Entities with new copy counts, where as many are given as there are entities."""
    return F.when(F.size(counts) == F.size(entities), F.transform(entities, lambda e, i: e.withField("count", F.get(counts, i)))).otherwise(entities)


def with_sequences(entities: Column, change, *, kind: str = "proteinChain") -> Column:
    """Entities of one kind with sequences changed by an expression."""
    return F.transform(entities, lambda e: F.when(e["kind"] == kind, e.withField("sequence", change(e["sequence"]))).otherwise(e))


def prefix_within(entities: Column, budget: int) -> Column:
    """Entities walked in order, each with as many copies (and ids) as still fit; empty ones and what doesn't fit is passed over."""
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<{ENTITY}>").alias("kept"))

    def step(a: Column, e: Column) -> Column:
        fits = F.when(F.length(e["sequence"]) > 0, F.floor(F.try_divide(a["left"], F.length(e["sequence"])))).otherwise(0)
        n = F.least(copies(e).cast("long"), fits).cast("int")
        kept = F.when(n > 0, F.concat(a["kept"], F.array(F.struct(e["kind"].alias("kind"), e["sequence"].alias("sequence"), n.alias("count"), F.slice(e["ids"], 1, n).alias("ids"))))).otherwise(a["kept"])
        return F.struct((a["left"] - n * F.length(e["sequence"])).alias("left"), kept.alias("kept"))

    return F.aggregate(entities, zero, step, lambda a: a["kept"])


def capped_copies(entities: Column, budget: int) -> Column:
    """A single entity over the budget is brought down to one copy."""
    over = (F.size(entities) == 1) & (task_size(entities)["tokens"] > budget)
    return F.when(over, F.transform(entities, lambda e: e.withField("count", F.lit(1)))).otherwise(entities)


def jobs(targets: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Targets with records -> status and skip reason; rows up to the limit-th good one are kept."""
    out = targets.withColumn("skip_reason", F.when(F.col("n_records") == 0, "no_sequence_record").when(F.col("counts").isNull(), F.concat(F.lit("ambiguous_oligo_state:"), "oligo_state")).otherwise(""))
    out = out.withColumn("status", F.when(F.col("skip_reason") == "", "ok").otherwise("skipped"))
    if limit is None:
        return out
    # the limit-th good row bounds the rest; finding it sorts no more than limit rows in one place
    last = out.where("status = 'ok'").orderBy("ord").limit(limit).agg(F.max("ord").alias("last"), F.count(F.lit(1)).alias("n"))
    return out.join(F.broadcast(last)).where((F.col("n") < limit) | (F.col("ord") <= F.col("last"))).drop("last", "n")


def fragment(sequence: Column, ranges: Column) -> Column:
    """struct(status, fragment): the part of a chain that a domain's ranges name."""
    lo, hi = F.get(ranges, F.lit(0))["lo"], F.get(ranges, F.lit(0))["hi"]
    status = F.when(F.size(ranges) != 1, "non_contiguous").when((lo < 1) | (hi < lo), "invalid_range").when(hi > F.length(sequence), "out_of_bounds").otherwise("ok")
    return F.struct(status.alias("status"), F.when(status == "ok", F.substr(sequence, lo, hi - lo + 1)).otherwise("").alias("fragment"))


def ordered(tasks: DataFrame, order: str) -> DataFrame:
    """place: by input, size-asc or size-desc, ties by input order then name."""
    key = {"input": [], "size-asc": [F.asc("tokens")], "size-desc": [F.desc("tokens")]}[order]
    return placed(tasks, ["pool"], [*key, "ord", "name"])


def by_priority(jobs_: DataFrame, *, size_first: bool = True) -> DataFrame:
    """Wanted kind first, then by size among those if asked, then input order."""
    size = F.when(F.col("priority") == 0, F.col("tokens")).otherwise(0) if size_first else F.lit(0)
    return placed(jobs_.withColumn("_size", size), ["pool"], ["priority", "_size", "ord"]).drop("_size")
