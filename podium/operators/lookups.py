"""Lookups through aliases and priorities, semi- and anti-joins, and unions by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import aliases, csv_items


def alias_index(records: DataFrame) -> DataFrame:
    """(alias, record_id, sequence, ord, ...): each record under its targets' ids and phases, first of equal ones (same id, sequence and kind)."""
    targets = F.filter(F.transform(F.split("target_ids", ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    under = records.withColumn("target", F.explode(targets)).withColumn("alias", F.explode(aliases(F.col("target")))).drop("target", "target_ids")
    first = W.partitionBy("alias", "record_id", "sequence", "kind").orderBy("ord")
    return under.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def with_records(targets: DataFrame, index: DataFrame) -> DataFrame:
    """Targets with the number of their records and the records' ids in order of arrival."""
    up = F.upper("target_id")
    got = index.groupBy("alias").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "record_id"))), lambda r: r["record_id"]).alias("records"))
    return targets.join(got, up == F.col("alias"), "left").select(*targets.columns, F.coalesce(F.size("records"), F.lit(0)).alias("n_records"), F.array_join(F.coalesce("records", F.array().cast("array<string>")), ",").alias("record_ids"))


def informative(state: Column) -> Column:
    return F.coalesce(F.trim(state), F.lit("")).isin("", "-") == F.lit(False)


def metadata(keys: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """A value for each key: of the row with that id (the last one), else of a row with that alias (the first one)."""
    exact = rows.groupBy(F.upper("target_id").alias("key")).agg(F.max_by(value, "ord").alias("exact"))
    alias = rows.select("ord", value, F.explode(aliases(F.col("target_id"))).alias("key")).groupBy("key").agg(F.min_by(value, "ord").alias("by_alias"))
    return keys.join(exact, "key", "left").join(alias, "key", "left").select(*keys.columns, F.coalesce("exact", "by_alias").alias(value))


def informative_state(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """The exact id's state if it says anything, else that of the alphabetically first alias that does."""
    told = rows.where(informative(F.col("oligo_state")))
    exact = told.groupBy(F.upper("target_id").alias("key")).agg(F.max_by("oligo_state", "ord").alias("exact"))
    own = told.groupBy(F.upper("target_id").alias("alias")).agg(F.max_by("oligo_state", "ord").alias("state"))
    by_alias = keys.select("key", F.explode(aliases(F.col("key"))).alias("alias")).join(own, "alias").groupBy("key").agg(F.min_by("state", "alias").alias("by_alias"))
    return keys.join(exact, "key", "left").join(by_alias, "key", "left").select("key", F.coalesce("exact", "by_alias", F.lit("")).alias("oligo_state"))


def last_row(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last row of each key, as a lookup table."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "ord").alias("r")).select(key, "r.*")


def gathered_ranges(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def listed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Values of each key in order of arrival."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value))), lambda x: x[value]).alias(f"{value}s"))


def override(own: Column, wanted: Column) -> Column:
    """Wanted values that are known, in the wanted order; the own list where nothing is wanted."""
    return F.when(F.size(wanted) > 0, F.array_intersect(wanted, own)).otherwise(own)


def keep_scoreable(jobs: DataFrame, targets: DataFrame, *, available: str) -> DataFrame:
    """Jobs any of whose aliases is an alias of a wanted target, with those targets; the others with an empty list."""
    wanted = targets.where(available).select("target_id", F.explode(aliases(F.col("target_id"))).alias("alias")).distinct()
    own = jobs.select("job", F.explode(aliases(F.col("job"))).alias("alias"))
    kept = own.join(wanted, "alias").groupBy("job").agg(F.array_join(F.array_sort(F.collect_set("target_id")), ",").alias("kept_for"))
    return jobs.join(kept, "job", "left").withColumn("status", F.when(F.col("kept_for").isNull(), "dropped").otherwise("kept")).na.fill("", ["kept_for"])


def recover(targets: DataFrame, jobs: DataFrame, index: DataFrame) -> DataFrame:
    """Targets without a job, with sequences recovered through aliases: each sequence once, by the least (alias place, ord)."""
    absent = targets.join(jobs, F.upper(targets["target_id"]) == F.upper(jobs["job"]), "left_anti")
    placed = absent.select("target_id", F.posexplode(aliases(F.col("target_id"))).alias("place", "alias")).join(index, "alias")
    first = W.partitionBy("target_id", "sequence").orderBy("place", "ord")
    return placed.withColumn("n", F.row_number().over(first)).where("n = 1").select("target_id", "place", "record_id", "kind", "ord")


def first_alias_records(targets: DataFrame, index: DataFrame, *, preferred: str = "proteinChain") -> DataFrame:
    """Records of the first alias that has any; of the preferred kind alone where there are such."""
    placed = targets.select("target_id", F.posexplode(aliases(F.col("target_id"))).alias("place", "alias")).join(index, "alias")
    near = placed.withColumn("least", F.min("place").over(W.partitionBy("target_id"))).where("place = least")
    has = F.max((F.col("kind") == preferred).cast("int")).over(W.partitionBy("target_id"))
    return near.withColumn("has", has).where((F.col("has") == 0) | (F.col("kind") == preferred)).select("target_id", "place", "record_id", "kind")


def relation(query: Column, hit: Column) -> Column:
    """How two sequences relate: equal, one within the other, or not."""
    return F.when(query == hit, "exact").when(F.contains(hit, query), "query_in_hit").when(F.contains(query, hit), "hit_in_query").otherwise("different")


def pick(*sets: Column) -> Column:
    """The smallest member of the first set that isn't empty."""
    return F.array_min(F.coalesce(*(F.when(F.size(s) > 0, s) for s in sets)))


def united(*sets: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(s, F.array().cast("array<string>")) for s in sets))))


def overlay_ids(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[,;\s]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


#: What an overlay row's status may be, and what an accepted row must tell.
OVERLAY_STATUS = ("accepted", "candidate", "rejected", "deferred")
PROVENANCE = ("source", "native_provenance", "construct_coverage", "chain_mapping", "scoring_mapping")


def overlay_rows(rows: DataFrame, *, id_pattern: str | None = None) -> DataFrame:
    """All overlay rows, trimmed, ids split; a row without a target, with an odd status, or accepted but incomplete stops the query.

    Columns: target_id, ids, status and those of ``PROVENANCE``. An accepted row needs an id and all of these.
    With a pattern, an id that doesn't match it as a whole is an error in any row.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    trimmed = rows.withColumns({c: text(c) for c in PROVENANCE} | {"target_id": F.upper(text("target_id")), "status": F.lower(text("status")), "ids": overlay_ids(F.col("ids"))})
    accepted = F.col("status") == "accepted"
    lacking = F.array_join(F.filter(F.array(*(F.when(F.col(c) == "", c) for c in PROVENANCE)), lambda c: c.isNotNull()), ", ")
    error = (
        F.when(F.col("target_id") == "", F.lit("overlay row without a target"))
        .when(~F.col("status").isin(*OVERLAY_STATUS), F.concat(F.lit("unknown status: "), "status"))
        .when(F.exists("ids", lambda x: ~x.rlike(f"^(?:{id_pattern})$")) if id_pattern else F.lit(False), F.concat(F.lit("invalid id: "), "target_id"))
        .when(accepted & (F.size("ids") == 0), F.concat(F.lit("accepted row without ids: "), "target_id"))
        .when(accepted & (lacking != ""), F.concat(F.lit("incomplete row: "), "target_id", F.lit(" lacks "), lacking))
    )
    return trimmed.withColumn("status", F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.col("status")))


def overlay(rows: DataFrame, *, id_pattern: str | None = None) -> DataFrame:
    """Accepted overlay rows as a set of ids for each target; a bad row stops the query."""
    ids = overlay_rows(rows, id_pattern=id_pattern).where("status = 'accepted'").select("target_id", F.explode("ids").alias("id"))
    return ids.groupBy("target_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose keys aren't new, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_preferred(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row for each key: more paths, then a hash, then the old side and earlier arrival."""
    both = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)))
    best = F.struct("n_paths", "has_hash", -F.col("side"), -F.col("ord"))
    cols = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), best).alias("r")).select(key, "r.*")


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of two id sets, of what they share and lack, and whether they are equal."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(1)), b.select(key).distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, key, "full_outer").agg(F.count("in_a").alias("a"), F.count("in_b").alias("b"), F.count_if(F.expr("in_a = 1 and in_b = 1")).alias("shared"), F.count_if(F.expr("in_b is null")).alias("only_a"), F.count_if(F.expr("in_a is null")).alias("only_b"))
    return both.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of old ones of the same key; others are put at the end, in their own order."""
    cols = [c for c in old.columns if c not in (key, "ord")]
    both = old.select(key, F.col("ord").alias("old_ord"), F.struct(*cols).alias("o")).join(new.select(key, F.col("ord").alias("new_ord"), F.struct(*cols).alias("n")), key, "full_outer")
    return both.select(key, F.when(F.col("old_ord").isNotNull(), 0).otherwise(1).alias("part"), F.coalesce("old_ord", "new_ord").alias("ord"), F.coalesce("n", "o").alias("r")).select(key, "part", "ord", "r.*")


def phases(**manifests: DataFrame) -> DataFrame:
    """Manifests of several steps under each other, tagged by step; what is missing reads none."""
    out = None
    for name, df in manifests.items():
        part = df.select(F.lit(name).alias("phase"), *(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("none")).alias(c) for c in df.columns))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.na.fill("none")
