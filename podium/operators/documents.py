"""JSON documents of unknown shape as VARIANT: a canonical form, their jobs by name, and guards on what a variant may change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """One spelling for equal documents: keys sorted at every level, no blanks, numbers without trailing zeros; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def jobs(inputs: DataFrame) -> DataFrame:
    """(source, name, job, ord): the named jobs of input documents (source, body), lists of objects; of one name in a document the last.

    What isn't JSON, isn't a list, or has items that are no objects or have no name, gives no job there; broken() lists such documents.
    """
    docs = inputs.select("source", F.try_parse_json("body").alias("v")).where(F.schema_of_variant("v").startswith("ARRAY"))
    items = inputs.sparkSession.sql("SELECT source, e.pos AS ord, try_variant_get(e.value, '$.name', 'string') AS name, to_json(e.value) AS job FROM {docs}, LATERAL variant_explode(v) AS e", docs=docs)
    return items.where("name <> ''").groupBy("source", "name").agg(F.max_by("job", "ord").alias("job"), F.max("ord").alias("ord"))


def broken(inputs: DataFrame) -> DataFrame:
    """(source, problem): documents that are missing, no JSON, or no list."""
    v = F.try_parse_json("body")
    problem = F.when(F.coalesce(F.trim("body"), F.lit("")) == "", "missing").when(v.isNull(), "malformed").when(~F.schema_of_variant(v).startswith("ARRAY"), "not_a_list")
    return inputs.select("source", problem.alias("problem")).where("problem is not null")


def differences(base: DataFrame, other: DataFrame) -> DataFrame:
    """(name, change): jobs (name, job) that one side lacks, or that differ in canonical form: missing, extra or changed."""
    digest = lambda df, c: df.select("name", F.sha2("job", 256).alias(c))
    both = digest(base, "a").join(digest(other, "b"), "name", "full")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def keys_changed(base: DataFrame, other: DataFrame) -> DataFrame:
    """(name, key): top-level keys of the jobs on both sides whose values differ, or that one side lacks."""
    sql = "SELECT name, e.key, sha2(to_json(e.value), 256) AS {0} FROM {{df}}, LATERAL variant_explode(parse_json(job)) AS e"
    a, b = (df.sparkSession.sql(sql.format(c), df=df.join(o.select("name"), "name", "left_semi")) for df, o, c in ((base, other, "a"), (other, base, "b")))
    return a.join(b, ["name", "key"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("name", "key")


def variant_guard(specs: DataFrame, wanted: DataFrame, rules: dict[str, str], changes: DataFrame, allowed: DataFrame, *, most: int = 25, listed: int = 12) -> DataFrame:
    """One row (status, failures, n_failures): may a variant's runs stand beside the base's?

    wanted: (run_id) that must have a spec; rules: message -> SQL condition on a spec; changes: of differences(); allowed: (name) that must change and
    alone may. Failures are listed by run and rule, then the target sets, then unexpected and missing changes; at most ``most`` of them, with at most ``listed`` names
    in one. No spec, job or change goes through the driver.
    """
    checked = wanted.select("run_id").distinct().join(specs.withColumn("_there", F.lit(True)), "run_id", "left")
    rule = lambda i, msg, cond: F.when(F.col("_there") & ~F.coalesce(F.expr(cond), F.lit(False)), F.struct(F.lit(0).alias("part"), F.col("run_id").alias("a"), F.lit(i).alias("b"), F.concat_ws(":", "run_id", F.lit(msg)).alias("text")))
    gone = F.when(F.col("_there").isNull(), F.struct(F.lit(0).alias("part"), F.col("run_id").alias("a"), F.lit(0).alias("b"), F.concat_ws(":", "run_id", F.lit("missing_run_spec")).alias("text")))
    by_run = checked.select(F.explode(F.array_compact(F.array(gone, *(rule(i, m, c) for i, (m, c) in enumerate(rules.items(), 1))))).alias("f")).select("f.*")
    sets = changes.groupBy().agg(F.count_if(F.col("change") == "missing").alias("m"), F.count_if(F.col("change") == "extra").alias("e")).where("m + e > 0")
    sets = sets.select(F.lit(1).alias("part"), F.lit("").alias("a"), F.lit(0).alias("b"), F.concat(F.lit("target_set_mismatch:missing="), "m", F.lit(" extra="), "e").alias("text"))
    changed = changes.where("change = 'changed'").select("name").distinct()

    def names(df: DataFrame, part: int, what: str) -> DataFrame:
        first = df.orderBy("name").limit(listed).groupBy().agg(F.array_sort(F.collect_list("name")).alias("n")).where("size(n) > 0")
        return first.select(F.lit(part).alias("part"), F.lit("").alias("a"), F.lit(0).alias("b"), F.concat(F.lit(f"{what}:"), F.array_join("n", ",")).alias("text"))

    only = allowed.select("name").distinct()
    failures = by_run.unionByName(sets).unionByName(names(changed.join(only, "name", "left_anti"), 2, "unexpected_changed_targets")).unionByName(names(only.join(changed, "name", "left_anti"), 3, "missing_changes"))
    return report(failures, most)


def report(failures: DataFrame, most: int) -> DataFrame:
    """The first ``most`` failures (part, a, b, text) in their order, how many there are, and ok or blocked."""
    first = failures.orderBy("part", "a", "b").limit(most).groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "a", "b", "text"))).alias("f"))
    first = first.select(F.lit(1).alias("_one"), F.array_join(F.transform("f", lambda f: f["text"]), ";").alias("failures"))
    counted = failures.groupBy().agg(F.count(F.lit(1)).alias("n_failures")).withColumn("_one", F.lit(1))
    return counted.join(first, "_one").select(F.when(F.col("n_failures") == 0, "ok").otherwise("blocked").alias("status"), "failures", "n_failures")
