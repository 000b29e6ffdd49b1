"""Recorded answers of a sequence search and of its entries: bodies of unknown shape, an error for each row that has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import relation

# fixed values: how a hit is named, and what a candidate is called by how its sequence relates to the target's
HIT = "^[0-9][A-Z0-9]{3}_[0-9]+$"
EQUAL = "full_construct_exact_candidate_needs_native_provenance_and_mapping"
TARGET_INSIDE = "partial_or_construct_variant_candidate_do_not_promote_without_mapping"
ENTITY_INSIDE = "local_sequence_hit_not_full_construct_do_not_promote"
UNVERIFIED = "sequence_search_hit_alignment_unverified"


def body_error(body: Column, error: Column) -> Column:
    """The recorded error, else malformed for a body that isn't JSON, else none; an empty body is an empty answer."""
    blank = F.coalesce(F.trim(body), F.lit("")) == ""
    return F.when(F.coalesce(error, F.lit("")) != "", error).when(~blank & F.try_parse_json(body).isNull(), "malformed").otherwise("none")


def nested(v: Column, path: str) -> Column:
    """Text at a path, line breaks as blanks, trimmed; empty where there is nothing."""
    return F.trim(F.regexp_replace(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")), "\n", " "))


def nested_list(v: Column, path: str) -> Column:
    """Items of the list at a path joined by commas; empty where there is none."""
    return F.array_join(F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>")), ",")


def search_sequence(sequence: Column) -> Column:
    """Capital letters without blanks, unknown ones as X; empty for a nucleic sequence."""
    plain = F.regexp_replace(F.upper(F.coalesce(sequence, F.lit(""))), r"\s+", "")
    # fixed values: the letters of a nucleic sequence, and those of a protein that the search knows
    return F.when(plain.rlike("^[ACGTUN]*$"), "").otherwise(F.regexp_replace(plain, "[^ABCDEFGHIKLMNPQRSTUVWXYZ]", "X"))


def hits(searches: DataFrame) -> DataFrame:
    """(target_id, place, hit, pdb_id, entity_id) of searches (target_id, body); identifiers of another form are passed over."""
    read = searches.select("target_id", F.try_parse_json("body").alias("v")).where("v is not null")
    items = searches.sparkSession.sql("SELECT target_id, e.pos AS place, upper(try_variant_get(e.value, '$.identifier', 'string')) AS hit FROM {read}, LATERAL variant_explode(try_variant_get(v, '$.result_set', 'variant')) AS e", read=read)
    return items.where(F.col("hit").rlike(HIT)).select("target_id", "place", "hit", F.substring_index("hit", "_", 1).alias("pdb_id"), F.substring_index("hit", "_", -1).alias("entity_id"))


def method(v: Column) -> Column:
    """Experimental method: of the first experiment, else of the entry's own list or text."""
    first = F.try_variant_get(v, "$.exptl[0].method", "string")
    several = nested_list(v, "$.rcsb_entry_info.experimental_method")
    single = F.try_variant_get(v, "$.rcsb_entry_info.experimental_method", "string")
    told = F.try_variant_get(v, "$.exptl[0]", "variant").isNotNull() & F.schema_of_variant(F.try_variant_get(v, "$.exptl[0]", "variant")).startswith("OBJECT")
    return F.when(told, F.coalesce(first, F.lit(""))).when(several != "", several).otherwise(F.coalesce(single, F.lit("")))


def candidate_rows(targets: DataFrame, found: DataFrame, entries: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each target (target_id, sequence) with a protein sequence and each of its hits, with what entry (pdb_id, body, error) and entity (pdb_id, entity_id, body, error) say.

    An answer that failed, is malformed or wasn't recorded leaves its fields empty and says so in its own error column; the row stays.
    """
    answer = lambda df, p: df.withColumns({f"{p}_v": F.try_parse_json("body"), f"{p}_error": body_error(F.col("body"), F.col("error"))}).drop("body", "error")
    full = found.join(targets.select("target_id", search_sequence(F.col("sequence")).alias("own")).where("own <> ''"), "target_id")
    full = full.join(answer(entries, "entry"), "pdb_id", "left").join(answer(entities, "entity"), ["pdb_id", "entity_id"], "left")
    full = full.withColumn("theirs", search_sequence(nested(F.col("entity_v"), "$.entity_poly.pdbx_seq_one_letter_code_can")))
    how = F.when(F.col("theirs") == "", "none").otherwise(relation(F.col("own"), F.col("theirs")))
    return full.select(
        "target_id", "place", "hit", "pdb_id", "entity_id",
        F.length("own").alias("target_length"),
        nested(F.col("entry_v"), "$.struct.title").alias("entry_title"),
        nested(F.col("entry_v"), "$.rcsb_accession_info.initial_release_date").alias("release_date"),
        method(F.col("entry_v")).alias("experimental_method"),
        nested(F.col("entity_v"), "$.rcsb_polymer_entity.pdbx_description").alias("entity_description"),
        nested_list(F.col("entity_v"), "$.rcsb_polymer_entity_container_identifiers.asym_ids").alias("asym_ids"),
        nested_list(F.col("entity_v"), "$.rcsb_polymer_entity_container_identifiers.auth_asym_ids").alias("auth_asym_ids"),
        F.nullif(F.length("theirs"), F.lit(0)).alias("entity_length"),
        F.when(how == "exact", EQUAL).when(how == "query_in_hit", TARGET_INSIDE).when(how == "hit_in_query", ENTITY_INSIDE).otherwise(UNVERIFIED).alias("candidate_status"),
        F.coalesce("entry_error", F.lit("not_recorded")).alias("entry_error"),
        F.coalesce("entity_error", F.lit("not_recorded")).alias("entity_error"),
    )
