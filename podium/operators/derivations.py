"""Tasks derived from tasks and lookup tables: fragments, fallbacks, subsets and recoveries, each with its reasons.

Tasks are rows (name, ord, sequences); names are unique. A derivation returns the tasks it is about with ``status``,
``skip_reason`` and the new ``sequences``. Everything works on one task at a time but for equi-joins on names and aliases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import sequences as Q
from . import lookups as K
from . import strategies as S
from . import tasks as T

#: Fixed value: tokens that a task may have.
TOKEN_LIMIT = 2560
PROTEIN = "proteinChain"


def proteins(entities: Column) -> Column:
    return F.filter(entities, lambda e: e["kind"] == PROTEIN)


def tokens(entities: Column) -> Column:
    return T.task_size(entities, (PROTEIN,))["tokens"]


def counts(entities: Column) -> Column:
    return F.transform(entities, lambda e: T.copies(e).cast("int"))


def mixed(entities: Column) -> Column:
    return F.size(proteins(entities)) != F.size(entities)


def with_track(tasks: DataFrame, targets: DataFrame, *more: str) -> DataFrame:
    """Tasks with their target's track and further columns, of the last row with that id; tasks say whether they have bonds."""
    rows = K.last_row(targets, "target_id", ["track", *more]).withColumnRenamed("target_id", "name")
    got = tasks if "bonds" in tasks.columns else tasks.withColumn("bonds", F.lit(False))
    return got.join(rows, "name", "left").withColumn("track", F.nullif("track", F.lit("")))


def decided(tasks: DataFrame, reason: Column, sequences: Column) -> DataFrame:
    got = tasks.withColumn("skip_reason", reason)
    changed = F.col("skip_reason") == "none"
    got = got.withColumn("status", F.when(changed, "changed").otherwise("unchanged")).withColumn("original_tokens", tokens(F.col("sequences")))
    got = got.withColumn("sequences", F.when(changed, sequences).otherwise(F.col("sequences")))
    return got.withColumn("tokens", tokens(F.col("sequences")))


def domain_to_one_copy(tasks: DataFrame, targets: DataFrame, *, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Domain tasks of one protein over the limit are brought down to its first copy."""
    s = F.col("sequences")
    reason = (
        F.when(F.col("track").isNull(), "target_metadata_missing")
        .when(F.col("track") != "protein_domain", "not_protein_domain")
        .when(mixed(s), "requires_protein_only_job")
        .when(tokens(s) <= limit, "within_token_limit")
        .when(F.col("bonds"), "unsupported_covalent_bonds")
        .when(F.size(s) != 1, "requires_single_protein_entity")
        .when(T.copies(F.get(s, F.lit(0))) <= 1, "count_already_one")
        .otherwise("none")
    )
    one = F.transform(s, lambda e: e.withField("count", F.lit(1)).withField("ids", F.array(F.coalesce(F.get(e["ids"], F.lit(0)), F.lit("A")))))
    return decided(with_track(tasks, targets), reason, one)


def within_limit(tasks: DataFrame, targets: DataFrame, *, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Tasks over the limit lose their tags; if that isn't enough, copies are kept in order while they fit."""
    got = with_track(tasks, targets).withColumn("cleaned", T.with_sequences(F.col("sequences"), lambda x: Q.trimmed(x, epitopes=True)["sequence"]))
    got = got.withColumn("cleaned_tokens", tokens(F.col("cleaned")))
    got = got.withColumn("fitting", F.when(F.col("cleaned_tokens") <= limit, F.col("cleaned")).otherwise(T.prefix_within(F.col("cleaned"), limit)))
    s = F.col("sequences")
    reason = (
        F.when(F.col("track").isNull(), "target_metadata_missing")
        .when(mixed(s), "requires_protein_only_job")
        .when(F.col("bonds"), "unsupported_covalent_bonds")
        .when(tokens(s) <= limit, "within_token_limit")
        .when(F.size("fitting") == 0, "no_entity_fits_token_limit")
        .otherwise("none")
    )
    return decided(got, reason, F.col("fitting")).drop("cleaned", "fitting")


def with_official_counts(tasks: DataFrame, targets: DataFrame, states: DataFrame, *, limit: int = TOKEN_LIMIT, token_safe: bool = False) -> DataFrame:
    """Copies as the official state (key, official_state) says; token_safe: not where that would pass the limit."""
    got = with_track(tasks, targets, "oligo_state").join(states.withColumnRenamed("key", "name"), "name", "left")
    s, state = F.col("sequences"), F.coalesce("official_state", F.lit(""))
    said = F.transform(F.regexp_extract_all(F.upper(state), F.lit(r"[A-Z]+(\d+)"), 1), lambda x: x.cast("int"))
    got = got.withColumn("wanted", F.when((F.size(said) == F.size(s)) & F.forall(said, lambda c: c >= 1), said))
    named = F.forall(s, lambda e: F.greatest(F.coalesce(F.size(e["ids"]), F.lit(0)), F.lit(1)) == T.copies(e))
    new = T.named_chains(T.with_counts(s, F.col("wanted")))
    reason = (
        F.when(F.coalesce("track", F.lit("")) != "protein_oligo", "not_protein_oligo")
        .when(mixed(s), "requires_protein_only_job")
        .when(state.isin("", "UNK", "-"), "official_oligo_state_unavailable")
        .when(F.col("wanted").isNull(), "ambiguous_official_oligo_state")
        .when((F.col("wanted") == counts(s)) & named, "already_matches_official_oligo_state")
        .when(F.lit(token_safe) & (tokens(new) > limit), "oversize_after_recovery")
        .otherwise("none")
    )
    return decided(got, reason, new).withColumn("counts", counts(F.col("sequences"))).drop("wanted")


def domain_fragments(tasks: DataFrame, domains: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """A task for each domain of a task's target, or the reason against it.

    Domains are rows (ord, domain_id, target_id, residue_ranges). Targets of the domain track that list known
    domains in ``domain_ids`` have these instead of the ones that name them.
    """
    known = K.last_row(domains, "domain_id", ["residue_ranges"])
    of = domains.where("target_id <> '' AND domain_id <> ''").select(F.col("target_id").alias("name"), "domain_id", F.col("ord").alias("place"))
    if targets is not None:
        listed = targets.where("track = 'protein_domain'").select("target_id", "domain_ids", "ord")
        last = K.last_row(listed, "target_id", ["domain_ids"]).select(F.col("target_id").alias("name"), F.posexplode(F.split("domain_ids", ",")).alias("place", "domain_id"))
        own = last.join(known.select("domain_id"), "domain_id", "left_semi").select("name", "domain_id", F.col("place").cast("long").alias("place"))
        of = of.join(own.select("name").distinct(), "name", "left_anti").unionByName(own)
    got = tasks.join(of, "name").join(known, "domain_id")
    p = proteins(F.col("sequences"))
    sequence, ranges = F.coalesce(F.get(p, F.lit(0))["sequence"], F.lit("")), I.parse_strict(F.col("residue_ranges"))
    cut = T.fragment(sequence, ranges)
    reason = (
        F.when(F.size(p) != 1, "requires_single_protein_entity")
        .when(F.coalesce(F.get(p, F.lit(0))["count"], F.lit(1)) > 1, "requires_single_copy_entity")
        .when(F.size(ranges) != 1, "non_contiguous_domain")
        .when(cut["status"] != "ok", "domain_range_out_of_bounds")
        .otherwise("none")
    )
    fragment = F.when(F.col("skip_reason") == "none", cut["fragment"]).otherwise("")
    out = got.withColumn("skip_reason", reason).withColumn("fragment", fragment)
    return out.select(
        F.concat_ws("__", "name", "domain_id").alias("fragment_id"), F.col("name").alias("source"), "domain_id", "place", "residue_ranges",
        F.when(F.col("skip_reason") == "none", "ok").otherwise("skip").alias("status"), "skip_reason", "fragment",
    )


def variable_domains(tasks: DataFrame) -> DataFrame:
    """Tasks with a chain that goes on after its variable domain, cut there, under a name of their own."""
    cut = T.with_sequences(F.col("sequences"), lambda x: F.coalesce(F.substr(x, F.lit(1), Q.variable_end(x)), x))
    got = tasks.withColumn("cut", cut).where(F.col("cut") != F.col("sequences"))
    return got.withColumn("sequences", F.col("cut")).withColumn("source", F.col("name")).withColumn("name", F.concat("name", F.lit("__fv"))).drop("cut")


def task_aliases(name: Column) -> Column:
    """Aliases of an id, and the id with or without a last O."""
    up = F.upper(F.trim(name))
    other = F.when(F.endswith(up, F.lit("O")), F.regexp_replace(up, "O$", "")).otherwise(F.concat(up, F.lit("O")))
    return F.filter(F.array_distinct(F.concat(Q.aliases(up), F.array(other))), lambda a: a != "")


def scoreable_subset(tasks: DataFrame, targets: DataFrame, *, oligo_first: bool = False, size_first: bool = False) -> DataFrame:
    """Tasks with the targets that they can be scored on; those kept are in the order (priority, size_key, ord).

    Targets: (ord, target_id, track, reference_status, sequence_lookup_id, official_target_id).
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    extra = F.array(F.upper(blank("sequence_lookup_id")), F.upper(blank("official_target_id")))
    found = targets.where((F.col("reference_status") == "available") & (blank("target_id") != "")).withColumn("target", blank("target_id"))
    index = found.select("target", F.explode(F.filter(F.array_distinct(F.concat(task_aliases(F.col("target")), extra)), lambda a: a != "")).alias("alias")).distinct()
    hits = tasks.select("name", F.explode(task_aliases(F.col("name"))).alias("alias")).join(index, "alias")
    kept = hits.groupBy("name").agg(F.array_sort(F.collect_set("target")).alias("kept_for"))
    track = targets.groupBy(F.upper(F.trim("target_id")).alias("up")).agg(F.max_by("track", "ord").alias("track"))
    up = F.upper(F.trim("name"))
    got = tasks.join(kept, "name", "left").withColumn("up", up).join(track, "up", "left")
    exact = F.exists("kept_for", lambda x: F.upper(x) == F.col("up")) & (F.col("track") == "protein_oligo")
    first = F.lit(0) if not oligo_first else F.when(exact, 0).otherwise(1)
    got = got.withColumn("status", F.when(F.col("kept_for").isNull(), "skipped").otherwise("kept"))
    got = got.withColumn("priority", F.when(F.col("status") == "kept", first)).withColumn("size_key", F.when((F.col("priority") == 0) & F.lit(size_first), tokens(F.col("sequences"))).otherwise(F.lit(0).cast("long")))
    note = F.when(F.col("priority") == 0, ",priority:exact_oligo_size_first" if size_first else ",priority:exact_oligo_target_first").otherwise(",priority:original_order_after_exact_oligo_targets") if oligo_first else F.lit("")
    rules = F.when(F.col("status") == "kept", F.concat(F.lit("has_available_reference"), note)).otherwise("no_available_reference_for_job_aliases")
    return got.select(*tasks.columns, "status", F.array_join(F.coalesce("kept_for", F.array().cast("array<string>")), ",").alias("kept_for"), "priority", "size_key", rules.alias("rules"))


def is_protein_record() -> Column:
    """Records (sequence, sequence_kind, header) that can stand in for a protein: 30 letters, protein ones, told or recognised."""
    s = F.regexp_replace(F.upper("sequence"), r"\s+", "")
    other = F.length(F.regexp_replace(s, f"[{Q.NUCLEIC}]", "")) / F.length(s)
    header = F.lower(F.coalesce("header", F.lit("")))
    told = header.rlike("protein|prot |subunit")
    return (F.length(s) >= 30) & s.rlike(f"^[{Q.PROTEIN}]+$") & ((F.col("sequence_kind") == PROTEIN) | (other >= 0.10) | told)


def recovered(tasks: DataFrame, targets: DataFrame, records: DataFrame, *, tracks: tuple[str, ...] = ("protein_domain",)) -> DataFrame:
    """Tasks that are missing or hold other than proteins, made anew from records under their own id or their targets' ids, met by any alias of the target in need.

    Targets: (ord, target_id, track, oligo_state). Records: (ord, target_ids, record_id, header, sequence, sequence_kind).
    Returns a row for each target in need: name, ord, status, skip_reason, sources, record_ids, sequences.
    """
    own = K.last_row(targets.withColumn("target_id", F.upper("target_id")).withColumn("at", F.col("ord")), "target_id", ["track", "oligo_state", "at"])
    own = own.where(F.col("track").isin(*tracks) & (F.col("target_id") != "")).withColumnRenamed("target_id", "name")
    fine = tasks.where(~mixed(F.col("sequences"))).select("name")
    needy = own.join(fine, "name", "left_anti")
    ids = F.concat(F.array(F.upper("record_id")), F.transform(F.split(F.coalesce("target_ids", F.lit("")), ","), lambda x: F.upper(F.trim(x))))
    index = records.where(is_protein_record()).select("ord", "record_id", "sequence", F.explode(F.filter(F.array_distinct(ids), lambda x: x != "")).alias("alias"))
    met = needy.select("name", F.posexplode(Q.recovery_aliases(F.col("name"))).alias("place", "alias")).join(index, "alias")
    met = met.withColumn("letters", F.upper("sequence"))
    first = met.groupBy("name", "letters").agg(F.min(F.struct("place", "ord", "record_id", "alias")).alias("r"))
    made = F.array_sort(F.collect_list(F.struct("r", F.regexp_replace("letters", r"\s+", "").alias("sequence"))))
    got = needy.join(first.groupBy("name").agg(made.alias("m")), "name", "left")
    said = F.transform(F.regexp_extract_all(F.upper(F.coalesce("oligo_state", F.lit(""))), F.lit(r"[A-Z]+(\d+)"), 1), lambda x: x.cast("int"))
    n = F.when(F.size(said) == F.size("m"), said).when((F.size("m") == 1) & (F.size(said) > 0), F.slice(said, 1, 1)).otherwise(F.array_repeat(F.lit(1), F.size("m")))
    entity = lambda x, i: F.struct(F.lit(PROTEIN).alias("kind"), x["sequence"].alias("sequence"), F.get(n, i).alias("count"), F.array().cast("array<string>").alias("ids"))
    some = F.col("m").isNotNull()
    return got.select(
        "name", F.col("at").alias("ord"), F.when(some, "changed").otherwise("unchanged").alias("status"), F.when(some, "none").otherwise("no_recoverable_protein_sequence").alias("skip_reason"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["r"]["alias"]))), ",").alias("sources"),
        F.array_join(F.transform("m", lambda x: x["r"]["record_id"]), ",").alias("record_ids"), F.when(some, T.named_chains(F.transform("m", entity))).alias("sequences"),
    )


def with_recovered(tasks: DataFrame, made: DataFrame) -> DataFrame:
    """Tasks with those made anew in their places; new ones come after all others, in the order of their targets."""
    new = made.where("status = 'changed'").select("name", F.col("ord").alias("at"), F.col("sequences").alias("new"))
    got = tasks.select("name", "ord", "sequences").join(new, "name", "full")
    return got.select("name", F.col("ord").isNull().alias("added"), F.coalesce("ord", "at").alias("ord"), F.coalesce("new", "sequences").alias("sequences"))


def recovered_within_limit(tasks: DataFrame, targets: DataFrame, records: DataFrame, *, tracks: tuple[str, ...] = ("protein_domain",), limit: int = TOKEN_LIMIT) -> DataFrame:
    """Recovery, then tasks over the limit brought under it."""
    return within_limit(with_recovered(tasks, recovered(tasks, targets, records, tracks=tracks)), targets, limit=limit)


def recovered_with_official_counts(tasks: DataFrame, targets: DataFrame, records: DataFrame, states: DataFrame, *, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Recovery of complexes, then official copies where they stay under the limit."""
    made = with_recovered(tasks, recovered(tasks, targets, records, tracks=("protein_oligo",)))
    return with_official_counts(made, targets, states, limit=limit, token_safe=True)


def blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit("")))


def repair_aliases(seed: Column) -> Column:
    """Ids in the order in which records are sought for one: itself, without its last O, first and bare variants of both, and for each of these its recovery aliases."""
    up = F.upper(seed)
    bare = lambda x: F.when(F.endswith(x, F.lit("O")), F.regexp_replace(x, "O$", ""))

    def variants(x: Column) -> list[Column]:
        out = []
        for pattern, sep, other in ((r"^(.*)_V(\d+)(O?)$", "_V1", None), (r"^(.*)V(\d+)(O?)$", "V1", r"^(.*)_V(\d+)(O?)$")):
            fits = x.rlike(pattern) if other is None else x.rlike(pattern) & ~x.rlike(other)
            base, version, tail = (F.regexp_extract(x, pattern, i) for i in (1, 2, 3))
            out += [F.when(fits & (version != "1"), F.concat(base, F.lit(sep), tail)), F.when(fits, F.concat(base, tail)), F.when(fits & (version != "1") & (tail != ""), F.concat(base, F.lit(sep))), F.when(fits & (tail != ""), base)]
        return out

    pending = F.array_compact(F.array(up, bare(up), *variants(up), *variants(bare(up))))
    full = F.flatten(F.transform(pending, lambda x: F.concat(F.array(x), F.array_compact(F.array(bare(x))), Q.recovery_aliases(x))))
    return F.filter(F.array_distinct(full), lambda a: a != "")


def repaired(tasks: DataFrame, targets: DataFrame, records: DataFrame, *, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Every target that could be scored here (a reference, and not barred from ranking), and what is done for it: already_covered, added or skipped.

    A target without a task gets one from the records of the first of its aliases that has protein records, told ones before others; over the limit it is skipped. Targets:
    (ord, target_id, track, oligo_state, reference_status, rank_eligible, sequence_lookup_id, official_target_id), of repeated ids the first row. Records: as for recovered().
    Returns name, ord, track, status, skip_reason, source, record_ids, target_ids, rules, sequences.
    """
    barred = F.lower(blank("rank_eligible")).isin("false", "0", "no")
    scoreable = targets.where((F.col("reference_status") == "available") & ~barred & (blank("target_id") != ""))
    fields = ["ord", "track", "oligo_state", "lookup", "official"]
    rows = scoreable.select(F.upper(blank("target_id")).alias("name"), "ord", "track", "oligo_state", F.upper(blank("sequence_lookup_id")).alias("lookup"), F.upper(blank("official_target_id")).alias("official"))
    own = rows.groupBy("name").agg(F.min_by(F.struct(*fields), F.struct("ord", *fields)).alias("r")).select("name", "r.*")
    index = rows.select("name", F.explode(F.filter(F.array_distinct(F.concat(task_aliases(F.col("name")), F.array("lookup", "official"))), lambda a: a != "")).alias("alias"))
    covered = tasks.select(F.explode(task_aliases(F.col("name"))).alias("alias")).distinct().join(index, "alias").select("name").unionByName(tasks.select(F.upper(F.trim("name")).alias("name"))).distinct()
    needy = own.join(covered, "name", "left_anti")
    # a blank id has no aliases to be worked out
    of = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(repair_aliases(F.col(c)))
    seeds = F.array_distinct(F.flatten(F.array(*(of(c) for c in ("name", "lookup", "official")))))
    ids = F.concat(F.array(F.upper("record_id")), F.transform(F.split(F.coalesce("target_ids", F.lit("")), ","), lambda x: F.upper(F.trim(x))))
    known = records.where(is_protein_record()).select("ord", "record_id", "target_ids", "sequence_kind", F.regexp_replace(F.upper("sequence"), r"\s+", "").alias("sequence"), F.explode(F.filter(F.array_distinct(ids), lambda x: x != "")).alias("alias"))
    met = needy.select("name", F.posexplode(seeds).alias("place", "alias")).join(known.withColumnRenamed("ord", "at"), "alias")
    # of the records of the first alias that has any, those told to be proteins if there are some
    told = F.when(F.col("sequence_kind") == PROTEIN, 0).otherwise(1)
    least = met.groupBy("name").agg(F.min(F.struct("place", told.alias("told"))).alias("least"))
    chosen = met.join(least, "name").where((F.col("place") == F.col("least.place")) & (told == F.col("least.told")))
    one = chosen.groupBy("name", "alias", "sequence").agg(F.min(F.struct("at", "record_id", "target_ids", "sequence_kind")).alias("r"))
    made = one.groupBy("name").agg(F.min("alias").alias("source"), F.array_sort(F.collect_list(F.struct("r", "sequence"))).alias("m"))
    got = own.join(covered.withColumn("has", F.lit(True)), "name", "left").join(made, "name", "left")
    state, n_made = F.coalesce("oligo_state", F.lit("")), F.size("m")
    said = F.transform(F.regexp_extract_all(F.upper(state), F.lit(r"[A-Z]+(\d+)"), 1), lambda x: x.cast("int"))
    n = F.when(F.size(said) == n_made, said).when((n_made == 1) & (F.size(said) > 0), F.slice(said, 1, 1)).otherwise(F.array_repeat(F.lit(1), n_made))
    entity = lambda x, i: F.struct(F.lit(PROTEIN).alias("kind"), x["sequence"].alias("sequence"), F.get(n, i).alias("count"), F.array().cast("array<string>").alias("ids"))
    got = got.withColumn("new", F.when(F.col("m").isNotNull(), T.named_chains(F.transform("m", entity))))
    status = F.when(F.col("has"), "already_covered").when(F.col("m").isNull(), "skipped").when(tokens(F.col("new")) > limit, "skipped").otherwise("added")
    reason = F.when(F.col("has") | (status == "added"), "none").when(F.col("m").isNull(), "no_recoverable_protein_sequence").otherwise(f"oversize_after_repair:{limit}")
    recast = F.array_distinct(F.transform(F.filter("m", lambda x: ~x["r"]["sequence_kind"].eqNullSafe(F.lit(PROTEIN))), lambda x: F.concat(F.lit("recast_sequence_kind:"), F.coalesce(x["r"]["sequence_kind"], F.lit("unknown")))))
    odd = K.informative(F.col("oligo_state")) & Q.stoichiometry(state, n_made).isNull()
    notes = F.array(F.when(~F.col("source").isin(F.col("name"), F.col("lookup")), F.concat(F.lit("alias_fallback:"), "source")), F.when(odd, F.concat(F.lit("unparsed_oligo_state:"), state)))
    rules = F.when(F.col("has"), "existing_input_covers_scoreable_target").when(F.col("m").isNull(), "scoreable_input_repair").otherwise(F.array_join(F.array_compact(F.concat(F.array(F.lit("scoreable_input_repair")), recast, notes)), ","))
    joined = lambda f: F.coalesce(F.array_join(F.transform("m", lambda x: x["r"][f]), ","), F.lit(""))
    of = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("m", lambda x: x["r"]["target_ids"]), lambda x: F.coalesce(x, F.lit("")) != ""))), ",")
    return got.select("name", "ord", "track", status.alias("status"), reason.alias("skip_reason"), F.coalesce("source", F.lit("")).alias("source"), joined("record_id").alias("record_ids"), F.coalesce(of, F.lit("")).alias("target_ids"), rules.alias("rules"), F.when(status == "added", F.col("new")).alias("sequences"))


def with_repairs(tasks: DataFrame, made: DataFrame) -> DataFrame:
    """Tasks, and after them those that were added, in the order of their targets."""
    added = made.where("status = 'added'").select("name", F.lit(True).alias("added"), "ord", "sequences")
    return tasks.select("name", F.lit(False).alias("added"), "ord", "sequences").unionByName(added)


#: Derivations by name, with the tables that each needs besides the tasks, and what else sets it apart; add to it to plug in others.
DERIVATIONS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], dict]] = {
    "domain_fragment_inputs": (domain_fragments, ("domains",), {}),
    "antibody_fv_inputs": (variable_domains, (), {}),
    "oversize_domain_monomer_fallback": (domain_to_one_copy, ("targets",), {}),
    "large_target_split_or_fallback": (within_limit, ("targets",), {}),
    "sequence_recovery": (recovered, ("targets", "records"), {}),
    "protein_oligo_sequence_recovery": (recovered, ("targets", "records"), {"tracks": ("protein_oligo",)}),
    "sequence_recovery_large_target_fallback": (recovered_within_limit, ("targets", "records"), {}),
    "oligo_stoichiometry_recovery": (with_official_counts, ("targets", "states"), {}),
    "oligo_stoichiometry_token_safe": (with_official_counts, ("targets", "states"), {"token_safe": True}),
    "protein_oligo_sequence_stoich_token_safe": (recovered_with_official_counts, ("targets", "records", "states"), {}),
    "scoreable_target_subset": (scoreable_subset, ("targets",), {}),
    "scoreable_target_subset_oligo_first": (scoreable_subset, ("targets",), {"oligo_first": True}),
    "scoreable_target_subset_oligo_size_first": (scoreable_subset, ("targets",), {"oligo_first": True, "size_first": True}),
    "scoreable_target_subset_input_repair": (repaired, ("targets", "records"), {}),
}


def derive(name: str, tasks: DataFrame, **tables: DataFrame) -> DataFrame:
    """A derivation or a cleaning of sequences by its name; tables that it doesn't need are left aside, a missing one is told."""
    if name in S.STRATEGIES:
        return S.apply(tasks, name)
    if name not in DERIVATIONS:
        raise ValueError(f"unknown strategy: {name}; known are {', '.join([*S.STRATEGIES, *DERIVATIONS])}")
    made, needs, more = DERIVATIONS[name]
    missing = [t for t in needs if tables.get(t) is None]
    if missing:
        raise ValueError(f"{name} needs the tables {', '.join(missing)}")
    return made(tasks, *(tables[t] for t in needs), **more)
