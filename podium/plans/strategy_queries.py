"""Queries on tasks derived from tasks, and on what mappings and structure files name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..operators import derivations as V
from ..sources import structures as X
from .core_queries import documents
from .registry import query

TRACKS = "tr AS (SELECT o_orderkey AS task, CASE WHEN o_custkey % 4 = 1 THEN 'protein_oligo' ELSE 'protein_domain' END AS track FROM orders WHERE o_custkey % 4 <> 0)"
SIZES = "e AS (SELECT task, count(*) AS n, count(*) FILTER (WHERE kind = 'proteinChain') AS np, coalesce(sum(len * copies) FILTER (WHERE kind = 'proteinChain'), 0) AS tokens, max(copies) AS copies, sum(len) AS one, min(len) AS shortest FROM entities GROUP BY 1)"


def tasks(t):
    return documents(t).withColumn("ord", F.col("task")).withColumn("bonds", F.col("task") % 5 == 0)


def targets(t):
    track = F.when(F.col("o_custkey") % 4 == 1, "protein_oligo").otherwise("protein_domain")
    return t.orders.where("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("job"), F.col("o_orderkey").cast("string")).alias("target_id"), track.alias("track"), F.lit("").alias("oligo_state"))


@query(
    "arr2_domain_to_one_copy",
    f"WITH {TRACKS}, {SIZES}, r AS (SELECT e.*, CASE WHEN track IS NULL THEN 'target_metadata_missing' WHEN track <> 'protein_domain' THEN 'not_protein_domain' WHEN n <> np THEN 'requires_protein_only_job' WHEN tokens <= 40 THEN 'within_token_limit' "
    "WHEN task % 5 = 0 THEN 'unsupported_covalent_bonds' WHEN n <> 1 THEN 'requires_single_protein_entity' WHEN copies <= 1 THEN 'count_already_one' ELSE 'none' END AS skip_reason FROM e LEFT JOIN tr USING (task)) "
    "SELECT task, skip_reason, CAST(CASE WHEN skip_reason = 'none' THEN one ELSE tokens END AS BIGINT) AS tokens FROM r",
    "entities",
)
def _(t):
    return V.domain_to_one_copy(tasks(t), targets(t), limit=40).select("task", "skip_reason", "tokens")


@query(
    "arr2_within_limit",
    f"WITH {TRACKS}, {SIZES} SELECT task, CAST(tokens AS BIGINT) AS original_tokens, CASE WHEN track IS NULL THEN 'target_metadata_missing' WHEN n <> np THEN 'requires_protein_only_job' WHEN task % 5 = 0 THEN 'unsupported_covalent_bonds' "
    "WHEN tokens <= 30 THEN 'within_token_limit' WHEN shortest > 30 THEN 'no_entity_fits_token_limit' ELSE 'none' END AS skip_reason FROM e LEFT JOIN tr USING (task)",
    "entities",
)
def _(t):
    return V.within_limit(tasks(t), targets(t), limit=30).select("task", "original_tokens", "skip_reason")


@query(
    "arr2_official_counts",
    f"WITH {TRACKS}, s AS (SELECT *, CASE task % 4 WHEN 0 THEN '' WHEN 1 THEN 'A2' WHEN 2 THEN 'A1B3' ELSE 'A1' END AS state, row_number() OVER (PARTITION BY task ORDER BY pos, part, kind, len, copies) AS rn FROM entities), "
    "e AS (SELECT task, state, count(*) AS n, count(*) FILTER (WHERE kind = 'proteinChain') AS np, max(copies) AS most, CASE state WHEN 'A1B3' THEN 2 WHEN '' THEN 0 ELSE 1 END AS said, "
    "coalesce(sum(len * copies) FILTER (WHERE kind = 'proteinChain'), 0) AS old, sum(len * CASE WHEN state = 'A2' THEN 2 WHEN state = 'A1B3' AND rn = 2 THEN 3 ELSE 1 END) AS new FROM s GROUP BY 1, 2), "
    "r AS (SELECT e.*, CASE WHEN track IS NULL OR track <> 'protein_oligo' THEN 'not_protein_oligo' WHEN n <> np THEN 'requires_protein_only_job' WHEN state = '' THEN 'official_oligo_state_unavailable' WHEN n <> said THEN 'ambiguous_official_oligo_state' "
    "WHEN state = 'A1' AND most = 1 THEN 'already_matches_official_oligo_state' WHEN new > 60 THEN 'oversize_after_recovery' ELSE 'none' END AS skip_reason FROM e LEFT JOIN tr USING (task)) "
    "SELECT task, skip_reason, CAST(CASE WHEN skip_reason = 'none' THEN new ELSE old END AS BIGINT) AS tokens FROM r",
    "entities",
)
def _(t):
    state = F.element_at(F.array(F.lit(""), F.lit("A2"), F.lit("A1B3"), F.lit("A1")), (F.col("task") % 4 + 1).cast("int"))
    states = documents(t).select(F.col("name").alias("key"), state.alias("official_state"))
    return V.with_official_counts(tasks(t), targets(t), states, limit=60, token_safe=True).select("task", "skip_reason", "tokens")


@query(
    "arr2_domain_fragments",
    "WITH p AS (SELECT task, count(*) FILTER (WHERE kind = 'proteinChain') AS n, max(CASE WHEN kind = 'proteinChain' THEN len END) AS len, max(CASE WHEN kind = 'proteinChain' THEN copies END) AS copies FROM entities GROUP BY 1), "
    "d AS (SELECT o_orderkey AS task, concat('D', CAST(o_orderkey AS VARCHAR)) AS domain_id, CASE o_custkey % 4 WHEN 0 THEN '1-5' WHEN 1 THEN '3-2' WHEN 2 THEN '1-2,4-5' ELSE '2-30' END AS r FROM orders), "
    "s AS (SELECT *, CASE WHEN n <> 1 THEN 'requires_single_protein_entity' WHEN copies <> 1 THEN 'requires_single_copy_entity' WHEN r = '1-2,4-5' THEN 'non_contiguous_domain' WHEN r = '3-2' OR (r = '1-5' AND len < 5) OR (r = '2-30' AND len < 30) THEN 'domain_range_out_of_bounds' ELSE 'none' END AS skip_reason FROM p JOIN d USING (task)) "
    "SELECT concat('job', CAST(task AS VARCHAR), '__', domain_id) AS fragment_id, skip_reason, CAST(CASE WHEN skip_reason <> 'none' THEN 0 WHEN r = '1-5' THEN 5 ELSE 29 END AS INTEGER) AS len FROM s",
    "entities",
)
def _(t):
    ranges = F.element_at(F.array(F.lit("1-5"), F.lit("3-2"), F.lit("1-2,4-5"), F.lit("2-30")), (F.col("o_custkey") % 4 + 1).cast("int"))
    domains = t.orders.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("D"), F.col("o_orderkey").cast("string")).alias("domain_id"), F.concat(F.lit("job"), F.col("o_orderkey").cast("string")).alias("target_id"), ranges.alias("residue_ranges"))
    return V.domain_fragments(tasks(t), domains).select("fragment_id", "skip_reason", F.length("fragment").alias("len"))


@query("arr2_variable_domains", "SELECT concat(CAST(p_partkey AS VARCHAR), '__fv') AS name, CAST(81 + p_size AS INTEGER) AS len FROM part WHERE 81 + p_size BETWEEN 85 AND 135")
def _(t):
    made = F.concat(F.lit("QVQL"), F.repeat(F.lit("A"), F.col("p_size") + 66), F.lit("WGQGTLVTVSS"), F.repeat(F.lit("A"), F.lit(90)))
    entity = F.struct(F.lit("proteinChain").alias("kind"), made.alias("sequence"), F.lit(1).alias("count"), F.array(F.lit("A")).alias("ids"))
    rows = t.part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("ord"), F.array(entity).alias("sequences"))
    return V.variable_domains(rows).select("name", F.length(F.col("sequences")[0]["sequence"]).alias("len"))


@query(
    "arr2_scoreable_subset",
    "WITH e AS (SELECT task, coalesce(sum(len * copies) FILTER (WHERE kind = 'proteinChain'), 0) AS tokens FROM entities GROUP BY 1), o AS (SELECT o_orderkey AS task, o_custkey % 3 AS c, o_orderstatus <> 'P' AS there, o_orderpriority = '1-URGENT' AS oligo FROM orders) "
    "SELECT task, CASE WHEN there THEN 'kept' ELSE 'skipped' END AS status, CASE WHEN there THEN concat(CASE c WHEN 0 THEN 'job' WHEN 1 THEN 'JOB' ELSE 'X' END, CAST(task AS VARCHAR), CASE c WHEN 1 THEN 'O' ELSE '' END) ELSE '' END AS kept_for, "
    "CAST(CASE WHEN there THEN CASE WHEN c = 0 AND oligo THEN 0 ELSE 1 END END AS INTEGER) AS priority, CAST(CASE WHEN there AND c = 0 AND oligo THEN tokens ELSE 0 END AS BIGINT) AS size_key FROM e JOIN o USING (task)",
    "entities",
)
def _(t):
    key, c = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 3
    target = F.when(c == 0, F.concat(F.lit("job"), key)).when(c == 1, F.concat(F.lit("JOB"), key, F.lit("O"))).otherwise(F.concat(F.lit("X"), key))
    status = F.when(F.col("o_orderstatus") != "P", "available").otherwise("missing")
    track = F.when(F.col("o_orderpriority") == "1-URGENT", "protein_oligo").otherwise("protein_domain")
    rows = t.orders.select(F.col("o_orderkey").alias("ord"), target.alias("target_id"), track.alias("track"), status.alias("reference_status"), F.when(c == 2, F.concat(F.lit("job"), key)).alias("sequence_lookup_id"), F.lit("").alias("official_target_id"))
    return V.scoreable_subset(tasks(t), rows, oligo_first=True, size_first=True).select("task", "status", "kept_for", "priority", "size_key")


@query("arr2_recovered", None)
def _(t):
    rows = t.targets.withColumn("track", F.lit("protein_domain"))
    records = t.records.select("ord", "target_ids", "record_id", F.lit("").alias("header"), F.repeat("sequence", 2).alias("sequence"), F.col("kind").alias("sequence_kind"))
    return V.recovered(documents(t).withColumn("ord", F.col("task")), rows, records).select("name", "status", "skip_reason", "sources", "record_ids")


@query(
    "str8_mapping",
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '7-9' WHEN 1 THEN concat('5-', CAST(p_size + 5 AS VARCHAR), ',90-95') ELSE '' END AS ranges, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'A,b' ELSE concat('C', CAST(p_size AS VARCHAR)) END AS chains FROM part",
)
def _(t):
    kind = F.col("p_size") % 3
    mapping = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("residue_ranges = 5-"), (F.col("p_size") + 5).cast("string"), F.lit(",90-95 reference_chains=b,A"))).otherwise("residue_range=4;8")
    chain = F.when(kind == 2, F.concat(F.lit("Ref_label_asym_chain C"), F.col("p_size").cast("string"))).otherwise("")
    domain = F.when(kind == 0, "7-9").otherwise("")
    return t.part.select("p_partkey", I.render(I.of_mapping(mapping, domain)).alias("ranges"), F.array_join(I.reference_chains(chain, mapping), ",").alias("chains"))


@query(
    "snk11_cropped_text",
    r"SELECT p_partkey, CAST(CASE WHEN p_size BETWEEN 10 AND 20 THEN 1 ELSE 0 END + CASE WHEN p_size + 5 BETWEEN 10 AND 20 AND p_size % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS kept, "
    r"concat('data_x\nloop_\n_atom_site.id\n_atom_site.label_seq_id\n_atom_site.label_asym_id\n', CASE WHEN p_size BETWEEN 10 AND 20 THEN concat('1 ', p_size, ' A\n') ELSE '' END, CASE WHEN p_size + 5 BETWEEN 10 AND 20 AND p_size % 2 = 0 THEN concat('2 ', p_size + 5, ' A\n') ELSE '' END, '#\n_other.key 1\n') AS text FROM part".replace(r"\n", "' || chr(10) || '"),
)
def _(t):
    size = F.col("p_size")
    chain = F.when(size % 2 == 0, "A").otherwise("B")
    text = F.concat(F.lit("data_x\nloop_\n_atom_site.id\n_atom_site.label_seq_id\n_atom_site.label_asym_id\n1 "), size.cast("string"), F.lit(" A\n2 "), (size + 5).cast("string"), F.lit(" "), chain, F.lit("\n3 . A\n#\n_other.key 1\n"))
    ranges = F.array(F.struct(F.lit(10).alias("lo"), F.lit(20).alias("hi")))
    return t.part.select("p_partkey", X.cropped_text(text, ranges, F.array(F.lit("A"))).alias("c")).select("p_partkey", "c.kept", "c.text")


REPAIR = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s, CASE WHEN o_custkey % 6 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 6 ELSE o_custkey % 6 END AS c FROM orders)
  SELECT concat(CASE WHEN c IN (0, 6) THEN 'JOB' WHEN c = 2 THEN 'VIA' ELSE 'NEW' END, s) AS name, CASE WHEN c = 0 THEN 'already_covered' WHEN c IN (3, 4, 6) THEN 'skipped' ELSE 'added' END AS status,
    CASE c WHEN 3 THEN 'no_recoverable_protein_sequence' WHEN 6 THEN 'no_recoverable_protein_sequence' WHEN 4 THEN 'oversize_after_repair:2560' ELSE 'none' END AS skip_reason, CASE WHEN c IN (0, 3, 6) THEN '' WHEN c = 2 THEN concat('OFF', s) ELSE concat('NEW', s) END AS source,
    CASE WHEN c IN (0, 3, 6) THEN '' ELSE concat('r', s) END AS record_ids, CASE WHEN c IN (0, 3, 6) THEN '' WHEN c = 2 THEN concat('x, off', s) ELSE concat('new', s) END AS target_ids,
    CASE c WHEN 0 THEN 'existing_input_covers_scoreable_target' WHEN 2 THEN concat('scoreable_input_repair,alias_fallback:OFF', s) WHEN 5 THEN 'scoreable_input_repair,recast_sequence_kind:rnaSequence' ELSE 'scoreable_input_repair' END AS rules,
    CAST(CASE c WHEN 1 THEN 40 WHEN 2 THEN 40 WHEN 5 THEN 80 END AS BIGINT) AS tokens FROM o"""


@query("arr2_input_repair", REPAIR)
def _(t):
    key, c = F.col("o_orderkey").cast("string"), F.col("o_custkey") % 6
    target = F.concat(F.when(c == 0, "job").when(c == 2, "via").otherwise("new"), key)
    state = F.when(c == 4, "A70").when(c == 5, "A2").otherwise("")
    official = F.when(c == 2, F.concat(F.lit("off"), key)).otherwise("")
    rows = t.orders.select(F.col("o_orderkey").alias("ord"), target.alias("target_id"), F.lit("protein_domain").alias("track"), state.alias("oligo_state"), F.lit("available").alias("reference_status"), F.lit("true").alias("rank_eligible"), F.lit("").alias("sequence_lookup_id"), official.alias("official_target_id"))
    of = F.when(c == 2, F.concat(F.lit("x, off"), key)).otherwise(F.concat(F.lit("new"), key))
    kind = F.when(c == 5, "rnaSequence").otherwise("proteinChain")
    records = t.orders.where(~c.isin(0, 3)).select(F.col("o_orderkey").alias("ord"), of.alias("target_ids"), F.concat(F.lit("r"), key).alias("record_id"), F.lit("").alias("header"), F.repeat(F.lit("MKVL "), F.lit(10)).alias("sequence"), kind.alias("sequence_kind"))
    got = V.derive("scoreable_target_subset_input_repair", tasks(t), targets=rows, records=records)
    return got.select("name", "status", "skip_reason", "source", "record_ids", "target_ids", "rules", V.tokens(F.col("sequences")).alias("tokens"))
