"""Queries on lookups, sequences, ranges, tasks, candidates, caches and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import scores as S
from ..functions import sequences as Q
from ..operators import cache as C
from ..operators import candidates as D
from ..operators import lookups as K
from ..operators import ranges as G
from ..operators import review as V
from ..operators import shards as H
from ..operators import tasks as T
from .registry import query

# -- lookups ------------------------------------------------------------------------------------

ALIASES = "unnest(CASE WHEN regexp_full_match({0}, '[THRDML][012]\\d{{3}}(S\\d+|V\\d+)?') THEN list_distinct([{0}, concat(substr({0}, 1, 1), '0', substr({0}, 3)), concat(substr({0}, 1, 1), '1', substr({0}, 3)), concat(substr({0}, 1, 1), '2', substr({0}, 3))]) ELSE [{0}] END)"
INDEX = f"under AS (SELECT *, {ALIASES.format('target_ids')} AS alias FROM records), idx AS (SELECT alias, record_id, sequence, kind, min(ord) AS ord FROM under GROUP BY 1, 2, 3, 4)"
PLACED = "placed AS (SELECT target_id, place, CASE WHEN place = 0 THEN target_id ELSE concat(substr(target_id, 1, 1), p, substr(target_id, 3)) END AS alias FROM (SELECT DISTINCT target_id FROM targets) CROSS JOIN (VALUES (0, ''), (1, '0'), (2, '1'), (3, '2')) v(place, p) WHERE place = 0 OR p <> substr(target_id, 2, 1))"


def one_each(t):
    return t.targets.select("target_id").distinct()


@query("join1_alias_index", f"WITH {INDEX} SELECT alias, record_id, ord FROM idx", "records")
def _(t):
    return K.alias_index(t.records).select("alias", "record_id", "ord")


@query("join1_with_records", f"WITH {INDEX}, g AS (SELECT alias, CAST(count(*) AS INTEGER) AS n, string_agg(record_id, ',' ORDER BY ord, record_id) AS ids FROM idx GROUP BY 1) SELECT DISTINCT target_id, coalesce(n, 0) AS n_records, coalesce(ids, '') AS record_ids FROM targets LEFT JOIN g ON alias = target_id", "records targets")
def _(t):
    return K.with_records(one_each(t), K.alias_index(t.records))


@query("join2_metadata", f"WITH k AS (SELECT DISTINCT target_ids AS key FROM records), e AS (SELECT target_id AS key, arg_max(description, ord) AS exact FROM targets GROUP BY 1), u AS (SELECT ord, description, {ALIASES.format('target_id')} AS key FROM targets), a AS (SELECT key, arg_min(description, ord) AS by_alias FROM u GROUP BY 1) SELECT key, coalesce(exact, by_alias) AS description FROM k LEFT JOIN e USING (key) LEFT JOIN a USING (key)", "records targets")
def _(t):
    return K.metadata(t.records.select(F.col("target_ids").alias("key")).distinct(), t.targets, "description")


@query(
    "join2_informative_state",
    f"WITH k AS (SELECT DISTINCT target_ids AS key FROM records), told AS (SELECT target_id, arg_max(oligo_state, ord) AS state FROM targets WHERE trim(oligo_state) NOT IN ('', '-') GROUP BY 1), x AS (SELECT key, {ALIASES.format('key')} AS alias FROM k), b AS (SELECT key, arg_min(state, alias) AS by_alias FROM x JOIN told ON alias = target_id GROUP BY 1) SELECT key, coalesce(told.state, by_alias, '') AS oligo_state FROM k LEFT JOIN told ON key = target_id LEFT JOIN b USING (key)",
    "records targets",
)
def _(t):
    return K.informative_state(t.records.select(F.col("target_ids").alias("key")).distinct(), t.targets)


@query("join3_last_row", "SELECT run_id, arg_max(status, ord) AS status, arg_max(value, ord) AS value FROM status_log GROUP BY 1", "status_log")
def _(t):
    return K.last_row(t.status_log, "run_id", ["status", "value"])


@query("join3_gathered_ranges", "SELECT target, string_agg(concat(lo, '-', hi), ',' ORDER BY lo, hi) AS ranges FROM ranges GROUP BY 1", "ranges")
def _(t):
    got = K.gathered_ranges(t.ranges, "target")
    return got.select("target", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["lo"], r["hi"])), ",").alias("ranges"))


@query("join4_listed", "SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_custkey, c_name) AS names FROM customer GROUP BY 1")
def _(t):
    got = K.listed(t.customer.select("c_nationkey", F.col("c_custkey").alias("ord"), "c_name"), "c_nationkey", "c_name")
    return got.select("c_nationkey", F.array_join("c_names", ",").alias("names"))


@query("join4_override", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b,a' ELSE 'a,b,c' END AS ids FROM part")
def _(t):
    own, want = F.array(*map(F.lit, "abc")), F.when(F.col("p_size") % 2 == 0, F.array(*map(F.lit, "bxa"))).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", F.array_join(K.override(own, want), ",").alias("ids"))


JOBS = "jobs AS (SELECT DISTINCT target_ids AS job FROM records)"


def jobs(t):
    return t.records.select(F.col("target_ids").alias("job")).distinct()


@query(
    "join12_keep_scoreable",
    f"WITH {JOBS}, w AS (SELECT DISTINCT target_id, {ALIASES.format('target_id')} AS alias FROM targets WHERE size % 2 = 0), o AS (SELECT job, {ALIASES.format('job')} AS alias FROM jobs), k AS (SELECT job, string_agg(DISTINCT target_id, ',' ORDER BY target_id) AS kept_for FROM o JOIN w USING (alias) GROUP BY 1) SELECT job, coalesce(kept_for, '') AS kept_for, CASE WHEN kept_for IS NULL THEN 'dropped' ELSE 'kept' END AS status FROM jobs LEFT JOIN k USING (job)",
    "records targets",
)
def _(t):
    return K.keep_scoreable(jobs(t), t.targets, available="size % 2 = 0")


@query(
    "join13_recover",
    f"WITH {JOBS}, {INDEX}, {PLACED}, m AS (SELECT p.target_id, place, i.record_id, kind, i.ord, row_number() OVER (PARTITION BY p.target_id, sequence ORDER BY place, i.ord) AS n FROM placed p JOIN idx i USING (alias) WHERE p.target_id NOT IN (SELECT job FROM jobs)) SELECT target_id, place, record_id, kind, ord FROM m WHERE n = 1",
    "records targets",
)
def _(t):
    # places are numbered over the aliases that differ; make them comparable with phases
    got = K.recover(one_each(t), jobs(t), K.alias_index(t.records))
    phase = F.substring("target_id", 2, 1).cast("int")
    return got.withColumn("place", F.when((F.col("place") > 0) & (F.col("place") > phase), F.col("place") + 1).otherwise(F.col("place")).cast("int"))


@query(
    "join14_first_alias",
    f"WITH {INDEX}, {PLACED}, m AS (SELECT p.target_id, place, i.record_id, kind, min(place) OVER (PARTITION BY p.target_id) AS least FROM placed p JOIN idx i USING (alias)), h AS (SELECT *, max(CAST(kind = 'proteinChain' AS INT)) OVER (PARTITION BY target_id) AS has FROM m WHERE place = least) SELECT target_id, record_id, kind FROM h WHERE has = 0 OR kind = 'proteinChain'",
    "records targets",
)
def _(t):
    return K.first_alias_records(one_each(t), K.alias_index(t.records)).select("target_id", "record_id", "kind")


@query("join15_relation", "SELECT p_partkey, CASE WHEN p_name = split_part(p_name, ' ', 1) THEN 'exact' WHEN contains(split_part(p_name, ' ', 1), p_name) THEN 'query_in_hit' WHEN contains(p_name, split_part(p_name, ' ', 1)) THEN 'hit_in_query' ELSE 'different' END AS relation FROM part")
def _(t):
    return t.part.select("p_partkey", K.relation(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("relation"))


@query("join16_pick", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN least(o_orderpriority, o_orderstatus) WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END AS picked FROM orders")
def _(t):
    none = F.array().cast("array<string>")
    a, b = F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderpriority", "o_orderstatus")).otherwise(none), F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(none)
    return t.orders.select("o_orderkey", K.pick(a, b, F.array(F.lit("none"))).alias("picked"))


@query("join16_united", "SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderpriority, o_orderstatus, 'P'])), ',') AS ids FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.array_join(K.united(F.array("o_orderpriority"), F.array("o_orderstatus", F.lit("P"))), ",").alias("ids"))


@query("prj8_overlay", "SELECT upper(p_brand) AS target_id, string_agg(DISTINCT lower(x), ',' ORDER BY lower(x)) AS ids FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS x FROM part WHERE p_size % 3 = 0) GROUP BY 1")
def _(t):
    rows = t.part.select(F.col("p_brand").alias("target_id"), F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("ids"), F.element_at(F.array(F.lit(" Accepted"), F.lit("deferred"), F.lit("candidate")), (F.col("p_size") % 3 + 1).cast("int")).alias("status"), *(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias(c) for c in K.PROVENANCE))
    return K.overlay(rows).select("target_id", F.array_join("ids", ",").alias("ids"))


@query("set1_union_with_provenance", "SELECT 'customer' AS source, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def _(t):
    a = t.customer.select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("nation"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("nation"))).groupBy("source", "nation").agg(F.count(F.lit(1)).alias("n"))


CACHE = "keyed AS (SELECT *, sha256(sequence) AS key FROM cache)"
PREFER = "(n_paths, CAST(has_hash AS INT), -ord)"


@query("set2_merge_preferred", f"WITH {CACHE}, r AS (SELECT *, CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END AS side, row_number() OVER (PARTITION BY key ORDER BY n_paths DESC, has_hash DESC, CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END, ord) AS rn FROM keyed) SELECT key, ord, n_paths, has_hash FROM r WHERE rn = 1", "cache")
def _(t):
    rows = t.cache.select(F.sha2("sequence", 256).alias("key"), "ord", "n_paths", "has_hash")
    return K.merge_preferred(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"), "key").drop("side")


@query("set3_set_report", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a JOIN b USING (k)) AS shared, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) = 0 AND (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) = 0 AS equal")
def _(t):
    return K.set_report(t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), "k")


@query("set4_replaced", "SELECT c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS body, 0 AS part, c_custkey AS ord FROM customer UNION ALL SELECT s_suppkey + 1000000, 'added', 1, s_suppkey FROM supplier")
def _(t):
    old = t.customer.select(F.col("c_custkey").alias("name"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("body"))
    new = old.where("name % 3 = 0").withColumn("body", F.lit("new")).unionByName(t.supplier.select((F.col("s_suppkey") + 1000000).alias("name"), F.col("s_suppkey").alias("ord"), F.lit("added").alias("body")))
    return K.replaced(old, new, "name")


@query("set5_phases", "SELECT 'first' AS phase, c_name AS name, 'none' AS reason FROM customer UNION ALL SELECT 'second', s_name, CASE WHEN s_acctbal < 0 THEN 'negative' ELSE 'none' END FROM supplier")
def _(t):
    return K.phases(first=t.customer.select(F.col("c_name").alias("name")), second=t.supplier.select(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "negative").otherwise("").alias("reason")))


@query("prj16_manifest_rows", "SELECT 'load' AS phase, CAST(p_partkey AS VARCHAR) AS target_id, CASE WHEN p_size % 2 = 0 THEN 'none' ELSE p_type END AS note FROM part")
def _(t):
    return K.phases(load=t.part.select(F.col("p_partkey").alias("target_id"), F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("note")))


# -- sequences and ids --------------------------------------------------------------------------


@query("str3_ids", "SELECT ord, regexp_replace(upper(target_id), '^([A-Z]\\d{4})S\\d+$', '\\1') AS base, upper(target_id) AS of_model, concat('G', CAST(size AS VARCHAR)) AS grp FROM targets", "targets")
def _(t):
    model = F.concat("target_id", F.lit("TSG"), F.col("size").cast("string"), F.lit("_1-D1"))
    plain = F.concat(F.regexp_replace("target_id", "S1$", ""), F.lit("TS"), F.lit("x"))
    first = F.when(F.col("target_id").endswith("S1"), F.upper("target_id")).otherwise(Q.target_of_model(plain))
    return t.targets.select("ord", Q.base_target(F.col("target_id")).alias("base"), first.alias("of_model"), Q.group_of_model(model).alias("grp"))


CONTENT = "CASE WHEN sequence = '' THEN '' WHEN regexp_full_match(sequence, '[ACGTUN]+') THEN CASE WHEN contains(sequence, 'U') THEN 'rnaSequence' ELSE 'dnaSequence' END WHEN NOT regexp_full_match(sequence, '[ABCDEFGHIKLMNPQRSTVWXYZ]+') THEN '' WHEN length(sequence) >= 30 AND length(regexp_replace(sequence, '[ACGTUN]', '', 'g')) / length(sequence) >= 0.10 THEN 'proteinChain' ELSE '' END"


@query("str4_sequence_kind", f"SELECT ord, {CONTENT} AS content, CASE WHEN {CONTENT} = 'proteinChain' THEN 'proteinChain' WHEN substr(record_id, 1, 1) IN ('T', 'H') THEN 'proteinChain' WHEN substr(record_id, 1, 1) = 'R' THEN 'rnaSequence' WHEN regexp_full_match(sequence, '[ACGTUN]*') THEN CASE WHEN contains(sequence, 'U') THEN 'rnaSequence' ELSE 'dnaSequence' END ELSE 'proteinChain' END AS kind FROM chains", "chains")
def _(t):
    return t.chains.select("ord", Q.content_kind(F.col("sequence")).alias("content"), Q.sequence_kind(F.col("record_id"), F.col("header"), F.col("sequence")).alias("kind"))


@query("str5_sanitized", "SELECT ord, regexp_replace(sequence, '[^ACDEFGHIKLMNPQRSTVWYX]', 'X', 'g') AS protein, regexp_replace(replace(sequence, 'T', 'U'), '[^ACGUN]', '', 'g') AS rna, regexp_replace(replace(sequence, 'U', 'T'), '[^ACGTN]', '', 'g') AS dna FROM chains", "chains")
def _(t):
    return t.chains.select("ord", *(Q.sanitized(F.lit(k), F.col("sequence")).alias(n) for k, n in (("proteinChain", "protein"), ("rnaSequence", "rna"), ("dnaSequence", "dna"))))


@query("str6_stoichiometry", "SELECT ord, CASE WHEN oligo_state = '' THEN '1,1' WHEN contains(oligo_state, 'B') THEN CASE WHEN size % 7 = 0 THEN NULL ELSE concat(CAST(size % 7 AS VARCHAR), ',2') END ELSE NULL END AS counts FROM targets", "targets")
def _(t):
    return t.targets.select("ord", F.array_join(Q.stoichiometry(F.col("oligo_state"), F.lit(2)), ",").alias("counts"))


@query("str7_ranges", "SELECT target, concat(CAST(least(lo, hi) AS VARCHAR), CASE WHEN lo = hi THEN '' ELSE concat('-', CAST(greatest(lo, hi) AS VARCHAR)) END, ',7') AS lenient, 0 AS strict FROM ranges", "ranges")
def _(t):
    text = F.concat(F.col("hi").cast("string"), F.lit("-"), F.col("lo").cast("string"), F.lit("; 7, x"))
    return t.ranges.select("target", I.render(I.parse(text)).alias("lenient"), F.size(I.parse_strict(text)).alias("strict"))


@query("str9_tag_trimming", "SELECT ord, CAST(len64 AS INTEGER) AS len FROM (SELECT ord, CASE WHEN ends_with(sequence, 'GSHHHHHH') AND length(sequence) >= 38 THEN length(sequence) - 8 WHEN ends_with(sequence, 'GHHHHHH') AND length(sequence) >= 37 THEN length(sequence) - 7 WHEN ends_with(sequence, 'HHHHHH') AND length(sequence) >= 36 THEN length(sequence) - 6 ELSE length(sequence) END AS len64 FROM chains)", "chains")
def _(t):
    got = t.chains.select("ord", Q.trimmed(F.col("sequence"), epitopes=True).alias("c"))
    return got.select("ord", F.length("c.sequence").alias("len"))


@query("str10_entropy", "WITH l AS (SELECT ord, unnest(string_split(sequence, '')) AS c, length(sequence) AS n FROM chains), p AS (SELECT ord, c, count(*) / max(n) AS p FROM l GROUP BY 1, 2) SELECT ord, round(sum(-p * log2(p)), 9) AS entropy FROM p GROUP BY 1", "chains")
def _(t):
    return t.chains.select("ord", F.round(Q.entropy(F.col("sequence")), 9).alias("entropy"))


@query("str10_low_complexity", None)
def _(t):
    return t.chains.select("ord", Q.low_complexity_cuts(F.col("sequence")).alias("cuts")).select("ord", "cuts.*")


@query("str11_leader_cut", None)
def _(t):
    return t.chains.select("ord", Q.leader_cut(F.concat(F.lit("MKTLLLLAVVLLALLAGSA"), F.col("sequence"))).alias("cut"))


@query("str12_variable_end", "SELECT p_partkey, CASE WHEN 70 + p_size + 11 BETWEEN 85 AND 135 THEN CAST(70 + p_size + 11 AS INTEGER) END AS variable_end FROM part")
def _(t):
    made = F.concat(F.lit("QVQL"), F.repeat(F.lit("A"), F.col("p_size") + 66), F.lit("WGQGTLVTVSS"), F.repeat(F.lit("A"), F.lit(90)))
    return t.part.select("p_partkey", Q.variable_end(made).alias("variable_end"))


@query("str13_fragment", "SELECT ord, CASE WHEN length(sequence) < 40 THEN 'out_of_bounds' ELSE 'ok' END AS status, CASE WHEN length(sequence) < 40 THEN '' ELSE substr(sequence, 5, 36) END AS fragment FROM chains", "chains")
def _(t):
    return t.chains.select("ord", T.fragment(F.col("sequence"), I.parse_strict(F.lit("5-40"))).alias("f")).select("ord", "f.*")


@query("str14_arguments", "SELECT p_partkey, 'a,b' AS items, CASE WHEN p_size % 3 = 0 THEN 'a' ELSE 'b' END AS padded FROM part")
def _(t):
    items = Q.csv_items(F.lit(" a,, b ,"))
    return t.part.select("p_partkey", F.array_join(items, ",").alias("items"), Q.padded(items, (F.col("p_size") % 3).cast("int")).alias("padded"))


@query("win8_longest_run", "SELECT ord, CAST(coalesce(list_max(list_transform(regexp_extract_all(sequence, '[ACGT]+'), lambda x: length(x))), 0) AS INTEGER) AS run FROM chains", "chains")
def _(t):
    return t.chains.select("ord", Q.longest_run(F.col("sequence"), "ACGT").alias("run"))


@query("hash1_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))


@query("map1_metric_map", """SELECT p_partkey, concat('{"brand":"', p_brand, '","size":"', CAST(p_size AS VARCHAR), '"}') AS metrics FROM part""")
def _(t):
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return t.part.select("p_partkey", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))).alias("metrics"))


@query("json1_guarded_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS absent FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.a.b").alias("absent"))


# -- ranges -------------------------------------------------------------------------------------


@query("win5_islands", "WITH p AS (SELECT DISTINCT user_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS p FROM events), g AS (SELECT *, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS i FROM p) SELECT user_id, min(p) AS lo, max(p) AS hi FROM g GROUP BY user_id, i")
def _(t):
    days = t.events.select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("p"))
    return G.combined(days.select("user_id", F.col("p").alias("lo"), F.col("p").alias("hi")), None, ["user_id"])


POS = "pos AS (SELECT target, unnest(generate_series(lo, hi)) AS p FROM ranges)"


@query("agg10_range_coverage", f"WITH {POS}, d AS (SELECT DISTINCT target, p FROM pos) SELECT target, CAST(count(*) AS INTEGER) AS size, round(count(*) FILTER (WHERE p BETWEEN 100 AND 199) / 100.0, 6) AS coverage FROM d GROUP BY 1", "ranges")
def _(t):
    got = G.coverage(hundred(t), t.ranges, ["target"])
    return got.select("target", F.col("size").cast("int").alias("size"), F.round("coverage", 6).alias("coverage"))


def hundred(t):
    """Places 100 to 199 of each target."""
    return t.ranges.select("target").distinct().withColumns({"lo": F.lit(100), "hi": F.lit(199)})


@query("agg10_merged_ranges", f"WITH {POS}, d AS (SELECT DISTINCT target, p FROM pos), g AS (SELECT *, p - row_number() OVER (PARTITION BY target ORDER BY p) AS i FROM d) SELECT target, CAST(min(p) AS INTEGER) AS lo, CAST(max(p) AS INTEGER) AS hi FROM g GROUP BY target, i", "ranges")
def _(t):
    return G.combined(t.ranges, None, ["target"])


ISLANDS = "g AS (SELECT target, p, p - row_number() OVER (PARTITION BY target ORDER BY p) AS i FROM d) SELECT target, CAST(min(p) AS INTEGER) AS lo, CAST(max(p) AS INTEGER) AS hi FROM g GROUP BY target, i"


@query("agg10_missing_ranges", f"WITH {POS}, t AS (SELECT DISTINCT target FROM ranges), d AS (SELECT target, p FROM (SELECT target, unnest(generate_series(100, 199)) AS p FROM t) EXCEPT SELECT target, p FROM pos), {ISLANDS}", "ranges")
def _(t):
    return G.combined(hundred(t), t.ranges, ["target"], G.DIFFERENCE)


@query("agg10_shared_ranges", f"WITH {POS}, d AS (SELECT DISTINCT target, p FROM pos WHERE p BETWEEN 100 AND 199), {ISLANDS}", "ranges")
def _(t):
    return G.combined(hundred(t), t.ranges, ["target"], G.INTERSECTION)


@query("win4_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events")
def _(t):
    from pyspark.sql import Window as W

    seen = F.when(F.col("event_type") == "error", F.col("event_id"))
    return t.events.select("event_id", F.last(seen, ignorenulls=True).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)).alias("last_error"))


@query("win9_first_occurrences", "SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY f) AS seen FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(t):
    listed = K.listed(t.orders.select("o_custkey", F.col("o_orderkey").alias("ord"), "o_orderpriority"), "o_custkey", "o_orderpriority")
    return listed.select("o_custkey", F.array_join(F.array_distinct("o_orderprioritys"), ",").alias("seen"))


@query("win10_unique_labels", "SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE concat(p_name, '_', CAST(n AS VARCHAR)) END AS label FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def _(t):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    return t.part.select("p_partkey", "p_name", n.alias("n")).select("p_partkey", F.when(F.col("n") == 1, F.col("p_name")).otherwise(F.concat_ws("_", "p_name", "n")).alias("label"))


# -- tasks --------------------------------------------------------------------------------------


def documents(t):
    """Tasks as nested documents: the lines of an order are its entities."""
    e = F.struct("pos", "part", "kind", F.repeat(F.lit("A"), F.col("len")).alias("sequence"), F.col("copies").cast("int").alias("count"), F.array().cast("array<string>").alias("ids"))
    got = t.entities.groupBy("task", "name").agg(F.array_sort(F.collect_list(e)).alias("s"))
    return got.select("task", "name", F.transform("s", lambda x: x.dropFields("pos", "part")).alias("sequences"))


@query("agg21_task_size", "SELECT task, CAST(sum(len * copies) AS BIGINT) AS tokens, CAST(sum(copies) AS BIGINT) AS chains, count(*) AS entities, CAST(coalesce(sum(len * copies) FILTER (WHERE kind = 'proteinChain'), 0) AS BIGINT) AS protein FROM entities GROUP BY 1", "entities")
def _(t):
    got = documents(t).select("task", T.task_size(F.col("sequences")).alias("a"), T.task_size(F.col("sequences"), ("proteinChain",)).alias("p"))
    return got.select("task", "a.*", F.col("p.tokens").alias("protein"))


@query("win7_chain_names", "SELECT task, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) ELSE concat('A', chr(CAST(64 + n - 26 AS INTEGER))) END AS last_chain, CAST(n AS INTEGER) AS n FROM (SELECT task, sum(copies) AS n FROM entities GROUP BY 1) WHERE n <= 52", "entities")
def _(t):
    got = documents(t).select("task", F.flatten(F.transform(T.named_chains(F.col("sequences")), lambda e: e["ids"])).alias("ids"))
    return got.select("task", F.element_at("ids", -1).alias("last_chain"), F.size("ids").alias("n")).where("n <= 52")


@query("arr1_new_counts", "SELECT task, CAST(sum(len * (1 + rn % 2)) AS BIGINT) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY pos, part, kind, len, copies) AS rn FROM entities) GROUP BY 1", "entities")
def _(t):
    counts = F.transform(F.sequence(F.lit(1), F.size("sequences")), lambda i: (1 + i % 2).cast("int"))
    return documents(t).select("task", T.task_size(T.with_counts(F.col("sequences"), counts))["tokens"].alias("tokens"))


@query("arr2_cleaned_sequences", "SELECT task, CAST(sum(CASE WHEN kind = 'proteinChain' THEN greatest(len - 2, 0) * copies ELSE len * copies END) AS BIGINT) AS tokens FROM entities GROUP BY 1", "entities")
def _(t):
    shorter = T.with_sequences(F.col("sequences"), lambda s: F.substr(s, F.lit(3)))
    return documents(t).select("task", T.task_size(shorter)["tokens"].alias("tokens"))


@query("srt7_prefix_within_budget", None)
def _(t):
    kept = T.prefix_within(F.col("sequences"), 150)
    return documents(t).select("task", T.task_size(kept)["tokens"].alias("tokens"), F.size(kept).alias("entities"))


@query("srt8_capped_copies", "SELECT task, CAST(CASE WHEN count(*) = 1 AND sum(len * copies) > 60 THEN sum(len) ELSE sum(len * copies) END AS BIGINT) AS tokens FROM entities GROUP BY 1", "entities")
def _(t):
    return documents(t).select("task", T.task_size(T.capped_copies(F.col("sequences"), 60))["tokens"].alias("tokens"))


POOL = "pool AS (SELECT o_orderpriority AS pool, concat('job', CAST(o_orderkey AS STRING)) AS name, o_orderkey AS ord, CAST(floor(o_totalprice) AS BIGINT) AS tokens, CAST(o_custkey % 2 AS INT) AS priority FROM orders)"


def pool(t):
    return t.orders.select(F.col("o_orderpriority").alias("pool"), F.concat(F.lit("job"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("ord"), F.floor("o_totalprice").alias("tokens"), (F.col("o_custkey") % 2).cast("int").alias("priority"))


@query("srt1_task_order", f"WITH {POOL} SELECT pool, name, CAST(row_number() OVER (PARTITION BY pool ORDER BY tokens DESC, ord, name) AS INTEGER) AS place FROM pool", "")
def _(t):
    return T.ordered(pool(t), "size-desc").select("pool", "name", "place")


@query("srt2_shards", None)
def _(t):
    return H.shard(pool(t), shards=6)


@query("srt2_shards_under_cap", None)
def _(t):
    return H.shard_under_cap(t.customer.select(F.col("c_nationkey").cast("string").alias("pool"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"), F.floor(F.abs("c_acctbal")).alias("tokens")), max_tokens=20_000)


@query("srt6_job_priority", f"WITH {POOL} SELECT pool, name, CAST(row_number() OVER (PARTITION BY pool ORDER BY priority, CASE WHEN priority = 0 THEN tokens ELSE 0 END, ord) AS INTEGER) AS place FROM pool", "")
def _(t):
    return T.by_priority(pool(t)).select("pool", "name", "place")


@query("prj1_job_selection", f"WITH {INDEX}, g AS (SELECT alias, count(*) AS n FROM idx GROUP BY 1), c AS (SELECT t.ord, target_id, coalesce(n, 0) AS n, oligo_state, CASE WHEN oligo_state = '' THEN true WHEN contains(oligo_state, 'B') THEN coalesce(n, 0) = 2 AND size % 7 > 0 ELSE coalesce(n, 0) = 1 AND size % 7 > 0 END AS fits FROM targets t LEFT JOIN g ON alias = target_id), s AS (SELECT ord, target_id, CASE WHEN n = 0 THEN 'no_sequence_record' WHEN NOT fits THEN concat('ambiguous_oligo_state:', oligo_state) ELSE '' END AS skip_reason FROM c), k AS (SELECT max(ord) AS last, count(*) AS n FROM (SELECT ord FROM s WHERE skip_reason = '' ORDER BY ord LIMIT 300)) SELECT s.ord, target_id, skip_reason, CASE WHEN skip_reason = '' THEN 'ok' ELSE 'skipped' END AS status FROM s, k WHERE k.n < 300 OR s.ord <= k.last", "records targets")
def _(t):
    got = K.with_records(t.targets, K.alias_index(t.records))
    got = got.withColumn("counts", Q.stoichiometry(F.col("oligo_state"), F.col("n_records")))
    return T.jobs(got, limit=300).select("ord", "target_id", "skip_reason", "status")


# -- candidates ---------------------------------------------------------------------------------

NAMES = "names AS (SELECT n_nationkey AS target_id, concat('/', CAST(n_nationkey AS VARCHAR)) AS alias FROM nation)"


@query(
    "join6_matches",
    "WITH f AS (SELECT page_id, lower(regexp_extract(url, '[^/]*$')) AS name, list_transform(string_split(url, '/')[:-2], lambda x: lower(x)) AS dirs FROM pages), a AS (SELECT n_nationkey AS target_id, CAST(n_nationkey + 60 AS VARCHAR) AS alias, 0 AS place, 'exact' AS match_type FROM nation UNION ALL SELECT n_nationkey, concat('page=', CAST(n_nationkey AS VARCHAR)), 1, 'lookup' FROM nation UNION ALL SELECT n_nationkey, substr('endefres', CAST(n_nationkey % 4 * 2 + 1 AS INT), 2), 2, 'official' FROM nation) SELECT page_id, target_id, min(place) AS place, arg_min(match_type, place) AS match_type FROM f JOIN a ON contains(name, alias) OR list_contains(dirs, alias) GROUP BY 1, 2",
)
def _(t):
    key = F.col("n_nationkey")
    of = lambda alias, place, kind: F.struct(alias.alias("alias"), F.lit(place).alias("place"), F.lit(kind).alias("match_type"))
    language = F.substr(F.lit("ENDEFRES"), (key % 4 * 2 + 1).cast("int"), F.lit(2))
    names = t.nation.select(key.alias("target_id"), F.explode(F.array(of((key + 60).cast("string"), 0, "exact"), of(F.concat(F.lit("Page="), key.cast("string")), 1, "lookup"), of(language, 2, "official"))).alias("a")).select("target_id", "a.*")
    paths = t.pages.select("page_id", F.col("url").alias("path"))
    return D.matches(paths.select("path").distinct(), names).join(paths, "path").select("page_id", "target_id", "place", "match_type")


FOUND = "found AS (SELECT target_id, path, CAST(ord % 3 AS INT) AS place, CASE ord % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'lookup' ELSE 'official' END AS match_type FROM candidates)"


def found(t):
    return t.candidates.select("target_id", "path", (F.col("ord") % 3).cast("int").alias("place"), F.when(F.col("ord") % 3 == 0, "exact").when(F.col("ord") % 3 == 1, "lookup").otherwise("official").alias("match_type"))


@query("join7_match_label", f"WITH {FOUND} SELECT target_id, arg_min(match_type, place) AS match_type FROM found GROUP BY 1", "candidates")
def _(t):
    return found(t).groupBy("target_id").agg(F.min_by("match_type", "place").alias("match_type"))


@query("prj15_exact_only", f"WITH {FOUND} SELECT target_id, path, place FROM found WHERE substr(target_id, -1) <> '3' OR match_type = 'exact'", "candidates")
def _(t):
    return D.exact_only(found(t), t.candidates.select("target_id").where("endswith(target_id, '3')")).select("target_id", "path", "place")


@query("win6_first_candidate", f"WITH {FOUND} SELECT target_id, arg_min(path, (place, CASE WHEN path LIKE '%.cif' THEN 0 ELSE 1 END, path)) AS path, count(*) AS observed FROM found GROUP BY 1", "candidates")
def _(t):
    return D.first_candidate(found(t))


BLEND = "(0.2 * (CASE WHEN plddt > 1 THEN plddt / 100 ELSE plddt END) + 0.5 * ptm + 0.3 * iptm - 0.1 * disorder - CASE WHEN has_clash THEN 0.2 ELSE 0 END)"
OWN = f"(CASE WHEN ranking_score IS NULL THEN {BLEND} ELSE CASE WHEN ranking_score > 1 THEN ranking_score / 100 ELSE ranking_score END - 0.05 * disorder - CASE WHEN has_clash THEN 0.2 ELSE 0 END END)"
MORE = " * 0.7 + 0.2 * coalesce(consensus, 0) + 0.1 * coalesce(support, 0)"


@query("math3_selector_scores", f"SELECT ord, round({BLEND}, 9) AS confidence_v1, round({BLEND}{MORE}, 9) AS diversity_consensus_v1, round({OWN}, 9) AS ranking_v1, round({OWN}{MORE}, 9) AS ranking_consensus_v1 FROM candidates", "candidates")
def _(t):
    c = {k: F.col(k) for k in ("plddt", "ptm", "iptm", "disorder", "has_clash", "ranking_score", "consensus", "support")}
    return t.candidates.select("ord", *(F.round(f(c), 9).alias(n) for n, f in S.SELECTORS.items()))


@query("win6_best_candidate", f"WITH s AS (SELECT target_id, path, {OWN} AS s, row_number() OVER (PARTITION BY target_id ORDER BY {OWN} DESC, path) AS n FROM candidates) SELECT target_id, path, round(s, 6) AS selection_score FROM s WHERE n = 1", "candidates")
def _(t):
    return D.best_candidate(t.candidates, "ranking_v1")


#: A file's confidence is named for its prefix and sample, its sample, its stem, or not at all.
NAMED_SQL = """f AS (SELECT DISTINCT path, regexp_extract(path, '^(.*/)', 1) AS dir, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem FROM candidates),
      g AS (SELECT *, regexp_extract(stem, 'sample_([0-9]+)$', 1) AS n, regexp_extract(stem, '^(.*)_sample_[0-9]+$', 1) AS prefix FROM f),
      h AS (SELECT path, dir, concat(dir, CASE CAST(n AS BIGINT) % 4 WHEN 0 THEN concat(prefix, '_summary_confidence_sample_', n, '.json') WHEN 1 THEN concat('summary_confidence_sample_', n, '.json') WHEN 2 THEN concat(stem, '_summary_confidence.json') END) AS own, CAST(n AS BIGINT) % 4 < 3 AS has FROM g)"""


@query("src17_sidecar", f"WITH {NAMED_SQL}, least AS (SELECT dir, min(own) AS any_one FROM h WHERE has GROUP BY 1) SELECT path, CASE WHEN has THEN own ELSE any_one END AS confidence FROM h JOIN least USING (dir)", "candidates")
def _(t):
    files = t.candidates.select("path").distinct()
    sample, n = F.regexp_extract("path", r"sample_(\d+)\.[^.]*$", 1), F.regexp_extract("path", r"sample_(\d+)\.[^.]*$", 1).cast("long") % 4
    folder, stem, prefix = F.regexp_extract("path", r"^(.*/)", 1), F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1), F.regexp_extract("path", r"([^/]*)_sample_\d+\.[^.]*$", 1)
    name = F.when(n == 0, F.concat(prefix, F.lit("_summary_confidence_sample_"), sample, F.lit(".json"))).when(n == 1, F.concat(F.lit("summary_confidence_sample_"), sample, F.lit(".json"))).when(n == 2, F.concat(stem, F.lit("_summary_confidence.json")))
    # conditions on what is exploded stay above it: below, they would spell the expressions out some forty times for a line
    return D.sidecar(files, files.select(F.explode(F.array(F.concat(folder, name))).alias("path")))


@query(
    "prj14_score_ladder",
    """WITH r AS (SELECT concat('R', CAST(n_nationkey AS VARCHAR)) AS run_id, CASE WHEN n_nationkey % 2 = 0 THEN 'attack' ELSE 'dev' END AS tier, 3 AS declared, n_nationkey FROM nation),
      f AS (SELECT concat('R', CAST(l_suppkey % 8 AS VARCHAR)) AS run_id, concat('T', CAST(l_orderkey AS VARCHAR)) AS target_id, count(*) AS observed FROM lineitem GROUP BY 1, 2),
      m AS (SELECT run_id, target_id, observed, observed % 2 = 1 AS has_raw, CAST(substr(target_id, 2) AS BIGINT) AS k FROM f)
      SELECT r.run_id, t.target_id, track, CASE WHEN rank_eligible <> 'true' THEN 'unranked_target' WHEN tier = 'attack' AND coalesce(m.observed, 0) BETWEEN 1 AND 2 THEN 'partial_candidates' WHEN m.observed IS NULL THEN 'missing_prediction' WHEN reference_status <> 'available' THEN 'missing_reference'
        WHEN NOT has_raw THEN 'metric_unavailable' WHEN k % 5 = 0 THEN 'metric_failed' WHEN k % 7 = 0 THEN 'metric_unparseable' ELSE 'ok' END AS status, coalesce(m.observed, 0) AS observed,
        CASE WHEN rank_eligible = 'true' AND NOT (tier = 'attack' AND coalesce(m.observed, 0) BETWEEN 1 AND 2) AND m.observed IS NOT NULL AND reference_status = 'available' AND has_raw AND k % 5 <> 0 AND k % 7 <> 0 THEN round((k % 100) / 100.0, 6) ELSE 0 END AS score
      FROM r CROSS JOIN run_targets t LEFT JOIN m ON m.run_id = r.run_id AND m.target_id = t.target_id""",
    "run_targets",
)
def _(t):
    name = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    runs = t.nation.select(name("n_nationkey").alias("run_id"), F.when(F.col("n_nationkey") % 2 == 0, "attack").otherwise("dev").alias("budget_tier"), F.lit(3).alias("candidate_count"), F.lit("true").alias("rank_eligible"))
    files = t.lineitem.select(F.concat(F.lit("R"), (F.col("l_suppkey") % 8).cast("string")).alias("run_id"), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("target_id"), F.col("l_orderkey").alias("k"), F.lit("f").alias("path"))
    metrics = files.groupBy("run_id", "target_id", "k").agg(F.count(F.lit(1)).alias("n")).select("run_id", "target_id", F.when(F.col("n") % 2 == 1, "out").alias("raw"), F.when(F.col("k") % 5 == 0, 1).otherwise(0).alias("exit_code"), F.when(F.col("k") % 7 != 0, (F.col("k") % 100) / 100.0).alias("value"))
    return D.score_rows(runs, t.run_targets, files, metrics)


@query("join5_runs_by_targets", "SELECT r_name AS run_id, concat('T', CAST(c_custkey AS VARCHAR)) AS target_id FROM region CROSS JOIN customer")
def _(t):
    return t.region.select(F.col("r_name").alias("run_id")).crossJoin(t.customer.select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("target_id")))


PAIRS = "items AS (SELECT s_nationkey AS target_id, s_suppkey AS item, s_acctbal FROM supplier), pairs AS (SELECT a.target_id, a.item AS a, b.item AS b, CASE WHEN (a.item + b.item) % 11 = 0 THEN NULL ELSE 1 / (1 + abs(a.s_acctbal - b.s_acctbal) / 1000) END AS score FROM items a JOIN items b ON a.target_id = b.target_id AND a.item < b.item)"


@query("agg14_consensus", f"WITH {PAIRS}, each AS (SELECT target_id, a AS item, score FROM pairs UNION ALL SELECT target_id, b, score FROM pairs), per AS (SELECT target_id, item, avg(score) AS mean, count(*) FILTER (WHERE score >= 0.5) AS close FROM each GROUP BY 1, 2), n AS (SELECT target_id, count(*) AS n FROM items GROUP BY 1) SELECT i.target_id, i.item, n, CASE WHEN n = 1 THEN 1 ELSE round(coalesce(mean, 0), 6) END AS consensus, CASE WHEN n = 1 THEN 1 ELSE round((1 + coalesce(close, 0)) / n, 6) END AS support FROM items i JOIN n USING (target_id) LEFT JOIN per ON per.target_id = i.target_id AND per.item = i.item", "")
def _(t):
    items = t.supplier.select(F.col("s_nationkey").alias("target_id"), F.col("s_suppkey").alias("item"), "s_acctbal")
    a, b = items.toDF("target_id", "a", "x"), items.toDF("target_id", "b", "y")
    score = F.when((F.col("a") + F.col("b")) % 11 != 0, 1 / (1 + F.abs(F.col("x") - F.col("y")) / 1000))
    pairs = a.join(b, "target_id").where("a < b").select("target_id", "a", "b", score.alias("score"))
    return D.consensus(pairs, items.drop("s_acctbal"), 0.5)


@query("agg9_confidence_means", "SELECT event_type, count(*) AS files, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k FROM events GROUP BY 1")
def _(t):
    return t.events.select("event_type", F.from_json("props", "k string").alias("c")).groupBy("event_type").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg(F.col("c.k").try_cast("double")), 6).alias("k"))


# -- cache --------------------------------------------------------------------------------------

REDUCED = f"{CACHE}, red AS (SELECT key, arg_max(ord, {PREFER}) AS ord, arg_max(n_paths, {PREFER}) AS n_paths, arg_max(has_hash, {PREFER}) AS has_hash, count(*) AS copies, arg_max(source_run, {PREFER}) AS source_run, arg_max(bytes, {PREFER}) AS bytes FROM keyed GROUP BY 1)"


@query("agg11_cache_index", f"WITH {REDUCED} SELECT key, ord, n_paths, has_hash, copies FROM red", "cache")
def _(t):
    return C.reduced(t.cache).select("key", "ord", "n_paths", "has_hash", "copies")


@query("agg12_cache_summary", f"WITH {REDUCED} SELECT count(*) AS records, CAST(sum(n_paths) AS BIGINT) AS paths, count(*) FILTER (WHERE has_hash) AS hashed, CAST(sum(bytes) AS BIGINT) AS bytes, min(bytes) AS least, max(bytes) AS most, round(avg(bytes), 6) AS mean FROM red", "cache")
def _(t):
    return C.summary(C.reduced(t.cache))


@query("agg12_top_sources", f"WITH {REDUCED} SELECT source_run, count(*) AS records FROM red GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "cache")
def _(t):
    return C.top_sources(C.reduced(t.cache))


REUSE = f"{REDUCED}, ch AS (SELECT doc_id AS ord, source AS task, n_chars AS residues, CASE WHEN lang = 'en' THEN text ELSE concat(text, '!') END AS sequence, CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS own FROM documents), use AS (SELECT ch.ord, task, residues, CASE WHEN own > 0 THEN 'existing' WHEN red.key IS NULL THEN 'missing' WHEN NOT red.has_hash THEN 'stale' ELSE 'reused' END AS status, red.ord AS r FROM ch LEFT JOIN red ON sha256(sequence) = red.key)"


def reuse(t):
    chains = t.documents.select(F.col("doc_id").alias("ord"), F.col("source").alias("task"), F.col("n_chars").alias("residues"), F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("sequence"), F.when(F.col("n_chars") % 5 == 0, 1).otherwise(0).alias("own_paths"))
    return C.reuse(chains, C.reduced(t.cache))


@query("join10_reuse", f"WITH {REUSE} SELECT ord, task, residues, status, CASE WHEN status = 'reused' THEN r END AS source_ord FROM use", "cache")
def _(t):
    return reuse(t)


SUMMED = "SELECT task, count(*) AS chains, count(*) FILTER (WHERE status IN ('existing', 'reused')) AS covered, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'stale') AS stale, round(count(*) FILTER (WHERE status IN ('existing', 'reused')) / count(*), 6) AS coverage FROM use GROUP BY 1"


@query("agg18_reuse_summary", f"WITH {REUSE} {SUMMED}", "cache")
def _(t):
    return C.reuse_summary(reuse(t))


@query("agg22_checks", f"WITH {REUSE}, s AS ({SUMMED}) SELECT task, coverage >= 0.5 AS passes FROM s", "cache")
def _(t):
    return C.checks(C.reuse_summary(reuse(t)), complete=False, least=0.5).select("task", "passes")


@query("agg13_missing_work", f"WITH {REUSE} SELECT task, count(*) AS chains, CAST(sum(residues) AS BIGINT) AS residues, max(residues) AS longest FROM use WHERE status = 'missing' GROUP BY 1 ORDER BY residues DESC, chains DESC, task LIMIT 7", "cache")
def _(t):
    return C.missing_work(reuse(t), 7)


@query("snk7_store_paths", f"WITH {REDUCED} SELECT key, concat('store/', substr(key, 1, 2), '/', key, '/part.', substr(key, 1, 12), '.a3m') AS store_path FROM red", "cache")
def _(t):
    return C.store_paths(C.reduced(t.cache), "store").select("key", "store_path")


@query("snk5_hash_manifest", "SELECT page_id, sha256(html) AS sha, strlen(html) AS bytes FROM pages")
def _(t):
    return t.pages.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("bigint").alias("bytes"))


# -- reviews ------------------------------------------------------------------------------------

ROWS = "tg AS (SELECT p_partkey AS ord, concat(CASE p_size % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'H' ELSE 'M' END, CAST(p_partkey AS VARCHAR), 'o') AS target_id, p_size % 11 = 0 AS cancelled, p_size % 4 AS n_records, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS reference FROM part)"
STATUS = "CASE substr(target_id, 1, 1) WHEN 'T' THEN 'protein_domain' WHEN 'H' THEN 'protein_oligo' ELSE 'other' END AS track, CASE WHEN n_records > 0 THEN 'ok' ELSE 'missing' END AS input_status, CASE WHEN reference <> '' THEN 'available' ELSE 'missing' END AS reference_status, CASE WHEN substr(target_id, 1, 1) = 'M' THEN 'track_out_of_scope' WHEN cancelled THEN 'cancelled' WHEN n_records = 0 THEN 'no_sequence_record' WHEN reference = '' THEN 'reference_missing' ELSE '' END AS skip_reason"


def review_targets(t):
    prefix = F.when(F.col("p_size") % 3 == 0, "T").when(F.col("p_size") % 3 == 1, "H").otherwise("M")
    return t.part.select(F.concat(prefix, F.col("p_partkey").cast("string"), F.lit("o")).alias("target_id"), (F.col("p_size") % 11 == 0).alias("cancelled"), (F.col("p_size") % 4).alias("n_records"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("reference"))


@query("prj6_target_rows", f"WITH {ROWS}, s AS (SELECT target_id, {STATUS} FROM tg) SELECT *, skip_reason = '' AS rank_eligible FROM s")
def _(t):
    return V.target_rows(review_targets(t))


@query("prj7_server_rows", f"WITH {ROWS}, s AS (SELECT target_id, {STATUS} FROM tg) SELECT *, true AS rank_eligible, substr(target_id, 1, length(target_id) - 1) AS lookup_id FROM s")
def _(t):
    return V.server_rows(review_targets(t))


@query("prj9_review", "SELECT CAST(o_orderkey AS VARCHAR) AS target_id, o_orderstatus AS pdb_id, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' WHEN o_orderkey % 3 = 1 THEN 'deferred' ELSE 'candidate' END AS review_status, CASE WHEN o_orderkey % 2 = 0 THEN 'whole_chain' ELSE concat('domain:', o_orderstatus) END AS scoring_mapping, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE concat('seen | ', o_orderpriority) END AS notes FROM orders")
def _(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(k.cast("string").alias("target_id"), F.col("o_orderstatus").alias("pdb_id"), F.when(k % 3 == 0, "rejected:identity").when(k % 3 == 1, "construct_deferred_review").otherwise("exact").alias("status"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("o_orderstatus")).alias("domains"), F.when(k % 5 == 0, "").otherwise("seen").alias("note"), F.col("o_orderpriority").alias("method"))
    return V.review(rows)


CAND = "cand AS (SELECT concat('T', CAST(l_partkey AS VARCHAR)) AS target_id, concat('p', CAST(l_suppkey % 9 AS VARCHAR)) AS pdb_id, CASE WHEN l_linestatus = 'F' OR l_partkey % 4 = 0 THEN 'deferred' WHEN l_partkey % 4 = 1 THEN 'rejected' ELSE 'candidate' END AS review_status FROM lineitem)"
BEST = "tgt AS (SELECT concat('T', CAST(p_partkey AS VARCHAR)) AS target_id, p_brand AS track, CASE WHEN p_size % 2 = 0 THEN 'available' ELSE 'missing' END AS reference_status, p_size / 50.0 AS best_score, p_size % 13 AS total_len FROM part)"


@query("agg20_reference_gaps", f"WITH {CAND}, {BEST}, per AS (SELECT target_id, count(*) AS n, string_agg(DISTINCT pdb_id, ',' ORDER BY pdb_id) AS ids, count(*) FILTER (WHERE review_status <> 'deferred') = 0 AS d, count(*) FILTER (WHERE review_status <> 'rejected') = 0 AS r FROM cand GROUP BY 1) SELECT track, target_id, best_score, total_len, coalesce(n, 0) AS candidates, coalesce(ids, '') AS candidate_ids, CASE WHEN n IS NULL THEN 'search' WHEN d THEN 'wait' WHEN r THEN 'search_again' ELSE 'review' END AS next_action FROM tgt LEFT JOIN per USING (target_id) WHERE reference_status <> 'available'")
def _(t):
    return V.gaps(gap_targets(t), gap_candidates(t))


def gap_targets(t):
    return t.part.select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("target_id"), F.col("p_brand").alias("track"), F.when(F.col("p_size") % 2 == 0, "available").otherwise("missing").alias("reference_status"), (F.col("p_size") / 50.0).alias("best_score"), (F.col("p_size") % 13).alias("total_len"))


def gap_candidates(t):
    k = F.col("l_partkey")
    return t.lineitem.select(F.concat(F.lit("T"), k.cast("string")).alias("target_id"), F.concat(F.lit("p"), (F.col("l_suppkey") % 9).cast("string")).alias("pdb_id"), F.when((F.col("l_linestatus") == "F") | (k % 4 == 0), "deferred").when(k % 4 == 1, "rejected").otherwise("candidate").alias("review_status"))


@query("prj10_next_action", f"WITH {CAND}, {BEST}, per AS (SELECT target_id, count(*) FILTER (WHERE review_status <> 'deferred') = 0 AS d, count(*) FILTER (WHERE review_status <> 'rejected') = 0 AS r FROM cand GROUP BY 1) SELECT CASE WHEN d IS NULL THEN 'search' WHEN d THEN 'wait' WHEN r THEN 'search_again' ELSE 'review' END AS next_action, count(*) AS n FROM tgt LEFT JOIN per USING (target_id) WHERE reference_status <> 'available' GROUP BY 1")
def _(t):
    return V.gaps(gap_targets(t), gap_candidates(t)).groupBy("next_action").agg(F.count(F.lit(1)).alias("n"))


@query("srt5_gap_priority", f"WITH {BEST} SELECT track, target_id, CAST(row_number() OVER (PARTITION BY track ORDER BY best_score DESC, total_len, target_id) AS INTEGER) AS place FROM tgt WHERE reference_status <> 'available'")
def _(t):
    return V.prioritised(V.gaps(gap_targets(t), gap_candidates(t))).select("track", "target_id", "place")


@query("prj2_worklist", "SELECT o_orderkey AS ord, o_orderstatus AS blocker FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY ord LIMIT 50")
def _(t):
    return V.worklist(t.orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("blocker")), ["P", "O"], 50)


@query("join8_chain_audit", f"WITH rv AS (SELECT s_suppkey AS target_id, concat('p', CAST(s_nationkey AS VARCHAR)) AS pdb_id, CAST(s_suppkey % 50 AS INT) AS lo, CAST(s_suppkey % 50 + 99 AS INT) AS hi FROM supplier), ch AS (SELECT concat('p', CAST(target % 25 AS VARCHAR)) AS pdb_id, CAST(target AS VARCHAR) AS chain, target FROM ranges WHERE target % 25 < 20 GROUP BY target), {POS}, d AS (SELECT DISTINCT target, p FROM pos), c AS (SELECT rv.target_id, rv.pdb_id, coalesce(ch.chain, 'no_atoms') AS chain, CASE WHEN ch.chain IS NULL THEN NULL ELSE round((SELECT count(*) FROM d WHERE d.target = ch.target AND p BETWEEN lo AND hi) / 100.0, 6) END AS coverage FROM rv LEFT JOIN ch USING (pdb_id)) SELECT *, coalesce(coverage, 0) >= 0.9 AS supports FROM c", "ranges")
def _(t):
    lo = (F.col("s_suppkey") % 50).cast("int")
    pdb = F.concat(F.lit("p"), F.col("s_nationkey").cast("string"))
    reviews = t.supplier.select(F.col("s_suppkey").alias("target_id"), F.array(F.struct(lo.alias("lo"), (lo + 99).alias("hi"))).alias("wanted"), pdb.alias("pdb_ids"))
    structures = t.supplier.select(F.col("s_suppkey").alias("target_id"), pdb.alias("pdb_id"))
    chains = K.gathered_ranges(G.combined(t.ranges.where("target % 25 < 20"), None, ["target"]), "target").select(F.concat(F.lit("p"), (F.col("target") % 25).cast("string")).alias("pdb_id"), F.col("target").cast("string").alias("chain"), F.col("ranges").alias("observed"))
    return V.chain_audit(reviews, structures, chains)


@query("join9_assembly_audit", "WITH c AS (SELECT o_custkey AS target_id, o_custkey % 40 AS pdb_id, list_distinct(list(o_orderpriority)) AS chains FROM orders GROUP BY 1), a AS (SELECT l_suppkey AS assembly_id, l_suppkey % 40 AS pdb_id, list_distinct(list(o_orderpriority)) AS members FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY 1) SELECT target_id, assembly_id, CAST(len(list_intersect(chains, members)) AS INTEGER) AS shared, len(chains) > 0 AND len(list_intersect(chains, members)) = len(chains) AS contained, len(chains) = len(members) AS same_count FROM c JOIN a USING (pdb_id)")
def _(t):
    cands = t.orders.groupBy(F.col("o_custkey").alias("target_id")).agg(F.collect_set("o_orderpriority").alias("chains")).withColumn("pdb_id", F.col("target_id") % 40)
    both = t.lineitem.where("l_quantity > 45").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    assemblies = both.groupBy(F.col("l_suppkey").alias("assembly_id")).agg(F.collect_set("o_orderpriority").alias("members")).withColumn("pdb_id", F.col("assembly_id") % 40)
    return V.assembly_audit(cands, assemblies)


@query("arr2_strategy_registry", None)
def _(t):
    from ..operators import strategies

    chains = t.chains.select(F.col("ord"), F.array(F.struct(F.lit("proteinChain").alias("kind"), F.col("sequence"), F.lit(1).alias("count"), F.array().cast("array<string>").alias("ids"))).alias("sequences"))
    out = None
    for name in strategies.STRATEGIES:
        one_ = strategies.apply(chains, name).select("ord", F.lit(name).alias("strategy"), "changed", F.length(F.col("sequences")[0]["sequence"]).alias("length"))
        out = one_ if out is None else out.unionByName(one_)
    return out


@query("udf2_file_facts", "SELECT p_partkey, p_size % 2 = 0 AS path_exists, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS path_bytes FROM part")
def _(t):
    from ..operators import external

    path = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    files = t.part.where("p_size % 2 = 0").select(path.alias("path"), F.col("p_size").cast("bigint").alias("length"))
    return external.with_files(t.part.select("p_partkey", path.alias("path")), files, "path").select("p_partkey", "path_exists", "path_bytes")


@query("udf3_newest_source", "SELECT CAST(s_suppkey AS VARCHAR) AS run_id, concat('runs/', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN '/reuse.json' ELSE '/input.json' END) AS source FROM supplier")
def _(t):
    from ..operators import external

    run = F.col("s_suppkey").cast("string")
    names = F.when(F.col("s_suppkey") % 2 == 0, F.array(*map(F.lit, ("input.json", "reuse.json", "x.txt")))).otherwise(F.array(*map(F.lit, ("input.json", "x.txt"))))
    files = t.supplier.select(F.explode(F.transform(names, lambda n: F.concat(F.lit("runs/"), run, F.lit("/"), n))).alias("path"))
    specs = t.supplier.select(run.alias("run_id"), F.concat(F.lit("runs/"), run).alias("run_dir"))
    return external.newest_source(files, specs, ["reuse.json", "input.json"])
