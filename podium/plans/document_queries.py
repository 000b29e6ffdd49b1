"""Queries on documents of unknown shape: jobs of task inputs, guards, recorded answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as D
from ..operators import documents as J
from ..operators import leaderboard as L
from ..operators import runs as R
from ..sources import responses as A
from ..sources import texts
from .registry import query

#: Ten jobs a document; the other side spells keys in another order, has some jobs changed, some missing and some more, and every ninth document is cut off.
SIDES = """p AS (SELECT p_partkey AS k, concat('J', CAST(p_partkey AS VARCHAR)) AS name, p_size, p_brand, CAST(floor(p_partkey / 10) AS BIGINT) % 9 = 4 AS cut FROM part),
      base AS (SELECT * FROM p WHERE k % 13 <> 0), other AS (SELECT *, k % 7 = 0 AS changed FROM p WHERE k % 11 <> 0 AND NOT cut)"""


def inputs(t, side: str):
    k = F.col("p_partkey")
    tags = F.array(F.lit("x"), F.col("p_brand"))
    if side == "base":
        job, keep = F.to_json(F.struct(F.concat(F.lit("J"), k.cast("string")).alias("name"), F.col("p_size").alias("size"), F.struct(tags.alias("tags"), F.lit(1.5).alias("w")).alias("more"))), k % 13 != 0
    else:
        size = F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
        job, keep = F.to_json(F.struct(F.struct(F.lit(1.50).alias("w"), tags.alias("tags")).alias("more"), size.alias("size"), F.concat(F.lit("J"), k.cast("string")).alias("name"))), k % 11 != 0
    docs = t.part.where(keep).groupBy(F.floor(k / 10).alias("d")).agg(F.array_join(F.collect_list(job), " ,\n").alias("jobs"))
    whole = F.concat(F.lit("[ 7, {}, "), "jobs", F.lit(" ]"))
    return docs.select(F.concat(F.lit("S"), F.col("d").cast("string")).alias("source"), whole.alias("body") if side == "base" else F.when(F.col("d") % 9 == 4, F.concat(F.lit("["), "jobs", F.lit(","))).otherwise(whole).alias("body"))


def both(t):
    return J.jobs(inputs(t, "base")), J.jobs(inputs(t, "other"))


CHANGES = f"{SIDES}, ch AS (SELECT coalesce(b.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'missing' WHEN b.name IS NULL THEN 'extra' WHEN changed THEN 'changed' END AS change FROM base b FULL JOIN other o ON b.k = o.k)"


@query("join18_job_differences", f"WITH {CHANGES} SELECT name, change FROM ch WHERE change IS NOT NULL")
def _(t):
    return J.differences(*both(t))


@query("join18_changed_keys", f"WITH {CHANGES} SELECT name, 'size' AS key FROM ch WHERE change = 'changed'")
def _(t):
    return J.keys_changed(*both(t))


@query("join18_broken_documents", "SELECT DISTINCT concat('S', CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS VARCHAR)) AS source, 'malformed' AS problem FROM part WHERE p_partkey % 11 <> 0 AND CAST(floor(p_partkey / 10) AS BIGINT) % 9 = 4")
def _(t):
    return J.broken(inputs(t, "other"))


@query(
    "join18_document_guard",
    f"""WITH {CHANGES}, sp AS (SELECT concat('R', CAST(n_nationkey AS VARCHAR)) AS run_id, n_nationkey AS k FROM nation WHERE n_nationkey % 6 <> 5),
      want AS (SELECT concat('R', CAST(n_nationkey AS VARCHAR)) AS run_id FROM nation),
      f AS (SELECT 0 AS part, run_id AS a, 0 AS b, concat(run_id, ':missing_run_spec') AS text FROM want WHERE run_id NOT IN (SELECT run_id FROM sp)
        UNION ALL SELECT 0, run_id, 1, concat(run_id, ':unexpected_seeds') FROM sp WHERE k % 4 = 0 UNION ALL SELECT 0, run_id, 2, concat(run_id, ':unexpected_sample') FROM sp WHERE k % 10 = 3
        UNION ALL SELECT 1, '', 0, concat('target_set_mismatch:missing=', CAST(count(*) FILTER (WHERE change = 'missing') AS VARCHAR), ' extra=', CAST(count(*) FILTER (WHERE change = 'extra') AS VARCHAR)) FROM ch
        UNION ALL SELECT 2, '', 0, concat('unexpected_changed_targets:', string_agg(name, ',' ORDER BY name)) FROM (SELECT name FROM ch WHERE change = 'changed' AND CAST(substr(name, 2) AS BIGINT) % 2 = 1 ORDER BY name LIMIT 12) HAVING count(*) > 0
        UNION ALL SELECT 3, '', 0, concat('missing_changes:', string_agg(name, ',' ORDER BY name)) FROM (SELECT name FROM p WHERE k % 14 = 0 AND name NOT IN (SELECT name FROM ch WHERE change = 'changed') ORDER BY name LIMIT 12) HAVING count(*) > 0)
      SELECT 'blocked' AS status, (SELECT string_agg(text, ';' ORDER BY part, a, b) FROM (SELECT * FROM f ORDER BY part, a, b LIMIT 25)) AS failures, (SELECT count(*) FROM f) AS n_failures""",
)
def _(t):
    run = F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("run_id")
    specs = t.nation.where("n_nationkey % 6 <> 5").select(run, F.when(F.col("n_nationkey") % 4 == 0, "101").otherwise("101,102").alias("seeds"), (F.col("n_nationkey") % 10).alias("sample"))
    allowed = t.part.where("p_partkey % 14 = 0").select(F.concat(F.lit("J"), F.col("p_partkey").cast("string")).alias("name"))
    return J.variant_guard(specs, t.nation.select(run), {"unexpected_seeds": "seeds = '101,102'", "unexpected_sample": "sample <> 3"}, J.differences(*both(t)), allowed)


# -- recorded answers ---------------------------------------------------------------------------

ANSWERS = """t AS (SELECT p_partkey AS k, p_size, concat('T', CAST(p_partkey AS VARCHAR)) AS target_id, concat(CAST(p_partkey % 9 + 1 AS VARCHAR), 'AB', CAST(p_partkey % 10 AS VARCHAR)) AS id FROM part),
      h AS (SELECT *, unnest([0, 2]) AS place FROM t WHERE k % 12 > 1), hits AS (SELECT *, CASE place WHEN 0 THEN id ELSE concat('9', substr(id, 2)) END AS pdb_id, CASE place WHEN 0 THEN '1' ELSE CAST(p_size AS VARCHAR) END AS entity_id FROM h)"""


def searches(t):
    """Answers with two good hits and one of another form; some empty, some cut off."""
    k = F.col("p_partkey")
    code = F.concat((k % 9 + 1).cast("string"), F.lit("ab"), (k % 10).cast("string"))
    body = F.concat(F.lit('{"total_count": 3, "result_set": [{"identifier": "'), code, F.lit('_1", "score": 1.0}, {"score": 0.5, "identifier": "XABC_2"}, {"identifier": "9'), F.substr(code, F.lit(2)), F.lit("_"), F.col("p_size").cast("string"), F.lit('"}]}'))
    return t.part.select(F.concat(F.lit("T"), k.cast("string")).alias("target_id"), F.when(k % 12 == 0, "").when(k % 12 == 1, F.substr(body, F.lit(1), F.lit(60))).otherwise(body).alias("body"))


@query("src14_hits", f"WITH {ANSWERS} SELECT target_id, CAST(place AS INTEGER) AS place, concat(pdb_id, '_', entity_id) AS hit, pdb_id, entity_id FROM hits")
def _(t):
    return A.hits(searches(t))


@query(
    "src14_candidate_rows",
    f"""WITH {ANSWERS}, ids AS (SELECT DISTINCT id AS pdb_id, CAST(concat(substr(id, 1, 1), substr(id, 4)) AS INT) AS x FROM t),
      r AS (SELECT hits.*, x, entity_id = '1' AS seen FROM hits LEFT JOIN ids USING (pdb_id))
      SELECT target_id, CAST(place AS INTEGER) AS place, concat(pdb_id, '_', entity_id) AS hit, pdb_id, entity_id, 11 AS target_length, CASE WHEN x % 8 IN (2, 3, 4) THEN concat('A title of ', pdb_id) ELSE '' END AS entry_title,
        CASE WHEN x % 8 = 2 THEN '2024-01-02' ELSE '' END AS release_date, CASE x % 8 WHEN 2 THEN 'X-RAY' WHEN 3 THEN 'NMR,EM' WHEN 4 THEN 'EM' ELSE '' END AS experimental_method,
        CASE WHEN seen THEN concat('chain of ', pdb_id) ELSE '' END AS entity_description, CASE WHEN seen THEN 'A,B' ELSE '' END AS asym_ids, CASE WHEN seen THEN '7' ELSE '' END AS auth_asym_ids, CASE WHEN seen THEN CAST([11, 14, 5, 4][x % 4 + 1] AS INTEGER) END AS entity_length,
        CASE WHEN seen AND x % 4 = 0 THEN '{A.EQUAL}' WHEN seen AND x % 4 = 1 THEN '{A.TARGET_INSIDE}' WHEN seen AND x % 4 = 2 THEN '{A.ENTITY_INSIDE}' ELSE '{A.UNVERIFIED}' END AS candidate_status,
        CASE WHEN x % 8 = 0 THEN 'HTTP Error 404' WHEN x % 8 = 1 THEN 'malformed' WHEN x % 8 < 7 THEN 'none' ELSE 'not_recorded' END AS entry_error, CASE WHEN seen THEN 'none' ELSE 'not_recorded' END AS entity_error FROM r""",
)
def _(t):
    k = F.col("p_partkey")
    targets = t.part.select(F.concat(F.lit("T"), k.cast("string")).alias("target_id"), F.concat(F.lit("mk"), F.substring("p_brand", 1, 5), F.lit("7\n8 LE")).alias("sequence"))
    ids = t.part.select(F.concat((k % 9 + 1).cast("string"), F.lit("AB"), (k % 10).cast("string")).alias("pdb_id"), ((k % 9 + 1) * 10 + k % 10).alias("x")).distinct()
    text = lambda s: F.replace(F.lit(s), F.lit("ID"), F.col("pdb_id"))
    title, kind = '"struct": {"title": "A title\\nof ID "}', F.col("x") % 8
    body = F.when(kind == 1, '{"struct": {"title": ').when(kind == 2, text("{" + title + ', "rcsb_accession_info": {"initial_release_date": "2024-01-02"}, "exptl": [{"method": "X-RAY"}]}')).when(kind == 3, text("{" + title + ', "rcsb_entry_info": {"experimental_method": ["NMR", "EM"]}}'))
    body = body.when(kind == 4, text("{" + title + ', "rcsb_entry_info": {"experimental_method": "EM"}}')).when(kind == 5, '{"struct": "odd", "exptl": []}').when(kind == 6, "")
    entries = ids.where("x % 8 < 7").select("pdb_id", body.alias("body"), F.when(kind == 0, "HTTP Error 404").alias("error"))
    chain = F.when(F.col("x") % 4 == 0, "MKBRAND\\n55LE").when(F.col("x") % 4 == 1, "GSMKBRANDXXLEX").when(F.col("x") % 4 == 2, "RANDX").otherwise("WWWW")
    entity = F.concat(F.lit('{"entity_poly": {"pdbx_seq_one_letter_code_can": "'), chain, F.lit('"}, "rcsb_polymer_entity": {"pdbx_description": "chain of '), "pdb_id", F.lit('"}, "rcsb_polymer_entity_container_identifiers": {"asym_ids": ["A", "B"], "auth_asym_ids": [7]}}'))
    entities = ids.select("pdb_id", F.lit("1").alias("entity_id"), entity.alias("body"), F.lit("").alias("error"))
    return A.candidate_rows(targets, A.hits(searches(t)), entries, entities)


# -- confidences, merges, landing ---------------------------------------------------------------


def confidence_files(t):
    """A confidence file for each line: some cut off, some lists, some without a number."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    path = F.concat_ws("/", F.lit("out"), F.col("l_suppkey").cast("string"), F.concat(k.cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("_summary_confidence.json")))
    number = F.when(F.col("l_linenumber") == 3, F.lit("null")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    body = F.concat(F.lit('{"plddt": '), number, F.lit(', "ptm": 0.5, "chains": {"A": [1]}}'))
    body = F.when(F.col("l_orderkey") % 7 == 0, F.lit('{"plddt": ')).when(F.col("l_orderkey") % 7 == 1, F.lit("[1]")).otherwise(body)
    return t.lineitem.select(path.alias("path"), F.concat(F.lit("R"), F.col("l_suppkey").cast("string")).alias("run_id"), body.alias("body"), "l_linenumber")


FILES = "f AS (SELECT concat('out/', l_suppkey, '/', l_orderkey * 10 + l_linenumber, '_', l_partkey, '_summary_confidence.json') AS path, concat('R', l_suppkey) AS run_id, l_orderkey % 7 > 1 AS fine, l_linenumber AS n, CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS INT) END AS q FROM lineitem)"


@query("src17_overlay", f"WITH {FILES} SELECT path, CASE WHEN NOT fine THEN NULL WHEN n = 2 THEN '90' ELSE CAST(q AS VARCHAR) END AS plddt, CASE WHEN fine THEN '0.5' END AS ptm, CASE WHEN fine THEN '{{\"A\":[1]}}' END AS chains, CASE WHEN fine AND n = 2 THEN '0.25' END AS consensus_score FROM f")
def _(t):
    files = confidence_files(t)
    beside = F.regexp_replace("path", r"\.json$", ".selection_qa.json")
    body = F.when(F.col("l_linenumber") == 2, '{"consensus_score": 0.25, "plddt": 90}').otherwise("{")
    got = D.overlaid(files, files.where("l_linenumber in (2, 4)").select(beside.alias("path"), body.alias("body")))
    return got.select("path", *(F.element_at("fields", F.lit(k)).alias(k) for k in ("plddt", "ptm", "chains", "consensus_score")))


@query("agg9_confidence_files", f"WITH {FILES} SELECT run_id, count(*) AS files, count(*) FILTER (WHERE fine) AS read, round(avg(q) FILTER (WHERE fine), 6) AS mean_plddt, round(avg(0.5) FILTER (WHERE fine), 6) AS mean_ptm FROM f GROUP BY 1")
def _(t):
    return L.confidence_means(confidence_files(t), ("plddt", "ptm"))


@query(
    "snk8_merged_runs",
    """WITH s AS (SELECT s_nationkey AS m, s_suppkey AS k, s_suppkey % 5 AS e, s_nationkey % 4 = 1 AND s_suppkey % 2 = 0 AS odd FROM supplier),
      e AS (SELECT m, k, 0 AS pos, CAST(100 + e AS VARCHAR) AS seed FROM s UNION ALL SELECT m, k, 1, '101' FROM s), d AS (SELECT m, seed, min(k * 2 + pos) AS w FROM e GROUP BY 1, 2),
      g AS (SELECT m, string_agg(seed, ',' ORDER BY w) AS seeds, count(*) AS n FROM d GROUP BY 1), p AS (SELECT m, count(*) AS shards, count(DISTINCT odd) AS kinds, count(*) FILTER (WHERE k % 3 > 0) AS delivered FROM s GROUP BY 1),
      c AS (SELECT m, sum(n) AS files, count(*) FILTER (WHERE n > 1) AS collisions FROM (SELECT m, CASE WHEN m % 4 = 2 THEN k % 2 ELSE k END AS path, count(*) AS n FROM s WHERE m % 4 <> 3 OR k % 3 > 0 GROUP BY 1, 2) GROUP BY 1)
      SELECT m AS merged, shards, seeds, CAST(n * 2 AS INTEGER) AS candidates, CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(collisions, 0) AS BIGINT) AS collisions,
        CASE WHEN kinds > 1 THEN 'mixed_policy' WHEN m % 4 = 3 AND delivered < shards THEN 'shard_without_files' WHEN collisions > 0 THEN 'path_collision' ELSE 'none' END AS problem
      FROM p JOIN g USING (m) LEFT JOIN c USING (m)""",
)
def _(t):
    m, k = F.col("s_nationkey"), F.col("s_suppkey")
    seeds = F.concat((100 + k % 5).cast("string"), F.lit(" , 101,"))
    policy = F.when((m % 4 == 1) & (k % 2 == 0), "odd").otherwise("")
    one = F.lit("x")
    specs = t.supplier.select(m.alias("merged"), k.alias("shard"), k.alias("ord"), seeds.alias("seeds"), F.lit(2).alias("sample"), one.alias("benchmark"), one.alias("model"), one.alias("manifest"), policy.alias("policy"))
    files = t.supplier.where("s_nationkey % 4 <> 3 OR s_suppkey % 3 > 0").select(m.alias("merged"), k.alias("shard"), F.concat(F.lit("a/"), F.when(m % 4 == 2, k % 2).otherwise(k).cast("string")).alias("rel_path"))
    return R.merged_runs(specs, files)


@query(
    "src15_materialized",
    """WITH w AS (SELECT concat('T', p_partkey) AS target_id, p_partkey AS k, unnest([concat('A', p_partkey % 400), concat('B', p_size)]) AS pdb_id FROM part WHERE p_partkey % 4 > 0),
      i AS (SELECT *, CAST(substr(pdb_id, 2) AS INT) AS n, substr(pdb_id, 1, 1) AS h FROM w)
      SELECT DISTINCT target_id, pdb_id, 'candidate' AS status, CASE WHEN n % 3 = 0 AND h = 'A' THEN 'cached' WHEN n % 5 = 0 AND h = 'A' THEN 'download_failed:HTTP 404' WHEN h = 'A' THEN 'downloaded' ELSE 'download_failed:not_fetched' END AS download_status,
        CASE WHEN h <> 'A' OR n % 3 <> 0 AND n % 5 = 0 THEN NULL WHEN n % 3 = 0 THEN CAST(n AS BIGINT) ELSE CAST(n + 1 AS BIGINT) END AS bytes, CASE WHEN h <> 'A' OR n % 3 <> 0 AND n % 5 = 0 THEN '' WHEN n % 3 = 0 THEN 'old' ELSE 'new' END AS sha256 FROM i""",
)
def _(t):
    k = F.col("p_partkey")
    status = F.when(k % 4 == 0, "rejected").otherwise(" Candidate")
    wanted = t.part.select(F.concat(F.lit("t"), k.cast("string")).alias("target_id"), F.concat(F.lit("a"), (k % 400).cast("string"), F.lit("; b"), F.col("p_size").cast("string"), F.lit(",")).alias("pdb_ids"), status.alias("status"))
    n = (k % 400).cast("long")
    ids = t.part.select(n.alias("n"), F.concat(F.lit("a"), n.cast("string")).alias("pdb_id")).distinct()
    there = ids.where("n % 3 = 0").select("pdb_id", F.col("n").alias("length"), F.lit("old").alias("sha256"))
    bad = F.col("n") % 5 == 0
    fetched = ids.select("pdb_id", F.when(~bad, F.col("n") + 1).alias("length"), F.when(~bad, "new").alias("sha256"), F.when(bad, "HTTP 404").alias("error"))
    return texts.materialized(wanted, there, fetched)
