"""Queries of sources and sinks: texts are made from the driver tables, parsed, and compared with them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import sections, sinks, structures, texts
from .registry import query


def place(t, name: str) -> str:
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local") or t.spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/podium-checkpoints"
    return f"{base.rstrip('/')}/podium-{name}-{uuid.uuid4().hex}"


@query("src7_tsv_round_trip", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_name, chr(9), '\"q\"') ELSE '' END AS p_name, '' AS absent FROM part")
def _(t):
    path = place(t, "tsv")
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit('\t"q"')))
    sinks.delimited(t.part.select("p_partkey", name.alias("p_name")), path, ["p_partkey", "p_name", "absent"])
    return texts.delimited(t.spark, path)


@query("src8_csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, concat(c_name, ',', c_mktsegment) AS label FROM customer")
def _(t):
    path = place(t, "csv")
    sinks.delimited(t.customer.select("c_custkey", F.concat_ws(",", "c_name", "c_mktsegment").alias("label")), path, ["c_custkey", "label"], sep=",")
    return texts.delimited(t.spark, path, sep=",")


@query("src2_target_list", "SELECT concat('T', CAST(n_nationkey AS VARCHAR)) AS target_id, 'T' AS target_prefix, n_name AS \"Type\" FROM nation WHERE n_nationkey % 4 <> 0")
def _(t):
    path = place(t, "targets")
    name = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit(" T"), F.col("n_nationkey").cast("string")))
    sinks.delimited(t.nation.select(name.alias("Target"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("Type")), path, ["Target", "Type"], sep=";")
    return texts.target_list(texts.delimited(t.spark, path, sep=";")).select("target_id", "target_prefix", "Type")


@query("src5_fasta", "SELECT record_id, sequence, CAST(length(sequence) AS INTEGER) AS length FROM chains", "chains")
def _(t):
    body = F.concat(F.lit(">"), "record_id", F.lit(" | "), "header", F.lit("\n"), F.substring("sequence", 1, 20), F.lit("\n\n"), F.lower(F.substr("sequence", F.lit(21))), F.lit("\n>empty\n\n"))
    return texts.fasta(t.chains.select(F.col("ord").cast("string").alias("file"), body.alias("text"))).select("record_id", "sequence", "length")


@query(
    "src6_score_table",
    SCORES := "SELECT concat('T', CAST(1000 + l_orderkey % 9000 AS VARCHAR)) AS target_id, concat('T', CAST(1000 + l_orderkey % 9000 AS VARCHAR), 'TS', lpad(CAST(l_suppkey AS VARCHAR), 3, '0'), '_', CAST(l_linenumber AS VARCHAR)) AS model, CAST(l_suppkey AS VARCHAR) AS \"group\", 'GDT_TS' AS primary_metric, l_quantity AS primary_score FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem)",
)
def _(t):
    return texts.score_table(score_texts(t), "prot_domains").select("target_id", "model", "group", "primary_metric", "primary_score")


def score_texts(t):
    name = F.concat(F.lit("T"), (1000 + F.col("l_orderkey") % 9000).cast("string"))
    row = F.concat_ws("   ", "l_linenumber", F.concat(name, F.lit("TS"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0"), F.lit("_"), F.col("l_linenumber").cast("string")), "l_suppkey", "l_quantity", F.lit("a b"))
    per = t.lineitem.groupBy("l_orderkey", name.alias("target")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    body = F.concat(F.lit("Target: "), "target", F.lit(" x\n# note\n#  Model  GR#  GDT_TS  Comment\n"), "rows", F.lit("\nskipped line"))
    return per.select(F.col("l_orderkey").cast("string").alias("file"), body.alias("text"))


@query("src6_split_table", SCORES)
def _(t):
    pieces = score_texts(t).select("file", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,23}"), 0)).alias("pos", "text"))
    return sections.score_table_pieces(pieces, "prot_domains").select("target_id", "model", "group", "primary_metric", "primary_score")


@query("src3_html_tables", None)
def _(t):
    cells = F.array_join(F.transform(F.array(F.col("p_partkey").cast("string"), F.lit("x"), F.col("p_size").cast("string"), F.concat(F.lit("T"), (1000 + F.col("p_partkey") % 9000).cast("string"), F.lit("-D1: 3-"), F.col("p_size").cast("string")), F.lit("12"), F.lit("easy 1abc")), lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), "")
    return texts.domain_summary(t.dealt("part", "p_partkey").select(F.col("p_partkey").cast("string").alias("file"), F.concat(F.lit("<table><tr>"), cells, F.lit("</tr></table>")).alias("text")))


@query("src3_page_tables", None)
def _(t):
    return texts.table_cells(t.pages.select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"))).select("file", "row", F.size("cells").alias("cells"))


@query("src4_anchored_references", "SELECT concat('T', CAST(1000 + p_partkey % 9000 AS VARCHAR)) AS target_id, CASE WHEN p_size % 2 = 0 THEN '1abc,2xyz' ELSE '3def' END AS pdb_ids, CAST(p_partkey AS VARCHAR) AS file FROM part")
def _(t):
    link = F.concat(F.lit('<p><a href="target.cgi?id=1"> T'), (1000 + F.col("p_partkey") % 9000).cast("string"), F.lit("</a> "))
    body = F.concat(link, F.lit("nothing"), link, F.when(F.col("p_size") % 2 == 0, '<a href="/structure/2XYZ">x</a><a href="?structureId=1abc">y</a>').otherwise("<b>PDB code:</b> 3DEF, 1234"), link, F.lit("/structure/9zzz"))
    return texts.anchored_references(t.part.select(F.col("p_partkey").cast("string").alias("file"), body.alias("text")))


@query("src9_task_lists", "SELECT CAST(o_custkey AS VARCHAR) AS file, concat('job', CAST(o_orderkey AS VARCHAR)) AS name, 1 AS entities FROM orders")
def _(t):
    task = F.struct(F.concat(F.lit("job"), F.col("o_orderkey").cast("string")).alias("name"), F.array(F.create_map(F.lit("proteinChain"), F.struct(F.col("o_orderpriority").alias("sequence"), F.lit(1).alias("count")))).alias("sequences"))
    docs = t.orders.groupBy("o_custkey").agg(F.to_json(F.collect_list(task)).alias("text"))
    return texts.tasks(docs.select(F.col("o_custkey").cast("string").alias("file"), "text")).select("file", "name", F.size("sequences").alias("entities"))


@query("src18_metric_outputs", "SELECT p_partkey, p_size / 100.0 AS gdt_ts, 0.5 AS tm_score, CAST(p_size AS DOUBLE) AS dockq, 0.25 AS qsglob FROM part WHERE p_size > 1")
def _(t):
    size = F.col("p_size").cast("string")
    out = F.concat(F.lit("GDT-TS-score= "), size, F.lit("\nTM-score = 0.5\nTotal DockQ over 3: "), size, F.lit("\nQS_global: 0.25"))
    return t.part.where("p_size > 1").select("p_partkey", *(c.alias(k) for k, c in texts.metric_values(out).items()))


@query("src18_json_report", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 64.0 END AS qsglob, CASE WHEN p_size % 2 = 0 THEN 'unmapped_model_chains:A,B' ELSE '' END AS diagnostic FROM part")
def _(t):
    body = F.concat(F.lit('{"'), F.when(F.col("p_size") % 3 == 1, "QSglob").otherwise("qs_global"), F.lit('": "'), F.when(F.col("p_size") % 3 == 0, "none").otherwise((F.col("p_size") / 64.0).cast("string")), F.lit('", "mdl_chains_without_chem_mapping": '), F.when(F.col("p_size") % 2 == 0, '["A","B"]').otherwise("[]"), F.lit("}"))
    return t.part.select("p_partkey", texts.qs_json(body).alias("q")).select("p_partkey", "q.*")


ATOMS = "SELECT l_partkey AS part, CAST(l_orderkey % 200 AS INT) AS residue, substr('ABCD', CAST(l_linenumber % 4 + 1 AS INT), 1) AS asym FROM lineitem"


@query("src12_observed_chains", f"WITH a AS ({ATOMS}) SELECT CAST(part AS VARCHAR) AS file, asym, CAST(count(DISTINCT residue) AS INTEGER) AS residues FROM a GROUP BY 1, 2")
def _(t):
    return structures.chains(structure_texts(t)).select("file", "asym", F.size("residues").alias("residues"))


def structure_texts(t):
    asym = F.substring(F.lit("ABCD"), 1, 4)
    chain = F.substr(asym, (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1))
    row = F.concat_ws("  ", F.lit("ATOM"), chain, F.lit("'x y'"), (F.col("l_orderkey") % 200).cast("string"))
    per = t.lineitem.groupBy("l_partkey").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    body = F.concat(F.lit("data_x\n#\nloop_\n_atom_site.group_PDB\n_atom_site.label_asym_id\n_atom_site.label_entity_id\n_atom_site.label_seq_id\n"), "rows", F.lit("\nHETATM A 1 .\n#\n_pdbx_struct_assembly.id 1\n_pdbx_struct_assembly.oligomeric_details\n'dimeric form'\n#\n"))
    return per.select(F.col("l_partkey").cast("string").alias("file"), body.alias("text"))


@query("src13_assembly_category", "SELECT CAST(l_partkey AS VARCHAR) AS file, '1' AS id, 'dimeric form' AS details FROM lineitem GROUP BY 1")
def _(t):
    got = structures.category(structure_texts(t), "_pdbx_struct_assembly")
    return got.select("file", F.col("values")["id"].alias("id"), F.col("values")["oligomeric_details"].alias("details"))


@query("snk11_cropped_atoms", f"WITH a AS ({ATOMS}) SELECT CAST(part AS VARCHAR) AS file, count(*) AS n FROM a WHERE asym IN ('A', 'C') AND (residue BETWEEN 10 AND 40 OR residue BETWEEN 90 AND 99) GROUP BY 1")
def _(t):
    ranges = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((10, 40), (90, 99))))
    return structures.cropped(structures.atoms(structure_texts(t)), ranges, ["A", "C"]).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("src16_catalog", "SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part")
def _(t):
    out = None
    for name in ("region", "nation", "part"):
        one = getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("src15_availability", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'failed' WHEN p_partkey % 2 = 0 THEN 'cached' ELSE 'downloaded' END AS status FROM part")
def _(t):
    want = t.part.select("p_partkey")
    have = t.part.where("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("cached"))
    return want.join(have, "p_partkey", "left").select("p_partkey", F.when(F.col("cached").isNull(), "failed").when(F.col("cached"), "cached").otherwise("downloaded").alias("status"))


@query("src14_recorded_responses", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 90 THEN 'rejected:identity' WHEN event_type = 'error' THEN 'deferred' ELSE 'candidate' END AS status FROM events")
def _(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", F.when(k >= 90, "rejected:identity").when(F.col("event_type") == "error", "deferred").otherwise("candidate").alias("status"))


@query("snk3_documents", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    path = place(t, "json")
    sinks.documents(t.nation.select("n_nationkey", "n_name"), path)
    return t.spark.read.schema("n_nationkey int, n_name string").json(path)


@query("snk4_markdown", "SELECT concat('| ', CAST(r_regionkey AS VARCHAR), ' | ', r_name, ' |') AS line FROM region")
def _(t):
    text = sinks.markdown(t.region.orderBy("r_regionkey"), ["r_regionkey", "r_name"])
    return t.spark.createDataFrame([(x,) for x in text.split("\n")[2:]], "line string")


@query("snk6_status_log", "SELECT 'R1' AS run_id, 'failed' AS status")
def _(t):
    path = place(t, "log")
    for i, status in enumerate(("pending", "running", "failed")):
        sinks.append_status(t.spark, path, run_id="R1", status=status, benchmark="B", ord=i)
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.max_by("status", "ord").alias("status"))
