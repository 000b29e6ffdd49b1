"""Rows that only larger tables have, and plans whose work must follow the input."""

from pyspark.sql import functions as F

from podium.operators import lookups as K
from podium.operators import review as V

KINDS = [(1, "T1001", "r", "MKV", "proteinChain"), (2, "T1001", "r", "MKV", "rnaSequence"), (3, "T1001", "r", "MKV", "rnaSequence")]


def index(spark):
    return K.alias_index(spark.createDataFrame(KINDS, "ord long, target_ids string, record_id string, sequence string, kind string"))


def test_records_of_two_kinds_are_two(spark):
    """a record id and sequence told under two kinds is in the index once for each."""
    got = index(spark).where("alias = 'T1001'").select("ord", "kind").orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(1, "proteinChain"), (2, "rnaSequence")]


def test_first_alias_with_records_of_two_kinds(spark):
    """the preferred kind is found although an equal record of another kind came first."""
    rows = [(1, "T1001", "r", "MKV", "rnaSequence"), (2, "T1001", "r", "MKV", "proteinChain")]
    records = spark.createDataFrame(rows, "ord long, target_ids string, record_id string, sequence string, kind string")
    targets = spark.createDataFrame([("T1001",)], "target_id string")
    assert [r["kind"] for r in K.first_alias_records(targets, K.alias_index(records)).collect()] == ["proteinChain"]


def test_targets_with_records_of_two_kinds(spark):
    """both kinds count."""
    targets = spark.createDataFrame([("T1001",)], "target_id string")
    assert [tuple(r) for r in K.with_records(targets, index(spark)).collect()] == [("T1001", 2, "r,r")]


def rows_into(df, node):
    """The nodes of the optimized plan, outermost first, down to the first of a kind."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text[: text.index(node)]


def test_chain_audit_covers_before_it_pairs(spark):
    """coverage is worked out below the step that tells targets apart; repeated reviews and ids without a structure keep their rows."""
    one = [(i, [(1, 10)], "p1,p2") for i in (1, 1, 2)]
    reviews = spark.createDataFrame(one, "target_id long, wanted array<struct<lo:int,hi:int>>, pdb_ids string")
    structures = spark.createDataFrame([(1, "p1"), (2, "p1"), (2, "p2")], "target_id long, pdb_id string")
    chains = spark.createDataFrame([("p1", "A", [(1, 9)]), ("p1", "B", [(5, 6)])], "pdb_id string, chain string, observed array<struct<lo:int,hi:int>>")
    got = V.chain_audit(reviews, structures, chains)
    a, b = (lambda t: (t, "p1", "A", 0.9, True)), (lambda t: (t, "p1", "B", 0.2, False))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([a(1), a(1), b(1), b(1), a(2), b(2), (2, "p2", "no_atoms", None, False)], key=str)
    assert "explode(target_ids" in rows_into(got, "Join LeftOuter")


def test_chain_audit_deals_the_chains_of_a_structure(spark):
    """chains of one structure lie in many tasks, with the rows of each pair; null and repeated chains, and null ranges, stay."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        reviews = spark.createDataFrame([(1, [(1, 10)], "p"), (2, [(1, 10)], "p"), (3, [(5, 6)], "q")], "target_id long, wanted array<struct<lo:int,hi:int>>, pdb_ids string")
        chains = spark.range(0, 500, 1, 1).selectExpr("'p' as pdb_id", "cast(id as string) as chain", "array(named_struct('lo', 1, 'hi', cast(id % 12 as int))) as observed")
        odd = spark.createDataFrame([("p", None, [(1, 5)]), ("p", "0", [(1, 5)]), ("p", "x", None)], "pdb_id string, chain string, observed array<struct<lo:int,hi:int>>")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = V.chain_audit(reviews, reviews.select("target_id", reviews["pdb_ids"].alias("pdb_id")), chains.unionByName(odd)).withColumn("task", F.spark_partition_id())
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = [(t, "p", str(i), min(i % 12, 10) / 10) for t in (1, 2) for i in range(500)]
    want += [(t, "p", c, v) for t in (1, 2) for c, v in (("no_atoms", 0.5), ("0", 0.5), ("x", None))] + [(3, "q", "no_atoms", None)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in rows)
    assert len({r["task"] for r in rows if r["pdb_id"] == "p"}) > 1


def test_assembly_audit_compares_sets_once(spark):
    """sets are compared below the steps that tell pairs apart; null ids and repeated rows stay."""
    cands = spark.createDataFrame([(1, ["a", "b"], 0), (None, ["b", "a"], 0), (1, ["a", "b"], 0)], "target_id long, chains array<string>, pdb_id long")
    assemblies = spark.createDataFrame([(7, ["a", "b", "c"], 0), (8, [], 0)], "assembly_id long, members array<string>, pdb_id long")
    got = V.assembly_audit(cands, assemblies)
    want = [(t, *rest) for t in (1, None, 1) for rest in ((7, 2, True, False), (8, 0, False, False))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert rows_into(got, "Join Inner").count("explode(") >= 3


def test_assembly_audit_deals_pairs_to_tasks(spark):
    """one structure with one set of chains doesn't leave all pairs to one task, and pieces of lists lose no pair."""
    cands = spark.range(1, 3002, 1, 1).selectExpr("id as target_id", "array('a') as chains", "0L as pdb_id")
    assemblies = spark.range(1, 12, 1, 1).selectExpr("id as assembly_id", "array('a', 'b') as members", "0L as pdb_id")
    got = V.assembly_audit(cands, assemblies).withColumn("task", F.spark_partition_id())
    assert got.select("target_id", "assembly_id").distinct().count() == got.count() == 3001 * 11
    assert got.select("task").distinct().count() >= 3


def test_assembly_audit_tells_plain_ids_apart(spark):
    """no struct is read for each pair; null ids on both sides and repeated ones keep their pairs."""
    cands = spark.createDataFrame([(None, ["a"], 0), (1, ["a"], 0), (1, ["a"], 0)], "target_id long, chains array<string>, pdb_id long")
    assemblies = spark.createDataFrame([(None, ["a"], 0), (7, ["a"], 0)], "assembly_id long, members array<string>, pdb_id long")
    got = V.assembly_audit(cands, assemblies)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((t, a, 1, True, True)) for t in (None, 1, 1) for a in (None, 7))
    above = rows_into(got, "Join Inner")
    assert ".target_id" not in above and ".assembly_id" not in above


def test_sections_take_pieces_in_batches(spark):
    """pieces come to Python by the batch, a file that goes on in the next batch keeps its state."""
    from podium.sources import sections

    body = "Target: T1 x\n#  Model  GR#  GDT_TS\n" + "\n".join(f"{i} T1TS{i:03d}_1 {i} 5.0" for i in range(1, 40))
    pieces = [(f, i, body[i : i + 7]) for f in ("f", "g") for i in range(0, len(body), 7)] + [("g", 10_000, None), (None, 0, "Target: T9\n# Model\n1 x")]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        told = sections.told_lines(spark.createDataFrame(pieces, "file string, pos long, text string"))
        got = sorted(map(tuple, told.select("file", "n", "target", "line").collect()), key=str)
        plan = told._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = [(f, i + 1, "T1", f"{i} T1TS{i:03d}_1 {i} 5.0") for f in ("f", "g") for i in range(1, 40)] + [(None, 2, "T9", "1 x")]
    assert got == sorted(want, key=str) and "MapInArrow" in plan


def test_atoms_make_no_map_of_a_loop_row(spark):
    """quoted, short and odd cells of loops, and single blocks, as category() gives them; loop rows without a map."""
    from podium.sources import structures as X

    keys = "loop_\n_atom_site.group_PDB\n_atom_site.label_asym_id\n_atom_site.label_entity_id\n_atom_site.label_seq_id\n"
    text = keys + "ATOM A 'x y' 7\nHETATM 'B' ? 8\nATOM A 1 .\nATOM A\nTER A 1 9\nATOM ' 1 4 5 6\n#\n_atom_site.group_PDB ATOM\n_atom_site.label_seq_id '3'\n#\n"
    got = X.atoms(spark.createDataFrame([("f", text)], "file string, text string"))
    assert sorted(tuple(r)[2:] for r in got.collect()) == sorted([("", "", "", 3), ("A", "", "x y", 7), ("B", "", "", 8), ("'", "", "1", 4)])
    assert "array_position" in got._jdf.queryExecution().optimizedPlan().toString()


def test_small_files_are_dealt_to_tasks(spark):
    """rows that take long are dealt by key, not by the few splits of a small file."""
    from podium.plans import catalog

    for name in ("str11_leader_cut", "arr2_strategy_registry", "src3_html_tables"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan, name


def plan_of(spark, name):
    from podium.plans import catalog

    return catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_target_stats_copy_no_rows(spark):
    """distinct groups are counted without a copy of the rows for each count."""
    assert "Expand" not in plan_of(spark, "agg5_target_stats")


def test_ranges_cast_no_blanks(spark):
    """a blank does not come to a cast; odd parts, overflows and single positions read as before."""
    from pyspark.sql import functions as F

    from podium.functions import intervals as I

    read = lambda f, x: [tuple(r) for r in spark.range(1).select(f(F.lit(x)).alias("x")).first()["x"]]
    assert read(I.parse, "9 - 3; 7, x,5-99999999999") == [(3, 9), (7, 7), (5, 5)]
    assert read(I.parse_strict, "9-3, 4-5") == [(9, 3), (4, 5)] and read(I.parse_strict, "9-3, x") == []
    assert "= )" in plan_of(spark, "str7_ranges")


def test_blank_ids_have_no_aliases_to_work_out(spark):
    """F16: aliases of a blank lookup or official id are passed over."""
    assert "(lookup" in plan_of(spark, "arr2_input_repair") and "CASE WHEN (official" in plan_of(spark, "arr2_input_repair")


def test_ladder_shuffles_no_product(spark):
    """the outermost join of the plan is the one with the runs."""
    plan = plan_of(spark, "prj14_score_ladder")
    assert plan.index("Join Cross") < plan.index("Join LeftOuter")


def test_a_text_is_encoded_in_one_call():
    """op10: words that are rare are no calls of their own; blanks, special tokens and odd words have the file's ids."""
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from podium.llm import packing

    own, t = packing.Tokens(P.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    bpe, calls = own.bpe, []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(bpe, name)

    own.bpe = Counted()
    texts = [" ".join(f"w{i}x{i * i}" for i in range(1000)), "a  b \t c\u00a0 d \n", "x<|endoftext|> y", " " * 40, "ab" * 5000, "\u4f60\u597d \U0001f600 e\u0301"]
    got = [np.frombuffer(own.encode(x), dtype=own.kind).tolist() for x in texts]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts] and len(calls) == len(texts)


def test_segments_leave_a_pool_by_the_batch():
    """F8: what a pool is dealt is handed on while it is dealt; a worker holds no more than a batch of it."""
    import pyarrow as pa

    from podium.operators import shards

    taken = []

    def rows():
        deal = shards.Deal(shards=6, least=1)
        for size in range(40_000, 0, -1):
            taken.append(size)
            for s in deal.give(size, 1):
                yield "p", size, s

    batches = shards.in_batches(rows(), pa.string())
    first = next(batches)
    assert first.num_rows <= shards.RUNS and len(taken) <= shards.RUNS
    assert first.num_rows + sum(b.num_rows for b in batches) == 40_000


def test_pools_stream_through_the_worker(spark):
    """F8: no group of a pool is handed to Python whole."""
    from podium.operators import shards

    df = spark.createDataFrame([(p, str(i), i, i) for p in ("p", "q", None) for i in range(50)], "pool string, name string, ord long, tokens long")
    plan = shards.shard(df, shards=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_many_open_shards_are_not_gone_through_for_each_size():
    """a size with fewer tasks than there are open shards asks the heap for its smallest alone."""
    from podium.operators import shards

    class Heap(list):
        read = 0

        def __iter__(self):
            Heap.read += 1
            return super().__iter__()

    deal = shards.Deal(shards=None, max_tokens=20_000, least=0)
    deal.heap = Heap()
    for size in range(9_999, 5_000, -1):
        for _ in deal.give(size, 7):
            pass
    assert len(deal.heap) > 1_000 and Heap.read < 100 and deal.live == sum(e[3] for e in list.__iter__(deal.heap))


def test_no_edges_start_no_workers(spark, tmp_path):
    """op2, pipeline: an empty table of components doesn't come from Python, whose workers would stay beside the others."""
    from podium.llm import common

    got = common.components(common.Scratch(spark), spark.range(3).selectExpr("id as a", "id as b"))
    assert got.columns == ["id", "component"] and got.collect() == []
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()


def test_remembered_words_stay_few():
    """op2, pipeline: each worker of a core remembers words for some 6 MB at most."""
    from podium.llm import common

    memory = common.WordHash()
    assert memory[b"w0"] == common.word_hashes([b"w0"])[0]
    most = 0
    for i in range(120_000):
        memory[b"w%d" % i]
        most = max(most, len(memory))
    assert most <= 50_000


def test_words_are_hashed_without_memory(monkeypatch):
    """op4: words don't go through a memory that rare ones empty, which took longer than to hash each of them anew."""
    from podium.llm import common

    monkeypatch.setattr(common.WordHash, "__missing__", None)
    got = common.word_hashes([b"new", b"words", b"new"])
    assert got[0] == got[2] != got[1] and (common.Words([b"new words", None, b"new"]).hashes == got).all()


def test_sidecars_meet_a_folder_once_for_each_path(spark):
    """what is first in a folder is met by the path, not by a key beside its names; each place of the order still counts."""
    from podium.operators import candidates

    names = ["a/p_sample_1.cif", "b/p_sample_1.cif", "c/p_sample_1.cif", "d/p_sample_1.cif", "e/p_sample_1.cif", "f/x.cif", "p_sample_2.cif", "f/x.cif", None]
    own = ["a/p_summary_confidence_sample_1.json", "a/summary_confidence_sample_1.json", "b/summary_confidence_sample_1.json", "b/a_summary_confidence_sample_1.json",
           "c/z_summary_confidence_sample_1.json", "c/q_summary_confidence_sample_1.json", "d/p_sample_1_summary_confidence.json", "d/a_summary_confidence.json",
           "e/b_summary_confidence.json", "e/a_summary_confidence.json", "e/a.json", "summary_confidence_sample_2.json", "summary_confidence_sample_2.json", "g/summary_confidence.json", None]
    got = candidates.sidecar(*(spark.createDataFrame([(x,) for x in rows], "path string") for rows in (names, own)))
    want = [(names[0], own[0]), (names[1], own[2]), (names[2], own[5]), (names[3], own[6]), (names[4], own[9]), (names[6], own[11])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ", any" not in plan and plan.count("Generate") == 2


def test_sidecars_are_sorted_by_hashes(spark):
    """groups and joins by paths, which begin alike, are led by a hash, and paths are not met with themselves again."""
    from podium.operators import candidates

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        some = spark.createDataFrame([("a/p_sample_1.cif",), ("a/x.cif",), ("b/x.cif",)], "path string")
        got = candidates.sidecar(some, spark.createDataFrame([("a/p_sample_1_summary_confidence.json",), ("a/a_summary_confidence.json",), ("b/x.json",)], "path string"))
        assert sorted(map(tuple, got.collect())) == [("a/p_sample_1.cif", "a/p_sample_1_summary_confidence.json"), ("a/x.cif", "a/a_summary_confidence.json")]
        plan = got._jdf.queryExecution().sparkPlan().toString()
        joins = [x for x in plan.splitlines() if "SortMergeJoin" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(joins) == 2 and all("SortMergeJoin [at#" in x for x in joins)


def test_sidecar_names_are_spelled_out_once(spark):
    """conditions on the names that the query makes don't repeat the expressions below the distinct paths."""
    import __spark_entry__

    got = __spark_entry__.queries()["src17_sidecar"](spark, "/root/testdata/sf0.001")
    filters = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Filter " in x]
    assert filters and not any("regexp_extract" in x for x in filters)
