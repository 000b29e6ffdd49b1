"""Small cases of operators that SQL can't check, with answers worked out by hand."""

from pyspark.sql import functions as F

from podium.functions import scores as S
from podium.functions import sequences as Q
from podium.operators import lookups, shards, tasks
from podium.sources import folders, texts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lenient_float(spark):
    got = [one(spark, S.lenient_float(F.lit(x))) for x in ("99.67", "-", "12abc", "1e-3", ".5", "N/A", "")]
    assert got == [99.67, None, 12.0, 0.001, 0.5, None, None]


def test_normalized(spark):
    assert one(spark, S.normalized(F.lit("RMSD"), F.lit(3.0))) == 0.25
    assert one(spark, S.normalized(F.lit("GDT_TS"), F.lit(0.98))) == 0.0098
    assert one(spark, S.normalized(F.lit("lddt"), F.lit(0.5))) == 0.5


def test_greedy_shards(spark):
    rows = [("p", f"t{i}", i, n) for i, n in enumerate((100, 90, 50, 20, 10))]
    out = shards.shard(spark.createDataFrame(rows, "pool string, name string, ord long, tokens long"), shards=2)
    sums = {r["shard"]: (r["s"], r["n"]) for r in out.groupBy("shard").agg(F.sum("tokens").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    assert sums == {1: (130, 3), 2: (140, 2)}


def test_prefix_skips_what_does_not_fit(spark):
    e = lambda n, c: F.struct(F.lit("proteinChain").alias("kind"), F.repeat(F.lit("A"), F.lit(n)).alias("sequence"), F.lit(c).alias("count"), F.array().cast("array<string>").alias("ids"))
    kept = one(spark, F.transform(tasks.prefix_within(F.array(e(60, 1), e(50, 1), e(20, 3)), 100), lambda x: x["count"]))
    assert kept == [1, 2]


def test_leader_and_complexity(spark):
    assert one(spark, Q.leader_cut(F.lit("MKT" + "LLLLAVVLLALLAGSA" + "Q" * 100))) > 0
    assert one(spark, Q.leader_cut(F.lit("Q" * 120))) == 0
    cuts = one(spark, Q.low_complexity_cuts(F.lit("GS" * 20 + "ACDEFGHIKLMNPQRSTVWY" * 5)))
    assert (cuts["n"], cuts["c"]) == (40, 0)


def test_fasta(spark):
    df = spark.createDataFrame([("f", ">T1234s1 a protein\nMKV\n\nlla\n>R0001 x\nACGU\n>none\n")], "file string, text string")
    got = {r["record_id"]: (r["target_ids"], r["sequence"], r["sequence_kind"]) for r in texts.fasta(df).collect()}
    assert got == {"T1234s1": ("T1234,T1234S1", "MKVLLA", "proteinChain"), "R0001": ("R0001", "ACGU", "rnaSequence")}


def test_score_table(spark):
    body = "Target: T1200 x\n#  Model GR# GDT_TS Note\n1 T1200TS001_1 001 55.5 a b c\nT1200TS002_1 002\nnothing here\n"
    rows = texts.score_table(spark.createDataFrame([("f", body)], "file string, text string"), "prot_domains").orderBy("n").collect()
    assert [(r["model"], r["group"], r["submitted_rank"], r["primary_score"]) for r in rows] == [("T1200TS001_1", "001", "1", 55.5), ("T1200TS002_1", "002", "", None)]
    assert '"Note":"a b c"' in rows[0]["metric_json"]


def test_overlay_stops_on_bad_rows(spark):
    import pytest

    names = ["target_id", "ids", "status", *lookups.PROVENANCE]
    row = lambda *first, **more: spark.createDataFrame([[*first, *(more.get(c, "x") for c in lookups.PROVENANCE)]], names)
    for bad, message in ((row("T1", "1abc", "accepted", chain_mapping=" "), "lacks chain_mapping"), (row("T1", " ,", "accepted"), "without ids"), (row("T1", "1abc", "maybe"), "unknown status"), (row("", "1abc", "deferred"), "without a target")):
        with pytest.raises(Exception, match=message):
            lookups.overlay(bad).collect()
    with pytest.raises(Exception, match="invalid id"):
        lookups.overlay(row("T1", "1abc;nope", "deferred"), id_pattern="[0-9][a-z0-9]{3}").collect()
    assert lookups.overlay(row("t1", "1ABC; 2xyz", "accepted").unionByName(row("T2", "", "candidate", source=""))).collect() == [("T1", ["1abc", "2xyz"])]


def test_hash_manifest_reads_what_is_there(spark, tmp_path):
    import hashlib

    from podium.sources import sinks

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.cif").write_bytes(b"abc")
    (tmp_path / "y.cif").write_bytes(b"")
    files = spark.createDataFrame([(f"{tmp_path}/a/x.cif", 3), (f"{tmp_path}/y.cif", 0), (f"{tmp_path}/gone.cif", 9)], "path string, length long")
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in sinks.hash_manifest(files, str(tmp_path)).collect()}
    assert got == {"x.cif": hashlib.sha256(b"abc").hexdigest(), "y.cif": "", "gone.cif": ""}


def test_markdown_says_when_it_stops(spark):
    from podium.sources import sinks

    assert sinks.markdown(spark.range(3), ["id"], most=2).endswith("_Only the first 2 rows are shown._")
    assert sinks.markdown(spark.range(2), ["id"], most=2).endswith("| 1 |")


def test_listing_counts_empty_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.pdb", "a/y.cif", "z.cif"):
        (tmp_path / name).write_text("")
    got = [r["path"].rsplit("/", 1)[1] for r in folders.listing(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == ["y.cif", "z.cif", "x.pdb"]


def test_latest_status_stream(spark, tmp_path):
    from podium.streaming import status

    schema = "ord long, run_id string, status string"
    for i, s in enumerate(("pending", "ok")):
        spark.createDataFrame([(i, "R1", s)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    q = status.latest(status.log_stream(spark, str(tmp_path / "log"), schema)).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["run_id"], r["status"]) for r in spark.sql("select * from latest").collect()] == [("R1", "ok")]


def test_commands(spark):
    from podium.operators import external

    rows = spark.createDataFrame([(1, ["echo", "TM-score = 0.5"]), (2, ["false"]), (3, ["no-such-program-here"])], "key long, command array<string>")
    got = {r["key"]: (r["exit_code"], r["stdout"]) for r in external.run_commands(rows).collect()}
    assert got == {1: (0, "TM-score = 0.5\n"), 2: (1, ""), 3: (None, "")}


def test_strategies(spark):
    from podium.operators import strategies

    tagged = "MHHHHHH" + "ACDEFGHIKL" * 4
    assert one(spark, strategies.without_tags(F.lit(tagged))) == "ACDEFGHIKL" * 4
    assert one(spark, strategies.without_low_complexity(F.lit("GS" * 20 + "ACDEFGHIKLMNPQRSTVWY" * 5))) == "ACDEFGHIKLMNPQRSTVWY" * 5


def entities(*rows):
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("sequence"), F.lit(n).alias("count"), F.array(*map(F.lit, ids)).cast("array<string>").alias("ids")) for k, s, n, ids in rows))


def task_rows(spark, **tasks):
    from functools import reduce

    rows = [spark.range(1).select(F.lit(n).alias("name"), F.lit(i).cast("long").alias("ord"), entities(*e).alias("sequences")) for i, (n, e) in enumerate(tasks.items())]
    return reduce(lambda a, b: a.unionByName(b), rows)


def test_copies_kept_while_they_fit(spark):
    from podium.operators import derivations as V

    made = task_rows(spark, T1=[("proteinChain", "A" * 60, 2, ["A", "B"]), ("proteinChain", "", 1, ["C"]), ("proteinChain", "C" * 30, 3, ["D", "E", "F"])], T2=[("proteinChain", "A" * 200, 1, ["A"])], T3=[("proteinChain", "MHHHHHH" + "A" * 95, 1, ["A"])])
    rows = spark.createDataFrame([(i, t, "protein_oligo") for i, t in enumerate(("T1", "T2", "T3"))], "ord long, target_id string, track string")
    got = {r["name"]: r for r in V.within_limit(made, rows, limit=100).collect()}
    assert [(e["count"], e["ids"]) for e in got["T1"]["sequences"]] == [(1, ["A"]), (1, ["D"])]
    assert (got["T2"]["skip_reason"], got["T2"]["tokens"]) == ("no_entity_fits_token_limit", 200)
    assert got["T3"]["sequences"][0]["sequence"] == "A" * 95


def test_recovery_takes_records_by_alias_order(spark):
    from podium.operators import derivations as V

    protein, other = "MKV" * 12, "ACDEFGHIKL" * 4
    made = task_rows(spark, T1001=[("rnaSequence", "ACGU", 1, ["A"])], T1002=[("proteinChain", protein, 1, ["A"])])
    rows = spark.createDataFrame([(1, "T2001", "protein_domain", "A2B1"), (2, "T1001", "protein_domain", "A3"), (3, "T1002", "protein_domain", ""), (4, "T1009", "protein_domain", ""), (5, "T1008", "protein_oligo", "")], "ord long, target_id string, track string, oligo_state string")
    records = spark.createDataFrame([(1, "T1001", "r1", "", protein, "proteinChain"), (2, "T2001", "r2", "", other, "proteinChain"), (3, "T2001", "r3", "", other.lower(), "proteinChain"), (4, "T2001", "r4", "", "ACGU" * 10, "rnaSequence"), (5, "T1009", "r5", "", "MKV", "proteinChain")], "ord long, target_ids string, record_id string, header string, sequence string, sequence_kind string")
    out = V.recovered(made, rows, records)
    got = {r["name"]: r for r in out.collect()}
    assert sorted(got) == ["T1001", "T1009", "T2001"]
    assert got["T1009"]["skip_reason"] == "no_recoverable_protein_sequence"
    assert got["T2001"]["record_ids"] == "r2,r1" and [(e["count"], e["ids"]) for e in got["T2001"]["sequences"]] == [(2, ["A", "B"]), (1, ["C"])]
    assert got["T1001"]["record_ids"] == "r1,r2" and [e["count"] for e in got["T1001"]["sequences"]] == [1, 1]
    names = [(r["name"], r["added"]) for r in V.with_recovered(made, out).orderBy("added", "ord").collect()]
    assert names == [("T1001", False), ("T1002", False), ("T2001", True)]


def test_domains_that_targets_list_come_first(spark):
    from podium.operators import derivations as V

    made = task_rows(spark, T1=[("proteinChain", "ACDEFGHIKL", 1, ["A"])], T2=[("proteinChain", "ACDEFGHIKL", 2, ["A", "B"])])
    domains = spark.createDataFrame([(1, "D1", "T1", "1-3"), (2, "D2", "T1", "4-6"), (3, "D3", "T2", "1-2")], "ord long, domain_id string, target_id string, residue_ranges string")
    rows = spark.createDataFrame([(1, "T1", "protein_domain", "D2,gone")], "ord long, target_id string, track string, domain_ids string")
    got = [(r["fragment_id"], r["skip_reason"], r["fragment"]) for r in V.domain_fragments(made, domains, rows).orderBy("fragment_id").collect()]
    assert got == [("T1__D2", "none", "EFG"), ("T2__D3", "requires_single_copy_entity", "")]


def test_recovery_aliases(spark):
    got = lambda x: one(spark, Q.recovery_aliases(F.lit(x)))
    assert got("T2001") == ["T2001", "T0001", "T1001"]
    assert got("T1200V2") == ["T1200V2", "T0200V2", "T2200V2", "T1200V1"]
    assert got("X1_V2") == ["X1_V2", "X1_V1", "X1"]


def test_cropped_text_drops_odd_rows_and_copies_the_rest(spark):
    from podium.sources import structures

    body = "data_a\nloop_\n_atom_site.id\n_atom_site.atom\n_atom_site.label_seq_id\n_atom_site.auth_asym_id\n1 \"O5'\" 3 A\n2 O5' 3 A\n3 C 3\n4 C ? A\n5 C 3 B\n6 C 9 A\n\n_cell.x 1\nloop_\n_a.b\n7 8\n"
    ranges = F.array(F.struct(F.lit(2).alias("lo"), F.lit(4).alias("hi")))
    got = one(spark, structures.cropped_text(F.lit(body), ranges, F.array(F.lit("A"))))
    assert got["kept"] == 1
    assert got["text"] == "data_a\nloop_\n_atom_site.id\n_atom_site.atom\n_atom_site.label_seq_id\n_atom_site.auth_asym_id\n1 \"O5'\" 3 A\n_cell.x 1\nloop_\n_a.b\n7 8\n"
    assert one(spark, structures.cropped_text(F.lit(body), ranges, F.array().cast("array<string>")))["kept"] == 2


def test_run_specs_by_folder_and_by_register(spark, tmp_path):
    """One spec for each folder's file; with a register, those it names, and of those it names that aren't there, none."""
    import json

    for name, seeds in (("r1", "101"), ("r2", "102,103"), ("r3", "1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run_spec.json").write_text(json.dumps({"run_id": name, "seeds": seeds}, indent=2))
    read = lambda **how: sorted((r["run_id"], r["seeds"], r["run_dir"].rsplit("/", 1)[1]) for r in texts.run_specs(spark, f"{tmp_path}/*/run_spec.json", "run_id string, seeds string", **how).collect())
    assert read() == [("r1", "101", "r1"), ("r2", "102,103", "r2"), ("r3", "1", "r3")]
    register = spark.createDataFrame([("r2",), ("r2",), ("gone",)], "run_id string")
    assert read(registered=register) == [("r2", "102,103", "r2")]
