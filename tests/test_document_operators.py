"""Documents of unknown shape, recorded answers, and substring matching against plain Python."""

import json
import random

from pyspark.sql import functions as F

from podium.operators import candidates, documents
from podium.sources import responses


def test_matches_against_loops(spark):
    """Aliases from one to forty characters, in any case, with blanks, dots and accents; empty ones match nothing."""
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abAB.é_1") for _ in range(n))
    files = ["/".join([*(word(rnd.randrange(1, 4)) for _ in range(rnd.randrange(4))), word(rnd.randrange(1, 60))]) for _ in range(150)]
    cuts = [f[(i := rnd.randrange(len(f))) : i + rnd.randrange(1, 40)].replace("/", "") for f in files]
    names = [(f"t{i % 40}", a.swapcase(), f"m{i % 3}", i % 3) for i, a in enumerate([*cuts, "a", "ab", "", "zz"])]
    df = spark.createDataFrame([(f,) for f in dict.fromkeys(files)], "path string")
    got = {(r.path, r.target_id): r.place for r in candidates.matches(df, spark.createDataFrame(names, "target_id string, alias string, match_type string, place int")).collect()}
    want = {}
    for f in files:
        *dirs, name = f.lower().split("/")
        for t, a, _, p in names:
            if a and (a.lower() in name or a.lower() in dirs):
                want[f, t] = min(p, want.get((f, t), 9))
    assert got == want


def test_matches_runs_nothing_to_plan(spark):
    """Planning starts no job, and a short alias does not set the width of the runs of the others."""
    files = spark.createDataFrame([("d/abcdefgh_long_name.cif",)], "path string")
    names = spark.createDataFrame([("t1", "ab", "x", 0), ("t2", "abcdefgh_long", "x", 0), ("t3", "abcdefgx", "x", 0)], "target_id string, alias string, match_type string, place int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    got = candidates.matches(files, names)
    assert not tracker.getJobIdsForGroup("planning")
    assert sorted(r.target_id for r in got.collect()) == ["t1", "t2"]


BODIES = {
    "a": '[{"name": "x", "n": 1, "more": {"q": [1, 2], "p": null}}, {"name": "y"}, 5, {"n": 2}, {"name": ""}, {"name": "x", "more": {"p": null, "q": [1, 2]}, "n": 2}]',
    "b": '[{"more": {"p": null, "q": [1, 2]}, "n": 2.0, "name": "x"}, {"name": "y", "k": []}, {"name": "z"}]',
    "cut": '[{"name": "x"',
    "object": '{"name": "x"}',
    "text": '"[1]"',
    "empty": "",
    "blank": "  ",
    "none": None,
    "no jobs": "[]",
}


def test_jobs_of_documents(spark):
    df = spark.createDataFrame(list(BODIES.items()), "source string, body string")
    jobs = documents.jobs(df)
    got = {(r.source, r.name): (json.loads(r.job), r.ord) for r in jobs.collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z")}
    assert got["a", "x"] == ({"name": "x", "n": 2, "more": {"p": None, "q": [1, 2]}}, 5)
    assert {r.source: r.problem for r in documents.broken(df).collect()} == {"cut": "malformed", "object": "not_a_list", "text": "not_a_list", "empty": "missing", "blank": "missing", "none": "missing"}
    a, b = jobs.where("source = 'a'"), jobs.where("source = 'b'")
    assert {r.name: r.change for r in documents.differences(a, b).collect()} == {"y": "changed", "z": "extra"}  # 2 and 2.0, and any order of keys, are equal
    assert [tuple(r) for r in documents.keys_changed(a, b).collect()] == [("y", "k")]
    assert documents.differences(a, a).count() == 0 and documents.jobs(df.limit(0)).count() == 0


def test_canonical_form(spark):
    rows = [('{"b": 1, "a": {"d": [3, {"z": 1, "y": 2}], "c": "é"}}',), ('{ "a":{"c":"é","d":[3,{"y":2,"z":1}]},"b":1 }',), ('{"b": 1, "a": {"d": [{"z": 1, "y": 2}, 3], "c": "é"}}',), ("{",), (None,), ('{"a": 1, "a": 2}',)]
    got = [r.c for r in spark.createDataFrame(rows, "j string").select(documents.canonical(F.col("j")).alias("c")).collect()]
    assert got[0] == got[1] == '{"a":{"c":"é","d":[3,{"y":2,"z":1}]},"b":1}' and got[2] not in (None, got[0]) and got[3:] == [None, None, None]


def test_guard_lists_failures_in_order(spark):
    specs = spark.createDataFrame([("r1", "101", 1), ("r2", "7", None)], "run_id string, seeds string, sample int")
    wanted = spark.createDataFrame([("r2",), ("r1",), ("r0",)], "run_id string")
    changes = spark.createDataFrame([("j1", "changed"), ("j2", "changed"), ("j3", "missing"), *((f"k{i:02}", "changed") for i in range(20))], "name string, change string")
    allowed = spark.createDataFrame([("j1",), ("j9",)], "name string")
    rules = {"unexpected_seeds": "seeds = '101'", "unexpected_sample": "sample = 1"}
    got = documents.variant_guard(specs, wanted, rules, changes, allowed).first()
    listed = ",".join(["j2", *(f"k{i:02}" for i in range(11))])
    assert got.status == "blocked" and got.n_failures == 6
    assert got.failures.split(";") == ["r0:missing_run_spec", "r2:unexpected_seeds", "r2:unexpected_sample", "target_set_mismatch:missing=1 extra=0", f"unexpected_changed_targets:{listed}", "missing_changes:j9"]
    assert documents.variant_guard(specs, wanted, rules, changes, allowed, most=2).first().failures == "r0:missing_run_spec;r2:unexpected_seeds"
    fine = documents.variant_guard(specs.where("run_id = 'r1'"), wanted.where("run_id = 'r1'"), rules, changes.where("name = 'j1'"), allowed.where("name = 'j1'")).first()
    assert tuple(fine) == ("ok", "", 0)


def test_recorded_answers(spark):
    searches = [("t1", '{"result_set": [{"identifier": "1abc_1"}, {"identifier": "ABCD_1"}, {"identifier": 5}, "x", {"identifier": "2DEF_12"}]}'), ("t2", '{"result_set": "none"}'), ("t3", '{"result_set": ['), ("t4", None), ("t5", "{}"), ("t6", '{"result_set": [{"identifier": "1ABC_1"}]}')]
    found = responses.hits(spark.createDataFrame(searches, "target_id string, body string"))
    assert sorted(map(tuple, found.collect())) == [("t1", 0, "1ABC_1", "1ABC", "1"), ("t1", 4, "2DEF_12", "2DEF", "12"), ("t6", 0, "1ABC_1", "1ABC", "1")]
    targets = spark.createDataFrame([("t1", "mkv lw"), ("t6", "ACGU")], "target_id string, sequence string")
    answer = "pdb_id string, entity_id string, body string, error string"
    entries = spark.createDataFrame([("1ABC", None, '{"struct": {"title": " two\\nlines "}, "exptl": [{"method": null}], "rcsb_entry_info": {"experimental_method": ["A"]}}', None), ("2DEF", None, "[", None)], answer).drop("entity_id")
    entities = spark.createDataFrame([("1ABC", "1", '{"entity_poly": {"pdbx_seq_one_letter_code_can": "GMKVLWJ"}}', ""), ("2DEF", "12", None, "timeout")], answer)
    got = {r.hit: r for r in responses.candidate_rows(targets, found, entries, entities).collect()}
    assert set(got) == {"1ABC_1", "2DEF_12"}  # a nucleic target has nothing to search
    one, two = got["1ABC_1"], got["2DEF_12"]
    assert (one.entry_title, one.experimental_method, one.entity_length, one.candidate_status, one.entry_error) == ("two lines", "", 7, responses.TARGET_INSIDE, "none")
    assert (two.entry_error, two.entity_error, two.entity_length, two.candidate_status, two.asym_ids) == ("malformed", "timeout", None, responses.UNVERIFIED, "")


def test_repair_of_inputs(spark):
    """Variants and phases lead to records, told proteins come before others, the first alias that has any decides."""
    from podium.operators import derivations as V

    protein = "MKVLWAALLVTFLAGCQAKVEQAVETEPEPELRQ"
    tasks = spark.createDataFrame([("T1001o", 1, [("proteinChain", protein, 1, ["A"])])], "name string, ord long, sequences array<struct<kind:string,sequence:string,count:int,ids:array<string>>>")
    fields = "ord long, target_id string, track string, oligo_state string, reference_status string, rank_eligible string, sequence_lookup_id string, official_target_id string"
    row = lambda ord_, target, state="", status="available", eligible="true", lookup="", official="": (ord_, target, "protein_oligo", state, status, eligible, lookup, official)
    targets = [row(1, "t1001"), row(2, "T1002V2O", "A2B1"), row(3, "T1003", lookup="X9"), row(4, "T1004", eligible="No"), row(5, "T1005", status="missing"), row(6, "T1006"), row(7, "H1007_V2", "A1Q"), row(8, "T1003", "late")]
    records = [(1, "T1002V1", "r1", "", protein, "proteinChain"), (2, "T1002V1", "r2", "", protein[::-1], "proteinChain"), (3, "T1002V1", "r3", "", protein, "proteinChain"), (4, "T1002V1", "r4", "", protein[1:], "dnaSequence"), (5, "X9", "r5", "a subunit", "ACGT" * 10, "dnaSequence"), (6, "T1006", "r6", "", "MK", "proteinChain"), (7, "H1007_V1,H1007", "r7", "", protein, "")]
    made = V.derive("scoreable_target_subset_input_repair", tasks, targets=spark.createDataFrame(targets, fields), records=spark.createDataFrame(records, "ord long, target_ids string, record_id string, header string, sequence string, sequence_kind string"))
    got = {r.name: r for r in made.collect()}
    assert {k: r.status for k, r in got.items()} == {"T1001": "already_covered", "T1002V2O": "added", "T1003": "added", "T1006": "skipped", "H1007_V2": "added"}
    assert (got["T1002V2O"].source, got["T1002V2O"].record_ids, [e["count"] for e in got["T1002V2O"].sequences], [e["ids"] for e in got["T1002V2O"].sequences]) == ("T1002V1", "r1,r2", [2, 1], [["A", "B"], ["C"]])
    assert got["T1002V2O"].rules == "scoreable_input_repair,alias_fallback:T1002V1"
    assert (got["T1003"].source, got["T1003"].rules, got["T1003"].ord) == ("X9", "scoreable_input_repair,recast_sequence_kind:dnaSequence", 3)
    assert got["T1006"].skip_reason == "no_recoverable_protein_sequence" and got["T1006"].sequences is None
    assert got["H1007_V2"].rules.startswith("scoreable_input_repair,recast_sequence_kind:,alias_fallback:H1007_V1")
    assert [(r.name, r.added) for r in V.with_repairs(tasks, made).orderBy("added", "ord").collect()] == [("T1001o", False), ("T1002V2O", True), ("T1003", True), ("H1007_V2", True)]


def test_derivations_by_name(spark):
    import pytest

    from podium.operators import derivations as V

    tasks = spark.createDataFrame([("T1", 1, [("proteinChain", "GSHHHHHH" + "MKVLWAALLVTFLAGCQAKVEQAVETEPEPELRQ", 1, ["A"])])], "name string, ord long, sequences array<struct<kind:string,sequence:string,count:int,ids:array<string>>>")
    assert V.derive("terminal_tags", tasks).columns == ["name", "ord", "sequences", "changed"]
    with pytest.raises(ValueError, match="needs the tables domains"):
        V.derive("domain_fragment_inputs", tasks)
    with pytest.raises(ValueError, match="unknown strategy: none; known are terminal_tags"):
        V.derive("none", tasks)
    assert V.derive("antibody_fv_inputs", tasks, targets=None).count() == 0
    assert len(V.DERIVATIONS) == 14


def test_overlay_of_confidences(spark):
    """The sidecar's keys win, also with null; what isn't an object says nothing; repeated files and sidecars give no more rows than files."""
    files = [("a/x.json", '{"plddt": 80, "ptm": 0.5, "chains": [1]}'), ("a/y.json", "[]"), ("a/z.json", "{"), ("a/v.json", '{"ptm": 1}'), ("a/v.json", '{"ptm": 2}'), ("a/w.json", None)]
    sidecars = [("a/x.selection_qa.json", '{"plddt": null, "consensus_score": 0.75}'), ("a/y.selection_qa.json", '{"ptm": 1}'), ("a/v.selection_qa.json", "broken"), ("a/v.selection_qa.json", "broken too"), ("a/other.json", '{"ptm": 9}')]
    schema = "path string, body string"
    got = sorted(((r.path, r.fields) for r in candidates.overlaid(spark.createDataFrame(files, schema), spark.createDataFrame(sidecars, schema)).collect()), key=str)
    assert got == sorted([("a/x.json", {"plddt": None, "consensus_score": "0.75", "ptm": "0.5", "chains": "[1]"}), ("a/y.json", {}), ("a/z.json", {}), ("a/v.json", {"ptm": "1"}), ("a/v.json", {"ptm": "2"}), ("a/w.json", {})], key=str)


def test_means_and_merges(spark):
    from podium.operators import leaderboard, runs

    bodies = [("r", '{"plddt": 80, "ptm": null}'), ("r", '{"plddt": "high"}'), ("r", "{"), ("r", "[]"), ("r", None), ("s", "{}")]
    got = {r.run_id: tuple(r)[1:] for r in leaderboard.confidence_means(spark.createDataFrame(bodies, "run_id string, body string"), ("plddt", "ptm")).collect()}
    assert got == {"r": (5, 2, 80.0, None), "s": (1, 1, None, None)}

    spec = lambda merged, shard, seeds, sample=1, policy=None: (merged, shard, int(shard[1:]), seeds, sample, "b", "m", "x", policy)
    specs = [spec("a", "s1", "7, 5"), spec("a", "s2", "5,,9"), spec("b", "s1", None), spec("c", "s1", "1"), spec("c", "s2", "2", 2), spec("d", "s1", "1"), spec("e", "s1", "1"), spec("e", "s2", "2")]
    files = [("a", "s1", "p"), ("a", "s2", "q"), ("b", "s1", "p"), ("c", "s1", "p"), ("c", "s2", "q"), ("e", "s1", "p"), ("e", "s2", "p"), ("e", "s2", "q")]
    made = runs.merged_runs(spark.createDataFrame(specs, "merged string, shard string, ord long, seeds string, sample int, benchmark string, model string, manifest string, policy string"), spark.createDataFrame(files, "merged string, shard string, rel_path string"))
    got = {r.merged: (r.seeds, r.candidates, r.files, r.collisions, r.problem) for r in made.collect()}
    assert got["a"] == ("7,5,9", 3, 2, 0, "none") and got["b"] == ("101", 1, 1, 0, "none") and got["c"][4] == "mixed_sample" and got["d"][4] == "shard_without_files" and got["e"][2:] == (3, 1, "path_collision")
    listed = runs.merged_listing(made, spark.createDataFrame(files, "merged string, shard string, rel_path string"))
    assert sorted(map(tuple, listed.collect())) == [("a", "p", "s1"), ("a", "q", "s2"), ("b", "p", "s1")]


def test_landing(spark):
    from podium.sources import texts

    wanted = spark.createDataFrame([("t1", "1abc, 2DEF;1ABC", " Candidate"), ("t2", "3ghi", "rejected"), ("t3", None, "candidate"), ("t4", "4jkl", "candidate")], "target_id string, pdb_ids string, status string")
    there = spark.createDataFrame([("1ABC", 5, "h1"), ("4JKL", 6, "h4")], "pdb_id string, length long, sha256 string")
    fetched = spark.createDataFrame([("1abc", 7, "n1", None), ("4jkl", None, None, "timeout")], "pdb_id string, length long, sha256 string, error string")
    rows = lambda **how: sorted(tuple(r)[:2] + tuple(r)[3:] for r in texts.materialized(wanted, there, fetched, **how).collect())
    assert rows() == [("T1", "1ABC", "cached", 5, "h1"), ("T1", "2DEF", "download_failed:not_fetched", None, ""), ("T4", "4JKL", "cached", 6, "h4")]
    assert rows(force=True) == [("T1", "1ABC", "downloaded", 7, "n1"), ("T1", "2DEF", "download_failed:not_fetched", None, ""), ("T4", "4JKL", "download_failed:timeout", 6, "h4")]
