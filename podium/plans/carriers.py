"""Views that put the driver tables into the shapes the operators work on: name -> (tables, SQL)."""

CARRIERS: dict[str, tuple[tuple[str, ...], str]] = {
    # one scored submission: category, group, target, metric, raw value, and the order of arrival
    "submissions": (
        ("lineitem", "orders"),
        """SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, o_orderpriority AS category,
             concat('G', CAST(l_suppkey AS STRING), CASE WHEN l_suppkey % 3 = 0 THEN 's' ELSE '' END) AS grp,
             concat('T', CAST(l_partkey AS STRING)) AS target,
             CASE l_linenumber % 3 WHEN 0 THEN 'RMSD' WHEN 1 THEN 'GDT_TS' ELSE 'lddt' END AS metric,
             l_extendedprice / 1000.0 AS raw
           FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    ),
    # one scored (run, target): a customer's nation is the run, an order the target
    "run_scores": (
        ("orders", "customer"),
        """SELECT concat('R', CAST(c_nationkey AS STRING)) AS run_id, o_orderpriority AS track, concat('T', CAST(o_orderkey AS STRING)) AS target_id,
             o_orderkey AS ord, CASE WHEN o_custkey % 11 = 0 THEN 'false' ELSE 'true' END AS rank_eligible,
             CASE WHEN o_orderkey % 17 = 0 THEN 'missing_prediction' WHEN o_orderstatus = 'P' THEN 'partial_candidates' WHEN o_orderkey % 23 = 0 THEN 'metric_failed' ELSE 'ok' END AS status,
             CASE WHEN o_orderkey % 17 = 0 OR o_orderstatus = 'P' OR o_orderkey % 23 = 0 THEN 0.0 ELSE o_totalprice / 1000000.0 END AS score,
             CASE WHEN c_nationkey % 7 = 3 THEN 'confidence_v1' ELSE '' END AS selected_model_policy,
             CASE WHEN o_orderstatus = 'F' THEN concat('out/', CAST(c_nationkey AS STRING), '/a/b/', CAST(o_orderkey AS STRING), '.cif') ELSE '' END AS prediction_path
           FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    ),
    "run_targets": (
        ("orders",),
        """SELECT concat('T', CAST(o_orderkey AS STRING)) AS target_id, o_orderpriority AS track, CASE WHEN o_custkey % 11 = 0 THEN 'false' ELSE 'true' END AS rank_eligible,
             CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'available' END AS reference_status FROM {orders}""",
    ),
    # two runs over the same targets
    "two_runs": (
        ("lineitem",),
        """SELECT CASE WHEN l_returnflag = 'R' THEN 'base' ELSE 'new' END AS run_id, l_linestatus AS track, concat('T', CAST(l_partkey AS STRING)) AS target_id,
             CASE WHEN max(l_discount) > 0.09 THEN 'metric_failed' ELSE 'ok' END AS status, CASE WHEN max(l_discount) > 0.09 THEN 0.0 ELSE max(l_quantity) / 50.0 END AS score
           FROM {lineitem} GROUP BY 1, 2, 3""",
    ),
    # a status log: one line for each event, in the order of event_id
    "status_log": (("events",), """SELECT event_id AS ord, concat('R', CAST(user_id AS STRING)) AS run_id, CASE event_type WHEN 'error' THEN 'failed' ELSE event_type END AS status, value, concat('B', CAST(user_id % 5 AS STRING)) AS benchmark FROM {events}"""),
    # chains: a sequence over capital letters for each part
    "chains": (
        ("part",),
        """SELECT p_partkey AS ord, concat(CASE p_size % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'H' WHEN 2 THEN 'R' ELSE 'X' END, CAST(1000 + p_partkey AS STRING)) AS record_id, p_brand AS header,
             CASE p_size % 5 WHEN 0 THEN repeat('ACGU', p_size) WHEN 1 THEN repeat('ACGT', p_size) WHEN 2 THEN concat('MGSHHHHHH', repeat(upper(replace(p_name, ' ', '')), p_size), 'HHHHHH')
               ELSE concat(p_type, repeat(upper(replace(p_name, ' ', '')), p_size)) END AS sequence, p_name AS name
           FROM {part}""",
    ),
    # targets with phases and suffixes in their ids, as aliases have them
    "targets": (
        ("part",),
        """SELECT p_partkey AS ord, concat('T', CAST(p_partkey % 3 AS STRING), CAST(100 + p_partkey % 700 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN 'S1' ELSE '' END) AS target_id,
             CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('A', CAST(p_size % 7 AS STRING), CASE WHEN p_size % 3 = 0 THEN 'B2' ELSE '' END) END AS oligo_state, p_type AS description, p_size AS size
           FROM {part}""",
    ),
    "records": (
        ("part",),
        """SELECT p_partkey AS ord, concat('T', CAST((p_partkey + 1) % 3 AS STRING), CAST(100 + (p_partkey * 7) % 900 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN 'S1' ELSE '' END) AS target_ids,
             concat('rec', CAST(p_partkey % 997 AS STRING)) AS record_id, concat(upper(replace(p_name, ' ', '')), p_type) AS sequence, CASE WHEN p_size % 3 = 0 THEN 'rnaSequence' ELSE 'proteinChain' END AS kind FROM {part}""",
    ),
    # entities of a task: the lines of an order
    "entities": (
        ("lineitem",),
        """SELECT concat('job', CAST(l_orderkey AS STRING)) AS name, l_orderkey AS task, l_linenumber AS pos, CAST(l_quantity AS INT) AS len, 1 + l_linenumber % 3 AS copies, CASE WHEN l_partkey % 6 = 0 THEN 'rnaSequence' ELSE 'proteinChain' END AS kind, l_partkey AS part
           FROM {lineitem}""",
    ),
    # intervals of a target: stretches of positions
    "ranges": (("lineitem",), """SELECT l_partkey AS target, CAST(l_orderkey % 500 AS INT) AS lo, CAST(l_orderkey % 500 + l_quantity AS INT) AS hi, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord FROM {lineitem}"""),
    # candidate files with confidences
    "candidates": (
        ("lineitem",),
        """SELECT concat('T', CAST(l_partkey AS STRING)) AS target_id, concat('out/seed_', CAST(l_suppkey AS STRING), '/T', CAST(l_partkey AS STRING), '_sample_', CAST(l_orderkey AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN '.pdb' ELSE '.cif' END) AS path,
             l_quantity * 2 AS plddt, l_discount * 10 AS ptm, l_tax * 10 AS iptm, l_discount AS disorder, l_returnflag = 'R' AS has_clash, CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 100000.0 END AS ranking_score,
             CASE WHEN l_returnflag = 'A' THEN l_tax * 12 END AS consensus, CASE WHEN l_returnflag = 'A' THEN l_discount * 9 END AS support, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord
           FROM {lineitem}""",
    ),
    # a cache of computed inputs by exact sequence: equal texts are equal sequences
    "cache": (("documents",), """SELECT doc_id AS ord, text AS sequence, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 2 END AS n_paths, n_chars % 2 = 0 AS has_hash, source AS source_run, n_chars AS bytes FROM {documents}"""),
}

#: Carriers whose rows take long, and the key by which the rows of their table are dealt to tasks first.
DEALT = {"chains": "p_partkey"}
