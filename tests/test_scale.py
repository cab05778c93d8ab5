"""What is sent to all tasks is bounded, and small files are dealt out: plans and results at the limits."""

import random
import re

from pyspark.sql import functions as F

from quarry.operators import durable, flow_map, graph, graph_checks, linking, schema
from quarry.plans import flow_queries, inputs, registry, stream_queries
from quarry.streaming import deltas, keyed

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_names_and_texts_meet_by_exchange(spark, monkeypatch):
    texts = spark.createDataFrame([("a", "one two"), ("b", "two"), ("c", None)], "k string, text string")
    names = spark.createDataFrame([("two",), ("one",), ("three",)], "name string")
    want = {("a", "one"), ("a", "two"), ("b", "two")}
    for most in (linking.SENT_GRAMS, 0):
        monkeypatch.setattr(linking, "SENT_GRAMS", most)
        out = linking.contains_pairs(texts, names, "text", "name")
        assert {(r["k"], r["name"]) for r in out.collect()} == want
        assert most or "Broadcast" not in plan(out)


def test_longest_key_of_repeated_and_null_models(spark):
    usage = spark.createDataFrame([(1, "big-x"), (1, "big-x"), (2, None), (3, "other")], "k int, model string")
    prices = spark.createDataFrame([("big", 1), ("big-x", 2), ("default", 3)], "key string, price int")
    assert sorted((r["k"], r["key"], r["price"]) for r in linking.longest_key(usage, prices, "model", "key", "default").collect()) == [(1, "big-x", 2), (1, "big-x", 2), (2, "default", 3), (3, "default", 3)]


def test_narrow_tables_are_dealt_out_by_key(spark):
    docs = inputs.derive(spark, SF, inputs.MARKDOWN)
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan(docs.groupBy("doc_id").agg(F.max("text"))).count("Exchange") == 1


def test_dependency_edges_of_crowded_documents(spark, monkeypatch):
    rows = [(d, f"p{i}", "Process", f"calls s{i} now") for d in (1, 2) for i in range(3)] + [(1, f"d{i}", "Dependency", f"s{i}") for i in range(3)] + [(2, "d0", "Persistence", "S0"), (2, "v", "Service", "v")]
    nodes = spark.createDataFrame(rows, "doc_id int, id string, type string, name string")
    want = {(1, f"p{i}", f"d{i}", "dependsOn") for i in range(3)} | {(2, "p0", "d0", "writesTo"), (2, "v", "d0", "writesTo")}
    monkeypatch.setattr(linking, "SENT_GRAMS", 0)
    for few in (linking.FEW_NAMES, 2, 0):
        monkeypatch.setattr(linking, "FEW_NAMES", few)
        out = graph_checks.dependency_edges(nodes)
        assert {tuple(r) for r in out.collect()} == want
        assert "Broadcast" not in plan(out)


def test_code_edges_send_only_rows_per_project(spark):
    out = registry.QUERIES["g4_code_edges"](spark, SF)
    # The project itself, its packages and stores, the two sizes and first types of flows; few names of contained ones are told apart by count.
    assert plan(out).count("BroadcastExchange") <= 8


def test_first_keys_over_several_batches(spark, tmp_path):
    schema = "id string, server string, kind string, source_hash string, created_at string, summary string"
    for rows in ([("d1", "2024-01-01 00:00:09"), ("d1", "2024-01-01 00:00:01"), ("d2", None)], [("d1", "2023-01-01 00:00:00"), ("d3", "2020-01-01 00:00:00")]):
        spark.createDataFrame([(k, "s", "x", "h", at, "t") for k, at in rows], schema).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    out = stream_queries._drained(spark, keyed.first_keys(deltas.stream_deltas(spark, str(tmp_path / "log"), files_per_trigger=1)), str(tmp_path / "out"))
    assert sorted(r["id"] for r in out.collect()) == ["d1", "d2", "d3"]


def test_nodes_of_an_item_are_made_in_one_pass(spark):
    items = spark.createDataFrame([(1, "rules", 0, "alert the external monitor"), (1, "other", 0, "latency"), (1, None, 0, "x")], "doc_id int, section string, item_ord int, item string")
    out = graph.canonical_nodes(items)
    assert "Union" not in plan(out)
    assert sorted(r["id"] for r in out.collect()) == ["alert.alert-the-external-monitor.1", "ext.alert-the-external-monitor.1", "met.latency.1", "mon.alert-the-external-monitor.1", "rule.alert-the-external-monitor.1"]


def test_best_matches_of_distinct_sets_write_no_pairs(spark, monkeypatch):
    gen, written = random.Random(3), []
    lefts, rights = ([set(gen.sample(range(60), 25)) for _ in range(n)] for n in (40, 600))
    monkeypatch.setattr(linking, "saved", lambda df, tag: written.append(durable.saved(df, tag)) or written[-1])
    monkeypatch.setattr(linking, "CELLS", 4000)
    left = spark.createDataFrame([(f"l{i}", f"f{f}") for i, fs in enumerate(lefts) for f in fs], "left_id string, feature string")
    right = spark.createDataFrame([(j, 600 - j, [(f"f{f}", 1 + f % 5) for f in fs]) for j, fs in enumerate(rights)], "right_id long, ord long, features array<struct<feature: string, weight: long>>")
    out = linking.best_rows(left, right, 2)
    want = {(f"l{i}", j, -s) for i, fs in enumerate(lefts) for s, _, j in sorted((-sum(1 + f % 5 for f in fs & gs), 600 - j, j) for j, gs in enumerate(rights))[:2]}
    assert {(r["left_id"], r["right_id"], r["score"]) for r in out.collect()} == want
    # The features of the right rows, 15 000, and the 24 000 pairs are not written.
    assert sum(df.count() for df in written) < 5000


def test_flows_are_told_from_traces_of_first_entries(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(flow_queries, "saved", lambda df, tag: written.setdefault(tag, durable.saved(df, tag)))
    flows = registry.QUERIES["g10_interpreted_flows"](spark, SF)
    traced = written["flow-traces"].select("entry_id").distinct().count()
    assert traced == flows.count() < written["flow-entries"].count()


def test_leads_equal_clusters(spark):
    e = flow_queries.Evidence(spark, SF)
    entries = e.entries()
    leads = flow_map.lead_flows(entries, e.primary(entries))
    clusters = flow_map.cluster_flows(entries, e.primary(entries), e.steps(entries)).select(leads.columns)
    assert sorted(map(tuple, leads.collect())) == sorted(map(tuple, clusters.collect()))


def test_traces_take_one_exchange_by_entry(spark):
    e = flow_queries.Evidence(spark, SF)
    entries = e.entries()
    out = flow_map.trace_flows(entries, e.primary(entries), *(e.of[k] for k in ("operations", "repositories", "calls", "deps", "kinds", "triggers", "jobs")))
    assert not re.search(r"hashpartitioning\(entry_id#\d+L?, (role|node)#", plan(out))


def test_ladder_meets_in_one_exchange(spark):
    out = registry.QUERIES["v1_table_ladder"](spark, SF)
    assert "SortMergeJoin" not in plan(out)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ladder_of_blank_and_foreign_evidence(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "b", "jobs"), (2, "b", "two notes"), (3, None, "user"), (None, "t", "order")], "doc_id int, title string, text string")
    explicit = spark.createDataFrame([(1, ""), (3, "own"), (3, None), (9, "far")], "doc_id int, table_name string")
    items = spark.createDataFrame([(2, "examples", None, "an invoice"), (2, "examples", 1, "a payment"), (8, "dependencies", 1, "order"), (None, "examples", 1, "file")], "doc_id int, section string, item_ord int, item string")
    nodes = spark.createDataFrame([(2, "Entity", "Cart", 1), (2, None, "note", None), (9, "Entity", "x", 1)], "doc_id int, type string, name string, ord int")
    hints = spark.createDataFrame([("two",), (None,)], "hint string")
    out = sorted((tuple(r) for r in schema.table_ladder(docs, explicit, hints, items, nodes).collect()), key=repr)
    assert out == sorted([
        (1, "domain_record", "fallback"), (2, "tasks", "keyword"), (2, "notes", "keyword"), (2, "two", "hint"), (2, "cart", "graph"), (2, "invoices", "main"),
        (3, "own", "explicit"), (9, "far", "explicit"), (None, "orders", "main"), (None, "domain_record", "fallback"),
    ], key=repr)


def test_few_names_meet_texts_where_they_lie(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "one two") for k in range(9)] + [(9, None)], "k int, text string")
    names = spark.createDataFrame([("two", 1), ("TWO", 1), ("six", 1)], "name string, v int")
    for few in (linking.FEW_NAMES, 0):
        monkeypatch.setattr(linking, "FEW_NAMES", few)
        out = linking.contains_pairs(texts, names, "text", "name")
        assert out.columns == ["name", "k", "text", "v"]
        assert sorted((r["k"], r["name"]) for r in out.collect()) == sorted((k, n) for k in range(9) for n in ("two", "TWO"))
        assert "__text" not in plan(out)


def test_copies_of_a_text_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(linking, "SENT_GRAMS", 0)
    monkeypatch.setattr(linking, "COPIES", 4)
    texts = spark.createDataFrame([("one two",)] * 30 + [("one",), ("none",), (None,)], "text string").repartition(3)
    out = linking.contains_pairs(texts, spark.createDataFrame([("two",), ("one",), ("three",)], "name string"), "text", "name")
    assert sorted(map(tuple, out.collect())) == sorted([("one two", "one"), ("one two", "two")] * 30 + [("one", "one"), ("none", "one")])
    assert "__part" in plan(out)
