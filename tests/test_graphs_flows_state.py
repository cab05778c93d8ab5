"""Operators of the code graph, the flow map, containment, matching, scans of large keys and keyed streams: what their
queries' SQL does not show."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import code_graph, flow_map, linking, relational, support_graph
from quarry.operators.durable import saved
from quarry.plans import code_queries, flow_queries, registry
from quarry.streaming import deltas, keyed
from quarry.streaming.sinks import EpochTable

SF = "/root/testdata/sf0.001"


def hot_rows(spark, n=400, seed=1):
    gen = random.Random(seed)
    rows = [("hot" if gen.random() < 0.8 else gen.choice([None, "a", "b"]), i, gen.choice([None, None, None, i])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, i long, v long").repartition(3)


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_scans_of_a_key_with_most_rows(spark, block):
    rows, df = hot_rows(spark)
    by_key = defaultdict(list)
    for k, i, v in rows:
        by_key[k].append((i, v))
    first = lambda xs: next((x for x in xs if x is not None), None)
    want = {}
    for own in by_key.values():
        vs = [v for _, v in own]
        for at, (i, _) in enumerate(own):
            want[i] = (first(reversed(vs[: at + 1])), first(vs[at + 1 : at + 4]), first(vs[max(0, at - 2) : at + 3]), own[at + 1][0] if at + 1 < len(own) else None)
    out = relational.carry_forward(df, ["k"], ["i"], "v", "c", block)
    out = relational.look_ahead(out, ["k"], ["i"], "v", 3, "l", block)
    out = relational.nearby(out, ["k"], ["i"], "v", 2, "n", block)
    assert {r["i"]: (r["c"], r["l"], r["n"]) for r in out.collect()} == {i: w[:3] for i, w in want.items()}
    pairs = relational.step_pairs(df, ["k"], ["i"], "i", block=block)
    assert {r["i"]: r["next_node"] for r in pairs.collect()} == {i: w[3] for i, w in want.items() if w[3] is not None}


def test_a_large_key_lies_in_several_tasks(spark):
    _, df = hot_rows(spark)
    placed = relational._blocks(df, ["k"], ["i"], 50).where("k = 'hot'")
    assert placed.select("__block").distinct().count() > 5
    ranged = df.repartitionByRange(4, "k", "i").where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranged > 1


def test_round_robin_of_a_large_group(spark):
    left = spark.createDataFrame([("g", i) for i in range(50)] + [("x", 1)], "g string, a long")
    right = spark.createDataFrame([("g", i) for i in range(7)], "g string, b long")
    got = {r["a"]: r["b"] for r in relational.round_robin(left, right, ["a"], ["b"], "g", 2).collect()}
    assert got == {i: (i + 2) % 7 for i in range(50)}


@pytest.mark.parametrize("hot", [5, 1000])
def test_best_matches_equal_nested_loops(spark, hot):
    gen = random.Random(hot)
    weight = {f"f{i}": 1 + i % 4 for i in range(30)}
    pick = lambda p: {"f0"} if gen.random() < p else set()
    left = {i: set(gen.sample(sorted(weight), 4)) | pick(0.5) for i in range(40)}
    right = {j: set(gen.sample(sorted(weight), 3)) | pick(0.5) for j in range(90)}
    want = set()
    for i, fs in left.items():
        scored = sorted((-sum(weight[f] for f in fs & gs), j) for j, gs in right.items() if fs & gs)
        want |= {(i, j, -s) for s, j in scored[:2]}
    l_rows = spark.createDataFrame([(i, f) for i, fs in left.items() for f in fs], "left_id long, feature string")
    r_rows = spark.createDataFrame([(j, j, f, weight[f]) for j, fs in right.items() for f in fs], "right_id long, ord long, feature string, weight long")
    assert {(r["left_id"], r["right_id"], r["score"]) for r in linking.best_matches(l_rows, r_rows, 2, hot).collect()} == want


def test_a_feature_of_all_rows_gives_no_pairs(spark):
    left = spark.range(300).select(F.col("id").alias("left_id"), F.lit("all").alias("feature"))
    right = spark.range(300).select(F.col("id").alias("right_id"), F.col("id").alias("ord"), F.lit("all").alias("feature"), F.lit(2).cast("long").alias("weight"))
    got = linking.best_matches(left, right, 2, 10).collect()
    assert len(got) == 600 and {(r["right_id"], r["score"]) for r in got} == {(0, 2), (1, 2)}


def test_code_graph_has_all_kinds_and_no_loose_ends(spark):
    nodes = code_graph.code_nodes(code_queries.evidence(spark, "/root/testdata/sf0.01"))
    edges = code_graph.code_edges(nodes)
    assert {r["type"] for r in edges.select("type").distinct().collect()} == {"contains", "exposes", "persistsTo", "mapsTo", "uses", "starts", "routesTo", "writesTo", "guards", "validates", "handlesErrorsFor", "configures", "protects"}
    assert {"CodeProject", "Module", "Package", "Controller", "EndpointFamily", "HttpEndpoint", "ExternalSystem", "PersistenceTarget", "Table", "Flow", "ValidationBoundary", "ExceptionHandler", "WebConfiguration", "SecurityBoundary"} <= {r["type"] for r in nodes.select("type").distinct().collect()}
    assert code_graph.unresolved_ends(nodes, edges).isEmpty()
    loose = edges.union(spark.createDataFrame([("brand1", "code.brand1", "nowhere", "uses")], edges.schema))
    assert [tuple(r) for r in code_graph.unresolved_ends(nodes, loose).collect()] == [("brand1", "nowhere")]


def test_entrypoints_of_all_kinds(spark):
    kinds = {r["kind"] for r in flow_queries.Evidence(spark, SF).entries().select("kind").distinct().collect()}
    assert {"rest-endpoint", "webhook-endpoint", "callback-endpoint", "quartz-job", "spring-scheduled", "scheduler", "kafka-listener", "rabbit-listener", "jms-listener", "mdb-listener", "event-handler", "startup-runner", "batch-job", "soap-endpoint", "graphql-endpoint", "redis-listener"} <= kinds


def test_quotas_anchors_and_checks_are_all_met(spark):
    e = flow_queries.Evidence(spark, SF)
    entries = e.entries()
    steps = e.steps(entries)
    primary = {r["entry_id"] for r in e.primary(entries).collect()}
    per = defaultdict(Counter)
    for r in steps.collect():
        per[r["entry_id"]][r["role"]] += 1
    assert max(c["validator"] + c["mapper"] + c["helper"] for c in per.values()) <= flow_map.COLLABORATORS
    assert max(c["repository"] for c in per.values()) >= flow_map.REPOSITORIES
    assert {"service", "repository", "validator", "mapper", "helper", "event-publisher", "external-client", "scheduler", "listener", "controller"} <= {x for c in per.values() for x in c}
    clusters = saved(flow_map.cluster_flows(entries, e.primary(entries), steps))
    lists = clusters.select(F.max(F.size("entry_ids")).alias("a"), F.max(F.size("helpers")).alias("b")).first()
    assert max(lists) <= flow_map.EVIDENCE_MOST
    anchored = {("service" if r["first_entry"] in primary else "start") for r in clusters.collect()}
    assert anchored == {"service", "start"}
    flows = flow_map.interpret_flows(clusters, entries, e.primary(entries), e.of["operations"], steps, e.of["known"])
    issues = flow_map.flow_issues(entries, e.primary(entries), steps, saved(flows), *(e.of[k] for k in ("nodes", "edges", "candidates")))
    found = {r["category"] for r in issues.select("category").distinct().collect()}
    assert found == {"low-evidence", "mixed-flow", "missing-node", "broken-edge", "semantic-contradiction"}


def test_traces_of_helpers_are_noise(spark):
    """A traced flow has its service before helpers, so this check is for traces from elsewhere."""
    entries = spark.createDataFrame([("e", "app", 2), ("f", "app", 2)], "entry_id string, app string, n_evidence long")
    none = spark.createDataFrame([], "entry_id string, service string")
    steps = spark.createDataFrame([(e, k, r, f"n{k}") for e, rs in (("e", ["controller", "helper", "mapper", "validator"]), ("f", ["controller", "helper", "mapper", "service"])) for k, r in enumerate(rs)], "entry_id string, step_ord int, role string, node string")
    flows = spark.createDataFrame([], "flow_id string, app string, cluster_name string, entry_id string, flow_type string, n_evidence long")
    nodes, edges = spark.createDataFrame([("x", "n0")], "id string, name string"), spark.createDataFrame([], "src string, dst string")
    others = spark.createDataFrame([], "app string, flow_name string, flow_type string")
    assert [tuple(r) for r in flow_map.flow_issues(entries, none, steps, flows, nodes, edges, others).collect()] == [("e", "utility-noise")]


def test_cluster_without_any_step_takes_the_target(spark):
    entries = spark.createDataFrame([("e", "app", "rest-endpoint", "GET /", "GET /", "Target", "", 1, 0, 1)], "entry_id string, app string, kind string, name string, trigger string, target string, notes string, n_evidence long, rank int, ord long")
    primary = spark.createDataFrame([], "entry_id string, service string, operation string")
    steps = spark.createDataFrame([("e", 1, "helper", "H")], "entry_id string, step_ord int, role string, node string")
    row = flow_map.cluster_flows(entries, primary, steps).first()
    assert (row["anchor"], row["helpers"], row["n_evidence"]) == ("Target", ["H"], 1)


def test_containment_ends_at_cycles_and_containers(spark):
    nodes = spark.createDataFrame([(x, "application" if x in "AB" else "layer", x, [x]) for x in "ABabcdz"], "id string, type string, name string, items array<string>")
    edges = spark.createDataFrame([(s, t, "contains") for s, t in ("Aa", "ab", "bc", "ca", "bB", "Bd", "db", "zz")], "src string, dst string, type string")
    got = {r["id"]: (r["container"], r["depth"], r["path"]) for r in support_graph.nearest_containers(nodes, edges, "application").collect()}
    assert got == {"a": ("A", 1, "A > a"), "b": ("A", 2, "A > a > b"), "c": ("A", 3, "A > a > b > c"), "d": ("B", 1, "B > d")}
    assert {(r["app"], r["card"], tuple(r["items"])) for r in support_graph.cards(nodes, edges, ["layer"]).collect()} == {("A", x, (x,)) for x in "abc"} | {("B", "d", ("d",))}


def test_every_rung_of_the_ladder_is_reached(spark):
    rungs = {r["evidence"] for r in registry.QUERIES["v1_table_ladder"](spark, SF).select("evidence").distinct().collect()}
    assert rungs == {"explicit", "keyword", "hint", "dependency", "graph", "main", "fallback"}


def test_repeated_epochs_leave_the_table_as_it_is(spark, tmp_path):
    out, schema = EpochTable(str(tmp_path / "t"), ["k"]), "k string, v long"
    parts = [[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)]]
    for epoch, rows in enumerate(parts):
        for _ in range(2):
            out.write(spark.createDataFrame(rows, schema), epoch)
    want = [("a", 2), ("b", 1), ("c", 3)]
    read = lambda: sorted(tuple(r) for r in out.read(spark, schema).collect())
    assert read() == want
    out.compact(spark, schema, 1)
    assert read() == want
    out.compact(spark, schema, 2)
    out.write(spark.createDataFrame([("b", 9)], schema), 3)
    assert read() == [("a", 2), ("b", 9), ("c", 3)]
    log = EpochTable(str(tmp_path / "log"))
    for _ in range(2):
        log.write(spark.createDataFrame(parts[0], schema), 0)
    assert log.read(spark, schema).count() == 2


def test_keyed_streams_over_several_batches(spark, tmp_path):
    rows = [("d1", "s1", "x", "h", "2024-01-01 00:00:02", "two"), ("d2", "s1", "x", "h", None, "none"), ("d1", "s2", "x", "h", "2024-01-01 00:00:01", "other"), ("d3", "s1", "x", "h", "2024-01-01 00:00:01", "one"), ("d1", "s1", "x", "h", "2024-01-01 00:00:03", "three")]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "id string, server string, kind string, source_hash string, created_at string, summary string").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    from quarry.plans.stream_queries import _drained

    for name, op, key, want in (
        ("latest", keyed.latest_records, "server", {("s1", "three"), ("s2", "other")}),
        ("first", keyed.first_records, "id", {"d1", "d2", "d3"}),
    ):
        out = _drained(spark, op(deltas.stream_deltas(spark, str(tmp_path / "log"), files_per_trigger=1)), str(tmp_path / name), [key])
        got = {r["id"] for r in out.collect()} if name == "first" else {(r["server"], r["summary"]) for r in out.collect()}
        assert got == want
