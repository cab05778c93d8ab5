"""Operators of applications and integrity rules: nulls, empty tables, hot keys, each branch of their tables."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import applications as P
from quarry.operators import graph_checks as C
from quarry.operators import records

CONTRACT = "project string, file string, type_name string, imports array<string>, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_contracts_without_text_imports_or_calls(spark):
    data = [("p", "a", None, None, "x"), ("p", "b", "OrderApi", ["c.dto.Order", "d.Kind", "e.dto.Order"], '@SecurityRequirement(name = "k") @Valid @Operation moderator'), ("p", "c", "X", [], None), ("p", "d", "X", [], "")]
    contracts = spark.createDataFrame(data, CONTRACT)
    calls = spark.createDataFrame([("p", "OrderApi", "GET", "/o", 1), ("p", None, "GET", "/n", 2)], "project string, type_name string, method string, path string, ord long")
    enums = spark.createDataFrame([("p", "Kind"), ("p", "Kind")], "project string, name string")
    got = {r["file"]: r for r in P.api_surface(contracts, calls, enums).collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"]["family"], got["a"]["n_endpoints"], got["a"]["auth"], got["a"]["dto_types"], got["a"]["enum_types"]) == ("API", 0, "public", [], [])
    b = got["b"]
    assert (b["family"], b["auth"], b["samples"], b["schemes"], b["permissions"]) == ("Order", "protected", ["GET /o"], ["k"], ["moderator access"])
    assert (b["dto_types"], b["enum_types"], b["validated"], b["described"]) == (["Order"], ["Kind"], True, True)
    assert rows(P.api_surface(contracts.limit(0), calls, enums)) == []
    files = spark.createDataFrame([("q", "src/openapi.yaml"), ("r", "a.java")], "project string, file string")
    assert rows(P.api_flags(contracts, files)) == [("p", "java-contracts", False, False, True), ("q", "openapi-generated", False, False, False), ("r", "unknown", False, False, False)]


def test_every_source_reaches_its_layers(spark):
    sources = sorted({s for ss in P.LAYER_SOURCES.values() for s in ss if not s.endswith(" type")})
    kinds = sorted({s.removesuffix(" type") for ss in P.LAYER_SOURCES.values() for s in ss if s.endswith(" type")})
    items = spark.createDataFrame([("p", s, f"redis {s}") for s in sources] * 2 + [("p", "none", "x"), ("p", None, "x"), ("p", "job", None)], "project string, source string, item string")
    types = spark.createDataFrame([("p", k, f"redis {k} t") for k in kinds] + [("p", None, "x")], "project string, kind string, name string")
    apps = spark.createDataFrame([("p", "A-Backend"), ("p", "a-Notification"), ("p", "tool"), ("q", "idle")], "project string, app string")
    want = set()
    for layer, ss in P.LAYER_SOURCES.items():
        for app in ("A-Backend", "a-Notification", "tool"):
            if {"common": app == "A-Backend", "notification": app == "a-Notification"}.get(layer, True):
                want |= {("p", app, layer, f"redis {s.removesuffix(' type')} t" if s.endswith(" type") else f"redis {s}") for s in ss}
    assert set(rows(P.application_layers(items, types, apps))) == want


def test_flows_go_to_the_first_application_named(spark):
    flows = [("p", i, s, n, t) for i, (s, n, t) in enumerate([("see ONE and two", "two", "t"), (None, "mail", None), ("", None, "t"), ("mail", "one", "t"), ("nothing", "in two", "t")])]
    flows = spark.createDataFrame(flows + [("q", 9, "one", "x", "t")], "project string, flow_id long, summary string, name string, trigger string")
    apps = spark.createDataFrame([("p", "two", 2), ("p", "one", 1), ("p", "two", 3)], "project string, app string, ord long")
    got = {r["flow_id"]: (r["app"], r["label"]) for r in P.flows_by_app(flows, apps, [("mail", "mailer")]).collect()}
    assert got == {0: ("one", "t -> two"), 1: ("mailer", " -> mail"), 2: ("application", "t -> "), 3: ("mailer", "t -> one"), 4: ("two", "t -> in two"), 9: ("application", "t -> x")}


def test_sections_rebuilt_in_parts(spark):
    gen = random.Random(2)
    found = [("d", "flows", gen.choice(["document", "graph"]), f"line {gen.randrange(300)}", i) for i in range(900)]
    existing = spark.createDataFrame([("d", "flows", "- line 7\n* new\n\n  "), ("e", "flows", None), (None, "flows", "x")], "doc_id string, section string, text string")
    lines = P.flow_lines(spark.createDataFrame(found, "doc_id string, section string, source string, line string, ord long"), existing)
    at = {"document": 1, "graph": 2, "section": 3}
    first = {}
    for _, _, source, line, i in [*found, (0, 0, "section", "line 7", 0), (0, 0, "section", "new", 1)]:
        first[line] = min(first.get(line, (9, 0, line)), (at[source], i, line))
    parts = P.section_parts(lines, most=40).where("doc_id = 'd'").orderBy("part").collect()
    assert [p["part"] for p in parts] == list(range(len(parts))) and len(parts) > 5
    assert "\n".join(p["text"] for p in parts).split("\n") == [f"- {line}" for *_, line in sorted(first.values())]
    assert rows(P.section_parts(lines).where("doc_id IS NULL")) == [(None, "flows", 0, "- x")]


NODES = "id string, type string, external boolean, monitored boolean"


def test_integrity_rules_on_nulls_and_hubs(spark):
    nodes = [("hub", "DataFlow", None, True), ("m", "Metric", None, None), ("i", "Issue", True, None), ("x", None, True, None), (None, "Process", None, None)] + [(f"t{k}", "Transformation", None, None) for k in range(60)]
    edges = [("e", "i", "e1"), ("e1", "hub", "m"), ("e2", None, "hub")] + [(f"a{k}", "hub", f"t{k}") for k in range(60)] + [(f"b{k}", f"t{k}", "hub") for k in range(40)]
    nodes, edges = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, "id string, src string, dst string")
    want = [("external integration of another type", n) for n in ("i", "x")] + [("process without interface, data flow or dependency", None)] + [("transformation without output flow", f"t{k}") for k in range(40, 60)]
    assert rows(C.integrity_violations(nodes, edges)) == sorted(want, key=repr)
    # Without ids of edges, an issue that points to one has no cause.
    assert ("issue without cause", "i") in rows(C.integrity_violations(nodes, edges.drop("id")))
    assert rows(C.integrity_violations(nodes.limit(0), edges)) == []


def test_dependencies_by_name_within_a_document(spark):
    nodes = [(1, "p", "Process", "Load Orders DB"), (1, "q", "Process", None), (1, "d", "Persistence", "orders db"), (2, "d", "Dependency", "orders db"), (2, "s", "Service", None), (1, "n", "Dependency", None)]
    df = spark.createDataFrame(nodes, "doc_id long, id string, type string, name string")
    assert rows(C.dependency_edges(df)) == [(1, "p", "d", "writesTo"), (2, "s", "d", "dependsOn")]
    named = spark.createDataFrame([("UserRepo", None), (None, "Repository"), ("repository", "x"), ("Base", "JpaRepository"), ("A", "x")], "name string, type string")
    assert rows(C.persistence_processes(named)) == [("Base persistence",), ("User persistence",)]


@pytest.mark.parametrize("text", [None, "", "[]", "{}", '{"relationships":null}', '{"relationships":[null]}', "{oops"])
def test_relationships_of_nothing(spark, text):
    assert rows(records.normalize_relationships(spark.createDataFrame([(1, text)], "k long, j string"), "j", ["k"])) == []


def test_parse_counts_and_cards(spark):
    schema = "project string, package string, imports array<string>, type_names array<string>, nodes long, named_nodes long, types long, fields long, methods long"
    files = spark.createDataFrame([("p", "a", ["i", "i", ""], None, 1, None, 2, 3, 4), ("p", None, None, ["T"], 5, 6, None, 0, 0), (None, "a", [], [], None, None, None, None, None)], schema)
    assert rows(P.parse_totals(files, ["project"])) == [("p", 2, 6, 6, 2, 3, 4), (None, 1, 0, 0, 0, 0, 0)]
    assert rows(P.parse_names(files, ["project"])) == sorted([("p", "package", "a"), ("p", "import", "i"), ("p", "type", "T"), (None, "package", "a")], key=repr)
    hot = spark.createDataFrame([("hot", f"n{i % 500:03}") for i in range(2000)] + [("a", "x"), ("a", None), (None, "y")], "k string, v string")
    cards = {r["k"]: (r["n"], r["first"]) for r in P.class_cards(P.class_members(hot, "k", "v"), "k", "v").collect()}
    assert cards == {"hot": (500, [f"n{i:03}" for i in range(16)]), "a": (1, ["x"])}
