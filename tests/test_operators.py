"""Golden fixtures of single operators."""

import random

from pyspark.sql import functions as F

from quarry.functions import names as N
from quarry.operators import linking, quality, records, schema, text
from quarry.operators.aggregates import common_prefix
from quarry.operators.graph import reachable
from quarry.operators.relational import merge_evidence, pack, ranks, unique_by


def one(spark, value, *columns):
    return list(spark.createDataFrame([(value,)], "x string").select(*columns).first())


def test_slugs_and_names(spark):
    assert one(spark, "  Hello, World! ", N.slugify("x"), N.slugify("x", 4), N.snake_case("x")) == ["hello-world", "hell", "hello_world"]
    assert one(spark, "***", N.slugify("x"), N.slugify("x", 80, None)) == ["item", ""]
    assert one(spark, "src/NoteEntity.java", N.normalize_hint("x"), N.base_name("x")) == ["note", "NoteEntity.java"]
    assert one(spark, "a.b.Type", N.package_of("x"), N.simple_name("x")) == ["a.b", "Type"]
    assert one(spark, "Type", N.package_of("x"), N.simple_name("x")) == [None, "Type"]
    long = one(spark, "é" * 3 + "x" * 200, N.artifact_name("x", 40))[0]
    assert len(long) <= 40 and long.startswith("e")
    assert one(spark, "/api/v1//users/7?x=1", N.endpoint_family("x")) == ["/users"]
    assert one(spark, "", N.endpoint_family("x")) == ["/"]
    assert one(spark, "/api/v2", N.endpoint_family("x")) == ["/api"]
    assert one(spark, "paymentGateway_x", N.humanize("x")) == ["Payment Gateway X"]


def test_types_and_kinds(spark):
    assert one(spark, "VARCHAR(20)", N.sql_type("x"), N.column_type("x")) == ["string", "string"]
    assert one(spark, "geometry", N.sql_type("x"), N.column_type("x")) == ["geometry", None]
    assert one(spark, "kafka-listener", N.step_role("x"), N.flow_type("x"), N.flow_actor("x")) == ["listener", "event", "event source"]
    assert one(spark, "UserRepository", N.collaborator_role("x", F.lit(None).cast("string")), N.collaborator_role("x", F.lit("service"))) == ["repository", "service"]


def test_sections_with_and_without_headings(spark):
    docs = spark.createDataFrame([(1, "# T\nlost\n## A\nx\n### B\ny\r\n## C\n"), (2, "no heading"), (3, None), (4, "")], "doc_id long, text string")
    rows = {(r.doc_id, r.name): r.raw for r in text.split_sections(docs).collect()}
    assert rows == {(1, "a"): "x\n### B\ny", (1, "c"): ""}
    assert text.split_headings(docs).count() == 4


def test_contradiction_needs_both_sides(spark):
    items = spark.createDataFrame([(1, "must not delete users"), (2, "must delete users"), (2, "must not delete users"), (3, "allow export"), (3, "deny export")], "doc_id long, item string")
    assert {r.doc_id for r in quality.contradictions(items).collect()} == {2, 3}
    assert 1 in {r.doc_id for r in quality.contradictions(items, compat=True).collect()}


def test_ddl(spark):
    ddl = 'CREATE TABLE IF NOT EXISTS "Notes" (id UUID, price NUMERIC(10,2) NOT NULL, owner_id UUID REFERENCES users(id), PRIMARY KEY (id, price));\nselect 1;\n'
    rows = schema.ddl_definitions(spark.createDataFrame([("f", ddl)], "file string, text string"))
    assert {(r.column_name, r.type, r.nullable) for r in schema.ddl_columns(rows).collect()} == {("id", "uuid", True), ("price", "number", False), ("owner_id", "uuid", True)}
    assert {r.column_name for r in schema.ddl_keys(rows).collect()} == {"id", "price"}
    assert [(r.column_name, r.target_table) for r in schema.ddl_references(rows).collect()] == [("owner_id", "users")]


def test_foreign_keys(spark):
    columns = spark.createDataFrame([("notes", "owner_id"), ("notes", "parent_id"), ("notes", "note_id"), ("tasks", "box_id"), ("tasks", "id")], "table_name string, column_name string")
    tables = spark.createDataFrame([("notes",), ("users",), ("boxes",)], "table_name string")
    assert {(r.from_column, r.to_table) for r in schema.infer_fks(columns, tables).collect()} == {("owner_id", "users"), ("parent_id", "notes"), ("box_id", "boxes")}


def test_containment_join_equals_nested_loop(spark):
    gen = random.Random(3)
    word = lambda n: "".join(gen.choice("abC") for _ in range(n))
    texts, names = {word(gen.randrange(12)) for _ in range(60)}, {word(gen.randrange(6)) for _ in range(40)}
    a, b = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in names], "n string")
    got = sorted((r.t, r.n) for r in linking.contains_pairs(a, b, "t", "n").collect())
    assert got == sorted((t, n) for t in texts for n in names if n and n.lower() in t.lower())


def test_json_from_free_text(spark):
    rows = [(1, '{"summary":"a","notes":"b"}'), (2, 'x\n```json\n{"summary":"c"}\n```'), (3, 'pre {"summary":"d"} post'), (4, "first\nsecond"), (5, None), (6, "{broken")]
    out = {r.k: (r.parsed, r.summary, r.notes) for r in records.parse_review(spark.createDataFrame(rows, "k long, t string"), "t", ["k"]).collect()}
    assert out == {1: (True, "a", "b"), 2: (True, "c", ""), 3: (True, "d", ""), 4: (False, "first", "second"), 5: (False, "", ""), 6: (False, "{broken", "")} or out[5][0] is False


def test_pack_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 9), ("b", 1, 30)], "k string, o int, n int")
    assert [(r.k, r.o) for r in pack(df, ["k"], ["o"], "n", 10).orderBy("k", "o").collect()] == [("a", 1), ("a", 2)]


def test_results_do_not_depend_on_row_order(spark):
    rows = [(k % 7, k, f"a.b.{k % 5}.x") for k in range(200)]
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, o int, p string").repartition(seed + 1)
        results.add((tuple(sorted(map(tuple, unique_by(df, ["k"], ["o"]).collect()))), tuple(sorted(map(tuple, common_prefix(df, ["k"], "p").collect())))))
    assert len(results) == 1


def test_merge_and_reach(spark):
    a = spark.createDataFrame([("x", None, True, ["p"]), ("y", "old", False, None)], "k string, s string, f boolean, l array<string>")
    b = spark.createDataFrame([("y", "new", True, ["q"]), ("z", "n", False, ["r"])], "k string, s string, f boolean, l array<string>")
    out = {r.k: (r.s, r.f, r.l) for r in merge_evidence(a, b, "k", ["s"], ["f"], ["l"]).collect()}
    assert out == {"x": (None, True, ["p"]), "y": ("old", True, ["q"]), "z": ("n", False, ["r"])}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {r.id: r.depth for r in reachable(edges, spark.createDataFrame([("a",)], "id string"), 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_the_whole_corpus_is_read(spark):
    from quarry.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    parts = {f"Part{r[0]}Service.java" for r in spark.read.parquet(f"{sf}/part.parquet").where("p_size % 3 = 0").select("p_partkey").collect()}
    names = [r["name"] for r in QUERIES["s1_read_whole_corpus"](spark, sf).collect()]
    assert len(names) == len(parts) and set(names) == parts and any(int(n[4:].split("S")[0]) >= 60 for n in names)


def test_ranks_of_a_key_that_holds_most_rows(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", (i * 37) % 101, i) for i in range(700)]
    out = ranks(spark.createDataFrame(rows, "k string, at int, id int").repartition(5), ["k"], ["at", F.desc("id")], "place").collect()
    groups = {}
    for k, at, i in rows:
        groups.setdefault(k, []).append((at, -i, i))
    want = {i: place for own in groups.values() for place, (_, _, i) in enumerate(sorted(own), 1)}
    assert {r["id"]: r["place"] for r in out} == want and len(out) == len(rows)


def test_packed_rows_end_at_the_cap(spark):
    rows = [("a", i, 3 + i % 5) for i in range(60)] + [("b", i, None) for i in range(30)] + [("c", 1, 99)]
    out = pack(spark.createDataFrame(rows, "k string, at int, n int"), ["k"], ["at"], "n", 40).collect()
    want, total = [], {}
    for k, at, n in rows:
        total[k] = total.get(k, -2) + (n or 0) + 2
        if total[k] <= 40:
            want.append((k, at, total[k]))
    assert sorted((r["k"], r["at"], r["packed_length"]) for r in out) == sorted(want)


def test_containment_equals_brute_force(spark):
    gen = random.Random(4)
    make = lambda a, b: "".join(gen.choice("abAB ç") for _ in range(gen.randrange(a, b)))
    texts = [make(0, 60) for _ in range(80)] + [None, "", "aaaa", "aaaa"]
    names = sorted({make(1, 7) for _ in range(60)}) + ["", None, "not there at all"]
    left = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    right = spark.createDataFrame([(n, k) for n in names for k in ((1, 2) if n == "ab" else (1,))], "name string, k int")
    got = sorted((r["id"], r["name"], r["k"]) for r in linking.contains_pairs(left, right, "text", "name").collect())
    assert got == sorted((i, n, k) for i, t in enumerate(texts) if t for n in names if n and n.lower() in t.lower() for k in ((1, 2) if n == "ab" else (1,)))
    assert linking.contains_pairs(left, right.where("name = ''"), "text", "name").count() == 0


def test_page_text(spark):
    html = "<style>p{}</style><script>a</script><table><TR><th>A</th><td>B &amp;lt; C</td></TR></table><p>One<br/>two</p>&nbsp;&quot;x&quot;&#39;&copy;<h2>Head</h2><li>i</li>"
    assert one(spark, html, text.html_to_text(F.col("x")))[0] == '| A | B < C One\ntwo\n "x" Head\n i'
