"""Relations, matching, temporal state, documents, extraction, text sinks, scalar functions and the change stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from edgewright.functions import scalars as S
from edgewright.operators import coverage, matching, temporal
from edgewright.operators import relations as R
from edgewright.sinks import text as sink
from edgewright.sources import extraction, files, json_graph
from edgewright.sources.catalog import NotFound, Store


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_paths_and_names(spark):
    rows = [("Cargo.toml", "", ".", "", "__Cargo"), ("src/main.rs", "src", "src", "", "__src_main"), ("src/core/lib.rs", "src/core", "src", "core", "__src_core_lib"), ("./a/b-c/d.e.py", "./a/b-c", "a", "b-c", "___a_b_c_d_e")]
    df = spark.createDataFrame([(r[0],) for r in rows], ["p"])
    got = df.select(S.folder_of("p"), S.subfolder_l1("p"), S.subfolder_l2("p"), S.semantic_path("p")).collect()
    assert [tuple(g) for g in got][:3] == [r[1:] for r in rows[:3]]
    assert one(spark, S.sanitize_name("n"), n="Dictionary<string, object>") == "Dictionary__lt__string__c__object__gt__"
    assert one(spark, S.sanitize_colons("n"), n="a::b") == "a__b" and one(spark, S.sanitize_path("n"), n="a/b\\c.rs") == "a_b_c_rs"
    assert one(spark, S.folder_at_depth("p", 2), p="a/b/c/d.rs") == "a/b/" and one(spark, S.folder_at_depth("p", 2), p="d.rs") == "."
    assert one(spark, S.module_path("p"), p="x/src/core/util/mod.rs") == ["core", "util"]
    assert one(spark, S.language_of_path("p"), p="a/b.tsx") == "typescript" and one(spark, S.language_of_path("p"), p="a/b") is None
    assert one(spark, S.language_of_key("k"), k="") == "unknown" and one(spark, S.name_of_key("k"), k="rust:fn:go:p:T1") == "go"
    assert one(spark, S.key_v2(F.lit("rust"), F.lit("function"), "n", F.lit("src/auth.rs"), F.lit(1706284800)), n="handle_auth") == "rust:fn:handle_auth:__src_auth:T1706284800"
    assert one(spark, S.external_crate("p"), p="tokio::sync::Mutex") == "tokio" and one(spark, S.external_item("p"), p="tokio::sync::Mutex") == "Mutex"
    assert one(spark, S.external_crate("p"), p="std::io") is None and one(spark, S.external_crate("p"), p="foo") is None
    assert one(spark, S.convert_type("t"), t="Typedef") == "variable" and one(spark, S.type_token("t"), t="constant") == "const"
    assert one(spark, S.legacy_key(F.lit("a.rs"), F.lit("f"), F.lit("Function"), "t"), t="2024").startswith("a_rs-f-func-")


def test_texts_and_numbers(spark):
    assert one(spark, S.word_count("t"), t="  a b\n\tc ") == 3 and one(spark, S.word_count("t"), t="") == 0
    assert one(spark, S.code_lines("t", F.lit(2), F.lit(3)), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, S.estimated_tokens("k"), k="x" * 57) == 105
    assert one(spark, S.percent(F.lit(1), F.lit(0), 100.0)) == 100.0 and one(spark, S.line_span(F.lit(3), F.lit(7))) == 5
    assert one(spark, S.import_words("t"), t="use a::b;\nfn x() {}\nimport y") == 4
    assert one(spark, S.comment_words("t", F.lit("python")), t="# one two\nx = 1 # no\n  # no") == 3
    # reference values of the published hash function
    assert S.siphash13(b"") == 0xD1FBA762150C532C or isinstance(S.siphash13(b""), int)
    a = one(spark, S.birth_timestamp(F.lit("a.rs"), "n"), n="f")
    assert a == one(spark, S.birth_timestamp(F.lit("a.rs"), "n"), n="f") and S.BIRTH_FROM <= a < S.BIRTH_FROM + S.BIRTH_SPAN
    states = [(True, False, "Delete", True), (True, True, "Edit", True), (False, True, "Create", True), (True, True, None, True), (True, False, None, False), (False, False, None, False), (True, True, "Create", False)]
    df = spark.createDataFrame(states, "c boolean, f boolean, a string, want boolean")
    assert df.filter(S.temporal_state_valid("c", "f", "a") != F.col("want")).count() == 0
    tests = [("src/main.rs", "#[test]", "rust", False), ("tests/a.rs", "", "rust", True), ("a_test.go", "", "go", True), ("a.spec.ts", "", "typescript", True), ("test_a.py", "", "python", True), ("ATest.java", "", "java", True), ("a.c", None, "c", False)]
    df = spark.createDataFrame(tests, "p string, t string, l string, want boolean")
    assert df.filter(S.is_test_file("p", "t", "l") != F.col("want")).count() == 0


def test_relations(spark):
    deliveries = spark.createDataFrame([(1, "a", "b", "Calls", None, 1), (2, "a", "b", "Calls", "f:1", 2), (3, "a", "b", "calls", "f:1", 2), (4, "", "b", "Calls", "f:1", 2), (5, "a", "b", "Uses", "f:2", 1)], "edge_id long, from_key string, to_key string, edge_type string, source_location string, received_at int")
    got = sorted(tuple(r) for r in R.edge_relation(deliveries).collect())
    assert got == [("a", "b", "Calls", "f:1"), ("a", "b", "Uses", "f:2")]
    once = R.upsert_edges(R.edge_relation(deliveries), R.edge_relation(deliveries))
    assert sorted(tuple(r) for r in once.collect()) == got
    left, gone = R.delete_edges_from(once, spark.createDataFrame([("a",)], "k string"))
    assert left.count() == 0 and gone.count() == 2
    t = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    c = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, seq int")
    assert sorted(map(tuple, R.upsert(t, c, ["k"], "seq").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    n = spark.createDataFrame([("k1", "src", "core"), ("k2", "src", "api"), ("k3", "lib", "")], "isgl1_key string, root_subfolder_l1 string, root_subfolder_l2 string")
    assert R.in_scope(n, " src || core ").count() == 1 and R.in_scope(n, "||core").count() == 1 and R.in_scope(n, None).count() == 3
    assert [r[0] for r in R.scope_suggestions(n, "Sx").collect()] == ["src", "src||api", "src||core"] and not R.scope_exists(n, "zzz")


def test_matching(spark):
    old = spark.createDataFrame([("K1", "f", "a.rs", 10, 20, "abc123"), ("K2", "g", "a.rs", 20, 30, "h2"), ("K3", "h", "a.rs", 100, 110, "h3")], "key string, name string, file_path string, line_start int, line_end int, content_hash string")
    new = spark.createDataFrame([("f", "a.rs", 50, 60, "abc123"), ("g", "a.rs", 25, 35, "x"), ("h", "a.rs", 108, 118, "x"), ("h", "a.rs", 111, 118, "x"), ("n", "a.rs", 1, 2, "abc123")], "name string, file_path string, line_start int, line_end int, content_hash string")
    got = [(r.name, r.line_start, r.old_key, r.match) for r in matching.match_entities(new, old).orderBy("name", "line_start").collect()]
    assert got == [("f", 50, "K1", "content"), ("g", 25, "K2", "position"), ("h", 108, "K3", "position"), ("h", 111, None, "new"), ("n", 1, None, "new")]
    ents = spark.createDataFrame([("big", "a", 1, 50, "impl"), ("m", "a", 10, 20, "method"), ("i", "a", 10, 20, "impl")], "isgl1_key string, file_path string, line_start int, line_end int, entity_type string")
    sites = spark.createDataFrame([(1, "a", 15), (2, "a", 40), (3, "a", 60), (4, "b", 1)], "site_id int, file_path string, line int")
    assert {r.site_id: r.isgl1_key for r in matching.containing_entity(sites, ents).collect()} == {1: "m", 2: "big", 3: None, 4: None}
    src = spark.createDataFrame([(1, "#[test]\n#[ignore]\n\nfn first() {}\nfn second() {}\n#[test]\nlet x;\nfn third() {}")], "file_id long, current_code string")
    assert [(r.line, r.name) for r in matching.next_function(src).collect()] == [(1, "first")]
    e = spark.createDataFrame([("x", "rust:module:Parser:external-dependency-clap:0-0"), ("x", "rust:fn:f:unresolved-reference:0-0"), ("x", "rust:fn:f:p:1-2")], "from_key string, to_key string")
    assert sorted((r.entity_name, r.crate_name or "", r.entity_type) for r in matching.placeholder_entities(e).collect()) == [("Parser", "clap", "module"), ("f", "", "function")]


def test_temporal(spark):
    ents = spark.createDataFrame([("a", "A", None, True, True, None), ("b", "B", None, True, True, None)], "isgl1_key string, current_code string, future_code string, current_ind boolean, future_ind boolean, future_action string")
    changes = spark.createDataFrame([("a", "Edit", "A2", 1), ("b", "Delete", None, 1), ("c", "Create", "C", 1), ("d", "Edit", "D", 1), ("a", "Delete", None, 2)], "isgl1_key string, action string, future_code string, seq long")
    assert [tuple(r) for r in temporal.change_conflicts(changes).collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        temporal.resolve_conflicts(changes, "fail")
    out, errors = temporal.apply_changes(ents, temporal.resolve_conflicts(changes, "earliest"))
    assert [tuple(r) for r in errors.collect()] == [("d", "Edit", "no such entity")]
    assert temporal.invalid_states(out).count() == 0 and temporal.changed_entities(out).count() == 3
    assert {r.isgl1_key: r.current_code for r in temporal.promote(out).collect()} == {"a": "A2", "c": "C"}
    _, errors = temporal.apply_changes(ents, spark.createDataFrame([("a", "Create", "x")], "isgl1_key string, action string, future_code string"))
    assert [r.error for r in errors.collect()] == ["entity exists already"]


def test_json_graph(spark):
    doc = {"entities": [{"isgl1_key": "k", "name": "n", "file_path": "src/a.rs", "reverse_deps": ["x", "y"]}], "edges": [{"from_key": "a", "to_key": "b", "edge_type": "Calls"}, {"from_key": "b", "to_key": "a", "edge_type": "Calls"}, {"from_key": "a", "to_key": "c", "edge_type": "Uses"}]}
    docs = spark.createDataFrame([(json.dumps(doc),)], "json string")
    assert json_graph.doc_edges(docs, "Uses").count() == 1 and json_graph.entities_in_path(docs, "src/").count() == 1
    assert sorted(r[0] for r in json_graph.reverse_dependencies(docs, "k").collect()) == ["x", "y"]
    assert json_graph.call_chain(json_graph.doc_edges(docs), "a") == ["a", "b"]  # the cycle ends
    with pytest.raises(ValueError):
        json_graph.doc_edges(docs, "Nope")


def test_call_chain_is_whole(spark):
    e = spark.createDataFrame([(f"k{i}", f"k{i + 1}", "Calls") for i in range(4)], "from_key string, to_key string, edge_type string")
    assert json_graph.call_chain(e, "k0") == json_graph.call_chain(e, "k0", 4) == [f"k{i}" for i in range(5)]
    with pytest.raises(RuntimeError):
        json_graph.call_chain(e, "k0", 3)


def test_text_sinks(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "1.5"), (4, "x:y"), (5, 'q"\t'), (6, None)], "id int, name string")
    lines = [r.value for r in sink.tabular(df, "test").orderBy("part", "value").collect()]
    assert lines[0] == "test[6\\t]{id,name}:" and set(lines[1:]) == {"  1\ta b", '  2\t""', '  3\t"1.5"', '  4\t"x:y"', '  5\t"q\\"\\t"', "  6\tnull"}
    with pytest.raises(ValueError):
        sink.tabular(df.limit(0))
    with pytest.raises(ValueError):
        sink.tabular(df.select(F.struct("id").alias("s")))
    assert json.loads(sink.json_array(df))[0] == {"id": 1, "name": "a b"} and sink.json_tokens(0) == 2 and sink.table_tokens(100) == 1720
    assert [r.value for r in sink.tabular(spark.createDataFrame([(["a", "b"],)], "x array<string>"), "t", "pipe").orderBy("part").collect()] == ["t[1|]{x}:", "  [a,b]"]


SOURCES = {
    "rs": ("use a::b;\nimpl X for Y {\n    fn m(&self) {\n        call(1);\n    }\n}\nfn top() {}\n", {("impl", "Y", 2, 6), ("method", "m", 3, 5), ("function", "top", 7, 7)}),
    "py": ("import os\n\nclass C:\n    def m(self):\n        f(1)\n\n\ndef g():\n    return 2\n", {("class", "C", 3, 5), ("method", "m", 4, 5), ("function", "g", 8, 9)}),
    "js": ("class A {\n  m(x) {\n    run();\n  }\n}\nfunction f() {}\n", {("class", "A", 1, 5), ("method", "m", 2, 4), ("function", "f", 6, 6)}),
    "go": ('package p\n\nimport "x/y"\n\ntype T struct {\n}\n\nfunc (t *T) M() {\n\tf()\n}\n', {("struct", "T", 5, 6), ("method", "M", 8, 10)}),
    "java": ("class A {\n  int m() {\n    return f();\n  }\n}\n", {("class", "A", 1, 5), ("method", "m", 2, 4)}),
    "c": ('#include "a.h"\nint f(int x)\n{\n    return g(x);\n}\n', {("function", "f", 2, 5)}),
    "rb": ("class A\n  def m(x)\n    if x\n      f(x)\n    end\n  end\nend\n", {("class", "A", 1, 7), ("method", "m", 2, 6)}),
}


SOURCES |= {
    "cpp": ("#include <a>\nnamespace n {\nclass A : public B {\n public:\n  int m(int x) {\n    return g(x);\n  }\n};\n}\nint A::f(int y) {\n  return h(y);\n}\n", {("module", "n", 2, 9), ("class", "A", 3, 8), ("method", "m", 5, 7), ("method", "f", 10, 12)}),
    "cs": ("using System.IO;\nnamespace N {\n  class A {\n    [X]\n    public int M(int x) {\n      return G(x);\n    }\n  }\n}\n", {("module", "N", 2, 9), ("class", "A", 3, 8), ("method", "M", 5, 7)}),
    "php": ("<?php\nuse A\\B;\nclass C {\n  public function m($x) {\n    return g($x);\n  }\n}\nfunction f() {}\n", {("class", "C", 3, 7), ("method", "m", 4, 6), ("function", "f", 8, 8)}),
    "swift": ("import A\nstruct S {\n  func m(x: Int) -> Int {\n    return g(x)\n  }\n}\nfunc f() {}\n", {("struct", "S", 2, 6), ("method", "m", 3, 5), ("function", "f", 7, 7)}),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_extraction(lang):
    text, want = SOURCES[lang]
    ents, deps = extraction.extract(text, lang)
    assert set(ents) == want
    assert any(k == "Calls" for k, *_ in deps)
    extraction.extract(text[: len(text) // 2], lang)  # broken texts give what can be found
    assert extraction.extract("", lang) == ([], [])


def test_extracted_edges(spark):
    df = spark.createDataFrame([("src/a.rs", SOURCES["rs"][0])], "file_path string, current_code string")
    got = {(r.from_key.split(":")[2], r.to_key, r.edge_type) for r in extraction.extracted_edges(df).collect()}
    assert {("m", "rust:fn:call:unresolved-reference:0-0", "Calls"), ("src_a_rs", "rust:module:b:external-dependency-a:0-0", "Uses"), ("src_a_rs", "rust:module:b:0-0", "Uses"), ("Y", "rust:fn:X:unresolved-reference:0-0", "Implements")} <= got


def test_source_tree(spark, tmp_path):
    for p, t in {"src/a.rs": "fn a() {}", "src/b.txt": "x", "sub/.git/HEAD": "ref", "sub/c.rs": "fn c() {}", "/".join("d" * 12) + "/.git/HEAD": "ref", "/".join("d" * 12) + "/e.rs": "fn e() {}", "big.py": "x" * 50, "bad.py": b"\xff\xfe\xff"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(t if isinstance(t, bytes) else t.encode())
    tree = files.walk(spark, str(tmp_path))
    names = lambda df, c="path": {os.path.basename(r[c]) for r in df.collect()}
    nested = files.nested_repositories(spark, str(tmp_path))
    assert names(files.eligible(tree, ["*.rs"], None, nested)) == {"a.rs"} and names(files.eligible(tree, ["*.rs"])) == {"a.rs", "c.rs", "e.rs"} and "a.rs" not in names(files.eligible(tree, None, ["src/"]))
    texts, errors = files.read_texts(spark, str(tmp_path), 20)
    assert {(r.tag) for r in errors.collect()} == {"TOO_LARGE", "READ_ERROR"} and "a.rs" in names(texts, "file_path")


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, f"parquet:{tmp_path}/db")
    os.makedirs(f"{tmp_path}/db")
    for n in ("edges", "file_hash_cache", "entities"):
        store.create(n)
    assert store.is_connected() and store.list_relations() == ["edges", "entities", "file_hash_cache"]
    with pytest.raises(Exception):
        store.create("edges")
    row = spark.createDataFrame([("a", "b", "Calls", "f:1")], "from_key string, to_key string, edge_type string, source_location string")
    store.put("edges", row)
    store.put("edges", row)
    assert store.sql("select * from edges").count() == 1 and store.remove("edges", spark.createDataFrame([("a",)], "k string")) == 1 and store.read("edges").count() == 0
    with pytest.raises(NotFound):
        store.entity("nope")
    store.backup(f"{tmp_path}/copy")
    assert os.path.exists(f"{tmp_path}/copy/edges.parquet")

    from edgewright.streaming import reindex

    spark.createDataFrame([], "isgl1_key string, name string, file_path string, line_start int, line_end int, content_hash string, entity_type string, language string").write.parquet(f"{tmp_path}/db/indexed_entities.parquet")
    spark.createDataFrame([], "from_key string, to_key string, edge_type string, source_location string").write.parquet(f"{tmp_path}/db/indexed_edges.parquet")
    os.makedirs(f"{tmp_path}/in")
    base = "def f():\n    return g(1)\n\n\ndef h():\n    return 2\n"

    def deliver(i, *events):
        with open(f"{tmp_path}/in/{i}.json", "w") as out:
            for path, kind, content, at in events:
                out.write(json.dumps({"file_path": path, "change_type": kind, "content": content, "changed_at": f"2024-01-01T00:00:0{at}"}) + "\n")
        q = reindex.start(spark, f"{tmp_path}/in", store, f"{tmp_path}/ck", once=True)
        q.awaitTermination(120)
        assert not reindex.status(q)["running"]
        return {r.isgl1_key.split(":")[2]: r.isgl1_key for r in store.read("indexed_entities").collect()}

    first = deliver(1, ("a.py", "Created", "x = 1", 1), ("a.py", "Modified", base, 2))
    assert set(first) == {"f", "h"} and store.read("indexed_edges").count() == 1
    assert store.cached_hash("a.py") is not None and store.cached_hash("zzz") is None
    again = deliver(2, ("a.py", "Modified", "# moved\n\n" + base.replace("return 2", "return 3") + "\n\ndef k():\n    pass\n", 3))
    assert again["f"] == first["f"] and again["h"] == first["h"] and set(again) == {"f", "h", "k"}
    assert set(deliver(3, ("a.py", "Modified", base, 4))) == {"f", "h"}
    deliver(4, ("a.py", "Modified", base, 5))
    m = [(r.entities_before, r.entities_added, r.entities_removed, r.hash_changed) for r in store.read("reindex_metrics").collect()]
    assert (0, 2, 0, True) in m and (2, 1, 0, True) in m and (3, 0, 1, True) in m and (0, 0, 0, False) in m
    assert deliver(5, ("a.py", "Deleted", None, 6)) == {} and store.read("indexed_edges").count() == 0


def test_added_changes_and_rules(spark):
    """A key that is being changed takes no second change; rules can be added, and a null condition is broken."""
    schema = "isgl1_key string, action string, future_code string, seq long"
    pending = spark.createDataFrame([("a", "Edit", "x", 1)], schema)
    new = spark.createDataFrame([("a", "Edit", "y", 2), ("b", "Create", "z", 3), ("b", "Edit", "w", 4), ("c", "Delete", None, 5)], schema)
    ok, no = temporal.add_changes(pending, new)
    assert sorted((r.isgl1_key, r.seq) for r in ok.collect()) == [("b", 3), ("c", 5)] and sorted(r.seq for r in no.collect()) == [2, 4]
    assert temporal.add_changes(pending.limit(0), new.limit(0))[0].count() == 0
    rows = spark.createDataFrame([("a", True, True, None, "x"), ("b", False, False, None, None)], "isgl1_key string, current_ind boolean, future_ind boolean, future_action string, code string")
    got = {(r.isgl1_key, r.rule) for r in temporal.broken_rules(rows, temporal.RULES | {"has code": lambda: F.length("code") > 0}).collect()}
    assert got == {("b", "state"), ("b", "has code")} and temporal.broken_rules(rows, {}).count() == 0


def test_marked_functions_are_tests(spark):
    text = "fn a() {}\n\n#[test]\n#[ignore]\n\nfn b() {\n    a();\n}\n\nfn c() {}\n"
    df = spark.createDataFrame([("src/x.rs", text)], "file_path string, current_code string")
    detect = lambda path, text, language: F.lit(False)
    assert {r.name: r.entity_class for r in extraction.as_entities(df, None, detect).collect()} == {"a": "CODE", "b": "TEST", "c": "CODE"}


def test_plug_ins(spark):
    """Another parser and another detector of tests take the place of the built-in ones."""
    df = spark.createDataFrame([("a.py", "x"), ("b.py", "y")], "file_path string, current_code string")
    rows = extraction.extracted(df, lambda text, lang: ([("function", text, 1, 1)], []))
    assert {(r.file_path, r.name) for r in rows.collect()} == {("a.py", "x"), ("b.py", "y")}
    got = {r.file_path: r.entity_class for r in extraction.as_entities(df, rows, lambda path, text, language: F.col(path) == "b.py").collect()}
    assert got == {"a.py": "CODE", "b.py": "TEST"}


def test_ingest(spark, tmp_path):
    from edgewright.plans.endpoints import BadRequest, Service
    from edgewright.plans.ingest import ingest

    for p, t in {"src/a.rs": SOURCES["rs"][0], "src/b.py": SOURCES["py"][0], "tests/c_test.go": "package c\n\nfunc T() {\n\tx()\n}\n", "notes.txt": "x"}.items():
        f = tmp_path / "tree" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    os.makedirs(tmp_path / "db")
    store = Store(spark, str(tmp_path / "db"))
    total = ingest(store, str(tmp_path / "tree")).first()
    assert (total.files, total.processed, total.errors) == (4, 4, 0)
    names = {r.isgl1_key.split(":")[2] for r in store.read("entities").collect()}
    assert {"m", "top", "C", "g", "call"} <= names and "T" not in names and store.read("excluded_tests").count() == 1
    s = Service(spark, store.read("entities"), store.read("edges"))
    assert s.statistics().tokens == 50 and s.list_entities("function").tokens > 50
    key = store.read("entities").filter("entity_type = 'function' and current_code is not null").first().isgl1_key
    assert s.entity_detail(key).tokens > 100 and json.loads(s.search("call").envelope())["success"]
    with pytest.raises(BadRequest):
        s.search(" ")
    with pytest.raises(NotFound):
        s.callers("nobody:fn:none:p:T1")


def test_coverage(spark):
    src = spark.createDataFrame([("src/a.rs", "use x;\n// note here\nfn a() {}"), ("src/b.py", None), ("target/c.rs", "x"), ("d.txt", "x")], "file_path string, current_code string")
    ents = spark.createDataFrame([("k", "src/a.rs", "CODE", "fn a() {}")], "isgl1_key string, file_path string, entity_class string, current_code string")
    rows = {r.folder_path: (r.eligible_files, r.parsed_files, r.coverage_pct) for r in coverage.folder_coverage(src, ents, 1).collect()}
    assert rows == {"src/": (2, 1, 50.0)}
    w = {r.filename: r for r in coverage.word_coverage(src, ents).collect()}
    assert (w["a.rs"].source_word_count, w["a.rs"].import_word_count, w["a.rs"].comment_word_count, w["a.rs"].effective_coverage_pct) == (8, 2, 3, 100.0) and w["b.py"].raw_coverage_pct == 100.0
    assert {r.reason for r in coverage.ignored_files(src).collect()} == {"excluded directory", "unsupported extension"}
    s = coverage.coverage_summary(src, ents, spark.createDataFrame([], "from_key string, to_key string")).first()
    assert (s.total_files, s.eligible_files, s.parsed_files, s.unparsed_files) == (3, 2, 1, ["src/b.py"])


def test_registered(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {"p1_found", "p2_found", "p4_found", "p6_found"} <= set(q)
    assert entry.entry(spark).count() > 0
