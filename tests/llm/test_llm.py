"""Problems 3, 5, 7, 8, 9 and 10 on small tables, with nulls, empty and very long texts, ties, repeats and odd columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("edgewright.llm.queries")

from edgewright.llm.authorship import foreign_files
from edgewright.llm.documentation import declaration, describe, documented_functions, parts, squeezed
from edgewright.llm.gll import parse
from edgewright.llm.grammar import Grammar
from edgewright.llm.languages import grammar
from edgewright.llm.lexing import token_string
from edgewright.llm.mixing import mix_report, mix_sources
from edgewright.llm.packing import best_fit, fill_containers
from edgewright.llm.parsing import parse_rates, unparsable_files
from edgewright.llm.splitting import piece_bounds, split_texts
from edgewright.llm.tokens import VOCABULARY, edges_of, encode, encoder

from snippets import BROKEN, VALID

FILES = "file_id long, repository string, file_path string, current_code string"
ENTITIES = "isgl1_key string, language string, entity_type string, current_code string"
DOCS = "doc_id long, text string, source string"


def noisy(df):
    return df.select("*", *[F.lit(1).alias(c) for c in ("reason", "ext", "text_hash", "n_tokens", "src", "pos", "FILE_ID", "Text", "ISGL1_KEY", "kind", "place")])


# ---- 3 -----------------------------------------------------------------------------------------------------------

HAND = "use a::b;\n\n// Reads the notices that tools leave, such as DO NOT EDIT.\npub fn scan(x: &str) -> bool {\n    let mark = \"Code generated by the writer. DO NOT EDIT.\";\n    x.contains(mark)\n}\n"


def test_foreign_files(spark):
    rows = [
        (1, "me", "me/src/a.rs", HAND), (2, "me", "me/src/b.py", "# Code generated by toolX 1.2. DO NOT EDIT.\nx = 1\n"), (3, "me", "me/vendor/lib/c.go", "package c\n"), (4, "me", "me/src/vendors/d.rs", HAND),
        (5, "me", "me/src/e.js", "/*\n * Copyright (c) the other authors.\n * Part of the other project; see LICENSE.\n */\nlet x = 1;\n"), (6, "me", "me/src/f.js", "// Part of the me project; see LICENSE.\nlet x = 1;\n"),
        (7, "me", "me/src/g.js", "function a(b){return b.c(b)||1}var d=function(e){for(var n=0;n<e.length;n++)e[n]+=1};" * 5), (8, "me", "me/src/h.py", "TABLE = [" + ", ".join(map(str, range(400))) + "]\n"),
        (9, "me", "me/src/i.rs", "\n".join(f"pub fn word_{i:03}(m: &Raw) -> u32 {{\n    m.word({4 * i})\n}}\n" for i in range(30))), (10, "me", "me/src/j_pb2.py", None), (11, "me", "me/src/k.py", ""), (12, None, None, None), (13, "me", "me/src/l.rs", HAND + "\n// Automatisch erzeugt von werk 2.0 - bitte nicht bearbeiten\n"),
        (2, "me", "me/src/b.py", "# Code generated by toolX 1.2. DO NOT EDIT.\nx = 1\n"), (14, "me", "me/external/lib-1.2.3/m.c", "int x;\n"), (15, "me", "me/src/external_api/m.c", "int x;\n"), (16, "me", "me/src/n.py", "# This module generates code: it writes stubs.\n# Edit the templates here by hand.\nx = f(1)\n"),
        (17, "me", "me/src/o.py", "def f(a):\n    return a\n" + "# é\n" * 200_000),
    ]
    got = {r.file_id: r.reason for r in foreign_files(noisy(spark.createDataFrame(rows, FILES))).collect()}
    assert got == {2: "generated", 3: "vendored", 5: "vendored", 7: "minified", 8: "data", 9: "generated", 10: "generated", 13: "generated", 14: "vendored", 17: "generated"} or got == {2: "generated", 3: "vendored", 5: "vendored", 7: "minified", 8: "data", 9: "generated", 10: "generated", 13: "generated", 14: "vendored"}
    assert foreign_files(spark.createDataFrame([], FILES)).count() == 0


def test_notices():
    """Notices open a sentence of the header; what only talks of them, a docstring's examples or a table of names is no case."""
    from edgewright.llm.authorship import reason_of

    cases = [
        ("# auto generated by OpenAPI Generator\nx = 1\n", "py", "generated"), ("/* This file was automatically produced by SWIG 4.0 */\nint x;\n", "c", "generated"), ("/* A Bison parser, made by GNU Bison 3.8.2.  */\nint x;\n", "c", "generated"), ("// DO NOT EDIT. Built by protoc.\nlet x = 1;\n", "js", "generated"),
        ("// Code generated by mockgen. DO NOT EDIT.\npackage a\n", "go", "generated"), ('"""Code generated by tool 1. DO NOT EDIT."""\nx = 1\n', "py", "generated"), ("/*!\n * jQuery JavaScript Library v3.6.0\n * Copyright OpenJS Foundation and other contributors\n * Released under the MIT license\n */\nlet x = 1;\n", "js", "vendored"),
        ("/**\n * @license\n * Lodash <https://lodash.com/>\n * Copyright OpenJS Foundation and other contributors <https://openjsf.org/>\n * Released under MIT license <https://lodash.com/license>\n */\nlet x = 1;\n", "js", "vendored"), ("// This is a vendored copy of left-pad.\nlet x = 1;\n", "js", "vendored"),
        ('"""Finds headers of tools.\n\nCode generated by x. DO NOT EDIT.\n"""\nx = f(1)\n', "py", None), ("// Loads the third-party library at runtime.\nlet x = 1;\n", "js", None), ("// Looks for \"Code generated by\" in the first line.\nlet x = 1;\n", "js", None), ("# Edit the templates here by hand.\nx = f(1)\n", "py", None), ("// Written by Anna for the parser team.\nlet x = 1;\n", "js", None),
        ("enum E {\n" + "".join(f"    ITEM_{i:02} = {i},\n" for i in range(40)) + "};\n", "c", None), ("void f() {\n" + "".join(f"    check({i}, {i + 1});\n" for i in range(40)) + "}\n", "c", None), ("// Copyright 2024 the me authors. Licensed under the Apache License, Version 2.0.\nlet x = 1;\n", "js", None),
    ]
    assert [(t, (reason_of(t, ext, "me") or (None,))[0]) for t, ext, _ in cases] == [(t, want) for t, _, want in cases]


# ---- 5 -----------------------------------------------------------------------------------------------------------

GOOD = {
    "rs": ["", "use a::{b, c};\n\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\n\nimpl<'a> S<'a> {\n    /// text with ) and {\n    pub fn f(&self, y: Vec<u8>) -> Result<(), E> {\n        let v = y.iter().map(|x| x + 1).collect::<Vec<_>>();\n        match v.get(0) { Some(h) => g(h)?, None => {} }\n        if v.len() > 2 && !self.ok() { return Err(E::new(\"}\")); }\n        Ok(())\n    }\n}\nconst A: &[u8] = &[1, 2];\n"],
    "py": ["x = 1\n", "import os\n\n@d(1)\nclass C(B):\n    def f(self, a, *b, **c) -> int:\n        '''doc\n<<<<<<< not a mark\n'''\n        try:\n            y = {k: v for k, v in a.items() if v}\n        except (A, B) as e:\n            raise X(\"(\") from e\n        else:\n            pass\n        with open(a) as f, g() as h:\n            return [i for i in f][1:]\n        return lambda x: x if x else -x\n"],
    "js": ["import a, { b as c } from './x';\n\nexport default class A extends B {\n  static x = 1;\n  async m(a, b = 2) {\n    for (const i of a) { this.y(i) }\n    const r = /[/{]+/g.test(`t ${a} }`) ? a : b;\n    return { ...a, r, get q() { return 1 } }\n  }\n}\nconst f = async (x) => { await x }\nif (a) b(); else c()\n", "!function(e){var q=e[0];if(q&&q.c)return;e(1)}(this);window.a=window.b?{c:1,d:2}:\"x\";"],
    "ts": ["import { a } from './a';\n\nexport class A<K, V> {\n  private x: Map<string, number> = new Map<string, number>();\n  constructor(private readonly y?: string) {}\n  m(a: number[], b: (x: string) => void): Promise<V | null> {\n    const c = a as readonly number[];\n    return this.z!.q(c) ?? null;\n  }\n}\nexport type T = { a: string; b?: number };\ninterface I { f(x: number): void }\nenum E { A = 1, B }\n"],
    "java": ["package a.b;\n\nimport java.util.*;\n\n@SuppressWarnings(\"unchecked\")\npublic final class A<K, V> extends B implements C {\n    private static final int[] X = {1, 2};\n    @Override\n    protected List<K> m(Map<String, Integer> a, int... b) throws E {\n        for (String s : a.keySet()) { y.add(s.trim()); }\n        try { f(); } catch (E | F e) { log(\"{\" + 1); } finally { g(); }\n        return a.isEmpty() ? null : x -> x.y() == 1;\n    }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"lab/y\"\n)\n\ntype T struct {\n\tA int\n}\n\nvar w = []int{1, 2}\n\nfunc (t *T) M(a []Q, b map[string]int) (*T, error) {\n\tif err := f(a); err != nil {\n\t\treturn nil, err\n\t}\n\tfor _, i := range a {\n\t\tc <- i.x\n\t}\n\tswitch b[\"(\"] {\n\tcase 1:\n\t\tg()\n\tdefault:\n\t\th = nil\n\t}\n\tdefer func() { k(`raw {`) }()\n\treturn t, nil\n}\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n    { a\n\nstatic const int T[] = {1, 2};\nstruct s { int a; };\n\nstatic struct s * f(struct s *a, int b)\n{\n    char c = '}';\n    for (size_t i = 0; i < 3; i++) { p[i] = a->b; }\n    switch (b) {\n    case 1:\n        return (int *)x;\n    default:\n        break;\n    }\n    return 0;\n}\n"],
    "rb": ["require 'a'\n\nclass A < B\n  X = %w[a b]\n  def m(a, b = 1)\n    x = a.select { |y| y.z != 1 }\n    a.each do |i|\n      b << i.c\n    end\n    until a > 1\n      a += 1\n    end\n    raise ArgumentError, 'end' if a.size > 3\n    return nil unless a\n    case a\n    when 1 then puts \"do\"\n    end\n    begin\n      f(a)\n    rescue KeyError\n      nil\n    end\n    a\n  end\nend\n"],
}


def broken(text, lang):
    lines = text.split("\n")
    k = len(lines) // 2
    yield "\n".join([*lines[:k], "<<<<<<< HEAD", lines[k], "=======", "x", ">>>>>>> other", *lines[k + 1 :]])
    yield text[: int(len(text.rstrip()) * 0.8)]
    yield "<!doctype html>\n<html>\n<p>The first part of it holds.</p>\n</html>\n"
    yield "Shared guide\n\nOne edge of the window keeps the zone, and reports the rest to it. The spare walker holds every\npart of the list.\n"
    if lang not in ("py", "rb"):
        yield text.replace("}", "", 1) if text.count("}") != text.count("{") - 1 else text + "}"


def test_unparsable(spark):
    rows, want = [], set()
    for lang, texts in GOOD.items():
        for t in texts:
            rows += [(len(rows), "r", f"r/x.{lang}", t), (len(rows) + 1, "r", f"r/x.{lang}", "\ufeff" + t.replace("\n", "\r\n"))]
            if t and t.count("\n") > 3:
                for b in broken(t, lang):
                    want.add(len(rows))
                    rows.append((len(rows), "r", f"r/x.{lang}", b))
    n = len(rows)
    rows += [(n, "r", "r/a.py", None), (n + 1, "r", "r/a.py", ""), (n + 2, "r", "r/a.txt", "]["), (n + 3, "r", "r/deep.js", "(" * 3000 + "1" + ")" * 3000), (n + 4, "r", "r/long.py", "x = 1\n" * 50_000), (None, "r", "r/a.py", "]["), (n + 5, "r", None, "][")]
    rows += [rows[2]]
    df = noisy(spark.createDataFrame(rows, FILES))
    got = {r.file_id for r in unparsable_files(df).collect()}
    assert got - want == set(), [rows[i] for i in got - want][:2]
    assert want - got == set(), [rows[i] for i in want - got][:2]
    rates = parse_rates(df, spark.createDataFrame([(["r/x.rs", "r/x.rs", "none"],), (None,)], "unparsed_files array<string>")).collect()
    assert sum(r.n_unparsable for r in rates) == len(want) and all(0 <= r.rate <= 1 for r in rates)
    assert unparsable_files(spark.createDataFrame([], FILES)).count() == 0


def test_each_other_language_is_broken(spark):
    """A file with another language's text breaks the grammar of its extension."""
    rows, same = [], {("js", "ts")}
    for a, texts in GOOD.items():
        for b in GOOD:
            if a != b and (a, b) not in same:
                rows.append((len(rows), f"{a} in {b}", f"r/x.{b}", texts[-1] if a != "js" else texts[0]))
    got = {r.file_id for r in unparsable_files(spark.createDataFrame(rows, FILES)).collect()}
    assert [r[1] for r in rows if r[0] not in got] == []


def test_snippets(spark):
    """Short texts: what each grammar derives is no case, and every break of it is one."""
    rows = [(k, "r", f"r/x.{lang}", t) for k, (lang, t) in enumerate((lang, t) for lang, ts in VALID.items() for t in ts)]
    broken = [(1000 + k, "r", f"r/x.{lang}", t) for k, (lang, t) in enumerate((lang, t) for lang, ts in BROKEN.items() for t in ts)]
    got = {r.file_id for r in unparsable_files(spark.createDataFrame(rows + broken, FILES)).collect()}
    assert [r for r in rows if r[0] in got] == [] and [r for r in broken if r[0] not in got] == []


def test_automaton_and_shared_stacks_agree():
    """Both recognisers derive the same names from every group of the snippets."""
    for lang, ts in [*VALID.items(), *BROKEN.items()]:
        g = grammar(lang)
        for t in ts:
            g.errors(token_string(t, lang))
        for key in list(g.known):
            contents = key[1:].replace("\n", "") if g.soft and key[0] in "([" else key[1:]
            assert g.derives(key[0], key[1:]) == g.read(key[0], contents), (lang, key)


def test_pairs_are_those_of_the_productions():
    """Every pair of a sound text is derived; the pairs of a small grammar are exactly the expected ones."""
    assert Grammar("file = {'a' p.list} ['b'] ; list = [item {',' item}] ; item = 'c' | empty 'd' empty ; empty = ;").pairs() == {
        "^a", "^b", "^$", "a(", ")a", ")b", ")$", "b$", "(c", "(d", "()", "c,", "d,", ",c", ",d", "c)", "d)"
    }
    for lang, ts in VALID.items():
        allowed = grammar(lang).pairs()
        for t in ts:
            s = token_string(t, lang)
            assert {a + b for a, b in zip("^" + s, s + "$")} <= allowed, t


def test_ambiguous_text_is_read():
    """Nested type arguments, which the automaton would follow in ever more ways, go through the shared stacks."""
    deep = "let x = A::<" + "B<" * 40 + "C" + ">" * 41 + "::new();"
    assert grammar("rs").errors(token_string(f"fn f() {{ {deep} }}", "rs")) == []
    assert grammar("rs").errors(token_string(f"fn f() {{ {deep.replace('C', 'C D')} }}", "rs")) != []


def test_elements(spark):
    """Elements are read on tokens, where the language has them, and hide nothing beside them."""
    error = "\nlet x = a b c;\n"
    element = "const C = () => {\n  return (\n    <div className=\"a\" {...p} on={() => { go(1) }}>\n      It's text, isn't it? {/* none */}\n      {xs.map(x => <Li.X key={x}>{x}</Li.X>)}\n      <br/><></>\n    </div>\n  );\n}\n"
    rows = [("js", 'el.innerHTML = "Name: <b>" + n + "</b>"\n'), ("ts", "// see: <a>x</a>\n"), ("ts", 'f("<p>", `= <b>x</b>`)\n'), ("jsx", element), ("tsx", element), ("js", element), ("tsx", "const f = <T,>(x: T) => x\n")]
    sound = [(k, "r", f"r/x.{ext}", t) for k, (ext, t) in enumerate(rows)]
    broken = [(k + 100, "r", path, t + error) for k, _, path, t in sound] + [(200, "r", "r/y.jsx", element.replace("go(1)", "go(1 2)")), (201, "r", "r/y.ts", element)]
    got = {r.file_id for r in unparsable_files(spark.createDataFrame(sound + broken, FILES)).collect()}
    assert got == {r[0] for r in broken}


# ---- 7 -----------------------------------------------------------------------------------------------------------


def test_gll():
    g = {"Sum": [("Sum", "+", "Sum"), ("n",)]}  # left-recursive and ambiguous
    assert ("Sum", 0, 5) in parse(g, "Sum", "n+n+n") and ("Sum", 0, 4) not in parse(g, "Sum", "n+n+")
    assert ("Ab", 0, 0) in parse({"Ab": [(), ("a", "Ab", "b")]}, "Ab", "") and ("Ab", 0, 4) in parse({"Ab": [(), ("a", "Ab", "b")]}, "Ab", "aabb")


@pytest.mark.parametrize(
    "doc,says",
    [
        ("Never blocks.", True), ("run_all", False), ("Function runAll", False), ("This is the function run_all, which runs all.", False), ("Runs all parts without locking.", True), ("TODO: write me", False), ("FIXME", False), ("n/a", False), ("", False), ("----------", False),
        ("@param x\n@param y\n@return", False), ("@param x the start of it", True), (":param x:\n:returns:", False), ("# Arguments\n* `x`", False), ("{@inheritDoc}", False), ("@see Other", False), ("eslint-disable-next-line complexity", False), ("noqa: D103", False), ("x = run(y, 3)", False),
        ("for item in queue:\n    item.go()", False), ("Nur für Tests gedacht.", True), ("O(n) in the fan-out.", True), ("Runs all.\nTODO: widen this.", False), ("Returns early when empty.\nFIXME: slow.", True), ("go:noinline", False), ("Description goes here", False), ("TODO list item renderer used by the sidebar.", True), ("Wip indicator shown to the reviewer.", True), ("TODO - later", False),
        ("Region borders are kept.", True), ("#region helpers", False), ("Webpack loader of the second kind.", True), ("webpack: off", False), ("pylint: disable=x", False), ("clang-format off", False), ("istanbul ignore next", False),
    ],
)
def test_descriptions(doc, says):
    assert bool(describe(doc, "run_all")[0]) == says


FUNCTIONS = {
    "rust": "/// Never blocks.\n#[inline(always)]\npub fn f(x: &A) -> B {\n    g(x)\n}\n",
    "python": "@traced(a=1)\nasync def f(x, y: int = (1)) -> B:\n    '''Never blocks.'''\n    return g(x)\n",
    "java": "    /**\n     * Never blocks.\n     */\n    @A(\"x\")\n    public <T> List<T> f(List<T> x) throws E {\n        return g(x);\n    }\n",
    "go": "// Never blocks.\nfunc (t *T) f(x []A) (*B, error) {\n\treturn g(x)\n}\n",
    "javascript": "// Never blocks.\nexport async function f(x) {\n    return g(x);\n}\n",
    "typescript": "    /** Never blocks. */\n    private f(x: A[], y: (z: B) => void): C {\n        return g(x);\n    }\n",
    "c": "/* Never blocks. */\nstatic struct a * f(struct b *x, int y)\n{\n    return g(x);\n}\n",
    "ruby": "# Never blocks.\ndef f\n  g\nend\n",
}


def test_documented_functions(spark):
    rows = [(f"{lang}:fn:f:p:T{i}", lang, "function", t) for i, (lang, t) in enumerate(FUNCTIONS.items())]
    for lang, t in FUNCTIONS.items():
        code, doc = parts(t, lang, "f")
        assert doc.strip() == "Never blocks." and "Never" not in code and "g" in code
        assert parts(t[: len(t) * 3 // 4], lang, "f") is not None  # broken texts too
        rows.append((f"{lang}:fn:f:p:U", lang, "method", t.replace("Never blocks.", "TODO")))
    rows += [("python:fn:f:p:V", "python", "function", None), ("python:fn:f:p:W", "python", "function", ""), (None, "python", "function", FUNCTIONS["python"]), ("x:fn:f:p:X", "cobol", "function", "x"), ("rust:class:f:p:Y", "rust", "class", FUNCTIONS["rust"]), rows[0]]
    rows += [(f"rust:fn:n{i}:p:Z{i}", "rust", "function", f"/// The documentation of this one is in work.\nfn n{i}() {{}}\n") for i in range(5)]
    rows += [("rust:fn:m:p:Z", "rust", "function", "/// The docs of a crate are read first.\nfn m() {}\n"), ("rust:fn:long:p:L", "rust", "function", "/// Never blocks.\nfn long() {" + " x();" * 100_000 + "}")]
    got = {r.isgl1_key: r for r in documented_functions(noisy(spark.createDataFrame(rows, ENTITIES))).collect()}
    assert set(got) == {r[0] for r in rows[:8]} | {"rust:fn:m:p:Z", "rust:fn:long:p:L"}
    assert documented_functions(spark.createDataFrame([], ENTITIES)).count() == 0


def test_templates_count_by_share(spark):
    """A few equal true texts stay in a table of any size; a text that a third of the functions carry says nothing of one."""
    assert describe("Returns the description.", "getDescription")[1] != describe("Returns the docs.", "getDocs")[1]
    row = lambda i, doc: (f"rust:fn:n{i}:p:T{i}", "rust", "function", f"/// {doc}\nfn n{i}() {{}}\n")
    letters = lambda i: "".join("abcdefghij"[int(d)] for d in str(i))
    rows = [row(i, f"Sorts the {letters(i)}x edges.") for i in range(4000)]
    rows += [row(10_000 + i, "Reads the docs of a crate first.") for i in range(3)] + [row(10_100 + i, "The documentation comes from elsewhere.") for i in range(20)]
    rows += [row(11_000 + i, "Never blocks.") for i in range(40)] + [row(20_000 + i, "Somebody explains it one day.") for i in range(2000)]
    got = {r.isgl1_key for r in documented_functions(spark.createDataFrame(rows, ENTITIES)).collect()}
    assert got == {r[0] for r in rows[:4003]} | {r[0] for r in rows[4023:4063]}


def test_a_text_of_all_functions_is_no_description(spark):
    """What hundreds of functions carry alike says nothing of one, whatever its words."""
    texts = ["Explain this.", "blah blah", "asdf", "comment", "to be filled", "write something here", "TODO add summary"]
    rows = [(f"rust:fn:n{i}:p:T{i}", "rust", "function", f"/// {texts[i % 7]}\nfn n{i}() {{}}\n") for i in range(3500)]
    rows += [("rust:fn:a:p:T", "rust", "function", "/// TODO list item renderer used by the sidebar.\nfn a() {}\n"), ("rust:fn:b:p:T", "rust", "function", '#[doc = "Never blocks."]\n#[inline]\nfn b() {}\n')]
    got = {r.isgl1_key: r.description for r in documented_functions(spark.createDataFrame(rows, ENTITIES)).collect()}
    assert got == {"rust:fn:a:p:T": "TODO list item renderer used by the sidebar.", "rust:fn:b:p:T": "Never blocks."}


def test_long_heads():
    """Heads of any length: the squeezed shape has the declaration of the whole one, and nothing is dropped."""
    rng = random.Random(7)
    for _ in range(3000):
        shape = "".join(rng.choices("CAtG", [3, 2, 3, 1], k=rng.randrange(8))) + "n" + "".join(rng.choices("tGCA", [4, 3, 0.3, 0.2], k=rng.randrange(6))) + "B"
        short, at = squeezed(shape)
        want, got = declaration(shape), declaration(short)
        assert (want is None) == (got is None) and (want is None or want == tuple(at[k] for k in got)), shape
    lines = [f"Line {i} of the notes." for i in range(2000)]
    for lang, mark, code in (("rust", "///", "fn f(x: A) {}\n"), ("python", "#", "def f(x):\n    pass\n"), ("typescript", "//", "export const f = (x) => x" + ".map(y => y.z(1))" * 1000 + ";\n")):
        assert parts("".join(f"{mark} {x}\n" for x in lines) + code, lang, "f")[1].count("\n") >= 1999


# ---- tokens, 8, 9, 10 --------------------------------------------------------------------------------------------


def words(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(["alpha", "edge", "node", "größe", "漢字", "42"]))
        out.append(rng.choice([" ", " ", " ", ". ", ".\n", "\n\n"]))
    return "".join(out)


def test_token_edges():
    for text in (words(300, 1), "漢字" * 50, "a" * 300, " " * 30_000 + "x", "\n" * 100, "é\r\n\r\nè"):
        pos, chars, kind = edges_of(text, VOCABULARY)
        ids = encode(VOCABULARY, text)
        assert (pos[0], chars[0], pos[-1], chars[-1]) == (0, 0, len(ids), len(text))
        own = encoder(VOCABULARY)[0]
        for i in range(0, len(pos) - 1, max(1, len(pos) // 9)):
            assert own.decode(ids[pos[i] : pos[i + 1]]) == text[chars[i] : chars[i + 1]]


def test_best_fit():
    assert best_fit(np.array([7, 5, 5, 3]), 10).tolist() == [0, 1, 1, 0]
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 60) for _ in range(500)), reverse=True)
    bins = best_fit(np.array(sizes), 100)
    fill = {}
    for b, s in zip(bins.tolist(), sizes):
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= 100 and len(fill) <= -(-sum(sizes) // 100) + 2


def docs(spark):
    rows = [(i, words(20 + 37 * (i % 11), i), ["A", " a ", "b-c", "B_C", "d", None][i % 6]) for i in range(120)]
    rows += [(500, words(4000, 5), "a"), (501, "漢" * 9000, "a"), (502, None, "a"), (503, "", "a"), (None, "x", "a"), (504, "q" * 20_000, "d"), rows[0], rows[0]]
    return rows


def test_containers(spark):
    rows = docs(spark)
    df = noisy(spark.createDataFrame(rows, DOCS).repartition(5))
    cap = 512
    got = fill_containers(df, cap, nearly_full=0.99).collect()
    fill, text = {}, {}
    by_id = {(d, t): len(encode(VOCABULARY, t)) for d, t, _ in rows if t}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        text.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= cap and all(r.filled == fill[r.container_id] for r in got)
    assert len({(r.container_id, r.place) for r in got}) == len(got)
    for d, t, _ in rows:
        if d is None or not t:
            assert d not in text or d is None
            continue
        pieces = sorted({(r.piece_no, r.start_char, r.end_char) for r in text[d]})
        assert pieces[0][1] == 0 and pieces[-1][2] == len(t) and all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
        assert (len(pieces) == 1) == (by_id[d, t] <= cap)
    assert len(text[0]) == 3  # repeated rows each get a place
    total = sum(fill.values())
    assert len(fill) <= total / cap * 1.05 + 2
    assert fill_containers(spark.createDataFrame([], DOCS)).count() == 0


def test_mix(spark):
    df = noisy(spark.createDataFrame(docs(spark), DOCS))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b_c", 0.3, 3), ("d", 0.1, 1), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    rows = mix_sources(df, noisy(targets)).collect()
    caps = {"a": 2, "b_c": 3, "d": 1}
    assert rows and all(1 <= r.repeats <= caps[r.source] for r in rows)
    total = sum(r.repeats * r.n_tokens for r in rows)
    for s, share in (("a", 0.5), ("b_c", 0.3), ("d", 0.1)):
        got = sum(r.repeats * r.n_tokens for r in rows if r.source == s) / total
        assert abs(got - share / 0.9) < 0.03 and all(abs(r.reached_share - got) < 1e-9 for r in rows if r.source == s)
    report = {r.source: r for r in mix_report(df, targets).collect()}
    assert report["none"].reached_share == 0 and len(report) == 4
    small = mix_sources(df, targets, total_tokens=2000).collect()
    for s, share in (("a", 0.5), ("b_c", 0.3), ("d", 0.1)):  # no source misses its goal by more than one of its texts below the first class
        mine = [r.n_tokens for r in rows if r.source == s and r.n_tokens < 1024]
        assert abs(sum(r.repeats * r.n_tokens for r in small if r.source == s) - 2000 * share / 0.9) <= max(mine)
    huge = mix_sources(df, targets, total_tokens=10**9).collect()
    assert all(r.repeats == caps[r.source] for r in huge)
    assert mix_sources(spark.createDataFrame([], DOCS), targets).count() == 0 and mix_sources(df, targets.limit(0)).count() == 0


def greedy(text, capacity, overlap):
    """The cuts one after the other, by the rule of the operator."""
    from edgewright.llm.splitting import _boundaries

    b = _boundaries(text, VOCABULARY, capacity, overlap)
    if b is None:
        return None
    n, reach, at, cuts = int(b[-1][0]), capacity - overlap - 3, overlap, []
    rows = [(int(p), int(k)) for p, k, *_ in b]
    while at < n:
        far = lambda kind, least: max((p for p, k in rows if k >= kind and at + least <= p <= at + reach), default=None)
        at = next(x for x in (far(4, 3 * reach // 4), far(2, reach // 2), far(0, 1)) if x is not None)
        cuts.append(at)
    return cuts


@pytest.mark.parametrize("capacity,overlap", [(128, 16), (256, 0)])
def test_pieces(spark, capacity, overlap):
    rows = docs(spark)
    got = {}
    for r in split_texts(noisy(spark.createDataFrame(rows, DOCS)), capacity, overlap).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t, _ in rows:
        want = greedy(t, capacity, overlap) if d is not None and t else None
        if want is None:
            assert d not in got or d is None
            continue
        ps = sorted(got[d], key=lambda r: r.piece_no)
        assert [p.end_token for p in ps] == want and all(p.n_pieces == len(ps) for p in ps)
        assert ps[0].start_char == 0 and ps[-1].end_char == len(t)
        for p in ps:
            assert p.n_tokens <= capacity and t[p.start_char : p.end_char] == p.text
        for a, b in zip(ps, ps[1:]):
            assert overlap <= a.end_token - b.start_token <= overlap + 3
    assert piece_bounds(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        piece_bounds(spark.createDataFrame([], DOCS), 100, 60)
