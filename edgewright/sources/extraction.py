"""Entities and dependencies from source texts, by one pass over each file's tokens."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.functions.scalars import content_hash, is_test_file, key_v2, sanitize_colons, sanitize_path, semantic_path
from edgewright.session import cut
from edgewright.sources.lexing import LANGUAGE, LEXERS

#: Words that open a definition, with the kind of entity, per language.
DEFINES = {
    "rs": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module", "macro_rules!": "macro"},
    "py": {"def": "function", "class": "class"},
    "js": {"function": "function", "class": "class"},
    "ts": {"function": "function", "class": "class", "interface": "interface", "enum": "enum"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "class"},
    "go": {"func": "function", "struct": "struct", "interface": "interface"},
    "c": {"struct": "struct", "enum": "enum", "union": "struct"},
    "rb": {"def": "function", "class": "class", "module": "module"},
    "cpp": {"struct": "struct", "enum": "enum", "union": "struct", "class": "class", "namespace": "module"},
    "cs": {"class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "record": "class", "namespace": "module"},
    "php": {"function": "function", "class": "class", "interface": "interface", "trait": "trait", "enum": "enum"},
    "swift": {"func": "function", "class": "class", "struct": "struct", "enum": "enum", "protocol": "interface", "extension": "impl"},
}
EXTENSIONS = LANGUAGE | dict.fromkeys(("cpp", "cc", "cxx", "hpp"), "cpp") | {"cs": "cs", "php": "php", "swift": "swift", "mjs": "js"}
NAMES = {"cpp": "cpp", "cs": "csharp", "php": "php", "swift": "swift", "rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "c": "c", "rb": "ruby"}
#: Lines that import something; the first group that matched is the module.
IMPORTS = {
    "rs": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)", re.M), "py": re.compile(r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))", re.M),
    "js": re.compile(r"""^\s*import\b[^'"\n]*['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]""", re.M), "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)", re.M),
    "go": re.compile(r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$""", re.M), "c": re.compile(r"""^[ \t]*#[ \t]*include[ \t]*[<"]([^>"]+)[>"]""", re.M), "rb": re.compile(r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", re.M),
}
IMPORTS["ts"], IMPORTS["cpp"] = IMPORTS["js"], IMPORTS["c"]
IMPORTS["cs"] = re.compile(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", re.M)
IMPORTS["php"] = re.compile(r"""^\s*use\s+([\w\\]+)|\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)""", re.M)
IMPORTS["swift"] = re.compile(r"^\s*import\s+(?:\w+\s+)?([\w.]+)", re.M)
_TRAIT = re.compile(r"\bimpl(?:<[^>{]*>)?\s+([\w:]+)(?:<[^{]*?>)?\s+for\s+(\w+)")
_NOT_CALLED = frozenset("if for while switch catch return match with function elif except and or not in is lambda await typeof sizeof super this fn func def defer go case new throw print async".split())


def _kind(kind: str, stack: list) -> str:
    return "method" if kind == "function" and any(k in ("class", "impl", "trait", "interface", "struct") for k, *_ in stack) else kind


def extract(text: str, lang: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[str, str, int]]]:
    """([(kind, name, first line, last line)], [(edge type, target, line)]) of a text; broken texts give what can be found."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    pattern, classes = LEXERS[lang]
    words, line, at = DEFINES[lang], 1, 0
    toks = []
    for m in pattern.finditer(text):
        t = m.group()
        line += text.count("\n", at, m.start())
        at = m.start()
        if t[0] == "\n" or t[:2] in ("//", "/*") or (t[0] == "#" and lang in ("py", "rb")) or (lang in ("c", "cpp", "cs", "php") and t.lstrip()[:1] == "#"):
            if t[0] == "\n" and lang in ("py", "rb"):
                toks.append(("\n", "\n", line + 1, len(t) - 1))
            continue
        toks.append((t, classes[t], line, 0))
    last = text.count("\n") + (not text.endswith("\n"))
    if lang == "py":
        ents, calls = _by_indent(toks, words, last)
    elif lang == "rb":
        ents, calls = _by_end(toks, words, last)
    else:
        ents, calls = _by_braces(toks, words, lang, last)
    deps = [("Calls", name, at) for name, at in calls]
    if lang == "rs":
        for m in _USE.finditer(text):
            at = text.count("\n", 0, m.start()) + 1
            deps += [("Uses", target, at) for target in _use_targets(m[1])]
    else:
        for m in IMPORTS[lang].finditer(text):
            target = next((g for g in m.groups() if g), None)
            if target:
                deps.append(("Uses", target, text.count("\n", 0, m.start()) + 1))
    deps += [("Uses", name, at) for name, at in _uses(toks, lang)]
    if lang == "rs":
        deps += [("Implements", m[1].split("::")[-1], text.count("\n", 0, m.start()) + 1) for m in _TRAIT.finditer(text)]
    return list(dict.fromkeys(ents)), deps


def _generics(toks: list, j: int) -> str:
    """The type parameters written directly after a type's name, as in the source."""
    if j >= len(toks) or toks[j][0] != "<":
        return ""
    depth, out = 0, []
    for t, *_ in toks[j:]:
        if t in (";", "{"):
            break
        depth += (t == "<") - t.count(">") * (t.strip(">") == "")
        out.append(", " if t == "," else t)
        if depth <= 0:
            return "".join(out)
    return ""


_USE = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", re.M)
#: Crates whose paths are no dependencies outside, and words that stand for own paths.
INSIDE = frozenset("crate self super std core alloc proc_macro test".split())


def _use_targets(path: str) -> list[str]:
    """The keys' middles of one use declaration: `Item:external-dependency-crate`, `a__b__C` and the last name; of a list each member's name."""
    path = re.sub(r"\s+", " ", path).strip().removeprefix("::")
    if "{" in path:
        members = re.findall(r"[\w:]+(?=\s*(?:,|\}|\bas\b))", path[path.index("{") :])
        return [m.split("::")[-1] for m in members if "::" in m]
    alias = re.match(r"([\w:]+) as ", path)
    if alias:
        return [alias[1].split("::")[-1]]
    if path.endswith("::*"):
        return [path[:-3].replace("::", "__")]
    parts = path.split("::")
    if len(parts) < 2:
        return [path]
    whole = f"{parts[-1]}:external-dependency-{parts[0]}" if parts[0] not in INSIDE else "__".join(parts)
    return [whole, parts[-1]]


def _uses(toks: list, lang: str) -> list[tuple[str, int]]:
    """(name, line) of fields and properties, simple types of parameters, results and fields, arguments of generic types, decorators."""
    out = []
    named = lambda k: k < len(toks) and toks[k][0].isidentifier() and toks[k][1] not in "cF"
    typed = lambda k: named(k) and toks[k][0][:1].isupper()
    text = lambda k: toks[k][0] if 0 <= k < len(toks) else ""
    imports = False
    for i, (t, c, line, _) in enumerate(toks):
        if lang in ("py", "java"):
            if t in ("import", "from", "package") and (i == 0 or text(i - 1) in ("\n", ";")):
                imports = True
            imports = imports and t not in ("\n", ";")
            if imports:
                continue
        if (t == "." and lang in ("rs", "js", "ts", "py", "java", "c", "rb")) or (t == "->" and lang == "c"):
            if named(i + 1) and text(i + 1) != "await" and not (lang == "java" and text(i + 2) == "("):
                out.append((text(i + 1), toks[i + 1][2]))
        elif lang == "rs" and (t == ":" and typed(i + 1) and text(i + 2) in (",", ")", "}") or t == "->" and typed(i + 1) and text(i + 2) in ("{", "where", ";")):
            out.append((text(i + 1), toks[i + 1][2]))
        elif lang == "rs" and t in ("<", ",") and typed(i + 1) and text(i + 2) in (",", ">", "<", ">>") and (typed(i - 1) or t == ","):
            if t == "<" or any(text(k) == "<" and typed(k - 1) for k in range(max(0, i - 6), i)):
                out.append((text(i + 1), toks[i + 1][2]))
        elif lang in ("ts", "java") and t == "<" and typed(i - 1) and text(i - 2) not in ("class", "interface", "type", "function"):
            out.append((text(i - 1), line))
        elif lang == "py" and t == "@" and (i == 0 or text(i - 1) == "\n"):
            k = i + 1
            while text(k + 1) == ".":
                k += 2
            if named(k):
                out.append((text(k), line))
        elif lang == "py" and t in (":", "->") and named(i + 1) and (t == "->" or named(i - 1)) and text(i + 2) in (",", ")", "=", ":", "["):
            out.append((text(i + 1), toks[i + 1][2]))
    return out


def _bodies(toks: list) -> tuple[dict[int, tuple], list[tuple]]:
    """Functions given to const, let or var by name: ({place of the body's brace: (kind, name, line)}, those whose body is an expression)."""
    at, whole = {}, []
    for i, (t, _, line, _) in enumerate(toks):
        if t not in ("const", "let", "var") or i + 2 >= len(toks) or not toks[i + 1][0].isidentifier():
            continue
        name, k, depth = toks[i + 1][0], i + 2, 0
        while k < len(toks) and toks[k][0] != "=" and toks[k][0] != ";" and k < i + 200:  # a type may stand between
            k += 1
        if k >= len(toks) or toks[k][0] != "=":
            continue
        k += 1
        text = lambda k: toks[k][0] if k < len(toks) else ""
        k += text(k) == "async"
        plain = text(k) == "function"
        if plain or text(k) == "<":
            while k < len(toks) and text(k) not in ("(", "{", ";"):
                k += 1
        if text(k) == "(":
            while k < len(toks):  # over the parameters
                depth += (text(k) == "(") - (text(k) == ")")
                if not depth:
                    break
                k += 1
            k += 1
            if text(k) == ":":  # a type of the result
                while k < len(toks) and text(k) not in (";", "=") and not (text(k) == ("{" if plain else "=>")):
                    k += 1
        elif text(k + 1) == "=>":
            k += 1
        else:
            continue
        arrow = text(k) == "=>"
        if not arrow and not (plain and text(k) == "{"):
            continue
        k -= plain
        k += 1
        if k < len(toks) and toks[k][0] == "{":
            at[k] = ("function", name, line)
        elif arrow and k < len(toks):
            depth, last = 0, toks[k][2]
            while k < len(toks):
                x, _, row, _ = toks[k]
                depth += (x in ("(", "[", "{")) - (x in (")", "]", "}"))
                if depth < 0 or depth == 0 and (x in (";", ",") or row > last and x not in (".", "?", ":", "?.", "+", "&&", "||", "??")):
                    break
                last, k = row, k + 1
            whole.append(("function", name, line, last))
    return at, whole


def _called(toks: list, i: int) -> bool:
    t, c = toks[i][0], toks[i][1]
    return c in "iw" and i + 1 < len(toks) and toks[i + 1][0] == "(" and t not in _NOT_CALLED and t.rstrip("!").isidentifier()


def _by_braces(toks: list, words: dict, lang: str, last: int) -> tuple[list, list]:
    ents, calls, stack, depth, pending, paren = [], [], [], 0, None, 0
    bodies, whole = _bodies(toks) if lang in ("js", "ts") else ({}, [])
    ents += whole
    for i, (t, c, line, _) in enumerate(toks):
        if t == "(":
            paren += 1
        elif t == ")":
            paren = max(0, paren - 1)
        elif t == "{":
            depth += 1
            if i in bodies:
                stack.append((*bodies[i], depth))
            elif pending:
                stack.append((*pending, depth))
                pending = None
        elif t == "}":
            while stack and stack[-1][3] >= depth:
                kind, name, first, _d = stack.pop()
                ents.append((kind, name, first, line))
            depth = max(0, depth - 1)
        elif t == ";" and pending and paren == 0:
            if pending[0] in ("struct", "module") and lang == "rs":
                ents.append((*pending, line))
            pending = None
        elif t in words and (i == 0 or toks[i - 1][0] != "."):
            kind, j = words[t], i + 1
            if lang == "go" and t == "func":
                if j < len(toks) and toks[j][0] == "(":  # a receiver
                    while j < len(toks) and toks[j][0] != ")":
                        j += 1
                    j, kind = j + 1, "method"
            elif lang == "go":
                j = i - 1
            elif lang == "rs" and t == "impl":
                k, angle = j, 0
                while k < len(toks) and toks[k][0] not in ("{", ";"):
                    angle += (toks[k][0] == "<") - (toks[k][0] == ">")
                    if toks[k][0] == "for":
                        j = k + 1
                    elif angle == 0 and toks[k][0] == ">" and k < i + 8 and toks[i + 1][0] == "<" and j == i + 1:
                        j = k + 1
                    k += 1
            elif t == "function" and j < len(toks) and toks[j][0] == "*":
                j += 1
            if 0 <= j < len(toks) and toks[j][0].isidentifier() and paren == 0:
                if lang != "c" or kind != "function":
                    ahead = toks[j + 1][0] if j + 1 < len(toks) else ""
                    if lang not in ("c", "cpp") or ahead in ("{", ":"):
                        pending = (_kind(kind, stack), toks[j][0] + (_generics(toks, j + 1) if kind != "function" and kind != "method" else ""), line)
        elif _called(toks, i):
            prev = toks[i - 1][0] if i else ""
            if prev in words and (lang != "go" or prev == "func") or (lang == "go" and pending and pending[1] == t):
                continue
            body = stack[-1] if stack else None
            member = body is not None and body[0] in ("class", "struct", "interface", "enum") and depth == body[3] and lang in ("js", "ts", "java", "cpp", "cs")
            top = lang == "c" and depth == 0 or lang == "cpp" and (depth == 0 or body is not None and body[0] == "module" and depth == body[3])
            if (member or top) and paren == 0 and pending is None and prev not in (".", "=", "new", "return", "@"):
                pending = ("method" if member or prev == "::" else "function", t, line)
            elif depth or lang in ("js", "ts"):
                calls.append((t.rstrip("!"), line))
    ents += [(k, n, f, last) for k, n, f, _d in stack]
    return ents, calls


def _by_indent(toks: list, words: dict, last: int) -> tuple[list, list]:
    ents, calls, stack, indent, end, depth = [], [], [], 0, 0, 0
    for i, (t, c, line, width) in enumerate(toks):
        if t == "\n":
            if depth == 0:
                indent = width
            continue
        depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
        if toks[i - 1][0] == "\n" and depth <= 1 or i == 0:
            while stack and indent <= stack[-1][3] and depth == (t in ("(", "[", "{")):
                k, n, f, _w = stack.pop()
                ents.append((k, n, f, max(f, end)))
        end = line + t.count("\n")
        if t in words and i + 1 < len(toks) and toks[i + 1][0].isidentifier():
            stack.append((_kind(words[t], stack[-1:]), toks[i + 1][0], line, indent))
        elif _called(toks, i) and (i == 0 or toks[i - 1][0] not in words):
            calls.append((t, line))
    ents += [(k, n, f, max(f, end)) for k, n, f, _w in stack]
    return ents, calls


def _by_end(toks: list, words: dict, last: int) -> tuple[list, list]:
    ents, calls, stack, loop = [], [], [], False
    for i, (t, c, line, _) in enumerate(toks):
        prev = toks[i - 1][0] if i else "\n"
        if t == "\n":
            loop = False
        elif t in words and prev != "." and i + 1 < len(toks):
            j = i + 1
            if t == "def" and j + 2 < len(toks) and toks[j + 1][0] == ".":
                j += 2
            stack.append((_kind(words[t], stack), toks[j][0], line))
        elif t in ("begin", "case") or (t in ("if", "unless", "while", "until", "for") and prev in ("\n", "=", "(")) or (t == "do" and not loop):
            stack.append(("", t, line))
            loop = t in ("while", "until", "for")
        elif t == "end" and stack:
            k, n, f = stack.pop()
            if k:
                ents.append((k, n, f, line))
        elif _called(toks, i) and prev not in words:
            calls.append((t, line))
    ents += [(k, n, f, last) for k, n, f in stack if k]
    return ents, calls


def extracted(files: DataFrame, parser: Callable[[str, str], tuple[list, list]] = extract) -> DataFrame:
    """(file_path, lang, kind, name, line_start, line_end, edge_type): entities (edge_type null) and targets of
    dependencies (kind null) of each text; null texts and unknown extensions give none. parser: another
    function of text and language that returns what `extract` does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file_path", "lang", "kind", "name", "line_start", "line_end", "edge_type"]
        for batch in batches:
            out = []
            for path, ext, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lang = EXTENSIONS[ext]
                ents, deps = parser(text, lang)
                out += [(path, NAMES[lang], k, n, a, b, None) for k, n, a, b in ents]
                out += [(path, NAMES[lang], None, n, a, a, e) for e, n, a in deps]
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    rows = files.filter("current_code is not null and file_path is not null").select("file_path", ext.alias("ext"), "current_code").filter(F.col("ext").isin(list(EXTENSIONS)))
    return rows.mapInArrow(run, "file_path string, lang string, kind string, name string, line_start int, line_end int, edge_type string")


def extracted_entities(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(file_path, language, entity_type, name, line_start, line_end) of all files, distinct."""
    rows = extracted(files) if rows is None else rows
    return rows.filter("kind is not null").select("file_path", F.col("lang").alias("language"), F.col("kind").alias("entity_type"), "name", "line_start", "line_end").distinct()


def extracted_edges(files: DataFrame, rows: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(from_key, to_key, edge_type, source_location): calls and implementations from the smallest entity around them to
    an unresolved name, imports, fields, types and decorators from the file to a module (one outside by its crate); one
    row per key, the first place.

    Entities are named by their lines unless their keys are given (isgl1_key, file_path, line_start, line_end, entity_type).
    """
    from edgewright.operators.matching import containing_entity

    rows = cut(extracted(files)) if rows is None else rows
    ents = entities
    if ents is None:
        ents = extracted_entities(files, rows).withColumn("isgl1_key", F.concat_ws(":", "language", _token(), "name", semantic_path("file_path"), F.concat_ws("-", "line_start", "line_end")))
    place = F.concat_ws(":", "file_path", "line_start")
    deps = rows.filter("edge_type is not null").withColumn("site_id", F.concat_ws("|", "file_path", "line_start"))
    uses = deps.filter("edge_type = 'Uses'").select(
        F.concat_ws(":", "lang", F.lit("file"), sanitize_path("file_path"), F.lit("1-1")).alias("from_key"), F.concat_ws(":", "lang", F.lit("module"), sanitize_colons("name"), F.lit("0-0")).alias("to_key"), "edge_type", place.alias("source_location")
    )
    sites = deps.filter("edge_type <> 'Uses'").select("site_id", "file_path", F.col("line_start").alias("line")).distinct()
    owner = containing_entity(sites, ents).filter("isgl1_key is not null").withColumnRenamed("isgl1_key", "from_key")
    calls = deps.filter("edge_type <> 'Uses'").join(owner, "site_id").select("from_key", F.concat_ws(":", "lang", F.lit("fn"), sanitize_colons("name"), F.lit("unresolved-reference"), F.lit("0-0")).alias("to_key"), "edge_type", place.alias("source_location"))
    return calls.unionByName(uses).groupBy("from_key", "to_key", "edge_type").agg(F.min("source_location").alias("source_location"))


def _token():
    from edgewright.functions.scalars import type_token

    return type_token("entity_type")


#: A test mark stands at most so many lines before its function: other attributes and blank lines may lie between.
MARK_LINES = 20


def as_entities(files: DataFrame, rows: DataFrame | None = None, is_test: Callable = is_test_file) -> DataFrame:
    """Extracted entities in the columns of the relation, keys of the current format; tests by path and text, or by another
    detector, a function of the columns of path, text and language."""
    from edgewright.functions.scalars import birth_timestamp, code_lines, subfolder_l1, subfolder_l2
    from edgewright.operators.matching import next_function

    ents = extracted_entities(files, rows)
    texts = files.filter("current_code is not null").select("file_path", F.col("current_code").alias("text")).dropDuplicates(["file_path"])
    e = ents.join(texts, "file_path").withColumn("birth_timestamp", birth_timestamp("file_path", "name"))
    # a function behind a test mark is a test, whatever its file
    marked = next_function(texts.filter(F.col("file_path").endswith(".rs")).select(F.col("file_path").alias("file_id"), F.col("text").alias("current_code")))
    marked = marked.select(F.col("file_id").alias("file_path"), "name", F.col("line").alias("_mark")).distinct()
    near = F.col("line_start") - F.col("_mark")
    hit = e.select("file_path", "name", "line_start").join(marked, ["file_path", "name"]).filter(near.between(1, MARK_LINES)).select("file_path", "name", "line_start").distinct().withColumn("_marked", F.lit(True))
    e = e.join(hit, ["file_path", "name", "line_start"], "left")
    code = code_lines("text", F.col("line_start"), F.col("line_end"))
    signature = F.to_json(F.struct("entity_type", "name", F.lit("Public").alias("visibility"), "file_path", F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("line_range")))
    return e.select(
        key_v2("language", "entity_type", "name", "file_path", "birth_timestamp").alias("isgl1_key"), code.alias("current_code"), signature.alias("interface_signature"), F.lit(True).alias("current_ind"), F.lit(True).alias("future_ind"),
        "file_path", "language", "entity_type", F.when(F.coalesce("_marked", F.lit(False)) | is_test("file_path", "text", "language"), "TEST").otherwise("CODE").alias("entity_class"), "birth_timestamp", content_hash(code).alias("content_hash"),
        semantic_path("file_path").alias("semantic_path"), subfolder_l1("file_path").alias("root_subfolder_l1"), subfolder_l2("file_path").alias("root_subfolder_l2"), "name", "line_start", "line_end",
    )


