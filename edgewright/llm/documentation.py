"""Problem 7: functions paired with their documentation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.columns import pick
from edgewright.llm.gll import parse
from edgewright.session import cut
from edgewright.sources.lexing import LEXERS

_LANG = {"rust": "rs", "python": "py", "javascript": "js", "typescript": "ts", "java": "java", "go": "go", "c": "c", "cpp": "c", "ruby": "rb"}

#: What stands before a function's body, in classes: C comment, A attribute, annotation or decorator, n the function's
#: name, G a group in parentheses, t any other token of a declaration, B where the body begins. Whatever fits nothing is
#: skipped (?), so the declaration is found in broken text too; a comment belongs to it only if Lead reaches it.
GRAMMAR = {
    "Unit": [("Skip", "Lead", "Decl", "Skip")],
    "Skip": [(), ("Skip", "?")],
    "Lead": [(), ("Lead", "C"), ("Lead", "A")],
    "Decl": [("Before", "n", "Between", "G", "After", "B")],
    "Before": [(), ("Before", "t"), ("Before", "G"), ("Before", "A")],
    "Between": [(), ("Between", "t")],
    "After": [(), ("After", "t"), ("After", "G"), ("After", "n")],
}


@lru_cache(maxsize=50_000)
def declaration(shape: str) -> tuple[int, int, int] | None:
    """(first lead token, first token of the declaration, token of the body) of the earliest declaration with the longest lead."""
    derived = parse(GRAMMAR, "Unit", shape)
    decls = sorted((b, e) for name, b, e in derived if name == "Decl")
    if not decls:
        return None
    # the earliest name, and of its declarations the longest that begins outside comments
    body = min(e for _, e in decls)
    begin = min(b for b, e in decls if e == body)
    while shape[begin] == "A":
        begin += 1
    lead = min(b for name, b, e in derived if name == "Lead" and e == begin) if any(name == "Lead" and e == begin for name, _, e in derived) else begin
    return lead, begin, body - 1


def squeezed(shape: str) -> tuple[str, list[int]]:
    """(a shape of at most eight classes with the same declaration, first token of each of its classes).

    Runs that the grammar treats alike become one class: what is skipped before the last lead, a lead with a comment in
    it, what stands between it and the name, and what follows the parameters. Texts of any length stay short to parse.
    """
    name = shape.find("n")
    if name < 0:
        return "", []
    last = shape.rfind("C", 0, name)
    lead = last
    while lead > 0 and shape[lead - 1] in "CA":
        lead -= 1
    out, at = [], []

    def put(c: str, i: int) -> None:
        out.append(c)
        at.append(i)

    begin = 0
    if last >= 0:
        if lead > 0:
            put("t", 0)
        put("C", lead)
        begin = last + 1
    i = begin
    while i < name and shape[i] == "A":
        i += 1
    if i > begin:
        put("A", begin)
    if i < name:
        put("t", i)
    put("n", name)
    i = name + 1
    while i < len(shape) and shape[i] == "t":
        i += 1
    if i > name + 1:
        put("t", name + 1)
    if i < len(shape) - 1:
        put(shape[i], i)
        rest = shape[i + 1 : -1]
        if rest:
            put(next((c for c in rest if c in "CA"), "t"), i + 1)
    put(shape[-1], len(shape) - 1)
    return "".join(out), at


def head(text: str, lang: str, name: str) -> tuple[str, list[tuple[int, int]]]:
    """(shape, spans) of the tokens up to the function's body, groups as one token each."""
    pattern, classes = LEXERS[lang]
    shape, spans, depth, open_at, prev = [], [], 0, 0, ""
    named = grouped = False
    for m in pattern.finditer(text):
        t = m.group()
        c = classes[t]
        if c == "\n" or t[0] == "\n" or t == "\\\n":
            if depth == 0 and lang == "rb" and named:
                shape.append("B")
                spans.append(m.span())
                break
            continue
        if c == " ":
            if depth == 0:
                shape.append("C")
                spans.append(m.span())
            continue
        if t in ("(", "["):
            if depth == 0:
                open_at = m.start()
            depth += 1
            continue
        if t in (")", "]"):
            depth = max(0, depth - 1)
            if depth == 0:
                if shape and shape[-1] == "A" and (prev in "@#" or text[spans[-1][1] : open_at].strip() == ""):
                    spans[-1] = (spans[-1][0], m.end())
                    if lang == "rs" and _DOC.match(text, spans[-1][0], m.end()):
                        shape[-1] = "C"
                else:
                    shape.append("G" if t == ")" else "t")
                    spans.append((open_at, m.end()))
                    grouped = grouped or (named and t == ")")
                prev = ")"
            continue
        if depth:
            continue
        if c in "@#" or (lang == "py" and t == "@") or (c == "i" and shape and shape[-1] == "A" and prev == "@" and lang == "py") or (prev == "." and shape and shape[-1] == "A"):
            if prev in ("@", "#", ".") and shape and shape[-1] == "A":
                spans[-1] = (spans[-1][0], m.end())
            else:
                shape.append("A")
                spans.append(m.span())
        elif t == "." and shape and shape[-1] == "A":
            spans[-1] = (spans[-1][0], m.end())
            prev = "."
            continue
        elif t == "!" and shape and shape[-1] == "A" and lang == "rs":
            continue
        elif named and grouped and (t == "{" or (t == ":" and lang == "py") or (t == ";" and lang in ("c", "java", "ts", "rs"))):
            shape.append("B")
            spans.append(m.span())
            break
        elif t == name and not named:
            shape.append("n")
            spans.append(m.span())
            named = True
        else:
            shape.append("t")
            spans.append(m.span())
        prev = "@" if t == "@" else c if c in "@#" else c if c != "@" else ""
    end = (len(text), len(text))
    if named and shape[-1] != "B":  # cut off before the body
        shape.append("B")
        spans.append(end)
    if named and not grouped:  # no parameters, or cut off in them
        shape.insert(-1, "G")
        spans.insert(-1, spans[-1])
    return "".join(shape), spans


#: Rust's documentation as an attribute.
_DOC = re.compile(r'#!?\[\s*doc\s*=\s*(?:"((?:[^"\\]|\\(?s:.))*)"|r#*"((?s:.*?))"#*)\s*\]')
_STRING = re.compile(r'(?s)\s*(?:#[^\n]*\n\s*)*([rRuU]?)("""(.*?)"""|\'\'\'(.*?)\'\'\'|"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\')[ \t]*(?:;|\n|#|$)')


def parts(text: str, language: str, name: str) -> tuple[str, str] | None:
    """(code without documentation, raw documentation) of one function's text; None if no declaration is found."""
    lang = _LANG.get(language)
    if lang is None:
        return None
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    shape, spans = head(text, lang, name)
    short, at = squeezed(shape)
    found = declaration(short) if short else None
    if found is None:
        return None
    first, begin, body = (at[k] for k in found)
    comments = [k for k in range(first, begin) if shape[k] == "C"]
    docs, code, last = [], [], 0
    for k in comments:
        a, b = spans[k]
        docs.append(_strip_comment(text[a:b]))
        code.append(text[last:a])
        last = b
    rest = text[last:]
    if lang == "py":
        m = _STRING.match(text, spans[body][1])
        if m:
            docs.append("\n".join(s.strip() for s in next(g for g in m.groups()[2:] if g is not None).split("\n")))
            a, b = m.span(2)
            a -= len(m[1])
            tail = text[b:]
            rest = text[last:a] + (tail.lstrip(" \t;").removeprefix("\n").lstrip(" \t") if tail.strip() else "pass\n")
    code.append(rest)
    return "\n".join(row for row in "".join(code).split("\n") if row.strip()), "\n".join(docs)


def _strip_comment(c: str) -> str:
    doc = _DOC.match(c)
    if doc:
        return (doc[1] or doc[2] or "").replace("\\n", "\n").replace('\\"', '"')
    if c.startswith("/*"):
        return "\n".join(re.sub(r"^\s*\*+(?!/)\s?|^\s+", "", row).rstrip() for row in c[2:].removesuffix("*/").lstrip("*!").split("\n"))
    if c.startswith("=begin"):
        return "\n".join(c.split("\n")[1:-1])
    return re.sub(r"^(?://[/!]?|#+!?)", "", c).strip("\n")


#: Words that a description may use without saying anything of the function.
_EMPTY = frozenset("a an the of to for is are this that these which it its and or in on by with as at from be here function functions method methods routine procedure helper fn def func sub name named called funktion methode die der das ist función método el la".split()) - {"called"}
#: Phrases that stand in for a text to come, found elsewhere included; compared without case and end marks.
_STAND_IN = frozenset(
    "todo|fixme|xxx|hack|tbd|n/a|na|none|(none)|stub|wip|???|...|placeholder|undocumented|no description|no documentation|no docs|missing docs|missing documentation|add description here|add docs|describe me|documentation pending|"
    "documentation missing|description pending|docs pending|write me|fill me in|to be documented|to be written|to do|to come|auto-created stub|auto-generated stub|not documented|not yet documented|"
    "description goes here|documentation goes here|lorem ipsum|coming soon|see above|see below|same as above|ditto".split("|")
)
_OPEN = re.compile(r"(?i)^\W*(todo|fixme|xxx|hack|tbd|wip)\b(?:\W*$|\s*[:(\[]|\s+[-–—])")
#: Words that hint at a stand-in; such a description is kept only if it is not repeated across the corpus.
_HINT = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|wip)\b|\b(documentation|docs?|docstring|description|describe|undocumented|placeholder|stub|beschreibung|dokumentation|descripción|documentación|pendiente)\b")
_ELSEWHERE = re.compile(r"(?i)^\W*(@?see\b|inherit-?doc\b|copydoc\b|:nodoc:|see also\b)|\{@inheritdoc\}|^\W*@inheritdoc")
#: What steers a tool: marks that are nothing else, and names of tools where a directive follows; marks of folds.
_TOOL = re.compile(
    r"(?i)^\W*(?:@?ts-(?:ignore|expect|nocheck)|nolint|go:|lint:|noqa|type: ?ignore|fmt:|noinspection|checkstyle:|@?formatter:|nosonar|nosec|safety-lint|vim:|-\*-|@flow|@jsx|export \w+$|cgo |\+build"
    r"|(?:eslint|tslint|jshint|jslint|prettier|istanbul|[cv]8|pylint|flake8|mypy|pyright|yapf|isort|pragma|rubocop|clippy|rustfmt|cppcheck|clang|coverage|cspell|spell-?checker|biome|deno-lint|webpack|sourcery|bandit|doxygen|swiftlint|ktlint|phpcs|psalm|phpstan|sonar|codeql|shellcheck|pydocstyle|black|ruff)"
    r"(?:\W*$|[-:=/]\S|:|\s*\(|\s+(?:disable|enable|ignore|off|on|skip|next|suppress|expect|allow|deny)\b))"
    r"|^[\w.@/-]+:\s*(?:off|on|skip|disable|ignore|enable)\b|^[\w@/]+-(?:disable|ignore|enable|suppress)\b"
)
_FOLD = re.compile(r"^\W*#?(?:end)?region\b[^.!?]*$")
_PARAM = re.compile(r"^\W*?(?:[@\\](?:param|arg|argument|return|returns|throws|exception|tparam|yields?|retval)(?:\[\w+\])?|:(?:param|type|returns?|rtype|raises|arg)\b[^:]*:?)(?:\s*(?:\{[^}]*\})?)\s*(.*)$")
_NAMED = re.compile(r"^\W*?(?:[@\\](?:param|arg|argument|throws|exception|tparam)(?:\[\w+\])?\s*(?:\{[^}]*\})?\s*\[?[\w$.]+\]?\s*[-:]?\s*(.*)|:(?:param|type|raises|arg)\b[^:]*:\s*(.*)|[@\\:](?:returns?|rtype|retval|yields?):?\s*(?:\{[^}]*\})?\s*(.*))$")
_LISTED = re.compile(r"^\s*[*+-]?\s*`[\w$.]+`\s*[-:]?\s*(.*)$")
_HEADING = re.compile(r"(?i)^\W*(arguments|args|parameters|params|returns?|return value|raises|throws|errors|examples?|notes?|yields)\W*$")
_CODE = re.compile(
    r"[;{]\s*$|^[}\])]+[;,)]*$|^\}|(?<![=!<>])(?:[-+*/%|&^]|:)?=(?![=>])\s*\S.*[\w)\]}\"'`]$|^[\w$.\[\]>-]+(?:::<?[\w$]+>?)*[!?]?\(.*\)[;:?]*$|^(?:for|while|if|elif|with|except|def|class|switch|match|case|else|try|default|unless|until)\b.*[:{]\s*$|=>\s*.*,$"
    r"|^(?:end|begin|else|ensure|break|continue|return|pass)$|^(?:until|unless|while|if)\s+\S+\s*(?:[<>=!]=?)\s*\S+$|^(?:rescue|raise)\s+[A-Z]\w+|\bdo\s*(?:\|[^|]*\|)?$|^(?:let|const|var|defer|go|import|from|use|return|throw)\s+[\w.({\[&*].*(?:[=(].*|\))$|^[\w.]+\s*<<\s*\S+$|^return [\w.]+(?:, [\w.]+)*$|^[\w.]+ (?:\+=|-=) \S+$"
)
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _stem(w: str) -> str:
    w = w.lower()
    for end, put in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("zzes", "z"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 2:
            return (w[: -len(end)] + put).rstrip("e")
    return w.rstrip("e")


@lru_cache(maxsize=100_000)
def words_of(text: str) -> tuple[str, ...]:
    return tuple(_stem(w) for chunk in _WORD.findall(text) for w in _CAMEL.sub(" ", chunk).split())


_EMPTY_STEMS = frozenset(_stem(w) for w in _EMPTY)
_HINT_STEMS = frozenset(_stem(w) for w in re.findall(r"[^\W\d_]{3,}", _HINT.pattern.replace("docs?", "docs doc").replace("(?i)", "").replace("\\b", " ").replace("\\W", " ")))


def describe(raw: str, name: str) -> tuple[str, str, bool]:
    """(description, template, doubtful): the rows of a documentation that say something of the function.

    The description is empty if nothing does; template is the text without the function's own words and numbers, but with the words that hint at a stand-in.
    """
    own = set(words_of(name.replace("_", " "))) | _EMPTY_STEMS
    kept, says = [], False
    rows = [row.strip() for row in raw.split("\n")]
    code = [bool(_CODE.search(row)) for row in rows]
    for row, is_code in zip(rows, code):
        if not _WORD.search(row) and not re.search(r"\d", row):
            continue
        if row.strip(" .!:-").lower() in _STAND_IN or _OPEN.match(row) or _ELSEWHERE.search(row) or _TOOL.search(row) or _FOLD.match(row) or _HEADING.match(row):
            continue
        m = _NAMED.match(row) or _LISTED.match(row)
        if m:
            text = next((g for g in m.groups() if g), "")
            if not _WORD.search(text):
                continue
            row_says = text
        elif _PARAM.match(row):
            continue
        elif is_code:
            continue
        else:
            row_says = row
        kept.append(row)
        says = says or any(w not in own for w in words_of(row_says))
    if not says:
        return "", "", False
    text = "\n".join(kept)
    template = " ".join("#" if w in own - _EMPTY_STEMS - _HINT_STEMS else w for w in words_of(text))
    return text, template, bool(_HINT.search(text)) and len(kept) == 1


def pairs(functions: DataFrame) -> DataFrame:
    """(isgl1_key, code, description, template_hash, doubtful, plain) per delivered row whose documentation says something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["isgl1_key", "code", "description", "template", "doubtful"]
        for batch in batches:
            out = []
            for key, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = (key.split(":") + ["", "", ""])[2]
                got = parts(text, language, name)
                if got is not None:
                    description, template, doubtful = describe(got[1], name)
                    if description:
                        out.append((key, got[0], description, template, doubtful))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.string()) for i in range(4)] + [pa.array(columns[4], pa.bool_())], names)

    functions = pick(functions, "isgl1_key", "language", "entity_type", "current_code")
    rows = functions.filter("entity_type in ('function', 'method') and current_code is not null and current_code <> '' and isgl1_key is not null")
    rows = rows.select("isgl1_key", "language", "current_code").mapInArrow(run, "isgl1_key string, code string, description string, template string, doubtful boolean")
    return rows.select("isgl1_key", "code", "description", F.xxhash64("template").alias("template_hash"), "doubtful", (~F.col("template").contains("#")).alias("plain"))


def documented_functions(entities: DataFrame, most_repeats: int = 2, doubtful_share: float = 0.001, plain_share: float = 0.01, least_plain: int = 100) -> DataFrame:
    """(isgl1_key, code, description): one pair per function or method whose documentation says something of it.

    Each text is parsed by a generalised LL grammar over its tokens, which also finds the declaration in broken text;
    comments before it (attributes may stand between) and a Python body's opening string are its documentation. Rows
    that repeat the name, list parameters without words, stand in for a text, refer elsewhere, steer a tool, draw a line
    or are code are no description. Templates, the texts without the functions' own words, are counted by hash over the whole
    corpus. Where one row talks of documentation itself, it is doubtful and dropped if its template is shared by more than
    `doubtful_share` of the documented functions (and `most_repeats`); any text without a word of the function (plain) is
    dropped if more than `plain_share` of them (and `least_plain`, below which a share says nothing) have it.

    Null and empty texts, null keys and unknown languages give no pair; a key delivered more than once gives one, the
    least by description; extra columns are ignored; an empty table gives an empty result.
    """
    found = cut(pairs(entities))  # parsed once for the uses below
    documented = found.select("isgl1_key").distinct().count()
    counted = found.filter("doubtful or plain").select("isgl1_key", "template_hash", "doubtful").distinct().groupBy("template_hash", "doubtful").agg(F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("doubtful"), max(most_repeats, doubtful_share * documented)).otherwise(max(least_plain, plain_share * documented))
    repeated = counted.filter(F.col("n") > bound).select("template_hash", "doubtful")  # at most one per share
    kept = found.join(F.broadcast(repeated), ["template_hash", "doubtful"], "left_anti")
    return kept.groupBy("isgl1_key").agg(F.min(F.struct("description", "code")).alias("m")).select("isgl1_key", "m.code", "m.description")
