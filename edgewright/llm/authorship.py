"""Problem 3: source files that nobody wrote by hand in their repository."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewright.columns import pick

#: Notices as they open a sentence of a file's header, lower case; all sets go into one automaton. One of the
#: first or second set decides; of the weaker ones two of different sets must stand in the header.
GENERATED = (
    "code generated by", "generated code", "@generated", "automatically generated", "automatically produced", "automatically created", "auto-generated", "auto generated", "autogenerated", "<auto-generated", "machine written", "machine generated", "machine-generated", "computer generated",
    "generated file - do not", "generated file. do not", "automatisch erzeugt", "automatisch generiert", "maschinell erzeugt", "archivo generado", "fichero generado", "código generado", "generado automáticamente", "généré automatiquement", "fichier généré", "gerado automaticamente", "arquivo gerado", "generato automaticamente",
)
VENDORED = ("vendored from", "vendored copy", "bundled copy of", "imported verbatim", "copied verbatim from", "copied unchanged from", "copy of upstream", "unmodified copy of", "upstream home:", "mirrored from upstream", "downloaded from upstream", "third-party code from")
MADE = ("generated by", "generated from", "generated with", "generated using", "produced by", "output of", "built by", "made by", "created by", "compiled by", "written by", "erzeugt von", "erzeugt mit", "generado por", "généré par", "gerado por", "generato da")
HANDS_OFF = ("do not edit", "do not modify", "don't edit", "do not change", "manual edits", "manual changes", "changes will be lost", "changes will be overwritten", "edits will be overwritten", "rewritten at every build", "regenerate", "nicht bearbeiten", "nicht ändern", "no modificar", "no editar", "ne pas modifier", "ne pas éditer", "não edite")
TOOLS = ("bison", "yacc", "flex", "swig", "protoc", "protocol buffer compiler", "openapi generator", "swagger codegen", "antlr", "thrift compiler", "javacc", "cython", "jflex", "ragel", "gperf", "bindgen", "cbindgen", "sqlc", "mockgen", "stringer", "easyjson", "flatc", "xsd.exe", "xjc", "wsdl2java", "re2c", "lemon", "gengetopt", "moc", "qt user interface compiler", "meta object compiler", "grpc", "graphql code generator", "jooq", "cargo-", "autoconf", "at build time")
#: Directories of other projects' files, and file names that tools give.
VENDORED_PATH = r"(^|/)(vendor|vendored|third[_-]?party|node_modules|bower_components|site-packages|dist-packages|Godeps|Pods)/|(^|/)(external|externals|extern|deps|dependencies)/[^/]+-v?\d+(\.\d+)+/"
MINIFIED_PATH = r"[.-]min\.[cm]?[jt]sx?$"
GENERATED_PATH = r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|c)|\.g\.[cm]?[jt]sx?|[._]generated\.\w+|[._]gen\.go|\.tab\.[ch]|\.lex\.c|\.designer\.\w+|_pb\.(rb|js|ts)|_grpc_pb\.(js|ts)|[a-z]Grpc\.java|\.generated\.\w+)$"
LOCKFILE = r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|Pipfile\.lock|Gemfile\.lock|composer\.lock|go\.sum)$"

#: A text is data when this share of it is literals and it has no statements, compressed when fewer of its characters
#: (literals aside) are blanks, and a tool's repetition when no more of its lines are distinct, numbers aside, and it numbers its definitions; shorter
#: texts are not judged by the latter two.
DATA_SHARE, BLANK_SHARE, DISTINCT_SHARE, LEAST_SIZE, LEAST_LINES, LEAST_NUMBERED = 0.75, 0.05, 0.3, 200, 20, 5

_OWNER = re.compile(r"(?:copyright \(c\)(?: \d{4})? the|part of the) (\S+) (?:authors|contributors|project)\b", re.I)
#: A line that names a work and its version, and a copyright or licence beside it: the banner of another project's release.
_BANNER = re.compile(r"^[*!#/;\s-]*(?:@license\s+)?([@\w$][\w$./ -]{1,60}?),?\s+v?(\d+\.\d+(?:\.\d+)*)(?:[\s,;:|(-]|$)", re.M)
_RIGHTS = re.compile(r"\(c\)|©|\bcopyright\b|\blicen[sc]ed?\b", re.I)
_LIBRARY = re.compile(r"^[*!#/;\s-]*(?:@license\s+)?([\w$.-]+)[^\n]*(?:<https?://|\blibrary\b)", re.M | re.I)
#: Words that may stand before a notice in its sentence.
_LEAD = frozenset("this the a an file files code source module header class content contents of in is was are were has have been it its all automatically auto machine please note warning attention important caution notice diese datei ist wurde wird este esta archivo fichero fue ha sido ce cet fichier est a été parser lexer scanner implementation interface wrapper bindings and und y et - -- : ! * /".split())
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d[\d.]*)[,\s]*')
_STATEMENT = re.compile(r"\b(func|def|fn|function|for|while|return|if|switch|match)\b")
_COMMENT = re.compile(r"^(//|#|/?\*)")
_NUMBER = re.compile(r"\w*\d{2,}\w*|\d+")
#: A definition whose name ends in a number of two digits or more.
_NUMBERED = re.compile(r"\b(?:def|fn|func|function|class|struct|sub|[a-z]\w*)\s+\*?\w*[A-Za-z_]\d{2,}\s*(?:\(|=\s*\(|=\s*function)")
_HASH = ("py", "rb")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("generated", GENERATED), ("vendored", VENDORED), ("made", MADE), ("hands off", HANDS_OFF), ("tool", TOOLS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_SENTENCE = re.compile(r"[.;!?]\s+|\s--?\s|\n|\(|:\s|,\s")
_WORD = re.compile(r"[^\s,.;:!?()]+")


def notices(outer: str) -> set[str]:
    """Kinds of notices in comments. One counts where it opens a sentence or only words of a notice stand before it; inside
    quotation marks or further on in a sentence it is talked about. A tool's name may stand anywhere."""
    low, found = outer.lower(), set()
    for end, (kind, n) in automaton().iter(low):
        begin = end - n + 1
        if (low[begin - 1 : begin].isalnum() and low[begin].isalnum()) or (low[end].isalnum() and low[end + 1 : end + 2].isalnum()):
            continue
        if kind == "tool":
            found.add(kind)
            continue
        start = max((m.end() for m in _SENTENCE.finditer(low, max(0, begin - 200), begin)), default=max(0, begin - 200))
        before = low[start:begin]
        if not any(q in before for q in "\"'`“«") and all(w.strip("*/#-<>") in _LEAD or not w.strip("*/#-<>") for w in _WORD.findall(before)):
            found.add(kind)
    return found


def notice_reason(outer: str, repository: str) -> str | None:
    """What the comments that open or close a file say of its origin."""
    found = notices(outer)
    if "generated" in found or len(found & {"made", "hands off", "tool"}) > 1:
        return "generated"
    if "vendored" in found or any(m[1].lower() != repository.lower() for m in _OWNER.finditer(outer)):
        return "vendored"
    head = outer[:1500]
    if _RIGHTS.search(head):
        named = next((m for m in _BANNER.finditer(head) if m[1].strip().lower() not in (repository.lower(), "version", "apache license", "license", "mit license")), None)
        if (named and not re.search(r"\b(?:licen[sc]e|version)\b", named[1], re.I)) or any(m[1].lower() != repository.lower() and re.search(r"\breleased under\b|\blicensed under\b", head, re.I) for m in _LIBRARY.finditer(head)):
            return "vendored"
    return None


def outer_comments(text: str, ext: str) -> str:
    """The comments before a file's first line of code and after its last."""
    lines = text.removeprefix("﻿").split("\n")
    hashes = ext in _HASH

    def take(rows: list[str]) -> list[str]:
        out, close = [], None
        for row in rows:
            s = row.strip()
            if close:
                out.append(s)
                close = None if close in s else close
            elif not s or s.startswith(("//", "--", "*", "<!--")) or (s[0] == "#" and (hashes or s.startswith("#!/"))):
                out.append(s)
            elif s.startswith("/*"):
                out.append(s)
                close = None if "*/" in s[2:] else "*/"
            elif ext == "py" and s[:3] in ('"""', "'''") and not any(r.strip()[:3] in ('"""', "'''") for r in out):
                out.append(s[3:])  # of a docstring the first line only
                break
            elif ext == "rb" and s.startswith("=begin"):
                out.append(s)
                close = "=end"
            else:
                break
        return out

    head = take(lines)
    tail = []
    inside = False
    for row in reversed(lines[len(head) :]):
        s = row.strip()
        if inside or s.endswith("*/") and s.startswith(("/*", "*", "*/")):
            tail.append(s)
            inside = not s.startswith("/*")
        elif not s or s.startswith("//") or (s[0] == "#" and hashes):
            tail.append(s)
        else:
            break
    return "\n".join(head + tail[::-1])


def reason_of(text: str, ext: str, repository: str) -> tuple[str, str] | None:
    """(reason, evidence): why a text was not written by hand in its repository, by its notices or its make-up; None if nothing says so."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    outer = outer_comments(text, ext)
    told = notice_reason(outer, repository) if outer else None
    if told:
        return told, "notice"
    lines = [s for row in text.split("\n") if (s := row.strip())]
    n = len(text)
    literal = sum(map(len, _LITERAL.findall(text)))
    if literal >= DATA_SHARE * n and not _STATEMENT.search(_LITERAL.sub(" ", "\n".join(s for s in lines if not _COMMENT.match(s)))):
        return "data", "make-up"
    # literals aside, so that a long address in code is no sign of compression
    if n - literal >= LEAST_SIZE and text.count(" ") + text.count("\t") < BLANK_SHARE * (n - literal):
        return "minified", "make-up"
    if len(lines) >= LEAST_LINES and len(set(_NUMBER.sub("0", "\n".join(lines)).split("\n"))) <= DISTINCT_SHARE * len(lines) and len(_NUMBERED.findall(text)) >= LEAST_NUMBERED:
        return "generated", "make-up"
    return None


def path_reason(path: str = "file_path") -> Column:
    p = F.col(path)
    return (
        F.when(p.rlike(VENDORED_PATH), "vendored").when(p.rlike(MINIFIED_PATH), "minified").when(p.rlike(GENERATED_PATH) | p.rlike(LOCKFILE), "generated")
    )


def foreign_files(files: DataFrame) -> DataFrame:
    """(file_id, reason, evidence): files not written by hand in their repository; reason vendored, generated, minified or
    data; evidence path, notice or make-up.

    Path rules decide first, in the scan; the rest goes through one automaton of notices over the comments that open or
    close a file, so code or strings that only mention such notices are no case; a header that names another project
    marks a copy; what has no notice is judged by the make-up of the whole text. Null and empty texts are judged by
    their path alone; null ids are ignored; a null path or repository matches no rule; a file loaded twice counts
    once, under its least reason; extra columns are ignored; an empty table gives an empty result.
    """
    files = pick(files, "file_id", "repository", "file_path", "current_code")
    known = files.filter("file_id is not null").select("file_id", F.coalesce("repository", F.lit("")).alias("repository"), F.lower(F.regexp_extract(F.coalesce("file_path", F.lit("")), r"\.([A-Za-z]+)$", 1)).alias("ext"), "current_code", path_reason().alias("reason"))
    by_path = known.filter("reason is not null").select("file_id", "reason", F.lit("path").alias("evidence"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why = [reason_of(t, e, r) or (None, None) for t, e, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array([w[0] is not None for w in why])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w[0] for w in why], pa.string()), pa.array([w[1] for w in why], pa.string())], ["file_id", "reason", "evidence"]).filter(keep)

    texts = known.filter("reason is null and current_code is not null and current_code <> ''").select("file_id", "current_code", "ext", "repository")
    found = by_path.unionByName(texts.mapInArrow(run, "file_id long, reason string, evidence string"))
    return found.groupBy("file_id").agg(F.min(F.struct("reason", "evidence")).alias("m")).select("file_id", "m.reason", "m.evidence")
