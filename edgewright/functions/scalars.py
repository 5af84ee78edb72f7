"""Scalar functions over keys, names, paths and texts, as column expressions; null in gives null out unless said."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from edgewright.schemas import LANGUAGE_OF, TYPE_CONVERSION, TYPE_TOKENS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def key_part(key, n: int) -> Column:
    """The n-th part (from 1) of a key `language:type:name:path:stamp`; null if there is none or it is empty."""
    part = F.element_at(F.split(_c(key), ":"), n) if n == 1 else F.get(F.split(_c(key), ":"), F.lit(n - 1))
    return F.when(part != "", part)


def name_of_key(key) -> Column:
    return F.get(F.split(_c(key), ":"), F.lit(2))


def language_of_key(key) -> Column:
    """First part of the key; `unknown` where it is empty."""
    return F.when(_c(key).isNotNull(), F.coalesce(key_part(key, 1), F.lit("unknown")))


def sanitize_name(name) -> Column:
    """A name as it may stand in a key: `, ` and commas, blanks and brackets become words."""
    out = F.replace(_c(name), F.lit(", "), F.lit("__c__"))
    for a, b in ((" ", "_"), ("<", "__lt__"), (">", "__gt__"), (",", "__c__"), ("[", "__lb__"), ("]", "__rb__"), ("{", "__lc__"), ("}", "__rc__")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sanitize_colons(name) -> Column:
    return F.replace(_c(name), F.lit("::"), F.lit("__"))


def sanitize_path(path) -> Column:
    return F.translate(_c(path), "/\\.", "___")


def semantic_path(path) -> Column:
    """`__` and the path up to its last dot, with / \\ - . as _."""
    stem = F.when(F.instr(_c(path), ".") > 0, F.regexp_extract(_c(path), r"(?s)^(.*)\.[^.]*$", 1)).otherwise(_c(path))
    return F.concat(F.lit("__"), F.translate(stem, "/\\-.", "____"))


def folder_of(path) -> Column:
    """Everything before the last slash; "" for a file at the root."""
    return F.regexp_extract(_c(path), r"(?s)^(.*)/[^/]*$", 1)


def filename_of(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def extension_of(path) -> Column:
    """Text after the last dot of the file name; null without one."""
    ext = F.regexp_extract(_c(path), r"[^/]\.([^./]+)$", 1)
    return F.when(ext != "", ext)


def language_of_path(path) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return F.element_at(table, F.lower(extension_of(path)))


def subfolder_l1(path) -> Column:
    p = F.split(F.regexp_replace(_c(path), r"^\./", ""), "/")
    return F.when(F.size(p) <= 1, ".").otherwise(F.get(p, F.lit(0)))


def subfolder_l2(path) -> Column:
    p = F.split(F.regexp_replace(_c(path), r"^\./", ""), "/")
    return F.when(F.size(p) <= 2, "").otherwise(F.get(p, F.lit(1)))


def folder_at_depth(path, depth: int) -> Column:
    """The first `depth` folders of the path and a slash; "." for a file at the root."""
    parts = F.filter(F.split(folder_of(path), "/"), lambda x: (x != "") & (x != "."))
    return F.when(F.size(parts) == 0, ".").otherwise(F.concat(F.array_join(F.slice(parts, 1, depth), "/"), F.lit("/")))


def module_path(path) -> Column:
    """Folders and stem after `src`, without a last lib, main or mod."""
    parts = F.split(F.regexp_replace(_c(path), r"\.(rs|py|js|ts)$", ""), "/")
    after = F.when(F.array_position(parts, "src") > 0, F.slice(parts, F.array_position(parts, "src").cast("int") + 1, F.size(parts))).otherwise(F.array().cast("array<string>"))
    return F.when(F.element_at(after, -1).isin("lib", "main", "mod"), F.slice(after, 1, F.greatest(F.size(after) - 1, F.lit(0)))).otherwise(after)


def code_lines(text, first, last) -> Column:
    """Lines first..last (from 1) of a text, joined."""
    return F.array_join(F.slice(F.split(_c(text), "\n"), F.greatest(_c(first), F.lit(1)), F.greatest(_c(last) - F.greatest(_c(first), F.lit(1)) + 1, F.lit(0))), "\n")


def content_hash(text) -> Column:
    return F.sha2(_c(text), 256)


def legacy_key(path, name, kind, stamp) -> Column:
    """`path-name-kind-hash8` of the older key format, hash over the four texts."""
    return F.concat_ws("-", sanitize_path(path), _c(name), F.substring(F.lower(_c(kind)), 1, 4), F.substring(F.sha2(F.concat(_c(path), _c(name), _c(kind), _c(stamp)), 256), 1, 8))


def key_v2(language, kind, name, path, birth) -> Column:
    """`language:type:name:path:T<birth>`."""
    return F.concat_ws(":", _c(language), type_token(kind), sanitize_name(name), semantic_path(path), F.concat(F.lit("T"), _c(birth).cast("string")))


def type_token(kind) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_TOKENS.items() for x in kv]), F.lower(_c(kind)))


def convert_type(kind) -> Column:
    k = F.lower(_c(kind))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_CONVERSION.items() for x in kv]), k), k)


def external_crate(path) -> Column:
    """First segment of `a::b::c` for a path outside; null for one segment, own paths and the standard library."""
    p = F.split(_c(path), "::")
    inside = F.get(p, F.lit(0)).isin("crate", "self", "super", "std", "core", "alloc", "proc_macro", "test")
    return F.when((F.size(p) >= 2) & ~inside, F.get(p, F.lit(0)))


def external_item(path) -> Column:
    return F.when(external_crate(path).isNotNull(), F.element_at(F.split(_c(path), "::"), -1))


def word_count(text) -> Column:
    """Number of maximal runs without white space."""
    return F.size(F.filter(F.split(_c(text), r"\s+"), lambda x: x != ""))


def comment_words(text, language) -> Column:
    """Words in the comment lines at the left margin of a text."""
    hashes = F.coalesce(_c(language).isin("python", "ruby"), F.lit(False))
    mine = lambda x: F.when(hashes, x.rlike(r"^#(?!!)")).otherwise(x.rlike(r"^(//|/\*| ?\*)"))
    return F.aggregate(F.filter(F.split(_c(text), "\n"), mine), F.lit(0), lambda n, x: n + word_count(x))


def import_words(text) -> Column:
    """Words in the lines that import something."""
    lines = F.split(_c(text), "\n")
    return F.aggregate(F.filter(lines, lambda x: x.rlike(r"^\s*(import\b|from\s+\S+\s+import\b|use\s|#\s*include\b|require\b|using\s)")), F.lit(0), lambda a, x: a + word_count(x))


def is_test_file(path, text, language) -> Column:
    """Test classification of a file by its path and text, per language; main.rs and lib.rs are never tests."""
    p, t, lang = _c(path), F.coalesce(_c(text), F.lit("")), _c(language)
    return (
        F.when(p.endswith("main.rs") | p.endswith("lib.rs"), False)
        .when(lang == "rust", p.contains("/tests/") | p.startswith("tests/") | p.endswith("_test.rs") | p.endswith("_tests.rs") | t.contains("#[test]") | t.contains("#[cfg(test)]"))
        .when(lang == "go", p.endswith("_test.go"))
        .when(lang.isin("javascript", "typescript"), p.contains(".test.") | p.contains(".spec.") | p.contains("__tests__"))
        .when(lang == "python", p.startswith("test_") | p.contains("/test_") | p.endswith("_test.py") | p.contains("/tests/"))
        .when(lang == "java", p.endswith("Test.java") | p.endswith("Tests.java") | p.contains("src/test/"))
        .otherwise(False)
    )


def estimated_tokens(key) -> Column:
    """100 and a tenth of the key's bytes."""
    return (F.lit(100) + F.floor(F.octet_length(_c(key)) / 10)).cast("int")


def percent(part, whole, when_empty: float) -> Column:
    return F.when(_c(whole) > 0, _c(part) * 100.0 / _c(whole)).otherwise(F.lit(when_empty))


def line_span(start, end) -> Column:
    return _c(end) - _c(start) + 1


def effective_code(action, future, current) -> Column:
    return F.when(_c(action).isNotNull(), _c(future)).otherwise(_c(current))


def temporal_state_valid(current, future, action) -> Column:
    """The legal states: (1,0,Delete) (1,1,Edit) (0,1,Create), equal set indicators without action; (0,0) never."""
    c, f, a = _c(current), _c(future), _c(action)
    return F.coalesce(F.when(~c & ~f, False).when(a.isNull(), c == f).otherwise((c & ~f & (a == "Delete")) | (c & f & (a == "Edit")) | (~c & f & (a == "Create"))), F.lit(False))


def scc_risk(size) -> Column:
    return F.when(_c(size) <= 1, "NONE").when(_c(size) == 2, "MEDIUM").otherwise("HIGH")


def core_layer(coreness) -> Column:
    return F.when(_c(coreness) >= 8, "CORE").when(_c(coreness) >= 3, "MID").otherwise("PERIPHERAL")


def entropy_level(h) -> Column:
    return F.when(_c(h) < 1.0, "LOW").when(_c(h) < 1.4, "MODERATE").otherwise("HIGH")


def debt_severity(hours) -> Column:
    return F.when(_c(hours) <= 0, "NONE").when(_c(hours) <= 4, "LOW").when(_c(hours) <= 8, "MEDIUM").otherwise("HIGH")


def metric_status(value, fail: float | None, warn: float | None) -> Column:
    """FAIL above `fail`, WARNING above `warn`, else OK."""
    out = F.lit("OK")
    if warn is not None:
        out = F.when(_c(value) > warn, "WARNING").otherwise(out)
    return F.when(_c(value) > fail, "FAIL").otherwise(out) if fail is not None else out


def _rounds(v: list[np.ndarray], n: int) -> None:
    turn = lambda x, b: (x << np.uint64(b)) | (x >> np.uint64(64 - b))
    for _ in range(n):
        v[0] = v[0] + v[1]
        v[1] = turn(v[1], 13) ^ v[0]
        v[0] = turn(v[0], 32)
        v[2] = v[2] + v[3]
        v[3] = turn(v[3], 16) ^ v[2]
        v[0] = v[0] + v[3]
        v[3] = turn(v[3], 21) ^ v[0]
        v[2] = v[2] + v[1]
        v[1] = turn(v[1], 17) ^ v[2]
        v[2] = turn(v[2], 32)


def siphash13_all(texts: list[bytes]) -> np.ndarray:
    """SipHash with one compression and three finalisation rounds under the zero key (published algorithm), of texts of the
    same length at a time."""
    out = np.zeros(len(texts), dtype=np.uint64)
    lengths = np.array([len(x) for x in texts])
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        words = n // 8 + 1
        data = np.zeros((len(rows), words * 8), dtype=np.uint8)
        data[:, :n] = np.frombuffer(b"".join(texts[i] for i in rows), dtype=np.uint8).reshape(len(rows), n)
        data[:, -1] = n & 0xFF
        blocks = data.view("<u8")
        v = [np.full(len(rows), k, dtype=np.uint64) for k in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]
        for k in range(words):
            v[3] = v[3] ^ blocks[:, k]
            _rounds(v, 1)
            v[0] = v[0] ^ blocks[:, k]
        v[2] = v[2] ^ np.uint64(0xFF)
        _rounds(v, 3)
        out[rows] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def siphash13(data: bytes) -> int:
    return int(siphash13_all([data])[0])


#: Start and length in seconds of the period of synthetic birth stamps (2020 and ten years).
BIRTH_FROM, BIRTH_SPAN = 1_577_836_800, 315_360_000


def birth_timestamp(path, name) -> Column:
    """Synthetic birth of an entity: a stable hash of path and name within ten years from 2020."""

    @F.pandas_udf("long")
    def born(paths: pd.Series, names: pd.Series) -> pd.Series:
        known = (paths.notna() & names.notna()).to_numpy()
        out = pd.Series(pd.NA, index=paths.index, dtype="Int64")
        hashes = siphash13_all([p.encode() + b"\xff" + n.encode() + b"\xff" for p, n in zip(paths[known], names[known])])
        out[known] = BIRTH_FROM + (hashes % np.uint64(BIRTH_SPAN)).astype("int64")
        return out

    return born(_c(path), _c(name))
