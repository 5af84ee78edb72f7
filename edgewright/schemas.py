"""Fixed schemas of the relations, nested types and enumerations. Nothing is inferred when reading."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()


def _struct(spec: str) -> T.StructType:
    """Columns written as `name:type`, `!` for never null; types S L I B D T and A for an array of strings."""
    kinds = {"S": _S, "L": _L, "I": _I, "B": _B, "D": _D, "T": _TS, "A": T.ArrayType(_S)}
    cols = [c.partition(":") for c in spec.split()]
    return T.StructType([T.StructField(n, kinds[t.rstrip("!")], not t.endswith("!")) for n, _, t in cols])


LINE_RANGE = T.StructType([T.StructField("start", _I), T.StructField("end", _I)])
#: The JSON of interface_signature, tdd_classification and lsp_meta_data.
SIGNATURE = T.StructType([
    T.StructField("entity_type", _S), T.StructField("name", _S), T.StructField("visibility", _S), T.StructField("file_path", _S),
    T.StructField("line_range", LINE_RANGE), T.StructField("module_path", T.ArrayType(_S)), T.StructField("documentation", _S),
])
TDD = T.StructType([
    T.StructField("entity_class", _S), T.StructField("testability", _S), T.StructField("complexity", _S), T.StructField("dependencies", _L),
    T.StructField("test_coverage_estimate", _D), T.StructField("critical_path", _B), T.StructField("change_risk", _S),
])
LSP = T.StructType([T.StructField("type_information", T.MapType(_S, _S)), T.StructField("usage_analysis", T.MapType(_S, _S)), T.StructField("semantic_tokens", T.ArrayType(T.MapType(_S, _S)))])
METADATA = T.StructType([T.StructField("created_at", _TS), T.StructField("modified_at", _TS), T.StructField("content_hash", _S), T.StructField("additional", T.MapType(_S, _S))])

ENTITIES = _struct(
    "isgl1_key:S! current_code:S future_code:S interface_signature:S! tdd_classification:S! lsp_meta_data:S current_ind:B! future_ind:B! future_action:S file_path:S! language:S! "
    "last_modified:S! entity_type:S! entity_class:S! birth_timestamp:L content_hash:S semantic_path:S root_subfolder_l1:S! root_subfolder_l2:S!"
)
EDGES = _struct("from_key:S! to_key:S! edge_type:S! source_location:S")
EXCLUDED_TESTS = _struct("entity_name:S! folder_path:S! filename:S! entity_class:S! language:S! line_start:L! line_end:L! detection_reason:S!")
WORD_COVERAGE = _struct("folder_path:S! filename:S! language:S! source_word_count:L! entity_word_count:L! import_word_count:L! comment_word_count:L! raw_coverage_pct:D! effective_coverage_pct:D! entity_count:L!")
IGNORED_FILES = _struct("folder_path:S! filename:S! extension:S! reason:S!")
FILE_HASH_CACHE = _struct("file_path:S! content_hash:S! last_updated:T")
FILE_CHANGES = _struct("file_path:S! change_type:S! content:S changed_at:T")
MATCH_NEW = _struct("name:S! file_path:S! line_start:I! line_end:I! content_hash:S! code:S")
MATCH_OLD = _struct("key:S! name:S! file_path:S! line_start:I! line_end:I! content_hash:S")
TEMPORAL_CHANGES = _struct("isgl1_key:S! action:S! future_code:S seq:L")
JSON_GRAPH = T.StructType([
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField("isgl1_key", _S), T.StructField("name", _S), T.StructField("file_path", _S), T.StructField("reverse_deps", T.ArrayType(_S))]))),
    T.StructField("edges", T.ArrayType(T.StructType([T.StructField("from_key", _S), T.StructField("to_key", _S), T.StructField("edge_type", _S)]))),
])
RELATIONS = {"entities": ENTITIES, "edges": EDGES, "excluded_tests": EXCLUDED_TESTS, "word_coverage": WORD_COVERAGE, "ignored_files": IGNORED_FILES, "file_hash_cache": FILE_HASH_CACHE}
#: Primary keys of the relations: writing a row again replaces it.
KEYS = {"entities": ["isgl1_key"], "edges": ["from_key", "to_key", "edge_type"], "excluded_tests": ["entity_name", "folder_path", "filename"], "word_coverage": ["folder_path", "filename"], "ignored_files": ["folder_path", "filename"], "file_hash_cache": ["file_path"]}

#: Edge types, languages by extension, tokens of entity types in keys.
EDGE_TYPES = ("Calls", "Uses", "Implements")
LANGUAGE_OF = {
    "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "go": "go", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "sql": "sql",
}
TYPE_TOKENS = {
    "function": "fn", "method": "method", "class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "trait": "trait", "module": "module", "impl": "impl",
    "macro": "macro", "proc_macro": "proc_macro", "test": "test", "variable": "var", "constant": "const", "table": "table", "view": "view",
}
TYPE_CONVERSION = {"namespace": "module", "typedef": "variable", "interface": "trait", "impl": "impl_block"}
