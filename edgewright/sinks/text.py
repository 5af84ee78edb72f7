"""Results as text: JSON rows, tab-oriented tables, error logs, dated workspaces."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = {"tab": ("\t", "\\t"), "comma": (",", ","), "pipe": ("|", "|")}


def json_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON object per row, nulls written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def json_array(df: DataFrame, most: int = 10_000) -> str:
    """A pretty JSON array for a result of checked size."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for one document; write json_lines instead")
    return json.dumps([r.asDict(True) for r in rows], indent=2, default=str)


def json_tokens(n_rows: int) -> int:
    return 30 * n_rows if n_rows else 2


def table_tokens(n_rows: int) -> int:
    return 20 + 17 * n_rows


def _cell(name: str, kind: T.DataType, delimiter: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StructType, T.MapType)):
        raise ValueError(f"column {name} is nested")
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: F.coalesce(_quoted(x, delimiter) if isinstance(kind.elementType, T.StringType) else x.cast("string"), F.lit("null")))
        text = F.concat(F.lit("["), F.array_join(inner, ","), F.lit("]"))
    elif isinstance(kind, T.StringType):
        text = _quoted(c, delimiter)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def _quoted(c: Column, delimiter: str) -> Column:
    """Quoted if empty, padded, a reserved word, a number, or with a delimiter, line end or colon in it."""
    needs = (c == "") | c.contains(delimiter) | c.contains("\n") | c.contains(":") | c.isin("true", "false", "null") | (F.trim(c) != c) | c.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$")
    escaped = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.when(needs, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(c)


def tabular(df: DataFrame, name: str = "entities", delimiter: str = "tab") -> DataFrame:
    """(part, value): the header `name[count<delimiter>]{fields}:` as part 0 and a line of two blanks and the values in
    alphabetical order of the fields per row, as part 1. An empty table and nested columns are errors."""
    char, shown = DELIMITERS[delimiter]
    fields = sorted(df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    line = F.concat(F.lit("  "), F.concat_ws(char, *[_cell(f, kinds[f], char) for f in fields]))
    n = df.count()
    if n == 0:
        raise ValueError("an empty table has no header")
    head = df.sparkSession.createDataFrame([(0, f"{name}[{n}{shown}]{{{','.join(fields)}}}:")], "part int, value string")
    return head.unionByName(df.select(F.lit(1).alias("part"), line.alias("value")))


def write_text(lines: DataFrame, path: str) -> None:
    """Write lines as text files; a header part comes in a file of its own, first by name."""
    lines.write.partitionBy("part").mode("overwrite").text(path) if "part" in lines.columns else lines.select("value").write.mode("overwrite").text(path)


def error_log(errors: DataFrame) -> DataFrame:
    """(value): lines `[TAG] path: detail` of (file_path, tag, detail)."""
    return errors.select(F.concat(F.lit("["), "tag", F.lit("] "), "file_path", F.when(F.length("detail") > 0, F.concat(F.lit(": "), "detail")).otherwise("")).alias("value"))


def workspace_name(prefix: str, at: Column | None = None) -> Column:
    """A dated folder name, prefix and yyyyMMddHHmmss."""
    return F.concat(F.lit(prefix), F.date_format(F.current_timestamp() if at is None else at, "yyyyMMddHHmmss"))


