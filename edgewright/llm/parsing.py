"""Problem 5: source files that do not parse.

Files are lexed; what is checked are rows of a DataFrame: adjacent tokens are anti-joined with the pairs that the
language's productions derive, brackets (blocks among them) are reduced by windows over nesting depth, and groups whose
contents, inner groups reduced, no production derives are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.columns import pick
from edgewright.llm.grammar import BEGIN, END
from edgewright.llm.languages import grammar
from edgewright.llm.lexing import token_string
from edgewright.session import cut

LANGUAGE = {"rs": "rs", "py": "py", "js": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "java": "java", "go": "go", "c": "c", "h": "c", "rb": "rb"}
#: Brackets in rows: round, square, curly, parts of a template, indented blocks, blocks closed by a word.
OPENS, CLOSES = "([{tik", ")]}TIK"
_EMPTY = re.compile("|".join(re.escape(a + b) for a, b in zip(OPENS, CLOSES)))


@lru_cache(maxsize=None)
def _bracket_rows(lang: str) -> tuple[re.Pattern, dict[int, str]]:
    """(what is no bracket, the language's brackets as in rows)."""
    g = grammar(lang)
    names = {k: OPENS.index({"p": "(", "s": "[", "b": "{"}.get(k, k if k in ("t", "i") else "k")) for k in g.brackets}
    table = {ord(v[0]): OPENS[names[k]] for k, v in g.brackets.items()} | {ord(v[1]): CLOSES[names[k]] for k, v in g.brackets.items()}
    return re.compile("[^" + re.escape("".join(g.brackets.values())) + "]+"), table


def lex_rows(text: str, lang: str, ext: str = "") -> tuple[set[str], str, list[str]]:
    """(adjacent pairs, brackets left after two local reductions in their order, first group that no production derives) of one text.

    Groups are reduced here from the inside, each distinct one once per process; where brackets do not match there is
    nothing to reduce, and the windows over the brackets find it.
    """
    s = token_string(text, lang, ext in ("js", "jsx", "tsx"))
    pairs = {a + b for a, b in set(zip(BEGIN + s, s + END))}
    other, table = _bracket_rows(lang)
    rest = _EMPTY.sub("", _EMPTY.sub("", other.sub("", s).translate(table)))
    return pairs, rest, grammar(lang).errors(s)[:1]


def token_rows(files: DataFrame) -> DataFrame:
    """(file_id, text_hash, lang, kind, a, pos): kind `pair`, `nest` or `stmt`; pairs distinct per text.

    The lexers return one compact row per text; the rows of tokens are made of it inside the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pairs, nests, statements = [], [], [], []
            for ext, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                langs.append(LANGUAGE[ext])
                p, nest, stmts = lex_rows(text, langs[-1], ext)
                pairs.append("".join(p))
                nests.append(nest)
                statements.append(stmts)
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(pairs, pa.string()), pa.array(nests, pa.string()), pa.array(statements, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["file_id", "text_hash", "lang", "pairs", "nest", "stmts"])

    texts = files.mapInArrow(run, "file_id long, text_hash long, lang string, pairs string, nest string, stmts array<string>")
    row = lambda kind, a, pos: F.struct(F.lit(kind).alias("kind"), a.alias("a"), pos.cast("int").alias("pos"))
    places = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places((F.length("pairs") / 2).cast("int")), lambda i: row("pair", F.substring(F.col("pairs"), i * 2 + 1, F.lit(2)), F.lit(0)))
    nest = F.transform(places(F.length("nest")), lambda i: row("nest", F.substring(F.col("nest"), i + 1, F.lit(1)), i))
    stmts = F.transform("stmts", lambda x: row("stmt", x, F.lit(0)))
    return texts.select("file_id", "text_hash", "lang", F.explode(F.concat(pairs, nest, stmts)).alias("t")).select("file_id", "text_hash", "lang", "t.kind", "t.a", "t.pos")


def extension(path="file_path"):
    return F.lower(F.regexp_extract(F.col(path), r"\.([A-Za-z]+)$", 1))


def parseable(files: DataFrame) -> DataFrame:
    """(file_id, text_hash, ext, current_code) of the files that have text and a language by extension."""
    files = pick(files, "file_id", "file_path", "current_code")
    known = files.filter("current_code is not null and current_code <> '' and file_id is not null").select("file_id", F.xxhash64("current_code").alias("text_hash"), extension().alias("ext"), "current_code")
    return known.filter(F.col("ext").isin(list(LANGUAGE)))


def permissible_pairs(spark) -> DataFrame:
    """(lang, kind, a): the pairs that the productions derive, a fixed table of the grammars."""
    rows = [(lang, "pair", p) for lang in sorted(set(LANGUAGE.values())) for p in sorted(grammar(lang).pairs())]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["lang", "kind", "a"]))


def unparsable_files(files: DataFrame) -> DataFrame:
    """(file_id, reason): files whose text breaks the grammar of their extension's language; reason `pair`, `nest` or `stmt`.

    Null and empty texts, unknown extensions and null ids are no case. A file loaded twice counts once; if its texts
    differ, each is checked and one that breaks the grammar suffices. Line ends are normalised and a byte order mark
    is skipped; extra columns are ignored; an empty table gives an empty result. Texts are not shuffled.
    """
    known = parseable(files)
    key = ["file_id", "text_hash"]
    allowed = F.broadcast(permissible_pairs(files.sparkSession))  # fixed size
    # what breaks a rule on its own is decided at once; of the brackets only those that two local reductions leave go on
    suspects = cut(token_rows(known).join(allowed, ["lang", "kind", "a"], "left_anti"))
    nest = suspects.filter("kind = 'nest'").select(*key, "a", "pos").distinct()
    opens = F.col("a").isin(*OPENS)
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    leveled = nest.withColumn("d", depth).withColumn("level", F.when(opens, F.col("d")).otherwise(F.col("d") + 1))
    at_level = Window.partitionBy(*key, "level").orderBy("pos")
    matched = leveled.withColumn("before", F.lag("a").over(at_level)).withColumn("after", F.lead("a").over(at_level))
    opener = F.translate("a", CLOSES, OPENS)
    unmatched = F.when(opens, F.coalesce(F.col("after").isin(*OPENS), F.lit(True))).otherwise(~F.col("before").eqNullSafe(opener))
    found = suspects.filter("kind <> 'nest'").select("file_id", "kind").unionByName(matched.filter(unmatched).select("file_id", F.lit("nest").alias("kind")))
    return found.groupBy("file_id").agg(F.min("kind").alias("reason"))


def parse_rates(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(repository, language, n_files, n_unparsable, rate, n_reported, n_reported_sound) per repository and language of the extension.

    n_reported counts the files that any report of that repository names as unparsed, n_reported_sound those of them that parse.
    """
    files, reports = pick(files, "file_id", "repository", "file_path", "current_code"), pick(reports, "unparsed_files")
    one = files.filter("file_id is not null").select("file_id", "repository", "file_path", extension().alias("language")).dropDuplicates(["file_id"])
    told = reports.select(F.explode("unparsed_files").alias("file_path")).filter("file_path is not null").distinct().withColumn("told", F.lit(1))
    bad = unparsable_files(files).select("file_id", F.lit(1).alias("bad"))
    rows = one.join(bad, "file_id", "left").join(told, "file_path", "left")
    return (
        rows.groupBy("repository", "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_unparsable"), F.count("told").alias("n_reported"), F.count(F.when(F.col("bad").isNull(), F.col("told"))).alias("n_reported_sound"))
        .withColumn("rate", F.col("n_unparsable") / F.col("n_files"))
    )
