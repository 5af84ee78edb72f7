"""Problem 10: cutting oversized texts at natural boundaries, by pointer doubling over tables of boundaries."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.columns import pick
from edgewright.llm.tokens import PARAGRAPH, SENTENCE, VOCABULARY, WORD, edges_of
from edgewright.session import cut

_BOUNDARY = "doc_id long, text_hash long, n_tokens int, pos int, kind int, at_char int, back_pos int, back_char int"


def text_key(text="text") -> F.Column:
    return F.xxhash64(F.col(text)).alias("text_hash")


def _stretch(pos: np.ndarray, chosen: np.ndarray, longest: int) -> np.ndarray:
    """Mark of the edges that lie in stretches of more than `longest` tokens without a chosen edge."""
    stops = np.concatenate([[0], pos[chosen], [pos[-1]]])
    i = np.searchsorted(stops, pos, side="left").clip(1, len(stops) - 1)
    return stops[i] - stops[i - 1] > longest


def _boundaries(text: str, vocabulary: str, capacity: int, overlap: int):
    """Boundaries of one oversized text: sentences and lines; words where those are far apart; forced ones where words are."""
    pos, chars, kind = edges_of(text, vocabulary)
    if pos[-1] <= capacity:
        return None
    reach = capacity - overlap - 3
    strong = kind >= SENTENCE
    natural = strong | ((kind == WORD) & _stretch(pos, strong, reach // 2))
    forced = np.zeros(len(pos), dtype=bool)
    stops = np.concatenate([[overlap], pos[natural & (pos > overlap)]])
    for a, b in zip(stops[:-1], stops[1:]):
        while b - a > reach:
            j = np.searchsorted(pos, a + reach, side="right") - 1
            forced[j], a = True, pos[j]
    keep = np.flatnonzero((natural | forced) & (pos > overlap))
    back = np.searchsorted(pos, pos[keep] - overlap, side="right") - 1
    first = (overlap, -1, 0, 0, 0)  # stands for the start of the text: what follows it begins at token 0
    rows = np.column_stack([pos[keep], kind[keep], chars[keep], pos[back], chars[back]])
    return np.vstack([np.array([first]), rows])


def boundaries(documents: DataFrame, capacity: int, overlap: int, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n_tokens", "pos", "kind", "at_char", "back_pos", "back_char"]
        for batch in batches:
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                b = _boundaries(text, vocabulary, capacity, overlap)
                if b is not None:
                    n = len(b)
                    head = [pa.array(np.full(n, doc, dtype=np.int64)), pa.array(np.full(n, key, dtype=np.int64)), pa.array(np.full(n, b[-1, 0], dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays(head + [pa.array(b[:, i].astype(np.int32)) for i in range(5)], names)

    # a text of at most `capacity` bytes has at most `capacity` tokens: the filter is exact and reaches the scan's output
    documents = pick(documents, "doc_id", "text")
    large = documents.filter((F.octet_length("text") > capacity) & F.col("doc_id").isNotNull()).select("doc_id", text_key(), "text")
    return large.mapInArrow(run, _BOUNDARY)


def piece_bounds(documents: DataFrame, capacity: int = 4096, overlap: int = 128, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text_hash, piece_no, n_pieces, start_token, end_token, start_char, end_char, n_tokens) of every piece of
    every text of more than `capacity` tokens.

    Every boundary is joined to its farthest legal successor: the last paragraph end in the last quarter of its reach,
    else the last line or sentence end in the last half, else the last boundary in reach. The successor table is then
    squared until it spans the longest text, and the cuts reached from each text's start are gathered on the way: all
    texts are cut in parallel, in a number of joins that grows with the logarithm of the pieces.

    A piece has at most `capacity` tokens and shares `overlap` tokens with the next (up to 3 more where the edge would
    split a character). Offsets count characters. Null and empty texts and null ids give no piece; equal texts under
    one id are cut once; extra columns are ignored; an empty table gives an empty result.
    """
    if not 0 <= overlap < capacity // 2 or capacity < 16:
        raise ValueError("overlap must be less than half the capacity, the capacity at least 16")
    reach, key = capacity - overlap - 3, ["doc_id", "text_hash"]
    table = cut(boundaries(documents, capacity, overlap, vocabulary).dropDuplicates([*key, "pos", "kind"]))
    by = Window.partitionBy(*key).orderBy("pos")
    far = lambda kind, least: F.max(F.when(F.col("kind") >= kind, F.col("pos"))).over(by.rangeBetween(least, reach))
    leap = F.coalesce(far(PARAGRAPH, 3 * reach // 4), far(SENTENCE, reach // 2), far(0, 1))
    step = cut(table.withColumn("next", F.when(F.col("pos") < F.col("n_tokens"), leap)).filter("next is not null").select(*key, "pos", "next"))
    longest = table.agg(F.max("n_tokens")).first()[0] or 0
    rounds = ceil(log2(2 * longest / reach + 2)) + 1
    reached = table.filter("kind = -1").select(*key, "pos")
    for i in range(rounds):
        ahead = reached.join(step, [*key, "pos"]).select(*key, F.col("next").alias("pos"))
        reached = cut(reached.unionByName(ahead).distinct())
        if i < rounds - 1:
            after = step.select(*key, F.col("pos").alias("next"), F.col("next").alias("second"))
            step = cut(step.join(after, [*key, "next"]).select(*key, "pos", F.col("second").alias("next")))
    cuts = table.filter("kind >= 0").join(reached, [*key, "pos"], "left_semi")
    whole = Window.partitionBy(*key)
    return cuts.select(
        *key,
        F.row_number().over(by).alias("piece_no"),
        F.count(F.lit(1)).over(whole).cast("int").alias("n_pieces"),
        F.coalesce(F.lag("back_pos").over(by), F.lit(0)).alias("start_token"),
        F.col("pos").alias("end_token"),
        F.coalesce(F.lag("back_char").over(by), F.lit(0)).alias("start_char"),
        F.col("at_char").alias("end_char"),
    ).withColumn("n_tokens", F.col("end_token") - F.col("start_token"))


def with_text(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the text of each piece from its character offsets."""
    documents = pick(documents, "doc_id", "text")
    texts = documents.filter("text is not null and doc_id is not null").select(F.col("doc_id"), text_key(), "text")
    texts = texts.join(pieces.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return pieces.join(texts, ["doc_id", "text_hash"]).withColumn("text", F.expr("substring(text, start_char + 1, end_char - start_char)"))


def split_texts(documents: DataFrame, capacity: int = 4096, overlap: int = 128, vocabulary: str = VOCABULARY) -> DataFrame:
    """piece_bounds with the text of each piece."""
    return with_text(piece_bounds(documents, capacity, overlap, vocabulary), documents)


