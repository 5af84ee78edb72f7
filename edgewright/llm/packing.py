"""Problem 8: filling containers of fixed capacity with texts, by hierarchical residual packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewright.columns import pick
from edgewright.llm.splitting import text_key
from edgewright.llm.tokens import VOCABULARY, WORD, edges_of, encode
from edgewright.session import cut

_ROWS = "container_id long, place int, doc_id long, text_hash long, copy_no int, piece_no int, start_char int, end_char int, n_tokens int, filled int, done boolean"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number per size, sizes in descending order: each goes where the least room is left over."""
    room: list[tuple[int, int]] = []
    where, bins = np.empty(len(sizes), dtype=np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        j = bisect_left(room, (size, -1))
        if j == len(room):
            left, b, bins = capacity, bins, bins + 1
        else:
            left, b = room.pop(j)
        where[i] = b
        if left > size:
            insort(room, (left - size, b))
    return where


def pieces_of(text: str, capacity: int, vocabulary: str) -> list[tuple[int, int, int, int]]:
    """(piece_no, start_char, end_char, n_tokens); more than one piece only for a text beyond the capacity."""
    n = len(text.encode("utf-8", "surrogatepass"))
    if n <= capacity or (tokens := len(encode(vocabulary, text))) <= capacity:
        return [(1, 0, len(text), tokens if n > capacity else len(encode(vocabulary, text)))]
    pos, chars, kind = edges_of(text, vocabulary)
    words, out, a = np.flatnonzero(kind >= WORD), [], 0
    while pos[a] < pos[-1]:
        b = np.searchsorted(pos, pos[a] + capacity, side="right") - 1
        if pos[b] < pos[-1]:
            i = np.searchsorted(words, b, side="right") - 1
            w = words[i] if i >= 0 else a
            b = w if pos[w] > pos[a] + capacity * 63 // 64 else b
        out.append((len(out) + 1, int(chars[a]), int(chars[b]), int(pos[b] - pos[a])))
        a = b
    return out


def _emit(rows: pd.DataFrame, bins: np.ndarray, capacity: int, enough: int, level: int) -> pd.DataFrame:
    task = TaskContext.get()
    rows = rows.assign(container_id=(level << 56) + ((task.partitionId() if task else 0) << 32) + bins)
    rows = rows.sort_values(["container_id", "doc_id", "text_hash", "copy_no", "piece_no"], kind="stable")
    filled = rows.groupby("container_id")["n_tokens"].transform("sum")
    return rows.assign(place=rows.groupby("container_id").cumcount() + 1, filled=filled, done=filled >= enough)[[c.split()[0] for c in _ROWS.split(", ")]]


def _first_round(capacity: int, enough: int, vocabulary: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, seen = [], {}
        for batch in batches:
            for doc, key, text in zip(batch["doc_id"].tolist(), batch["text_hash"].tolist(), batch["text"].tolist()):
                copy = seen[doc, key] = seen.get((doc, key), 0) + 1
                found += [(doc, key, copy, *p) for p in pieces_of(text, capacity, vocabulary)]
        rows = pd.DataFrame(found, columns=["doc_id", "text_hash", "copy_no", "piece_no", "start_char", "end_char", "n_tokens"])
        if len(rows):
            rows = rows.sort_values(["n_tokens", "doc_id", "text_hash", "copy_no", "piece_no"], ascending=[False, True, True, True, True], kind="stable")
            yield _emit(rows, best_fit(rows["n_tokens"].to_numpy(), capacity), capacity, enough, 0)

    return run


def _next_round(capacity: int, enough: int, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = list(batches)
        if not sum(map(len, all_rows)):
            return
        rows = pd.concat(all_rows, ignore_index=True)
        sizes = rows.groupby("container_id")["n_tokens"].sum().reset_index().sort_values(["n_tokens", "container_id"], ascending=[False, True], kind="stable")
        into = pd.Series(best_fit(sizes["n_tokens"].to_numpy(), capacity), index=sizes["container_id"].to_numpy())
        yield _emit(rows, rows["container_id"].map(into).to_numpy(), capacity, enough, level)

    return run


def fill_containers(documents: DataFrame, capacity: int = 4096, nearly_full: float = 0.995, fan_in: int = 8, most_open: int = 40_000, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, place, doc_id, text_hash, copy_no, piece_no, start_char, end_char, n_tokens, filled) per piece.

    Each partition of the scan sizes its texts and packs them best-fit, largest first, without a shuffle. Containers
    filled to `nearly_full` are finished; the others become items of the next round, in which `fan_in` partitions are
    merged into one, and so on up the tree. A task never holds more than about `most_open` open containers: when merging
    no longer closes a hundredth of them, what is left cannot be combined any further in this way and is finished too.

    A text is cut only if it exceeds the capacity (at a word's end if one lies in the last 64th). `filled` is the number
    of tokens in the container. Null and empty texts and null ids need no place; repeated rows each get a place of
    their own; extra columns are ignored; an empty table gives no container.
    """
    enough = ceil(capacity * nearly_full)
    documents = pick(documents, "doc_id", "text")
    texts = documents.filter("text is not null and text <> '' and doc_id is not null").select("doc_id", text_key(), "text")
    packed = cut(texts.mapInPandas(_first_round(capacity, enough, vocabulary), _ROWS))
    parts, level = packed.rdd.getNumPartitions(), 1
    finished, still = packed.filter("done"), packed.filter("not done")
    open_before = still.select("container_id").distinct().count()
    while open_before > 1 and level < 100:
        parts = max(1, ceil(parts / fan_in), ceil(open_before / most_open))
        packed = cut(still.repartition(parts, "container_id").mapInPandas(_next_round(capacity, enough, level), _ROWS))
        finished, still = finished.unionByName(packed.filter("done")), packed.filter("not done")
        count = still.select("container_id").distinct().count()
        if parts == 1 or (parts * most_open <= open_before * 2 and count > open_before * 0.99):
            break
        open_before, level = count, level + 1
    return finished.unionByName(still).drop("done")
