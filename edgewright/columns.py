"""Picking an operator's own columns out of tables that may carry others."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pick(df: DataFrame, *names: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the named columns, by exact spelling; others are dropped, whatever their names.

    Columns whose names differ only in case, or stand twice, would be ambiguous: they are told apart by position, an
    exact spelling (the first of equals) before another. A missing column is an error unless optional.
    """
    have = df.columns
    lower = [c.lower() for c in have]
    if len(set(lower)) == len(lower):
        return df.select(*[n for n in names if n not in optional or n.lower() in lower])
    places = {}
    for n in names:
        at = [i for i, c in enumerate(have) if c == n] or [i for i, c in enumerate(lower) if c == n.lower()]
        if at:
            places[n] = at[0]
        elif n not in optional:
            raise ValueError(f"no column {n} among {have}")
    return df.toDF(*[f"_{i}" for i in range(len(have))]).selectExpr(*[f"_{i} as `{n}`" for n, i in places.items()])
