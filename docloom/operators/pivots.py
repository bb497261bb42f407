"""Rows to columns and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, key: Column, values: list, aggregates: list[tuple[str, object]]) -> DataFrame:
    """One row with a column for each listed value: the aggregate of its rows, or a struct of several; null without rows.

    aggregates: (alias, function of a row condition to a Column). All are taken in one pass over df.
    """
    cols = []
    for v in values:
        at = key == F.lit(v)
        n = F.count_if(at)
        made = [F.when(n > 0, make(at)).alias(name) for name, make in aggregates]
        cols.append((made[0] if len(made) == 1 else F.struct(*made)).alias(str(v)))
    return df.agg(*cols)


def unpivot(df: DataFrame, sets: list[tuple[str, str, list[str]]]) -> DataFrame:
    """A row for each listed column, other columns repeated. sets: (value column, name column, columns); several are zipped."""
    used = {c for _, _, cols in sets for c in cols}
    rest = [F.col("`" + c + "`") for c in df.columns if c not in used]
    n = max(len(cols) for _, _, cols in sets)
    rows = []
    for i in range(n):
        parts = []
        for value, name, cols in sets:
            there = i < len(cols)
            parts += [(F.lit(cols[i]) if there else F.lit(None).cast("string")).alias(name), (F.col("`" + cols[i] + "`") if there else F.lit(None)).alias(value)]
        rows.append(F.struct(*parts))
    return df.select(*rest, F.inline(F.array(*rows)))
