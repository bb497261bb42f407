"""Joins that keep the matches of a row as an array, and their flat, first, last and counted forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEST, UNWIND, FIRST, LAST, TOTALS = "nest", "unwind", "first", "last", "totals"
ROW = "__row"
MARK = "__order"


def sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return sortable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def gathered(side: str, kind: T.DataType) -> Column:
    """The rows of a group in the order in which they were read."""
    pairs = F.collect_list(F.when(F.col(side).isNotNull(), F.struct(MARK, side)))
    pairs = F.array_sort(pairs) if sortable(kind) else F.array_sort(pairs, lambda a, b: F.when(a[MARK] < b[MARK], -1).otherwise(1))
    return F.transform(pairs, lambda x: x[side])


def picked(mode: str, side: str, kind: T.DataType) -> Column:
    if mode == NEST:
        return gathered(side, kind)
    return (F.min_by if mode == FIRST else F.max_by)(side, MARK)


def totals(fields: list[str]) -> list[Column]:
    """n (rows), and for each field s (sum as double) and c (values that aren't null)."""
    each = [x for i, f in enumerate(fields) for x in (F.sum(F.col(f).cast("double")).alias(f"s{i}"), F.count(f).alias(f"c{i}"))]
    return [F.count(F.lit(1)).cast("int").alias("n"), *each]


def by_keys(left: DataFrame, left_keys: list[Column], right: DataFrame, right_keys: list[Column], side: str, how: str, mode: str, fields: list[str]) -> DataFrame:
    """left with the rows of right of equal keys in column `side`, of which the columns `fields` are kept.

    The right side is reduced by key before it is joined, so that left rows are neither multiplied nor regrouped. how:
    inner or left, and full for unwind. A null key matches nothing. Without matches a left join has an empty array
    (nest), zeros (totals) or null. Nested rows, first and last are in the order in which right is read. The array of a key
    is one value, as long as the key has rows; `totals` (see above) makes none and is reduced before the shuffle.
    """
    names = [f"__k{i}" for i in range(len(right_keys))]
    keyed = right.select(*[k.alias(n) for k, n in zip(right_keys, names)], F.struct(*fields).alias(side), *([F.monotonically_increasing_id().alias(MARK)] if mode not in (UNWIND, TOTALS) else []))
    if mode == TOTALS:
        keyed = right.select(*[k.alias(n) for k, n in zip(right_keys, names)], *fields).groupBy(*names).agg(*totals(fields))
        keyed = keyed.select(*names, F.struct(*[c for c in keyed.columns if c not in names]).alias(side))
    elif mode != UNWIND:
        keyed = keyed.groupBy(*names).agg(picked(mode, side, keyed.schema[side].dataType).alias(side))
    lk = [f"__l{i}" for i in range(len(left_keys))]
    both = left.withColumns(dict(zip(lk, left_keys)))
    on = [F.col(a) == F.col(b) for a, b in zip(lk, names)]
    out = both.join(keyed, on, how).drop(*names, *lk)
    if how == "left" and mode in (NEST, TOTALS):
        kind = out.schema[side].dataType
        none = F.array().cast(kind) if mode == NEST else F.struct(*[F.lit(0.0 if f.name[0] == "s" else 0).cast(f.dataType).alias(f.name) for f in kind.fields])
        out = out.withColumn(side, F.coalesce(side, none))
    return out


def by_condition(left: DataFrame, right: DataFrame, condition: Column, side: str, how: str, mode: str, fields: list[str]) -> DataFrame:
    """The same for any condition, in which the right row is the struct column `side`.

    Rows of left are numbered, joined by whatever way the condition allows, and put together again by their number.
    """
    if mode == UNWIND:
        return left.join(right.select(F.struct(*fields).alias(side)), condition, how)
    r = right.select(F.struct(*fields).alias(side), F.monotonically_increasing_id().alias(MARK))
    numbered = left.withColumn(ROW, F.monotonically_increasing_id())
    joined = numbered.join(r, condition, how)
    rest = F.first(F.struct(*[F.col("`" + c + "`") for c in left.columns])).alias("__left")
    return joined.groupBy(ROW).agg(rest, picked(mode, side, r.schema[side].dataType).alias(side)).select("__left.*", side)
