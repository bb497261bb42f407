"""Window functions whose groups may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

#: Bytes of a table's files, as the optimizer bounds them, up to which nothing is counted; and rows that one task may sort.
SMALL_BYTES, HOT_ROWS = 16 << 20, 1_000_000
RANKS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}
KEYS, PART, AT, SIZE = "__w", "__part", "__at", "__size"


def bytes_bound(df: DataFrame) -> int:
    """The optimizer's bound of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def plain_window(kind: str, order: list[Column], keys: list[str], value: Column | None, n: int) -> Column:
    """The window function over whole groups."""
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(*order)
    if kind in RANKS:
        return RANKS[kind]().over(w)
    return F.ntile(n).over(w) if kind == "NTILE" else (F.lag if kind == "LAG" else F.lead)(value, n).over(w)


def large(df: DataFrame, keys: list[str], small_bytes: int, hot_rows: int) -> bool:
    """Whether a group has more rows than one task should sort."""
    if bytes_bound(df) <= small_bytes:
        return False
    return not keys or not df.groupBy(*keys).count().where(F.col("count") > hot_rows).isEmpty()


def window_column(
    df: DataFrame, keys: list[Column], order: list[Column], kind: str, out: str, value: Column | None = None, n: int = 1, small_bytes: int = SMALL_BYTES, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """df with ROW_NUMBER, RANK, DENSE_RANK, NTILE(n), or LAG and LEAD of `value` by n rows, in the groups of `keys`.

    Ties of row numbers are in any order; a null key is a group. Where a group is too large for a task, all rows are sorted by ranges of
    (keys, order), so that equal places lie in one part; parts are ranked apart and shifted by the counts of the group's parts before.
    NTILE follows from row number and group size, LAG and LEAD from the row of the number n before or after.
    """
    names = [f"{KEYS}{i}" for i in range(len(keys))]
    df = df.withColumns(dict(zip(names, keys)))
    kind_of = (lambda c: c) if kind in ("LAG", "LEAD") else (lambda c: c.cast("int" if keys or kind == "NTILE" else "bigint"))
    if not large(df, names, small_bytes, hot_rows):
        return df.withColumn(out, kind_of(plain_window(kind, order, names, value, n))).drop(*names)
    if kind in RANKS:
        return shifted(df, names, order, kind, out).withColumn(out, kind_of(F.col(out))).drop(*names)
    if kind == "NTILE":
        got = shifted(df, names, order, "ROW_NUMBER", AT)
        got = attached(got, df.groupBy(*names).agg(F.count(F.lit(1)).alias(SIZE)), names) if names else got.withColumn(SIZE, F.lit(df.count()))
        few, more = F.floor(F.col(SIZE) / n), F.col(SIZE) % n
        wide = more * (few + 1)
        tile = F.when(F.col(AT) <= wide, F.floor((F.col(AT) - 1) / (few + 1)) + 1).otherwise(more + 1 + F.floor((F.col(AT) - 1 - wide) / F.greatest(few, F.lit(1))))
        return got.withColumn(out, kind_of(tile)).drop(AT, SIZE, *names)
    numbered = materialize(shifted(df.withColumn(out, value), names, order, "ROW_NUMBER", AT), "numbered")
    other = numbered.select(*names, (F.col(AT) + (n if kind == "LAG" else -n)).alias(AT), F.col(out))
    return attached(numbered.drop(out), other, [*names, AT]).drop(AT, *names)


def attached(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join in which a null key matches a null key; `on` columns of the left are kept."""
    r = right.withColumnsRenamed({c: f"{c}_r" for c in on})
    return left.join(r, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on], "left").drop(*[f"{c}_r" for c in on])


def shifted(df: DataFrame, names: list[str], order: list[Column], kind: str, out: str) -> DataFrame:
    """A rank over parts of the sorted rows, shifted by what the same group has in the parts before."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = materialize(df.repartitionByRange(n, *[F.col(c) for c in names], *order).withColumn(PART, F.spark_partition_id()), "ranked")
    ranked = parts.withColumn(out, RANKS[kind]().over(Window.partitionBy(PART, *names).orderBy(*order)))
    size = F.max(out) if kind == "DENSE_RANK" else F.count(F.lit(1))
    sizes = ranked.groupBy(PART, *names).agg(size.alias(SIZE))
    ahead = (Window.partitionBy(*names) if names else Window).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # A group lies in as many parts as there are partitions at most; groups within one part have nothing before.
    before = sizes.select(PART, *names, F.sum(SIZE).over(ahead).alias("__before")).where(F.col("__before").isNotNull())
    before = materialize(before, "before")
    got = attached(ranked, before, [PART, *names])
    return got.withColumn(out, (F.col(out) + F.coalesce("__before", F.lit(0))).cast("bigint")).drop(PART, "__before")
