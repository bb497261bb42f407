"""Neighbours in ordered groups of any size.

A group larger than `hot_rows` is cut into chunks at sampled places of its order, each chunk is swept on
its own, and the ends of the chunks are joined through a small table of edges. No group, however
large, is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialize

#: Rows of a group from which it is cut.
HOT_ROWS = 1_000_000
#: Sampled places of order for each stretch of hot_rows rows.
SAMPLES = 50
#: Chunks of a group at most, as every row is held against its group's cuts; a chunk grows with the group beyond that.
CHUNKS = 256


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """The groups over hot_rows rows, at most count / hot_rows of them; None if there are none. df is stored, so that its rows are soon counted."""
    if df.count() <= hot_rows:
        return None
    hot = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows), "hot")
    return None if hot.isEmpty() else hot


def with_chunks(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame, hot_rows: int) -> DataFrame:
    """df with __chunk (0, 1, ... in the order of a group; null in groups that aren't cut)."""
    step = F.greatest(F.lit(max(1, hot_rows // SAMPLES)), F.floor(F.col("__n") / (CHUNKS * SAMPLES)))
    place = F.struct(*order)
    some = df.join(hot, keys).where(F.pmod(F.xxhash64(*order), step) == 0)
    cuts = some.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("__s"))
    cuts = cuts.select(*keys, F.filter("__s", lambda x, i: i % SAMPLES == 0).alias("__cuts"))
    cuts = materialize(cuts, "cuts")
    return df.join(cuts, keys, "left").withColumn("__chunk", F.size(F.filter("__cuts", lambda x: x <= place)) + F.when(F.col("__cuts").isNull(), F.lit(None))).drop("__cuts")


def neighbours(df: DataFrame, keys: list[str], order: list[str], previous: dict[str, str] | None = None, following: dict[str, str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with columns of the row before (previous: new name -> column) and after (following) in each group.

    keys must not be null; order must be unique in a group. The first row has null for previous ones, the
    last for following ones. df is read more than once: hand in a stored table.
    """
    previous, following = previous or {}, following or {}
    hot = hot_groups(df, keys, hot_rows)
    if hot is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({k: F.lag(c).over(w) for k, c in previous.items()} | {k: F.lead(c).over(w) for k, c in following.items()})
    cut = with_chunks(df, keys, order, hot, hot_rows)
    edge = cut.where(F.col("__chunk").isNotNull()).groupBy(*keys, "__chunk")
    carried = list(dict.fromkeys([*previous.values(), *following.values()]))
    whole = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]).alias("v"))
    edges = edge.agg(F.min(whole).alias("a"), F.max(whole).alias("z"))
    over = Window.partitionBy(*keys).orderBy("__chunk")
    edges = edges.select(*keys, "__chunk", F.lag("z.v").over(over).alias("__before"), F.lead("a.v").over(over).alias("__after"))
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    out = cut.withColumns({"__first": F.lag(F.lit(1)).over(w).isNull(), "__last": F.lead(F.lit(1)).over(w).isNull()} | {k: F.lag(c).over(w) for k, c in previous.items()} | {k: F.lead(c).over(w) for k, c in following.items()})
    out = out.join(materialize(edges, "edges"), [*keys, "__chunk"], "left")
    fix = {k: F.when(F.col("__first"), F.col(f"__before.c{carried.index(c)}")).otherwise(F.col(k)) for k, c in previous.items()}
    fix |= {k: F.when(F.col("__last"), F.col(f"__after.c{carried.index(c)}")).otherwise(F.col(k)) for k, c in following.items()}
    return out.withColumns(fix).drop("__chunk", "__first", "__last", "__before", "__after").select(*df.columns, *previous, *following)
