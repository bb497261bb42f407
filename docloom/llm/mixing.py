"""Mixtures of sources by weighted fair queueing.

The documents of a source are shuffled by a hash; each gets as virtual finish time the tokens of its source up to and
with it, divided by the source's target share. Served in the order of finish times, the sources keep their shares at
every length; a source that has run out after its allowed repeats leaves its room to the others. The order is sorted by
ranges over all partitions and cut where the total budget is used up. Running sums are taken in sorted partitions and
carried over by a table of partition sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import bounded_broadcast, materialize

#: Rows of a partition of the sorted order.
PART_ROWS = 500_000


def running_sum(df: DataFrame, order: list[str], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with the sum of `value` over all rows up to and with each in `order` (which must be unique), within groups `by`.

    The carried table has one row for each partition and group in it.
    """
    by = by or []
    n = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // PART_ROWS)
    parts = df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts, "sorted")
    sums = parts.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(*by).orderBy("__part") if by else Window.orderBy("__part")
    carried = materialize(sums.withColumn("__before", F.sum("__sum").over(w) - F.col("__sum")).drop("__sum"), "carried")
    inner = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn(out, F.sum(value).over(inner)).join(carried, [*by, "__part"]).withColumn(out, F.col(out) + F.col("__before")).drop("__part", "__before")


def mixture(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, n_tokens, repeat_no, finish and place of each use of a document, in the order of `place`.

    sizes: doc_id (unique), source, n_tokens; targets: source, target_share, max_repeats. total: the budget of tokens, by
    default those of all documents of the sources listed. Sources that aren't listed, are null, or have no positive share,
    and documents without tokens take no part. A document is used once in each pass over its source, max_repeats times at
    most (a null counts as 1). The first document that would exceed the budget ends the mixture.
    """
    t = targets.where((F.col("target_share") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
    docs = sizes.select("doc_id", "source", "n_tokens").where(F.col("n_tokens") > 0).join(bounded_broadcast(t), "source")
    docs = docs.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens"), "share", "most", F.xxhash64(F.lit(seed), "doc_id").alias("shuffled"))
    docs = materialize(docs, "sized")
    if total is None:
        total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]
    whole = docs.groupBy("source").agg(F.sum("n_tokens").alias("of_source"))
    line = running_sum(docs, ["shuffled", "doc_id"], "n_tokens", "upto", ["source"]).join(bounded_broadcast(whole), "source")
    finish = (F.col("repeat_no").cast("double") * F.col("of_source") + F.col("upto")) / F.col("share")
    # What ends beyond total / share can't lie within the budget: at least its source's own tokens come before it.
    passes = F.least(F.col("most"), F.ceil(F.lit(total) / F.col("of_source")).cast("int") + 1)
    uses = line.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1))).withColumn("finish", finish)
    uses = uses.where(F.col("repeat_no") * F.col("of_source") + F.col("upto") <= F.lit(total)).select("doc_id", "source", "n_tokens", "repeat_no", "finish")
    uses = materialize(uses, "uses")  # counted, sampled and sorted
    placed = running_sum(uses, ["finish", "source", "doc_id", "repeat_no"], "n_tokens", "place")
    return placed.where(F.col("place") <= F.lit(total))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source of targets: target_share, tokens, actual_share, documents used, uses, most_repeats in a mixture."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.sum(F.when(F.col("repeat_no") == 0, 1).otherwise(0)).alias("documents"), (F.max("repeat_no") + 1).alias("most_repeats"))
    all_tokens = F.sum("tokens").over(Window.partitionBy())
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["tokens", "uses", "documents", "most_repeats"])
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), all_tokens), F.lit(0.0)))
