"""References to records that do not exist, by runs of parent keys.

Keys are integers of up to 128 bits (two signed halves). Consecutive parent keys are compressed into runs: keys that hold from the
beginning of time without end into runs of any length, keys with one period of life each into runs of up to 64 keys that hold
these periods; a key with several lives is one run for each, in the order of (key, time). A reference is matched to the run that
starts last before it and is an orphan if it lies beyond that run's end, or outside the period of its key there. Runs don't cross
the borders of blocks of 2^16 keys, so that blocks are swept apart; blocks with very many references are cut (sweep.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.sweep import HOT_ROWS, hot_groups, neighbours, with_chunks
from docloom.session import materialize

FOREVER = 2**63 - 1
KEY = ["k_hi", "k_lo"]
BLOCK = ["k_hi", "k_block"]
BLOCK_BITS = 16
#: A run that holds periods has at most 2^6 keys, as every place of the line is read with its run.
RUN_BITS = 6
LIVES = "array<struct<at: bigint, until: bigint>>"


def hex_digits(c: Column) -> Column:
    """The 32 hexadecimal digits of a key, upper case; null if the value is no reference (other count, or all zero)."""
    plain = F.translate(F.upper(c), "-{} ", "")  # the usual marks, without a regular expression
    sound = (F.length(plain) == 32) & (F.length(F.translate(plain, "0123456789ABCDEF", "")) == 0)
    h = F.when(sound, plain).otherwise(F.upper(F.regexp_replace(c, "[^0-9A-Fa-f]", "")))
    return F.when((F.length(h) == 32) & (h != "0" * 32), h)


def halves(h: Column) -> list[Column]:
    """k_hi and k_lo of 32 hexadecimal digits."""
    return [F.conv(F.substring(h, a, 16), 16, -10).cast("bigint").alias(n) for a, n in ((1, "k_hi"), (17, "k_lo"))]


def integer_halves(c: Column) -> list[Column]:
    """k_hi and k_lo of an integer key."""
    return [F.when(c.isNotNull(), F.lit(0)).cast("bigint").alias("k_hi"), c.cast("bigint").alias("k_lo")]


def live_runs(parents: DataFrame, tombstones: DataFrame | None = None, hot_rows: int = HOT_ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """Runs k_hi, k_block, k_lo, at, to_lo, to_at, lives in which a record was live, apart for each value of `by`.

    parents: k_hi, k_lo, at (null: since ever); tombstones: k_hi, k_lo, at. A record is live from a row's arrival up to
    a later tombstone of its key (a tombstone at the same moment as a row does not end it). lives has a struct (at, until) for
    each key of a run from k_lo to to_lo; without it the run holds from at to to_at.
    """
    key, block = [*by, *KEY], [*by, *BLOCK]
    rows = parents.select(*key, F.coalesce("at", F.lit(-FOREVER)).alias("at")).groupBy(*key, "at").agg(F.lit(1).alias("born"))
    rows = materialize(rows, "births").where(F.col("k_lo").isNotNull())
    if tombstones is None:
        births = rows.groupBy(*key).agg(F.min("at").alias("at")).withColumns({"until": F.lit(FOREVER), "single": F.lit(True)})
    else:
        ends = tombstones.where(F.col("k_lo").isNotNull() & F.col("at").isNotNull()).groupBy(*key, "at").agg(F.lit(0).alias("born"))
        dead = ends.select(*key).distinct()
        plain = rows.join(dead, key, "left_anti").groupBy(*key).agg(F.min("at").alias("at")).withColumns({"until": F.lit(FOREVER), "single": F.lit(True)})
        # At one moment the tombstone comes first, so that the row there is live.
        events = materialize(rows.join(dead, key, "left_semi").unionByName(ends).groupBy(*key, "at", "born").agg(F.lit(1).alias("one")).drop("one"), "life")
        turns = neighbours(events, key, ["at", "born"], previous={"was": "born"}, hot_rows=hot_rows).where(F.coalesce("was", F.lit(0)) != F.col("born"))
        turns = neighbours(materialize(turns.select(*key, "at", "born"), "turns"), key, ["at", "born"], following={"until": "at"}, hot_rows=hot_rows)
        lived = turns.where("born = 1").select(*key, "at", F.coalesce("until", F.lit(FOREVER)).alias("until"))
        births = plain.unionByName(lived.withColumn("single", F.lit(False)))
    births = births.withColumn("k_block", F.shiftright("k_lo", BLOCK_BITS))
    end = F.col("until") - F.when(F.col("until") == FOREVER, 0).otherwise(1)
    always = F.col("single") & (F.col("at") == -FOREVER)
    none = F.lit(None).cast(LIVES)
    several = births.where(~F.col("single")).select(*block, "k_lo", "at", F.col("k_lo").alias("to_lo"), end.alias("to_at"), none.alias("lives"))
    # Consecutive keys: key minus rank is the same along a run. A block has at most 2^16 keys with one life, so its window is small.
    island = F.col("k_lo") - F.row_number().over(Window.partitionBy(*block, "always").orderBy("k_lo"))
    single = births.where("single").withColumn("always", always).withColumn("i", island)
    part = F.when(F.col("always"), 0).otherwise(F.shiftright("k_lo", RUN_BITS))
    life = F.struct("k_lo", F.struct("at", end.alias("until")).alias("life"))
    runs = single.groupBy(*block, "always", "i", part.alias("part")).agg(F.min("k_lo").alias("k_lo"), F.max("k_lo").alias("to_lo"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max(end).alias("last"), F.collect_list(F.when(~F.col("always"), life)).alias("l"))
    held = ~F.col("always") & (F.col("n") > 1)
    runs = runs.select(
        *block, "k_lo", F.when(held, -FOREVER).otherwise(F.col("first")).alias("at"), "to_lo", F.when(held, FOREVER).otherwise(F.col("last")).alias("to_at"),
        F.when(held, F.transform(F.array_sort("l"), lambda x: x["life"])).cast(LIVES).alias("lives"),
    )
    return several.unionByName(runs)


def orphans(references: DataFrame, parents: DataFrame, tombstones: DataFrame | None = None, hot_rows: int = HOT_ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """The references (k_hi, k_lo, at, and any other columns) for which no record was live at their time.

    References without key or time take no part. Parents as in live_runs; an empty parent table makes every
    reference an orphan. The references are swept once for each distinct key and moment and joined back,
    so that many rows of one key and moment are one. by: columns (not null) of all three tables that tell relations apart,
    which are swept together.
    """
    key, block = [*by, *KEY], [*by, *BLOCK]
    refs = materialize(references, "references").where(F.col("k_lo").isNotNull() & F.col("at").isNotNull())
    runs = live_runs(parents, tombstones, hot_rows, by)
    # At one place of order the run's start comes before the reference: a record of the same moment counts.
    starts = runs.select(*block, "k_lo", "at", F.lit(0).alias("kind"), "to_lo", "to_at", "lives")
    asked = refs.groupBy(*key, "at").agg(F.lit(1).alias("kind")).withColumn("k_block", F.shiftright("k_lo", BLOCK_BITS))
    line = starts.unionByName(asked.select(*block, "k_lo", "at", "kind", *[F.lit(None).cast(t).alias(c) for c, t in (("to_lo", "bigint"), ("to_at", "bigint"), ("lives", LIVES))]))
    life = F.get(F.col("s.lives"), (F.col("k_lo") - F.col("s.k_lo")).cast("int"))
    outside = (F.col("at") < life["at"]) | (F.col("at") > life["until"])
    beyond = F.col("s").isNull() | (F.col("k_lo") > F.col("s.to_lo")) | (F.col("at") > F.col("s.to_at")) | F.coalesce(outside, F.lit(False))
    matched = as_of(line, hot_rows, block).where((F.col("kind") == 1) & beyond).select(*key, "at")
    return refs.join(matched, [*key, "at"], "left_semi")


def as_of(line: DataFrame, hot_rows: int, block: list[str]) -> DataFrame:
    """Each place of the line with the last run that starts up to it: s."""
    order = ["k_lo", "at", "kind"]
    run = F.when(F.col("kind") == 0, F.struct("k_lo", "to_lo", "to_at", "lives"))
    line = materialize(line, "line")
    hot = hot_groups(line, block, hot_rows)
    if hot is None:
        w = Window.partitionBy(*block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        got = line.withColumn("s", F.last(run, ignorenulls=True).over(w))
    else:
        cut = with_chunks(line, block, order, hot, hot_rows)
        w = Window.partitionBy(*block, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        tail = cut.where(F.col("__chunk").isNotNull()).groupBy(*block, "__chunk").agg(F.max_by(run, F.when(F.col("kind") == 0, F.struct(*order))).alias("z"))
        before = Window.partitionBy(*block).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        tail = tail.select(*block, "__chunk", F.last("z", ignorenulls=True).over(before).alias("carried"))
        got = cut.withColumn("s", F.last(run, ignorenulls=True).over(w)).join(materialize(tail, "tail"), [*block, "__chunk"], "left").withColumn("s", F.coalesce("s", "carried"))
    return got.select(*block, *order, "s")


def by_period(found: DataFrame, names: list[str], at: str = "at", unit: str = "month") -> DataFrame:
    """Counts of orphans and of distinct missing keys for each table and period of arrival (its first day as text)."""
    period = F.date_format(F.date_trunc(unit, F.timestamp_micros(F.col(at))), "yyyy-MM-dd")
    each = found.groupBy(*names, period.alias("period"), *KEY).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*names, "period").agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("missing_keys"))
