"""Rows of a field-change log as typed attribute events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.instants import FeedZones, InstantDictionary
from docloom.operators.typed_values import canonical, folded, is_clear
from docloom.operators.wide import attribute_map
from docloom.session import bounded_broadcast, materialize


def value_of(c: Column, value_type: Column) -> Column:
    """canonical() of c unless it clears; inside a lambda, so that the text is evaluated once."""
    return F.get(F.transform(F.array(c), lambda v: F.when(~is_clear(v), canonical(v, value_type))), F.lit(0))


def typed_events(changes: DataFrame, fields: dict[str, str], dictionary: InstantDictionary, keep: list[str] | None = None) -> DataFrame:
    """entity, attribute, version, row_id, value, old_value, written, old_written of the changes that take part.

    changes has _id, ParentId, Field, OldValue, NewValue, CreatedDate, feed_code, all text. Without part are rows of
    unknown fields, of values that can't be read as the field's type, of dates that denote no single instant,
    and rows without ParentId. value is null where the row clears; old_value is null where it is clear or can't be read.
    keep: further columns of changes. Those two are for comparison, written and old_written what they stand for: texts as the row has them, with their
    letter case and outer blanks, values of other types in the same form as value.
    """
    known = attribute_map(fields)
    named = changes.select(
        F.col("_id").alias("row_id"), folded(F.col("ParentId")).alias("entity"), F.try_element_at(known, folded(F.col("Field"))).alias("f"),
        F.col("NewValue").alias("nv"), F.col("OldValue").alias("ov"), F.col("CreatedDate").alias("raw"), F.col("feed_code").alias("feed"), *(keep or []),
    ).where(F.col("f").isNotNull() & F.col("entity").isNotNull())
    # Stored before it is filtered: the texts are read as values once only.
    typed = materialize(
        named.select(
            *(keep or []), "row_id", "entity", F.col("f.name").alias("attribute"), "raw", "feed", is_clear(F.col("nv")).alias("clear"),
            value_of(F.col("nv"), F.col("f.type")).alias("value"), value_of(F.col("ov"), F.col("f.type")).alias("old_value"),
            *[F.when(F.col("f.type") == "text", F.col(c)).alias(f"{c}_text") for c in ("nv", "ov")],
        ),
        "typed",
    ).where(F.col("clear") | F.col("value").isNotNull())
    dictionary.add(typed.select("raw", "feed"))
    timed = dictionary.match(typed, "raw", "feed", "version").where(F.col("version").isNotNull())
    shown = [F.when(F.col(c).isNotNull(), F.coalesce(text, c)).alias(name) for c, text, name in (("value", "nv_text", "written"), ("old_value", "ov_text", "old_written"))]
    return timed.select(*(keep or []), "entity", "attribute", "version", "row_id", "value", "old_value", *shown)


#: Batches into which a table is cut at least and at most, and rows of a batch between these.
LEAST_BATCHES, MOST_BATCHES, BATCH_ROWS = 3, 64, 50_000_000


def batched(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with `batch`, the number of the stretch of the table they lie in (files in the order of their names), and how many there are.

    As a log would have brought them: a file, or a part of a large one, after the other.
    """
    file, place = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos")
    n = materialize(rows.select(file).groupBy("__file").agg(F.count(F.lit(1)).alias("n")), "files")
    total = n.agg(F.sum("n").alias("t")).first()["t"] or 0
    k = min(MOST_BATCHES, max(LEAST_BATCHES, -(-total // BATCH_ROWS)))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = n.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    both = rows.select("*", file, place).join(bounded_broadcast(starts), "__file")
    return both.withColumn("batch", F.floor((F.col("__start") + F.col("__pos")) * k / F.lit(max(1, total))).cast("int")).drop("__file", "__pos", "__start"), k


def event_batches(changes: DataFrame, fields: dict[str, str], dictionary: InstantDictionary) -> list[DataFrame]:
    """typed_events() of a table in batches; the texts are read as values once, and stored."""
    rows, k = batched(changes)
    events = materialize(typed_events(rows, fields, dictionary, ["batch"]), "events", ["batch"])
    return [events.where(F.col("batch") == b).drop("batch") for b in range(k)]


def offer_fields(table: DataFrame) -> dict[str, str]:
    """field_name -> value_type of the reference table of attributes (its rows are columns of the wide table)."""
    return {r.field_name.strip(): r.value_type for r in table.select("field_name", "value_type").orderBy("field_name").collect()}


def dictionary_for(feed_zones: DataFrame) -> InstantDictionary:
    return InstantDictionary(feed_zones.sparkSession, FeedZones.load(feed_zones))
