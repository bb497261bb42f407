"""History of changing attributes as a bitemporal ledger.

Every event (a row that sets or clears an attribute) has one segment of valid time, from its instant to that
of the next event. A batch of events is recorded at a number that grows; where a late event falls into
a segment known before, the sweep splits it and appends a new version of the segment. Nothing is
overwritten: the version of a segment that held at recorded time r is the last one recorded up to r.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.sweep import HOT_ROWS, neighbours
from docloom.session import materialize, work_path

GROUP = ["entity", "attribute"]
ORDER = ["valid_from", "row_id"]
EVENT = "entity string, attribute string, valid_from bigint, row_id string, value string, old_value string, written string, old_written string"
SEGMENT = EVENT + ", next_from bigint, next_row string, recorded bigint"


class Ledger:
    """Append-only segments under `path`, one folder for each recorded batch."""

    def __init__(self, spark: SparkSession, path: str | None = None, hot_rows: int = HOT_ROWS):
        self.spark, self.path, self.hot_rows = spark, path or work_path(spark, "ledger"), hot_rows
        self.batches: list[str] = []

    def versions(self) -> DataFrame:
        """All segment versions with recorded and superseded (null while it holds)."""
        if not self.batches:
            return self.spark.createDataFrame([], SEGMENT).withColumn("superseded", F.lit(None).cast("bigint"))
        w = Window.partitionBy(*GROUP, "row_id").orderBy("recorded")
        return self.spark.read.schema(SEGMENT).parquet(*self.batches).withColumn("superseded", F.lead("recorded").over(w))

    def current(self, as_recorded: int | None = None) -> DataFrame:
        """The segments believed now, or at an earlier recorded time."""
        if len(self.batches) <= 1 and as_recorded is None:
            return self.versions().drop("superseded") if not self.batches else self.spark.read.schema(SEGMENT).parquet(*self.batches)
        v = self.versions() if as_recorded is None else self._upto(as_recorded)
        return v.where(F.col("superseded").isNull()).drop("superseded")

    def _upto(self, recorded: int) -> DataFrame:
        w = Window.partitionBy(*GROUP, "row_id").orderBy("recorded")
        old = self.spark.read.schema(SEGMENT).parquet(*self.batches).where(F.col("recorded") <= recorded) if self.batches else self.versions().drop("superseded")
        return old.withColumn("superseded", F.lead("recorded").over(w))

    def record(self, events: DataFrame) -> None:
        """Take in a batch with entity, attribute, valid_from, row_id, value, old_value (row_id unique).

        value and old_value are compared; written and old_written, where the batch has them, are what they stand for.
        Rows without entity, attribute or valid_from take no part; a row id that is known is a repeat and ignored.
        """
        now = len(self.batches) + 1
        events = events.withColumns({c: F.col(v) for c, v in (("written", "value"), ("old_written", "old_value")) if c not in events.columns})
        new = events.where("entity is not null and attribute is not null and valid_from is not null and row_id is not null")
        new = new.select(*[x.split()[0] for x in EVENT.split(", ")], *[F.lit(None).cast(t).alias(c) for c, t in (("next_from", "bigint"), ("next_row", "string"), ("recorded", "bigint"))])
        both = self._stored().unionByName(new) if self.batches else new
        if self._small(new):
            swept = self._swept(both)
        else:
            if self.batches:
                touched = new.select(*GROUP).distinct()
                old = self.current().join(touched, GROUP, "left_semi")
                both = old.unionByName(new.join(old.select(*GROUP, "row_id"), [*GROUP, "row_id"], "left_anti"))
            both = materialize(both.dropDuplicates([*GROUP, "row_id"]), "events")
            swept = neighbours(both, GROUP, ORDER, following={"n_from": "valid_from", "n_row": "row_id"}, hot_rows=self.hot_rows)
        changed = swept.where(F.col("recorded").isNull() | ~F.col("next_row").eqNullSafe(F.col("n_row")))
        out = f"{self.path}/recorded-{now:06d}"
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        changed.withColumns({"next_from": F.col("n_from"), "next_row": F.col("n_row"), "recorded": F.lit(now).cast("bigint")}).select(*names).write.parquet(out)
        self.batches.append(out)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT).parquet(*self.batches)

    def _small(self, new: DataFrame | None = None) -> bool:
        """Whether no group can have more rows than one task should sort, as the table and the batch, which are stored, have no more."""
        rows = self._stored().count() if self.batches else 0
        return rows <= self.hot_rows and (new is None or rows + new.count() <= self.hot_rows)

    @staticmethod
    def _swept(both: DataFrame) -> DataFrame:
        """The last version of each row, or the row itself if it is new, with the one that follows in its group: one exchange."""
        newest = Window.partitionBy(*GROUP, "row_id").orderBy(F.col("recorded").desc_nulls_last())
        own = both.repartition(*[F.col(c) for c in GROUP]).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
        w = Window.partitionBy(*GROUP).orderBy(*ORDER)
        return own.withColumns({"n_from": F.lead("valid_from").over(w), "n_row": F.lead("row_id").over(w)})

    def history(self, as_recorded: int | None = None) -> DataFrame:
        """The periods in which an attribute held one value: entity, attribute, value, written, from_row_id, to_row_id, valid_from, valid_to.

        Events that repeat the value in force are merged into its period, which has the first one's written; cleared
        stretches are no periods. The old_value of the first event is a period before it, with from_row_id '' and
        valid_from null. to_row_id is '' and valid_to null while the value holds.
        """
        small = self._small()
        kept = [*GROUP, *ORDER, "value", "old_value", "written", "old_written"]
        if small and self.batches:
            upto = self._stored() if as_recorded is None else self._stored().where(F.col("recorded") <= as_recorded)
            w = Window.partitionBy(*GROUP).orderBy(*ORDER)
            lagged = self._swept(upto).select(*kept).withColumns({"p_row": F.lag("row_id").over(w), "p_value": F.lag("value").over(w)})
        else:
            seg = materialize(self.current(as_recorded).select(*kept), "segments")
            lagged = neighbours(seg, GROUP, ORDER, previous={"p_row": "row_id", "p_value": "value"}, hot_rows=self.hot_rows)
        first = F.col("p_row").isNull()
        lagged = lagged.withColumn("before", F.when(first, F.col("old_value")).otherwise(F.col("p_value")))
        start = F.struct(F.lit(None).cast("bigint").alias("valid_from"), F.lit("").alias("row_id"), F.col("old_value").alias("value"), F.col("old_written").alias("written"))
        own = F.struct("valid_from", "row_id", "value", "written")
        moves = F.filter(F.array(F.when(first & F.col("old_value").isNotNull(), start), F.when(~F.col("before").eqNullSafe(F.col("value")), own)), lambda x: x.isNotNull())
        changes = lagged.select(*GROUP, F.explode(moves).alias("m")).select(*GROUP, "m.*").withColumn("at", F.coalesce("valid_from", F.lit(-(2**63))))
        following = {"to_row_id": "row_id", "valid_to": "valid_from"}
        if small:
            w = Window.partitionBy(*GROUP).orderBy("at", "row_id")
            out = changes.withColumns({k: F.lead(c).over(w) for k, c in following.items()})
        else:
            out = neighbours(materialize(changes, "changes"), GROUP, ["at", "row_id"], following=following, hot_rows=self.hot_rows)
        return out.where(F.col("value").isNotNull()).select(*GROUP, "value", "written", F.col("row_id").alias("from_row_id"), F.coalesce("to_row_id", F.lit("")).alias("to_row_id"), "valid_from", "valid_to")
