"""Attribute-value rows to wide tables, as log-structured upserts.

Each batch becomes a sparse wide delta: one row an entity, one cell a touched attribute, each cell with
its own version. Deltas are stored as runs, all cut into the same buckets of entities and sorted by entity in each; compaction merges
the runs bucket by bucket, without a shuffle, and keeps the latest version of each cell. A batch is reduced before it is
shuffled, so that an entity with very many rows is one row of each task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.typed_values import SPARK_TYPES
from docloom.session import work_path


def cell_column(i: int) -> str:
    return f"cell_{i}"


class WideStore:
    """A wide table of entities, kept as runs of sparse deltas.

    fields: attribute -> value type. A cell is struct(v: negative version, r: row id, x: value), so that
    the least struct is the latest version and, of several, that of the smallest row id.
    """

    def __init__(self, spark: SparkSession, fields: dict[str, str], path: str | None = None):
        self.spark, self.fields, self.path = spark, dict(fields), path or work_path(spark, "wide")
        self.runs: list[str] = []
        self.written, self.name = 0, f"docloom_wide_{uuid.uuid4().hex[:12]}"
        self.columns = [cell_column(i) for i in range(len(self.fields))]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def delta(self, rows: DataFrame) -> DataFrame:
        """The sparse delta of rows with entity, attribute, version (bigint), row_id, value (null clears).

        Rows without entity or version, and those of attributes that aren't fields, take no part. Of rows of one version the
        smallest row_id holds; repeated rows change nothing; other columns are not read; no rows give no delta rows.
        """
        cell = F.struct((-F.col("version")).alias("v"), F.col("row_id").alias("r"), F.col("value").alias("x"))
        cells = [F.min(F.when(F.col("attribute") == f, cell)).alias(cell_column(i)) for i, f in enumerate(self.fields)]
        known = rows.where(F.col("entity").isNotNull() & F.col("version").isNotNull() & F.col("attribute").isin(*self.fields))
        return known.groupBy("entity").agg(*cells)

    def _write(self, cells: DataFrame) -> str:
        """A run: an external table whose files lie under `path`, in buckets of entities sorted by entity."""
        self.written += 1
        run = f"{self.name}_{self.written:05d}"
        cells.write.format("parquet").bucketBy(self.buckets, "entity").sortBy("entity").option("path", f"{self.path}/{run}").saveAsTable(run)
        return run

    def upsert(self, rows: DataFrame) -> None:
        """Append a batch as a new sorted run."""
        self.runs.append(self._write(self.delta(rows)))

    def cells(self) -> DataFrame:
        """One row an entity with the latest version of each cell over all runs."""
        if not self.runs:
            cols = ", ".join(f"{cell_column(i)} struct<v:bigint,r:string,x:string>" for i in range(len(self.fields)))
            return self.spark.createDataFrame([], "entity string, " + cols)
        if len(self.runs) == 1:
            return self.spark.table(self.runs[0])
        # Their files, not the tables: a union of bucketed scans would be taken for bucketed itself and not be put together.
        runs = self.spark.read.parquet(*[f"{self.path}/{r}" for r in self.runs])
        return runs.groupBy("entity").agg(*[F.min(c).alias(c) for c in self.columns])

    def merged(self, a: str, b: str) -> DataFrame:
        """The latest version of each cell of two runs, which are joined bucket by bucket in the order they are stored in."""
        x, y = self.spark.table(a), self.spark.table(b).withColumnsRenamed({c: f"{c}_b" for c in ("entity", *self.columns)})
        both = x.join(y.hint("merge"), F.col("entity") == F.col("entity_b"), "full_outer")
        return both.select(F.coalesce("entity", "entity_b").alias("entity"), *[F.least(c, f"{c}_b").alias(c) for c in self.columns])

    def compact(self) -> DataFrame:
        """Replace the runs by one, merging two neighbours at a time; the files of the old ones stay for those who still read them."""
        while len(self.runs) > 1:
            pairs = [self.runs[i : i + 2] for i in range(0, len(self.runs), 2)]
            self.runs = [self._write(self.merged(*p)) if len(p) == 2 else p[0] for p in pairs]
            for old in (r for p in pairs if len(p) == 2 for r in p):
                self.spark.sql(f"DROP TABLE {old}")  # of the catalog only
        return self.cells()

    def wide(self, cells: DataFrame | None = None) -> DataFrame:
        """entity and one typed column for each attribute; a cleared or never given attribute is null."""
        src = self.cells() if cells is None else cells
        cols = [F.col(f"{cell_column(i)}.x").cast(SPARK_TYPES[t]).alias(f) for i, (f, t) in enumerate(self.fields.items())]
        return src.select("entity", *cols)

    def filled(self, cells: DataFrame | None = None) -> DataFrame:
        """entity, attribute, row_id of each cell that holds a value."""
        src = self.cells() if cells is None else cells
        each = F.array(*[F.struct(F.lit(f).alias("attribute"), F.col(cell_column(i)).alias("cell")) for i, f in enumerate(self.fields)])
        return src.select("entity", F.explode(F.filter(each, lambda x: x["cell"]["x"].isNotNull())).alias("e")).select("entity", "e.attribute", F.col("e.cell.r").alias("row_id"))


def attribute_map(fields: dict[str, str]) -> Column:
    """Folded attribute name -> struct(name as in fields, type)."""
    pairs = [x for f, t in fields.items() for x in (F.lit(f.strip().lower()), F.struct(F.lit(f).alias("name"), F.lit(t).alias("type")))]
    return F.create_map(*pairs)
