"""Column profiles from file footers and dictionaries, with scans only where these don't suffice.

Footers give exact nulls and extrema of a chunk, dictionary pages its candidate values. A chunk of one load
with at most one value is counted from these alone; other chunks are scanned, row group by row group and for the profiled columns
only, into value counts by load, from which shares, distinct counts, ranges and medians follow. Rows that break a
pattern are looked for only in chunks with a dictionary entry that breaks it, or without a full dictionary. Files of which every
chunk needs a scan, whose store only Spark can open, or of tables whose load is a folder, are scanned by Spark as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.operators.footers import chunk_statistics, each_group, read_group
from docloom.session import materialize

#: Distinct numbers of a load that one task may order.
FEW = 100_000
BINS = 1024


@dataclass(frozen=True)
class Rule:
    """What a column's values should look like: a list of codes, or a pattern of numbers."""

    column: str
    codes: tuple[str, ...] = ()
    number: str = ""
    missing: tuple[str, ...] = ("", "NULL")

    def is_missing(self, c: Column) -> Column:
        return F.coalesce(c.isin(*self.missing), F.lit(True))

    def well_formed(self, c: Column) -> Column:
        return F.coalesce(c.isin(*self.codes) if self.codes else c.rlike(self.number), F.lit(False))

    def breaking(self, c: pa.ChunkedArray) -> pa.ChunkedArray:
        """Which values are neither missing nor well-formed, outside the JVM."""
        there = pc.invert(pc.or_kleene(pc.is_null(c), pc.is_in(c, pa.array(self.missing, pa.string()))))
        good = pc.is_in(c, pa.array(self.codes, pa.string())) if self.codes else pc.fill_null(pc.match_substring_regex(c, self.number), False)
        return pc.and_(there, pc.invert(good))


@dataclass(frozen=True)
class Limits:
    """From which difference on a load is reported."""

    rows: int = 100
    missing_percent: int = 15
    code_percent: int = 15
    median_factor: int = 5


class Profile:
    """Profile of text columns of a Parquet table.

    path: the table; load: integer column that tells loads apart (a null load counts among all rows only).
    An empty table has no cases; a column that a file lacks is null there.
    """

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule], load: str = "load_no"):
        self.spark, self.path, self.rules, self.load = spark, path, rules, load
        self.rows = spark.read.parquet(path)
        self.files = sorted(self.rows.inputFiles())
        self._base = {"basePath": path} if len(self.files) > 1 else {}  # keeps columns that are folders
        self.chunks = materialize(chunk_statistics(spark, self.files, [r.column for r in rules], load), "chunks")
        self._counts: DataFrame | None = None
        # Chunks that a task may read by itself: texts, of a load that lies in the file, and a footer that was read.
        texts = [r.column for r in rules if r.column in self.rows.columns and isinstance(self.rows.schema[r.column].dataType, T.StringType)]
        foldered = any(f"/{c}=" in f for f in self.files[:1] for c in self.rows.columns)
        whole = isinstance(self.rows.schema[load].dataType, T.IntegralType) and not foldered if load in self.rows.columns else False
        self._own = F.lit(whole) & F.col("n_rows").isNotNull() & F.col("column_name").isin(texts)

    def _plan(self, settled: Column) -> DataFrame:
        """The chunks with `how` they are treated: known (settled by their footer), group (a task reads the row group), file (Spark scans it)."""
        at = ["file", "column_name"]
        files = self.chunks.groupBy(*at).agg(F.bool_and(self._own).alias("own"), F.count(F.lit(1)).alias("n_all"), F.count_if(settled).alias("n_settled"))
        none, every = F.col("n_settled") == 0, F.col("n_settled") == F.col("n_all")
        how = F.when(every, "known").when(none | ~F.col("own"), "file").when(settled, "known").otherwise("group")
        return self.chunks.join(files, at).withColumn("how", how).drop("own", "n_all", "n_settled")

    @staticmethod
    def _named(chunks: DataFrame) -> list[str]:
        """Names of files, as many as the table has at most, which the driver lists anyway."""
        return [r.file for r in chunks.where("how = 'file'").select("file").distinct().collect()]

    def footers(self) -> DataFrame:
        """For each column: rows, nulls, least and greatest text, distinct candidates, from footers and dictionaries alone.

        A figure is null where a chunk of the column does not state it. Candidates are the entries of all dictionaries.
        """
        c = self.chunks
        bare = F.col("n_nulls") == F.col("n_rows")
        told = F.bool_and(F.coalesce(bare | F.col("min_value").isNotNull(), F.lit(False)))
        bounds = c.groupBy("column_name").agg(
            F.sum("n_rows").alias("n_rows"), F.when(F.bool_and(F.col("n_nulls").isNotNull()), F.sum("n_nulls")).alias("n_nulls"),
            F.when(told, F.min("min_value")).alias("least"), F.when(told, F.max("max_value")).alias("greatest"), F.bool_and("complete").alias("complete"),
        )
        entries = c.select("column_name", F.explode("candidates").alias("x")).distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
        out = bounds.join(entries, "column_name", "left")
        return out.select("column_name", "n_rows", "n_nulls", "least", "greatest", F.when(F.col("complete"), F.coalesce("n", F.lit(0))).alias("n_candidates"))

    def counts(self) -> DataFrame:
        """column_name, load, value, n over all rows of the table."""
        if self._counts is None:
            bare = (F.col("n_nulls") == F.col("n_rows")) | ((F.col("n_nulls") == 0) & F.col("complete") & (F.size("candidates") == 1))
            enough = F.coalesce((F.col("group_min") == F.col("group_max")) & bare, F.lit(False))
            parts = []
            plan = materialize(self._plan(enough), "plan")
            known = plan.where("how = 'known'")
            parts.append(known.select("column_name", F.col("group_min").cast("bigint").alias("load"), F.get("candidates", F.lit(0)).alias("value"), F.col("n_rows").alias("n")))
            load = self.load

            def count(file: str, group: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
                t = read_group(file, group, [load, *columns])
                for c in columns:
                    n = t.select([load, c]).rename_columns(["load", "value"]).group_by(["load", "value"]).aggregate([([], "count_all")])
                    cols = [pa.array([c] * n.num_rows, pa.string()), n["load"].cast(pa.int64()), n["value"].cast(pa.string()), n["count_all"]]
                    yield from pa.table(cols, names=["column_name", "load", "value", "n"]).combine_chunks().to_batches()

            some = plan.where("how = 'group'")
            if not some.isEmpty():
                parts.append(each_group(some, count, "column_name string, load bigint, value string, n bigint"))
            scans: dict[tuple[str, ...], list[str]] = {}
            for r in plan.where("how = 'file'").groupBy("file").agg(F.array_sort(F.collect_set("column_name")).alias("c")).collect():
                scans.setdefault(tuple(r.c), []).append(r.file)
            for columns, files in scans.items():
                have = [c for c in columns if c in self.rows.columns]
                each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in have])
                part = self.spark.read.options(**self._base).schema(self.rows.schema).parquet(*files).select(F.col(self.load).cast("bigint").alias("load"), F.explode(each).alias("e"))
                parts.append(part.groupBy("e.column_name", "load", "e.value").agg(F.count(F.lit(1)).alias("n")))
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            self._counts = materialize(out.groupBy("column_name", "load", "value").agg(F.sum("n").alias("n")), "counts")
        return self._counts

    def summary(self) -> DataFrame:
        """For each column and load, and for all rows (is_total): rows, missing, distinct, breaking, least and greatest value."""
        c = self.counts()
        whole = c.groupBy("column_name", "value").agg(F.sum("n").alias("n")).select("column_name", F.lit(None).cast("bigint").alias("load"), "value", "n", F.lit(True).alias("is_total"))
        both = c.withColumn("is_total", F.lit(False)).unionByName(whole)
        out = None
        for r in self.rules:
            v = F.col("value")
            miss = r.is_missing(v)
            one = both.where(F.col("column_name") == r.column).groupBy("column_name", "load", "is_total").agg(
                F.sum("n").alias("n_rows"), F.sum(F.when(miss, F.col("n")).otherwise(0)).alias("n_missing"), F.count_if(~miss).alias("n_distinct"),
                F.sum(F.when(~miss & ~r.well_formed(v), F.col("n")).otherwise(0)).alias("n_breaking"), F.min(F.when(~miss, v)).alias("least"), F.max(F.when(~miss, v)).alias("greatest"),
            )
            out = one if out is None else out.unionByName(one)
        return out

    def breaking_rows(self, keep: list[str]) -> DataFrame:
        """column_name and the columns `keep` of each row whose value is neither missing nor well-formed."""
        out = None
        for r in self.rules:
            value = F.col("__x")
            suspect = F.exists("candidates", lambda x: ~r.is_missing(x) & ~r.well_formed(x)) | ~F.col("complete")
            plan = materialize(self._plan(~F.coalesce(suspect, F.lit(True))).where(F.col("column_name") == r.column), "plan")
            shape = self.rows.select(F.lit(r.column).alias("column_name"), *keep).schema
            arrow = to_arrow_schema(shape)

            def find(file: str, group: int, columns: list[str], r=r, arrow=arrow) -> Iterator[pa.RecordBatch]:
                t = read_group(file, group, [*dict.fromkeys([*keep, r.column])])
                t = t.filter(r.breaking(t[r.column].cast(pa.string())))
                cols = [pa.array([r.column] * t.num_rows, pa.string()), *[t[k].cast(arrow.field(k).type) for k in keep]]
                yield from pa.table(cols, schema=arrow).combine_chunks().to_batches()

            some, files = plan.where("how = 'group'"), self._named(plan)
            part = each_group(some, find, shape.simpleString()) if not files or not some.isEmpty() else None
            if files:
                rows = self.spark.read.options(**self._base).schema(self.rows.schema).parquet(*files).select(*keep, F.col(r.column).cast("string").alias("__x"))
                scanned = rows.where(~r.is_missing(value) & ~r.well_formed(value)).select(F.lit(r.column).alias("column_name"), *keep)
                part = scanned if part is None else part.unionByName(scanned)
            out = part if out is None else out.unionByName(part)
        return self.rows.select(F.lit("").alias("column_name"), *keep).limit(0) if out is None else out

    def shifted_loads(self, limits: Limits = Limits()) -> DataFrame:
        """column_name, load of each load whose distribution differs from that of all rows by `limits`."""
        out = None
        for r in self.rules:
            c = self.counts().where(F.col("column_name") == r.column)
            part = self._shifted(r, c, limits).select(F.lit(r.column).alias("column_name"), "load")
            out = part if out is None else out.unionByName(part)
        return out

    def _shifted(self, r: Rule, c: DataFrame, limits: Limits) -> DataFrame:
        v, n = F.col("value"), F.col("n")
        big = lambda x: F.col(x).cast("decimal(38,0)")
        sums = [F.sum(n).alias("rows"), F.sum(F.when(r.is_missing(v), n).otherwise(0)).alias("missing")]
        sums += [F.sum(F.when(v == code, n).otherwise(0)).alias(f"c{i}") for i, code in enumerate(r.codes)]
        each = c.where(F.col("load").isNotNull()).groupBy("load").agg(*sums)
        total = c.agg(*sums).first()  # one row
        for name in ("rows", "missing", *[f"c{i}" for i in range(len(r.codes))]):
            each = each.withColumn(f"all_{name}", F.lit(total[name]))
        both = each.where(F.col("rows") >= limits.rows)
        differs = (big("missing") * big("all_rows") - big("all_missing") * big("rows")) * 100 >= big("rows") * big("all_rows") * limits.missing_percent
        there, all_there = big("rows") - big("missing"), big("all_rows") - big("all_missing")
        for i in range(len(r.codes)):
            gap = F.abs(big(f"c{i}") * all_there - big(f"all_c{i}") * there) * 100
            differs = differs | ((there > 0) & (gap >= there * all_there * limits.code_percent))
        if r.number:
            numbers = c.where(~r.is_missing(v) & r.well_formed(v)).select("load", as_number(v).alias("v"), "n")
            m = materialize(medians(numbers), "medians")
            middle = m.where("load = -1").first()
            both = both.join(m.where("load >= 0"), "load", "left").withColumn("all_median", F.lit(middle["median"] if middle else None).cast("decimal(38,6)"))
            k = limits.median_factor
            differs = differs | F.coalesce((F.col("median") >= F.col("all_median") * k) | (F.col("median") * k <= F.col("all_median")), F.lit(False))
        return both.where(differs)


def as_number(c: Column) -> Column:
    """decimal(38,4) of well-formed digits; beyond 26 digits before the point, the 10^26 of its sign."""
    far = F.when(c.startswith("-"), F.lit("-1" + "0" * 26)).otherwise(F.lit("1" + "0" * 26))
    return F.coalesce(c.try_cast("decimal(30,4)").cast("decimal(38,4)"), far.cast("decimal(38,4)"))


def medians(numbers: DataFrame) -> DataFrame:
    """load, median of weighted numbers (load, v, n), exactly; load -1 is all rows. Loads are not negative.

    While a load has more than FEW distinct numbers, its range is cut into BINS and only the bin of the median is kept.
    """
    every = numbers.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit(-1).cast("bigint").alias("load"), "v", "n")
    left = materialize(numbers.where(F.col("load").isNotNull()).groupBy("load", "v").agg(F.sum("n").alias("n")).unionByName(every), "numbers")
    total = left.groupBy("load").agg(F.sum("n").alias("total"))
    ranks = total.select("load", F.explode(F.array_distinct(F.array(F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1))).alias("rank"))
    # One problem for each load and rank sought; `rank` counts within what is left of it.
    left = left.join(ranks, "load").withColumn("sought", F.col("rank"))
    own = ["load", "sought"]
    while left.groupBy(*own).count().where(F.col("count") > FEW).limit(1).count():
        span = left.groupBy(*own).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        cut = left.join(span, own)
        width = (F.col("hi") - F.col("lo")).cast("double") / BINS
        cut = cut.withColumn("bin", F.floor((F.col("v") - F.col("lo")).cast("double") / width))
        bins = cut.groupBy(*own, "rank", "bin").agg(F.sum("n").alias("in_bin"))
        upto = F.sum("in_bin").over(Window.partitionBy(*own).orderBy("bin"))
        place = bins.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("in_bin") < F.col("rank")))
        kept = cut.join(place.drop("rank"), [*own, "bin"]).select(*own, (F.col("rank") - F.col("upto") + F.col("in_bin")).alias("rank"), "v", "n")
        left = materialize(kept, "narrowed")
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy("v"))
    hit = left.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return hit.groupBy("load").agg(F.avg("v").alias("median"))
