"""New or changed records since the last successful run, by versions of a table's manifest.

A version lists immutable data files, each with a deletion vector: the row positions that are not part of that
version. The record delta of two versions is the rows of added files without their vector, plus the
positions that a vector covered before and no longer covers; removed files and newly covered positions are
deletions. The version a run has processed is part of its output commit, so that a run that fails leaves neither.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import bounded_broadcast, materialize, work_path

PLACE = ["__file", "__pos"]
#: Files whose names are handed to a scan; beyond, all files are read and matched.
MOST_NAMED = 100_000


def with_place(df: DataFrame) -> DataFrame:
    """Rows with the file they lie in and their position there."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__pos"))


class Manifest:
    """One version: table of file, n_rows, and a table of (file, pos) that the version does not have.

    Both are stored under `path`; a version is never changed after it was written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def write(cls, spark: SparkSession, files: DataFrame, vectors: DataFrame, path: str | None = None) -> Manifest:
        """files: file, n_rows; vectors: file, pos of the rows that are left out."""
        m = cls(spark, path or work_path(spark, "manifest"))
        files.select("__file", "n_rows").write.parquet(f"{m.path}/files")
        vectors.select(*PLACE).write.parquet(f"{m.path}/vectors")
        return m

    @property
    def files(self) -> DataFrame:
        return self.spark.read.schema("__file string, n_rows bigint").parquet(f"{self.path}/files")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("__file string, __pos bigint").parquet(f"{self.path}/vectors")

    def empty(self) -> bool:
        return self.files.isEmpty()


def in_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows that lie in some files (__file). Other files are not opened, unless the files wanted are more than MOST_NAMED.

    The names are taken to the driver, which lists all files of the table to read it anyway.
    """
    names = [r["__file"] for r in files.select("__file").distinct().limit(MOST_NAMED + 1).collect()]
    if len(names) > MOST_NAMED:
        return with_place(rows).join(files.select("__file").distinct(), "__file", "left_semi")
    return with_place(rows.where(F.col("_metadata.file_path").isin(names)) if names else rows.limit(0))


def file_name(uri: str) -> str:
    """A file as _metadata.file_path names it."""
    return re.sub("^file:/+", "file:/", unquote(uri))


def counted(rows: DataFrame) -> DataFrame:
    """__file and n_rows of the files of a table, from their footers: no column is read."""
    return rows.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count(F.lit(1)).alias("n_rows"))


def next_version(rows: DataFrame, last: Manifest | None = None, deleted: DataFrame | None = None) -> Manifest:
    """The version of a table as it is now: its files, of which only those that `last` has not are counted, and its deletion vectors.

    deleted: file, pos of rows that are no part of it any more, beside those of `last`. Files without rows are in no version.
    """
    spark = rows.sparkSession
    if last is None:
        files, vectors = counted(rows), spark.createDataFrame([], "__file string, __pos bigint")
    else:
        there = spark.createDataFrame([(file_name(f),) for f in rows.inputFiles()], "__file string")
        known = last.files.join(there, "__file", "left_semi")
        added = in_files(rows, there.join(last.files, "__file", "left_anti"))
        files = known.unionByName(added.groupBy("__file").agg(F.count(F.lit(1)).alias("n_rows")))
        vectors = last.vectors.join(there, "__file", "left_semi")
    return Manifest.write(spark, files, vectors if deleted is None else vectors.unionByName(deleted.select(*PLACE)).distinct())


def versions_by_arrival(rows: DataFrame, arrival: Column, cutoff: int | None) -> tuple[Manifest, Manifest]:
    """The version of a table at a cutoff (rows that arrived before it) and the version of now, over the same files.

    Files whose rows all arrived at or after the cutoff are absent from the older version; files with both
    carry a deletion vector there. Rows without arrival time are in neither. cutoff None: nothing was processed.
    The arrivals are read once.
    """
    spark = rows.sparkSession
    late = F.col("at").isNull() | (F.col("at") >= F.lit(cutoff) if cutoff is not None else F.lit(True))
    hidden = materialize(with_place(rows).select(*PLACE, arrival.alias("at")).where(late).select(*PLACE, F.col("at").isNull().alias("never")), "late")
    files = materialize(counted(rows), "files")
    now = Manifest.write(spark, files, hidden.where("never"))
    left = files.join(hidden.groupBy("__file").agg(F.count(F.lit(1)).alias("n")), "__file", "left").where("n is null or n < n_rows")
    then = Manifest.write(spark, left, hidden.join(bounded_broadcast(left.select("__file")), "__file", "left_semi"))
    return then, now


def record_delta(rows: DataFrame, old: Manifest | None, new: Manifest) -> tuple[DataFrame, DataFrame]:
    """Rows that `new` has and `old` has not, and places (file, pos) that `old` has and `new` has not.

    rows: the table itself, read from its files. Only files that are new or of whose vectors a row is exposed are read. Vectors are
    matched by sorting: stored places are far smaller than in memory, so that their size on disk is no bound.
    """
    files, vectors = new.files, new.vectors
    if old is None:
        gone = vectors.limit(0)
        touched, exposed = files.select("__file"), None
    else:
        added = files.join(old.files, "__file", "left_anti").select("__file")
        exposed = old.vectors.join(vectors.hint("merge"), PLACE, "left_anti").join(files.select("__file"), "__file", "left_semi")
        touched = added
        removed = old.files.join(files, "__file", "left_anti").select("__file")
        lost = vectors.join(old.vectors.hint("merge"), PLACE, "left_anti").join(old.files.select("__file"), "__file", "left_semi")
        all_lost = removed.join(old.vectors.groupBy("__file").agg(F.count(F.lit(1)).alias("n")), "__file", "left").select("__file", F.lit(None).cast("bigint").alias("__pos"))
        gone = lost.unionByName(all_lost)
    whole = in_files(rows, touched).join(vectors.hint("merge"), PLACE, "left_anti")
    if exposed is None:
        return whole.drop(*PLACE), gone
    some = in_files(rows, exposed).join(exposed.hint("merge"), PLACE, "left_semi")
    return whole.unionByName(some).drop(*PLACE), gone


def first_of_change(delta: DataFrame, seen: DataFrame | None, change: list[str], order: list[str]) -> DataFrame:
    """The rows of delta that bring a change not seen before, each change once: by its first row in `order`.

    change: columns that name the change (compared with null as a value); seen: rows with these columns. Rows are
    reduced to one a change before they are shuffled, so that a change delivered very often is no hot spot.
    """
    keep = [c for c in delta.columns if c not in change and c not in order]
    first = delta.groupBy(*change).agg(F.min(F.struct(*order, *keep)).alias("__first"))
    if seen is None:
        return first.select(*change, "__first.*")
    known = seen.groupBy(*change).agg(F.lit(1).alias("__seen"))
    alike = [first[c].eqNullSafe(known[c]) for c in change]
    return first.join(known, alike, "left_anti").select(*change, "__first.*")


class Consumer:
    """Runs a step over the record delta of a table and commits its output with the version processed.

    Folder `path`, the same for all runs: one folder an attempt, and commit files that name a finished attempt. An attempt without
    commit is as if it had never been; commit n can be written once only. With `change`, the columns that name a change, a
    commit also names what its run has seen of them, so that a later run finds repeats without reading the table's past.
    """

    def __init__(self, spark: SparkSession, path: str, change: list[str] | None = None):
        self.spark, self.path, self.change = spark, path.rstrip("/"), change or []
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commits(self) -> list[dict]:
        """The commits in their order; a few names each, read without a job."""
        folder = self._p("commits")
        if not self.fs.exists(folder):
            return []
        out = []
        for status in self.fs.listStatus(folder):
            if status.getPath().getName().endswith(".json"):
                stream = self.fs.open(status.getPath())
                out.append(json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
        return sorted(out, key=lambda c: c["number"])

    def processed(self) -> Manifest | None:
        done = self.commits()
        return Manifest(self.spark, done[-1]["version"]) if done else None

    def adopt(self, version: Manifest, seen: DataFrame | None = None) -> None:
        """Commit a version as processed whose output lies elsewhere; seen: its changes."""
        out = None
        if seen is not None:
            out = f"{self.path}/attempt-{uuid.uuid4().hex[:12]}"
            seen.select(*self.change).write.parquet(f"{out}/seen")
        self._commit(len(self.commits()) + 1, version, None, out and f"{out}/seen")

    def _commit(self, number: int, version: Manifest, out: str | None, seen: str | None = None) -> None:
        text = json.dumps({"number": number, "version": version.path, "output": out, "seen": seen})
        target, draft = self._p(f"commits/{number:06d}.json"), self._p(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._p("commits"))
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            raise RuntimeError("another run has committed")

    def seen(self) -> DataFrame | None:
        """The changes of all runs committed; None before the first."""
        parts = [c["seen"] for c in self.commits() if c.get("seen")]
        return self.spark.read.parquet(*parts) if parts else None

    def run(self, rows: DataFrame, new: Manifest, step: Callable[[DataFrame, DataFrame], DataFrame]) -> str:
        """step(rows added or changed, places deleted) -> output; returns the folder of the output.

        With `change` the output has these columns; they are what the run has seen.
        """
        done = self.commits()
        added, gone = record_delta(rows, Manifest(self.spark, done[-1]["version"]) if done else None, new)
        out = f"{self.path}/attempt-{uuid.uuid4().hex[:12]}"
        step(added, gone).write.parquet(out)
        self._commit(len(done) + 1, new, out, out if self.change else None)
        return out

    def output(self) -> DataFrame | None:
        outs = [c["output"] for c in self.commits() if c["output"]]
        return self.spark.read.parquet(*outs) if outs else None
