"""Edge cases of the general operators on small made tables."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import incremental, nested, profile, references
from docloom.operators.history import Ledger
from docloom.operators.sweep import neighbours
from docloom.operators.typed_values import canonical, is_clear
from docloom.operators.wide import WideStore

EVENT = "entity string, attribute string, valid_from bigint, row_id string, value string, old_value string"
VERSION = "entity string, attribute string, version bigint, row_id string, value string"


# references


def ids(found):
    return sorted(r.row_id for r in found.collect())


def keys(spark, rows, kind="row_id string, key bigint, at bigint"):
    df = spark.createDataFrame(rows, kind)
    return df.select("*", *references.integer_halves(F.col("key")))


def test_dense_parents_become_runs(spark):
    parents = keys(spark, [("", k, None) for k in [*range(10), *range(20, 30), 2**16 - 1, 2**16, 2**16 + 1, 5, 5]])
    runs = references.live_runs(parents).collect()
    assert sorted((r.k_lo, r.to_lo) for r in runs) == [(0, 9), (20, 29), (65535, 65535), (65536, 65537)]
    refs = keys(spark, [(str(k), k, 1) for k in (0, 9, 10, 15, 20, 29, 30, 65535, 65536, 65537, 65538, -1)] + [("none", None, 1)])
    assert ids(references.orphans(refs, parents)) == sorted(map(str, (10, 15, 30, 65538, -1)))


@pytest.mark.parametrize("hot", [40, 1_000_000])
def test_dense_keys_with_times_are_compressed(spark, hot):
    """5,000 consecutive keys, each with an arrival of its own, a gap, and some keys that were deleted and came again."""
    rng = random.Random(2)
    births = [("", k, 1000 + rng.randrange(500)) for k in range(5000) if not 2000 <= k < 2100]
    ends = [("", k, 1600) for k in range(0, 5000, 500)]
    again = [("", k, 1700) for k in range(0, 5000, 1000)]
    runs = references.live_runs(keys(spark, births + again), keys(spark, ends)).collect()
    assert len(runs) < 130 and sum(r.to_lo - r.k_lo + 1 for r in runs if r.lives) == 4900 - 9
    assert all(r.lives is None or len(r.lives) == r.to_lo - r.k_lo + 1 <= 64 for r in runs)
    born = {k: t for _, k, t in births}
    refs = [(f"{i}", rng.randrange(-5, 5005), 900 + rng.randrange(900)) for i in range(2000)]
    live = lambda k, t: t >= 1700 if k == 2000 else k in born and born[k] <= t and not (k % 500 == 0 and t >= 1600 and not (k % 1000 == 0 and t >= 1700))
    got = references.orphans(keys(spark, refs), keys(spark, births + again), keys(spark, ends), hot_rows=hot)
    assert ids(got) == sorted(i for i, k, t in refs if not live(k, t))


@pytest.mark.parametrize("hot", [3, 1_000_000])
def test_liveness(spark, hot):
    rng = random.Random(5)
    births = [(f"b{i}", rng.randrange(6), rng.randrange(100)) for i in range(40)]
    ends = [(f"e{i}", rng.randrange(6), rng.randrange(100)) for i in range(20)]
    refs = [(f"r{i}", rng.randrange(7), rng.randrange(110)) for i in range(200)] + [("x", None, 5), ("y", 1, None)]
    want = sorted(i for i, k, t in refs if k is not None and t is not None and not any(b <= t and not any(b < e <= t for _, q, e in ends if q == k) for _, p, b in births if p == k))
    got = references.orphans(keys(spark, refs), keys(spark, births), keys(spark, ends), hot_rows=hot)
    assert ids(got) == want


def test_empty_parents_and_references(spark):
    none = keys(spark, [])
    refs = keys(spark, [("a", 1, 1)])
    assert ids(references.orphans(refs, none, none)) == ["a"]
    assert ids(references.orphans(none, refs, none)) == []


def test_key_forms(spark):
    k = "0123456789ABCDEF0123456789ABCDEF"
    forms = [k, k.lower(), "{01234567-89ab-cdef-0123-456789abcdef}", f"  {k} ", "0" * 32, k[:-1], k + "0", "", None, "n/a"]
    got = [r.h for r in spark.createDataFrame([(f,) for f in forms], "v string").select(references.hex_digits(F.col("v")).alias("h")).collect()]
    assert got == [k] * 4 + [None] * 6


# sweep


@pytest.mark.parametrize("hot", [7, 10_000])
def test_neighbours_of_cut_groups(spark, hot):
    rows = [("a", i // 3, f"{i:04d}") for i in range(300)] + [("b", 1, "x"), ("c", 5, "1"), ("c", 4, "2")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t int, id string")
    got = {r.id: (r.before, r.after) for r in neighbours(df, ["g"], ["t", "id"], {"before": "id"}, {"after": "id"}, hot).collect()}
    for i in range(300):
        assert got[f"{i:04d}"] == (f"{i - 1:04d}" if i else None, f"{i + 1:04d}" if i < 299 else None)
    assert got["x"] == (None, None) and got["2"] == (None, "1")


# values


def test_typed_values(spark):
    cases = [
        ("12,200.00", "decimal", "12200.000000000000000000"), ("$5", "decimal", "5.000000000000000000"), ("2.5E+02", "decimal", "250.000000000000000000"), (" 1 000 ", "decimal", "1000.000000000000000000"), ("21%", "decimal", "21.000000000000000000"),
        ("1,2", "decimal", None), ("1.2.3", "decimal", None), ("", "decimal", None), ("1e999", "decimal", None), ("9" * 10_000, "decimal", None), ("5\n6", "decimal", "56.000000000000000000"),
        ("2,086", "integer", "2086"), ("89.0", "integer", "89"), ("7.5", "integer", None), ("9223372036854775808", "integer", None),
        ("Yes", "boolean", "true"), ("0", "boolean", "false"), ("2", "boolean", None),
        ("2026-09-08T00:00:00.000Z", "date", "2026-09-08"), ("2026-09-08T01:00:00.000Z", "date", None), ("4 Mar 2026", "date", "2026-03-04"), ("20250605", "date", "2025-06-05"), ("2023/11/22", "date", "2023-11-22"), ("2025-02-30", "date", None), ("31 Xyz 2025", "date", None),
        ("  GRÜNLAND  ", "text", "grünland"), ("x", "other", None), (None, "text", None),
    ]
    df = spark.createDataFrame([(i, v, t) for i, (v, t, _) in enumerate(cases)], "i int, v string, t string")
    got = {r.i: r.c for r in df.select("i", canonical(F.col("v"), F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]
    clear = spark.createDataFrame([(None,), ("",), (" \t",), ("null",), ("NULL ",), ("nul",)], "v string").select(is_clear(F.col("v")).alias("c")).collect()
    assert [r.c for r in clear] == [True] * 5 + [False]


# wide tables


def test_latest_version_of_each_cell_in_any_batches(spark):
    rng = random.Random(3)
    rows = [(f"e{rng.randrange(5)}", rng.choice(["A", "B", "zz"]), rng.randrange(10), f"{i:03d}", rng.choice(["1", "2", None])) for i in range(200)] + [(None, "A", 1, "n", "1"), ("e0", None, 1, "m", "1"), ("e0", "A", None, "o", "1")]
    want = {}
    for e, a, v, i, x in rows:
        if e and a in ("A", "B") and v is not None:
            want[e, a] = min(want.get((e, a), (1, "")), (-v, i, x), key=lambda c: c[:2])
    rng.shuffle(rows)
    store = WideStore(spark, {"A": "integer", "B": "text"})
    for k in range(0, len(rows), 70):
        store.upsert(spark.createDataFrame(rows[k : k + 70], VERSION))
    expect = sorted((e, a, c[1]) for (e, a), c in want.items() if c[2] is not None)
    assert sorted(map(tuple, store.filled().collect())) == expect
    plan = store.merged(*store.runs[:2])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    store.compact()
    assert len(store.runs) == 1 and sorted(map(tuple, store.filled().collect())) == expect
    store.upsert(spark.createDataFrame([("e0", "A", 99, "late", None)], VERSION))
    assert not [r for r in store.filled().collect() if (r.entity, r.attribute) == ("e0", "A")]
    assert dict(store.wide().dtypes) == {"entity": "string", "A": "bigint", "B": "string"}


def test_empty_wide(spark):
    store = WideStore(spark, {"A": "integer"})
    assert store.wide().count() == 0
    store.upsert(spark.createDataFrame([], VERSION))
    assert store.filled().count() == 0


# history


def periods(rows):
    out, by = set(), {}
    for e, a, t, i, v, o in rows:
        by.setdefault((e, a), []).append((t, i, v, o))
    for (e, a), own in by.items():
        own.sort(key=lambda r: r[:2])
        value, since = own[0][3], ""
        for _, i, v, _ in own:
            if v != value:
                if value is not None:
                    out.add((e, a, value, since, i))
                value, since = v, i
        if value is not None:
            out.add((e, a, value, since, ""))
    return out


@pytest.mark.parametrize("hot", [9, 1_000_000])
def test_late_batches_split_segments(spark, hot):
    rng = random.Random(hot)
    rows = [(f"e{rng.choice([0, 0, 0, 1])}", "A", rng.randrange(30), f"{i:03d}", rng.choice(["x", "y", None]), rng.choice(["x", "z", None])) for i in range(90)]
    ledger = Ledger(spark, hot_rows=hot)
    for k in (0, 30, 60):
        ledger.record(spark.createDataFrame(rows[k : k + 30], EVENT))
    told = lambda df: {(r.entity, r.attribute, r.value, r.from_row_id, r.to_row_id) for r in df.collect()}
    assert told(ledger.history()) == periods(rows)
    assert told(ledger.history(as_recorded=1)) == periods(rows[:30])  # as believed before the late rows
    assert told(ledger.history(as_recorded=2)) == periods(rows[:60])
    assert ledger.versions().where("superseded is not null").count() > 0
    ledger.record(spark.createDataFrame(rows[:30], EVENT))  # known rows again
    assert told(ledger.history()) == periods(rows)


def test_empty_history(spark):
    ledger = Ledger(spark)
    ledger.record(spark.createDataFrame([(None, "A", 1, "i", "x", None), ("e", "A", None, "j", "x", None)], EVENT))
    assert ledger.history().count() == 0


# nested records


def shredded(spark, payloads, paths=((("a", "b")), ("c",))):
    df = spark.createDataFrame([("t", str(i), p) for i, p in enumerate(payloads)], "table_name string, row_id string, payload string")
    return nested.Flat(df, [tuple(p) for p in paths])


def test_odd_shapes(spark):
    deep = "[" * 200 + "]" * 200
    payloads = ['{"a": {"b": [1, null, {}]}, "c": "x"}', '{"a": "{\\"b\\": \\"[2]\\"}"}', '{"c": {"d": [1]}}', '"{\\"c\\": [\\"\\"]}"', '{"c": 5}', '{"c": "5"}', '{"c": [NaN]}', '{"c": [1', "", None, "null", "[]", '{"c": []}', '{"c": ["\\ud800"]}', f'{{"c": {deep}}}', '{"c": [' + "9" * 5000 + "]}", '{"c": [1], "c": [2, 3]}', '{"c": ""}']
    got = sorted((int(r.row_id), r.array_path, r.pos) for r in shredded(spark, payloads).occurrences.collect())
    assert got == [(0, "a.b", 0), (0, "a.b", 2), (0, "c", 0), (1, "a.b", 0), (2, "c", 0), (3, "c", 0), (5, "c", 0), (13, "c", 0), (14, "c", 0), (15, "c", 0), (16, "c", 0), (16, "c", 1), (17, "c", 0)]


def test_identical_subtrees_are_stored_once(spark):
    f = shredded(spark, ['{"c": [{"x": 1, "y": [1.0]}, {"y": [1], "x": 1}, {"x": 2}]}'] * 3)
    assert f.occurrences.count() == 9
    assert f.occurrences.select("child").distinct().count() == 2
    assert f.nodes.count() == f.nodes.select("child").distinct().count()
    assert f.nodes.where("node_type = 'object'").count() == 3  # two elements and the record
    kinds = {r.child: r.node_type for r in f.nodes.collect()}
    assert all(r.parent in kinds and r.child in kinds for r in f.bridge.collect())
    flat = f.flat("c", ["x"]).collect()
    assert sorted((r.row_id, r.pos, r.x) for r in flat) == [(str(i), p, v) for i in range(3) for p, v in ((0, "1"), (1, "1"), (2, "2"))]


def test_no_records(spark):
    f = shredded(spark, [])
    assert f.occurrences.count() == 0 and f.nodes.count() == 0


# profiles


def test_profile_of_files_with_and_without_dictionary(spark, tmp_path):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(2)
    frames = []
    for load in range(1, 5):
        rows = [(f"{load}-{i}", load, rng.choice(["A", "B", None, "", "?", "NULL"]), str(rng.randrange(1000 * (9 if load == 3 else 1))) + rng.choice(["", ".5", "x"])) for i in range(150)]
        frames.append(pd.DataFrame(rows, columns=["_id", "load_no", "code", "num"]))
        pq.write_table(pa.Table.from_pandas(frames[-1], schema=pa.schema([("_id", "string"), ("load_no", "int32"), ("code", "string"), ("num", "string")])), f"{tmp_path}/p{load}.parquet", use_dictionary=load % 2 == 0, compression="zstd", row_group_size=60)
    one = pd.DataFrame({"_id": ["s1", "s2"], "load_no": [9, 9], "code": ["A", "A"], "num": ["7", "7"]})
    pq.write_table(pa.Table.from_pandas(one, schema=pa.schema([("_id", "string"), ("load_no", "int32"), ("code", "string"), ("num", "string")])), f"{tmp_path}/p9.parquet")
    df = pd.concat([*frames, one])
    p = profile.Profile(spark, f"file://{tmp_path}", [profile.Rule("code", codes=("A", "B")), profile.Rule("num", number=r"\A[0-9]+(\.[0-9])?\z")])
    got = {(r.column_name, r._id) for r in p.breaking_rows(["_id"]).collect()}
    assert got == {("code", i) for i, c in zip(df["_id"], df["code"]) if c == "?"} | {("num", i) for i, n in zip(df["_id"], df["num"]) if n.endswith("x")}
    counts = {(r.column_name, r.load, r.value): r.n for r in p.counts().collect()}
    assert sum(n for (c, _, _), n in counts.items() if c == "code") == len(df) and counts["code", 9, "A"] == 2
    known = p.chunks.where("file like '%p9%' and column_name = 'code'").first()
    assert known.complete and known.candidates == ["A"] and known.n_nulls == 0
    assert [(r.column_name, r.load) for r in p.shifted_loads().collect()] == [("num", 3)]


def test_chunks_that_footers_settle_are_not_read(spark, tmp_path):
    """One file of ten row groups, of which three need a scan; the data pages of the others can't be decoded."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(3)
    rows = [(f"{g}-{i}", 1 + g // 5, "A" if g not in (2, 6, 7) else rng.choice("AB?")) for g in range(10) for i in range(100)]
    df = pd.DataFrame(rows, columns=["_id", "load_no", "code"])
    path = f"{tmp_path}/t.parquet"
    pq.write_table(pa.Table.from_pandas(df, preserve_index=False), path, row_group_size=100, compression="snappy")
    meta = pq.read_metadata(path)
    with open(path, "r+b") as f:
        for g in range(10):
            if g not in (2, 6, 7):
                for c in ("_id", "code"):
                    x = next(meta.row_group(g).column(k) for k in range(3) if meta.row_group(g).column(k).path_in_schema == c)
                    f.seek(x.dictionary_page_offset + x.total_compressed_size - 4)
                    f.write(b"\xff" * 4)
    for g in (0, 2):
        try:
            pq.ParquetFile(path).read_row_group(g)
            assert g == 2
        except (OSError, pa.ArrowException):
            assert g == 0
    p = profile.Profile(spark, f"file://{path}", [profile.Rule("code", codes=("A", "B"))])
    assert {r._id for r in p.breaking_rows(["_id"]).collect()} == {i for i, _, c in rows if c == "?"}
    got = {(r.load, r.value): r.n for r in p.counts().collect()}
    assert got == df.groupby(["load_no", "code"]).size().to_dict()


def test_medians_that_need_narrowing(spark, monkeypatch):
    import statistics

    monkeypatch.setattr(profile, "FEW", 10)
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(-10000, 10000), rng.randrange(1, 4)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "load bigint, x bigint, n bigint").select("load", F.col("x").cast("decimal(38,4)").alias("v"), "n")
    got = {r.load: float(r.median) for r in profile.medians(df).collect()}
    for k in (-1, 0, 1, 2):
        assert got[k] == statistics.median([x for load, x, n in rows for _ in range(n) if k in (-1, load)])


def test_profile_of_a_table_in_folders(spark, tmp_path):
    rows = [(str(i), i % 2, "A" if i % 4 else "?") for i in range(300)]
    spark.createDataFrame(rows, "_id string, load_no int, code string").write.partitionBy("load_no").parquet(f"file://{tmp_path}/f")
    p = profile.Profile(spark, f"file://{tmp_path}/f", [profile.Rule("code", codes=("A",))])
    assert {r._id for r in p.breaking_rows(["_id"]).collect()} == {i for i, _, c in rows if c == "?"}
    assert {(r.load, r.value): r.n for r in p.counts().collect()} == {(0, "?"): 75, (0, "A"): 75, (1, "A"): 150}


def test_footers_that_cannot_be_read(spark):
    from docloom.operators.footers import chunk_statistics

    got = chunk_statistics(spark, ["nowhere://x/y.parquet", "file:///nothing/here.parquet"], ["a"]).collect()
    assert [(r.complete, r.n_rows) for r in got] == [(False, None)] * 2


def test_numbers_of_any_length(spark):
    texts = ["9" * 10_000, "-" + "9" * 40, ".5", "12.3456", "0"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(profile.as_number(F.col("v")).alias("n"), F.lit(1).cast("bigint").alias("load"))
    assert [float(r.n) for r in df.collect()] == [1e26, -1e26, 0.5, 12.3456, 0.0]
    got = profile.medians(df.select("load", F.col("n").alias("v"), F.lit(1).cast("bigint").alias("n"))).collect()
    assert {r.load: float(r.median) for r in got} == {1: 0.5, -1: 0.5}


def test_profile_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "_id string, load_no int, code string").coalesce(1).write.parquet(f"file://{tmp_path}/e")
    p = profile.Profile(spark, f"file://{tmp_path}/e", [profile.Rule("code", codes=("A",))])
    assert p.breaking_rows(["_id"]).count() == 0 and p.shifted_loads().count() == 0


# increments


def test_versions_and_deltas(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(i, i % 10 if i % 13 else None) for i in range(100)], "id int, at bigint").repartition(3).write.parquet(path)
    t = spark.read.parquet(path)
    then, now = incremental.versions_by_arrival(t, F.col("at"), 7)
    added, gone = incremental.record_delta(t, then, now)
    assert sorted(r.id for r in added.collect()) == [i for i in range(100) if i % 13 and i % 10 >= 7] and gone.count() == 0
    back, lost = incremental.record_delta(t, now, then)
    assert back.count() == 0 and lost.count() == added.count()
    every, _ = incremental.record_delta(t, None, now)
    assert every.count() == sum(1 for i in range(100) if i % 13)
    _, whole = incremental.versions_by_arrival(t, F.col("at"), None)
    assert whole.files.count() == 3


def test_names_that_clash(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(i, i, "f", 7, 1) for i in range(20)], "id int, at bigint, file string, pos int, n_rows int").write.parquet(path)
    t = spark.read.parquet(path)
    added, _ = incremental.record_delta(t, *incremental.versions_by_arrival(t, F.col("at"), 15))
    assert added.columns == t.columns and sorted(r.id for r in added.collect()) == [15, 16, 17, 18, 19]
    refs = spark.createDataFrame([("a", 1, 1, "x", 0), ("b", 9, 1, "y", 0)], "row_id string, key bigint, at bigint, born string, kind int")
    refs = refs.select("*", *references.integer_halves(F.col("key")))
    found = references.orphans(refs, keys(spark, [("", 1, 0)])).collect()
    assert [(r.row_id, r.born, r.kind) for r in found] == [("b", "y", 0)]
    spark.createDataFrame([("i", 1, "?", "x")], "_id string, load_no int, code string, x string").write.parquet(f"file://{tmp_path}/p")
    p = profile.Profile(spark, f"file://{tmp_path}/p", [profile.Rule("code", codes=("A",))])
    assert p.breaking_rows(["_id", "x"]).first().x == "x"


def test_failed_runs_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(i, i) for i in range(20)], "id int, at bigint").repartition(2).write.parquet(path)
    t = spark.read.parquet(path)
    first, second = incremental.versions_by_arrival(t, F.col("at"), 10)
    c = incremental.Consumer(spark, f"file://{tmp_path}/out")
    take = lambda added, gone: added.select("id")

    def fails(added, gone):
        raise RuntimeError("lost")

    assert c.processed() is None and c.output() is None
    with pytest.raises(RuntimeError):
        c.run(t, first, fails)
    assert c.output() is None
    c.run(t, first, take)
    with pytest.raises(RuntimeError):
        c.run(t, second, fails)
    c.run(t, second, take)
    c.run(t, second, take)
    assert sorted(r.id for r in c.output().collect()) == list(range(20))


def test_later_runs_read_new_files_only(spark, tmp_path):
    """Three runs over a growing table, one of them killed; files of the past can't be read any more, so that any read of them fails."""
    folder, kind = f"{tmp_path}/t", "id string, key string, changed bigint, at bigint"

    def load(n, rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        return spark.read.schema(kind).parquet(f"file://{folder}")

    def spoil():
        for f in glob.glob(f"{folder}/*.parquet"):
            with open(f, "r+b") as x:
                x.write(b"spoilt!!" * 8)
                x.seek(-64, 2)
                x.write(b"spoilt!!" * 8)
        for f in glob.glob(f"{folder}/.*.crc"):
            os.remove(f)

    c = incremental.Consumer(spark, f"file://{tmp_path}/out", ["key", "changed"])

    def step(added, gone):
        return incremental.first_of_change(added.select("key", "changed", "at", "id"), c.seen(), c.change, ["at", "id"])

    def killed(added, gone):
        step(added, gone).write.parquet(f"file://{tmp_path}/out/attempt-killed")
        raise RuntimeError("killed")

    t = load(1, [("a", "k", 1, 1), ("b", "k", 1, 2), ("c", "m", 1, 3)])
    first = incremental.next_version(t)
    c.run(t, first, step)
    spoil()
    t = load(2, [("d", "k", 1, 4), ("e", "k", 2, 5), ("f", None, None, 6)])
    second = incremental.next_version(t, first)
    with pytest.raises(Exception, match="killed"):
        c.run(t, second, killed)
    assert sorted(r.id for r in c.output().collect()) == ["a", "c"]
    again = incremental.Consumer(spark, f"file://{tmp_path}/out", ["key", "changed"])  # another process
    out = again.run(t, second, step)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["e", "f"]
    spoil()
    t = load(3, [("g", None, None, 7), ("h", "k", 2, 8), ("i", "m", 9, 9)])
    third = incremental.next_version(t, second)
    assert third.files.count() == 3 and len(t.inputFiles()) == 3
    out = again.run(t, third, step)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["i"]
    assert sorted(r.id for r in again.output().collect()) == ["a", "c", "e", "f", "i"] and len(again.commits()) == 3
    os.remove(glob.glob(f"{folder}/*.parquet")[0])
    t = spark.read.schema(kind).parquet(f"file://{folder}")
    fourth = incremental.next_version(t, third)
    added, gone = incremental.record_delta(t, third, fourth)
    assert added.count() == 0 and gone.count() == 1 and fourth.files.count() == 2


def test_first_of_a_change(spark):
    new = spark.createDataFrame([("k", 1, 5, "b"), ("k", 1, 5, "a"), (None, 1, 3, "c"), (None, 1, 2, "d"), ("z", None, 1, "e"), ("s", 1, 9, "f")], "key string, changed int, at int, row_id string")
    seen = spark.createDataFrame([("s", 1), ("s", 1), (None, 2)], "key string, changed int")
    got = incremental.first_of_change(new, seen, ["key", "changed"], ["at", "row_id"])
    assert sorted(r.row_id for r in got.collect()) == ["a", "d", "e"]


# ranks


@pytest.mark.parametrize("small", [0, 1 << 30])
@pytest.mark.parametrize("groups", [0, 3])
def test_windows_over_large_groups(spark, small, groups):
    """Sorted in ranges (small = 0, every group is large) as in one window; null is a group."""
    from docloom.operators.ranking import window_column

    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(20)]), None if groups and i % 50 == 0 else i % groups if groups else 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x int, g int")
    by = [F.col("g")] if groups else []
    run = lambda kind, order, *more: {r.id: r.r for r in window_column(df, by, order, kind, "r", *more, small_bytes=small, hot_rows=0).collect()}
    place = lambda v: (v is not None, v or 0)
    for down in (False, True):
        key = F.col("x").desc() if down else F.col("x").asc()
        got = {k: run(k, [key, F.col("id").asc()] if k == "ROW_NUMBER" else [key]) for k in ("RANK", "DENSE_RANK", "ROW_NUMBER")}
        tile = run("NTILE", [key, F.col("id").asc()], None, 7)
        lag, lead = (run(k, [key, F.col("id").asc()], F.col("id"), 2) for k in ("LAG", "LEAD"))
        for g in {r[2] for r in rows}:
            own = [r for r in rows if r[2] == g]
            low = sorted([r[1] for r in own], key=place, reverse=down)
            ids = [r[0] for r in sorted(own, key=lambda r: place(r[1]), reverse=down)]
            if down:  # ties by id still ascend
                ids = [r[0] for r in sorted(own, key=lambda r: (tuple(-int(v) for v in place(r[1])), r[0]))]
            assert all(got["RANK"][r[0]] == low.index(r[1]) + 1 and got["DENSE_RANK"][r[0]] == list(dict.fromkeys(low)).index(r[1]) + 1 for r in own)
            assert [got["ROW_NUMBER"][i] for i in ids] == list(range(1, len(ids) + 1))
            sizes = [len(ids) // 7 + (k < len(ids) % 7) for k in range(7)]
            assert [tile[i] for i in ids] == [k + 1 for k, n in enumerate(sizes) for _ in range(n)]
            assert [lag[i] for i in ids] == [None, None, *ids[:-2]] and [lead[i] for i in ids] == [*ids[2:], None, None]
    none = window_column(df.limit(0), by, [F.col("x").asc()], "LAG", "r", F.col("id"), small_bytes=small, hot_rows=0)
    assert none.count() == 0
