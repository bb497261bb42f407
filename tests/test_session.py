import os

from docloom import session


def test_shared_folder_is_the_one_set(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == base
    assert session.work_path(spark, "x").startswith(base)


def test_stored_tables_and_clearing(spark):
    df = session.materialize(spark.range(5).withColumnRenamed("id", "a b"), "t")
    assert df.columns == ["a b"] and df.count() == 5
    folder = session.shared_dir(spark).removeprefix("file://") + "/docloom"
    assert os.path.isdir(folder)
    session.clear_work(spark)
    assert not os.path.exists(folder)


def test_broadcast_only_of_counted_tables(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(session.bounded_broadcast(spark.range(10), 10)) and not hinted(session.bounded_broadcast(spark.range(11), 10))


def test_rows_are_kept_when_spread(spark):
    assert session.spread(spark.range(100).coalesce(1)).count() == 100
    assert session.spread(spark.range(0)).count() == 0


def test_nothing_else_imports_the_llm_package():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docloom")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "docloom.llm" not in open(os.path.join(folder, f)).read(), f
