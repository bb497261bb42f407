import pytest

from docloom.llm import mixing, queries

SIZES = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "source string, target_share double, max_repeats int"


def brute(sizes, targets, total, order):
    """Weighted fair queueing, one document after another. order: doc_id -> place in its source."""
    share, most = {s: t for s, t, _ in targets}, {s: m or 1 for s, _, m in targets}
    uses = []
    for s in share:
        own = sorted(((order[d], d, n) for d, x, n in sizes if x == s and n), key=lambda x: x[0])
        upto = 0
        for r in range(most[s]):
            for _, d, n in own:
                upto += n
                uses.append((upto / share[s], s, d, r, n))
    out, place = [], 0
    for f, s, d, r, n in sorted(uses):
        place += n
        if place > total:
            break
        out.append((d, s, r, place))
    return out


def order_of(spark, sizes, seed=17):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d,) for d, _, _ in sizes], "doc_id bigint").select("doc_id", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    return {r.doc_id: (r.h, r.doc_id) for r in df.collect()}


@pytest.mark.parametrize("total", [50, 700, 100_000])
def test_same_as_one_queue(spark, total, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 10)
    sizes = [(i, "abc"[i % 3] if i % 7 else "a", 1 + i % 5) for i in range(120)] + [(500, None, 3), (501, "zz", 3), (502, "a", 0)]
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.15, None), ("none", 0.05, 2)]
    got = mixing.mixture(spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, TARGETS), total)
    assert sorted((r.doc_id, r.source, r.repeat_no, r.place) for r in got.collect()) == sorted(brute(sizes, targets, total, order_of(spark, sizes)))


def test_shares_are_met_until_sources_run_out(spark):
    sizes = [(i, "big" if i < 900 else "small", 10) for i in range(1000)]
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 2)], TARGETS)
    docs = spark.createDataFrame(sizes, SIZES)
    mixed = mixing.mixture(docs, targets, 5000)
    by = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(by["big"].actual_share - 0.7) < 0.01 and abs(by["small"].actual_share - 0.3) < 0.01
    by = {r.source: r for r in mixing.shares(mixing.mixture(docs, targets, 9000), targets).collect()}
    assert by["small"].most_repeats == 2 and by["small"].tokens == 2000 and by["big"].tokens == 7000  # out of reach: all that is allowed


def test_nothing_to_mix(spark):
    none, targets = spark.createDataFrame([], SIZES), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed = mixing.mixture(none, targets)
    assert mixed.count() == 0
    got = mixing.shares(mixed, targets).collect()
    assert [(r.source, r.tokens, r.actual_share) for r in got] == [("a", 0, 0.0)]


def test_documents(spark, data):
    targets = {r.source: r for r in spark.read.parquet(f"{data}/mix_targets.parquet").collect()}
    rows = queries.p9_mixture(spark, data).collect()
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.doc_id), []).append(r.repeat_no)
    assert all(sorted(v) == list(range(len(v))) and len(v) <= targets[s].max_repeats for (s, _), v in uses.items())
    assert max(r.place for r in rows) == sum(r.n_tokens for r in rows)
    shares = {r.source: r for r in queries.p9_shares(spark, data).collect()}
    assert shares.keys() == targets.keys() and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
