"""The pN queries against plain restatements, on the small tables."""

import brute
import pytest

from docloom.queries import problems

COLUMNS = {
    "p1": "table_name field_name row_id", "p2": "parent_id field_name row_id", "p3": "table_name row_id array_path pos", "p4": "parent_id field_name from_row_id to_row_id",
    "p5": "table_name column_name load_no row_id", "p6": "table_name row_id", "p7": "table_name row_id field_name utc_micros",
}


@pytest.mark.parametrize("p", sorted(COLUMNS))
def test_found(spark, data, p):
    df = problems.QUERIES[f"{p}_found"](spark, data)
    assert df.columns == COLUMNS[p].split()
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    assert set(got) == getattr(brute, p)(data)


def test_wide_has_a_column_for_each_field(spark, data):
    df = problems.p2_wide(spark, data)
    types = dict(df.dtypes)
    assert types["Amount__c"] == "decimal(38,18)" and types["Is_Renewal__c"] == "boolean" and types["Close_Date__c"] == "date" and types["Term_Months__c"] == "bigint"
    filled = sum(v is not None for r in df.collect() for v in r[1:])
    assert filled == len(brute.p2(data))


def test_periods_do_not_overlap(spark, data):
    by = {}
    for r in problems.p4_periods(spark, data).collect():
        by.setdefault((r.parent_id, r.field_name), []).append((r.valid_from, r.valid_to))
    for spans in by.values():
        spans.sort(key=lambda x: (x[0] is not None, x[0]))
        for (_, end), (start, _) in zip(spans, spans[1:]):
            assert end is not None and end <= start


def test_summary_adds_up(spark, data):
    rows = problems.p5_summary(spark, data).collect()
    for name in ("Status", "PolType", "Premium"):
        own = [r for r in rows if r.column_name == name]
        whole = next(r for r in own if r.is_total)
        assert whole.n_rows == sum(r.n_rows for r in own if not r.is_total)
        assert whole.n_missing == sum(r.n_missing for r in own if not r.is_total)


def test_texts_come_out_as_written(spark, data):
    rows = {r["_id"]: r for r in brute.load(data, "flat_offer_history")}
    texts = [r["field_name"] for r in brute.load(data, "offer_fields") if r["value_type"] == "text"]
    want = {(p, f): rows[i]["NewValue"] for p, f, i in brute.p2(data) if f in texts}
    got = {(r.parent_id, f): r[f] for r in problems.p2_wide(spark, data).collect() for f in texts if r[f] is not None}
    assert got == want and any(v != v.strip().lower() for v in want.values())
    spans = sorted(((p, f, rows[i]["NewValue"] if i else None, j) for p, f, i, j in brute.p4(data) if f in texts and i), key=str)
    told = problems.p4_periods(spark, data).where("valid_from is not null").collect()
    assert sorted(r.value for r in told if r.field_name in texts) == sorted(s[2] for s in spans)
    first = {k: min((r for r in v), key=lambda r: r[:2])[1] for k, v in brute.offer_events(data).items()}
    olds = [rows[first[p, f]]["OldValue"] for p, f, i, _ in brute.p4(data) if not i and f in texts]
    assert sorted(r.value for r in problems.p4_periods(spark, data).where("valid_from is null").collect() if r.field_name in texts) == sorted(olds)
