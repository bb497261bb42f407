import datetime as dt

import pytest

from docloom.operators.instants import FeedZones, InstantDictionary, normalise_instants

FEEDS = [("KA1", "America/New_York", "mdy", "EST", "EDT"), ("EL5", "Europe/London", "dmy", "GMT", "BST"), ("AT9", "Asia/Tokyo", "ymd", "JST", None), ("AK8", "Asia/Kolkata", "dmy", "IST", None), ("UU0", "Etc/UTC", "ymd", "UTC", None)]
ZONES = FeedZones(FEEDS)


def at(*a):
    return (dt.datetime(*a) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


@pytest.mark.parametrize(
    "raw,feed,want",
    [
        ("2024-01-02T03:04:05.678Z", "KA1", at(2024, 1, 2, 3, 4, 5, 678000)),
        ("2024-01-02T03:04:05.1234567Z", "KA1", at(2024, 1, 2, 3, 4, 5, 123456)),
        ("2024-07-01 12:00:00", "KA1", at(2024, 7, 1, 16)),
        ("7/1/2024 12:00 PM", "KA1", at(2024, 7, 1, 16)),
        ("01/07/2024 12:00", "EL5", at(2024, 7, 1, 11)),
        ("2024/07/01 09:00", "AT9", at(2024, 7, 1)),
        ("01.07.2024 12:00", "KA1", at(2024, 7, 1, 16)),
        ("Jul  1 2024 12:00AM", "UU0", at(2024, 7, 1)),
        ("Mon, 01 Jul 2024 00:00:00 GMT", "KA1", at(2024, 7, 1)),
        ("Tue, 01 Jul 2024 00:00:00 GMT", "KA1", None),
        ("20240701T000000Z", "KA1", at(2024, 7, 1)),
        ("20240701", "AT9", at(2024, 6, 30, 15)),
        ("2024-07-01", "AT9", at(2024, 6, 30, 15)),
        ("1719792000", "KA1", at(2024, 7, 1)),
        ("1719792000123", "KA1", at(2024, 7, 1, 0, 0, 0, 123000)),
        ("2024-07-01T02:00:00+02:00[Europe/London]", "KA1", at(2024, 7, 1)),
        ("2024-07-01T01:00:00[Europe/London]", "KA1", at(2024, 7, 1)),
        ("2024-07-01 12:00:00 -0330", "KA1", at(2024, 7, 1, 15, 30)),
        ("2024-07-01 12:00:00 EST", "KA1", at(2024, 7, 1, 17)),
        ("2024-07-01 12:00:00 IST", "AK8", at(2024, 7, 1, 6, 30)),
        ("2024-11-03 01:30:00 EDT", "KA1", at(2024, 11, 3, 5, 30)),
        ("2024-11-03 01:30:00", "KA1", None),  # twice
        ("2024-03-10 02:30:00", "KA1", None),  # never
        ("2024-02-30", "KA1", None),
        ("13/13/2024 10:00", "EL5", None),
        ("25/06/2024 10:00", "KA1", None),
        ("2024-07-01 25:00:00", "KA1", None),
        ("1:00 PM", "KA1", None),
        ("2024", "KA1", None), ("2024-07", "KA1", None), ("Q3 2024", "KA1", None), ("Jul 2024", "KA1", None), ("", "KA1", None), ("NULL", "KA1", None), ("?", "KA1", None), (None, "KA1", None),
        ("2024-07-01 12:00:00", None, None), ("2024-07-01 12:00:00Z", None, at(2024, 7, 1, 12)),
        ("9" * 10000, "KA1", None), ("٢٠٢٤٠٧٠١", "KA1", None),
    ],
)
def test_forms(raw, feed, want):
    assert ZONES.parse(raw, feed) == want


def zones_table(spark):
    return spark.createDataFrame(FEEDS, "feed_code string, tz_name string, day_order string, std_abbr string, dst_abbr string")


def test_rows_keep_their_number_and_columns(spark):
    rows = [(i, "1719792000" if i % 3 else None, "KA1", "x") for i in range(30)] + [(99, "nonsense", None, "y"), (98, "2024-07-01T00:00:00.000Z", None, "z")]
    df = spark.createDataFrame(rows, "id int, raw string, feed string, n string")  # names that the dictionary uses itself
    got = normalise_instants(df, "raw", "feed", zones_table(spark)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"id", "raw", "feed", "n", "utc_micros"}
    by = {r.id: r.utc_micros for r in got}
    assert by[1] == at(2024, 7, 1) and by[0] is None and by[99] is None and by[98] == at(2024, 7, 1)


def test_empty(spark):
    df = spark.createDataFrame([], "raw string, feed string")
    assert normalise_instants(df, "raw", "feed", zones_table(spark)).count() == 0


def test_dictionary_is_kept_and_grows(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    first = InstantDictionary(spark, ZONES, path).add(spark.createDataFrame([("1719792000", "KA1")], "raw string, feed string"))
    assert first.table.count() == 1
    again = InstantDictionary(spark, ZONES, path).add(spark.createDataFrame([("1719792000", "KA1"), ("1719792001", "KA1"), (None, "KA1")], "raw string, feed string"))
    assert again.table.count() == 2 and again.table.where("raw = '1719792000'").count() == 1


def test_values_that_become_frequent_later(spark, tmp_path):
    kind = "raw string, feed string"
    d = InstantDictionary(spark, ZONES, f"file://{tmp_path}/d").add(spark.createDataFrame([("1719792000", "KA1")] + [(f"17197920{i:02d}", "KA1") for i in range(1, 60)], kind))
    later = spark.createDataFrame([("1719792000", "KA1")] * 500 + [("1719792001", "KA1"), (None, None)], kind)
    d.add(later)
    assert {r.raw: r.n for r in d.counts.collect()} == {"1719792000": 500, "1719792001": 1} and d.table.count() == 60
    got = d.match(later, "raw", "feed")
    assert got.where(f"utc_micros = {at(2024, 7, 1)}").count() == 500 and got.count() == 502
