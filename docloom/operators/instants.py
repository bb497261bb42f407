"""Mixed timestamp texts to one UTC instant, through a dictionary of distinct values.

Each distinct (raw text, feed) is parsed once; the dictionary can be kept on disk and grows by the
values it has not seen. Rows get their instant back by a join in which frequent values, whose number
is bounded by their frequency, are broadcast and the rest are matched by a shuffle.
"""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize, work_path

#: The one normal form that needs no dictionary: UTC with milliseconds.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"
#: A value that makes up more than this share of all rows is matched by broadcast; there are at most 1 / share of them.
HOT_SHARE = 1 / 2000

EPOCH = dt.datetime(1970, 1, 1)
MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
MONTHS |= {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
MONTHS["sept"] = 9
DAYS = {d: i for i, d in enumerate("mon tue wed thu fri sat sun".split())}
DAYS |= {d: i for i, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
UNIVERSAL = {"Z", "UTC", "GMT", "UT"}

_DATE = (
    r"(?:(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})"
    r"|(?P<cy>\d{4})(?P<cm>\d{2})(?P<cd>\d{2})(?=T)"
    r"|(?P<s1>\d{1,4})/(?P<s2>\d{1,2})/(?P<s3>\d{1,4})"
    r"|(?P<pd>\d{1,2})\.(?P<pm>\d{1,2})\.(?P<py>\d{4})"
    r"|(?:(?P<w>[A-Za-z]{3,9}),?\s+)?(?:(?P<nm>[A-Za-z]{3,9})\.?\s+(?P<nd>\d{1,2}),?|(?P<rd>\d{1,2})[ -](?P<rm>[A-Za-z]{3,9})\.?,?)[ -](?P<ny>\d{4}))"
)
_TIME = (
    r"(?:(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?"
    r"|(?<=T)(?P<cH>\d{2})(?P<cM>\d{2})(?P<cS>\d{2})?(?:[.,](?P<cf>\d+))?)\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
)
_ZONE = r"(?:(?P<off>Z|z|(?:(?:UTC|GMT)\s?)?[+\-−]\d{1,2}(?::?\d{2})?(?::?\d{2})?))?\s*(?P<abbr>[A-Za-z]{2,5})?\s*(?:\[(?P<tz>[A-Za-z0-9_+\-/]+)\])?"
WHEN = re.compile(rf"{_DATE}(?:(?:[Tt]|\s+|,\s*){_TIME}\s*{_ZONE})?$")
NUMBER = re.compile(r"[+-]?\d+$", re.A)


@functools.lru_cache(4096)
def zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def micros(t: dt.datetime) -> int:
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def local_to_utc(t: dt.datetime, tz: ZoneInfo) -> int | None:
    """The one instant at which clocks in tz show t; None in a gap or where two instants do."""
    a = t.replace(tzinfo=tz, fold=0).utcoffset()
    b = t.replace(tzinfo=tz, fold=1).utcoffset()
    return micros(t - a) if a == b else None


def day_start(t: dt.datetime, tz: ZoneInfo) -> int:
    """The first instant of the day; where midnight falls into a gap or is shown twice, the earlier bound."""
    return micros(t - t.replace(tzinfo=tz, fold=0).utcoffset())


@functools.lru_cache(4096)
def abbreviation_offset(tz_name: str, daylight: bool) -> dt.timedelta | None:
    """The offset of a zone's standard or daylight time, as its clocks have had it since 1970, latest rule first."""
    tz = zone(tz_name)
    if tz is None:
        return None
    for year in range(2025, 1969, -1):
        for month in (1, 7):
            x = dt.datetime(year, month, 1, tzinfo=tz)
            if bool(x.dst()) == daylight:
                return x.utcoffset()
    return None


def calendar(g: dict, order: str | None) -> tuple[int, int, int] | None:
    """Year, month and day of a match, or None if they can't be told."""
    if g["y"]:
        return int(g["y"]), int(g["m"]), int(g["d"])
    if g["cy"]:
        return int(g["cy"]), int(g["cm"]), int(g["cd"])
    if g["pd"]:
        return int(g["py"]), int(g["pm"]), int(g["pd"])
    if g["s1"]:
        a, b, c = g["s1"], g["s2"], g["s3"]
        if len(a) == 4 and len(c) <= 2:
            return int(a), int(b), int(c)
        if len(c) != 4 or len(a) > 2 or order not in ("mdy", "dmy"):
            return None
        return (int(c), int(a), int(b)) if order == "mdy" else (int(c), int(b), int(a))
    month = MONTHS.get((g["nm"] or g["rm"]).lower())
    return (int(g["ny"]), month, int(g["nd"] or g["rd"])) if month else None


def parse_instant(raw: str | None, tz_name: str | None, day_order: str | None, abbrs: dict[str, tuple[str, bool]]) -> int | None:
    """Microseconds since 1970 of the instant that raw denotes, or None.

    A zone, offset or abbreviation in the text holds (offset before zone name); otherwise clocks of tz_name.
    abbrs: abbreviation -> (zone, daylight) as the feed means them. A day alone is its start in tz_name.
    8, 10 and 13 digits are a calendar day, seconds and milliseconds. Digits past microseconds are dropped.
    None for gaps, repeated local times, days that don't exist, contradicting weekdays, bare years and months.
    """
    if raw is None:
        return None
    s = raw.strip()
    if not s or not s.isascii() and "−" not in s:
        return None
    home = zone(tz_name) if tz_name else None
    if NUMBER.match(s):
        n = len(s)
        if n == 13 and s.isdigit():
            return int(s) * 1000
        if n == 10 and s.isdigit():
            return int(s) * 1_000_000
        if n == 8 and s.isdigit() and home:
            try:
                return day_start(dt.datetime(int(s[:4]), int(s[4:6]), int(s[6:])), home)
            except ValueError:
                return None
        return None
    m = WHEN.match(s)
    if not m:
        return None
    g = m.groupdict()
    ymd = calendar(g, day_order)
    if not ymd:
        return None
    try:
        t = dt.datetime(*ymd)
    except ValueError:
        return None
    if g["w"] and DAYS.get(g["w"].lower()) != t.weekday():
        return None
    hour = g["H"] or g["cH"]
    if hour is None:
        return day_start(t, home) if home else None
    h, mi, sec = int(hour), int(g["M"] or g["cM"]), int(g["S"] or g["cS"] or 0)
    if g["ap"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"][0] in "Pp")
    frac = ((g["f"] or g["cf"] or "") + "000000")[:6]
    if h == 24 and not mi and not sec and not int(frac):
        h, t = 0, t + dt.timedelta(days=1)
    try:
        t = t.replace(hour=h, minute=mi, second=sec, microsecond=int(frac))
    except ValueError:
        return None
    off, abbr = g["off"], (g["abbr"] or "").upper()
    if off:
        digits = re.sub(r"\D", "", off)
        if not digits:
            return micros(t)
        if len(digits) in (1, 3):
            digits = "0" + digits
        digits = digits.ljust(6, "0")
        oh, om, os_ = int(digits[:2]), int(digits[2:4]), int(digits[4:])
        if om > 59 or os_ > 59 or oh > 18:
            return None
        delta = dt.timedelta(hours=oh, minutes=om, seconds=os_)
        return micros(t + delta if ("-" in off or "−" in off) else t - delta)
    if abbr:
        if abbr in abbrs:
            o = abbreviation_offset(*abbrs[abbr])
            return None if o is None else micros(t - o)
        return micros(t) if abbr in UNIVERSAL else None
    tz = zone(g["tz"]) if g["tz"] else home
    return local_to_utc(t, tz) if tz else None


class FeedZones:
    """What the feeds mean: feed_code -> (zone, day order, abbreviations).

    An abbreviation of another feed counts where it has but one meaning among all feeds.
    """

    def __init__(self, rows: list[tuple[str, str, str, str | None, str | None]]):
        meanings: dict[str, set[tuple[str, bool]]] = {}
        own = {}
        for code, tz, order, std, dst in rows:
            mine = {a.upper(): (tz, day) for a, day in ((std, False), (dst, True)) if a}
            own[code] = (tz, order, mine)
            for a, x in mine.items():
                meanings.setdefault(a, set()).add(x)
        common = {}
        for a, xs in meanings.items():
            if a not in UNIVERSAL and len({abbreviation_offset(*x) for x in xs}) == 1:
                common[a] = next(iter(xs))
        self.feeds = {c: (tz, order, common | mine) for c, (tz, order, mine) in own.items()}
        self.other = (None, None, common)

    @classmethod
    def load(cls, feed_zones: DataFrame) -> FeedZones:
        """From a table of feeds (one row a feed, a reference table of fixed size)."""
        return cls([tuple(r) for r in feed_zones.select("feed_code", "tz_name", "day_order", "std_abbr", "dst_abbr").collect()])

    def parse(self, raw: str | None, feed: str | None) -> int | None:
        try:
            return parse_instant(raw, *self.feeds.get(feed, self.other))
        except (ValueError, OverflowError):
            return None


def canonical_micros(c: Column) -> Column:
    """Instants of values in the normal form, inside the JVM; null for any other text or days that don't exist."""
    return F.when(c.rlike(CANONICAL), F.unix_micros(c.try_cast("timestamp")))


def utc_micros(c: Column) -> Column:
    """Instant of a text that is UTC whether or not it says so; null if it can't be read."""
    t = F.trim(c)
    return F.unix_micros(F.when(t.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp"))


class InstantDictionary:
    """Distinct (raw, feed) -> utc_micros, parsed once each and kept in `path`.

    Nulls are no entries. An entry whose text denotes no single instant is kept with a null instant, so
    that it isn't parsed again.
    """

    def __init__(self, spark, zones: FeedZones, path: str | None = None):
        self.spark, self.zones, self.path = spark, zones, path or work_path(spark, "instants")
        self.table: DataFrame | None = None
        self.counts: DataFrame | None = None  # raw, feed, n of the values taken in last
        try:
            self.table = spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise

    def add(self, values: DataFrame) -> InstantDictionary:
        """Take in columns raw and feed: parse those not known yet and append them."""
        new = values.where(F.col("raw").isNotNull() & ~F.coalesce(F.col("raw").rlike(CANONICAL), F.lit(False)))
        new = new.groupBy("raw", "feed").agg(F.count(F.lit(1)).alias("n"))
        later = self.table is not None
        if later:
            new = self.counts = materialize(new, "counts")
            known = self.table.select("raw", "feed")
            new = new.join(known, [new.raw == known.raw, new.feed.eqNullSafe(known.feed)], "left_anti")
        zones = self.zones

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [zones.parse(r, f) for r, f in zip(b["raw"], b["feed"])]
                yield b.assign(utc_micros=pd.array(got, dtype="Int64"))

        new.mapInPandas(parse, "raw string, feed string, n bigint, utc_micros bigint").write.mode("append").parquet(self.path)
        self.table = self.spark.read.parquet(self.path)
        if not later:
            self.counts = self.table.select("raw", "feed", "n")
        return self

    def match(self, rows: DataFrame, raw: str, feed: str, out: str = "utc_micros") -> DataFrame:
        """rows with the instant of column raw in a new column; rows without one get null. No row is lost."""
        canon = F.coalesce(F.col(raw).rlike(CANONICAL), F.lit(False))
        d = self.table
        counts = d.select("raw", "feed", "n") if self.counts is None else self.counts
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
        hot = counts.where(F.col("n") > max(1, total * HOT_SHARE)).limit(int(1 / HOT_SHARE) + 1)
        hot = d.join(F.broadcast(hot.select(F.col("raw").alias("__hr"), F.col("feed").alias("__hf"))), (F.col("raw") == F.col("__hr")) & F.col("feed").eqNullSafe(F.col("__hf")), "left_semi")
        hot_rows = hot.select("raw", "feed", "utc_micros").collect()
        keyed = rows.withColumn(out, canonical_micros(F.col(raw))).withColumn("__raw", F.when(~canon, F.col(raw)))
        dic = d.select(F.col("raw").alias("__dr"), F.col("feed").alias("__df"), F.col("utc_micros").alias("__du"))
        on = [F.col("__raw") == F.col("__dr"), F.col(feed).eqNullSafe(F.col("__df"))]
        if hot_rows:  # at most 1 / HOT_SHARE entries
            small = self.spark.createDataFrame(hot_rows, "__hr string, __hf string, __hu bigint").withColumn("__hot", F.lit(True))
            keyed = keyed.join(F.broadcast(small), [F.col("__raw") == F.col("__hr"), F.col(feed).eqNullSafe(F.col("__hf"))], "left")
            keyed = keyed.withColumn(out, F.coalesce(out, "__hu")).withColumn("__raw", F.when(F.col("__hot").isNull(), F.col("__raw"))).drop("__hr", "__hf", "__hu", "__hot")
        done = keyed.where(F.col("__raw").isNull()).drop("__raw")
        rest = keyed.where(F.col("__raw").isNotNull()).join(dic, on, "left").withColumn(out, F.col("__du")).drop("__raw", "__dr", "__df", "__du")
        return done.unionByName(rest)


def normalise_instants(rows: DataFrame, raw: str, feed: str, feed_zones: DataFrame, out: str = "utc_micros", path: str | None = None) -> DataFrame:
    """Every row of `rows` with the UTC instant (microseconds since 1970) of its text column `raw` in column `out`.

    Null, blank and unreadable texts get null; repeated rows stay repeated; columns of rows keep their names.
    An empty table gives an empty table. Times without zone are local to the row's feed; a feed that
    feed_zones doesn't know has no zone, so that only texts with their own zone have an instant.
    path: where the dictionary is kept for the next call; by default it serves this call only.
    """
    d = InstantDictionary(rows.sparkSession, FeedZones.load(feed_zones), path)
    d.add(rows.select(F.col(raw).alias("raw"), F.col(feed).alias("feed")))
    return d.match(rows, raw, feed, out)

