"""Date and time functions. Where a zone is given, clocks of that zone are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.errors import StatementError
from docloom.functions.registry import plain, register

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")
#: Format letters of statements and of Spark.
LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "L": "SSS", "j": "DDD", "z": "xx", "Z": "xx", "b": "MMM", "B": "MMMM", "%": "%"}


def pattern(fmt: str) -> str:
    """Spark's pattern of a format with percent signs."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in LETTERS:
                raise StatementError(f"Unknown date format %{fmt[i + 1]}")
            out += LETTERS[fmt[i + 1]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
            i += 1
    return out.replace("''", "") if "''" in out and "'" not in fmt else out


def unit_of(ctx, node) -> str:
    u = str(ctx.value(node)).lower().rstrip("s") if str(ctx.value(node)).lower() != "s" else "second"
    if u not in UNITS:
        raise StatementError(f"Unknown unit of time {u}")
    return u


def local(ctx, args, i: int, at: int = 0) -> Column:
    """Argument `at`, moved to the zone of argument i if there is one."""
    d = ctx.col(args[at])
    return F.from_utc_timestamp(d, ctx.col(args[i])) if len(args) > i else d


def week(d: Column) -> Column:
    """Weeks from the first Sunday of the year, 0 before it."""
    return F.floor((F.dayofyear(d) + 7 - F.dayofweek(d)) / 7).cast("int")


PARTS = {
    "day_of_month day": F.dayofmonth, "day_of_week": F.dayofweek, "day_of_year": F.dayofyear, "iso_day_of_week": lambda d: F.weekday(d) + 1, "iso_week": F.weekofyear,
    "iso_week_year": lambda d: F.extract(F.lit("YEAROFWEEK"), d), "hour": F.hour, "millisecond": lambda d: F.date_format(d, "SSS").cast("int"), "minute": F.minute,
    "month": F.month, "second": F.second, "week": week, "year": F.year,
}
for names, get in PARTS.items():
    register(names, 1, 2)(lambda ctx, args, get=get: get(local(ctx, args, 1).cast("timestamp")))

EXTRACTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "milliseconds": PARTS["millisecond"], "week": week, "dow": F.dayofweek}


def truncated(d: Column, unit: str) -> Column:
    """The start of the unit d lies in; weeks begin on Sunday."""
    if unit == "week":
        return F.date_trunc("day", F.timestamp_add("DAY", 1 - F.dayofweek(d), d))
    return F.date_trunc(unit, d)


def moved(d: Column, unit: str, n: Column) -> Column:
    return F.timestamp_add(unit.upper(), n.cast("int"), d)


@register("date_from_string", 1, 5)
def date_from_string(ctx, args):
    s = ctx.col(args[0])
    fmt = ctx.value(args[1]) if len(args) > 1 else None
    lenient = len(args) > 3
    if fmt:
        d = F.try_to_timestamp(s, F.lit(pattern(fmt))) if lenient else F.to_timestamp(s, pattern(fmt))
    else:
        d = s.try_cast("timestamp") if lenient else s.cast("timestamp")
    if len(args) > 2 and ctx.value(args[2]):
        d = F.to_utc_timestamp(d, ctx.col(args[2]))
    if lenient:
        d = F.when(s.isNull(), ctx.col(args[4]).cast("timestamp") if len(args) > 4 else F.lit(None)).otherwise(F.coalesce(d, ctx.col(args[3]).cast("timestamp")))
    return d


def clock(ctx, args, first: int, day: Column) -> Column:
    """day with hours, minutes, seconds, milliseconds of arguments from `first` on, which may exceed their range, and a zone."""
    out = day.cast("timestamp")
    for k, unit in enumerate(("hour", "minute", "second", "millisecond")):
        if len(args) > first + k:
            out = moved(out, unit, ctx.col(args[first + k]))
    return F.to_utc_timestamp(out, ctx.col(args[first + 4])) if len(args) > first + 4 else out


@register("date_from_parts", 1, 8)
def date_from_parts(ctx, args):
    """Parts beyond their range carry over."""
    day = F.make_date(ctx.col(args[0]), F.lit(1), F.lit(1)).cast("timestamp")
    for k, unit in ((1, "month"), (2, "day")):
        if len(args) > k:
            day = moved(day, unit, ctx.col(args[k]) - 1)
    return clock(ctx, args, 3, day)


@register("date_from_iso_parts", 1, 8)
def date_from_iso_parts(ctx, args):
    monday = F.date_trunc("week", F.make_date(ctx.col(args[0]), F.lit(1), F.lit(4)).cast("timestamp"))
    days = (ctx.col(args[1]) - 1) * 7 if len(args) > 1 else F.lit(0)
    if len(args) > 2:
        days = days + ctx.col(args[2]) - 1
    return clock(ctx, args, 3, moved(monday, "day", days))


@register("date_to_string", 1, 4)
def date_to_string(ctx, args):
    fmt = ctx.value(args[1]) if len(args) > 1 else None
    d = ctx.col(args[0])
    zone = ctx.value(args[2]) if len(args) > 2 else None
    d = F.from_utc_timestamp(d, ctx.col(args[2])) if zone else d
    out = F.date_format(d, pattern(fmt) if fmt else "yyyy-MM-dd'T'HH:mm:ss.SSS" + ("" if zone else "'Z'"))
    return F.coalesce(out, ctx.col(args[3])) if len(args) > 3 else out


@register("date_to_parts", 1, 3)
def date_to_parts(ctx, args):
    d = F.from_utc_timestamp(ctx.col(args[0]), ctx.col(args[1])) if len(args) > 1 and ctx.value(args[1]) else ctx.col(args[0])
    d = d.cast("timestamp")
    iso = len(args) > 2 and bool(ctx.value(args[2]))
    day = [("isoWeekYear", PARTS["iso_week_year"]), ("isoWeek", F.weekofyear), ("isoDayOfWeek", PARTS["iso_day_of_week"])] if iso else [("year", F.year), ("month", F.month), ("day", F.dayofmonth)]
    rest = [("hour", F.hour), ("minute", F.minute), ("second", F.second), ("millisecond", PARTS["millisecond"])]
    return F.struct(*[f(d).alias(n) for n, f in day + rest])


@register("date_trunc", 2, 3)
def date_trunc(ctx, args):
    unit = unit_of(ctx, args[1])
    if len(args) > 2:
        return F.to_utc_timestamp(truncated(local(ctx, args, 2), unit), ctx.col(args[2]))
    return truncated(ctx.col(args[0]).cast("timestamp"), unit)


def added(ctx, args, sign: int) -> Column:
    """Days and larger units move the clock of the zone, smaller ones the instant."""
    unit, n = unit_of(ctx, args[1]), ctx.col(args[2]) * sign
    if UNITS.index(unit) > UNITS.index("day"):
        return moved(ctx.col(args[0]).cast("timestamp"), unit, n)
    out = moved(local(ctx, args, 3).cast("timestamp"), unit, n)
    return F.to_utc_timestamp(out, ctx.col(args[3])) if len(args) > 3 else out


register("date_add dateadd", 3, 4)(lambda ctx, args: added(ctx, args, 1))
register("date_subtract datesubtract", 3, 4)(lambda ctx, args: added(ctx, args, -1))


@register("date_diff datediff", 3, 5)
def date_diff(ctx, args):
    """The number of borders of the unit between start and end."""
    unit = unit_of(ctx, args[2])
    a, b = (local(ctx, args, 3, i).cast("timestamp") for i in (0, 1))
    if unit == "millisecond":
        return F.unix_millis(b) - F.unix_millis(a)
    if unit == "week":
        names = "sunday monday tuesday wednesday thursday friday saturday".split()
        first = next((i for i, n in enumerate(names) if len(args) > 4 and n.startswith(str(ctx.value(args[4])).lower()[:3])), 0)
        start = lambda d: F.date_sub(F.to_date(d), F.pmod(F.dayofweek(d) - 1 - first, F.lit(7)))
        return (F.datediff(start(b), start(a)) / 7).cast("bigint")
    return F.timestamp_diff(unit.upper(), truncated(a, unit), truncated(b, unit))


plain("current_date getdate", F.current_timestamp, 0)
