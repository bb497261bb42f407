"""Attribute values written as text, read as typed values inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spark types of the value types an attribute may have.
SPARK_TYPES = {"text": "string", "decimal": "decimal(38,18)", "integer": "bigint", "boolean": "boolean", "date": "date"}
BLANKS = r"^[\s\p{Z}\x00-\x1f]+|[\s\p{Z}\x00-\x1f]+\z"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def trimmed(c: Column) -> Column:
    """Without outer white space of any kind; a text that has a visible sign of ASCII at both ends is taken as it is."""
    sound = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(sound, c).otherwise(F.regexp_replace(c, BLANKS, ""))


def folded(c: Column) -> Column:
    """As names and texts are compared: no outer blanks, no letter case."""
    return F.lower(trimmed(c))


def is_clear(c: Column) -> Column:
    """Null, blank and the word NULL clear an attribute."""
    return F.coalesce(folded(c).isin("", "null"), F.lit(True))


def number(c: Column) -> Column:
    """decimal(38,18) of a number with optional blanks, thousands commas, currency or percent sign; else null."""
    s = F.regexp_replace(c, r"[\s\p{Z}$€£¥%]", "")
    s = F.when(s.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?\z"), F.regexp_replace(s, ",", "")).otherwise(s)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?\z"), s.try_cast("decimal(38,18)"))


def day(c: Column) -> Column:
    """The existing calendar day a text names, with or without a midnight time; else null."""
    s = trimmed(c)
    midnight = r"(?:(?:T|\s+)0?0:00(?::00(?:\.0+)?)?\s*(?:Z|[+-]\d\d:?\d\d)?)?\z"
    ymd = rf"(?i)^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){midnight}"
    plain = r"^(\d{4})(\d{2})(\d{2})\z"
    named = rf"(?i)^(\d{{1,2}})[ -]([a-z]{{3}})[a-z]*[ -](\d{{4}}){midnight}"
    dots = rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){midnight}"
    g = lambda p, i: F.regexp_extract(s, p, i)
    month = (F.instr(F.lit(MONTHS), F.substring(F.lower(g(named, 2)), 1, 3)) + 2) / 3
    text = (
        F.when(s.rlike(ymd), F.concat_ws("-", g(ymd, 1), g(ymd, 3), g(ymd, 4)))
        .when(s.rlike(plain), F.concat_ws("-", g(plain, 1), g(plain, 2), g(plain, 3)))
        .when(s.rlike(named) & (month == F.floor(month)), F.concat_ws("-", g(named, 3), month.cast("int").cast("string"), g(named, 1)))
        .when(s.rlike(dots), F.concat_ws("-", g(dots, 3), g(dots, 2), g(dots, 1)))
    )
    return text.try_cast("date")


def canonical(c: Column, value_type: Column) -> Column:
    """One text for each typed value, so that equal texts are equal values; null where c can't be read as value_type."""
    n = number(c)
    b = folded(c)
    return (
        F.when(value_type == "text", folded(c))
        .when(value_type == "decimal", n.cast("string"))
        .when(value_type == "integer", F.when(n == F.floor(n), n.cast("decimal(20,0)").try_cast("bigint").cast("string")))
        .when(value_type == "boolean", F.when(b.isin("true", "yes", "y", "1"), "true").when(b.isin("false", "no", "n", "0"), "false"))
        .when(value_type == "date", day(c).cast("string"))
    )
