"""Conversions and null handling."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import StatementError
from docloom.functions.registry import plain, register

#: Names of types in statements and what they are here.
TYPES = {
    "double": "double", "float": "double", "number": "double", "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "decimal": "decimal(38,18)",
    "string": "string", "varchar": "string", "char": "string", "nchar": "string", "text": "string", "bool": "boolean", "boolean": "boolean",
    "date": "timestamp", "datetime": "timestamp", "time": "timestamp", "timestamp": "timestamp", "objectid": "objectid",
}
#: Type names as TYPEOF gives them.
NAMES = {"integer": "int", "long": "long", "short": "int", "byte": "int", "double": "double", "float": "double", "string": "string", "boolean": "bool", "timestamp": "date", "timestamp_ntz": "date", "date": "date", "array": "array", "struct": "object", "map": "object", "binary": "binData", "void": "null"}


def iso(c: Column) -> Column:
    """A timestamp as text with milliseconds and Z."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def convert(ctx, node, to: str) -> Column:
    kind = TYPES.get(to.lower())
    if kind is None:
        raise StatementError(f"Unknown type {to}")
    c, now = ctx.col(node), ctx.type(node)
    if kind == "objectid":
        return object_id(c)
    if kind == "string":
        if isinstance(now, T.StructType | T.ArrayType | T.MapType):
            return F.to_json(c, {"ignoreNullFields": "false"})
        return iso(c) if isinstance(now, T.TimestampType | T.TimestampNTZType) else c.cast("string")
    if kind == "boolean":
        return F.when(c.isNotNull(), F.lit(True)) if isinstance(now, T.StringType) else c.cast("boolean")
    if kind == "timestamp" and isinstance(now, T.NumericType):
        return F.timestamp_millis(c.cast("bigint"))
    if kind in ("int", "bigint") and isinstance(now, T.TimestampType):
        return F.unix_millis(c).cast(kind)
    return c.cast(kind)


def object_id(c: Column) -> Column:
    """A 12-byte id in lower-case hexadecimal digits; anything else is an error."""
    low = F.lower(c.cast("string"))
    return F.when(c.isNull() | low.rlike(r"\A[0-9a-f]{24}\z"), low).otherwise(F.raise_error(F.concat(F.lit("Not an object id: "), c.cast("string"))).cast("string"))


@register("convert", 2)
def convert_call(ctx, args):
    return convert(ctx, args[0], str(ctx.value(args[1])))


for name, to in {"to_date": "date", "to_string": "string", "to_decimal": "decimal", "to_double": "double", "to_int": "int", "to_long": "long", "to_bool": "bool", "to_objectid": "objectid"}.items():
    register(name, 1)(lambda ctx, args, to=to: convert(ctx, args[0], to))

plain("ifnull coalesce", F.coalesce, 1, None)


@register("typeof", 1)
def type_name(ctx, args):
    kind = ctx.type(args[0]).typeName()
    return F.when(ctx.col(args[0]).isNull(), "null").otherwise(F.lit("decimal" if kind.startswith("decimal") else NAMES.get(kind, kind)))


@register("parse_json", 1)
def parse_json(ctx, args):
    """A literal as a typed value; a column as VARIANT (null where it is no JSON)."""
    node = args[0]
    if hasattr(node, "value"):
        text = str(node.value)
        value = json.loads(text)
        if not isinstance(value, dict | list):
            return F.lit(value)
        return F.from_json(F.lit(text), F.schema_of_json(F.lit(text)))
    return F.try_parse_json(ctx.col(node))


@register("field_exists", 1, 2)
def field_exists(ctx, args):
    """Whether a field has a value: a missing field and a null one can't be told apart once loaded."""
    from docloom.plans.syntax import Literal, Name

    wanted = bool(ctx.value(args[1])) if len(args) > 1 else True
    node = Name(tuple(args[0].value.split("."))) if isinstance(args[0], Literal) else args[0]
    there = ctx.col(node).isNotNull() if ctx.knows(node) else F.lit(False)
    return there if wanted else ~there
