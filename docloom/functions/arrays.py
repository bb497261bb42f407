"""Array, set and object functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import StatementError
from docloom.functions.registry import plain, register


def truthy(kind: T.DataType):
    """Null, false and zero are false, all else is true."""
    if isinstance(kind, T.BooleanType):
        return lambda x: F.coalesce(x, F.lit(False))
    if isinstance(kind, T.NumericType):
        return lambda x: F.coalesce(x != 0, F.lit(False))
    return lambda x: x.isNotNull()


def element(ctx, node) -> T.DataType:
    kind = ctx.type(node)
    if not isinstance(kind, T.ArrayType):
        raise StatementError("An array is needed")
    return kind.elementType


@register("is_array", 1)
def is_array(ctx, args):
    kind = ctx.type(args[0])
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.startswith(F.schema_of_variant(ctx.col(args[0])), F.lit("ARRAY")), F.lit(False))
    return ctx.col(args[0]).isNotNull() if isinstance(kind, T.ArrayType) else F.lit(False)


register("all_elements_true", 1)(lambda ctx, args: F.forall(ctx.col(args[0]), truthy(element(ctx, args[0]))))
register("any_element_true", 1)(lambda ctx, args: F.exists(ctx.col(args[0]), truthy(element(ctx, args[0]))))
plain("size_of_array lengthofarray", lambda a, *_: F.size(a), 1, 2)
plain("first_in_array", lambda a: F.get(a, F.lit(0)))
plain("last_in_array", lambda a: F.try_element_at(a, F.lit(-1)))
plain("reverse_array", F.reverse)
plain("concat_arrays", F.concat, 1, None)
plain("set_union", lambda *xs: reduce(F.array_union, xs) if len(xs) > 1 else F.array_distinct(xs[0]), 1, None)
plain("set_difference", F.array_except, 2)
plain("set_intersection", lambda *xs: reduce(F.array_intersect, xs), 2, None)
plain("set_equals", lambda a, *bs: reduce(lambda x, y: x & y, [(F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0) for b in bs]), 2, None)
plain("set_is_subset", lambda a, b: F.size(F.array_except(a, b)) == 0, 2)
plain("array_elem_at", lambda a, i: F.when(i >= 0, F.get(a, i)).when(i < 0, F.try_element_at(a, F.when(i < 0, i))), 2)


@register("indexof_array", 2, 4)
def index_of(ctx, args):
    """0-based place of a value between start and end, -1 if it isn't there."""
    a, v = ctx.col(args[0]), ctx.col(args[1])
    start = ctx.col(args[2]) if len(args) > 2 else F.lit(0)
    end = ctx.col(args[3]) if len(args) > 3 else F.size(a)
    part = a if len(args) < 3 else F.slice(a, start + 1, F.greatest(end - start, F.lit(0)))
    at = F.array_position(part, v)
    return F.when(at > 0, at - 1 + start).when(at == 0, -1)


@register("array_range", 2, 3)
def array_range(ctx, args):
    """Half-open, in steps that may be negative."""
    a, b = ctx.col(args[0]).cast("bigint"), ctx.col(args[1]).cast("bigint")
    step = ctx.col(args[2]).cast("bigint") if len(args) > 2 else F.lit(1).cast("bigint")
    up = (step > 0) & (a < b)
    down = (step < 0) & (a > b)
    return F.when(up, F.sequence(a, F.when(up, b - 1).otherwise(a), F.when(up, step).otherwise(1))).when(down, F.sequence(a, F.when(down, b + 1).otherwise(a), F.when(down, step).otherwise(-1))).otherwise(F.array().cast("array<bigint>"))


@register("zip_array", 1, None)
def zip_arrays(ctx, args):
    """Arrays of the elements at the same places, as many as the shortest has."""
    cols = [ctx.col(a) for a in args]
    n = F.least(*[F.size(c) for c in cols]) if len(cols) > 1 else F.size(cols[0])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.array(*[F.get(c, i) for c in cols]))).otherwise(F.array_remove(F.array(F.array(*[F.get(c, F.lit(0)) for c in cols])), F.array(*[F.get(c, F.lit(0)) for c in cols])))


def total(a: Column, kind: T.DataType, path: list[str]) -> Column:
    """Sum over a path of nested arrays of objects."""
    if path and isinstance(kind, T.StructType):
        f = next((f for f in kind.fields if f.name == path[0]), None)
        if f is None:
            raise StatementError(f"No field {path[0]} to sum")
        inner = f.dataType
        if isinstance(inner, T.ArrayType):
            return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(total(x[path[0]], inner.elementType, path[1:]), F.lit(0.0)))
        return total(F.transform(a, lambda x: x[path[0]]), inner, path[1:])
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(numeric(x, kind), F.lit(0.0)))


def numeric(x: Column, kind: T.DataType) -> Column:
    """A number as double; what is no number is null and counts for nothing."""
    return x.cast("double") if isinstance(kind, T.NumericType) else x.try_cast("double") if isinstance(kind, T.VariantType) else F.lit(None).cast("double")


def path_of(ctx, args) -> list[str]:
    return [p for a in args[1:] for p in str(ctx.value(a)).split(".")]


@register("sum_array", 1, None)
def sum_array(ctx, args):
    return total(ctx.col(args[0]), element(ctx, args[0]), path_of(ctx, args))


def field(name: str):
    return lambda x: x[name]


@register("avg_array", 1, None)
def avg_array(ctx, args):
    """Mean of the values that aren't null, over a path of fields."""
    a, kind = ctx.col(args[0]), element(ctx, args[0])
    for p in path_of(ctx, args):
        f = next((f for f in kind.fields if f.name == p), None) if isinstance(kind, T.StructType) else None
        if f is None:
            raise StatementError(f"No field {p} to average")
        a, kind = F.transform(a, field(p)), f.dataType
        if isinstance(kind, T.ArrayType):
            a, kind = F.flatten(F.filter(a, lambda x: x.isNotNull())), kind.elementType
    # Evaluated once, inside a lambda.
    there = F.transform(F.array(a), lambda v: F.filter(F.transform(v, lambda x: numeric(x, kind)), lambda x: x.isNotNull()))
    mean = F.transform(there, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)))
    return F.get(mean, F.lit(0))


@register("object_to_array", 1)
def object_to_array(ctx, args):
    """Objects k, v in the order of the fields; values of unlike types become text."""
    o, kind = ctx.col(args[0]), ctx.type(args[0])
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(o), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    if not isinstance(kind, T.StructType):
        raise StatementError("OBJECT_TO_ARRAY needs an object")
    same = len({f.dataType.simpleString() for f in kind.fields}) <= 1
    text = lambda f: F.to_json(o[f.name]) if isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) else o[f.name].cast("string")
    return F.when(o.isNotNull(), F.array(*[F.struct(F.lit(f.name).alias("k"), (o[f.name] if same else text(f)).alias("v")) for f in kind.fields]))


@register("array_to_object", 1)
def array_to_object(ctx, args):
    """A map of [{k, v}] or [[k, v]]; of a repeated key the last value holds."""
    a, kind = ctx.col(args[0]), element(ctx, args[0])
    pair = (lambda x: F.struct(x["k"].cast("string"), x["v"])) if isinstance(kind, T.StructType) else (lambda x: F.struct(F.get(x, F.lit(0)).cast("string"), F.get(x, F.lit(1))))
    pairs = F.transform(a, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["col1"] == x["col1"]))
    return F.map_from_entries(last)


@register("merge_objects", 1, None)
def merge_objects(ctx, args):
    """Fields of all objects, of a repeated name the last; the fields of a null object are left out of the merge."""
    fields: dict[str, Column] = {}
    for a in args:
        if getattr(a, "name", "") == "empty_object":
            continue
        o, kind = ctx.col(a), ctx.type(a)
        if not isinstance(kind, T.StructType):
            raise StatementError("MERGE_OBJECTS needs objects")
        for f in kind.fields:
            fields[f.name] = o[f.name] if f.name not in fields else F.when(o.isNotNull(), o[f.name]).otherwise(fields[f.name])
    return F.struct(*[c.alias(n) for n, c in fields.items()]) if fields else empty()


def empty() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


plain("empty_object", empty, 0)
