"""Mathematical, comparison and boolean functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.registry import plain, register
from docloom.plans.syntax import Literal

for name in "abs acos acosh asin asinh atan atanh ceil exp floor ln log10 sin sinh sqrt tan tanh".split():
    plain(name, getattr(F, name if name != "ln" else "log"))
plain("atan2", F.atan2, 2)
plain("binary_size", F.octet_length)
plain("degrees_to_radians", F.radians)
plain("radians_to_degrees", F.degrees)
plain("divide", lambda a, b: a.cast("double") / b, 2)
plain("log", lambda number, base: F.log(number.cast("double")) / F.log(base.cast("double")), 2)
plain("mod", lambda a, b: a % b, 2)
plain("multiply", lambda *xs: reduce(lambda a, b: a * b, xs), 2, None)
plain("pow", F.pow, 2)
plain("rand", F.rand, 0)
plain("max", F.greatest, 2, None)
plain("min", F.least, 2, None)
plain("sum", lambda *xs: reduce(lambda a, b: a + b, xs), 2, None)


@register("avg", 2, None)
def row_mean(ctx, args):
    """Mean of the arguments that aren't null."""
    xs = F.filter(F.array(*[ctx.col(a).cast("double") for a in args]), lambda x: x.isNotNull())
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))


@register("subtract", 2)
def subtract(ctx, args):
    return ctx.minus(args[0], args[1])


#: Places that a double has at most before and behind its point; rounding beyond these changes nothing, or leaves nothing.
MOST_PLACES = 18


def at_places(ctx, args, cut):
    """cut(x, places) for places that are a literal, or any expression (0 without one, null for null)."""
    x = ctx.col(args[0])
    if len(args) < 2 or isinstance(args[1], Literal) and args[1].value is not None:
        return cut(x, int(ctx.value(args[1])) if len(args) > 1 else 0)
    x, n = x.cast("double"), ctx.col(args[1]).cast("int")
    out = F.when(n > MOST_PLACES, x)
    for k in range(-MOST_PLACES, MOST_PLACES + 1):
        out = out.when(n == k, cut(x, k).cast("double"))
    return out.when(n < -MOST_PLACES, F.lit(0.0))


@register("round", 1, 2)
def half_even(ctx, args):
    return at_places(ctx, args, F.bround)


def cut_off(x: Column, places: int) -> Column:
    """Towards zero, in decimals, so that 1.15 keeps its digits at two places."""
    if places > MOST_PLACES:
        return x
    exact = F.abs(x).try_cast("decimal(38,18)")  # a larger number has no digits behind the point that a double could tell
    whole = F.floor(exact, F.lit(places)).cast("double")
    return F.coalesce(F.when(x < 0, -whole).otherwise(whole), x.cast("double"))


@register("trunc", 1, 2)
def truncate(ctx, args):
    """Towards zero, at a number of places."""
    return at_places(ctx, args, cut_off)


plain("cmp", lambda a, b: F.when(a < b, -1).when(a == b, 0).when(a > b, 1), 2)
plain("eq", lambda a, b: a == b, 2)
plain("ne", lambda a, b: ~a.eqNullSafe(b), 2)
plain("gt", lambda a, b: a > b, 2)
plain("gte", lambda a, b: a >= b, 2)
plain("lt", lambda a, b: a < b, 2)
plain("lte", lambda a, b: a <= b, 2)


@register("and", 2, None)
def conjunction(ctx, args):
    return reduce(lambda a, b: a & b, [ctx.truth(a) for a in args])


@register("or", 2, None)
def disjunction(ctx, args):
    return reduce(lambda a, b: a | b, [ctx.truth(a) for a in args])


@register("not", 1)
def negation(ctx, args):
    return ctx.negated(args[0])


@register("iif", 3)
def either(ctx, args):
    return F.when(ctx.truth(args[0]), ctx.col(args[1])).otherwise(ctx.col(args[2]))
