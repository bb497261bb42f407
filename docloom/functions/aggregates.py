"""Aggregates over rows of a group. FIRSTN and LASTN are planned in plans.lower, as they need an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.registry import register
from docloom.plans.syntax import Literal, Name


def field_of(node):
    """A text stands for the field of that name."""
    return Name(tuple(node.value.split("."))) if isinstance(node, Literal) and isinstance(node.value, str) else node


@register("sum", 1, kind="aggregate")
def total(ctx, args):
    return F.coalesce(F.sum(ctx.col(field_of(args[0]))), F.lit(0))


register("avg", 1, kind="aggregate")(lambda ctx, args: F.avg(ctx.col(args[0])))
register("min", 1, kind="aggregate")(lambda ctx, args: F.min(ctx.col(args[0])))
register("max", 1, kind="aggregate")(lambda ctx, args: F.max(ctx.col(args[0])))
register("count", 0, 1, kind="aggregate")(lambda ctx, args: F.count(F.lit(1)))
register("firstn lastn", 1, 2, kind="aggregate")(lambda ctx, args: None)
