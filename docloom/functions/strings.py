"""String functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.registry import plain, register

plain("concat", F.concat, 1, None)
plain("trim", lambda s, chars=None: F.btrim(s) if chars is None else F.btrim(s, chars), 1, 2)
plain("ltrim", lambda s, chars=None: F.ltrim(s) if chars is None else F.ltrim(s, chars), 1, 2)
plain("rtrim", lambda s, chars=None: F.rtrim(s) if chars is None else F.rtrim(s, chars), 1, 2)
plain("substr substr_cp", lambda s, start, size: F.substring(s, start + 1, size), 3)
plain("substr_bytes", lambda s, start, size: F.decode(F.substring(s.cast("binary"), start + 1, size), "UTF-8"), 3)
plain("left", F.left, 2)
plain("starts_with", F.startswith, 2)
plain("strpos", F.instr, 2)
plain("locate", lambda part, s: F.instr(s, part), 2)
plain("upper to_upper", lambda s: F.coalesce(F.upper(s), F.lit("")))
plain("lower to_lower", lambda s: F.coalesce(F.lower(s), F.lit("")))
plain("replace_all", F.replace, 3)
plain("strlen", F.octet_length)
plain("strlen_cp", F.char_length)


@register("replace", 3)
def replace_first(ctx, args):
    s, find, by = (ctx.col(a) for a in args)
    at = F.instr(s, find)
    return F.when(at == 0, s).otherwise(F.overlay(s, by, at, F.length(find)))


@register("split", 2)
def split(ctx, args):
    """Parts between a delimiter, which is taken as it is."""
    mark = F.replace(ctx.col(args[1]).cast("string"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.split(ctx.col(args[0]), F.concat(F.lit("\\Q"), mark, F.lit("\\E")), F.lit(-1))


@register("join", 2)
def join(ctx, args):
    return F.array_join(ctx.col(args[0]).cast("array<string>"), str(ctx.value(args[1])))


@register("wrapparam wrap_param", 1, 2)
def parameter(ctx, args):
    """A literal whose escapes the lexer has read already."""
    return F.lit(ctx.value(args[0]))
