"""Expressions of a statement as columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import ColumnDoesNotExistError, StatementError
from docloom.functions import registry
from docloom.functions.conversion import convert
from docloom.functions.dates import EXTRACTS
from docloom.plans import syntax as s

ROOT = "$$ROOT"
WINDOWS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Scope:
    """What names mean: columns of df, joined sides, aliases given before, or the element of an array."""

    df: DataFrame | None
    base: tuple[str, ...] = ()  # names of the first source
    columns: tuple[str, ...] = ()  # its columns
    joined: dict[str, str] = field(default_factory=dict)  # name of a joined side -> column of df
    aliases: dict[str, s.Node] = field(default_factory=dict)
    element: tuple[Column, T.DataType] | None = None
    parent: Scope | None = None

    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields} if self.df is not None else {}


def field_named(kind: T.StructType, name: str) -> T.StructField | None:
    return next((f for f in kind.fields if f.name == name), None) or next((f for f in kind.fields if f.name.lower() == name.lower()), None)


def descend(c: Column, kind: T.DataType, path: list[str]) -> tuple[Column, T.DataType] | None:
    """A path into a value; into an array it gives the array of what lies in the elements."""
    for i, p in enumerate(path):
        if isinstance(kind, T.StructType):
            f = field_named(kind, p)
            if f is None:
                f = field_named(kind, ".".join(path[i:]))
                return (c[f.name], f.dataType) if f else None
            c, kind = c[f.name], f.dataType
        elif isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(p)), kind.valueType
        elif isinstance(kind, T.VariantType):
            return F.try_variant_get(c, "$" + "".join(f"['{x}']" for x in path[i:]), "string"), T.StringType()
        elif isinstance(kind, T.ArrayType):
            inner = kind.elementType
            got = descend(F.lit(None).cast(inner), inner, path[i:])
            return (F.transform(c, lambda x: descend(x, inner, path[i:])[0]), T.ArrayType(got[1])) if got else None
        else:
            return None
    return c, kind


def variants(parts: tuple[str, ...]):
    """Readings of a written path: as it is, then with dots inside quoted parts as steps."""
    yield list(parts)
    flat = [x for p in parts for x in p.split(".")]
    if flat != list(parts):
        yield flat


class Compiler:
    """Columns of nodes in a scope. aggregating: calls of aggregates are allowed."""

    def __init__(self, scope: Scope, options, lower=None, aggregating: bool = False):
        self.scope, self.options, self.lower, self.aggregating = scope, options, lower, aggregating

    def within(self, scope: Scope) -> Compiler:
        return Compiler(scope, self.options, self.lower, self.aggregating)

    # names

    def resolve(self, parts: tuple[str, ...]) -> tuple[Column, T.DataType]:
        sc: Scope | None = self.scope
        while sc is not None:
            for path in variants(parts):
                if got := self._in(sc, path):
                    return got
            sc = sc.parent
        raise ColumnDoesNotExistError(".".join(parts))

    def _in(self, sc: Scope, path: list[str]) -> tuple[Column, T.DataType] | None:
        if sc.element is not None:
            c, kind = sc.element
            if path[0] == ROOT or path[0] in sc.base:
                return descend(c, kind, path[1:])
            return descend(c, kind, path) if isinstance(kind, T.StructType) else None
        kinds = sc.types()
        side = next((n for n in sc.joined if n == path[0]), None) or next((n for n in sc.joined if n.lower() == path[0].lower()), None)
        if side is not None:
            got = descend(quoted(sc.joined[side]), kinds[sc.joined[side]], path[1:])
            if got:
                return got
        rest = path
        if len(path) > 1 and path[0].lower() in {b.lower() for b in sc.base}:
            rest = path[1:]
        elif len(path) == 1 and path[0] in sc.base and path[0] not in sc.columns:
            return F.struct(*[quoted(c) for c in sc.columns]), T.StructType([T.StructField(c, kinds[c]) for c in sc.columns])
        for p in dict.fromkeys([tuple(rest), tuple(path)]):
            for name in (".".join(p), p[0]):
                hit = next((c for c in sc.columns if c == name), None) or next((c for c in sc.columns if c.lower() == name.lower()), None)
                if hit is not None:
                    got = descend(quoted(hit), kinds[hit], [] if name == ".".join(p) else list(p[1:]))
                    if got:
                        return got
        for side in sc.joined.values():
            if got := descend(quoted(side), kinds[side], list(path)):
                return got
        if path[0] in sc.aliases and sc.df is not None:
            node = sc.aliases[path[0]]
            inner = self.within(replace(sc, aliases={k: v for k, v in sc.aliases.items() if k != path[0]}))
            return descend(inner.col(node), inner.type(node), path[1:])
        return None

    def knows(self, node: s.Node) -> bool:
        try:
            self.resolve(node.parts)
            return True
        except ColumnDoesNotExistError:
            return False

    # types

    def type(self, node: s.Node) -> T.DataType:
        if isinstance(node, s.Name):
            return self.resolve(node.parts)[1]
        if isinstance(node, s.Literal):
            v = node.value
            return T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.IntegerType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.TimestampType() if isinstance(v, dt.datetime) else T.StringType()
        probe = self.probe()
        return probe.scope_df().select(probe.col(node).alias("v")).schema[0].dataType

    def scope_df(self) -> DataFrame:
        sc = self.scope
        while sc.df is None:
            sc = sc.parent
        return sc.df

    def probe(self) -> Compiler:
        """The same scope over a table in which elements of arrays are columns."""
        chain, sc = [], self.scope
        while sc is not None:
            chain.append(sc)
            sc = sc.parent
        df = self.scope_df()
        if all(x.element is None for x in chain):
            return self
        df = df.select("*", *[F.lit(None).cast(x.element[1]).alias(f"__e{i}") for i, x in enumerate(chain) if x.element is not None])
        new = None
        for i in reversed(range(len(chain))):
            x = chain[i]
            new = replace(x, parent=new, df=df if x.df is not None else None, element=None if x.element is None else (F.col(f"__e{i}"), x.element[1]))
        return self.within(new)

    def value(self, node: s.Node):
        """The value of a literal."""
        if isinstance(node, s.Literal):
            return node.value
        if isinstance(node, s.Call) and node.name in ("wrapparam", "wrap_param"):
            return self.value(node.args[0])
        if isinstance(node, s.Name):  # a bare word such as a unit
            return node.text
        raise StatementError("A literal is needed")

    # nodes

    def col(self, node: s.Node) -> Column:
        return getattr(self, "on_" + type(node).__name__.lower())(node)

    def truth(self, node: s.Node) -> Column:
        return self.col(node)

    def negated(self, node: s.Node) -> Column:
        c = self.truth(node)
        return ~c if self.options.nulls == "sql" else ~F.coalesce(c, F.lit(False))

    def on_literal(self, n: s.Literal) -> Column:
        return F.lit(n.value)

    def on_name(self, n: s.Name) -> Column:
        return self.resolve(n.parts)[0]

    def on_star(self, n: s.Star) -> Column:
        raise StatementError("* can't be used here")

    def minus(self, a: s.Node, b: s.Node) -> Column:
        """A difference; of two times in milliseconds, of a time and a number the time so many milliseconds before."""
        x, y = self.type(a), self.type(b)
        if isinstance(x, T.TimestampType):
            if isinstance(y, T.TimestampType):
                return F.unix_millis(self.col(a)) - F.unix_millis(self.col(b))
            return F.timestamp_add("MILLISECOND", -self.col(b).cast("int"), self.col(a))
        return self.col(a) - self.col(b)

    def plus(self, a: s.Node, b: s.Node) -> Column:
        for x, y in ((a, b), (b, a)):
            if isinstance(self.type(x), T.TimestampType):
                return F.timestamp_add("MILLISECOND", self.col(y).cast("int"), self.col(x))
        return self.col(a) + self.col(b)

    def on_binary(self, n: s.Binary) -> Column:
        if n.op == "AND":
            return self.truth(n.left) & self.truth(n.right)
        if n.op == "OR":
            return self.truth(n.left) | self.truth(n.right)
        if n.op == "LIKE":
            return self.like(n)
        if n.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(n)
        if n.op == "+":
            return self.plus(n.left, n.right)
        if n.op == "-":
            return self.minus(n.left, n.right)
        a, b = self.col(n.left), self.col(n.right)
        return a * b if n.op == "*" else a.cast("double") / b if n.op == "/" else a % b

    def compare(self, n: s.Binary) -> Column:
        for side, other in ((n.left, n.right), (n.right, n.left)):
            if isinstance(other, s.Literal) and other.value is None and n.op in ("=", "!="):
                c = self.col(side)
                return c.isNull() if n.op == "=" else c.isNotNull()
        for side, other, turned in ((n.left, n.right, False), (n.right, n.left, True)):
            if isinstance(side, s.Name):
                c, kind = self.resolve(side.parts)
                if isinstance(kind, T.ArrayType) and not (isinstance(other, s.Name) and isinstance(self.type(other), T.ArrayType)) and not isinstance(other, s.Call | s.SubQuery):
                    v = self.col(other)
                    hit = F.exists(c, lambda x: self.ordered("=" if n.op == "!=" else n.op, v if turned else x, x if turned else v))
                    return ~F.coalesce(hit, F.lit(False)) if n.op == "!=" else hit
        if isinstance(n.right, s.Call) and n.right.name == "empty_object" and isinstance(self.type(n.left), T.StructType):
            c, kind = self.col(n.left), self.type(n.left)
            bare = c.isNotNull()
            for f in kind.fields:
                bare = bare & c[f.name].isNull()
            return bare if n.op == "=" else ~bare
        return self.ordered(n.op, self.col(n.left), self.col(n.right))

    def ordered(self, op: str, a: Column, b: Column) -> Column:
        if op == "!=":
            return a != b if self.options.nulls == "sql" else ~a.eqNullSafe(b)
        return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def like(self, n: s.Binary) -> Column:
        """Without regard to letter case; % counts at the ends only, inside and _ they are ordinary characters."""
        c = F.lower(self.col(n.left).cast("string"))
        p = self.value(n.right)
        if p is None:
            return F.lit(None).cast("boolean")
        text, head, tail = str(p), False, False
        if text.startswith("%"):
            text, head = text[1:], True
        if text.endswith("%"):
            text, tail = text[:-1], True
        t = F.lower(F.lit(text))
        return F.contains(c, t) if head and tail else F.endswith(c, t) if head else F.startswith(c, t) if tail else c == t

    def on_unary(self, n: s.Unary) -> Column:
        return self.negated(n.arg) if n.op == "NOT" else -self.col(n.arg)

    def on_is(self, n: s.Is) -> Column:
        c = self.col(n.arg)
        hit = c.isNull() if n.what is None else c.eqNullSafe(F.lit(n.what))
        return ~hit if n.negated else hit

    def on_inlist(self, n: s.InList) -> Column:
        c, kind = self.col(n.arg), self.type(n.arg)
        items = [self.col(x) for x in n.items if not (isinstance(x, s.Literal) and x.value is None)]
        holds_null = len(items) < len(n.items)
        if isinstance(kind, T.ArrayType):
            hit = F.exists(c, lambda x: x.isin(items))
        else:
            hit = c.isin(items) if items else F.lit(False)
        if holds_null:
            hit = F.coalesce(hit, F.lit(False)) | c.isNull()
        return hit if not n.negated else ~hit if self.options.nulls == "sql" else ~F.coalesce(hit, F.lit(False))

    def on_inquery(self, n: s.InQuery) -> Column:
        raise StatementError("Sub queries can be used with IN in WHERE only")

    def on_between(self, n: s.Between) -> Column:
        c = self.col(n.arg)
        hit = (c >= self.col(n.low)) & (c <= self.col(n.high))
        return ~F.coalesce(hit, F.lit(False)) if n.negated else hit

    def on_case(self, n: s.Case) -> Column:
        out = None
        for cond, then in n.whens:
            out = (F if out is None else out).when(self.truth(cond), self.col(then))
        return out if n.otherwise is None else out.otherwise(self.col(n.otherwise))

    def on_cast(self, n: s.Cast) -> Column:
        return convert(self, n.arg, n.to)

    def on_extract(self, n: s.Extract) -> Column:
        if n.part not in EXTRACTS:
            raise StatementError(f"EXTRACT of {n.part} is not supported")
        return EXTRACTS[n.part](self.col(n.arg).cast("timestamp"))

    def on_call(self, n: s.Call) -> Column:
        if registry.is_aggregate(n.name, n.args, n.distinct) and (self.aggregating or registry.find(n.name, registry.SCALARS) is None):
            if not self.aggregating:
                raise StatementError(f"Aggregate {n.name.upper()} can't be used here")
            if n.name == "count" and n.distinct:
                c = Compiler(self.scope, self.options, self.lower).col(n.args[0])
                return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))
            f = registry.AGGREGATES[n.name]
            registry.check(f, len([a for a in n.args if not isinstance(a, s.Star)]))
            return f.build(Compiler(self.scope, self.options, self.lower), list(n.args))
        f = registry.find(n.name, registry.SCALARS)
        if f is None:
            raise StatementError(f"Function not found: {n.name}")
        registry.check(f, len(n.args))
        return f.build(self, list(n.args))

    def on_over(self, n: s.Over) -> Column:
        from pyspark.sql import Window

        if not n.order:
            raise StatementError(f"{n.name} needs ORDER BY")
        w = Window.partitionBy(*[self.col(p) for p in n.partition]).orderBy(*[self.col(e).asc() if up else self.col(e).desc() for e, up in n.order])
        if n.name in WINDOWS:
            return WINDOWS[n.name]().over(w)
        if n.name == "NTILE":
            return F.ntile(int(self.value(n.args[0]))).over(w)
        if n.name in ("LAG", "LEAD"):
            return getattr(F, n.name.lower())(self.col(n.args[0]), int(self.value(n.args[1])) if len(n.args) > 1 else 1).over(w)
        raise StatementError(f"Unsupported window function {n.name}")

    # sub-selects

    def on_subquery(self, n: s.SubQuery) -> Column:
        q = n.query
        if not q.sources:
            return self.object_of(q)
        if len(q.sources) > 1 or q.sources[0].name is None or q.sets:
            raise StatementError("Sub query operations not supported")
        src = q.sources[0]
        try:
            arr, kind = self.resolve(tuple(src.name.split(".")))
        except ColumnDoesNotExistError:
            raise StatementError("Sub query operations not supported") from None
        if not isinstance(kind, T.ArrayType):
            raise StatementError(f"{src.name} is no array")
        return self.array_select(q, arr, kind.elementType, (src.alias or src.name.split(".")[-1],))

    def object_of(self, q: s.Select) -> Column:
        cols = []
        for i in q.items:
            name = i.alias or (i.expr.parts[-1].split(".")[-1] if isinstance(i.expr, s.Name) else None)
            if name is None:
                raise StatementError("Fields of an object need an alias")
            cols.append(self.col(i.expr).alias(name))
        return F.struct(*cols)

    def array_select(self, q: s.Select, arr: Column, kind: T.DataType, names: tuple[str, ...]) -> Column:
        """Filter, sort, project and slice the elements of an array."""
        at = lambda x: self.within(Scope(None, names, element=(x, kind), parent=self.scope))
        if q.group or any(isinstance(x, s.Call) and registry.is_aggregate(x.name, x.args) and x.name not in registry.SCALARS for i in q.items for x in s.walk(i.expr)):
            raise StatementError("Aggregates are not supported in a sub select of an array")
        if q.where is not None:
            arr = F.filter(arr, lambda x: F.coalesce(at(x).truth(q.where), F.lit(False)))
        if q.order:

            def order(a: Column, b: Column) -> Column:
                out = F.lit(0)
                for e, up in reversed(q.order):
                    x, y = at(a).col(e), at(b).col(e)
                    less, more = (-1, 1) if up else (1, -1)  # null is least
                    out = F.when(x.eqNullSafe(y), out).when(x.isNull() | (x < y), less).otherwise(more)
                return out

            arr = F.array_sort(arr, order)
        if not (len(q.items) == 1 and isinstance(q.items[0].expr, s.Star)):
            arr = F.transform(arr, lambda x: self.project_element(at(x), q, x, kind))
        if q.limit is not None or q.offset is not None:
            arr = F.slice(arr, (q.offset or 0) + 1, q.limit if q.limit is not None else 2**31 - 1)
        return arr

    def project_element(self, c: Compiler, q: s.Select, x: Column, kind: T.DataType) -> Column:
        if len(q.items) == 1 and q.items[0].alias == ROOT:
            return c.col(q.items[0].expr)
        cols: dict[str, Column] = {}
        for i in q.items:
            if isinstance(i.expr, s.Star):
                cols |= {f.name: x[f.name] for f in kind.fields}
                continue
            name = i.alias or (i.expr.parts[-1].split(".")[-1] if isinstance(i.expr, s.Name) else None)
            if name is None:
                raise StatementError("Columns of a sub select need an alias")
            cols[name] = c.col(i.expr)
        return F.struct(*[v.alias(k) for k, v in cols.items()])
