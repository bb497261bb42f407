"""Statements as DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import ColumnDoesNotExistError, StatementError
from docloom.functions import registry
from docloom.functions.aggregates import field_of
from docloom.operators import joins, pivots, ranking
from docloom.plans import syntax as s
from docloom.plans.expressions import ROOT, Compiler, Scope, quoted
from docloom.plans.lexer import tokens
from docloom.plans.parser import Parser, named

HIDDEN = "__sort"


def conjuncts(n: s.Node | None) -> list[s.Node]:
    if isinstance(n, s.Binary) and n.op == "AND":
        return conjuncts(n.left) + conjuncts(n.right)
    return [] if n is None else [n]


def shape_of(i: s.Item) -> str | None:
    return i.expr.name if isinstance(i.expr, s.Call) and i.expr.name in registry.SHAPES else None


def aggregates_in(n: s.Node) -> bool:
    if isinstance(n, s.Over):
        return False
    if isinstance(n, s.Call) and registry.is_aggregate(n.name, n.args, n.distinct):
        return True
    return any(aggregates_in(c) for c in children(n))


def children(n: s.Node) -> list[s.Node]:
    out: list[s.Node] = []
    for v in vars(n).values():
        stack = [v]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple | list):
                stack.extend(x)
            elif isinstance(x, s.Node) and not isinstance(x, s.Select):
                out.append(x)
    return out


class NeedsArray(Exception):
    """A side that was to be totalled has to be gathered."""


class Lowering:
    """Turns trees into DataFrames over a catalog of tables."""

    def __init__(self, catalog, options):
        self.catalog, self.options = catalog, options

    def run(self, q: s.Select) -> DataFrame:
        if not q.sets:
            return self.select(q)
        order, limit, offset = q.order, q.limit, q.offset
        first = replace(q, sets=[], order=[], limit=None, offset=None)
        out = self.select(first)
        for kind, right in q.sets:
            out = self.combine(kind, out, self.run(right))
        return self.cut(self.sort_output(out, order), limit, offset)

    def combine(self, kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
        if kind.startswith("UNION"):
            both = a.unionByName(b, allowMissingColumns=True)
            return both if kind == "UNION ALL" else both.distinct()
        if set(a.columns) == set(b.columns):
            b = b.select(*[quoted(c) for c in a.columns])
        elif len(a.columns) == len(b.columns):
            b = b.toDF(*a.columns)
        else:
            raise StatementError(f"{kind} needs as many columns on both sides")
        return a.intersect(b) if kind == "INTERSECT" else a.subtract(b)

    def sort_output(self, df: DataFrame, order: list[tuple[s.Node, bool]]) -> DataFrame:
        if not order:
            return df
        c = Compiler(Scope(df, (), tuple(df.columns)), self.options)
        return df.orderBy(*[c.col(e).asc() if up else c.col(e).desc() for e, up in order])

    @staticmethod
    def cut(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
        if offset:
            df = df.offset(offset)
        return df.limit(min(limit, 2**31 - 1)) if limit is not None else df

    # sources

    def source(self, src: s.Source) -> DataFrame:
        if src.query is not None:
            df = self.run(src.query)
        else:
            df = self.catalog.table(src.name)
        turns = [h for h in src.hints if h.lower().startswith("unpivot")]
        for h in src.hints:
            if h.lower().startswith("pivot"):
                df = self.pivot(df, h)
        return pivots.unpivot(df, [self.unpivot_args(h) for h in turns]) if turns else df

    @staticmethod
    def arguments(hint: str) -> list[str]:
        """Arguments between the outer brackets of a hint, parted by commas outside inner brackets."""
        a, z = hint.find("("), hint.rfind(")")
        if a < 0 or z < a:
            raise StatementError(f"Unreadable hint {hint}")
        out, depth, last, body = [], 0, 0, hint[a + 1 : z]
        for i, ch in enumerate(body + ","):
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 0:
                out.append(body[last:i].strip())
                last = i + 1
        return out

    @classmethod
    def listed(cls, text: str) -> list[str]:
        if not (text.startswith("[") and text.endswith("]")):
            raise StatementError(f"A list in brackets is needed, not {text}")
        return [x.strip().strip("'\"`") for x in cls.arguments("(" + text[1:-1] + ")") if x.strip()]

    def pivot(self, df: DataFrame, hint: str) -> DataFrame:
        args = self.arguments(hint)
        if len(args) != 3:
            raise StatementError("PIVOT takes aggregates, a column and a list of values")
        c = Compiler(Scope(df, (), tuple(df.columns)), self.options)
        made = []
        if not (args[0].startswith("[") and args[0].endswith("]")):
            raise StatementError("PIVOT needs its aggregates in brackets")
        for text in self.arguments("(" + args[0][1:-1] + ")"):
            item = Parser(tokens(text)).item()
            call = item.expr
            if not isinstance(call, s.Call) or not registry.is_aggregate(call.name, call.args):
                raise StatementError(f"PIVOT needs an aggregate, not {text}")
            value = F.lit(1) if not call.args or isinstance(call.args[0], s.Star) or call.name == "count" else c.col(field_of(call.args[0]))
            f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}.get(call.name)
            if f is None:
                raise StatementError(f"PIVOT can't take {call.name}")
            made.append((item.alias or call.name, lambda at, f=f, value=value: f(F.when(at, value))))
        key = named(Parser(tokens(args[1])).expr())
        kind = c.type(key)
        values = [int(v) if isinstance(kind, T.IntegralType) else float(v) if isinstance(kind, T.NumericType) else v for v in self.listed(args[2])]
        return pivots.pivot(df, c.col(key), values, made)

    def unpivot_args(self, hint: str) -> tuple[str, str, list[str]]:
        args = self.arguments(hint)
        if len(args) != 3:
            raise StatementError("UNPIVOT takes a value column, a name column and a list of columns")
        return args[0].strip("'\"`"), args[1].strip("'\"`"), self.listed(args[2])

    @staticmethod
    def counted_sides(q: s.Select) -> tuple[s.Select, dict[str, list[str]]]:
        """The statement with counts, sums and means of nested sides read from totals, and the fields that each such side totals.

        A side is one if nothing else than SIZE_OF_ARRAY, SUM_ARRAY or AVG_ARRAY of a single field uses it, so that no array
        of its rows is made.
        """
        found: dict[str, list[str]] = {}
        outer = {x for src in q.sources for x in (src.alias, src.name) if x}
        for src in q.sources[1:]:
            name = src.alias
            if not name or src.hints or src.join == "full" or q.sets or [x.label for x in q.sources].count(name) > 1:
                continue
            rest = s.Select(q.items, where=q.where, group=q.group, having=q.having, order=q.order)
            uses = [n for n in s.deep(rest) if isinstance(n, s.Name) and n.parts[0] == name or isinstance(n, s.Star)]
            uses += [x for x in s.deep([q2.on for q2 in q.sources if q2 is not src and q2.on is not None]) if isinstance(x, s.Name) and x.parts[0] == name]
            calls = [n for n in s.deep(rest) if isinstance(n, s.Call) and n.name in ("size_of_array", "lengthofarray", "sum_array", "avg_array") and n.args and n.args[0] == s.Name((name,))]
            plain = [n for n in calls if len(n.args) == (1 if n.name in ("size_of_array", "lengthofarray") else 2) and all(isinstance(a, s.Literal) and isinstance(a.value, str) and "." not in a.value for a in n.args[1:])]
            named_elsewhere = any(isinstance(n, s.Literal) and isinstance(n.value, str) and n.value.split(".")[0] in outer and n.value.split(".")[0] == name for n in s.deep(rest))
            if calls and len(calls) == len(plain) == len(uses) and not named_elsewhere and all(c.lower() != name.lower() for c in (i.alias or "" for i in q.items)):
                found[name] = list(dict.fromkeys(n.args[1].value for n in plain if len(n.args) > 1))
        if not found:
            return q, found

        def turn(n: s.Node) -> s.Node | None:
            if not (isinstance(n, s.Call) and n.args and isinstance(n.args[0], s.Name) and len(n.args[0].parts) == 1 and n.args[0].parts[0] in found):
                return None
            at = lambda x: s.Name((n.args[0].parts[0], x))
            if len(n.args) == 1:
                return at("n")
            i = found[n.args[0].parts[0]].index(n.args[1].value)
            if n.name == "sum_array":
                return s.Call("coalesce", (at(f"s{i}"), s.Literal(0.0)))
            return s.Case(((s.Binary(">", at(f"c{i}"), s.Literal(0)), s.Binary("/", at(f"s{i}"), at(f"c{i}"))),))

        return s.rewritten(q, turn), found

    def sources(self, q: s.Select, totals: dict[str, list[str]] | None = None) -> Scope:
        first = q.sources[0]
        df = self.source(first)
        names = tuple(x for x in (first.alias, None if first.alias else first.name) if x)
        scope = Scope(df, names, tuple(df.columns))
        for src in q.sources[1:]:
            scope = self.join(scope, src, q, (totals or {}).get(src.label))
        return scope

    @staticmethod
    def needed(q: s.Select, src: s.Source, columns: list[str]) -> list[str]:
        """The columns of a joined side that a statement may use; gathered rows are not pruned by the optimizer.

        All, if a star or the side as a whole is used other than to be counted or summed; else those whose name occurs.
        """
        names, counted = {x for x in (src.alias, src.name) if x}, set()
        for n in s.deep(q):
            if isinstance(n, s.Call) and n.name in ("size_of_array", "sum_array", "avg_array", "count") and n.args:
                counted.add(id(n.args[0]))
        said: set[str] = set()
        for n in s.deep(q):
            if isinstance(n, s.Star) and id(n) not in counted and (n.table is None or n.table in names):
                return columns
            if isinstance(n, s.Name):
                if n.parts[-1] in names and id(n) not in counted:
                    return columns
                said.update(p for part in n.parts for p in (part.lower(), *part.lower().split(".")))
            if isinstance(n, s.Literal) and isinstance(n.value, str):
                said.update((n.value.lower(), *n.value.lower().split(".")))
        return [c for c in columns if c.lower() in said] or columns[:1]

    def join(self, scope: Scope, src: s.Source, q: s.Select, totals: list[str] | None = None) -> Scope:
        right = self.source(src)
        kept = self.needed(q, src, right.columns)
        fields = ["`" + c.replace("`", "``") + "`" for c in kept]
        label = src.label
        side = f"__side_{len(scope.joined)}_{label}"
        flags = {h.lower() for h in src.hints}
        mode = joins.UNWIND if "unwind" in flags or self.options.unwind_joins else joins.FIRST if "first" in flags else joins.LAST if "last" in flags else joins.NEST
        if src.join == "full":
            mode = joins.UNWIND
        names = tuple(x for x in (src.alias, src.name) if x)
        there = Compiler(Scope(right, names, tuple(right.columns)), self.options)
        here = Compiler(scope, self.options)
        pairs = []
        for c in conjuncts(src.on):
            pair = self.equal_sides(c, here, there, names)
            if pair is None and self.concerns(c, here, there, names):
                right = right.filter(there.truth(c))  # before rows are gathered
            else:
                pairs.append(pair)
        if totals is not None and pairs and all(pairs) and mode == joins.NEST:
            where = {f: next((c for c in right.schema.fields if c.name == f), None) for f in totals}
            if all(c is not None and isinstance(c.dataType, T.NumericType) for c in where.values()):
                mode, fields = joins.TOTALS, ["`" + f + "`" for f in totals]
        if totals is not None and mode != joins.TOTALS:
            raise NeedsArray
        if pairs and all(pairs):
            df = joins.by_keys(scope.df, [here.col(a) for a, _ in pairs], right, [there.col(b) for _, b in pairs], side, src.join, mode, fields)
        else:
            if src.join == "full":
                raise StatementError("Join not supported: FULL JOIN needs equality of columns")
            kind = T.StructType([right.schema[c] for c in kept])
            probe = scope.df.select("*", F.lit(None).cast(kind).alias(side))
            both = Compiler(replace(scope, df=probe, joined=scope.joined | {n: side for n in names}), self.options)
            on = both.truth(src.on)
            df = joins.by_condition(scope.df, right, on, side, src.join, mode, fields)
        return replace(scope, df=df, joined=scope.joined | {label: side})

    @staticmethod
    def concerns(n: s.Node, here: Compiler, there: Compiler, names: tuple[str, ...]) -> bool:
        """Whether a condition is about the joined side only."""
        used = [x for x in s.deep(n) if isinstance(x, s.Name)]
        own = lambda x: x.parts[0] in names and len(x.parts) > 1
        return bool(used) and all(there.knows(x) and (own(x) or not here.knows(x)) for x in used) and not any(isinstance(x, s.Select) for x in s.deep(n))

    @staticmethod
    def equal_sides(n: s.Node, here: Compiler, there: Compiler, names: tuple[str, ...]) -> tuple[s.Name, s.Name] | None:
        """(left, right) of an equality between a column of each side."""
        if not (isinstance(n, s.Binary) and n.op == "=" and isinstance(n.left, s.Name) and isinstance(n.right, s.Name)):
            return None
        own = lambda x: x.parts[0] in names and len(x.parts) > 1
        for a, b in ((n.left, n.right), (n.right, n.left)):
            if own(b) and not own(a) and here.knows(a) and there.knows(b):
                return a, b
        for a, b in ((n.left, n.right), (n.right, n.left)):
            if not own(a) and here.knows(a) and there.knows(b) and not (here.knows(b) and there.knows(a)):
                return a, b
        for a, b in ((n.left, n.right), (n.right, n.left)):
            if not own(a) and here.knows(a) and there.knows(b):
                return a, b
        return None

    # filters

    def where(self, scope: Scope, where: s.Node | None) -> Scope:
        plain: list[s.Node] = []
        for c in conjuncts(where):
            if isinstance(c, s.InQuery) or (isinstance(c, s.Unary) and c.op == "NOT" and isinstance(c.arg, s.InQuery)):
                q = c if isinstance(c, s.InQuery) else replace(c.arg, negated=not c.arg.negated)
                scope = self.membership(scope, q)
            else:
                plain.append(c)
        for c in plain:
            c, scope, marks = self.marked(c, scope)
            kept = scope.df.filter(Compiler(scope, self.options).truth(c))
            scope = replace(scope, df=kept.drop(*marks))
        return scope

    def values_of(self, q: s.InQuery) -> DataFrame:
        sub = self.run(q.query)
        if len(sub.columns) != 1:
            raise StatementError("A sub query of IN must select one column")
        return sub.toDF("__in")

    def membership(self, scope: Scope, q: s.InQuery) -> Scope:
        sub = self.values_of(q)
        c = Compiler(scope, self.options).col(q.arg)
        df = scope.df.withColumn("__key", c)
        on = F.col("__key").eqNullSafe(F.col("__in")) if q.negated and self.options.nulls != "sql" else F.col("__key") == F.col("__in")
        return replace(scope, df=df.join(sub, on, "left_anti" if q.negated else "left_semi").drop("__key"))

    def marked(self, n: s.Node, scope: Scope) -> tuple[s.Node, Scope, list[str]]:
        """A predicate in which sub-queries inside OR or NOT are columns that say whether the value is among theirs."""
        marks: list[str] = []
        state = {"scope": scope}

        def turn(x):
            if isinstance(x, s.InQuery):
                sc, name = state["scope"], f"__mark{len(marks)}"
                marks.append(name)
                c = Compiler(sc, self.options).col(x.arg)
                sub = self.values_of(x).distinct().withColumn(name, F.lit(True))
                df = sc.df.withColumn("__key", c).join(sub, F.col("__key").eqNullSafe(F.col("__in")), "left").drop("__key", "__in")
                state["scope"] = replace(sc, df=df, columns=(*sc.columns, name))
                return s.Is(s.Name((name,)), None, not x.negated)
            if isinstance(x, s.Binary):
                return s.Binary(x.op, turn(x.left), turn(x.right))
            if isinstance(x, s.Unary):
                return s.Unary(x.op, turn(x.arg))
            return x

        if not any(isinstance(x, s.InQuery) for x in s.walk(n)):
            return n, scope, []
        out = turn(n)
        return out, state["scope"], marks

    # selects

    def select(self, q: s.Select) -> DataFrame:
        if not q.sources:
            raise StatementError("A FROM clause is needed")
        counted, totals = self.counted_sides(q)
        try:
            base = self.sources(counted, totals)
            q = counted
        except NeedsArray:
            base = self.sources(q)
        scope = self.where(base, q.where)
        grouped = q.group is not None or any(aggregates_in(i.expr) for i in q.items)
        if grouped:
            out, hidden = self.grouped(q, scope)
        else:
            out, hidden = self.projected(q, scope)
        if q.having is not None:
            if any(isinstance(x, s.Call) and registry.is_aggregate(x.name, x.args) for x in s.walk(q.having)):
                raise StatementError("HAVING takes aliases of aggregates, not aggregates")
            out = out.filter(Compiler(Scope(out, scope.base, tuple(out.columns)), self.options).truth(q.having))
        full = any(x.join == "full" for x in q.sources)
        if (q.distinct or full) and not grouped:
            if any(h.startswith(HIDDEN) for h in hidden if h):
                raise StatementError("ORDER BY of DISTINCT rows takes selected columns")
            out = out.distinct()
        if q.order:
            keys = []
            for (_, up), h in zip(q.order, hidden):
                keys.append(h.asc() if up else h.desc()) if isinstance(h, Column) else keys.append(F.col(h).asc() if up else F.col(h).desc())
            out = out.orderBy(*keys).drop(*[h for h in hidden if isinstance(h, str)])
        if self.options.unset_id and "_id" in out.columns and not any(isinstance(i.expr, s.Name) and i.expr.parts[-1] == "_id" for i in q.items):
            out = out.drop("_id")
        limit = q.limit if q.limit is not None else self.options.default_limit
        return self.cut(out, limit, q.offset)

    def name_of(self, i: s.Item) -> str:
        if i.alias:
            return i.alias
        if isinstance(i.expr, s.Name):
            return i.expr.parts[-1].split(".")[-1]
        raise StatementError(f"An alias is needed for {self.said(i.expr)}")

    @staticmethod
    def said(n: s.Node) -> str:
        return f"function {n.name}" if isinstance(n, s.Call) else f"window function {n.name}" if isinstance(n, s.Over) else {"Binary": "a calculation", "Case": "CASE", "Cast": "CAST", "Literal": "a literal"}.get(type(n).__name__, "an expression")

    def order_keys(self, q: s.Select, scope: Scope, names: list[str], allow: bool) -> tuple[list, dict[str, Column]]:
        """For each sort key a column of the output or the name of a hidden one, and the hidden ones."""
        out, hidden = [], {}
        low = {n.lower(): n for n in names}
        for k, (e, _) in enumerate(q.order):
            if isinstance(e, s.Literal) and isinstance(e.value, int) and not isinstance(e.value, bool) and 1 <= e.value <= len(names):
                out.append(quoted(names[e.value - 1]))
                continue
            if not isinstance(e, s.Name):
                raise StatementError("ORDER BY takes columns")
            parts = e.parts[1:] if len(e.parts) > 1 and e.parts[0] in (*scope.base, *scope.joined, *[x.name or "" for x in q.sources]) else e.parts
            full = ".".join(parts)
            if full in names or full.lower() in low:
                out.append(quoted(full if full in names else low[full.lower()]))
                continue
            head = parts[0]
            if head in names and head not in scope.columns:
                c = quoted(head)
                for p in parts[1:]:
                    c = c[p]
                out.append(c)
                continue
            if not allow:
                raise ColumnDoesNotExistError(full)
            name = f"{HIDDEN}{k}"
            hidden[name] = Compiler(scope, self.options).col(e)
            out.append(name)
        return out, hidden

    def grouped(self, q: s.Select, scope: Scope) -> tuple[DataFrame, list]:
        if any(isinstance(i.expr, s.Star) for i in q.items):
            raise StatementError("SELECT * can't be grouped")
        if any(shape_of(i) == "unwind" for i in q.items):
            raise StatementError("UNWIND can't be grouped")
        items = [i for i in q.items if shape_of(i) != "unset"]
        plain, agg = Compiler(scope, self.options), Compiler(scope, self.options, aggregating=True)
        keys = {self.name_of(i): plain.col(i.expr) for i in items if not aggregates_in(i.expr)}
        made = {self.name_of(i): i.expr for i in items if aggregates_in(i.expr)}
        ends = {n: e for n, e in made.items() if isinstance(e, s.Call) and e.name in ("firstn", "lastn")}
        sums = {n: agg.col(e) for n, e in made.items() if n not in ends}
        df = scope.df
        if not made:
            out = df.select(*[c.alias(n) for n, c in keys.items()]).distinct()
        elif keys:
            named_keys = [c.alias(n) for n, c in keys.items()]
            out = df.groupBy(*named_keys).agg(*[c.alias(n) for n, c in sums.items()]) if sums else df.select(*named_keys).distinct()
        else:
            out = df.agg(*[c.alias(n) for n, c in sums.items()]) if sums else df.sparkSession.range(1).select(F.lit(1).alias("__one"))
        for n, e in ends.items():
            out = self.with_ends(out, scope, keys, n, e)
        out = out.select(*[quoted(self.name_of(i)) for i in items])
        ordered, _ = self.order_keys(q, scope, out.columns, False)
        return out, ordered

    def with_ends(self, out: DataFrame, scope: Scope, keys: dict[str, Column], name: str, e: s.Call) -> DataFrame:
        """The first or last n rows or values of each group, in the order read; only those n are gathered."""
        c = Compiler(scope, self.options)
        n = int(c.value(e.args[0]))
        value = c.col(field_of(e.args[1])) if len(e.args) > 1 else F.struct(*[quoted(x) for x in scope.columns])
        rows = scope.df.select(*[k.alias(f"__g{i}") for i, k in enumerate(keys.values())], F.monotonically_increasing_id().alias("__at"), value.alias("__v"))
        groups = [f"__g{i}" for i in range(len(keys))]
        side = F.col("__at").asc() if e.name == "firstn" else F.col("__at").desc()
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*groups).orderBy(side))).where(F.col("__n") <= n) if groups else rows.orderBy(side).limit(n)
        got = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("__at", "__v"))).alias("__l")).select(*groups, F.transform("__l", lambda x: x["__v"]).alias(name))
        if not groups:
            one = F.lit(1).alias("__only")
            return out.select("*", one).join(got.select("*", one), "__only").drop("__only", "__one")  # one row each
        return out.join(got, [quoted(k).eqNullSafe(F.col(g)) for k, g in zip(keys, groups)]).drop(*groups)

    def projected(self, q: s.Select, scope: Scope) -> tuple[DataFrame, list]:
        shapes = [i for i in q.items if shape_of(i) in ("unset", "flatten")]
        items = [i for i in q.items if shape_of(i) not in ("unset", "flatten")]
        if shapes and not items:
            items = [s.Item(s.Star())]
        scope, items, dropped = self.unwound(items, scope)
        scope, items = self.ranked(items, scope)
        aliases = {i.alias: i.expr for i in items if i.alias and i.alias != ROOT}
        c = Compiler(replace(scope, aliases=aliases), self.options, self.run)
        cols: dict[str, Column] = {}
        nested: dict[str, dict] = {}
        root: Column | None = None
        for i in items:
            e = i.expr
            if isinstance(e, s.Literal) and e.quote == "'" and str(e.value).count(".") == 1 and str(e.value).split(".")[0] in (*scope.base, *scope.joined):
                e = s.Name(tuple(e.value.split(".")))
            if i.alias == ROOT:
                root = c.col(e)
            elif isinstance(e, s.Star):
                cols |= self.starred(e, scope, dropped, i.alias)
            elif isinstance(e, s.Name) and not i.alias and (path := self.nested_path(e, scope)):
                at = nested.setdefault(path[0], {})
                for p in path[1:-1]:
                    at = at.setdefault(p, {})
                at[path[-1]] = c.col(e)
                cols.setdefault(path[0], None)
            else:
                cols[self.name_of(i if e is i.expr else s.Item(e, i.alias))] = c.col(e)
        for n, tree in nested.items():
            cols[n] = self.tree(tree)
        if root is not None:
            names = [f.name for f in c.scope.df.select(root.alias("r")).schema[0].dataType.fields]
            ordered, hidden = self.order_keys(q, scope, names, True)
            out = scope.df.select(root.alias("__root"), *[v.alias(k) for k, v in hidden.items()]).select("__root.*", *hidden)
            return out, ordered
        names = list(cols)
        ordered, hidden = self.order_keys(q, scope, names, not q.distinct)
        out = scope.df.select(*[v.alias(k) for k, v in cols.items()], *[v.alias(k) for k, v in hidden.items()])
        for i in shapes:
            out = self.unset(out, i.expr) if shape_of(i) == "unset" else self.flatten(out, i.expr)
        return out, ordered

    @staticmethod
    def tree(t: dict) -> Column:
        return F.struct(*[(Lowering.tree(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])

    @staticmethod
    def nested_path(e: s.Name, scope: Scope) -> list[str] | None:
        """The path of a field inside an object of the first source, which keeps its place in the output."""
        parts = list(e.parts[1:] if len(e.parts) > 1 and e.parts[0] in scope.base else e.parts)
        if ".".join(parts) in scope.columns or parts[0] in scope.joined:
            return None
        flat = [x for p in parts for x in p.split(".")]
        kind = scope.types().get(flat[0])
        return flat if len(flat) > 1 and isinstance(kind, T.StructType) and flat[0] in scope.columns else None

    def starred(self, e: s.Star, scope: Scope, dropped: set[str], alias: str | None) -> dict[str, Column]:
        if e.table and e.table in scope.joined:
            return {alias or e.table: quoted(scope.joined[e.table])}
        if e.table and e.table not in scope.base:
            raise StatementError(f"Unknown table {e.table}")
        own = {n: quoted(n) for n in scope.columns if n not in dropped and not n.startswith("__")}
        label = e.table or (scope.base[0] if scope.base and self.options.nest_alias and self.aliased(scope) else None)
        out = {alias or label: F.struct(*[v.alias(k) for k, v in own.items()])} if label else own
        return out if e.table else out | {n: quoted(c) for n, c in scope.joined.items() if n not in dropped}

    def aliased(self, scope: Scope) -> bool:
        return bool(getattr(scope, "base", ())) and scope.base[0] not in self.catalog

    def unwound(self, items: list[s.Item], scope: Scope) -> tuple[Scope, list[s.Item], set[str]]:
        """Rows for the elements of arrays; a row without elements stays, with null."""
        out, dropped = [], set()
        for k, i in enumerate(items):
            if shape_of(i) != "unwind":
                out.append(i)
                continue
            if len(i.expr.args) != 1:
                raise StatementError("UNWIND takes one array")
            arg = i.expr.args[0]
            name = f"__unwind{k}"
            alias = i.alias or (arg.parts[-1] if isinstance(arg, s.Name) else None)
            if alias is None:
                raise StatementError("An alias is needed for UNWIND")
            df = scope.df.withColumn(name, F.explode_outer(Compiler(scope, self.options).col(arg)))
            if isinstance(arg, s.Name) and alias != arg.parts[-1]:
                dropped.add(arg.parts[-1])
            scope = replace(scope, df=df, columns=(*scope.columns, name))
            out.append(s.Item(s.Name((name,)), alias))
        return scope, out, dropped

    def ranked(self, items: list[s.Item], scope: Scope) -> tuple[Scope, list[s.Item]]:
        """Window functions as columns, so that large groups can be ranked in parts."""
        out = []
        for k, i in enumerate(items):
            e = i.expr
            if isinstance(e, s.Over) and e.order and e.name in ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD"):
                name = f"__rank{k}"
                c = Compiler(scope, self.options)
                df = scope.df.withColumns({f"__o{j}": c.col(x) for j, (x, _) in enumerate(e.order)})
                order = [F.col(f"__o{j}").asc() if up else F.col(f"__o{j}").desc() for j, (_, up) in enumerate(e.order)]
                shift = e.name in ("LAG", "LEAD")
                value = c.col(e.args[0]) if shift else None
                n = int(c.value(e.args[0])) if e.name == "NTILE" else int(c.value(e.args[1])) if shift and len(e.args) > 1 else 1
                df = ranking.window_column(df, [c.col(p) for p in e.partition], order, e.name, name, value, n).drop(*[f"__o{j}" for j in range(len(e.order))])
                scope = replace(scope, df=df, columns=(*scope.columns, name))
                if not i.alias:
                    raise StatementError(f"An alias is needed for {self.said(e)}")
                out.append(s.Item(s.Name((name,)), i.alias))
            else:
                out.append(i)
        return scope, out

    def unset(self, df: DataFrame, e: s.Call) -> DataFrame:
        """Without some fields, nested ones as well; fields that aren't there are none to drop."""
        for a in e.args:
            path = list(a.parts) if isinstance(a, s.Name) else str(a.value).split(".")
            flat = [x for p in path for x in p.split(".")]
            if ".".join(path) in df.columns:
                df = df.select(*[quoted(c) for c in df.columns if c != ".".join(path)])
            elif flat[-1] in df.columns and len(flat) > 1 and flat[0] not in df.columns:
                df = df.drop(flat[-1])
            elif len(flat) > 1 and flat[0] in df.columns and isinstance(df.schema[flat[0]].dataType, T.StructType):
                df = df.withColumn(flat[0], quoted(flat[0]).dropFields(".".join(f"`{x}`" for x in flat[1:])))
        return df

    def flatten(self, df: DataFrame, e: s.Call) -> DataFrame:
        """The fields of an object as prefixed fields beside it, and without it if the third argument is true."""
        if not 2 <= len(e.args) <= 3 or not isinstance(e.args[1], s.Literal):
            raise StatementError("FLATTEN takes an object, a prefix and optionally whether to drop the object")
        c = Compiler(Scope(df, (), tuple(df.columns)), self.options)
        path = [x for p in e.args[0].parts for x in p.split(".")]
        kind = c.type(e.args[0])
        if not isinstance(kind, T.StructType):
            raise StatementError("FLATTEN needs an object")
        o, prefix = c.col(e.args[0]), str(e.args[1].value)
        drop = len(e.args) > 2 and bool(e.args[2].value)
        fresh = {prefix + f.name: o[f.name] for f in kind.fields}
        if len(path) == 1:
            out = df.withColumns(fresh)
            return out.drop(path[0]) if drop else out
        top = quoted(path[0])
        inner = ".".join(path[1:-1])
        for n, v in fresh.items():
            top = top.withField(f"{inner}.`{n}`" if inner else f"`{n}`", v)
        return df.withColumn(path[0], top.dropFields(".".join(path[1:])) if drop else top)
