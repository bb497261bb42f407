"""The engine: statements over tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docloom.functions import registry
from docloom.plans import syntax as s
from docloom.plans.lower import Lowering, aggregates_in, shape_of
from docloom.plans.parser import parse
from docloom.sources.catalog import Catalog, Table


@dataclass(frozen=True)
class Options:
    """How statements are read.

    unwind_joins: joins multiply rows unless a hint says otherwise. unset_id: drop `_id` unless it is selected.
    nulls: "document" (negations are true for null) or "sql". nest_alias: `SELECT *` of an aliased source nests it
    under its alias. default_limit: limit of statements without one. optimize_joins is accepted; Catalyst pushes anyway.
    """

    unwind_joins: bool = False
    unset_id: bool = False
    nulls: str = "document"
    nest_alias: bool = True
    default_limit: int | None = None
    optimize_joins: bool = False


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, Table] | None = None, folder: str | None = None, schemas: dict[str, T.StructType] | None = None, options: Options = Options()):
        self.spark, self.options = spark, options
        self.catalog = Catalog(spark, tables, folder, schemas)

    def register(self, name: str, df: Table) -> None:
        self.catalog.register(name, df)

    def parse(self, text: str) -> s.Select:
        return parse(text)

    def sql(self, text: str, **options) -> DataFrame:
        """The result of one statement, planned but not run."""
        return Lowering(self.catalog, replace(self.options, **options)).run(parse(text))

    def explain(self, text: str, **options) -> str:
        """The physical plan of a statement."""
        df = self.sql(text, **options)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    @classmethod
    def analyze(cls, text: str) -> dict:
        """What a statement is about, without planning it: kind (query or aggregate, see is_simple), collections read, joins, what the
        columns are called, whether it groups, and its limit and offset."""
        q = parse(text)
        tables = [x.name for n in s.deep(q) if isinstance(n, s.Select) for x in n.sources if x.name]
        names = [i.alias or (i.expr.parts[-1].split(".")[-1] if isinstance(i.expr, s.Name) else "*" if isinstance(i.expr, s.Star) else None) for i in q.items]
        return {
            "kind": "query" if cls.is_simple(text) else "aggregate", "collections": list(dict.fromkeys(tables)), "joins": [(x.join, x.label) for x in q.sources if x.join],
            "columns": names, "grouped": q.group is not None or any(aggregates_in(i.expr) for i in q.items), "limit": q.limit, "offset": q.offset,
        }

    @staticmethod
    def is_simple(text: str) -> bool:
        """Whether a statement only filters, projects plain columns, sorts and limits one table."""
        q = parse(text)
        if len(q.sources) != 1 or q.sources[0].query is not None or q.sources[0].alias or q.group is not None or q.having is not None or q.distinct or q.sets:
            return False
        if any(isinstance(x, s.InQuery) for x in s.walk(q.where)):
            return False
        for i in q.items:
            if i.alias == "$$ROOT" or shape_of(i) or aggregates_in(i.expr) or isinstance(i.expr, s.Over | s.SubQuery):
                return False
            if isinstance(i.expr, s.Star) and (i.expr.table or len(q.items) > 1):
                return False
        return True

    def result_schema(self, text: str, **options) -> list[dict]:
        """The columns of a result, nested ones by path: path, type, format, isArray, required, order, collectionName, as."""
        q = parse(text)
        df = self.sql(text, **options)
        first = q.sources[0].name if q.sources else None
        sides = {x.label: x.name for x in q.sources if x.name}
        given = {}
        for i in q.items:
            if isinstance(i.expr, s.Name):
                head = i.expr.parts[0]
                given[i.alias or i.expr.parts[-1].split(".")[-1]] = (sides.get(head, first), i.alias)
        out: list[dict] = []
        flatten(df.schema, "", out, first, given)
        for k, r in enumerate(out):
            r["order"] = k
        return out

    @staticmethod
    def functions() -> list[str]:
        """Names of all functions."""
        return sorted({*registry.SCALARS, *registry.AGGREGATES, *registry.SHAPES})


KINDS = {"string": "string", "boolean": "boolean", "integer": "integer", "long": "integer", "short": "integer", "byte": "integer", "double": "number", "float": "number", "timestamp": "string", "timestamp_ntz": "string", "date": "string", "struct": "object", "map": "object", "array": "array", "binary": "string", "void": "null", "variant": "object"}


def flatten(kind: T.StructType, prefix: str, out: list[dict], table: str | None, given: dict) -> None:
    for f in kind.fields:
        path = prefix + f.name
        d, many = f.dataType, False
        if isinstance(d, T.ArrayType):
            d, many = d.elementType, True
        name = d.typeName()
        where, alias = given.get(f.name, (table, None)) if not prefix else (table, None)
        base = "decimal" if name.startswith("decimal") else KINDS.get(name, name)
        out.append({"path": path, "type": "number" if base == "decimal" else base, "format": "date-time" if name in ("timestamp", "timestamp_ntz", "date") else None, "isArray": many, "required": not f.nullable, "order": 0, "collectionName": where, "as": alias})
        if isinstance(d, T.StructType):
            flatten(d, path + ".", out, table, given)
