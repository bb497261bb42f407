"""Nested records as flat tables: objects stored once by identity, occurrences as bridge rows.

Every subtree has an identity, the hash of its canonical form, in which children stand by their identities.
`nodes` has each distinct object, array or scalar once, and is stored so; `bridge` has for each distinct parent its children
with field and ordinal, which a parent's canonical form lists; `roots` names each record's subtree, `places` the chosen arrays of each
record, and `occurrences`, the elements of these arrays, are the bridge rows of the array that stands in a place.
Records may be nested to any depth: texts are parsed and trees are hashed with stacks of their own. Numbers are
exact: equal ones have one identity however they are written, and no digit is lost.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import materialize

OUT = "kind string, table_name string, row_id string, path string, pos bigint, parent string, child string, node_type string, content string"
FIELDS = [x.split()[0] for x in OUT.split(", ")]
ARROW = pa.schema([(n, pa.int64() if n == "pos" else pa.string()) for n in FIELDS])
KINDS = ("node", "bridge", "root", "occurrence")
#: What is stored; the bridge is read from the nodes, occurrences from both.
STORED = ("node", "root", "place")
ROWS_OUT = 20_000
SPACE = re.compile(r"[ \t\r\n]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
WORDS = {"true": True, "false": False, "null": None}
#: Digits of a number up to which it is written out.
PLAIN = 40


def plain_number(text: str) -> str:
    """The one text of a JSON number's exact value: written out if that takes few digits, else digits and exponent."""
    mantissa, _, power = text.lower().partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    digits = (whole + part).lstrip("0")
    short = digits.rstrip("0")
    if not short:
        return "0"
    exponent = int(power or 0) - len(part) + len(digits) - len(short)
    if exponent >= 0 and len(short) + exponent <= PLAIN:
        return sign + short + "0" * exponent
    if exponent < 0 and len(short) <= PLAIN and -exponent <= PLAIN:
        short = short.rjust(1 - exponent, "0")
        return f"{sign}{short[:exponent]}.{short[exponent:]}"
    return f"{sign}{short}e{exponent}"


class Number:
    """A number with a fraction or an exponent, by its exact value."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = plain_number(text)

    def __eq__(self, other) -> bool:
        return isinstance(other, Number) and self.text == other.text or isinstance(other, int) and self.text == plain_number(str(other))

    def __hash__(self) -> int:
        return hash(self.text)

    def __repr__(self) -> str:
        return self.text


def reject(constant: str):
    raise ValueError(constant)


def sound(text: str):
    """The value of a JSON text of any depth; raises ValueError where it is none (NaN, Infinity and cut texts are none)."""
    try:
        return json.loads(text, parse_constant=reject, parse_float=Number)
    except RecursionError:
        return deep(text)


def skip(text: str, at: int) -> int:
    return SPACE.match(text, at).end()


def scalar(text: str, at: int) -> tuple[object, int]:
    if text.startswith('"', at):
        return scanstring(text, at + 1, True)
    for word, value in WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = NUMBER.match(text, at)
    if m is None:
        raise ValueError(f"no value at {at}")
    return int(m[0]) if m[0].lstrip("-").isdigit() else Number(m[0]), m.end()


def field_name(text: str, at: int) -> tuple[str, int]:
    """The name of a field and the place after its colon."""
    at = skip(text, at)
    if not text.startswith('"', at):
        raise ValueError(f"no name at {at}")
    name, at = scanstring(text, at + 1, True)
    at = skip(text, at)
    if not text.startswith(":", at):
        raise ValueError(f"no colon at {at}")
    return name, at + 1


def deep(text: str):
    """sound() with a stack of its own, for texts nested beyond the interpreter's."""
    at, boxes, names = 0, [], []
    while True:
        at = skip(text, at)
        if text[at : at + 1] in ("{", "["):
            box = {} if text[at] == "{" else []
            at = skip(text, at + 1)
            if text.startswith("}" if isinstance(box, dict) else "]", at):
                value, at = box, at + 1
            else:
                boxes.append(box)
                if isinstance(box, dict):
                    name, at = field_name(text, at)
                    names.append(name)
                continue
        else:
            value, at = scalar(text, at)
        while boxes:
            box = boxes[-1]
            if isinstance(box, dict):
                box[names.pop()] = value
            else:
                box.append(value)
            at = skip(text, at)
            sign, at = text[at : at + 1], at + 1
            if sign == ",":
                if isinstance(box, dict):
                    name, at = field_name(text, at)
                    names.append(name)
                break
            if sign != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"unfinished at {at}")
            value = boxes.pop()
        else:
            if skip(text, at) != len(text):
                raise ValueError(f"more text at {at}")
            return value


def as_container(value):
    """A text that is itself a JSON object or array counts as that; anything else as it is."""
    if isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "["):
        try:
            inner = sound(value)
        except ValueError:
            return value
        if isinstance(inner, dict | list):
            return inner
    return value


def as_elements(value) -> list:
    """What stands in the place of an array as elements: an object or a text is one, a number or boolean none."""
    value = as_container(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict | str) else []


def quoted(text: str) -> str:
    """A text as JSON; halves of surrogate pairs, which UTF-8 can't hold, stay escaped."""
    out = json.dumps(text, ensure_ascii=False)
    return out if out.isascii() or not any("\ud800" <= c <= "\udfff" for c in out) else json.dumps(text)


def name_of(kind: str, content: str) -> str:
    return hashlib.sha256(f"{kind}:{content}".encode()).hexdigest()[:32]


def leaf(value) -> tuple[str, str]:
    """Type and canonical form of a scalar."""
    if isinstance(value, str):
        return "string", quoted(value)
    if value is None:
        return "null", "null"
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    return "number", value.text if isinstance(value, Number) else plain_number(repr(value) if isinstance(value, float) else str(value))


#: The identity of null.
NULL = name_of(*leaf(None))


class Shredder:
    """Cuts one record after another into rows; repeats of a subtree are left out while it is remembered.

    paths: arrays whose elements are listed for each record, as tuples of field names. kinds: the rows wanted; a place is
    a record's array as a whole, an occurrence one element of it. first: number of the first record, the `pos` of its root and places.
    """

    def __init__(self, paths: list[tuple[str, ...]], kinds: tuple[str, ...] = KINDS, remember: int = 200_000, first: int = 0):
        self.paths, self.kinds, self.remember, self.known, self.number = paths, frozenset(kinds), remember, set(), first
        self.rows: list[tuple] = []

    def _new(self, kind: str, content: str, below: tuple[tuple[str, int | None, str], ...] = ()) -> str:
        name = name_of(kind, content)
        if name not in self.known:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known.add(name)
            if "node" in self.kinds:
                self.rows.append(("node", None, None, None, None, None, name, kind, content))
            if "bridge" in self.kinds:
                self.rows += [("bridge", None, None, k.encode("utf-8", "replace").decode(), i, name, c, None, None) for k, i, c in below]
        return name

    def identity(self, value, met: dict[int, str] | None = None) -> str:
        """The identity of a subtree, whose rows are emitted if it is new here; met: those of containers hashed before."""
        met = {} if met is None else met
        if not isinstance(value, dict | list):
            return self._new(*leaf(value))
        stack = [(value, False)]
        while stack:
            at, ready = stack.pop()
            if id(at) in met:
                continue
            inside = at.values() if isinstance(at, dict) else at
            if not ready:
                stack.append((at, True))
                stack += [(x, False) for x in inside if isinstance(x, dict | list)]
                continue
            names = [met[id(x)] if isinstance(x, dict | list) else self._new(*leaf(x)) for x in inside]
            if isinstance(at, dict):
                below = sorted(zip(at, names))
                met[id(at)] = self._new("object", "[" + ",".join([f'[{quoted(k)},"{c}"]' for k, c in below]) + "]", [(k, None, c) for k, c in below])
            else:
                met[id(at)] = self._new("array", "[" + ",".join([f'"{c}"' for c in names]) + "]", [("", i, c) for i, c in enumerate(names)])
        return met[id(value)]

    def record(self, table: str, row_id: str, value) -> None:
        value, met = as_container(value), {}
        self.number += 1
        if "root" in self.kinds or "node" in self.kinds or "bridge" in self.kinds:
            root = self.identity(value, met)
            if "root" in self.kinds:
                self.rows.append(("root", table, row_id, None, self.number, None, root, None, None))
        held = []  # what was parsed here keeps its place in memory while `met` is used
        for path in self.paths:
            at = value
            for step in path:
                at = as_container(at)
                held.append(at)
                at = at.get(step) if isinstance(at, dict) else None
            elements = as_elements(at)
            held.append(elements)
            if "place" in self.kinds and elements:
                self.rows.append(("place", table, row_id, ".".join(path), self.number, None, self.identity(elements, met), None, None))
            for i, x in enumerate(elements if "occurrence" in self.kinds else ()):
                if x is not None:
                    self.rows.append(("occurrence", table, row_id, ".".join(path), i, None, self.identity(x, met), None, None))

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), ARROW)], schema=ARROW) if self.rows else pa.RecordBatch.from_pylist([], ARROW)
        self.rows = []
        return batch


def shred(records: DataFrame, paths: list[tuple[str, ...]], kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows of OUT of records (table_name, row_id, payload), payload being JSON text; repeats may remain.

    A null payload, or one that is no sound JSON, gives no rows. Repeated records count each for itself. kinds: the rows wanted.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)  # a long number is sound JSON
        s = Shredder(paths, kinds, first=TaskContext.get().partitionId() << 40)
        for b in batches:
            for table, row_id, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                if payload is None:
                    continue
                try:
                    value = sound(payload)
                except ValueError:
                    continue
                s.record(table, row_id, value)
                if len(s.rows) >= ROWS_OUT:
                    yield s.take()
            yield s.take()

    return records.select("table_name", "row_id", "payload").mapInArrow(work, OUT)


def items(content: Column) -> Column:
    """The identities in the canonical form of an array that isn't empty."""
    return F.split(F.substr(content, F.lit(3), F.length(content) - 4), '","')


class Flat:
    """The related tables of a set of records."""

    def __init__(self, records: DataFrame, paths: list[tuple[str, ...]]):
        self.records, self.paths = records, paths
        self._rows: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """The rows of the kinds of STORED, stored on first use, each node once.

        Equal nodes of several tasks meet by their identity. Roots and places have the number of their record, so that none is a repeat.
        """
        if self._rows is None:
            key = F.coalesce(F.when(F.col("kind") != "node", F.col("pos").cast("string")), "child").alias("key")
            rows = shred(self.records, self.paths, STORED).select("kind", "table_name", "row_id", "path", "pos", "child", "node_type", "content", key)
            self._rows = materialize(rows.repartition("key").distinct().drop("key"), "shredded", ["kind"], "zstd")
        return self._rows

    @property
    def nodes(self) -> DataFrame:
        """child (identity), node_type, content of each distinct subtree."""
        return self._of("node").select("child", "node_type", "content")

    @property
    def bridge(self) -> DataFrame:
        """parent, field, pos, child: the children of each distinct object or array."""
        objects = self.nodes.where("node_type = 'object'").select("child", F.explode(F.from_json("content", "array<array<string>>", {"maxStringLen": str(2**31 - 1)})).alias("x"))
        fields = objects.select(F.col("child").alias("parent"), F.col("x")[0].alias("field"), F.lit(None).cast("bigint").alias("pos"), F.col("x")[1].alias("child"))
        places = self._lists.select(F.col("child").alias("parent"), F.lit("").alias("field"), F.posexplode(items(F.col("content"))).alias("pos", "child"))
        return fields.unionByName(places.withColumn("pos", F.col("pos").cast("bigint")))

    @property
    def roots(self) -> DataFrame:
        return self._of("root").select("table_name", "row_id", "child")

    @property
    def places(self) -> DataFrame:
        """table_name, row_id, array_path, child: the chosen arrays of each record, but for empty ones."""
        return self._of("place").select("table_name", "row_id", F.col("path").alias("array_path"), "child")

    @property
    def occurrences(self) -> DataFrame:
        """table_name, row_id, array_path, pos, child of each element that is not null: the bridge rows of the array in each place."""
        held = self.places.join(self._lists.select("child", "content"), "child")
        each = held.select("table_name", "row_id", "array_path", F.posexplode(items(F.col("content"))).alias("pos", "child"))
        return each.where(F.col("child") != NULL).withColumn("pos", F.col("pos").cast("bigint"))

    @property
    def _lists(self) -> DataFrame:
        return self.nodes.where("node_type = 'array' AND content <> '[]'")

    def _of(self, kind: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind)

    def flat(self, array_path: str, fields: list[str]) -> DataFrame:
        """One flat table: the elements of an array with their record, place and scalar fields as text."""
        o = self.occurrences.where(F.col("array_path") == array_path)
        b = self.bridge.where(F.col("field").isin(*fields)).join(self.nodes.where(~F.col("node_type").isin("object", "array")).select("child", "content"), "child")
        wide = b.groupBy(F.col("parent").alias("child")).agg(*[F.max(F.when(F.col("field") == f, F.get_json_object(F.concat(F.lit('{"v":'), "content", F.lit("}")), "$.v"))).alias(f) for f in fields])
        return o.join(wide, "child", "left")
