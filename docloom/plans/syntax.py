"""The tree of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Node:
    """Part of a statement."""


@dataclass(frozen=True)
class Literal(Node):
    value: Any
    quote: str = ""  # of a string: ' or "


@dataclass(frozen=True)
class Name(Node):
    """A column or path; parts as written between dots, a quoted part may hold dots itself."""

    parts: tuple[str, ...]

    @property
    def text(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Star(Node):
    table: str | None = None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node


@dataclass(frozen=True)
class Is(Node):
    arg: Node
    what: Any  # None, True or False
    negated: bool = False


@dataclass(frozen=True)
class InList(Node):
    arg: Node
    items: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class InQuery(Node):
    arg: Node
    query: Select
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Case(Node):
    whens: tuple[tuple[Node, Node], ...]
    otherwise: Node | None = None


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    to: str


@dataclass(frozen=True)
class Extract(Node):
    part: str
    arg: Node


@dataclass(frozen=True)
class Over(Node):
    name: str
    partition: tuple[Node, ...]
    order: tuple[tuple[Node, bool], ...]
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class SubQuery(Node):
    query: Select


@dataclass
class Item:
    """A column of a SELECT list."""

    expr: Node
    alias: str | None = None


@dataclass
class Source:
    """A table, sub-query or array field of a FROM clause, and how it is joined."""

    name: str | None = None
    query: Select | None = None
    alias: str | None = None
    hints: list[str] = field(default_factory=list)
    join: str | None = None
    on: Node | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name or ""


@dataclass
class Select(Node):
    items: list[Item]
    sources: list[Source] = field(default_factory=list)
    distinct: bool = False
    where: Node | None = None
    group: list[Node] | None = None
    having: Node | None = None
    order: list[tuple[Node, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    sets: list[tuple[str, Select]] = field(default_factory=list)

    __hash__ = object.__hash__


def walk(node: Any):
    """All nodes of a tree, sub-queries excluded."""
    if isinstance(node, Node) and not isinstance(node, Select):
        yield node
        for v in vars(node).values():
            yield from walk(v)
    elif isinstance(node, tuple | list):
        for v in node:
            yield from walk(v)


def rewritten(node: Any, turn):
    """The tree with turn(node) for each node for which that isn't None, sub-queries of sources excluded."""
    if isinstance(node, Node):
        new = turn(node)
        if new is not None:
            return new
    if isinstance(node, Node | Item) and not isinstance(node, Source):
        return type(node)(**{k: rewritten(v, turn) for k, v in vars(node).items()})
    if isinstance(node, tuple | list):
        return type(node)(rewritten(v, turn) for v in node)
    return node


def deep(node: Any):
    """All nodes of a tree, those of sub-queries included."""
    if isinstance(node, Node):
        yield node
    if isinstance(node, Node | Item | Source):
        for v in vars(node).values():
            yield from deep(v)
    elif isinstance(node, tuple | list):
        for v in node:
            yield from deep(v)
