"""Functions by name: how many arguments they take and how they become columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from docloom.errors import StatementError


@dataclass(frozen=True)
class Function:
    """build(ctx, args) makes a Column; ctx compiles argument nodes (see plans.expressions.Compiler)."""

    name: str
    build: Callable[[Any, list], Any]
    least: int
    most: int | None
    kind: str = "scalar"  # or aggregate, shape
    returns: str = ""


SCALARS: dict[str, Function] = {}
AGGREGATES: dict[str, Function] = {}
SHAPES = {"unset", "flatten", "unwind"}


def register(names: str, least: int, most: int | None = -1, kind: str = "scalar", returns: str = ""):
    """Decorator: the function under all its names; most -1 means as many as least, None any number."""

    def take(build):
        table = AGGREGATES if kind == "aggregate" else SCALARS
        for n in names.split():
            table[n] = Function(n, build, least, least if most == -1 else most, kind, returns)
        return build

    return take


def plain(names: str, make: Callable, least: int = 1, most: int | None = -1, returns: str = "") -> None:
    """A function of compiled arguments only."""
    register(names, least, most, returns=returns)(lambda ctx, args: make(*[ctx.col(a) for a in args]))


def find(name: str, table: dict[str, Function]) -> Function | None:
    return table.get(name.lower())


def check(f: Function, n: int) -> None:
    if n < f.least or (f.most is not None and n > f.most):
        want = str(f.least) if f.most == f.least else f"{f.least} or more" if f.most is None else f"{f.least} to {f.most}"
        raise StatementError(f"{f.name.upper()} takes {want} arguments, not {n}")


def is_aggregate(name: str, args: tuple, distinct: bool = False) -> bool:
    """Whether a call aggregates rows; sum, avg, min and max of several arguments work on one row."""
    low = name.lower()
    return low in AGGREGATES and (low in ("count", "firstn", "lastn") or len(args) == 1)
