"""Syntax trees. Names are lower case from the parser on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    """A string, a number (always a float), True, False or None."""

    value: str | float | bool | None


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Call:
    """Operators are calls too: ``a + b`` is add(a, b), ``a.b`` is idx(a, 'b')."""

    function: str
    args: tuple


Expr = Literal | Name | Call


@dataclass(frozen=True)
class Table:
    kind: str
    path: str


@dataclass(frozen=True)
class Scan:
    table: Table
    alias: str | None


@dataclass(frozen=True)
class Inline:
    select: Select
    alias: str | None


@dataclass(frozen=True)
class Lateral:
    source: Source
    expr: Expr
    name: str


@dataclass(frozen=True)
class Join:
    left: Source
    right: Source
    on: Expr


Source = Scan | Inline | Lateral | Join


@dataclass(frozen=True)
class Output:
    expr: Expr
    name: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    ascending: bool


@dataclass(frozen=True)
class Select:
    outputs: tuple[Output, ...]
    source: Source
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Describe:
    table: Table
    as_table: bool


@dataclass(frozen=True)
class Explain:
    select: Select


@dataclass(frozen=True)
class Insert:
    table: Table
    select: Select


Statement = Select | Describe | Explain | Insert
