"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    operand: object
    negated: bool


@dataclass(frozen=True)
class Between:
    operand: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class InList:
    operand: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    operand: object
    query: Select
    negated: bool


@dataclass(frozen=True)
class Case:
    operand: object | None
    branches: tuple
    otherwise: object | None


@dataclass(frozen=True)
class Cast:
    operand: object
    target: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Subquery:
    query: Select


@dataclass(frozen=True)
class Default:
    """The keyword DEFAULT as an inserted value."""


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    schema: str | None = None
    args: tuple | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    table: TableRef
    on: object | None = None


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple
    first: TableRef | None = None
    joins: tuple = ()
    where: object | None = None
    group_by: tuple = ()
    having: object | None = None
    order_by: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple | None
    rows: tuple | None = None
    query: Select | None = None


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple
    where: object | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    default_source: str | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple
    keys: tuple = ()


@dataclass(frozen=True)
class CreateView:
    name: str
    source: str
    query: Select | None


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple
    unique: bool = False
    if_not_exists: bool = False


@dataclass(frozen=True)
class Drop:
    kind: str
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Transaction:
    action: str


@dataclass
class Span:
    """Where an expression stands in the source."""

    start: int
    end: int = field(default=0)
