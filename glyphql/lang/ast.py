"""Syntax trees of the symbolic language: immutable, with source positions where errors need them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Column:
    parts: tuple[str, ...]
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Interval:
    amount: Expr
    unit: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Unary:
    op: str
    value: Expr


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Between:
    value: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class In:
    value: Expr
    options: tuple[Expr, ...] | Select
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    value: Expr
    negated: bool = False


@dataclass(frozen=True)
class Case:
    subject: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class OrderItem:
    value: Expr
    descending: bool = False


@dataclass(frozen=True)
class Window:
    call: Call
    partition: tuple[Expr, ...] = ()
    order: tuple[OrderItem, ...] = ()
    frame: str | None = None


@dataclass(frozen=True)
class Scalar:
    query: Select


Expr = Literal | Column | Star | Parameter | Interval | Call | Unary | Binary | Between | In | IsNull | Case | Window | Scalar


@dataclass(frozen=True)
class Item:
    value: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    """A table, a memory reference (``memory``), or a derived table (``query``)."""

    name: str
    alias: str
    memory: bool = False
    query: Select | None = None


@dataclass(frozen=True)
class Select:
    verb: str
    join: str
    sources: tuple[Source, ...]
    items: tuple[Item, ...]
    distinct: bool = False
    on: Expr | None = None
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[OrderItem, ...] = ()
    limit: int | None = None
    offset: int | None = None
    #: (all, query) of each UNION [ALL] that follows.
    unions: tuple[tuple[bool, Select], ...] = ()
    outputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Let:
    name: str
    query: Select


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[object, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    primary: bool = False
    references: tuple[str, str] | None = None
    unique: bool = False
    required: bool = False
    check: str | None = None
    default: str | None = None


@dataclass(frozen=True)
class Create:
    table: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class Drop:
    table: str


@dataclass(frozen=True)
class Index:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Transaction:
    action: str


Statement = Select | Let | Insert | Update | Delete | Create | Drop | Index | Transaction
