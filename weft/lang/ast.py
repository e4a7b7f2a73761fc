"""Syntax trees of schemas, predicates and queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class TypeRef:
    """A type name with arguments, as ``Json<List<String>>?``."""

    name: str
    args: tuple["TypeRef", ...] = ()
    nullable: bool = False


@dataclass
class Field:
    name: str
    type: TypeRef
    directives: dict[str, list] = field(default_factory=dict)


@dataclass
class Link:
    """A link from ``local`` fields of a record to ``foreign`` fields of another."""

    name: str
    local: list[str]
    record: str
    foreign: list[str]
    namespace: str | None = None


@dataclass
class Variant:
    name: str
    fields: list[Field]


@dataclass
class Union:
    name: str
    variants: list[Variant]


@dataclass
class Record:
    name: str
    fields: list[Field]
    links: list[Link]
    directives: list[tuple[str, list, Any]]  # name, arguments, block

    @property
    def table(self) -> str:
        return next((a[0] for n, a, _ in self.directives if n == "tablename"), "")


@dataclass
class Schema:
    session: list[Field] = field(default_factory=list)
    unions: dict[str, Union] = field(default_factory=dict)
    records: dict[str, Record] = field(default_factory=dict)
    syncable: bool = True


# --- predicates and values ---


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Path:
    """A field, or a path through variants of a union."""

    parts: tuple[str, ...]


@dataclass(frozen=True)
class SessionPath:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class VariantValue:
    name: str
    fields: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Exists:
    links: tuple[str, ...]
    where: Any


# --- queries ---


@dataclass
class Selection:
    """A selected field or link, or an assigned one in a mutation."""

    name: str
    alias: str
    children: list["Selection"] | None = None
    wheres: list = field(default_factory=list)
    sorts: list[tuple[str, str]] = field(default_factory=list)
    limits: list = field(default_factory=list)
    value: Any = None
    assigned: bool = False


@dataclass
class Query:
    kind: str  # query, insert, update, delete
    name: str
    params: dict[str, TypeRef]
    roots: list[Selection]
