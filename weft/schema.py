"""A checked schema: physical columns of records, unions, links, cardinality and permissions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import types as T

from .errors import WeftError
from .lang.ast import And, Const, Exists, Field, Link, Record, Schema, TypeRef, Union
from .lang.parser import parse_schema

_SCALARS = {
    "String": T.StringType(), "Int": T.LongType(), "Float": T.DoubleType(), "Bool": T.BooleanType(), "DateTime": T.LongType(), "Date": T.StringType(), "JSON": T.StringType(),
    "Json": T.StringType(), "Id.Int": T.LongType(), "Id.Uuid": T.StringType(),
}
OPERATIONS = ("query", "insert", "update", "delete")


@dataclass
class Column:
    """A physical column: a plain field, a union's discriminator, or a payload field of some variants."""

    name: str
    type: T.DataType
    nullable: bool
    logical: str = ""
    union: str | None = None  # of a discriminator


@dataclass
class Table:
    """A record with its links resolved."""

    record: Record
    name: str
    columns: dict[str, Column]
    key: str | None
    unique: set[str]
    links: dict[str, Link] = field(default_factory=dict)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.record.fields if f.name == name), None)


# Plurals that follow no rule.
_IRREGULAR = {"child": "children", "person": "people", "man": "men", "woman": "women", "mouse": "mice", "goose": "geese", "foot": "feet", "tooth": "teeth", "ox": "oxen"}
#: Endings, the first that fits counts: how many letters go, and what comes instead. Words in -s count as plural, but for those in -ses, -xes and the like.
_ENDINGS = [(r"([sxz]|[cs]h)es$", 0, "es"), (r"s$", 0, ""), (r"([xz]|[cs]h)$", 0, "es"), (r"[^aeiou]y$", 1, "ies"), (r"fe$", 2, "ves"), (r"[^aeiou]f$", 1, "ves"), (r"[^aeiou]o$", 0, "es")]


def plural(word: str) -> str:
    """The plural of an English noun; the first letter keeps its case."""
    if found := _IRREGULAR.get(word.lower()):
        return word[:1] + found[1:]
    for ending, gone, more in _ENDINGS:
        if len(word) > 1 and re.search(ending, word, re.I):
            return word[: len(word) - gone] + more
    return f"{word}s" if word else word


def decapitalized(name: str) -> str:
    return name[:1].lower() + name[1:]


class Catalog:
    """A schema text, parsed and checked; raises :class:`WeftError` with the kind of the first fault."""

    def __init__(self, source: str):
        self.schema: Schema = parse_schema(source)
        self.session = {f.name: f.type for f in self.schema.session}
        self.tables: dict[str, Table] = {}  # by query root, the decapitalized record name
        for union in self.schema.unions.values():
            self._payload(union)
        for record in self.schema.records.values():
            self.tables[decapitalized(record.name)] = self._table(record)
        for table in self.tables.values():
            for link in table.record.links:
                table.links[link.name] = self._resolved(table, link)
        for table in self.tables.values():
            self._check_permissions(table)

    def table_of(self, record: str) -> Table:
        return self.tables[decapitalized(record)]

    # --- types ---

    def scalar(self, ref: TypeRef) -> T.DataType:
        """The stored type of a type that isn't a union."""
        if ref.name in ("List", "Dict"):
            inner = self.logical(ref.args[0])
            return T.ArrayType(inner) if ref.name == "List" else T.MapType(T.StringType(), inner)
        if ref.name in _SCALARS:
            return _SCALARS[ref.name]
        parts = ref.name.split(".")
        if len(parts) >= 2 and parts[-2] in self.schema.records:  # a key of another record
            target = next((f for f in self.schema.records[parts[-2]].fields if f.name == parts[-1]), None)
            if target is not None:
                return self.scalar(target.type)
        raise WeftError("UnknownType", ref.name)

    def logical(self, ref: TypeRef) -> T.DataType:
        """The type as it shows in results: unions are structs with ``_type``."""
        if ref.name in self.schema.unions:
            fields = [T.StructField("_type", T.StringType())]
            for f in self._payload(self.schema.unions[ref.name]).values():
                fields.append(T.StructField(f.name, self.logical(f.type)))
            return T.StructType(fields)
        if ref.name in ("Json", "JSON") and ref.args:
            return self.logical(ref.args[0])
        return self.scalar(ref)

    def _payload(self, union: Union) -> dict[str, Field]:
        """Payload fields of all variants; fields of one name share a column and need one type."""
        found: dict[str, Field] = {}
        for variant in union.variants:
            for f in variant.fields:
                if f.name in found and (found[f.name].type.name, found[f.name].type.args) != (f.type.name, f.type.args):
                    raise WeftError("VariantFieldTypeCollision", f"{union.name}.{f.name}")
                found.setdefault(f.name, f)
        return found

    def payload(self, union: str) -> dict[str, Field]:
        return self._payload(self.schema.unions[union])

    def physical(self, f: Field, prefix: str = "", nullable: bool = False, logical: str | None = None) -> list[Column]:
        """The columns of a field: one, or a union's discriminator and payload columns joined by double underscores."""
        name = prefix + f.name
        nullable, logical = nullable or f.type.nullable, logical or f.name
        if f.type.name in self.schema.unions:
            out = [Column(name, T.StringType(), nullable, logical, f.type.name)]
            for p in self.payload(f.type.name).values():
                out += self.physical(p, f"{name}__", True, logical)
            return out
        kind = T.StringType() if f.type.name in ("Json", "JSON") else self.scalar(f.type)
        return [Column(name, kind, nullable, logical)]

    def _table(self, record: Record) -> Table:
        columns: dict[str, Column] = {}
        for f in record.fields:
            for c in self.physical(f):
                columns[c.name] = c
        keys = [f.name for f in record.fields if "id" in f.directives]
        if len(keys) > 1:
            raise WeftError("MultiplePrimaryKeys", record.name)
        if not keys and not any(n == "keyless" for n, _, _ in record.directives):
            raise WeftError("NoPrimaryKey", record.name)
        unique = {f.name for f in record.fields if "unique" in f.directives} | set(keys)
        return Table(record, record.table or plural(decapitalized(record.name)), columns, keys[0] if keys else None, unique)

    def _resolved(self, table: Table, link: Link) -> Link:
        if link.record not in self.schema.records:
            raise WeftError("LinkToUnknownTable", f"{table.record.name}.{link.name}")
        target = self.table_of(link.record)
        local = link.local or [table.key] * len(link.foreign)
        for t, names in ((table, local), (target, link.foreign)):
            for n in names:
                if n is None or n not in t.columns:
                    raise WeftError("LinkToUnknownField", f"{table.record.name}.{link.name}: {n}")
        return Link(link.name, local, link.record, link.foreign, link.namespace)

    def singular(self, table: Table, link: Link) -> bool:
        """Whether a link leads to one row at most: its foreign field is unique and the local one isn't merely the own key."""
        target = self.table_of(link.record)
        return len(link.foreign) == 1 and link.foreign[0] in target.unique and link.local != [table.key]

    # --- permissions ---

    def _check_permissions(self, table: Table) -> None:
        names = [n for n, _, _ in table.record.directives]
        if "public" in names:
            return
        covered: set[str] = set()
        for name, args, block in table.record.directives:
            if name == "allow":
                operations = [a if a == "*" else a.parts[0] for a in args]
                covered |= set(OPERATIONS) if "*" in operations else set(operations)
                if "insert" in operations and _has_exists(block):
                    raise WeftError("ExistsInInsertPermission", table.record.name)
                if self.schema.syncable and _has_exists(block):
                    raise WeftError("ExistsInSyncedNamespace", table.record.name)
        if not covered:
            raise WeftError("MissingPermissions", table.record.name)
        if missing := set(OPERATIONS) - covered:
            raise WeftError("MissingPermissionOperations", f"{table.record.name}: {', '.join(sorted(missing))}")

    def permission(self, table: Table, operation: str) -> Any | None:
        """The condition on an operation; None if there is none."""
        if any(n == "public" for n, _, _ in table.record.directives):
            return None
        found = []
        for name, args, block in table.record.directives:
            if name == "allow":
                operations = [a if a == "*" else a.parts[0] for a in args]
                if "*" in operations:
                    found = [block]
                    break
                if operation in operations:
                    found.append(block)
        found = [b for b in found if b != Const(True)]
        if not found:
            return None
        return found[0] if len(found) == 1 else And(tuple(found))

    # --- structure ---

    @cached_property
    def sync_layers(self) -> list[list[str]]:
        """Table names in the order in which they have to be synchronized: strongly connected tables share a layer, linked ones come first."""
        names = list(self.tables)
        edges = {n: {decapitalized(k.record) for k in self.tables[n].links.values()} - {n} for n in names}
        reach: dict[str, set[str]] = {}
        for n in names:
            seen, todo = {n}, [n]
            while todo:
                for m in edges[todo.pop()] - seen:
                    seen.add(m)
                    todo.append(m)
            reach[n] = seen
        groups: list[set[str]] = []
        for n in names:
            if not any(n in g for g in groups):
                groups.append({m for m in reach[n] if n in reach[m]})
        layers, done = [], set()
        while len(done) < len(groups):
            ready = [i for i, g in enumerate(groups) if i not in done and all(any(m in groups[j] for j in {*done, i}) for n in g for m in edges[n])]
            layers.append(sorted(self.tables[n].name for i in ready for n in groups[i]))
            done |= set(ready)
        return layers


def _has_exists(p: Any) -> bool:
    return isinstance(p, Exists) or any(_has_exists(x) for x in getattr(p, "parts", ()) if not isinstance(x, str))
