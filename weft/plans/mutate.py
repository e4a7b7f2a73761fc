"""Inserts, updates and deletes over immutable snapshots.

A mutation gives the new snapshot of each table that it touches, the response, and the changed rows before and after.
Permissions are conditions: on an insert they are asked of the proposed row with its defaults, on updates and deletes
of the row as it was. What they don't allow is silently left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WeftError
from ..lang.ast import Call, Const, Param, Path, Query, Selection, SessionPath, VariantValue
from ..schema import Catalog, Table
from .predicate import exists_in, operand
from .select import Planner


class Change(NamedTuple):
    """Changed rows of a table: ``rows`` as they are reported (deleted ones as they were), and the images before and after; None where there is none."""

    table: str
    op: str
    rows: DataFrame
    before: DataFrame | None
    after: DataFrame | None


@dataclass
class Mutation:
    """``tables``: new snapshots by table name; ``response``: selected columns of changed rows by alias; ``changes``: one for each table and step."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    response: dict[str, DataFrame] = field(default_factory=dict)
    changes: list[Change] = field(default_factory=list)


class Mutator:
    def __init__(self, spark: SparkSession, planner: Planner):
        self.spark, self.planner = spark, planner
        self.catalog: Catalog = planner.catalog
        self.out = Mutation()

    def run(self, query: Query) -> Mutation:
        for root in query.roots:
            table = self.catalog.tables[root.name]
            done = {"insert": self.insert, "update": self.update, "delete": self.delete}[query.kind](table, root)
            self.out.response[root.alias] = done
        return self.out

    # --- values ---

    def _omitted(self, value: Any) -> bool:
        return isinstance(value, Param) and value.name not in self.planner.params

    def _value(self, table: Table, value: Any) -> Column:
        ctx = self.planner.context(table, lambda n: F.col(f"`{n}`"))
        return operand(ctx, value).column

    def assigned(self, table: Table, name: str, value: Any) -> dict[str, Column]:
        """Physical columns that an assignment sets; a union's payload columns of other variants become null."""
        column = table.columns[name]
        if column.union is None:
            return {name: self._value(table, value).cast(column.type)}
        members = {n: F.lit(None).cast(c.type) for n, c in table.columns.items() if n.startswith(f"{name}__")}
        if isinstance(value, (Const, SessionPath)) or (isinstance(value, Param) and not isinstance(self.planner.params.get(value.name), dict)):
            return {name: self._value(table, value).cast("string"), **members}
        if isinstance(value, Param):
            value = _as_variant(self.planner.params[value.name])
        if isinstance(value, Path):
            value = VariantValue(value.parts[0])
        if not isinstance(value, VariantValue):
            raise WeftError("InvalidValue", f"{table.record.name}.{name}")
        return {name: F.lit(value.name), **members, **self._members(table, column.union, name, value)}

    def _members(self, table: Table, union: str, prefix: str, value: VariantValue) -> dict[str, Column]:
        variant = next((v for v in self.catalog.schema.unions[union].variants if v.name == value.name), None)
        if variant is None:
            raise WeftError("UnknownVariant", f"{union}.{value.name}")
        given = dict(value.fields)
        if unknown := set(given) - {f.name for f in variant.fields}:
            raise WeftError("UnknownField", f"{union}.{value.name}: {', '.join(sorted(unknown))}")
        out: dict[str, Column] = {}
        for f in variant.fields:
            name = f"{prefix}__{f.name}"
            if f.name not in given:
                if not f.type.nullable:
                    raise WeftError("MissingVariantField", f"{union}.{value.name}.{f.name}")
                continue
            inner = given[f.name]
            if f.type.name in self.catalog.schema.unions:
                inner = _as_variant(inner.value) if isinstance(inner, Const) else inner
                out[name] = F.lit(inner.name)
                out |= self._members(table, f.type.name, name, inner)
            else:
                out[name] = self._value(table, inner).cast(table.columns[name].type)
        return out

    # --- insert ---

    def insert(self, table: Table, s: Selection, parent: tuple[DataFrame, dict[str, str]] | None = None) -> DataFrame:
        """Inserts a row and, through links, its children; children of a row that wasn't allowed aren't inserted either."""
        values: dict[str, Column] = {}
        given: set[str] = set()
        for c in s.children or []:
            if c.assigned and not self._omitted(c.value):
                given.add(c.name)
                values |= self.assigned(table, c.name, c.value)
        start = self.spark.range(1).select() if parent is None else parent[0]
        linked = {} if parent is None else parent[1]
        for f in table.record.fields:
            if f.name in given or f.name in linked:
                continue
            if f.name == table.key:
                if isinstance(table.columns[f.name].type, T.LongType):
                    values[f.name] = self._now(table).agg(F.coalesce(F.max(f.name), F.lit(0)) + 1).scalar()
                else:
                    values[f.name] = F.expr("uuid()")
            elif f.name == "updatedAt" or "default" in f.directives:
                default = (f.directives.get("default") or [Path(("now",))])[0]
                if isinstance(default, Path) and default.parts == ("now",):
                    default = Call("now", ())
                values |= self.assigned(table, f.name, default)
            elif f.type.nullable:
                values[f.name] = F.lit(None)
            else:
                raise WeftError("MissingRequiredField", f"{table.record.name}.{f.name}")
        columns = []
        for n, c in table.columns.items():
            v = F.col(f"`{linked[n]}`") if n in linked else values.get(n, F.lit(None))
            columns.append(v.cast(c.type).alias(n))
        proposed = start.select(*columns)
        allowed = self.planner.filtered(table, proposed, self.catalog.permission(table, "insert"))
        self._changed(table, self._now(table).unionByName(allowed), Change(table.name, "insert", allowed, None, allowed))
        for c in s.children or []:
            if c.name in table.links:
                link = table.links[c.name]
                keys = allowed.select(*(F.col(f"`{a}`").alias(f"_fk{i}") for i, a in enumerate(link.local)))
                self.insert(self.catalog.table_of(link.record), c, (keys, {b: f"_fk{i}" for i, b in enumerate(link.foreign)}))
        return self._response(table, s, allowed)

    # --- update and delete ---

    def _marked(self, table: Table, s: Selection, operation: str) -> DataFrame:
        """All rows with ``_hit``: whether the mutation is meant for a row and allowed on it. Rows are told by their values alone, so a null key is no matter."""
        if table.key is None:
            raise WeftError("NoPrimaryKey", table.record.name)
        return self.planner.marked(table, self._now(table), [*s.wheres, self.catalog.permission(table, operation)], "_hit")

    def update(self, table: Table, s: Selection) -> DataFrame:
        permission = self.catalog.permission(table, "update")
        fixed = {k for e in exists_in(permission) for k in table.links[e.links[0]].local}
        values: dict[str, Column] = {}
        for c in s.children or []:
            if c.assigned and not self._omitted(c.value):
                if c.name in fixed:
                    raise WeftError("UpdateOfRelationshipKey", f"{table.record.name}.{c.name}")
                values |= self.assigned(table, c.name, c.value)
        if "updatedAt" in table.columns and "updatedAt" not in values:
            values["updatedAt"] = F.lit(self.planner.clock.now).cast("long")
        marked = self._marked(table, s, "update")
        own = {n: F.col(f"`{n}`") for n in table.columns}
        new = {n: values.get(n, own[n]).cast(c.type) for n, c in table.columns.items()}
        hit = marked.where("_hit")
        before, after = hit.select(*own.values()), hit.select(*(v.alias(n) for n, v in new.items()))
        snapshot = marked.select(*(F.when(F.col("_hit"), new[n]).otherwise(own[n]).alias(n) if n in values else own[n] for n in own))
        self._changed(table, snapshot, Change(table.name, "update", after, before, after))
        return self._response(table, s, after)

    def delete(self, table: Table, s: Selection) -> DataFrame:
        """Gives the rows as they were."""
        marked = self._marked(table, s, "delete")
        gone = marked.where("_hit").drop("_hit")
        self._changed(table, marked.where("not _hit").drop("_hit"), Change(table.name, "delete", gone, gone, None))
        return self._response(table, s, gone)

    # --- results ---

    def _now(self, table: Table) -> DataFrame:
        found = self.out.tables.get(table.name)
        return self.planner.source(table) if found is None else found.select(*(F.col(f"`{c}`").alias(c) for c in found.columns))

    def _changed(self, table: Table, snapshot: DataFrame, change: Change) -> None:
        self.out.tables[table.name] = snapshot
        self.out.changes.append(change)

    def _response(self, table: Table, s: Selection, rows: DataFrame) -> DataFrame:
        from ..operators.shape import logical_column

        fields = [c for c in self.planner.selected(table, s) if c.name not in table.links]
        return rows.select(*(logical_column(self.catalog, table.field(c.name), lambda n: F.col(f"`{n}`")).alias(c.alias) for c in fields))


def _as_variant(value: dict) -> VariantValue:
    if not isinstance(value, dict) or "_type" not in value:
        raise WeftError("InvalidValue", "a union value needs _type")
    return VariantValue(value["_type"], tuple((k, _as_variant(v) if isinstance(v, dict) else Const(v)) for k, v in value.items() if k != "_type"))


def generated_crud(catalog: Catalog, table: Table) -> str:
    """Create, update and delete queries of a record, as text."""
    name, root = table.record.name, table.record.name[:1].lower() + table.record.name[1:]

    def kind(f, optional: bool) -> str:
        text = "Int" if f.type.name == "Id.Int" else "String" if f.type.name == "Id.Uuid" else f.type.name
        return text + ("?" if optional or f.type.nullable else "")

    fields = [f for f in table.record.fields if f.name != table.key and f.name != "updatedAt"]
    key = table.field(table.key)
    create = ", ".join(f"${f.name}: {kind(f, 'default' in f.directives)}" for f in fields)
    change = ", ".join([f"${table.key}: {kind(key, False)}", *(f"${f.name}: {kind(f, True)}" for f in fields)])
    sets = " ".join(f"{f.name} = ${f.name}" for f in fields)
    where = f"@where {{ {table.key} == ${table.key} }}"
    return (
        f"insert {name}Create({create}) {{ {root} {{ {sets} }} }}\n"
        f"update {name}Update({change}) {{ {root} {{ {where} {sets} }} }}\n"
        f"delete {name}Delete(${table.key}: {kind(key, False)}) {{ {root} {{ {where} {table.key} }} }}\n"
    )
