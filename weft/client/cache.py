"""Runs the client's form of a query over its tables.

Values are compared by their kinds: those of different kinds, or null, are neither less nor greater, so ``$gte`` and ``$lte`` hold
for them; they are equal only to their like. An operator with null never holds (null itself, as ``{"field": null}``, asks for null),
and neither do ``$nin``, ``$like`` and ``$nlike``. Where ``$and`` stands, nothing beside it counts; then ``$or``.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from ..errors import WeftError
from ..operators.relations import attach_many, attach_one
from ..operators.shape import logical_column
from ..schema import Table
from .form import Leaf, Node, bind, decode


def _kind(x: Any) -> str | None:
    if isinstance(x, T.DataType):
        return {"boolean": "bool", "long": "int", "integer": "int", "short": "int", "double": "float", "float": "float", "string": "string"}.get(x.typeName())
    if isinstance(x, bool):
        return "bool"
    return {int: "int", float: "float", str: "string"}.get(type(x))


def _equal(c: Column, kind: str | None, value: Any) -> Column:
    if value is None:
        return c.isNull()
    return F.coalesce(c == F.lit(value), F.lit(False)) if kind is not None and kind == _kind(value) else F.lit(False)


def _ordered(c: Column, kind: str | None, op: str, value: Any) -> Column:
    also = op in ("$gte", "$lte")  # what can't be compared counts as equal
    if kind != _kind(value) or kind not in ("int", "float", "string"):
        return F.lit(also)
    plain = {"$gt": c > F.lit(value), "$gte": c >= F.lit(value), "$lt": c < F.lit(value), "$lte": c <= F.lit(value)}[op]
    return F.coalesce(plain, F.lit(also))


def _operator(c: Column, kind: str | None, op: str, value: Any) -> Column:
    if op == "$in" and isinstance(value, list):
        alike = [v for v in value if v is not None and _kind(v) == kind]
        met = F.coalesce(c.isin(alike), F.lit(False)) if alike else F.lit(False)
        return met | c.isNull() if None in value else met
    if value is None or isinstance(value, (dict, list)) or op not in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
        return F.lit(False)
    if op in ("$eq", "$ne"):
        return _equal(c, kind, value) if op == "$eq" else ~_equal(c, kind, value)
    return _ordered(c, kind, op, value)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def condition(where: dict | None, columns: dict[str, T.DataType]) -> Column:
    """The column of a ``@where``; a field that the table doesn't have is null."""
    if where is None:
        return F.lit(True)
    if "$and" in where:
        return _all([condition(p, columns) for p in where["$and"]])
    if "$or" in where:
        return reduce(lambda a, b: a | b, [condition(p, columns) for p in where["$or"]], F.lit(False))
    parts = []
    for name, value in where.items():
        c = F.col(f"`{name}`") if name in columns else F.lit(None).cast("string")
        kind = _kind(columns[name]) if name in columns else None
        if isinstance(value, dict):
            parts += [_operator(c, kind, op, v) for op, v in value.items()]
        else:
            parts.append(_equal(c, kind, value))
    return _all(parts)


def entity_condition(where: dict | None, columns: dict[str, T.DataType]) -> Column:
    """The filter of a stream of entities: ``$eq``, ``$ne``, ``$in`` and ``$nin`` with strict equality, nulls equal to each other; all fields have to agree."""
    parts = []
    for name, value in (where or {}).items():
        c = F.col(f"`{name}`") if name in columns else F.lit(None).cast("string")
        kind = _kind(columns[name]) if name in columns else None
        if kind in ("int", "float"):  # numbers are of one kind there

            def same(v, c=c):
                return c.isNull() if v is None else F.coalesce(c.cast("double") == F.lit(float(v)), F.lit(False)) if _kind(v) in ("int", "float") else F.lit(False)
        else:

            def same(v, c=c, kind=kind):
                return _equal(c, kind, v)

        if not isinstance(value, dict):
            parts.append(same(value))
        elif "$eq" in value:
            parts.append(same(value["$eq"]))
        elif "$ne" in value:
            parts.append(~same(value["$ne"]))
        elif "$in" in value:
            parts.append(reduce(lambda a, b: a | b, map(same, value["$in"]), F.lit(False)))
        elif "$nin" in value:
            parts.append(_all([~same(v) for v in value["$nin"]]))
        else:
            parts.append(F.lit(False))
    return _all(parts)


class Cache:
    """A client's tables, queried in its own form; permissions were applied when rows came."""

    def __init__(self, engine: Engine):
        self.engine, self.catalog = engine, engine.catalog

    def query(self, form: dict[str, Any], given: dict[str, Any] | None = None, session: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        """One DataFrame per root of the form, which may be a template."""
        out = {}
        for node in decode(bind(form, given, session)):
            if node.source not in self.catalog.tables:
                raise WeftError("UnknownTable", node.source)
            table = self.catalog.tables[node.source]
            rows = self._kept(table, node)
            order = self._order(table, node)
            if node.sorts:
                rows = rows.orderBy(*order)
            if node.limit is not None:
                rows = rows.limit(node.limit)
            joined, shown = self._shown(table, node, rows)
            if node.sorts and joined is not rows:
                joined = joined.orderBy(*order)  # joins don't keep order
            out[node.alias] = joined.select(*(c.alias(a) for a, c in shown.items()))
        return out

    def _kept(self, table: Table, node: Node) -> DataFrame:
        return self.engine.source(table).where(condition(node.where, {n: c.type for n, c in table.columns.items()}))

    def _order(self, table: Table, node: Node) -> list[Column]:
        """Nulls, which the form calls equal to anything, come first ascending and last descending; booleans have no order; ties go by key."""
        out, named = [], set()
        for name, way in node.sorts:
            if name in table.columns and _kind(table.columns[name].type) in ("int", "float", "string") and name not in named:
                c = F.col(f"`{name}`")
                out.append(c.asc_nulls_first() if way == "asc" else c.desc_nulls_last())
                named.add(name)
        if table.key and table.key not in named:
            out.append(F.col(f"`{table.key}`").asc_nulls_first())
        return out

    def _shown(self, table: Table, node: Node, rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        selections = node.selections or [Leaf(f.name, f.name) for f in table.record.fields]
        shown: dict[str, Column] = {}
        for n, s in enumerate(selections):
            if isinstance(s, Leaf):
                f = table.field(s.source)
                if f is None:
                    raise WeftError("UnknownField", f"{table.record.name}.{s.source}")
                shown[s.alias] = logical_column(self.catalog, f, lambda name: F.col(f"`{name}`"))
                continue
            if s.source not in table.links:
                raise WeftError("UnknownLink", f"{table.record.name}.{s.source}")
            link = table.links[s.source]
            target = self.catalog.table_of(link.record)
            name = f"_link{n}"
            related = self._kept(target, s)
            one = self.catalog.singular(table, link)
            order = [target.key] if target.key else []
            if not one and (s.sorts or s.limit is not None) and (by := self._order(target, s)):
                # The limit stands right behind the rank, so Spark cuts each key's rows before it shuffles them.
                related = related.withColumn("_at", F.row_number().over(Window.partitionBy(*(F.col(f"`{k}`") for k in link.foreign)).orderBy(*by)))
                related, order = related if s.limit is None else related.where(F.col("_at") <= s.limit), ["_at"]
            inner, columns = self._shown(target, s, related)
            value = F.struct(*(c.alias(a) for a, c in columns.items()))
            if one:
                rows = attach_one(rows, link.local, inner, link.foreign, value, name)
            else:
                rows = attach_many(rows, link.local, inner, link.foreign, order, value, name)
            shown[s.alias] = F.col(name)
        return rows, shown
