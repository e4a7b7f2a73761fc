"""Predicates compiled to columns.

One compiler with three modes of null and type semantics. ``sql`` is the rule: comparisons are null-safe where an operand is
declared nullable or is a null literal (or a nullable session value), else three-valued. ``live`` and ``client`` compare nulls
as equal to each other always; ``live`` compares real numbers within the smallest step, and ``client`` orders values of
different types as equal. Nullability comes from the schema, never from a DataFrame.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import WeftError
from ..functions.registry import Clock, call
from ..lang.ast import And, Call, Compare, Const, Exists, ListOf, Or, Param, Path, SessionPath, VariantValue
from ..schema import Catalog, Table

OMITTED = object()


@dataclass
class Context:
    """What a predicate may refer to. ``column`` gives a physical column; ``exists`` the marker column of an exists condition."""

    catalog: Catalog
    table: Table
    column: Callable[[str], Column]
    params: dict[str, Any] = field(default_factory=dict)
    session: dict[str, Any] = field(default_factory=dict)
    clock: Clock = field(default_factory=Clock)
    mode: str = "sql"
    exists: Callable[[Exists], Column] | None = None
    session_columns: Callable[[str], Column] | None = None


@dataclass
class _Operand:
    column: Column
    nullable: bool
    guards: list[Column]
    values: list | None = None  # of a list
    union: str | None = None
    real: bool = False
    array: bool = False  # a column of lists


def resolve(catalog: Catalog, table: Table, parts: tuple[str, ...]) -> tuple[str, bool, list[tuple[str, str]], str | None]:
    """Physical name, nullability, guards (discriminator, variant) and union of a field or a path through variants."""
    f = table.field(parts[0])
    if f is None:
        if parts[0] in table.links:
            raise WeftError("WhereOnLinkIsntAllowed", f"{table.record.name}.{parts[0]}")
        raise WeftError("UnknownField", f"{table.record.name}.{parts[0]}")
    name, nullable, guards, ref = parts[0], f.type.nullable, [], f.type
    rest = list(parts[1:])
    while rest:
        union = catalog.schema.unions.get(ref.name)
        if union is None or len(rest) < 2:
            raise WeftError("InvalidUnionPath", ".".join(parts))
        variant = next((v for v in union.variants if v.name == rest[0]), None)
        inner = next((x for x in variant.fields if x.name == rest[1]), None) if variant else None
        if inner is None:
            raise WeftError("InvalidUnionPath", ".".join(parts))
        guards.append((name, variant.name))
        name, ref, nullable = f"{name}__{inner.name}", inner.type, inner.type.nullable
        rest = rest[2:]
    return name, nullable, guards, ref.name if ref.name in catalog.schema.unions else None


def _session(ctx: Context, parts: tuple[str, ...]) -> _Operand:
    if parts[0] not in ctx.catalog.session:
        raise WeftError("UnknownSessionField", parts[0])
    ref = ctx.catalog.session[parts[0]]
    if ctx.session_columns is not None:
        column, guards = ctx.session_columns(parts[0]), []
        for variant, inner in zip(parts[1::2], parts[2::2], strict=False):  # a union value is a struct with _type
            guards.append(F.coalesce(column["_type"] == variant, F.lit(False)))
            column = F.when(guards[-1], column[inner])
        return _Operand(column, ref.nullable or len(parts) > 1, guards, array=len(parts) == 1 and ref.name in ("Json", "JSON") and bool(ref.args) and ref.args[0].name == "List")
    value = ctx.session.get(parts[0])
    guards = []
    for variant, inner in zip(parts[1::2], parts[2::2], strict=False):  # a union value is a dict with _type
        guards.append(F.lit(isinstance(value, dict) and value.get("_type") == variant))
        value = value.get(inner) if isinstance(value, dict) and value.get("_type") == variant else None
    if isinstance(value, (list, tuple)):
        return _Operand(F.lit(None), False, guards, list(value))
    return _Operand(F.lit(value), ref.nullable or len(parts) > 1, guards)


def operand(ctx: Context, x: Any, other_union: str | None = None) -> _Operand:
    if isinstance(x, Const):
        return _Operand(F.lit(x.value), x.value is None, [], real=isinstance(x.value, float))
    if isinstance(x, Param):
        if x.name not in ctx.params:
            raise WeftError("UndefinedParameter", x.name)
        value = ctx.params[x.name]
        if isinstance(value, (list, tuple)):
            return _Operand(F.lit(None), False, [], list(value))
        return _Operand(F.lit(value), False, [], real=isinstance(value, float))
    if isinstance(x, SessionPath):
        return _session(ctx, x.parts)
    if isinstance(x, ListOf):
        return _Operand(F.lit(None), False, [], [i.value if isinstance(i, Const) else ctx.params[i.name] for i in x.items])
    if isinstance(x, VariantValue) or (isinstance(x, Path) and other_union and len(x.parts) == 1 and ctx.table.field(x.parts[0]) is None):
        name = x.name if isinstance(x, VariantValue) else x.parts[0]
        if other_union and all(v.name != name for v in ctx.catalog.schema.unions[other_union].variants):
            raise WeftError("UnknownVariant", name)
        return _Operand(F.lit(name), False, [])
    if isinstance(x, Path):
        name, nullable, guards, union = resolve(ctx.catalog, ctx.table, x.parts)
        kind = ctx.table.columns[name].type.typeName() if name in ctx.table.columns else ""
        return _Operand(ctx.column(name), nullable, [ctx.column(d) == v for d, v in guards], union=union, real=kind == "double")
    if isinstance(x, Call):
        args = [operand(ctx, a) for a in x.args]
        return _Operand(call(x.name, [a.column for a in args], ctx.clock), any(a.nullable for a in args), [g for a in args for g in a.guards])
    raise WeftError("InvalidValue", repr(x))


def _compared(ctx: Context, op: str, a: _Operand, b: _Operand) -> Column:
    if op in ("in", "not in"):
        if b.array:
            found = F.coalesce(F.array_contains(b.column, a.column), F.lit(False))
            return found if op == "in" else ~found
        if b.values is None:
            raise WeftError("InNeedsAList", op)
        found = a.column.isin(b.values) if b.values else F.lit(False)
        return found if op == "in" else ~found
    if op in ("like", "not like"):
        found = F.ilike(a.column, b.column) if ctx.mode == "sql" else F.like(a.column, b.column)
        return found if op == "like" else ~found
    always = ctx.mode in ("live", "client")
    if op in ("==", "!="):
        equal = a.column.eqNullSafe(b.column) if always or a.nullable or b.nullable else a.column == b.column
        if ctx.mode == "live" and (a.real or b.real):
            near = F.abs(a.column.cast("double") - b.column.cast("double")) < sys.float_info.epsilon
            equal = F.coalesce(near, a.column.isNull() & b.column.isNull())
        return equal if op == "==" else ~equal
    plain = {">": a.column > b.column, "<": a.column < b.column, ">=": a.column >= b.column, "<=": a.column <= b.column}[op]
    if always and op in (">=", "<="):
        return F.coalesce(plain, a.column.isNull() & b.column.isNull()) if ctx.mode == "live" else F.coalesce(plain, F.lit(True))
    return F.coalesce(plain, F.lit(False)) if always else plain


def compile_predicate(ctx: Context, p: Any) -> Column:
    """The column of a condition; guards of union paths stand before the comparison, whatever its operator."""
    if isinstance(p, Const):
        return F.lit(bool(p.value))
    if isinstance(p, And):
        return reduce(lambda a, b: a & b, (compile_predicate(ctx, x) for x in p.parts))
    if isinstance(p, Or):
        return reduce(lambda a, b: a | b, (compile_predicate(ctx, x) for x in p.parts))
    if isinstance(p, Exists):
        if ctx.mode != "sql" or ctx.exists is None:
            return F.lit(False)
        return ctx.exists(p)
    if isinstance(p, Compare):
        a = operand(ctx, p.left)
        b = operand(ctx, p.right, a.union)
        if b.union and isinstance(p.left, Path) and a.union is None:
            a = operand(ctx, p.left, b.union)
        return reduce(lambda x, y: x & y, [*a.guards, *b.guards, _compared(ctx, p.op, a, b)])
    raise WeftError("InvalidCondition", repr(p))


def fields_of(p: Any) -> set[str]:
    """Names of the record's own fields that a condition reads."""
    if isinstance(p, Path):
        return {p.parts[0]}
    if isinstance(p, Compare):
        return fields_of(p.left) | fields_of(p.right)
    if isinstance(p, Call):
        return set().union(*map(fields_of, p.args), set())
    if isinstance(p, (And, Or)):
        return set().union(*map(fields_of, p.parts))
    return set()


def exists_in(p: Any) -> list[Exists]:
    if isinstance(p, Exists):
        return [p]
    return [e for x in getattr(p, "parts", ()) if not isinstance(x, str) for e in exists_in(x)]


def walk(p: Any):
    """A condition and all that stands in it."""
    yield p
    for attr in ("parts", "args", "items"):
        for x in getattr(p, attr, ()):
            if not isinstance(x, str):
                yield from walk(x)
    if isinstance(p, Compare):
        yield from walk(p.left)
        yield from walk(p.right)
    if isinstance(p, Exists):
        yield from walk(p.where)
    if isinstance(p, VariantValue):
        for _, v in p.fields:
            yield from walk(v)
