"""Checks of a query against a catalogue, before any plan is made."""

from __future__ import annotations

from typing import Any

from ..errors import WeftError
from ..functions.registry import FUNCTIONS
from ..lang.ast import Call, Compare, Const, Exists, ListOf, Param, Path, Query, Selection, SessionPath, TypeRef, VariantValue
from ..schema import Catalog, Table
from .predicate import fields_of, resolve, walk


_KINDS = {"Int": "number", "Float": "number", "DateTime": "number", "Id.Int": "number", "String": "text", "Date": "text", "Id.Uuid": "text", "Bool": "bool"}
#: Kinds of the arguments and of the result; None is any.
_NUMERIC = "abs acos asin atan atan2 ceil cos exp floor ln log mod pow round sign sin sqrt tan trunc randomblob".split()
_TEXTUAL = "lower upper trim ltrim rtrim replace like strftime".split()
_RESULTS = {"like": "bool", "length": "number", "julianday": "number", "now": "number", "random": "number", "pi": "number", "hex": "text", "date": "text", "time": "text", "datetime": "text", "substr": "text"}


def kind_of_type(catalog: Catalog, ref: TypeRef) -> str | None:
    """What a type's values are: number, text, bool, a union by its name, a list of such; None is not known."""
    if ref.name in catalog.schema.unions:
        return ref.name
    if ref.name in ("Json", "JSON"):
        return kind_of_type(catalog, ref.args[0]) if ref.args and ref.args[0].name == "List" else None
    if ref.name == "List":
        return f"list of {kind_of_type(catalog, ref.args[0])}"
    if ref.name in _KINDS:
        return _KINDS[ref.name]
    parts = ref.name.split(".")
    if len(parts) >= 2 and parts[-2] in catalog.schema.records:  # a key of another record
        target = next((f for f in catalog.schema.records[parts[-2]].fields if f.name == parts[-1]), None)
        return kind_of_type(catalog, target.type) if target else None
    return None


def _kind_of_path(catalog: Catalog, ref: TypeRef, parts: tuple[str, ...]) -> str | None:
    for variant, inner in zip(parts[1::2], parts[2::2], strict=False):
        found = next((v for v in catalog.schema.unions[ref.name].variants if v.name == variant), None) if ref.name in catalog.schema.unions else None
        fields = {f.name: f.type for f in found.fields} if found else {}
        if inner not in fields:
            return None
        ref = fields[inner]
    return kind_of_type(catalog, ref)


def kind_of(catalog: Catalog, table: Table, params: dict[str, TypeRef], x: Any) -> str | None:
    """What a value of a query is; checks the arguments of functions on the way."""
    if isinstance(x, Const):
        return None if x.value is None else "bool" if isinstance(x.value, bool) else "number" if isinstance(x.value, (int, float)) else "text"
    if isinstance(x, Param):
        return kind_of_type(catalog, params[x.name]) if x.name in params else None
    if isinstance(x, SessionPath):
        return _kind_of_path(catalog, catalog.session[x.parts[0]], x.parts) if x.parts[0] in catalog.session else None
    if isinstance(x, ListOf):
        kinds = {kind_of(catalog, table, params, i) for i in x.items} - {None}
        if len(kinds) > 1:
            raise WeftError("TypeMismatch", f"a list of {', '.join(sorted(kinds))}")
        return f"list of {kinds.pop()}" if kinds else None
    if isinstance(x, Path):
        field = table.field(x.parts[0])
        return _kind_of_path(catalog, field.type, x.parts) if field else None
    if isinstance(x, Call):
        kinds = [kind_of(catalog, table, params, a) for a in x.args]
        wanted = "number" if x.name in _NUMERIC else "text" if x.name in _TEXTUAL else None
        for k in kinds:
            if wanted and k not in (wanted, None):
                raise WeftError("TypeMismatch", f"{x.name} takes {wanted}, not {k}")
        if x.name in ("max", "min", "ifnull", "nullif"):
            return _alike(f"arguments of {x.name}", *kinds)
        return _RESULTS.get(x.name, wanted)
    return None


def _alike(what: str, *kinds: str | None) -> str | None:
    known = {k for k in kinds if k is not None and "None" not in k}
    if len(known) > 1:
        raise WeftError("TypeMismatch", f"{what}: {' and '.join(sorted(known))}")
    return known.pop() if known else None


def _typed(catalog: Catalog, table: Table, params: dict[str, TypeRef], p: Any) -> None:
    """Raises ``TypeMismatch`` for comparisons of values that can't be compared."""
    if isinstance(p, Compare):
        a, b = (kind_of(catalog, table, params, x) for x in (p.left, p.right))
        if p.op in ("in", "not in"):
            _alike(f"{p.op}", f"list of {a}" if a else None, b if b and b.startswith("list of ") else None)
        elif p.op in ("like", "not like"):
            _alike(p.op, "text", a, b)
        else:
            _alike(p.op, a, b)
    elif isinstance(p, Exists):
        at = table
        for name in p.links:
            if name not in at.links:
                return  # reported where it is planned
            at = catalog.table_of(at.links[name].record)
        _typed(catalog, at, params, p.where)
    else:
        for x in getattr(p, "parts", ()):
            if not isinstance(x, str):
                _typed(catalog, table, params, x)


_PYTHON = {"number": (int, float), "text": (str,), "bool": (bool,)}


def check_value(catalog: Catalog, name: str, ref: TypeRef, value: Any) -> None:
    """Raises ``InvalidParameter`` for a value that isn't of its declared type."""
    kind = kind_of_type(catalog, ref)
    if value is None or kind is None:
        return
    if kind.startswith("list of "):
        if not isinstance(value, (list, tuple)):
            raise WeftError("InvalidParameter", f"{name}: {ref.name}")
        inner = ref.args[0] if ref.name == "List" else ref.args[0].args[0]
        for v in value:
            check_value(catalog, name, inner, v)
        return
    if kind in catalog.schema.unions:
        names = {v.name for v in catalog.schema.unions[kind].variants}
        tag = value.get("_type") if isinstance(value, dict) else value
        if tag not in names:
            raise WeftError("InvalidParameter", f"{name}: {ref.name}")
        return
    whole = ref.name in ("Int", "Id.Int", "DateTime") or (kind == "number" and ref.name != "Float")
    if not isinstance(value, _PYTHON[kind]) or (kind == "number" and isinstance(value, bool)) or (whole and not isinstance(value, int)):
        raise WeftError("InvalidParameter", f"{name}: {ref.name}")


def check(catalog: Catalog, query: Query) -> None:
    """Raises the first fault found: unknown names, repeated or empty selections, misplaced arguments, unused or undefined parameters."""
    used: set[str] = set()
    for root in query.roots:
        if root.name not in catalog.tables:
            raise WeftError("UnknownTable", root.name)
    if not query.roots:
        raise WeftError("NoFieldsSelected", query.name)
    aliases = [r.alias for r in query.roots]
    if len(set(aliases)) < len(aliases):
        raise WeftError("DuplicateQueryField", query.name)
    for root in query.roots:
        _selection(catalog, catalog.tables[root.name], root, query, used, True)
    if undefined := used - set(query.params):
        raise WeftError("UndefinedParameter", ", ".join(sorted(undefined)))
    if unused := set(query.params) - used:
        raise WeftError("UnusedParameter", ", ".join(sorted(unused)))


def _value(p: Any, used: set[str]) -> None:
    for x in walk(p):
        if isinstance(x, Param):
            used.add(x.name)
        elif isinstance(x, Call):
            if x.name not in FUNCTIONS:
                raise WeftError("UnknownFunction", x.name)
            if FUNCTIONS[x.name][0] != len(x.args):
                raise WeftError("WrongNumberOfArguments", x.name)


def _selection(catalog: Catalog, table: Table, s: Selection, query: Query, used: set[str], root: bool) -> None:
    name, kind = table.record.name, query.kind
    children = s.children or []
    if not children:
        raise WeftError("NoFieldsSelected" if root else "LinkSelectionIsEmpty", f"{name}: {s.name}")
    if len(s.wheres) > 1:
        raise WeftError("MultipleWheres", name)
    if len(s.limits) > 1:
        raise WeftError("MultipleLimits", name)
    if s.limits and any(c.children is not None for c in children):
        raise WeftError("LimitOnNestedSelection", name)
    for p in s.wheres:
        for field in fields_of(p):
            if table.field(field) is None and field in table.links:
                raise WeftError("WhereOnLinkIsntAllowed", f"{name}.{field}")
        _value(p, used)
        _typed(catalog, table, query.params, p)
    for p in s.limits:
        _value(p, used)
    for field, _ in s.sorts:
        if table.field(field) is None:
            raise WeftError("UnknownField", f"{name}.{field}")
    seen: set[str] = set()
    for c in children:
        if c.alias in seen and kind != "insert":
            raise WeftError("DuplicateQueryField", f"{name}.{c.alias}")
        seen.add(c.alias)
        if c.name == "*":
            continue
        if c.name in table.links:
            if c.assigned:
                raise WeftError("CannotAssignLink", f"{name}.{c.name}")
            if kind in ("update", "delete"):
                raise WeftError("LinksInUpdateOrDelete", f"{name}.{c.name}")
            if c.children is None:
                raise WeftError("LinkSelectionIsEmpty", f"{name}.{c.name}")
            _selection(catalog, catalog.table_of(table.links[c.name].record), c, query, used, False)
            continue
        if table.field(c.name) is None:
            raise WeftError("UnknownField", f"{name}.{c.name}")
        if c.children is not None:
            raise WeftError("NestedSelectionOnField", f"{name}.{c.name}")
        if c.assigned:
            if kind not in ("insert", "update"):
                raise WeftError("AssignmentInQuery", f"{name}.{c.name}")
            _value(c.value, used)
            if not isinstance(c.value, VariantValue):
                wanted = kind_of_type(catalog, table.field(c.name).type)
                _alike(f"{name}.{c.name}", wanted, None if wanted in catalog.schema.unions else kind_of(catalog, table, query.params, c.value))
    if kind == "query" and all(c.name in table.links and not c.children for c in children):
        raise WeftError("NoFieldsSelected", name)
    for p in s.wheres:
        for x in walk(p):
            parts = getattr(x, "parts", None)
            if type(x).__name__ == "Path" and table.field(parts[0]) is not None:
                resolve(catalog, table, parts)
