"""Canonical text of schemas and queries, and digests of queries by it."""

from __future__ import annotations

import hashlib
from typing import Any

from .ast import And, Call, Compare, Const, Exists, Field, Link, ListOf, Or, Param, Path, Query, Record, Schema, Selection, SessionPath, TypeRef, Union, VariantValue

_STEP = "    "


def show_type(t: TypeRef) -> str:
    args = f"<{', '.join(map(show_type, t.args))}>" if t.args else ""
    return f"{t.name}{args}{'?' if t.nullable else ''}"


def show_value(v: Any) -> str:
    if isinstance(v, Const):
        v = v.value
    if v is None or isinstance(v, bool):
        return "null" if v is None else str(v)
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'
    if isinstance(v, Param):
        return f"${v.name}"
    if isinstance(v, SessionPath):
        return ".".join(("Session", *v.parts))
    if isinstance(v, Path):
        return ".".join(v.parts)
    if isinstance(v, Call):
        return f"{v.name}({', '.join(map(show_value, v.args))})"
    if isinstance(v, ListOf):
        return f"[{', '.join(map(show_value, v.items))}]"
    if isinstance(v, VariantValue):
        inner = ", ".join(f"{n} = {show_value(x)}" for n, x in v.fields)
        return f"{v.name} {{ {inner} }}" if inner else v.name
    return str(v)


def show_condition(p: Any) -> str:
    """A condition; chains are written as And(...) and Or(...), which leaves no doubt about their order."""
    if isinstance(p, (And, Or)):
        return f"{type(p).__name__}({', '.join(map(show_condition, p.parts))})"
    if isinstance(p, Exists):
        return f"exists {'.'.join(p.links)} {{ {show_condition(p.where)} }}"
    if isinstance(p, Compare):
        return f"{show_value(p.left)} {p.op} {show_value(p.right)}"
    return show_value(p)


def _argument(a: Any) -> str:
    return " ".join(map(show_value, a)) if isinstance(a, tuple) else show_value(a)


def _field(f: Field) -> str:
    directives = "".join(f" @{n}" + (f"({', '.join(map(_argument, a))})" if a else "") for n, a in f.directives.items())
    return f"{f.name} {show_type(f.type)}{directives}"


def _link(k: Link) -> str:
    far = [f"{k.namespace + '.' if k.namespace else ''}{k.record}.{f}" for f in k.foreign]
    return f"{k.name} @link({', '.join([*k.local, *far])})"


def _union(u: Union) -> str:
    variants = []
    for v in u.variants:
        inner = "".join(f"{_STEP * 2}{_field(f)}\n" for f in v.fields)
        variants.append(f"{v.name} {{\n{inner}{_STEP}}}" if inner else v.name)
    return f"type {u.name}\n{_STEP}= " + f"\n{_STEP}| ".join(variants) + "\n"


def _record(r: Record) -> str:
    lines = []
    for name, args, block in r.directives:
        text = f"@{name}" + (f"({', '.join(map(_argument, args))})" if args else "")
        if block is not None:
            text += f"{' where' if name != 'allow' else ''} {{ {show_condition(block)} }}"
        lines.append(text)
    lines += [*map(_field, r.fields), *map(_link, r.links)]
    return f"record {r.name} {{\n" + "".join(f"{_STEP}{x}\n" for x in lines) + "}\n"


def show_schema(s: Schema) -> str:
    parts = [] if s.syncable else ["@syncable(false)\n"]
    if s.session:
        parts.append("session {\n" + "".join(f"{_STEP}{_field(f)}\n" for f in s.session) + "}\n")
    return "\n".join([*parts, *map(_union, s.unions.values()), *map(_record, s.records.values())])


def _selection(s: Selection, depth: int) -> str:
    pad = _STEP * depth
    name = s.name if s.alias == s.name else f"{s.alias}: {s.name}"
    if s.assigned:
        return f"{pad}{name} = {show_value(s.value)}\n"
    if s.children is None:
        return f"{pad}{name}\n"
    inner = "".join(f"{pad}{_STEP}@where {{ {show_condition(p)} }}\n" for p in s.wheres)
    inner += "".join(f"{pad}{_STEP}@sort({f}, {way.capitalize()})\n" for f, way in s.sorts)
    inner += "".join(f"{pad}{_STEP}@limit({show_value(v)})\n" for v in s.limits)
    return f"{pad}{name} {{\n{inner}" + "".join(_selection(c, depth + 1) for c in s.children) + f"{pad}}}\n"


def show_query(q: Query) -> str:
    params = ", ".join(f"${n}: {show_type(t)}" for n, t in q.params.items())
    return f"{q.kind} {q.name}{f'({params})' if params else ''} {{\n" + "".join(_selection(r, 1) for r in q.roots) + "}\n"


def query_hashes(q: Query) -> tuple[str, str]:
    """SHA-256 of what callers see (kind, parameters, selected names), and of the whole query; the name counts in neither."""

    def names(s: Selection) -> str:
        return s.alias + ("" if s.children is None else "{" + ",".join(names(c) for c in s.children if not c.assigned) + "}")

    interface = f"{q.kind}({','.join(f'{n}:{show_type(t)}' for n, t in q.params.items())})" + ";".join(map(names, q.roots))
    whole = show_query(Query(q.kind, "_", q.params, q.roots))
    return tuple(hashlib.sha256(x.encode()).hexdigest() for x in (interface, whole))


def proposed_links(s: Schema) -> list[tuple[str, str]]:
    """Links that lead back where none does: the record and the text of its link."""
    out = []
    for record in s.records.values():
        for k in record.links:
            target = s.records.get(k.record)
            key = next((f.name for f in record.fields if "id" in f.directives), None)
            local = k.local or [key]
            if target is not None and not any(x.record == record.name and x.foreign == local for x in target.links):
                name = record.name[:1].lower() + record.name[1:] + "s"
                out.append((target.name, _link(Link(name, list(k.foreign), record.name, list(local)))))
    return out


def watched(s: Schema) -> list[tuple[str, str]]:
    """Kinds of changes (record, operation) that records ask to watch; without arguments inserts."""
    out = []
    for r in s.records.values():
        for name, args, _ in r.directives:
            if name == "watch":
                out += [(r.name, a.parts[0]) for a in args] or [(r.name, "insert")]
    return out
