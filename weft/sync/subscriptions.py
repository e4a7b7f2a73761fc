"""Standing queries: when to run them again, and how results changed."""

from __future__ import annotations

from typing import Any

from ..lang.ast import Query, Selection
from ..plans.predicate import exists_in, fields_of
from ..schema import Catalog, Table


def read_by(catalog: Catalog, query: Query) -> dict[str, set[str]]:
    """Fields by table that a query selects, filters or sorts by, keys of its links included, and all that query permissions and ``exists`` conditions read."""
    out: dict[str, set[str]] = {}

    def condition(table: Table, p: Any) -> None:
        if p is None:
            return
        out.setdefault(table.name, set()).update(fields_of(p))
        for e in exists_in(p):
            at = table
            for name in e.links:
                link = at.links[name]
                out.setdefault(at.name, set()).update(link.local)
                at = catalog.table_of(link.record)
                out.setdefault(at.name, set()).update(link.foreign)
            condition(at, e.where)

    def visit(root: str, s: Selection) -> None:
        table = catalog.tables[root]
        fields = out.setdefault(table.name, set())
        for p in [*s.wheres, catalog.permission(table, "query")]:
            condition(table, p)
        fields |= {f for f, _ in s.sorts} | ({table.key} if table.key else set())
        for c in s.children or []:
            if c.name == "*":
                fields |= {f.name for f in table.record.fields}
            elif c.name in table.links:
                link = table.links[c.name]
                fields.update(link.local)
                child = link.record[:1].lower() + link.record[1:]
                visit(child, c)
                out[catalog.tables[child].name].update(link.foreign)
            else:
                fields.add(c.name)

    for root in query.roots:
        visit(root.name, root)
    return out


def must_rerun(catalog: Catalog, query: Query, table: str, op: str, changed: set[str] | None) -> bool:
    """Whether a change may change a result: a row came or went, or a field that the query reads changed (None: unknown fields)."""
    read = read_by(catalog, query)
    if table not in read:
        return False
    return op in ("insert", "delete") or changed is None or bool(changed & read[table])


def changed_fields(before: dict[str, Any], after: dict[str, Any]) -> set[str]:
    return {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}


def diff(old: list[dict], new: list[dict], key: str = "id") -> list[dict]:
    """Operations that turn one result list into another: remove, insert, move and set, to be applied in order."""
    ops: list[dict] = []
    now = list(old)
    wanted = {r[key] for r in new}
    for i in range(len(now) - 1, -1, -1):
        if now[i][key] not in wanted:
            ops.append({"op": "remove", "index": i})
            del now[i]
    for i, row in enumerate(new):
        at = next((j for j in range(i, len(now)) if now[j][key] == row[key]), None)
        if at is None:
            ops.append({"op": "insert", "index": i, "row": row})
            now.insert(i, row)
            continue
        if at != i:
            ops.append({"op": "move", "from": at, "to": i})
            now.insert(i, now.pop(at))
        if now[i] != row:
            ops.append({"op": "set", "index": i, "row": row})
            now[i] = row
    return ops


def apply_diff(rows: list[dict], ops: list[dict]) -> list[dict]:
    out = list(rows)
    for op in ops:
        if op["op"] == "remove":
            del out[op["index"]]
        elif op["op"] == "insert":
            out.insert(op["index"], op["row"])
        elif op["op"] == "move":
            out.insert(op["to"], out.pop(op["from"]))
        else:
            out[op["index"]] = op["row"]
    return out
