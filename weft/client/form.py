"""The client's form of a query: nested dicts of selections with ``@where``, ``@sort``, ``@limit`` and ``@source``.

``{"plant": {"@where": {"keeper": {"$eq": 7}}, "@sort": [{"field": "id", "direction": "desc"}], "@limit": 5, "name": {"@source": "species", "@select": True}, "bed": {}}}``
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..errors import WeftError

# Operators of the form.
OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$like", "$nlike")


@dataclass
class Node:
    """What is asked of a table; without selections all its fields."""

    source: str
    alias: str
    where: dict | None = None
    sorts: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None
    selections: list["Node | Leaf"] = field(default_factory=list)


@dataclass
class Leaf:
    source: str
    alias: str


def bind(template: Any, given: dict[str, Any] | None, session: dict[str, Any] | None) -> Any:
    """A template with ``{"$var": name}`` and ``{"$session": name}`` replaced by their values; null where there is none."""
    if isinstance(template, list):
        return [bind(x, given, session) for x in template]
    if not isinstance(template, dict):
        return template
    if len(template) == 1:
        (kind, name), = template.items()
        if kind in ("$var", "$session") and isinstance(name, str):
            return ((given if kind == "$var" else session) or {}).get(name)
    return {k: bind(v, given, session) for k, v in template.items()}


def decode(form: dict[str, Any]) -> list[Node]:
    """The roots of a form; raises ``InvalidForm`` where a clause isn't valid. Selections of another kind are left out."""
    out = []
    for alias, body in form.items():
        if not isinstance(body, dict):
            raise WeftError("InvalidForm", f"{alias}: expected an object")
        out.append(_node(alias, body))
    return out


def _node(alias: str, body: dict[str, Any]) -> Node:
    source = body.get("@source")
    node = Node(source if isinstance(source, str) else alias, alias)
    if body.get("@where") is not None:
        node.where = _where(body["@where"])
    if body.get("@sort") is not None:
        clauses = body["@sort"] if isinstance(body["@sort"], list) else [body["@sort"]]
        node.sorts = [_sort(c) for c in clauses]
    if body.get("@limit") is not None:
        if not isinstance(body["@limit"], int) or isinstance(body["@limit"], bool):
            raise WeftError("InvalidForm", "@limit isn't an integer")
        node.limit = max(0, body["@limit"])
    for name, value in body.items():
        if name in ("@where", "@sort", "@limit", "@source", "@select"):
            continue
        if value is True:
            node.selections.append(Leaf(name, name))
        elif isinstance(value, dict) and value.get("@select") is True:
            other = value.get("@source")
            node.selections.append(Leaf(other if isinstance(other, str) else name, name))
        elif isinstance(value, dict):
            node.selections.append(_node(name, value))
    return node


def _sort(clause: Any) -> tuple[str, str]:
    if not isinstance(clause, dict) or not isinstance(clause.get("field"), str) or not isinstance(clause.get("direction"), str):
        raise WeftError("InvalidForm", "@sort needs field and direction")
    return clause["field"], "desc" if clause["direction"].lower() == "desc" else "asc"


def _where(where: Any) -> dict:
    """A checked condition: every operator is known, ``$and`` and ``$or`` have lists of conditions."""
    if not isinstance(where, dict):
        raise WeftError("InvalidForm", "@where isn't an object")
    for name, value in where.items():
        if name in ("$and", "$or"):
            if not isinstance(value, list):
                raise WeftError("InvalidForm", f"{name} needs a list")
            for part in value:
                _where(part)
        elif isinstance(value, dict):
            if unknown := set(value) - set(OPERATORS):
                raise WeftError("InvalidForm", f"unknown operator {', '.join(sorted(unknown))}")
    return where
