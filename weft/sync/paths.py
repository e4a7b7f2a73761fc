"""Changes of nested results by path: ``.plants#(7).tools[0]``.

A path is fields, each with selectors of a list's row by place (``[n]``) or by id (``#(id)``, a backslash before a character that isn't meant as syntax).
Results are values (dicts and lists) that are never changed in place.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from ..errors import WeftError

_STEP = re.compile(r"\.(?P<field>(?:[^.\[#]|#(?!\())+)|\[(?P<place>-?\d+)\]|#\((?P<id>(?:\\.|[^\\)])*)\)", re.S)


def steps(path: str) -> list[tuple[str, Any]]:
    """(``field``, ``place`` or ``id``, value) of each step; raises ``InvalidPath``."""
    if path == ".":
        return []
    out: list[tuple[str, Any]] = []
    at = 0
    while at < len(path):
        found = _STEP.match(path, at)
        if found is None or (not out and found.lastgroup != "field"):
            raise WeftError("InvalidPath", f"{path!r} at {at}")
        kind, value = found.lastgroup, found[found.lastgroup]
        if kind == "id":
            value = re.sub(r"\\(.)", r"\1", value, flags=re.S)
            value = int(value) if re.fullmatch(r"-?\d+", value, re.A) else value
        out.append((kind, int(value) if kind == "place" else value))
        at = found.end()
    if not out:
        raise WeftError("InvalidPath", repr(path))
    return out


def _place(rows: list, kind: str, value: Any) -> int:
    """The place of a row; ids of digits match numbers and texts alike."""
    if kind == "place":
        if not 0 <= value < len(rows):
            raise WeftError("OutOfBounds", str(value))
        return value
    for i, row in enumerate(rows):
        if isinstance(row, dict) and not isinstance(row.get("id"), (bool, float)) and row.get("id") is not None and str(row["id"]) == str(value):
            return i
    raise WeftError("NoSuchRow", str(value))


def changed(value: Any, path: list[tuple[str, Any]], change: Callable[[Any], Any]) -> Any:
    """The value with what stands at a path changed."""
    if not path:
        return change(value)
    (kind, name), rest = path[0], path[1:]
    if kind == "field":
        if not isinstance(value, dict) or name not in value:
            raise WeftError("NoSuchField", name)
        return {**value, name: changed(value[name], rest, change)}
    if not isinstance(value, list):
        raise WeftError("NotAList", str(name))
    i = _place(value, kind, name)
    return [*value[:i], changed(value[i], rest, change), *value[i + 1 :]]


def _bounded(n: Any, most: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or not 0 <= n <= most:
        raise WeftError("OutOfBounds", str(n))
    return n


def _row(x: Any) -> dict:
    if not isinstance(x, dict):
        raise WeftError("NotARow", repr(x)[:80])
    return x


def _list(x: Any) -> list:
    if not isinstance(x, list):
        raise WeftError("NotAList", repr(x)[:80])
    return x


def _inserted(op: dict, rows: list) -> list:
    i = _bounded(op.get("index"), len(rows))
    return [*rows[:i], _row(op.get("row")), *rows[i:]]


def _without(rows: list, n: Any) -> tuple[Any, list]:
    i = _bounded(n, len(rows) - 1)
    return rows[i], [*rows[:i], *rows[i + 1 :]]


def _moved(op: dict, rows: list) -> list:
    row, rest = _without(rows, op.get("from"))
    i = _bounded(op.get("to"), len(rest))
    return [*rest[:i], row, *rest[i:]]


def _set(op: dict, now: Any) -> dict:
    _row(now)
    return _row(op.get("row"))


def _removed(op: dict, now: Any) -> None:
    _row(now)


#: What an operation makes of the value at its path; a removed row leaves null there.
_CHANGES: dict[str, Callable[[dict, Any], Any]] = {
    "set-row": _set, "remove-row": _removed, "insert-row": lambda op, now: _inserted(op, _list(now)),
    "move-row": lambda op, now: _moved(op, _list(now)), "remove-row-by-index": lambda op, now: _without(_list(now), op.get("index"))[1],
}


def apply_at(result: Any, ops: list[dict]) -> tuple[Any, list[tuple[int, str]]]:
    """The result after all operations that can be done, and (place, error) of those that can't."""
    errors = []
    result = {} if result is None else result
    for n, op in enumerate(ops):
        try:
            if op.get("op") not in _CHANGES:
                raise WeftError("UnknownOperation", str(op.get("op")))
            result = changed(result, steps(op["path"]), lambda now, op=op: _CHANGES[op["op"]](op, now))
        except WeftError as e:
            errors.append((n, e.kind))
    return result, errors
