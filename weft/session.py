"""Session values: checked against the schema, and flattened to the names of physical columns."""

from __future__ import annotations

import json
from typing import Any

from .errors import WeftError
from .lang.ast import Field, TypeRef
from .schema import Catalog


def _fits(name: str, value: Any) -> bool:
    """Whether a value is of a scalar type; types that aren't listed take any."""
    if name in ("Int", "Id.Int", "DateTime"):
        return isinstance(value, int) and not isinstance(value, bool)
    if name == "Float":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if name == "Bool":
        return isinstance(value, bool)
    return isinstance(value, str) if name in ("String", "Id.Uuid", "Date") else True


def prepare(catalog: Catalog, value: Any) -> dict[str, Any]:
    """Session fields by physical name: a union gives its tag and ``field__payload`` names, those of other variants null.

    Raises ``InvalidSession`` for what isn't an object or doesn't fit its type and ``MissingSessionField`` for a required field that is absent or null. A schema without
    session fields takes any: booleans as 0 and 1, lists and objects as JSON text. Values that the schema doesn't name are left out.
    """
    if not isinstance(value, dict):
        raise WeftError("InvalidSession", "expected an object")
    if not catalog.schema.session:
        return {n: int(v) if isinstance(v, bool) else json.dumps(v) if isinstance(v, (list, dict)) else v for n, v in value.items()}
    out: dict[str, Any] = {}
    for f in catalog.schema.session:
        if value.get(f.name) is None and not f.type.nullable:
            raise WeftError("MissingSessionField", f.name)
        _flatten(catalog, f.name, f.type, value.get(f.name), out)
    return out


def _flatten(catalog: Catalog, name: str, ref: TypeRef, value: Any, out: dict[str, Any]) -> None:
    union = catalog.schema.unions.get(ref.name)
    if union is None:
        if ref.name == "Bool" and isinstance(value, bool):
            out[name] = int(value)
            return
        if value is not None and not _fits(ref.name, value):
            raise WeftError("InvalidSession", f"{name}: {value!r} isn't {ref.name}")
        out[name] = value
        return
    plain = all(not v.fields for v in union.variants)
    tag = value if plain and isinstance(value, str) else value.get("_type") if isinstance(value, dict) else None
    variant = next((v for v in union.variants if v.name == tag), None)
    if value is not None and variant is None:
        raise WeftError("InvalidSession", f"{name}: no variant {tag!r}")
    out[name] = tag
    own: dict[str, Field] = {f.name: f for f in variant.fields} if variant else {}
    for p in catalog.payload(union.name).values():
        given = value.get(p.name) if p.name in own else None
        if p.name in own and given is None and not p.type.nullable:
            raise WeftError("MissingSessionField", f"{name}.{tag}.{p.name}")
        _flatten(catalog, f"{name}__{p.name}", p.type, given, out)
