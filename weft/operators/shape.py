"""Between flat columns and logical values: projection of unions, booleans and JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import Field
from ..schema import Catalog


def logical_column(catalog: Catalog, f: Field, column: Callable[[str], Column], prefix: str = "") -> Column:
    """A field as results show it.

    Unions become structs with ``_type`` and the payload fields of all variants, those of other variants null; an absent or
    unknown variant is null. Null booleans are false. Typed JSON is parsed.
    """
    name = prefix + f.name
    c = column(name)
    union = catalog.schema.unions.get(f.type.name)
    if union is not None:
        payload = catalog.payload(union.name)
        members = []
        for p in payload.values():
            holders = [v.name for v in union.variants if any(x.name == p.name for x in v.fields)]
            members.append(F.when(c.isin(holders), logical_column(catalog, p, column, f"{name}__")).alias(p.name))
        return F.when(c.isin([v.name for v in union.variants]), F.struct(c.alias("_type"), *members))
    if f.type.name == "Bool":
        return F.coalesce(c, F.lit(False))
    if f.type.name in ("Json", "JSON") and f.type.args:
        return F.from_json(c, catalog.logical(f.type.args[0]))
    return c


def union_json(catalog: Catalog, union: str, value: Column) -> Column:
    """JSON text of a union struct: its variant's own fields, nulls among them included, and no others."""
    out = F.lit(None).cast("string")
    for v in catalog.schema.unions[union].variants:
        shown = F.struct(F.lit(v.name).alias("_type"), *(value[x.name].alias(x.name) for x in v.fields))
        out = F.when(value["_type"] == v.name, F.to_json(shown, {"ignoreNullFields": "false"})).otherwise(out)
    return out
