"""Results at the edge: one JSON value per response, groups of affected rows, and JSON columns that are checked.

A response is one value for one caller, so its rows are bounded and the bound is checked before they are gathered; larger results are for
:func:`weft.engine.json_rows` or a table.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import json_rows
from .errors import WeftError
from .plans.mutate import Mutation
from .schema import Catalog, Table
from .sync.protocol import MOST_ROWS

MOST = 100_000


def gathered(df: DataFrame, most: int = MOST) -> list[Any]:
    """The rows as JSON values, in their order; raises ``ResponseTooLarge`` beyond ``most``."""
    found = json_rows(df).limit(most + 1).collect()
    if len(found) > most:
        raise WeftError("ResponseTooLarge", f"over {most} rows")
    return [json.loads(r["json"]) for r in found]


def root_json(df: DataFrame, most: int = MOST) -> str:
    """A root's rows as one JSON array; ``[]`` without rows."""
    return json.dumps(gathered(df, most), ensure_ascii=False, separators=(",", ":"))


def assembled(*parts: Mapping[str, Any]) -> dict[str, Any]:
    """One response from the results of several statements: a list takes the place of what was there, another value is added to it, names with an underscore in front are left out."""
    out: dict[str, Any] = {}
    for part in parts:
        for name, value in part.items():
            if name[:1] != "_":
                out[name] = list(value) if isinstance(value, list) else [*out.get(name, []), value]
    return out


def respond(results: Mapping[str, DataFrame], most: int = MOST) -> str:
    """The response to a query or a mutation: an object with an array per root."""
    return json.dumps(assembled({name: gathered(df, most) for name, df in results.items()}), ensure_ascii=False, separators=(",", ":"))


def affected_groups(mutation: Mutation) -> list[dict[str, Any]]:
    """Changed rows by table: ``table``, ``headers`` and ``rows``, in the order of the changes; rows of one table with the same headers are one group. Raises ``SyncRequired`` beyond the protocol's rows."""
    out: dict[tuple, dict[str, Any]] = {}
    left = MOST_ROWS
    for c in mutation.changes:
        rows = c.rows.limit(left + 1).collect()
        if len(rows) > left:
            raise WeftError("SyncRequired", c.table)
        left -= len(rows)
        if rows:
            group = out.setdefault((c.table, *c.rows.columns), {"table": c.table, "headers": c.rows.columns, "rows": []})
            group["rows"] += [list(r) for r in rows]
    return list(out.values())


def _parsed(name: str, c: Column) -> Column:
    """JSON text as a variant; the job fails where it isn't JSON. An array or object within a text is parsed once more."""
    value = F.try_parse_json(c)
    inner = F.try_variant_get(value, "$", "string")
    nested = F.when(F.schema_of_variant(value) == "STRING", F.when(inner.rlike(r"^\s*[\[{]"), F.try_parse_json(inner)))
    bad = c.isNotNull() & (value.isNull() | (F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)) & inner.rlike(r"^\s*[\[{]") & nested.isNull()))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"MalformedJson: {name}: "), F.substring(c, 1, 80)))).otherwise(F.coalesce(nested, value))


def normalized(catalog: Catalog, table: Table, rows: DataFrame) -> DataFrame:
    """Rows with their JSON columns, payload columns of unions among them, as variants; malformed JSON fails with ``MalformedJson`` and the column's name, null stays null."""
    json_columns = {c.name for f in table.record.fields for c in _json_columns(catalog, table, f)}
    return rows.select(*(_parsed(n, F.col(f"`{n}`")).alias(n) if n in json_columns else F.col(f"`{n}`") for n in rows.columns))


def _json_columns(catalog: Catalog, table: Table, f, prefix: str = "") -> list:
    name = prefix + f.name
    if f.type.name in catalog.schema.unions:
        return [c for p in catalog.payload(f.type.name).values() for c in _json_columns(catalog, table, p, f"{name}__")]
    return [table.columns[name]] if f.type.name in ("Json", "JSON") else []
