"""Schemas and data: introspection of DataFrames, differences of schemas, and migration of snapshots."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WeftError
from ..schema import Catalog, decapitalized

_NAMES = {"string": "String", "long": "Int", "integer": "Int", "short": "Int", "double": "Float", "float": "Float", "boolean": "Bool", "date": "Date", "timestamp": "DateTime"}


def to_schema(tables: dict[str, DataFrame], keys: dict[str, str] | None = None) -> str:
    """Schema text for DataFrames by table name; ``keys`` names their primary keys. Nested columns become JSON."""
    out = []
    for name, df in tables.items():
        key = (keys or {}).get(name)
        lines = [f"record {name[:1].upper()}{name[1:]} {{", f'    @tablename("{name}")', "    @public"]
        if key is None:
            lines.append("    @keyless")
        for f in df.schema.fields:
            kind = _NAMES.get(f.dataType.typeName(), "JSON")
            lines.append(f"    {f.name} {kind}{' @id' if f.name == key else '?' if f.nullable else ''}")
        out.append("\n".join([*lines, "}"]))
    return "\n\n".join(out) + "\n"


@dataclass(frozen=True)
class LinkRow:
    """A link as introspection reports it: ``foreign_key`` stands in the own table where it leads to one row, in the related one where to many."""

    table: str
    name: str
    foreign_key: str
    related: str
    kind: str  # many-to-one or one-to-many


def extract_links(catalog: Catalog) -> list[LinkRow]:
    """All links of a schema, by record and in their order."""
    out = []
    for table in catalog.tables.values():
        for name, link in table.links.items():
            away = any(n != table.key for n in link.local)
            out.append(LinkRow(table.name, name, link.local[0] if away else link.foreign[0], catalog.table_of(link.record).name, "many-to-one" if away else "one-to-many"))
    return out


def proposed_foreign_keys(tables: dict[str, DataFrame], keys: dict[str, str]) -> list[tuple[str, str, str]]:
    """Foreign keys (table, column, other table) that the names tell: a column named like another table's key, where one table alone has a key of that name."""
    owners: dict[str, list[str]] = {}
    for table, key in keys.items():
        owners.setdefault(key, []).append(table)
    return [(t, c, owners[c][0]) for t, df in tables.items() for c in df.columns if len(owners.get(c, [])) == 1 and owners[c][0] != t]


def with_links(schema: str, foreign_keys: list[tuple[str, str, str]], keys: dict[str, str]) -> str:
    """Schema text of :func:`to_schema` with a link each way for every foreign key (table, column, other table)."""
    more: dict[str, list[str]] = {}
    for table, column, other in foreign_keys:
        record, target = (n[:1].upper() + n[1:] for n in (table, other))
        more.setdefault(record, []).append(f"    {_free(f'{decapitalized(target)}By_{column}')} @link({column}, {target}.{keys[other]})")
        more.setdefault(target, []).append(f"    {_free(f'{decapitalized(record)}sBy_{column}')} @link({record}.{column})")
    blocks = []
    for block in schema.strip().split("\n\n"):
        name = block.split()[1]
        blocks.append("\n".join([block[:-2], *more.get(name, []), "}"]) if name in more else block)
    return "\n\n".join(blocks) + "\n"


def _free(name: str) -> str:
    return name.replace(".", "_")


def difference(old: Catalog, new: Catalog) -> list[tuple[str, str, str | None]]:
    """Steps (what, table, column) from one schema to another; dropped or retyped columns and dropped tables are errors."""
    before, after = ({t.name: t for t in c.tables.values()} for c in (old, new))
    if gone := set(before) - set(after):
        raise WeftError("TableDropped", ", ".join(sorted(gone)))
    steps: list[tuple[str, str, str | None]] = []
    for name, table in after.items():
        if name not in before:
            steps.append(("create", name, None))
            continue
        had = before[name].columns
        if gone := set(had) - set(table.columns):
            raise WeftError("ColumnDropped", f"{name}: {', '.join(sorted(gone))}")
        for c in table.columns.values():
            if c.name not in had:
                steps.append(("add", name, c.name))
            elif had[c.name].type != c.type:
                raise WeftError("ColumnTypeChanged", f"{name}.{c.name}")
    return steps


def migrate(tables: dict[str, DataFrame], old: Catalog, new: Catalog, spark) -> dict[str, DataFrame]:
    """Tables with new columns as null and new tables empty."""
    out = dict(tables)
    by_name = {t.name: t for t in new.tables.values()}
    for what, name, column in difference(old, new):
        if what == "create":
            out[name] = spark.createDataFrame([], T.StructType([T.StructField(c.name, c.type) for c in by_name[name].columns.values()]))
        else:
            out[name] = out[name].withColumn(column, F.lit(None).cast(by_name[name].columns[column].type))
    return out


@dataclass
class Managed:
    """Tables with the schema that they were made by, and a log of what was done to them."""

    tables: dict[str, DataFrame]
    schema: str | None = None
    log: list[dict] = field(default_factory=list)

    def recorded(self) -> str:
        """The log as lines of JSON, for a file beside the tables."""
        return "".join(json.dumps(entry, sort_keys=True) + "\n" for entry in self.log)


def ensure(managed: Managed, name: str, schema: str, spark, now: int = 0) -> str:
    """Brings tables to a schema: ``created``, ``migrated`` or ``up-to-date``, where nothing is done or logged.

    Tables without a recorded schema are ``UnmanagedTables``, as nothing says what they mean. What can't be migrated raises and leaves all as it was.
    """
    if managed.schema is None and managed.tables:
        raise WeftError("UnmanagedTables", ", ".join(sorted(managed.tables)))
    if managed.schema == schema:
        return "up-to-date"
    old, new = Catalog(managed.schema or ""), Catalog(schema)
    steps = difference(old, new)
    tables = migrate(managed.tables, old, new, spark)
    outcome = "created" if managed.schema is None else "migrated"
    managed.log.append({"name": f"ensure:{name}", "outcome": outcome, "schema": hashlib.sha256(schema.encode()).hexdigest(), "steps": [list(s) for s in steps], "at": now, "number": len(managed.log) + 1})
    managed.tables, managed.schema = tables, schema
    return outcome
