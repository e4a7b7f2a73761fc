"""Generated rows that fit a schema: keys, foreign keys with a fan-out, and values by type, all from hashes of a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Catalog, Table, decapitalized

ROWS, FANOUT = 1000, 5.0


def row_counts(catalog: Catalog, rows: int = ROWS, fanout: float = FANOUT, most: int | None = None) -> dict[str, int]:
    """Rows per table: ``rows`` for tables without a parent, and for others ``fanout`` per row of the parent, at most ``most`` if that is given."""
    parents = {t.name: {catalog.table_of(k.record).name for k in t.links.values() if catalog.singular(t, k)} - {t.name} for t in catalog.tables.values()}
    out: dict[str, int] = {}

    def of(name: str, above: frozenset) -> int:
        if name not in out:
            known = [of(p, above | {name}) for p in sorted(parents[name]) if p not in above]
            out[name] = round(max(known) * fanout) if known else rows
            out[name] = out[name] if most is None else min(most, out[name])
        return out[name]

    for name in parents:
        of(name, frozenset({name}))
    return out


def seed(spark: SparkSession, catalog: Catalog, seed_number: int = 12345, rows: int = ROWS, fanout: float = FANOUT) -> dict[str, DataFrame]:
    """A DataFrame per table; the same seed gives the same rows."""
    counts = row_counts(catalog, rows, fanout)
    return {t.name: _rows(spark, catalog, t, seed_number, counts) for t in catalog.tables.values()}


def _rows(spark: SparkSession, catalog: Catalog, table: Table, number: int, counts: dict[str, int]) -> DataFrame:
    references = {k.local[0]: catalog.table_of(k.record) for k in table.links.values() if catalog.singular(table, k)}

    def draw(name: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(f"{number}:{table.name}:{name}")), F.lit(1 << 31))

    columns = []
    for name, c in table.columns.items():
        if name == table.key:
            value = F.col("id") + 1
        elif name in references:
            value = draw(name) % counts[references[name].name] + 1
        elif c.union:
            names = [v.name for v in catalog.schema.unions[c.union].variants]
            value = F.element_at(F.array(*map(F.lit, names)), (draw(name) % len(names) + 1).cast("int"))
        elif isinstance(c.type, T.BooleanType):
            value = draw(name) % 2 == 0
        elif isinstance(c.type, T.DoubleType):
            value = draw(name) / 1000
        elif isinstance(c.type, T.LongType):
            value = draw(name)
        else:
            value = F.format_string(f"{decapitalized(table.record.name)} {name} %d", draw(name))
        columns.append(value.cast(c.type).alias(name))
    return spark.range(counts[table.name]).select(*columns)
