"""A registry of standing queries, and which of them a change makes run again.

A change is looked at by three questions, the cheap ones first: does the query read the table; did a field that it reads change;
and, where nothing but the query's root reads the table, does a changed row meet the root's condition, before or after. Only the last two run Spark jobs, each
an aggregate of one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import WeftError
from ..lang.ast import Query, Selection
from ..plans.mutate import Change
from ..plans.predicate import exists_in
from ..schema import Catalog, Table
from .subscriptions import must_rerun, read_by


@dataclass
class Standing:
    query: Query
    text: str
    params: dict[str, Any]
    session: dict[str, Any]
    revision: int = 1


class Registry:
    """Standing queries by name."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.queries: dict[str, Standing] = {}

    def register(self, name: str, text: str, params: dict[str, Any] | None = None, session: dict[str, Any] | None = None) -> int:
        """Adds a query or replaces it; its revision, which counts the times that it was set."""
        query = self.engine._only(text, ("query",))
        bound = self.engine._bound(query, params)
        revision = self.queries[name].revision + 1 if name in self.queries else 1
        self.queries[name] = Standing(query, text, bound, dict(session or {}), revision)
        return revision

    def update(self, name: str, params: dict[str, Any]) -> int:
        """Gives a query other parameters; one that stays as it is keeps its revision."""
        if name not in self.queries:
            raise WeftError("UnknownQuery", name)
        standing = self.queries[name]
        bound = self.engine._bound(standing.query, params)
        if bound != standing.params:
            standing.params, standing.revision = bound, standing.revision + 1
        return standing.revision

    def unregister(self, name: str) -> bool:
        return self.queries.pop(name, None) is not None

    def current(self, name: str, revision: int) -> bool:
        """Whether a result that was made for a revision still counts."""
        return name in self.queries and self.queries[name].revision == revision

    def affected(self, change: Change) -> Iterator[str]:
        """Names of the queries that have to run again."""
        table = next(t for t in self.engine.catalog.tables.values() if t.name == change.table)
        fields: set[str] | None = None
        for name, standing in self.queries.items():
            if not must_rerun(self.engine.catalog, standing.query, change.table, "insert", None):
                continue  # doesn't read the table
            if change.op == "update" and table.key is not None:
                if fields is None:
                    fields = fields_changed(table, change)
                if not must_rerun(self.engine.catalog, standing.query, change.table, "update", fields):
                    continue
            elif change.rows.isEmpty():
                continue
            roots = roots_alone(self.engine.catalog, standing.query, table)
            if roots is None or any(self._meets(table, standing, r, change) for r in roots):
                yield name

    def _meets(self, table: Table, standing: Standing, root: Selection, change: Change) -> bool:
        """Whether a row meets the root's condition and permission as it was or as it is."""
        planner = self.engine.planner(standing.params, standing.session)
        for rows in (change.before, change.after):
            if rows is None:
                continue
            for p in [*root.wheres, self.engine.catalog.permission(table, "query")]:
                rows = planner.filtered(table, rows, p)
            if not rows.isEmpty():
                return True
        return False


def roots_alone(catalog: Catalog, query: Query, table: Table) -> list[Selection] | None:
    """The roots that read a table, if nothing else in the query does (a link, or an ``exists`` of whatever condition); else None."""
    mine = [r for r in query.roots if catalog.tables[r.name] is table]
    for root in query.roots:
        at = catalog.tables[root.name]
        inner = Query(query.kind, query.name, query.params, [Selection(root.name, root.alias, root.children, root.wheres)])
        conditions = [*root.wheres, catalog.permission(at, "query")]
        links = any(c.name in at.links for c in root.children or [])
        if (links or any(exists_in(p) for p in conditions if p is not None)) and table.name in _beyond(catalog, inner):
            return None
    return mine


def _beyond(catalog: Catalog, query: Query) -> set[str]:
    """Tables that a query of one root reads beyond its root: those of links and of ``exists`` paths, the root's own if they lead back to it."""
    root = query.roots[0]
    at = catalog.tables[root.name]
    out: set[str] = set()
    for c in root.children or []:
        if c.name in at.links:
            child = at.links[c.name].record
            child = child[:1].lower() + child[1:]
            out |= set(read_by(catalog, Query("query", "", {}, [Selection(child, child, c.children, c.wheres)])))
    for p in [*root.wheres, catalog.permission(at, "query")]:
        for e in exists_in(p) if p is not None else []:
            end = at
            for link in e.links:
                end = catalog.table_of(end.links[link].record)
                out.add(end.name)
            inner = Selection(end.record.name[:1].lower() + end.record.name[1:], "e", [], [e.where])
            out |= set(read_by(catalog, Query("query", "", {}, [inner])))
    return out


def fields_changed(table: Table, change: Change) -> set[str]:
    """Logical fields that differ in any row between the images of an update, from one aggregate over the images joined by key."""
    if change.before is None or change.after is None:
        return set(f.name for f in table.record.fields)
    was, now = change.before.alias("a"), change.after.alias("b")
    both = was.join(now, F.col(f"a.`{table.key}`").eqNullSafe(F.col(f"b.`{table.key}`")))
    differ = [F.max(~F.col(f"a.`{n}`").eqNullSafe(F.col(f"b.`{n}`"))).alias(n) for n in table.columns]
    found = both.agg(*differ).first()
    changed = {table.columns[n].logical for n in table.columns if found[n]}
    # A new key has no partner in the join.
    if not change.before.join(change.after.select(F.col(f"`{table.key}`").alias("_k")), F.col(f"`{table.key}`").eqNullSafe(F.col("_k")), "left_anti").isEmpty():
        changed.add(table.columns[table.key].logical)
    return changed


def changed_ids(table: Table, change: Change) -> DataFrame:
    """Distinct keys of changed rows, by the key's name and not by its place."""
    images = [x.select(F.col(f"`{table.key}`").alias("id")) for x in (change.before, change.after) if x is not None]
    out = images[0]
    for more in images[1:]:
        out = out.unionByName(more)
    return out.distinct()


def ids_in_result(changed: DataFrame, result: DataFrame, key: str = "id") -> DataFrame:
    """Changed ids that a result shows."""
    return changed.join(result.select(F.col(f"`{key}`").alias("_k")), F.col("id") == F.col("_k"), "left_semi")


def ids_not_in_result(changed: DataFrame, result: DataFrame, key: str = "id") -> DataFrame:
    """Changed ids that a result doesn't show."""
    return changed.join(result.select(F.col(f"`{key}`").alias("_k")), F.col("id") == F.col("_k"), "left_anti")
