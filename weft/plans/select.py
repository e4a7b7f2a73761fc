"""Nested selections as DataFrames.

Filters and permissions stand at the scans. Each relationship is aggregated before it is joined, so several one-to-many
links never multiply each other. Children are restricted to surviving parents only where parents were filtered or limited. Sort and limit
apply to the root, before anything is joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WeftError
from ..functions.registry import Clock
from ..lang.ast import And, Const, Exists, Param, Selection
from ..operators.relations import attach_each, attach_many, attach_one, mark_exists, restrict
from ..operators.shape import logical_column
from ..schema import Catalog, Table
from .predicate import Context, compile_predicate, exists_in

Source = Callable[[Table], DataFrame]


class Planner:
    def __init__(self, catalog: Catalog, source: Source, params: dict[str, Any], session: dict[str, Any], clock: Clock):
        self.catalog, self.source, self.params, self.session, self.clock = catalog, source, params, session, clock

    # --- conditions ---

    def filtered(self, table: Table, df: DataFrame, condition: Any) -> DataFrame:
        """Rows of a table that meet a condition; ``exists`` becomes a marker column, or a semi join where it stands alone."""
        if condition is None or condition == Const(True):
            return df
        if isinstance(condition, And):
            for part in condition.parts:
                df = self.filtered(table, df, part)
            return df
        if isinstance(condition, Exists):
            related, keys, local = self._related(table, condition)
            return restrict(df, local, related, keys)
        columns = df.columns
        marks: dict[Exists, str] = {}
        for e in exists_in(condition):
            related, keys, local = self._related(table, e)
            marks[e] = f"_exists{len(marks)}"
            df = mark_exists(df, local, related, keys, marks[e])
        ctx = self.context(table, lambda n: F.col(f"`{n}`"))
        ctx.exists = lambda e: F.col(marks[e])
        return df.where(compile_predicate(ctx, condition)).select(*(F.col(f"`{c}`") for c in columns))

    def marked(self, table: Table, df: DataFrame, conditions: list[Any], name: str) -> DataFrame:
        """All rows, and whether each meets the conditions; a condition that is null isn't met. No row goes or multiplies."""
        columns = df.columns
        conditions = [c for c in conditions if c is not None]
        marks: dict[Exists, str] = {}
        for e in [e for c in conditions for e in exists_in(c)]:
            if e not in marks:
                related, keys, local = self._related(table, e)
                marks[e] = f"_exists{len(marks)}"
                df = mark_exists(df, local, related, keys, marks[e])
        ctx = self.context(table, lambda n: F.col(f"`{n}`"))
        ctx.exists = lambda e: F.col(marks[e])
        met = F.lit(True)
        for c in conditions:
            met = met & compile_predicate(ctx, c)
        return df.select(*(F.col(f"`{c}`") for c in columns), F.coalesce(met, F.lit(False)).alias(name))

    def context(self, table: Table, column: Callable[[str], Column]) -> Context:
        return Context(self.catalog, table, column, self.params, self.session, self.clock)

    def _related(self, table: Table, e: Exists) -> tuple[DataFrame, list[str], list[str]]:
        """Rows at the end of a path of links that meet its condition, led back to the first link: rows, their keys, and the keys of the table."""
        path = []
        at = table
        for name in e.links:
            if name not in at.links:
                raise WeftError("UnknownLink", f"{at.record.name}.{name}")
            path.append((at, at.links[name]))
            at = self.catalog.table_of(at.links[name].record)
        rows = self.filtered(at, self.source(at), e.where)
        for parent, link in reversed(path[1:]):
            rows = restrict(self.source(parent), link.local, rows, link.foreign)
        return rows, path[0][1].foreign, path[0][1].local

    # --- selections ---

    def selected(self, table: Table, s: Selection) -> list[Selection]:
        """The selection with ``*`` replaced by all fields that aren't selected by themselves."""
        out = []
        named = {c.name for c in s.children or [] if c.name != "*"}
        for c in s.children or []:
            if c.name == "*":
                out += [Selection(f.name, f.name) for f in table.record.fields if f.name not in named]
            else:
                out.append(c)
        return out

    def _needed(self, table: Table, children: list[Selection], more: set[str]) -> list[str]:
        wanted = {c.name for c in children} | more
        names = [n for n, c in table.columns.items() if c.logical in wanted or n in wanted]
        for c in children:
            if c.name in table.links:
                names += table.links[c.name].local
        return list(dict.fromkeys(names))

    def rows(self, table: Table, s: Selection, root: bool, parents: tuple[DataFrame, list[str], list[str]] | None = None, keep: set[str] = frozenset()) -> tuple[DataFrame, dict[str, Column], bool]:
        """Rows of a selection with its links attached, the column of each alias, and whether rows were filtered."""
        children = self.selected(table, s)
        base = self.source(table)
        conditions = [*s.wheres, *([p] if (p := self.catalog.permission(table, "query")) is not None else [])]
        for c in conditions:
            base = self.filtered(table, base, c)
        narrowed = bool(conditions)
        if parents is not None:
            base = restrict(base, parents[2], parents[0], parents[1])
            narrowed = True
        sorts = s.sorts if root else []
        key = {table.key} if table.key else set()
        base = base.select(*(F.col(f"`{n}`") for n in self._needed(table, children, {f for f, _ in sorts} | key | set(keep))))
        if sorts:
            base = base.orderBy(*self.order(sorts))
        if root and s.limits:
            base = base.limit(self._limit(s.limits[0]))
            narrowed = True
        joined, out = base, {}
        for n, c in enumerate(children):
            if c.name not in table.links:
                continue
            link = table.links[c.name]
            target = self.catalog.table_of(link.record)
            parent = (base, link.local, link.foreign) if narrowed else None
            rows, columns, _ = self.rows(target, c, False, parent, set(link.foreign))
            value = F.struct(*(v.alias(a) for a, v in columns.items()))
            name = f"_link{n}"
            if self.catalog.singular(table, link):
                joined = attach_one(joined, link.local, rows, link.foreign, value, name)
            else:
                joined = attach_many(joined, link.local, rows, link.foreign, [target.key] if target.key else [], value, name)
            out[c.alias] = F.col(name)
        for c in children:
            if c.name not in table.links:
                out[c.alias] = logical_column(self.catalog, table.field(c.name), lambda n: F.col(f"`{n}`"))
        return joined, {c.alias: out[c.alias] for c in children}, narrowed

    def order(self, sorts: list[tuple[str, str]]) -> list[Column]:
        """Nulls come first ascending and last descending."""
        return [F.col(f"`{f}`").asc_nulls_first() if way == "asc" else F.col(f"`{f}`").desc_nulls_last() for f, way in sorts]

    def _limit(self, value: Any) -> int:
        n = self.params.get(value.name) if isinstance(value, Param) else getattr(value, "value", None)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise WeftError("InvalidLimit", repr(n))
        return n

    def root(self, s: Selection) -> DataFrame:
        """A root selection: one column per alias, in its order."""
        table = self.catalog.tables[s.name]
        rows, columns, _ = self.rows(table, s, True)
        if s.sorts and any(c.name in table.links for c in s.children or []):
            rows = rows.orderBy(*self.order(s.sorts))  # joins don't keep order
        return rows.select(*(v.alias(a) for a, v in columns.items()))

    def unnested(self, s: Selection) -> DataFrame:
        """A root selection with a row for each row at the end of its chain of links: what :meth:`root` gives with each array exploded, and no array is made.

        An array of ``root`` is a struct here. A row without linked rows is left out, as by ``explode``. Two links to many rows side by side would multiply
        each other and are refused. Arrays below a link to one row stay arrays. Rows are in the order of the root's sorts alone.
        """
        table, at, kept = self.catalog.tables[s.name], s, [f for f, _ in s.sorts]
        out, up, levels = None, [], []  # up: what leads from the level before to this one
        while True:
            children = self.selected(table, at)
            many = [c for c in children if c.name in table.links and not self.catalog.singular(table, table.links[c.name])]
            if len(many) > 1:
                raise WeftError("SeveralLinks", f"{table.record.name}: {', '.join(c.alias for c in many)}")
            link, n = table.links[many[0].name] if many else None, len(levels)
            down = link.local if link else []
            rows, columns, _ = self.rows(table, replace(at, children=[c for c in children if c not in many]), at is s, keep={*up, *down})
            named = {a: f"_v{n}_{i}" for i, a in enumerate(columns)}
            rows = rows.select(
                *(v.alias(named[a]) for a, v in columns.items()), *(F.col(f"`{f}`").alias(f"_s{i}") for i, f in enumerate(kept) if at is s),
                *(F.col(f"`{k}`").alias(f"_up{n}_{i}") for i, k in enumerate(up)), *(F.col(f"`{k}`").alias(f"_down{n}_{i}") for i, k in enumerate(down)),
            )
            out = rows if out is None else attach_each(out, [f"_down{n - 1}_{i}" for i in range(len(up))], rows, [f"_up{n}_{i}" for i in range(len(up))])
            levels.append(([c.alias for c in children], named))
            if link is None:
                break
            table, at, up = self.catalog.table_of(link.record), many[0], link.foreign
        if kept:
            out = out.orderBy(*self.order([(f"_s{i}", way) for i, (_, way) in enumerate(s.sorts)]))
        below: list[Column] = []
        for aliases, named in reversed(levels):
            below = [F.col(named[a]).alias(a) if a in named else F.struct(*below).alias(a) for a in aliases]
        return out.select(*below)
