"""Mutations that a client shows before the server has answered.

The client's view of a table is what the server sent, with its own pending updates on top, in the order in which they were made. A view is a
plan: each pending update is a projection, so nothing is copied, and rolling back is leaving one out.
"""

from __future__ import annotations

from collections import ChainMap
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import WeftError
from ..schema import Table
from ..streaming.state import merge


@dataclass
class Pending:
    """An update of the rows where a field has a value."""

    table: str
    field: str
    equals: Any
    values: dict[str, Any]
    revision: int | None = None  # that the server acknowledged it with


class Optimistic:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.base: ChainMap = ChainMap({}, engine.tables)
        self.applied = 0  # the server's last revision that the base holds
        self.pending: dict[str, Pending] = {}  # by request, in order

    def _table(self, name: str) -> Table:
        table = self.engine.catalog.tables.get(name) or next((t for t in self.engine.catalog.tables.values() if t.name == name), None)
        if table is None:
            raise WeftError("UnknownTable", name)
        return table

    def begin(self, request: str, root: str, where: tuple[str, str], sets: dict[str, str], given: dict[str, Any]) -> bool:
        """Shows an update: ``where`` is (field, parameter), ``sets`` parameters by field. Parameters that aren't given set nothing; whether there is anything to show."""
        table = self._table(root)
        if unknown := {where[0], *sets} - set(table.columns):
            raise WeftError("UnknownField", ", ".join(sorted(unknown)))
        values = {f: given[p] for f, p in sets.items() if p in given}
        if request in self.pending or where[1] not in given or not values:
            return False
        entry = Pending(table.name, where[0], given[where[1]], values)
        if self.view(table.name).where(self._hit(entry)).isEmpty():
            return False
        self.pending[request] = entry
        return True

    @staticmethod
    def _hit(p: Pending):
        return F.col(f"`{p.field}`").eqNullSafe(F.lit(p.equals))

    def view(self, name: str) -> DataFrame:
        """A table as the client shows it."""
        rows = self.base[self._table(name).name]
        for p in self.pending.values():
            if p.table == self._table(name).name:
                kinds = {f.name: f.dataType for f in rows.schema.fields}
                rows = rows.withColumns({f: F.when(self._hit(p), F.lit(v).cast(kinds[f])).otherwise(F.col(f"`{f}`")) for f, v in p.values.items()})
        return rows

    def acknowledge(self, request: str, revision: int) -> None:
        """The server took an update; it stays on top until the base has that revision."""
        if request in self.pending:
            self.pending[request].revision = revision
            self._prune()

    def reject(self, request: str) -> bool:
        """Rolls an update back; those made after it stay."""
        return self.pending.pop(request, None) is not None

    def receive(self, revision: int, changes: dict[str, DataFrame]) -> bool:
        """Puts the server's rows into the base, under what is pending; a revision that it holds already is left out."""
        if revision <= self.applied:
            return False
        for name, rows in changes.items():
            table = self._table(name)
            self.base[table.name] = merge(self.base[table.name], rows, table.key) if "updatedAt" in table.columns else self._upserted(table, rows)
        self.applied = revision
        self._prune()
        return True

    def _upserted(self, table: Table, rows: DataFrame) -> DataFrame:
        old = self.base[table.name]
        new = rows.select(F.col(f"`{table.key}`").alias("_k"))
        return old.join(new, F.col(f"`{table.key}`") == F.col("_k"), "left_anti").unionByName(rows)

    def _prune(self) -> None:
        """Forgets acknowledged updates that the base holds, from the first on; one behind an open update waits for it, so the order stays."""
        for request, p in list(self.pending.items()):
            if p.revision is None or p.revision > self.applied:
                return
            del self.pending[request]
