"""Sync sessions: epochs, revisions, origins and limits of live messages on the server, and what a client keeps of them.

An epoch is one lifetime of the data; within it every change that goes out has the next revision. A client of another epoch starts over.
"""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import WeftError
from ..plans.mutate import Mutation
from ..schema import Table
from .protocol import MOST_RECIPIENTS, MOST_ROWS, Seen, catch_up, live_changes

# Fixed value: the most bytes of JSON text that a live message may have.
MOST_BYTES = 1 << 20


@dataclass(frozen=True)
class Reset:
    """What a client of another epoch gets instead of pages."""

    epoch: str
    reason: str = "epoch_changed"


@dataclass
class Pages:
    epoch: str
    revision: int
    tables: dict[str, DataFrame]
    cursor: dict[str, Seen]
    more: bool


@dataclass
class Message:
    """A table's changed rows for some sessions; without rows they have to catch up instead."""

    table: str
    op: str
    sessions: list[Any]
    rows: DataFrame | None
    epoch: str
    revision: int

    @property
    def sync_required(self) -> bool:
        return self.rows is None


@dataclass
class Delivery:
    """Messages to other sessions, and those that go back to the origin with its response."""

    epoch: str
    revision: int
    messages: list[Message] = field(default_factory=list)
    origin: list[Message] = field(default_factory=list)


class Server:
    """Keeps epoch and revision; ``save`` and ``load`` are its state as text."""

    def __init__(self, engine: Engine, epoch: str | None = None, revision: int = 0, new_epoch: Callable[[], str] = lambda: secrets.token_hex(16)):
        self.engine, self.new_epoch = engine, new_epoch
        self.epoch, self.revision = epoch or new_epoch(), revision

    def save(self) -> str:
        return json.dumps({"epoch": self.epoch, "revision": self.revision})

    @classmethod
    def load(cls, engine: Engine, text: str) -> "Server":
        return cls(engine, **json.loads(text))

    def rotate(self) -> str:
        """Starts a new epoch, whose revisions begin again."""
        self.epoch, self.revision = self.new_epoch(), 0
        return self.epoch

    def catch_up(self, cursor: dict[str, Seen], session: dict[str, Any], epoch: str | None = None, size: int | None = None) -> Pages | Reset:
        """Pages, or a reset for a client that knows another epoch; a client without an epoch gets pages."""
        if epoch is not None and epoch != self.epoch:
            return Reset(self.epoch)
        tables, after, more = catch_up(self.engine, cursor, session, size)
        return Pages(self.epoch, self.revision, tables, after, more)

    def deliver(self, mutation: Mutation, sessions: DataFrame, origin: Any = None) -> Delivery:
        """Messages about a mutation's rows (deleted ones as they were; ``op`` tells them), all with one new revision; a mutation that changed nothing has none and takes no revision.

        ``sessions`` has ``session_id`` and the session's fields. The origin is left out of the others' messages. Sessions with the same rows
        share a message. Beyond the limits of rows, bytes and sessions a message has no rows.
        """
        changes = [c for c in mutation.changes if not c.rows.isEmpty()]
        if not changes:
            return Delivery(self.epoch, self.revision)
        self.revision += 1
        out = Delivery(self.epoch, self.revision)
        others = sessions if origin is None else sessions.where(~F.col("session_id").eqNullSafe(F.lit(origin)))
        tables = {t.name: t for t in self.engine.catalog.tables.values()}
        for c in changes:
            out.messages += self._messages(tables[c.table], c.op, c.rows, others)
            if origin is not None:
                out.origin += self._messages(tables[c.table], c.op, c.rows, sessions.where(F.col("session_id").eqNullSafe(F.lit(origin))))
        return out

    def _messages(self, table: Table, op: str, rows: DataFrame, sessions: DataFrame) -> list[Message]:
        ids = [r[0] for r in sessions.select("session_id").limit(MOST_RECIPIENTS + 1).collect()]
        if not ids:
            return []
        if len(ids) > MOST_RECIPIENTS:
            return [Message(table.name, op, [], None, self.epoch, self.revision)]  # to all
        if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            return [Message(table.name, op, sorted(ids), None, self.epoch, self.revision)]
        out = []
        for found in live_changes(self.engine, table, rows, sessions).collect():  # at most one for each session
            mine = rows.where(F.col(f"`{table.key}`").isin(found["keys"]))
            whole = json_bytes(mine) <= MOST_BYTES
            out.append(Message(table.name, op, found["sessions"], mine if whole else None, self.epoch, self.revision))
        return sorted(out, key=lambda m: m.sessions)


def json_bytes(rows: DataFrame) -> int:
    """Bytes of the rows as JSON texts with their separators."""
    size = rows.select((F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})) + 1).alias("n"))
    return int(size.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


@dataclass
class Client:
    """What a client remembers of its server; ``accept`` says what is to be done with a message."""

    epoch: str | None = None
    revision: int | None = None
    cursor: dict[str, Seen] = field(default_factory=dict)

    def accept(self, epoch: str, revision: int) -> str:
        """``apply``, ``stale`` for a revision that was already applied, or ``reset`` for another epoch."""
        if self.epoch is not None and epoch != self.epoch:
            return "reset"
        if self.revision is not None and revision <= self.revision:
            return "stale"
        self.epoch, self.revision = epoch, revision
        return "apply"

    def reset(self, epoch: str) -> None:
        """Forgets rows, cursor and revision."""
        self.epoch, self.revision, self.cursor = epoch, None, {}

    def recompute(self, engine: Engine) -> dict[str, Seen]:
        """The cursor from the rows that are there: of tables with rows the newest time and the last key of that time; a table whose rows are gone starts over."""
        tables = {t.name: t for t in engine.catalog.tables.values()}
        if unknown := set(self.cursor) - set(tables):
            raise WeftError("UnknownTable", ", ".join(sorted(unknown)))
        after = dict(self.cursor)
        for name, table in tables.items():
            had = after.get(name, Seen())
            found = newest_seen(engine, table) if name in engine.tables else None
            if found is None:
                if name in after and (had.updated_at is not None or had.key is not None):
                    after[name] = Seen()
            elif found.updated_at is not None:
                after[name] = replace(found, permission_hash=had.permission_hash)
            else:
                after[name] = had
        self.cursor = after
        return after


def newest_seen(engine: Engine, table: Table) -> Seen | None:
    """The last place of a table in the order of pages, from one partial aggregation; None if there are no rows."""
    rows = engine.source(table)
    if table.key is None or "updatedAt" not in table.columns:
        return None if rows.isEmpty() else Seen()
    last = rows.agg(F.max(F.struct("updatedAt", F.col(f"`{table.key}`").alias("key"))).alias("last")).first()["last"]
    return None if last is None else Seen(last["updatedAt"], last["key"])
