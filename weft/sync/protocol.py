"""Catch-up by pages and live changes per session.

A cursor holds for each table the last seen ``updatedAt`` and key and the permission's hash; a changed hash starts the table over.
Pages are ordered by (updatedAt, key), so rows of one second that a page cuts apart are not lost.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import WeftError
from ..lang.ast import SessionPath
from ..plans.predicate import Context, compile_predicate, walk
from ..schema import Table

# Limits of the protocol.
PAGE, MOST_PAGE, MOST_TABLES, MOST_HASH = 1000, 5000, 512, 256
MOST_ROWS, MOST_RECIPIENTS = 5000, 1000


#: Where rows without ``updatedAt`` stand in the order.
_NEVER = -(1 << 62)


@dataclass(frozen=True)
class Seen:
    """What a client has of a table: nothing if there is neither a time nor a key."""

    updated_at: int | None = None
    key: Any = None
    permission_hash: str = ""


def page_size(n: int | None) -> int:
    if n is None:
        return PAGE
    if n <= 0:
        raise WeftError("InvalidPageSize", str(n))
    return min(n, MOST_PAGE)


def check_cursor(engine: Engine, cursor: dict[str, Seen]) -> None:
    known = {t.name for t in engine.catalog.tables.values()}
    if len(cursor) > MOST_TABLES:
        raise WeftError("CursorTooLarge", str(len(cursor)))
    for name, seen in cursor.items():
        if name not in known:
            raise WeftError("UnknownTable", name)
        if len(seen.permission_hash) > MOST_HASH:
            raise WeftError("HashTooLong", name)


def permission_hash(engine: Engine, table: Table, session: dict[str, Any]) -> str:
    """A digest of the query permission and of the session values that it reads."""
    permission = engine.catalog.permission(table, "query")
    names = sorted({x.parts[0] for x in walk(permission) if isinstance(x, SessionPath)}) if permission is not None else []
    parts = ["permission_v1", repr(permission), *(f"{n}={type(session.get(n)).__name__}:{session.get(n)!r}" for n in names)]
    return hashlib.sha256("".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()


def status(engine: Engine, cursor: dict[str, Seen], session: dict[str, Any]) -> DataFrame:
    """Per table the newest visible ``updatedAt``, the permission's hash, and whether the client has to synchronize."""
    check_cursor(engine, cursor)
    out = None
    for table in engine.catalog.tables.values():
        if "updatedAt" not in table.columns:
            continue
        seen, now = cursor.get(table.name, Seen()), permission_hash(engine, table, session)
        newest = engine.planner(session=session).filtered(table, engine.source(table), engine.catalog.permission(table, "query")).agg(F.max("updatedAt").alias("newest"), F.count("*").alias("_rows"))
        changed = F.lit(seen.permission_hash != now)
        behind = F.coalesce(F.col("newest") > F.lit(_NEVER if seen.updated_at is None and seen.key is not None else seen.updated_at).cast("long"), F.lit(seen.updated_at is None and seen.key is None) & (F.col("_rows") > 0), F.lit(False))
        row = newest.select(F.lit(table.name).alias("table"), "newest", F.lit(now).alias("permission_hash"), (changed | behind).alias("needs_sync"))
        out = row if out is None else out.unionByName(row)
    return out


def page(engine: Engine, table: Table, seen: Seen, session: dict[str, Any], size: int | None = None) -> tuple[DataFrame, bool, Seen]:
    """The next rows of a table, whether there are more, and the cursor after them."""
    n, now = page_size(size), permission_hash(engine, table, session)
    rows = engine.planner(session=session).filtered(table, engine.source(table), engine.catalog.permission(table, "query"))
    time = F.coalesce(F.col("updatedAt"), F.lit(_NEVER))
    if seen.permission_hash == now and (seen.updated_at is not None or seen.key is not None):
        at = _NEVER if seen.updated_at is None else seen.updated_at
        rows = rows.where(time > at if seen.key is None else (time > at) | ((time == at) & (F.col(table.key) > seen.key)))
    found = rows.orderBy(time, table.key).limit(n + 1)
    got = found.collect()  # a page, at most 5,001 rows
    shown = engine.spark.createDataFrame(got[:n], found.schema)
    last = Seen(got[:n][-1]["updatedAt"], got[:n][-1][table.key], now) if got else Seen(seen.updated_at, seen.key, now)
    return shown, len(got) > n, last


def catch_up(engine: Engine, cursor: dict[str, Seen], session: dict[str, Any], size: int | None = None) -> tuple[dict[str, DataFrame], dict[str, Seen], bool]:
    """One page of every table that is behind, in the order of the sync layers; pages, the new cursor, and whether there is more."""
    check_cursor(engine, cursor)
    by_name = {t.name: t for t in engine.catalog.tables.values()}
    found = status(engine, cursor, session)
    behind = {r["table"] for r in found.where("needs_sync").collect()} if found is not None else set()  # a row for each table
    pages, after, more = {}, dict(cursor), False
    for layer in engine.catalog.sync_layers:
        for name in layer:
            table = by_name[name]
            if name not in behind or table.key is None:
                continue
            rows, rest, after[name] = page(engine, table, cursor.get(name, Seen()), session, size)
            pages[name], more = rows, more or rest
        if more:
            break
    return pages, after, more


def live_changes(engine: Engine, table: Table, rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Changed rows by the sessions that may see them: ``sessions`` (ids, sorted) and ``keys`` (sorted), one row per distinct set of rows.

    ``sessions`` has ``session_id`` and the session's fields; there are at most ``MOST_RECIPIENTS``, which is checked. Exists conditions
    are false here.
    """
    if sessions.limit(MOST_RECIPIENTS + 1).count() > MOST_RECIPIENTS or rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise WeftError("SyncRequired", table.name)
    met = _visible(engine, table, rows, sessions)
    sets = met.groupBy(F.col("_s_session_id").alias("session_id")).agg(F.array_sort(F.collect_set(table.key)).alias("keys"))
    return sets.groupBy("keys").agg(F.array_sort(F.collect_set("session_id")).alias("sessions")).select("sessions", "keys")


def live_blocks(engine: Engine, table: Table, rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """:func:`live_changes` of any number of changed rows, in blocks of at most ``MOST_ROWS``: ``block``, ``sessions`` and ``keys``.

    Blocks are dealt out by the key's hash, half full on average; if one has too many rows, there are twice as many. All blocks are
    one plan. Changes of one key stay in one block; more of them than a block takes can't be sent.
    """
    if sessions.limit(MOST_RECIPIENTS + 1).count() > MOST_RECIPIENTS:
        raise WeftError("SyncRequired", table.name)
    n = max(1, -(-rows.count() * 2 // MOST_ROWS))
    for _ in range(8):
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64(table.key), F.lit(n)))
        if (dealt.groupBy("_block").count().agg(F.max("count")).first()[0] or 0) <= MOST_ROWS:
            break
        n *= 2
    else:
        raise WeftError("SyncRequired", table.name)
    met = _visible(engine, table, dealt, sessions)
    sets = met.groupBy("_block", F.col("_s_session_id").alias("session_id")).agg(F.array_sort(F.collect_set(table.key)).alias("keys"))
    return sets.groupBy("_block", "keys").agg(F.array_sort(F.collect_set("session_id")).alias("sessions")).select(F.col("_block").alias("block"), "sessions", "keys")


def _visible(engine: Engine, table: Table, rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows with each session that may see them; its fields have ``_s_`` in front."""
    permission = engine.catalog.permission(table, "query")
    named = sessions.select(*(F.col(c).alias(f"_s_{c}") for c in sessions.columns))
    if permission is None:
        visible = F.lit(True)
    else:
        ctx = Context(engine.catalog, table, lambda n: F.col(f"`{n}`"), mode="live", session_columns=lambda n: F.col(f"_s_{n}"))
        visible = compile_predicate(ctx, permission)
    return rows.join(F.broadcast(named), visible)
