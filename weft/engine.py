"""The public API: a schema bound to DataFrames."""

from __future__ import annotations

import contextlib
import io
from collections import ChainMap
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import WeftError
from .functions.registry import Clock
from .lang.parser import parse_queries
from .plans.check import check, check_value
from .plans.mutate import Mutation, Mutator
from .plans.select import Planner
from .schema import Catalog, Table


def _stored(c: Column, kind: str, wanted: T.DataType) -> Column:
    """A column in its stored type; timestamps are seconds, those without a zone are taken as UTC."""
    if kind == "timestamp_ntz" and isinstance(wanted, T.LongType):
        return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)
    return c.cast(wanted)


class Engine:
    """Runs queries and mutations of a schema over DataFrames, one per table name.

    >>> engine = Engine(spark, schema_text, {"users": users, "posts": posts})
    >>> engine.query('query Q { user { id name posts { title } } }')["user"].show()
    """

    def __init__(self, spark: SparkSession, schema: str | Catalog, tables: Mapping[str, DataFrame], now: int = 0):
        self.spark = spark
        self.catalog = schema if isinstance(schema, Catalog) else Catalog(schema)
        self.tables = ChainMap({}, tables)  # snapshots of mutations over the given tables
        self.clock = Clock(now)

    def source(self, table: Table) -> DataFrame:
        """A table's physical columns under names of their own, so that a table may be joined with itself."""
        if table.name not in self.tables:
            raise WeftError("UnknownTable", table.name)
        df = self.tables[table.name]
        lacking = [c for c in table.columns if c not in df.columns]
        if lacking:
            raise WeftError("MissingColumn", f"{table.name}: {', '.join(lacking)}")
        kinds = dict(df.dtypes)
        return df.select(*(_stored(F.col(f"`{n}`"), kinds[n], c.type).alias(n) for n, c in table.columns.items()))

    def planner(self, params: dict[str, Any] | None = None, session: dict[str, Any] | None = None) -> Planner:
        return Planner(self.catalog, self.source, params or {}, session or {}, self.clock)

    def _only(self, text: str, kinds: tuple[str, ...]):
        queries = parse_queries(text)
        if len(queries) != 1 or queries[0].kind not in kinds:
            raise WeftError("ParsingError", f"expected one {' or '.join(kinds)}")
        check(self.catalog, queries[0])
        return queries[0]

    def _bound(self, query, params: dict[str, Any] | None) -> dict[str, Any]:
        """Parameters with absent nullable ones as null in queries and left out in mutations."""
        given = dict(params or {})
        if unknown := set(given) - set(query.params):
            raise WeftError("UnknownParameter", ", ".join(sorted(unknown)))
        for name, ref in query.params.items():
            if name in given and given[name] is None and not ref.nullable:
                raise WeftError("NullParameter", name)
            if name in given:
                check_value(self.catalog, name, ref, given[name])
            else:
                if not ref.nullable:
                    raise WeftError("MissingParameter", name)
                if query.kind == "query":
                    given[name] = None
        return given

    def query(self, text: str, params: dict[str, Any] | None = None, session: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        """One DataFrame per root selection, with nested structs and arrays."""
        query = self._only(text, ("query",))
        planner = self.planner(self._bound(query, params), session)
        return {root.alias: planner.root(root) for root in query.roots}

    def unnested(self, text: str, params: dict[str, Any] | None = None, session: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        """One DataFrame per root selection with a row for each row at the end of its chain of links, for results whose nested rows would be too large; see :meth:`Planner.unnested`."""
        query = self._only(text, ("query",))
        planner = self.planner(self._bound(query, params), session)
        return {root.alias: planner.unnested(root) for root in query.roots}

    def explain(self, text: str, params: dict[str, Any] | None = None, session: dict[str, Any] | None = None, mode: str = "formatted") -> dict[str, str]:
        """The plan of each root of a query, or of each snapshot of a mutation, as text; nothing is run."""
        query = self._only(text, ("query", "insert", "update", "delete"))
        frames = self.query(text, params, session) if query.kind == "query" else self.mutate(text, params, session).tables
        return {name: _plan(df, mode) for name, df in frames.items()}

    def mutate(self, text: str, params: dict[str, Any] | None = None, session: dict[str, Any] | None = None) -> Mutation:
        """The mutation's results; :meth:`apply` makes its snapshots the engine's tables."""
        query = self._only(text, ("insert", "update", "delete"))
        return Mutator(self.spark, self.planner(self._bound(query, params), session)).run(query)

    def apply(self, mutation: Mutation) -> None:
        self.tables.update(mutation.tables)


def _plan(df: DataFrame, mode: str) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, nulls included."""
    return df.select(F.to_json(F.struct(*(df[f"`{c}`"] for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))
