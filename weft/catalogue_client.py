"""Queries in the client's form, of sync sessions and of responses, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _NOTE, _NOTES_SQL, NOW, Query, _notes, engine
from .client.cache import Cache, entity_condition
from .engine import Engine
from .response import normalized
from .sync.optimistic import Optimistic
from .sync.session import Client, Server
from .sync.standing import Registry, changed_ids, ids_in_result, ids_not_in_result

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str, query: Query) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _form(name: str, root: str, sql: str, body: dict, given: dict | None = None) -> None:
    _add(name, sql, lambda s, d: Cache(engine(s, d)).query({root: body}, given, {"userId": 3})[root])


# --- the client's form ---
_form("client_filter", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal >= 1000.0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 3", {"@where": {"c_acctbal": {"$gte": 1000.0}, "c_mktsegment": {"$in": ["BUILDING", "MACHINERY", 4]}, "c_nationkey": {"$ne": 3}}, "c_custkey": True})
_form("client_and_or", "customer", "SELECT c_custkey FROM customer WHERE (c_nationkey = 3 AND c_acctbal < 0) OR (c_nationkey > 20 AND c_nationkey <= 23)", {"@where": {"$or": [{"$and": [{"c_nationkey": 3}, {"c_acctbal": {"$lt": 0.0}}]}, {"c_nationkey": {"$gt": 20, "$lte": 23}}]}, "c_custkey": True})
_form("client_mixed_kinds", "customer", "SELECT c_custkey FROM customer WHERE c_nationkey = 3", {"@where": {"c_nationkey": 3, "c_name": {"$gte": 5}, "c_acctbal": {"$lte": 7}}, "c_custkey": True})
_form("client_never", "customer", "SELECT c_custkey FROM customer WHERE false", {"@where": {"c_nationkey": {"$nin": [3]}}, "c_custkey": True})
_form("client_template", "customer", "SELECT c_custkey, c_name AS label FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'", {"@where": {"c_nationkey": {"$session": "userId"}, "c_mktsegment": {"$var": "segment"}}, "c_custkey": True, "label": {"@source": "c_name", "@select": True}}, {"segment": "BUILDING"})
_form("client_all_fields", "nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation", {})
_form("client_sort_limit", "customer", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25", {"@sort": [{"field": "c_acctbal", "direction": "desc"}], "@limit": 25, "c_custkey": True, "c_acctbal": True})


def _dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dearest orders of each customer of a nation, one row each."""
    form = {"customer": {"@where": {"c_nationkey": 3}, "c_custkey": True, "orders": {"@sort": [{"field": "o_totalprice", "direction": "desc"}], "@limit": 3, "o_orderkey": True}}}
    found = Cache(engine(spark, sf_dir)).query(form)["customer"]
    return found.select("c_custkey", F.posexplode_outer("orders").alias("place", "o")).select("c_custkey", F.col("place").cast("long").alias("place"), F.col("o.o_orderkey").alias("o_orderkey"))


_add(
    "client_nested_limit",
    "SELECT c.c_custkey, o.place, o.o_orderkey FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders) o "
    "ON o.o_custkey = c.c_custkey AND o.place < 3 WHERE c.c_nationkey = 3",
    _dearest,
)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).source(engine(spark, sf_dir).catalog.tables["customer"])
    return rows.where(entity_condition({"c_mktsegment": {"$nin": ["BUILDING", None]}, "c_nationkey": {"$in": [1, 2, 3]}}, {f.name: f.dataType for f in rows.schema.fields})).select("c_custkey")


_add("entity_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey IN (1, 2, 3)", _entities)


# --- sync sessions ---
def _recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = Client()
    seen = client.recompute(_notes(spark, sf_dir))["notes"]
    return spark.createDataFrame([("notes", seen.updated_at, seen.key)], "table string, updated_at long, key long")


_add("cursor_recompute", f"SELECT 'notes' AS \"table\", updatedAt AS updated_at, id AS key FROM {_NOTES_SQL} ORDER BY updatedAt DESC, id DESC LIMIT 1", _recomputed)


def _open_notes(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, _NOTE.replace("@allow(insert, update, delete) { False }", "@allow(insert, update, delete) { True }"), _notes(spark, sf_dir).tables, NOW)


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who gets what of a change of the notes of one day, without its origin: a row for each session and note, or one without a note where a session has to catch up."""
    e = _open_notes(spark, sf_dir)
    done = e.mutate("update Q { note { @where { updatedAt >= 800000000 updatedAt < 801000000 } updatedAt = 1 } }")
    sessions = spark.createDataFrame([(i, i // 2) for i in range(20)], "session_id long, userId long")
    out = spark.createDataFrame([], "session_id long, id long, revision long")
    for m in Server(e, "first").deliver(done, sessions, 3).messages:  # at most one for each session
        rows = m.rows.select("id") if m.rows is not None else spark.createDataFrame([(None,)], "id long")
        out = out.unionByName(rows.select(F.explode(F.array(*map(F.lit, m.sessions))).alias("session_id"), "id", F.lit(m.revision).cast("long").alias("revision")))
    return out


_add(
    "live_without_origin",
    f"WITH hit AS (SELECT * FROM {_NOTES_SQL} WHERE updatedAt >= 800000000 AND updatedAt < 801000000), n AS (SELECT count(*) AS n FROM hit) "
    "SELECT CAST(s.i AS BIGINT) AS session_id, hit.id, CAST(1 AS BIGINT) AS revision FROM hit JOIN range(20) s(i) ON hit.owner = s.i // 2 CROSS JOIN n WHERE s.i <> 3 AND n.n <= 5000 "
    "UNION ALL SELECT CAST(s.i AS BIGINT), NULL, 1 FROM range(20) s(i) CROSS JOIN n WHERE s.i <> 3 AND n.n > 5000",
    _delivered,
)


def _standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which standing queries an update of the notes of owner 3 makes run again."""
    e = _open_notes(spark, sf_dir)
    r = Registry(e)
    for i in range(6):
        r.register(f"owner {i}", "query Q { note { id owner } }", session={"userId": i})
        r.register(f"late {i}", "query Q { note { @where { updatedAt > 4000000000 } id } }", session={"userId": i})
    change = e.mutate("update Q { note { @where { owner == 3 } owner = 4 } }").changes[0]
    return spark.createDataFrame([(n,) for n in r.affected(change)], "name string")


_add("standing_rerun", f"SELECT 'owner ' || o.i AS name FROM range(6) o(i) WHERE o.i IN (3, 4) AND EXISTS (SELECT 1 FROM {_NOTES_SQL} n WHERE n.owner = 3)", _standing)


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ids by whether a result shows them."""
    e = _open_notes(spark, sf_dir)
    table = e.catalog.tables["note"]
    ids = changed_ids(table, e.mutate("update Q { note { @where { owner == 3 || owner == 5 } owner = 4 } }").changes[0])
    result = e.query("query Q { note { @where { updatedAt > 850000000 } id } }", session={"userId": 3})["note"]
    return ids_in_result(ids, result).withColumn("shown", F.lit(True)).unionByName(ids_not_in_result(ids, result).withColumn("shown", F.lit(False)))


_add("changed_ids", f"SELECT id, owner = 3 AND updatedAt > 850000000 AS shown FROM {_NOTES_SQL} WHERE owner IN (3, 5)", _ids)


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a client shows them with two updates on top, after one of three was rolled back and the server's row came."""
    o = Optimistic(engine(spark, sf_dir))
    for request, key, name in (("a", 3, "three"), ("b", 4, "four"), ("c", 3, "again")):
        o.begin(request, "nation", ("n_nationkey", "id"), {"n_name": "name"}, {"id": key, "name": name})
    o.reject("b")
    o.receive(1, {"nation": spark.createDataFrame([(3, "server", 1), (4, "server", 1)], "n_nationkey long, n_name string, n_regionkey long")})
    return o.view("nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


_add("optimistic_view", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE n_nationkey WHEN 3 THEN 'again' WHEN 4 THEN 'server' ELSE n_name END AS n_name FROM nation", _shown)


# --- JSON columns ---
_TALLY = """
record Tally {
    @tablename("tallies")
    @public
    id Int @id
    data Json
}
"""


def _tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.array(F.col("o_orderkey")).alias("orders")))
    rows = o.select(F.col("o_orderkey").alias("id"), text.alias("data"))
    e = Engine(spark, _TALLY, {"tallies": rows})
    table = e.catalog.tables["tally"]
    found = normalized(e.catalog, table, e.source(table))
    return found.select("id", F.variant_get("data", "$.customer", "long").alias("customer"), F.variant_get("data", "$.orders[0]", "long").alias("first"))


_add("json_normalized", 'SELECT o_orderkey AS id, CAST(o_custkey AS BIGINT) AS customer, o_orderkey AS "first" FROM orders', _tallies)
