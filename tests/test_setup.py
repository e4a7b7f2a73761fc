"""Session values, links, fixtures, migration and plans."""

import json

import pytest

from weft.engine import Engine
from weft.errors import WeftError
from weft.schema import Catalog
from weft.session import prepare
from weft.sources.evolve import Managed, ensure, extract_links, proposed_foreign_keys, to_schema, with_links
from weft.sources.fixtures import import_nested

MILL = """
session {
    id Int
    name String?
    active Bool
    rank Rank
    place Place?
}
type Rank = Guest | Miller
type Place = Nowhere | At { street String  floor Int? }
record Mill {
    @public
    id Int @id
    place Place
    wheels @link(Wheel.millId)
}
record Wheel {
    @public
    id Int @id
    millId Int
    teeth Int @default(12)
    notes Json?
    mill @link(millId, Mill.id)
}
"""


def test_session():
    catalog = Catalog(MILL)
    full = prepare(catalog, {"id": 1, "active": True, "rank": "Miller", "place": {"_type": "At", "street": "Low"}, "more": 3})
    assert full == {"id": 1, "name": None, "active": 1, "rank": "Miller", "place": "At", "place__street": "Low", "place__floor": None}
    bare = prepare(catalog, {"id": 1, "active": False, "rank": {"_type": "Guest"}})
    assert bare["place"] is None and bare["place__street"] is None and bare["active"] == 0
    assert prepare(Catalog("record A {\n @public\n id Int @id\n}"), {"a": True, "b": [1], "c": None}) == {"a": 1, "b": "[1]", "c": None}


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ([], "InvalidSession"), ({"id": 1, "rank": "Guest"}, "MissingSessionField"), ({"id": "x", "active": True, "rank": "Guest"}, "InvalidSession"), ({"id": 1, "active": True, "rank": "King"}, "InvalidSession"),
        ({"id": 1, "active": True, "rank": "Guest", "place": "At"}, "InvalidSession"), ({"id": 1, "active": True, "rank": "Guest", "place": {"_type": "At"}}, "MissingSessionField"), ({"id": True, "active": True, "rank": "Guest"}, "InvalidSession"),
    ],
)
def test_bad_session(value, kind):
    with pytest.raises(WeftError, match=kind):
        prepare(Catalog(MILL), value)


def test_links(spark):
    found = {(x.table, x.name, x.foreign_key, x.related, x.kind) for x in extract_links(Catalog(MILL))}
    assert found == {("mills", "wheels", "millId", "wheels", "one-to-many"), ("wheels", "mill", "millId", "mills", "many-to-one")}
    tables = {"mill": spark.createDataFrame([(1, "a")], "mill_no long, name string"), "wheel": spark.createDataFrame([(5, 1)], "wheel_no long, mill_no long")}
    keys = {"mill": "mill_no", "wheel": "wheel_no"}
    assert proposed_foreign_keys(tables, keys) == [("wheel", "mill_no", "mill")]
    engine = Engine(spark, with_links(to_schema(tables, keys), proposed_foreign_keys(tables, keys), keys), tables)
    assert engine.query("query Q { mill { name wheelsBy_mill_no { wheel_no } } }")["mill"].collect()[0]["wheelsBy_mill_no"][0]["wheel_no"] == 5
    assert engine.query("query Q { wheel { millBy_mill_no { name } } }")["wheel"].collect()[0]["millBy_mill_no"]["name"] == "a"


def test_fixtures(spark):
    engine = Engine(spark, MILL, {"mills": spark.createDataFrame([(4, "Nowhere", None, None)], "id long, place string, place__street string, place__floor long")})
    made = import_nested(engine, {"mill": [{"place": {"_type": "At", "street": "Low"}, "wheels": [{"teeth": 9, "notes": {"a": 1}}, {}]}], "wheel": [{"mill": {"id": 9, "place": "Nowhere"}}]})
    assert sorted((r["id"], r["place"], r["place__street"]) for r in made["mills"].collect()) == [(4, "Nowhere", None), (5, "At", "Low"), (9, "Nowhere", None)]
    assert sorted((r["id"], r["millId"], r["teeth"], r["notes"]) for r in made["wheels"].collect()) == [(1, 5, 9, '{"a": 1}'), (2, 5, 12, None), (3, 9, 12, None)]
    for bad in ({"x": []}, {"mill": [{"colour": 1}]}, {"mill": [{}]}, {"mill": [3]}, {"mill": [{"place": "Mars"}]}, {"mill": [{"id": 1, "place": "Nowhere", "wheels": [{"millId": 2}]}]}):
        with pytest.raises(WeftError, match="InvalidFixture"):
            import_nested(engine, bad)
    assert import_nested(engine, {}) == {}


def test_ensure(spark):
    first = "record Mill {\n    @public\n    id Int @id\n}\n"
    managed = Managed({})
    assert ensure(managed, "mills", first, spark) == "created" and managed.tables["mills"].columns == ["id"]
    assert ensure(managed, "mills", first, spark) == "up-to-date" and len(managed.log) == 1
    assert ensure(managed, "mills", first.replace("@id\n", "@id\n    name String?\n"), spark, 5) == "migrated" and managed.tables["mills"].columns == ["id", "name"]
    assert [json.loads(x)["outcome"] for x in managed.recorded().splitlines()] == ["created", "migrated"]
    before = dict(managed.tables)
    with pytest.raises(WeftError, match="ColumnDropped"):
        ensure(managed, "mills", first, spark)
    assert managed.tables == before and len(managed.log) == 2
    with pytest.raises(WeftError, match="UnmanagedTables"):
        ensure(Managed(before), "mills", first, spark)


def test_explain(spark):
    engine = Engine(spark, MILL, {"mills": spark.createDataFrame([], "id long, place string, place__street string, place__floor long"), "wheels": spark.createDataFrame([], "id long, millId long, teeth long, notes string")})
    assert "Physical Plan" in engine.explain("query Q { mill { id wheels { id } } }")["mill"]
    assert "Physical Plan" in engine.explain("delete Q { wheel { @where { id == 1 } id } }")["wheels"]
