"""The client's form of a query, entity filters, and responses at the edge."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.client.cache import Cache, condition, entity_condition
from weft.client.form import bind, decode
from weft.engine import Engine
from weft.errors import WeftError
from weft.response import affected_groups, assembled, normalized, respond, root_json

SHELF = """
type Cover = Paper | Cloth { colour String  notes Json<List<Int>>? }
record Shelf {
    @public
    id Int @id
    room String?
    books @link(Book.shelfId)
}
record Book {
    @public
    id Int @id
    title String?
    price Float?
    used Bool
    shelfId Int?
    cover Cover?
    tags Json
    shelf @link(shelfId, Shelf.id)
}
"""


@pytest.fixture()
def engine(spark):
    shelves = spark.createDataFrame([(1, "hall"), (2, None), (3, "attic")], "id long, room string")
    books = spark.createDataFrame(
        [
            (10, "Moss", 4.0, True, 1, "Cloth", "red", "[1]", "{}"), (11, "Fern", None, False, 1, "Paper", None, None, "[1, 2]"), (12, None, 9.5, False, 1, None, None, None, None),
            (13, "Reed", 2.5, True, 2, "Paper", None, None, '"[3]"'), (14, "Sedge", 7.0, False, None, "Paper", None, None, "null"),
        ],
        "id long, title string, price double, used boolean, shelfId long, cover string, cover__colour string, cover__notes string, tags string",
    )
    return Engine(spark, SHELF, {"shelves": shelves, "books": books})


def ids(engine, where):
    return [r["id"] for r in Cache(engine).query({"book": {"@where": where, "@sort": {"field": "id", "direction": "asc"}, "id": True}})["book"].collect()]


@pytest.mark.parametrize(
    ("where", "wanted"),
    [
        ({"title": "Moss"}, [10]), ({"title": None}, [12]), ({"title": {"$ne": "Moss"}}, [11, 12, 13, 14]), ({"title": {"$eq": None}}, []), ({"title": {"$ne": None}}, []),
        ({"price": {"$gt": 4.0}}, [12, 14]), ({"price": {"$gte": 4.0}}, [10, 11, 12, 14]), ({"price": {"$lte": 4.0}}, [10, 11, 13]), ({"price": {"$lt": "x"}}, []), ({"price": {"$gte": 4}}, [10, 11, 12, 13, 14]),
        ({"id": {"$in": [10, 14, "11"]}}, [10, 14]), ({"id": {"$in": []}}, []), ({"title": {"$in": [None, "Reed"]}}, [12, 13]), ({"id": {"$nin": [10]}}, []), ({"title": {"$like": "M%"}}, []),
        ({"used": True, "price": {"$lt": 4.0}}, [13]), ({"used": {"$gt": False}}, []), ({"$or": [{"id": 10}, {"$and": [{"id": 12}, {"title": None}]}], "id": 14}, [10, 12]), ({"$and": [], "id": 10}, [10, 11, 12, 13, 14]),
        ({"$or": []}, []), ({"absent": None}, [10, 11, 12, 13, 14]), ({"absent": 1}, []), ({"id": {"$gte": 11, "$lt": 13}}, [11, 12]), ({}, [10, 11, 12, 13, 14]),
    ],
)
def test_where(engine, where, wanted):
    assert ids(engine, where) == wanted


def test_all_fields_and_aliases(engine):
    assert Cache(engine).query({"shelf": {}})["shelf"].columns == ["id", "room"]
    found = Cache(engine).query({"b": {"@source": "book", "@where": {"id": 10}, "name": {"@source": "title", "@select": True}, "no": False}})["b"]
    assert [r.asDict() for r in found.collect()] == [{"name": "Moss"}]


def test_nested_sort_and_limit(engine):
    form = {"shelf": {"@sort": [{"field": "id", "direction": "Desc"}], "id": True, "books": {"@sort": [{"field": "price", "direction": "desc"}], "@limit": 2, "id": True, "shelf": {"room": True}}}}
    found = [(r["id"], [b["id"] for b in r["books"]]) for r in Cache(engine).query(form)["shelf"].collect()]
    assert found == [(3, []), (2, [13]), (1, [12, 10])]
    assert Cache(engine).query({"shelf": {"@limit": 0, "id": True}})["shelf"].count() == 0


def test_templates():
    template = {"book": {"@where": {"id": {"$var": "id"}, "owner": {"$session": "user"}, "x": [{"$var": "none"}]}}}
    assert bind(template, {"id": 3}, {"user": 4}) == {"book": {"@where": {"id": 3, "owner": 4, "x": [None]}}}
    assert bind({"$var": "id", "more": 1}, {"id": 3}, None) == {"$var": "id", "more": 1}


@pytest.mark.parametrize("form", [{"a": {"@where": {"x": {"$near": 1}}}}, {"a": {"@where": {"$or": {}}}}, {"a": {"@sort": {"field": "x"}}}, {"a": {"@limit": "3"}}, {"a": 1}])
def test_bad_forms(form):
    with pytest.raises(WeftError, match="InvalidForm"):
        decode(form)


def test_unknown_names(engine):
    for form, kind in (({"pen": {}}, "UnknownTable"), ({"book": {"pages": True}}, "UnknownField"), ({"book": {"pages": {}}}, "UnknownLink")):
        with pytest.raises(WeftError, match=kind):
            Cache(engine).query(form)


def test_entity_filter(engine):
    books = engine.tables["books"]
    kinds = {f.name: f.dataType for f in books.schema.fields}
    for where, wanted in (
        ({"title": None}, [12]), ({"price": {"$eq": 4}}, [10]), ({"price": {"$in": [4, None]}}, [10, 11]), ({"title": {"$nin": ["Moss", None]}}, [11, 13, 14]), ({"title": {"$ne": "Moss"}, "used": False}, [11, 12, 14]),
        ({"id": "10"}, []), ({"id": {"$nin": []}}, [10, 11, 12, 13, 14]), ({"id": {"$gt": 1}}, []), (None, [10, 11, 12, 13, 14]),
    ):
        assert sorted(r["id"] for r in books.where(entity_condition(where, kinds)).collect()) == wanted, where


def test_condition_has_no_python(spark):
    df = spark.range(3).where(condition({"id": {"$gt": 0}}, {"id": T.LongType()}))
    assert df.count() == 2


def test_one_value(engine):
    roots = engine.query("query Q { shelf { @sort(id, Asc) id room books { title } } book { @where { id > 99 } id } }")
    found = json.loads(respond(roots))
    assert found["book"] == [] and found["shelf"][1] == {"id": 2, "room": None, "books": [{"title": "Reed"}]}
    assert root_json(roots["book"]) == "[]"
    with pytest.raises(WeftError, match="ResponseTooLarge"):
        root_json(roots["shelf"], 2)


def test_assembly():
    assert assembled({"a": {"id": 1}, "_hidden": 3}, {"a": {"id": 2}, "b": []}, {"b": [4]}) == {"a": [{"id": 1}, {"id": 2}], "b": [4]}


def test_affected_groups(engine):
    done = engine.mutate("update Q { book { @where { id < 12 } price = 1.0 } }")
    groups = affected_groups(done)
    assert [(g["table"], len(g["rows"])) for g in groups] == [("books", 2)] and groups[0]["headers"][0] == "id"
    assert affected_groups(engine.mutate("delete Q { book { @where { id == 99 } id } }")) == []


def test_json_is_checked(engine, spark):
    table = engine.catalog.tables["book"]
    found = normalized(engine.catalog, table, engine.tables["books"]).select("id", F.to_json("tags").alias("tags"), F.to_json("cover__notes").alias("notes"))
    assert {r["id"]: (r["tags"], r["notes"]) for r in found.collect()} == {10: ("{}", "[1]"), 11: ("[1,2]", None), 12: (None, None), 13: ("[3]", None), 14: ("null", None)}
    for bad in ("{", "", '"[3"', "[1,]"):
        broken = engine.tables["books"].where("id = 10").withColumn("tags", F.lit(bad))
        with pytest.raises(Exception, match="MalformedJson: tags"):
            normalized(engine.catalog, table, broken).collect()
