"""Queries, permissions, unions, mutations, catch-up and live changes in a small garden."""

import pytest

from weft.engine import Engine, json_rows
from weft.errors import WeftError
from weft.lang.parser import parse_queries
from weft.operators.shape import union_json
from weft.plans.mutate import generated_crud
from weft.schema import Catalog, plural
from weft.sources.evolve import difference, migrate, to_schema
from weft.sources.seed import row_counts, seed
from weft.sync.protocol import Seen, catch_up, check_cursor, live_changes, page, page_size, permission_hash, status
from weft.sync.subscriptions import apply_diff, changed_fields, diff, must_rerun

GARDEN = """
session {
    keeper Int
    duty String?
    species Json<List<String>>
}
type Growth
   = Seed
   | Sprout { height Float? }
   | Tree { height Float?  rings Int }
record Bed {
    @public
    id Int @id
    label String?
    fenced Bool?
    plants @link(Plant.bedId)
    tools @link(Tool.bedId)
}
record Plant {
    @allow(query) { keeper == Session.keeper || Session.duty == "head" }
    @allow(insert, update, delete) { keeper == Session.keeper }
    id Int @id
    species String
    growth Growth
    keeper Int
    bedId Int?
    updatedAt Int?
    bed @link(bedId, Bed.id)
}
record Tool {
    @public
    id Int @id
    bedId Int
    uses Json<Dict<Int>>
    bed @link(bedId, Bed.id)
}
"""


@pytest.fixture()
def garden(spark):
    beds = spark.createDataFrame([(10, "herbs", True), (20, None, None), (30, "fruit", False)], "id long, label string, fenced boolean")
    plants = spark.createDataFrame(
        [
            (1, "mint", "Sprout", 0.2, None, 7, 10, None), (2, "sage", "Seed", None, None, 7, 10, 50), (3, "plum", "Tree", None, 12, 8, 30, 50),
            (4, "pear", "Tree", 3.5, 40, 8, None, 50), (5, "moss", "Fungus", 1.0, 1, 9, 20, 70), (6, "dill", "Sprout", None, None, 8, 10, 60),
        ],
        "id long, species string, growth string, growth__height double, growth__rings long, keeper long, bedId long, updatedAt long",
    )
    tools = spark.createDataFrame([(1, 30, '{"dig": 2}'), (2, 30, None), (3, 10, '{"cut": 1, "dig": 5}')], "id long, bedId long, uses string")
    return Engine(spark, GARDEN, {"beds": beds, "plants": plants, "tools": tools}, now=900)


def rows(df):
    return [r.asDict(True) for r in df.collect()]


HEAD = {"keeper": 0, "duty": "head"}


def test_two_links_side_by_side_do_not_multiply(garden):
    out = rows(garden.query("query Q { bed { @sort(id, Asc) id plants { species } tools { id } } }", session=HEAD)["bed"])
    assert [(b["id"], [p["species"] for p in b["plants"]], [t["id"] for t in b["tools"]]) for b in out] == [(10, ["mint", "sage", "dill"], [3]), (20, ["moss"], []), (30, ["plum"], [1, 2])]


def test_a_child_with_a_map_column(garden):
    out = rows(garden.query("query Q { bed { @sort(id, Desc) id tools { id uses } } }")["bed"])
    assert [b["tools"] for b in out] == [[{"id": 1, "uses": {"dig": 2}}, {"id": 2, "uses": None}], [], [{"id": 3, "uses": {"cut": 1, "dig": 5}}]]


def test_a_missing_parent_is_null(garden):
    out = rows(garden.query("query Q { plant { @sort(id, Desc) id bed { label } } }", session=HEAD)["plant"])
    assert [p["bed"] for p in out] == [{"label": "herbs"}, {"label": None}, None, {"label": "fruit"}, {"label": "herbs"}, {"label": "herbs"}]


def test_nested_rows_are_filtered_by_their_own_permission(garden):
    out = rows(garden.query("query Q { bed { @sort(id, Asc) id plants { id } } }", session={"keeper": 8})["bed"])
    assert [[p["id"] for p in b["plants"]] for b in out] == [[6], [], [3]]


def test_comparisons_with_null(garden):
    ids = lambda where: sorted(b["id"] for b in rows(garden.query(f"query Q {{ bed {{ @where {{ {where} }} id }} }}")["bed"]))
    assert ids('label != "herbs"') == [20, 30] and ids("label == null") == [20] and ids("label != null") == [10, 30]


def test_unions(garden):
    shown = garden.query("query Q { plant { id growth } }", session=HEAD)["plant"]
    texts = [r[0] for r in shown.orderBy("id").select(union_json(garden.catalog, "Growth", shown["growth"])).collect()]
    assert texts == ['{"_type":"Sprout","height":0.2}', '{"_type":"Seed"}', '{"_type":"Tree","height":null,"rings":12}', '{"_type":"Tree","height":3.5,"rings":40}', None, '{"_type":"Sprout","height":null}']
    tall = garden.query("query Q { plant { @where { growth.Tree.height != 3.5 } id } }", session=HEAD)["plant"]
    assert [p["id"] for p in rows(tall)] == [3]
    assert {b["id"]: b["fenced"] for b in rows(garden.query("query Q { bed { id fenced } }")["bed"])} == {10: True, 20: False, 30: False}


def fault(f, *args, **more):
    with pytest.raises(WeftError) as e:
        f(*args, **more)
    return e.value.kind


def test_parameters(garden):
    text = "query Q($few: Int) { bed { @sort(id, Desc) @limit($few) id } }"
    assert rows(garden.query(text, {"few": 2})["bed"]) == [{"id": 30}, {"id": 20}]
    for params, kind in (({}, "MissingParameter"), ({"few": None}, "NullParameter"), ({"few": 1, "many": 2}, "UnknownParameter"), ({"few": -1}, "InvalidLimit"), ({"few": "2"}, "InvalidParameter"), ({"few": True}, "InvalidParameter"), ({"few": 1.5}, "InvalidParameter")):
        assert fault(garden.query, text, params) == kind


def test_types_are_checked_before_a_plan_is_made(garden):
    for where in ('id == "ten"', "label > 3", 'fenced == "yes"', "label like 3", "id in [1, \"x\"]", 'id in ["x"]', 'abs(label) == 1', "lower(id) == \"a\"", "Or(id == 1, label == 2)", "ifnull(label, 1) == label"):
        assert fault(garden.query, f"query Q {{ bed {{ @where {{ {where} }} id }} }}") == "TypeMismatch", where
    assert fault(garden.query, 'query Q { plant { @where { growth.Tree.rings == "many" } id } }', session=HEAD) == "TypeMismatch"
    assert fault(garden.mutate, "update Q { bed { @where { id == 10 } label = 5 } }") == "TypeMismatch"
    for where in ("id == 10.5", "label == null", "id in []", 'length(label) > 2', 'Session.duty == "head"'):
        garden.query(f"query Q {{ bed {{ @where {{ {where} }} id }} }}", session=HEAD)
    assert fault(garden.query, "query Q($l: Json<List<Int>>) { bed { @where { id in $l } id } }", {"l": [1, "x"]}) == "InvalidParameter"


def test_plans_hold_no_cartesian_product_and_no_python(garden):
    plan = garden.query("query Q { bed { id plants { species bed { label } } tools { id } } }", session=HEAD)["bed"]._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "Python", "Arrow"))


def test_inserts(garden):
    text = "insert Q($s: String) { bed { label = \"roots\" plants { species = $s keeper = 7 growth = Tree { rings = 1 } } } }"
    m = garden.mutate(text, {"s": "yam"}, {"keeper": 7})
    assert [b["id"] for b in rows(m.tables["beds"]) if b["label"] == "roots"] == [31]
    assert [(p["id"], p["bedId"], p["growth"], p["growth__rings"], p["updatedAt"]) for p in rows(m.tables["plants"]) if p["species"] == "yam"] == [(7, 31, "Tree", 1, 900)]
    denied = garden.mutate(text, {"s": "yam"}, {"keeper": 8})
    assert denied.tables["plants"].count() == 6 and denied.tables["beds"].count() == 4
    assert fault(garden.mutate, 'insert Q { plant { species = "yam" } }', session={"keeper": 7}) == "MissingRequiredField"


def test_updates(garden):
    m = garden.mutate("update Q { plant { @where { id == 4 } growth = Seed } }", session={"keeper": 8})
    assert [(p["growth"], p["growth__height"], p["growth__rings"], p["updatedAt"]) for p in rows(m.tables["plants"]) if p["id"] == 4] == [("Seed", None, None, 900)]
    change = m.changes[0]
    assert (change.table, change.op) == ("plants", "update") and [r["growth"] for r in rows(change.before)] == ["Tree"] and [r["growth"] for r in rows(change.after)] == ["Seed"]
    text = "update Q($l: String?) { bed { @where { id == 10 } label = $l } }"
    label = lambda params: [b["label"] for b in rows(garden.mutate(text, params).tables["beds"]) if b["id"] == 10]
    assert label({}) == ["herbs"] and label({"l": None}) == [None] and label({"l": "x"}) == ["x"]
    m = garden.mutate('update Q { plant { @where { updatedAt >= 60 } species = "z" } }', session={"keeper": 8})  # a null condition keeps its row
    assert sorted(p["id"] for p in rows(m.tables["plants"]) if p["species"] == "z") == [6] and m.tables["plants"].count() == 6


def test_deletes(garden):
    m = garden.mutate("delete Q { plant { @where { bedId != 30 } id } }", session={"keeper": 8})
    assert sorted(p["id"] for p in rows(m.tables["plants"])) == [1, 2, 3, 5] and sorted(p["id"] for p in rows(m.response["plant"])) == [4, 6]
    assert m.changes[0].after is None and m.changes[0].before.count() == 2


def test_a_mutation_touches_no_other_row_and_joins_nothing(garden):
    plan = garden.mutate("delete Q { bed { @where { label == \"fruit\" } id } }").tables["beds"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_apply_and_generated_crud(garden):
    create, change, remove = generated_crud(garden.catalog, garden.catalog.tables["bed"]).strip().split("\n")
    garden.apply(garden.mutate(create, {"label": "vines", "fenced": True}))
    garden.apply(garden.mutate(change, {"id": 31, "label": "hops"}))
    garden.apply(garden.mutate(remove, {"id": 10}))
    assert sorted((b["id"], b["label"], b["fenced"]) for b in rows(garden.tables["beds"])) == [(20, None, None), (30, "fruit", False), (31, "hops", True)]


def test_json_rows(garden):
    assert json_rows(garden.query("query Q { bed { @where { id == 20 } id label } }")["bed"]).first()[0] == '{"id":20,"label":null}'


def test_paging_loses_no_row_of_one_second_and_none_without_a_time(garden):
    table, seen, got = garden.catalog.tables["plant"], Seen(), []
    for _ in range(10):
        found, more, seen = page(garden, table, seen, HEAD, 1)
        got += [r["id"] for r in rows(found)]
        if not more:
            break
    assert got == [1, 2, 3, 4, 6, 5]
    assert page(garden, table, Seen(70, 5, "another"), HEAD, 10)[0].count() == 6  # a changed permission starts over


def test_status_and_catch_up(garden):
    session = {"keeper": 7, "duty": None}
    now = permission_hash(garden, garden.catalog.tables["plant"], session)
    state = lambda seen: [(r["table"], r["newest"], r["needs_sync"]) for r in rows(status(garden, {"plants": seen}, session))]
    assert state(Seen(50, 2, now)) == [("plants", 50, False)] and state(Seen(10, 1, now)) == [("plants", 50, True)] and state(Seen()) == [("plants", 50, True)]
    assert state(Seen(None, 1, now)) == [("plants", 50, True)] and state(Seen(50, 2, "another")) == [("plants", 50, True)]
    pages, cursor, more = catch_up(garden, {}, session)
    assert sorted(r["id"] for r in rows(pages["plants"])) == [1, 2] and not more and cursor["plants"].updated_at == 50
    assert catch_up(garden, cursor, session)[0] == {}  # nothing is behind
    assert page_size(None) == 1000 and page_size(9999) == 5000
    assert fault(page_size, 0) and fault(check_cursor, garden, {"nowhere": Seen()})


def test_live_changes_group_sessions_that_see_the_same(garden, spark):
    sessions = spark.createDataFrame([(1, 7, None), (2, 7, None), (3, 8, None), (4, 1, "head"), (5, 1, None)], "session_id long, keeper long, duty string")
    table = garden.catalog.tables["plant"]
    out = sorted((r["sessions"], r["keys"]) for r in rows(live_changes(garden, table, garden.source(table), sessions)))
    assert out == [([1, 2], [1, 2]), ([3], [3, 4, 6]), ([4], [1, 2, 3, 4, 5, 6])]


def test_a_query_catch_up_and_live_changes_agree(spark, garden):
    """The same rows are visible in all three, by lists and by variants of the session as well."""
    for rule, session in (("species in Session.species", {"species": ["plum", "dill"]}), ("species not in Session.species", {"species": ["plum"]}), ("keeper == Session.rank.Keeper.number", {"rank": ("Keeper", 8)}), ("keeper == Session.rank.Keeper.number", {"rank": ("Guest", 8)})):
        schema = GARDEN.replace('keeper == Session.keeper || Session.duty == "head"', rule).replace("    duty String?", "    duty String?\n    rank Rank").replace("type Growth", "type Rank = Guest | Keeper { number Int }\ntype Growth")
        e = Engine(spark, schema, garden.tables, 900)
        table = e.catalog.tables["plant"]
        values = {k: {"_type": v[0], "number": v[1]} if k == "rank" else v for k, v in session.items()}
        asked = sorted(r["id"] for r in rows(e.query("query Q { plant { id } }", session=values)["plant"]))
        paged = sorted(r["id"] for r in rows(page(e, table, Seen(), values)[0]))
        columns = ", ".join("species array<string>" if k == "species" else "rank struct<_type: string, number: long>" for k in session)
        live = rows(live_changes(e, table, e.source(table), spark.createDataFrame([(1, *session.values())], f"session_id long, {columns}")))
        assert asked == paged == sorted(k for r in live for k in r["keys"]), rule


def test_standing_queries(garden):
    c, q = garden.catalog, parse_queries('query Q { bed { @where { label == "a" } id plants { species } } }')[0]
    assert must_rerun(c, q, "beds", "update", {"label"}) and not must_rerun(c, q, "beds", "update", {"fenced"})
    assert must_rerun(c, q, "plants", "insert", None) and must_rerun(c, q, "plants", "update", {"bedId"}) and not must_rerun(c, q, "tools", "insert", None)
    assert must_rerun(c, q, "plants", "update", {"keeper"})  # the permission reads it
    behind = Catalog('@syncable(false)\n' + GARDEN.replace("record Bed {\n    @public", "record Bed {\n    @allow(query) { exists tools { id > 1 } }\n    @allow(insert, update, delete) { False }"))
    q = parse_queries("query Q { bed { id } }")[0]
    assert must_rerun(behind, q, "tools", "insert", None) and must_rerun(behind, q, "tools", "update", {"bedId"}) and not must_rerun(behind, q, "tools", "update", {"uses"})
    assert changed_fields({"a": 1, "b": 2}, {"a": 1, "b": 3}) == {"b"}
    old = [{"id": i, "v": 0} for i in (5, 6, 7, 8)]
    new = [{"id": 8, "v": 0}, {"id": 6, "v": 1}, {"id": 1, "v": 0}, {"id": 5, "v": 0}]
    assert apply_diff(old, diff(old, new)) == new and diff(new, new) == []


def test_generated_rows_and_evolution(spark, garden):
    c = garden.catalog
    assert row_counts(c, 20) == {"beds": 20, "plants": 100, "tools": 100} and row_counts(c, 20, most=50)["tools"] == 50
    one, two = seed(spark, c, 7, 20), seed(spark, c, 7, 20)
    assert rows(one["plants"].orderBy("id")) == rows(two["plants"].orderBy("id"))
    assert list(Catalog(to_schema({"beds": garden.tables["beds"]}, {"beds": "id"})).tables["beds"].columns) == ["id", "label", "fenced"]
    newer = Catalog(GARDEN.replace("    fenced Bool?\n", "    fenced Bool?\n    soil String?\n"))
    assert difference(c, newer) == [("add", "beds", "soil")] and migrate(garden.tables, c, newer, spark)["beds"].columns == ["id", "label", "fenced", "soil"]
    assert fault(difference, newer, c) == "ColumnDropped"


def test_plurals():
    words = {"person": "people", "Child": "Children", "news": "news", "box": "boxes", "city": "cities", "day": "days", "leaf": "leafs", "wolf": "wolves", "knife": "knives", "hero": "heroes", "radio": "radios", "church": "churches", "users": "users"}
    assert {w: plural(w) for w in words} == words
