"""Epochs, revisions, origins, limits, cursors, standing queries, optimistic updates and paths."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.engine import Engine
from weft.errors import WeftError
from weft.sync.optimistic import Optimistic
from weft.sync.paths import apply_at, steps
from weft.sync.protocol import Seen
from weft.sync.session import Client, Pages, Reset, Server, json_bytes
from weft.sync.standing import Registry, changed_ids, fields_changed, ids_in_result, ids_not_in_result

HARBOUR = """
@syncable(false)
session {
    captain Int
}
record Ship {
    @allow(query) { owner == Session.captain }
    @allow(insert, update, delete) { True }
    id Int @id
    name String
    owner Int
    load Float?
    portId Int?
    updatedAt Int?
    port @link(portId, Port.id)
}
record Port {
    @public
    id Int @id
    town String
    ships @link(Ship.portId)
}
"""
SHIPS = "id long, name string, owner long, load double, portId long, updatedAt long"


@pytest.fixture()
def engine(spark):
    ships = spark.createDataFrame([(1, "Tern", 5, 1.0, 1, 10), (2, "Gull", 5, 2.0, 2, 20), (3, "Skua", 6, None, None, 20), (4, "Knot", 6, 4.0, 1, None)], SHIPS)
    return Engine(spark, HARBOUR, {"ships": ships, "ports": spark.createDataFrame([(1, "Aal"), (2, "Bra")], "id long, town string")}, now=100)


@pytest.fixture()
def sessions(spark):
    return spark.createDataFrame([("a", 5), ("b", 5), ("c", 6), ("d", 7)], "session_id string, captain long")


def test_epochs(engine):
    names = iter(["one", "two"])
    server = Server(engine, new_epoch=lambda: next(names))
    first = server.catch_up({}, {"captain": 5})
    assert isinstance(first, Pages) and first.epoch == "one" and sorted(r["id"] for r in first.tables["ships"].collect()) == [1, 2]
    assert isinstance(server.catch_up(first.cursor, {"captain": 5}, "one"), Pages)
    server.revision = 7
    assert server.rotate() == "two" and server.revision == 0
    assert server.catch_up(first.cursor, {"captain": 5}, "one") == Reset("two")
    assert Server.load(engine, server.save()).epoch == "two"


def test_delivery(engine, sessions):
    server = Server(engine, "e")
    done = engine.mutate("update Q { ship { @where { id < 4 } load = 9.0 } }")
    out = server.deliver(done, sessions, "a")
    assert (out.revision, server.revision) == (1, 1)
    assert [(m.sessions, sorted(r["id"] for r in m.rows.collect())) for m in out.messages] == [(["b"], [1, 2]), (["c"], [3])]
    assert [(m.sessions, m.rows.count(), m.revision) for m in out.origin] == [(["a"], 2, 1)]
    nothing = server.deliver(engine.mutate("update Q { ship { @where { id == 99 } load = 9.0 } }"), sessions)
    assert (nothing.messages, server.revision) == ([], 1)


def test_limits(engine, sessions, spark):
    wide = spark.createDataFrame([(1, "x" * 700_000, 5, None, None, 1), (2, "y" * 700_000, 5, None, None, 1), (3, "z", 6, None, None, 1)], SHIPS)
    large = Engine(spark, HARBOUR, {**engine.tables, "ships": wide})
    out = Server(large, "e").deliver(large.mutate("update Q { ship { @where { id > 0 } load = 1.0 } }"), sessions)
    assert [(m.sessions, m.sync_required) for m in out.messages] == [(["a", "b"], True), (["c"], False)]
    many = Engine(spark, HARBOUR, {**engine.tables, "ships": spark.range(5001).selectExpr("id", "'n' AS name", "5L AS owner", "0D AS load", "1L AS portId", "1L AS updatedAt")})
    out = Server(many, "e").deliver(many.mutate("update Q { ship { @where { id >= 0 } load = 1.0 } }"), sessions)
    assert [(m.sessions, m.sync_required) for m in out.messages] == [(["a", "b", "c", "d"], True)]
    assert json_bytes(spark.range(0)) == 0


def test_client(engine, spark):
    client = Client()
    assert [client.accept("e", 3), client.accept("e", 3), client.accept("e", 2), client.accept("e", 4), client.accept("f", 9)] == ["apply", "stale", "stale", "apply", "reset"]
    client.reset("f")
    assert (client.epoch, client.revision, client.accept("f", 1)) == ("f", None, "apply")
    client.cursor = {"ships": Seen(5, 1, "h")}
    assert client.recompute(engine)["ships"] == Seen(20, 3, "h")
    gone = Engine(spark, HARBOUR, {"ships": engine.tables["ships"].limit(0), "ports": engine.tables["ports"]})
    assert client.recompute(gone)["ships"] == Seen()


def test_registry(engine):
    r = Registry(engine)
    assert r.register("mine", "query Q($n: Float) { ship { @where { load > $n } id load } }", {"n": 1.5}, {"captain": 5}) == 1
    r.register("names", "query Q { ship { id name } }", session={"captain": 5})
    r.register("ports", "query Q { port { id ships { id } } }", session={"captain": 5})
    r.register("towns", "query Q { port { id town } }")

    def hit(text):
        return sorted(n for c in engine.mutate(text).changes for n in r.affected(c))

    assert hit("update Q { ship { @where { id == 2 } load = 9.0 } }") == ["mine"]
    assert hit("update Q { ship { @where { id == 1 } load = 1.2 } }") == []  # meets neither before nor after
    assert hit("update Q { ship { @where { id == 1 } load = 1.7 } }") == ["mine"]  # comes in
    assert hit("update Q { ship { @where { id == 2 } load = 0.1 } }") == ["mine"]  # goes out
    assert hit("update Q { ship { @where { id == 3 } load = 9.0 } }") == []  # another's
    assert hit("update Q { ship { @where { id == 3 } owner = 5 } }") == ["names", "ports"]  # permissions read it
    assert hit("update Q { ship { @where { id == 1 } portId = 2 } }") == ["ports"]
    assert hit('insert Q { ship { name = "Rail" owner = 6 load = 3.0 } }') == ["ports"]
    assert hit('insert Q { ship { name = "Rail" owner = 5 load = 3.0 } }') == ["mine", "names", "ports"]
    assert hit("delete Q { ship { @where { id == 2 } id } }") == ["mine", "names", "ports"]
    assert hit("delete Q { ship { @where { id == 99 } id } }") == []
    assert r.update("mine", {"n": 1.5}) == 1 and r.update("mine", {"n": 3.0}) == 2
    assert r.current("mine", 2) and not r.current("mine", 1)
    assert hit("update Q { ship { @where { id == 2 } load = 2.5 } }") == []
    assert r.unregister("mine") and not r.unregister("mine")


def test_ids(engine):
    table = engine.catalog.tables["ship"]
    change = engine.mutate("update Q { ship { @where { id < 3 } load = 1.0 } }").changes[0]
    assert fields_changed(table, change) == {"load", "updatedAt"}
    ids = changed_ids(table, change)
    result = engine.query("query Q { ship { @where { id > 1 } id } }", session={"captain": 5})["ship"]
    assert [r["id"] for r in ids_in_result(ids, result).collect()] == [2]
    assert [r["id"] for r in ids_not_in_result(ids, result).collect()] == [1]


def loads(o):
    return {r["id"]: r["load"] for r in o.view("ships").collect()}


def test_optimistic(engine, spark):
    o = Optimistic(engine)
    assert o.begin("r1", "ship", ("id", "id"), {"load": "load"}, {"id": 1, "load": 50.0})
    assert o.begin("r2", "ship", ("id", "id"), {"load": "load", "name": "none"}, {"id": 1, "load": 60.0})
    assert not o.begin("r3", "ship", ("id", "id"), {"load": "load"}, {"id": 99, "load": 1.0})
    assert not o.begin("r3", "ship", ("id", "id"), {"load": "load"}, {"id": 1})
    assert loads(o)[1] == 60.0
    assert o.reject("r2") and loads(o)[1] == 50.0
    assert o.begin("r4", "ship", ("id", "id"), {"load": "load"}, {"id": 1, "load": 70.0})
    o.acknowledge("r4", 2)  # behind r1, which is still open
    o.receive(2, {"ships": spark.createDataFrame([(1, "Tern", 5, 71.0, 1, 200)], SHIPS)})
    assert loads(o)[1] == 70.0 and list(o.pending) == ["r1", "r4"]
    o.acknowledge("r1", 1)
    assert not o.pending and loads(o)[1] == 71.0
    assert not o.receive(2, {"ships": spark.createDataFrame([(1, "Tern", 5, 0.0, 1, 300)], SHIPS)}) and loads(o)[1] == 71.0
    o.receive(3, {"port": spark.createDataFrame([(1, "Cor"), (3, "Dun")], "id long, town string")})
    assert {r["id"]: r["town"] for r in o.view("port").collect()} == {1: "Cor", 2: "Bra", 3: "Dun"}


def test_paths():
    value = {"beds": [{"id": 7, "plants": [{"id": "x)y", "n": 1}, {"id": 2, "n": 2}]}, {"id": 8, "plants": []}]}
    ops = [
        {"op": "set-row", "path": r".beds#(7).plants#(x\)y)", "row": {"id": "x)y", "n": 5}}, {"op": "insert-row", "path": ".beds[1].plants", "index": 0, "row": {"id": 3}},
        {"op": "move-row", "path": ".beds", "from": 0, "to": 1}, {"op": "remove-row-by-index", "path": ".beds#(7).plants", "index": 1}, {"op": "set-row", "path": ".beds[9]", "row": {}},
        {"op": "insert-row", "path": ".beds", "index": 3, "row": {}}, {"op": "noop", "path": ".beds"}, {"op": "set-row", "path": "beds", "row": {}}, {"op": "set-row", "path": ".beds[0]", "row": 3}, {"op": "set-row", "path": ".none", "row": {}},
    ]
    out, errors = apply_at(value, ops)
    assert out == {"beds": [{"id": 8, "plants": [{"id": 3}]}, {"id": 7, "plants": [{"id": "x)y", "n": 5}]}]}
    assert errors == [(4, "OutOfBounds"), (5, "OutOfBounds"), (6, "UnknownOperation"), (7, "InvalidPath"), (8, "NotARow"), (9, "NoSuchField")]
    assert value["beds"][0]["plants"][0]["n"] == 1
    assert apply_at(value, [{"op": "remove-row", "path": ".beds#(8)"}])[0]["beds"][1] is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.just("place"), st.integers(0, 50)), st.tuples(st.just("id"), st.text(max_size=8))), max_size=4))
def test_path_round_trip(selectors):
    def quoted(x):
        return "".join("\\" + c if c in "\\)" else c for c in x)

    text = ".a" + "".join(f"[{v}]" if k == "place" else f"#({quoted(v)})" for k, v in selectors)
    found = steps(text)
    assert found[0] == ("field", "a") and [(k, str(v)) for k, v in found[1:]] == [(k, str(int(v)) if k == "id" and v.lstrip("-").isascii() and v.lstrip("-").isdigit() and v.count("-") <= 1 else str(v)) for k, v in selectors]


@pytest.mark.parametrize("path", ["", "a", "[0]", ".", ".a[", ".a[x]", ".a#(1", ".a..b", ".a[0]x"])
def test_bad_paths(path):
    if path == ".":
        assert steps(path) == []
    else:
        with pytest.raises(WeftError, match="InvalidPath"):
            steps(path)
