"""Chains of links with a row for each row at their end, and the order of arrays."""

import pytest
from pyspark.sql import functions as F

from weft import catalogue
from weft.engine import Engine
from weft.errors import WeftError

SF = "/root/testdata/sf0.001"
HARBOUR = """
session {
    clerk Int
}
record Quay {
    @public
    id Int @id
    label String?
    ships @link(Ship.quayId)
    cranes @link(Crane.quayId)
}
record Ship {
    @public
    id Int @id
    label String?
    quayId Int?
    quay @link(quayId, Quay.id)
    crates @link(Crate.shipId)
}
record Crate {
    @allow(query) { clerk == Session.clerk }
    @allow(insert, update, delete) { False }
    @keyless
    shipId Int?
    clerk Int
    mass Float?
    note String?
    ship @link(shipId, Ship.id)
}
record Crane {
    @public
    id Int @id
    quayId Int
}
"""
CLERK = {"clerk": 1}


@pytest.fixture()
def harbour(spark):
    quays = spark.createDataFrame([(1, "north"), (2, None), (3, "south"), (3, "twin")], "id long, label string")
    ships = spark.createDataFrame([(11, "a", 1), (12, None, 1), (13, "c", None), (14, "d", 3), (15, "e", 9)], "id long, label string, quayId long")
    crates = spark.createDataFrame(
        [(11, 1, 2.0, "x"), (11, 1, 2.0, "x"), (11, 1, None, "y"), (11, 1, None, None), (11, 1, float("nan"), "z"), (11, 2, 1.0, "hidden"), (14, 1, -1.0, "w"), (13, 1, 3.0, "v"), (None, 1, 4.0, "u"), (77, 1, 5.0, "t")],
        "shipId long, clerk long, mass double, note string",
    )
    cranes = spark.createDataFrame([(1, 1)], "id long, quayId long")
    return Engine(spark, HARBOUR, {"quays": quays, "ships": ships, "crates": crates, "cranes": cranes})


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def listed(df) -> list[str]:
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("where", ["", "@where { label != null }", "@where { exists cranes { id == 1 } }"])
def test_a_chain_gives_the_rows_of_its_exploded_arrays(harbour, where):
    text = f"query Q {{ quay {{ {where} id label ships {{ label quay {{ label }} crates {{ mass note }} }} }} }}"
    nested = harbour.query(text, session=CLERK)["quay"].withColumn("ships", F.explode("ships"))
    nested = nested.withColumn("crate", F.explode("ships.crates")).withColumn("ships", F.col("ships").withField("crates", F.col("crate"))).drop("crate")
    found = harbour.unnested(text, session=CLERK)["quay"]
    assert [n for n, _ in found.dtypes] == [n for n, _ in nested.dtypes] and found.select("ships.crates.mass", "ships.quay.label").columns == ["mass", "label"]
    assert listed(found) == listed(nested) and found.count() == (5 if "exists" in where else 9)


def test_a_selection_without_links_or_fields_in_between(harbour):
    assert listed(harbour.unnested("query Q { crane { * } }")["crane"]) == listed(harbour.query("query Q { crane { * } }")["crane"])
    found = harbour.unnested("query Q { quay { ships { crates { note } } } }", session=CLERK)["quay"].select("ships.crates.note")
    assert sorted((r[0] or "" for r in found.collect())) == ["", *"wwxxyz"]


def test_links_to_one_row_stay_and_sorts_of_the_root_hold(harbour):
    found = harbour.unnested("query Q { ship { @sort(label, Desc) id quay { label } crates { note } } }", session=CLERK)["ship"].collect()
    assert [r["id"] for r in found] == [14, 14, 13, 11, 11, 11, 11, 11] and {r["quay"] and r["quay"]["label"] for r in found if r["id"] in (11, 13)} == {"north", None}
    assert found[0].asDict().keys() == {"id", "quay", "crates"}


def test_two_links_to_many_rows_side_by_side_are_refused(harbour):
    with pytest.raises(WeftError) as e:
        harbour.unnested("query Q { quay { id ships { id } cranes { id } } }")
    assert e.value.kind == "SeveralLinks"


def test_deep_nested_makes_no_arrays(spark):
    """A row of a region would hold a fifth of all line items."""
    text = plan(catalogue.queries()["deep_nested"](spark, SF))
    assert "collect_list" not in text and "Generate" not in text and "CartesianProduct" not in text


def test_arrays_of_rows_without_a_key_are_in_order_of_their_values(harbour):
    found = harbour.query("query Q { ship { @where { id == 11 } crates { mass note } } }", session=CLERK)["ship"]
    assert [(repr(c["mass"]), c["note"]) for c in found.first()["crates"]] == [("None", None), ("None", "y"), ("2.0", "x"), ("2.0", "x"), ("nan", "z")]
