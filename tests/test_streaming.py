"""Keyed state from streams."""

from weft.streaming.state import KeyedState, entity_changes, merge, newest

KIND = "id long, v string, updatedAt long"


def test_merge_rules(spark):
    state = spark.createDataFrame([(1, "old", 10), (2, "old", 10), (3, "old", None), (4, "old", 10)], KIND)
    batch = spark.createDataFrame([(1, "older", 9), (2, "equal", 10), (3, "new", None), (4, "none", None), (5, "first", 1)], KIND)
    out = {r["id"]: r["v"] for r in merge(state, batch, "id").collect()}
    assert out == {1: "old", 2: "equal", 3: "new", 4: "old", 5: "first"}


def test_empty(spark):
    empty = spark.createDataFrame([], KIND)
    assert newest(empty, "id").count() == 0 and merge(empty, empty, "id").count() == 0


def test_stream_into_versions(spark, tmp_path):
    source = str(tmp_path / "in")
    state = KeyedState(spark, str(tmp_path / "state"), "id")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (2, "z", 0)]):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KIND).parquet(source)
        state.start(stream, str(tmp_path / "check")).awaitTermination()
    assert {r["id"]: r["v"] for r in state.read().collect()} == {1: "c", 2: "b"}
    state.foreach_batch(spark.createDataFrame([(1, "again", 9)], KIND), 1)  # a batch that runs again replaces its version
    assert {r["id"]: r["v"] for r in state.read().collect()} == {1: "again", 2: "b"}


def test_entity_changes(spark):
    rows = [("users", 1, 1, "a"), ("users", 1, 2, "b"), ("posts", 1, 3, "c"), ("logs", 1, 4, "d")]
    batch = spark.createDataFrame(rows, "table string, id long, sequence long, v string")
    assert sorted((r["table"], r["v"]) for r in entity_changes(batch, ["users", "posts"]).collect()) == [("posts", "c"), ("users", "b")]
