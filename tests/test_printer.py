"""Printing and parsing again gives the same tree, and printing is stable."""

import pytest

from weft.catalogue import schema_text
from weft.lang.parser import parse_predicate, parse_queries, parse_schema
from weft.lang.printer import proposed_links, query_hashes, show_condition, show_query, show_schema, watched

from .test_engine import GARDEN as GRAPH
from .test_language import SCHEMA

QUERIES = [
    'query A($n: Int, $s: String?) { user { @where { id == $n && name != "x\\"y" } @sort(id, Desc) @limit($n) id who: name posts { * } } }',
    'insert B { user { name = "a" status = Special { reason = null } posts { title = "t" } } }',
    "update C($x: String?) { user { @where { Or(id == 1, status.Special.reason == $x) } name = lower($x) } }",
    "delete D { user { @where { id in [1, 2] } id } }",
]


@pytest.mark.parametrize("text", [SCHEMA, GRAPH, schema_text(), "@syncable(false)\nrecord A {\n @public\n @index(id asc, x desc) where { x = null }\n id Int @id\n x Int? @default(3)\n}"])
def test_schemas(text):
    tree = parse_schema(text)
    shown = show_schema(tree)
    assert parse_schema(shown) == tree and show_schema(parse_schema(shown)) == shown


@pytest.mark.parametrize("text", QUERIES)
def test_queries(text):
    tree = parse_queries(text)[0]
    shown = show_query(tree)
    assert parse_queries(shown)[0] == tree and show_query(parse_queries(shown)[0]) == shown


@pytest.mark.parametrize("text", ["a == 1 || b == 2 && c != null", "exists a.b { x == Session.y, z >= -2.5 }", "not_a like \"%x\"", "True"])
def test_conditions(text):
    tree = parse_predicate(text)
    assert parse_predicate(show_condition(tree)) == tree


def test_hashes():
    one, two = (parse_queries(t)[0] for t in ("query A { user { id name } }", "query B { user { @where { id == 1 } id name } }"))
    assert query_hashes(one)[0] == query_hashes(two)[0] and query_hashes(one)[1] != query_hashes(two)[1]
    assert query_hashes(one) == query_hashes(parse_queries("query Z {\n user {\n id\n name\n } }")[0])


def test_links_back_and_watches():
    s = parse_schema("record A {\n @public\n @watch\n id Int @id\n}\nrecord B {\n @public\n @watch(update, delete)\n id Int @id\n aId Int\n a @link(aId, A.id)\n}")
    assert proposed_links(s) == [("A", "bs @link(id, B.aId)")]
    assert watched(s) == [("A", "insert"), ("B", "update"), ("B", "delete")]
    assert proposed_links(parse_schema(SCHEMA)) == []
