"""Parsers and checks: what is accepted and what is refused, and with which kind of error."""

import pytest

from weft.errors import WeftError
from weft.lang.ast import And, Compare, Const, Exists, Or, Param, Path, SessionPath
from weft.lang.parser import parse_predicate, parse_queries, parse_schema
from weft.plans.check import check
from weft.schema import Catalog, plural

SCHEMA = """
session {
    userId Int
}
type Status
   = Active
   | Special { reason String }
record User {
    @public
    id Int @id
    name String?
    status Status
    posts @link(Post.authorId)
}
record Post {
    @public
    id Int @id
    title String
    authorId Int
    author @link(authorId, User.id)
}
"""


def test_chain_is_left_to_right_without_precedence():
    p = parse_predicate("a == 1 || b == 2 && c == 3")
    assert isinstance(p, And) and isinstance(p.parts[0], Or)


def test_lines_and_commas_conjoin_and_a_leading_or_groups():
    assert isinstance(parse_predicate("a == 1\n b == 2"), And)
    assert isinstance(parse_predicate("a == 1, b == 2"), And)
    assert isinstance(parse_predicate("\n || a == 1 || b == 2"), Or)


def test_values():
    assert parse_predicate("a = -3") == Compare("==", Path(("a",)), Const(-3))
    assert parse_predicate("a == 0.5").right == Const(0.5)
    assert parse_predicate('a == "x\\"y"').right == Const('x"y')
    assert parse_predicate("Session.userId == $p") == Compare("==", SessionPath(("userId",)), Param("p"))
    assert isinstance(parse_predicate("exists a.b { c == 1 }"), Exists)


@pytest.mark.parametrize("text", ["", "a", "a ==", "And(a == 1)", "a == 1 &&", "a === 1", "exists { a == 1 }"])
def test_broken_conditions(text):
    with pytest.raises(WeftError):
        parse_predicate(text)


def test_comments_and_types():
    s = parse_schema("// a\nrecord A {\n  @public\n  id Id.Int @id // b\n  x Json<List<String>>?\n}")
    assert s.records["A"].fields[1].type.args[0].name == "List" and s.records["A"].fields[1].type.nullable


@pytest.mark.parametrize(
    "text,kind",
    [
        ("record A {\n id Int @id\n}", "MissingPermissions"),
        ("record A {\n @allow(query) { True }\n id Int @id\n}", "MissingPermissionOperations"),
        ("record A {\n @public\n id Int\n}", "NoPrimaryKey"),
        ("record A {\n @public\n id Int @id\n x Foo\n}", "UnknownType"),
        ("record A {\n @public\n id Int @id\n b @link(B.x)\n}", "LinkToUnknownTable"),
        ("record A {\n @public\n id Int @id\n b @link(id, A.x)\n}", "LinkToUnknownField"),
        ("type T = A { v Int } | B { v String }", "VariantFieldTypeCollision"),
        ("type T = A | A", "DuplicateVariant"),
        ("record A {\n @public\n id Int @id\n id Int\n}", "DuplicateField"),
        ("record A {\n @allow(*) { exists a { id == 1 } }\n id Int @id\n a @link(A.id)\n}", "ExistsInSyncedNamespace"),
        ("@syncable(false)\nrecord A {\n @allow(insert) { exists a { id == 1 } }\n id Int @id\n a @link(A.id)\n}", "ExistsInInsertPermission"),
    ],
)
def test_schema_errors(text, kind):
    with pytest.raises(WeftError) as e:
        Catalog(text)
    assert e.value.kind == kind


@pytest.mark.parametrize(
    "text,kind",
    [
        ("query Q { nobody { id } }", "UnknownTable"),
        ("query Q { user { nothing } }", "UnknownField"),
        ("query Q { user { id id } }", "DuplicateQueryField"),
        ("query Q { user { } }", "NoFieldsSelected"),
        ("query Q { user { id posts { } } }", "LinkSelectionIsEmpty"),
        ("query Q { user { id posts } }", "LinkSelectionIsEmpty"),
        ("query Q { user { @where { id == 1 } @where { id == 2 } id } }", "MultipleWheres"),
        ("query Q { user { @limit(1) @limit(2) id } }", "MultipleLimits"),
        ("query Q { user { @limit(1) id posts { id } } }", "LimitOnNestedSelection"),
        ("query Q { user { @where { posts == 1 } id } }", "WhereOnLinkIsntAllowed"),
        ("query Q { user { @where { soundex(name) == 1 } id } }", "UnknownFunction"),
        ("query Q { user { @where { abs(id, id) == 1 } id } }", "WrongNumberOfArguments"),
        ("query Q { user { @where { id == $x } id } }", "UndefinedParameter"),
        ("query Q($x: Int) { user { id } }", "UnusedParameter"),
        ("query Q { user { @where { status.Special.nothing == 1 } id } }", "InvalidUnionPath"),
        ("query Q { user { @sort(nothing, Asc) id } }", "UnknownField"),
        ("update Q { user { @where { id == 1 } posts { id } } }", "LinksInUpdateOrDelete"),
        ("query Q { user { id = 1 } }", "AssignmentInQuery"),
    ],
)
def test_query_errors(text, kind):
    with pytest.raises(WeftError) as e:
        check(Catalog(SCHEMA), parse_queries(text)[0])
    assert e.value.kind == kind


def test_catalogue():
    c = Catalog(SCHEMA)
    assert list(c.tables["user"].columns) == ["id", "name", "status", "status__reason"] and c.tables["user"].name == "users"
    assert c.singular(c.tables["post"], c.tables["post"].links["author"]) and not c.singular(c.tables["user"], c.tables["user"].links["posts"])
    assert c.sync_layers == [["posts", "users"]]  # linked both ways
    assert [plural(w) for w in ("story", "box", "day", "user")] == ["stories", "boxes", "days", "users"]
