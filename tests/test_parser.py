import random

import pytest

from corvane.errors import MissingParameter, SqlSyntaxError
from corvane.plans import ast as a
from corvane.plans import params
from corvane.plans.parser import parse, tokenize


def test_insert():
    assert parse("INSERT INTO users (id, name, active) VALUES (1, 'Alice', TRUE)") == a.Insert("users", ("id", "name", "active"), ((1, "Alice", True),))


def test_select():
    got = parse("SELECT id, name FROM users WHERE status = 'active' AND age >= 18 ORDER BY name DESC LIMIT 10 OFFSET 5")
    c = a.ColumnRef
    where = a.And(a.Compare(c("status"), "=", "active"), a.Compare(c("age"), ">=", 18))
    assert got == a.Select((c("id"), c("name")), "users", None, where, (), None, (a.OrderItem(c("name"), True),), 10, 5)


@pytest.mark.parametrize(
    "text,message",
    [
        ("ALTER TABLE users ADD COLUMN age INTEGER", "Unsupported: ALTER"),
        ("SELECT * FROM users WHERE age BETWEEN 18 AND 65", "Unknown operator: BETWEEN"),
        ("SELECT id users", "Expected FROM"),
        ("SELECT * FROM t x WHERE a = 1", "Unexpected x"),
        ("SELECT * FROM a, b WHERE a = 1", "Unexpected ,"),
        ("SELECT * FROM a JOIN b ON a.x > b.y", "Expected ="),
        ("SELECT * FROM a JOIN b ON a.x = b.y JOIN c ON c.x = a.x", "Unexpected JOIN"),
        ("SELECT DISTINCT a FROM t", "Unsupported: DISTINCT"),
        ("SELECT a + 1 FROM t", "Expected FROM"),
        ("CREATE INDEX i ON t (a)", "Unsupported: CREATE INDEX"),
        ("CREATE TABLE t (a BLOB)", "Unknown type: BLOB"),
        ("WITH x AS (SELECT 1) SELECT * FROM x", "Unsupported: WITH"),
        ("SELECT * FROM t WHERE a = 'open", "Unterminated"),
        ("SELECT * FROM t LIMIT x", "LIMIT needs"),
        ("", "Empty"),
    ],
)
def test_errors(text, message):
    with pytest.raises(SqlSyntaxError, match=message.replace("+", "\\+").replace("*", "\\*")):
        parse(text)


def test_right_nested_sets_and_offsets():
    got = parse("SELECT a FROM x UNION SELECT a FROM y EXCEPT ALL SELECT a FROM z ORDER BY a OFFSET 3;")
    assert got.op == "union" and not got.all and got.right.op == "except" and got.right.all
    assert got.right.right.offset == 3 and got.right.right.order


def test_precedence():
    w = parse("SELECT * FROM t WHERE NOT a = 1 OR b = 2 AND (c IS NULL OR d IN (1, NULL, 'x'))").where
    assert isinstance(w, a.Or) and isinstance(w.left, a.Not) and isinstance(w.right, a.And) and isinstance(w.right.right, a.Or)
    assert w.right.right.right == a.InList(a.ColumnRef("d"), (1, a.Null(), "x"))


def test_length_is_ignored_and_quotes():
    t = parse("CREATE TABLE IF NOT EXISTS t (a VARCHAR(10) PRIMARY KEY, b NUMERIC(10,2) NOT NULL DEFAULT 3)")
    assert [c.type for c in t.columns] == ["TEXT", "FLOAT"] and t.if_not_exists and t.columns[1].not_null
    assert tokenize("'O''Brien'")[0].text == "O'Brien"


def test_parameters():
    s = parse("SELECT * FROM t WHERE a = $1 AND b IN ($2, 3)")
    bound = params.bind(s, ["007", "7"])
    assert bound.where.left.value == "007" and bound.where.right.values == (7, 3)
    assert params.unbound(s) == 1 and params.unbound(bound) is None
    with pytest.raises(MissingParameter, match="no value specified for parameter \\$2"):
        params.bind(s, ["x"])
    assert params.bind(parse("INSERT INTO t VALUES ($1)"), ["7"]).rows == (("7",),)
    assert params.bind(s, ["'; DROP TABLE t", None]).where.left.value == "'; DROP TABLE t"


def test_fuzz_never_crashes():
    r = random.Random(1)
    words = "SELECT FROM WHERE t a b ( ) , * = < > <> 'x' 1 NULL AND OR NOT IN LIKE GROUP BY ORDER LIMIT UNION JOIN ON COUNT EXPLAIN VALUES INSERT INTO $1 ;".split()
    for _ in range(5000):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 14)))
        try:
            parse(text)
        except SqlSyntaxError:
            pass
    with pytest.raises(SqlSyntaxError, match="too deeply"):
        parse("SELECT a FROM t WHERE " + "(" * 100_000)
