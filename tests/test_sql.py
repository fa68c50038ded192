import itertools
from decimal import Decimal

import pytest

from corvane import DuplicateTable, Session, SqlSyntaxError, UndefinedTable
from corvane.errors import AmbiguousColumn, GroupingError, InvalidValue, NotNullViolation, UndefinedColumn, UniqueViolation

_n = itertools.count()


def make(s, name, columns, rows):
    """An external table, quicker than a managed one; its first column is the key."""
    from pyspark.sql import types as T

    from corvane.functions.types import SPARK

    schema = T.StructType([T.StructField(c, SPARK[k]) for c, k in (x.split() for x in columns.split(","))])
    s.register(name, s.spark.createDataFrame(rows, schema))


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path / "store"))


def rows(s, text, values=()):
    return s.sql(text, values).rendered()


def test_windows(s):
    make(s, "scores", "id INTEGER,name TEXT,score INTEGER", [(1, "Alice", 90), (2, "Bob", 85), (3, "Charlie", 90), (4, "Diana", 80)])
    r = s.sql("SELECT name, ROW_NUMBER() OVER (ORDER BY score DESC) FROM scores ORDER BY score DESC, id")
    assert r.columns == ["name", "row_number"] and [x[1] for x in r.rendered()] == ["1", "2", "3", "4"]
    make(s, "p", "id INTEGER,price INTEGER", [(1, 10), (2, 30), (3, 20)])
    assert rows(s, "SELECT id, ROW_NUMBER() OVER (ORDER BY price DESC), RANK() OVER (ORDER BY price DESC), DENSE_RANK() OVER (ORDER BY price DESC) FROM p ORDER BY price DESC") == [["2", "1", "1", "1"], ["3", "2", "2", "2"], ["1", "3", "3", "3"]]
    assert rows(s, "SELECT price, ROW_NUMBER() OVER (ORDER BY price DESC) FROM p ORDER BY id LIMIT 1") == [["10", "3"]]
    make(s, "t", "id INTEGER,v INTEGER", [(1, None), (2, 5)])
    assert rows(s, "SELECT v, RANK() OVER (ORDER BY v DESC), DENSE_RANK() OVER (ORDER BY v DESC) FROM t ORDER BY v DESC") == [["NULL", "1", "1"], ["5", "2", "2"]]


def test_window_over_join(s):
    make(s, "a", "id INTEGER", [(1,), (2,), (3,)])
    make(s, "b", "id INTEGER,a_id INTEGER,v INTEGER", [(1, 1, 5), (2, 2, 15), (3, 3, 25), (4, 1, 15)])
    text = "SELECT b.id, {}() OVER (ORDER BY b.v) FROM a JOIN b ON a.id = b.a_id ORDER BY b.id"
    assert [x[1] for x in rows(s, text.format("RANK"))] == ["1", "2", "4", "2"]
    assert [x[1] for x in rows(s, text.format("DENSE_RANK"))] == ["1", "2", "3", "2"]


def test_literals_follow_the_column(s):
    make(s, "nums", "id INTEGER,v INTEGER,f FLOAT", [(1, 1, 1.5), (2, 10, 2.0)])
    ids = lambda w: [x[0] for x in rows(s, f"SELECT id FROM nums WHERE {w} ORDER BY id")]
    assert ids("v = 1.0") == ["1"] and ids("v > 2") == ["2"] and ids("v = '10'") == ["2"] and ids("v > 1.5") == ["2"] and ids("v < 1.5") == ["1"]
    assert ids("v = 'x'") == [] and ids("v <> 'x'") == ["1", "2"] and ids("v = 1.5") == [] and ids("v < 99999999999999999999") == ["1", "2"]
    assert ids("f = '1.5'") == ["1"] and ids("f >= 2") == ["2"]
    with pytest.raises(InvalidValue):
        ids("v > 'x'")
    make(s, "words", "id INTEGER,w TEXT", [(1, "NaN"), (2, "apple"), (3, "1e3"), (4, "1000"), (5, "true")])
    got = lambda w: [x[0] for x in rows(s, f"SELECT id FROM words WHERE {w} ORDER BY id")]
    assert got("w = 'NaN'") == ["1"] and got("w = 1000") == ["4"] and got("w = '1e3'") == ["3"] and got("w = TRUE") == ["5"]
    make(s, "big", "id INTEGER,name TEXT", [(9007199254740992, "a"), (9007199254740993, "b")])
    assert rows(s, "SELECT name FROM big WHERE id = 9007199254740992") == [["a"]]


def test_null_logic(s):
    make(s, "n", "id INTEGER,name TEXT", [(1, "alice"), (2, None)])
    make(s, "w", "id INTEGER,w TEXT", [(1, "a"), (2, None)])
    make(s, "t", "id INTEGER,v TEXT", [(1, "a"), (2, "b"), (3, None)])
    ids = lambda table, w: [x[0] for x in rows(s, f"SELECT id FROM {table} WHERE {w} ORDER BY id")]
    assert ids("n", "name = NULL") == ids("n", "name <> NULL") == ids("n", "NOT (name = NULL)") == [] and ids("n", "name IS NULL") == ["2"] and ids("n", "name IS NOT NULL") == ["1"]
    assert ids("n", "name = NULL OR id = 1") == ["1"]
    assert ids("t", "v IN ('a', NULL)") == ["1"] and ids("t", "NOT (v IN ('z', NULL))") == [] and ids("t", "NOT (v IN ('z'))") == ["1", "2"]
    assert ids("t", "v IN (SELECT w FROM w)") == ["1"] and ids("t", "NOT (v IN (SELECT w FROM w))") == []
    assert ids("t", "NOT (v IN (SELECT w FROM w WHERE id = 1))") == ["2"]
    assert ids("t", "v IN (SELECT w FROM w) OR id = 3") == ["1", "3"] and ids("t", "NOT (v IN (SELECT w FROM w) OR id = 9)") == []
    assert ids("t", "NOT (NOT (v IN (SELECT w FROM w WHERE id > 5)) AND id < 3)") == ["3"]


def test_like(s):
    make(s, "names", "id INTEGER,name TEXT", [(1, "Alice"), (2, "Bob"), (3, "Alex"), (4, "a.b"), (5, "axb"), (6, "a\nb"), (7, "50%"), (8, "x\\y"), (9, "Alan\n")])
    ids = lambda p: [x[0] for x in rows(s, "SELECT id FROM names WHERE name LIKE $1 ORDER BY id", [p])]
    assert ids("Al%") == ["1", "3"] and ids("a.b") == ["4"] and ids("a_b") == ["4", "5"] and ids("x\\y") == ["8"] and ids("alice") == [] and ids("%b") == ["2", "4", "5"]


def test_aggregates(s):
    make(s, "agg", "id INTEGER,n INTEGER", [(1, 10), (2, 5), (3, None)])
    r = s.sql("SELECT COUNT(*), COUNT(n), SUM(n), AVG(n), MIN(n), MAX(n) FROM agg")
    assert r.columns == ["count(*)", "count(n)", "sum(n)", "avg(n)", "min(n)", "max(n)"] and r.rendered() == [["3", "2", "15", "7.5", "5", "10"]]
    assert rows(s, "SELECT SUM(n), AVG(n), MIN(n), MAX(n), COUNT(n) FROM agg WHERE id = 3") == [["NULL"] * 4 + ["0"]]
    assert rows(s, "SELECT COUNT(*), SUM(n) FROM agg WHERE id > 99") == [["0", "NULL"]]
    make(s, "avg3", "id INTEGER,v INTEGER", [(1, 1), (2, 0), (3, 0)])
    make(s, "avg7", "id INTEGER,v INTEGER", [(k, 2 if k == 1 else 0) for k in range(1, 8)])
    make(s, "avg32", "id INTEGER,v INTEGER", [(k, -1 if k == 1 else 0) for k in range(1, 33)])
    assert rows(s, "SELECT AVG(v) FROM avg3") == [["0.333333333333333"]] and rows(s, "SELECT AVG(v) FROM avg7") == [["0.285714285714286"]] and rows(s, "SELECT AVG(v) FROM avg32") == [["-0.03125"]]
    make(s, "wide", "id INTEGER,v WIDE", [(1, Decimal(9223372036854775808)), (2, Decimal(9223372036854775809))])
    assert rows(s, "SELECT SUM(v) FROM wide") == [["18446744073709551617"]]
    make(s, "long", "id INTEGER,v INTEGER", [(1, 2**63 - 1), (2, 2**63 - 1)])
    assert rows(s, "SELECT SUM(v) FROM long") == [[str(2**64 - 2)]]
    make(s, "q", "id INTEGER,v TEXT", [(1, "2"), (2, "10"), (3, "1")])
    assert rows(s, "SELECT MIN(v), MAX(v) FROM q") == [["1", "2"]] and rows(s, "SELECT v FROM q GROUP BY v ORDER BY v") == [["1"], ["10"], ["2"]]
    with pytest.raises(InvalidValue):
        rows(s, "SELECT SUM(v) FROM q")


def test_grouping(s):
    make(s, "t", "id INTEGER,region TEXT,name TEXT", [(2, "b", "second"), (10, "b", "tenth"), (1, "a", "first")])
    assert rows(s, "SELECT region, name, COUNT(*) FROM t GROUP BY region ORDER BY region") == [["a", "first", "1"], ["b", "tenth", "2"]]
    assert rows(s, "SELECT region FROM t GROUP BY region HAVING COUNT(*) > 1") == [["b"]]
    assert rows(s, "SELECT COUNT(*) FROM t GROUP BY region HAVING region = 'b'") == [["2"]]
    assert rows(s, "SELECT name, COUNT(*) FROM t") == [["NULL", "3"]]
    assert rows(s, "SELECT region FROM t GROUP BY region HAVING region IN (SELECT region FROM t WHERE id = 1)") == [["a"]]
    assert rows(s, "SELECT region FROM t GROUP BY region ORDER BY COUNT(*) DESC LIMIT 1") == [["b"]]
    with pytest.raises(GroupingError, match="must appear in the GROUP BY clause"):
        rows(s, "SELECT region FROM t GROUP BY region HAVING name = 'x'")


def test_joins(s):
    make(s, "a", "id INTEGER,k TEXT", [(1, None), (2, "x")])
    make(s, "b", "id INTEGER,k TEXT", [(1, None), (2, "x")])
    text = "SELECT a.id, b.id FROM a {} b ON a.k = b.k"
    assert rows(s, text.format("JOIN")) == [["2", "2"]]
    assert sorted(rows(s, text.format("LEFT JOIN"))) == [["1", "NULL"], ["2", "2"]]
    assert sorted(rows(s, text.format("RIGHT OUTER JOIN"))) == [["2", "2"], ["NULL", "1"]]
    assert rows(s, "SELECT a.id FROM a JOIN b ON b.k = a.k") == [["2"]]
    assert rows(s, "SELECT a.id FROM a LEFT JOIN b ON a.k = b.k WHERE b.id IS NULL") == [["1"]]
    r = s.sql("SELECT * FROM a LEFT JOIN b ON a.k = b.k ORDER BY a.id")
    assert r.columns == ["id", "k", "id", "k"] and r.rendered()[0] == ["1", "NULL", "NULL", "NULL"]
    for bad in ("SELECT id FROM a JOIN b ON a.k = b.k", "SELECT * FROM a JOIN b ON a.k = b.k ORDER BY id"):
        with pytest.raises(AmbiguousColumn, match='column "id" is ambiguous'):
            s.sql(bad)
    with pytest.raises(UndefinedColumn, match="not in the FROM clause"):
        s.sql("SELECT c.id FROM a JOIN b ON a.k = b.k")


def test_names(s):
    make(s, "cc", "id INTEGER,Name TEXT", [(1, "a")])
    assert rows(s, "SELECT Name FROM CC WHERE Name = 'a'") == [["a"]]
    for bad in ("SELECT * FROM cc WHERE name = 'a'", "SELECT nope FROM cc LIMIT 0", "SELECT id FROM cc ORDER BY nope"):
        with pytest.raises(UndefinedColumn, match="does not exist"):
            s.sql(bad)
    with pytest.raises(UndefinedTable, match="Table 'zz' does not exist"):
        s.sql("SELECT * FROM zz")


def test_order_limit(s):
    make(s, "t", "id INTEGER,v INTEGER", [(1, 3), (2, None), (10, 1), (3, 3)])
    assert rows(s, "SELECT id FROM t ORDER BY v, id DESC") == [["10"], ["3"], ["1"], ["2"]]
    assert rows(s, "SELECT id FROM t ORDER BY v DESC, id") == [["2"], ["1"], ["3"], ["10"]]
    assert rows(s, "SELECT id FROM t LIMIT 2") == [["1"], ["10"]]
    assert rows(s, "SELECT id FROM t ORDER BY id LIMIT 2 OFFSET 2") == [["3"], ["10"]] and rows(s, "SELECT id FROM t ORDER BY id OFFSET 9") == []


def test_set_operators(s):
    for name, values in (("a", ["p", "p", "q", None]), ("b", ["p", None]), ("c", ["NULL"])):
        make(s, name, "id INTEGER,v TEXT", list(enumerate(values)))
    get = lambda op, x="a", y="b": sorted(r[0] for r in rows(s, f"SELECT v FROM {x} {op} SELECT v FROM {y}"))
    assert get("UNION") == ["NULL", "p", "q"] and len(get("UNION ALL")) == 6 and get("INTERSECT") == ["NULL", "p"] and get("EXCEPT") == ["q"]
    assert get("INTERSECT ALL") == ["NULL", "p", "p"] and get("EXCEPT ALL") == ["q"] and len(get("UNION", "b", "c")) == 3
    assert sorted(r[0] for r in rows(s, "SELECT v FROM b UNION SELECT v FROM a EXCEPT SELECT v FROM a")) == ["NULL", "p"]
    with pytest.raises(SqlSyntaxError):
        s.sql("SELECT id, v FROM a UNION SELECT v FROM b")


def test_dml(s):
    s.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, v VARCHAR(10), n INT)")
    assert s.sql("INSERT INTO T (V, id) VALUES ('O''Brien', '007'), ('b', 8)").count == 2
    assert rows(s, "SELECT * FROM t ORDER BY id") == [["7", "O'Brien", "NULL"], ["8", "b", "NULL"]]
    for bad, error in (("VALUES (7, 'x', 1)", UniqueViolation), ("VALUES (9, 'a', 1), (9, 'b', 1)", UniqueViolation), ("VALUES (NULL, 'a', 1)", NotNullViolation), ("VALUES (9, 'a', 'x1')", InvalidValue), ("VALUES (9)", SqlSyntaxError), ("(nope) VALUES (1)", UndefinedColumn)):
        with pytest.raises(error):
            s.sql(f"INSERT INTO t {bad}")
    assert s.sql("UPDATE t SET n = 5, v = NULL WHERE id = 8 OR v = 'zz'").count == 1
    assert s.sql("UPDATE t SET n = 1 WHERE n > 100").count == 0
    assert s.sql("DELETE FROM t WHERE n <> 5").count == 0
    assert s.sql("DELETE FROM t WHERE v LIKE 'O%'").count == 1
    assert rows(s, "SELECT * FROM t") == [["8", "NULL", "5"]]
    s.sql("INSERT INTO t VALUES (7, 'again', 2)")
    assert rows(s, "SELECT v FROM t WHERE id = 7") == [["again"]]
    s.compact()
    assert len(s.store.manifest().tables["t"]["segments"]) == 1 and len(rows(s, "SELECT * FROM t")) == 2
    assert s.sql("DELETE FROM t").count == 2 and rows(s, "SELECT COUNT(*) FROM t") == [["0"]]
    with pytest.raises(DuplicateTable) as e:
        s.sql("CREATE TABLE T (a INT)")
    assert e.value.sqlstate == "42P07"
    s.sql("CREATE TABLE IF NOT EXISTS t (a INT)")
    s.sql("CREATE TABLE te (a INT)")
    assert rows(s, "SHOW TABLES") == [["t"], ["te"]]
    s.sql("DROP TABLE te")
    s.sql("DROP TABLE IF EXISTS te")
    with pytest.raises(UndefinedTable):
        s.sql("DROP TABLE te")


def test_types_and_reopen(s, spark):
    s.sql("CREATE TABLE m (id TEXT, f FLOAT, b BOOL, at TIMESTAMP, j JSON)")
    s.sql("INSERT INTO m VALUES ('é', 1.50, TRUE, '2024-01-02 03:04:05', '{}'), ('z', '2', 'false', '2024-01-01', NULL)")
    again = Session(spark, s.store.root)
    assert rows(again, "SELECT id, f, b FROM m WHERE at > '2024-01-01 12:00:00' AND b = TRUE") == [["é", "1.5", "true"]]
    assert rows(again, "SELECT id FROM m WHERE b = 'x'") == [] and rows(again, "SELECT id FROM m WHERE at < '2024-01-02'") == [["z"]]


def test_explain_and_fetch(s):
    make(s, "t", "id INTEGER,v INTEGER", [(k, k % 3) for k in range(20)])
    assert any("Filter" in r[0] or "Scan" in r[0] for r in rows(s, "EXPLAIN SELECT v FROM t WHERE id = 3"))
    text = rows(s, "EXPLAIN ANALYZE SELECT v, COUNT(*) FROM t GROUP BY v HAVING COUNT(*) > 1")
    assert text[0][0].startswith("Total rows=3") and any("HashAggregate" in r[0] for r in text)
    assert "Insert" in rows(s, "EXPLAIN INSERT INTO t VALUES (1, 2)")[0][0]
    r = s.sql("SELECT id FROM t ORDER BY id")
    assert [len(r.fetch(8)) for _ in range(4)] == [8, 8, 4, 0]


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "id * 2 v").write.parquet(str(tmp_path / "p"))
    s = Session(spark)
    s.register_parquet("p", str(tmp_path / "p"))
    plan = "\n".join(r[0] for r in s.sql("EXPLAIN SELECT v FROM p WHERE id = 5.0 AND s LIKE '5%'").collect())
    assert "EqualTo(id,5)" in plan and "StringStartsWith(s,5)" in plan and "ReadSchema: struct<id:bigint,s:string,v:bigint>" in plan


def test_sorts_of_whole_tables(spark):
    from corvane import queries

    sf = "/root/testdata/sf0.01"
    got = [tuple(r) for r in queries.QUERIES["sort_nulls_whole"](spark, sf).collect()]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and {q for _, q in got} == {None, 0, 1}
    assert got == sorted(got, key=lambda r: (-(2 if r[1] is None else r[1]), r[0]))
    got = [tuple(r) for r in queries.QUERIES["sort_multi_whole"](spark, sf).collect()]
    assert len(got) == spark.read.parquet(f"{sf}/customer.parquet").count() and got == sorted(got, key=lambda r: (-r[0], r[1]))
