import random
import threading

import pytest

from corvane import SerializationFailure, Session
from corvane.errors import CorvaneError, InvalidValue, MissingParameter, SqlSyntaxError, TransactionState, UniqueViolation
from corvane.indexes import IndexManager
from corvane.migrations import AddField, CreateIndex, Migration, Migrator, RemoveField, RenameField
from corvane.prepared import QueryEngine
from corvane.replay import load, read_jsonl, verify
from corvane.sources.kv import Batch
from corvane.streaming.ingest import key_value_stream, parquet_stream


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, str(tmp_path / "store"))


def test_model(s):
    """Random operations against a sorted map, with snapshots and compaction."""
    r, model, kv = random.Random(4), {}, s.kv("m")
    keys, pinned = [f"k{i:02d}" for i in range(8)], []
    for step in range(25):
        k, what = r.choice(keys), r.random()
        if what < 0.5:
            v = str(r.random())
            kv.put(k, v)
            model[k] = v
        elif what < 0.75:
            kv.delete(k)
            model.pop(k, None)
        elif what < 0.85:
            kv.compact()
        if step in (8, 16):
            pinned.append((kv.snapshot(), dict(model)))
    s.store.collect_garbage(older_than_s=0)
    assert kv.scan_all() == sorted(model.items())
    for snapshot, then in pinned:
        assert snapshot.scan_prefix("k") == sorted(then.items())
        snapshot.close()


def test_namespaces_scans_and_limits(s):
    a, b = s.kv("tenant_a"), s.kv("tenant_b")
    a.write_batch(Batch().put("x", "1").put("y", "2").put("z", "3").delete("y"))
    b.put("x", "other")
    assert a.get("x") == "1" and b.get("x") == "other" and a.get("y") is None and a.scan("x", "z") == [("x", "1")] and a.scan_all(1) == [("x", "1")]
    a.put_with_ttl("t", "gone", 100)
    assert a.get("t") == "gone"
    from corvane.sources.kv import newest

    assert newest(a.log(), now=2**40).where("key = 't'").count() == 0
    for bad in (lambda: s.kv("a/b"), lambda: Batch().put("k", None), lambda: a.page("a", "z", 10_001)):
        with pytest.raises(InvalidValue):
            bad()


def test_prepared(s):
    kv = s.kv()
    e = QueryEngine(kv, capacity=2)
    for k in range(10):
        kv.put(f"row_{k:03d}", str(k)) if k > 1 else e.execute(e.prepare("INSERT $1 $2"), [f"row_{k:03d}", str(k)])
    p = e.prepare("SELECT * WHERE key >= $1 AND key <= $2")
    assert [k for k, _ in e.execute(p, ["row_003", "row_007"])] == [f"row_{k:03d}" for k in range(3, 8)]
    assert e.query("SELECT COUNT WHERE key >= row_005 LIMIT 2") == 2 and e.query("SELECT * ORDER BY DESC LIMIT 1") == [("row_009", "9")]
    assert e.execute_named(e.prepare("SELECT * WHERE key = :k"), {"k": "row_004"}) == [("row_004", "4")]
    assert e.query("UPDATE SET value = 'x y' WHERE key = row_004") == 1 and kv.get("row_004") == "x y"
    assert e.query("DELETE WHERE key = nothing") == 1 and e.query("DELETE WHERE key >= row_008 AND key <= row_009") == 2 and len(kv.scan_all()) == 8
    with pytest.raises(MissingParameter):
        e.execute(p, ["a"])
    for bad in ("DELETE WHERE key >= a", "SELECT x", "DROP", "SELECT * WHERE key > a"):
        with pytest.raises(SqlSyntaxError):
            e.prepare(bad)
    e.prepare("SELECT COUNT")
    assert e.prepare("SELECT COUNT") is e.prepare("SELECT COUNT") and e.cache_stats()["size"] == 2 and e.cache_stats()["hits"] >= 2
    e.clear_cache()
    assert e.cache_stats()["size"] == 0


def test_transactions(spark, s):
    s.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    s.sql("INSERT INTO t VALUES (1, 10), (2, 20)")
    other = Session(spark, s.store.root)
    s.sql("BEGIN")
    s.sql("UPDATE t SET v = 11 WHERE id = 1")
    assert s.sql("SELECT v FROM t WHERE id = 1").rendered() == [["11"]] and other.sql("SELECT v FROM t WHERE id = 1").rendered() == [["10"]]
    s.sql("SAVEPOINT a")
    s.sql("DELETE FROM t")
    s.sql("ROLLBACK TO a")
    with pytest.raises(TransactionState):
        s.txn.rollback_to("a")
    s.sql("COMMIT")
    assert other.sql("SELECT v FROM t WHERE id = 1").rendered() == [["11"]]
    # Write skew: both read the table, the second to commit fails.
    s.sql("BEGIN")
    other.sql("START TRANSACTION")
    s.sql("SELECT * FROM t").collect()
    other.sql("SELECT * FROM t").collect()
    s.sql("UPDATE t SET v = 0 WHERE id = 1")
    other.sql("UPDATE t SET v = 0 WHERE id = 2")
    s.sql("COMMIT")
    with pytest.raises(SerializationFailure) as e:
        other.sql("COMMIT")
    assert e.value.sqlstate == "40001"
    # Inserts of different keys do not conflict, of one key they do.
    s.sql("BEGIN")
    other.sql("BEGIN")
    s.sql("INSERT INTO t VALUES (5, 5)")
    other.sql("INSERT INTO t VALUES (6, 6)")
    s.sql("COMMIT")
    other.sql("COMMIT")
    s.sql("BEGIN")
    other.sql("BEGIN")
    s.sql("INSERT INTO t VALUES (7, 7)")
    other.sql("INSERT INTO t VALUES (7, 8)")
    s.sql("COMMIT")
    with pytest.raises(SerializationFailure):
        other.sql("COMMIT")
    # DDL inside a block, and an error that poisons it.
    s.sql("BEGIN WORK")
    s.sql("CREATE TABLE u (id INT)")
    assert ["u"] in s.sql("SHOW TABLES").rendered() and ["u"] not in other.sql("SHOW TABLES").rendered()
    with pytest.raises(CorvaneError):
        s.sql("SELECT nope FROM u")
    with pytest.raises(TransactionState, match="aborted"):
        s.sql("SELECT * FROM u")
    s.sql("ROLLBACK")
    assert ["u"] not in s.sql("SHOW TABLES").rendered()
    with pytest.raises(TransactionState):
        s.sql("COMMIT")


def test_key_value_transactions(spark, s):
    kv = s.kv()
    kv.put("a", "1")
    one, two = s.begin(), Session(spark, s.store.root).begin()
    assert one.get("a") == "1" and two.scan("a", "c") == [("a", "1")]
    one.set("b", "2")
    assert one.scan("a", "z") == [("a", "1"), ("b", "2")]
    two.set("q", "9")
    s.commit()
    with pytest.raises(SerializationFailure):
        two.commit()
    assert kv.scan_all() == [("a", "1"), ("b", "2")]


def test_concurrent_commits(s):
    kv, errors = s.kv(), []

    def work(n):
        try:
            for k in range(3):
                kv.put(f"{n}_{k}", "x")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(kv.scan_all()) == 12


def test_half_written_commits_are_invisible(s):
    kv = s.kv()
    kv.put("a", "1")
    s.store.write(s.spark.createDataFrame([("", "b", "2", 0, 0, False)], "namespace string, key string, value string, seq long, expiry long, deleted boolean"), "kv")
    assert kv.scan_all() == [("a", "1")] and s.store.collect_garbage(older_than_s=0) >= 1 and kv.scan_all() == [("a", "1")]


def test_backup(s, spark, tmp_path):
    s.sql("CREATE TABLE t (id INT, v TEXT)")
    s.sql("INSERT INTO t VALUES (1, 'a')")
    s.kv().put("k", "v")
    s.create_backup(str(tmp_path / "b"))
    s.sql("DELETE FROM t")
    again = Session.restore(spark, str(tmp_path / "b"), str(tmp_path / "r"))
    assert again.sql("SELECT * FROM t").rendered() == [["1", "a"]] and again.kv().get("k") == "v"
    again.kv().put("k", "w")
    damaged = next(p for p in (tmp_path / "b" / "data").rglob("*.parquet"))
    damaged.write_bytes(damaged.read_bytes()[:-1] + b"x")
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    with pytest.raises(CorvaneError, match="damaged"):
        Session.restore(spark, str(tmp_path / "b"), str(tmp_path / "r2"))


def test_indexes(s):
    ix = IndexManager(s.kv())
    ix.create_index("mail", "users", ["email"], unique=True)
    ix.create_index("age", "users", ["age"])
    ix.put_document("users", "user1", {"email": "ab", "age": 30})
    ix.put_document("users", "user2", {"email": "abc", "age": 4})
    ix.put_document("users", "user3", {"age": "30"})
    assert ix.lookup("mail", ["ab"]) == ["user1"] and ix.range_scan("age", 1, 30) == ["user2", "user1"] and ix.lookup("age", ["30"]) == ["user3"]
    with pytest.raises(UniqueViolation):
        ix.put_document("users", "user4", {"email": "ab"})
    ix.put_document("users", "user1", {"email": "ab", "age": 31})
    assert ix.rebuild_index("mail") == 2 and ix.violations("mail").count() == 0
    ix.remove_document("users", "user2")
    assert ix.range_scan("age", 1, 40) == ["user1"]
    ix.drop_index("mail")
    assert ix.list() == ["age"]
    with pytest.raises(CorvaneError):
        ix.lookup("mail", ["ab"])


def test_migrations(s):
    kv = s.kv()
    kv.put("users:1", '{"name": "a", "n": 9007199254740993, "o": {"x": [1]}}')
    kv.put("users:2", '{"name": "b", "role": "admin"}')
    m = Migrator(kv, [Migration(1, "role", (AddField("users", "role", "user"),), (RemoveField("users", "role"),)), Migration(2, "rename", (RenameField("users", "name", "full"), CreateIndex("full", "users", ("full",))), (RenameField("users", "full", "name"),))])
    assert m.migrate_up() == 2 and m.migrate_up() == 2
    assert kv.get("users:1") == '{"full": "a", "n": 9007199254740993, "o": {"x": [1]}, "role": "user"}' and kv.get("users:2") == '{"full": "b", "role": "admin"}'
    assert m.migration_status() == [(1, "role", "Applied"), (2, "rename", "Applied")] and m.migrate_down() == 1
    assert kv.get("users:2") == '{"name": "b", "role": "admin"}' and m.migrate_to(0) == 0 and kv.get("users:2") == '{"name": "b"}'
    assert [e["state"] for e in m.migration_log()].count("InProgress") == 4


def test_replay(s, tmp_path):
    lines = ['{"id": "evt-1", "tenant": "acme"}', '{"id": "evt-2", "tenant": "acme"}', "", '{"id": "evt-3", "tenant": "globex"}']
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    rows = read_jsonl(s.spark, str(tmp_path / "in.jsonl"), "id", "event:")
    load(s.kv(), rows)
    s.compact()
    report = verify(s.kv(), rows)
    import zlib

    expected = sum(zlib.crc32(f"event:evt-{k}".encode() + b"\0" + x.encode()) for k, x in zip((1, 2, 3), [x for x in lines if x]))
    assert (report.rows, report.mismatches, report.checksum) == (3, 0, expected)
    s.kv().put("event:evt-1", "changed")
    assert verify(s.kv(), rows).mismatches == 1
    assert read_jsonl(s.spark, str(tmp_path / "in.jsonl")).count() == 3


def test_streaming(s, tmp_path):
    schema = s.spark.createDataFrame([], "id long, v string").schema
    for k in range(3):
        s.spark.createDataFrame([(k, f"v{k}")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        q = key_value_stream(parquet_stream(s.spark, str(tmp_path / "in"), schema), s.kv(), "id", "v", str(tmp_path / "state"))
        q.awaitTermination()
    assert s.kv().scan_all() == [("0", "v0"), ("1", "v1"), ("2", "v2")]


def test_embedded_facade(spark, tmp_path):
    from corvane import Embedded

    db = Embedded.open_dir(spark, str(tmp_path / "e"))
    a, b = db.scoped("tenant_a"), db.scoped("tenant_b")
    a.put("k", "1")
    b.put("k", "2")
    with a.snapshot() as then:
        a.put("k", "3")
        assert a.get_at("k", then) == "1" and a.get("k") == "3" and b.scan_prefix("k") == [("k", "2")] and db.scan_all() == []
    db.execute_sql("CREATE TABLE metrics (id INT PRIMARY KEY, name TEXT)")
    db.execute_sql("INSERT INTO metrics VALUES (1, 'cpu')")
    db.sync()
    db.close()
    again = Embedded.open_dir(spark, str(tmp_path / "e"))
    assert again.execute_sql("SELECT name FROM metrics WHERE id = 1").rendered() == [["cpu"]] and again.stats()["tables"] == 1
    with pytest.raises(RuntimeError):
        db.get("k")


def test_corrupt_data_fails_loudly(s):
    s.sql("CREATE TABLE t (id INT, v TEXT)")
    s.sql("INSERT INTO t VALUES (1, 'a')")
    segment = s.store.manifest().tables["t"]["segments"][0]["path"]
    s.store.files.delete(segment)
    with pytest.raises(Exception, match="(?i)path|exist"):
        s.sql("SELECT * FROM t LIMIT 0").collect()


def test_dead_writers_block_nobody(s):
    kv, files = s.kv(), s.store.files
    version = s.store.latest()
    files.put(s.store._name(version + 1) + ".lock", "left by a writer that died")
    files.put("_left", "half a manifest")
    assert kv.put("a", "1") == version + 1 and kv.get("a") == "1"
    # Where links do not exist: a lease that has run out is moved away, a fresh one holds.
    files.put("x.lock", "other")
    files.put("_held", "mine")
    assert not files._leased("_held", "x")
    files.fs.setTimes(files.path("x.lock"), 1, 1)
    assert not files._leased("_held", "x") and files._leased("_held", "x") and files.read("x") == "mine" and not files.exists("x.lock")
    assert not files.put_new("x", "again") and files.read("x") == "mine"


def test_concurrent_creation_has_one_winner(s):
    out = []
    threads = [threading.Thread(target=lambda k=k: out.append((k, s.store.files.put_new("one", str(k))))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [k for k, ok in out if ok]
    assert len(won) == 1 and s.store.files.read("one") == str(won[0])


def test_collection_spares_running_commits_and_snapshots(s):
    kv = s.kv()
    kv.put("a", "1")
    rows = s.spark.createDataFrame([("", "b", "2", 0, 0, False)], "namespace string, key string, value string, seq long, expiry long, deleted boolean")
    segment = s.store.write(rows, "kv")  # written, not committed yet
    assert s.store.collect_garbage() == 0 and s.store.files.exists(segment["path"])
    s.store.commit(s.store.latest(), lambda m: m.kv.append(segment | {"seq": m.version}), {})
    assert kv.scan_all() == [("a", "1"), ("b", "2")]
    snap = kv.snapshot()
    kv.delete("a")
    kv.compact()
    s.store.collect_garbage(older_than_s=0)
    assert snap.get("a") == "1" and kv.get("a") is None


def test_the_log_folds_itself(s, monkeypatch):
    from corvane.sources import kv as module

    monkeypatch.setattr(module, "FOLD_BATCHES", 3)
    monkeypatch.setattr(module, "FOLD_FOLDERS", 2)
    kv, model = s.kv(), {}
    snap = None
    for k in range(9):
        if k % 4 == 3:
            kv.delete("k1")
            model.pop("k1", None)
        else:
            kv.write_batch(Batch().put(f"k{k % 3}", str(k)).put("z", str(k)))
            model |= {f"k{k % 3}": str(k), "z": str(k)}
        if k == 4:
            snap, then = kv.snapshot(), dict(model)
        assert len(s.store.manifest().kv) <= 5
    assert kv.scan_all() == sorted(model.items()) and snap.scan("", "~") == sorted(then.items())


def test_changes_between_read_and_write_are_seen(s, monkeypatch):
    """A document that is written while a migration, a unique check or a range delete runs: none is lost."""
    kv = s.kv()
    kv.write_batch(Batch().put("c:1", '{"a": 1}').put("c:2", '{"a": 2}'))
    write, once = s.store.write, []

    def meanwhile(key, value):
        def slow(df, kind):
            out = write(df, kind)
            if not once:
                once.append(key)
                kv.put(key, value)
            return out

        once.clear()
        monkeypatch.setattr(s.store, "write", slow)

    meanwhile("c:1", '{"a": 7}')
    Migrator(kv, [Migration(1, "b", (AddField("c", "b", 0),))]).migrate_up()
    assert kv.get("c:1") == '{"a": 7, "b": 0}' and kv.get("c:2") == '{"a": 2, "b": 0}'
    made = IndexManager(kv)
    made.create_index("by_a", "c", ["a"], unique=True)
    meanwhile("c:9", '{"a": 5}')
    with pytest.raises(UniqueViolation):
        made.put_document("c", "8", {"a": 5})
    assert kv.get("c:8") is None and made.lookup("by_a", [5]) == ["9"]
    meanwhile("c:4", "late")
    engine = QueryEngine(kv)
    assert engine.query("DELETE WHERE key >= c:1 AND key <= c:5") == 3 and kv.scan_prefix("c:") == [("c:9", '{"a": 5}')]
    assert engine.query("DELETE WHERE key >= x AND key <= y") == 0


def test_large_sums_are_averaged(s):
    s.sql("CREATE TABLE big (k INTEGER PRIMARY KEY, v INTEGER, w WIDE)")
    s.sql("INSERT INTO big VALUES " + ", ".join(f"({k}, {9 * 10**18 + k}, {10**30 + k})" for k in range(30)))
    ((v, w),) = s.sql("SELECT AVG(v), AVG(w) FROM big").collect()
    assert str(v) == "9000000000000000014.500000000000000" and str(w) == "1000000000000000000000000000014.500000"
    assert s.sql("SELECT AVG(v) FROM big WHERE k > 99").collect() == [(None,)]
    s.sql("INSERT INTO big VALUES (-1, -2, 1), (-2, -1, 1), (-3, -1, 1)")
    assert str(s.sql("SELECT AVG(v) FROM big WHERE k < 0").collect()[0][0]) == "-1.333333333333333"


def test_rankings_use_no_single_task(spark, tmp_path):
    import re

    rows = [(k, (k * 7919) % 10_007 if k % 11 else None, "abc"[k % 3]) for k in range(6000)]
    spark.createDataFrame(rows, "k long, v long, g string").repartition(4).write.parquet(f"{tmp_path}/t")
    s = Session(spark)
    s.register_parquet("t", f"{tmp_path}/t", "k")
    for text, down, distinct in (("RANK() OVER (ORDER BY v)", False, False), ("DENSE_RANK() OVER (ORDER BY v DESC)", True, True), ("ROW_NUMBER() OVER (ORDER BY g DESC)", True, None)):
        df = s.dataframe(f"SELECT k, {text} FROM t")
        got = {r[0]: r[1] for r in df.collect()}
        if distinct is None:
            order = sorted(rows, key=lambda r: (-ord(r[2]), str(r[0])))
            want = {r[0]: i + 1 for i, r in enumerate(order)}
        else:
            least = lambda v: (v is None, v or 0)
            values = sorted([r[1] for r in rows] if not distinct else {r[1] for r in rows}, key=least, reverse=down)
            place = {}
            for i, v in enumerate(values):
                place.setdefault(v, i + 1)
            want = {k: place[v] for k, v, _ in rows}
        assert got == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Windows are over ranges of values, or over the totals of ranges.
        assert set(re.findall(r"windowspecdefinition\((\w+)#", plan)) <= {"_range", "_base"} and "SinglePartition" not in plan
