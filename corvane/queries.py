"""Registered queries of the engine's own operators, each with the same question in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .indexes import IndexManager
from .migrations import AddField, Migration, Migrator, RenameField
from .plans.parser import Parser
from .prepared import QueryEngine
from .replay import checksum, load, verify
from .session import Session
from .sources import workspace
from .sources.kv import Batch, newest
from .streaming.ingest import key_value_stream, parquet_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
# Primary keys of the test tables.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}


def session(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    out = Session(spark)
    for t in tables:
        out.register_parquet(t, f"{sf_dir}/{t}.parquet", KEYS[t])
    return out


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement of the dialect over the tables that it names."""
    words = {t.text.lower() for t in Parser(text).tokens if not t.quoted}
    return session(spark, sf_dir, *[t for t in KEYS if t in words]).dataframe(text)


def dialect(name: str, text: str, sql: str | None = None, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    QUERIES[name] = lambda spark, sf_dir: shape(run(spark, sf_dir, text))
    SQL[name] = sql or text


def casts(**kinds: str) -> Callable[[DataFrame], DataFrame]:
    """Output columns to other types or names: new = 'old|type'."""

    def shape(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{spec.split('|')[0]}`").cast(spec.split("|")[1]).alias(new) if "round" not in spec else F.round(F.col(f"`{spec.split('|')[0]}`"), 2).alias(new) for new, spec in kinds.items()])

    return shape


# Scans, projection, filters.
dialect("scan_star", "SELECT * FROM nation")
dialect("pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 5")
dialect("project_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
dialect("filter_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderdate < '1997-01-01' AND o_orderstatus <> 'F'")
dialect("filter_bool_logic", "SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 10 AND p_size <= 40) OR (p_brand = 'Brand#1' AND p_retailprice < 1000.5)")
dialect("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'E%O_Y' AND p_name LIKE '%e_ %g%'")
dialect("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3.0)", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)")
dialect("filter_not_in_null", "SELECT COUNT(*) FROM customer WHERE NOT (c_nationkey IN (1, NULL)) OR c_custkey = 7", 'SELECT COUNT(*) AS "count(*)" FROM customer WHERE NOT (c_nationkey IN (1, NULL)) OR c_custkey = 7')
_OUTER = "documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"
dialect("filter_is_null", f"SELECT documents.doc_id, lang, toxic FROM {_OUTER} WHERE toxic IS NULL OR quality IS NOT NULL AND toxic = 1")
dialect("in_subquery", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
dialect("not_in_subquery", "SELECT doc_id FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))")
dialect("in_subquery_or", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR lang = 'es'")

# Joins.
dialect("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
dialect("join_left", f"SELECT documents.doc_id, lang, quality FROM {_OUTER}")
dialect("join_right", "SELECT labels.doc_id, documents.doc_id, source FROM labels RIGHT JOIN documents ON labels.doc_id = documents.doc_id", "SELECT labels.doc_id AS label_id, documents.doc_id AS doc_id, source FROM labels RIGHT JOIN documents ON labels.doc_id = documents.doc_id", lambda df: df.toDF("label_id", "doc_id", "source"))
dialect("join_pushdown", "SELECT o_orderkey, c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_mktsegment = 'AUTOMOBILE' AND orders.o_totalprice > 200000")
dialect("join_outer_null_filter", f"SELECT documents.doc_id, source FROM {_OUTER} WHERE labels.quality IS NULL")

# Aggregation.
dialect("agg_global", "SELECT COUNT(*), SUM(o_custkey), MIN(o_totalprice), MAX(o_orderdate) FROM orders", 'SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS total, MIN(o_totalprice) AS low, MAX(o_orderdate) AS last FROM orders', casts(n="count(*)|bigint", total="sum(o_custkey)|bigint", low="min(o_totalprice)|double", last="max(o_orderdate)|timestamp_ntz"))
dialect("agg_group", "SELECT l_returnflag, COUNT(*), SUM(l_quantity), AVG(l_discount) FROM lineitem WHERE l_discount <= 0.05 GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity, ROUND(AVG(l_discount), 2) AS discount FROM lineitem WHERE l_discount <= 0.05 GROUP BY l_returnflag", casts(l_returnflag="l_returnflag|string", n="count(*)|bigint", quantity="sum(l_quantity)|round", discount="avg(l_discount)|round"))
dialect("agg_group_multi", "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_partkey), MIN(l_shipdate), MAX(l_tax) FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS total, MIN(l_shipdate) AS first, MAX(l_tax) AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus", casts(l_returnflag="l_returnflag|string", l_linestatus="l_linestatus|string", n="count(*)|bigint", total="sum(l_partkey)|bigint", first="min(l_shipdate)|timestamp_ntz", tax="max(l_tax)|double"))
dialect("agg_group_only", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
dialect("agg_having_hidden", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND o_custkey > 10")
dialect("agg_exact_avg", "SELECT c_nationkey, AVG(c_custkey) FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, CAST(ROUND(CAST(SUM(c_custkey) AS DOUBLE) / COUNT(c_custkey), 9) AS DOUBLE) AS mean FROM customer GROUP BY c_nationkey", lambda df: df.select("c_nationkey", F.round(F.col("`avg(c_custkey)`").cast("double"), 9).alias("mean")))
dialect("agg_first_row", "SELECT c_mktsegment, c_name, COUNT(*) FROM customer GROUP BY c_mktsegment", 'SELECT c_mktsegment, arg_min(c_name, CAST(c_custkey AS VARCHAR)) AS c_name, COUNT(*) AS "count(*)" FROM customer GROUP BY c_mktsegment')
dialect("agg_count_nulls", f"SELECT lang, COUNT(*), COUNT(quality), SUM(toxic) FROM {_OUTER} GROUP BY lang", "SELECT lang, COUNT(*) AS n, COUNT(quality) AS rated, CAST(SUM(toxic) AS BIGINT) AS toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang", casts(lang="lang|string", n="count(*)|bigint", rated="count(quality)|bigint", toxic="sum(toxic)|bigint"))

# Windows.
dialect("win_row_number", "SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY s_acctbal DESC) FROM supplier", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC NULLS FIRST, CAST(s_suppkey AS VARCHAR)) AS row_number FROM supplier")
dialect("win_rank", "SELECT s_suppkey, RANK() OVER (ORDER BY s_nationkey) FROM supplier", "SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey NULLS LAST) AS rank FROM supplier")
dialect("win_dense_rank", f"SELECT documents.doc_id, DENSE_RANK() OVER (ORDER BY quality DESC) FROM {_OUTER}", "SELECT documents.doc_id, dense_rank() OVER (ORDER BY quality DESC NULLS FIRST) AS dense_rank FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id")
dialect("win_multi_order", "SELECT s_suppkey, RANK() OVER (ORDER BY s_acctbal DESC), DENSE_RANK() OVER (ORDER BY s_nationkey) FROM supplier", "SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal DESC NULLS FIRST) AS rank, dense_rank() OVER (ORDER BY s_nationkey NULLS LAST) AS dense_rank FROM supplier")
dialect("win_over_join", "SELECT o_orderkey, RANK() OVER (ORDER BY c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000", "SELECT o_orderkey, rank() OVER (ORDER BY c_nationkey NULLS LAST) AS rank FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
# Orders by nearly as many values as rows, which no task may see alone.
dialect("win_rank_unique", "SELECT o_orderkey, RANK() OVER (ORDER BY o_totalprice) FROM orders", "SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice NULLS LAST) AS rank FROM orders")
dialect("win_dense_rank_unique", "SELECT o_orderkey, DENSE_RANK() OVER (ORDER BY o_totalprice DESC) FROM orders", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_totalprice DESC NULLS FIRST) AS dense_rank FROM orders")
dialect("win_row_number_orders", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderstatus DESC) FROM orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC NULLS FIRST, CAST(o_orderkey AS VARCHAR)) AS row_number FROM orders")
dialect("win_partitioned", "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) FROM customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS FIRST, CAST(c_custkey AS VARCHAR)) AS row_number FROM customer")

# Order and limit.
dialect("sort_multi", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 50")
dialect("sort_nulls", f"SELECT documents.doc_id, quality FROM {_OUTER} ORDER BY quality DESC, documents.doc_id LIMIT 700", "SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id ORDER BY quality DESC NULLS FIRST, documents.doc_id LIMIT 700")
dialect("sort_multi_whole", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey")
dialect("sort_nulls_whole", f"SELECT documents.doc_id, quality FROM {_OUTER} ORDER BY quality DESC, documents.doc_id", "SELECT documents.doc_id, quality FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id ORDER BY quality DESC NULLS FIRST, documents.doc_id")
dialect("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
dialect("limit_unordered", "SELECT c_custkey, c_name FROM customer LIMIT 25", "SELECT c_custkey, c_name FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 25")
dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, CAST(o_orderkey AS VARCHAR) LIMIT 5")
dialect("order_by_aggregate", "SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey LIMIT 4", 'SELECT c_nationkey, COUNT(*) AS "count(*)" FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey LIMIT 4')

# Set operators.
_A, _B = "SELECT c_nationkey FROM customer", "SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000"
dialect("union_all", f"{_A} UNION ALL {_B}")
dialect("union_distinct", f"{_A} UNION {_B}")
dialect("intersect", f"{_A} INTERSECT {_B}")
dialect("intersect_all_filter", f"{_A} INTERSECT ALL {_B}", f"SELECT c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 8000 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
dialect("except", f"{_A} EXCEPT {_B}")
dialect("except_all_filter", f"{_A} EXCEPT ALL {_B}", f"SELECT c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 8000 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
dialect("setop_right_nested", f"{_A} UNION SELECT s_nationkey FROM supplier EXCEPT {_B}", f"({_A}) UNION ((SELECT s_nationkey FROM supplier) EXCEPT ({_B}))")


# Key-value log: events as one.
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat(F.col("event_type"), F.lit(":"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return e.select(F.lit("").alias("namespace"), key.alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"), (F.col("event_id") % 3 * 1000).alias("expiry"), F.lit(False).alias("deleted"), "user_id", "event_type")


_KEY = "event_type || ':' || lpad(CAST(event_id AS VARCHAR), 20, '0')"


def kv(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@kv("kv_range", f"SELECT {_KEY} AS key, props AS value FROM events WHERE {_KEY} >= 'click:00000000000000000500' AND {_KEY} < 'view'")
def kv_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).where((F.col("key") >= "click:00000000000000000500") & (F.col("key") < "view"))
    return newest(log.withColumn("expiry", F.lit(0)), namespace=False).select("key", "value")


@kv("kv_prefix", f"SELECT {_KEY} AS key, props AS value FROM events WHERE starts_with({_KEY}, 'purchase:')")
def kv_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).where(F.col("key").startswith("purchase:"))
    return newest(log.withColumn("expiry", F.lit(0)), namespace=False).select("key", "value")


@kv("kv_count", f"SELECT COUNT(*) AS n FROM (SELECT DISTINCT {_KEY} AS key FROM events WHERE {_KEY} <= 'login')")
def kv_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).where(F.col("key") <= "login")
    return newest(log.withColumn("expiry", F.lit(0)), namespace=False).agg(F.count(F.lit(1)).alias("n"))


@kv("kv_newest_version", "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS value, MAX(event_id) AS seq FROM events GROUP BY user_id")
def kv_newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumns({"key": F.col("user_id").cast("string"), "expiry": F.lit(0)})
    return newest(log, namespace=False).select("key", "value", "seq")


@kv("kv_snapshot", "SELECT CAST(user_id AS VARCHAR) AS key, MAX(event_id) AS seq FROM events WHERE event_id <= 500 GROUP BY user_id")
def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumns({"key": F.col("user_id").cast("string"), "expiry": F.lit(0)})
    return newest(log, seq=500, namespace=False).select("key", "seq")


@kv("kv_ttl", "SELECT key, seq FROM (SELECT CAST(user_id AS VARCHAR) AS key, MAX(event_id) AS seq FROM events GROUP BY user_id) WHERE seq % 3 = 0 OR seq % 3 * 1000 > 1500")
def kv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumn("key", F.col("user_id").cast("string"))
    return newest(log, now=1500, namespace=False).select("key", "seq")


@kv("kv_tombstone", "SELECT key, seq FROM (SELECT CAST(user_id AS VARCHAR) AS key, MAX(event_id) AS seq, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id) WHERE kind <> 'click'")
def kv_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).withColumns({"key": F.col("user_id").cast("string"), "expiry": F.lit(0), "deleted": F.col("event_type") == "click"})
    return newest(log, namespace=False).select("key", "seq")


# The same through a store: batches are written, read at versions, expire, are deleted and folded.
def _batches(spark: SparkSession, sf_dir: str, n: int = 4) -> tuple[Session, list[int]]:
    """Each user's newest event of each batch; batch b holds the events with event_id % n = b. The versions of the batches."""
    s, e, out = session(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet"), []
    for b in range(n):
        mine = e.where(F.col("event_id") % n == b).groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max_by(F.struct("props", "event_id"), "event_id").alias("r"))
        # Of the last batch's keys, those of every third event have expired long ago.
        expiry = F.when((F.col("r.event_id") % 3 == 1) & F.lit(b == n - 1), 1).otherwise(0).cast("long")
        out.append(s.kv("users").append(mine.select(F.lit("users").alias("namespace"), "key", F.col("r.props").alias("value"), F.lit(0).cast("long").alias("seq"), expiry.alias("expiry"), F.lit(False).alias("deleted"))))
    return s, out


_USERS = "(SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id % 4 * 1000000000000 + event_id) AS value, max(event_id % 4 * 1000000000000 + event_id) AS v FROM events {where} GROUP BY user_id)"
_ALIVE = " WHERE NOT (v >= 3000000000000 AND v % 1000000000000 % 3 = 1)"


@kv("kv_store_newest", f"SELECT key, value FROM {_USERS.format(where='')}{_ALIVE}")
def kv_store_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir)[0].kv("users").frame().select("key", "value")


@kv("kv_store_at_version", f"SELECT key, value FROM {_USERS.format(where='WHERE event_id % 4 < 2')}")
def kv_store_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, versions = _batches(spark, sf_dir)
    return s.kv("users").frame(version=versions[1]).select("key", "value")


@kv("kv_store_folded", f"SELECT key, value FROM {_USERS.format(where='')}{_ALIVE}")
def kv_store_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _batches(spark, sf_dir)
    s.kv().compact(batches_only=True)
    s.kv().compact()
    return s.kv("users").frame().select("key", "value")


@kv("kv_store_delete_range", f"SELECT key, value FROM {_USERS.format(where='')}{_ALIVE} AND NOT key BETWEEN '2' AND '5'")
def kv_store_delete_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _batches(spark, sf_dir)
    engine = QueryEngine(s.kv("users"))
    engine.execute(engine.prepare("DELETE WHERE key >= :a AND key <= :b"), {"a": "2", "b": "5"})
    s.kv().compact(batches_only=True)
    return s.kv("users").frame().select("key", "value")


@kv("prepared_count", f"SELECT COUNT(*) AS n FROM {_USERS.format(where='')}{_ALIVE} AND key BETWEEN '1' AND '7'")
def prepared_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = QueryEngine(_batches(spark, sf_dir)[0].kv("users"))
    return spark.createDataFrame([(engine.query("SELECT COUNT WHERE key >= 1 AND key <= 7"),)], "n long")


@kv("migrated_documents", "SELECT CAST(event_id AS VARCHAR) AS pk, json_extract_string(props, '$.k') AS renamed, 'x' AS tag FROM events")
def migrated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv_ = _documents(spark, sf_dir).kv
    Migrator(kv_, [Migration(1, "tag", (AddField("events", "tag", "x"),)), Migration(2, "rename", (RenameField("events", "k", "renamed"),))]).migrate_up()
    return IndexManager(kv_).documents("events").select("pk", F.get_json_object("value", "$.renamed").alias("renamed"), F.get_json_object("value", "$.tag").alias("tag"))


@kv("backup_restore", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(CASE WHEN o_custkey < 50 THEN 0 ELSE o_custkey END AS BIGINT) AS o_custkey FROM orders WHERE o_orderkey % 10 <> 7")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, at = session(spark, sf_dir), workspace.folder(spark)
    s.sql("CREATE TABLE bought (o_orderkey INTEGER PRIMARY KEY, o_custkey INTEGER)")
    s.load("bought", spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 10 <> 7"))
    s.sql("UPDATE bought SET o_custkey = 0 WHERE o_custkey < 50")
    s.create_backup(f"{at}/backup")
    return Session.restore(spark, f"{at}/backup", f"{at}/restored").dataframe("SELECT * FROM bought")


# Managed tables and the store.
def _nation(spark: SparkSession, sf_dir: str) -> Session:
    s = session(spark, sf_dir)
    s.sql("CREATE TABLE land (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INTEGER)")
    s.load("land", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return s


_LAND = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, {name} AS n_name, CAST({region} AS BIGINT) AS n_regionkey FROM nation"


@kv("dml_update_view", _LAND.format(name="CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_name END", region="n_regionkey"))
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir)
    s.sql("UPDATE land SET n_name = 'changed' WHERE n_regionkey = 1")
    return s.dataframe("SELECT * FROM land")


@kv("dml_delete_view", _LAND.format(name="n_name", region="n_regionkey") + " WHERE NOT (n_regionkey >= 3 OR n_name LIKE '%1')")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir)
    s.sql("DELETE FROM land WHERE n_regionkey >= 3 OR n_name LIKE '%1'")
    return s.dataframe("SELECT * FROM land")


@kv("dml_insert_view", _LAND.format(name="n_name", region="n_regionkey") + " UNION ALL SELECT 100, 'new', NULL")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir)
    s.sql("INSERT INTO land (n_name, n_nationkey) VALUES ($1, $2)", ["new", "100"])
    return s.dataframe("SELECT * FROM land")


@kv("snapshot_read", _LAND.format(name="n_name", region="n_regionkey"))
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir)
    version = s.store.latest()
    s.sql("DELETE FROM land")
    return s.table_at("land", version)


@kv("transaction_view", _LAND.format(name="CASE WHEN n_nationkey = 3 THEN 'inside' ELSE n_name END", region="n_regionkey") + " WHERE n_nationkey <> 4")
def transaction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir)
    for text in ("BEGIN", "UPDATE land SET n_name = 'inside' WHERE n_nationkey = 3", "SAVEPOINT a", "DELETE FROM land", "ROLLBACK TO a", "DELETE FROM land WHERE n_nationkey = 4"):
        s.sql(text)
    out = s.dataframe("SELECT * FROM land")
    s.commit()
    return out


@kv("compacted_read", _LAND.format(name="CASE WHEN n_regionkey = 0 THEN 'folded' ELSE n_name END", region="n_regionkey"))
def compacted_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir)
    s.sql("UPDATE land SET n_name = 'folded' WHERE n_regionkey = 0")
    s.compact()
    return s.dataframe("SELECT * FROM land")


@kv("show_tables", "SELECT * FROM (VALUES ('land'), ('nation')) t(table_name)")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir)
    s.register_parquet("nation", f"{sf_dir}/nation.parquet")
    return s.sql("SHOW TABLES").df


def _documents(spark: SparkSession, sf_dir: str) -> IndexManager:
    s = session(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    load(s.kv(), e.select(F.concat(F.lit("events:"), F.col("event_id").cast("string")).alias("key"), F.col("props").alias("value")))
    out = IndexManager(s.kv())
    out.create_index("by_k", "events", ["k"])
    return out


@kv("index_lookup", "SELECT CAST(event_id AS VARCHAR) AS pk FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 42")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _documents(spark, sf_dir)
    return made.matching(made.indexed("by_k"), ["k"], [42]).select("pk")


@kv("index_range", "SELECT CAST(event_id AS VARCHAR) AS pk FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 30 AND 40")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).range_frame("by_k", 30, 40).select("pk")


@kv("prepared_range", "SELECT 'k' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS key, n_name AS value FROM nation WHERE n_nationkey BETWEEN 3 AND 7")
def prepared_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    batch = Batch()
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").toLocalIterator():
        batch.put(f"k{r['n_nationkey']:03d}", r["n_name"])
    s.kv().write_batch(batch)
    engine = QueryEngine(s.kv())
    return spark.createDataFrame(engine.execute(engine.prepare("SELECT * WHERE key >= $1 AND key <= $2 ORDER BY DESC"), ["k003", "k007"]), "key string, value string")


@kv("replay_checksum", None)
def replay_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), checksum().alias("checksum"))


@kv("replay_verify", "SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM events")
def replay_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, rows = session(spark, sf_dir), event_log(spark, sf_dir).select("key", "value")
    load(s.kv(), rows)
    report = verify(s.kv(), rows)
    return spark.createDataFrame([(report.rows, report.mismatches)], "n long, mismatches long")


@kv("stream_ingest", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, at = session(spark, sf_dir), workspace.folder(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.write.parquet(f"{at}/in")
    q = key_value_stream(parquet_stream(spark, f"{at}/in", nation.schema), s.kv(), "n_nationkey", "n_name", f"{at}/state")
    q.awaitTermination()
    return s.kv().frame().select("key", "value")


@kv("explain_plan", None)
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "nation").sql("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1").df.withColumnRenamed("QUERY PLAN", "query_plan")


@kv("explain_analyze", None)
def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, "nation").sql("EXPLAIN ANALYZE SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey").df.withColumnRenamed("QUERY PLAN", "query_plan")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_group_multi"](spark, sf_dir)
