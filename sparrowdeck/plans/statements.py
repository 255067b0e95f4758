"""Queries whose rows come out of a database: statements of the dialect change its tables, then a query reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import tables
from . import dialect

SUPPLIERS = "CREATE TABLE suppliers (id BIGINT PRIMARY KEY, name VARCHAR(30) NOT NULL, nation INT, balance DOUBLE, note VARCHAR(10) DEFAULT 'none');"


def loaded(spark: SparkSession, sf_dir: str) -> tables.Database:
    """A new database with the suppliers."""
    db = tables.scratch(spark)
    dialect.execute(db, SUPPLIERS)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    db.insert("suppliers", s.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), ["id", "name", "nation", "balance"])
    return db


def after(*statements: str, read: str = "SELECT id, name, nation, balance, note FROM suppliers") -> Callable[[SparkSession, str], DataFrame]:
    """The rows that `read` gives after the statements."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = loaded(spark, sf_dir)
        for text in statements:
            dialect.execute(db, text)
        return dialect.execute(db, read)

    return run


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which writes a unique index and a required column refuse, and that nothing of them stays."""
    db = loaded(spark, sf_dir)
    dialect.execute(db, "CREATE UNIQUE INDEX by_name ON suppliers (name, nation)")
    attempts = {
        "copy": "INSERT INTO suppliers (id, name, nation) SELECT id + 1000000, name, nation FROM suppliers WHERE id = 1",
        "same key twice": "INSERT INTO suppliers (id, name, nation) VALUES (-1, 'x', NULL), (-2, 'x', NULL)",
        "one key for all": "UPDATE suppliers SET name = 'y', nation = 1",
        "no name": "UPDATE suppliers SET name = NULL WHERE id = 2",
        "new key": "INSERT INTO suppliers (id, name, nation) VALUES (-3, 'x', NULL)",
    }
    out = []
    for what, text in attempts.items():
        try:
            dialect.execute(db, text)
            out.append((what, "accepted"))
        except tables.TableError as e:
            out.append((what, str(e).split(" in ")[0]))
    counted = dialect.execute(db, "SELECT COUNT(*) FROM suppliers").first()["count"]
    return spark.createDataFrame([(w, r, counted) for w, r in out], "attempt string, result string, n long")


def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables changed in one commit; a second transaction that rewrote the same rows loses as a whole."""
    db = loaded(spark, sf_dir)
    dialect.execute(db, "CREATE TABLE moves (id BIGINT, amount DOUBLE)")
    one, two = tables.Transaction(db), tables.Transaction(db)
    for t, amount in ((one, 10), (two, 99)):
        dialect.execute(t, "UPDATE suppliers SET balance = balance + @a WHERE nation = 3", {"a": amount})
        dialect.execute(t, "INSERT INTO moves SELECT id, @a FROM suppliers WHERE nation = 3", {"a": amount})
    one.commit()
    lost = False
    try:
        two.commit()
    except tables.Conflict:
        lost = True
        two.rollback()
    return dialect.execute(db, "SELECT s.id, s.balance, m.amount, @lost AS second_lost FROM suppliers s LEFT JOIN moves m ON s.id = m.id", {"lost": lost})


def seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = loaded(spark, sf_dir)
    dialect.execute(db, "CREATE INDEX by_nation ON suppliers (nation, id)")
    db.cluster("suppliers")
    return db.seek("suppliers", "by_nation", equal=[3], low=2, high=10_000).select("id", "name", "nation")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each version of a table had, oldest first."""
    db = loaded(spark, sf_dir)
    dialect.execute(db, "DELETE FROM suppliers WHERE nation = 3")
    dialect.execute(db, "INSERT INTO suppliers (id, name) VALUES (-1, 'new')")
    seen = db.scan_versions("suppliers").createOrReplaceTempView
    name = "sd_versions"
    seen(name)
    try:
        return spark.sql(f"SELECT CAST(rank() OVER (ORDER BY version) AS BIGINT) AS step, n FROM (SELECT version, count(*) AS n FROM {name} GROUP BY version)")
    finally:
        spark.catalog.dropTempView(name)


_BASE = "SELECT s_suppkey AS id, s_name AS name, s_nationkey::INTEGER AS nation, s_acctbal AS balance, 'none' AS note FROM supplier"
QUERIES = {
    "sql_create_insert": after(),
    "sql_insert_select": after("INSERT INTO suppliers (id, name, nation, note) SELECT id + 1000000, upper(name), nation + 1, 'copy' FROM suppliers WHERE balance > 0"),
    "sql_insert_values": after("INSERT INTO suppliers (id, name, balance) VALUES (-1, 'it''s new', 1.5), (-2, 'no balance', NULL)"),
    "sql_update": after("UPDATE suppliers SET balance = balance + 10, note = 'low' WHERE balance < 1000 AND nation NOT IN (3, NULL)"),
    "sql_update_from_query": after("UPDATE suppliers SET note = 'top' WHERE balance > (SELECT AVG(balance) FROM suppliers)"),
    "sql_delete": after("DELETE FROM suppliers WHERE balance < 1000", "DELETE FROM suppliers WHERE nation = NULL"),
    "sql_alter": after("ALTER TABLE suppliers DROP COLUMN balance", "ALTER TABLE suppliers ADD COLUMN balance VARCHAR(9) DEFAULT 'new'", "INSERT INTO suppliers (id, name) VALUES (-1, 'late')"),
    "sql_drop": after("CREATE TABLE gone (id INT)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone", "CREATE TABLE gone (n BIGINT)", "INSERT INTO gone SELECT COUNT(*) FROM suppliers", read="SELECT n FROM gone"),
    "sql_unique": refused,
    "sql_transaction": transaction,
    "sql_index_seek": seek,
    "sql_version_scan": versions,
}
ORACLES = {
    "sql_create_insert": _BASE,
    "sql_insert_select": f"{_BASE} UNION ALL SELECT s_suppkey + 1000000, upper(s_name), s_nationkey + 1, NULL, 'copy' FROM supplier WHERE s_acctbal > 0",
    "sql_insert_values": f"{_BASE} UNION ALL SELECT -1, 'it''s new', NULL, 1.5, 'none' UNION ALL SELECT -2, 'no balance', NULL, NULL, 'none'",
    "sql_update": f"SELECT id, name, nation, CASE WHEN hit THEN balance + 10 ELSE balance END AS balance, CASE WHEN hit THEN 'low' ELSE note END AS note FROM (SELECT *, balance < 1000 AND nation <> 3 AS hit FROM ({_BASE}))",
    "sql_update_from_query": f"SELECT id, name, nation, balance, CASE WHEN balance > (SELECT avg(s_acctbal) FROM supplier) THEN 'top' ELSE note END AS note FROM ({_BASE})",
    "sql_delete": f"SELECT * FROM ({_BASE}) WHERE NOT coalesce(balance < 1000, FALSE)",
    "sql_alter": f"SELECT id, name, nation, NULL::VARCHAR AS balance, note FROM ({_BASE}) UNION ALL SELECT -1, 'late', NULL, 'new', 'none'",
    "sql_drop": "SELECT count(*) AS n FROM supplier",
    "sql_unique": "SELECT attempt, result, (SELECT count(*) + 1 FROM supplier) AS n FROM (VALUES ('copy', 'duplicate key'), ('same key twice', 'duplicate key'), ('one key for all', 'duplicate key'), ('no name', 'null'), ('new key', 'accepted')) t(attempt, result)",
    "sql_transaction": "SELECT s_suppkey AS id, CASE WHEN s_nationkey = 3 THEN s_acctbal + 10 ELSE s_acctbal END AS balance, CASE WHEN s_nationkey = 3 THEN 10.0::DOUBLE END AS amount, TRUE AS second_lost FROM supplier",
    "sql_index_seek": "SELECT s_suppkey AS id, s_name AS name, s_nationkey::INTEGER AS nation FROM supplier WHERE s_nationkey = 3 AND s_suppkey BETWEEN 2 AND 10000",
    "sql_version_scan": "SELECT 1::BIGINT AS step, count(*) AS n FROM supplier UNION ALL SELECT 2, count(*) FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 3, count(*) + 1 FROM supplier WHERE s_nationkey <> 3",
}
