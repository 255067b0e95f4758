"""The library's own operators on small tables: dialect, tables, key-value, graph, validation, mapping, sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparrowdeck.functions import compat, cron
from sparrowdeck.operators import graph, keyvalue, mapping, tables, validation
from sparrowdeck.plans import dialect
from sparrowdeck.sources import formats
from sparrowdeck.streaming import events
from sparrowdeck.types import spark_type


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Ada", 36), (2, "Grace", 45), (3, "Alan", 41)], "id long, name string, age int")


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", 2)], "category string, score int")


def ask(spark, text, params=None, **frames):
    return [tuple(r) for r in dialect.query(spark, text, frames, params).collect()]


# ---- dialect


def test_selects(spark, users, scores):
    assert ask(spark, "SELECT name FROM users WHERE age > 40 ORDER BY age DESC;", users=users) == [("Grace",), ("Alan",)]
    assert ask(spark, "SELECT id FROM users ORDER BY id LIMIT 1 OFFSET 1", users=users) == [(2,)]
    assert ask(spark, "SELECT id FROM users ORDER BY id OFFSET 1 LIMIT 1", users=users) == [(2,)]
    assert ask(spark, "SELECT TOP 2 id FROM users ORDER BY id", users=users) == [(1,), (2,)]
    assert ask(spark, "SELECT id FROM users ORDER BY id OFFSET 1 ROWS FETCH NEXT 1 ROWS ONLY", users=users) == [(2,)]
    assert ask(spark, "SELECT name, age + 1 FROM users WHERE name LIKE 'A%' ORDER BY name", users=users) == [("Ada", 37), ("Alan", 42)]
    assert ask(spark, "SELECT COUNT(*) FROM users", users=users) == [(3,)]
    assert len(ask(spark, "SELECT DISTINCT category FROM t", t=scores)) == 2
    assert [len(ask(spark, f"SELECT * FROM t WHERE score {p}", t=scores)) for p in ("= 1", "IS NULL", "<> 999")] == [2, 1, 3]


def test_names_of_computed_columns(spark, users):
    q = dialect.query(spark, "SELECT id, age + 1, name AS n, UPPER(name) FROM users", {"users": users})
    assert q.columns == ["id", "column2", "n", "column4"]
    assert dialect.query(spark, "SELECT COUNT(*) FROM users", {"users": users}).columns == ["count"]


def test_parameters(spark, users):
    assert ask(spark, "SELECT name FROM users WHERE age = @a OR id = $1", {"a": 36, "1": 2}, users=users) == [("Ada",), ("Grace",)]
    with pytest.raises(dialect.DialectError):
        dialect.query(spark, "SELECT * FROM users WHERE age = @b", {"users": users})


def test_kept_semantics(spark, users, scores):
    assert ask(spark, "SELECT age / 10, 7 / 2, -7 / 2, age / 10 / 2 FROM users WHERE id = 1", users=users) == [(3, 3, -3, 1)]
    assert ask(spark, "SELECT 7.0 / 2 FROM users WHERE id = 1", users=users)[0][0] == 3.5
    assert len(ask(spark, "SELECT * FROM t WHERE score NOT IN (1, NULL)", t=scores)) == 1
    assert ask(spark, "SELECT id FROM users WHERE id IN (NULL)", users=users) == []
    odd = spark.createDataFrame([("a\\b",), ("ab",), ("a%",)], "x string")
    assert ask(spark, r"SELECT x FROM odd WHERE x LIKE 'a\b'", odd=odd) == [("a\\b",)]
    assert ask(spark, "SELECT x FROM odd WHERE x = 'a\\b' /* one /* two */ */ -- end", odd=odd) == [("a\\b",)]
    assert ask(spark, "SELECT \"x\" FROM odd WHERE x = 'it''s'", odd=odd) == []
    assert ask(spark, "SELECT CAST('3' AS INT8), CAST(1 AS FLOAT), '5'::INTEGER FROM users WHERE id = 1", users=users) == [(3, 1.0, 5)]
    assert ask(spark, "SELECT CASE age WHEN NULL THEN 1 ELSE 2 END FROM users WHERE id = 1", users=users) == [(2,)]


def test_joins_and_sets(spark, users, scores):
    orders = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "order_id long, user_id long")
    assert sorted(ask(spark, "SELECT u.name, o.order_id FROM users u JOIN orders o ON u.id = o.user_id", users=users, orders=orders)) == [("Ada", 10), ("Ada", 11)]
    assert ask(spark, "SELECT name FROM users, orders WHERE users.id = orders.user_id AND order_id = 10", users=users, orders=orders) == [("Ada",)]
    assert sorted(ask(spark, "SELECT id FROM users UNION SELECT user_id FROM orders", users=users, orders=orders)) == [(1,), (2,), (3,), (9,)]
    assert ask(spark, "WITH x AS (SELECT user_id, COUNT(*) AS n FROM orders GROUP BY user_id) SELECT user_id FROM x WHERE n > 1", orders=orders) == [(1,)]
    assert ask(spark, "SELECT t.* FROM users t WHERE EXISTS (SELECT 1 FROM orders WHERE user_id = t.id)", users=users, orders=orders) == [(1, "Ada", 36)]
    assert ask(spark, "SELECT COUNT(DISTINCT category) AS n FROM t", t=scores) == [(2,)]


@pytest.mark.parametrize(("text", "code"), [("", "SQL0001"), ("  ;", "SQL0001"), ("TRUNCATE t", "SQL0002"), ("SELECT 'a", "SQL0002"), ("SELECT 1; SELECT 2", "SQL0002")])
def test_diagnostics(text, code):
    with pytest.raises(dialect.DialectError) as e:
        dialect.parse(text)
    assert e.value.code == code


def test_a_missing_semicolon_is_noted():
    assert dialect.parse("SELECT 1").notes[0].startswith("SQL0100")
    assert dialect.parse("SELECT 1;").notes == []


def test_unknown_names_fail_before_execution(spark, users):
    for q in ("SELECT zzz FROM users", "SELECT * FROM nowhere", "SELECT zzz.id FROM users"):
        with pytest.raises(Exception, match="cannot be (found|resolved)|UNRESOLVED|NOT_FOUND"):
            dialect.query(spark, q, {"users": users}).collect()


def test_types_and_compat(spark, scores):
    assert [spark_type(t) for t in ("INT8", "FLOAT", "VARCHAR(10)", "NUMERIC", "NUMERIC(5)", "decimal(18, 4)", "UUID")] == ["BIGINT", "DOUBLE", "STRING", "DECIMAL(38,18)", "DECIMAL(5,0)", "DECIMAL(18,4)", "STRING"]
    with pytest.raises(ValueError, match="unknown type"):
        spark_type("POINT")
    got = scores.select(compat.in_list(F.col("score"), [1, None]), compat.not_in_list(F.col("score"), [None]), compat.in_list(F.col("score"), [])).collect()
    assert [tuple(r) for r in got] == [(True, True, False), (True, True, False), (None, None, None), (False, True, False)]
    assert [r[0] for r in scores.select(compat.text_only(scores, "score", True)).collect()] == [1, 1, None, 2]
    assert compat.successor(b"a\xff") == b"b" and compat.successor(b"\xff") is None


# ---- tables


def test_tables(spark, tmp_path):
    db = tables.Database(spark, f"file://{tmp_path}")
    col = tables.ColumnDef
    db.create_table("items", tables.TableDef((col("id", "INT"), col("label", "VARCHAR(50)", True, "unlabeled"), col("qty", "INT", True, 0)), ("id",)))
    db.create_table("items", db.definition("items"), if_not_exists=True)
    assert db.insert("items", [(1,), (2,)], ["id"]) == 2
    assert sorted(map(tuple, db.read("items").collect())) == [(1, "unlabeled", 0), (2, "unlabeled", 0)]
    snapshot = db.version("items")
    assert db.update("items", {"qty": F.col("qty") + F.col("id"), "label": F.lit("x")}, F.col("id") > 1) == 1
    assert db.delete("items", F.col("qty") > 100) == 0 and db.delete("items", F.col("id") == 1) == 1
    assert [tuple(r) for r in db.read("items").collect()] == [(2, "x", 2)]
    assert db.read("items", snapshot).count() == 2
    with pytest.raises(tables.TableError, match="null"):
        db.insert("items", [(None, "a", 1)])
    with pytest.raises(tables.Conflict):
        db.insert("items", [(7, "late", 1)], at=snapshot)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        db.insert("items", [("abc", "a", 1)])
    db.add_column("items", col("extra", "BIGINT", True, 5))
    assert [tuple(r) for r in db.read("items").collect()] == [(2, "x", 2, None)]
    db.create_index("items", "u", ["label"], unique=True)
    with pytest.raises(tables.TableError, match="duplicate"):
        db.insert("items", [(3, "x", 1, 1)])
    with pytest.raises(tables.TableError, match="index"):
        db.drop_column("items", "label")
    db.drop_index("items", "u")
    db.drop_column("items", "label")
    assert db.read("items").columns == ["id", "qty", "extra"]
    assert db.scan_versions("items").select("version").distinct().count() > 3
    assert db.purge() > 3 and db.read("items").count() == 1
    t1, t2 = tables.Transaction(db), tables.Transaction(db)
    t1.replace("items", t1.read("items").withColumn("qty", F.lit(9)))
    t2.replace("items", t2.read("items").withColumn("qty", F.lit(8)))
    t1.commit()
    with pytest.raises(tables.Conflict):
        t2.commit()
    assert db.read("items").first()["qty"] == 9
    with pytest.raises(tables.TableError):
        tables.Transaction(db, "serializable")
    db.drop_table("items")
    db.drop_table("items", if_exists=True)
    with pytest.raises(tables.TableError, match="unknown"):
        db.read("items")


def test_a_dropped_name_added_anew_is_null(spark, tmp_path):
    db, col = tables.Database(spark, f"file://{tmp_path}"), tables.ColumnDef
    db.create_table("t", tables.TableDef((col("id", "INT"), col("v", "INT"))))
    db.insert("t", [(1, 7), (2, 8)])
    before = db.version("t")
    db.drop_column("t", "v")
    db.add_column("t", col("v", "VARCHAR(5)"))
    assert sorted(map(tuple, db.read("t").collect())) == [(1, None), (2, None)]
    db.insert("t", [(3, "x")])
    assert sorted(map(tuple, db.read("t").collect())) == [(1, None), (2, None), (3, "x")]
    assert sorted(map(tuple, db.read("t", before).collect())) == [(1, 7), (2, 8)]


def test_a_commit_over_two_tables_is_atomic(spark, tmp_path):
    db, col = tables.Database(spark, f"file://{tmp_path}"), tables.ColumnDef
    for name in ("a", "b"):
        db.create_table(name, tables.TableDef((col("id", "INT"), col("v", "INT"))))
        db.insert(name, [(1, 1), (2, 2)])
    one = tables.Transaction(db)
    one.insert("a", [(3, 3)])
    one.update("b", {"v": F.lit(9)}, F.col("id") == 1)
    assert one.read("a").count() == 3 and db.read("a").count() == 2  # its own changes are seen by it alone
    assert db.update("b", {"v": F.lit(5)}, F.col("id") == 1) == 1
    with pytest.raises(tables.Conflict):
        one.commit()
    assert db.read("a").count() == 2 and {r["v"] for r in db.read("b").collect()} == {5, 2}
    two = tables.Transaction(db)
    two.insert("a", [(3, 3)])
    two.delete("b")
    db.insert("a", [(4, 4)])  # adding rows is no conflict
    two.commit()
    assert sorted(r["id"] for r in db.read("a").collect()) == [1, 2, 3, 4] and db.read("b").count() == 0
    three = tables.Transaction(db, "read committed")
    db.insert("b", [(5, 5)])
    assert three.read("b").count() == 1 and tables.Transaction(db).read("b").count() == 1
    three.insert("b", [(6, 6)])
    three.rollback()
    assert db.read("b").count() == 1


def test_only_touched_files_are_rewritten_and_seeks_skip_files(spark, tmp_path):
    db, col = tables.Database(spark, f"file://{tmp_path}"), tables.ColumnDef
    db.create_table("t", tables.TableDef((col("id", "BIGINT"), col("v", "BIGINT"))))
    db.insert("t", spark.range(1000).selectExpr("id", "id AS v"))
    db.insert("t", spark.range(1000, 1010).selectExpr("id", "id AS v"))
    first = set(db.state("t").files)
    assert db.update("t", {"v": F.lit(-1)}, F.col("id") == 1005) == 1
    assert len(first & set(db.state("t").files)) >= len(first) - 4
    db.create_index("t", "by_id", ["id"], unique=True)
    db.cluster("t")
    got = db.seek("t", "by_id", low=10, high=20)
    assert got.count() == 11 and db.seek("t", "by_id", equal=[500]).count() == 1
    assert "PushedFilters: [IsNotNull" in got._jdf.queryExecution().toString()
    with pytest.raises(tables.TableError, match="duplicate"):
        db.insert("t", [(20, 1)])
    with pytest.raises(tables.TableError, match="duplicate"):
        db.update("t", {"id": F.lit(3)}, F.col("id") == 4)
    assert db.update("t", {"id": F.col("id") + 1}) == 1010


# ---- key-value


def test_key_value(spark):
    store = spark.createDataFrame([], keyvalue.SCHEMA)
    for k in ("delta", "alpha", "charlie", "bravo"):
        store = keyvalue.command(store, "PUT @k @v", {"k": k, "v": k.upper()}).store
    keys = lambda df: [bytes(r["key"]).decode() for r in df.collect()]
    assert keys(keyvalue.command(store, "SCAN")) == ["alpha", "bravo", "charlie", "delta"]
    assert keys(keyvalue.command(store, "SCAN FROM @a TO @b", {"a": "b", "b": "d"})) == ["bravo", "charlie"]
    assert keys(keyvalue.command(store, "SCAN PREFIX @p LIMIT 1", {"p": "d"})) == ["delta"]
    assert keyvalue.command(store, "EXISTS @k", {"k": "zulu"}).first()[0] is False
    assert not keyvalue.command(store, "PUT @k @v IF ABSENT", {"k": "alpha", "v": "x"}).applied
    etag = keyvalue.command(store, "GET @k", {"k": "alpha"}).first()["etag"]
    assert not keyvalue.command(store, "PUT @k @v IF @e", {"k": "alpha", "v": "x", "e": etag + 99}).applied
    change = keyvalue.command(store, "PUT @k @v IF @e", {"k": "alpha", "v": "x", "e": etag})
    assert change.applied and bytes(keyvalue.get(change.store, b"alpha").first()["value"]) == b"x"
    assert keys(keyvalue.scan(keyvalue.command(store, "DELETE @k", {"k": "bravo"}).store)) == ["alpha", "charlie", "delta"]
    for bad in ("", "GET", "FIND @k", "SCAN FROM", "PUT @k @v IF", "GET @missing"):
        with pytest.raises(keyvalue.CommandError):
            keyvalue.command(store, bad, {"k": "a", "v": "b"})


# ---- graph


def test_graph(spark):
    nodes = spark.createDataFrame([(i, ["N"], {}) for i in range(1, 6)], graph.NODES)
    edges = spark.createDataFrame([(1, 1, 2, "A", {}), (2, 2, 3, "A", {}), (3, 3, 1, "A", {}), (4, 3, 4, "B", {})], graph.RELATIONSHIPS)
    start = spark.createDataFrame([(1,)], "id long")
    reach = lambda **k: dict(map(tuple, graph.traverse(edges, start, **k).collect()))
    assert reach() == {1: 0, 2: 1}
    assert reach(max_depth=10) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert reach(max_depth=10, type_="A") == {1: 0, 2: 1, 3: 2}
    assert reach(direction="in", max_depth=1) == {1: 0, 3: 1} and reach(direction="both") == {1: 0, 2: 1, 3: 1}
    edges2 = graph.create_relationship(nodes, edges, 9, 1, 5, "A")
    assert edges2.count() == 5
    assert graph.get_node(nodes, 2).count() == 1 and graph.delete_relationship(edges2, 9).count() == 4
    with pytest.raises(Exception, match="node exists"):
        graph.create_nodes(nodes, nodes.where("id = 1")).collect()
    left, kept = graph.delete_node(nodes, edges2, 1)
    assert left.count() == 4 and kept.count() == 2
    with pytest.raises(ValueError, match="exist"):
        graph.create_relationship(nodes, edges, 9, 1, 77, "A")
    docs = spark.createDataFrame([], "id string, content string, version long")
    docs = graph.put_document(graph.put_document(docs, "a", "1", 0), "a", "2", 1)
    assert [tuple(r) for r in docs.collect()] == [("a", "2", 2)]
    with pytest.raises(ValueError, match="version"):
        graph.delete_document(docs, "a", 1)
    assert graph.get_document(docs, "a").first()["content"] == "2"
    assert graph.delete_document(docs, "a", 2).count() == 0


# ---- validation and mapping


def test_rules(spark):
    v = validation
    df = spark.createDataFrame([(1, "abc", ["x", "y"], "a@b.co"), (2, None, None, None), (3, "  ", [], "bad")], "n int, s string, xs array<string>, mail string")
    rules = {
        "null": ("s", v.null(), [1, 3]), "not_null": ("s", v.not_null(), [2]), "equal": ("s", v.equal_to("abc"), [2, 3]), "not_equal": ("s", v.not_equal_to("abc"), [1]),
        "gt": ("n", v.greater_than(2), [1, 2]), "ge": ("n", v.greater_or_equal(2), [1]), "lt": ("n", v.less_than(2), [2, 3]), "le": ("n", v.less_or_equal(2), [3]),
        "between": ("n", v.between(1, 3), [1, 3]), "between_eq": ("n", v.between_or_equal(2, 3), [1]), "length": ("s", v.length(3), [2, 3]), "range": ("s", v.length(2, 3), [2]),
        "min": ("s", v.min_length(3), [2, 3]), "max": ("s", v.max_length(2), [1, 2]), "empty": ("s", v.empty(), [1]), "not_empty": ("s", v.not_empty(), [2, 3]),
        "array": ("xs", v.contains("x", True), [2, 3]), "no_x": ("xs", v.not_contains("x", True), [1]), "starts": ("s", v.starts_with("a"), [2, 3]), "not_starts": ("s", v.not_starts_with("a"), [1, 2]),
        "ends": ("s", v.ends_with("c"), [2, 3]), "not_ends": ("s", v.not_ends_with("c"), [1, 2]), "regex": ("s", v.matches("^a.c$"), [2, 3]), "mail": ("mail", v.email(), [2, 3]), "sizes": ("xs", v.min_length(1, True), [2, 3]),
    }
    for name, (column, rule, want) in rules.items():
        got = v.validate(df, v.Profile().rule_for(name, column, rule)).where("size(failures) > 0").orderBy("n").collect()
        assert [r["n"] for r in got] == want, name
    p = v.Profile().rule_for("a", "n", v.greater_than(1), v.greater_than(2)).rule_for_each("e", "xs", v.equal_to("x")).when(F.col("n") == 1, lambda q: q.rule_for("w", "s", v.null()))
    assert v.validate(df, p).orderBy("n").first()["failures"] == ["a.0", "a.1", "e", "w"]
    assert v.validate(df, v.Profile(p.checks, cascade=False)).orderBy("n").first()["failures"] == ["a.0"]


def test_mapping(spark):
    m = mapping
    df = spark.createDataFrame([(1, [1, 2], None), (2, None, [9])], "id int, new array<int>, old array<int>")
    got = m.map_rows(df, m.Mapping().member("id", "id").collection("o", "new", lambda x: x * 10, "old").collection("k", "new", lambda x: x * 10, "old", merge=True)).collect()
    assert [tuple(r) for r in got] == [(1, [10, 20], [10, 20]), (2, [9], [9])]
    pairs = spark.createDataFrame([("a", "name", "n"), ("a", "size", "3"), ("b", "0", "x"), ("b", "1", "y")], "id string, path string, value string")
    assert tuple(m.bind_object(pairs.where("id = 'a'"), "name string, size int").first()) == ("a", "n", 3)
    assert m.bind_array(pairs.where("id = 'b'")).first()["items"] == ["x", "y"]
    assert m.bind_map(pairs.where("id = 'a'")).first()["items"] == {"name": "n", "size": "3"}
    one = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, value string")
    assert sorted(map(tuple, m.layered(one, one.where("path = 'q'").withColumn("value", F.lit("9"))).collect())) == [("p", "1", 0), ("q", "9", 1)]
    store = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert sorted(map(tuple, m.upsert(store, spark.createDataFrame([("b", None), ("c", 3)], "key string, v int")).collect())) == [("a", 1), ("c", 3)]
    t = dt.datetime(2024, 1, 1, 12)
    entries = spark.createDataFrame([("abs", t, None, None, None), ("rel", None, t + dt.timedelta(1), None, None), ("slide", None, None, t, dt.timedelta(hours=1)), ("free", None, None, None, None)], "k string, absolute timestamp_ntz, relative timestamp_ntz, last_access timestamp_ntz, sliding interval day to second")
    now = F.lit(t).cast("timestamp_ntz")
    assert {r["k"] for r in m.unexpired(entries, now).collect()} == {"rel", "slide", "free"}
    cache = spark.createDataFrame([(i, 10, 0 if i < 3 else 1, i, i == 0) for i in range(6)], "id int, size long, priority int, last_access int, keep boolean")
    assert {r["id"] for r in m.evict(cache, 40, 0.0).collect()} == {0, 3, 4, 5} and m.evict(cache, 60).count() == 6


# ---- sources, schedules, streams


def test_sources(spark, tmp_path):
    f = formats
    assert f.json_pairs('{"a": {"b": [1, true, null, {}]}, "c": "x"}') == [("a:b:0", "1"), ("a:b:1", "true"), ("a:b:2", None), ("a:b:3", None), ("c", "x")]
    for bad in ("[1]", '{"a": 1, "A": 2}'):
        with pytest.raises(ValueError):
            f.json_pairs(bad)
    texts = spark.createDataFrame([(1, "a: [x, {b: 1}]"), (2, "a: [x"), (3, None)], "id long, t string")
    assert sorted(map(tuple, f.pairs(texts, "id", "t", "yaml", errors=True).select("id", "path", "value").collect()), key=repr) == [("1", "a:0", "x"), ("1", "a:1:b", "1"), ("2", None, None)]
    with pytest.raises(Exception, match="expected a comma"):
        f.pairs(texts, "id", "t", "yaml").collect()
    toks = f.tokens(spark.createDataFrame([(1, "a==b \t=c\nd"), (2, ""), (3, None)], "id long, t string"), "id", "t", {"eq": "=", "eqeq": "=="}, whitespace=True)
    assert sorted((r["n"], r["kind"], r["name"], r["value"], r["offset"]) for r in toks.collect()) == [(0, "text", None, "a", 0), (1, "literal", "eqeq", "==", 1), (2, "text", None, "b", 3), (3, "whitespace", None, " \t", 4), (4, "literal", "eq", "=", 6), (5, "text", None, "c\nd", 7)]
    assert f.ini_pairs("; c\nk = 'v'\n[a:b]\nx=1\nx = 2\n# d") == [("k", "v"), ("a:b:x", "2")]
    for bad in ("[a", "[]", "nothing", "= 1"):
        with pytest.raises(ValueError):
            f.ini_pairs(bad)
    assert f.xml_pairs('<r v="1"><a>x</a><b Name="n"><c>1</c></b><d>1</d><d>2</d></r>') == [("v", "1"), ("a", "x"), ("b:n:Name", "n"), ("b:n:c", "1"), ("d:0", "1"), ("d:1", "2")]
    for bad in ("<r><a z='1'>x</a></r>", "<!DOCTYPE r><r/>"):
        with pytest.raises(ValueError):
            f.xml_pairs(bad)
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, "x")], "id long, t string")
    assert sorted((r["id"], r["n"], r["line"]) for r in f.lines(df, "id", "t").collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (3, 0, "x")]
    content = [b"\xef\xbb\xbfa", "a".encode("utf-16"), "ab".encode("utf-16-be"), "ab".encode("utf-32-le"), "a".encode("utf-32"), b"ab", b""]
    got = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(content)], "i int, c binary").select("i", f.encoding(F.col("c")).alias("e")).orderBy("i").collect()
    assert [r["e"] for r in got] == ["utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "utf-32-le", "utf-8", "utf-8"]
    kinds = {"": "null", "~": "null", "True": "boolean", "-12": "integer", "0x1F": "integer", "0o17": "integer", "1.5e3": "float", ".inf": "float", "-.INF": "float", ".NaN": "float", "yes": "string", "1a": "string"}
    got = spark.createDataFrame([(k,) for k in kinds], "s string").select("s", f.yaml_kind(F.col("s")).alias("k"), f.yaml_integer(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["k"] for r in got} == kinds and {r["n"] for r in got if r["k"] == "integer"} == {-12, 31, 15}
    for name, text in (("a/x.txt", "1"), ("a/y.md", "2"), ("b/z.txt", "3")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda **k: sorted(r["name"] for r in f.blobs(spark, str(tmp_path), **k).collect())
    assert names() == ["a/x.txt", "a/y.md", "b/z.txt"] and names(prefix="a/") == ["a/x.txt", "a/y.md"]
    assert names(include="*.txt", exclude="b/*") == ["a/x.txt"] and names(include=["a/*", "z.*"], exclude=["*.md"]) == ["a/x.txt", "b/z.txt"]
    assert names(include="**/z.txt") == ["b/z.txt"] and names(exclude="**") == [] and f.blobs(spark, str(tmp_path), include="z.txt").first()["content"] == b"3"
    got = list(f.row_frames(spark.range(5), 2))
    assert got[0] == ("header", [("id", "bigint")]) and got[-1] == ("complete", 5) and [len(x) for k, x in got if k == "rows"] == [2, 2, 1]
    old = f.manifest(spark, str(tmp_path)).where("name != 'b/z.txt'").withColumn("hash", F.when(F.col("name") == "a/y.md", "0").otherwise(F.col("hash")))
    assert dict(map(tuple, f.migration(old, f.manifest(spark, str(tmp_path))).collect())) == {"a/y.md": "changed", "b/z.txt": "added"}


def test_schedules(spark):
    assert cron.values("*/20", 0, 59) == {0, 20, 40} and cron.values("1-9/4", 0, 59) == {1, 5} and cron.values("1-9/4,30", 0, 59) == {1, 5, 9, 30}
    got = cron.occurrences(spark, "0 12 29 2 *", "2024-01-01 00:00:00", "2026-01-01 00:00:00").collect()
    assert [r[0] for r in got] == [dt.datetime(2024, 2, 29, 12)]
    for bad in ("* * * *", "61 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            cron.matches(bad, F.col("ts"))


def test_streams(spark, sf, tmp_path):
    stream = events.counts(events.event_stream(spark, sf), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counted").collect()}
    assert got == {tuple(r) for r in events.counts(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 day").collect()}
    seen = []
    events.change_feed(events.event_stream(spark, sf), lambda df, _: seen.append(df.count()), str(tmp_path / "f")).awaitTermination(120)
    assert sum(seen) == 1000


# ---- plans


def test_plans(spark, sf):
    from sparrowdeck import catalog

    text = lambda name: catalog.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in text("top_k")
    assert "PushedFilters: [IsNotNull(o_totalprice)" in text("filter_project")
    assert "ReadSchema: struct<o_orderkey:bigint>" in text("bitwise")
    assert "BroadcastHashJoin" in text("join_inner")


def test_every_query_runs(spark, sf):
    from sparrowdeck import catalog

    for name, query in catalog.queries().items():
        assert query(spark, sf).limit(5).count() > 0, name
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


# ---- statements over a database


def test_null_candidates_and_names_in_literals(spark, users, scores):
    assert sorted(ask(spark, "SELECT id FROM users WHERE id NOT IN (2, @p)", {"p": None}, users=users)) == [(1,), (3,)]
    assert sorted(ask(spark, "SELECT id FROM users WHERE id NOT IN (2, NULLIF(id, id))", users=users)) == [(1,), (3,)]
    assert ask(spark, "SELECT id FROM users WHERE id IN (@p)", {"p": None}, users=users) == []
    assert ask(spark, "SELECT 'rows from users today', id FROM users WHERE id = 1", users=users) == [("rows from users today", 1)]
    assert ask(spark, "SELECT users FROM t, users WHERE users = id", t=spark.createDataFrame([(1,)], "users long"), users=users) == [(1,)]
    assert ask(spark, "WITH users AS (SELECT 5 AS id) SELECT id FROM users", users=users) == [(5,)]
    odd = spark.createDataFrame([("a\\b",), ("ab",)], "x string")
    assert ask(spark, "SELECT x FROM odd WHERE x LIKE @p", {"p": "a\\_"}, odd=odd) == [("a\\b",)]
    assert ask(spark, "SELECT EXTRACT(YEAR FROM d) AS y FROM t", t=spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date")) == [(2024,)]


def test_statements(spark, tmp_path):
    db = tables.Database(spark, f"file://{tmp_path}")
    run = lambda text, **p: dialect.execute(db, text, p)
    rows = lambda text, **p: sorted(map(tuple, run(text, **p).collect()), key=repr)
    run("CREATE TABLE Items (id INT PRIMARY KEY, label VARCHAR(20) DEFAULT 'none', price DECIMAL(10, 2), qty INT DEFAULT -1);")
    run("CREATE TABLE IF NOT EXISTS Items (id INT)")
    assert run("INSERT INTO items (id, price) VALUES (1, 2.5), (2, NULL), (3, @p)", p=7) == 3
    assert rows("SELECT id, label, qty FROM items WHERE price IS NULL") == [(2, "none", -1)]
    assert run("UPDATE items SET qty = qty + id, label = 'it''s, ok' WHERE id > 1 AND id NOT IN (@a, NULL)", a=3) == 1
    assert rows("SELECT id, label, qty FROM items WHERE id = 2") == [(2, "it's, ok", 1)]
    assert run("UPDATE items SET qty = qty / 2 WHERE id IN (SELECT MAX(id) FROM items)") == 1
    assert rows("SELECT qty FROM items WHERE id = 3") == [(0,)]
    run("CREATE TABLE copies (id BIGINT, price DOUBLE)")
    assert run("INSERT INTO copies SELECT id, price FROM items WHERE price > 2") == 2
    assert run("DELETE FROM copies WHERE price > 5") == 1 and run("DELETE FROM copies") == 1
    run("CREATE UNIQUE INDEX u ON items (id)")
    with pytest.raises(tables.TableError, match="duplicate"):
        run("INSERT INTO items (id) VALUES (9), (2)")
    run("DROP INDEX u")
    run("DROP INDEX IF EXISTS u")
    run("ALTER TABLE items DROP COLUMN label")
    run("ALTER TABLE items ADD COLUMN label INT")
    assert rows("SELECT DISTINCT label FROM items") == [(None,)]
    t = tables.Transaction(db)
    assert dialect.execute(t, "DELETE FROM items WHERE id = 1") == 1
    assert dialect.execute(t, "SELECT COUNT(*) FROM items").first()["count"] == 2 and rows("SELECT COUNT(*) FROM items") == [(3,)]
    t.commit()
    assert rows("SELECT COUNT(*) FROM items") == [(2,)]
    run("DROP TABLE items")
    run("DROP TABLE IF EXISTS items")
    for bad in ("INSERT INTO copies VALUES (1, 2", "UPDATE copies price = 2", "CREATE VIEW v", "ALTER TABLE copies RENAME x", "DELETE copies", "CREATE TABLE q (a POINT)"):
        with pytest.raises(ValueError):
            run(bad)
