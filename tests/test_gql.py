"""The graph query language on a small graph."""

import pytest

from sparrowdeck.operators import graph
from sparrowdeck.plans import gql


@pytest.fixture(scope="module")
def ask(spark):
    nodes = spark.createDataFrame([(1, ["P"], {"name": "Ada", "age": "36"}), (2, ["P"], {"name": "Grace", "age": "45"}), (3, ["P", "X"], {"name": "Alan"}), (4, ["C"], {"name": "Oslo"})], graph.NODES)
    edges = spark.createDataFrame([(10, 1, 2, "KNOWS", {"since": "1"}), (11, 2, 3, "KNOWS", {"since": "2"}), (12, 3, 1, "KNOWS", {}), (13, 1, 4, "LIVES", {}), (14, 3, 4, "LIVES", {})], graph.RELATIONSHIPS)
    return lambda text, **p: sorted(map(tuple, gql.query(text, nodes, edges, p).collect()), key=repr)


def test_patterns(ask):
    assert ask("MATCH (a:P)-[:KNOWS]->(b) RETURN a.name, b.name") == [("Ada", "Grace"), ("Alan", "Ada"), ("Grace", "Alan")]
    assert ask("MATCH (a)<-[r:KNOWS {since: 2}]-(b) RETURN a.id AS a, id(r) AS r, b.id AS b;") == [(3, 11, 2)]
    assert ask("MATCH (a {name: 'Ada'})--(b) RETURN b.id") == [(2,), (3,), (4,)]
    assert ask("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c)-[:KNOWS]->(a) RETURN a.id, c.id") == [(1, 3), (2, 1), (3, 2)]
    assert ask("MATCH (a)-[:LIVES]->(c), (b)-[:LIVES]->(c) WHERE a.id < b.id RETURN a.name, b.name, c.name") == [("Ada", "Alan", "Oslo")]
    assert ask("MATCH (a)-[r:KNOWS|LIVES]->() WHERE a.id = $i RETURN type(r) AS t", i=1) == [("KNOWS",), ("LIVES",)]
    assert ask("MATCH (n:X) RETURN labels(n) AS l, keys(n) AS k") == [(["P", "X"], ["name"])]


def test_clauses(ask):
    assert ask("MATCH (a:P) OPTIONAL MATCH (a)-[:LIVES]->(c) RETURN a.name AS a, c.name AS c") == [("Ada", "Oslo"), ("Alan", "Oslo"), ("Grace", None)]
    assert ask("MATCH (a:P) WHERE a.age IS NOT NULL AND toInteger(a.age) IN [36, 40] RETURN a.name") == [("Ada",)]
    assert ask("MATCH (a)-[:KNOWS]->(b) WITH b, count(*) AS n WHERE n = 1 RETURN sum(n) AS s") == [(3,)]
    assert ask("MATCH (a:P) RETURN a.name AS name ORDER BY name DESC SKIP 1 LIMIT $n", n=1) == [("Alan",)]
    assert ask("UNWIND [1, 2] AS x RETURN x + 1 AS y") == [(2,), (3,)]
    assert ask("RETURN 'it\\'s' AS s UNION ALL RETURN 'it\\'s' AS s") == [("it's",), ("it's",)]
    assert ask("RETURN 1 AS s UNION RETURN 1 AS s") == [(1,)]
    assert ask("MATCH (a:P) RETURN DISTINCT size(collect(a.name)) AS n, count(DISTINCT a.age) AS k") == [(3, 2)]


@pytest.mark.parametrize("text", ["MATCH (a)", "MATCH (a RETURN a", "RETURN $x", "OPTIONAL MATCH (a) RETURN a", "MATCH (a) RETURN a.name LIMIT x", "DELETE a", "RETURN 1 MATCH (a)", "RETURN"])
def test_errors(ask, text):
    with pytest.raises(gql.GqlError):
        ask(text)
