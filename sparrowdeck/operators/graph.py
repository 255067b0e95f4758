"""Property graphs as two frames, documents as a versioned frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

NODES = "id long, labels array<string>, props map<string,string>"
RELATIONSHIPS = "id long, src long, dst long, type string, props map<string,string>"


def create_node(nodes: DataFrame, id_: int, labels: list[str], props: dict[str, str] | None = None) -> DataFrame:
    if nodes.where(F.col("id") == id_).limit(1).count():
        raise ValueError(f"node {id_} exists")
    return nodes.unionByName(nodes.sparkSession.createDataFrame([(id_, labels, props or {})], NODES))


def get_node(nodes: DataFrame, id_: int) -> DataFrame:
    """The node of an id, or no row."""
    return nodes.where(F.col("id") == id_)


def create_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes and new ones, in one plan; an id that is there already, or twice among the new ones, fails when it is read."""
    both = nodes.unionByName(new).groupBy("id").agg(F.first("labels").alias("labels"), F.first("props").alias("props"), F.count(F.lit(1)).alias("n"))
    return both.select(F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("node exists: "), F.col("id")))).alias("id"), "labels", "props")


def delete_node(nodes: DataFrame, relationships: DataFrame, id_: int) -> tuple[DataFrame, DataFrame]:
    """Nodes without one, and relationships without those that touch it."""
    return nodes.where(F.col("id") != id_), relationships.where((F.col("src") != id_) & (F.col("dst") != id_))


def create_relationship(nodes: DataFrame, relationships: DataFrame, id_: int, src: int, dst: int, type_: str, props: dict[str, str] | None = None) -> DataFrame:
    if nodes.where(F.col("id").isin(src, dst)).select("id").distinct().count() != len({src, dst}):
        raise ValueError("both ends have to exist")
    return relationships.unionByName(relationships.sparkSession.createDataFrame([(id_, src, dst, type_, props or {})], RELATIONSHIPS))


def delete_relationship(relationships: DataFrame, id_: int) -> DataFrame:
    return relationships.where(F.col("id") != id_)


def match(nodes: DataFrame, relationships: DataFrame, steps: list[tuple[str, str | None, str]], optional: bool = False) -> DataFrame:
    """Rows of a chain (a)-[:type]->(b)-[:type]->(c): steps name the two nodes and give the type (none: any) between them.

    A column for each node's id, and r1, r2, ... for the relationships. optional keeps rows whose later steps find none.
    """
    out = nodes.select(F.col("id").alias(steps[0][0]))
    for k, (a, kind, b) in enumerate(steps, 1):
        step = relationships if kind is None else relationships.where(F.col("type") == kind)
        step = step.select(F.col("src").alias("__src"), F.col("dst").alias(b), F.col("id").alias(f"r{k}"))
        out = out.join(step, F.col(a) == F.col("__src"), "left" if optional else "inner").drop("__src")
    return out


def traverse(relationships: DataFrame, start: DataFrame, direction: str = "out", type_: str | None = None, max_depth: int = 1) -> DataFrame:
    """(id, depth) of the nodes within max_depth steps of the start nodes (a frame with id), by least depth.

    Each step joins the frontier with the edges and drops what was reached before, so cycles end; its lineage is cut.
    """
    if direction not in ("out", "in", "both") or max_depth < 0:
        raise ValueError("direction is out, in or both, and the depth is not negative")
    edges = relationships if type_ is None else relationships.where(F.col("type") == type_)
    out, back = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    edges = {"out": out, "in": back, "both": out.union(back)}[direction]
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        if depth < max_depth:
            frontier = cut(frontier)
        seen = seen.union(frontier)
    return seen


def get_document(documents: DataFrame, id_: str) -> DataFrame:
    """The document of an id, or no row."""
    return documents.where(F.col("id") == id_)


def put_documents(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace many (id, content, and an optional column expected) in one pass: each gets the next version, and
    one whose expected version (0: absent, null: any) is not the current one stays as it is."""
    if "expected" not in changes.columns:
        changes = changes.withColumn("expected", F.lit(None).cast("long"))
    both = documents.join(changes.select(F.col("id").alias("k"), F.col("content").alias("c"), "expected"), F.col("id") == F.col("k"), "full")
    now = F.coalesce("version", F.lit(0).cast("long"))
    applies = F.col("k").isNotNull() & (F.col("expected").isNull() | (F.col("expected") == now))
    out = both.select(F.coalesce("id", "k").alias("id"), F.when(applies, F.col("c")).otherwise(F.col("content")).alias("content"), F.when(applies, now + 1).otherwise(F.col("version")).alias("version"))
    return out.where("version IS NOT NULL")


def put_document(documents: DataFrame, id_: str, content: str, expected_version: int | None = None) -> DataFrame:
    """Insert or replace (id, content, version); an expected version (0: absent) has to be the current one."""
    now = documents.where(F.col("id") == id_).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    if expected_version is not None and now != expected_version:
        raise ValueError(f"version of {id_} is {now}")
    row = documents.sparkSession.createDataFrame([(id_, content, now + 1)], "id string, content string, version long")
    return documents.where(F.col("id") != id_).unionByName(row)


def delete_document(documents: DataFrame, id_: str, expected_version: int | None = None) -> DataFrame:
    now = documents.where(F.col("id") == id_).agg(F.max("version")).first()[0]
    if expected_version is not None and now != expected_version:
        raise ValueError(f"version of {id_} is {now}")
    return documents.where(F.col("id") != id_)


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as relationships."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("src"), (F.col("n_nationkey") + 1_000_000_000).cast("long").alias("dst"), F.lit("HAS").alias("type"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + 2_000_000_000).alias("id"), (F.col("c_nationkey") + 1_000_000_000).cast("long").alias("src"), (F.col("c_custkey") + 2_000_000_000).alias("dst"), F.lit("SERVES").alias("type"))
    return n.union(c)


def _from_region(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    return traverse(geography(spark, sf_dir), spark.createDataFrame([(1,)], "id long"), **options)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("id"), F.array(F.lit("Region")).alias("labels"), F.create_map(F.lit("name"), F.col("r_name")).alias("props"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.create_map(F.lit("name"), F.col("n_name")).alias("props"))
    return create_nodes(r, n)


def nodes_and_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node created, one got, one deleted with its relationships, and a relationship deleted."""
    nodes, edges = _nodes(spark, sf_dir), geography(spark, sf_dir).where("type = 'HAS'").withColumn("props", F.expr("CAST(map() AS MAP<STRING, STRING>)"))
    nodes = create_node(nodes, 77, ["Region"], {"name": "NEW"})
    edges = create_relationship(nodes, edges, 5, 77, 1_000_000_003, "HAS")
    nodes, edges = delete_node(nodes, edges, 2)
    edges = delete_relationship(edges, 1_000_000_000)
    counted = edges.groupBy(F.col("src").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    found = nodes.where("id < 100")
    return found.join(counted, F.col("id") == F.col("s"), "left").select("id", F.col("props")["name"].alias("name"), F.coalesce("n", F.lit(0)).alias("n"), (F.lit(get_node(nodes, 77).count())).cast("long").alias("got"))


def documents_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after a batch with expected versions; one of them is got."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    docs = e.where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("id"), F.col("props").alias("content"), (F.col("event_id") % 5 + 1).alias("version"))
    changes = e.where("event_id % 3 = 0").select(F.col("event_id").cast("string").alias("id"), F.lit("new").alias("content"), F.when(F.col("event_id") % 4 == 0, 2).when(F.col("event_id") % 4 == 1, 0).cast("long").alias("expected"))
    out = put_documents(docs, changes)
    return out.withColumn("got", F.lit(get_document(out, "6").count()).cast("long"))


QUERIES = {
    "graph_nodes": nodes_and_edges,
    "documents_put": documents_put,
    "graph_match_chain": lambda s, d: match(_nodes(s, d), geography(s, d), [("region", "HAS", "nation"), ("nation", "SERVES", "customer")]).select("region", "nation", "customer"),
    "graph_match_optional": lambda s, d: match(_nodes(s, d), geography(s, d), [("a", "SERVES", "b")], optional=True).groupBy("a").agg(F.count("b").alias("n")),
    "graph_traverse": lambda s, d: _from_region(s, d, max_depth=3),
    "graph_traverse_typed": lambda s, d: _from_region(s, d, max_depth=3, type_="HAS"),
    "graph_traverse_both": lambda s, d: _from_region(s, d, max_depth=2, direction="both"),
    "graph_match": lambda s, d: geography(s, d).where("type = 'HAS'").alias("a").join(geography(s, d).where("type = 'SERVES'").alias("b"), F.expr("a.dst = b.src")).groupBy(F.col("a.src").alias("region")).agg(F.count(F.lit(1)).alias("customers")),
}
_EDGES = "(SELECT n_regionkey::BIGINT AS src, n_nationkey + 1000000000::BIGINT AS dst, 'HAS' AS type FROM nation UNION ALL SELECT c_nationkey + 1000000000::BIGINT, c_custkey + 2000000000::BIGINT, 'SERVES' FROM customer)"
ORACLES = {
    "graph_nodes": "SELECT r_regionkey::BIGINT AS id, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey <> 0) AS n, 1::BIGINT AS got FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 77, 'NEW', 1, 1",
    "documents_put": """WITH x AS (SELECT event_id, event_id % 2 = 0 AS old, event_id % 3 = 0 AS chg, event_id % 5 + 1 AS v, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS expected, props FROM events),
      y AS (SELECT *, chg AND (expected IS NULL OR expected = CASE WHEN old THEN v ELSE 0 END) AS hit FROM x)
      SELECT event_id::VARCHAR AS id, CASE WHEN hit THEN 'new' ELSE props END AS content, CASE WHEN hit AND old THEN v + 1 WHEN hit THEN 1 ELSE v END AS version, 1::BIGINT AS got FROM y WHERE old OR hit""",
    "graph_match_chain": "SELECT n_regionkey::BIGINT AS region, n_nationkey + 1000000000::BIGINT AS nation, c_custkey + 2000000000::BIGINT AS customer FROM nation JOIN customer ON n_nationkey = c_nationkey",
    "graph_match_optional": "SELECT a, count(c_custkey) AS n FROM (SELECT r_regionkey::BIGINT AS a, NULL AS k FROM region UNION ALL SELECT n_nationkey + 1000000000::BIGINT, n_nationkey FROM nation) LEFT JOIN customer ON c_nationkey = k GROUP BY a",
    "graph_traverse": f"WITH RECURSIVE e AS {_EDGES}, t(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM t JOIN e ON src = id WHERE depth < 3) SELECT id, min(depth)::INTEGER AS depth FROM t GROUP BY id",
    "graph_traverse_typed": f"WITH RECURSIVE e AS {_EDGES}, t(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM t JOIN e ON src = id AND type = 'HAS' WHERE depth < 3) SELECT id, min(depth)::INTEGER AS depth FROM t GROUP BY id",
    "graph_traverse_both": f"WITH RECURSIVE e AS {_EDGES}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), t(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM t JOIN b ON src = id WHERE depth < 2) SELECT id, min(depth)::INTEGER AS depth FROM t GROUP BY id",
    "graph_match": "SELECT n_regionkey::BIGINT AS region, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1",
}
