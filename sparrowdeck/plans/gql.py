"""A graph query language over two frames: MATCH, OPTIONAL MATCH, WHERE, UNWIND, WITH, RETURN and UNION as joins.

Nodes are (id, labels, props), relationships (id, src, dst, type, props). A variable is a column that holds the whole node
or relationship; `a.name` reads a property, which is text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class GqlError(ValueError):
    """A text that is not accepted."""


_TOKEN = re.compile(r"""\s+|//[^\n]*|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?)|(?P<parameter>\$\w+)|(?P<word>[^\W\d]\w*|`[^`]+`)|(?P<sign><>|<=|>=|->|<-|\.\.|[-+*/%=<>(),.\[\]{}:|;])""")
# Words that begin a clause, and aggregate functions.
CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "RETURN", "WITH", "UNWIND", "ORDER", "SKIP", "LIMIT", "UNION"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
# Functions that are spelt otherwise in Spark SQL; {0} is the argument.
SPELT = {
    "collect": "collect_list({0})", "labels": "({0}).labels", "type": "({0}).type", "id": "({0}).id", "elementid": "CAST(({0}).id AS STRING)", "properties": "({0}).props",
    "keys": "array_sort(map_keys(({0}).props))", "startnode": "({0}).src", "endnode": "({0}).dst", "size": "size({0})", "head": "get({0}, 0)", "last": "element_at({0}, -1)", "tail": "slice({0}, 2, size({0}))",
    "tointeger": "CAST(try_cast({0} AS DOUBLE) AS BIGINT)", "tofloat": "try_cast({0} AS DOUBLE)", "tostring": "CAST({0} AS STRING)", "log": "ln({0})", "toupper": "upper({0})", "tolower": "lower({0})",
}


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GqlError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0].strip("`") if m.lastgroup == "word" else m[0]))
    return [t for t in out if t != ("sign", ";")]


class Query:
    """One query without UNION, read clause by clause into a frame."""

    def __init__(self, tokens: list[tuple[str, str]], nodes: DataFrame, relationships: DataFrame, parameters: Mapping[str, object]):
        self.tokens, self.at = tokens, 0
        self.nodes, self.relationships, self.parameters = nodes, relationships, parameters
        self.frame: DataFrame | None = None
        self.nameless = 0

    # -- tokens

    def is_(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1].upper() in texts

    def take(self, text: str) -> bool:
        found = self.is_(text)
        self.at += found
        return found

    def need(self, text: str) -> None:
        if not self.take(text):
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise GqlError(f"expected {text}, not {got}")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise GqlError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def hidden(self) -> str:
        self.nameless += 1
        return f"__{self.nameless}"

    # -- expressions

    def expression(self, stops: set[str]) -> tuple[str, bool]:
        """Spark SQL up to a stop word or sign outside brackets, and whether it aggregates."""
        out: list[str] = []
        depth, sums = 0, False
        while self.at < len(self.tokens):
            kind, text = self.tokens[self.at]
            if not depth and kind != "string" and text.upper() in stops:
                break
            self.at += 1
            if kind == "string":
                out.append("'" + re.sub(r"\\(.)", r"\1", text[1:-1]).replace("\\", "\\\\").replace("'", "\\'") + "'")
            elif kind == "parameter":
                if text[1:] not in self.parameters:
                    raise GqlError(f"no value for {text}")
                out.append(_literal(self.parameters[text[1:]]))
            elif kind == "word" and self.at < len(self.tokens) and self.tokens[self.at][1] == "(" and text.upper() not in ("IN", "AND", "OR", "NOT"):
                self.at += 1
                distinct = "DISTINCT " if self.take("DISTINCT") else ""
                inner: list[str] = []
                while not self.is_(")"):
                    part, deep = self.expression({",", ")"})
                    sums |= deep
                    inner.append(part)
                    if not self.take(",") and not self.is_(")"):
                        raise GqlError("a call without its end")
                self.need(")")
                name = text.lower()
                sums |= name in AGGREGATES
                given = distinct + ", ".join(inner)
                out.append(SPELT[name].format(given) if name in SPELT else f"{name}({given})")
            elif kind == "word" and self.is_(".") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "word":
                prop = self.tokens[self.at + 1][1]
                self.at += 2
                out.append(f"`{text}`.props['{prop}']" if prop != "id" else f"`{text}`.id")
            elif text == "[" and kind == "sign":
                items = []
                while not self.is_("]"):
                    items.append(self.expression({",", "]"})[0])
                    self.take(",")
                self.need("]")
                out.append(f"({', '.join(items)})" if out and out[-1].upper() == "IN" else f"array({', '.join(items)})")
            else:
                depth += (text == "(") - (text == ")")
                if depth < 0:
                    raise GqlError("unbalanced parenthesis")
                out.append(text)
        if not out:
            raise GqlError("expected an expression")
        return " ".join(out), sums

    # -- patterns

    def properties(self) -> dict[str, str]:
        out = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.word()
                self.need(":")
                out[key] = self.expression({",", "}"})[0]
                self.take(",")
        return out

    def node(self, frame: DataFrame | None, end: str | None = None) -> tuple[DataFrame, str]:
        """The frame joined with the nodes of a pattern (name:Label {key: value}); end: the column with their id."""
        self.need("(")
        name = self.word() if not self.is_(":", ")", "{") else self.hidden()
        labels = []
        while self.take(":"):
            labels.append(self.word())
        props = self.properties()
        self.need(")")
        if frame is not None and name in frame.columns:
            out = frame if end is None else frame.where(F.col(f"`{name}`.id") == F.col(end))
        else:
            nodes = self.nodes.select(F.struct("id", "labels", "props").alias(name))
            if end is not None:
                out = frame.join(nodes, F.col(end) == F.col(f"`{name}`.id"))
            else:
                out = nodes if frame is None else frame.crossJoin(nodes)
        for label in labels:
            out = out.where(F.array_contains(F.col(f"`{name}`.labels"), label))
        for key, value in props.items():
            out = out.where(F.col(f"`{name}`.props")[key] == F.expr(f"CAST({value} AS STRING)"))
        return out, name

    def chain(self, frame: DataFrame | None) -> DataFrame:
        frame, here = self.node(frame)
        while self.is_("-", "<-"):
            back = self.is_("<-")
            self.at += 1
            name, types, props = self.hidden(), [], {}
            if self.take("["):
                if not self.is_(":", "]", "{"):
                    name = self.word()
                if self.take(":"):
                    types.append(self.word())
                    while self.take("|"):
                        self.take(":")
                        types.append(self.word())
                props = self.properties()
                self.need("]")
            forward = not back and self.take("->")
            if not forward:
                self.need("-")
            edges = self.relationships.select(F.struct("id", "src", "dst", "type", "props").alias(name))
            if types:
                edges = edges.where(F.col(f"`{name}`.type").isin(types))
            for key, value in props.items():
                edges = edges.where(F.col(f"`{name}`.props")[key] == F.expr(f"CAST({value} AS STRING)"))
            a, b = self.hidden(), self.hidden()
            out_, in_ = (edges.select(name, F.col(f"`{name}`.{x}").alias(a), F.col(f"`{name}`.{y}").alias(b)) for x, y in (("src", "dst"), ("dst", "src")))
            edges = out_ if forward else in_ if back else out_.union(in_)
            frame = frame.join(edges, F.col(f"`{here}`.id") == F.col(a))
            frame, here = self.node(frame, b)
            frame = frame.drop(a, b)
        return frame

    def match(self, optional: bool) -> None:
        before = self.frame
        frame = None if optional else before
        while True:
            frame = self.chain(frame)
            if not self.take(","):
                break
        if optional:
            if self.take("WHERE"):
                frame = frame.where(self.expression(CLAUSES)[0])
            frame = frame.select(*[c for c in frame.columns if not c.startswith("__")])
            shared = [c for c in frame.columns if c in before.columns]
            renamed = frame.select(*[F.col(f"`{c}`").alias(f"__o_{c}" if c in shared else c) for c in frame.columns])
            on = [F.col(f"`{c}`.id") == F.col(f"`__o_{c}`.id") for c in shared] or [F.lit(True)]
            frame = before.join(renamed, on, "left").drop(*[f"__o_{c}" for c in shared])
        self.frame = frame

    # -- clauses

    def projection(self, stops: set[str]) -> None:
        """Items of WITH or RETURN; where some aggregate, the others are what is grouped by."""
        distinct = self.take("DISTINCT")
        items: list[tuple[str, str, bool]] = []
        while True:
            if self.take("*"):
                items += [(f"`{c}`", c, False) for c in self.frame.columns if not c.startswith("__")]
            else:
                begin = self.at
                text, sums = self.expression({",", "AS"} | stops)
                plain = "".join(t for _, t in self.tokens[begin : self.at])
                items.append((text, self.word() if self.take("AS") else plain, sums))
            if not self.take(","):
                break
        frame = self.frame if self.frame is not None else self.nodes.sparkSession.range(1)
        if any(s for _, _, s in items):
            groups = [F.expr(t).alias(n) for t, n, s in items if not s]
            frame = frame.groupBy(*groups).agg(*[F.expr(t).alias(n) for t, n, s in items if s]).select(*[F.col(f"`{n}`") for _, n, _ in items])
        else:
            frame = frame.select(*[F.expr(t).alias(n) for t, n, _ in items])
        self.frame = frame.distinct() if distinct else frame
        if self.take("ORDER"):
            self.need("BY")
            order = []
            while True:
                text, _ = self.expression({",", "ASC", "DESC", "SKIP", "LIMIT"} | stops)
                if text.replace(" ", "") in self.frame.columns:
                    text = f"`{text.replace(' ', '')}`"
                order.append(F.expr(text).desc() if self.take("DESC") else F.expr(text).asc())
                self.take("ASC")
                if not self.take(","):
                    break
            self.frame = self.frame.orderBy(*order)
        if self.take("SKIP"):
            self.frame = self.frame.offset(self.count())
        if self.take("LIMIT"):
            self.frame = self.frame.limit(self.count())

    def count(self) -> int:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        value = self.parameters.get(text[1:]) if kind == "parameter" else int(text) if text.isdigit() else None
        if not isinstance(value, int):
            raise GqlError("expected a number of rows")
        return value

    def run(self) -> DataFrame:
        while self.at < len(self.tokens):
            if self.take("RETURN"):
                self.projection(CLAUSES)
                if self.at < len(self.tokens):
                    raise GqlError(f"unexpected {self.tokens[self.at][1]} after RETURN")
                return self.frame
            if self.take("OPTIONAL"):
                self.need("MATCH")
                if self.frame is None:
                    raise GqlError("OPTIONAL MATCH comes after a match")
                self.match(True)
            elif self.take("MATCH"):
                self.match(False)
            elif self.take("WHERE"):
                self.frame = self.frame.where(self.expression(CLAUSES)[0])
            elif self.take("UNWIND"):
                text, _ = self.expression({"AS"})
                self.need("AS")
                name = self.word()
                frame = self.frame if self.frame is not None else self.nodes.sparkSession.range(1).select(F.lit(1).alias("__one"))
                self.frame = frame.withColumn(name, F.explode(F.expr(text)))
            elif self.take("WITH"):
                self.projection(CLAUSES)
            else:
                raise GqlError(f"unexpected {self.tokens[self.at][1]}")
        raise GqlError("a query ends with RETURN")


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def query(text: str, nodes: DataFrame, relationships: DataFrame, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """Run a query over a graph. Patterns are equi-joins of nodes and relationships by id; a comma between patterns that
    share no variable is the only cross join."""
    parts: list[list[tuple[str, str]]] = [[]]
    every: list[bool] = []
    tokens = tokenize(text)
    at = 0
    while at < len(tokens):
        if tokens[at][0] == "word" and tokens[at][1].upper() == "UNION":
            every.append(at + 1 < len(tokens) and tokens[at + 1][1].upper() == "ALL")
            at += every[-1]
            parts.append([])
        else:
            parts[-1].append(tokens[at])
        at += 1
    out = None
    for k, part in enumerate(parts):
        one = Query(part, nodes, relationships, parameters or {}).run()
        out = one if out is None else out.union(one) if every[k - 1] else out.union(one).distinct()
    return out


# ---- queries over regions, nations and customers


def over_geography(text: str, parameters: Mapping[str, object] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        node = lambda id_, label, *props: F.struct(id_.cast("long").alias("id"), F.array(F.lit(label)).alias("labels"), F.create_map(*[x for k, v in props for x in (F.lit(k), F.col(v).cast("string"))]).alias("props")).alias("n")
        n_id, c_id = F.col("n_nationkey") + 1_000_000_000, F.col("c_custkey") + 2_000_000_000
        nodes = read("region").select(node(F.col("r_regionkey"), "Region", ("name", "r_name")))
        nodes = nodes.union(read("nation").select(node(n_id, "Nation", ("name", "n_name"))))
        nodes = nodes.union(read("customer").select(node(c_id, "Customer", ("name", "c_name"), ("balance", "c_acctbal"), ("segment", "c_mktsegment"))))
        edge = lambda id_, a, b, kind: F.struct(id_.cast("long").alias("id"), a.cast("long").alias("src"), b.cast("long").alias("dst"), F.lit(kind).alias("type"), F.create_map(F.lit("k"), F.lit("v")).alias("props")).alias("e")
        edges = read("nation").select(edge(n_id, F.col("n_regionkey"), n_id, "HAS")).union(read("customer").select(edge(c_id, F.col("c_nationkey") + 1_000_000_000, c_id, "SERVES")))
        return query(text, nodes.select("n.*"), edges.select("e.*"), parameters)

    return run


QUERIES = {
    "gql_match": over_geography("MATCH (r:Region)-[:HAS]->(n:Nation)-[s:SERVES]->(c:Customer {segment: 'BUILDING'}) WHERE toFloat(c.balance) > $least RETURN r.name AS region, n.name AS nation, c.id AS customer, type(s) AS kind", {"least": 1000}),
    "gql_aggregate": over_geography("MATCH (c:Customer)<-[:SERVES]-(n) RETURN n.name AS nation, count(*) AS n, count(DISTINCT c.segment) AS segments, size(collect(c.name)) AS names"),
    "gql_optional": over_geography("MATCH (n:Nation) OPTIONAL MATCH (n)-[:SERVES]->(c) WHERE toFloat(c.balance) > 9000 RETURN n.name AS nation, count(c) AS rich"),
    "gql_with_order": over_geography("MATCH (n:Nation)-[:SERVES]->(c) WITH n.name AS nation, count(*) AS k WHERE k > 1 RETURN nation, k ORDER BY k DESC, nation SKIP 2 LIMIT 5"),
    "gql_union": over_geography("MATCH (r:Region) RETURN r.name AS name UNION MATCH (n:Nation) WHERE n.name IN ['NATION_1', 'NATION_2'] RETURN n.name AS name UNION MATCH (x:Region) RETURN x.name AS name"),
    "gql_unwind": over_geography("UNWIND [3, 1, 2] AS k MATCH (r:Region) WHERE r.id < k RETURN k, count(*) AS n"),
}
_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
ORACLES = {
    "gql_match": f"SELECT r_name AS region, n_name AS nation, c_custkey + 2000000000::BIGINT AS customer, 'SERVES' AS kind FROM {_CUSTOMERS} WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000",
    "gql_aggregate": f"SELECT n_name AS nation, count(*) AS n, count(DISTINCT c_mktsegment) AS segments, count(*)::INTEGER AS names FROM {_CUSTOMERS} GROUP BY n_nationkey, n_name",
    "gql_optional": "SELECT n_name AS nation, count(c_custkey) AS rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey, n_name",
    "gql_with_order": f"SELECT n_name AS nation, count(*) AS k FROM {_CUSTOMERS} GROUP BY n_nationkey, n_name HAVING count(*) > 1 ORDER BY k DESC, nation LIMIT 5 OFFSET 2",
    "gql_union": "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation WHERE n_name IN ('NATION_1', 'NATION_2')",
    "gql_unwind": "SELECT k::INTEGER AS k, count(*) AS n FROM unnest([3, 1, 2]) AS t(k) JOIN region ON r_regionkey < k GROUP BY k",
}
