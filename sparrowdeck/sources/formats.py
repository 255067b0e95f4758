"""Readers and text sources: path/value pairs of JSON, INI and XML, lines, tokens, encodings, YAML scalars, listings."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIRS = "id string, path string, value string"


# ---- configuration texts as path/value pairs


def json_pairs(text: str) -> list[tuple[str, str | None]]:
    """Leaves of an object by path; array indexes are segments; empty objects and arrays are null."""

    def unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
        out = dict(pairs)
        if len({k.lower() for k in out}) != len(pairs):
            raise ValueError("duplicate path")
        return out

    root = json.loads(text, object_pairs_hook=unique, parse_float=str, parse_int=str)
    if not isinstance(root, dict):
        raise ValueError("the root has to be an object")

    def walk(path: str, x: object) -> Iterator[tuple[str, str | None]]:
        items = list(x.items()) if isinstance(x, dict) else [(str(i), v) for i, v in enumerate(x)] if isinstance(x, list) else None
        if items:
            for k, v in items:
                yield from walk(f"{path}:{k}" if path else k, v)
        elif path:
            yield path, None if items is not None or x is None else str(x).lower() if isinstance(x, bool) else str(x)

    return list(walk("", root))


def ini_pairs(text: str) -> list[tuple[str, str | None]]:
    """Assignments by section and key; the last value of a path wins."""
    section, out = [], {}
    for n, raw in enumerate(re.split("\r\n|\n|\r", text.lstrip("﻿")), 1):
        line = raw.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[":
            names = [s.strip() for s in line[1:-1].split(":")]
            if line[-1] != "]" or not all(names):
                raise ValueError(f"line {n}: bad section {line}")
            section = names
            continue
        key, equals, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not equals or not key:
            raise ValueError(f"line {n}: expected key = value")
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[":".join([*section, key])] = value
    return list(out.items())


def xml_pairs(text: str) -> list[tuple[str, str | None]]:
    """Elements and attributes by path below the root. A Name attribute adds a segment; repeated siblings get an index."""
    if re.search(r"<!DOCTYPE", text, re.I):
        raise ValueError("document types are not accepted")
    out: dict[str, str | None] = {}

    known: set[str] = set()

    def put(path: list[str], value: str | None) -> None:
        key = ":".join(path)
        if key.lower() in known:
            raise ValueError(f"duplicate path {key}")
        known.add(key.lower())
        out[key] = value

    def walk(path: list[str], x: ElementTree.Element) -> None:
        body = "".join([x.text or "", *(c.tail or "" for c in x)]).strip()
        for k, v in x.attrib.items():
            if k.startswith("{"):
                raise ValueError("attribute namespaces are not accepted")
            if path or k.lower() != "name":
                put([*path, k], v)
        children = list(x)
        if body and (children or any(k.lower() != "name" for k in x.attrib)):
            raise ValueError(f"text mixed with other content at {':'.join(path)}")
        if body or (path and not children and not x.attrib):
            put(path, body or None)
        names = [(c.tag.lower(), next((v.lower() for k, v in c.attrib.items() if k.lower() == "name"), None)) for c in children]
        seen: dict[tuple, int] = {}
        for c, n in zip(children, names, strict=True):
            step = [*path, c.tag]
            name = next((v for k, v in c.attrib.items() if k.lower() == "name"), None)
            if name is not None:
                step.append(name)
            if names.count(n) > 1:
                step.append(str(seen.get(n, 0)))
                seen[n] = seen.get(n, 0) + 1
            walk(step, c)

    walk([], ElementTree.fromstring(text))
    return list(out.items())


def pairs(df: DataFrame, id_: str, text: str, format_: str, errors: bool = False) -> DataFrame:
    """(id, path, value) of each text of a format: json, ini, xml or yaml; a null text has none.

    A bad text ends the job, or with `errors` gives one row without a path whose column `error` says what is wrong.
    """
    from . import yaml

    read = {"json": json_pairs, "ini": ini_pairs, "xml": xml_pairs, "yaml": yaml.pairs}[format_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    rows += [(i, p, v, None) for p, v in read(t)] if t is not None else []
                except (ValueError, ElementTree.ParseError) as e:
                    if not errors:
                        raise
                    rows.append((i, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4 if errors else 3)], names=["id", "path", "value", "error"][: 4 if errors else 3])

    return df.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, PAIRS + ", error string" * errors)


def flat_json_pairs(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, path, value) of JSON objects without nesting, by built-in functions only."""
    return df.select(F.col(id_).alias("id"), F.explode(F.from_json(text, "map<string,string>")).alias("path", "value"))


# ---- texts


def lines(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, n, line), n from 0; lines end with LF, CRLF or CR. An end of line at the end of the text adds no line."""
    body = F.regexp_replace(text, r"(\r\n|\n|\r)\z", "")
    return df.where(F.length(text) > 0).select(F.col(id_).alias("id"), F.posexplode(F.split(body, r"\r\n|\n|\r")).alias("n", "line"))


def delimited(text: Column, delimiter: str) -> Column:
    """Tokens between a delimiter."""
    return F.split(text, re.escape(delimiter))


def tokens(df: DataFrame, id_: str, text: str, definitions: dict[str, str], whitespace: bool = False) -> DataFrame:
    """(id, n, kind, name, value, offset) of the tokens of a text: literals that are defined by name, of which the longest
    that fits counts, runs of spaces and tabs if asked for, and the text between them. Nothing of the text is lost."""
    literals = sorted(definitions.items(), key=lambda x: (-len(x[1]), x[0]))
    signs = "|".join(re.escape(v) for _, v in literals)
    ends = "|".join([*([signs] if signs else []), *(["[ \\t]"] if whitespace else [])])
    pattern = "(?s)" + "|".join([*([signs] if signs else []), *(["[ \\t]+"] if whitespace else []), f"(?:(?!{ends}).)+" if ends else ".+"])
    rows = df.select(F.col(id_).alias("id"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(0))).alias("n", "value"))
    name = F.coalesce(*[F.when(F.col("value") == v, F.lit(k)) for k, v in literals]) if literals else F.lit(None).cast("string")
    kind = F.when(name.isNotNull(), "literal")
    kind = kind.when(F.col("value").rlike(r"^[ \t]+$"), "whitespace") if whitespace else kind
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("id", F.col("n").cast("long").alias("n"), kind.otherwise("text").alias("kind"), name.alias("name"), "value", F.coalesce(F.sum(F.length("value")).over(before), F.lit(0)).cast("long").alias("offset"))


def encoding(content: Column) -> Column:
    """Encoding of a binary by its byte order mark, else by where its null bytes are, else UTF-8."""
    h = lambda n: F.hex(F.substring(content, 1, n))
    four = h(4)
    at = lambda i: F.substring(four, 2 * i + 1, 2)
    has4 = F.length(content) >= 4
    return (
        F.when(four == "0000FEFF", "utf-32-be")
        .when(four == "FFFE0000", "utf-32-le")
        .when(h(3) == "EFBBBF", "utf-8")
        .when(h(2) == "FEFF", "utf-16-be")
        .when(h(2) == "FFFE", "utf-16-le")
        .when(has4 & (h(3) == "000000") & (at(3) != "00"), "utf-32-be")
        .when(has4 & (at(0) != "00") & (F.substring(four, 3, 6) == "000000"), "utf-32-le")
        .when((F.length(content) >= 2) & (at(0) == "00") & (at(1) != "00"), "utf-16-be")
        .when((F.length(content) >= 2) & (at(0) != "00") & (at(1) == "00"), "utf-16-le")
        .otherwise("utf-8")
    )


# The forms of the YAML core schema's scalars.
YAML_NULL = r"^(~|null|Null|NULL|)$"
YAML_BOOLEAN = r"^(true|True|TRUE|false|False|FALSE)$"
YAML_INTEGER = r"^([-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$"
YAML_FLOAT = r"^([-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN))$"


def yaml_kind(scalar: Column) -> Column:
    return F.when(scalar.rlike(YAML_NULL), "null").when(scalar.rlike(YAML_BOOLEAN), "boolean").when(scalar.rlike(YAML_INTEGER), "integer").when(scalar.rlike(YAML_FLOAT), "float").otherwise("string")


def yaml_integer(scalar: Column) -> Column:
    return (
        F.when(scalar.startswith("0x"), F.conv(F.substring(scalar, 3, 64), 16, 10).cast("long"))
        .when(scalar.startswith("0o"), F.conv(F.substring(scalar, 3, 64), 8, 10).cast("long"))
        .otherwise(scalar.try_cast("long"))
    )


# ---- listings


def blobs(spark: SparkSession, folder: str, prefix: str = "", include: str | Sequence[str] = (), exclude: str | Sequence[str] = ()) -> DataFrame:
    """(path, modificationTime, length, content, name) of the files below a folder whose name there begins with a prefix,
    matches one of the globs to include (all if there are none) and none of those to exclude.

    A glob without a slash is for the last part of a name; ** goes over folders. Names are chosen from a listing, and only
    chosen files are read. The names come to the driver, where Spark lists files anyway.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    name = F.regexp_extract("path", re.escape(folder.rstrip("/").split("://")[-1]) + "/(.*)$", 1)
    listed = reader.load(folder).select("path", name.alias("name")).where(F.col("name").startswith(prefix))
    some = lambda globs: [globs] if isinstance(globs, str) else list(globs)
    one = lambda glob: F.col("name").rlike(glob_pattern(glob if "/" in glob else f"**/{glob}"))
    if some(include):
        listed = listed.where(reduce(or_, map(one, some(include))))
    for glob in some(exclude):
        listed = listed.where(~one(glob))
    chosen = [r["path"] for r in listed.select("path").collect()]
    df = reader.load(chosen) if chosen else reader.load(folder).where(F.lit(False))
    return df.withColumn("name", name)


def glob_pattern(glob: str) -> str:
    out = re.escape(glob).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def manifest(spark: SparkSession, folder: str, include: str | Sequence[str] = ()) -> DataFrame:
    """(name, hash) of the files of a folder."""
    return blobs(spark, folder, include=include).select("name", F.sha2("content", 256).alias("hash"))


def migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, change) between two manifests: added, removed or changed."""
    both = old.select("name", F.col("hash").alias("a")).join(new.select("name", F.col("hash").alias("b")), "name", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("name", change.alias("change")).where("change IS NOT NULL")


def row_frames(df: DataFrame, size: int = 1000) -> Iterator[tuple[str, object]]:
    """A result as frames for a client: ("header", [(name, type)]), ("rows", up to `size` rows) as they come, and
    ("complete", number of rows). One partition at a time is on the driver."""
    yield "header", [(f.name, f.dataType.simpleString()) for f in df.schema]
    held: list[tuple] = []
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(row))
        n += 1
        if len(held) == size:
            yield "rows", held
            held = []
    if held:
        yield "rows", held
    yield "complete", n


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a client puts them together from frames."""
    got = list(row_frames(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"), 7))
    rows = [r for kind, part in got if kind == "rows" for r in part]
    if got[-1] != ("complete", len(rows)):
        raise ValueError("rows are missing")
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in got[0][1]))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested JSON, some of it broken."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    good = F.concat(F.lit('{"key": '), F.col("o_orderkey").cast("string"), F.lit(', "who": {"id": '), F.col("o_custkey").cast("string"), F.lit(', "tags": ["a", true, null, {}]}, "none": []}'))
    twice = F.lit('{"a": 1, "A": 2}')
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("[1]")).when(F.col("o_orderkey") % 7 == 1, F.lit("{")).when(F.col("o_orderkey") % 7 == 2, twice).when(F.col("o_orderkey") % 7 > 3, good).alias("text"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the encodings, with and without byte order marks."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 7).alias("k"), "c_name")
    wide = F.expr("unhex(regexp_replace(hex(encode(c_name, 'UTF-8')), '(..)', '000000$1'))")
    kinds = [F.encode("c_name", "UTF-8"), F.expr("concat(X'EFBBBF', encode(c_name, 'UTF-8'))"), F.expr("concat(X'FEFF', encode(c_name, 'UTF-16BE'))"), F.expr("concat(X'FFFE', encode(c_name, 'UTF-16LE'))"), F.encode("c_name", "UTF-16BE"), F.encode("c_name", "UTF-16LE"), wide]
    content = F.coalesce(*[F.when(F.col("k") == i, x) for i, x in enumerate(kinds)])
    return c.select("c_custkey", content.alias("content"))


QUERIES = {
    "row_frames": _framed,
    "json_pairs_nested": lambda s, d: pairs(_nested(s, d), "o_orderkey", "text", "json", errors=True).select("id", "path", "value", F.col("error").isNotNull().alias("bad")),
    "tokens": lambda s, d: tokens(s.read.parquet(f"{d}/part.parquet").withColumn("t", F.concat_ws("=>", "p_name", "p_type", F.lit("=x="))), "p_partkey", "t", {"arrow": "=>", "equals": "="}, whitespace=True),
    "text_lines": lambda s, d: lines(_docs(s, d), "doc_id", "text").select("id", F.col("n").cast("long").alias("n"), "line"),
    "json_flatten": lambda s, d: flat_json_pairs(s.read.parquet(f"{d}/events.parquet"), "event_id", "props"),
    "json_pairs": lambda s, d: pairs(s.read.parquet(f"{d}/events.parquet"), "event_id", "props", "json"),
    "delimited_tokens": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.explode(delimited(F.col("p_type"), " ")).alias("token")),
    "encodings": lambda s, d: _marked(s, d).select("c_custkey", encoding(F.col("content")).alias("encoding")),
    "yaml_kinds": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", yaml_kind(F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.col("event_id").cast("string"))).alias("kind")),
}
ORACLES = {
    "row_frames": "SELECT n_nationkey, n_name FROM nation",
    "json_pairs_nested": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), p AS (SELECT k, unnest([{'p': 'key', 'v': k::VARCHAR}, {'p': 'who:id', 'v': c::VARCHAR}, {'p': 'who:tags:0', 'v': 'a'}, {'p': 'who:tags:1', 'v': 'true'}, {'p': 'who:tags:2', 'v': NULL}, {'p': 'who:tags:3', 'v': NULL}, {'p': 'none', 'v': NULL}]) AS x FROM o WHERE k % 7 > 3)
      SELECT k::VARCHAR AS id, x.p AS path, x.v AS value, FALSE AS bad FROM p UNION ALL SELECT k::VARCHAR, NULL, NULL, TRUE FROM o WHERE k % 7 < 3""",
    "tokens": r"""WITH t AS (SELECT p_partkey AS id, regexp_extract_all(p_name || '=>' || p_type || '=>' || '=x=', '=>|=|[ \t]+|[^= \t]+') AS xs FROM part), u AS (SELECT id, n - 1 AS n, xs[n] AS value FROM t, unnest(range(1, len(xs) + 1)) AS r(n))
      SELECT id, n, CASE WHEN value IN ('=>', '=') THEN 'literal' WHEN regexp_full_match(value, '[ \t]+') THEN 'whitespace' ELSE 'text' END AS kind, CASE value WHEN '=>' THEN 'arrow' WHEN '=' THEN 'equals' END AS name, value, coalesce(sum(length(value)) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM u""",
    "text_lines": r"SELECT doc_id AS id, n - 1 AS n, l[n] AS line FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') AS l FROM documents WHERE length(text) > 0), unnest(range(1, len(l) + 1)) AS t(n)",
    "json_flatten": "SELECT event_id AS id, 'k' AS path, regexp_extract(props, ': ([0-9]+)', 1) AS value FROM events",
    "json_pairs": "SELECT event_id::VARCHAR AS id, 'k' AS path, regexp_extract(props, ': ([0-9]+)', 1) AS value FROM events",
    "delimited_tokens": "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS token FROM part",
    "encodings": "SELECT c_custkey, ['utf-8', 'utf-8', 'utf-16-be', 'utf-16-le', 'utf-16-be', 'utf-16-le', 'utf-32-be'][(c_custkey % 7) + 1] AS encoding FROM customer",
    "yaml_kinds": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'float' WHEN 1 THEN 'string' ELSE 'integer' END AS kind FROM events",
}
