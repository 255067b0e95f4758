"""YAML texts as events: documents, block and flow collections, scalars of all styles, anchors, aliases and tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "id string, n long, event string, value string, style string, anchor string, tag string, error string"
# Escapes of double-quoted scalars.
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


class YamlError(ValueError):
    """A text that is no YAML, with the line."""


@dataclass(frozen=True)
class Event:
    event: str
    value: str | None = None
    style: str | None = None
    anchor: str | None = None
    tag: str | None = None


_NONE: tuple[str | None, str | None] = (None, None)


class Parser:
    """Recursive descent over one text; columns decide the structure of blocks."""

    def __init__(self, text: str):
        self.text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
        self.at = 0
        self.out: list[Event] = []
        self.anchors: set[str] = set()

    def fail(self, what: str) -> None:
        raise YamlError(f"line {self.text.count(chr(10), 0, self.at) + 1}: {what}")

    # -- characters

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def column(self) -> int:
        return self.at - (self.text.rfind("\n", 0, self.at) + 1)

    def marker(self) -> bool:
        return not self.column() and self.peek(3) in ("---", "...") and (self.at + 3 >= len(self.text) or self.text[self.at + 3] in " \t\n")

    def end(self) -> bool:
        return self.at >= len(self.text) or self.marker()

    def spaces(self) -> None:
        while self.peek() in (" ", "\t") and self.peek():
            self.at += 1

    def eol(self) -> bool:
        return not self.peek() or self.peek() == "\n" or (self.peek() == "#" and (not self.column() or self.text[self.at - 1] in " \t\n"))

    def gap(self) -> None:
        """Over white space, comments and ends of lines."""
        while True:
            begin = not self.column()
            self.spaces()
            if begin and "\t" in self.text[self.at - self.column() : self.at] and not self.eol():
                self.fail("a tab in the indentation")
            if not self.eol() or self.at >= len(self.text):
                return
            stop = self.text.find("\n", self.at)
            self.at = len(self.text) if stop < 0 else stop + 1
            if self.marker():
                return

    def is_(self, sign: str) -> bool:
        """An indicator: the sign and then white space or the end."""
        return self.peek() == sign and (self.at + 1 >= len(self.text) or self.text[self.at + 1] in " \t\n")

    # -- streams

    def parse(self) -> list[Event]:
        while True:
            self.gap()
            while self.peek() == "%":
                self.at = (self.text + "\n").find("\n", self.at) + 1
                self.gap()
            if self.peek(3) == "..." and self.marker():
                self.at += 3
                continue
            if self.at >= len(self.text):
                return self.out
            explicit = self.marker()
            self.out.append(Event("document-start", style="explicit" if explicit else "implicit"))
            self.anchors = set()
            if explicit:
                self.at += 3
                self.value(-1)
            else:
                self.block(0, _NONE)
            self.gap()
            if not self.end():
                self.fail("content after the document's node")
            closed = self.peek(3) == "..."
            self.at += 3 * closed
            self.out.append(Event("document-end", style="explicit" if closed else "implicit"))

    # -- nodes

    def properties(self) -> tuple[str | None, str | None]:
        anchor = tag = None
        while self.peek() in ("&", "!"):
            m = re.compile(r"&[^\s,\[\]{}]+|!<[^>\s]+>|![^\s,\[\]{}]*").match(self.text, self.at)
            if not m:
                self.fail("a bad anchor or tag")
            if m[0][0] == "&":
                anchor = m[0][1:]
                self.anchors.add(anchor)
            else:
                tag = m[0]
            self.at = m.end()
            self.spaces()
        return anchor, tag

    def scalar(self, value: str, style: str, props: tuple[str | None, str | None]) -> None:
        self.out.append(Event("scalar", value, style, *props))

    def alias(self) -> None:
        m = re.compile(r"\*([^\s,\[\]{}]+)").match(self.text, self.at)
        if not m or m[1] not in self.anchors:
            self.fail("an alias without its anchor")
        self.at = m.end()
        self.out.append(Event("alias", m[1]))

    def key_end(self) -> int:
        """Where the colon of an implicit key on this line is; -1 if there is none."""
        p, depth, quote = self.at, 0, ""
        while p < len(self.text) and self.text[p] != "\n":
            c = self.text[p]
            if quote:
                p += c == "\\" and quote == '"'
                quote = "" if c == quote else quote
            elif c in "\"'" and (p == self.at or self.text[p - 1] in " [{,:"):
                quote = c
            elif c in "[{" and (depth or p == self.at):
                depth += 1
            elif c in "]}" and depth:
                depth -= 1
            elif c == "#" and p and self.text[p - 1] in " \t":
                return -1
            elif c == ":" and not depth and (p + 1 >= len(self.text) or self.text[p + 1] in " \t\n"):
                return p
            p += 1
        return -1

    def block(self, least: int, props: tuple[str | None, str | None]) -> None:
        """A node that begins here, in column `least` or later."""
        begin, column = self.at, self.column()
        if self.is_("-"):
            return self.sequence(column, props)
        if self.is_("?") or (self.peek() not in ("|", ">") and self.key_end() >= 0 and self.peek() not in ("&", "!")):
            return self.mapping(column, props)
        if self.peek() in ("&", "!"):
            own = self.properties()
            if self.eol():
                self.gap()
                if self.end() or self.column() < least:
                    return self.scalar("", "plain", own)
                return self.block(least, own)
            if self.key_end() >= 0:  # they belong to the first key
                self.at = begin
                return self.mapping(column, props)
            props = own
        return self.inline(least, props)

    def inline(self, least: int, props: tuple[str | None, str | None]) -> None:
        """A node that is no block collection."""
        c = self.peek()
        if c in ("|", ">"):
            return self.literal(least, props)
        if c in ("[", "{"):
            self.flow(props)
        elif c == "*":
            self.alias()
        elif c in ("'", '"'):
            self.scalar(self.quoted(), "single-quoted" if c == "'" else "double-quoted", props)
        else:
            return self.scalar(self.plain(least), "plain", props)
        self.spaces()
        if not self.eol():
            self.fail("content after a node")

    def value(self, column: int) -> None:
        """What stands after a colon or a document marker, for a collection in this column."""
        self.spaces()
        props = self.properties()
        if not self.eol():
            if column < 0:
                return self.block(0, props)
            if self.is_("-") or (self.peek() not in ("[", "{", '"', "'", "|", ">") and self.key_end() >= 0):
                self.fail("a block collection within a line")
            return self.inline(column + 1, props)
        self.gap()
        if not self.end() and self.column() == column and self.is_("-"):
            return self.sequence(column, props)
        if self.end() or self.column() <= column:
            return self.scalar("", "plain", props)
        return self.block(column + 1, props)

    def sequence(self, column: int, props: tuple[str | None, str | None]) -> None:
        self.out.append(Event("sequence-start", None, "block", *props))
        while not self.end() and self.column() == column and self.is_("-"):
            self.at += 1
            self.spaces()
            if self.eol():
                self.gap()
            if self.end() or self.column() <= column:
                self.scalar("", "plain", _NONE)
            else:
                self.block(column + 1, _NONE)
            self.gap()
        if not self.end() and self.column() > column:
            self.fail("bad indentation")
        self.out.append(Event("sequence-end"))

    def mapping(self, column: int, props: tuple[str | None, str | None]) -> None:
        self.out.append(Event("mapping-start", None, "block", *props))
        while not self.end() and self.column() == column and (self.is_("?") or self.is_(":") or self.key_end() >= 0):
            if self.is_("?"):
                self.at += 1
                self.value(column)
                self.gap()
                if not self.end() and self.column() == column and self.is_(":"):
                    self.at += 1
                    self.value(column)
                else:
                    self.scalar("", "plain", _NONE)
            else:
                self.key()
                self.at += 1
                self.value(column)
            self.gap()
        if not self.end() and self.column() > column:
            self.fail("bad indentation")
        self.out.append(Event("mapping-end"))

    def key(self) -> None:
        stop = self.key_end()
        props = self.properties()
        c = self.peek()
        if c == "*":
            self.alias()
        elif c in ("[", "{"):
            self.flow(props)
        elif c in ("'", '"'):
            self.scalar(self.quoted(), "single-quoted" if c == "'" else "double-quoted", props)
        else:
            self.scalar(self.text[self.at : stop].rstrip(), "plain", props)
            self.at = stop
        self.spaces()
        if self.at != stop:
            self.fail("a bad key")

    # -- scalars

    def fold(self, parts: list[str]) -> str:
        """Lines as one: an end of line is a space, an empty line an end of line."""
        out, breaks = parts[0], 0
        for p in parts[1:]:
            if not p:
                breaks += 1
            else:
                out += "\n" * breaks + p if breaks else f" {p}"
                breaks = 0
        return out + "\n" * breaks

    def plain(self, least: int, flow: bool = False) -> str:
        if self.peek() in ("@", "`", "%", ",", "]", "}") or not self.peek():
            self.fail("a bad start of a plain scalar")
        lines = []
        while True:
            begin = self.at
            while self.peek() and self.peek() != "\n":
                c = self.peek()
                after = self.text[self.at + 1 : self.at + 2]
                if (c == ":" and (after in ("", " ", "\t", "\n") or (flow and after in ",[]{}"))) or (c == "#" and self.at > begin and self.text[self.at - 1] in " \t") or (flow and c in ",[]{}"):
                    break
                self.at += 1
            lines.append(self.text[begin : self.at].strip())
            if self.peek() != "\n":
                break
            back, empty = self.at, 0
            while self.peek() == "\n":
                self.at += 1
                self.spaces()
                empty += self.peek() == "\n"
            if self.end() or self.peek() == "#" or (not flow and (self.column() < least or self.key_end() >= 0)) or (flow and self.peek() in (",", "]", "}", "[", "{")):
                if not flow and not self.end() and self.column() >= max(least, 1) and self.peek() != "#":
                    self.fail("a key within a plain scalar")
                self.at = back
                break
            lines += [""] * empty
        return self.fold(lines)

    def quoted(self) -> str:
        quote = self.peek()
        self.at += 1
        lines, line = [], ""
        while True:
            c = self.peek()
            if not c or self.marker():
                self.fail("a quoted scalar without its end")
            self.at += 1
            if c == quote:
                if quote == "'" and self.peek() == "'":
                    line += "'"
                    self.at += 1
                    continue
                lines.append(line.lstrip(" \t") if lines else line)
                return self.fold(lines)
            if c == "\n":
                lines.append(line.strip(" \t") if lines else line.rstrip(" \t"))
                line = ""
            elif c == "\\" and quote == '"':
                e = self.peek()
                self.at += 1
                if e == "\n":  # the line goes on without a space
                    self.spaces()
                elif e in ("x", "u", "U"):
                    size = {"x": 2, "u": 4, "U": 8}[e]
                    if not re.fullmatch(rf"[0-9a-fA-F]{{{size}}}", self.peek(size)):
                        self.fail("a bad escape")
                    line += chr(int(self.peek(size), 16))
                    self.at += size
                elif e in ESCAPES:
                    line += ESCAPES[e]
                else:
                    self.fail("an unknown escape")
            else:
                line += c

    def literal(self, least: int, props: tuple[str | None, str | None]) -> None:
        m = re.compile(r"([|>])([-+]?)([1-9]?)([-+]?)[ \t]*(#[^\n]*)?(?=\n|$)").match(self.text, self.at)
        if not m or (m[2] and m[4]):
            self.fail("a bad head of a block scalar")
        chomp = m[2] or m[4]
        self.at = min(len(self.text), m.end() + 1)
        indent = max(least - 1, 0) + int(m[3]) if m[3] else 0
        lines: list[str] = []
        while self.at < len(self.text) and not self.marker():
            stop = self.text.find("\n", self.at)
            line = self.text[self.at : stop if stop >= 0 else len(self.text)]
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if not indent:
                    indent = max(lead, least, 1) if lead >= least else 0
                if not indent or lead < indent:
                    break
                lines.append(line[indent:])
            else:
                lines.append(line[indent:] if indent and lead > indent else "")
            self.at = len(self.text) if stop < 0 else stop + 1
        while lines and lines[-1] == "" and self.at >= len(self.text) and not self.text.endswith("\n"):
            lines.pop()
        body = lines[: next((k for k in range(len(lines), 0, -1) if lines[k - 1]), 0)]
        rest = len(lines) - len(body)
        if m[1] == ">":
            text, k = "", 0
            for k, x in enumerate(body):
                if k == 0:
                    text = x
                    continue
                before = body[k - 1]
                kept = x[:1] in (" ", "\t") or before[:1] in (" ", "\t")
                if not x:
                    text += "\n"
                elif kept:
                    text += "\n" + x
                else:
                    text += x if not before and text.endswith("\n") else " " + x if before else "\n" + x
        else:
            text = "\n".join(body)
        text += "" if chomp == "-" or not body and chomp != "+" else "\n" * (1 + rest if chomp == "+" else 1)
        self.scalar(text, "literal" if m[1] == "|" else "folded", props)

    # -- flow collections

    def flow(self, props: tuple[str | None, str | None]) -> None:
        square = self.peek() == "["
        close = "]" if square else "}"
        self.out.append(Event("sequence-start" if square else "mapping-start", None, "flow", *props))
        self.at += 1
        while True:
            self.gap()
            if self.end():
                self.fail("a flow collection without its end")
            if self.peek() == close:
                break
            if self.peek() == ",":
                self.fail("an empty entry")
            begin = len(self.out)
            asked = self.is_("?")
            self.at += asked
            self.gap()
            self.flow_node()
            self.gap()
            paired = self.peek() == ":"
            if paired:
                self.at += 1
                self.gap()
                self.flow_node()
                self.gap()
            if square and (paired or asked):
                self.out.insert(begin, Event("mapping-start", None, "flow"))
                if not paired:
                    self.scalar("", "plain", _NONE)
                self.out.append(Event("mapping-end"))
            elif not square and not paired:
                self.scalar("", "plain", _NONE)
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != close:
                self.fail("expected a comma")
        self.at += 1
        self.out.append(Event("sequence-end" if square else "mapping-end"))

    def flow_node(self) -> None:
        props = self.properties()
        self.gap()
        c = self.peek()
        if c in (",", "]", "}", ":") and (c != ":" or self.text[self.at + 1 : self.at + 2] in ("", " ", ",", "\n", "]", "}")):
            return self.scalar("", "plain", props)
        if c in ("[", "{"):
            return self.flow(props)
        if c == "*":
            return self.alias()
        if c in ("'", '"'):
            return self.scalar(self.quoted(), "single-quoted" if c == "'" else "double-quoted", props)
        return self.scalar(self.plain(0, flow=True), "plain", props)


def events(text: str) -> list[Event]:
    """The events of a text."""
    return Parser(text).parse()


def pairs(text: str) -> list[tuple[str, str | None]]:
    """Leaves of the first document by path; indexes are segments, aliases stand for what they name, empty collections and
    plain null scalars are null."""
    stream = events(text)
    known: dict[str, int] = {}
    out: list[tuple[str, str | None]] = []

    def walk(i: int, path: str) -> int:
        e = stream[i]
        if e.anchor:
            known[e.anchor] = i
        if e.event == "alias":
            walk(known[e.value], path)
            return i + 1
        if e.event == "scalar":
            out.append((path, None if e.style == "plain" and e.value in ("", "~", "null", "Null", "NULL") else e.value))
            return i + 1
        i, n, empty = i + 1, 0, True
        while not stream[i].event.endswith("-end"):
            empty = False
            if e.event == "sequence-start":
                name, n = str(n), n + 1
            else:
                if stream[i].event != "scalar":
                    raise YamlError("a key has to be a scalar")
                name, i = stream[i].value, i + 1
            i = walk(i, f"{path}:{name}" if path else name)
        if empty:
            out.append((path, None))
        return i + 1

    if stream:
        if stream[1].event != "mapping-start":
            raise YamlError("the root has to be a mapping")
        walk(1, "")
    if len({k.lower() for k, _ in out}) != len(out):
        raise YamlError("duplicate path")
    return out


def event_rows(df: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, n, event, value, style, anchor, tag, error) of each text; a bad one gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if t is None:
                    continue
                try:
                    rows += [(i, n, e.event, e.value, e.style, e.anchor, e.tag, None) for n, e in enumerate(events(t))]
                except YamlError as x:
                    rows.append((i, 0, None, None, None, None, None, str(x)))
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return df.select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, EVENTS)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as YAML texts: a block mapping with a flow list, a block sequence with an alias, and a literal."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(
        F.lit("# a customer\n---\nname: &n "), "c_name", F.lit("\nsegment: !seg '"), "c_mktsegment", F.lit("'\nplaces: [1, \""), F.col("c_nationkey").cast("string"), F.lit("\"]\nmore:\n- *n\n- deep: {a: b}\nnote: |\n  first\n    second\n..."),
    )
    return c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit("a: [1, 2")).otherwise(text).alias("text"))


QUERIES = {"yaml_events": lambda s, d: event_rows(_texts(s, d), "c_custkey", "text").select("id", "n", "event", "value", "style", "anchor", "tag", F.col("error").isNotNull().alias("bad"))}
_SHAPE = """[{'e': 'document-start', 'v': NULL, 's': 'explicit', 'a': NULL, 't': NULL}, {'e': 'mapping-start', 'v': NULL, 's': 'block', 'a': NULL, 't': NULL},
 {'e': 'scalar', 'v': 'name', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': c_name, 's': 'plain', 'a': 'n', 't': NULL},
 {'e': 'scalar', 'v': 'segment', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': c_mktsegment, 's': 'single-quoted', 'a': NULL, 't': '!seg'},
 {'e': 'scalar', 'v': 'places', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'sequence-start', 'v': NULL, 's': 'flow', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': '1', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': c_nationkey::VARCHAR, 's': 'double-quoted', 'a': NULL, 't': NULL}, {'e': 'sequence-end', 'v': NULL, 's': NULL, 'a': NULL, 't': NULL},
 {'e': 'scalar', 'v': 'more', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'sequence-start', 'v': NULL, 's': 'block', 'a': NULL, 't': NULL}, {'e': 'alias', 'v': 'n', 's': NULL, 'a': NULL, 't': NULL}, {'e': 'mapping-start', 'v': NULL, 's': 'block', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': 'deep', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'mapping-start', 'v': NULL, 's': 'flow', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': 'a', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': 'b', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'mapping-end', 'v': NULL, 's': NULL, 'a': NULL, 't': NULL}, {'e': 'mapping-end', 'v': NULL, 's': NULL, 'a': NULL, 't': NULL}, {'e': 'sequence-end', 'v': NULL, 's': NULL, 'a': NULL, 't': NULL},
 {'e': 'scalar', 'v': 'note', 's': 'plain', 'a': NULL, 't': NULL}, {'e': 'scalar', 'v': 'first' || chr(10) || '  second' || chr(10), 's': 'literal', 'a': NULL, 't': NULL}, {'e': 'mapping-end', 'v': NULL, 's': NULL, 'a': NULL, 't': NULL}, {'e': 'document-end', 'v': NULL, 's': 'explicit', 'a': NULL, 't': NULL}]"""
ORACLES = {
    "yaml_events": f"""WITH x AS (SELECT c_custkey, {_SHAPE} AS es FROM customer WHERE c_custkey % 10 <> 0)
    SELECT c_custkey::VARCHAR AS id, n - 1 AS n, es[n].e AS event, es[n].v AS value, es[n].s AS style, es[n].a AS anchor, es[n].t AS tag, FALSE AS bad FROM x, unnest(range(1, len(es) + 1)) AS t(n)
    UNION ALL SELECT c_custkey::VARCHAR, 0, NULL, NULL, NULL, NULL, NULL, TRUE FROM customer WHERE c_custkey % 10 = 0"""
}
