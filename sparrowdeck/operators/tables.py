"""Mutable tables as immutable files: commits list the files of each table, and one commit may change several tables.

A commit is one file with a number of its own, made only if nobody has made it yet; that is what makes it atomic, over
several tables too. Inserts add files; updates and deletes rewrite only files that have a row they change. Columns are
stored under numbers that are never used again, so a name can be dropped and added anew. Readers keep the files of the
commit they opened. All paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lineage
from ..types import spark_type


class TableError(ValueError):
    """A change that the table does not accept."""


class Conflict(TableError):
    """Another writer committed first."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # a dialect type
    nullable: bool = True
    default: Any = None
    number: int = 0  # its name in files; given by the table


@dataclass(frozen=True)
class TableDef:
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    indexes: tuple[tuple[str, tuple[str, ...], bool], ...] = ()  # name, columns, unique
    numbers: int = 0  # column numbers given so far

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) != len(names) or not names:
            raise TableError("a table needs columns of different names")
        if any(k.lower() not in names for k in self.primary_key):
            raise TableError("the primary key names an unknown column")
        # a primary key makes its columns NOT NULL and nothing else
        keys = {k.lower() for k in self.primary_key}
        numbers, columns = self.numbers, []
        for c in self.columns:
            numbers += not c.number
            columns.append(replace(c, nullable=c.nullable and c.name.lower() not in keys, number=c.number or numbers))
        object.__setattr__(self, "columns", tuple(columns))
        object.__setattr__(self, "numbers", numbers)

    def column(self, name: str) -> ColumnDef:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise TableError(f"unknown column {name}")

    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in self.columns)

    def stored_ddl(self) -> str:
        return ", ".join(f"c{c.number} {spark_type(c.type)}" for c in self.columns)

    def layout(self) -> tuple[str, ...]:
        """Columns that files are ordered by: those of the first index, or the primary key."""
        return self.indexes[0][1] if self.indexes else self.primary_key

    def to_json(self) -> dict:
        return {"columns": [[c.name, c.type, c.nullable, c.default, c.number] for c in self.columns], "primary_key": list(self.primary_key), "indexes": [[n, list(k), u] for n, k, u in self.indexes], "numbers": self.numbers}

    @classmethod
    def from_json(cls, x: dict) -> TableDef:
        return cls(tuple(ColumnDef(*c) for c in x["columns"]), tuple(x["primary_key"]), tuple((n, tuple(k), u) for n, k, u in x["indexes"]), x["numbers"])


@dataclass(frozen=True)
class State:
    """A table as a statement sees it: its definition and files, and what changed since `version`."""

    definition: TableDef
    files: tuple[str, ...] = ()
    version: int = 0
    added: tuple[str, ...] = ()
    removed: frozenset[str] = frozenset()
    redefined: bool = False

    def with_files(self, added: Iterable[str], removed: Iterable[str] = ()) -> State:
        added, gone = tuple(added), set(removed)
        return replace(self, files=(*[f for f in self.files if f not in gone], *added), added=(*[f for f in self.added if f not in gone], *added), removed=self.removed | gone)

    @property
    def changed(self) -> bool:
        return bool(self.added or self.removed or self.redefined)


class Database:
    """Tables in a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files and commits

    def _path(self, *parts: object) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _fs(self) -> Any:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self._path("commits", number).toString(), wholetext=True).first()[0])

    def _create(self, path: Any, text: str) -> bool:
        """Write a file that must not exist yet; whether it was ours to write."""
        try:
            out = self._fs().create(path, False)
        except Exception:
            if self._fs().exists(path):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def commits(self) -> list[int]:
        fs, path = self._fs(), self._path("commits")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path)) if fs.exists(path) else []

    def newest(self) -> int:
        return max(self.commits(), default=0)

    def _heads(self, number: int) -> dict[str, int]:
        """The commit that has the head of each table, as of a commit."""
        return self._load(number)["tables"] if number else {}

    def state(self, table: str, at: int | None = None) -> State:
        """The table as of a commit, by default the newest."""
        heads = self._heads(self.newest() if at is None else at)
        if table not in heads:
            raise TableError(f"unknown table {table}")
        head = self._load(heads[table])["heads"][table]
        return State(TableDef.from_json(head["definition"]), tuple(head["files"]), heads[table])

    def tables(self) -> list[str]:
        return sorted(self._heads(self.newest()))

    def publish(self, changes: Mapping[str, State | None]) -> int:
        """Commit the changed states of several tables (None: dropped) together or not at all.

        First updater wins, by file: a commit fails if a file it rewrote is gone, the definition changed, or the table
        changed at all and has a unique index. What only adds rows meets other commits without a conflict.
        """
        while True:
            number = self.newest()
            heads, record = self._heads(number), {}
            for table, mine in changes.items():
                if mine is None:
                    if table not in heads:
                        raise Conflict(f"{table} is gone")
                    continue
                if heads.get(table, 0) == mine.version:
                    files, definition = mine.files, mine.definition
                else:
                    now = self.state(table, number) if table in heads else None
                    unique = any(u for _, _, u in mine.definition.indexes)
                    if now is None or mine.redefined or now.definition != mine.definition or unique or not mine.removed <= set(now.files):
                        raise Conflict(f"{table} has changed since version {mine.version}")
                    files, definition = (*[f for f in now.files if f not in mine.removed], *mine.added), now.definition
                record[table] = {"definition": definition.to_json(), "files": list(files)}
            tables = {t: n for t, n in heads.items() if changes.get(t, 0) is not None} | dict.fromkeys(record, number + 1)
            if self._create(self._path("commits", number + 1), json.dumps({"tables": tables, "heads": record})):
                return number + 1

    # -- definition

    def create_table(self, table: str, definition: TableDef, if_not_exists: bool = False) -> None:
        if table in self._heads(self.newest()):
            if if_not_exists:
                return
            raise TableError(f"{table} exists")
        definition.ddl()  # unknown types fail here
        self.publish({table: State(definition, redefined=True)})

    def drop_table(self, table: str, if_exists: bool = False) -> None:
        if table not in self._heads(self.newest()):
            if if_exists:
                return
            raise TableError(f"unknown table {table}")
        self.publish({table: None})

    def definition(self, table: str) -> TableDef:
        return self.state(table).definition

    def _redefine(self, table: str, **changes: Any) -> None:
        state = self.state(table)
        self.publish({table: replace(state, definition=replace(state.definition, **changes), redefined=True)})

    def add_column(self, table: str, column: ColumnDef) -> None:
        """Older rows read null; the column's default counts for later inserts only."""
        self._redefine(table, columns=(*self.definition(table).columns, replace(column, number=0)))

    def drop_column(self, table: str, name: str) -> None:
        d = self.definition(table)
        c = d.column(name)
        if name.lower() in {k.lower() for k in d.primary_key} or any(name.lower() in {k.lower() for k in keys} for _, keys, _ in d.indexes):
            raise TableError(f"{name} is part of a key or an index")
        if len(d.columns) == 1:
            raise TableError("a table keeps its last column")
        self._redefine(table, columns=tuple(x for x in d.columns if x is not c))

    def create_index(self, table: str, name: str, columns: Sequence[str], unique: bool = False) -> None:
        """A unique index is checked now and on every write; nulls count as values. Rows written from now on are ordered
        by the first index of their table, and cluster() orders those that are there, so that a seek skips files."""
        d = self.definition(table)
        if any(n.lower() == name.lower() for n, _, _ in d.indexes):
            raise TableError(f"index {name} exists")
        keys = tuple(d.column(c).name for c in columns)
        if unique and self.read(table).groupBy(*keys).count().where("count > 1").limit(1).count():
            raise TableError(f"duplicate key in {name}")
        self._redefine(table, indexes=(*d.indexes, (name, keys, unique)))

    def drop_index(self, table: str, name: str, if_exists: bool = False) -> None:
        d = self.definition(table)
        left = tuple(i for i in d.indexes if i[0].lower() != name.lower())
        if len(left) == len(d.indexes):
            if if_exists:
                return
            raise TableError(f"unknown index {name}")
        self._redefine(table, indexes=left)

    # -- reading

    def version(self, table: str) -> int:
        return self.state(table).version

    def rows(self, state: State, files: Sequence[str] | None = None) -> DataFrame:
        """The rows of a state, or of some of its files, under the names of its columns."""
        files = state.files if files is None else files
        d = state.definition
        if not files:
            return self.spark.createDataFrame([], d.ddl())
        stored = self.spark.read.schema(d.stored_ddl()).parquet(*[self._path("data", f).toString() for f in files])
        return stored.select(*[F.col(f"c{c.number}").alias(c.name) for c in d.columns])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The newest version, or the one of a snapshot."""
        return self.rows(self.state(table, version))

    def scan_versions(self, table: str) -> DataFrame:
        """The rows of every version that is still there, with the version: no visibility rule."""
        versions = sorted({self._heads(n).get(table, 0) for n in self.commits()} - {0})
        out = None
        for v in versions:
            one = self.read(table, v).withColumn("version", F.lit(v))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise TableError(f"unknown table {table}")
        return out

    def seek(self, table: str, index: str, equal: Sequence[Any] = (), low: Any = None, high: Any = None, version: int | None = None) -> DataFrame:
        """Rows by an equality prefix of an index's columns and a range (inclusive) of the next one. These reach the scan
        as pushed filters; over rows in the index's order, files and row groups outside the range are skipped."""
        state = self.state(table, version)
        keys = next((k for n, k, _ in state.definition.indexes if n.lower() == index.lower()), None)
        if keys is None:
            raise TableError(f"unknown index {index}")
        ranged = low is not None or high is not None
        if len(equal) + ranged > len(keys):
            raise TableError(f"{index} has {len(keys)} columns")
        out = self.rows(state)
        for k, v in zip(keys, equal, strict=False):
            out = out.where(F.col(k) == F.lit(v))
        if low is not None:
            out = out.where(F.col(keys[len(equal)]) >= F.lit(low))
        if high is not None:
            out = out.where(F.col(keys[len(equal)]) <= F.lit(high))
        return out

    # -- staging: data files are written first, and count only once they are published

    def _store(self, d: TableDef, rows: DataFrame) -> list[str]:
        """Write rows, in the order of the table's first index, and name the files."""
        folder = uuid.uuid4().hex
        stored = rows.select(*[F.col(c.name).cast(spark_type(c.type)).alias(f"c{c.number}") for c in d.columns])
        if keys := [f"c{d.column(k).number}" for k in d.layout()]:
            stored = stored.repartitionByRange(*keys).sortWithinPartitions(*keys)
        stored.write.parquet(self._path("data", folder).toString())
        found = self._fs().listStatus(self._path("data", folder))
        return sorted(f"{folder}/{x.getPath().getName()}" for x in found if x.getPath().getName().startswith("part-") and x.getLen() > 0)

    def _check(self, d: TableDef, new: DataFrame, others: DataFrame | None) -> None:
        """No nulls in required columns, and no unique key twice among the new rows or in the others."""
        required = [c.name for c in d.columns if not c.nullable]
        if required and new.where(" OR ".join(f"`{c}` IS NULL" for c in required)).limit(1).count():
            raise TableError(f"null in {', '.join(required)}")
        for name, keys, unique in d.indexes:
            if not unique:
                continue
            if new.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise TableError(f"duplicate key in {name}")
            if others is not None:
                a, b = new.select(*[F.col(k).alias(f"n_{k}") for k in keys]), others.select(*[F.col(k).alias(f"o_{k}") for k in keys])
                if b.join(a, [F.col(f"n_{k}").eqNullSafe(F.col(f"o_{k}")) for k in keys], "left_semi").limit(1).count():
                    raise TableError(f"duplicate key in {name}")

    def _given(self, d: TableDef, rows: Sequence[Sequence[Any]] | DataFrame, columns: Sequence[str] | None) -> DataFrame:
        names = [d.column(c).name for c in columns] if columns else [c.name for c in d.columns]
        if isinstance(rows, DataFrame):
            if len(rows.columns) != len(names):
                raise TableError("the rows have another number of columns")
            new = rows.toDF(*names)
        else:
            if any(len(r) != len(names) for r in rows):
                raise TableError("a row has another number of values than columns")
            raw = ", ".join(f"`{n}` {'binary' if spark_type(d.column(n).type) == 'BINARY' else 'string'}" for n in names)
            new = self.spark.createDataFrame([tuple(v if v is None or isinstance(v, (bytes, bytearray)) else str(v) for v in r) for r in rows], raw)
        return new.select(*[(F.col(c.name) if c.name in names else F.lit(c.default)).cast(spark_type(c.type)).alias(c.name) for c in d.columns])

    def stage_insert(self, state: State, rows: Sequence[Sequence[Any]] | DataFrame, columns: Sequence[str] | None = None) -> tuple[State, int]:
        """Rows are computed once, into files; checks and the count read those."""
        new = state.with_files(self._store(state.definition, self._given(state.definition, rows, columns)))
        fresh = self.rows(new, new.files[len(state.files) :])
        self._check(state.definition, fresh, self.rows(state))
        return new, fresh.count()

    def _touched(self, state: State, hit: Column) -> list[str]:
        """Files that have a row for which the condition is true. Their names, not their rows, come to the driver."""
        if not state.files:
            return []
        stored = self.spark.read.schema(state.definition.stored_ddl()).parquet(*[self._path("data", f).toString() for f in state.files])
        named = stored.select(*[F.col(f"c{c.number}").alias(c.name) for c in state.definition.columns], F.col("_metadata.file_path").alias("__file"))
        return ["/".join(r[0].rsplit("/", 2)[1:]) for r in named.where(hit).select("__file").distinct().collect()]

    def stage_update(self, state: State, changes: Mapping[str, Column], where: Column | None = None) -> tuple[State, int]:
        d = state.definition
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        files = self._touched(state, hit)
        if not files:
            return state, 0
        new = {d.column(k).name: v for k, v in changes.items()}
        old = self.rows(state, files)
        # the condition is on old values, so it is kept beside the new ones until the files are written
        after = old.withColumn("__hit", hit).select(*[(F.when(F.col("__hit"), new[c.name].cast(spark_type(c.type))).otherwise(F.col(c.name)) if c.name in new else F.col(c.name)).alias(c.name) for c in d.columns], "__hit")
        n = old.where(hit).count()
        keyed = any(u and {k.lower() for k in keys} & {k.lower() for k in new} for _, keys, u in d.indexes)
        changed = after.where("__hit").drop("__hit")
        self._check(d if keyed else replace(d, indexes=()), changed, self.rows(state).where(~hit) if keyed else None)
        return state.with_files(self._store(d, after.drop("__hit")), files), n

    def stage_delete(self, state: State, where: Column | None = None) -> tuple[State, int]:
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        files = self._touched(state, hit)
        if not files:
            return state, 0
        old = self.rows(state, files)
        return state.with_files(self._store(state.definition, old.where(~hit)), files), old.where(hit).count()

    def stage_replace(self, state: State, rows: DataFrame) -> State:
        new = state.with_files(self._store(state.definition, rows), state.files)
        self._check(state.definition, self.rows(new), None)
        return new

    # -- single statements

    def _expected(self, table: str, at: int | None) -> State:
        state = self.state(table)
        if at is not None and state.version != at:
            raise Conflict(f"{table} has changed since version {at}")
        return state

    def insert(self, table: str, rows: Sequence[Sequence[Any]] | DataFrame, columns: Sequence[str] | None = None, at: int | None = None) -> int:
        """Append rows; missing columns get their defaults. Returns the number of rows. Text is parsed to column types."""
        state, n = self.stage_insert(self._expected(table, at), rows, columns)
        self.publish({table: state})
        return n

    def update(self, table: str, changes: Mapping[str, Column], where: Column | None = None, at: int | None = None) -> int:
        """Set columns where the condition is true; expressions see the old row. Returns the number of rows changed."""
        state, n = self.stage_update(self._expected(table, at), changes, where)
        if n:
            self.publish({table: state})
        return n

    def delete(self, table: str, where: Column | None = None, at: int | None = None) -> int:
        """Delete where the condition is true; unknown keeps the row. Returns the number of rows deleted."""
        state, n = self.stage_delete(self._expected(table, at), where)
        if n:
            self.publish({table: state})
        return n

    def cluster(self, table: str) -> None:
        """Write the table anew in the order of its first index (or primary key)."""
        state = self.state(table)
        self.publish({table: self.stage_replace(state, self.rows(state))})

    def purge(self, keep: int = 1) -> int:
        """Delete all but the newest commits, and the files that only those name; returns how many commits went. It ends
        what readers of the deleted versions can read, so `keep` has to cover the open ones. Heads that kept commits
        refer to stay."""
        commits = self.commits()
        kept = set(commits[-keep:])
        kept |= {n for k in list(kept) for n in self._heads(k).values()}
        named = lambda numbers: {f for n in numbers for head in self._load(n)["heads"].values() for f in head["files"]}
        gone = [n for n in commits if n not in kept]
        for f in named(gone) - named(kept):
            self._fs().delete(self._path("data", f), False)
        for n in gone:
            self._fs().delete(self._path("commits", n), False)
        return len(gone)


@dataclass
class Transaction:
    """Statements that commit together, over several tables, or not at all.

    Snapshot sees the commit at which it began; read committed the newest at each statement. Serializable is not offered.
    Both see their own changes. The first updater of a file wins; see Database.publish.
    """

    db: Database
    isolation: str = "snapshot"
    pending: dict[str, State] = field(default_factory=dict)
    began: int = 0

    def __post_init__(self) -> None:
        if self.isolation not in ("snapshot", "read committed"):
            raise TableError(f"{self.isolation} is not supported")
        self.began = self.db.newest()

    def state(self, table: str) -> State:
        if table in self.pending:
            return self.pending[table]
        return self.db.state(table, self.began if self.isolation == "snapshot" else None)

    def read(self, table: str) -> DataFrame:
        return self.db.rows(self.state(table))

    def insert(self, table: str, rows: Sequence[Sequence[Any]] | DataFrame, columns: Sequence[str] | None = None) -> int:
        self.pending[table], n = self.db.stage_insert(self.state(table), rows, columns)
        return n

    def update(self, table: str, changes: Mapping[str, Column], where: Column | None = None) -> int:
        self.pending[table], n = self.db.stage_update(self.state(table), changes, where)
        return n

    def delete(self, table: str, where: Column | None = None) -> int:
        self.pending[table], n = self.db.stage_delete(self.state(table), where)
        return n

    def replace(self, table: str, rows: DataFrame) -> None:
        self.pending[table] = self.db.stage_replace(self.state(table), rows)

    def commit(self) -> None:
        changed = {t: s for t, s in self.pending.items() if s.changed}
        if changed:
            self.db.publish(changed)
        self.pending, self.began = {}, self.db.newest()

    def rollback(self) -> None:
        """Drop the changes and the files they wrote."""
        for state in self.pending.values():
            for f in state.added:
                self.db._fs().delete(self.db._path("data", f), False)
        self.pending, self.began = {}, self.db.newest()


def visible(versions: DataFrame, snapshot: int, active: Sequence[int] = ()) -> DataFrame:
    """Row versions (writer, deleter, ...) that a snapshot sees: written by a finished earlier writer, not deleted by one."""
    seen = lambda c: (F.col(c) <= snapshot) & ~F.col(c).isin(list(active)) if active else F.col(c) <= snapshot
    return versions.where(seen("writer") & (F.col("deleter").isNull() | ~seen("deleter")))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", (F.col("event_id") % 100).alias("writer"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 100 + 30).alias("deleter"))


def scratch(spark: SparkSession) -> Database:
    """A new database in the shared folder."""
    return Database(spark, f"{lineage.shared_dir(spark)}/sparrowdeck/db-{uuid.uuid4().hex}")


QUERIES = {"snapshot_visible": lambda s, d: visible(_versions(s, d), 60, [10, 40])}
ORACLES = {
    "snapshot_visible": """SELECT event_id, user_id, writer, deleter FROM (SELECT event_id, user_id, event_id % 100 AS writer, CASE WHEN event_id % 4 = 0 THEN event_id % 100 + 30 END AS deleter FROM events)
    WHERE writer <= 60 AND writer NOT IN (10, 40) AND (deleter IS NULL OR NOT (deleter <= 60 AND deleter NOT IN (10, 40)))"""
}
