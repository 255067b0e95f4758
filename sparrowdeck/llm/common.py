"""Shared pieces of the training-data operators: word rules, shared-folder tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import lineage

#: Words are maximal runs of characters other than space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: The same six characters, for translate().
BREAK_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that a function of map_batches gets at a time.
ROWS = 1000

_written: dict[str, list[str]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir; where that is unset, what the context has as checkpoint
    folder; in local mode, where there is one machine, a temporary one."""
    return lineage.shared_dir(spark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    with contextlib.suppress(Exception):  # a leftover table is harmless, and the session may have ended
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, owner: str | None = None) -> None:
    """Delete the tables that materialize() wrote for an owner (for all when None) and whose readers are done.

    A frame that an operator returned may still read its tables, so a caller says when it is done; what is left goes when
    the program ends.
    """
    for key in [owner] if owner else list(_written):
        for path in _written.pop(key, []):
            remove(spark, path)


def fewer(df: DataFrame) -> DataFrame:
    """The frame in a quarter as many tasks as a shuffle has, though one for each core at least: for tables whose rows are
    cheap to make, so that four shuffle partitions, one after the other, make one file. Files cost more than rows here."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, task_count(df) // 4))


def materialize(df: DataFrame, owner: str, name: str, spread: bool = False) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back.

    The table outlives the loss of any executor. Each call writes to a folder of its own. spread: by as many tasks as
    there are, where making the rows is the work; otherwise by fewer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparrowdeck/{owner}-{name}-{uuid.uuid4().hex}"
    df = df if spread else fewer(df)
    if not _written:
        atexit.register(release, spark)
    _written.setdefault(owner, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame, owner: str) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        root = f.rsplit("/", 1)[0]
        for path in list(_written.get(owner, [])):
            if path.rsplit("/", 1)[1] == root.rsplit("/", 1)[1]:
                remove(df.sparkSession, path)
                _written[owner].remove(path)


def few_rows(df: DataFrame, key: Column, n: int) -> list[Row]:
    """At most n rows, those of least hash of the key, the same ones each time. Of a large table only about 2 n rows come
    from all tasks together: a sort with a limit would bring n from each."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    total = df.count()
    if total > 2 * n:
        df = df.where(place < int((1 << 40) * 2 * n / total) + 1)
    return df.orderBy(place, *df.columns).limit(n).collect()


def task_count(df: DataFrame) -> int:
    """Tasks for a shuffle whose work is Python's: the session's number, which merging by bytes would undercut."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame) -> DataFrame:
    """The frame; its session sends at most ROWS rows at a time to Python from now on. A row may be a whole text, and
    both sides hold a batch outside the JVM's heap, in buffers that double as they grow."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """mapInArrow for a function from one batch to dictionaries of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for out in fn(batch.slice(at, ROWS)):
                    yield to_batch(out, arrow)

    return small_batches(df).mapInArrow(run, schema)


def to_batch(columns: dict[str, Any], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of the schema's types from arrays, lists or numpy arrays."""
    return pa.RecordBatch.from_arrays(
        [
            x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type)
            for f in schema
        ],
        schema=schema,
    )


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of the ranges [start, start + length), one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
