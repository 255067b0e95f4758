"""Media columns: content-addressed payloads in tar shards, read back by ranges."""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, materialize, shared_dir, small_batches, task_count, texts, to_batch

#: A payload is rows of so many 8-bit samples.
WIDTH = 64
#: Bytes after which a task begins another shard, and bytes of a shard that are one reading unit.
SHARD, UNIT = 256 << 20, 8 << 20
#: A PNG's signature and header chunk: all that the metadata columns need.
HEADER = 33
STORED = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
READ = "digest binary, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(data: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of WIDTH."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def png(payload: bytes) -> bytes:
    """The payload as an 8-bit grey image of WIDTH columns."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def header_of(start: bytes) -> tuple[int, int]:
    """Width and height from the first HEADER bytes."""
    if start[:8] != b"\x89PNG\r\n\x1a\n" or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">II", start[16:24])


def samples_of(image: bytes) -> bytes:
    """The samples of an image that png() wrote."""
    width, _ = header_of(image)
    at, body = 8, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if zlib.crc32(image[at + 4 : at + 8 + size]) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Shape, mean, spread, entropy and the share of each eighth of the value range."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    share = count[count > 0] / len(x)
    bars = count.reshape(8, 32).sum(axis=1) * 1000 // len(x)
    values = np.arange(256)
    mean = float((count * values).sum() / len(x))
    spread = float(np.sqrt((count * (values - mean) ** 2).sum() / len(x)))
    return f"{WIDTH}x{len(x) // WIDTH};mean={mean:.4f};std={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};bars={','.join(map(str, bars))}"


class Shard:
    """A tar file that is being written; members are named by their payload's digest."""

    def __init__(self, fs: Any, path: str):
        self.path, self.at = path, 0
        self.out = fs.open_output_stream(path)

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.PAX_FORMAT)
        self.out.write(head)
        self.out.write(data)
        self.out.write(bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        return offset

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def store(docs: DataFrame, root: str, shard_bytes: int = SHARD, text: str = "text") -> DataFrame:
    """Write each payload once a shard; rows get its digest, shard, offset and length. Run it once and keep the rows:
    each attempt of a task writes shards of its own, and only those of the attempts that returned rows are referred to."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(STORED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as afs

        fs, base = afs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        shard: Shard | None = None
        places: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), texts(batch, text), strict=True):
                payload = payload_of(data)
                digest = hashlib.sha256(payload).digest()
                if shard is not None and shard.at > shard_bytes:
                    shard.close()
                    shard, places = None, {}
                if shard is None:
                    shard = Shard(fs, f"{base}/{uuid.uuid4().hex}.tar")
                if digest not in places:
                    image = png(payload)
                    places[digest] = (shard.add(f"{digest.hex()}.png", image), len(image))
                rows.append((doc, len(data), digest, shard.path, *places[digest]))
            if rows:
                yield to_batch(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)
        if shard is not None:
            shard.close()

    return small_batches(docs.select("doc_id", text)).mapInArrow(run, STORED)


def read_back(stored: DataFrame, root: str) -> DataFrame:
    """What the stored bytes of each distinct payload say. Payloads that several shards hold are read from the first."""
    index = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # rows are small, what they stand for is not: so many tasks as the payloads may take, whatever the rows weigh
    stored_bytes = stored.agg(F.sum("length")).first()[0] or 0
    tasks = max(task_count(stored), stored_bytes // (4 * UNIT))
    units = index.withColumn("unit", F.floor(F.col("offset") / UNIT)).repartition(tasks, "shard", "unit").sortWithinPartitions("shard", "offset")

    def look(batch: pa.RecordBatch) -> Iterator[dict]:
        from pyarrow import fs as afs

        fs, _ = afs.FileSystem.from_uri(root)
        out: dict[str, list] = {c.split()[0]: [] for c in READ.split(", ")}
        path, file = None, io.BytesIO()
        for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
            if shard != path:
                file.close()
                path, file = shard, fs.open_input_file(shard)
            file.seek(offset)
            width, height = header_of(file.read(HEADER))  # the metadata columns need no more
            file.seek(offset)
            image = file.read(length)
            samples = samples_of(image)
            row = (digest, width, height, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        file.close()
        yield out

    return map_batches(units.select("digest", "shard", "offset", "length"), look, READ)


def headers(stored: DataFrame, root: str) -> DataFrame:
    """(digest, width, height) by reading HEADER bytes of each distinct payload and nothing else."""
    index = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset")).alias("at")).select("digest", "at.*")

    def look(batch: pa.RecordBatch) -> Iterator[dict]:
        from pyarrow import fs as afs

        fs, _ = afs.FileSystem.from_uri(root)
        got = []
        for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True):
            with fs.open_input_file(shard) as file:
                file.seek(offset)
                got.append(header_of(file.read(HEADER)))
        yield {"digest": batch.column("digest"), "width": [g[0] for g in got], "height": [g[1] for g in got]}

    return map_batches(index, look, "digest binary, width int, height int")


def media_columns(docs: DataFrame, root: str | None = None, payloads: bool = True, owner: str = "op7") -> DataFrame:
    """A row for each document: where its payload is stored and what reading it back gives.

    Payloads are UTF-8 texts filled up with zeros, stored as 8-bit grey images in tar shards under `root` (by default in
    the shared folder) and named by their SHA-256, so equal texts share one member of a shard and one reading. Texts
    never travel between tasks; rows meet their payload's features by digest.

    Without `payloads`, the columns that a header has (width, height) are filled from headers alone.

    A null text is empty (one row of zeros); a text of any length is one payload; equal rows give equal rows; an empty
    table gives an empty result; only doc_id and text are read. The shards stay: they are what the operator makes.
    """
    root = root or f"{shared_dir(docs.sparkSession)}/sparrowdeck/{owner}-media-{uuid.uuid4().hex}"
    if "://" not in root:
        root = f"file://{root}" if root.startswith("/") else root.replace("file:/", "file:///", 1)
    stored = materialize(store(docs, root), owner, "stored", spread=True)
    features = (read_back if payloads else headers)(stored, root).withColumnRenamed("digest", "payload")
    return stored.join(features, F.col("digest") == F.col("payload")).drop("payload")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media columns of the documents table, payloads read back."""
    out = media_columns(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
