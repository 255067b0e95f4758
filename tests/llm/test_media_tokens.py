"""Media shards and token matrices: exact round trips."""

import hashlib
import io
import random
import tarfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparrowdeck.llm import media
from sparrowdeck.llm import token_output as to
from sparrowdeck.llm.tokens import PieceEncoder


def test_media_round_trip(spark, tmp_path):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (5, "é" * 1000), (6, "x" * 64), (7, "y\0"), (8, "y"), (9, "long " * 50_000), (9, "long " * 50_000), (None, "n")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string")
    got = media.media_columns(docs, f"file://{tmp_path}").collect()
    assert len(got) == len(rows)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        want = media.payload_of(text[r["doc_id"]])
        assert len(want) % 64 == 0 and len(want) > 0
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text[r["doc_id"]]), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        with open(r["shard"], "rb") as f:
            f.seek(r["offset"])
            image = f.read(r["length"])
            assert media.samples_of(image) == want and r["media_bytes"] == len(image) and r["media_sha256"] == hashlib.sha256(image).hexdigest()
            f.seek(0)
            with tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
                assert tar.extractfile(f"{bytes(r['digest']).hex()}.png").read() == image
    assert len({r["feature"] for r in got if r["doc_id"] in (1, 4)}) == 1
    stored = docs.sparkSession.createDataFrame([(bytearray(r["digest"]), r["shard"], r["offset"]) for r in got], "digest binary, shard string, offset long")
    assert {bytes(r["digest"]): (r["width"], r["height"]) for r in media.headers(stored, f"file://{tmp_path}").collect()} == {bytes(r["digest"]): (r["width"], r["height"]) for r in got}


def test_shards_roll_over(spark, tmp_path):
    docs = spark.createDataFrame([(i, str(random.Random(i).getrandbits(9000))) for i in range(20)], "doc_id long, text string").coalesce(1)
    assert media.store(docs, f"file://{tmp_path}", shard_bytes=4000).select("shard").distinct().count() > 3


def test_damage_is_seen():
    image = bytearray(media.png(media.payload_of(b"abc")))
    image[45] ^= 1
    with pytest.raises(ValueError):
        media.samples_of(bytes(image))


def test_headers_alone(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hello"), (2, "é" * 1000), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["width"], r["height"]) for r in media.media_columns(docs, f"file://{tmp_path}", payloads=False).collect()}
    assert got == {1: (64, 1), 2: (64, 32), 3: (64, 1)}


def test_token_matrix_edges(spark):
    """Null texts and ids, repeated rows, a very long text, columns with names of the result."""
    long = "word " * 20_000
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, "c", 5, "x"), (2, None, 5, "x"), (3, long, 5, "x"), (4, "", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long, input_ids string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = []
    for r in to.token_matrices(docs, length=128).collect():
        ids = np.frombuffer(bytes(r["input_ids"]), "<u2")
        ends = r["cu_seqlens"]
        got += [(d, s, tuple(ids[a:b].tolist())) for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], ends, ends[1:], strict=False)]
        assert r["n_tokens"] == ends[-1] <= 128 and len(ids) == 128
    want = []
    for d, x, *_ in rows:
        ids = [*t.encode(x or "").ids, to.END_ID]
        want += [(d, k, tuple(ids[k : k + 128])) for k in range(0, len(ids), 128)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_media_empty(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bins_are_best_fit():
    r = random.Random(3)
    lengths = [r.randint(1, 100) for _ in range(500)]
    bins, room = [], []
    for k in sorted(range(500), key=lambda k: -lengths[k]):
        fits = [b for b in range(len(bins)) if room[b] >= lengths[k]]
        if fits:
            b = min(fits, key=lambda b: room[b])
        else:
            b = len(bins)
            bins.append([])
            room.append(100)
        bins[b].append(k)
        room[b] -= lengths[k]
    got = to.best_fit_decreasing(lengths, 100)
    assert sorted(k for b in got for k in b) == list(range(500)) and len(got) == len(bins)
    assert sorted(100 - sum(lengths[k] for k in b) for b in got) == sorted(room)


def test_matrices_round_trip(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "<|endoftext|> 'LL  \n\n x\t "), (-4, "w " * 9000)], "doc_id long, text string"))
    parts = {}
    for r in to.token_matrices(docs, block=50_000).collect():
        ids, at = np.frombuffer(r["input_ids"], "<u2"), r["cu_seqlens"]
        positions = np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == len(positions) == 2048 and at[-1] == r["n_tokens"] <= 2048
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], at[:-1], at[1:], strict=True):
            parts[d, s] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    whole = {}
    for (d, _), x in sorted(parts.items()):
        whole.setdefault(d, []).extend(x)
    rows = docs.collect()
    assert {d: [*t.encode(x or "", add_special_tokens=False).ids, 50256] for d, x in rows} == whole
    assert all(t.decode(whole[d][:-1]) == (x or "") for d, x in rows)


def test_pieces_encode_alone():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    odd = ["a  b\n\n\nc   ", " \t x", "don't WE'LL 12 3.4!!  ?", " x y", "é ß\U0001f600 <|endoftext|>", "a\x1cb \x1f\x1f c\x85d", "x\u00b2 \u00bd \u00aa \u00df_\u00e9 'S 's'll\r\n\x0b\x0c y"]
    assert [np.frombuffer(x, "<u2").tolist() for x in PieceEncoder(path).encode(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_matrices_empty(spark):
    assert to.token_matrices(spark.createDataFrame([], "doc_id long, text string")).count() == 0
