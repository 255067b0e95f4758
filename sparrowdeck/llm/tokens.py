"""Token ids of whole texts through a cache of pieces that a tokenizer encodes on their own."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ranges

#: Entries of a cache; a full one starts anew.
CACHE = 1_200_000
#: Letters, and after them punctuation that is one piece; apostrophes and the characters of special tokens are not plain.
_plain_word = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?*#$%&;:()"+/=@^_`{}~\[\]\\-]*)""").fullmatch
_plain_piece = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Texts of these characters alone are cut by a pattern of the faster library; it cuts them as the tokenizer's own does.
_common_text = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_common_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+").findall


def cut_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """(ends of the texts in the words, words, code of each word, distinct words) of an array of texts; null is empty."""
    lists = pc.ascii_split_whitespace(text.fill_null("") if text.null_count else text)
    flat = lists.flatten()
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate(([0], np.cumsum(there)))
    offsets = lists.offsets.to_numpy()
    flat = flat.filter(pa.array(there))
    coded = flat.dictionary_encode()
    return before[offsets[1:] - offsets[0]], flat, coded.indices.to_numpy(), coded.dictionary


def strings(words: pa.Array) -> list[str]:
    """to_pylist() of an array of strings, several times as fast."""
    return words.to_numpy(zero_copy_only=False).tolist()


def split_buffer(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of consecutive parts of `data` that end at these elements."""
    offsets = np.concatenate(([0], ends)).astype(np.int64) * data.itemsize
    if offsets[-1] >= 1 << 31:
        return pa.array([data[a:b].tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)], pa.large_binary())
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for: printable bytes stand for themselves, the
    others are the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


#: Stands for the end of a word; never a byte of UTF-8.
WORD_END = b"\xff"


def merge_core(path: str) -> object | None:
    """The byte-pair merges of a byte-level tokenizer in the faster library, which takes one piece at a time.

    That library merges the neighbours whose joined text has the least id, the tokenizer those of the least merge. Both
    are the same where ids follow the order of merges and no two merges give one token; otherwise there is none.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, suffix = made["model"], made["model"].get("end_of_word_suffix") or ""
    merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    ids = [model["vocab"].get(a.removesuffix(suffix) + b if suffix else a + b) for a, b in merges]
    special = {t["content"] for t in made["added_tokens"]}
    alphabet, ranks = byte_alphabet(), {}
    for token, number in model["vocab"].items():
        if token not in special:
            body, end = (token[: -len(suffix)], WORD_END) if suffix and token.endswith(suffix) else (token, b"")
            ranks[bytes(alphabet[c] for c in body) + end] = number
    first = len(ranks) - len(merges)
    if ids != list(range(first, len(ranks))) or max(ranks.values()) != len(ranks) - 1 or (suffix and sum(len(t) == 2 and t.endswith(WORD_END) for t in ranks) != 256):
        return None
    return tiktoken._tiktoken.CoreBPE(ranks, {}, r"\S+")


class _Encoder(dict):
    """Ids, as bytes, of pieces by text. A piece that is new is encoded when it is looked up.

    Plain letters need no normalising: for them the merges alone do.
    """

    code = "I"  # of array: unsigned 32-bit
    end = b""

    def __init__(self, path: str, ordinary: bool, cache: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.core = merge_core(path)
        self.cache = cache

    def _full(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _plain(self, letters: str) -> bytes:
        if self.core is None:
            return self._full(letters)
        return array(self.code, self.core.encode_single_piece(letters.encode() + self.end)).tobytes()

    def _joined(self, pieces: list[str]) -> bytes:
        if len(self) > self.cache:
            self.clear()
        return b"".join(map(self.__getitem__, pieces))


class WordEncoder(_Encoder):
    """Little-endian unsigned 32-bit ids of a tokenizer that drops white space, ends words with a mark and lower-cases.

    Gives the same ids as the tokenizer on the whole text: words are cut at ASCII white space, over which neither its
    normalisation nor its pre-tokenizer nor its special tokens reach. Plain words are encoded by their letters in lower
    case; punctuation after them is a piece of its own.
    """

    end = WORD_END

    def __init__(self, path: str, cache: int = CACHE):
        super().__init__(path, False, cache)

    def __missing__(self, word: str) -> bytes:
        m = _plain_word(word)
        if not m:
            ids = self._full(word)
        else:
            letters, tail = m.groups()
            low = letters.lower()
            ids = self._plain(word) if low == word else self[low] + self[tail] if tail else self[low]
        self[word] = ids
        return ids

    def looked_up(self, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words with these codes, end of each word's ids). Each distinct word is looked up once."""
        if len(self) > self.cache:
            self.clear()
        got = list(map(self.__getitem__, strings(words)))
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
        pool = np.frombuffer(b"".join(got), "<u4")
        each = lengths[codes]
        return pool[ranges((np.cumsum(lengths) - lengths)[codes], each)], np.cumsum(each)

    def closed(self, cut: tuple, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts of cut_words(), each with `end` behind it, one after the other; end of each text)."""
        ends, _, codes, words = cut
        ids, after = self.looked_up(codes, words)
        ends = np.concatenate(([0], after))[ends]
        out = np.full(len(ids) + len(ends), end, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = ids
        return out, ends + np.arange(1, len(ends) + 1)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        ends, _, codes, words = cut_words(pa.array(list(texts), pa.string()))
        ids, after = self.looked_up(codes, words)
        ends = np.concatenate(([0], after))[ends]
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(ends) else []


class PieceEncoder(_Encoder):
    """Little-endian unsigned 16-bit ids of a byte-level tokenizer; the pieces of its own pattern are encoded one by one."""

    code = "H"

    def __init__(self, path: str, cache: int = CACHE):
        import public_tokenizers
        import regex

        super().__init__(path, True, cache)
        self.cut = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self._plain(piece) if _plain_piece(piece) else self._full(piece)
        return ids

    def pieces(self, text: str) -> list[str]:
        if _common_text(text):
            return _common_pieces(text)
        if any("\x1c" <= c <= "\x1f" for c in text):  # which not all libraries take for white space
            return [text]
        return self.cut(text)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [self._joined(self.pieces(t)) for t in texts]
