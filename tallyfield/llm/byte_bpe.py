"""Byte-level BPE encoding and decoding on padded numpy matrices.

A batch's different pre-tokens are put into matrices of similar byte length, one pre-token a row, one byte id a cell, -1
behind the end. In each round the ranks of all neighbouring pairs are looked up in a hash table, every row merges its leftmost pair of
minimum rank, and the cells behind it move up by one; rows without a known pair leave the matrix. Pre-tokens that a worker has
seen are kept, up to ``CACHE``.

Texts are first cut at spaces and line ends into chunks that no pre-token crosses; the pattern splits only chunks that a
worker has not seen.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import batch, slices, text_array, texts_of

#: Chunks that a worker keeps; further ones are encoded again in each batch.
CACHE = 500_000
#: Matrix cells that are merged at once.
CELLS = 1 << 19
_NONE = np.int64(1 << 40)
_CHUNK = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_OTHER_BLANK = re.compile(r"[^\S \n]")


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of the joined bytes, probed by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(4, int(2 * len(left)).bit_length())
        keys = (left.astype(np.int64) << 32) | right
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
            won = self.keys[at[todo]] == keys[todo]
            self.values[at[todo[won]]] = joined[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Joined ids, ``_NONE`` where the pair is unknown or a side is padding."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        out = self.values[at]
        out[self.keys[at] != keys] = _NONE
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1) & (left >= 0) & (right >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.keys[at]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (got != -1)
            open_, at = open_[more], at[more]
        return out


class Vocabulary:
    """Ranks of a tiktoken file and what encoding and decoding derive from them."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # any two tokens whose joined bytes are a token may merge, at that token's rank
        splits = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                  if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        self.pairs = PairTable(*np.array(splits, np.int64).T)
        self.split = regex.compile(pattern).findall
        self.chunks: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        rest = []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is None:
                rest.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        rest.sort(key=lambda i: len(words[i]))
        lo = 0
        while lo < len(rest):
            # a bucket: rows of at most 1.5 times the shortest length, CELLS cells in all
            width, hi = len(words[rest[lo]]), lo + 1
            while hi < len(rest) and len(words[rest[hi]]) <= 1.5 * width and len(words[rest[hi]]) * (hi - lo + 1) <= CELLS:
                hi += 1
            self._merge_bucket(words, rest[lo:hi], out)
            lo = hi
        return out

    def _merge_bucket(self, words: list[bytes], rows: list[int], out: list[bytes]) -> None:
        lengths = np.array([len(words[i]) for i in rows])
        data = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
        cells = np.full((len(rows), lengths.max()), -1, np.int64)
        cells[np.arange(cells.shape[1]) < lengths[:, None]] = self.byte_ids[data]
        rows = np.array(rows)
        while len(rows):
            width = cells.shape[1]
            if width > 1:
                found = self.pairs.find(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(rows), width - 1)
                at = found.argmin(1)  # the first of equal ranks
                best = found[np.arange(len(rows)), at]
            else:
                best = np.full(len(rows), _NONE)
            done = best == _NONE
            for i in np.flatnonzero(done):
                out[rows[i]] = cells[i][cells[i] >= 0].astype("<u4").tobytes()
            if width == 1:
                return
            keep = np.flatnonzero(~done)
            rows, cells, at, best = rows[keep], cells[keep], at[keep], best[keep]
            if not len(rows):
                return
            cells[np.arange(len(rows)), at] = best
            source = np.arange(width - 1)
            cells = np.take_along_axis(cells, source + (source > at[:, None]), 1)
            lengths = lengths[keep] - 1
            cells = cells[:, :lengths.max()]

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks = [[t] if _OTHER_BLANK.search(t) else _CHUNK.findall(t) for t in texts]
        known, new = self.chunks, list(set().union(*chunks) - self.chunks.keys())
        added: dict[str, bytes] = {}
        if new:
            parts = [[c] if c.isalpha() or c[:1] == " " and c[1:].isalpha() and c.isascii() else self.split(c) for c in new]
            words = list(set().union(*parts))
            ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
            added = {c: b"".join(map(ids.__getitem__, p)) for c, p in zip(new, parts, strict=True)}
            if len(known) + len(added) <= CACHE:
                known.update(added)
                added = {}
        if added:
            both = lambda c: added.get(c) or known[c]
            return [b"".join(map(both, c)) for c in chunks]
        return [b"".join(map(known.__getitem__, c)) for c in chunks]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (bytes) of every text.

    Special tokens have no meaning: their names are ordinary text. A null or empty text has no ids. Rows that repeat a doc_id are
    encoded each; an empty table gives no rows; other columns are not read.
    """
    return _mapped(docs, path, pattern, id_col, text_col, "ids binary, decoded binary", [pa.binary(), pa.binary()],
                   lambda ids, back: (ids, back))


def encoded_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with the ids' number and the SHA-256 of ids and decoded bytes instead of them."""
    return _mapped(docs, path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                   [pa.int64(), pa.string(), pa.string()],
                   lambda ids, back: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))


def _mapped(docs, path, pattern, id_col, text_col, columns, types, of):
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        words = vocabulary(path, pattern)
        for rb in batches:
            texts, ids = text_array(rb.column("text")), rb.column("doc_id")
            for lo, hi in slices(texts, 1 << 22):
                rows = [of(x, words.decode(x)) for x in words.encode(texts[lo:hi].to_pylist())]
                yield batch(names, [ids[lo:hi], *map(list, zip(*rows, strict=True))], [pa.int64(), *types])

    rows = texts_of(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, f"doc_id long, {columns}")
