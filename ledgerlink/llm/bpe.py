"""Byte-level BPE encoding and decoding.

Text is cut by the tokenizer's pattern; what occurs again is encoded once (a bounded cache lives between batches).
Pieces are bucketed by length into padded matrices of token ids. Each round every row merges its leftmost pair of minimum rank, found through a hashed pair table, and is compacted by one column; rows without a
mergeable pair leave the matrix. Decoding gathers the bytes of the ids.

Defined cases: null and empty texts have no tokens, the hash of the empty string, and decode to nothing. Repeated rows
and repeated ids each give a row. Extra input columns are ignored. An empty table gives an empty result. A piece of any
length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import csr_gather, documents, slices

NO_RANK = np.int32(2**31 - 1)
#: Units of text kept between batches in a worker.
CACHE_UNITS = 500_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Token bytes by id, and the hashed table (left id, right id) -> merged id; ids are ranks."""

    def __init__(self, ranks_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
        size = max(ranks.values()) + 1
        tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        decimal = [b"%d," % i for i in range(size)]
        self.dec_length = np.array([len(d) for d in decimal], np.int64)
        self.dec_first = np.concatenate([[0], np.cumsum(self.dec_length)])[:-1]
        self.dec_bytes = np.frombuffer(b"".join(decimal), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._hash_pairs(ranks)

    def _hash_pairs(self, ranks: dict[bytes, int]) -> None:
        key, value = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    key.append(a << 32 | b)
                    value.append(rank)
        keys, values = np.array(key, np.uint64), np.array(value, np.int32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        slot = (keys * _GOLD >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):  # linear probing, all keys at once: the first to ask for a free slot has it
            free = left[self.values[slot[left]] == NO_RANK]
            _, at = np.unique(slot[free], return_index=True)
            won = free[at]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & mask

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NO_RANK where it does not merge; negative ids are padding."""
        key = a.astype(np.int64).astype(np.uint64) << np.uint64(32) | b.astype(np.int64).astype(np.uint64)
        slot = (key * _GOLD >> np.uint64(64 - self.bits)).astype(np.int64)
        out, shape = np.full(key.size, NO_RANK, np.int32), key.shape
        key, slot = key.ravel(), slot.ravel()
        ask = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        mask = (1 << self.bits) - 1
        while len(ask):
            at = slot[ask]
            hit = self.keys[at] == key[ask]
            out[ask[hit]] = self.values[at[hit]]
            ask = ask[~hit & (self.values[at] != NO_RANK)]
            slot[ask] = (slot[ask] + 1) & mask
        return out.reshape(shape)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and the number of each piece's ids."""
        length = np.array([len(p) for p in pieces], np.int64)
        flat = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        first = np.cumsum(length) - length
        count = np.minimum(length, 1)
        store = flat.copy()  # a piece's ids end up at the start of its range
        bucket = np.where(length <= 16, length, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for size in np.unique(bucket[length > 1]):
            rows = np.flatnonzero((bucket == size) & (length > 1))
            step = max(1, int(1_000_000 // size))
            for k in range(0, len(rows), step):
                self._merge(flat, first, length, rows[k : k + step], store, count)
        return csr_gather(store, first, count), count

    def _merge(self, flat, first, length, rows, store, count) -> None:
        width = int(length[rows].max())
        ids = np.full((len(rows), width), -1, np.int32)
        col = np.arange(width)
        inside = col < length[rows][:, None]
        ids[inside] = csr_gather(flat, first[rows], length[rows])
        ranks = np.full((len(rows), width), NO_RANK, np.int32)
        ranks[:, :-1] = self.rank_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = ranks.argmin(axis=1)  # leftmost minimum
            best = ranks[np.arange(len(rows)), at]
            over = best == NO_RANK
            if over.any():
                done, full = rows[over], ids[over]
                there = full >= 0
                store[(first[done][:, None] + np.arange(full.shape[1]))[there]] = full[there]
                count[done] = there.sum(axis=1)
                go = ~over
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            ids[r, at] = best
            keep = np.ones(ids.shape, bool)
            keep[r, at + 1] = False
            width = ids.shape[1] - 1
            ids, ranks = ids[keep].reshape(-1, width), ranks[keep].reshape(-1, width)
            after = np.where(at + 1 < width, ids[r, np.minimum(at + 1, width - 1)], -1)
            ranks[r, at] = self.rank_of(ids[r, at], after)
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self.rank_of(ids[back, at[back] - 1], ids[back, at[back]])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return csr_gather(self.bytes, self.first[ids], self.length[ids])

    def decimal(self, ids: np.ndarray) -> np.ndarray:
        """Decimal ids, each followed by a comma."""
        return csr_gather(self.dec_bytes, self.dec_first[ids], self.dec_length[ids])


#: White space as the tokenizer library has it (the regex module counts four more control characters).
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class _Units(dict):
    """Unit -> position in the encoded store; unknown units are queued."""

    def __init__(self):
        super().__init__()
        self.queue: list[str] = []
        self.known = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = at = self.known + len(self.queue)
        self.queue.append(unit)
        return at


class Encoder:
    """encode()/decode() of whole texts by one vocabulary and pattern.

    A unit is a stretch of text whose pieces do not depend on its surroundings: with the public pattern no piece goes
    from a solid character to white space, so where white space stands alone a text falls apart into words with their
    leading space. Other texts, and other patterns, are one unit.
    """

    def __init__(self, ranks_file: bytes, pattern: str):
        import public_tokenizers
        import regex

        self.vocabulary = Vocabulary(ranks_file)
        self.divisible = pattern == public_tokenizers.PATTERN
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE[1:-1]).replace(r"\S", "[^" + _SPACE[1:]).replace(r"\s", _SPACE)).findall
        self.double = re.compile(r"\s{2}|\x00").search
        self._reset()

    def _reset(self) -> None:
        self.units = _Units()
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _divide(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.divisible or self.double(text):
            return self.find(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each text's ids."""
        if self.units.known > CACHE_UNITS:
            self._reset()
        get = self.units.__getitem__
        each = [np.fromiter(map(get, found), np.int64, len(found)) for found in map(self._divide, texts)]
        if self.units.queue:
            found = [self.find(u) for u in self.units.queue]
            n = np.array([len(f) for f in found], np.int64)
            ids, count = self.vocabulary.encode([p.encode() for f in found for p in f])
            count = np.bincount(np.repeat(np.arange(len(found)), n), weights=count, minlength=len(found)).astype(np.int64)
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, count])
            self.units.known += len(found)
            self.units.queue = []
        at = np.concatenate(each) if each else np.zeros(0, np.int64)
        first = np.cumsum(self.count) - self.count
        n = self.count[at]
        row = np.repeat(np.arange(len(texts)), [len(e) for e in each])
        return csr_gather(self.ids, first[at], n), np.bincount(row, weights=n, minlength=len(texts)).astype(np.int64)


@lru_cache(2)
def _encoder(ranks_file: bytes, pattern: str) -> Encoder:
    return Encoder(ranks_file, pattern)


def _tokenized(df: DataFrame, schema: str, make, ranks_path: str | None, pattern: str | None) -> DataFrame:
    import public_tokenizers

    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))  # one vocabulary file: its size does not follow the data
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(np.array([len(t) for t in texts], np.int64)):
                part = texts[i:j]
                ids, count = encoder.encode_batch(part)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), *make(encoder.vocabulary, ids, count)], names=[x.split()[0] for x in schema.split(", ")])

    return df.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""

    def make(vocabulary, ids, count):
        import pyarrow as pa

        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))]

    return _tokenized(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, ids array<int>", make, ranks_path, pattern)


def digest_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes, decodes again, and returns the digests of ids and decoded bytes of each document."""

    def make(vocabulary, ids, count):
        import pyarrow as pa

        decimal, plain = vocabulary.decimal(ids).tobytes(), vocabulary.decode(ids).tobytes()
        edge = np.concatenate([[0], np.cumsum(count)])
        dec_edge = np.concatenate([[0], np.cumsum(vocabulary.dec_length[ids])])[edge]
        edge = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])[edge]
        hexed = lambda data, a, b: hashlib.sha256(data[a:b]).hexdigest()
        return [
            pa.array(count, pa.int64()),
            pa.array([hexed(decimal, a, max(a, b - 1)) for a, b in zip(dec_edge[:-1], dec_edge[1:])], pa.string()),
            pa.array([hexed(plain, a, b) for a, b in zip(edge[:-1], edge[1:])], pa.string()),
        ]

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _tokenized(picked, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, ranks_path, pattern)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(documents(spark, sf_dir))
