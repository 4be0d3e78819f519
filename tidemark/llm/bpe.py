"""Byte-level BPE without a tokenizer library: a rank queue on a hierarchical bitmap.

A pre-token's bytes form a linked list. Each mergeable pair waits in the bucket of its merge rank; a
three-level bitmap of 64-way words marks the buckets in use, so the next rank is three find-first-set
steps away. Positions within a bucket leave leftmost first. An entry whose pair has changed since is
stale and skipped. A pre-token of n bytes has at most 3 n entries: n log n steps even where a text is
one pre-token of millions of bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import without

#: Pre-tokens and segments up to so many characters are remembered, so many of each in a worker.
KEPT_CHARS = 64
KEPT_PIECES, KEPT_SEGMENTS = 1_000_000, 400_000
NEVER = 1 << 60
BIT = [1 << i for i in range(64)]
#: A blank beside another white-space character, and a blank beside none.
_TOUCHED = re.compile(r" (?:(?=\s)|(?<=\s ))")
_LONE = re.compile(r"(?<=\S) (?=\S)")


class _Memo(dict):
    """A bounded dict that makes missing values."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class BytePairCodec:
    """Encodes text to ids and back, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # The library's \s is the White_Space property.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        size = max(ranks.values(), default=-1) + 1
        self.low = [0] * ((size >> 6) + 1)  # a bit for each bucket in use
        self.mid = [0] * ((size >> 12) + 1)  # a bit for each word of low that isn't 0
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.piece = _Memo(self._piece, KEPT_PIECES)
        self.first = _Memo(self._segment, KEPT_SEGMENTS)
        self.spaced = _Memo(lambda s: self._segment(" " + s), KEPT_SEGMENTS)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n < 2:
            return [ranks[piece[i : i + 1]] for i in range(n)]
        # Node i spans piece[i:after[i]]; before[i] is the node to its left; due[i]: the rank at which
        # it would merge with the node to its right, NEVER if it can't or is gone. Index n, and so -1,
        # is the end. Only pairs that precede both neighbours are queued: no other can be next, and
        # each change looks at the pairs around it again.
        after, before, due = list(range(1, n + 2)), list(range(-1, n)), [NEVER] * (n + 1)
        low, mid, top, buckets, get = self.low, self.mid, 0, {}, ranks.get
        for i in range(n - 1):
            due[i] = get(piece[i : i + 2], NEVER)
        fresh = [i for i in range(n - 1) if due[i - 1] > due[i] <= due[i + 1] and due[i] != NEVER]
        while True:
            for i in fresh:  # push
                r = due[i]
                bucket = buckets.get(r)
                if bucket is not None:
                    heappush(bucket, i)
                    continue
                buckets[r] = [i]
                a = r >> 6
                word = low[a]
                low[a] = word | BIT[r & 63]
                if not word:
                    b = a >> 6
                    word = mid[b]
                    mid[b] = word | BIT[a & 63]
                    if not word:
                        top |= BIT[b]
            if not top:
                break
            # pop: the lowest rank by three find-first-set steps, its leftmost position
            b = (top & -top).bit_length() - 1
            word = mid[b]
            a = (b << 6) + (word & -word).bit_length() - 1
            word = low[a]
            bit = word & -word
            rank = (a << 6) + bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[a] = word = word ^ bit
                if not word:
                    mid[b] = word = mid[b] ^ BIT[a & 63]
                    if not word:
                        top ^= BIT[b]
            fresh = []
            if due[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            h = before[i]
            after[i], due[j] = k, NEVER
            if k < n:
                before[k] = i
                due[i] = r = get(piece[i : after[k]], NEVER)
                s = due[k]
                if s != NEVER and r > s <= due[after[k]]:
                    fresh.append(k)
            else:
                due[i] = r = s = NEVER
            if h >= 0:
                due[h] = q = get(piece[h:k], NEVER)
                g = before[h]
                o = due[g] if g >= 0 else NEVER
                if q != NEVER and o > q <= r:
                    fresh.append(h)
                if o != NEVER and o <= q and (due[before[g]] if before[g] >= 0 else NEVER) > o:
                    fresh.append(g)
                if r != NEVER and q > r <= s:
                    fresh.append(i)
            elif r != NEVER and r <= s:
                fresh.append(i)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _piece(self, text: str) -> bytes:
        ids = self.merge(text.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _segment(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pattern.findall(text)))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        The pattern never joins what lies on both sides of a blank between other than white space,
        except the blank itself with what follows; so a text is the sum of its segments, each led by a
        blank that touches no white space.
        """
        head, *rest = _LONE.split(text) if _TOUCHED.search(text) else text.split(" ")
        return b"".join([self.first[head], *map(self.spaced.__getitem__, rest)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), dtype="<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec.from_file(path, pattern)


def _encode(path: str, pattern: str):
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([own.encode(x.as_py()) for x in texts], pa.list_(pa.int32()))

    return run


def _decode(path: str, pattern: str):
    def run(ids: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        return pa.array([None if x.as_py() is None else own.decode(x.as_py()) for x in ids], pa.binary())

    return run


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids`` (array<int>) added; null and empty texts have none. Rows are kept one to one."""
    return without(df, ids).withColumn(ids, F.arrow_udf(_encode(path, pattern), "array<int>")(text))


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of ``ids`` added; null ids give null, an id outside the table raises."""
    return without(df, out).withColumn(out, F.arrow_udf(_decode(path, pattern), "binary")(ids))


def _digest(path: str, pattern: str):
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        n, ids_sha, text_sha = [], [], []
        for x in texts:
            raw = own.encode_bytes(x.as_py() or "")
            n.append(len(raw) // 4)
            ids_sha.append(hashlib.sha256(raw).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(np.frombuffer(raw, dtype="<u4").tolist())).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.arrow_udf(_digest(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), "struct<n_tokens bigint, ids_sha256 string, decoded_sha256 string>")
    return docs.select("doc_id", digest("text").alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
