"""Sequence packing by best-fit decreasing, for corpora that no machine holds.

Documents become token ids; overlong ones are first cut into full windows. What remains are pieces
shorter than a window. Best-fit decreasing needs only how many pieces have each length, at most
``window`` numbers: the plan places runs of equal pieces into runs of equal windows, a segment tree
indexed by remaining capacity finding the tightest open window each time, exactly as if piece after
piece were placed. Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import held, keep, named, unheld, without

WINDOW = 4096
#: The id after each document in the packed stream.
END_ID = 2
#: Ranks within a length are counted in so many parts at least, each of so many pieces on average.
PARTS, PART_ROWS = 64, 1_000_000
#: Words and their pieces up to so many characters are remembered, twice so many in a worker.
KEPT_CHARS, KEPT = 64, 200_000
#: Bytes of ids that a batch of pieces holds, but for one longer document.
BATCH_BYTES = 1 << 20


#: Words of these characters are cut here by the tokenizer's own pattern, which spares the library's
#: bookkeeping of offsets; all of them are composed and have lower-case forms of one character.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same for lower-case words of printable ASCII.
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes are themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of blank-free words as little-endian 32-bit bytes; the tokenizer works word by word.

    Words and their pieces share one memo, as most words are one piece: in two generations of ``KEPT``. When the
    younger is full, the keys not asked for since it began are forgotten.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()
        # Only a tokenizer that works as _PIECE does is cut here.
        self.plain = True
        probe = "It's 12 o'clock—naïve CAFÉ, x²=4!? don't ÄÖÜ".split()
        self.plain = all(self._cut(w) == self.whole(w) for w in probe if _PLAIN.fullmatch(w))
        self.clear()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        return pack(f"<{len(ids)}I", *ids)

    def _cut(self, word: str) -> bytes:
        low = word.lower()
        if low.isascii() and low.isalpha():
            return self._piece(low) if low == word else self[low]
        pieces = (_ASCII_PIECE if low.isascii() else _PIECE).findall(low)
        if len(pieces) == 1 and low == word:  # a piece is cut no further
            return self._piece(low)
        return b"".join([self[p] for p in pieces])

    def __missing__(self, word: str) -> bytes:
        if len(word) > KEPT_CHARS:
            return self.whole(word)
        ids = self.older.get(word)
        if ids is None:
            ids = self._cut(word) if self.plain and _PLAIN.fullmatch(word) else self.whole(word)
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Blanks separate words for the tokenizer as they do here, but for four control characters."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def _cut(path: str, window: int, with_ids: bool):
    """Texts (the last column) to their pieces, in batches of bounded size."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    step = 4 * window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _words(path)
        for b in batches:
            texts, held, size = b.column(b.num_columns - 1), [], 0
            for i in range(b.num_rows):
                raw = own.encode(texts[i].as_py() or "") + end
                held.append((i, raw))
                size += len(raw)
                if size >= BATCH_BYTES:
                    yield pieces(b, held)
                    held, size = [], 0
            if held:
                yield pieces(b, held)

    def pieces(b: pa.RecordBatch, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parts = [(i, at // 4, len(raw) // 4, raw[at : at + step]) for i, raw in held for at in range(0, len(raw), step)]
        row, start, total, raw = zip(*parts, strict=True)
        length = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
        columns = [c.take(pa.array(row)) for c in b.columns[:-1]]
        columns += [pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
        names = [*b.schema.names[:-1], "doc_tokens", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(raw, pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    return run


class CapacityTree:
    """Counts of open windows by remaining capacity, as a segment tree over the capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity >= length that an open window has."""
        at = length + self.size
        if self.count[at]:
            return length
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at *= 2
                    if not self.count[at]:
                        at += 1
                return at - self.size
            at >>= 1
        return None


def plan_best_fit_decreasing(lengths: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Placements ``(length, first rank, first window, pieces a window, tokens already there)``.

    ``lengths``: how many pieces have each length. A placement holds for the ranks up to the next one
    of its length: rank r goes to window ``first + (r - rank) // pieces``, behind what is there and
    the ``(r - rank) % pieces`` pieces before it.
    """
    tree, runs, plan, opened = CapacityTree(window), {}, [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(lengths, reverse=True):
        rank, total = 0, lengths[length]
        while rank < total:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, opened, -(-(total - rank) // (window // length))
                opened += n
            else:
                first, n = runs[capacity].pop()
                tree.add(capacity, -n)
            each = min(capacity // length, total - rank)
            take = min(n, (total - rank) // each)
            plan.append((length, rank, first, each, window - capacity))
            leave(capacity - each * length, first, take)
            rank += take * each
            if n > take:
                if capacity == window:  # fresh windows: the last may get fewer
                    opened -= n - take
                else:
                    leave(capacity, first + take, n - take)
    return plan


def _place(plan: list[tuple[int, int, int, int, int]]):
    length, rank, first, each, used = (np.array(x, dtype=np.int64) for x in zip(*sorted(plan), strict=True)) if plan else [np.zeros(0, np.int64)] * 5
    key = (length << 44) + rank

    def run(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        at = np.searchsorted(key, (n << 44) + r, side="right") - 1
        r = r - rank[at]
        return pa.StructArray.from_arrays([pa.array(first[at] + r // each[at]), pa.array(used[at] + r % each[at] * n)], names=["sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, window: int = WINDOW, key: tuple[str, ...] = ("doc_id", "start"), ties: tuple[str, ...] = ()) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``window``) with ``sequence_id`` and ``offset`` added.

    Offsets are gapless from 0 within a sequence. Pieces of one length are numbered in parts, so that
    a length that most pieces have is no hot key; the plan's size depends on ``window`` only.
    """
    pieces = without(pieces, "sequence_id", "offset")
    slim = pieces.select(held(pieces), named("length").cast("bigint").alias("length"), F.struct(*[named(c) for c in (*key, *ties)]).alias("place"))
    lengths = {int(n): int(c) for n, c in slim.groupBy("length").count().collect()}  # at most ``window`` rows
    plan = plan_best_fit_decreasing(lengths, window)
    parts = max(PARTS, math.ceil(max(lengths.values(), default=0) / PART_ROWS))
    slim = slim.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int"))
    counts = slim.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    ranked = slim.selectExpr("row_", "length", "part", "row_number() OVER (PARTITION BY length, part ORDER BY place) - 1 AS at").join(before, ["length", "part"])
    place = F.arrow_udf(_place(plan), "struct<sequence_id bigint, offset bigint>")
    placed = ranked.select("row_", place(F.col("length"), (F.col("before") + F.col("at")).cast("bigint")).alias("to"))
    return placed.select(*unheld(pieces), "to.sequence_id", "to.offset")


def pack_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of the tokenized texts of ``df``, packed into sequences of at most ``window`` ids.

    One row per piece: ``df``'s other columns, ``start``, ``length``, ``ids_crc32``, ``ids`` (with
    ``with_ids``; little-endian unsigned 32-bit integers), ``doc_tokens``, ``sequence_id``, ``offset``.
    A null or empty text is the end id alone. Repeated rows are documents of their own. Input columns
    with the new names are replaced, others may have any name.
    An empty table gives an empty result. Sequences are short of ``window`` only by what best-fit
    decreasing leaves; padding them is the reader's.
    """
    new = ["start", "length", "ids_crc32", "ids", "doc_tokens", "sequence_id", "offset"]
    base = without(df, *new)
    slim = base.select(held(base, text), named(text).alias("text"))
    made = [T.StructField(c, T.LongType()) for c in ("doc_tokens", "start", "length", "ids_crc32")]
    made += [T.StructField("ids", T.BinaryType())] if with_ids else []
    pieces = keep(slim.mapInArrow(_cut(path, window, with_ids), T.StructType([slim.schema["row_"], *made])))
    pieces = pieces.select(*unheld(base, text), *[f.name for f in made])
    return pack_pieces(pieces, window, (doc_id, "start"), ("ids_crc32", "doc_tokens"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
