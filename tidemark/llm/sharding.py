"""Sharding by histogram sort (Solomonik and Kale, 2010): balanced byte ranges of a sort key.

Keys are (xxhash64 of the text, doc_id), so equal texts lie side by side. Each round counts the exact
bytes below a bounded number of candidate boundaries over all partitions; between the two probes that
enclose a target the next round probes again, until every splitter is within the tolerance. Then rows
move once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.storage import forget, held, keep, named, unheld, without

#: Probes for each open splitter and round.
PROBES = 64
#: A splitter may miss its target by this share of a mean shard.
TOLERANCE = 0.002
#: To keep a group of equal texts whole, by this share.
GROUP_TOLERANCE = 0.01
#: Row numbers within a shard are counted in so many parts at least, each of so many rows on average.
SLOT_PARTS, PART_ROWS = 64, 1_000_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(probes: list[tuple[int, int]]):
    """Bytes and rows by the number of probes that are <= a row's key."""
    first = np.array([h for h, _ in probes], dtype=np.int64)
    ties: dict[int, list[tuple[int, int]]] = {}
    for at, (h, d) in enumerate(probes):
        ties.setdefault(h, []).append((d, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(probes) + 1), dtype=np.int64)
        for b in batches:
            h, d, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.searchsorted(first, h, side="left")
            for i in np.flatnonzero((at < len(first)) & (first[np.minimum(at, len(first) - 1)] == h)):
                at[i] += sum(x <= d[i] for x, _ in ties[int(h[i])])
            np.add.at(total[0], at, n)
            np.add.at(total[1], at, 1)
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, total[0, at], total[1, at])], names=["at", "n", "c"])

    return run


def _cumulated(keys: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact bytes and rows of keys below each probe."""
    parts = keys.mapInArrow(_below(probes), "at bigint, n bigint, c bigint").groupBy("at").agg(F.sum("n"), F.sum("c")).collect()
    total = np.zeros((2, len(probes) + 1), dtype=object)
    for at, n, c in parts:
        total[:, at] = n, c
    return [(int(n), int(c)) for n, c in np.cumsum(total, axis=1)[:, :-1].T]


def _between(low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int]]:
    """Up to PROBES keys evenly between two keys, the ends left out."""
    if high[0] - low[0] > 1:
        return sorted({(low[0] + (high[0] - low[0]) * i // (PROBES + 1), LOW) for i in range(1, PROBES + 1)} - {low, high})
    if high[0] > low[0] and low[1] == LOW and high[1] == LOW:
        return sorted({(low[0], LOW + (HIGH - LOW) * i // (PROBES + 1)) for i in range(1, PROBES + 1)} - {low})
    end = high[1] if high[0] == low[0] else HIGH
    return sorted({(low[0], low[1] + (end - low[1]) * i // (PROBES + 1)) for i in range(1, PROBES + 1)} - {low, high})


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``shards - 1`` keys; a row belongs to shard i if i splitters are <= its key.

    ``keys`` has (h bigint, d bigint, n bigint). Rounds end when each splitter's bytes are within the
    tolerance, or no key lies between its two probes.
    """
    total, rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mean = total / shards
    goals = [total * i / shards for i in range(1, shards)]
    low = [((LOW, LOW), 0, 0)] * len(goals)
    high = [((HIGH, HIGH), total, rows)] * len(goals)
    best: list[tuple[int, int] | None] = [None] * len(goals)

    def settle(i: int) -> None:
        near = min(low[i], high[i], key=lambda x: abs(x[1] - goals[i]))
        miss = abs(near[1] - goals[i])
        (lh, ld), (hh, hd) = low[i][0], high[i][0]
        one_text = hh - lh <= 1 and ld == hd == LOW
        if miss <= tolerance * mean or one_text and miss <= GROUP_TOLERANCE * mean or high[i][2] - low[i][2] <= 1 or not _between(low[i][0], high[i][0]):
            best[i] = near[0]

    for i in range(len(goals)):
        settle(i)
    while any(b is None for b in best):
        probes = sorted({p for i, b in enumerate(best) if b is None for p in _between(low[i][0], high[i][0])})
        for p, (n, c) in zip(probes, _cumulated(keys, probes), strict=True):
            for i, goal in enumerate(goals):
                if best[i] is None:
                    if n <= goal and p > low[i][0]:
                        low[i] = (p, n, c)
                    elif n > goal and p < high[i][0]:
                        high[i] = (p, n, c)
        for i in range(len(goals)):
            if best[i] is None:
                settle(i)
    return sorted(best)


def shard_by_bytes(df: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with ``size``, ``shard`` and ``slot`` added, rows placed so that shards' bytes are near equal.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. Equal texts stay in one shard unless that
    would move a boundary by more than 1 % of a mean shard; then the group is cut by ``doc_id``. Rows
    that agree in text and id (repeated rows) can't be told apart by the key and stay together. A null
    id counts as the smallest. ``slot`` is gapless from 0 within a shard, counted part by part so that
    no task holds a whole shard. An empty table stays empty. Input columns of the three names are
    replaced, others pass through whatever their names.
    """
    base = without(df, "size", "shard", "slot")
    body, own = named(text), named(doc_id).cast("bigint")
    keyed = base.select(
        held(base), (F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("h"), F.coalesce(own, F.lit(LOW)).alias("d"),
    )
    keys = keep(keyed.select("h", "d", F.col("size").alias("n")))
    cuts = find_splitters(keys, shards, tolerance)
    parts = max(SLOT_PARTS, math.ceil(keys.count() / shards / PART_ROWS))
    forget(keys)
    passed = [((F.col("h") > h) | ((F.col("h") == h) & (F.col("d") >= d))).cast("int") for h, d in cuts]
    placed = keyed.withColumn("shard", sum(passed, F.lit(0)).cast("int")).withColumn("part", F.pmod(F.xxhash64("h", "d"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "part", "sum(n) OVER (PARTITION BY shard ORDER BY part) - n AS before")
    within = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, part ORDER BY h, d) - 1 AS at")
    out = within.join(before, ["shard", "part"])
    return out.select(*unheld(base), "size", "shard", (F.col("before") + F.col("at")).cast("bigint").alias("slot"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
