"""Embedding near-dedup by p-stable hashing (Datar et al., 2004) and exact cosine checks.

A normalised vector's hash is floor((a.v + b) / w) for a Gaussian ``a``; a table's key joins ``k`` of
them. On the unit sphere Euclidean distance and cosine say the same, so the chance that a pair at the
threshold shares a key is known in closed form, and ``tables`` is what the wanted recall asks for.
``k`` grows with the logarithm of the row count, so unrelated vectors stay few per bucket at any size.

Equal vectors are one. A bucket larger than a block is split into cells of two blocks, so every pair
of it meets in one cell; a linked pair counts in the first table whose key it shares and in no other,
so links are counted without storing pairs. Each cell hands on at most one edge per member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.storage import forget, held, keep, named, unheld, without

#: Bucket width in units of the sphere's radius.
WIDTH = 2.0
#: Wanted chance that a pair exactly at the threshold meets in some table.
RECALL = 0.999
#: Unrelated vectors that a bucket may hold on average.
STRANGERS = 64.0
BLOCK = 1024
SEED = 20260101
#: Stand-ins for the ids of vectors whose rows all have null ids start here.
NAMELESS = 1 << 62


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash of two points so far apart agrees."""
    if distance <= 0:
        return 1.0
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def table_shape(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Hashes a table and tables."""
    far = collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows, 1) / STRANGERS) / -math.log(far)))
    near = collision(math.sqrt(2 - 2 * threshold)) ** k
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-near)))


@lru_cache(maxsize=8)
def _lines(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, k, tables])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) | 1


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def table_keys(v: np.ndarray, k: int, tables: int) -> np.ndarray:
    """int32 keys, one row per unit vector."""
    lines, shift, odd = _lines(v.shape[1], k, tables)
    cells = np.floor((v @ lines + shift) / WIDTH).astype(np.int64).reshape(len(v), tables, k)
    mixed = np.zeros((len(v), tables), np.uint64)
    for i in range(k):
        mixed = (mixed ^ (cells[:, :, i] * odd[:, i]).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _keys(k: int, tables: int):
    def run(vectors: pa.Array) -> pa.Array:
        out: list = [None] * len(vectors)
        by_dim: dict[int, list[int]] = {}
        raw = vectors.to_pylist()
        for i, v in enumerate(raw):
            by_dim.setdefault(len(v), []).append(i)
        for at in by_dim.values():
            for row, i in zip(table_keys(unit(np.array([raw[i] for i in at], dtype=np.float64)), k, tables), at, strict=True):
                out[i] = row
        return pa.array(out, pa.list_(pa.int32()))

    return run


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of the components of a graph on 0..n-1: their smallest nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _cells(threshold: float):
    """Sorted cells of (cell, table, across, block, id, weight, keys, vector) to link counts and edges.

    ``across``: the cell holds two blocks of a bucket, and only pairs of different blocks count. A cell's
    vectors have one length; cells of one length follow each other.
    """

    def pairs(v: np.ndarray, keys: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which candidate pairs meet here for the first time."""
        before = np.arange(keys.shape[1]) < table[i][:, None]
        return ~((keys[i] == keys[j]) & before).any(axis=1)

    def one(v, keys, table, across, block):
        found = []
        for at in range(0, len(v), 512):
            near = v[at : at + 512] @ v.T >= threshold
            i, j = np.nonzero(near)
            i += at
            ok = i < j
            if across:
                ok &= block[i] != block[j]
            found.append((i[ok], j[ok]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        ok = pairs(v, keys, table, i, j) if len(i) else np.zeros(0, bool)
        return i[ok], j[ok], i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(part: pa.RecordBatch) -> pa.RecordBatch:
            """Whole cells, few or one large one."""
            cell, table, across, block, ids, weight = (part.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            keys, v = _matrix(part.column(6), np.int32), unit(_matrix(part.column(7), np.float64))
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            size = np.diff(np.r_[start, len(cell)])
            first, all_ = [], []
            small = np.repeat(size <= 48, size) & ~across
            group = np.repeat(np.arange(len(start)), size)
            for d in range(1, int(size[size <= 48].max(initial=1))):
                i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
                i = i[np.einsum("ij,ij->i", v[i], v[i + d]) >= threshold]
                if len(i):
                    ok = pairs(v, keys, table, i, i + d)
                    first.append((i[ok], i[ok] + d))
                    all_.append((i, i + d))
            for s, n in zip(start, size, strict=True):
                if n > 48 or across[s]:
                    part_ = slice(s, s + n)
                    a, b, c, e = one(v[part_], keys[part_], table[part_], across[s], block[part_])
                    first.append((a + s, b + s))
                    all_.append((c + s, e + s))
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            i, j = (np.concatenate(x) for x in zip(*first, none, strict=True))
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            label = _joined(len(ids), *(np.concatenate(x) for x in zip(*all_, none, strict=True)))
            some, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
            src, dst = np.r_[ids[some], ids[tied]], np.r_[np.zeros(len(some), np.int64), ids[label[tied]]]
            n = np.r_[links[some], np.zeros(len(tied), np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(n), pa.array(np.r_[np.zeros(len(some), bool), np.ones(len(tied), bool)])], names=["src", "dst", "n", "edge"])

        def by_length(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            size = pc.list_value_length(part.column(7)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
            for s, e in zip(starts, [*starts[1:], len(size)], strict=True):
                yield settle(part.slice(s, e - s))

        for b in batches:
            for at in range(0, b.num_rows, 4096):
                held.append(b.slice(at, 4096))
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cell = table.column(0).to_numpy()
                whole = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
                if whole:
                    yield from by_length(table.slice(0, whole))
                held = [table.slice(whole)]
        if held and held[0].num_rows:
            yield from by_length(held[0])

    return run


def vector_links(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``df``'s columns but the vector, with ``n_links``, ``component_id`` and ``kept`` added, row by row.

    Vectors link where the cosine in double precision reaches the threshold. ``n_links``: how many
    other rows link directly; ``component_id``: the smallest id reachable by links, itself included;
    ``kept``: whether it is the row's own. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different lengths don't link. Repeated rows
    are rows of their own. A row with a null id counts as a link but names no component: its own is
    that of its vector's other rows or null, and it is kept if null. Input columns with the three names
    are replaced, others may have any name.
    """
    base = without(df, "n_links", "component_id", "kept")
    slim = base.select(held(base, vector), named(vec_id).cast("bigint").alias("id"), named(vector).alias("v"))
    fine = "size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = slim.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    # Equal vectors are one: the smallest id stands for them.
    solid = rows.where("fine").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    solid = solid.withColumn("rep", F.coalesce("rep", F.lit(NAMELESS) + F.xxhash64("v").bitwiseAND(F.lit(NAMELESS - 1))))
    k, tables = table_shape(df.count(), threshold)
    keyed = keep(solid.withColumn("keys", F.arrow_udf(_keys(k, tables), "array<int>")("v")))
    spread = keyed.select("rep", F.size("v").alias("dim"), F.posexplode("keys").alias("table", "key"))
    full = spread.groupBy("dim", "table", "key").agg(F.count("*").alias("n")).where("n > 1")
    full = keep(full.selectExpr("dim", "table", "key", f"CAST(ceil(n / {BLOCK}) AS int) AS blocks"))  # written: the join may split a large bucket
    met = spread.join(full, ["dim", "table", "key"]).withColumn("block", F.pmod(F.xxhash64("rep", "table"), F.col("blocks")).cast("int"))
    met = met.select("rep", "dim", "table", "key", "block", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) AS one, greatest(x, block) AS two))")).alias("at"))
    met = met.selectExpr("rep", "dim", "xxhash64(dim, table, key, at.one, at.two) AS cell", "table", "at.one <> at.two AS across", "block")
    cells = met.join(keyed, "rep").selectExpr("cell", "table", "across", "block", "rep", "weight", "keys", "v", "dim")
    found = keep(cells.repartition("cell").sortWithinPartitions("dim", "cell", "rep").mapInArrow(_cells(threshold), "src bigint, dst bigint, n bigint, edge boolean"))
    forget(full)
    links = found.where("NOT edge").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("edge").select("src", "dst"))
    facts = keyed.select("rep", "weight", "v").join(links, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left")
    facts = facts.selectExpr("v AS of_v", "coalesce(n, 0) + weight - 1 AS links", "coalesce(component, rep) AS c")
    out = rows.where("fine").join(facts, F.col("v") == F.col("of_v")).selectExpr("row_", "id", "links", f"IF(c < {NAMELESS}, c, NULL) AS c")
    out = out.unionByName(rows.where("NOT fine").selectExpr("row_", "id", "CAST(0 AS bigint) AS links", "CAST(NULL AS bigint) AS c"))
    component = F.coalesce("c", "id")
    return out.select(*unheld(base, vector), F.col("links").cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return vector_links(vectors).select("vec_id", "n_links", "component_id", "kept")
