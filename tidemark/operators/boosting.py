"""Boosted trees of many fits at a time, level by level in shared passes over binned rows.

The procedure is that of Spark's ``GBTClassifier``: a first tree on the labels as -1 and 1, then trees on the
log loss's gradient, splits by variance between at most 32 bins a feature, a share of rows for each tree and of
features for each node. One pass over the rows counts what every fit needs for a level of its tree, where Spark
runs some twenty jobs over all rows for each fit. Split points come, as Spark's do, from some ``SAMPLED`` rows;
every row counts in every split. Shares of rows follow a hash of the row's key, so results don't depend on
how rows lie in partitions, but for the last bits of sums.

A fit whose codes are at most ``ALONE`` bytes is grown whole by one task of its own, by the same steps; larger ones grow
together in the shared passes. Where a fit is to stop early, it stops once so many trees didn't better its average
precision on its own day's rows, and keeps the trees up to the best.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import draws as D
from tidemark.operators import metrics as M
from tidemark.operators.labels import PAIR

BINS = 32
#: Rows of a fit from which the split points of its features are taken.
SAMPLED = 10_000
#: Rows of a block, about: with few, counting them is mostly calls.
BLOCK = 40_000
#: Bytes of counts that a task holds; the fits of a level take turns beyond.
HELD = 64 << 20
#: Bytes of codes of a fit that one task grows by itself; it takes some four times as much memory.
ALONE = 128 << 20
#: Trees that a pass runs again before what they add up to is stored with the rows.
REPLAYED = 8
BLOCKS = "day string, label binary, key binary, member binary, margin binary, codes binary"


def key_hash() -> Column:
    return F.xxhash64("cutoff_date", *PAIR)


def cut_points(values: np.ndarray) -> np.ndarray:
    """At most 31 points between distinct values, as even in rows below as Spark's own."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < BINS:
        return between
    upto, stride, last, found = np.cumsum(counts), len(values) / BINS, -1, []
    nearer = (upto[:-1] + upto[1:]) / 2
    for target in stride * np.arange(1, BINS):
        last = max(last + 1, int(np.searchsorted(nearer, target, side="right")))
        if last >= len(between):
            break
        found.append(between[last])
    return np.array(found)


def split_points(trainval: DataFrame, rows_before: dict[str, int], numbers: Column) -> dict[str, list[np.ndarray]]:
    """Each feature's points by a fit's day, from rows before that day alone."""
    share = {d: min(1.0, SAMPLED / max(n, 1)) for d, n in rows_before.items()}
    u = F.shiftrightunsigned(key_hash(), 11) / float(1 << 53)
    met = [(F.col("cutoff_date") < d) & (F.col("_u") < s) for d, s in share.items()]
    some = trainval.withColumn("_u", u).where(F.greatest(*met, F.lit(False))).select("cutoff_date", "_u", numbers.alias("x")).toArrow()
    x, u_, days = matrix(some["x"].combine_chunks()), some["_u"].to_numpy(), np.array(some["cutoff_date"].to_pylist(), dtype=object)
    return {d: [cut_points(v) for v in x[(days < d) & (u_ < s)].T] for d, s in share.items()}


def matrix(rows: pa.Array) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), len(flat) // max(1, len(rows)))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``BLOCK`` rows or a little more; the last is what remains."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BLOCK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def squeeze(x: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(x).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def expand(raw: bytes, kind: type, rows: int) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(pa.decompress(raw[8:], n, codec="lz4", asbytes=True) if n else b"", kind)
    return out.reshape(rows, len(out) // rows)


def mixed(key: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A hash of keys, a seed and a number."""
    with np.errstate(over="ignore"):
        z = key + np.uint64((seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def share_of(key: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on, by a mixed hash of their keys."""
    return np.ones(len(key), bool) if share >= 1 else (mixed(key, seed, tree) >> np.uint64(11)) < share * float(1 << 53)


class Tree:
    """A tree over codes; a leaf leads to itself."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.right, self.value, self.level, self.gain = [0], [BINS], [0], [0], [0.0], [0], [0.0]

    def split(self, node: int, feature: int, at: int, values: tuple[float, float], gain: float) -> list[int]:
        two = [len(self.feature), len(self.feature) + 1]
        self.feature[node], self.bin[node], (self.left[node], self.right[node]), self.gain[node] = feature, at, two, gain
        for child, value in zip(two, values, strict=True):
            for column, v in ((self.feature, 0), (self.bin, BINS), (self.left, child), (self.right, child), (self.value, value), (self.level, self.level[node] + 1), (self.gain, 0.0)):
                column.append(v)
        return two

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        every, at = np.arange(codes.shape[1]), np.zeros(codes.shape[1], np.int64)
        feature, point, left, right = (np.array(v) for v in (self.feature, self.bin, self.left, self.right))
        for _ in range(max(self.level)):
            at = np.where(codes[feature[at], every] <= point[at], left[at], right[at])
        return at

    def arrays(self, cuts: list[np.ndarray], weight: float) -> tuple:
        """As ``models.run_trees`` takes it: over values, not codes; and what each split gains."""
        splits = np.array([c != i for i, c in enumerate(self.left)])
        threshold = np.array([cuts[f][b] if s else 0.0 for f, b, s in zip(self.feature, self.bin, splits, strict=True)])
        return (np.array(self.feature), splits, threshold, np.array(self.left), np.array(self.right), np.array(self.value), max(self.level), weight, np.array(self.gain))


@dataclass
class Binned:
    """Blocks of rows by the day of the fits that they take part in: codes of features, members of each fit."""

    blocks: DataFrame
    names: list[str]
    jobs: list[dict]
    weight: list[float]
    cuts: dict[str, list[np.ndarray]]
    sizes: list[int] | None = None  # rows of each fit; unknown ones aren't grown alone
    patience: int | None = None  # where fits stop early: blocks of the rows they are judged by, and who judges large ones
    judged: DataFrame | None = None
    judge: Callable | None = None
    best: dict[int, int] = field(default_factory=dict)

    @property
    def by_day(self) -> dict[str, list[int]]:
        return {d: [i for i, j in enumerate(self.jobs) if j["day"] == d] for d in self.cuts}


def binned(rows: DataFrame, jobs: list[dict], names: list[str], weight: list[float], cuts: dict[str, list[np.ndarray]], numbers: Column, last: dict[tuple, str]) -> Binned:
    """``rows`` drawn for the fits by ``last``, the limits of ``draws``; ``weight``: of a fit's positives."""
    out = Binned(rows, names, jobs, weight, cuts)
    by_day = out.by_day

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            x, found = matrix(b.column("x")), []
            label, key = b.column("label").to_numpy(zero_copy_only=False).astype(np.uint8), b.column("key").to_numpy(zero_copy_only=False)
            member = D.members(b.column("cutoff_date"), label, b.column("text").to_numpy(zero_copy_only=False), jobs, last)
            for day, mine in by_day.items():
                some = np.flatnonzero(member[mine].any(axis=0))
                if len(some):
                    codes = np.stack([np.searchsorted(c, x[some, f]).astype(np.uint8) for f, c in enumerate(cuts[day])])
                    found.append((day, label[some].tobytes(), key[some].tobytes(), np.packbits(member[mine][:, some], axis=1).tobytes(), b"", squeeze(codes)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.string(), *[pa.binary()] * 5], strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    slim = rows.where(F.col("cutoff_date") < max(cuts)).select("cutoff_date", "label", D.text().alias("text"), key_hash().alias("key"), numbers.alias("x"))
    out.blocks = slim.mapInArrow(run, BLOCKS).persist()
    return out


def judged(rows: DataFrame, cuts: dict[str, list[np.ndarray]], numbers: Column) -> DataFrame:
    """Blocks of the rows of the fits' days, in the codes of their day's fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            x, label, days, found = matrix(b.column(2)), b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8), np.array(b.column(0).to_pylist(), dtype=object), []
            for day, points in cuts.items():
                some = np.flatnonzero(days == day)
                if len(some):
                    found.append((day, label[some].tobytes(), squeeze(np.stack([np.searchsorted(c, x[some, f]).astype(np.uint8) for f, c in enumerate(points)]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["day", "label", "codes"])

    return rows.where(F.col("cutoff_date").isin(*cuts)).select("cutoff_date", "label", numbers.alias("x")).mapInArrow(run, "day string, label binary, codes binary")


def _block(b: pa.RecordBatch, i: int, jobs: int, features: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    day, label, key, member, margin, codes = (c[i].as_py() for c in b.columns)
    label = np.frombuffer(label, np.uint8)
    member = np.unpackbits(np.frombuffer(member, np.uint8).reshape(jobs, -1), axis=1, count=len(label)).astype(bool)
    margin = expand(margin, np.float64, jobs) if margin else np.zeros((jobs, len(label)))
    return day, label * 2.0 - 1.0, np.frombuffer(key, np.uint64), member, margin, expand(codes, np.uint8, features)


def features_of(seed: int, tree: int, node: int, of: list[int], share: float) -> list[int]:
    n = math.ceil(share * len(of))
    return of if n >= len(of) else sorted(np.random.default_rng([seed, tree, node]).choice(of, n, replace=False).tolist())


def _count(held: np.ndarray, node: np.ndarray, own: np.ndarray, y: np.ndarray, target: np.ndarray, weight: float, use: list[int], first: bool) -> None:
    """Adds to ``held`` (nodes, features, bins) the rows, the sums of weights and of weighted targets of a fit's rows."""
    start, width, shape = node * BINS, len(held) * BINS, (len(held), BINS)
    if first:  # targets are the labels: one count of both
        start = 2 * start + (target > 0)
        for f in use:
            both = np.bincount(start + 2 * own[f].astype(np.int64), minlength=2 * width).reshape(*shape, 2)
            held[:, f] += np.stack([both.sum(axis=2), both[:, :, 0] + weight * both[:, :, 1], weight * both[:, :, 1] - both[:, :, 0]], axis=2)
        return
    heavy = None if weight == 1 else np.where(y > 0, weight, 1.0)
    if heavy is not None:
        target = target * heavy
    for f in use:
        code = start + own[f]
        n = np.bincount(code, minlength=width)
        held[:, f, :, 0] += n.reshape(shape)
        held[:, f, :, 1] += (n if heavy is None else np.bincount(code, heavy, width)).reshape(shape)
        held[:, f, :, 2] += np.bincount(code, target, width).reshape(shape)


def _counted(rows: Binned, open_: dict[int, list[int]], grown: dict[int, Tree], past: dict[int, list[Tree]], number: int, seeds: dict[int, int], of: list[int], params: dict) -> DataFrame:
    """(job, node, sums): by feature and bin, the rows, the sums of weights and of weighted targets; a row for each task."""
    by_day, many, weight, rate = {d: (jobs, [j for j in jobs if j in open_]) for d, jobs in rows.by_day.items()}, len(rows.names), rows.weight, params["rate"]
    use = {j: sorted({f for n in nodes for f in features_of(seeds[j], number, n, of, params["columns"])}) for j, nodes in open_.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {j: np.zeros((len(nodes), many, BINS, 3)) for j, nodes in open_.items()}
        for b in batches:
            for i in range(b.num_rows):
                every, mine = by_day[b.column(0)[i].as_py()]
                if not mine:
                    continue
                _, y, key, member, margin, codes = _block(b, i, len(every), many)
                for j in mine:
                    at = every.index(j)
                    some = np.flatnonzero(member[at] & share_of(key, seeds[j], number, params["rows"]))
                    own, target = codes[:, some], y[some]
                    if number:
                        told = margin[at, some]
                        for k, tree in past[j]:
                            told = told + np.array(tree.value)[tree.nodes(own)] * (rate if k else 1.0)
                        target = 4 * target / (1 + np.exp(2 * target * told))
                    nodes = open_[j]
                    place = np.full(len(grown[j].feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    node = place[grown[j].nodes(own)]
                    if (node < 0).any():
                        kept = node >= 0
                        node, own, target, some = node[kept], own[:, kept], target[kept], some[kept]
                    _count(held[j], node, own, y[some], target, weight[j], use[j], not number)
        for j, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(sums), pa.int32()), pa.array(open_[j], pa.int32()), pa.array([squeeze(s) for s in sums], pa.binary())], names=["job", "node", "sums"])

    return rows.blocks.mapInArrow(run, "job int, node int, sums binary")


def _split(sums: np.ndarray, seed: int, number: int, node: int, of: list[int], params: dict) -> tuple[int, int, float, float, float, float]:
    """A node's best split by the sums of its features and bins: (feature or -1, bin, the sides' values, its own, gain)."""
    some = features_of(seed, number, node, of, params["columns"])
    n, w, t = np.moveaxis(np.cumsum(sums[some], axis=1), 2, 0)
    whole, weight, total = n[:, -1:], w[:, -1:], t[:, -1:]
    n, w, t = n[:, :-1], w[:, :-1], t[:, :-1]
    fits = (n >= params["min_rows"]) & (whole - n >= params["min_rows"])
    with np.errstate(all="ignore"):
        left, right = t / w, (total - t) / (weight - w)
        gain = np.where(fits, (t * left + (total - t) * right - total**2 / weight) / weight, -1.0)
        mean = float((total / weight)[0, 0]) if whole[0, 0] else 0.0
    f, at = divmod(int(gain.argmax()), BINS - 1)
    if not gain[f, at] > 1e-12:
        return -1, at, 0.0, 0.0, mean, 0.0
    return some[f], at, float(left[f, at]), float(right[f, at]), mean, float(gain[f, at] * weight[f, 0])


def _best(number: int, seeds: dict[int, int], of: list[int], params: dict, features: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        job, node = key[0].as_py(), key[1].as_py()
        sums = sum(expand(s.as_py(), np.float64, 1) for s in table["sums"]).reshape(features, BINS, 3)
        row = (job, node, *_split(sums, seeds[job], number, node, of, params))
        return pa.table([[v] for v in row], schema=pa.schema([("job", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("left", pa.float64()), ("right", pa.float64()), ("mean", pa.float64()), ("gain", pa.float64())]))

    return run


def _stored(rows: Binned, past: dict[int, list[tuple[int, Tree]]], rate: float) -> DataFrame:
    """The blocks with what the trees so far add up to for each row."""
    by_day, many = rows.by_day, len(rows.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = []
            for i in range(b.num_rows):
                every = by_day[b.column(0)[i].as_py()]
                _, _, _, _, margin, codes = _block(b, i, len(every), many)
                margin = margin.copy()
                for at, j in enumerate(every):
                    for k, tree in past.get(j, ()):
                        margin[at] += np.array(tree.value)[tree.nodes(codes)] * (rate if k else 1.0)
                margins.append(squeeze(margin))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(margins, pa.binary()), b.column(5)], names=b.schema.names)

    return rows.blocks.mapInArrow(run, BLOCKS)


def _tree(number: int, own: np.ndarray, y: np.ndarray, target: np.ndarray, weight: float, seed: int, of: list[int], params: dict) -> Tree:
    """A tree grown on rows at hand, by the steps of the shared passes."""
    tree, nodes, at = Tree(), [0], np.zeros(own.shape[1], np.int64)
    for level in range(params["depth"]):
        use = sorted({f for n in nodes for f in features_of(seed, number, n, of, params["columns"])})
        sums, after = np.zeros((len(nodes), len(own), BINS, 3)), []
        _count(sums, at, own, y, target, weight, use, not number)
        feature, point, left, right = (np.full(len(nodes), v) for v in (0, 0, -1, -1))  # -1: a leaf
        for i, n in enumerate(nodes):
            f, b, low, high, mean, gain = _split(sums[i], seed, number, n, of, params)
            if not level:
                tree.value[0] = mean
            if f >= 0:
                feature[i], point[i], left[i], right[i] = f, b, len(after), len(after) + 1
                after += tree.split(n, f, b, (low, high), gain)
        nodes = after
        if not nodes or level + 1 == params["depth"]:
            break
        at = np.where(own[feature[at], np.arange(len(at))] <= point[at], left[at], right[at])
        if (at < 0).any():
            kept = at >= 0
            at, own, y, target = at[kept], own[:, kept], y[kept], target[kept]
    return tree


def _trees(label: np.ndarray, key: np.ndarray, codes: np.ndarray, weight: float, seed: int, of: list[int], params: dict, patience: int | None, val: tuple[np.ndarray, np.ndarray] | None) -> tuple[int, list[Tree]]:
    """(best prefix, its trees) of a fit whose rows are at hand; without ``patience`` all trees."""
    order = np.argsort(key, kind="stable")  # sums don't depend on the rows' places
    y, key, codes, grown, best, at = label[order] * 2.0 - 1.0, key[order], codes[:, order], [], -1.0, 1
    margin, told = np.zeros(len(y)), np.zeros(len(val[0]) if val else 0)
    for number in range(params["trees"]):
        some = np.flatnonzero(share_of(key, seed, number, params["rows"]))
        target = 4 * y[some] / (1 + np.exp(2 * y[some] * margin[some])) if number else y[some]
        tree = _tree(number, codes[:, some], y[some], target, weight, seed, of, params)
        grown.append(tree)
        value, rate = np.array(tree.value), params["rate"] if number else 1.0
        margin += value[tree.nodes(codes)] * rate
        if patience is not None:
            told += value[tree.nodes(val[1])] * rate
            area = M.areas(told, val[0])[2]
            if area > best:  # never so for NaN
                best, at = area, number + 1
            elif number + 1 - at >= patience:
                break
    return (at, grown[:at]) if patience is not None else (len(grown), grown)


def _alone(rows: Binned, names: list[str], params: dict, seeds: dict[int, int]) -> dict[int, list[tuple]]:
    """The fits of ``seeds``, each by a task of its own, the largest first."""
    of, many, jobs, weight, cuts, patience, by_day = [rows.names.index(n) for n in names], len(rows.names), rows.jobs, rows.weight, rows.cuts, rows.patience, rows.by_day
    place = {j: i for i, j in enumerate(sorted(seeds, key=lambda j: -rows.sizes[j]))}
    columns = {"place": pa.int32(), "job": pa.int32(), "label": pa.binary(), "key": pa.binary(), "codes": pa.binary()}
    kinds = ", ".join(f"{c} {'int' if t == pa.int32() else 'binary'}" for c, t in columns.items())

    def batch(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, columns.values(), strict=True)], names=list(columns))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                every = by_day[b.column(0)[i].as_py()]
                if any(j in place for j in every):
                    _, y, key, member, _, codes = _block(b, i, len(every), many)
                    for at, j in enumerate(every):
                        if j in place and member[at].any():
                            some = np.flatnonzero(member[at])
                            yield batch((place[j], j, (y[some] > 0).astype(np.uint8).tobytes(), key[some].tobytes(), squeeze(codes[:, some])))

    def val(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                day, label, codes = (c[i].as_py() for c in b.columns)
                for j in by_day[day]:
                    if j in place:
                        yield batch((place[j], j, label, None, codes))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple]] = {}
        for b in batches:
            for _, j, label, key, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                y = np.frombuffer(label, np.uint8)
                held.setdefault((j, key is None), []).append((y, np.frombuffer(key or b"", np.uint64), expand(codes, np.uint8, many)))

        def whole(parts: list[tuple]) -> list[np.ndarray]:
            empty = [(np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros((many, 0), np.uint8))]
            return [np.concatenate(c, axis=-1) for c in zip(*(parts or empty), strict=True)]

        for j in sorted({j for j, _ in held}):
            label, _, codes = whole(held.pop((j, True), []))
            at, trees = _trees(*whole(held.pop((j, False), [])), weight[j], seeds[j], of, params, patience, (label, codes))
            made = [t.arrays(cuts[jobs[j]["day"]], params["rate"] if k else 1.0) for k, t in enumerate(trees)]
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([at], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], names=["job", "best", "trees"])

    apart = rows.blocks.mapInArrow(train, kinds)
    if patience is not None:
        apart = apart.unionByName(rows.judged.mapInArrow(val, kinds))
    found = apart.repartitionById(len(place), F.col("place")).mapInArrow(fit, "job int, best int, trees binary").collect()
    if patience is not None:
        rows.best.update({r.job: r.best for r in found})
    return {r.job: pickle.loads(r.trees) for r in found}


def grow(rows: Binned, names: list[str], params: dict, seeds: dict[int, int]) -> dict[int, list[tuple]]:
    """The trees of the fits ``seeds`` names, grown on the features ``names``, as ``models.run_trees`` takes them."""
    small = {j: s for j, s in seeds.items() if rows.sizes and 0 < rows.sizes[j] * len(rows.names) <= ALONE}
    found = _alone(rows, names, params, small) if small else {}
    large = {j: s for j, s in seeds.items() if j not in small}
    return found | (_together(rows, names, params, large) if large else {})


def _together(rows: Binned, names: list[str], params: dict, seeds: dict[int, int]) -> dict[int, list[tuple]]:
    """The fits of ``seeds`` in shared passes over all rows, a few for each level of a tree."""
    of = [rows.names.index(n) for n in names]
    most = max(1, HELD // (len(rows.names) * BINS * 3 * 8))
    done: dict[int, list[Tree]] = {j: [] for j in seeds}
    past: dict[int, list[tuple[int, Tree]]] = {j: [] for j in seeds}
    own, judge = rows, rows.judge() if rows.patience is not None else None

    def arrays() -> dict[int, list[tuple]]:
        return {j: [tree.arrays(rows.cuts[rows.jobs[j]["day"]], params["rate"] if k else 1.0) for k, tree in enumerate(trees)] for j, trees in done.items()}

    for number in range(params["trees"]):
        if judge and number and number % rows.patience == 0:
            settled = judge.look(arrays())
            seeds = {j: s for j, s in seeds.items() if j not in settled}
            if not seeds:
                break
        if number and number % REPLAYED == 0:
            blocks = _stored(own, past, params["rate"]).persist()
            blocks.count()
            if own is not rows:
                own.blocks.unpersist()
            own, past = Binned(blocks, rows.names, rows.jobs, rows.weight, rows.cuts), {j: [] for j in seeds}
        grown = {j: Tree() for j in seeds}
        open_ = {j: [0] for j in seeds}
        for level in range(params["depth"]):
            after: dict[int, list[int]] = {}
            for turn in _turns(open_, most):
                counts = _counted(own, turn, grown, past, number, seeds, of, params)
                best = counts.groupBy("job", "node").applyInArrow(_best(number, seeds, of, params, len(rows.names)), "job int, node int, feature int, bin int, left double, right double, mean double, gain double")
                for r in sorted(best.collect(), key=lambda r: (r.job, r.node)):
                    if not level:
                        grown[r.job].value[0] = r.mean
                    if r.feature >= 0:
                        after.setdefault(r.job, []).extend(grown[r.job].split(r.node, r.feature, r.bin, (r.left, r.right), r.gain))
            open_ = {j: sorted(nodes) for j, nodes in after.items()}
        for j in seeds:
            done[j].append(grown[j])
            past[j].append((number, grown[j]))
    if own is not rows:
        own.blocks.unpersist()
    found = arrays()
    if judge:
        judge.look(found)
        rows.best.update({j: judge.at.get(j, 1) for j in found})
        return {j: trees[: rows.best[j]] for j, trees in found.items()}
    return found


def _turns(open_: dict[int, list[int]], most: int) -> Iterator[dict[int, list[int]]]:
    """Fits' nodes in portions of ``most`` at most, a fit's own in several if need be."""
    turn, held = {}, 0
    for j, nodes in open_.items():
        for at in range(0, len(nodes), most):
            part = nodes[at : at + most]
            if turn and (held + len(part) > most or j in turn):
                yield turn
                turn, held = {}, 0
            turn[j] = part
            held += len(part)
    if turn:
        yield turn
