"""Tree ensembles grown from shared histograms: boosting, forests, extremely randomised trees.

Features are binned once, at their quantiles. A pass over the rows then serves every ensemble at once: each open node of each tree that is
growing gets sums of gradients and hessians per feature and bin, and its best split, so a pass costs one read of the table
however many grid cells, folds and classes are trained. Ensembles don't wait for each other: one may be at another level or round than the
next. Tasks add up their own rows; the cells of a node meet in one task, which picks the split, and only splits reach the driver.

A table that a task can hold (``HELD_BINS``) has more use for tasks that grow whole ensembles: each gets the rows once, and no pass is a job
(:func:`whole_ensembles`). Both ways grow the same trees.

Gradients are whole multiples of 2^-24, so their sums don't depend on how rows are dealt. Rows, features and cut points that are
drawn follow from hashes of the row's id, the tree and the node (:func:`scramble`): reruns agree on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.functions.values import hashed_uniform
from icuflow.sources.tables import stage

BINS = 32
SCALE = float(1 << 24)
PRIME = 2_147_483_647
PART_ROWS = 65_536  # rows of a part of the binned table
CELLS = 1 << 24  # sums that a task holds; more open nodes take a further pass
HELD_BINS = 1 << 26  # bins (rows times features) up to which a task may hold the whole table
AT_ONCE = 1 << 16  # cells of rows that are added up in one call
HELD_ROUNDS = 10  # finished trees of an ensemble until the margins are written anew
CHUNK_ROWS = 4_096
LEAST_GAIN = 1e-6
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]


def scramble(x, v):
    """A draw from 0 to PRIME - 1 that follows from ``x`` and ``v``; both below PRIME. Works on numbers and int64 arrays."""
    q = (x * 48271 + v) % PRIME
    s = q * q % PRIME
    return s * s % PRIME * q % PRIME


@dataclass(frozen=True)
class Ensemble:
    """Settings of one ensemble.

    ``boost`` fits gradients of the logistic (two classes), softmax or squared loss; ``rows`` and ``columns`` are the shares drawn for each round.
    ``forest`` and ``extra`` grow all ``rounds`` trees at once on Poisson-weighted rows and look at a share ``columns`` of the features at each
    node; ``extra`` tries one random cut per feature. ``least`` is the smallest hessian (rows, for forests) of a child, ``fold`` is not
    learnt from, ``prior`` starts from the class shares.
    """

    kind: str = "boost"
    classes: int = 2
    rounds: int = 50
    depth: int = 3
    rate: float = 0.1
    l2: float = 0.0
    least: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    loss: str = "logistic"
    prior: bool = False
    fold: int | None = None
    seed: int = 42

    @property
    def outputs(self) -> int:
        """Trees of a round."""
        return self.classes if self.kind == "boost" and self.loss == "logistic" and self.classes > 2 else 1

    @property
    def channels(self) -> int:
        """Gradients of a node."""
        return 1 if self.kind == "boost" else self.classes

    def leaf(self, sums: Sequence[float]) -> list[float]:
        """Value of a node from its gradients and hessian."""
        *g, h = sums
        return [-self.rate * g[0] / (h + self.l2)] if self.kind == "boost" else [x / h for x in g]


@dataclass
class Tree:
    """Nodes as lists; ``left`` is the first of two neighbouring children, 0 for a leaf; ``heap`` numbers a node 2n or 2n + 1 below n."""

    number: int
    output: int
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    heap: list[int] = field(default_factory=lambda: [1])
    value: list[list[float]] = field(default_factory=lambda: [[]])
    gain: list[float] = field(default_factory=lambda: [0.0])
    weight: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def level(self, node: int) -> int:
        return self.heap[node].bit_length() - 1

    def split(self, node: int, feature: int, cut: int, gain: float) -> None:
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, len(self.feature), gain
        for side in (0, 1):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.heap.append(2 * self.heap[node] + side)
            self.value.append([])
            self.gain.append(0.0)
            self.weight.append(0.0)


@dataclass
class Packed:
    """Many trees in flat arrays; a leaf's left child is itself and no value is above its cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    roots: np.ndarray
    depth: int

    @classmethod
    def of(cls, trees: Sequence[Tree], cuts: Sequence[np.ndarray] | None = None) -> Packed:
        """With ``cuts`` nodes compare raw values, else bins."""
        roots = np.cumsum([0, *[len(t.feature) for t in trees]])
        feature = np.array([f for t in trees for f in t.feature], np.int64)
        left = np.array([x + r if x else i + r for t, r in zip(trees, roots) for i, x in enumerate(t.left)], np.int64)
        if cuts is None:
            cut = np.where(feature < 0, 255, np.array([c for t in trees for c in t.cut], np.int64))
        else:
            cut = np.array([cuts[f][c] if f >= 0 else np.inf for t in trees for f, c in zip(t.feature, t.cut)])
        depth = max((h.bit_length() - 1 for t in trees for h in t.heap), default=0)
        return cls(np.maximum(feature, 0), cut, left, roots[:-1], depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Node of each row in each tree; nulls (NaN) go left."""
        node = np.repeat(self.roots[:, None], len(x), 1)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
        return node


def probabilities(spec: Ensemble, margins: np.ndarray) -> np.ndarray:
    """(rows, classes) of (rows, outputs); the squared loss keeps its values."""
    if spec.loss == "squared":
        return margins
    if spec.outputs == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([1 - p, p], 1)
    e = np.exp(margins - margins.max(1, keepdims=True))
    total = e[:, 0]
    for k in range(1, spec.outputs):  # in order, so that every engine rounds alike
        total = total + e[:, k]
    return e / total[:, None]


@dataclass
class Model:
    """A grown ensemble with its cut points."""

    spec: Ensemble
    start: list[float]
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a row for each row of ``x``. Trees of a forest that drew no row don't count; without any, classes are alike."""
        trees = [t for t in self.trees if t.weight[0] > 0]
        packed = Packed.of(trees, self.cuts)
        value = np.array([v for t in trees for v in t.value], float)
        out = []
        for i in range(0, len(x), CHUNK_ROWS):
            node = packed.leaves(x[i : i + CHUNK_ROWS])
            if self.spec.kind == "boost":
                total = np.tile(np.array(self.start), (node.shape[1], 1))
                for t, leaf in zip(trees, node):
                    total[:, t.output] += value[leaf, 0]
                out.append(probabilities(self.spec, total))
            else:
                total = np.zeros((node.shape[1], self.spec.classes))
                for leaf in node:
                    total += value[leaf]
                out.append(total / len(trees) if trees else total + 1 / self.spec.classes)
        return np.concatenate(out) if out else np.zeros((0, self.spec.classes))

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the gains of each feature's splits, and how many there are."""
        total, n = np.zeros(len(self.cuts)), np.zeros(len(self.cuts), int)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[f] += g
                    n[f] += 1
        return total, n

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a relation: a row per node, children of node n are 2n (values up to the threshold, and nulls) and 2n + 1."""
        rows = [
            (t.number, t.output, h, f if f >= 0 else None, float(self.cuts[f][c]) if f >= 0 else None, g, w, v)
            for t in self.trees for h, f, c, g, w, v in zip(t.heap, t.feature, t.cut, t.gain, t.weight, t.value)]
        return spark.createDataFrame(
            rows, "tree int, output int, node long, feature int, threshold double, gain double, weight double, value array<double>")


def leaves_by_joins(rows: DataFrame, key: str, nodes: DataFrame, depth: int) -> DataFrame:
    """(key, tree, output, value): the leaf of every row in every tree, one join with the node table per level.

    The node table is small next to the rows (a fitted model) and is broadcast if Spark's size estimate allows.
    """
    at = rows.select(key, "features").crossJoin(nodes.where("node = 1").select("tree", "output", "node"))  # every row meets every tree by definition
    for _ in range(depth):
        inner = nodes.where("feature is not null").select("tree", "output", "node", "feature", "threshold")
        value = F.get("features", "feature")
        down = F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.coalesce(value > F.col("threshold"), F.lit(False)).cast("int"))
        at = at.join(inner, ["tree", "output", "node"], "left").select(key, "features", "tree", "output", down.alias("node"))
    return at.join(nodes.select("tree", "output", "node", "value"), ["tree", "output", "node"]).select(key, "tree", "output", "value")


class Growth:
    """An ensemble while it grows."""

    def __init__(self, spec: Ensemble, model: Model, first: int):
        self.spec, self.model, self.first = spec, model, first  # first: its first margin
        self.round = 0
        self.growing: list[Tree] = []
        self.held: list[list[Tree]] = []  # finished rounds that the margins don't hold yet
        self.begin()

    def begin(self) -> None:
        if self.spec.kind == "boost":
            self.growing = [Tree(self.round, k) for k in range(self.spec.outputs)] if self.round < self.spec.rounds else []
        else:
            self.growing = [Tree(t, 0) for t in range(self.spec.rounds)] if not self.round else []

    def settle(self) -> None:
        """Go on to the next round once no node is open."""
        if self.growing and not any(t.open for t in self.growing):
            self.model.trees += self.growing
            if self.spec.kind == "boost":
                self.held.append(self.growing)
            self.round += 1
            self.begin()


@dataclass
class Job:
    """What a pass hands to its tasks: held trees, growing trees, and the slots of their open nodes."""

    specs: list[tuple[Ensemble, int, int]]  # of each growing tree: settings, first margin, number
    outputs: list[int]
    held: list[tuple[Packed, np.ndarray, np.ndarray]]  # per round that isn't in the margins: trees, values, margins they add to
    growing: Packed
    slot_of: np.ndarray
    slots: list[tuple[int, int]]  # growing tree and heap number of each slot
    size: int
    channels: int

    def margins(self, x: np.ndarray, margins: np.ndarray) -> np.ndarray:
        out = margins.copy()
        for trees, value, to in self.held:
            for leaf, k in zip(trees.leaves(x), to):
                out[:, k] += value[leaf]
        return out

    def add(self, sums: np.ndarray, x: np.ndarray, y: np.ndarray, fold: np.ndarray, base: np.ndarray, margins: np.ndarray) -> None:
        """Add rows to the (slot, feature, bin, channel) sums; the last channel is the hessian."""
        margins = self.margins(x, margins)
        slot = self.slot_of[self.growing.leaves(x)]
        owner, rows, values = [], [], []
        for mine, (spec, first, number), output in zip(slot, self.specs, self.outputs):
            if not (mine >= 0).any():
                continue
            g, h, learnt = gradients(spec, margins[:, first : first + spec.outputs], number, output, y, fold, base)
            at = np.flatnonzero(learnt & (mine >= 0))
            full = np.zeros((self.channels + 1, len(at)))
            full[: len(g)], full[-1] = g[:, at], h[at]
            owner.append(mine[at])
            rows.append(at)
            values.append(full)
        if not owner:
            return
        owner, rows, values = np.concatenate(owner), np.concatenate(rows), np.concatenate(values, 1)
        n = len(self.slots)
        for f in range(self.size):
            cell = owner * BINS + x[rows, f]
            for c in range(self.channels + 1):
                sums[:, f, :, c] += np.bincount(cell, values[c], n * BINS).reshape(n, BINS)

    def best(self, slots: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        """The best split of each slot: largest gain, then first feature, then first bin; feature -1 if there is none."""
        found = [self.choose(slots[i : i + 64], sums[i : i + 64]) for i in range(0, len(slots), 64)]
        columns = [np.concatenate(c) if len(found) else [] for c in zip(*found)]
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), *[pa.array(c if c.ndim == 1 else list(c), k) for c, k in zip(columns, [*SPLIT.values()][1:])]], names=list(SPLIT))

    def choose(self, slots: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, ...]:
        """(feature, cut, gain, sums of the left child, sums) of some slots."""
        of = [(*self.specs[tree], heap) for tree, heap in (self.slots[s] for s in slots.tolist())]
        sums = np.moveaxis(cells, -1, 0)
        valid = np.stack([tried(spec, number, heap, self.size) for spec, _, number, heap in of])[:, :, None] & np.ones(BINS, bool)
        for i, (spec, _, number, heap) in enumerate(of):
            if spec.kind == "extra":
                valid[i] &= random_cut(spec, number, heap, sums[-1, i])
        feature, cut, gain, part, total = best_cuts([spec for spec, *_ in of], sums, valid)
        return feature, cut, gain, part.T, total.T


def gradients(spec: Ensemble, margins: np.ndarray, number: int, output: int, y: np.ndarray, fold: np.ndarray, base: np.ndarray):
    """(channels, rows) gradients and hessians in units of 1 / SCALE, and the rows that are learnt from; ``margins`` are the ensemble's own."""
    learnt = fold != spec.fold if spec.fold is not None else np.ones(len(y), bool)
    draw = scramble(base, scramble(spec.seed, number))
    if spec.kind != "boost":
        times = np.searchsorted(POISSON, draw / PRIME, "right").astype(float)
        return np.stack([times * (y == c) for c in range(spec.classes)]), times, learnt & (times > 0)
    if spec.rows < 1:
        learnt &= draw < spec.rows * PRIME
    if spec.loss == "squared":
        return np.rint((margins[:, 0] - y) * SCALE)[None], np.full(len(y), SCALE), learnt
    p = probabilities(spec, margins)[:, output if spec.outputs > 1 else 1]
    target = (y == output) if spec.outputs > 1 else (y == 1)
    return np.rint((p - target) * SCALE)[None], np.rint(p * (1 - p) * SCALE), learnt


def best_cuts(specs: Sequence[Ensemble], sums: np.ndarray, valid: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(feature, cut, gain, (channel, node) sums of the left child and of all) from (channel, node, feature, bin) sums, a setting for each node.

    ``whole`` are the sums of each node; the first feature has them if it isn't given.
    """
    scale = np.array([SCALE if spec.kind == "boost" else 1.0 for spec in specs])
    l2, least = (np.array([getattr(spec, name) for spec in specs])[:, None, None] for name in ("l2", "least"))
    left = np.cumsum(sums / scale[:, None, None], 3)
    total = left[:, :, 0, -1] if whole is None else whole / scale
    h, whole = left[-1], total[:, :, None, None]
    right_h = whole[-1] - h
    valid = valid & (h >= least) & (right_h >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.zeros(h.shape)
        for c in range(len(sums) - 1):
            other = whole[c] - left[c]
            gain = gain + left[c] * left[c] / (h + l2) + other * other / (right_h + l2)
        for c in range(len(sums) - 1):
            gain = gain - whole[c] * whole[c] / (whole[-1] + l2)
    gain = np.where(valid, gain, -np.inf).reshape(len(specs), -1)
    at = gain.argmax(1)
    most = gain[np.arange(len(specs)), at]
    some = most > LEAST_GAIN
    feature, cut = np.divmod(at, BINS)
    return np.where(some, feature, -1), np.where(some, cut, 0), np.where(some, most, 0.0), left[:, np.arange(len(specs)), feature, cut], total


def random_cut(spec: Ensemble, number: int, heap: int, weight: np.ndarray) -> np.ndarray:
    """The one cut of each feature that a node of an extremely randomised tree tries, from its (feature, bin) weights."""
    some = weight > 0
    low, high = some.argmax(1), BINS - 1 - some[:, ::-1].argmax(1)
    u = scramble(scramble(scramble(spec.seed + 1, number), heap), np.arange(len(weight)))
    return np.arange(BINS) == (low + u * (high - low) // PRIME)[:, None]


def tried(spec: Ensemble, number: int, heap: int, size: int) -> np.ndarray:
    """Which features a node may be split at."""
    keep = max(1, int(spec.columns * size))
    if heap.bit_length() > spec.depth or keep == size:
        return np.full(size, heap.bit_length() <= spec.depth)
    start = scramble(spec.seed, number)
    draws = scramble(start if spec.kind == "boost" else scramble(start, heap), np.arange(size))
    out = np.zeros(size, bool)
    out[np.argsort(draws, kind="stable")[:keep]] = True
    return out


SPLIT = {"slot": pa.int32(), "feature": pa.int32(), "cut": pa.int32(), "gain": pa.float64(), "part": pa.list_(pa.float64()), "total": pa.list_(pa.float64())}
SPLIT_DDL = "slot int, feature int, cut int, gain double, part array<double>, total array<double>"
BINNED = "base long, y double, fold int, x binary, m binary"


def columns_of(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """Bins (rows, features), label, fold, base draw and margins of a batch of the binned table."""
    n = batch.num_rows
    x = flat_binary(batch.column(3)).reshape(n, size)
    m = flat_binary(batch.column(4)).view(np.float64).reshape(n, -1)
    return x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(0).to_numpy(), m


def flat_binary(column: pa.Array) -> np.ndarray:
    """The bytes of a column of binaries, one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of equally long arrays as a matrix; nulls are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def cut_points(rows: DataFrame, size: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature; a value's bin is the number of cuts below it. One pass; only cuts reach the driver."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, F.lit(10_000)).alias(f"c{i}") for i in range(size)]).first()
    return [np.unique(np.array(c or [], float)) for c in found]


def bins_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f])) for f, c in enumerate(cuts)], 1).astype(np.uint8)


def binned(rows: DataFrame, cuts: list[np.ndarray], start: list[float], parts: int) -> DataFrame:
    size = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bins_of(matrix(batch.column(3), size), cuts)
            m = np.tile(np.array(start, float), (batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fixed_binary(bins), fixed_binary(m)], names=["base", "y", "fold", "x", "m"])

    return kept(rows.select("base", "y", "fold", "x").repartition(parts).mapInArrow(run, BINNED), parts)


def kept(df: DataFrame, parts: int) -> DataFrame:
    """Written to the shared folder and cached from there: a lost executor's part is read again."""
    held = stage(df, "binned")
    return (held.coalesce(1) if parts == 1 else held).persist()


def with_margins(rows: DataFrame, job: Job, parts: int) -> DataFrame:
    size = job.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_batch(batch):
                x, _, _, _, m = columns_of(part, size)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], fixed_binary(job.margins(x, m))], names=part.schema.names)

    return kept(rows.mapInArrow(run, BINNED), parts)


def cut_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, CHUNK_ROWS) for i in range(0, batch.num_rows, CHUNK_ROWS))


def splits(rows: DataFrame, job: Job, parts: int) -> pa.Table:
    """One pass: the best split of every slot."""
    shape = (len(job.slots), job.size, BINS, job.channels + 1)

    def summed(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros(shape)
        for batch in batches:
            for part in cut_batch(batch):
                job.add(sums, *columns_of(part, job.size))
        return sums

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield job.best(np.arange(shape[0]), summed(batches))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = summed(batches).reshape(shape[0], -1)
        for i in range(0, shape[0], 64):
            some = sums[i : i + 64]
            at = [np.flatnonzero(s).astype(np.int32) for s in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array([a.tobytes() for a in at], pa.binary()),
                 pa.array([s[a].tobytes() for s, a in zip(some, at)], pa.binary())], names=["slot", "at", "value"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, at, value in zip(*(c.to_pylist() for c in batch.columns)):
                cells = held.setdefault(slot, np.zeros(int(np.prod(shape[1:]))))
                cells[np.frombuffer(at, np.int32)] += np.frombuffer(value)
        if held:
            yield job.best(np.array(list(held)), np.stack(list(held.values())).reshape(len(held), *shape[1:]))

    if parts == 1:
        return rows.mapInArrow(alone, SPLIT_DDL).toArrow()
    cells = rows.mapInArrow(partial, "slot int, at binary, value binary")
    return cells.repartition(min(parts, -(-shape[0] // 8)), "slot").mapInArrow(merged, SPLIT_DDL).toArrow()


def job_of(growths: list[Growth], size: int, limit: int) -> Job:
    """The next pass: all open nodes, or as many as a task may hold."""
    units = [(g, t) for g in growths for t in g.growing if t.open]
    channels = max([g.spec.channels for g, _ in units], default=1)
    most = max(1, limit // (size * BINS * (channels + 1)))
    packed = Packed.of([t for _, t in units])
    slot_of = np.full(len(packed.feature), -1, np.int64)
    slots = []
    for u, ((_, t), root) in enumerate(zip(units, packed.roots)):
        for node in t.open:
            if len(slots) < most:
                slot_of[root + node] = len(slots)
                slots.append((u, t.heap[node]))
    held = []
    for i in range(max((len(g.held) for g in growths), default=0)):
        trees = [(g.first + t.output, t) for g in growths if len(g.held) > i for t in g.held[i]]
        held.append((Packed.of([t for _, t in trees]), np.array([v[0] for _, t in trees for v in t.value]), np.array([k for k, _ in trees])))
    return Job([(g.spec, g.first, t.number) for g, t in units], [t.output for _, t in units], held, packed, slot_of, slots, size, channels)


def cell_sums(x: np.ndarray, features: np.ndarray, rows: np.ndarray, slot: np.ndarray, values: np.ndarray, slots: int, asked: np.ndarray | None) -> np.ndarray:
    """(channel, slot, feature, bin) sums of the ``values`` of ``rows``; ``asked`` has the features that each slot needs, or all do."""
    out = np.zeros((len(values), len(features), slots, BINS))
    base, step = slot * BINS, max(1, AT_ONCE // max(len(rows), 1)) if asked is None else 1
    for i in range(0, len(features), step):
        some = features[i : i + step]
        if asked is not None:
            at = np.flatnonzero(asked[slot, some[0]])
            cell, mine = base[at] + x[some[0]].take(rows[at]), values[:, at]
        else:
            cell = (x[some].take(rows, 1) + (base + (np.arange(len(some)) * slots * BINS)[:, None])).ravel()
            mine = values if len(some) == 1 else np.tile(values, len(some))
        for c, v in enumerate(mine):
            out[c, i : i + step] = np.bincount(cell, v, len(some) * slots * BINS).reshape(len(some), slots, BINS)
    return out.swapaxes(1, 2)


def fill(tree: Tree, spec: Ensemble, x: np.ndarray, values: np.ndarray, learnt: np.ndarray, limit: int) -> np.ndarray:
    """Grow one tree on (feature, row) bins and (channel, row) gradients in memory; the node of every row, learnt from or not.

    A node that is too light to be split isn't added up, and of two neighbours only the one with fewer rows if their parent's sums are at
    hand: sums are of whole numbers, so the other's are the difference.
    """
    size, n = x.shape
    boost = spec.kind == "boost"
    first = tried(spec, tree.number, 1, size)
    features = np.flatnonzero(first) if boost and first.any() else np.arange(size)
    most = max(1, limit // (size * BINS * len(values)))
    rows = np.flatnonzero(learnt)
    node = np.zeros(n, np.int32)
    above: dict[int, np.ndarray] = {}  # sums of the parent by its first child
    while tree.open:
        now = tree.open[:most]
        place = {k: i for i, k in enumerate(now)}
        here = node[rows]
        count = np.bincount(here, minlength=len(tree.left))
        pairs = [(k, k + 1) if count[k] <= count[k + 1] else (k + 1, k) for k in now if k in above and k + 1 in place]
        rest = {other for _, other in pairs}
        slot_of = np.full(len(tree.left), -1)
        added = [k for k in now if k not in rest]
        slot_of[added] = np.arange(len(added))
        slot = slot_of[here]
        at = np.flatnonzero(slot >= 0)
        asked = None if boost else np.stack([tried(spec, tree.number, tree.heap[k], size) for k in added])
        found = cell_sums(x, features, rows[at], slot[at], values[:, rows[at]], len(added), None if asked is None or asked.all() else asked)
        sums = np.zeros((len(values), len(now), len(features), BINS))
        sums[:, [place[k] for k in added]] = found
        for few, many in pairs:
            sums[:, place[many]] = above[min(few, many)] - sums[:, place[few]]
        fresh: dict[int, np.ndarray] = {}
        whole = None if boost else np.stack([np.bincount(slot[at], v, len(now)) for v in values[:, rows[at]]])
        for i in range(0, len(now), 64):
            some, cells = now[i : i + 64], sums[:, i : i + 64]
            valid = np.full((len(some), len(features), BINS), first.any())
            if not boost:
                valid &= asked[i : i + 64, :, None]
            if spec.kind == "extra":
                for j, k in enumerate(some):
                    valid[j] &= random_cut(spec, tree.number, tree.heap[k], cells[-1, j])
            feature, cut, gain, part, total = best_cuts([spec] * len(some), cells, valid, None if boost else whole[:, i : i + 64])
            for j, k in enumerate(some):
                left = len(tree.left)
                learn(spec, tree, k, {"feature": int(features[feature[j]]) if feature[j] >= 0 else -1, "cut": int(cut[j]), "gain": float(gain[j]),
                                      "part": part[:, j].tolist(), "total": total[:, j].tolist()})
                if feature[j] >= 0 and left in tree.open:
                    for child in (left, left + 1):
                        if tree.weight[child] < 2 * spec.least:
                            tree.open.remove(child)
                    if boost and left in tree.open and left + 1 in tree.open:
                        fresh[left] = cells[:, j]
        above = fresh if 2 * len(fresh) <= most else {}
        down = np.zeros(len(tree.left), np.int32)
        down[now] = [tree.left[k] for k in now]
        moved = np.flatnonzero(down[node])
        was = node[moved]
        node[moved] = down[was] + (x[np.array(tree.feature)[was], moved] > np.array(tree.cut)[was])
    return node


def grow_alone(spec: Ensemble, start: Sequence[float], x: np.ndarray, y: np.ndarray, fold: np.ndarray, base: np.ndarray, limit: int) -> tuple[list[Tree], np.ndarray]:
    """The trees of one ensemble on (feature, row) bins in memory, and the probabilities of all rows, as :meth:`Model.predict` gives them."""
    boost = spec.kind == "boost"
    total = np.tile(np.array(start, float), (len(y), 1)) if boost else np.zeros((len(y), spec.classes))
    known, trees = ~np.isnan(y), []
    for number in range(spec.rounds):
        grown = []
        for output in range(spec.outputs):
            g, h, learnt = gradients(spec, total, number, output, y, fold, base)
            tree = Tree(number, output)
            grown.append((tree, fill(tree, spec, x, np.concatenate([g, h[None]]), learnt & known, limit)))
        for tree, node in grown:
            if boost:
                total[:, tree.output] += np.array([v[0] for v in tree.value])[node]
            elif tree.weight[0] > 0:
                total += np.array(tree.value)[node]
            trees.append(tree)
    if boost:
        return trees, probabilities(spec, total)
    drew = sum(t.weight[0] > 0 for t in trees)
    return trees, total / drew if drew else total + 1 / spec.classes


GROWN = "ensemble int, number int, output int, feature binary, cut binary, left binary, heap binary, value binary, gain binary, weight binary"


def packed_tree(at: int, t: Tree) -> dict:
    """A row of GROWN."""
    kinds = {"feature": np.int32, "cut": np.int32, "left": np.int32, "heap": np.int64, "value": float, "gain": float, "weight": float}
    return {"ensemble": at, "number": t.number, "output": t.output, **{k: np.array(getattr(t, k), kind).tobytes() for k, kind in kinds.items()}}


def unpacked_tree(r: dict) -> Tree:
    ints = {k: np.frombuffer(r[k], np.int32).tolist() for k in ("feature", "cut", "left")}
    heap = np.frombuffer(r["heap"], np.int64).tolist()
    return Tree(r["number"], r["output"], **ints, heap=heap, value=np.frombuffer(r["value"]).reshape(len(heap), -1).tolist(),
                gain=np.frombuffer(r["gain"]).tolist(), weight=np.frombuffer(r["weight"]).tolist(), open=[])


def hands(ensembles: Sequence[Ensemble], tasks: int) -> list[list[int]]:
    """The ensembles of each task, the costly ones dealt first, each to the task with the least to do."""
    cost = [s.rounds * s.outputs * s.depth for s in ensembles]
    out, load = [[] for _ in range(tasks)], [0] * tasks
    for i in sorted(range(len(ensembles)), key=lambda i: -cost[i]):
        t = load.index(min(load))
        out[t].append(i)
        load[t] += cost[i]
    return out


def whole_ensembles(plain: DataFrame, models: Sequence[Model], limit: int, key: str | None = None, numbers: Sequence[int] = ()) -> DataFrame:
    """Ensembles grown whole inside tasks: each task gets all rows and some of the ensembles, so no level is a job.

    The result has their trees (GROWN), or with ``key`` the rows (cell, key, fold, label, prob) of each ensemble's own fold, scored; ``numbers`` are the cells.
    """
    spark, cuts, size = plain.sparkSession, models[0].cuts, len(models[0].cuts)
    tasks = max(1, min(len(models), spark.sparkContext.defaultParallelism))
    dealt = hands([m.spec for m in models], tasks)
    columns = ["base", "y", "fold", "x", *([key] if key else [])]
    kind = plain.schema[key].dataType.simpleString() if key else ""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [*batch.columns[:3], fixed_binary(bins_of(matrix(batch.column(3), size), cuts)), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(rest, names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            if batch.num_rows:
                for copy in pc.unique(batch.column(0)).to_pylist():
                    held.setdefault(copy, []).append(batch.filter(pc.equal(batch.column(0), copy)))
        for copy, some in held.items():
            table = pa.Table.from_batches(some).combine_chunks()
            base, y, fold = (table[c].to_numpy() for c in ("base", "y", "fold"))
            x = np.ascontiguousarray(np.concatenate([flat_binary(c).reshape(len(c), size) for c in table["x"].chunks]).T)
            for i in dealt[copy]:
                spec = models[i].spec
                trees, prob = grow_alone(spec, models[i].start, x, y.astype(float), fold, base, limit)
                if not key:
                    yield pa.RecordBatch.from_pylist([packed_tree(i, t) for t in trees], to_arrow(GROWN))
                    continue
                at = np.flatnonzero(fold == spec.fold)
                mine = table.take(pa.array(at))
                one = [mine[c].combine_chunks() for c in (key, "fold", "y")]
                one = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in one]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), numbers[i], np.int32)), *one, pa.array(list(prob[at]), pa.list_(pa.float64()))],
                                                 names=["cell", "key", "fold", "label", "prob"])

    binned = plain.select(*columns).mapInArrow(bins, "base long, y double, fold int, x binary" + (f", `{key}` {kind}" if key else ""))
    copies = binned.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_copy"), "*").repartitionById(tasks, "_copy")
    if not key:
        return copies.mapInArrow(run, GROWN)
    return copies.mapInArrow(run, f"cell int, key {kind}, fold int, label double, prob array<double>").withColumnRenamed("key", key)


def to_arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def prepared(rows: DataFrame, ensembles: Sequence[Ensemble], key: str | None, fold: str | None, unlabelled: bool = False) -> tuple[DataFrame, list[Model], int]:
    """The staged rows (base, y, fold, x; with ``unlabelled`` the key, and rows without a label), empty models, and the number of labelled rows."""
    base = hashed_uniform(F.col(key), "trees") if key else F.pmod(F.xxhash64("features", "label"), F.lit(PRIME)) / PRIME
    plain = (rows if unlabelled else rows.where("label is not null")).select(
        F.floor(F.coalesce(base, F.lit(0.0)) * PRIME).cast("long").alias("base"), F.col("label").cast("double").alias("y"),
        (F.coalesce(F.col(fold), F.lit(-1)) if fold else F.lit(-1)).cast("int").alias("fold"), vector_to_array("features").alias("x"),
        *([key] if unlabelled else []))
    plain = stage(plain, "features")
    known = plain.where("y is not null")
    sizes = known.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("size")).collect()
    n, size = sum(r.n for r in sizes), max((r["size"] for r in sizes), default=0)
    cuts = cut_points(known, size) if size else []
    models = []
    for spec in ensembles:
        counts = [sum(r.n for r in sizes if r.y == c and (spec.fold is None or r.fold != spec.fold)) for c in range(spec.classes)]
        models.append(Model(spec, beginning(spec, counts), cuts))
    return plain, models, n


def fits_tasks(n: int, models: Sequence[Model], part_rows: int = PART_ROWS) -> bool:
    """Whether a task may hold the table, and as many tasks find work on ensembles as would on parts of the rows."""
    return 0 < n * len(models[0].cuts) <= HELD_BINS and -(-n // part_rows) <= len(models)


def grow(rows: DataFrame, ensembles: Sequence[Ensemble], key: str | None = None, fold: str | None = None, limit: int = CELLS,
         part_rows: int = PART_ROWS) -> list[Model]:
    """The ensembles fitted on vector ``features`` and ``label``, all in shared passes, or whole inside tasks where the table is small enough.

    ``key`` names a unique id for the draws (equal rows draw alike without it), ``fold`` a column of fold numbers. Rows without a label
    are left out; nulls among the features go with the smallest values. Without any rows models have no trees.
    """
    if not ensembles:
        return []
    plain, models, n = prepared(rows, ensembles, key, fold)
    if not n:
        return models
    if fits_tasks(n, models, part_rows):
        for r in sorted(whole_ensembles(plain, models, limit).toArrow().to_pylist(), key=lambda r: (r["ensemble"], r["number"], r["output"])):
            models[r["ensemble"]].trees.append(unpacked_tree(r))
        return models
    return grow_by_passes(plain, models, n, limit, part_rows)


def grow_by_passes(plain: DataFrame, models: list[Model], n: int, limit: int, part_rows: int) -> list[Model]:
    ensembles, cuts = [m.spec for m in models], models[0].cuts
    size, parts = len(cuts), -(-n // part_rows)
    start = [v for m in models if m.spec.kind == "boost" for v in m.start]
    table = binned(plain, cuts, start or [0.0], parts)
    firsts = np.cumsum([0, *[s.outputs if s.kind == "boost" else 0 for s in ensembles]])
    growths = [Growth(s, m, int(at)) for s, m, at in zip(ensembles, models, firsts)]
    while any(g.growing for g in growths):
        if max(len(g.held) for g in growths) >= HELD_ROUNDS:
            fresh = with_margins(table, job_of(growths, size, limit), parts)
            table.unpersist()
            table = fresh
            for g in growths:
                g.held = []
        job = job_of(growths, size, limit)
        units = [(g, t) for g in growths for t in g.growing if t.open]
        place = [{h: i for i, h in enumerate(t.heap)} for _, t in units]
        found = splits(table, job, parts).to_pylist()
        for r in sorted(found, key=lambda r: r["slot"]):
            u, heap = job.slots[r["slot"]]
            g, tree = units[u]
            node = place[u][heap]
            learn(g.spec, tree, node, r)
        for g in growths:
            g.settle()
    table.unpersist()
    return models


def learn(spec: Ensemble, tree: Tree, node: int, found: dict) -> None:
    """Put a pass's result for an open node into its tree."""
    tree.open.remove(node)
    total, part = ([*x[: spec.channels], x[-1]] for x in (found["total"], found["part"]))
    tree.weight[node] = total[-1]
    tree.value[node] = spec.leaf(total) if total[-1] + spec.l2 > 0 else [0.0] * spec.channels
    if found["feature"] >= 0:
        tree.split(node, found["feature"], found["cut"], found["gain"])
        for child, sums in ((tree.left[node], part), (tree.left[node] + 1, [t - p for t, p in zip(total, part)])):
            tree.weight[child], tree.value[child] = sums[-1], spec.leaf(sums)
            if tree.level(child) < spec.depth:
                tree.open.append(child)


def beginning(spec: Ensemble, counts: list[int]) -> list[float]:
    """Margins before the first round."""
    if spec.kind != "boost":
        return []
    if spec.loss == "squared":
        return [0.5]
    if not spec.prior or not all(counts):
        return [0.0] * spec.outputs
    total = sum(counts)
    return [math.log(counts[1] / counts[0])] if spec.outputs == 1 else [math.log(c / total) for c in counts]


def predictor(model: Model) -> Callable[[DataFrame], DataFrame]:
    """Adds ``prob`` to frames with vector ``features``."""
    size = len(model.cuts)

    @F.pandas_udf("array<double>")
    def prob(features):
        x = np.stack(features.to_numpy()).astype(float) if len(features) else np.zeros((0, size))
        import pandas as pd
        return pd.Series(list(model.predict(x)))

    return lambda df: df.withColumn("prob", prob(vector_to_array("features")))


def fold_scores(rows: DataFrame, key: str, fold: str, models: Sequence[tuple[int, Model]]) -> DataFrame:
    """(cell, key, fold, label, prob): each row scored, per cell, by the model that didn't learn from its fold."""
    spec = rows.schema[key].dataType.simpleString()
    plain = rows.select(F.col(key).alias("key"), F.col(fold).cast("int").alias("fold"), F.col("label").cast("double").alias("label"),
                        vector_to_array("features").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for cell, model in models:
                at = np.flatnonzero(folds == model.spec.fold)
                if len(at):
                    some = batch.take(pa.array(at))
                    prob = model.predict(matrix(some.column(3), len(model.cuts)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell, np.int32)), *some.columns[:3], pa.array(list(prob))],
                                                     names=["cell", "key", "fold", "label", "prob"])

    return plain.mapInArrow(run, f"cell int, key {spec}, fold int, label double, prob array<double>").withColumnRenamed("key", key)


def held_out_scores(rows: DataFrame, cells: Sequence[tuple[int, Ensemble]], key: str, fold: str) -> DataFrame:
    """:func:`fold_scores` of ensembles that are grown for it; where tasks grow whole ensembles they score the rows too, and no tree leaves them."""
    if not cells:
        return fold_scores(rows, key, fold, [])
    plain, models, n = prepared(rows, [s for _, s in cells], key, fold, True)
    if n and fits_tasks(max(n, plain.count()), models):
        return whole_ensembles(plain, models, CELLS, key, [i for i, _ in cells])
    grown = grow_by_passes(plain.where("y is not null"), models, n, CELLS, PART_ROWS) if n else models
    return fold_scores(rows, key, fold, [(i, m) for (i, _), m in zip(cells, grown)])
