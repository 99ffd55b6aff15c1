"""Forests of unlimited depth with random cut points, all trees grown level by level together.

A level is two aggregations over one written table, each for all open nodes of all trees: the range of every
feature in a node, from which the node's reducer draws its candidate cuts, and the class counts left of every
candidate, from which it picks the best. Once a node is small its rows go to one task, which grows the subtree under it by the
same steps, so the table is not routed through the deep levels again. Counts are whole numbers and every draw is a hash of (seed, tree, path
to the node, feature), so a forest does not depend on partitioning. The driver holds the trees, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.session import parallelism, pin

ROWS = 4096
U64 = np.uint64
#: Numbers that one task holds at most for the open nodes of one pass.
HELD = 1 << 23
#: Rows (as counted by a tree) up to which the subtree of a node is grown in one task, and bytes of rows such a task is dealt.
SMALL = 4096
DEALT = 16 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of every 64-bit number (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> U64(11)).astype(np.float64) / float(1 << 53)


@dataclass(frozen=True)
class Plan:
    """How trees are grown.

    ``cuts`` random cut points are drawn for each of ``tried`` features of a node (among those not constant in it);
    one cut is the extremely randomised tree, many come close to the best cut. ``share`` gives each class the mean of
    a Poisson draw per row and tree, the number of times the row counts in that tree; None counts each row once.
    ``balanced`` lets classes weigh the same in every tree. A node of fewer than ``min_rows`` rows stays whole, as does
    one at ``depth`` (None: no limit).
    """

    trees: int
    tried: int
    cuts: int = 1
    share: tuple[float, ...] | None = None
    balanced: bool = True
    min_rows: int = 2
    depth: int | None = None
    seed: int = 42


@dataclass
class Forest:
    """Nodes of all trees: feature (-1 in a leaf), cut, children, class counts; and per tree its root and class weights."""

    classes: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    key: np.ndarray
    level: np.ndarray
    tree: np.ndarray
    weights: np.ndarray
    open: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    @classmethod
    def of_roots(cls, counts: np.ndarray, plan: Plan) -> Forest:
        t, k = counts.shape
        n = counts.sum(1, keepdims=True)
        weights = n / np.maximum(k * counts, 1) if plan.balanced else np.ones((t, k))
        key = mixed(np.arange(1, t + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(plan.seed))
        none = np.full(t, -1, dtype=np.int32)
        return cls(k, none, np.zeros(t), none.copy(), none.copy(), counts, key, np.zeros(t, np.int32), np.arange(t, dtype=np.int32), weights)

    @property
    def trees(self) -> int:
        return len(self.weights)

    def splittable(self, nodes: np.ndarray, plan: Plan) -> np.ndarray:
        """Those of ``nodes`` that hold two classes, enough rows, and are above the depth limit; by tree."""
        counts = self.counts[nodes]
        ok = ((counts > 0).sum(1) > 1) & (counts.sum(1) >= max(2, plan.min_rows))
        if plan.depth is not None:
            ok &= self.level[nodes] < plan.depth
        nodes = nodes[ok]
        return nodes[np.argsort(self.tree[nodes], kind="stable")]

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Give ``nodes`` two children each, the left one with the given class counts; the children."""
        at, n = len(self.feature), len(nodes)
        self.feature[nodes], self.cut[nodes] = feature, cut
        self.left[nodes], self.right[nodes] = at + np.arange(n), at + n + np.arange(n)
        twice = np.concatenate([nodes, nodes])
        side = np.repeat(np.array([1, 2], dtype=U64), n)
        none = np.full(2 * n, -1, dtype=np.int32)
        self.counts = np.concatenate([self.counts, left, self.counts[nodes] - left])
        self.feature, self.left, self.right = (np.concatenate([v, none]) for v in (self.feature, self.left, self.right))
        self.cut = np.concatenate([self.cut, np.zeros(2 * n)])
        self.key = np.concatenate([self.key, mixed(self.key[twice] * U64(2) + side)])
        self.level = np.concatenate([self.level, self.level[twice] + 1])
        self.tree = np.concatenate([self.tree, self.tree[twice]])
        return np.arange(at, at + 2 * n)

    def graft(self, nodes: np.ndarray, under: list[np.ndarray]) -> None:
        """Put a grown subtree (``_subtrees``) under each of ``nodes``; its first row is the node itself."""
        if not under:
            return
        sizes = np.array([len(u) for u in under])
        shift = len(self.feature) + np.cumsum(sizes - 1) - sizes + 1  # where the second row of each goes
        made = np.concatenate(under)
        top = np.cumsum(sizes) - sizes
        offset = np.repeat(shift - 1, sizes)
        sides = {side: np.where(made[side] >= 0, made[side] + offset, -1).astype(np.int32) for side in ("left", "right")}
        rest = np.delete(np.arange(len(made)), top)
        self.tree = np.concatenate([self.tree, np.repeat(self.tree[nodes], sizes)[rest]])
        self.level = np.concatenate([self.level, made["level"][rest]])
        self.counts = np.concatenate([self.counts, made["counts"][rest].astype(np.int64)])
        self.key = np.concatenate([self.key, np.zeros(len(rest), dtype=U64)])  # nothing is drawn for them any more
        for name, theirs in (("feature", made["feature"]), ("cut", made["cut"]), *sides.items()):
            mine = getattr(self, name)
            mine[nodes] = theirs[top]
            setattr(self, name, np.concatenate([mine, theirs[rest]]))

    def route(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node of ``tree`` where every row of x ends."""
        return _routed(self, x, tree)

    def facts(self) -> list[tuple[int, int, int, int, int, float]]:
        """Per tree: its number, nodes, leaves, depth, and the feature and cut of its root (-1 and 0 if it is a leaf)."""
        nodes = np.bincount(self.tree, minlength=self.trees)
        leaves = np.bincount(self.tree[self.feature < 0], minlength=self.trees)
        depth = np.zeros(self.trees, dtype=np.int64)
        np.maximum.at(depth, self.tree, self.level)
        return [(t, int(nodes[t]), int(leaves[t]), int(depth[t]), int(self.feature[t]), float(self.cut[t])) for t in range(self.trees)]


def _routed(forest, x: np.ndarray, tree: int) -> np.ndarray:
    node = np.full(len(x), tree, dtype=np.int64)
    rows = np.arange(len(x))
    while len(rows):
        inner = forest.feature[node[rows]] >= 0
        rows = rows[inner]
        at = node[rows]
        node[rows] = np.where(x[rows, forest.feature[at]] <= forest.cut[at], forest.left[at], forest.right[at])
    return node


def _slim(forest: Forest) -> SimpleNamespace:
    """What routing needs, to ship with a task."""
    return SimpleNamespace(feature=forest.feature, cut=forest.cut, left=forest.left, right=forest.right)


# ---- rows ------------------------------------------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, class number, matrix) of a few thousand rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            yield rows.column("id").to_numpy(), rows.column("y").to_numpy(), x


def _steps(mean: float) -> np.ndarray:
    """Cumulative Poisson probabilities up to where nothing of note is left."""
    out, term, total = [], math.exp(-mean), 0.0
    for j in range(int(mean + 12 * math.sqrt(mean) + 12)):
        total += term
        out.append(total)
        term *= mean / (j + 1)
    return np.array(out[:-1])


def times(ids: np.ndarray, y: np.ndarray, tree: int, plan: Plan) -> np.ndarray:
    """How often each row counts in a tree."""
    if plan.share is None:
        return np.ones(len(ids), dtype=np.int64)
    seed = U64((plan.seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    u = _uniform(mixed(ids.astype(np.int64).view(U64) + seed) ^ seed)
    out = np.zeros(len(ids), dtype=np.int64)
    for c, mean in enumerate(plan.share):
        mine = y == c
        out[mine] = np.searchsorted(_steps(mean), u[mine], side="right")
    return out


_PARTIAL = pa.schema([("slot", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
PARTIAL = "slot long, a binary, b binary"


def _blobs(matrix: np.ndarray) -> list[bytes]:
    width = matrix.shape[1] * matrix.itemsize
    raw = np.ascontiguousarray(matrix).tobytes()
    return [raw[k * width : (k + 1) * width] for k in range(len(matrix))]


def _rows_by_slot(batches: Iterator[pa.RecordBatch], dtype_a, dtype_b) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    slots, a, b = [], [], []
    for batch in batches:
        slots.append(batch.column("slot").to_numpy())
        a += batch.column("a").to_pylist()
        b += batch.column("b").to_pylist()
    slot = np.concatenate(slots) if slots else np.zeros(0, dtype=np.int64)
    if not len(slot):
        return None
    order = np.argsort(slot, kind="stable")
    shape = (len(slot), -1)
    return slot[order], np.frombuffer(b"".join(a), dtype_a).reshape(shape)[order], np.frombuffer(b"".join(b), dtype_b).reshape(shape)[order]


def _heads(slot: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(slot, prepend=slot[0] - 1))


def _root_counts(plan: Plan, classes: int):
    def run(batches):
        out = np.zeros((plan.trees, classes), dtype=np.int64)
        for ids, y, _ in _chunks(batches):
            for t in range(plan.trees):
                out[t] += np.bincount(y, weights=times(ids, y, t, plan), minlength=classes).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(plan.trees)), pa.array(_blobs(out), pa.binary()), pa.array([b""] * plan.trees, pa.binary())], schema=_PARTIAL)

    return run


def _summed(batches):
    held = _rows_by_slot(batches, np.int64, np.uint8)
    if held is not None:
        slot, a, _ = held
        first = _heads(slot)
        total = np.add.reduceat(a, first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(_blobs(total), pa.binary()), pa.array([b""] * len(first), pa.binary())], schema=_PARTIAL)


def _located(shared, plan: Plan, batches):
    """For every chunk and tree: the tree's first slot, and the rows that count and are in an open node, with slot and times."""
    held = shared.value
    for ids, y, x in _chunks(batches):
        for t in np.flatnonzero(np.diff(held.bounds)).tolist():
            often = times(ids, y, t, plan)
            slot = held.slot[_routed(held.forest, x, t)]
            rows = np.flatnonzero((slot >= 0) & (often > 0))
            if len(rows):
                yield t, x, y, rows, slot[rows], often[rows]


def _ranges(shared, plan: Plan, dims: int):
    """Per open node and task the smallest and largest value of every feature."""

    def run(batches):
        n = int(shared.value.bounds[-1])
        low, high = np.full((n, dims), np.inf), np.full((n, dims), -np.inf)
        for _, x, _, rows, slot, _ in _located(shared, plan, batches):
            order = np.argsort(slot, kind="stable")
            slot, part = slot[order], x[rows[order]]
            first = _heads(slot)
            at = slot[first]
            low[at] = np.fmin(low[at], np.fmin.reduceat(part, first, axis=0))
            high[at] = np.fmax(high[at], np.fmax.reduceat(part, first, axis=0))
        seen = np.flatnonzero((low <= high).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(_blobs(low[seen]), pa.binary()), pa.array(_blobs(high[seen]), pa.binary())], schema=_PARTIAL)

    return run


def drawn(key: np.ndarray, low: np.ndarray, high: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Candidate (feature, cut) pairs per node: ``tried`` features that are not constant, ``cuts`` cuts of each; feature -1 for none."""
    n, d = low.shape
    wide = low < high
    order = _uniform(key[:, None] + np.arange(1, d + 1, dtype=U64) * U64(0xA24BAED4963EE407))
    order[~wide] = 2.0
    pick = np.argsort(order, axis=1, kind="stable")[:, : plan.tried]
    ok = np.take_along_axis(wide, pick, axis=1)
    feature = np.repeat(np.where(ok, pick, -1), plan.cuts, axis=1)
    salt = np.arange(1, feature.shape[1] + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
    u = _uniform(mixed(key)[:, None] ^ salt)
    a, b = (np.take_along_axis(v, np.maximum(feature, 0), axis=1) for v in (low, high))
    with np.errstate(invalid="ignore", over="ignore"):
        cut = a * (1 - u) + b * u
        cut = np.where((cut >= a) & (cut < b), cut, a)
    return feature.astype(np.int64), np.where(feature >= 0, cut, 0.0)


def _candidates(keys, plan: Plan):
    """The candidate cuts of every node, from all tasks' ranges."""

    def run(batches):
        held = _rows_by_slot(batches, np.float64, np.float64)
        if held is not None:
            slot, low, high = held
            first = _heads(slot)
            feature, cut = drawn(keys.value[slot[first]], np.fmin.reduceat(low, first, axis=0), np.fmax.reduceat(high, first, axis=0), plan)
            yield pa.RecordBatch.from_arrays([pa.array(slot[first]), pa.array(_blobs(feature), pa.binary()), pa.array(_blobs(cut), pa.binary())], schema=_PARTIAL)

    return run


def _counted(shared, plan: Plan, classes: int):
    """Per open node and task the class counts at or below every candidate cut."""

    def run(batches):
        held = shared.value
        n, c = held.feature.shape
        left = np.zeros((n, c, classes), dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        for t, x, y, rows, slot, often in _located(shared, plan, batches):
            feature = held.feature[slot]
            below = (x[rows[:, None], np.maximum(feature, 0)] <= held.cut[slot]) & (feature >= 0)
            a, b = held.bounds[t], held.bounds[t + 1]
            place = ((slot[:, None] - a) * c + np.arange(c)) * classes + y[rows][:, None]
            many = np.broadcast_to(often[:, None], place.shape)
            left[a:b] += np.bincount(place[below], weights=many[below], minlength=(b - a) * c * classes).astype(np.int64).reshape(b - a, c, classes)
            seen[slot] = True
        seen = np.flatnonzero(seen)
        empty = pa.array([b""] * len(seen), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(_blobs(left[seen].reshape(len(seen), c * classes)), pa.binary()), empty], schema=_PARTIAL)

    return run


def impurity(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gini impurity times weight of the class counts on the last axis."""
    heavy = counts * weights
    total = heavy.sum(-1)
    return total - (heavy * heavy).sum(-1) / np.maximum(total, 1e-300)


def _choice(feature: np.ndarray, left: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node the candidate that leaves the least impurity, the first on a tie, and whether there is one."""
    right = counts[:, None, :] - left
    weights = weights[:, None, :]
    cost = impurity(left, weights) + impurity(right, weights)
    cost[(feature < 0) | (left.sum(-1) == 0) | (right.sum(-1) == 0)] = np.inf
    pick = cost.argmin(axis=1)
    return pick, np.isfinite(cost[np.arange(len(pick)), pick])


def _best(shared, classes: int):
    """The candidate of every node that leaves the least impurity, the first on a tie, and its left class counts."""

    def run(batches):
        rows = _rows_by_slot(batches, np.int64, np.uint8)
        if rows is None:
            return
        held = shared.value
        slot, left, _ = rows
        first = _heads(slot)
        slot = slot[first]
        left = np.add.reduceat(left, first, axis=0).reshape(len(slot), -1, classes)
        pick, ok = _choice(held.feature[slot], left, held.counts[slot], held.weights[slot])
        at = np.arange(len(slot))
        yield pa.RecordBatch.from_arrays([pa.array(slot[ok]), pa.array(_blobs(pick[ok][:, None].astype(np.int64)), pa.binary()), pa.array(_blobs(left[at, pick][ok]), pa.binary())], schema=_PARTIAL)

    return run


# ---- subtrees of small nodes ------------------------------------------------------------

_ROWS = pa.schema([("slot", pa.int64()), ("often", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])
ROWS_OF = "slot long, often long, y int, x binary"


def _dealt(shared, plan: Plan):
    """The rows of every open node, with the times they count."""

    def run(batches):
        for _, x, y, rows, slot, often in _located(shared, plan, batches):
            for at in range(0, len(rows), ROWS):
                part = slice(at, at + ROWS)
                columns = [pa.array(slot[part]), pa.array(often[part]), pa.array(y[rows[part]], pa.int32()), pa.array(_blobs(x[rows[part]]), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)

    return run


def _grown_under(forest: Forest, plan: Plan, slot: np.ndarray, often: np.ndarray, y: np.ndarray, x: np.ndarray) -> None:
    """Grow ``forest``, whose roots are the nodes the rows are in, to its leaves."""
    k, at = forest.classes, slot
    nodes = forest.splittable(np.arange(forest.trees), plan)
    while len(nodes):
        place = np.full(len(forest.feature), -1, dtype=np.int64)
        place[nodes] = np.arange(len(nodes))
        now = place[at]
        order = np.argsort(now, kind="stable")
        order = order[np.searchsorted(now[order], 0) :]  # rows of closed nodes are done with
        now, often, y, x = now[order], often[order], y[order], x[order]
        first = _heads(now)
        feature, cut = drawn(forest.key[nodes], np.fmin.reduceat(x, first, axis=0), np.fmax.reduceat(x, first, axis=0), plan)
        c = feature.shape[1]
        below = (x[np.arange(len(x))[:, None], np.maximum(feature, 0)[now]] <= cut[now]) & (feature >= 0)[now]
        cell = (now[:, None] * c + np.arange(c)) * k + y[:, None]
        many = np.broadcast_to(often[:, None], cell.shape)
        left = np.bincount(cell[below], weights=many[below], minlength=len(nodes) * c * k).astype(np.int64).reshape(len(nodes), c, k)
        pick, ok = _choice(feature, left, forest.counts[nodes], forest.weights[forest.tree[nodes]])
        each = np.arange(len(nodes))
        made = forest.split(nodes[ok], feature[each, pick][ok], cut[each, pick][ok], left[each, pick][ok])
        on = nodes[now]
        down = np.where(below[np.arange(len(x)), pick[now]], forest.left[on], forest.right[on])
        at = np.where(ok[now], down, on)
        nodes = forest.splittable(made, plan)


def _record(classes: int) -> np.dtype:
    """A node of a subtree on its way to the driver; children by their place in the subtree."""
    return np.dtype([("feature", "i4"), ("left", "i4"), ("right", "i4"), ("level", "i4"), ("cut", "f8"), ("counts", "i4", (classes,))])


def _subtrees(shared, plan: Plan, classes: int, dims: int):
    """Per open node the subtree under it: nodes in order of their making, as bytes."""

    def run(batches):
        slots, often, y, x = [], [], [], []
        for batch in batches:
            slots.append(batch.column("slot").to_numpy())
            often.append(batch.column("often").to_numpy())
            y.append(batch.column("y").to_numpy())
            x += batch.column("x").to_pylist()
        if not x:
            return
        held = shared.value
        found, slot = np.unique(np.concatenate(slots), return_inverse=True)
        n = len(found)
        none = np.full(n, -1, dtype=np.int32)
        part = Forest(classes, none, np.zeros(n), none.copy(), none.copy(), held.counts[found], held.key[found], held.level[found],
                      np.arange(n, dtype=np.int32), held.weights[found])
        matrix = np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1)
        _grown_under(part, plan, slot, np.concatenate(often), np.concatenate(y), matrix)
        order = np.argsort(part.tree, kind="stable")
        inside = np.empty(len(order), dtype=np.int64)  # a node's number in its own subtree
        bounds = np.searchsorted(part.tree[order], np.arange(n + 1))
        inside[order] = np.arange(len(order)) - bounds[part.tree[order]]
        whole = np.empty(len(order), dtype=_record(classes))
        whole["feature"], whole["cut"], whole["level"], whole["counts"] = part.feature[order], part.cut[order], part.level[order], part.counts[order]
        for side, child in (("left", part.left[order]), ("right", part.right[order])):
            whole[side] = np.where(child >= 0, inside[child], -1)
        for i in range(n):
            blob = whole[bounds[i] : bounds[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 1]), pa.array([blob], pa.binary()), pa.array([b""], pa.binary())], schema=_PARTIAL)

    return run


def _finished(table: DataFrame, forest: Forest, nodes: np.ndarray, plan: Plan, dims: int) -> None:
    """Grow all that is under ``nodes`` (ordered by tree), each in one task."""
    spark = table.sparkSession
    slot = np.full(len(forest.feature), -1, dtype=np.int64)
    slot[nodes] = np.arange(len(nodes))
    bounds = np.searchsorted(forest.tree[nodes], np.arange(forest.trees + 1))
    where = spark.sparkContext.broadcast(SimpleNamespace(forest=_slim(forest), slot=slot, bounds=bounds))
    roots = SimpleNamespace(counts=forest.counts[nodes], key=forest.key[nodes], level=forest.level[nodes], weights=forest.weights[forest.tree[nodes]])
    tasks = max(parallelism(spark), int(forest.counts[nodes].sum()) * (8 * dims + 32) // DEALT + 1)
    rows = table.mapInArrow(_dealt(where, plan), ROWS_OF).repartition(tasks, "slot")
    got = rows.mapInArrow(_subtrees(spark.sparkContext.broadcast(roots), plan, forest.classes, dims), PARTIAL).collect()
    got.sort(key=lambda r: r.slot)
    forest.graft(nodes[[r.slot for r in got]], [np.frombuffer(r.a, _record(forest.classes)) for r in got])


# ---- growth ----------------------------------------------------------------------------

def _gathered(table: DataFrame, run, merge) -> tuple[np.ndarray, list, list]:
    rows = table.mapInArrow(run, PARTIAL).repartition("slot").mapInArrow(merge, PARTIAL).collect()
    rows.sort(key=lambda r: r.slot)
    return np.array([r.slot for r in rows], dtype=np.int64), [r.a for r in rows], [r.b for r in rows]


def _wave(table: DataFrame, forest: Forest, nodes: np.ndarray, plan: Plan, dims: int) -> np.ndarray:
    """Split those of ``nodes`` (ordered by tree) that can be split; their children."""
    context = table.sparkSession.sparkContext
    slot = np.full(len(forest.feature), -1, dtype=np.int64)
    slot[nodes] = np.arange(len(nodes))
    bounds = np.searchsorted(forest.tree[nodes], np.arange(forest.trees + 1))
    where = SimpleNamespace(forest=_slim(forest), slot=slot, bounds=bounds)
    keys = context.broadcast(forest.key[nodes])
    at, feature, cut = _gathered(table, _ranges(context.broadcast(where), plan, dims), _candidates(keys, plan))
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    c = min(plan.tried, dims) * plan.cuts
    where.feature, where.cut = np.full((len(nodes), c), -1, dtype=np.int64), np.zeros((len(nodes), c))
    where.feature[at] = np.frombuffer(b"".join(feature), np.int64).reshape(len(at), c)
    where.cut[at] = np.frombuffer(b"".join(cut), np.float64).reshape(len(at), c)
    where.counts, where.weights = forest.counts[nodes], forest.weights[forest.tree[nodes]]
    shared = context.broadcast(where)
    at, pick, left = _gathered(table, _counted(shared, plan, forest.classes), _best(shared, forest.classes))
    if not len(at):
        return np.zeros(0, dtype=np.int64)
    pick = np.frombuffer(b"".join(pick), np.int64)
    left = np.frombuffer(b"".join(left), np.int64).reshape(len(at), forest.classes)
    return forest.split(nodes[at], where.feature[at, pick], where.cut[at, pick], left)


def grow(rows: DataFrame, classes: int, plan: Plan) -> Forest:
    """The forest of ``rows`` (id long, y int from 0, x array<double>).

    Nodes are split until they are pure, hold fewer than ``min_rows`` rows, or no feature varies in them. A missing
    value goes right. No rows give trees without counts.
    """
    table = pin(rows.select("id", F.col("y").cast("int").alias("y"), "x"))
    dims = table.agg(F.max(F.size("x"))).head()[0] or 1
    at, counts, _ = _gathered(table, _root_counts(plan, classes), _summed)
    roots = np.zeros((plan.trees, classes), dtype=np.int64)
    if len(at):
        roots[at] = np.frombuffer(b"".join(counts), np.int64).reshape(len(at), classes)
    forest = Forest.of_roots(roots, plan)
    nodes = forest.splittable(np.arange(plan.trees), plan)
    held = max(2 * dims, min(plan.tried, dims) * plan.cuts * classes)
    small = []
    while len(nodes):
        few = forest.counts[nodes].sum(1) <= SMALL
        small.append(nodes[few])
        nodes = nodes[~few]
        if not len(nodes):
            break
        step = max(1, HELD // held)
        made = [_wave(table, forest, nodes[k : k + step], plan, dims) for k in range(0, len(nodes), step)]
        nodes = forest.splittable(np.concatenate(made), plan)
    small = np.concatenate(small) if small else nodes
    if len(small):
        _finished(table, forest, small[np.argsort(forest.tree[small], kind="stable")], plan, dims)
    return forest


def leaf_scores(points: DataFrame, forest: Forest) -> DataFrame:
    """``points`` (id, label, x) with ``votes``: the mean over trees of the class shares of the row's leaf, by class number."""
    heavy = forest.counts * forest.weights[forest.tree]
    share = heavy / np.maximum(heavy.sum(1, keepdims=True), 1e-300)
    held = _slim(forest)
    held.share = share
    shared = points.sparkSession.sparkContext.broadcast(held)
    trees, classes = forest.trees, forest.classes

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                x = rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                total = np.zeros((len(rows), classes))
                for t in range(trees):
                    total += shared.value.share[_routed(shared.value, x, t)]
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * classes)
                votes = pa.ListArray.from_arrays(ends, pa.array((total / trees).ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), votes], names=["id", "label", "votes"])

    return points.select("id", "label", "x").mapInArrow(run, "id bigint, label string, votes array<double>")
