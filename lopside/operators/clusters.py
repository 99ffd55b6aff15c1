"""K-means for many clusters: as many as a share of the rows.

The start is drawn as in k-means|| (Bahmani et al., 2012): in a few rounds every row is taken with a chance that follows its squared
distance to the nearest centre so far. The rounds draw as many rows as there are clusters, not several times that, so no
candidates are left to be reduced. Rounds of Lloyd's algorithm follow. A row whose own centre did not move away is held only
against centres that moved, since all others are as far as they were; distances to many centres come from matrix products.
Rows stay in a written table; the driver and every task hold the centres.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED, uniform
from lopside.operators.neighbours import _matrix
from lopside.session import parallelism, pin, unpin

START_ROUNDS = 4
MORE_ROUNDS = 16    # further rounds if chance drew too few
ROUNDS = 300
TOLERANCE = 1e-4    # a centre that moves no farther has come to rest
ROW_TILE = 256
CENTRE_TILE = 1024
OUT_ROWS = 8192
_STATE = "id bigint, x array<double>, prediction int, was int, near double"


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of ``centres`` to each row, the first on a tie."""
    best, place = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    for lo in range(0, len(centres), CENTRE_TILE):
        c = centres[lo : lo + CENTRE_TILE]
        right, norm = np.ascontiguousarray(-2 * c.T), (c * c).sum(axis=1)
        for at in range(0, len(x), ROW_TILE):
            part = slice(at, at + ROW_TILE)
            score = x[part] @ right
            score += norm
            pick = score.argmin(axis=1)
            low = score[np.arange(len(pick)), pick]
            less = low < best[part]
            best[part] = np.where(less, low, best[part])
            place[part] = np.where(less, pick + lo, place[part])
    return place


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def _replaced(x: np.ndarray, prediction: np.ndarray, near: np.ndarray, centres: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row belongs once the centres numbered ``moved`` have moved (or come), and its squared distance there.

    ``near`` is its squared distance to its centre (-1: none) before.
    """
    old = prediction >= 0
    own = np.where(old, _apart(x, centres[np.maximum(prediction, 0)]), np.inf)
    away = old & (own > near)
    out, far = prediction.copy(), own
    for rows, among in ((np.flatnonzero(~away), moved), (np.flatnonzero(away), None)):
        if not len(rows) or (among is not None and not len(among)):
            continue
        pick = _closest(x[rows], centres if among is None else centres[among])
        pick = pick if among is None else among[pick]
        there = _apart(x[rows], centres[pick])
        less = there < far[rows]
        out[rows[less]], far[rows[less]] = pick[less], there[less]
    lost = out < 0  # a feature that is no number: near to nothing, never drawn
    out[lost], far[lost] = 0, 0.0
    return out, far


def _placed(state: DataFrame, centres: np.ndarray, moved: np.ndarray) -> DataFrame:
    """``state`` after the centres numbered ``moved`` have moved; a written table."""
    shared = state.sparkSession.sparkContext.broadcast((centres, moved))

    def run(batches):
        centres, moved = shared.value
        for batch in batches:
            lists = batch.column("x")
            if lists.null_count or lists.flatten().null_count:
                raise ValueError("k-means takes no missing features")
            x = _matrix(lists)
            if not len(x):
                continue
            was, near = batch.column("prediction").to_numpy(), batch.column("near").to_numpy()
            now, near = _replaced(x, was, near, centres, moved)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(now.astype(np.int32)), pa.array(was), pa.array(near)],
                                             names=["id", "x", "prediction", "was", "near"])

    out = pin(state.mapInArrow(run, _STATE))
    shared.unpersist()
    unpin(state)
    return out


def _grouped(number: np.ndarray, n: np.ndarray, x: np.ndarray):
    """Sums per number, in slices."""
    order = np.argsort(number, kind="stable")
    number = number[order]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    total, many = np.add.reduceat(x[order], first, axis=0), np.add.reduceat(n[order], first)
    for at in range(0, len(first), OUT_ROWS):
        part = slice(at, at + OUT_ROWS)
        ends = pa.array(np.arange(len(total[part]) + 1, dtype=np.int32) * x.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(number[first][part].astype(np.int32)), pa.array(many[part]), pa.ListArray.from_arrays(ends, pa.array(total[part].ravel()))],
                                         names=["number", "n", "x"])


def _change(state: DataFrame, sums: np.ndarray, counts: np.ndarray) -> int:
    """Bring sums and counts of the clusters up to date with the rows that changed theirs; how many clusters that touches."""

    def gone_and_come(batches):
        for batch in batches:
            now, was, x = batch.column("prediction").to_numpy(), batch.column("was").to_numpy(), _matrix(batch.column("x"))
            if not len(x):
                continue
            left = was >= 0
            yield from _grouped(np.concatenate([now, was[left]]), np.concatenate([np.ones(len(x), dtype=np.int64), -np.ones(left.sum(), dtype=np.int64)]), np.concatenate([x, -x[left]]))

    def merged(batches):
        held = [(b.column("number").to_numpy(), b.column("n").to_numpy(), _matrix(b.column("x"))) for b in batches if b.num_rows]
        if held:
            yield from _grouped(*(np.concatenate(c) for c in zip(*held)))

    schema = "number int, n bigint, x array<double>"
    changed = state.filter("prediction != was").select("prediction", "was", "x")
    found = changed.mapInArrow(gone_and_come, schema).repartition("number").mapInArrow(merged, schema).toArrow()  # a row per centre
    if found.num_rows:
        number = found.column("number").to_numpy()
        sums[number] += _matrix(found.column("x").combine_chunks())
        counts[number] += found.column("n").to_numpy()
    return found.num_rows


def _start(state: DataFrame, k: int, dims: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Up to k rows drawn as centres, and ``state`` with every row at the nearest; fewer if there are fewer distinct rows."""
    centres = np.empty((0, dims))
    for r in range(START_ROUNDS + MORE_ROUNDS):
        lack = k - len(centres)
        if not lack:
            break
        if r == 0:
            first = state.orderBy(uniform(seed, F.col("id"), F.lit("first")), "id").limit(1)
            new = _matrix(first.select("x").toArrow().column("x").combine_chunks())
        else:
            total = state.agg(F.sum("near")).head()[0]
            if not total:
                break
            want = lack / (START_ROUNDS - r) if r < START_ROUNDS else 1.2 * lack + 4
            chance = F.col("near") * F.lit(want / total)
            drawn = state.withColumn("u", uniform(seed, F.col("id"), F.lit(f"start {r}"))).filter((F.col("u") < chance) & (F.col("near") > 0))
            drawn = drawn.select("x", (F.col("u") / F.col("near")).alias("key"), "id").toArrow()  # about ``want`` rows
            if not drawn.num_rows:
                continue
            order = np.lexsort((drawn.column("id").to_numpy(), drawn.column("key").to_numpy()))
            new = _matrix(drawn.column("x").combine_chunks())[order]
            new = new[np.sort(np.unique(new, axis=0, return_index=True)[1])][:lack]
        centres = np.concatenate([centres, new])
        state = _placed(state, centres, np.arange(len(centres) - len(new), len(centres)))
    return state, centres


def kmeans(points: DataFrame, k: int, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """(id, prediction, x): the cluster of every row of ``points`` (id, x), numbered from 0, of at most k."""
    spark = points.sparkSession
    none = F.lit(-1)
    state = pin(points.select("id", "x", none.alias("prediction"), none.alias("was"), F.lit(float("inf")).alias("near")).repartition(parallelism(spark), "id"))
    dims = state.agg(F.max(F.size("x"))).head()[0] or 1
    state, centres = _start(state, k, dims, seed)
    sums, counts = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
    _change(state.withColumn("was", none), sums, counts)
    for _ in range(rounds):
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        moved = np.flatnonzero((new != centres).any(axis=1))
        if not len(moved):
            break
        farthest = _apart(new, centres).max()
        centres = new
        state = _placed(state, centres, moved)
        if farthest <= TOLERANCE**2 or not _change(state, sums, counts):
            break
    return state.select("id", "prediction", "x")
