"""Hypersphere cover: how many class-pure balls it takes to hold all rows.

Every row is the center of a ball that grows until it touches the ball of its nearest enemy, the closest row of
another class (Ho and Basu, 2002; Lorena et al., 2019, measure T1). Two rows that are each other's nearest enemy meet
half-way; a ball's radius is otherwise the distance to its nearest enemy less that one's radius. Balls inside another
are absorbed by it. The measure is the number of balls left over that of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.operators.neighbours import (
    DATA_BLOCK, DIGITS, QUERY_BLOCK, TILE_COLUMNS, _bare, _column, _dealt, _matrix, _pairs, _region_rows, _regions, _sum_pairs, distances, lay_out, nearest,
)
from lopside.operators.profile.concept import scaled
from lopside.session import pin

TOUCH = 1e-7  # balls of one chain all touch where its pair meets: what rounding adds up to there still counts as inside


def ball_radii(x: DataFrame, metric: str = "l1") -> DataFrame:
    """(id, x, r) for every row of ``x`` (id, label, x) that has an enemy.

    Nearest enemies (ties by id) form chains of falling distances that end in a pair. r = d - r(enemy) along a chain is
    an alternating sum, found by doubling: each round every row jumps to where its partner had jumped, so the rounds
    grow with the logarithm of the longest chain.
    """
    enemy = nearest(x, x, 1, "other", metric).select("id", F.col("nid").alias("to"), "dist")
    enemy = pin(enemy)
    back = enemy.select(F.col("id").alias("to"), F.col("to").alias("home"))
    mutual = F.col("home") == F.col("id")
    step = enemy.join(back, "to").select(
        "id", F.when(~mutual, F.col("to")).alias("to"), F.when(mutual, F.col("dist") / 2).otherwise(F.col("dist")).alias("sum"),
        F.lit(-1.0).alias("sign"))
    step = pin(step)
    while not step.filter("to IS NOT NULL").isEmpty():
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("sum").alias("more"), F.col("sign").alias("turn"))
        moving = step.filter("to IS NOT NULL").join(ahead, "to")
        moved = moving.select("id", F.col("next").alias("to"), (F.col("sum") + F.col("sign") * F.col("more")).alias("sum"), (F.col("sign") * F.col("turn")).alias("sign"))
        step = pin(step.filter("to IS NULL").unionByName(moved))
    radius = step.select("id", F.round("sum", DIGITS).alias("r"))
    return x.select("id", "x").join(radius, "id")


def _reaching(queries: DataFrame, layout, region: np.ndarray, largest: np.ndarray, inward: np.ndarray, giants: tuple) -> DataFrame:
    """``queries`` with the regions that have a ball which may be large and near enough to hold one, null for a ball inside a giant.

    ``largest`` and ``inward`` are the most that radius + and - distance to the pivot come to in a cell; ``giants`` (x, r, id)
    holds the largest ball of each cell.
    """
    shared = queries.sparkSession.sparkContext.broadcast((_bare(layout), region, largest, inward, giants))

    def run(batches):
        lay, region, largest, inward, (gx, gr, gi) = shared.value
        order = np.argsort(region, kind="stable")
        start = np.searchsorted(region[order], np.arange(region.max() + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            r, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("r", "id"))
            found = []
            for lo in range(0, len(x), QUERY_BLOCK):
                part = slice(lo, lo + QUERY_BLOCK)
                inside = _holds(distances(x[part], gx, lay.metric), r[part], ids[part], gr, gi).any(axis=1)
                near = _may_reach(distances(x[part], lay.pivots, lay.metric), r[part], largest, inward)
                there = np.logical_or.reduceat(near[:, order], start, axis=1)
                found += [None if done else np.nonzero(t)[0].tolist() for done, t in zip(inside, there)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "regions"])

    return queries.mapInArrow(run, "id bigint, x array<double>, r double, regions array<int>")


def _may_reach(d: np.ndarray, r: np.ndarray, largest: np.ndarray, inward: np.ndarray) -> np.ndarray:
    """Per (ball, cell), from the distances to the pivots, whether a ball of the cell may hold the ball."""
    return (d + r[:, None] <= largest[None, :] + 2 * TOUCH) & (r[:, None] - d <= inward[None, :] + 2 * TOUCH)


def _held_in_chunk(q: pa.Table, d: pa.Table, pivots: np.ndarray, metric: str) -> pa.Table:
    """The ids of the balls of ``q`` that one of ``d`` holds. Balls of like size are taken together and leave once they are held."""
    out = [np.empty(0, np.int64)]
    if len(q) and len(d):
        q, d = q.sort_by([("r", "ascending"), ("id", "ascending")]), d.sort_by([("cell", "ascending"), ("id", "ascending")])
        qx, dx = _matrix(_column(q, "x")), _matrix(_column(d, "x"))
        qr, qi, dr, di, reach, cell = (_column(t, c).to_numpy(zero_copy_only=False) for t, c in ((q, "r"), (q, "id"), (d, "w"), (d, "id"), (d, "reach"), (d, "cell")))
        cells, start = np.unique(cell, return_index=True)
        end = np.append(start[1:], len(d))
        largest, inward = np.maximum.reduceat(dr + reach, start), np.maximum.reduceat(dr - reach, start)
        for lo in range(0, len(q), QUERY_BLOCK):
            part = np.arange(lo, min(len(q), lo + QUERY_BLOCK))
            far = distances(qx[part], pivots[cells], metric)
            may = _may_reach(far, qr[part], largest, inward)
            held = np.zeros(len(part), dtype=bool)
            order = np.argsort(-may.sum(axis=0), kind="stable")
            for c in order[: np.count_nonzero(may.any(axis=0))]:
                ask = np.nonzero(may[:, c] & ~held)[0]
                if not len(ask):
                    continue
                least = qr[part[ask]].min()
                rows = np.arange(start[c], end[c])
                rows = rows[(dr[rows] >= least) & (dr[rows] + reach[rows] + 2 * TOUCH >= (far[ask, c] + qr[part[ask]]).min())]
                for at in range(0, len(rows), TILE_COLUMNS):
                    some = rows[at: at + TILE_COLUMNS]
                    held[ask] |= _holds(distances(qx[part[ask]], dx[some], metric), qr[part[ask]], qi[part[ask]], dr[some], di[some]).any(axis=1)
            out.append(qi[part[held]])
    return pa.table({"id": pa.array(np.concatenate(out), pa.int64())})


def _holds(far: np.ndarray, qr: np.ndarray, qi: np.ndarray, dr: np.ndarray, di: np.ndarray) -> np.ndarray:
    """Which balls (columns) are larger than a ball (row), the first id at equal size, and hold it."""
    larger = (dr[None, :] > qr[:, None]) | ((dr[None, :] == qr[:, None]) & (di[None, :] < qi[:, None]))
    return larger & (np.round(far, DIGITS) + qr[:, None] <= dr[None, :] + TOUCH)


def absorbed(balls: DataFrame, metric: str = "l1", block_rows: int = DATA_BLOCK) -> DataFrame:
    """The ids of the balls (id, x, r) that lie within another one; of equal balls the first id stays.

    Containment is transitive, so a ball inside any other is inside one that stays. A ball inside the largest ball of some
    cell is settled where it lies; another one is sent once to each region with a ball that could reach around it.
    """
    balls = pin(balls.select("id", "x", "r"))
    layout = lay_out(balls.select("id", F.lit("").alias("label"), "x", F.col("r").alias("w")), metric, block_rows)
    if layout.cells == 1:
        def kernel(q, d):
            qr, dr = (s.field(c).to_numpy(zero_copy_only=False).astype(float) for s, c in ((q, "r"), (d, "w")))
            qi, di = (s.field("id").to_numpy(zero_copy_only=False) for s in (q, d))
            return [_holds(distances(_matrix(q.field("x")), _matrix(d.field("x")), metric), qr, qi, dr, di).sum(1)]

        return _sum_pairs(_pairs(balls.withColumn("cell", F.lit(0)), ["id", "x", "r"], layout), kernel, ["n"]).filter("n > 0").select("id")
    largest, inward = np.full(layout.cells, -np.inf), np.full(layout.cells, -np.inf)
    tops = layout.placed.groupBy("cell").agg(
        F.max(F.col("w") + F.col("reach")).alias("out"), F.max(F.col("w") - F.col("reach")).alias("in"),
        F.max_by(F.struct("x", "w", "id"), F.struct("w", -F.col("id"))).alias("top")).collect()  # one row per cell
    for row in tops:
        largest[row["cell"]], inward[row["cell"]] = row["out"], row["in"]
    giants = tuple(np.array([row["top"][c] for row in tops]) for c in ("x", "w", "id"))
    most = _region_rows(layout)
    region = _regions(layout, most)
    planned = pin(_reaching(balls, layout, region, largest, inward, giants))
    inside = planned.filter("regions IS NULL").select("id")
    asked = planned.select("id", "x", "r", F.explode("regions").alias("region"))
    visits = {r["region"]: r["n"] for r in asked.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per region
    if not visits:
        return inside
    q, d = _dealt(asked, visits, layout, region, most, ["id", "x", "w", "cell", "reach"])
    shared = balls.sparkSession.sparkContext.broadcast(layout.pivots)

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        return _held_in_chunk(q.combine_chunks(), d.combine_chunks(), shared.value, metric)

    found = q.groupBy("part").cogroup(d.groupBy("part")).applyInArrow(run, "id bigint").distinct()
    return found.unionByName(inside)


def cover_share(points: DataFrame, metric: str = "l1", block_rows: int = DATA_BLOCK) -> float | None:
    """t1: balls left after absorption over rows; None where no row has an enemy."""
    x = pin(scaled(points))
    balls = pin(ball_radii(x, metric))
    n = balls.count()
    return 1 - absorbed(balls, metric, block_rows).count() / n if n else None
