"""Exact nearest-neighbour operators.

Rows are laid out in *cells* (the rows closest to one of about sqrt(n) pivot
rows). ``nearest`` joins *regions*: neighbouring cells up to a bounded number of
rows, a larger cell being cut into chunks. A query row goes to its own region,
then to those that the triangle inequality cannot rule out under the distance
found there; inside a region it is compared with the cells that are left under
a bound that tightens on the way. There are few regions, so a row is copied a
bounded number of times. The sums below pack cells into *blocks* instead, and a
task holds one query block and one data block at a time. Nothing is dropped: a
cell is skipped only when it provably holds no answer.

Ties are settled by (distance rounded to 9 decimals, neighbour id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.functions.draws import SEED, draw
from lopside.session import parallelism, pin

DATA_BLOCK = 2048
QUERY_BLOCK = 512
SALT_BLOCKS = 64
REGIONS = 16
REGION_ROWS = 65_536
REGION_BYTES = 32 << 20
TILE_COLUMNS = 4096
TILE_CELLS = 65_536
MAX_PIVOTS = 16_384
PIVOT_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20
GROUP_ROWS = 65_536  # query rows that one task holds while all data rows pass
GROUP_BYTES = 32 << 20
PLACED = 1024  # tasks up to which each gets a partition of its own; more even out by themselves
ALONE, FIRST, SECOND = range(3)  # rows of a task of one group, of the first and of the second of two
DIGITS = 9
_CELL = [T.StructField("cell", T.IntegerType())]


# ---- numpy on one pair of blocks ------------------------------------------------

def _matrix(lists: pa.ListArray) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Integer codes for two label arrays, equal labels getting equal codes."""
    both = pa.chunked_array([left, right]).combine_chunks().dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False)
    return codes[: len(left)], codes[len(left):]


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of two matrices, feature by feature, in tiles that stay in the processor's cache."""
    total = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    step = max(1, TILE_CELLS // max(1, len(b)))
    room = np.empty((min(step, len(a)), len(b)))
    for lo in range(0, len(a), step):
        part = total[lo: lo + step]
        gap = room[: len(part)]
        for j in range(a.shape[1]):
            np.subtract(a[lo: lo + step, j, None], columns[j], out=gap)
            if metric == "l1":
                np.abs(gap, out=gap)
            else:
                np.multiply(gap, gap, out=gap)
            np.add(part, gap, out=part)
        if metric != "l1":
            np.sqrt(part, out=part)
    return total


def _first_k(row: np.ndarray, col: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (dist, col) of every row."""
    order = np.lexsort((col, dist, row))
    sorted_rows = row[order]
    start = np.searchsorted(sorted_rows, sorted_rows, side="left")
    return order[np.arange(len(order)) - start < k]


def _rough(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, float, bool]:
    """(distances, 0, False), or for wide Euclidean rows (squared distances by a matrix product, their margin, True)."""
    if metric == "l2" and a.shape[1] > 8:
        na, nb = (a * a).sum(1), (b * b).sum(1)
        margin = 64 * np.finfo(float).eps * a.shape[1] * (na.max(initial=0) + nb.max(initial=0)) + 1e-8
        return na[:, None] + nb[None, :] - 2.0 * (a @ b.T), margin, True
    return np.round(distances(a, b, metric), DIGITS), 0.0, False


def _first_of_label(row: np.ndarray, code: np.ndarray, col: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Positions of the smallest (dist, col) of every (row, code)."""
    order = np.lexsort((col, dist, code, row))
    r, c = row[order], code[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    return order[first]


def closest_labels(a: np.ndarray, b: np.ndarray, valid: np.ndarray, codes: np.ndarray, k: int, metric: str, bound: np.ndarray):
    """As ``closest``, of the nearest column of each label (``codes``) the k nearest."""
    rough, margin, wide = _rough(a, b, metric)
    rough[~valid] = np.inf
    limit = (bound * bound + margin) if wide else bound
    order = np.argsort(codes, kind="stable")
    starts = np.nonzero(np.diff(codes[order], prepend=-1))[0]
    many = not np.isfinite(limit).all() or np.count_nonzero(rough <= limit[:, None]) > 8 * k * len(a)
    if many and len(starts) >= k:
        least = np.partition(np.minimum.reduceat(rough[:, order], starts, axis=1), k - 1, axis=1)[:, k - 1]
        limit = np.minimum(limit, least + (margin + 4e-9 * np.sqrt(np.maximum(least, 0)) if wide else 0.0))
    row, col, dist = _exact(a, b, valid & (rough <= limit[:, None]), rough, b.shape[0], wide)
    best = _first_of_label(row, codes[col], col, dist)
    row, col, dist = row[best], col[best], dist[best]
    best = _first_k(row, col, dist, k)
    return row[best], col[best], dist[best]


def closest(a: np.ndarray, b: np.ndarray, valid: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None):
    """(row, col, distance) of the k nearest valid columns of every row.

    Columns must be in tie-break order. For wide Euclidean rows a matrix product
    narrows the columns down, with a margin above its rounding error, and the
    exact distance is computed for those alone. Columns farther than a row's
    ``bound`` may be left out.
    """
    rough, margin, wide = _rough(a, b, metric)
    if bound is not None and np.isfinite(bound).all():
        near = rough <= ((bound * bound + margin) if wide else bound)[:, None]
        near &= valid
        if np.count_nonzero(near) <= 4 * k * len(a):  # few are left: no need to search for the k-th
            return _exact(a, b, near, rough, k, wide)
    rough[~valid] = np.inf
    if b.shape[0] > k:
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
        # two distances equal after rounding may differ by 1e-9 before it
        slack = margin + 4e-9 * np.sqrt(np.maximum(limit, 0)) if wide else 0.0
        keep = valid & (rough <= (limit + slack)[:, None])
    else:
        keep = valid
    return _exact(a, b, keep, rough, k, wide)


def _exact(a: np.ndarray, b: np.ndarray, keep: np.ndarray, rough: np.ndarray, k: int, wide: bool):
    """(row, col, distance) of the k nearest columns to keep of every row."""
    row, col = np.nonzero(keep)
    if wide:
        gap = a[row] - b[col]
        dist = np.round(np.sqrt((gap * gap).sum(1)), DIGITS)
    else:
        dist = rough[row, col]
    best = _first_k(row, col, dist, k)
    return row[best], col[best], dist[best]


def _valid(relation: str, qid, qlabel, did, dlabel) -> np.ndarray:
    if relation == "same":
        ok = qlabel[:, None] == dlabel[None, :]
    elif relation == "other":
        ok = qlabel[:, None] != dlabel[None, :]
    else:
        ok = np.ones((len(qid), len(did)), dtype=bool)
    return ok & (qid[:, None] != did[None, :])


# ---- layout ---------------------------------------------------------------------

@dataclass
class Layout:
    """Data rows in cells, packed into blocks, with what is known of each cell."""

    blocks: DataFrame            # cell, chunk, rows: array<struct<id, label, x, w>>
    pivots: np.ndarray           # (cells, d)
    count: np.ndarray            # rows per cell
    radius: np.ndarray           # largest distance of a cell's row to its pivot
    low: np.ndarray              # smallest label of a cell
    high: np.ndarray             # largest label of a cell
    metric: str
    block_rows: int
    placed: DataFrame | None = None  # id, label, x, w, cell, reach: the rows before they are packed

    @property
    def cells(self) -> int:
        return len(self.count)


def _to_pivots(x: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances to all pivots and how far they may be off: wide Euclidean rows take a matrix product."""
    if metric != "l2" or x.shape[1] <= 8:
        return distances(x, pivots, metric), 0.0
    nx, np_ = (x * x).sum(1), (pivots * pivots).sum(1)
    square = nx[:, None] + np_[None, :] - 2.0 * (x @ pivots.T)
    off = 64 * np.finfo(float).eps * x.shape[1] * (nx.max(initial=0) + np_.max(initial=0))
    return np.sqrt(np.maximum(square, 0.0)), math.sqrt(off)


def _assign(df: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add cell (a nearest pivot) and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*df.schema.fields, *_CELL, T.StructField("reach", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            cell = np.empty(len(x), dtype=np.int32)
            reach = np.empty(len(x))
            for lo in range(0, len(x), QUERY_BLOCK):
                part = x[lo: lo + QUERY_BLOCK]
                best = _to_pivots(part, p, metric)[0].argmin(axis=1)
                cell[lo: lo + QUERY_BLOCK] = best
                gap = part - p[best]
                reach[lo: lo + QUERY_BLOCK] = np.abs(gap).sum(1) if metric == "l1" else np.sqrt((gap * gap).sum(1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(reach)], names=[*batch.schema.names, "cell", "reach"]
            )

    return df.mapInArrow(run, schema)


def _pack(df: DataFrame, per_block: int, counts: dict[int, int], tasks: int, fields: list[str]) -> DataFrame:
    """Rows of a cell spread by hash over enough blocks, one row per block."""
    if len(counts) == 1:
        placed = df.withColumn("split", F.lit(_chunks(next(iter(counts.values())), per_block)))
    else:
        sizes = df.sparkSession.createDataFrame(
            [(int(c), _chunks(n, per_block)) for c, n in counts.items()], "cell int, split int"
        )
        placed = df.join(F.broadcast(sizes), "cell")  # at most MAX_PIVOTS rows
    # the chunk must not follow the label or the vector: the id spreads copies evenly
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("split")).cast("int"))
    return (
        placed.repartition(tasks, "cell", "chunk")
        .groupBy("cell", "chunk")
        .agg(F.collect_list(F.struct(*fields)).alias("rows"))
    )


def _chunks(rows: int, per_block: int) -> int:
    return max(1, math.ceil(rows / per_block))


def _tasks(spark, counts: dict[int, int], per_block: int) -> int:
    return min(parallelism(spark), sum(_chunks(n, per_block) for n in counts.values()))


def lay_out(data: DataFrame, metric: str, block_rows: int = DATA_BLOCK) -> Layout:
    """Cells and blocks of a frame (id, label, x, w), small frames being one cell."""
    spark = data.sparkSession
    fields = ["id", "label", "x", "w"]
    rows, dims = data.agg(F.count(F.lit(1)), F.max(F.size("x"))).head()
    dims = max(1, dims or 1)
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (8 * dims)))  # wide rows, fewer to a block
    if rows <= 2 * block_rows:
        blocks = _pack(data.withColumn("cell", F.lit(0)), block_rows, {0: rows}, _chunks(rows, block_rows), fields)
        nothing = np.array([None], dtype=object)
        return Layout(
            blocks, np.empty((1, 0)), np.array([rows]), np.array([np.inf]), nothing, nothing, metric, block_rows
        )
    first = data.select("id", "x").orderBy(draw(SEED, F.col("id")), "id")
    wanted = min(MAX_PIVOTS, math.ceil(math.sqrt(rows)), max(1, PIVOT_BYTES // (8 * dims)))
    pivots = np.unique(np.array([r["x"] for r in first.limit(wanted).collect()]), axis=0)
    placed = pin(_assign(data, pivots, metric))
    stats = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("reach").alias("r"), F.min("label").alias("lo"), F.max("label").alias("hi")
    ).collect()
    count, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    low, high = np.empty(len(pivots), dtype=object), np.empty(len(pivots), dtype=object)
    for s in stats:
        count[s["cell"]], radius[s["cell"]] = s["n"], s["r"]
        low[s["cell"]], high[s["cell"]] = s["lo"], s["hi"]
    blocks = _pack(placed, block_rows, {s["cell"]: s["n"] for s in stats}, parallelism(spark), fields)
    return Layout(blocks, pivots, count, radius, low, high, metric, block_rows, placed)


def _pairs(queries: DataFrame, fields: list[str], layout: Layout) -> DataFrame:
    """One row (q, d) per query block and data block of the same cell."""
    counts = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = counts or {0: 0}
    spark = queries.sparkSession
    q = _pack(queries, QUERY_BLOCK, counts, _tasks(spark, counts, QUERY_BLOCK), fields)
    if layout.cells == 1 and layout.count[0] <= 2 * layout.block_rows:
        small = F.broadcast(layout.blocks.select(F.col("rows").alias("d")))  # one or two blocks, counted in lay_out
        return q.select(F.col("rows").alias("q"), F.lit(0).alias("cell")).join(
            small.withColumn("cell", F.lit(0)), "cell"
        ).select("q", "d")
    return _meet(q, {c: _chunks(n, QUERY_BLOCK) for c, n in counts.items()}, layout).select("q", "d")


def _meet(q: DataFrame, blocks: dict[int, int], layout: Layout) -> DataFrame:
    """One row (cell, q, d) per query block (cell, chunk, rows) and data block of the same cell.

    The join key is (cell, data chunk, salt): a query block is copied to each
    chunk of its cell and a data block to each salt, so no key holds more than
    ``SALT_BLOCKS`` query blocks however large the cell is. ``blocks`` are the
    query blocks of each cell.
    """
    sizes = q.sparkSession.createDataFrame(
        [(int(c), _chunks(int(layout.count[c]), layout.block_rows), _chunks(n, SALT_BLOCKS)) for c, n in blocks.items()],
        "cell int, chunks int, salts int",
    )
    sizes = F.broadcast(sizes)  # at most MAX_PIVOTS rows
    q = q.join(sizes, "cell").select(
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("data_chunk"),
        F.pmod("chunk", "salts").alias("salt"),
        F.col("rows").alias("q"),
    )
    d = layout.blocks.join(sizes, "cell").select(
        "cell",
        F.col("chunk").alias("data_chunk"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.col("rows").alias("d"),
    )
    return q.join(d, ["cell", "data_chunk", "salt"]).select("cell", "q", "d")


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.StructArray, pa.StructArray]]:
    for i in range(batch.num_rows):
        yield batch.column("q")[i].values, batch.column("d")[i].values


def _top_k(pairs: DataFrame, k: int, relation: str, metric: str) -> DataFrame:
    """The k best candidates of every query row within each block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in _block_rows(batch):
                did = d.field("id").to_numpy(zero_copy_only=False)
                order = np.argsort(did, kind="stable")
                qid = q.field("id").to_numpy(zero_copy_only=False)
                qlabel, dlabel = _codes(q.field("label"), d.field("label"))
                valid = _valid(relation, qid, qlabel, did[order], dlabel[order])
                a, b = _matrix(q.field("x")), _matrix(d.field("x"))[order]
                if relation == "distinct":
                    row, col, dist = closest_labels(a, b, valid, dlabel[order], k, metric, np.full(len(a), np.inf))
                else:
                    row, col, dist = closest(a, b, valid, k, metric)
                pick = pa.array(order[col])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [q.field("id").take(at), q.field("label").take(at), d.field("id").take(pick),
                     d.field("label").take(pick), pa.array(dist)],
                    names=["id", "label", "nid", "nlabel", "dist"],
                )

    return pairs.mapInArrow(run, "id bigint, label string, nid bigint, nlabel string, dist double")


def _merge(found: DataFrame, k: int, relation: str = "any") -> DataFrame:
    if relation == "distinct":
        found = found.groupBy("id", "nlabel").agg(F.min(F.struct("dist", "nid")).alias("m"), F.first("label").alias("label"))
        found = found.select("id", "label", "m.nid", "nlabel", "m.dist")
    order = Window.partitionBy("id").orderBy("dist", "nid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _can_hold(layout: Layout, relation: str, labels: np.ndarray) -> np.ndarray:
    """Per (query, cell): rows of the cell certain to satisfy the relation."""
    count = layout.count[None, :]
    if relation == "any":
        return np.repeat(count, len(labels), axis=0)
    if relation == "distinct":  # how many labels a cell holds is not known
        return np.zeros((len(labels), count.shape[1]), dtype=np.int64)
    pure = (layout.low == layout.high)[None, :]
    touches = (labels[:, None] == layout.low[None, :]) | (labels[:, None] == layout.high[None, :])
    if relation == "same":
        return np.where(touches, np.where(pure, count, 1), 0)
    return np.where(pure, np.where(touches, 0, count), np.minimum(count, 1))


def _may_hold(layout: Layout, relation: str, labels: np.ndarray) -> np.ndarray:
    pure = (layout.low == layout.high)[None, :]
    mine = labels[:, None] == layout.low[None, :]
    if relation == "same":
        return (~pure | mine) & (layout.count > 0)[None, :]
    if relation == "other":
        return (~pure | ~mine) & (layout.count > 0)[None, :]
    return np.repeat((layout.count > 0)[None, :], len(labels), axis=0)


def _bare(layout: Layout) -> SimpleNamespace:
    """What is known of the cells, without the blocks, to ship with a task."""
    names = ("pivots", "count", "radius", "low", "high", "metric")
    return SimpleNamespace(**{n: getattr(layout, n) for n in names})


def _plan_home(queries: DataFrame, layout: Layout, k: int, relation: str) -> DataFrame:
    """Add the home cell and ``limit``: a distance the k-th neighbour cannot exceed."""
    shared = queries.sparkSession.sparkContext.broadcast(_bare(layout))
    need = k + 1  # the row itself may be among the certain ones

    def run(batches):
        lay = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            names = np.asarray(batch.column("label").to_pylist(), dtype=object)
            home, limit = np.empty(len(x), dtype=np.int32), np.empty(len(x))
            for lo in range(0, len(x), QUERY_BLOCK):
                part = slice(lo, lo + QUERY_BLOCK)
                d, off = _to_pivots(x[part], lay.pivots, lay.metric)
                home[part] = np.where(lay.count[None, :] > 0, d, np.inf).argmin(axis=1)
                far = d + lay.radius[None, :] + off
                order = far.argsort(axis=1)
                sure = np.take_along_axis(_can_hold(lay, relation, names[part]), order, axis=1).cumsum(axis=1)
                enough = sure >= need
                first = enough.argmax(axis=1)
                reach = np.take_along_axis(far, order, axis=1)[np.arange(len(d)), first]
                limit[part] = np.where(enough.any(axis=1), reach, np.inf)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home), pa.array(limit)], names=[*batch.schema.names, "cell", "limit"]
            )

    schema = T.StructType([*queries.schema.fields, *_CELL, T.StructField("limit", T.DoubleType())])
    return queries.mapInArrow(run, schema)


def _reachable(lay, x: np.ndarray, limit: np.ndarray, labels: np.ndarray, relation: str) -> tuple[np.ndarray, np.ndarray]:
    """Per (query, cell) whether the cell may hold an answer within the query's limit, and a distance nothing in it is nearer than."""
    d, off = _to_pivots(x, lay.pivots, lay.metric)
    gap = d - lay.radius[None, :] - off
    return (gap <= _slack(limit)[:, None]) & _may_hold(lay, relation, labels), gap


def _slack(limit: np.ndarray) -> np.ndarray:
    """A limit with room for rounding."""
    return limit * (1 + 1e-9) + 1e-8


def _regions(layout: Layout, most: int) -> np.ndarray:
    """The region of every cell: cells are halved along the direction they spread in until a part holds ``most`` rows."""
    region, parts, found = np.zeros(layout.cells, dtype=np.int32), [np.arange(layout.cells)], 0
    while parts:
        cells = parts.pop()
        rows = layout.count[cells]
        if len(cells) == 1 or rows.sum() <= most:
            region[cells], found = found, found + 1
            continue
        x = layout.pivots[cells] - layout.pivots[cells].mean(axis=0)
        way = x[(x * x).sum(1).argmax()]
        for _ in range(8):
            way = x.T @ (x @ way)
            way = way / (np.linalg.norm(way) or 1.0)
        order = np.argsort(x @ way, kind="stable")
        half = int(np.clip(np.searchsorted(rows[order].cumsum(), rows.sum() / 2) + 1, 1, len(cells) - 1))
        parts += [cells[order[:half]], cells[order[half:]]]
    return region


def _plan_regions(queries: DataFrame, layout: Layout, region: np.ndarray, relation: str) -> DataFrame:
    """Add ``regions``: those other than the home region that may hold an answer within the query's limit."""
    shared = queries.sparkSession.sparkContext.broadcast((_bare(layout), region))

    def run(batches):
        lay, region = shared.value
        order = np.argsort(region, kind="stable")
        start = np.searchsorted(region[order], np.arange(region.max() + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, limit = _matrix(batch.column("x")), batch.column("limit").to_numpy(zero_copy_only=False)
            home = batch.column("cell").to_numpy(zero_copy_only=False)
            labels = np.asarray(batch.column("label").to_pylist(), dtype=object)
            size, found = [], []
            for lo in range(0, len(x), QUERY_BLOCK):
                part = slice(lo, lo + QUERY_BLOCK)
                near, _ = _reachable(lay, x[part], limit[part], labels[part], relation)
                there = np.logical_or.reduceat(near[:, order], start, axis=1)
                there[np.arange(len(there)), region[home[part]]] = False
                size.append(there.sum(axis=1))
                found.append(np.nonzero(there)[1])
            ends = np.concatenate([[0], np.concatenate(size).cumsum()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))],
                names=[*batch.schema.names, "regions"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("regions", T.ArrayType(T.IntegerType()))]))


def _region_rows(layout: Layout) -> int:
    """How many rows a region may hold."""
    rows, dims = int(layout.count.sum()), max(1, layout.pivots.shape[1])
    return max(1, min(max(layout.block_rows, math.ceil(rows / REGIONS)), REGION_ROWS, REGION_BYTES // (8 * dims)))


def _dealt(asked: DataFrame, per_region: dict[int, int], layout: Layout, region: np.ndarray, most: int, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queries (any columns, id and region) and data rows (``fields``) with the ``part`` in which they meet.

    A region of more than ``most`` rows is cut into chunks and its queries into splits, by hashes of the ids; a task
    holds one chunk and one split. Queries are copied to each chunk and rows to each split of their region.
    """
    spark = asked.sparkSession
    rows = np.bincount(region, weights=layout.count)
    share = max(QUERY_BLOCK, min(most, math.ceil(sum(per_region.values()) / (4 * REGIONS))))
    sizes, parts = [], 0
    for r, n in sorted(per_region.items()):
        chunks, splits = _chunks(int(rows[r]), 2 * most), _chunks(n, share)
        sizes.append((int(r), parts, chunks, splits))
        parts += chunks * splits
    sizes = F.broadcast(spark.createDataFrame(sizes or [(0, 0, 1, 1)], "region int, base int, chunks int, splits int"))  # a row per region
    names = F.broadcast(spark.createDataFrame([(c, int(r)) for c, r in enumerate(region)], "cell int, region int"))  # at most MAX_PIVOTS rows
    spot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    kept = [c for c in asked.columns if c != "region"]
    q = asked.join(sizes, "region").select(
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), spot("splits").alias("split"), "base", "splits", *kept)
    d = layout.placed.join(names, "cell").join(sizes, "region").select(
        spot("chunks").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), "base", "splits", *fields)
    part = (F.col("base") + F.col("chunk") * F.col("splits") + F.col("split")).alias("part")
    tasks = max(1, min(2 * parts, 2 * parallelism(spark)))
    return q.select(part, *kept).repartition(tasks, "part"), d.select(part, *fields).repartition(tasks, "part")


def _searched(asked: DataFrame, per_region: dict[int, int], layout: Layout, region: np.ndarray, most: int, k: int, relation: str) -> DataFrame:
    """The k best candidates of every query (id, label, x, limit, cell, region) in each chunk of its region."""
    q, d = _dealt(asked.select("id", "label", "x", "limit", "cell", "region"), per_region, layout, region, most, ["id", "label", "x", "cell"])
    shared = asked.sparkSession.sparkContext.broadcast(_bare(layout))

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        return _search_chunk(q.combine_chunks(), d.combine_chunks(), shared.value, k, relation)

    schema = "id bigint, label string, nid bigint, nlabel string, dist double"
    return q.groupBy("part").cogroup(d.groupBy("part")).applyInArrow(run, schema)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _search_chunk(q: pa.Table, d: pa.Table, lay, k: int, relation: str) -> pa.Table:
    """The k nearest rows of ``d`` to each row of ``q``, cells in the order in which they come near a block of queries."""
    out = []
    if len(q) and len(d):
        q, d = q.sort_by([("cell", "ascending")]), d.sort_by([("cell", "ascending"), ("id", "ascending")])
        qx, dx = _matrix(_column(q, "x")), _matrix(_column(d, "x"))
        qid, did = (_column(t, "id").to_numpy(zero_copy_only=False) for t in (q, d))
        qcode, dcode = _codes(_column(q, "label"), _column(d, "label"))
        names = np.asarray(_column(q, "label").to_pylist(), dtype=object)
        limits = _column(q, "limit").to_numpy(zero_copy_only=False)
        cells, start = np.unique(_column(d, "cell").to_numpy(zero_copy_only=False), return_index=True)
        end = np.append(start[1:], len(d))
        here = SimpleNamespace(metric=lay.metric, **{n: getattr(lay, n)[cells] for n in ("pivots", "count", "radius", "low", "high")})
        for lo in range(0, len(q), QUERY_BLOCK):
            part = np.arange(lo, min(len(q), lo + QUERY_BLOCK))
            limit = limits[part].copy()
            may, gap = _reachable(here, qx[part], limit, names[part], relation)
            nearest_ = np.where(may, gap, np.inf).min(axis=0)
            order = np.argsort(nearest_, kind="stable")
            order = order[np.isfinite(nearest_[order])]
            row, col, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            done = 0
            while done < len(order):
                some, width = [], 0
                while done < len(order) and (not some or width + end[order[done]] - start[order[done]] <= TILE_COLUMNS):
                    some.append(order[done])
                    width += end[some[-1]] - start[some[-1]]
                    done += 1
                ask = np.nonzero((may[:, some] & (gap[:, some] <= _slack(limit)[:, None])).any(axis=1))[0]
                if not len(ask):
                    continue
                columns = np.concatenate([np.arange(start[c], end[c]) for c in some])
                columns = columns[np.argsort(did[columns], kind="stable")]
                for at in range(0, len(columns), 2 * TILE_COLUMNS):  # a cell may be wide
                    tile = columns[at: at + 2 * TILE_COLUMNS]
                    valid = _valid(relation, qid[part[ask]], qcode[part[ask]], did[tile], dcode[tile])
                    if relation == "distinct":
                        r, c, x = closest_labels(qx[part[ask]], dx[tile], valid, dcode[tile], k, lay.metric, _slack(limit[ask]))
                    else:
                        r, c, x = closest(qx[part[ask]], dx[tile], valid, k, lay.metric, _slack(limit[ask]))
                    row, col, dist = np.concatenate([row, ask[r]]), np.concatenate([col, tile[c]]), np.concatenate([dist, x])
                if relation == "distinct":
                    best = _first_of_label(row, dcode[col], did[col], dist)
                    row, col, dist = row[best], col[best], dist[best]
                best = _first_k(row, did[col], dist, k)
                row, col, dist = row[best], col[best], dist[best]
                full = np.bincount(row, minlength=len(part)) >= k
                kth = np.zeros(len(part))
                np.maximum.at(kth, row, dist)
                limit = np.where(full, np.minimum(limit, kth), limit)
            out.append((part[row], col, dist))
    empty = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    row, col, dist = (np.concatenate(a) for a in zip(*(out or empty)))
    row, col = pa.array(row), pa.array(col)
    return pa.table({
        "id": _column(q, "id").take(row), "label": _column(q, "label").take(row), "nid": _column(d, "id").take(col),
        "nlabel": _column(d, "label").take(col), "dist": pa.array(dist)})


# ---- operators ------------------------------------------------------------------

def nearest(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    relation: str = "any",
    metric: str = "l2",
    block_rows: int = DATA_BLOCK,
) -> DataFrame:
    """The k nearest data rows of every query row: id, label, nid, nlabel, dist, rank.

    ``relation`` restricts neighbours to rows of the query's own class
    (``same``) or of the others (``other``); ``distinct`` asks for k different
    labels, each by its nearest row. A row is never its own neighbour.
    A query with fewer than k eligible neighbours gets those there are.
    """
    q = queries.select("id", "label", "x")
    # Of identical rows only the k + 1 first ids can ever be answers. The rank
    # filter is applied before the shuffle too, so copies collapse map-side.
    copies = ["x"] if relation == "any" else ["x", "label"]
    first = Window.partitionBy(*copies).orderBy("id")
    slim = data.select("id", "label", "x").withColumn("copy", F.row_number().over(first))
    slim = slim.filter(F.col("copy") <= k + 1).drop("copy").withColumn("w", F.lit(1))
    layout = lay_out(slim, metric, block_rows)
    fields = ["id", "label", "x"]
    if layout.cells == 1:
        return _merge(_top_k(_pairs(q.withColumn("cell", F.lit(0)), fields, layout), k, relation, metric), k, relation)
    # the home region first; the others are ruled out by the distance found there
    most = _region_rows(layout)
    region = _regions(layout, most)
    homed = pin(_plan_home(q, layout, k, relation))
    per_cell = {r["cell"]: r["n"] for r in homed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_region: dict[int, int] = {}
    for c, n in per_cell.items():
        per_region[int(region[c])] = per_region.get(int(region[c]), 0) + n
    names = F.broadcast(q.sparkSession.createDataFrame([(c, int(r)) for c, r in enumerate(region)], "cell int, region int"))
    best = pin(_merge(_searched(homed.join(names, "cell"), per_region, layout, region, most, k, relation), k, relation).drop("rank"))
    kth = best.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("kth"))
    bound = F.when(F.col("n") == k, F.least("limit", "kth")).otherwise(F.col("limit"))
    rest = homed.join(kth, "id", "left").withColumn("limit", bound).drop("n", "kth")
    planned = pin(_plan_regions(rest, layout, region, relation).filter(F.size("regions") > 0))
    asked = planned.withColumn("region", F.explode("regions")).drop("regions")
    visits = {r["region"]: r["n"] for r in planned.select(F.explode("regions").alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not visits:
        return _merge(best, k, relation)
    return _merge(best.unionByName(_searched(asked, visits, layout, region, most, k, relation)), k, relation)


def _sum_pairs(pairs: DataFrame, kernel, names: list[str]) -> DataFrame:
    """Per (query, block) sums from ``kernel(q, d) -> [array per name]``."""

    def run(batches):
        for batch in batches:
            for q, d in _block_rows(batch):
                sums = kernel(q, d)
                yield pa.RecordBatch.from_arrays(
                    [q.field("id"), *[pa.array(np.asarray(s, dtype=float)) for s in sums]], names=["id", *names]
                )

    part = pairs.mapInArrow(run, "id bigint, " + ", ".join(f"{n} double" for n in names))
    return part.groupBy("id").agg(*[F.sum(n).alias(n) for n in names])


def count_within(queries: DataFrame, data: DataFrame, metric: str = "l2", block_rows: int = DATA_BLOCK) -> DataFrame:
    """How many data rows lie strictly nearer than each query's ``radius``: id, n.

    Copies are counted through a weight, a cell wholly inside the radius through
    its total, and a cell wholly outside is skipped.
    """
    slim = data.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    slim = slim.withColumn("label", F.lit("")).select("id", "label", "x", "w")
    layout = lay_out(slim, metric, block_rows)

    def kernel(q, d):
        near = np.round(distances(_matrix(q.field("x")), _matrix(d.field("x")), metric), DIGITS)
        radius = q.field("radius").to_numpy(zero_copy_only=False)
        weight = d.field("w").to_numpy(zero_copy_only=False)
        return [(near < radius[:, None]) @ weight]

    q = queries.select("id", "x", "radius")
    if layout.cells == 1:
        found = _sum_pairs(_pairs(q.withColumn("cell", F.lit(0)), ["id", "x", "radius"], layout), kernel, ["n"])
        return found.select("id", F.col("n").cast("bigint").alias("n"))
    totals = np.zeros(layout.cells)
    for r in layout.placed.groupBy("cell").agg(F.sum("w").alias("w")).collect():  # one row per cell
        totals[r["cell"]] = r["w"]
    most = _region_rows(layout)
    region = _regions(layout, most)
    planned = pin(_plan_radius(q, layout, totals, region))
    found = planned.select("id", F.col("w").alias("n"))
    asked = planned.select("id", "x", "radius", F.explode("regions").alias("region"))
    visits = {r["region"]: r["n"] for r in asked.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per region
    if visits:
        qs, ds = _dealt(asked, visits, layout, region, most, ["id", "x", "w", "cell"])
        shared = queries.sparkSession.sparkContext.broadcast(_bare(layout))

        def run(q: pa.Table, d: pa.Table) -> pa.Table:
            return _count_chunk(q.combine_chunks(), d.combine_chunks(), shared.value)

        found = found.unionByName(qs.groupBy("part").cogroup(ds.groupBy("part")).applyInArrow(run, "id bigint, n double"))
    return found.groupBy("id").agg(F.sum("n").cast("bigint").alias("n"))


def _inside_and_cut(d: np.ndarray, radius: np.ndarray, reach: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per (query, cell), from the distances to the pivots: whether the cell lies inside the radius, and whether that cuts it."""
    inside = d + reach[None, :] < radius[:, None] - 1e-8
    return inside, ~inside & (d - reach[None, :] <= radius[:, None] + 1e-8) & (count > 0)[None, :]


def _plan_radius(queries: DataFrame, layout: Layout, totals: np.ndarray, region: np.ndarray) -> DataFrame:
    """Per query the weight ``w`` of the cells inside its radius and the ``regions`` with a cell that it cuts."""
    shared = queries.sparkSession.sparkContext.broadcast((_bare(layout), totals, region))

    def run(batches):
        lay, weight, region = shared.value
        order = np.argsort(region, kind="stable")
        start = np.searchsorted(region[order], np.arange(region.max() + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            radius = batch.column("radius").to_numpy(zero_copy_only=False)
            w, found = [], []
            for lo in range(0, len(x), QUERY_BLOCK):
                part = slice(lo, lo + QUERY_BLOCK)
                inside, cut = _inside_and_cut(distances(x[part], lay.pivots, lay.metric), radius[part], lay.radius, lay.count)
                w.append(inside @ weight)
                found += [np.nonzero(t)[0].tolist() for t in np.logical_or.reduceat(cut[:, order], start, axis=1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(w)), pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "w", "regions"])

    return queries.mapInArrow(run, "id bigint, x array<double>, radius double, w double, regions array<int>")


def _count_chunk(q: pa.Table, d: pa.Table, lay) -> pa.Table:
    """Per row of ``q`` the weight of the rows of ``d`` nearer than its radius, in cells that the radius cuts."""
    ids, n = _column(q, "id"), np.zeros(len(q))
    if len(q) and len(d):
        d = d.sort_by([("cell", "ascending")])
        qx, dx = _matrix(_column(q, "x")), _matrix(_column(d, "x"))
        radius = _column(q, "radius").to_numpy(zero_copy_only=False)
        w = _column(d, "w").to_numpy(zero_copy_only=False).astype(float)
        cells, start = np.unique(_column(d, "cell").to_numpy(zero_copy_only=False), return_index=True)
        end = np.append(start[1:], len(d))
        for lo in range(0, len(q), QUERY_BLOCK):
            part = np.arange(lo, min(len(q), lo + QUERY_BLOCK))
            _, cut = _inside_and_cut(distances(qx[part], lay.pivots[cells], lay.metric), radius[part], lay.radius[cells], lay.count[cells])
            for c in np.nonzero(cut.any(axis=0))[0]:
                ask = part[cut[:, c]]
                for at in range(start[c], end[c], TILE_COLUMNS):
                    some = slice(at, min(end[c], at + TILE_COLUMNS))
                    n[ask] += (np.round(distances(qx[ask], dx[some], lay.metric), DIGITS) < radius[ask, None]) @ w[some]
    return pa.table({"id": ids, "n": pa.array(n)})


def sum_over_all(points: DataFrame, kernel, names: list[str], block_rows: int = DATA_BLOCK,
                 within: str | None = None) -> DataFrame:
    """Sums of a pair function over every pair of rows: id, w, <names>.

    For measures defined on all pairs, where no cell can be skipped. Identical
    (x, label) rows are computed once and weighted; the result has one row per
    distinct one, with its weight. ``within`` names an int column that restricts
    pairs to rows of the same group. Neither side is ever held whole.
    """
    cell = F.lit(0) if within is None else F.col(within).cast("int")
    slim = points.withColumn("cell", cell).groupBy("x", "label", "cell")
    slim = pin(slim.agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", "label", "x", "w", "cell"))
    fields = ["id", "label", "x", "w"]
    sizes = {r["cell"]: r["n"] for r in slim.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        sizes = {0: 0}
    count = np.zeros(max(sizes) + 1, dtype=np.int64)
    for c, n in sizes.items():
        count[c] = n
    nothing = np.array([None], dtype=object)
    blocks = _pack(slim, block_rows, sizes, _tasks(slim.sparkSession, sizes, block_rows), fields)
    layout = Layout(blocks, np.empty((1, 0)), count, np.array([np.inf]), nothing, nothing, "", block_rows)
    sums = _sum_pairs(_pairs(slim, fields, layout), kernel, names)
    return slim.select("id", "cell", "w").join(sums, "id")


# ---- every row against all rows, in groups --------------------------------------------

def _group_count(spark, rows: int, dims: int) -> int:
    """Groups of a bounded number of rows, a whole number for each core; few rows make few groups."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    most = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(1, dims))))
    return min(_chunks(rows, QUERY_BLOCK), cores * _chunks(rows, most * cores))


def _places(spark, groups: int) -> list[int]:
    """Numbers that hash partitioning over ``groups`` partitions sends to a partition each."""
    number = F.col("id").cast("int")
    tried = spark.range(0, 64 * groups, 1, 1).select(number.alias("n"), F.pmod(F.hash(number), F.lit(groups)).alias("part"))
    found = {r["part"]: r["n"] for r in tried.groupBy("part").agg(F.min("n").alias("n")).collect()}
    spare = (n for n in range(64 * groups, 65 * groups))
    return [found[p] if p in found else next(spare) for p in range(groups)]


def _struct(batches: list[pa.StructArray]) -> pa.StructArray:
    return pa.concat_arrays(batches) if len(batches) != 1 else batches[0]


def against_all(queries: DataFrame, asked: list[str], data: DataFrame, told: list[str], work, schema: str, rows: int, dims: int,
                block_rows: int = DATA_BLOCK) -> DataFrame:
    """Every query row held against every data row, without a row per pair of blocks.

    Query rows are dealt into groups by a hash of their ids. A task holds a group and lets all data rows pass, so a data row
    is copied once a group, a query row never, and a result is written once. ``work(q)``, of a group's columns ``asked``,
    returns a function to call with each block of the columns ``told``, and one that yields the result. ``rows`` is the number
    of query rows.
    """
    spark = queries.sparkSession
    groups = _group_count(spark, rows, dims)
    places = F.array(*[F.lit(p) for p in _places(spark, groups)])
    q = queries.select(F.get(places, F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).alias("place"), F.lit(False).alias("late"), F.struct(*asked).alias("q"))
    d = data.select(F.explode(places).alias("place"), F.lit(True).alias("late"), F.struct(*told).alias("d"))
    both = q.unionByName(d, allowMissingColumns=True).repartition(groups, "place").sortWithinPartitions("place", "late")

    def run(batches):
        place, held, step = None, [], None
        for batch in batches:
            at = batch.column("place").to_numpy()
            late = batch.column("late").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((np.diff(at) != 0) | (np.diff(late.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(at)]):
                if lo == hi:
                    continue
                if at[lo] != place:
                    if step is None and held:
                        step = work(_struct(held))
                    if step is not None:
                        yield from step[1]()
                    place, held, step = at[lo], [], None
                if not late[lo]:
                    held.append(batch.column("q").slice(lo, hi - lo))
                    continue
                if step is None and held:
                    step = work(_struct(held))
                    held = []
                if step is not None:
                    d = batch.column("d").slice(lo, hi - lo)
                    for k in range(0, len(d), block_rows):
                        step[0](d.slice(k, block_rows))
        if step is None and held:
            step = work(_struct(held))
        if step is not None:
            yield from step[1]()

    return both.mapInArrow(run, schema)


def sum_both_ways(points: DataFrame, kernel, names: list[str]) -> DataFrame:
    """Sums of symmetric pair functions over every pair of rows: id, w, <names>.

    As ``sum_over_all``, but a pair is looked at once for both its rows. Rows are dealt into groups of a bounded number
    by a hash of their ids, and a task holds two groups (or one): ``kernel(q, d)`` gives the sums of the rows of q and of d,
    ``kernel(q, None)`` those of the rows of q among themselves. A row is copied once a group.
    """
    spark = points.sparkSession
    slim = pin(points.groupBy("x", "label").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", "label", "x", "w"))
    rows, dims = slim.agg(F.count(F.lit(1)), F.max(F.size("x"))).head()
    most = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * max(1, dims or 1))))
    cores = max(1, spark.sparkContext.defaultParallelism)
    groups = max(_chunks(rows, most), min(_chunks(rows, QUERY_BLOCK), math.isqrt(6 * cores) + 1))
    tasks = groups * (groups + 1) // 2
    mine, other = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"), F.col("other")
    low, high = F.least("mine", other), F.greatest("mine", other)
    number = (high * (high + 1) / 2).cast("int") + low
    place = number if tasks > PLACED else F.get(F.array(*[F.lit(p) for p in _places(spark, tasks)]), number)
    dealt = slim.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    side = F.when(F.col("mine") == other, ALONE).when(F.col("mine") < other, FIRST).otherwise(SECOND)
    dealt = dealt.select(place.alias("place"), side.alias("side"), F.struct("id", "label", "x", "w").alias("q"))
    dealt = dealt.repartition(tasks, "place").sortWithinPartitions("place")

    def summed(held, side):
        rows, side = _struct(held), np.concatenate(side)
        alone, q, d = (rows.filter(pa.array(side == s)) for s in (ALONE, FIRST, SECOND))
        found = [(alone, kernel(alone, None)[0])] if len(alone) else []
        if len(q) and len(d):
            found = list(zip((q, d), kernel(q, d)))
        for side, sums in found:
            yield pa.RecordBatch.from_arrays([side.field("id"), *[pa.array(np.asarray(s, dtype=float)) for s in sums]], names=["id", *names])

    def run(batches):
        now, held, side = None, [], []
        for batch in batches:
            at = batch.column("place").to_numpy()
            ends = (np.flatnonzero(np.diff(at) != 0) + 1).tolist()
            for lo, hi in zip([0, *ends], [*ends, len(at)]):
                if lo == hi:
                    continue
                if at[lo] != now:
                    if held:
                        yield from summed(held, side)
                    now, held, side = at[lo], [], []
                held.append(batch.column("q").slice(lo, hi - lo))
                side.append(batch.column("side").to_numpy()[lo:hi])
        if held:
            yield from summed(held, side)

    part = dealt.mapInArrow(run, "id bigint, " + ", ".join(f"{n} double" for n in names))
    return slim.select("id", "w").join(part.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]), "id")
