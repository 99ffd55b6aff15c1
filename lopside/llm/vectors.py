"""Product quantisation of integer vectors, assigned under adaptive distance bounds.

Each round of clustering keeps, per vector and part, the entry assigned, an upper bound of its distance, the
next ``b`` entries with ordered lower bounds, and one outer bound for all entries not listed (Drake and Hamerly).
When entries move, the bounds are moved with them; only where they leave a doubt are distances computed, as exact
integers. ``b`` is chosen anew for each part and round from how many listed entries all vectors needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.session import pin, unpin

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integers beyond this cannot be summed in two halves; components are below 2**52 in size for it.
WIDEST = 1 << 62
ROWS = 4096
UP, DOWN = np.float32(np.inf), np.float32(-np.inf)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c, whole numbers in the narrowest kind that holds them.

    float64 (and its matrix product) while all terms stay below 2**53, int64 below 2**63, Python integers beyond.
    """
    most = max((int(abs(v).max()) for v in (x, c) if v.size), default=0)
    reach = 4 * max(1, x.shape[1]) * most * most
    if reach < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    if reach >= 1 << 63:
        x, c = x.astype(object), c.astype(object)
    out = np.zeros((len(x), len(c)), dtype=x.dtype)
    for k in range(x.shape[1]):
        out += (x[:, k : k + 1] - c[:, k]) ** 2
    return out


def squared_pairs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of x (rows, width) to c (rows, some, width), in the kinds of ``squared``."""
    most = max((int(abs(v).max()) for v in (x, c) if v.size), default=0)
    if 4 * max(1, x.shape[1]) * most * most >= 1 << 63:
        x, c = x.astype(object), c.astype(object)
    step = c - x[:, None, :]
    return (step * step).sum(2)


def above(square: np.ndarray) -> np.ndarray:
    """float32 roots that are not below the true ones."""
    return np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32) * np.float32(1 + 1e-6), UP)


def below(square: np.ndarray) -> np.ndarray:
    """float32 roots that are not above the true ones."""
    return np.maximum(np.nextafter(np.sqrt(square.astype(np.float64)).astype(np.float32) * np.float32(1 - 1e-6), DOWN), np.float32(0))


@dataclass
class State:
    """Of n vectors in one part: the entry assigned, its upper bound, the b next entries, and b + 1 ordered lower bounds.

    Bound j holds for listed entry j and all behind it, the last one for every entry not listed.
    """

    code: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray


def _ordered(square: np.ndarray, b: int) -> State:
    """The state of rows whose squared distances to all entries are known; ties go to the lower index."""
    n, k = square.shape
    b = min(b, k - 1)
    order = np.argsort(square, axis=1, kind="stable")[:, : b + 2]
    near = np.take_along_axis(square, order, axis=1)
    lower = np.full((n, b + 1), UP, dtype=np.float32)
    lower[:, : near.shape[1] - 1] = below(near[:, 1:])
    return State(order[:, 0].astype(np.uint8), above(near[:, 0]), order[:, 1 : b + 1].astype(np.uint8), lower)


def first_state(x: np.ndarray, codebook: np.ndarray, b: int) -> State:
    """The state of vectors never assigned before, from all distances."""
    return _ordered(squared(x, codebook), b)


def moved(state: State, x: np.ndarray, codebook: np.ndarray, shift: np.ndarray, b: int) -> tuple[State, np.ndarray]:
    """The state after entries moved by at most ``shift`` (float32), with at most b listed, and how many listed entries each row needed.

    A row needs none if its bounds decide, z if the assigned entry had to be held against the first z listed ones
    (bound z is the first above the upper bound), and as many as there are entries if against all.
    """
    b = min(b, state.near.shape[1])
    most = shift.max(initial=np.float32(0))
    upper = np.nextafter(state.upper + shift[state.code], UP)
    drop = np.concatenate([shift[state.near], np.full((len(x), 1), most, np.float32)], axis=1)
    lower = np.nextafter(state.lower - drop, DOWN)
    lower = np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1][:, : b + 1]  # the bound behind b listed ones holds for all the others
    near, code = state.near[:, :b].copy(), state.code.copy()
    lower = np.maximum(lower, np.float32(0))
    needed = np.zeros(len(x), dtype=np.int64)
    doubt = np.flatnonzero(upper >= lower[:, 0])
    if len(doubt):
        exact = squared_pairs(x[doubt], codebook[code[doubt]][:, None, :])[:, 0]
        upper[doubt] = above(exact)
        clear = upper[doubt, None] < lower[doubt]
        first = np.where(clear.any(axis=1), clear.argmax(axis=1), b + 1)
        for z in np.unique(first[first > 0]).tolist():
            rows = doubt[first == z]
            if z > b:
                needed[rows] = len(codebook)
                fresh = _ordered(squared(x[rows], codebook), b)
                code[rows], upper[rows], near[rows, : fresh.near.shape[1]], lower[rows] = fresh.code, fresh.upper, fresh.near, fresh.lower
                continue
            needed[rows] = z
            entries = np.concatenate([code[rows, None], near[rows, :z]], axis=1).astype(np.int64)
            square = squared_pairs(x[rows], codebook[entries])
            order = np.argsort(entries, axis=1, kind="stable")
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(square, order, axis=1), axis=1, kind="stable"), axis=1)
            entries, square = np.take_along_axis(entries, order, axis=1), np.take_along_axis(square, order, axis=1)
            code[rows], upper[rows], near[rows, :z] = entries[:, 0], above(square[:, 0]), entries[:, 1:]
            lower[rows, :z] = np.minimum(below(square[:, 1:]), lower[rows, z : z + 1])
    return State(code, upper, near, lower), needed


def next_width(needed: np.ndarray, b: int) -> int:
    """The b for the next round: the cheapest for the rows counted by how many listed entries they needed.

    A row that needs z costs z distances, or all of them if z is above b; every listed entry costs a bound
    update, taken as a sixteenth of a distance. At least one entry stays listed; b never grows.
    """
    rows, k = needed.sum(), len(needed) - 1
    z = np.arange(k + 1)
    costs = [(np.where(z <= w, z, k) * needed).sum() + rows * w / 16 for w in range(1, b + 1)]
    return 1 + int(np.argmin(costs)) if b > 0 else 0


_BASE = [("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int64()))]
POINTS = "vec_id long, label string, v array<long>"
_STATE = _BASE + [(c, pa.binary()) for c in ("code", "upper", "near", "lower", "needed")]
STATE = POINTS + ", code binary, upper binary, near binary, lower binary, needed binary"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _blob(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    """A binary column of rows of one length as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)
    return raw.reshape(len(column), -1) if len(raw) else np.zeros((len(column), 0), dtype)


def _blobs(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(matrix.tobytes())])


def _assigned(codebooks: np.ndarray, widths: list[int], held: list[int] | None, shifts: np.ndarray | None):
    """Assigns every part of every vector; ``held`` are the numbers of listed entries in the state read, None for none."""
    schema = pa.schema(_STATE)
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                x = _matrix(rows).reshape(len(rows), parts, width)
                if held is not None:
                    code, upper = _blob(rows, "code", np.uint8), _blob(rows, "upper", np.float32)
                    near = np.split(_blob(rows, "near", np.uint8), np.cumsum(held)[:-1], axis=1)
                    lower = np.split(_blob(rows, "lower", np.float32), np.cumsum(np.array(held) + 1)[:-1], axis=1)
                states, needed = [], []
                for p in range(parts):
                    if held is None:
                        states.append(first_state(x[:, p], codebooks[p], widths[p]))
                        needed.append(np.full(len(rows), entries))
                        continue
                    state, need = moved(State(code[:, p], upper[:, p], near[p], lower[p]), x[:, p], codebooks[p], shifts[p], widths[p])
                    states.append(state)
                    needed.append(need)
                yield pa.RecordBatch.from_arrays([
                    *(rows.column(rows.schema.get_field_index(c)) for c, _ in _BASE),
                    _blobs(np.stack([s.code for s in states], axis=1)),
                    _blobs(np.stack([s.upper for s in states], axis=1)),
                    _blobs(np.concatenate([s.near for s in states], axis=1)),
                    _blobs(np.concatenate([s.lower for s in states], axis=1)),
                    _blobs(np.stack(needed, axis=1).astype(np.uint16)),
                ], schema=schema)

    return run


HALF = 31
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])
SUMS = "part int, entry int, n long, high array<long>, low array<long>"


def _totals(parts: int, entries: int, width: int):
    """Per task and entry: its number of vectors and their sums, high and low halves apart; part + PARTS counts the need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, entries), dtype=np.int64)
        high, low = (np.zeros((parts, entries, width), dtype=np.int64) for _ in range(2))
        need = np.zeros((parts, entries + 1), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                x = _matrix(rows).reshape(len(rows), parts, width)
                code, needed = _blob(rows, "code", np.uint8), _blob(rows, "needed", np.uint16)
                for p in range(parts):
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    need[p] += np.bincount(needed[:, p], minlength=entries + 1)
                    for total, half in ((high, x[:, p] >> HALF), (low, x[:, p] & ((1 << HALF) - 1))):  # ROWS halves stay exact as float64
                        for j in range(width):
                            total[p, :, j] += np.bincount(code[:, p], half[:, j], minlength=entries).astype(np.int64)
        for p in range(parts):
            used = np.flatnonzero(n[p])
            yield tx.batch_of(_SUMS, part=[p] * len(used), entry=used, n=n[p, used], high=high[p, used].tolist(), low=low[p, used].tolist())
            used = np.flatnonzero(need[p])
            yield tx.batch_of(_SUMS, part=[parts + p] * len(used), entry=used, n=need[p, used], high=[[]] * len(used), low=[[]] * len(used))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all tasks' rows of one (part, entry)."""
    held = {}
    for batch in batches:
        for part, entry, n, high, low in zip(*(batch.column(f.name).to_pylist() for f in _SUMS)):
            mine = (n, np.array(high, dtype=np.int64), np.array(low, dtype=np.int64))
            other = held.get((part, entry))
            held[part, entry] = mine if other is None else tuple(a + b for a, b in zip(mine, other))
    if held:
        (part, entry), (n, high, low) = zip(*held), zip(*held.values())
        yield tx.batch_of(_SUMS, part=part, entry=entry, n=n, high=[h.tolist() for h in high], low=[v.tolist() for v in low])


def _codes(codebooks: np.ndarray):
    """The final code of every vector and its error, null where it is no 64-bit integer."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                x, code = _matrix(rows).reshape(len(rows), parts, width), _blob(rows, "code", np.uint8)
                squares = [squared_pairs(x[:, p], codebooks[p][code[:, p]][:, None, :])[:, 0].tolist() for p in range(parts)]
                error = [e if e < 1 << 63 else None for e in (sum(row) for row in zip(*squares))]
                yield tx.batch_of(schema, vec_id=rows.column("vec_id"), label=rows.column("label"), code=[c.hex() for c in rows.column("code").to_pylist()], error=error)

    return run


def points(rows: DataFrame, vector: str = "embedding", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, v): the vectors that can be coded, floor(SCALE * x) per component, written out.

    A vector that is null or empty, or has a null or non-finite component, is left out. The length is that of the
    vector of the smallest vec_id (ties: of the smallest vector); vectors of other lengths are left out. Zeros are
    added at the end until the length is a multiple of ``parts``. A component of 2**52 or more raises an error.
    """
    x = F.col(vector).cast("array<double>")
    whole = F.size(x).__gt__(0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    bad = F.exists(x, lambda e: F.abs(e) >= float(WIDEST // SCALE))
    ints = F.transform(x, lambda e: F.floor(e * SCALE))
    ints = F.when(bad, F.raise_error(F.lit("a vector component is 2**52 or more"))).otherwise(ints)
    kept = rows.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), ints.alias("v"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v")).collect()
    length = first[0][0] if first else 0
    pad = -length % parts
    v = F.concat("v", F.array_repeat(F.lit(0).cast("long"), pad)) if pad else F.col("v")
    return pin(kept.filter(F.size("v") == length).select("vec_id", "label", v.alias("v")))


@dataclass
class Coded:
    """The assigned vectors (STATE), the final codebooks (parts, entries, width) and what each round listed and needed."""

    state: DataFrame
    codebooks: np.ndarray
    widths: list[list[int]]
    needed: list[np.ndarray]


def clustered(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, listed: int = 32) -> Coded:
    """Codebooks of ``table`` (as ``points`` gives it) after ``rounds`` rounds, and every vector's assignment to them.

    The codebooks start as the parts of the first vectors by vec_id (null last, ties by vector). The driver holds
    them, one sum per entry, and the number of rows by how many listed entries they needed. Each round's state is
    a written table; the one before it is deleted, ``table`` too.
    """
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], dtype=np.int64)
    books = books.reshape(len(first), parts, -1).transpose(1, 0, 2).copy() if len(first) else np.zeros((parts, 0, 0), np.int64)
    if not len(first):
        return Coded(table.sparkSession.createDataFrame([], STATE), books, [], [])
    k, width = books.shape[1:]
    widths, held, shifts, state = [min(listed, k - 1)] * parts, None, None, table
    log, needs = [], []
    for step in range(rounds + 1):
        last, state = state, pin(state.mapInArrow(tx.trimmed(_assigned(books, widths, held, shifts)), STATE))
        unpin(last)
        log.append(widths)
        held = widths
        sums = state.select("v", "code", "needed").mapInArrow(tx.trimmed(_totals(parts, k, width)), SUMS)
        totals = sums.repartition("part", "entry").mapInArrow(_merged, SUMS).collect()
        need = np.zeros((parts, k + 1), dtype=np.int64)
        new = books.copy()
        for r in totals:
            if r.part >= parts:
                need[r.part - parts, r.entry] = r.n
            elif step < rounds:
                new[r.part, r.entry] = [((high << HALF) + low) // r.n for high, low in zip(r.high, r.low)]
        needs.append(need)
        if step == rounds:
            break
        gap = ((new - books).astype(object) ** 2).sum(2)
        shifts = above(np.array(gap.tolist(), dtype=np.float64) * (1 + 1e-12))
        shifts[gap == 0] = 0
        if step:
            widths = [next_width(need[p], widths[p]) for p in range(parts)]
        books = new
    return Coded(state, books, log, needs)


#: A label with more than this part of all rows is joined by broadcast: there are fewer such labels than HOT.
HOT = 10_000


def quantised(rows: DataFrame, vector: str = "embedding", **how) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of ``rows`` (vec_id, label, vector) that ``points`` keeps.

    ``code`` is the hexadecimal index of each part's entry, ``error`` the squared distances to them, ``label_error``
    the sum of errors over rows of one label (rows without label together), ``codebooks_sha256`` the digest of all
    final entries. Errors that are no 64-bit integer are null. Fewer vectors than entries give smaller codebooks; rows
    that share a vec_id, or have none, are coded one by one. An empty table gives an empty result.
    """
    coded = clustered(points(rows, vector), **how)
    digest = hashlib.sha256(",".join(map(str, coded.codebooks.ravel().tolist())).encode()).hexdigest()
    out = pin(coded.state.select("vec_id", "label", "v", "code").mapInArrow(tx.trimmed(_codes(coded.codebooks)), "vec_id long, label string, code string, error long"))
    unpin(coded.state)
    every = F.count("*") == F.count("error")
    sums = out.groupBy(F.col("label").alias("of")).agg(F.when(every, F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)")).alias("label_error"), F.count("*").alias("n"))
    sums = pin(sums)
    rows_in_all = sums.agg(F.sum("n")).first()[0]
    hot = sums.filter(F.col("n") * HOT > F.lit(rows_in_all or 0)).drop("n").withColumn("is_hot", F.lit(True))
    rest = sums.filter(F.col("n") * HOT <= F.lit(rows_in_all or 0)).drop("n")
    same = F.col("label").eqNullSafe(F.col("of"))
    placed = out.join(F.broadcast(hot), same, "left")
    few = placed.filter("is_hot").select("vec_id", "code", "error", "label_error")
    if not rest.isEmpty():
        others = placed.filter("is_hot IS NULL").drop("of", "label_error", "is_hot").join(rest.hint("merge"), same)
        few = few.union(others.select("vec_id", "code", "error", "label_error"))
    return few.withColumn("codebooks_sha256", F.lit(digest))
