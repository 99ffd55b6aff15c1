"""Exact n-gram Jaccard join of texts by prefix filters under several global orders."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.llm.graph import components
from lopside.llm.minhash import shingle_sets
from lopside.session import pin, unpin

#: Counters of the sketch that orders shingles by how often they occur, and counters in one row of it.
SLOTS = 1 << 18
SLOT_BLOCK = 1 << 10
#: A shingle is cold if its slot counts no more than this above four times the mean: no more texts can hold it.
COLD = 1000
#: Shingles that two similar sets share among their rarest, and members up to which a shingle is taken pair by pair.
SHARED, FEW = 3, 64
GROUP = 64
BLOCK = 256
#: Shingles that one side of a block is meant to hold at most.
BLOCK_SHINGLES = 1 << 18


def _slots(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - 18)).astype(np.int64)


_COUNTS = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
COUNTS = "block int, counts binary"


def _count_rows(counts: np.ndarray) -> pa.RecordBatch:
    blocks = counts.reshape(-1, SLOT_BLOCK)
    return tx.batch_of(_COUNTS, block=np.arange(len(blocks), dtype=np.int32), counts=[b.tobytes() for b in blocks])


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, counts = tx.Roll(), np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in tx.chunks(batch):
                counts += np.bincount(_slots(shingle_sets(data, offsets, roll, size)[0]), minlength=SLOTS)
        yield _count_rows(counts)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "counts"))):
            held[block] = held.get(block, 0) + np.frombuffer(counts, dtype=np.int64)
    yield tx.batch_of(_COUNTS, block=list(held), counts=[c.tobytes() for c in held.values()])


def frequencies(texts: DataFrame, size: int) -> np.ndarray:
    """SLOTS counters over the shingles of all texts, each shingle counted once a text in the slot of its hash.

    Two megabytes whatever the input: enough to tell common shingles from the rest, and any number per slot
    gives an order that all texts share.
    """
    rows = texts.mapInArrow(tx.trimmed(_counted(size)), COUNTS).repartition("block").mapInArrow(_added, COUNTS).collect()
    counts = np.zeros(SLOTS, dtype=np.int64)
    for r in rows:
        counts[r.block * SLOT_BLOCK : (r.block + 1) * SLOT_BLOCK] = np.frombuffer(r.counts, dtype=np.int64)
    return counts


def prefixes(own: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of a set (sorted hashes) under three orders: rarest first, lowest and highest hash first.

    Two sets that share ``percent`` of their union share at least a = ceil(percent * n / 100) shingles of either, so under
    any order common to both the first n - a + 1 of each have one in common, and the first n - a + SHARED have SHARED
    of them, or a if that is less. The order by rarity gets the longer prefix.
    """
    n = len(own)
    take = n - -(-percent * n // 100) + 1
    rare = own[np.lexsort((own, counts[_slots(own)]))[: take + SHARED - 1]]
    return rare, own[:take], own[n - take :]


def enough(most: Column, percent: int) -> Column:
    """How many shingles of the rarest two similar sets share at least, the larger having ``most`` shingles."""
    return F.least(F.lit(SHARED), F.ceil(percent * most / 100))


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash, for filters that may err on the side of a candidate."""
    return hashes.astype(np.uint32).view(np.int32)


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, rare array<long>, n_cold int, low array<int>, high array<int>"


def _sketched(size: int, percent: int, counts):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("rare", pa.list_(pa.int64())), ("n_cold", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])

    def lists(arrays, dtype):
        ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays).view(dtype)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, often = tx.Roll(), counts.value
        limit = COLD + 4 * int(often.mean())
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                sets, bounds = shingle_sets(data, offsets, roll, size)
                total = np.zeros((2, len(sets) + 1), dtype=np.uint64)
                np.cumsum(tx.mix(sets), out=total[0, 1:])
                np.cumsum(tx.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
                identity = (total[:, bounds[1:]] - total[:, bounds[:-1]]).view(np.int64)
                firsts = [prefixes(sets[a:b], often, percent) if b > a else (sets[:0],) * 3 for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                rare, low, high = zip(*firsts)
                cold = [int((often[_slots(a)] <= limit).sum()) for a in rare]
                yield tx.batch_of(schema, doc_id=part.column("doc_id"), n_shingles=np.diff(bounds), set_a=identity[0], set_b=identity[1],
                                  rare=lists(rare, np.int64), n_cold=cold, low=lists([_short(a) for a in low], np.int32), high=lists([_short(a) for a in high], np.int32))

    return run


def _near(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _starred(size: int, percent: int):
    """Of rows sorted by (center, chunk, side): the members (side 1) whose sets reach the similarity with the center's (side 0)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, at, held = tx.Roll(), None, None
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                sets, bounds = shingle_sets(data, offsets, roll, size)
                u, v = [], []
                for k, (center, chunk, side, doc) in enumerate(zip(*(part.column(c).to_pylist() for c in ("center", "chunk", "side", "doc_id")))):
                    own = sets[bounds[k] : bounds[k + 1]]
                    if side == 0:
                        at, held = (center, chunk), own.copy()
                    elif at == (center, chunk) and _near(len(own), len(held), len(np.intersect1d(own, held, assume_unique=True)), percent):
                        u.append(center)
                        v.append(doc)
                yield tx.batch_of(schema, u=u, v=v)

    return run


#: So many ids at most are broadcast.
WANTED = 500_000


def only(rows: DataFrame, wanted: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of the ids in ``column`` of ``wanted``: filtered on the scan while those are few, else left to the join that follows."""
    ids = pin(wanted.select(F.col(column).alias("doc_id")).distinct())
    return rows.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= WANTED else rows


def crossed(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs (center, doc) of fitting sizes that share a shingle among the first in the other two orders as well."""
    sides = [only(sketch, pairs, c).select(F.col("doc_id").alias(c), *[F.col(v).alias(f"{c}_{v}") for v in ("n_shingles", "low", "high")]) for c in ("center", "doc")]
    both = pairs.select("center", "doc").join(sides[0].hint("merge"), "center").join(sides[1].hint("merge"), "doc")
    fits = 100 * F.least("center_n_shingles", "doc_n_shingles") >= percent * F.greatest("center_n_shingles", "doc_n_shingles")
    return pin(both.filter(fits & F.arrays_overlap("center_low", "doc_low") & F.arrays_overlap("center_high", "doc_high")).select("center", "doc"))


def _met(percent: int):
    """Of rows sorted by key, the pairs of one key whose labels differ and whose sizes fit, and the larger size."""
    schema = pa.schema([("center", pa.int64()), ("doc", pa.int64()), ("most", pa.int64())])

    def paired(rows: pa.RecordBatch, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        a, b = _pairs(first, last)
        doc, n, label = (rows.column(c).to_numpy() for c in ("doc", "n_shingles", "label"))
        least, most = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        ok = (doc[a] != doc[b]) & (label[a] != label[b]) & (100 * least >= percent * most)
        a, b = a[ok], b[ok]
        return tx.batch_of(schema, center=np.minimum(doc[a], doc[b]), doc=np.maximum(doc[a], doc[b]), most=most[ok])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if left is not None and len(left):
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            if not len(batch):
                continue
            key = batch.column("key").to_numpy()
            first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            if len(first) > 1:
                yield paired(batch, first[:-1], first[1:])
            left = batch.slice(int(first[-1]))
        if left is not None and len(left):
            yield paired(left, np.array([0]), np.array([len(left)]))

    return run


def counted(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (center, doc) of different labels that share enough keys; ``members`` (key, doc, n_shingles, label) of FEW a key."""
    rows = members.select("key", "doc", "n_shingles", "label").repartition("key").sortWithinPartitions("key")
    pairs = rows.mapInArrow(tx.trimmed(_met(percent)), "center long, doc long, most long")
    return pairs.groupBy("center", "doc", "most").agg(F.count("*").alias("n")).filter(F.col("n") >= enough(F.col("most"), percent)).select("center", "doc")


def starred(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (center, doc) whose full sets reach the similarity, as (u, v).

    The members of a center with more than GROUP of them are dealt over chunks before they are joined with their
    texts, so its members never meet in one task.
    """
    width = pin(pairs.groupBy("center").agg(F.ceil(F.count("*") / GROUP).alias("width")).filter("width > 1"))
    chunk = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("width")), F.lit(0).cast("long"))
    placed = pin(pairs.join(width, "center", "left").select("center", chunk.alias("chunk"), "doc"))
    heads = placed.select("center", "chunk").distinct().select("center", "chunk", F.lit(0).alias("side"), F.col("center").alias("doc_id"))
    rows = heads.union(placed.select("center", "chunk", F.lit(1).alias("side"), F.col("doc").alias("doc_id")))
    rows = rows.join(only(texts, rows).hint("merge"), "doc_id").select("center", "chunk", "side", "doc_id", "text")
    rows = rows.repartition("center", "chunk").sortWithinPartitions("center", "chunk", "side")
    return rows.mapInArrow(tx.trimmed(_starred(size, percent)), "u long, v long")


def _products(row: np.ndarray, column: np.ndarray, n: int, step: int = 4096) -> np.ndarray:
    """How many columns each two of n rows share, from the (row, column) ones of a 0/1 matrix, a strip of columns at a time."""
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, step), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    return both


class _Lists:
    """A list column of 32- or 64-bit values, ready to tell which rows share one."""

    def __init__(self, column: pa.Array):
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        if values.dtype == np.int32:
            self.wide, self.number = 1 << 32, values.view(np.uint32).astype(np.int64)
        else:
            _, self.number = np.unique(values, return_inverse=True)
            self.wide = len(values) + 1
        self.low, self.size = offsets[:-1] - offsets[0], np.diff(offsets)
        self.held = np.sort(np.repeat(np.arange(len(self.size)), self.size) * self.wide + self.number)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For every pair (a, b) of rows whether their lists have a value in common."""
        if not len(self.held):
            return np.zeros(len(a), dtype=bool)
        a, b = np.where(self.size[a] <= self.size[b], a, b), np.where(self.size[a] <= self.size[b], b, a)
        pair = np.repeat(np.arange(len(a)), self.size[a])
        at = np.arange(len(pair)) - np.repeat(np.cumsum(self.size[a]) - self.size[a] - self.low[a], self.size[a])
        want = b[pair] * self.wide + self.number[at]
        place = np.minimum(np.searchsorted(self.held, want), len(self.held) - 1)
        return np.bincount(pair[self.held[place] == want], minlength=len(a)) > 0


def _pairs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b), a < b, of rows of one group; groups are given by their first row and the one behind their last."""
    row = np.concatenate([np.arange(x, y) for x, y in zip(first.tolist(), last.tolist())])
    many = np.repeat(last, last - first) - row - 1
    a = np.repeat(row, many)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)


#: Of a member's smaller keys so many are carried along: a pair that meets under one of them is not asked about again.
SMALLER = 16
#: Pairs that are looked at together in one task.
PAIRS = 1 << 17


def _surviving(percent: int):
    """Of rows sorted by (key, lo, hi), those that have a partner in their block which only the full sets can rule out."""
    def judged(rows: pa.RecordBatch, lists: list[tuple[_Lists, bool]], first: np.ndarray, last: np.ndarray) -> np.ndarray:
        a, b = _pairs(first, last)
        label, n, mine, lo, hi = (rows.column(c).to_numpy() for c in ("label", "n_shingles", "mine", "lo", "hi"))
        ok = (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        ok &= (lo[a] == hi[a]) | (mine[a] != mine[b])
        a, b = a[ok], b[ok]
        for column, want in lists:
            ok = column.shared(a, b) == want
            a, b = a[ok], b[ok]
        return np.union1d(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def whole(rows: pa.RecordBatch, end: bool):
            """The surviving rows of all blocks that are complete, and the rows of the last one unless it is the end."""
            key = np.stack([rows.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            first = np.concatenate([[0], cut])
            last = np.append(cut, len(rows))
            rest = len(rows) if end else int(first[-1])
            first, last = first[last <= rest], last[last <= rest]
            number = np.cumsum((last - first) * (last - first - 1) // 2)
            found, lists = [], [(_Lists(rows.column(c)), want) for c, want in (("smaller", False), ("low", True), ("high", True))]
            for low in range(0, int(number[-1]) if len(number) else 0, PAIRS):
                some = (number > low) & (number <= low + PAIRS) if low + PAIRS <= number[-1] else number > low
                if some.any():
                    found.append(judged(rows, lists, first[some], last[some]))
            keep = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            return rows.select(BLOCK_ROW).take(pa.array(keep)), rows.slice(rest)

        for batch in batches:
            if not len(batch):
                continue
            if left is not None and len(left):
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            kept, left = whole(batch, False)
            yield kept
        if left is not None and len(left):
            yield whole(left, True)[0]

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join the same rows as all True pairs of a square do, at most one fewer than rows."""
    left, out = set(range(len(linked))), []
    while left:
        todo = [left.pop()]
        while todo:
            k = todo.pop()
            new = [j for j in np.flatnonzero(linked[k]).tolist() if j in left]
            left.difference_update(new)
            todo += new
            out += [(k, j) for j in new]
    return out


BLOCK_ROW = ["key", "lo", "hi", "mine", "doc_id", "label"]


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the given sets share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    return _products(row[shared], (np.cumsum(times > 1) - 1)[column[shared]], len(sets)).astype(np.int64)


def _apart(block: list[tuple]) -> np.ndarray:
    """Which pairs of a block's rows (lo, hi, mine, label first) it has to decide."""
    lo, hi, mine, label = (np.array(v) for v in list(zip(*block))[:4])
    return (label[:, None] != label[None, :]) & ((lo[0] == hi[0]) | (mine[:, None] != mine[None, :]))


def _shorts(size: int):
    """The set of every text as 16 bits of each shingle, and its size."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("shorts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = tx.Roll()
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                sets, bounds = shingle_sets(data, offsets, roll, size)
                shorts = [np.unique(sets[a:b].astype(np.uint16)).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield tx.batch_of(schema, doc_id=part.column("doc_id"), n_shingles=np.diff(bounds), shorts=shorts)

    return run


def _bounded(percent: int):
    """Of rows sorted by (key, lo, hi), those with a partner whose shared 16-bit values leave the similarity possible.

    Sets share no more shingles than 16-bit values, plus those of either set that fell together with another.
    """
    schema = pa.schema([(c, pa.int64()) for c in BLOCK_ROW])

    def judged(block: list[tuple], rows: list[tuple]):
        _, _, _, _, n, shorts = zip(*block)
        sets, n = [np.frombuffer(s, np.uint16) for s in shorts], np.array(n)
        lost = n - np.array([len(s) for s in sets])
        most = _shared_counts(sets) + np.minimum(lost[:, None], lost[None, :])
        ok = (_apart(block) & (100 * most >= percent * (n[:, None] + n[None, :] - most))).any(axis=1)
        kept = [r for r, k in zip(rows, ok) if k]
        return tx.batch_of(schema, **{c: [r[j] for r in kept] for j, c in enumerate(BLOCK_ROW)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in [*BLOCK_ROW, "n_shingles", "shorts"])):
                if row[:3] != at:
                    if len(rows) > 1:
                        yield judged(block, rows)
                    at, rows, block = row[:3], [], []
                rows.append(row[:6])
                block.append((row[1], row[2], row[3], row[5], row[6], row[7]))
        if len(rows) > 1:
            yield judged(block, rows)

    return run


def _linked(size: int, percent: int):
    """Of rows sorted by (key, lo, hi), links that join what all pairs at the similarity join."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def judged(block: list[tuple]):
        _, _, _, _, doc, sets = zip(*block)
        n, both = np.array([len(s) for s in sets]), _shared_counts(list(sets))
        links = _forest(_apart(block) & (100 * both >= percent * (n[:, None] + n[None, :] - both)))
        return tx.batch_of(schema, u=[doc[a] for a, _ in links], v=[doc[b] for _, b in links])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, at, block = tx.Roll(), None, []
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                sets, bounds = shingle_sets(data, offsets, roll, size)
                for k, (key, lo, hi, mine, doc, label) in enumerate(zip(*(part.column(c).to_pylist() for c in BLOCK_ROW))):
                    if (key, lo, hi) != at:
                        if len(block) > 1:
                            yield judged(block)
                        at, block = (key, lo, hi), []
                    block.append((lo, hi, mine, label, doc, sets[bounds[k] : bounds[k + 1]].copy()))
        if len(block) > 1:
            yield judged(block)

    return run


def crossing(members: DataFrame, sketch: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between members (key, doc, label, n_shingles) of one key and different labels, confirmed on full sets.

    A key's members are cut into chunks and every two chunks meet in a block. There the cheap tests come first: two
    members are asked about only if none of their SMALLER smallest keys is one they share and have met under, and if they
    share shingles in the other two orders. Members with such a partner meet again with their whole sets at 16 bits a shingle, which bound what two can
    share, and those still possible with their texts. Of their links a block gives out a spanning forest.
    """
    parts = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    parts = pin(parts.filter("parts > 1"))
    own = members.groupBy("doc", "label", "n_shingles").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # twice its prefix at most
    sides = only(sketch, own, "doc").select(F.col("doc_id").alias("doc"), "low", "high")
    own = pin(own.join(sides.hint("merge"), "doc"))
    placed = own.select("*", F.posexplode("keys").alias("pos", "key")).withColumn("smaller", F.slice("keys", 1, F.least("pos", F.lit(SMALLER)))).drop("keys", "pos")
    many = F.coalesce("parts", F.lit(1).cast("long"))
    placed = placed.join(parts, "key", "left").withColumn("mine", F.pmod(F.xxhash64("doc"), many))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    placed = placed.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", F.col("doc").alias("doc_id"), "label", "n_shingles", "smaller", "low", "high")
    block = ["key", "lo", "hi"]
    placed = placed.repartition(*block).sortWithinPartitions(*block)
    row = "key long, lo long, hi long, mine long, doc_id long, label long"
    left = pin(placed.mapInArrow(tx.trimmed(_surviving(percent)), row))
    shorts = only(texts, left).mapInArrow(tx.trimmed(_shorts(size)), "doc_id long, n_shingles long, shorts binary")
    left = left.join(shorts.hint("merge"), "doc_id").select(*BLOCK_ROW, "n_shingles", "shorts").repartition(*block).sortWithinPartitions(*block)
    left = pin(left.mapInArrow(tx.trimmed(_bounded(percent)), row))
    rows = left.join(only(texts, left).hint("merge"), "doc_id").select(*BLOCK_ROW, "text").repartition(*block).sortWithinPartitions(*block)
    return rows.mapInArrow(tx.trimmed(_linked(size, percent)), "u long, v long").distinct()


def similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct ``size``-word shingles,
    and a component is named by its smallest doc_id. Equal sets are collapsed first. Candidates are documents that
    share a shingle among the first of their sets in each of three global orders: the rarest (by counts over all
    texts), the lowest and the highest hashes. Documents that meet in the first order are held against one center per
    shingle; then, where they are still apart, against those that share several shingles with them which few documents
    hold, and under the other shingles against each other block by block. The other two orders are always asked
    before any text is fetched, and every link is confirmed on full sets (a shingle is a 64-bit hash).

    A null or empty text has no shingles and is linked with nothing. Rows that share a doc_id are one document. A row
    without doc_id has a null component. Columns other than doc_id and text are not read. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = spark.sparkContext.broadcast(frequencies(texts, size))
    sketch = pin(texts.mapInArrow(tx.trimmed(_sketched(size, percent, counts)), SKETCH).withColumn("row", F.monotonically_increasing_id()))
    same = ["n_shingles", "set_a", "set_b"]
    every = pin(sketch.select("doc_id", "row", *same))
    named = every.filter("doc_id is not null and n_shingles > 0")
    classes = pin(named.groupBy(*same).agg(F.min(F.struct("doc_id", "row")).alias("first")).select(*same, F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row")))
    reps = sketch.filter("doc_id is not null and n_shingles > 0")
    rest = pin(named.select("row").join(classes.select("row"), "row", "left_anti"))
    reps = reps.join(F.broadcast(rest), "row", "left_anti") if rest.count() <= WANTED else pin(reps.join(classes.select("row"), "row", "left_semi"))

    cold = reps.select(F.explode(F.slice("rare", 1, F.col("n_cold"))).alias("key"), F.col("doc_id").alias("doc"))
    cold = cold.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1")
    hot = pin(reps.select(F.explode(F.slice("rare", F.col("n_cold") + 1, F.size("rare"))).alias("key"), F.col("doc_id").alias("doc")))
    crowd = pin(hot.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    buckets = cold.unionByName(hot.join(crowd, "key")).join(reps.select(F.col("doc_id").alias("doc"), "n_shingles"), "doc")
    buckets = pin(buckets.select("key", "doc", "n", "n_shingles"))
    score = buckets.groupBy("doc").agg(F.sum("n").alias("score"))
    scored = buckets.join(pin(score), "doc").select("key", "doc", F.struct(F.col("score"), (-F.col("doc")).alias("at")).alias("rank"))
    centers = pin(scored.groupBy("key").agg((-F.max("rank")["at"]).alias("center")))
    stars = buckets.join(centers, "key").filter("doc != center").groupBy("center", "doc", "n_shingles").agg(F.count("*").alias("n"))
    stars = pin(stars.filter(F.col("n") >= enough(F.col("n_shingles"), percent)).drop("n"))
    links = pin(starred(crossed(stars, reps, percent), texts, size, percent))
    labels = components(links)

    placed = pin(buckets.join(labels, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", "n_shingles", F.coalesce("label", "doc").alias("label")))
    # A pair that shares SHARED shingles, each held by FEW documents at most, is found by counting. Any other similar pair
    # shares one that more documents hold, and meets in the blocks of that one.
    pairs = pin(counted(placed.filter(F.col("n") <= FEW), percent))
    links = pin(links.union(starred(crossed(pairs, reps, percent), texts, size, percent)))
    labels = components(links)
    placed = placed.filter(F.col("n") > FEW).drop("label").join(labels, F.col("doc") == F.col("node"), "left")
    placed = placed.select("key", "doc", "n_shingles", F.coalesce("label", "doc").alias("label"))
    # Sets at the similarity differ in size by 100 / percent at most, so by one step of that scale: members of a key meet
    # within a step and the next one only. Of (key, step) groups with the same members, by number and two 64-bit hashes,
    # one will do.
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent + 1e-9)) if percent < 100 else F.col("n_shingles")
    placed = placed.filter("n_shingles > 0").select(F.explode(F.array(step, step + 1)).alias("step"), "key", "doc", "n_shingles", "label")
    placed = pin(placed.select(F.xxhash64("key", "step").alias("key"), "doc", "n_shingles", "label"))
    who = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("a"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("b")]
    split = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *who).filter("lo < hi")
    split = pin(split.groupBy("n", "a", "b").agg(F.min("key").alias("key")).select("key"))
    members = pin(placed.join(split, "key"))
    extra = pin(crossing(members, reps, texts, size, percent))
    if not extra.isEmpty():
        labels = components(links.union(extra))
    named_by = classes.join(labels, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("label", "rep").alias("component"))
    unpin(sketch)
    out = every.join(pin(named_by), same, "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
