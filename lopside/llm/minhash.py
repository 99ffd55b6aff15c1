"""Near-duplicate documents by SuperMinHash signatures, banding, exact confirmation and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.llm.graph import components
from lopside.llm.names import fresh
from lopside.session import pin

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, roll: tx.Roll, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, end to end, and each text's bounds.

    Letters A-Z count as lower case. A shingle is ``size`` consecutive words; a text with fewer words
    has its whole sequence as the only one; a text without words has none.
    """
    start, end, bounds = tx.words(data, offsets)
    sums = roll.sums(tx.byte_codes(seed=1, lower=True)[data])
    word = roll.spans(sums, start, end)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a == b:
            sets.append(word[:0])
            continue
        n = min(size, b - a)
        whole = word[a : b - n + 1]
        for k in range(1, n):
            whole = tx.mix(whole * np.uint64(0xA24BAED4963EE407) + word[a + k : b - n + 1 + k])
        sets.append(np.unique(whole + np.uint64(n)))
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    return np.concatenate(sets) if sets else word, np.concatenate([[0], np.cumsum(lengths)])


def signatures(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` slots per set; an empty set's row stays at EMPTY.

    Element i visits the slots in the order of its own random permutation and offers slot number j of
    that order the value j + r, r uniform in [0, 1) and drawn anew for each j. Round j handles the j-th
    visit of all elements at once; sets whose slots are all taken leave, since later values are larger.
    """
    n = len(bounds) - 1
    out = np.full(n * m, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = None
    for j in range(m):
        if j:
            open_ = (out.reshape(n, m) == EMPTY).any(axis=1)
            stay = open_[owner]
            if not stay.any():
                break
            if order is None or not stay.all():
                elements, owner = elements[stay], owner[stay]
                if order is None:
                    order = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
                    order[np.arange(len(elements)), slot[stay]] = 0
                else:
                    order = order[stay]
        draw = tx.mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        slot = (np.uint64(j) + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32))).astype(np.int64)
        value = (np.uint64(j) << np.uint64(48)) | (tx.mix(draw) >> np.uint64(16))
        if j:
            rows = np.arange(len(elements))
            slot, at = order[rows, slot].astype(np.int64), slot
            order[rows, at] = order[:, j]
        place = owner * m + slot
        free = out[place] == EMPTY
        np.minimum.at(out, place[free], value[free])
    return out.reshape(n, m)


def _sketches(size: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, m = tx.Roll(), bands * rows
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                sets, bounds = shingle_sets(data, offsets, roll, size)
                n = len(part)
                signed = signatures(sets, bounds, m)
                banded = signed.reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands))
                for r in range(rows):
                    key = tx.mix(key * np.uint64(0xA24BAED4963EE407) + banded[:, :, r])
                full = np.diff(bounds) > 0
                total = np.zeros((2, len(sets) + 1), dtype=np.uint64)
                np.cumsum(tx.mix(sets), out=total[0, 1:])
                np.cumsum(tx.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
                identity = (total[:, bounds[1:]] - total[:, bounds[:-1]]).view(np.int64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32), key[full].view(np.int64).ravel())
                yield tx.batch_of(schema, doc_id=part.column("doc_id"), n_shingles=np.diff(bounds), set_a=identity[0], set_b=identity[1], bands=lists)

    return run


def _confirm(size: int, percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, at, held = tx.Roll(), None, []
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                sets, bounds = shingle_sets(data, offsets, roll, size)
                u, v = [], []
                rows = zip(*(part.column(c).to_pylist() for c in ("center", "chunk", "side", "doc_id")))
                for k, (center, chunk, side, doc) in enumerate(rows):
                    if (center, chunk) != at:
                        at, held = (center, chunk), []
                    own = sets[bounds[k] : bounds[k + 1]]
                    if side == 0:
                        held.append(own.copy())
                        continue
                    for other in held:
                        if 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
                            continue
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            u.append(center)
                            v.append(doc)
                            break
                yield tx.batch_of(schema, u=u, v=v)

    return run


GROUP = 64


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (center, doc) whose full shingle sets reach the similarity, as (u, v).

    The partners of a center are cut into groups of about GROUP; a group's texts meet in one task, the
    center's first, so a center with very many partners is many small groups.
    """
    width = pairs.groupBy("center").agg(F.ceil(F.count("*") / GROUP).alias("width"))
    placed = pairs.join(width, "center").select("center", F.pmod(F.xxhash64("doc"), F.col("width")).alias("chunk"), "doc")
    heads = placed.select("center", "chunk").distinct().select("center", "chunk", F.lit(0).alias("side"), F.col("center").alias("doc_id"))
    wanted = heads.union(placed.select("center", "chunk", F.lit(1).alias("side"), F.col("doc").alias("doc_id")))
    placed = wanted.join(texts.hint("merge"), "doc_id").select("center", "chunk", "side", "doc_id", "text")
    placed = placed.repartition("center", "chunk").sortWithinPartitions("center", "chunk", "side", "doc_id")
    return placed.mapInArrow(tx.trimmed(_confirm(size, percent)), "u long, v long")


BLOCK = 512
COLUMNS = 4096


def _block_links(sets: list[np.ndarray], labels: np.ndarray, halves: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of different labels (and, if there are two halves, of different ones) whose sets reach the similarity."""
    number = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), number)
    shared = times[column] > 1
    row, column = row[shared], np.cumsum(times > 1)[column[shared]] - 1
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (number[:, None] + number[None, :] - both)
    linked &= labels[:, None] < labels[None, :]
    if len(np.unique(halves)) > 1:
        linked &= halves[:, None] != halves[None, :]
    return np.nonzero(linked)


def _blocks(size: int, percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, at, held = tx.Roll(), None, []

        def done():
            sets, labels, halves, docs = zip(*held)
            u, v = _block_links(list(sets), np.array(labels), np.array(halves), percent)
            docs = np.array(docs)
            return tx.batch_of(schema, u=docs[u], v=docs[v])

        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                sets, bounds = shingle_sets(data, offsets, roll, size)
                for k, (key, lo, hi, mine, doc, label) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "lo", "hi", "mine", "doc_id", "label")))):
                    if (key, lo, hi) != at:
                        if len(held) > 1:
                            yield done()
                        at, held = (key, lo, hi), []
                    held.append((sets[bounds[k] : bounds[k + 1]].copy(), label, mine, doc))
        if len(held) > 1:
            yield done()

    return run


def crossing(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) between rows of ``members`` (key, doc_id, label) of one key and different labels, confirmed on full sets.

    A key's members are cut into chunks of about BLOCK, and every pair of chunks meets in one block, where
    all intersections come from one product of 0/1 matrices; only links leave it.
    """
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    placed = members.join(parts, "key").select("key", "doc_id", "label", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    placed = placed.select("key", "doc_id", "label", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    block = ["key", "lo", "hi"]
    placed = placed.join(texts.hint("merge"), "doc_id").select(*block, "mine", "doc_id", "label", "text").repartition(*block).sortWithinPartitions(*block)
    return placed.mapInArrow(tx.trimmed(_blocks(size, percent)), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; the component
    is named by its smallest doc_id and that document is kept. Equal sets are collapsed first. Bands of
    ``rows`` slots propose candidates (at 0.8, 24 bands of 4 miss one pair in 300,000). First every
    member of a bucket is held against the bucket's center, the member that meets most others over all
    its buckets; then all members of one bucket that are still in different components are held against
    each other, block by block. Links are confirmed on full sets, of which each shingle is a 64-bit hash.

    A null or empty text has no shingles, is linked with nothing and kept. Rows that share a doc_id are
    one document. A row without doc_id is its own component (null) and kept. Columns other than doc_id
    and text are not read. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    sketch = pin(texts.mapInArrow(tx.trimmed(_sketches(size, bands, rows)), schema))
    named = sketch.filter("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    classes = pin(named.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    reps = named.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates([*same, "doc_id"])

    buckets = reps.select(F.explode("bands").alias("key"), "doc_id")
    crowd = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = pin(buckets.join(crowd, "key"))
    score = buckets.groupBy("doc_id").agg(F.sum("n").alias("score"))
    scored = buckets.join(score, "doc_id").select("key", "doc_id", F.struct(F.col("score"), (-F.col("doc_id")).alias("at")).alias("rank"))
    centers = scored.groupBy("key").agg((-F.max("rank")["at"]).alias("center"))
    stars = buckets.join(centers, "key").filter("doc_id != center").select("center", F.col("doc_id").alias("doc")).distinct()
    stars = pin(stars)
    links = pin(confirmed(stars, texts, size, percent))
    labels = components(links)

    placed = buckets.join(labels, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    placed = pin(placed)
    split = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    members = pin(placed.join(split.select("key"), "key", "left_semi"))
    extra = pin(crossing(members, texts, size, percent))
    if not extra.isEmpty():
        labels = components(links.union(extra))
    named_by = classes.join(labels, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("label", "rep").alias("component"))
    out = sketch.select("doc_id", *same).join(named_by, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns; of rows that share a doc_id one."""
    (other,) = fresh(docs, "_gone")
    gone = near_duplicates(docs, **how).filter(~F.col("kept")).select(F.col("doc_id").alias(other)).distinct()
    kept = docs.filter("doc_id is not null").join(gone, F.col("doc_id") == F.col(other), "left_anti")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
