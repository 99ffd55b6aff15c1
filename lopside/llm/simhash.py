"""SimHash fingerprints, and all fingerprints within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.llm.graph import components
from lopside.session import pin

BITS = 128
HEAVIEST = 15


def fingerprints(texts: list[str], roll: tx.Roll) -> np.ndarray:
    """Two unsigned 64-bit halves for every text.

    Terms are pairs of neighbouring words (the word itself if it is alone); every occurrence votes with
    the term's length in bytes, at most HEAVIEST, for the signs of the term's 128 hashed bits. A bit is
    set if more than half of the weight votes for it, so a text without words has the fingerprint 0.
    """
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    start, end, bounds = tx.words(data, offsets)
    word = roll.spans(roll.sums(tx.byte_codes(seed=1)[data]), start, end)
    owner, size = tx.owners(bounds), end - start
    paired = owner[1:] == owner[:-1]
    alone = np.flatnonzero(np.diff(bounds) == 1)
    left = np.flatnonzero(paired)
    first = np.concatenate([left, bounds[alone]])
    term = np.concatenate([tx.mix(word[left] * np.uint64(0xA24BAED4963EE407) + word[left + 1]), word[bounds[alone]]])
    weight = np.minimum(np.concatenate([size[left] + size[left + 1], size[bounds[alone]]]), HEAVIEST).astype(np.uint64)
    owner = owner[first]
    order = np.argsort(owner, kind="stable")
    term, weight, owner = term[order], weight[order], owner[order]
    votes = np.zeros((len(texts), BITS), dtype=np.int64)
    total = np.bincount(owner, weights=weight.astype(float), minlength=len(texts)).astype(np.int64)
    if len(term):
        spread = np.array([sum(((n >> b) & 1) << (16 * b) for b in range(4)) for n in range(16)], dtype=np.uint64)
        place = np.arange(len(term)) - np.searchsorted(owner, owner)
        heads = np.flatnonzero(place % 4096 == 0)  # 4096 * HEAVIEST fits 16 bits
        sums = np.empty((len(heads), BITS // 4), dtype=np.uint64)
        for half, hashed in enumerate((tx.mix(term + np.uint64(1)), tx.mix(term ^ np.uint64(0x94D049BB133111EB)))):
            for k in range(16):
                lanes = spread[(hashed >> np.uint64(4 * k)) & np.uint64(15)] * weight
                sums[:, half * 16 + k] = np.add.reduceat(lanes, heads)
        np.add.at(votes, owner[heads], sums.view(np.uint16).reshape(len(heads), BITS).astype(np.int64))
    bits = (2 * votes > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def edited(own: str, following: str) -> str:
    """``own`` with its last floor(n / 2) characters replaced by as many of the first of ``following``, or all."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, high long, low long"
_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("high", pa.int64()), ("low", pa.int64())]


def _digest(ids: list, texts: list[str], roll: tx.Roll) -> dict:
    """The columns of DIGEST for all texts but the last, which only follows."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    marks, new = fingerprints(texts, roll), fingerprints(changed, roll)
    text = lambda m: [f"{b:016x}{a:016x}" for a, b in m.tolist()]
    return {
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": text(marks[:-1]), "edited_fingerprint": text(new), "near_edited": likeness(marks[:-1], new), "near_next": likeness(marks[:-1], marks[1:]),
        "high": marks[:-1, 1].view(np.int64), "low": marks[:-1, 0].view(np.int64),
    }


def _in_order():
    schema = pa.schema(_FIELDS + [("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, held, opened = tx.Roll(), None, None

        def edge(part, which, doc, text):
            empty = {f.name: [None] for f in schema}
            return tx.batch_of(schema, **empty | {"doc_id": [doc], "part": [part], "edge": [which], "text": [text]})

        for batch in batches:
            for rows, data, offsets in tx.chunks(batch):
                ids, texts = rows.column("doc_id").to_pylist(), tx.decoded(data, offsets)
                if held is None:
                    opened = rows.column("part")[0].as_py()
                    yield edge(opened, 0, ids[0], texts[0])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                none = [None] * (len(ids) - 1)
                yield tx.batch_of(schema, **_digest(ids, texts, roll), part=none, edge=none, text=none)
                held = ids[-1], texts[-1]
        if held is not None:
            yield edge(opened, 1, *held)

    return run


def _across():
    schema = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, last = tx.Roll(), None
        for batch in batches:
            for rows, data, offsets in tx.chunks(batch):
                for doc, edge, text in zip(rows.column("doc_id").to_pylist(), rows.column("edge").to_pylist(), tx.decoded(data, offsets)):
                    if edge == 1:
                        last = doc, text
                    else:
                        yield tx.batch_of(schema, **_digest([last[0], doc], [last[1], text], roll))

    return run


def digests(docs: DataFrame) -> DataFrame:
    """The columns of DIGEST for every row of ``docs`` (doc_id, text); ``high`` and ``low`` are the fingerprint's halves.

    Rows are range partitioned by doc_id, so a task sees the next document beside its own. The first and
    last text of every range are written as well, and one row per range is finished from them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = DIGEST + ", part int, edge int, text string"
    done = pin(rows.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(tx.trimmed(_in_order()), schema))
    edges = done.filter("edge is not null").select("doc_id", "part", "edge", "text")
    parts = sorted(r[0] for r in edges.select("part").distinct().collect())
    ring = [(p, e, p if e else parts[k - 1]) for k, p in enumerate(parts) for e in (0, 1)]
    ring = docs.sparkSession.createDataFrame(ring, "part int, edge int, seam int")  # two rows per range
    seams = edges.join(F.broadcast(ring), ["part", "edge"]).repartition("seam").sortWithinPartitions("seam", F.col("edge").desc())
    seams = seams.select("doc_id", "edge", "text").mapInArrow(tx.trimmed(_across()), DIGEST)
    return done.filter("edge is null").select(seams.columns).unionByName(seams)


def within(marks: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """(high, low, n_within): for each distinct query fingerprint, how many rows of ``marks`` lie within ``radius`` bits.

    The 128 bits are cut into ``blocks`` parts. Fingerprints at most ``radius`` apart agree on at least
    blocks - radius parts, so there is a table for each choice of that many, keyed by these parts, and
    a pair counts in the first table in which it meets. Equal fingerprints are one row with a number.
    """
    width = BITS // blocks
    assert BITS % blocks == 0 and 64 % width == 0 and blocks > radius
    mask = (1 << width) - 1
    part = [F.shiftrightunsigned("low" if k * width < 64 else "high", k * width % 64).bitwiseAND(F.lit(mask)) for k in range(blocks)] if width < 64 else [F.col("low"), F.col("high")]
    choices = list(combinations(range(blocks), blocks - radius))
    tables = F.explode(F.array(*[F.struct(F.lit(n).alias("table"), F.xxhash64(*[part[k] for k in c]).alias("key")) for n, c in enumerate(choices)]))
    counted = marks.groupBy("high", "low").agg(F.count("*").alias("n")).select("*", tables.alias("at")).select("high", "low", "n", "at.*")
    asked = queries.select("high", "low").distinct().select("*", tables.alias("at")).select("high", "low", "at.*")
    a, b = counted.alias("a"), asked.alias("b")
    x = {h: F.col(f"a.{h}").bitwiseXOR(F.col(f"b.{h}")) for h in ("high", "low")}
    differ = [F.shiftrightunsigned(x["low" if k * width < 64 else "high"], k * width % 64).bitwiseAND(F.lit(mask)) != 0 for k in range(blocks)] if width < 64 else [x["low"] != 0, x["high"] != 0]
    first = F.lit(len(choices))
    for n, c in reversed(list(enumerate(choices))):
        apart = differ[c[0]]
        for k in c[1:]:
            apart = apart | differ[k]
        first = F.when(~apart, F.lit(n)).otherwise(first)
    near = (F.bit_count(x["high"]) + F.bit_count(x["low"]) <= radius) & (first == F.col("a.table"))
    met = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & near)
    return met.groupBy(F.col("b.high").alias("high"), F.col("b.low").alias("low")).agg(F.sum("a.n").alias("n_within"))


#: Bits that near copies of five-word Jaccard 0.8 lie apart; see README.
WIDE = 23
#: Held at once; each that is near takes some 200 bytes on the way.
PAIRS_AT_ONCE = 1 << 17
#: More than any block has.
BLOCK_BITS = 48
SPREAD = "at long, high long, low long, n long"
LINKED = "a_high long, a_low long, b_high long, b_low long, n long"


def _cuts(radius: int) -> np.ndarray:
    """Starts of so many even blocks of the bits that within ``radius`` one of them differs in at most one bit."""
    blocks = max(3, (radius + 2) // 2)  # three at least, as a block has to fit BLOCK_BITS
    return np.arange(blocks) * BITS // blocks


def _bits_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.stack([low, high], axis=1).view(np.uint8), axis=1, bitorder="little")


def _spread(radius: int):
    """Under twice the number of each block and its bits, every fingerprint; under the odd number after those and those
    with one bit turned, each that asks. So the probes of a key follow its fingerprints."""
    schema = pa.schema([(n, pa.int64()) for n in ("at", "high", "low", "n")])
    cuts = _cuts(radius)
    sizes = np.diff(np.append(cuts, BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low_row in range(0, len(batch), 2000):
                part = batch.slice(low_row, 2000)
                high, low, n = (part.column(c).to_numpy() for c in ("high", "low", "n"))
                asks = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
                bits = _bits_of(high, low).astype(np.int64)
                for j, (cut, size) in enumerate(zip(cuts, sizes)):
                    own = (bits[:, cut : cut + size] << np.arange(size)).sum(axis=1)
                    yield tx.batch_of(schema, at=(j << BLOCK_BITS | own) << 1, high=high, low=low, n=n)
                    turned = np.concatenate([[0], 1 << np.arange(size)])
                    probes = (own[asks][:, None] ^ turned[None, :]).ravel()
                    again = np.repeat(np.flatnonzero(asks), len(turned))
                    yield tx.batch_of(schema, at=(j << BLOCK_BITS | probes) << 1 | 1, high=high[again], low=low[again], n=n[again])

    return run


def _joined(i: np.ndarray, j: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest i of the component of each of ``n`` left and ``m`` right ends of the links (i, j); n where none is."""
    left, right = np.arange(n), np.full(m, n)
    while True:
        np.minimum.at(right, j, left[i])
        new = left.copy()
        np.minimum.at(new, i, right[j])
        if (new == left).all():
            return left, right
        left = new


def _met(radius: int):
    schema = pa.schema([(n, pa.int64()) for n in ("a_high", "a_low", "b_high", "b_low", "n")])
    cuts = _cuts(radius)

    def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        a, b = a.view(np.int64), b.view(np.int64)
        return tx.batch_of(schema, a_high=a[:, 0], a_low=a[:, 1], b_high=b[:, 0], b_low=b[:, 1], n=n)

    def links(block: int, held: np.ndarray, number: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS_AT_ONCE // len(asked))
        for k in range(0, len(held), step):
            b = held[k : k + step]
            apart = np.bitwise_count(asked[:, None, 0] ^ b[None, :, 0]) + np.bitwise_count(asked[:, None, 1] ^ b[None, :, 1])
            i, j = np.nonzero(apart <= radius)
            x = asked[i] ^ b[j]
            first = np.argmax(np.add.reduceat(_bits_of(x[:, 0], x[:, 1]), cuts, axis=1, dtype=np.uint8) <= 1, axis=1) == block
            i, j = i[first], j[first]
            if not len(i):
                continue
            sums = np.zeros(len(asked), dtype=np.int64)
            np.add.at(sums, i, number[k : k + step][j])
            own = np.flatnonzero(sums)
            yield rows(asked[own], asked[own], sums[own])
            left, right = _joined(i, j, len(asked), len(b))
            on, met = np.flatnonzero(left < np.arange(len(asked))), np.flatnonzero(right < len(asked))
            ends = np.concatenate([asked[on], b[met]])
            yield rows(asked[np.concatenate([left[on], right[met]])], ends, np.zeros(len(ends), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            at, number = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            both = np.stack([batch.column("high").to_numpy(), batch.column("low").to_numpy()], axis=1).view(np.uint64)
            heads = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
            for a, b in zip(heads, np.append(heads[1:], len(at))):
                if at[a] >> 1 != key:
                    key, held = at[a] >> 1, []
                if not at[a] & 1:
                    held.append((both[a:b], number[a:b]))
                elif held:
                    held = [tuple(map(np.concatenate, zip(*held)))] if len(held) > 1 else held
                    for k in range(a, b, 256):
                        yield from links(int(key >> BLOCK_BITS), *held[0], both[k : min(b, k + 256)])

    return run


def linked(marks: DataFrame, radius: int = WIDE) -> DataFrame:
    """Rows of LINKED for ``marks`` (high, low, n, asks; distinct): the n of an a that asks sum to the rows of ``marks``
    within ``radius`` bits of it, itself as well, and the (a, b) have the components that all such pairs have.

    The bits are cut into so many blocks that at least one differs in at most one bit. For each block a fingerprint
    stands under its bits there, and one that asks is held against those under its own bits and under each with one bit
    turned. The whole distance is exact, and a pair counts in the first block in which it meets. Sums and the stars of
    each block's components leave a task, never pairs.
    """
    spread = marks.select("high", "low", "n", "asks").mapInArrow(tx.trimmed(_spread(radius)), SPREAD)
    spread = spread.repartition(F.shiftright("at", 1)).sortWithinPartitions("at")
    return spread.mapInArrow(tx.trimmed(_met(radius)), LINKED)


def classes(rows: DataFrame, every: int, radius: int) -> DataFrame:
    """(high, low, n_near, class_id) for every distinct fingerprint of ``rows``; see ``fingerprinted``."""
    marks = rows.groupBy("high", "low").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.max(F.col("doc_id") % every == 0), F.lit(False)).alias("asks"))
    marks = pin(marks)
    links = pin(linked(marks, radius))
    near = links.groupBy(F.col("a_high").alias("high"), F.col("a_low").alias("low")).agg((F.sum("n") - 1).alias("n_near"))
    ends = links.select(F.struct(F.col("a_high").alias("high"), F.col("a_low").alias("low")).alias("u"), F.struct(F.col("b_high").alias("high"), F.col("b_low").alias("low")).alias("v"))
    labels = components(ends.filter("u != v")).select("node.high", "node.low", "label")
    named = marks.join(labels, ["high", "low"], "left").withColumn("label", F.coalesce("label", F.struct("high", "low")))
    named = pin(named)
    firsts = named.groupBy("label").agg(F.min("least").alias("class_id"))
    return named.join(firsts, "label").join(near, ["high", "low"], "left").select("high", "low", "n_near", "class_id")


def fingerprinted(docs: DataFrame, radius: int = 3, every: int = 20, wide: int = WIDE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``,
    and for rows whose doc_id is divisible by ``every``: n_within, the other rows whose fingerprint is at most ``radius``
    of 128 bits away, and n_near, those at most ``wide`` bits away, which takes in near copies. class_id of every row is
    the smallest doc_id of its class: rows of one fingerprint, and those within ``wide`` bits of a row that asks, are of
    one class with it.

    The next document is the next in ascending (doc_id, hash of the text), after the last the first; an
    only row follows itself. A null text is empty. A null doc_id sorts first, stays null and asks nothing. Rows that share
    a doc_id count one by one. Other columns are not read. An empty table gives an empty result.
    """
    rows = pin(digests(docs))
    asked = rows.filter(F.col("doc_id") % every == 0)
    near = within(rows, asked, radius)
    asks = F.col("doc_id") % every == 0
    told = classes(rows, every, wide).join(near.withColumn("n_within", F.col("n_within") - 1), ["high", "low"], "left")
    out = rows.join(told, ["high", "low"])
    columns = [n for n, _ in _FIELDS[:7]]
    return out.select(*columns, F.when(asks, F.col("n_within")).alias("n_within"), F.when(asks, F.col("n_near")).alias("n_near"), "class_id")
