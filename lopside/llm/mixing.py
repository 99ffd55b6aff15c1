"""Mixing sources to target weights from fixed-length blocks of words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.llm.names import fresh
from lopside.session import pin

WEIGHTS = (5, 2, 1)
SEED = 17
#: Above this many slots numpy's exact hypergeometric draw is not defined; a node is then split in proportion.
DRAW_LIMIT = 500_000_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> dict[str | None, float]:
    """Each source's share of all words by weight, at most ``cap`` times its size; the excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of range(size) sends each index: a Feistel network, walked until it lands inside."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & low[todo]
        for turn in range(4):
            left, right = right, left ^ (tx.mix(right + key[todo] + np.uint64(turn * 0x632BE59BD9B4E019 % (1 << 64))) & low[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(quota: np.ndarray, slots: int, seed: int, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source, slots of each source in all earlier shards) for the shards lo to hi - 1.

    The counts are multinomial draws conditioned on every source's quota. They come from a tree that
    halves the shards; a node's draw depends on the seed and its place only, so any task can find its
    own shards without the others.
    """
    def node(a, b, counts, before):
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, counts, before
            return
        middle = (a + b) // 2
        wanted, total = min((middle - a) * slots, int(counts.sum())), int(counts.sum())
        if total <= DRAW_LIMIT:
            left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(counts, wanted, method="marginals")
        else:
            exact = counts * (wanted / total)
            left = np.floor(exact).astype(np.int64)
            left[np.argsort(left - exact, kind="stable")[: wanted - int(left.sum())]] += 1
        yield from node(a, middle, left, before)
        yield from node(middle, b, counts - left, before + left)

    yield from node(0, max(1, math.ceil(int(quota.sum()) / slots)), quota, np.zeros_like(quota))


def _slots(quota, blocks, per_shard, seed):
    schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("source_no", pa.int32()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for shard, counts, before in shard_counts(quota, per_shard, seed, lo, hi):
                    source = np.repeat(np.arange(len(counts)), counts)
                    ordinal = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + before[source]
                    epoch, index = ordinal // blocks[source], ordinal % blocks[source]
                    key = tx.mix(source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch.astype(np.uint64) + np.uint64(seed))
                    block = permuted(index, blocks[source], key)
                    mixed = np.random.default_rng([seed, shard]).permutation(len(source))
                    yield tx.batch_of(schema, shard=np.full(len(source), shard), slot=mixed, source_no=source.astype(np.int32), block=block)

    return run


def _starts():
    schema = pa.schema([("doc_id", pa.int64()), ("source_no", pa.int32()), ("size", pa.int64()), ("part", pa.int32()), ("inside", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, so_far = None, 0
        for batch in batches:
            source, size = batch.column("source_no").to_numpy(), batch.column("size").to_numpy()
            upto = np.cumsum(size) - size
            first = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.zeros(0, int)
            inside = upto - np.repeat(upto[first], np.diff(np.append(first, len(source))))
            if len(source) and source[0] == at:
                inside[: (first[1] if len(first) > 1 else len(source))] += so_far
            if len(source):
                at, so_far = source[-1], int(inside[-1] + size[-1])
            yield tx.batch_of(schema, doc_id=batch.column("doc_id"), source_no=source, size=size, part=batch.column("part"), inside=inside)

    return run


class Mix:
    """The plan of a mix: ``rows`` (a row per document with its place in its source), ``slots``, ``sources``.

    Words of a source, documents in ascending (doc_id, size), are cut into blocks of ``length`` words, the
    last one shorter. A source gets target / (mean block length) slots, rounded. Output shards of
    ``per_shard`` slots draw how many of them each source fills (``shard_counts``); a source's slots walk
    through pseudorandom permutations of its blocks, a new one for each pass, so no block is used more
    than ceil(target / size) <= 3 times. Only per-source totals reach the driver: their number does not
    grow with the documents, and above ``max_sources`` the mix is refused.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, cap: float = 3.0, length: int = 128, per_shard: int = 4096, seed: int = SEED, max_sources: int = 1_000_000):
        spark = docs.sparkSession
        self.length = length
        size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        sized = pin(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size")))
        totals = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("size")).limit(max_sources + 1).collect()}
        if len(totals) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        wanted = targets(totals, weights, cap)
        names = list(sorted(s for s in totals if s is not None)) + [None] * (None in totals)
        count = np.array([totals[s] for s in names], dtype=np.int64)
        blocks = np.maximum(1, -(-count // length))
        quota = np.array([round(wanted[s] * b / n) if n else 0 for s, b, n in zip(names, blocks.tolist(), count.tolist())], dtype=np.int64)
        listed = [(i, s, totals[s], float(wanted[s])) for i, s in enumerate(names)]
        self.sources = spark.createDataFrame(listed, "source_no int, name string, source_size long, target double")
        numbered = sized.join(F.broadcast(self.sources), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source_no", "size")
        ranged = numbered.repartitionByRange("source_no", "doc_id", "size").sortWithinPartitions("source_no", "doc_id", "size")
        placed = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(tx.trimmed(_starts()), "doc_id long, source_no int, size long, part int, inside long")
        placed = pin(placed)
        ends = placed.groupBy("source_no", "part").agg(F.max(F.col("inside") + F.col("size")).alias("words"))
        before = F.sum("words").over(_before())
        ends = ends.select("source_no", "part", F.coalesce(before, F.lit(0)).alias("before"))  # at most a row per source and per range
        self.rows = placed.join(F.broadcast(ends), ["source_no", "part"]).select("doc_id", "source_no", "size", (F.col("inside") + F.col("before")).alias("start"))
        shards = max(1, math.ceil(int(quota.sum()) / per_shard))
        step = max(1, math.ceil(shards / 100_000))
        ranges = spark.range(0, shards, step, min(shards, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))).select("id", F.least(F.col("id") + step, F.lit(shards)).alias("stop"))
        self.slots = ranges.mapInArrow(tx.trimmed(_slots(quota, blocks, per_shard, seed)), "shard long, slot long, source_no int, block long")

    def pieces(self) -> DataFrame:
        """(doc_id, size, source_no, start, skip, words, uses): the words skip to skip + words - 1 of a document lie in
        one block, which the mix uses ``uses`` times. Documents without words have no pieces."""
        used = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("uses"))
        span = F.sequence(F.floor(F.col("start") / self.length), F.floor((F.col("start") + F.col("size") - 1) / self.length))
        cut = self.rows.filter("size > 0").withColumn("block", F.explode(span))
        begin = F.greatest(F.col("start"), F.col("block") * self.length)
        stop = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.length)
        cut = cut.select("*", (begin - F.col("start")).alias("skip"), (stop - begin).alias("words"))
        return cut.join(used.hint("merge"), ["source_no", "block"], "left").drop("block").fillna(0, ["uses"])

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every row."""
        row = ["doc_id", "size", "source_no", "start"]
        some = self.pieces().groupBy(*row).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        none = self.rows.filter("size = 0").select(*row, F.lit(0).cast("long").alias("taken"))
        joined = some.union(none).join(F.broadcast(self.sources), "source_no")
        return joined.select("doc_id", "size", "source_size", "target", "taken")


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source): how many of its words
    the mix takes, repeats counted.

    Null or wordless texts have size 0 and take 0. A null source is a source, last in order. Rows that share a doc_id
    count one by one. Other columns are not read. An empty table gives an empty result.
    """
    return Mix(docs, **how).taken()


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _cut(text: str, size: int, skip, words, uses, copy: int) -> str:
    parts, until = [], None
    for a, n, u in sorted(zip(skip, words, uses)):
        if u >= copy:
            if parts and a == until:
                parts[-1][1] = a + n
            else:
                parts.append([a, a + n])
            until = a + n
    if parts == [[0, size]]:
        return text
    raw = text.encode()
    start, end, _ = tx.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return "\n".join(raw[start[a] : end[b - 1]].decode() for a, b in parts)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The words the mix takes, as rows of the same columns: a document once for each pass that takes any of its
    words, with the text cut to these (n_chars follows). Documents of which nothing is taken are left out.

    Texts are found again by doc_id, which must be unique; rows without one are left out.
    """
    own, size, skip, words, uses, most, copy = fresh(docs, "_id", "_size", "_skip", "_words", "_uses", "_most", "_copy")
    spans = Mix(docs, **how).pieces().filter("uses > 0 and doc_id is not null").groupBy("doc_id", "start", "size").agg(
        F.collect_list("skip").alias(skip), F.collect_list("words").alias(words), F.collect_list("uses").alias(uses), F.max("uses").alias(most))

    @F.pandas_udf("string")
    def cut(text: pd.Series, size: pd.Series, skip: pd.Series, words: pd.Series, uses: pd.Series, copy: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, n, s.tolist(), w.tolist(), u.tolist(), c) for t, n, s, w, u, c in zip(text, size, skip, words, uses, copy)], dtype=object)

    times = F.explode(F.sequence(F.lit(1).cast("long"), most)).alias(copy)
    spans = spans.select(F.col("doc_id").alias(own), F.col("size").alias(size), skip, words, uses, times)
    joined = docs.join(spans, F.col("doc_id") == F.col(own))
    text = cut("text", size, skip, words, uses, copy)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
