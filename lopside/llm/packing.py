"""Packing tokenised documents into few sequences: dominance reduction, then best fit."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.session import pin

#: Characters whose classes every Unicode version agrees on; other texts go to the tokenizers library itself.
PLAIN = "[^\t\n\r\x20-\x7e\xa0-ɏΑ-ωЀ-џ‐-…]"


def encoder(model: str):
    """A function from a text to its ids, without special tokens added, for a byte-level BPE model (its JSON text).

    Plain texts take a faster engine with the same ranks when the model's merges are in the order of ids.
    """
    import re

    import tiktoken
    from tokenizers import Tokenizer

    spec, loaded = json.loads(model), []

    def slow(text: str) -> np.ndarray:
        if not loaded:
            loaded.append(Tokenizer.from_str(model))
        return np.array(loaded[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    marks = [t["content"] for t in spec.get("added_tokens", [])]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = spec["model"]["vocab"]
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in marks}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab["".join(p)] for p in pairs]
    step = spec.get("pre_tokenizer") or {}
    usual = step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not spec.get("normalizer")
    if not (usual and made == sorted(made) and len(ranks) == len(made) + 256):
        return slow
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast, odd = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), re.compile(PLAIN)

    def encode(text: str) -> np.ndarray:
        if odd.search(text) or any(m in text for m in marks):
            return slow(text)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def _pieces(model: str, capacity: int, end_id: int, keep_ids: bool):
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(model), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                out = defaultdict(list)
                for doc, text in zip(part.column("doc_id").to_pylist(), tx.decoded(data, offsets)):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        out["row"].append(row)
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                        if keep_ids:
                            out["ids"].append(ids[a:b].astype(np.int32))
                        row += 1
                yield tx.batch_of(schema, **{f.name: out[f.name] for f in schema})

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece: its document's ids and one end id, cut from the end into ``capacity`` if longer."""
    with open(tokenizer, encoding="utf-8") as file:
        model = file.read()
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tx.trimmed(_pieces(model, capacity, end_id, keep_ids)), schema)


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello and Toth's reduction on a histogram of lengths: sets fixed for good, (lengths, how often), and what is left.

    For each length, largest first, at most k of the smallest others fit beside it. With k = 0 it stands
    alone; with k = 1, or where one other fills the sequence exactly, the largest partner dominates every
    other choice; with k = 2 that partner dominates if no pair weighs more, and the heaviest pair does if
    its first is that partner and no lighter two are left between. A length none applies to is passed over.
    """
    left, fixed, order = dict(counts), [], sorted(counts)

    def fix(*lengths):
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
                order.remove(x)
        fixed.append((lengths, times))

    def largest(most, *used):
        """The largest length up to ``most`` of which some is left beside ``used``; 0 if none."""
        at = bisect_right(order, most)
        while at and left[order[at - 1]] <= used.count(order[at - 1]):
            at -= 1
        return order[at - 1] if at else 0

    def smallest(number, low, *used):
        """The ``number`` smallest lengths from ``low`` on, beside ``used``."""
        out, at = [], bisect_left(order, low)
        while at < len(order) and len(out) < number:
            out += [order[at]] * min(number - len(out), left[order[at]] - used.count(order[at]))
            at += 1
        return out

    for big in sorted(counts, reverse=True):
        while left.get(big):
            room, low = capacity - big, smallest(3, 0, big)
            fit = sum(sum(low[: k + 1]) <= room for k in range(len(low)))
            if not fit:
                fix(big)
                continue
            mate = largest(room, big)
            if fit == 1 or mate == room:
                fix(big, mate)
                continue
            if fit == 2:
                heads = [x for x in order if x < room and left[x] > (x == big)]
                pairs = [(x, largest(min(x, room - x), big, x)) for x in heads]
                one, two = max((p for p in pairs if p[1]), key=lambda p: (sum(p), p[0]))
                if mate >= one + two:
                    fix(big, mate)
                    continue
                between = sum(left[x] for x in order[bisect_right(order, two) : bisect_left(order, one)])
                if one == mate and (between <= 1 or sum(smallest(2, two + 1, big)) > room):
                    fix(big, one, two)
                    continue
            break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length on a histogram: equal open sequences are one entry with a number."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, how many]
    for x in sorted(counts, reverse=True):
        todo = counts[x]
        while todo:
            room = min((r for r, kept in open_.items() if r >= x and kept), default=None)
            if room is None:
                each = capacity // x
                if todo // each:
                    open_[capacity - each * x].append([(x,) * each, todo // each])
                if todo % each:
                    open_[capacity - todo % each * x].append([(x,) * (todo % each), 1])
                break
            lengths, number = open_[room].pop()
            each = min(room // x, todo)
            full = min(number, todo // each)
            open_[room - each * x].append([lengths + (x,) * each, full])
            if number > full:
                open_[room].append([lengths, number - full])
            todo -= each * full
    return [(tuple(lengths), number) for kept in open_.values() for lengths, number in kept]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs of places for each length: the ranks from ``rank`` on, ``number`` of them, go to the sequences from
    ``first`` on, at ``offset``. Its size depends on the capacity, not on the number of pieces."""
    fixed, left = reduced(counts, capacity)
    runs, ranked, sequence = [], defaultdict(int), 0
    for lengths, number in fixed + best_fit(left, capacity):
        offset = 0
        for x in lengths:
            runs.append((x, ranked[x], number, sequence, offset))
            ranked[x] += number
            offset += x
        sequence += number
    runs = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "number", "first", "offset"), runs.T.copy()))


def _placed(runs: dict[str, np.ndarray], names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.searchsorted(runs["length"], np.arange(runs["length"].max(initial=0) + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            wide = np.int64(1) << np.int64(44)
            at = np.searchsorted(runs["length"] * wide + runs["rank"], length * wide + rank, side="right") - 1
            assert len(heads) and (runs["length"][at] == length).all()
            sequence = runs["first"][at] + rank - runs["rank"][at]
            out = {n: batch.column(n) for n in names} | {"sequence_id": sequence, "offset": runs["offset"][at]}
            yield tx.batch_of(schema, **out)

    return run


BUCKETS = 1024


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece of ``docs`` (doc_id, text).

    The plan is made on the histogram of lengths, at most ``capacity`` rows; pieces of one length are
    alike and take its places by rank. Ranks come from counts per (length, bucket of rows), so a length
    that most pieces share is many small windows.

    A null text is empty: one piece of the end id. Rows that share a doc_id are packed one by one. A null
    doc_id stays null. Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    cut = pin(pieces(docs, tokenizer, capacity, end_id, keep_ids).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int")))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    totals = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    lower = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = cut.withColumn("inside", F.row_number().over(inside) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", (F.col("inside") + F.col("before")).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in [*names, "sequence_id", "offset"]])
    spark_kinds = {"piece": "int", "ids": "array<int>"}
    spark_schema = ", ".join(f"`{n}` {spark_kinds.get(n, 'long')}" for n in [*names, "sequence_id", "offset"])
    return ranked.select(*names, "rank").mapInArrow(tx.trimmed(_placed(plan(totals, capacity), names, schema)), spark_schema)
