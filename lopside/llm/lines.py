"""Line dedup: a segment-partition edit join over the distinct lines of all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx
from lopside.llm.graph import components
from lopside.llm.names import fresh
from lopside.session import pin

GRAM = 3
#: Bytes of text cut into lines at a time: each code point takes some twenty words of memory on the way.
LINE_BYTES = 1 << 18
FILTER_BITS = 1 << 26


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: bit i of ``reach[j]`` says that i characters of ``a`` are matched with
    at most j edits; only the band of 2k + 1 bits around the diagonal is kept."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest common prefix
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[-middle:] == b[-middle:] else (low, middle - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 2 << i
    reach = [(2 << j) - 1 for j in range(k + 1)]
    for at, c in enumerate(b, 1):
        band = ((2 << (2 * k)) - 1) << (at - k) if at >= k else (2 << (at + k)) - 1
        own, new = places.get(c, 0), []
        for j, old in enumerate(reach):
            now = old << 1 & own
            if j:
                now |= reach[j - 1] << 1 | reach[j - 1] | new[j - 1] << 1
            new.append(now & band)
        reach = new
        if not reach[k]:
            return False
    return bool(reach[k] >> len(a) & 1)


def segments(length: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of the k + 1 segments of lines of these lengths: as even as can be, the longer ones last."""
    small = length // (k + 1)
    longer = length - small * (k + 1)
    out, at = [], np.zeros_like(length)
    for i in range(k + 1):
        size = small + (i >= k + 1 - longer)
        out.append((at, size))
        at = at + size
    return out


def keys(length: np.ndarray, hashed, k: int, least: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Index keys of every line, and (valid, key) of its probes.

    ``hashed(start, size)`` hashes that stretch of each line. A line of length L is indexed under each of its
    segments. To meet the lines of length L - d, d from 0 to k, it probes their segment i at the places that the
    edits left and right of the segment allow: at most i - 1 of them before it and k + 1 - i after it.
    """
    mark = lambda h, i, n: tx.mix(h + tx.mix(n.astype(np.uint64) * np.uint64(64) + np.uint64(i))).view(np.int64)
    own = [mark(hashed(start, size), i, length) for i, (start, size) in enumerate(segments(length, k))]
    probes = []
    for d in range(k + 1):
        other = np.maximum(length - d, k + 1)
        for i, (start, size) in enumerate(segments(other, k)):
            for move in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1):
                at = start + move
                valid = (length - d >= least) & (at >= 0) & (at + size <= length)
                at = np.clip(at, 0, np.maximum(length - size, 0))
                probes.append((valid, mark(hashed(at, np.minimum(size, length - at)), i, other)))
    return own, probes


class Cut:
    """The lines of one chunk of texts that hold a word, as spans of code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.symbols = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        blank = np.zeros(128, dtype=bool)
        blank[[32, 9, 10, 11, 12, 13]] = True
        solid = ~((self.symbols < 128) & blank[np.minimum(self.symbols, 127)])
        breaks = np.flatnonzero(self.symbols == 10)
        per_doc = np.searchsorted(breaks, heads[1:]) - np.searchsorted(breaks, heads[:-1]) + 1
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        place = np.arange(len(self.doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        first = place == 0
        begin = np.empty(len(self.doc), dtype=np.int64)
        begin[first], begin[~first] = heads[:-1], breaks + 1
        last = place == np.repeat(per_doc, per_doc) - 1
        stop = np.empty(len(self.doc), dtype=np.int64)
        stop[last], stop[~last] = heads[1:], breaks
        upto = np.concatenate([[0], np.cumsum(solid)])
        full = upto[stop] > upto[begin]
        self.doc, self.place, self.start, self.end = self.doc[full], place[full], begin[full], stop[full]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        upto = np.concatenate([[0], np.cumsum(opens)])
        self.words = upto[self.end] - upto[self.start] + (solid[self.start] & ~opens[self.start])

    def text(self, k: int) -> str:
        return self.symbols[self.start[k] : self.end[k]].tobytes().decode("utf-32-le")


class Hashes:
    """Two hashes of any stretch of code points."""

    def __init__(self):
        self.rolls = [tx.Roll(), tx.Roll(0xAF251AF3B0F025B5)]
        self.tables = [tx.codes(1 << 16, seed) for seed in (11, 12)]

    def over(self, symbols: np.ndarray, which: int):
        codes = self.tables[which][symbols & 0xFFFF] + (symbols >> 16).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        roll, sums = self.rolls[which], self.rolls[which].sums(codes)
        return codes, lambda start, end: roll.spans(sums, start, end)


def _sketch(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 parities of each line's GRAM-grams. An edit takes at most GRAM away and adds at most GRAM."""
    n = len(codes)
    gram = np.zeros(n + 1, dtype=np.uint64)
    if n >= GRAM:
        mixed = codes[: n - GRAM + 1]
        for g in range(1, GRAM):
            mixed = tx.mix(mixed) + codes[g : n - GRAM + 1 + g]
        gram[: len(mixed)] = np.uint64(1) << (tx.mix(mixed) >> np.uint64(58))
    upto = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(gram)])
    return (upto[np.maximum(end - GRAM + 1, start)] ^ upto[start]).view(np.int64)


def _keyed(k: int, least: int, names: list[str]):
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part, data, offsets in tx.chunks(batch, limit=LINE_BYTES):
                cut = Cut(data, offsets)
                codes, first = hashes.over(cut.symbols, 0)
                _, second = hashes.over(cut.symbols, 1)
                long_ = cut.end - cut.start >= least
                start, end = cut.start[long_], cut.end[long_]
                own, probes = keys(end - start, lambda at, size: first(start + at, start + at + size), k, least)  # noqa: B023
                columns = [part.column("doc_id").take(pa.array(cut.doc[long_])), first(start, end).view(np.int64), second(start, end).view(np.int64), _sketch(codes, start, end)]
                columns += own + [pa.array(key, mask=~valid) for valid, key in probes]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=pa.int64()) for c in columns], schema=schema)

    return run


OCCURRENCES = "doc_id long, place int, high long, low long, line string"


def _occurrences(bits: bytes | None, least: int):
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        marked = None if bits is None else np.frombuffer(bits, np.uint8)
        for batch in batches:
            for part, data, offsets in tx.chunks(batch, limit=LINE_BYTES):
                cut = Cut(data, offsets)
                high, low = (hashes.over(cut.symbols, w)[1](cut.start, cut.end) for w in (0, 1))
                lines = [None] * len(high)
                if marked is not None:
                    slot = (high >> np.uint64(64 - 26)).astype(np.int64)
                    for at in np.flatnonzero((marked[slot >> 3] >> (slot & 7) & 1).astype(bool) & (cut.end - cut.start >= least)).tolist():
                        lines[at] = cut.text(at)
                ids = part.column("doc_id")
                yield tx.batch_of(schema, doc_id=ids.take(pa.array(cut.doc)), place=cut.place.astype(np.int32), high=high.view(np.int64), low=low.view(np.int64), line=lines)
                without = np.setdiff1d(np.arange(len(part)), cut.doc)
                none = [None] * len(without)
                yield tx.batch_of(schema, doc_id=ids.take(pa.array(without)), place=np.full(len(without), -1, np.int32), high=none, low=none, line=none)

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for batch in batches:
        slot = (batch.column("high").to_numpy().view(np.uint64) >> np.uint64(64 - 26)).astype(np.int64)
        np.bitwise_or.at(out, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    at = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(np.int16))], names=["at", "byte"])


def _confirmed(k: int):
    schema = pa.schema([(n, pa.int64()) for n in ("a_high", "a_low", "b_high", "b_low")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.array([within(a, b, k) for a, b in zip(batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist())], dtype=bool)
            kept = batch.filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([kept.column(f.name) for f in schema], schema=schema)

    return run


def _verdicts():
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("n_links", pa.int64()), ("first_docs", pa.list_(pa.int64())), ("dropped", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, out, done = None, {}, None, []

        def flush():
            rows = pa.RecordBatch.from_pylist(done, schema=schema)
            done.clear()
            return rows

        for batch in batches:
            for doc, place, a, b, first, links in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "class_high", "class_low", "class_doc", "n_links"))):
                if out is None or doc != at:
                    if out is not None:
                        done.append(out)
                    at, seen = doc, {}
                    out = {"doc_id": doc, "n_lines": 0, "n_dropped": 0, "n_links": 0, "first_docs": [], "dropped": []}
                if place < 0:
                    continue
                earlier = seen.setdefault((a, b), place)
                out["n_lines"] += 1
                out["n_links"] += links
                out["first_docs"].append(first)
                if doc is not None and (first != doc or earlier != place):
                    out["n_dropped"] += 1
                    out["dropped"].append(place)
            if len(done) > 1000:
                yield flush()
        if out is not None:
            done.append(out)
        yield flush()

    return run


def duplicates(docs: DataFrame, max_edits: int = 1, min_chars: int = 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_links, first_docs, dropped for every doc_id of ``docs`` (doc_id, text).

    Lines are cut at \\n; those without a word are not looked at. Equal lines are one class, and lines of at least
    ``min_chars`` characters are linked when their edit distance is at most ``max_edits``; classes are the components of
    these links. Of a class the first line of the document with the smallest doc_id stays. ``first_docs`` names
    that document for each line in order, ``dropped`` the numbers of the lines that go, ``n_links`` how many different
    texts the document's lines are linked with.

    Only distinct lines are joined. A pair meets under a segment key if the 64 parities of their 3-grams differ in
    few enough places, and is confirmed on the texts, which a second scan picks out with a filter of fixed size.

    A null, empty or blank text has no lines. Rows that share a doc_id are one document; the same line at the same place
    of such rows is one line, and stays if any of them does. Lines of rows without doc_id are never dropped, and all
    these rows give one. Other columns are not read. An empty table gives an empty result.
    """
    spark, k = docs.sparkSession, max_edits
    least = max(min_chars, k + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = keys(np.zeros(0, dtype=np.int64), lambda at, size: at.astype(np.uint64), k, least)
    own, probe = [f"own_{i}" for i in range(len(sample[0]))], [f"probe_{i}" for i in range(len(sample[1]))]
    names = ["high", "low", "sketch", *own, *probe]
    keyed = texts.filter("doc_id is not null").mapInArrow(tx.trimmed(_keyed(k, least, names)), "doc_id long, " + ", ".join(f"{n} long" for n in names))
    distinct = pin(keyed.groupBy("high", "low").agg(*[F.min(n).alias(n) for n in names[2:]]))
    index = distinct.select(F.explode(F.array(*own)).alias("key"), "high", "sketch").alias("a")
    asked = distinct.select(F.explode(F.array(*probe)).alias("key"), "high", "sketch").filter("key is not null").alias("b")
    apart = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch")))
    met = index.join(asked, (F.col("a.key") == F.col("b.key")) & (F.col("a.high") != F.col("b.high")) & (apart <= 2 * GRAM * k))
    pairs = pin(met.select(F.least("a.high", "b.high").alias("a"), F.greatest("a.high", "b.high").alias("b")).distinct())

    wanted = pairs.select(F.col("a").alias("high")).union(pairs.select(F.col("b").alias("high"))).distinct()
    marked = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for at, byte in wanted.mapInArrow(tx.trimmed(_marks), "at long, byte short").groupBy("at").agg(F.bit_or("byte").alias("byte")).toLocalIterator():
        marked[at] = byte & 255  # at most a row per byte of the filter
    seen = pin(texts.mapInArrow(tx.trimmed(_occurrences(marked.tobytes() if marked.any() else None, least)), OCCURRENCES))

    lines = seen.filter("line is not null and doc_id is not null").join(wanted, "high", "left_semi").groupBy("high", "low").agg(F.min("line").alias("line"))
    lines = pin(lines)
    side = lambda s: lines.select(F.col("high").alias(f"{s}_high"), F.col("low").alias(f"{s}_low"), F.col("line").alias(f"{s}_line"))
    both = pairs.join(side("a"), F.col("a") == F.col("a_high")).join(side("b"), F.col("b") == F.col("b_high"))
    links = pin(both.select("a_high", "a_low", "a_line", "b_high", "b_low", "b_line").mapInArrow(tx.trimmed(_confirmed(k)), "a_high long, a_low long, b_high long, b_low long"))
    a, b = F.struct(F.col("a_high").alias("high"), F.col("a_low").alias("low")), F.struct(F.col("b_high").alias("high"), F.col("b_low").alias("low"))
    ends = links.select(a.alias("u"), b.alias("v"))
    linked = ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_links"))
    linked = components(ends).join(linked, "node").select("node.high", "node.low", F.col("label.high").alias("class_high"), F.col("label.low").alias("class_low"), "n_links")
    linked = pin(linked)

    named = seen.filter("place >= 0").join(linked, ["high", "low"], "left").select(
        "doc_id", "place", F.coalesce("class_high", "high").alias("class_high"), F.coalesce("class_low", "low").alias("class_low"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    firsts = named.groupBy("class_high", "class_low").agg(F.min("doc_id").alias("class_doc"))
    told = named.join(firsts, ["class_high", "class_low"])
    none = F.lit(None).cast("long")
    bare = seen.filter("place < 0").select("doc_id", "place", none.alias("class_high"), none.alias("class_low"), none.alias("class_doc"), none.alias("n_links"))
    told = told.select(bare.columns).union(bare).repartition("doc_id").sortWithinPartitions("doc_id", "place")
    return told.mapInArrow(tx.trimmed(_verdicts()), "doc_id long, n_lines long, n_dropped long, n_links long, first_docs array<long>, dropped array<int>")


def without(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the lines that ``duplicates`` drops taken out of their texts (n_chars follows).

    Documents that had words and lose all of them go; all other rows and columns stay.
    """
    own, dropped = fresh(docs, "_id", "_dropped")
    gone = duplicates(docs, **how).filter("n_dropped > 0").select(F.col("doc_id").alias(own), F.col("dropped").alias(dropped))

    @F.pandas_udf("string")
    def cut(text: pd.Series, away: pd.Series) -> pd.Series:
        def one(t, places):
            return "\n".join(line for k, line in enumerate(t.split("\n")) if k not in places)

        return pd.Series([one(t, set(a.tolist())) for t, a in zip(text, away)], dtype=object)

    joined = docs.join(gone, F.col("doc_id") == F.col(own), "left")
    same = joined.filter(F.col(own).isNull()).select(docs.columns)
    out = joined.filter(F.col(own).isNotNull()).withColumn("text", cut("text", dropped)).filter(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(out.select(docs.columns))
