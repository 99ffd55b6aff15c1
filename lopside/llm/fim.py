"""Fill-in-the-middle documents, cut at token boundaries held in a compressed boundary set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

BITS = 16
ARRAY, BITMAP, RUN = "array", "bitmap", "run"


class Container:
    """Sorted 16-bit numbers, kept in whichever of three forms takes the fewest bytes, with their local select.

    An array holds the numbers, a bitmap 1024 words and the count of ones before each, runs their first
    numbers and the count of numbers before each.
    """

    def __init__(self, low: np.ndarray):
        heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        sizes = {ARRAY: 2 * len(low), RUN: 4 * len(heads), BITMAP: (1 << BITS) // 8}
        self.kind = min(sizes, key=sizes.get)
        if self.kind == ARRAY:
            self.values = low.astype(np.uint16)
        elif self.kind == RUN:
            self.values, self.before = low[heads].astype(np.uint16), heads
        else:
            bits = np.zeros(1 << BITS, dtype=bool)
            bits[low] = True
            self.values = np.packbits(bits, bitorder="little").view(np.uint64)
            self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.values), dtype=np.int64)])

    def select(self, k: int) -> int:
        """The k-th smallest number, from 0."""
        if self.kind == ARRAY:
            return int(self.values[k])
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        left = k - int(self.before[at])
        if self.kind == RUN:
            return int(self.values[at]) + left
        ones = np.flatnonzero(np.unpackbits(self.values[at : at + 1].view(np.uint8), bitorder="little"))
        return at * 64 + int(ones[left])


class Boundaries:
    """A set of offsets as containers by their high bits, with the cardinality before each container."""

    def __init__(self, offsets: np.ndarray):
        keys, first = np.unique(offsets >> BITS, return_index=True)
        self.keys = keys
        self.before = np.append(first, len(offsets))
        self.containers = [Container(low & ((1 << BITS) - 1)) for low in np.split(offsets, first[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0: the container by cumulative cardinality, then its local select."""
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return (int(self.keys[at]) << BITS) + self.containers[at].select(k - int(self.before[at]))


def boundaries(texts: list[str]) -> Iterator[Boundaries]:
    """Offset 0 and the end of every token of each text, in code points.

    A token is a run of letters A-Z and a-z, or one other code point.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    ends = np.ones(len(points), dtype=bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    at = 0
    for text in texts:
        own = ends[at : at + len(text)]
        at += len(text)
        offsets = np.flatnonzero(own) + 1
        if len(own) and not own[-1]:
            offsets = np.append(offsets, len(own))  # the next text begins with a letter
        yield Boundaries(np.concatenate([[0], offsets]))


def _parts(text: str, cuts: Boundaries, draws: tuple[int, ...], fim_percent: int, spm_percent: int):
    n = len(cuts) - 1
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((cuts.select(draws[0] % (n + 1)), cuts.select(draws[1] % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if draws[3] % 100 < spm_percent:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _transformed(fim_percent: int, spm_percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.chunks(batch):
                texts = tx.decoded(data, offsets)
                draws = zip(*(part.column(f"draw_{k}").to_pylist() for k in range(1, 5)))
                rows = [_parts(t, b, d, fim_percent, spm_percent) for t, b, d in zip(texts, boundaries(texts), draws)]
                n, form, low, width, output = zip(*rows)
                yield tx.batch_of(schema, doc_id=part.column("doc_id"), n=n, form=form, prefix_chars=low, middle_chars=width, output=output)

    return run


def transformed(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """The columns of SCHEMA for every row of ``docs`` (doc_id, text): its text cut in three and put in another order.

    Four draws are the first four 32-bit groups of the SHA-256 of ``seed:doc_id``. The prefix ends after draw 1
    modulo (tokens + 1) or draw 2 so taken, whichever is smaller, the middle after the larger. An empty text, one
    that contains a mark, and those whose draw 3 modulo 100 reaches ``fim_percent`` stay plain; of the others those
    with draw 4 modulo 100 below ``spm_percent`` are written suffix, prefix, middle (spm), the rest prefix, suffix,
    middle (psm), each part behind its mark.

    A null text is empty. A row without doc_id draws from ``seed:`` alone and keeps its null. Rows that share a
    doc_id draw the same numbers, each for its own text. Other columns are not read; an empty table gives an empty
    result. Nothing is shuffled; texts are handled half a megabyte at a time.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long").alias(f"draw_{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws)
    return rows.mapInArrow(tx.trimmed(_transformed(fim_percent, spm_percent)), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that ``transformed`` wrote as ``output`` in ``form``; null if either is.

    The first occurrence of a mark is the one written: no part contains a mark, and no mark can begin in a part
    and end in the mark behind it, since "<" stands only at a mark's start.
    """

    def between(first: Column, last: Column) -> Column:
        return F.substring(output, first + 3, last - first - 3)

    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    end = F.length(output) + 1
    psm = F.concat(between(p, s), between(m, end), between(s, m))
    spm = F.concat(between(p, m), between(m, end), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(docs: DataFrame, **how) -> DataFrame:
    """``transformed`` with SHA-256 digests in place of the texts: of the output, and of the text restored from it."""
    rows = transformed(docs, **how)
    text = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
