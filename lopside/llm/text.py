"""Words, lines and rolling hashes of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Texts are handled in chunks of about half a
megabyte, so a task's memory does not depend on how many rows an Arrow batch holds; one longer text
is a chunk of its own. A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def codes(size: int, seed: int) -> np.ndarray:
    """A fixed pseudorandom 64-bit code for each symbol."""
    return mix(np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def byte_codes(seed: int = 1, lower: bool = False) -> np.ndarray:
    table = codes(256, seed)
    if lower:
        table[65:91] = table[97:123]
    return table


class Roll:
    """Hashes of arbitrary spans of a symbol array from one running sum.

    Symbol i adds code * base^i modulo 2^64; a span's sum is shifted back to start at power 0.
    """

    def __init__(self, base: int = 0xD6E8FEB86659FD93):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (self.base, self.inverse))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._reach(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, dtype=U64)
        np.cumsum(symbols * self.up[: len(symbols)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of ``batch`` with the bytes of their texts and each text's offsets in them."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


def decoded(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and per text the index of its first word (one more at the end)."""
    blank = np.zeros(256, dtype=bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    solid = ~blank[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        full = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][full], offsets[1:][full] - 1
        first[heads], last[tails] = solid[heads], solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text each word belongs to, from the bounds that ``words`` gives."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def trimmed(run):
    """``run``, handing the memory it freed back to the system at its end: worker processes live on between tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return whole


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in schema], schema=schema)
