"""Token counts of documents under a unigram model, by dynamic programming over tries of distinct pre-tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.llm import text as tx

#: Added to a piece's rank before the logarithm, so that the first ranks do not differ too much (a shifted Zipf law).
SHIFT = 10


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their log probabilities from a file of ``base64 rank`` lines: p is proportional to 1 / (rank + SHIFT)."""
    with open(path, "rb") as file:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, file))
    weight = 1.0 / (np.array([r for r, _ in pairs], dtype=np.float64) + SHIFT)
    return [p for _, p in pairs], np.log(weight / weight.sum())


class Pieces:
    """The vocabulary by hash of its bytes: a bitmap rules most spans out, a sorted array decides."""

    BITS = 22

    def __init__(self, pieces: list[bytes], logs: np.ndarray, roll: tx.Roll):
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        key = roll.spans(roll.sums(tx.byte_codes(seed=1)[data]), offsets[:-1], offsets[1:])
        order = np.argsort(key)
        self.key, self.log = key[order], logs[order]
        self.lengths = np.unique(np.diff(offsets))
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[key >> np.uint64(64 - self.BITS)] = True
        self.floor = float(logs.min())  # what a byte costs that is no piece itself

    def look_up(self, hashed: np.ndarray) -> np.ndarray:
        """Log probability of each hashed span, -inf where it is no piece."""
        out = np.full(len(hashed), -np.inf)
        at = np.flatnonzero(self.maybe[hashed >> np.uint64(64 - self.BITS)])
        place = np.minimum(np.searchsorted(self.key, hashed[at]), len(self.key) - 1)
        hit = self.key[place] == hashed[at]
        out[at[hit]] = self.log[place[hit]]
        return out


#: Pre-tokens of more bytes are segmented one by one.
SHORT = 64


def _trie(sums: np.ndarray, starts: np.ndarray, length: np.ndarray, roll: tx.Roll, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and score of the best segmentation of each distinct pre-token.

    A node of the trie is a distinct prefix. Its forward score is the best, over its last piece, of that
    piece and the score of the shorter prefix before it, so it is computed once for all pre-tokens that share it;
    all nodes of one depth are computed together. Pre-tokens read their result at their terminal node.
    """
    score, count = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]  # by depth, then node
    node = [np.zeros(len(starts), dtype=np.int32)]  # by depth: the node of each pre-token's prefix
    tokens, best = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts))
    for depth in range(1, int(length.max(initial=0)) + 1):
        live = np.flatnonzero(length >= depth)
        _, sample, inverse = np.unique(roll.spans(sums, starts[live], starts[live] + depth), return_index=True, return_inverse=True)
        member = live[sample]  # one pre-token through each node
        stop = starts[member] + depth
        top, least = np.full(len(member), -np.inf), np.zeros(len(member), dtype=np.int64)
        for size in pieces.lengths[pieces.lengths <= depth].tolist():
            log = pieces.look_up(roll.spans(sums, stop - size, stop))
            if size == 1:
                log[np.isneginf(log)] = pieces.floor
            hit = np.flatnonzero(~np.isneginf(log))
            before = node[depth - size][member[hit]]
            value = score[depth - size][before] + log[hit]
            better = value >= top[hit]  # of equal scores the longer last piece
            top[hit[better]], least[hit[better]] = value[better], count[depth - size][before[better]] + 1
        score.append(top)
        count.append(least)
        at = np.zeros(len(starts), dtype=np.int32)
        at[live] = inverse
        node.append(at)
        done = live[length[live] == depth]
        tokens[done], best[done] = least[at[done]], top[at[done]]
    return tokens, best


def _alone(sums: np.ndarray, start: int, length: int, roll: tx.Roll, pieces: Pieces) -> tuple[int, float]:
    """The same for one long pre-token: look all its spans up at once, then run over the pieces found."""
    ending: list[list[tuple[int, float]]] = [[] for _ in range(length + 1)]
    for size in pieces.lengths[pieces.lengths <= length].tolist():
        begin = np.arange(start, start + length - size + 1)
        log = pieces.look_up(roll.spans(sums, begin, begin + size))
        if size == 1:
            log[np.isneginf(log)] = pieces.floor
        for at in np.flatnonzero(~np.isneginf(log)).tolist():
            ending[at + size].append((size, float(log[at])))
    score, count = [0.0] * (length + 1), [0] * (length + 1)
    for stop in range(1, length + 1):
        top = -np.inf
        for size, log in ending[stop]:
            value = score[stop - size] + log
            if value >= top:
                top, score[stop], count[stop] = value, value, count[stop - size] + 1
    return count[length], score[length]


def segmented(words: list[bytes] | np.ndarray, bounds: np.ndarray, roll: tx.Roll, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and score of distinct pre-tokens that lie end to end in ``words``, cut at ``bounds``."""
    sums = roll.sums(tx.byte_codes(seed=1)[words])
    starts, length = bounds[:-1], np.diff(bounds)
    tokens, best = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts))
    short = np.flatnonzero(length <= SHORT)
    tokens[short], best[short] = _trie(sums, starts[short], length[short], roll, pieces)
    for k in np.flatnonzero(length > SHORT).tolist():
        tokens[k], best[k] = _alone(sums, int(starts[k]), int(length[k]), roll, pieces)
    return tokens, best


def _counted(names: list[bytes], logs: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64()), ("log_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = tx.Roll()
        pieces = Pieces(names, logs, roll)
        for batch in batches:
            for part, data, offsets in tx.chunks(batch, limit=8 * tx.CHUNK_BYTES):
                start, end, bounds = tx.words(data, offsets)
                word = roll.spans(roll.sums(tx.byte_codes(seed=1)[data]), start, end)
                _, sample, inverse = np.unique(word, return_index=True, return_inverse=True)
                size = end[sample] - start[sample] + 1  # with a space in front
                edges = np.concatenate([[0], np.cumsum(size)])
                spot = np.arange(edges[-1]) - np.repeat(edges[:-1], size)
                spaced = np.full(edges[-1], 32, dtype=np.uint8)
                inside = spot > 0
                spaced[inside] = data[(np.repeat(start[sample], size) + spot - 1)[inside]]
                tokens, score = segmented(spaced, edges, roll, pieces)
                owner, n = tx.owners(bounds), len(part)
                total = np.bincount(owner, weights=tokens[inverse], minlength=n).astype(np.int64)
                yield tx.batch_of(schema, doc_id=part.column("doc_id"), n_pretokens=np.diff(bounds), n_tokens=total, log_score=np.bincount(owner, weights=score[inverse], minlength=n))

    return run


def counted(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, log_score of every row of ``docs`` (doc_id, text).

    A pre-token is a word with a space in front; its tokens are the pieces of its best segmentation under
    the unigram model, a document's count and score are sums over its pre-tokens. A byte that is no piece counts as
    one token with the smallest probability.

    A null, empty or blank text has 0 of everything. Rows that share a doc_id are counted one by one, a null
    doc_id stays null. Other columns are not read. An empty table gives an empty result.
    """
    names, logs = vocabulary(vocabulary_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tx.trimmed(_counted(names, logs)), "doc_id long, n_pretokens long, n_tokens long, log_score double")
