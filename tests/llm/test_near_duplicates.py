import random
import re

import numpy as np
import pytest

from lopside.llm import minhash
from lopside.llm import text as tx
from lopside.llm.graph import components


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    """(n_shingles, component) by doc_id, every pair compared."""
    sets = {d: shingles(t, size) for d, t, *_ in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = sorted(sets)
    for k, a in enumerate(named):
        for b in named[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in named}


def result(docs, **how):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, **how).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_odd_rows(odd_docs, odd_rows, size):
    want = {(d, n, c, c == d) for d, (n, c) in brute(odd_rows, size, 80).items()}
    got = result(odd_docs, size=size)
    assert {r for r in got if r[0] is not None} == want
    assert {(r[2], r[3]) for r in got if r[0] is None} == {(None, True)}
    assert minhash.near_duplicates(odd_docs, size=size).count() == len(odd_rows)


def test_copies_in_chains_and_groups(spark):
    rng = random.Random(1)
    rows, base = [], [str(rng.randrange(300)) for _ in range(80)]
    for k in range(150):
        own = list(base) if k % 3 else [str(rng.randrange(300)) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(len(own))] = str(rng.randrange(300))
        rows.append((k * 7, " ".join(own)))
    rows += [(5000 + k, rows[4][1]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {(d, n, c, c == d) for d, (n, c) in brute(rows, 2, 80).items()}
    assert result(docs, size=2) == want


def test_blocks_split_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP", 2)
    test_copies_in_chains_and_groups(spark)


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op2_minhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {(d, n, c, c == d) for d, (n, c) in brute(rows, 2, 80).items()}


def test_empty_table(no_docs):
    assert minhash.near_duplicates(no_docs).collect() == []
    assert minhash.keep_one(no_docs).collect() == []


def test_keep_one_keeps_columns_and_one_row(odd_docs, odd_rows):
    kept = minhash.keep_one(odd_docs, size=2)
    assert kept.columns == odd_docs.columns
    named = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert sorted(named) == sorted(d for d, (_, c) in brute(odd_rows, 2, 80).items() if c == d)


def test_signature_is_the_minimum_over_all_visits():
    """Stopping early changes nothing, and agreement estimates the similarity."""
    m, rng = 32, np.random.default_rng(2)

    def plain(elements):
        best = [None] * m
        for e in elements:
            order = list(range(m))
            for j in range(m):
                draw = tx.mix(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                k = j + int((int(draw[0]) & 0xFFFFFFFF) * (m - j) >> 32)
                order[j], order[k] = order[k], order[j]
                value = (j << 48) | int(tx.mix(draw)[0]) >> 16
                best[order[j]] = value if best[order[j]] is None else min(best[order[j]], value)
        return best

    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 200, 0)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = minhash.signatures(np.concatenate(sets), bounds, m)
    assert [row.tolist() for row in got[:4]] == [plain(s) for s in sets[:4]]
    assert (got[4] == minhash.EMPTY).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(30)] + [(None, 3), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    root = {}
    for u, v in edges:
        if u is not None and u != v:
            a, b = root.get(u, {u}), root.get(v, {v})
            for x in a | b:
                root[x] = a | b
    assert got == {x: min(s) for x, s in root.items()}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
