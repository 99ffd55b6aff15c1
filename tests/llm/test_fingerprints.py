import hashlib
import random

import numpy as np

from lopside.llm import simhash
from lopside.llm import text as tx


def check(rows, docs):
    """``docs`` in order; every column from the definition, the search against all pairs."""
    n = len(docs)
    marks = simhash.fingerprints([t or "" for _, t in docs], tx.Roll())
    by = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in by] == [d for d, _ in docs]
    for k, r in enumerate(by):
        own, following = docs[k][1] or "", docs[(k + 1) % n][1] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        new = simhash.fingerprints([changed], tx.Roll())
        assert r.fingerprint == f"{marks[k][1]:016x}{marks[k][0]:016x}" and r.edited_fingerprint == f"{new[0][1]:016x}{new[0][0]:016x}"
        assert r.near_edited == float(simhash.likeness(marks[k : k + 1], new)[0])
        assert r.near_next == float(simhash.likeness(marks[k : k + 1], marks[[(k + 1) % n]])[0])
        close = int((np.bitwise_count(marks ^ marks[k]).sum(axis=1) <= 3).sum()) - 1
        assert r.n_within == (close if r.doc_id is not None and r.doc_id % 20 == 0 else None)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    docs = odd_docs.filter("doc_id is not null and doc_id != 7")  # ties have an order of their own, below
    check(simhash.fingerprinted(docs).collect(), sorted((d, t) for d, t, _ in odd_rows if d is not None and d != 7))
    assert simhash.fingerprinted(no_docs).collect() == []


def test_ties_nulls_and_single_rows(spark, odd_docs, odd_rows):
    rows = simhash.fingerprinted(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    assert sorted(r.n_chars for r in rows) == sorted(len(t or "") for _, t, _ in odd_rows)
    one = simhash.fingerprinted(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0


def test_many_ranges(spark):
    rng = random.Random(9)
    docs = sorted((rng.randrange(10**9), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for _ in range(300))
    docs = list(dict(docs).items())
    check(simhash.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect(), docs)


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    docs = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    check(QUERIES["op9_simhash_fingerprints"](spark, "/root/testdata/sf0.001").collect(), docs)


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(10)
    base = [rng.getrandbits(128) for _ in range(20)]
    marks = []
    for _ in range(600):
        value = rng.choice(base)
        for _ in range(rng.randrange(6)):
            value ^= 1 << rng.randrange(128)
        marks.append(value)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(v >> 64), signed(v & (1 << 64) - 1)) for v in marks]
    table = spark.createDataFrame(rows, "high long, low long")
    for radius, blocks in ((3, 4), (2, 4), (1, 2)):
        got = {(r.high, r.low): r.n_within for r in simhash.within(table, table.limit(50), radius, blocks).collect()}
        asked = {tuple(r) for r in table.limit(50).collect()}
        want = {}
        for pair, value in zip(rows, marks):
            if pair in asked:
                want[pair] = sum(bin(value ^ v).count("1") <= radius for v in marks)
        assert got == want


def test_weights_and_shared_halves():
    rng = random.Random(11)
    texts = [" ".join(f"word{rng.randrange(5000)}" for _ in range(300)) for _ in range(60)]
    a, b = simhash.fingerprints(texts[:-1], tx.Roll()), simhash.fingerprints([simhash.edited(x, y) for x, y in zip(texts, texts[1:])], tx.Roll())
    following = simhash.fingerprints(texts[1:], tx.Roll())
    assert simhash.likeness(a, b).mean() > simhash.likeness(a, following).mean() + 0.1
    assert (simhash.fingerprints(["same words here"] * 2, tx.Roll())[0] == simhash.fingerprints(["same words here", "x"], tx.Roll())[0]).all()


def classes_of(docs, every, wide):
    """n_near and class_id of each (doc_id, text) from all pairs."""
    marks = simhash.fingerprints([t for _, t in docs], tx.Roll())
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    near = {}
    for k, (d, _) in enumerate(docs):
        apart = np.bitwise_count(marks ^ marks[k]).sum(axis=1)
        if d % every == 0:
            near[d] = int((apart <= wide).sum()) - 1
        for j in np.flatnonzero(apart <= (wide if d % every == 0 else 0)):
            root[find(int(j))] = find(k)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), d), d)
    return {d: (near.get(d), least[find(k)]) for k, (d, _) in enumerate(docs)}


def test_near_copies_are_found_and_named(spark):
    rng = random.Random(12)
    docs = []
    for k in range(0, 900, 3):
        own = [f"w{rng.randrange(900)}" for _ in range(150)]
        docs.append((k, " ".join(own)))
        for n in (1, 2):
            for _ in range(n):  # a changed word each, so 0.9 and more of the five-word shingles stay
                own[rng.randrange(150)] = f"x{rng.randrange(900)}"
            docs.append((k + n, " ".join(own)))
    docs += [(5000 + k, "") for k in range(40)]
    rows = simhash.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    got = {r.doc_id: (r.n_near, r.class_id) for r in rows}
    assert got == classes_of(docs, 20, simhash.WIDE)
    assert all(got[d] == (2, d - d % 3) for d in range(0, 900, 20))


def test_wide_search_is_exact(spark):
    rng = random.Random(13)
    base, marks = [rng.getrandbits(128) for _ in range(10)], set()
    for _ in range(500):
        value = rng.choice(base)
        for _ in range(rng.randrange(30)):
            value ^= 1 << rng.randrange(128)
        marks.add(value)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    marks = sorted(marks)
    row = lambda v: (signed(v >> 64), signed(v & (1 << 64) - 1))
    table = spark.createDataFrame([(*row(v), 1 + k % 2, k % 3 == 0) for k, v in enumerate(marks)], "high long, low long, n long, asks boolean").repartition(3)
    for radius in (1, 4, 23):
        got = {}
        for r in simhash.linked(table, radius).collect():
            got[r.a_high, r.a_low] = got.get((r.a_high, r.a_low), 0) + r.n
        near = lambda a, b: bin(a ^ b).count("1") <= radius  # noqa: B023, E731
        assert got == {row(a): sum(1 + j % 2 for j, b in enumerate(marks) if near(a, b)) for k, a in enumerate(marks) if k % 3 == 0}
