import random

import numpy as np
import pytest
from test_near_duplicates import brute

from lopside.llm import jaccard
from lopside.llm import text as tx


def result(docs, **how):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(docs, **how).collect()}


def wanted(rows, size, percent=80):
    return {(d, n, c) for d, (n, c) in brute(rows, size, percent).items()}


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = jaccard.similar(odd_docs).collect()
    assert len(got) == len(odd_rows) and {r.component_id for r in got if r.doc_id is None} == {None}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == wanted(odd_rows, 5)
    assert jaccard.similar(no_docs).collect() == []


def crowd(seed=1):
    """Chains and groups of copies around two texts, on top of a passage that all of them share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(25)]
    base, rows = [[str(rng.randrange(300)) for _ in range(90)] for _ in range(2)], []
    for k in range(150):
        own = list(base[k % 3 - 1]) if k % 3 else [str(rng.randrange(300)) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = str(rng.randrange(300))
        rows.append((k * 7, " ".join(own + passage)))
    return rows + [(5000 + k, rows[4][1].upper()) for k in range(40)] + [(6000 + k, " ".join(passage)) for k in range(3)]


@pytest.mark.parametrize("size, percent", [(2, 80), (5, 60)])
def test_copies_in_chains_and_groups(spark, size, percent):
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs, size=size, percent=percent) == wanted(rows, size, percent)


def test_small_blocks_groups_and_no_broadcast(spark, monkeypatch):
    """The same links with every bound at its least: hot keys, split blocks, joins in place of broadcasts."""
    for name, value in (("BLOCK", 3), ("GROUP", 2), ("BLOCK_SHINGLES", 200), ("PAIRS", 5), ("SMALLER", 1), ("WANTED", 0), ("COLD", 0)):
        monkeypatch.setattr(jaccard, name, value)
    rows = crowd(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs, size=2) == wanted(rows, 2)


def test_a_shingle_of_some_documents_is_counted_and_not_taken_to_blocks(spark, monkeypatch):
    """Texts of three runs of words, each held by about twelve: none goes to the blocks, and their links stay."""
    rng, seen, crossing = random.Random(5), [], jaccard.crossing
    runs = [[f"r{g}_{k}" for k in range(20)] for g in range(15)]
    rows = [(k, " ".join(sum(rng.sample(runs, 3), []))) for k in range(60)]
    rows += [(100 + k, text + " one") for k, text in rows[:5]]

    def watched(members, *rest):
        seen.append(members.count())
        return crossing(members, *rest)

    monkeypatch.setattr(jaccard, "crossing", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs) == wanted(rows, 5) and seen == [0]


def test_pairs_of_a_key_are_counted_whole(spark):
    """Pairs that share three keys, against brute force, with batches that end within a key."""
    rng = random.Random(6)
    docs = {d: (rng.randrange(20, 30), rng.randrange(30)) for d in range(40)}
    rows = [(key, d, *docs[d]) for key in range(60) for d in rng.sample(sorted(docs), rng.randrange(1, 13))]
    keys = {d: {r[0] for r in rows if r[1] == d} for d in docs}
    fits = lambda a, b: docs[a][1] != docs[b][1] and 100 * min(docs[a][0], docs[b][0]) >= 80 * max(docs[a][0], docs[b][0])
    want = {(a, b) for a in docs for b in docs if a < b and fits(a, b) and len(keys[a] & keys[b]) >= 3}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = jaccard.counted(spark.createDataFrame(rows, "key long, doc long, n_shingles long, label long"), 80).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op12_ngram_jaccard_join"](spark, "/root/testdata/sf0.001").select("doc_id", "n_shingles", "component_id").collect()}
    assert got == wanted(rows, 5)


def test_similar_sets_meet_in_every_order():
    """The filters lose no pair: sets at or above the similarity share a prefix shingle under each order."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 50, jaccard.SLOTS)
    met = 0
    for _ in range(600):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        for _ in range(int(rng.integers(0, max(1, len(a) // 6)))):
            b[rng.integers(len(b))] = rng.integers(0, 2**63)
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            met += 1
            for x, y in zip(jaccard.prefixes(a, counts, 80), jaccard.prefixes(b, counts, 80)):
                assert len(np.intersect1d(x, y))
    assert met > 200


def test_frequencies_count_every_text(spark, odd_docs):
    counts = jaccard.frequencies(odd_docs, 5)
    total = np.zeros(jaccard.SLOTS, dtype=np.int64)
    for text, in odd_docs.select("text").collect():
        data = np.frombuffer((text or "").encode(), np.uint8)
        sets, _ = jaccard.shingle_sets(data, np.array([0, len(data)]), tx.Roll(), 5)
        total += np.bincount(jaccard._slots(sets), minlength=jaccard.SLOTS)
    assert (counts == total).all()


def test_forest_joins_what_all_links_join():
    linked = np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        linked[a, b] = linked[b, a] = True
    links = jaccard._forest(linked)
    assert len(links) == 3 and {frozenset(p) for p in links} <= {frozenset(p) for p in ((0, 1), (1, 2), (0, 2), (4, 5))}
