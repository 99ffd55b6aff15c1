import re

import numpy as np
import pytest

from lopside.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets by halving: the level at which capped shares add up to all words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        if sum(min(cap * sizes[s], level * weight[s]) for s in names) < total:
            low = level
        else:
            high = level
    return {s: min(cap * sizes[s], high * weight[s]) for s in names}


def test_targets():
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 300}, {"x": 7}, {"a": 0, "b": 4}, {f"s{k}": k * k for k in range(40)}):
        got, want = mixing.targets(sizes), shares(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert mixing.targets({}) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_permuted_is_a_permutation(n):
    for key in (1, 99):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def test_shards_agree_from_any_start():
    quota = np.array([1000, 37, 0, 5000])
    whole = list(mixing.shard_counts(quota, 64, 7, 0, 10**6))
    assert (sum(c for _, c, _ in whole) == quota).all() and all(c.sum() == 64 for _, c, _ in whole[:-1])
    before = np.zeros(4, dtype=int)
    for shard, counts, start in whole:
        assert (start == before).all()
        before = before + counts
    alone = next(mixing.shard_counts(quota, 64, 7, 30, 31))
    assert alone[0] == 30 and (alone[1] == whole[30][1]).all() and (alone[2] == whole[30][2]).all()


def test_huge_quotas_are_split_in_proportion(monkeypatch):
    monkeypatch.setattr(mixing, "DRAW_LIMIT", 100)
    quota = np.array([1000, 37, 0, 5000])
    whole = list(mixing.shard_counts(quota, 64, 7, 0, 10**6))
    assert (sum(c for _, c, _ in whole) == quota).all() and all((c >= 0).all() for _, c, _ in whole)


def check(rows, docs, length):
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    want = shares(sizes)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d), size_of(t)) for d, t, _ in docs)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    for s in sizes:
        own = [r for r in rows if r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])]
        assert own, s
    taken = {}
    for r in rows:
        key = r.source_size, round(r.target, 6)
        taken[key] = taken.get(key, 0) + r.taken
    for s in sizes:
        alike = sum(sizes[o] == sizes[s] and abs(want[o] - want[s]) < 1e-6 for o in sizes)
        assert abs(taken[sizes[s], round(want[s], 6)] - alike * want[s]) <= alike * (2 * length + 1)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = mixing.taken(odd_docs, length=16).collect()
    check(rows, odd_rows, 16)
    again = mixing.taken(odd_docs.repartition(3), length=16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.taken(no_docs).collect() == []


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    check(QUERIES["op8_mix_to_weights"](spark, "/root/testdata/sf0.001").collect(), docs, 128)


def test_slots_use_blocks_evenly(odd_docs):
    plan = mixing.Mix(odd_docs, length=16, per_shard=64)
    slots = plan.slots.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots)
    uses = {}
    for r in slots:
        uses.setdefault(r.source_no, {}).setdefault(r.block, []).append(r.shard)
    for blocks in uses.values():
        counts = [len(v) for v in blocks.values()]
        assert max(counts) <= 3 and max(counts) - min(counts) <= 1


def test_mixed_texts_hold_the_words_taken(odd_docs, odd_rows, no_docs):
    docs = odd_docs.filter("doc_id is not null and doc_id != 7").withColumn("n_chars", odd_docs["doc_id"])
    taken = {r.doc_id: r.taken for r in mixing.taken(docs, length=16).collect()}
    out = mixing.mixed(docs, length=16)
    assert out.columns == docs.columns
    words, texts = {}, {d: t for d, t, _ in odd_rows}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size_of(r.text)
        assert r.n_chars == len(r.text) and r.text.split()[0] in texts[r.doc_id]
    assert words == {d: n for d, n in taken.items() if n}
    assert mixing.mixed(no_docs).collect() == []
