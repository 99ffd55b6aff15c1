import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lopside.llm import packing

MODEL = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity=2048):
    model, want, by = Tokenizer.from_file(MODEL), [], {}
    for d, t in docs:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want += [(str(d), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    used, bound = check(packing.pack(odd_docs, MODEL).collect(), [(d, t) for d, t, _ in odd_rows])
    assert used <= bound + 1
    assert packing.pack(no_docs, MODEL).collect() == []


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    used, bound = check(QUERIES["op10_best_fit_packing"](spark, "/root/testdata/sf0.001").collect(), docs)
    assert used <= bound + 1


def test_one_length_in_most_rows(spark):
    docs = spark.createDataFrame([(k, "the same text") for k in range(3000)] + [(5000, "word " * 5000)], "doc_id long, text string").repartition(7)
    rows = packing.pack(docs, MODEL, capacity=64).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], 64)


def test_ids_are_kept_on_request(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string")
    rows = packing.pack(docs, MODEL, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)


def test_the_faster_encoder_agrees():
    with open(MODEL, encoding="utf-8") as file:
        encode = packing.encoder(file.read())
    model, rng = Tokenizer.from_file(MODEL), random.Random(8)
    alphabet = "abcXYZ  \n\t'.,!?0123é ñÀßαЖ—“” \xa0\x85\x1c　中𝒳"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["<|endoftext|>", "it's we'll I'M", " " * 300, "\n\n\n x"]
    for t in texts:
        assert encode(t).tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every length."""
    best, lengths = [len(lengths)], sorted(lengths, reverse=True)

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        place(k + 1, bins + [lengths[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_what_the_reduction_fixes_is_part_of_an_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 20, 50))
    lengths = [rng.randrange(max(1, capacity // rng.choice((3, 4, 8))), capacity + 1) for _ in range(rng.randrange(1, 11))]
    counts = Counter(lengths)
    fixed, left = packing.reduced(counts, capacity)
    taken = Counter()
    for group, times in fixed:
        assert sum(group) <= capacity and times > 0
        for x in group:
            taken[x] += times
    assert taken + Counter(left) == counts
    assert sum(t for _, t in fixed) + fewest(list(Counter(left).elements()), capacity) == fewest(lengths, capacity)


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 500) for _ in range(40)}
    runs, bins = packing.plan(counts, 100), Counter()
    seen = {x: 0 for x in counts}
    for k in range(len(runs["length"])):
        x, rank, number, first = (int(runs[n][k]) for n in ("length", "rank", "number", "first"))
        assert rank == seen[x]
        seen[x] += number
        for s in range(first, first + number):
            bins[s] += x
    assert seen == counts and max(bins.values()) <= 100
    assert len(bins) <= 1.25 * sum(x * n for x, n in counts.items()) / 100 + 1
