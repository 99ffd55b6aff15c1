import random
import re
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lopside.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text("abé", max_size=9), st.text("abé", max_size=9), st.integers(0, 4))
def test_within_is_the_edit_distance(a, b, k):
    assert lines.within(a, b, k) == (distance(a, b) <= k)


def brute(rows, k, least):
    word, seen = re.compile(r"[^\x20\x09-\x0D]"), []
    for d, t in rows:
        seen += [(d, p, x) for p, x in enumerate((t or "").split("\n")) if word.search(x)]
    distinct = sorted({x for _, _, x in seen})
    root, links = {x: x for x in distinct}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    named = sorted({x for d, _, x in seen if d is not None})
    for i, a in enumerate(named):
        for b in named[:i]:
            if min(len(a), len(b)) >= max(least, k + 1) and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    first = {}
    for d, _, x in seen:
        if d is not None:
            first[find(x)] = min(first.get(find(x), d), d)
    out = {d: [0, 0, 0, [], []] for d, _ in rows}
    places = {}
    for d, p, x in sorted(seen, key=lambda o: (o[0] is not None, o[0] or 0, o[1])):
        row, c = out[d], find(x)
        earlier = places.setdefault((d, c), p)
        row[0] += 1
        row[2] += links[x]
        row[3].append(first.get(c))
        if d is not None and (first[c] != d or earlier != p):
            row[1] += 1
            row[4].append(p)
    return {d: tuple(v) for d, v in out.items()}


def result(docs, *how):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.n_links, list(r.first_docs), list(r.dropped)) for r in lines.duplicates(docs, *how).collect()}


def varied(seed):
    rng = random.Random(seed)
    base, rows = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(4, 16))) for _ in range(20)], []
    for d in range(60):
        own = []
        for _ in range(rng.randint(0, 5)):
            b = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2))):
                at = rng.randint(0, len(b))
                b[at : at + rng.choice((0, 1))] = rng.choice(("", "a", "é"))
            own.append("".join(b))
        rows.append((d * 3, "\n".join(own) if rng.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("k", [1, 2, 3])
def test_like_all_pairs(spark, k):
    rows = varied(k)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, 5) == brute(rows, k, 5)


def test_odd_rows(odd_docs, odd_rows):
    rows = [(d, t) for d, t, _ in odd_rows if d not in (11, 12, 7)]
    docs = odd_docs.filter("doc_id is null or doc_id not in (11, 12, 7)")
    got, want = result(docs), brute(rows, 1, 20)
    assert {d: v for d, v in got.items() if d is not None} == {d: v for d, v in want.items() if d is not None}
    assert got[None][:3] == want[None][:3]


def test_repeated_rows_are_one_document(odd_docs):
    got = result(odd_docs)
    assert got[7][0] == 2 and got[7][3] == [6, 6]  # a copy of 6, twice
    alone = result(odd_docs.filter("doc_id = 7"))
    assert alone[7][1] == 0


def test_without(odd_docs, no_docs):
    kept = lines.without(odd_docs)
    assert kept.columns == odd_docs.columns
    by = {r.doc_id: r.text for r in kept.filter("doc_id is not null").collect()}
    assert 7 not in by and by[1] is None and by[2] == "" and by[13] == "line one is here and long\n"
    assert kept.filter("doc_id is null").count() == 2
    assert lines.without(no_docs).collect() == [] and lines.duplicates(no_docs).collect() == []


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    seen = Counter(x for _, t in rows for x in set(t.split("\n")))
    got = QUERIES["op1_segment_edit_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    word = re.compile(r"[^\x20\x09-\x0D]")
    assert len(got) == len(rows) and sum(r.n_lines for r in got) == sum(1 for _, t in rows for x in t.split("\n") if word.search(x))
    distinct = sum(1 for x in seen if word.search(x))
    linked = [x for x in seen if word.search(x) and len(x) >= 20]
    short = {}
    for x in linked:  # pairs at one edit share the line without some one character
        for at in range(len(x)):
            short.setdefault(x[:at] + x[at + 1 :], set()).add(x)
    pairs = {(a, b) for s, group in short.items() for a in group for b in group if a < b and distance(a, b) <= 1} | {(min(s, x), max(s, x)) for s, g in short.items() if s in seen and len(s) >= 20 for x in g}
    root = {x: x for x in seen}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    merged = 0
    for a, b in pairs:
        if find(a) != find(b):
            root[find(a)] = find(b)
            merged += 1
    assert sum(r.n_lines - r.n_dropped for r in got) == distinct - merged
