import hashlib
import random
import re

import numpy as np
import pytest

from lopside.llm import fim


def brute(doc_id, text, seed=1):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, key = len(tokens), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(part) for part in (tokens[:low], tokens[low:high], tokens[high:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), sha(out), sha(text)


def check(rows, docs):
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in rows)
    assert got == sorted((str(d), *brute(d, t)) for d, t in docs)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    check(fim.digests(odd_docs).collect(), [(d, t) for d, t, _ in odd_rows])
    assert fim.digests(no_docs).collect() == [] and fim.transformed(no_docs).collect() == []


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op11_fill_in_middle"](spark, "/root/testdata/sf0.01").collect(), [tuple(r) for r in docs])


def test_marks_and_their_parts(spark):
    """Texts with a mark stay plain; halves of marks next to a cut do not mislead the way back."""
    rng = random.Random(6)
    pieces = ["<", ">", "<P", "S>", "M", "<<", ">>", "P>", "é", "𝒳", " ", "\n", "word", "<S"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(fim.digests(docs).collect(), rows)
    assert any(r.form == "plain" and "<S>" in t for r, (_, t) in zip(fim.transformed(docs).orderBy("doc_id").collect(), rows))


def test_rates_are_parameters(spark):
    docs = spark.createDataFrame([(k, f"some text number {k}") for k in range(300)], "doc_id long, text string")
    forms = lambda **how: {r.form: r.n for r in fim.transformed(docs, **how).groupBy("form").agg({"doc_id": "count"}).toDF("form", "n").collect()}
    assert forms(fim_percent=0) == {"plain": 300}
    assert set(forms(fim_percent=100, spm_percent=0)) == {"psm"} and set(forms(fim_percent=100, spm_percent=100)) == {"spm"}
    base = fim.transformed(docs).exceptAll(fim.transformed(docs)).count(), fim.transformed(docs).exceptAll(fim.transformed(docs, seed=2)).count()
    assert base[0] == 0 and base[1] > 200


@pytest.mark.parametrize("kind, offsets", [
    (fim.ARRAY, np.sort(np.random.default_rng(1).choice(1 << 16, 900, replace=False))),
    (fim.BITMAP, np.sort(np.random.default_rng(2).choice(1 << 16, 30_000, replace=False))),
    (fim.RUN, np.concatenate([np.arange(5, 4000), np.arange(9000, 60_000)])),
])
def test_select_in_every_kind_of_container(kind, offsets):
    one = fim.Container(offsets)
    assert one.kind == kind and [one.select(k) for k in range(0, len(offsets), 7)] == offsets[::7].tolist()
    assert one.select(len(offsets) - 1) == offsets[-1]
    many = np.concatenate([offsets, offsets + (1 << 16) * 3, np.arange(5) + (1 << 16) * 7])
    held = fim.Boundaries(many)
    assert len(held) == len(many) and len(held.containers) == 3 and [c.kind for c in held.containers[:2]] == [kind] * 2
    assert [held.select(k) for k in range(0, len(many), 11)] == many[::11].tolist()


def test_boundaries_of_neighbouring_texts():
    texts = ["ab cd", "", "ef", "中文x", "9", "a" * 70_000 + " " + "!" * 70_000]
    for text, held in zip(texts, fim.boundaries(texts)):
        ends, at = [0], 0
        for token in re.findall(r"[A-Za-z]+|[^A-Za-z]", text):
            at += len(token)
            ends.append(at)
        assert [held.select(k) for k in range(len(held))] == ends
