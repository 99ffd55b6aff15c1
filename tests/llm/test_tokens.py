import math

import numpy as np
import public_tokenizers

from lopside.llm import text as tx
from lopside.llm import tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def plain(word, known, floor):
    score, count = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
    for stop in range(1, len(word) + 1):
        for size in range(1, min(stop, 128) + 1):
            p = known.get(word[stop - size : stop], floor if size == 1 else None)
            if p is not None and score[stop - size] + p >= score[stop]:
                score[stop], count[stop] = score[stop - size] + p, count[stop - size] + 1
    return count[-1], score[-1]


def compare(rows, docs):
    names, logs = tokens.vocabulary(VOCABULARY)
    known, floor, memo = dict(zip(names, logs.tolist())), float(logs.min()), {}
    want = []
    for d, t in docs:
        words = (t or "").encode().split()
        for w in set(words) - memo.keys():
            memo[w] = plain(b" " + w, known, floor)
        want.append((str(d), len(words), sum(memo[w][0] for w in words), round(sum(memo[w][1] for w in words), 3)))
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens, round(r.log_score, 3)) for r in rows) == sorted(want)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    docs = [(d, t) for d, t, _ in odd_rows if d != 12]
    compare(tokens.counted(odd_docs.filter("doc_id is null or doc_id != 12"), VOCABULARY).collect(), docs)
    assert tokens.counted(no_docs, VOCABULARY).collect() == []


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    compare(QUERIES["op4_trie_token_counts"](spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in docs])


def test_long_pretokens_and_unknown_bytes():
    names, logs = [b"a", b"ab", b"abc", b"ca"], np.log(np.array([0.4, 0.3, 0.2, 0.1]))
    roll = tx.Roll()
    pieces, known = tokens.Pieces(names, logs, roll), dict(zip(names, logs.tolist()))
    words = [b"a", b"abcab", b"zzabca", b"abcabcab" * 40, "é".encode() * 70]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    count, score = tokens.segmented(np.frombuffer(b"".join(words), np.uint8), bounds, roll, pieces)
    want = [plain(w, known, float(logs.min())) for w in words]
    assert count.tolist() == [c for c, _ in want] and np.allclose(score, [s for _, s in want])
