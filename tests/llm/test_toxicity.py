import random
import zlib

from lopside.llm import toxicity


def sample(seed, n):
    rng = random.Random(seed)
    part = ["the", "on", "ing", "er", "and", "tion", "wh", "re", "st", "ly", "sh", "ea", "ou", "ed", "in", "nt"]
    bad = ["numskull", "dunderhead", "blockhead", "nitwit", "buffoon", "simpleton"]
    out = []
    for k in range(n):
        words = ["".join(rng.choice(part) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 200))]
        toxic = k % 5 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    rows = sample(1, 1500)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    held = [(got[d], y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(r.predicted == y for r, y in held) >= 0.97 * len(held)


def test_labels_of_the_test_fold_change_nothing(spark):
    rows = sample(2, 300)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    turned = [(d, y if zlib.crc32(str(d).encode()) % 5 else 1 - y) for d, _, y in rows]
    a = toxicity.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    b = toxicity.train(docs, spark.createDataFrame(turned, "doc_id long, toxic int"))
    assert a == b


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = sample(3, 300)
    model = toxicity.fit([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    got = toxicity.scored(odd_docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _, _ in odd_rows)
    assert all(r.score < 0.5 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    kept = toxicity.drop_toxic(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)
    assert toxicity.scored(no_docs, model).collect() == []


def test_no_labels(spark, odd_docs):
    labels = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    assert all(r.predicted == 0 for r in toxicity.scored(odd_docs, model).collect())


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    got = QUERIES["op7_compression_toxicity"](spark, "/root/testdata/sf0.001").collect()
    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_held_out_documents_of_the_given_table(spark):
    from lopside.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"  # 825 of them; a tenth of that tells little
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in QUERIES["op7_compression_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    ordinary = [p for p, y in held if not y]
    assert sum(ordinary) <= 0.02 * len(ordinary)
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_evidence_allows_for_every_kind_of_ordinary_text():
    """A count that one kind of ordinary text makes likely is no evidence; beyond it, it is."""
    model = toxicity.Model(b"", b"", ((1e-6,) * 6, (1e-2,) * 6))
    assert model.evidence(300, [0] * 6) == 0
    assert model.evidence(300, [2, 0, 0, 0, 0, 0]) < 0.5
    assert model.evidence(300, [30, 0, 0, 0, 0, 0]) > 8
    alone = toxicity.Model(b"", b"", ((1e-6,) * 6,))
    assert alone.evidence(300, [1, 0, 0, 0, 0, 0]) > 3


def test_long_words_are_taken_piece_by_piece():
    word = "x" * 1000 + "Numskull"
    assert b"".join(toxicity.words_of(word)) == word.lower().encode() and max(map(len, toxicity.words_of(word))) <= toxicity.PIECE
    rows = sample(5, 400)
    score = toxicity.fit([t for _, t, y in rows if y], [t for _, t, y in rows if not y]).scorer()
    filler = "".join(w for _, t, y in rows[:40] if not y for w in t.split())
    assert score(filler)[1] < 0.5
