import hashlib
import random
import re

from lopside.llm import privacy


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and privacy.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


TRICKY = [
    "a@b.c@d.e", "x@@y.z", "a@b", ".@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256.1", "0001.002.3.000255", "00000000000000000000001.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "4111111111111111222", "41111111111111111111111111111111111111111111", "+1 (555) 123-4567.", "+12345678", "+1+1 555 555 5555", "++49 30 1234567", "é@ü.de ü a@b.de", "1 2 3 4 5 6 7 8 9 0 1 2 3",
]


def test_base_spans_are_the_patterns_matches():
    rng = random.Random(5)
    texts = TRICKY + ["".join(rng.choice("1234.@+- ()aé_%") for _ in range(rng.randrange(60))) for _ in range(4000)]
    for t in texts:
        assert privacy.base_spans(t) == brute(t), t


def check(rows, want):
    assert len(rows) == len(want)
    have = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows)
    told = []
    for d, t in want:
        spans = brute(t)
        count = [sum(k == kind for k, _, _ in spans) for kind in privacy.KINDS[:4]]
        told.append((str(d), *count, hashlib.sha256(privacy.joined(spans).encode()).hexdigest()))
    assert have == sorted(told)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    check(privacy.found(odd_docs).collect(), [(d, t) for d, t, _ in odd_rows])
    assert privacy.found(no_docs).collect() == []


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op3_information_theoretic_pii"](spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in docs])


def told(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = dict(rows)
    out = {}
    for r in privacy.found(docs, **how).collect():
        out[r.doc_id] = [text[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"]
    return out


def test_terms_that_give_a_value_away(spark):
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choice(["the", "of", "river", "house", "walks", "green"]) for _ in range(12))
    rows = [(k, f"{filler()} bob@site.org wrote zanzibarian notes {filler()}") for k in range(8)]
    rows += [(100 + k, f"{filler()} user{k}@other.net wrote plain notes {filler()}") for k in range(40)]
    rows += [(200, f"{filler()} zanzibarian notes again {filler()}"), (201, "")]
    found = told(spark, rows, generalise=0.6)
    assert all(found[k] == ["zanzibarian"] for k in range(8)) and found[200] == ["zanzibarian"]
    assert not any(found[100 + k] for k in range(40)) and found[201] == []


def test_copies_prove_nothing(spark):
    copied = "some words before bob@site.org beside zanzibarian tales and more words after it all"
    rows = [(k, copied) for k in range(20)] + [(50 + k, f"user{k}@other.net writes") for k in range(9)]
    assert not any(told(spark, rows).values())


def test_cleaned():
    text = "mail a@b.de or Quxland please"
    assert privacy.cleaned(text, "email:5:11,term:15:22") == "mail [email] or  please"
    assert privacy.cleaned(text, "email:5:11,term:15:22", {"quxland"}) == "mail [email] or [something] please"


def test_overlapping_spans_go_whole():
    assert privacy.cleaned("call a@1.2.3.4 now", "email:5:12,ip:7:14") == "call [email] now"


def test_every_text_is_sanitised(spark):
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choice(["the", "of", "river", "house", "walks", "green"]) for _ in range(12))
    rows = [(k, f"{filler()} bob@site.org wrote zanzibarian notes {filler()}") for k in range(8)]
    rows += [(100 + k, f"{filler()} user{k}@other.net wrote plain notes {filler()}") for k in range(40)]
    rows += [(200, f"{filler()} zanzibarian notes again {filler()}"), (201, ""), (202, None), (100, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for how, word, column in (({"generalise": 0.6, "remove": 0.6}, "", "n_removed"), ({"generalise": 0.6, "remove": 2.0}, "[something]", "n_generalised")):
        got = privacy.sanitised(docs, **how).collect()
        want = [(d, t if t is None else re.sub(r"[a-z0-9]+@[a-z]+\.[a-z]+", "[email]", t).replace("zanzibarian", word)) for d, t in rows]
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for d, t in want)
        assert all(r[column] == r.n_term for r in got) and sum(r.n_term for r in got) == 11
        same = lambda rs: sorted((str(r.doc_id), r.n_email, r.base_sha256, r.spans, r.n_term) for r in rs)
        assert same(got) == same(privacy.found(docs, **how).collect())


def test_the_query_returns_sanitised_text(spark):
    from lopside.llm.queries import QUERIES

    rows = QUERIES["op3_information_theoretic_pii"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.n_email for r in rows)
    assert not any(kind == "email" for r in rows for kind, _, _ in privacy.base_spans(r.text or ""))
