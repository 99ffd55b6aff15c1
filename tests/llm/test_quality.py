import re
from collections import Counter

from lopside.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), failed


def check(rows, docs):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(d), *brute(t)) for d, t in docs)
    assert not any(r.kept and r.base_failed for r in rows)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    check(quality.rated(odd_docs).collect(), [(d, t) for d, t, _ in odd_rows])
    assert quality.rated(no_docs).collect() == []


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op6_line_first_quality"](spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in docs])


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.rated(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = rows.filter("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_rules_of_a_line():
    rules = quality.Rules()
    verdict = lambda line: quality.failing(line, len(line.split()), rules)
    assert verdict("Home | News | Sport | About us") == "navigation"
    assert verdict("Please accept cookies to go on.") == "boilerplate"
    assert verdict("BUY NOW!! CHEAP!! BEST!!") == "shouting"
    assert verdict("word*** and### more$$$ text%%%") == "punctuation"
    assert verdict("a long line of words that never comes to any end") == "punctuation"
    assert verdict("This is a sentence like any other, with an end.") is None
    assert verdict("A short heading") is None


def test_clean_text(spark):
    prose = " ".join(f"w{k}" for k in range(70)) + "."
    docs = spark.createDataFrame([(1, f"Home | News | Sport | More\n{prose}\n{prose}\nend."), (2, "Home | News | Sport | More\n" * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.rated(docs, with_text=True).collect()}
    assert got[1].clean_text == f"{prose}\nend." and got[1].n_lost_lines == 2 and got[2].clean_text == ""
