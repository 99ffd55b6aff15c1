import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lopside.llm import lines, minhash, packing, toxicity
from lopside.session import pin

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = pin(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def by_id(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns


def test_toxic_documents_go(spark, steps):
    _, before, after = steps[0]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    gone = {r.doc_id for r in toxicity.scored(before, model).filter("predicted = 1").collect()}
    assert by_id(after) == {d: t for d, t in by_id(before).items() if d not in gone}


def test_later_lines_go(steps):
    _, before, after = steps[1]
    dropped = {r.doc_id: set(r.dropped) for r in lines.duplicates(before).collect()}
    want = {}
    for d, t in by_id(before).items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped[d])
        if not dropped[d] or re.search(r"[^\x20\x09-\x0D]", left):
            want[d] = left
    assert by_id(after) == want
    seen = [x for t in want.values() for x in t.split("\n") if x.strip(" \t\r")]
    assert len(seen) == len(set(seen))
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_of_each_group_stays(steps):
    _, before, after = steps[2]
    kept = {r.doc_id for r in minhash.near_duplicates(before, size=5).filter("kept").collect()}
    assert by_id(after) == {d: t for d, t in by_id(before).items() if d in kept}


def test_sources_come_to_their_targets(steps):
    from lopside.llm import mixing

    _, before, after = steps[3]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    total = lambda df: {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(words)).collect()}
    want, got = mixing.targets(total(before)), total(after)
    assert all(abs(got.get(s, 0) - n) <= 400 for s, n in want.items())


def test_last_stage_and_run(spark, steps):
    _, before, after = steps[4]
    want = packing.pack(before, __import__("public_tokenizers").path("byte_bpe_50k.json"))
    plain = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert plain(after) == plain(want) == plain(corpus_pipeline.run(spark, SF))


def test_odd_rows(spark, odd_docs, tmp_path):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (None, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
