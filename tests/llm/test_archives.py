import base64
import hashlib
import random

import pyarrow.fs as pafs

from lopside.llm import warc


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, last string, file string").repartition(3)


def pages():
    rng = random.Random(2)
    rows = [(k, f"http://host/{k}", f"<p>{rng.randrange(40)} é中 \r\n\r\n</p>" * rng.randrange(1, 50), "x", None, "f") for k in range(200)]
    rows += [(300 + k, "http://same/", "<html>the same page</html>", None, "y", None) for k in range(60)]
    return rows + [(400, None, None, None, None, None), (401, "http://e/\r\nX: 1", "", None, None, None), (402, "http://long/", "long " * 200_000, None, None, None), (None, "http://none/", "no id", None, None, None)]


def want(rows, least=0):
    last = {}
    for p, _, h, *_ in rows:
        if p is not None and len((h or "").encode()) >= least:
            last[h or ""] = max(last.get(h or "", p), p)
    out = []
    for p, u, h, *_ in rows:
        raw = (h or "").encode()
        refers = last.get(h or "")
        refers = refers if None not in (p, refers) and p < refers else None
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return out


def keyed(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_round_trip(spark):
    for least in (0, 40):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(table(spark, pages()), least).collect()]
        assert keyed(got) == keyed(want(pages(), least))


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", "same", None, None, None)] * 3
    got = warc.round_trip(table(spark, rows)).collect()
    assert [(r.record_type, r.refers_to) for r in got] == [("response", None)] * 3
    assert warc.round_trip(table(spark, [])).collect() == []


def test_selected_records_and_payloads(spark):
    rows = pages()
    docs = table(spark, rows)
    folder = warc.folder_for(docs)
    index = warc.write(docs, folder, file_bytes=4096)
    assert index.select("file").distinct().count() > 5
    some = warc.read(index.filter("page_id % 7 = 0"), folder, gap=0, with_html=True).collect()
    by = {r[0]: r for r in rows}
    assert {r.page_id for r in some} == {p for p in by if p is not None and p % 7 == 0}
    for r in some:
        assert r.html == ((by[r.page_id][2] or "") if r.record_type == "response" else None)
    assert {r.url for r in warc.read(index.filter("page_id in (400, 401)"), folder).collect()} == {None, "http://e/%0D%0AX: 1"}


def test_files_are_plain_gzip_members(spark):
    import gzip

    docs = table(spark, [(1, "http://a/", "<p>one</p>", None, None, None), (2, "http://b/", "<p>two</p>", None, None, None)]).coalesce(1)
    folder = warc.folder_for(docs)
    index = warc.write(docs, folder).collect()
    store, root = pafs.FileSystem.from_uri(folder)
    whole = b"".join(gzip.decompress(store.open_input_file(f"{root}/{f}").readall()) for f in sorted({r.file for r in index}))
    assert whole.count(b"WARC/1.1\r\n") == 2 and b"<p>two</p>" in whole
