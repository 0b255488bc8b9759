import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import store
from vigil.llm import queries, warc
from vigil.llm.common import shared_path

BIG = "é" * 600 + "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 900


def pages(spark):
    html = [None, "", "short", "short", BIG, BIG, BIG + "2", "a\r\n\r\nb" * 300, "WARC/1.1\r\n" * 200, "WARC/1.1\r\n" * 200, "\x00\r\n" * 400, "y" * 999, "y" * 999, "z" * 1000]
    rows = [(i, f"http://a{i}.example/p?q={i}#f" if i % 3 else None, h) for i, h in enumerate(html)]
    rows += [(3, "http://dup/", BIG), (9, "http://x\r\ny/", "y" * 1500), (9, "http://x\r\ny/", "y" * 1500), (None, "u", "z" * 1000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_and_revisits(spark, tmp_path):
    rows, df = pages(spark)
    found = queries.op9_warc(spark, store(df.repartition(3), tmp_path, "pages")).collect()
    assert len(found) == len(rows)
    data = lambda h: (h or "").encode()
    expected = []
    for i, _, h in rows:
        group = [j if j is not None else -1 for j, _, g in rows if data(g) == data(h)]
        size, top = len(data(h)), max(group)
        # of identical rows with the largest id one is the response
        is_revisit = size >= 1000 and (i if i is not None else -1) != top
        expected.append((i, size, hashlib.sha1(data(h)).hexdigest(), "revisit" if is_revisit else "response", top if is_revisit else None))
    twin = max(k for k, (i, _, h) in enumerate(rows) if i == 9 and h == "y" * 1500)
    expected[twin] = (*expected[twin][:3], "revisit", 9)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(((r[0], r[1], r[2], r[3], r[4]) for r in expected), key=key)


def test_nested_rows_have_payload_and_request(spark):
    path = shared_path(spark, "warc-test")
    _, df = pages(spark)
    warc.write(df.withColumn("record_type", F.lit("clash")), path)
    whole = warc.assemble(warc.read(spark, path)).collect()
    assert len(whole) == df.count() and all(r.request.http_head.startswith("GET /") for r in whole)
    stored = sorted(bytes(r.response.payload) for r in whole if r.response.record_type == "response" and r.response.payload_bytes >= 1000)
    assert stored == sorted({(r.html or "").encode() for r in df.collect() if len((r.html or "").encode()) >= 1000})
    assert all(r.response.payload_sha1 == r.response.payload_digest for r in whole if r.response.record_type == "response")


def test_empty(spark, tmp_path):
    assert queries.op9_warc(spark, store(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")).count() == 0


def test_own_names_in_the_input_and_repeats(spark, monkeypatch):
    rows, df = pages(spark)
    own = ("_stored", "_row", "_payload", "_bytes", "_sha1", "_revisit", "_page", "_url", "_nth", "_copies", "_n", "value", "page", "file", "piece")
    twice = df.unionByName(df)
    expected = None
    for most in (warc.MOST_REPEATS, 0):
        monkeypatch.setattr(warc, "MOST_REPEATS", most)
        for frame in (twice, twice.orderBy(F.rand(3)).repartition(7).select("*", *(F.lit("own").alias(c) for c in own))):
            path = shared_path(spark, "warc-test")
            warc.write(frame, path)
            found = sorted(map(tuple, warc.captures(spark, path).collect()), key=repr)
            expected = expected or found
            assert found == expected and len(found) == 2 * len(rows)
    # each group of equal payloads of 1000 bytes has one response
    big = [r for r in expected if r[1] >= 1000]
    assert all(sum(r[3] == "response" for r in big if r[2] == d) == 1 for d in {r[2] for r in big})
