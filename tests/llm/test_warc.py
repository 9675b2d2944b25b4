import hashlib
import random

import pytest

from digitscope.llm import queries, warc
from suite.compare import connect, differences


def test_loser_tree():
    pick = random.Random(1)
    assert list(warc.LoserTree([])) == [] and list(warc.LoserTree([[], []])) == []
    for k in range(1, 20):
        runs = [sorted((pick.randrange(30), i) for _ in range(pick.randrange(8))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    keys = {
        "http://www.Example.com/a?b=1#top": "com,example)/a?b=1", "https://example.com:443": "com,example)/",
        "//user@blog.example.org:8080/x": "org,example,blog)/x".replace("blog)", "blog:8080)").replace("org,example,blog:8080)", "org:8080,example,blog)"),
        "": ")/", "ftp://h/é": "h)/é",
    }
    for url, key in keys.items():
        assert warc.url_key(url) == key
    assert warc.url_key(None) == ")/"


def rows():
    pick = random.Random(4)
    same, other = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 120, "x" * 1000
    out = [(i, f"http://h{pick.randrange(5)}.org/{pick.randrange(9)}", pick.choice([same, other, "y" * 999, None, "", f"own {i} " * 300])) for i in range(120)]
    return out + [(None, None, same), (500, "http://a.b/\r\nX: y", same), (500, "http://a.b/", same), (3, "u", "z" * 200000)]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    data = rows()
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as same", "'p' as payload", "2 as refers_to").repartition(5)
    warc.write(pages, f"{tmp_path}/w")
    got = warc.history(spark, f"{tmp_path}/w").collect()
    order = [(r.url_key, r.timestamp, r.file, r.offset) for r in got]
    assert order == sorted(order) and len(got) == len(data)
    want = []
    for page, url, html in data:
        body = (html or "").encode()
        last = max((p for p, _, h in data if p is not None and (h or "") == (html or "")), default=None)
        again = len(body) >= 1000 and page is not None and page < last
        want.append((page, (url or "").replace("\r", "%0D").replace("\n", "%0A"), len(body), hashlib.sha1(body).hexdigest(),
                     "revisit" if again else "response", last if again else None))
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    for r in got[:20]:
        with open(r.file.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            (one,) = warc.parse(file.read(r.length), r.file)
            assert one[2] == r.page_id
    assert "revisit" in {w[4] for w in want}
    warc.write(pages.limit(0), f"{tmp_path}/none")
    assert warc.history(spark, f"{tmp_path}/none").count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 100)
    data = [(i, "http://a.b/", "x" * (i * 7)) for i in range(100)] + [(200 + i, "http://c.d/", "y" * (300 * i)) for i in range(1, 30)] + [(300, "u" * 30_000, None)]
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    got = warc.history(spark, f"{tmp_path}/w").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((p, len(h or "")) for p, _, h in data)
    sizes = {}
    for r in got:
        sizes.setdefault(r.file, []).append(r.payload_bytes + len(r.url))
    assert all(sum(s) <= 20_000 or len(s) == 1 for s in sizes.values()) and any(len(s) > 1 for s in sizes.values())
    assert max(len(s) for s in sizes.values()) <= 100


def test_any_page_id(spark, tmp_path):
    ids = [2 ** 60, -(2 ** 60), 2 ** 63 - 1, -1, 0, 9 * 10 ** 12, 26 * 10 ** 10]
    warc.write(spark.createDataFrame([(i, "http://a.b/", "x") for i in ids], "page_id long, url string, html string"), f"{tmp_path}/w")
    got = warc.history(spark, f"{tmp_path}/w").collect()
    assert sorted(r.page_id for r in got) == sorted(ids) and all(len(r.timestamp) == 20 for r in got)
    assert [r.timestamp for r in got] == sorted(r.timestamp for r in got)


def test_query_on_repeated_payloads(spark, tmp_path):
    data = [(i, f"http://h{i % 3}.org/", ("large " * 400) + str(i % 4)) for i in range(60)] + [(100 + i, "http://h.org/", "small") for i in range(5)]
    data += [(200 + i, "http://h.org/", "é" * size) for i, size in enumerate((499, 500, 500, 499))]
    spark.createDataFrame(data, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op7_warc_index(spark, str(tmp_path)).collect()}
    last = {h: max(p for p, _, x in data if x == h) for _, _, h in data}
    for page, _, html in data:
        again = len(html.encode()) >= 1000 and page < last[html]
        assert (got[page].record_type, got[page].refers_to) == (("revisit", last[html]) if again else ("response", None))
        assert got[page].payload_digest == hashlib.sha1(html.encode()).hexdigest() and got[page].payload_bytes == len(html.encode())
    assert sum(r.record_type == "revisit" for r in got.values()) == 57


def test_damage_is_noticed():
    record = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\n"
              b"WARC-Payload-Digest: sha1:0\r\nContent-Length: 41\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(record, "f"))


def test_query_against_sql(spark, data):
    assert differences(queries.op7_warc_index(spark, data), connect(data), queries.ORACLE["op7_warc_index"]) == []
