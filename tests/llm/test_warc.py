import base64
import hashlib
import random

import pytest

from equiflow.llm import warc as W
from equiflow.llm.common import shared_folder

SCHEMA = "page_id long, url string, html string, payload_digest string, file string"


def brute(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = last.get(h or "") if last.get(h or "") != i else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def pages(n=400):
    r = random.Random(3)
    urls = [None, "", "http://a.example.com/x y?q=1#f", "https://B.Example.com:8443/é", "not a url\r\nX: 1", "http://[bad", "http://a.example.com/", "ftp://u:p@h.org/1%20"]
    bodies = [None, "", "<p>same</p>", "WARC/1.1\r\n\r\nfake\r\n\r\n", "\n", "é😀\x00" * 50, "x" * 300_000]
    rows = [(i, r.choice(urls + [f"http://h{r.randrange(30)}.example.net/{i}"] * 9), r.choice(bodies[:6] + [f"<html>{r.random()}</html>" * 5] * 6)) for i in range(n)]
    return rows + [(n + 7, urls[2], bodies[6]), (n + 9, urls[2], bodies[6]), (None, None, None), (None, urls[3], "<p>same</p>"), (-5, "http://neg/", "only"), (3, "http://again/", "<p>again</p>")]


@pytest.mark.parametrize("small", [True, False])
def test_round_trip_through_the_index(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(W, "FILE_BYTES", 2000)
        monkeypatch.setattr(W, "BLOCK_ENTRIES", 7)
        monkeypatch.setattr(W, "DIRECTORY", 10)
    rows = pages()
    spark.createDataFrame([(*x, "d", "f") for x in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, W.op8_warc(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_look_up_reads_only_what_it_asks_for(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ENTRIES", 5)
    rows = [(i, f"http://w{i % 13}.example.org/p{i}", f"<p>{i}</p>") for i in range(300)]
    df = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    folder = shared_folder(spark, "warc-test")
    W.write_archives(df, folder)
    index = W.build_index(W.scan_archives(spark, folder))
    assert index.count() >= 60
    asked = [rows[k] for k in (0, 7, 150, 299)] + [(999, "http://none.example.org/", "")]
    wanted = W.captures(spark.createDataFrame([(*x, None, None) for x in asked], SCHEMA))
    got = W.read_ranges(spark, folder, W.look_up(index, wanted)).collect()
    assert sorted((r.page_id, r.url) for r in got) == [(i, u) for i, u, _ in asked[:4]]


def test_keys_reverse_the_host():
    assert W.url_key("https://User@Blog.Example.com:80/a?b=1#c") == "com,example,blog:80)/a?b=1"
    assert W.url_key(None) == W.url_key("") == ")/" and "\n" not in W.url_key("http://x/\na")


def test_records_parse_and_damage_shows():
    import zlib

    data = zlib.decompress(W.record(5, "http://x/", "é\r\n\r\n".encode(), None), 31)
    assert W.parse(data) == (5, "http://x/", 6, W.payload_digest("é\r\n\r\n".encode()), "response", None)
    assert W.parse(zlib.decompress(W.record(4, None, b"abc", 9), 31))[1:] == (None, 3, W.payload_digest(b"abc"), "revisit", 9)
    with pytest.raises(ValueError, match="damaged"):
        W.parse(data.replace("é".encode(), "è".encode()))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op8_warc(spark, str(tmp_path)).count() == 0


def test_equal_entries_across_blocks_are_all_found(spark, tmp_path):
    rows = [(i, f"http://a.example.org/{i:04}", f"<p>{i}</p>") for i in range(700)]
    rows += [(7, "http://b.example.org/", "<p>same</p>")] * 1500 + [(None, None, "<p>none</p>")] * 1500
    spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, W.op8_warc(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_null_ids_revisit_the_largest_id_in_code_and_sql(spark, tmp_path):
    import duckdb

    rows = [(None, "http://a/", "same"), (4, "http://a/", "same"), (9, None, "same"), (None, "http://b/", "alone"), (None, "http://b/", "alone"), (None, None, None), (2, "http://c/", "")]
    spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, W.op8_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows) and sum(x[3] == "revisit" for x in got) == 3
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(W.OP8_SQL).fetchall(), key=str) == got
