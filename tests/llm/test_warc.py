import base64
import gzip
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from planarium.llm import warc
from planarium.llm.queries import op6_warc


@pytest.mark.parametrize(
    "url,key",
    [
        ("https://blog.Example.com/en/7?a=1&b#top", "com,example,blog)/en/7?a=1&b"),
        ("http://user@example.com:8080", "com,example)/"),
        ("", ")"),
        (None, ")"),
        ("not a url", ")not a url"),
        ("http://[bad/x", ")http%3A//%5Bbad/x"),
    ],
)
def test_keys(url, key):
    assert warc.key_of(url) == key


def made():
    pages = [(k, f"http://h{k % 3}.example.org/p/{k % 17}", f"<p>{k % 11}é</p>" * (k % 5)) for k in range(120)]
    pages += [(500, None, None), (501, "x y\r\nWARC-Type: evil", ""), (None, "http://a.b/", "solo"), (None, "http://a.b/", pages[1][2]), (7, pages[7][1], pages[7][2]), (600, "http://hot.example/", "z" * 200000)]
    return pages + [(700 + k, "http://hot.example/", f"v{k}") for k in range(60)]


def plain(pages):
    largest = {}
    for p, _, h in pages:
        if p is not None:
            largest[h or ""] = max(largest.get(h or "", p), p)
    out = []
    for p, _, h in pages:
        data = (h or "").encode()
        kept = largest.get(h or "")
        own = kept is None or kept == p
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else kept))
    return sorted(map(str, out))


@pytest.mark.parametrize("lines,directory", [(3000, 200_000), (5, 3)])
def test_round_trip(spark, monkeypatch, tmp_path, lines, directory):
    monkeypatch.setattr(warc, "LINES", lines)
    monkeypatch.setattr(warc, "DIRECTORY_ROWS", directory)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    pages = made()
    table = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id long, url string, html string, key string, sha int")
    captures, index = warc.write(table, f"file://{tmp_path}/w")
    found = warc.lookup(index, warc.keys_of(table))
    assert sorted(map(str, found.collect())) == sorted(map(str, captures.collect()))
    rows = warc.records(found, texts=True).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == plain(pages)
    texts = {p: h or "" for p, _, h in pages}
    assert all(r.html == texts[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)
    one = warc.lookup(index, spark.createDataFrame([("org,example,h1)/p/4",), ("no,such)/",)], "key string")).collect()
    assert {r.page_id for r in one} == {k for k in range(120) if k % 3 == 1 and k % 17 == 4}
    archive = sorted((tmp_path / "w/archive").glob("*.warc.gz"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in archive)
    assert whole.count(b"WARC/1.1\r\n") == len(pages)
    if lines == 3000:
        empty = warc.write(table.limit(0), f"file://{tmp_path}/e")
        assert empty[0].count() == empty[1].count() == warc.records(warc.lookup(empty[1], warc.keys_of(table))).count() == 0


def test_query(spark):
    got = op6_warc(spark, "/root/testdata/sf0.001")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == plain(pages)


def test_any_url_comes_back(spark, tmp_path):
    urls = ["http://x.org/a {b}", 'http://x.org/a {"key": "c"}', "http://x.org/?q={ {", *(f"http://x.org/a{c}b?q={c}c" for c in "\x0b\x0c\x1c\x1d\x1e\x85  \n\r\t é"), "http://x.org/a", 'not {"key": a url', "http://[bad / {x"]
    table = spark.createDataFrame([(k, u, f"<p>{k}</p>") for k, u in enumerate(urls)], "page_id long, url string, html string")
    captures, index = warc.write(table, f"file://{tmp_path}/w")
    found = warc.lookup(index, warc.keys_of(table))
    assert sorted(map(str, found.collect())) == sorted(map(str, captures.collect()))
    rows = warc.records(found, texts=True).collect()
    assert sorted((r.page_id, r.html) for r in rows) == [(k, f"<p>{k}</p>") for k in range(len(urls))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(' {}":key/?#[]@%\\\n\r\t\x85\u2028\x0b,)')), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=8))
def test_any_key_comes_back_from_a_block(parts):
    keys = sorted(warc.key_of(f"http://x.org/{p}" if k % 2 else p) for k, p in enumerate(parts))
    rows = [{"key": key, "page_id": k, "digest": "d", "kind": "response", "file": "f", "at": k, "size": 1} for k, key in enumerate(keys)]
    assert [(name, json.loads(line)) for name, line in warc.lines_of(warc.block_of(rows))] == [(r["key"], r) for r in rows]


def test_one_payload_of_most_pages(spark, tmp_path):
    pages = [(k, f"http://h/{k}", "hot" if k % 3 else f"own {k}") for k in range(900)] + [(None, "http://h/x", "hot")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    captures, index = warc.write(table, f"file://{tmp_path}/w")
    rows = warc.records(warc.lookup(index, warc.keys_of(table))).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == plain(pages)
