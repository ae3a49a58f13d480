"""Main text of pages and archive conversion."""

import base64
import gzip
import hashlib

import pytest

from pulseframe.llm import archives, html_text
from pulseframe.llm.common import shared_path

SENTENCE = "The quick brown fox is in the house and it was not there when we came to see what was in it, and so on for a while. "


def test_article_is_kept_whole():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></ul></nav>"
            "<!-- ad --><div class=\"ad\">Buy</div><article><h1>Head &amp;amp; line</h1><p><b>One<br>two &lt;3\n  x.<p>No.</p><aside>aside</aside>"
            "<div id='comments'><p>me too</p></div><ul><li>item</li></ul><p>a < b</p><form><input>send</form></article><footer>&copy; all</footer></body>")
    assert html_text.main_text(page) == "Head &amp; line\nOne two <3 x.\nNo.\nitem\na < b"


def test_rules_without_an_article():
    body = f"<div id='top-header'>Site</div><ul class='menu'><li><a href=x>Home</a></ul><div><h2>Title</h2><p>{SENTENCE * 2}<p>Short one.<p>{SENTENCE * 2}</div>"
    page = body + "<div class='comment-list'><p>" + SENTENCE * 2 + "</p></div><p><a href=y>" + SENTENCE + "</a></p><p>Short end.</p><footer>(c)</footer>"
    long = (SENTENCE * 2).strip()
    assert html_text.main_text(page) == f"Title\n{long}\nShort one.\n{long}"


@pytest.mark.parametrize("page", ["", "no markup", "<", "<p", "<p title='x", "<!--", "<script>x", "<article>", "</div></div>", "<p>" * 3000, "<div>" * 3000 + "x", "<a b=\"" * 500])
def test_odd_pages_do_not_fail(page):
    html_text.main_text(page)


def test_extract_messy_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x  y</article>"), (3, "u", "<article><p>" + SENTENCE * 5000), (3, "u", "<article>same"), (3, "u", "<article>same")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, k0 int")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((str(r.page_id), r.text) for r in got.collect()) == sorted([("1", ""), ("2", ""), ("None", "x y"), ("3", (SENTENCE * 5000).strip()), ("3", "same"), ("3", "same")])
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_pages_to_arc_to_warc(spark, version):
    rows = [(1, "http://a.example/x y", "same"), (2, "http://b.example/", "same"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\nx" * 50), (6, "u", "one"),
            (7, "u", "same"), (8, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows] + [(None, "u", "lost", 9, "x")], "page_id long, url string, html string, key int, digest string")
    path = shared_path(spark, "t")
    archives.write_arc(df, f"{path}/arc", version=version)
    archives.convert(spark, f"{path}/arc", f"{path}/warc")
    got = {r.key: r for r in archives.warc_records(spark, f"{path}/warc").collect()}
    assert set(got) == set(range(1, 9))
    last = {}
    for i, _, p in rows:
        last[p or ""] = max(i, last.get(p or "", 0))
    for i, _, p in rows:
        data, r = (p or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        to = last[p or ""]
        assert (r.type, r.refers_to) == (("response", None) if to == i else ("revisit", to))
        assert r.payload == (data if to == i else None)
    assert got[1].date == "2024-01-01T00:00:00Z" and len({r.record_id for r in got.values()}) == 8


def test_smaller_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = shared_path(spark, "t")
    archives.write_arc(df, f"{path}/arc")
    archives.convert(spark, f"{path}/arc", f"{path}/warc", min_bytes=3)
    assert {r.key: r.type for r in archives.warc_records(spark, f"{path}/warc").collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_no_pages_no_records(spark):
    path = shared_path(spark, "t")
    archives.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"{path}/arc")
    archives.convert(spark, f"{path}/arc", f"{path}/warc")
    assert archives.warc_records(spark, f"{path}/warc").count() == 0


def test_arc_lines_of_both_versions_and_members():
    for version in (1, 2):
        start = archives.arc_start(version) + b"\n"
        record = archives.arc_record(version, "http://x.example/a b", b"body\n1 2 3\n", 0) + b"\n"
        whole, parts = start + record * 2, gzip.compress(start) + gzip.compress(record) + gzip.compress(record)
        assert list(archives.read_arc(whole)) == list(archives.read_arc(parts)) == list(archives.read_arc(gzip.compress(whole)))
        fields, block = next(iter(archives.read_arc(whole)))
        assert fields[0] == "http://x.example/a%20b" and block == b"body\n1 2 3\n"
    with pytest.raises(ValueError):
        list(archives.read_arc(archives.arc_start(1) + b"\nhttp://x 0.0.0.0 2024 text/html 99\nshort\n"))
    spaced = archives.arc_start(1) + b"\nhttp://x/a b 0.0.0.0 2024 text/html 2\nok\n"
    assert next(iter(archives.read_arc(spaced)))[0][0] == "http://x/a b"


def test_one_key_with_several_payloads(spark):
    """Each row is one record, and refers to the record of its own payload."""
    path = shared_path(spark, "t")
    rows = [(5, "http://a", "A"), (5, "http://b", "B"), (9, "http://c", "A"), (10, "http://d", "B")]
    archives.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{path}/arc")
    archives.convert(spark, f"{path}/arc", f"{path}/warc")
    got = sorted((r.key, r.url, r.type, r.refers_to) for r in archives.warc_records(spark, f"{path}/warc").collect())
    assert got == [(5, "http://a", "revisit", 9), (5, "http://b", "revisit", 10), (9, "http://c", "response", None), (10, "http://d", "response", None)]
