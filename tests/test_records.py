"""Abstract pages and Atom feeds as columns, and their faults."""

import pytest
from pyspark.sql import functions as F

from folioscope.sources import abstracts, feeds

PAGE = """<html><head><META NAME="citation_arxiv_id" CONTENT="2601.00007"><meta name='citation_title' content='A "b" &amp; c'/>
<meta name="citation_author" content="X, Y"/><meta name="citation_abstract" content=" Some
 text "/><meta name="citation_keywords" content="b; a;b"/></head><body><div class="submission-history">
<b>[v1]</b> Mon, 5 Jan 2026 23:30:00 -0500 (1 KB)<br/>{0}</div></body></html>"""


def read(spark, *pages, expected=None):
    df = spark.createDataFrame([(i, p, expected, "own") for i, p in enumerate(pages)], "k long, html string, asked string, error string")
    return [r.asDict() for r in abstracts.abstract_pages(df, expected="asked" if expected else None).orderBy("k").collect()]


def test_days_are_those_of_utc(spark):
    got = read(spark, PAGE.format(""))[0]
    assert (str(got["submitted"]), [tuple(h) for h in got["history"]], got["error"]) == ("2026-01-06", [(1, "2026-01-06T04:30:00Z")], None)
    assert (got["id"], got["version"], got["title"], got["authors"], got["abstract"], got["subjects"], got["primary_category"]) == (
        "2601.00007", 1, 'A "b" & c', ["X, Y"], "Some text", ["a", "b"], None,
    )


def test_faults_of_abstract_pages(spark):
    second = "[v2] Tue, 6 Jan 2026 01:00:00 GMT"
    pages = [
        PAGE.format(second), PAGE.format("[v3] 6 Jan 2026 01:00:00 UTC"), PAGE.format(second).replace("2601.00007", "x"), PAGE.format("").replace("citation_author", "author"),
        PAGE.format("").replace("[v1]", "[1]"), "", None, PAGE.format("").replace("5 Jan", "35 Jan"),
    ]
    got = read(spark, *pages)
    assert [r["error"] for r in got] == [None, "history has gaps", "no identity", "lacks authors", "history has gaps", "no identity", "no identity", "history without a time"]
    assert got[0]["version"] == 2 and str(got[0]["updated"]) == "2026-01-06" and all(r["title"] is None for r in got[1:])
    assert [r["error"] for r in read(spark, PAGE.format(""), expected="arXiv:2601.00007v4")] == [None]
    assert [r["error"] for r in read(spark, PAGE.format(""), expected="2601.00008")] == ["another paper: 2601.00007"]


def test_elements_stand_in_for_metadata(spark):
    page = """<link rel="canonical" href='https://arxiv.org/abs/hep-ph/9901001v3'/><h1 class="title mathjax"><span>Title:</span>On <i>x</i></h1>
    <div class="authors"><span>Authors:</span><a>A B</a>, <a>C</a></div><blockquote class="abstract"><span>Abstract:</span> It is. </blockquote> [v1] 1 Feb 1999 00:00:00 GMT"""
    got = read(spark, page)[0]
    assert (got["id"], got["title"], got["authors"], got["abstract"], got["error"]) == ("hep-ph/9901001", "On x", ["A B", "C"], "It is.", None)


ATOM = '<?xml version="1.0"?><!-- c --><a:feed xmlns:a="http://www.w3.org/2005/Atom">{0}</a:feed>'
ENTRY = '<a:entry><a:id>http://arxiv.org/abs/2601.0000{0}v1</a:id><a:title>T {0}</a:title><a:author><a:name>N</a:name></a:author><a:category term="c"/><a:category term=""/></a:entry>'


def test_feeds(spark, tmp_path):
    docs = [ATOM.format(ENTRY.format(1) + ENTRY.format(2)), ATOM.format(""), "<rss/>", "no xml <", None, ATOM.format("<a:entry><a:title>x</a:title></a:entry>")]
    df = spark.createDataFrame([*enumerate(docs)], "k long, xml string")
    got = feeds.entries(df).orderBy("k", "place").collect()
    assert [(r["k"], r["id"], r["error"]) for r in got] == [
        (0, "2601.00001", None), (0, "2601.00002", None), (1, None, "empty feed"), (2, None, "no feed"), (3, None, "no feed"), (4, None, "no feed"), (5, None, "no identifier"),
    ]
    assert (got[0]["title"], got[0]["authors"], got[0]["categories"], got[0]["pdf"]) == ("T 1", ["N"], ["c"], None)
    assert feeds.entries(df.where("k < 0")).count() == 0
    (tmp_path / "a.xml").write_text(docs[0])
    assert feeds.feed_files(spark, str(tmp_path)).where(F.col("file") == "a.xml").count() == 2
    (tmp_path / "b.xml").write_text(docs[1])
    with pytest.raises(ValueError, match="b.xml: empty feed"):
        feeds.feed_files(spark, str(tmp_path))


def test_attributes_are_read_by_one_pattern(spark):
    tags = [(' name="a" content=\'x "y"\'', 'x "y"'), (" content=\"it's\"", "it's"), (' content="" name="b"', ""), (' content="open name=\'c\'', ""), (" data-content='n' CONTENT = 'p\nq'", "p\nq")]
    one = abstracts.attribute(F.col("t"), "content")
    assert str(one).count("regexp_extract") == 1
    got = spark.createDataFrame([(t,) for t, _ in tags], "t string").select(one)
    assert [r[0] for r in got.collect()] == [want for _, want in tags]
