import json

import pytest
from pyspark.sql import functions as F

from folioscope.sources import html, readers, schemas, sinks

LISTING = """<html><h3>Showing new listings for Monday, 3 November 2025</h3><div id="articles">{0}
<h3>New submissions</h3><dl><dt><a href="/abs/2511.00001">x</a></dt><dd><a href="/abs/2510.99999">companion</a></dd><dt><a href="/abs/2511.00002v1">y</a></dt>
<h3>Replacement submissions</h3><dt><a href="/abs/2510.00003">z</a></dt></dl></div>{1}</html>"""


def test_listing():
    got = html.listing(LISTING.format("", "Total of 3 entries"))
    assert got["error"] is None
    assert got["batches"] == [("2025-11-03", "new", ["2511.00001", "2511.00002"]), ("2025-11-03", "replacement", ["2510.00003"])]
    assert "partial" in html.listing(LISTING.format("showing first 2 of 3", ""))["error"]
    assert "total" in html.listing(LISTING.format("", "Total of 4 entries"))["error"]
    empty = html.listing("<h3>Showing new listings for Monday, 3 November 2025</h3>Total of 0 entries")
    assert empty["batches"] == [("2025-11-03", "recent", [])]


ABSTRACT = """<head><meta name="citation_title" content="A title"/><meta name="citation_author" content="B, A"/><meta name="citation_arxiv_id" content="2511.00001"/>
<meta name="citation_abstract" content="Text"/></head><div class="submission-history"><b>[v1]</b> Mon, 3 Nov 2025 18:00:00 UTC <b>{0}</b> Tue, 4 Nov 2025 18:00:00 UTC</div>"""


def test_abstract():
    got = html.abstract(ABSTRACT.format("[v2]"), "2511.00001")
    assert (got["id"], got["version"], got["submitted"], got["updated"], got["error"]) == ("2511.00001", 2, "2025-11-03", "2025-11-04", None)
    assert html.abstract(ABSTRACT.format("[v3]"))["error"] == "version history has gaps"
    assert html.abstract(ABSTRACT.format("[v2]"), "2511.00009")["error"]
    assert html.abstract("")["error"] == "no identity"


def test_search():
    page = '<p>Showing 1-2 of 1,200 results</p><li class="arxiv-result"><a href="/abs/2511.00002">a</a></li><li class="arxiv-result"><a href="/abs/2511.00001v2">b</a></li><a class="pagination-next" href="/s?start=2">n</a>'
    assert html.search(page) == {"ids": ["2511.00002", "2511.00001"], "next": "/s?start=2", "total": 1200, "error": None}
    assert html.search("<p>hello</p>")["error"]


BIB = """<a href="/abs/2599.00001">outside</a><section class="ltx_bibliography"><h2>References</h2><ul><li class="ltx_bibitem"><span class="ltx_tag_bibitem">[2401.00009]</span> arXiv:2401.00001v3</li>
<li class="ltx_bibitem"><a href="https://arxiv.org/abs/hep-ph/9901001">x</a><span class="ltx_bib_cited">Cited by: 2402.00002</span></li></ul></section>"""


def test_bibliography():
    assert html.bibliography(BIB) == {"references": ["2401.00001", "hep-ph/9901001"], "error": None}
    assert html.bibliography("<p>none</p>")["error"]


def test_readers(spark, tmp_path):
    paper = {"id": "p", "arxivId": "2401.00001", "title": "T", "cites": []}
    (tmp_path / "c.json").write_text(json.dumps({"schemaVersion": 2, "papers": [paper], "islands": [{"id": "i", "label": "I"}]}))
    (tmp_path / "d.json").write_text(json.dumps({"schemaVersion": 2}))
    assert [r["id"] for r in readers.papers(spark, str(tmp_path / "c.json")).collect()] == ["p"]
    assert readers.islands(spark, str(tmp_path / "c.json")).count() == 1
    with pytest.raises(Exception, match="no papers array"):
        readers.papers(spark, str(tmp_path / "d.json")).collect()
    assert readers.json_document(spark, str(tmp_path / "none.json"), schemas.CATALOGUE, missing_ok=True).count() == 0
    for name, body in (("a", '["x","y"]'), ("b", '{"ids":["x"]}'), ("t", "x\n\ny\n")):
        (tmp_path / name).write_text(body)
    assert [readers.id_list(spark, str(tmp_path / n)).count() for n in "abt"] == [2, 1, 2]
    log = [{"arxivId": "2401.00001", "version": 1, "metadataSha256": "a" * 64, "status": "ambiguous"}, {"arxivId": "x", "version": 1}]
    (tmp_path / "log.json").write_text(json.dumps({"candidates": log}))
    rows = readers.candidate_log(spark, str(tmp_path / "log.json"))
    assert sorted(str(r["error"]) for r in rows.collect()) == ["None", "id"]
    with pytest.raises(ValueError):
        readers.strict(rows, "log")
    (tmp_path / "f.xml").write_text("<feed><entry><id>a</id><title>t</title></entry><entry><id>b</id></entry></feed>")
    assert readers.atom_feed(spark, str(tmp_path / "f.xml")).count() == 2


def test_sinks(spark, tmp_path):
    assert sinks.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    path = str(tmp_path / "x.json")
    sinks.write_json(path, {"a": 1})
    assert sinks.write_or_check(path, {"a": 1}, check=True) and not sinks.write_or_check(path, {"a": 2}, check=True)
    df = spark.createDataFrame([("http://a/?x=1&y='<'", "2024-01-01"), ("http://b", None)], "u string, d string")
    got = [r["entry"] for r in sinks.sitemap_rows(df, "u", F.col("d")).collect()]
    assert got[0] == "  <url>\n    <loc>http://a/?x=1&amp;y=&apos;&lt;&apos;</loc>\n    <lastmod>2024-01-01</lastmod>\n  </url>"
    assert "lastmod" not in got[1] and sinks.sitemap(got).endswith("</urlset>\n")
    ld = df.select(sinks.json_ld("CollectionPage", name=F.lit("</script>")).alias("j")).first()["j"]
    assert "<" not in ld and json.loads(ld)["name"] == "</script>"
    bib = df.select(sinks.bibtex("k", title=F.lit("T"), doi=F.lit(None).cast("string")).alias("b")).first()["b"]
    assert bib == "@misc{k,\n  title = {T},\n}"
    index = spark.createDataFrame([("a", ["b"], "t"), ("b", [], "u")], "id string, cited_by array<string>, text string")
    assert sinks.catalogue_index(index, path) and sinks.catalogue_index(index, path, check=True)


def test_abstract_days_are_utc():
    page = ABSTRACT.format("[v2]").replace("3 Nov 2025 18:00:00 UTC", "3 Nov 2025 23:30:00 -0500")
    got = html.abstract(page)
    assert (got["submitted"], got["submitted_at"], got["updated"]) == ("2025-11-04", "2025-11-04T04:30:00Z", "2025-11-04")
