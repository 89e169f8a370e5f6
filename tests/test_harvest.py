import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import camera, text
from folioscope.operators import harvest, search, validate
from folioscope.sources import html, readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


GOOD = {
    "listings": [{"name": "b", "url": "https://arxiv.org/list/x/new"}, {"name": "a", "url": "https://export.arxiv.org/list/y/new"}],
    "searches": [{"name": "s", "url": "https://arxiv.org/search", "frontier": ["arXiv:2401.00001v3"], "maxPages": 2}],
    "explicitIds": ["2402.00002v1", "2401.00001", "HEP-PH/9901001"], "knownVersions": {"2401.00001v9": 2}, "coverageThrough": "2024-05-06",
    "authorSearchOverrides": [{"author": " A  Person ", "query": "person_a", "physicsArchive": "astro-ph", "identityEvidence": {"orcid": "0"}}],
}


def test_config():
    got = harvest.config(GOOD).checked()
    assert [x[0] for x in got.listings] == ["a", "b"] and got.searches[0]["frontier"] == ["2401.00001"]
    assert got.explicit_ids == ["2401.00001", "2402.00002", "hep-ph/9901001"] and got.known_versions == {"2401.00001": 2}
    assert got.coverage_through == date(2024, 5, 6) and [*got.overrides] == ["a person"]
    assert (got.review_limit, got.author_limit, got.overlap_days) == (500, 8, 2)


@pytest.mark.parametrize("change, said", [
    ({"schemaVersion": 2}, "schemaVersion"), ({"listings": [{"name": "x", "url": "http://arxiv.org/"}]}, "https"),
    ({"listings": [{"name": "x", "url": "https://elsewhere.example/"}]}, "known host"), ({"searches": [{"url": "https://arxiv.org/", "maxPages": 0}]}, "maxPages"),
    ({"explicitIds": ["nothing"]}, "identifier"), ({"knownVersions": {"2401.00001": 0}}, "positive"), ({"reviewLimit": 0}, "reviewLimit"),
    ({"overlapDays": -1}, "overlapDays"), ({"coverageThrough": "2024-02-30"}, "date"), ({"authorSearchOverrides": GOOD["authorSearchOverrides"] * 2}, "two overrides"),
    ({"authorSearchOverrides": [{"author": "x", "query": "y", "physicsArchive": "Astro", "identityEvidence": {}}]}, "evidence"),
])
def test_config_errors(change, said):
    with pytest.raises(ValueError, match=said):
        harvest.config(GOOD | change).checked()


def test_cache(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    now, old = datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 1)
    base = "https://arxiv.org/"
    table = [
        (base + "1", now, None, None, "text/html; charset=utf-8", "x", sha), (base + "2", old, "e", None, None, "x", sha), (base + "3", old, None, None, "text/html", "x", sha),
        (base + "4", now, "e", None, "text/html", "y", sha), ("https://elsewhere.example/5", now, None, None, "text/html", "x", sha),
        (base + "6", now, None, None, "application/pdf", "x", sha), (base + "7", now, None, None, "text/html", "x" * 50, sha), (base + "8", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(table, "url string, fetched_at timestamp, etag string, last_modified string, mime string, body string, sha string")
    got = harvest.cache_action(df, F.lit(now), most_bytes=20)
    assert [a for _, a in rows(got.withColumn("k", F.substring("url", -1, 1)), "k", "action")] == ["use", "revalidate", "fetch", "fetch", "reject", "reject", "reject", "fetch"]
    tries = spark.createDataFrame([(0, 500, None), (3, None, None), (9, 503, None), (0, 429, 7.0), (0, 404, None)], "a int, s int, r double")
    assert [r[0] for r in tries.select(harvest.retry_delay(F.col("a"), F.col("s"), F.col("r"))).collect()] == [1.0, 8.0, 60.0, 7.0, None]


def test_pages_to_frontier(spark):
    pages = spark.createDataFrame(
        [("s", p, i, f"{p}{i}") for p in (1, 2, 3) for i in (0, 1)] + [("t", 1, 0, "a"), ("u", 1, 0, "b"), ("u", 2, 0, "c")], "source string, page int, pos int, id string"
    )
    marks = spark.createDataFrame([("s", "21"), ("s", "30"), ("t", "zz"), ("u", "c")], "source string, id string")
    assert rows(harvest.pages_to_frontier(pages, marks, 4), "source", "n_pages", "met", "error") == [("s", 2, True, None), ("t", 1, False, None), ("u", 2, True, None)]
    errors = {r["source"]: r["error"] for r in harvest.pages_to_frontier(pages, marks, 1).collect()}
    assert errors == {"s": "too many pages", "t": "no frontier id", "u": "too many pages"}
    assert rows(harvest.new_on_pages(pages, marks), "source", "id") == [("s", "10"), ("s", "11"), ("s", "20"), ("t", "a"), ("u", "b")]


def test_catch_up(spark):
    d = date
    table = [("a", False, d(2024, 3, 1), d(2024, 5, 10), None), ("b", None, d(2024, 3, 1), None, d(2024, 2, 1)), ("c", True, d(2024, 1, 1), None, None), ("d", False, None, None, None), ("e", False, d(2024, 3, 1), d(2024, 9, 9), None)]
    df = spark.createDataFrame(table, "author string, has_frontier boolean, first_seen date, covered_through date, catalogue_scan date")
    got = harvest.catch_up_windows(df, F.lit(d(2024, 5, 9)), F.lit(d(2024, 6, 1)))
    assert rows(got.where("error is null"), "author", "low", "high", "cursor") == [
        ("a", d(2024, 5, 8), d(2024, 6, 1), d(2024, 6, 1)), ("b", d(2024, 2, 1), d(2024, 6, 1), d(2024, 6, 1)), ("e", d(2024, 5, 9), d(2024, 6, 1), d(2024, 9, 9)),
    ]
    assert rows(got.where("error is not null"), "author") == [("d",)]


def test_hydrate(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(harvest.to_hydrate(ids("a", "b", "b"), ids("b", "c"), ids("c", "a")), "id", "why") == [("a", "explicit"), ("b", "resurfaced"), ("c", "explicit")]


def test_camera(spark):
    df = spark.createDataFrame([(2.0, 100.0, 40.0)], "z double, d double, c double")
    z, c = F.col("z"), F.col("c")
    twice = camera.wheel_zoom(camera.wheel_zoom(z, F.lit(50.0)), F.lit(50.0))
    new = camera.zoom_about(c, F.lit(70.0), z, F.lit(5.0))
    centre, zoom = camera.fit(F.lit(0.0), F.lit(100.0), 800, 50, 0.5, 4.0)
    r = df.select(
        (twice - camera.wheel_zoom(z, F.col("d"))).alias("w"), ((F.lit(70.0) - new) * 5 - (F.lit(70.0) - c) * z).alias("a"), centre.alias("m"), zoom.alias("f"),
        camera.damp(F.lit(0.0), F.lit(8.0), F.lit(0.16)).alias("h"), camera.pinch_zoom(z, F.lit(10.0), F.lit(30.0)).alias("p"), camera.pinch_zoom(z, F.lit(0.0), F.lit(3.0)).alias("q"),
        camera.keep_inside(F.lit(-5.0), z, 1000, 400).alias("k"), camera.keep_inside(F.lit(-5.0), z, 100, 400).alias("l"), camera.clamp_zoom(F.lit(9.0), 1, 4).alias("x"),
    ).first()
    assert [round(v, 9) for v in r] == [0, 0, 50, 4, 6, 6, 2, 100, 50, 4]


def test_validation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, g string")
    assert validate.capped(df, 2, "rows").count() == 2
    with pytest.raises(Exception, match="rows: 2 rows, at most 1"):
        validate.capped(df, 1, "rows").collect()
    assert validate.matched(df, df.select("id", F.lit(5).alias("v")), "id", "note").count() == 2
    with pytest.raises(Exception, match="note: nothing for 2"):
        validate.matched(df, df.where("id = 1").select("id", F.lit(5).alias("v")), "id", "note").collect()
    assert rows(validate.count_changes(df, df.where("id = 1"), "g"), "key", "detail") == [("b", "1 to 0")]
    assert search.histogram_peak(spark.createDataFrame([], "n long")).first()[0] == 1


def test_page_problems(spark):
    schema = "url string, title string, description string, canonical string, h1_count int, links array<string>, types array<string>"
    good = ("/a/", "A", "about a", "/a/", 1, ["/b/", "https://x"], ["WebPage"])
    pages = spark.createDataFrame([good, ("/b/", "A", "x" * 161, "/a/", 2, ["/c/"], None), ("/z/", "Z", None, "/z/", 1, [], [])], schema)
    wanted = spark.createDataFrame([("/a/", "A", "WebPage"), ("/b/", "B", "WebPage"), ("/d/", "D", "WebPage")], "url string, title string, type string")
    assert rows(validate.page_problems(pages, wanted), "rule", "key") == [
        ("broken link", "/b/"), ("canonical", "/b/"), ("description", "/b/"), ("description", "/z/"), ("heading", "/b/"), ("missing page", "/d/"),
        ("repeated title", "A"), ("title", "/b/"), ("type", "/b/"), ("unexpected page", "/z/"),
    ]


def test_json_ld(spark):
    df = spark.createDataFrame([("</b>", ["X", "Y"])], "t string, a array<string>")
    day = F.lit("2024-01-02").cast("date")
    article = sinks.scholarly_article(F.col("t"), F.col("a"), day, F.lit(None).cast("date"), F.lit("u"), F.lit("s"), F.lit("about"))
    both = df.select(article.alias("j"), sinks.breadcrumbs((F.lit("Home"), F.lit("/")), (F.col("t"), F.lit("/t/"))).alias("b"), sinks.collection_page(F.col("t"), F.lit("d"), F.lit("/"), F.lit(3)).alias("c"))
    r = both.select("*", *[text.json_ld_types(c).alias(f"{c}_types") for c in "jbc"]).first()
    assert "<" not in r["j"] and json.loads(r["j"])["author"][1]["name"] == "Y" and "dateModified" not in json.loads(r["j"])
    assert [x["position"] for x in json.loads(r["b"])["itemListElement"]] == [1, 2]
    assert (r["j_types"], r["b_types"], r["c_types"]) == (["Person", "ScholarlyArticle"], ["BreadcrumbList", "ListItem"], ["CollectionPage", "ItemList"])
    odd = spark.createDataFrame([("nope",), (None,), ('[{"@type": ["A", "B"], "x": {"@type": "C"}}]',)], "v string")
    assert [r[0] for r in odd.select(text.json_ld_types("v")).collect()] == [None, None, ["A", "B", "C"]]


def test_index(spark, tmp_path):
    papers = spark.createDataFrame([("a", 2, "x"), ("b", 0, "y"), ("c", 1, "z")], "id string, pos int, t string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "out"), ("b", "c")], "src string, dst string")
    built = sinks.index_rows(papers, edges, F.col("t"))
    assert rows(built, "id", "incomingCitationCount") == [("a", 0), ("b", 2), ("c", 1)] and built.where("id = 'b'").first()["citedBy"] == ["c", "a"]
    assert sinks.index_or_rebuilt(built, built)[1] and not sinks.index_or_rebuilt(None, built)[1]
    bad = spark.createDataFrame([("b", ["a", "c"], 2, "y"), ("c", ["b"], 9, "z"), ("q", [], 0, ""), ("q", [], 0, "")], sinks.INDEX)
    assert rows(sinks.index_problems(bad, built).distinct(), "rule", "key") == [("citedBy", "b"), ("count", "c"), ("missing", "a"), ("repeated", "q"), ("unknown", "q")]
    assert not sinks.index_or_rebuilt(bad, built)[1]
    path = str(tmp_path / "s.md")
    sinks.append_summary(path, ["one"])
    sinks.append_summary(path, ["two", "three"])
    assert open(path).read() == "one\ntwo\nthree\n"


def test_manifests(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"schemaVersion": 1, "runAt": "2024-01-02T03:04:05+02:00", "counts": {"new": [1, 2]}}')
    (tmp_path / "a.json").write_text('{"runAt": "2024-01-02T03:04:05", "validation": "ok"}')
    got = readers.manifests(spark, str(tmp_path)).select("file", F.col("at").cast("string").alias("at"), "validation", F.to_json("body").alias("body")).collect()
    assert [(r["file"], r["at"], r["validation"]) for r in got] == [("a.json", None, "ok"), ("b.json", "2024-01-02 01:04:05", None)]
    assert json.loads(got[1]["body"])["counts"] == {"new": [1, 2]}


PAGE = """<html><head><link rel="canonical" href="https://arxiv.org/abs/2401.00001v2"></head><body><div id="watermark-tr">arXiv:2401.00001v2 [x] 3 Jan</div>
<section class="ltx_bibliography"><h2>References</h2><ul>{0}</ul></section>{1}</body></html>"""
ITEM = '<li class="ltx_bibitem"><span class="ltx_tag_bibitem">[1]</span> {0}</li>'


@pytest.mark.parametrize("item, want", [
    ('<a href="https://arxiv.org/abs/2402.00002v1">x</a>', ["2402.00002"]), ('Text <a href="https://elsewhere.example/abs/2402.00002">x</a>', []),
    ('<a href="/abs/hep-ph%2F9901001">x</a>', ["hep-ph/9901001"]), ('<a href="https://doi.org/10.48550/arXiv.2402.00003">x</a>', ["2402.00003"]),
    ('<a href="https://elsewhere.example/?q=arXiv:2402.00004v2">x</a>', ["2402.00004"]), ("Known as The  Great Title, 2020", ["2403.00001"]),
    ("A. Person, astro- ph/0101001", ["astro-ph/0101001"]),
])
def test_reference_items(item, want):
    got = html.bibliography(PAGE.format(ITEM.format(item), ""), "2401.00001", 2, {"the great title": "2403.00001"})
    assert got == {"references": want, "error": None}


def test_reference_sections():
    one = ITEM.format("arXiv:2402.00002")
    more = '<section id="bib"><h3>References</h3><ul><li>arXiv:2402.00009</li></ul></section>'
    cited = '<section class="references"><h2>References</h2><ul><li>Cited by: arXiv:2409.00001</li></ul></section>'
    assert html.bibliography(PAGE.format(one, more + cited))["references"] == ["2402.00002", "2402.00009"]
    assert "without a reference" in html.bibliography(PAGE.format(ITEM.format('<a href="#x"></a>'), ""))["error"]
    assert "citing" in html.bibliography(PAGE.format("<li>Cited by: x</li>", ""))["error"]
    assert "not 2401.00009" in html.bibliography(PAGE.format(one, ""), "2401.00009")["error"]
    assert "not v3" in html.bibliography(PAGE.format(one, ""), "2401.00001v3")["error"]
    two = PAGE.format(one, '<meta name="citation_arxiv_id" content="2401.00005">')
    assert "more than one" in html.bibliography(two)["error"]
    assert "no identity" in html.bibliography('<section id="bib"><h2>References</h2><li>x</li></section>', "2401.00001")["error"]


def test_submission_second():
    assert html.utc_second("Mon, 3 Nov 2025 18:00:05 -0500") == "2025-11-03T23:00:05Z"
    assert html.utc_second("3 Nov 2025 18:00:05 GMT") == "2025-11-03T18:00:05Z"
    assert html.utc_second("3 Nov 2025 18:00:05") is None and html.utc_second("x") is None


def test_links(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]
    assert one("https://elsewhere.example/abs/2401.00001", text.ids_from_href) == []
    assert one("https://export.arxiv.org/pdf/hep-ph%2F9901001v2.pdf", text.ids_from_href) == ["hep-ph/9901001"]
    assert one("https://x.example/?a=arXiv%3A2401.00002v3", text.ids_from_href) == ["2401.00002"]
    assert one("/abs/2401.00003?context=x", text.ids_from_href) == ["2401.00003"]
    url = one("a b&c", lambda c: text.search_url("https://arxiv.org/search/", c, F.lit(50)))
    assert url == "https://arxiv.org/search/?query=a+b%26c&order=-announced_date_first&size=50&start=50"
    assert one(url, text.is_newest_first) and not one(url.replace("-announced", "announced"), text.is_newest_first) and not one(None, text.is_newest_first)
    assert one("a/b", lambda c: text.page_url("https://s.example", F.lit("papers"), c)) == "https://s.example/papers/a%2Fb/"
    assert one("hep-ph", lambda c: text.catch_up_url("https://arxiv.org/catchup", c, F.lit("2024-01-02").cast("date"))) == "https://arxiv.org/catchup/hep-ph/2024-01-02"
    assert one("&#233;&#x2014;&amp;lt; &#xD800; &#99999999; &#;x&nbsp;y &#X41;", text.decode_entities) == "é—< &#xD800; &#99999999; &#;x y A"
    assert one("the  Great title of", lambda c: text.alias_ids(c, {"great Title": "i", "other": "j"})) == ["i"]


def test_containing(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "xone two three"), (3, "two"), (4, "ab"), (5, None), (6, "a")], "doc_id long, t string")
    aliases = spark.createDataFrame([(1, "one two three"), (2, "wo"), (3, "two three"), (4, "b"), (5, ""), (6, "two three four"), (7, None)], "item_id long, a string")
    want = {(d, i) for d, t in [(r["doc_id"], r["t"]) for r in docs.collect()] for i, a in [(r["item_id"], r["a"]) for r in aliases.collect()] if t is not None and a is not None and a in t}
    assert {*map(tuple, search.containing(docs, aliases).collect())} == want and len(want) > 12
