"""Harvest, index, link and page queries. Papers are parts or pages, authors customers, listing pages runs of events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import camera, text
from folioscope.operators import harvest, islands, search, validate
from folioscope.plans import citations, maps
from folioscope.registry import query
from folioscope.session import materialize, table
from folioscope.sources import sinks


def papers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key.cast("string").alias("id"), key.alias("pos"), text.normalize_search_text(F.col("p_name")).alias("t"))


def index(spark: SparkSession, sf: str) -> DataFrame:
    edges = citations.edges(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return sinks.index_rows(papers(spark, sf), edges, F.col("t"))


INDEX = f"""{citations.EDGES}, idx AS (SELECT CAST(p_partkey AS VARCHAR) AS id, coalesce(string_agg(CAST(src AS VARCHAR), ',' ORDER BY src), '') AS cited_by, count(src) AS n,
  trim(regexp_replace(lower(any_value(p_name)), '[^a-z0-9]+', ' ', 'g')) AS t, p_partkey AS k FROM part LEFT JOIN edges ON dst = p_partkey GROUP BY p_partkey)"""


@query(f"WITH {INDEX} SELECT id, cited_by, n, t FROM idx")
def search_index(spark: SparkSession, sf: str) -> DataFrame:
    return index(spark, sf).select("id", F.array_join("citedBy", ",").alias("cited_by"), F.col("incomingCitationCount").alias("n"), F.col("searchText").alias("t"))


PROBLEMS = f"""WITH {INDEX} SELECT 'missing' AS rule, id AS key, '' AS detail FROM idx WHERE k % 7 = 0 UNION ALL SELECT 'count', id, '' FROM idx WHERE k % 7 <> 0 AND k % 5 = 0
  UNION ALL SELECT 'text', id, '' FROM idx WHERE k % 7 <> 0 AND k % 5 <> 0 AND k % 3 = 0 UNION ALL SELECT 'citedBy', id, '' FROM idx WHERE k % 7 <> 0 AND k % 5 <> 0 AND k % 3 <> 0 AND n > 1
  UNION ALL SELECT 'unknown', 'new', '' UNION ALL SELECT 'repeated', id, '2' FROM idx WHERE k % 11 = 1 AND k % 7 <> 0
  UNION ALL SELECT rule, id, '' FROM (SELECT id, CASE WHEN k % 5 = 0 THEN 'count' WHEN k % 3 = 0 THEN 'text' WHEN n > 1 THEN 'citedBy' END AS rule FROM idx WHERE k % 11 = 1 AND k % 7 <> 0) WHERE rule IS NOT NULL"""


def stored_index(spark: SparkSession, built: DataFrame) -> DataFrame:
    """An index with a fault of each kind."""
    k = F.col("id").cast("long")
    turned = F.when((k % 5 != 0) & (k % 3 != 0), F.reverse("citedBy")).otherwise(F.col("citedBy"))
    stored = built.where(k % 7 != 0).select(
        "id", turned.alias("citedBy"), F.when(k % 5 == 0, F.col("incomingCitationCount") + 1).otherwise(F.col("incomingCitationCount")).alias("incomingCitationCount"),
        F.when((k % 5 != 0) & (k % 3 == 0), F.concat("searchText", F.lit("!"))).otherwise(F.col("searchText")).alias("searchText"),
    )
    new = spark.createDataFrame([("new", [], 0, "")], sinks.INDEX)
    return stored.unionByName(stored.where(k % 11 == 1)).unionByName(new)


@query(PROBLEMS)
def index_problems(spark: SparkSession, sf: str) -> DataFrame:
    built = index(spark, sf)
    return sinks.index_problems(stored_index(spark, built), built)


@query(PROBLEMS)
def index_problems_by_blocks(spark: SparkSession, sf: str) -> DataFrame:
    built = materialize(index(spark, sf), "index")
    return sinks.index_problems_in_blocks(stored_index(spark, built), built)


@query("SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def required_match(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return validate.matched(left, right, "k", "customer").select("id", "name")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def safety_cap(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return validate.capped(n, 25, "nations")


@query("""WITH a AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'moved' ELSE p_brand END AS v FROM part), b AS (SELECT v, count(*) AS now FROM a GROUP BY 1), w AS (SELECT p_brand AS v, count(*) AS was FROM part GROUP BY 1)
  SELECT 'count' AS rule, coalesce(w.v, b.v) AS key, coalesce(was, 0) || ' to ' || coalesce(now, 0) AS detail FROM w FULL JOIN b ON w.v = b.v WHERE coalesce(was, 0) <> coalesce(now, 0)""")
def count_changes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("v"))
    return validate.count_changes(p, p.withColumn("v", F.when(F.col("p_partkey") % 50 == 0, "moved").otherwise(F.col("v"))), "v")


LISTED = "pg AS (SELECT event_type AS source, event_id // 64 AS page, event_id % 64 AS pos, user_id AS id FROM events), mk AS (SELECT DISTINCT source, id FROM pg WHERE id % 41 = 5 AND source <> (SELECT max(event_type) FROM events))"


def listed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Listing pages of 64 entries, and the ids of each source's frontier (the last source has none)."""
    k = F.col("event_id")
    pages = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.floor(k / 64).alias("page"), (k % 64).alias("pos"), F.col("user_id").alias("id"))
    last = F.broadcast(table(spark, sf, "events").agg(F.max("event_type").alias("last")))  # one row
    return pages, pages.where("id % 41 = 5").join(last, F.col("source") != F.col("last"), "left_semi").select("source", "id")


@query(f"""WITH {LISTED}, st AS (SELECT source, min(page * 64 + pos) // 64 AS stop FROM pg JOIN mk USING (source, id) GROUP BY 1), p AS (SELECT source, min(page) AS lo, max(page) AS hi FROM pg GROUP BY 1)
  SELECT p.source, coalesce(stop, hi) - lo + 1 AS n_pages, stop IS NOT NULL AS met, CASE WHEN stop IS NULL AND hi - lo + 1 >= 3 THEN 'no frontier id' WHEN coalesce(stop, hi) - lo + 1 > 3 THEN 'too many pages' END AS error FROM p LEFT JOIN st ON st.source = p.source""")
def pages_to_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return harvest.pages_to_frontier(*listed(spark, sf), max_pages=3)


@query(f"""WITH {LISTED}, st AS (SELECT source, min(page * 64 + pos) AS stop FROM pg JOIN mk USING (source, id) GROUP BY 1), f AS (SELECT source, id, min(page * 64 + pos) AS spot FROM pg GROUP BY 1, 2)
  SELECT f.source, spot // 64 AS page, spot % 64 AS pos, id FROM f LEFT JOIN st ON st.source = f.source WHERE stop IS NULL OR spot < stop""")
def new_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    return harvest.new_on_pages(*listed(spark, sf))


@query("""WITH a AS (SELECT c_custkey AS author, c_custkey % 3 = 0 AS f, CAST(min(o_orderdate) AS DATE) AS first_seen, CASE WHEN c_custkey % 4 <> 1 THEN CAST(max(o_orderdate) AS DATE) END AS covered,
    CASE WHEN c_custkey % 5 = 2 THEN DATE '1992-02-03' END AS scan FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
  SELECT author, least(CASE WHEN covered IS NULL THEN first_seen ELSE covered - 2 END, DATE '1996-01-01', CASE WHEN covered IS NULL THEN scan END) AS low, DATE '1997-01-01' AS high,
    greatest(covered, DATE '1997-01-01') AS cursor, CASE WHEN first_seen IS NULL THEN 'no committed frontier or first sighting' END AS error FROM a WHERE NOT f""")
def catch_up_windows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.to_date(F.min("o_orderdate")).alias("first_seen"), F.to_date(F.max("o_orderdate")).alias("newest"))
    k = F.col("author")
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("author")).join(o, "author", "left")
    a = a.select(
        "author", (k % 3 == 0).alias("has_frontier"), "first_seen", F.when(k % 4 != 1, F.col("newest")).alias("covered_through"),
        F.when(k % 5 == 2, F.lit(date(1992, 2, 3))).alias("catalogue_scan"),
    )
    return harvest.catch_up_windows(a, F.lit(date(1996, 1, 1)), F.lit(date(1997, 1, 1)))


@query("""WITH s AS (SELECT DISTINCT user_id AS id FROM events), k AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), e AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 = 3)
  SELECT id, CASE WHEN id IN (SELECT id FROM e) THEN 'explicit' WHEN id IN (SELECT id FROM k) THEN 'resurfaced' ELSE 'new' END AS why FROM (SELECT id FROM s UNION SELECT id FROM e)""")
def hydrate_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return harvest.to_hydrate(table(spark, sf, "events").select(F.col("user_id").alias("id")), c.where("id % 2 = 0"), c.where("id % 10 = 3"))


@query("""WITH r AS (SELECT page_id AS id, CASE WHEN page_id % 9 = 4 THEN 'http://' ELSE 'https://' END || CASE WHEN page_id % 5 = 0 THEN 'elsewhere.example' ELSE 'export.arxiv.org' END || '/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 600 ELSE 4000 END AS age, page_id % 3 = 0 AS tagged,
    CASE WHEN page_id % 11 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS mime, page_id % 7 <> 2 AS whole, octet_length(encode(html)) AS n FROM pages)
  SELECT id, CASE WHEN NOT starts_with(url, 'https://export.arxiv.org/') OR mime = 'application/pdf' OR n > 3000 THEN 'reject'
    WHEN whole AND age <= 900 THEN 'use' WHEN whole AND tagged THEN 'revalidate' ELSE 'fetch' END AS action FROM r""")
def cache_rules(spark: SparkSession, sf: str) -> DataFrame:
    k, now = F.col("page_id"), F.lit("2024-01-01 12:00:00").cast("timestamp")
    host = F.when(k % 5 == 0, "elsewhere.example").otherwise("export.arxiv.org")
    url = F.concat(F.when(k % 9 == 4, "http://").otherwise("https://"), host, F.lit("/"), k.cast("string"))
    rows = table(spark, sf, "pages").select(
        k.alias("id"), url.alias("url"), F.timestamp_add("SECOND", F.when(k % 2 == 0, -600).otherwise(-4000), now).alias("fetched_at"),
        F.when(k % 3 == 0, "tag").alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(k % 11 == 5, "application/pdf").otherwise("text/html; charset=utf-8").alias("mime"), F.col("html").alias("body"),
        F.sha2(F.concat(F.col("html"), F.when(k % 7 == 2, "!").otherwise("")), 256).alias("sha"),
    )
    return harvest.cache_action(rows, now, most_bytes=3000).select("id", "action")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN n WHEN 1 THEN '' WHEN 2 THEN 'hep-ph/' || lpad(CAST(page_id AS VARCHAR), 7, '0') WHEN 3 THEN n WHEN 4 THEN n || ',' || m ELSE n END AS ids
  FROM (SELECT page_id, '2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS n, '2402.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS m FROM pages)""")
def href_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    n, m, old = F.concat(F.lit("2401."), F.lpad(k.cast("string"), 5, "0")), F.concat(F.lit("2402."), F.lpad(k.cast("string"), 5, "0")), F.lpad(k.cast("string"), 7, "0")
    href = (
        F.when(k % 6 == 0, F.concat(F.lit("https://arxiv.org/pdf/"), n, F.lit("v3.pdf")))
        .when(k % 6 == 1, F.concat(F.lit("https://elsewhere.example/abs/"), n))
        .when(k % 6 == 2, F.concat(F.lit("/abs/HEP-PH%2F"), old, F.lit("?x=1")))
        .when(k % 6 == 3, F.concat(F.lit("https://doi.org/10.48550/arXiv."), n))
        .when(k % 6 == 4, F.concat(F.lit("https://export.arxiv.org/html/"), n, F.lit("v1#arXiv:"), m, F.lit("v2")))
        .otherwise(F.concat(F.lit("https://x.example/?q=arXiv%3A"), n))
    )
    return table(spark, sf, "pages").select("page_id", F.array_join(text.ids_from_href(href), ",").alias("ids"))


@query("""SELECT page_id, 'https://arxiv.org/search/?query=' || 'page+' || page_id || '%26&order=-announced_date_first&size=50&start=' || page_id * 50 AS search, 'https://s.example/papers/' || page_id || '%2Fx/' AS page,
  page_id % 2 = 0 AS newest_first, 'é ' || chr(CAST(1000 + page_id AS INTEGER)) || chr(CAST(1000 + page_id AS INTEGER)) || ' < &#x;' AS decoded FROM pages""")
def url_builders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    url = text.search_url("https://arxiv.org/search/", F.concat(F.lit("page "), k.cast("string"), F.lit("&")), k * 50)
    shown = F.when(k % 2 == 0, url).otherwise(F.replace(url, F.lit("-announced"), F.lit("announced")))
    said = F.concat(F.lit("&#233; &#"), (k + 1000).cast("string"), F.lit(";&#x"), F.hex(k + 1000), F.lit("; &amp;lt; &#x;"))
    return table(spark, sf, "pages").select(
        "page_id", url.alias("search"), text.page_url("https://s.example/", F.lit("papers"), F.concat(k.cast("string"), F.lit("/x"))).alias("page"),
        text.is_newest_first(shown).alias("newest_first"), text.decode_entities(said).alias("decoded"),
    )


@query(f"""WITH {maps.PTS} SELECT id, round(greatest(0.5, least(4, exp(ln(1 + abs(x)) - 200 * y * 0.0015))), 6) AS wheel, round(x - (x - y) * 2 / 5, 6) AS centre, round(x + (y - x) * 0.25, 6) AS damped, round(2 * (1 + abs(x)) / (1 + abs(y)), 6) AS pinch,
  round(greatest(0.1, least(0.9, x)), 6) AS kept FROM pts""")
def camera_moves(spark: SparkSession, sf: str) -> DataFrame:
    x, y, two = F.col("x"), F.col("y"), F.lit(2.0)
    return maps.points(spark, sf).select(
        "id", F.round(camera.clamp_zoom(camera.wheel_zoom(1 + F.abs(x), 200 * y), 0.5, 4.0), 6).alias("wheel"), F.round(camera.zoom_about(y, x, two, F.lit(5.0)), 6).alias("centre"),
        F.round(camera.damp(y, x, F.lit(0.16)), 6).alias("damped"), F.round(camera.pinch_zoom(two, 1 + F.abs(y), 1 + F.abs(x)), 6).alias("pinch"),
        F.round(camera.keep_inside(x, two, 1.0, 0.4), 6).alias("kept"),
    )


@query(f"WITH {maps.PTS} SELECT id, round(x, 6) AS x, round(y, 6) AS y, grp AS radius, row_number() OVER (ORDER BY round(x, 6), round(y, 6), grp, id) AS place FROM pts")
def geometry_order(spark: SparkSession, sf: str) -> DataFrame:
    p = maps.points(spark, sf).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.col("group").alias("radius"))
    return islands.geometry_places(p)


@query(f"""WITH {maps.PTS} SELECT 'member geometry' AS rule, CAST(id AS VARCHAR) AS key FROM pts WHERE id % 10 = 3 OR id % 17 = 0 UNION ALL SELECT 'unknown island', CAST(id AS VARCHAR) FROM pts WHERE grp = 9
  UNION ALL SELECT 'island geometry', '4' WHERE EXISTS (SELECT 1 FROM pts WHERE grp = 4) UNION ALL SELECT 'member rank', 'm/' || r FROM (SELECT id // 2 AS r FROM pts WHERE id % 17 <> 0 GROUP BY 1 HAVING count(*) > 1)""")
def geometry_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    members = maps.points(spark, sf).select(
        F.lit("m").alias("map"), "group", "id", F.when(k % 17 != 0, F.floor(k / 2)).alias("rank"), F.when(k % 10 != 3, F.col("x")).otherwise(F.lit(float("nan"))).alias("x"), "y", F.lit(3.0).alias("radius")
    )
    rings = members.where("group <> 9").groupBy("map", "group").agg(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    rings = rings.select("*", F.when(F.col("group") == 4, -1.0).otherwise(5.0).alias("label_width"), F.lit(2.0).alias("label_height"))
    return islands.geometry_violations(members, rings).select("rule", "key")


@query("""SELECT p_partkey AS id, '{"@context":"https://schema.org","@type":"ScholarlyArticle","headline":"' || p_name || ' \\u003cb>","author":[{"@type":"Person","name":"' || p_brand || '"}],"datePublished":"2024-01-02","url":"/' || p_partkey || '/","sameAs":"x","abstract":"y"}' AS article,
  '{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":[{"@type":"ListItem","position":1,"name":"Home","item":"/"},{"@type":"ListItem","position":2,"name":"' || p_name || '","item":"/' || p_partkey || '/"}]}' AS crumbs, 'Person,ScholarlyArticle' AS types,
  '@misc{k,' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '}' AS bibtex FROM part""")
def linked_data(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"))
    article = sinks.scholarly_article(
        F.concat("p_name", F.lit(" <b>")), F.array("p_brand"), F.lit("2024-01-02").cast("date"), F.lit(None).cast("date"), url, F.lit("x"), F.lit("y")
    )
    crumbs = sinks.breadcrumbs((F.lit("Home"), F.lit("/")), (F.col("p_name"), url))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), article.alias("article"), crumbs.alias("crumbs"), sinks.bibtex("k", title=F.col("p_name"), doi=F.lit(None).cast("string")).alias("bibtex"))
    return rows.select("id", "article", "crumbs", F.array_join(text.json_ld_types("article"), ",").alias("types"), "bibtex")


@query("""SELECT page_id AS id FROM pages ORDER BY CASE WHEN page_id % 5 = 3 AND page_id > 20 THEN 0 WHEN page_id > 20 THEN 1 WHEN page_id % 5 = 3 THEN 2 ELSE 3 END, page_id LIMIT 1""")
def picked(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"))
    return search.pick(p, F.col("id") % 5 == 3, F.col("id") > 20, "id")


TITLED = "pg AS (SELECT url, page_id AS k, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), ex AS (SELECT url, CASE WHEN k % 7 = 0 THEN 'other' ELSE title END AS title, k FROM pg WHERE k % 10 <> 0)"


@query(f"""WITH {TITLED}, c AS (SELECT url, count(*) AS n FROM pg GROUP BY 1)
  SELECT 'unexpected page' AS rule, url AS key FROM pg WHERE url NOT IN (SELECT url FROM ex) UNION ALL SELECT 'missing page', '/gone/' UNION ALL SELECT 'title', pg.url FROM pg JOIN ex USING (url) WHERE pg.title <> ex.title
  UNION ALL SELECT 'description', url FROM pg WHERE length(title) = 0 OR length(title) > 160 UNION ALL SELECT 'heading', url FROM pg WHERE k % 4 = 1 UNION ALL SELECT 'type', pg.url FROM pg JOIN ex USING (url) WHERE pg.k % 6 = 0
  UNION ALL SELECT 'broken link', url FROM pg WHERE k % 13 = 0 UNION ALL SELECT 'canonical', url FROM pg WHERE k % 9 = 0 UNION ALL SELECT 'repeated title', title FROM pg GROUP BY title HAVING count(*) > 1""")
def page_rules(spark: SparkSession, sf: str) -> DataFrame:
    k, title = F.col("page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    built = table(spark, sf, "pages").select(
        "url", title.alias("title"), title.alias("description"), F.when(k % 9 != 0, F.col("url")).alias("canonical"), F.when(k % 4 == 1, 2).otherwise(1).alias("h1_count"),
        F.when(k % 13 == 0, F.array(F.lit("/nowhere/"))).otherwise(F.array(F.lit("https://x.example/"))).alias("links"), F.when(k % 6 != 0, F.array(F.lit("WebPage"))).alias("types"),
    )
    wanted = table(spark, sf, "pages").where("page_id % 10 <> 0").select("url", F.when(k % 7 == 0, "other").otherwise(title).alias("title"), F.lit("WebPage").alias("type"))
    gone = spark.createDataFrame([("/gone/", "x", "WebPage")], "url string, title string, type string")
    return validate.page_problems(built, wanted.unionByName(gone)).select("rule", "key")
