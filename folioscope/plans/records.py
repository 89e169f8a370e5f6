"""Records as publishers serve them, made from orders and customers: abstract pages and Atom feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import search
from folioscope.registry import query
from folioscope.session import fresh_path, materialize, table
from folioscope.sources import abstracts, feeds
from folioscope.sources.response_cache import ResponseCache

PAPER = "strftime(o_orderdate, '%y%m') || '.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')"


def papers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    paper = F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("."), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))
    return o.select(F.col("o_orderkey").alias("k"), paper.alias("paper"), "c_name", "c_custkey", "o_orderpriority", "c_mktsegment", F.to_date("o_orderdate").alias("day"))


@query(f"""WITH p AS (SELECT o_orderkey AS k, {PAPER} AS paper, c_name, o_orderpriority, c_mktsegment, CAST(o_orderdate AS DATE) AS day, o_orderkey % 3 + 1 AS n FROM orders JOIN customer ON c_custkey = o_custkey),
  e AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'history has gaps' WHEN k % 13 = 0 THEN 'lacks authors, abstract' WHEN k % 17 = 0 THEN 'another paper: ' || paper WHEN k % 19 = 0 THEN 'no identity' END AS found FROM p),
  f AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'no identity' WHEN k % 17 = 0 THEN 'another paper: ' || paper WHEN k % 13 = 0 THEN 'lacks authors, abstract' WHEN k % 11 = 0 THEN 'history has gaps' END AS error FROM e)
  SELECT k, CASE WHEN error IS NULL THEN paper END AS id, CASE WHEN error IS NULL THEN n END AS version, CASE WHEN error IS NULL THEN c_name || ' <&> "' || c_mktsegment || '"' END AS title,
    CASE WHEN error IS NULL THEN c_name || '|' || 'Zoë ' || o_orderpriority END AS authors, CASE WHEN error IS NULL THEN 'Of ' || c_mktsegment || ' on ' || o_orderpriority END AS abstract,
    CASE WHEN error IS NULL THEN day + 1 END AS submitted, CASE WHEN error IS NULL THEN CASE WHEN n = 1 THEN day + 1 ELSE day + CAST(n AS INTEGER) - 1 END END AS updated,
    CASE WHEN error IS NULL THEN '1:' || strftime(day + 1, '%Y-%m-%d') || 'T04:30:05Z' || CASE WHEN n > 1 THEN '|2:' || strftime(day + 1, '%Y-%m-%d') || 'T18:00:00Z' ELSE '' END || CASE WHEN n > 2 THEN '|3:' || strftime(day + 2, '%Y-%m-%d') || 'T18:00:00Z' ELSE '' END END AS history,
    CASE WHEN error IS NULL AND k % 2 = 0 THEN lower(c_mktsegment) END AS primary_category, CASE WHEN error IS NULL THEN o_orderpriority || '|' || c_mktsegment END AS subjects, error FROM f""")
def abstract_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose metadata stand now in <meta>, now in the body, with times of several zones, and pages with a fault of each kind."""
    k, day = F.col("k"), F.col("day")
    lit, cat = F.lit, F.concat
    fall = lambda *cases: F.coalesce(*[F.when(c, cat(*[lit(x) if isinstance(x, str) else x for x in parts])) for c, parts in cases], lit(""))
    always = lit(True)
    title = cat("c_name", lit(" &lt;&amp;&gt; &quot;"), "c_mktsegment", lit("&quot;"))
    stamp = lambda d, how: F.date_format(d, how)
    one = cat(lit("<b>[v1]</b> "), stamp(day, "EEE, d MMM yyyy"), lit(" 23:30:05 -0500 (9 KB)<br/>\n"))
    two = cat(lit("<b>[v2]</b> "), stamp(F.date_add(day, 1), "d MMM yyyy"), lit(" 18:00:00 UTC<br/>\n"))
    three = cat(lit("<strong>[v3]</strong> "), stamp(F.date_add(day, 3), "EEE, d MMM yyyy"), lit(" 03:00:00 +0900\n"))
    first = fall((k % 11 == 0, [lit("[v0] 1 Jan 2020 00:00:00 GMT "), one]), (always, [one]))
    identity = fall(
        (k % 19 == 0, ["<meta name='citation_arxiv_id' content='none'>"]),
        (k % 5 == 0, ['<link href="https://arxiv.org/abs/', F.col("paper"), 'v1" rel="canonical"/>']),
        (always, ['<meta content="', F.col("paper"), '" name="citation_arxiv_id"/>']),
    )
    head = fall((k % 7 == 0, ['<body><h1 class="title mathjax"><span>Title:</span> ', title, "</h1>"]), (always, ['<meta name="citation_title" content="', title, '"/><body>']))
    names = fall(
        (k % 13 == 0, [""]),
        (k % 7 == 0, ['<div class="authors"><span>Authors:</span> <a>', F.col("c_name"), "</a>, <a>Zo&#235; ", F.col("o_orderpriority"), "</a></div>"]),
        (always, ['<meta name="citation_author" content="', F.col("c_name"), '"><meta name="citation_author" content="Zo&#xEB;  ', F.col("o_orderpriority"), '">']),
    )
    about = fall((k % 13 == 0, [""]), (always, ['<meta property="og:description" content="Of ', F.col("c_mktsegment"), "\n  on ", F.col("o_orderpriority"), '">']))
    words = cat(lit('<meta name="citation_keywords" content="'), "o_orderpriority", lit("; "), "c_mktsegment", lit(';"/><meta name="citation_keywords" content="'), "c_mktsegment", lit('"/>'))
    category = fall((k % 2 == 0, ['<meta name="citation_primary_category" content="', F.lower("c_mktsegment"), '"/>']))
    versions = cat(first, F.when(k % 3 >= 1, two).otherwise(""), F.when(k % 3 == 2, three).otherwise(""))
    page = cat(lit("<html><head>"), identity, words, category, about, head, names, lit('<div class="submission-history">From: x\n'), versions, lit("</div><script>[v9] 1 Jan 2020 00:00:00 GMT</script></body></html>"))
    asked = F.when(k % 17 == 0, "2401.99999").otherwise(F.concat("paper", lit("v1")))
    got = abstracts.abstract_pages(papers(spark, sf).select("k", page.alias("html"), asked.alias("asked")), expected="asked")
    told = F.array_join(F.transform("history", lambda e: F.concat_ws(":", e["version"].cast("string"), e["submitted_at"])), "|")
    return got.select(
        "k", "id", "version", "title", F.array_join("authors", "|").alias("authors"), "abstract", "submitted", "updated", told.alias("history"),
        "primary_category", F.array_join("subjects", "|").alias("subjects"), "error",
    )


@query(f"""WITH p AS (SELECT c_custkey, o_orderkey AS k, {PAPER} AS paper, c_name, o_orderpriority, c_mktsegment, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON c_custkey = o_custkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY k) - 1 AS place FROM p)
  SELECT c_custkey AS feed, CAST(place AS INTEGER) AS place, paper AS id, c_name || ' & ' || k AS title, c_name || CASE WHEN k % 2 = 0 THEN '|' || o_orderpriority ELSE '' END AS authors, 'On <x>' AS abstract, day AS published,
    day AS updated, CASE WHEN k % 3 = 0 THEN '' ELSE c_mktsegment || '|hep' END AS categories, 'https://arxiv.org/abs/' || paper AS url, CASE WHEN k % 4 <> 0 THEN 'https://arxiv.org/pdf/' || k END AS pdf, CAST(NULL AS VARCHAR) AS error
  FROM r WHERE c_custkey % 10 <> 3
  UNION ALL SELECT c_custkey, NULL, NULL, '', '', '', '', '', '', NULL, NULL, CASE WHEN c_custkey % 20 = 3 THEN 'no feed' ELSE 'empty feed' END FROM (SELECT DISTINCT c_custkey FROM p) WHERE c_custkey % 10 = 3""")
def atom_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A feed a customer with an entry an order; some aren't feeds, some are empty."""
    k, lit, cat = F.col("k"), F.lit, F.concat
    author = lambda c: cat(lit("<author><name>"), c, lit("</name></author>"))
    entry = cat(
        lit("<entry><id>http://arxiv.org/abs/"), "paper", lit("v2</id><updated>"), F.col("day").cast("string"), lit("T01:02:03Z</updated><published>"), F.col("day").cast("string"),
        lit("T00:00:00Z</published><title>"), "c_name", lit("\n  &amp; "), k.cast("string"), lit("</title><summary>  On &lt;x&gt; </summary>"), author(F.col("c_name")),
        F.when(k % 2 == 0, author(F.col("o_orderpriority"))).otherwise(""), lit('<link href="https://arxiv.org/abs/'), "paper", lit('" rel="alternate"/>'),
        F.when(k % 4 != 0, cat(lit('<link title="pdf" href="https://arxiv.org/pdf/'), k.cast("string"), lit('" rel="related"/>'))).otherwise(""),
        F.when(k % 3 != 0, cat(lit('<category term="'), "c_mktsegment", lit('" scheme="s"/><category term="hep"/>'))).otherwise(""), lit("</entry>"),
    )
    each = papers(spark, sf).groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("es"))
    body = F.array_join(F.transform("es", lambda x: x["e"]), "\n")
    c = F.col("c_custkey")
    inside = F.when(c % 10 == 3, F.lit("<title>none</title>")).otherwise(body)
    space = F.when(c % 20 == 3, "urn:other").otherwise("http://www.w3.org/2005/Atom")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="'), space, F.lit('">'), inside, F.lit("</feed>"))
    got = feeds.entries(each.select(c.alias("feed"), xml.alias("xml")))
    return got.withColumns({n: F.array_join(n, "|") for n in ("authors", "categories")})


@query("SELECT greatest(1, coalesce(max(n), 1)) AS peak FROM (SELECT count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE))")
def histogram_peak(spark: SparkSession, sf: str) -> DataFrame:
    return search.histogram_peak(search.day_histogram(table(spark, sf, "orders"), "o_orderdate"))


STATUSES = ("relevant", "excluded", "ambiguous", "pending")


@query("""WITH s AS (SELECT coalesce(source, '') AS source, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 0 THEN 'excluded' ELSE 'ambiguous' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
  SELECT source, """ + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES) + ", count(*) AS total FROM s GROUP BY 1")
def status_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """The tallies of every screening status that a run's manifest holds, by source."""
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    q, t = F.col("quality"), F.col("toxic")
    status = F.when(q.isNull(), "pending").when((q == 1) & (t == 0), "relevant").when(q == 0, "excluded").otherwise("ambiguous")
    rows = d.select(F.coalesce("source", F.lit("")).alias("source"), status.alias("status"))
    return rows.groupBy("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


@query("""WITH r AS (SELECT page_id AS k, CASE WHEN page_id % 10 = 9 THEN 'https://elsewhere.example/' ELSE 'https://arxiv.org/' END || page_id AS url, html FROM pages),
  held AS (SELECT *, CASE WHEN k % 6 = 0 OR k % 3 = 1 THEN 0 ELSE 5000 END AS age, CASE WHEN k % 3 = 1 THEN html || 'new' ELSE html END AS body, k % 4 = 0 OR k % 6 = 0 AS tagged FROM r WHERE k % 10 <> 9 AND (k % 2 = 0 OR k % 3 = 1))
  SELECT r.url, CASE WHEN r.k % 10 = 9 THEN 'reject' WHEN held.k IS NULL THEN 'fetch' WHEN age = 0 THEN 'use' WHEN tagged THEN 'revalidate' ELSE 'fetch' END AS action,
    CASE WHEN age > 0 AND tagged THEN 'tag' || r.k END AS etag, CASE WHEN age = 0 THEN sha256(body) END AS body FROM r LEFT JOIN held ON held.k = r.k""")
def response_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A round of answers (new bodies, confirmations, errors, a host that isn't allowed) over a store, then what the next round has to do."""
    k = F.col("page_id")
    url = F.concat(F.when(k % 10 == 9, "https://elsewhere.example/").otherwise("https://arxiv.org/"), k.cast("string"))
    p = materialize(table(spark, sf, "pages").select(k.alias("k"), url.alias("url"), "html"), "pages")
    k, then, now = F.col("k"), F.lit("2024-01-01 10:00:00").cast("timestamp"), F.lit("2024-01-01 11:23:20").cast("timestamp")
    held = ResponseCache(spark, fresh_path(spark, "responses"), 16)
    none = F.lit(None).cast("string")

    def answer(rows: DataFrame, status, at, etag, body) -> DataFrame:
        return rows.select("url", status.cast("int").alias("status"), at.alias("at"), etag.alias("etag"), none.alias("last_modified"), F.lit("text/html").alias("mime"), body.alias("body"))

    tag = F.when(k % 4 == 0, F.concat(F.lit("tag"), k.cast("string")))
    held.absorb(answer(p.where(k % 2 == 0), F.lit(200), then, tag, F.col("html")))
    again, changed = p.where((k % 6 == 0) & (k % 3 != 1)), p.where(k % 3 == 1)
    lost = p.where((k % 2 == 1) & (k % 3 != 1))
    said = F.when(k % 3 == 1, F.concat("html", F.lit("new")))
    held.absorb(
        answer(again, F.lit(304), now, F.concat(F.lit("tag"), k.cast("string")), none)
        .unionByName(answer(changed, F.lit(200), now, none, said))
        .unionByName(answer(lost, F.when(k % 4 == 1, 503).otherwise(304), now, none, none))
    )
    return held.plan(p, now).select("url", "action", "etag", F.sha2("body", 256).alias("body"))
