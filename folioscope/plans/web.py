"""Page queries: links, visible text, titles, URLs, sitemaps, strict parsing, and streaming replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.registry import query
from folioscope.session import ensure_workers, fresh_path, table
from folioscope.sources import html, sinks


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) AS href FROM pages""")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]+)"'), 1)).alias("href"))


DECODED = "{0}"
for _name, _char in (("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
    DECODED = f"replace({DECODED}, '{_name}', '{_char}')"
VISIBLE = "trim(regexp_replace(" + DECODED.format(
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script\\b[^>]*>.*?</script|style\\b[^>]*>.*?</style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
) + ", '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({VISIBLE}) AS chars, sha256({VISIBLE}) AS digest FROM pages")
def page_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).select("page_id", text.visible_text(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    get = lambda tag: F.regexp_extract("html", f"<{tag}>([^<]*)</{tag}>", 1)
    return pages(spark, sf).select("page_id", get("title").alias("title"), get("h1").alias("h1"))


URL = r"^(https?)://([^/?#]+)([^?#]*)"


@query(f"""SELECT page_id, regexp_extract(url, '{URL}', 2) AS host, regexp_extract(url, '{URL}', 3) AS path, regexp_extract(url, '{URL}', 1) || '://' || regexp_extract(url, '{URL}', 2) || rtrim(regexp_extract(url, '{URL}', 3), '/') AS key,
  regexp_extract(url, '{URL}', 2) LIKE '%.example.org' AND starts_with(regexp_extract(url, '{URL}', 3), '/en') AS allowed FROM pages""")
def url_normalise(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda i: F.regexp_extract("url", URL, i)
    key = F.concat(part(1), F.lit("://"), part(2), F.rtrim(part(3), F.lit("/")))
    allowed = part(2).endswith(".example.org") & part(3).startswith("/en")
    return pages(spark, sf).select("page_id", part(2).alias("host"), part(3).alias("path"), key.alias("key"), allowed.alias("allowed"))


@query("""SELECT page_id, contains(url, 'utm_source=feed') AS by_feed, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, regexp_full_match(url, 'https?://[a-z.]+/[a-z]{2}/\\d+') AS plain FROM pages""")
def newest_first_url(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select(
        "page_id", F.coalesce(F.try_parse_url("url", F.lit("QUERY"), F.lit("utm_source")) == "feed", F.lit(False)).alias("by_feed"),
        text.escape_xml(F.col("url")).alias("escaped"), F.col("url").rlike(r"^https?://[a-z.]+/[a-z]{2}/\d+$").alias("plain"),
    )


@query(f"""WITH r AS (SELECT page_id, 'arXiv:24' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || CASE WHEN page_id % 3 = 0 THEN 'v' || (page_id % 7 + 1) ELSE '' END || CASE WHEN page_id % 2 = 0 THEN '?x=1' ELSE '' END AS raw FROM pages)
  SELECT page_id, lower(regexp_extract(raw, '(\\d{{4}}\\.\\d{{5}})', 1)) AS id, TRY_CAST(nullif(regexp_extract(raw, 'v(\\d+)', 1), '') AS INTEGER) AS version,
    array_to_string(list_filter(list_transform(string_split(replace(url, '?', '/'), '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts, url AS bare FROM r JOIN pages USING (page_id)""")
def id_normalise(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    raw = F.concat(
        F.lit("arXiv:24"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("."), F.lpad(k.cast("string"), 5, "0"),
        F.when(k % 3 == 0, F.concat(F.lit("v"), (k % 7 + 1).cast("string"))).otherwise(""), F.when(k % 2 == 0, "?x=1").otherwise(""),
    )
    parts = F.array_join(text.split_list(F.regexp_replace("url", "/", " ; "), ";?"), "|")
    labelled = F.concat(F.lit("Title:  ["), k.cast("string"), F.lit("] "), "url")
    bare = text.strip_reference_label(text.strip_descriptor(labelled, "Title"))
    rows = pages(spark, sf).select("page_id", text.normalize_id(raw).alias("n"), parts.alias("parts"), bare.alias("bare"))
    return rows.select("page_id", "n.id", "n.version", "parts", "bare")


@query("""SELECT u AS url, '  <url>' || chr(10) || '    <loc>' || replace(u, '&', '&amp;') || '</loc>' || chr(10) || '    <lastmod>' || strftime(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER), '%Y-%m-%d') || '</lastmod>' || chr(10) || '  </url>' AS entry FROM (SELECT page_id, url AS u FROM pages)""")
def sitemap_rows(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int"))
    return sinks.sitemap_rows(pages(spark, sf), "url", day)


SAID = "{0}"
for _name, _char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&nbsp;", " ")):
    SAID = f"replace({SAID}, '{_name}', '{_char}')"
SAID = f"regexp_replace({SAID}, '&amp;?', '&', 'g')"  # a cut title may end without the semicolon
SHOWN = "regexp_replace(regexp_replace(html, '(?is)<head\\b.*?</head>|<(?:script\\b.*?</script|style\\b.*?</style)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
FOUND = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
TAG = "regexp_extract(html, '<{0}>([^<]*)</{0}>', 1)"


@query(f"""SELECT page_id, {FOUND.format(SAID.format(TAG.format('title')))} AS title, {FOUND.format(SAID.format(TAG.format('h1')))} AS h1, CAST(len(regexp_extract_all(html, '<a\\s[^>]*href="[^"]+"')) AS BIGINT) AS n_links,
  length({FOUND.format(SAID.format(SHOWN))}) AS chars, CAST(NULL AS VARCHAR) AS error FROM pages""")
def page_parse_strict(spark: SparkSession, sf: str) -> DataFrame:
    ensure_workers(spark)
    parsed = html.parse_pages(pages(spark, sf), "page_id", "html", html.page, "title string, h1 string, links array<string>, chars long, error string")
    return parsed.select("page_id", "title", "h1", F.size("links").cast("long").alias("n_links"), "chars", "error")


@query("""WITH s AS (SELECT event_type || '|' || user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS k FROM events) SELECT k, count(*) > 0 AS seen FROM s GROUP BY 1""")
def streaming_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from folioscope.streaming import replay

    root = fresh_path(spark, "stream")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return replay.dedup_table(replay.slices(e, F.col("event_id"), 5, f"{root}/in"), f"{root}/out")  # each slice spans all days


ACTIONS = """a AS (SELECT user_id AS id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'decided' WHEN 3 THEN 'listed' ELSE 'observed' END AS kind, 1 + event_id % 3 AS version,
  sha256(event_type) AS digest, CASE WHEN event_id % 5 < 3 THEN 'relevant' ELSE 'excluded' END AS decision, nullif(user_id % 4, 0) AS published, event_id // 100 AS batch, event_id % 3 = 0 AS discover FROM events)"""


@query(f"""WITH {ACTIONS}, o AS (SELECT id, version, seq, digest, published, lag(digest) OVER (PARTITION BY id, version ORDER BY seq) AS had FROM a WHERE kind = 'observed'),
  v AS (SELECT id, version, arg_min(digest, seq) AS digest_0, arg_max(digest, seq) AS digest, coalesce(version <= any_value(published), false) AS covered FROM o GROUP BY 1, 2),
  d AS (SELECT a.id, a.version, a.seq, any_value(a.decision) AS decision, arg_max(o.digest, o.seq) AS reviewed FROM a JOIN o ON o.id = a.id AND o.version = a.version AND o.seq < a.seq WHERE kind = 'decided' GROUP BY 1, 2, 3),
  s AS (SELECT id, version, seq, 'pending' AS status, NULL AS reviewed FROM o WHERE digest <> had UNION ALL SELECT * FROM d),
  l AS (SELECT id, version, arg_max(status, seq) AS status, arg_max(reviewed, seq) FILTER (reviewed IS NOT NULL) AS reviewed, count(reviewed) AS decisions FROM s GROUP BY 1, 2)
  SELECT id, version, digest, coalesce(status, CASE WHEN covered THEN 'relevant' ELSE 'pending' END) AS status, coalesce(reviewed, CASE WHEN covered THEN digest_0 END) AS reviewed, coalesce(decisions, 0) AS decisions,
    CAST(NULL AS BOOLEAN) AS discovered, CAST(NULL AS BIGINT) AS first_batch, CAST(NULL AS BIGINT) AS promoted FROM v LEFT JOIN l USING (id, version)
  UNION ALL SELECT id, 0, NULL, NULL, NULL, 0, bool_or(discover), min(batch), min(batch) FILTER (discover) FROM a WHERE kind = 'listed' GROUP BY 1""")
def paper_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Listings, observations and decisions of papers as keyed state, in five micro-batches of which each spans all time."""
    from folioscope.streaming import papers, replay

    k, root = F.col("event_id"), fresh_path(spark, "papers")
    actions = table(spark, sf, "events").select(
        F.col("user_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), k.cast("long").alias("seq"),
        F.when(k % 4 == 0, "decided").when(k % 4 == 3, "listed").otherwise("observed").alias("kind"), (1 + k % 3).cast("long").alias("version"),
        F.sha2("event_type", 256).alias("digest"), F.when(k % 5 < 3, "relevant").otherwise("excluded").alias("decision"),
        F.nullif(F.col("user_id") % 4, F.lit(0)).cast("long").alias("published"), F.expr("event_id div 100").alias("batch"), (k % 3 == 0).alias("discover"),
    )
    papers.paper_states(replay.slices(actions, -k * 3, 5, f"{root}/in"), f"{root}/out", "400 days")
    return papers.latest(spark, f"{root}/out")
