"""Completeness, gates, snapshots, orders and projections. Papers are parts, documents or orders; searches runs of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import numbers
from folioscope.operators import graph, harvest, state, validate
from folioscope.plans import citations
from folioscope.plans import harvest as listings
from folioscope.registry import query
from folioscope.session import table


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CAST(o_orderdate AS DATE), o_orderkey) AS place FROM orders""")
def catalogue_positions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("observation"), F.to_date("o_orderdate").alias("published"))
    return state.catalogue_places(o).select("id", "place")


@query("""WITH s AS (SELECT user_id AS id, length(event_type) AS version, event_id AS seq, sha256(event_type || (day(ts) % 3)) AS sha, event_id % 5 = 0 AS demanded FROM events),
  t AS (SELECT *, CASE WHEN demanded OR row_number() OVER (PARTITION BY id, version ORDER BY seq) = 1 THEN seq END AS taken FROM s),
  u AS (SELECT *, max(taken) OVER (PARTITION BY id, version ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(taken) OVER (PARTITION BY id, version) AS newest FROM t)
  SELECT u.id, u.version, u.seq, u.sha, CASE WHEN before IS NULL THEN 'new' WHEN h.sha = u.sha THEN 'replayed' WHEN taken IS NOT NULL THEN 'superseding' ELSE 'conflict' END AS state, u.seq = newest AS head
  FROM u LEFT JOIN s h ON h.seq = before""")
def snapshot_states(spark: SparkSession, sf: str) -> DataFrame:
    sha = F.sha2(F.concat("event_type", (F.dayofmonth("ts") % 3).cast("string")), 256)
    return state.snapshot_states(
        table(spark, sf, "events").select(
            F.col("user_id").alias("id"), F.length("event_type").cast("long").alias("version"), F.col("event_id").alias("seq"), sha.alias("sha"), (F.col("event_id") % 5 == 0).alias("supersede")
        )
    )


@query("""WITH c AS (SELECT DISTINCT event_id // 64 AS page FROM events), p AS (SELECT page, CASE WHEN page % 11 = 3 THEN 'no container' WHEN page % 7 = 5 THEN 'partial' WHEN page % 4 <> 1 AND page % 5 = 2 THEN 'count mismatch' END AS error FROM c
  UNION ALL SELECT -1 - r_regionkey, CASE WHEN r_regionkey = 4 THEN 'no entries' WHEN r_regionkey % 2 = 1 THEN 'no day' END FROM region) SELECT page, error FROM p WHERE error IS NOT NULL""")
def listing_problems(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "events").select(F.floor(F.col("event_id") / 64).alias("page"), F.col("user_id").alias("id"))
    page, k = F.col("page"), F.col("r_regionkey").cast("long")
    counted = entries.groupBy("page").agg(F.countDistinct("id").alias("n"))
    said = F.when(page % 4 != 1, F.col("n") + F.when(page % 5 == 2, 1).otherwise(0))
    full = counted.select("page", (page % 11 != 3).alias("container"), said.alias("total"), F.lit(True).alias("dated"))
    empty = table(spark, sf, "region").select((-1 - k).alias("page"), F.lit(True).alias("container"), F.when(k != 4, F.lit(0).cast("long")).alias("total"), (k % 2 == 0).alias("dated"))
    claims = counted.select("page", "n", F.lit(10).alias("shown"), F.when(page % 7 == 5, 11).otherwise(10).alias("total"))
    return harvest.listing_problems(full.unionByName(empty), claims, entries)


SEARCHES = """s AS (SELECT event_type || '/' || user_id % 8 AS source, user_id % 8 AS k, user_id AS id, day(ts) AS d, event_type AS t FROM events),
  f AS (SELECT source, k, t, id, min(d) AS d FROM s GROUP BY ALL UNION SELECT source, k, t, id, d FROM s WHERE k = 3),
  p AS (SELECT DISTINCT source, k, t, id, CASE WHEN k = 5 THEN (d - 1) // 2 + 1 ELSE (d - 1) // 8 + 1 END AS page FROM f),
  mk AS (SELECT source, id FROM p WHERE id % 41 = 5 AND k IN (0, 5, 6) AND t <> (SELECT max(event_type) FROM events) UNION SELECT source, -1 FROM p WHERE k = 7),
  n AS (SELECT source, count(DISTINCT id) AS n FROM p GROUP BY 1),
  pg AS (SELECT DISTINCT source, page, CASE k WHEN 1 THEN NULL WHEN 2 THEN n + page % 2 WHEN 4 THEN n + 1 ELSE n END AS total FROM p JOIN n USING (source)),
  st AS (SELECT source, min(page) AS stop FROM p JOIN mk USING (source, id) GROUP BY 1),
  b AS (SELECT source, max(page) AS last, any_value(stop) AS stop, least(max(page), coalesce(any_value(stop), max(page)), 4) AS upto FROM p LEFT JOIN st USING (source) GROUP BY 1),
  i AS (SELECT source, count(*) AS shown, count(DISTINCT id) AS ids FROM p JOIN b USING (source) WHERE page <= upto GROUP BY 1),
  j AS (SELECT source, min(total) AS lo, max(total) AS hi, count(*) > count(total) AS unsaid FROM pg JOIN b USING (source) WHERE page <= upto GROUP BY 1),
  r AS (SELECT *, coalesce(stop <= upto, false) AS met, source IN (SELECT source FROM mk) AS has FROM b JOIN i USING (source) JOIN j USING (source))"""


@query(f"""WITH {SEARCHES} SELECT source, CAST(upto AS BIGINT) AS n_pages, met, CASE WHEN unsaid THEN 'no total' WHEN lo <> hi THEN 'total changed' WHEN shown > ids THEN 'repeated ids' WHEN met THEN NULL
  WHEN upto < last THEN 'too many pages' WHEN ids <> hi THEN 'total not reached' WHEN has THEN 'frontier not met' END AS error FROM r""")
def search_problems(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k, d, page = F.col("k"), F.col("d"), F.col("page")
    s = e.select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 8).cast("string")).alias("source"), (F.col("user_id") % 8).alias("k"), F.col("user_id").alias("id"), F.dayofmonth("ts").alias("d"), "event_type")
    firsts = s.groupBy("source", "k", "id", "event_type").agg(F.min("d").alias("d")).unionByName(s.where("k = 3"))
    at = F.floor((d - 1) / F.when(k == 5, 2).otherwise(8)) + 1
    shown = firsts.select("source", "k", "id", "event_type", at.alias("page")).distinct()
    n = shown.groupBy("source").agg(F.countDistinct("id").alias("n"))
    lists = shown.groupBy("source", "k", "page").agg(F.collect_list("id").alias("ids")).join(n, "source")
    total = F.when(k == 2, F.col("n") + page % 2).when(k == 4, F.col("n") + 1).when(k != 1, F.col("n"))
    last = F.broadcast(e.agg(F.max("event_type").alias("last")))  # one row
    met = shown.where("id % 41 = 5 and k in (0, 5, 6)").join(last, F.col("event_type") != F.col("last"), "left_semi").select("source", "id")
    never = shown.where("k = 7").select("source", F.lit(-1).cast("long").alias("id"))
    return harvest.search_problems(lists.select("source", "page", total.alias("total"), "ids"), met.unionByName(never), max_pages=4)


@query("""WITH e AS (SELECT c_custkey AS source, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
  SELECT source, CASE WHEN lo IS NULL OR lo > DATE '1995-09-01' THEN 'starts late' ELSE 'ends early' END AS error FROM e WHERE lo IS NULL OR lo > DATE '1995-09-01' OR hi < DATE '2001-01-15'""")
def coverage_problems(spark: SparkSession, sf: str) -> DataFrame:
    days = F.date_format("o_orderdate", "yyyy-MM-dd")
    seen = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.min(days).alias("earliest"), F.max(days).alias("latest"))
    evidence = table(spark, sf, "customer").select(F.col("c_custkey").alias("source")).join(seen, "source", "left")
    return harvest.coverage_problems(evidence, ("1995-09-01", "2001-08-01"), ("1995-09-01", "2001-08-01"), newest="2001-01-15")


@query(f"""WITH {listings.LISTED}, st AS (SELECT source, min(page * 64 + pos) AS stop FROM pg JOIN mk USING (source, id) GROUP BY 1), f AS (SELECT source, id, min(page * 64 + pos) AS spot FROM pg GROUP BY 1, 2),
  n AS (SELECT f.source, spot // 64 AS page, string_agg(CAST(id AS VARCHAR), ',' ORDER BY spot) AS ids, count(*) AS n FROM f LEFT JOIN st ON st.source = f.source WHERE stop IS NULL OR spot < stop GROUP BY 1, 2),
  fr AS (SELECT source, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS front FROM mk GROUP BY 1)
  SELECT n.source, 'frontier:' || left(sha256(coalesce(front, '')), 16) || ':page:' || page AS batch_key, sha256(sha256(n.source || '/' || page) || '|' || coalesce(front, '') || '|' || ids) AS payload_sha, n FROM n LEFT JOIN fr ON fr.source = n.source""")
def delta_batches(spark: SparkSession, sf: str) -> DataFrame:
    pages, marks = listings.listed(spark, sf)
    sha = F.sha2(F.concat_ws("/", "source", F.col("page").cast("string")), 256)
    return harvest.delta_batches(pages.withColumn("page_sha", sha), marks)


@query("""SELECT c_custkey AS id, c_custkey % 10 = 0 AS skipped, CASE WHEN c_custkey % 10 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'q' || c_custkey ELSE c_name || '  Ä.' END END AS query,
  CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 7 = 0 THEN 'hep' END AS archive FROM customer""")
def author_queries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("id"), F.concat("c_name", F.when(k % 10 == 0, " Collaboration").otherwise("  Ä.")).alias("name"))
    overrides = c.where("id % 7 = 0").select(F.concat(F.lit("  "), F.upper("name")).alias("name"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), F.lit("hep").alias("archive"))
    return harvest.author_queries(c, overrides)


@query("""SELECT 'role' AS rule, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 10 <> 0 UNION ALL SELECT 'no island', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT r, CAST(p_partkey AS VARCHAR) FROM part, (VALUES ('one island'), ('repeated island')) v(r) WHERE p_partkey % 4 = 2 UNION ALL SELECT r, CAST(p_partkey AS VARCHAR) FROM part, (VALUES ('one island'), ('primary first')) v(r) WHERE p_partkey % 4 = 3""")
def membership_problems(spark: SparkSession, sf: str) -> DataFrame:
    k, brand, other = F.col("p_partkey"), F.col("p_brand"), F.lit("other")
    islands = F.when(k % 4 == 0, F.array(brand)).when(k % 4 == 2, F.array(brand, brand)).when(k % 4 == 3, F.array(other, brand))
    role = lambda step: F.when(k % step == 0, "observation").otherwise(other)
    return validate.membership_problems(table(spark, sf, "part").select(k.alias("id"), role(5).alias("contribution"), role(10).alias("role"), brand.alias("primary"), islands.alias("islands")))


RUN = """v AS (SELECT d.doc_id AS id, n_chars % 5 AS version, sha256(coalesce(source, '')) AS digest, CASE WHEN d.doc_id % 13 = 0 THEN 'other' WHEN quality IS NOT NULL THEN sha256(coalesce(source, '')) END AS reviewed,
    CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 0 THEN 'excluded' ELSE 'ambiguous' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  c AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN n_chars % 5 - doc_id % 3 END AS published FROM documents WHERE doc_id % 2 = 0), h AS (SELECT id, version FROM v WHERE id % 3 = 0), lg AS (SELECT id, version, digest FROM v WHERE id % 4 = 0),
  w AS (SELECT v.* FROM v LEFT JOIN c ON c.id = v.id WHERE status = 'relevant' AND reviewed = digest AND (published IS NULL OR published < version)),
  g AS (SELECT (SELECT count(*) FROM v WHERE status = 'pending' OR reviewed IS NULL OR reviewed <> digest) AS pending, (SELECT count(*) FROM w WHERE (id, version) NOT IN (SELECT id, version FROM h)) AS unreferenced, (SELECT count(*) FROM w) AS unpublished,
    (SELECT count(*) FROM v WHERE status = 'ambiguous' AND reviewed = digest AND id NOT IN (SELECT id FROM lg)) AS unlogged, (SELECT count(*) FROM c WHERE published IS NULL OR (id, published) NOT IN (SELECT id, version FROM h)) AS unmapped,
    (SELECT count(*) FROM (SELECT DISTINCT user_id * 3 AS id FROM events) WHERE id NOT IN (SELECT id FROM v)) AS unhydrated)"""


@query(f"WITH {RUN} SELECT *, CASE WHEN pending + unhydrated > 0 THEN 'review' WHEN unreferenced > 0 THEN 'references' WHEN unmapped > 0 THEN 'mapped references' END AS first_failure FROM g")
def completion_reasons(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d, k = table(spark, sf, "documents").select("doc_id", "source", "n_chars"), F.col("doc_id")
    q, digest = F.col("quality"), F.sha2(F.coalesce("source", F.lit("")), 256)
    status = F.when(q.isNull(), "pending").when((q == 1) & (F.col("toxic") == 0), "relevant").when(q == 0, "excluded").otherwise("ambiguous")
    reviewed = F.when(k % 13 == 0, "other").when(q.isNotNull(), digest)
    v = d.join(labels, "doc_id", "left").select(k.alias("id"), (F.col("n_chars") % 5).alias("version"), digest.alias("digest"), reviewed.alias("reviewed"), status.alias("status"))
    c = d.where("doc_id % 2 = 0").select(k.alias("id"), F.when(k % 10 != 0, F.col("n_chars") % 5 - k % 3).alias("published"))
    found = table(spark, sf, "events").select((F.col("user_id") * 3).alias("id")).distinct()
    return validate.completion(v, c, v.where("id % 3 = 0"), found, v.where("id % 4 = 0"), F.lit(True))


@query(f"""WITH {citations.EDGES}, r AS (SELECT p_partkey AS id, p_partkey // 4096 AS block, sha256(p_partkey || '|' || p_brand || '|' || p_size || '|' || coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)), '')) AS sha
    FROM part LEFT JOIN edges ON src = p_partkey GROUP BY p_partkey, p_brand, p_size), b AS (SELECT block, count(*) AS n, sha256(string_agg(sha, '' ORDER BY id)) AS digest FROM r GROUP BY 1)
  SELECT block, n, digest FROM b UNION ALL SELECT -1, CAST(sum(n) AS BIGINT), sha256(string_agg(digest, '' ORDER BY block)) FROM b""")
def projection_digests(spark: SparkSession, sf: str) -> DataFrame:
    papers = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    return graph.projection_digests(papers, citations.edges(spark, sf))


@query(f"""WITH {citations.COUNTS}, m AS (SELECT id, mode, CASE WHEN mode = 'citations' THEN sqrt(196 + 1740 * least(1, ln(1 + n) / ln(65))) WHEN id % 9 = 0 THEN 28 ELSE 16 END AS d FROM counts, (VALUES ('uniform'), ('citations')) v(mode))
  SELECT id, mode, round(d, 6) AS diameter, round((d / 2 + 5) * 1.12, 6) AS radius FROM m""")
def map_radii(spark: SparkSession, sf: str) -> DataFrame:
    counts = graph.incoming_counts(citations.edges(spark, sf), citations.papers(spark, sf))
    rows = counts.select("id", "n", F.explode(F.array(F.lit("uniform"), F.lit("citations"))).alias("mode"))
    d = numbers.map_diameter(F.col("mode"), F.col("id") % 9 == 0, F.col("n"))
    return rows.select("id", "mode", F.round(d, 6).alias("diameter"), F.round(numbers.collision_radius(d), 6).alias("radius"))


@query(f"""WITH {citations.EDGES} SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY p_size, p_partkey) AS ids FROM edges JOIN part ON p_partkey = src GROUP BY 1""")
def cited_by_position(spark: SparkSession, sf: str) -> DataFrame:
    order = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.struct("p_size", "p_partkey").alias("pos"))
    return graph.cited_by(citations.edges(spark, sf), order).select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT o_orderkey AS id, coalesce(CAST(u AS VARCHAR), CAST(s AS VARCHAR), '') AS at FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS s, CAST(max(l_shipdate) AS DATE) AS u
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY o_orderkey, o_orderdate) ORDER BY 2, 1 LIMIT 200""")
def oldest_first(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda c: F.to_date(c).cast("string")
    updated = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("id")).agg(day(F.max("l_shipdate")).alias("updated"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 != 0, day("o_orderdate")).alias("submitted"))
    at = F.coalesce("updated", "submitted", F.lit("")).alias("at")
    return o.join(updated, "id", "left").select("id", at).orderBy("at", "id").limit(200)  # a run reviews two hundred
