"""Search, facets, dates and row-level text rules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import dates, text
from folioscope.operators import search
from folioscope.registry import query
from folioscope.session import ensure_workers, table

NORM = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    ensure_workers(spark)  # texts go to Python in small batches
    return table(spark, sf, "documents")


@query(f"SELECT doc_id, length({NORM.format('text')}) AS chars, sha256({NORM.format('text')}) AS digest FROM documents")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", text.search_text("text").alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query(f"""SELECT d.doc_id, sha256({NORM.format("concat_ws(' ', text, source, lang, l.quality)")}) AS with_terms, sha256({NORM.format('text')}) AS without
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def search_text_variant(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("q")), "doc_id", "left")
    a, b = text.search_text("text", "source", "lang", "q"), text.search_text("text")
    return d.select("doc_id", F.sha2(a, 256).alias("with_terms"), F.sha2(b, 256).alias("without"))


@query(f"SELECT doc_id FROM documents WHERE contains({NORM.format('text')}, 'an the')")
def search_contains(spark: SparkSession, sf: str) -> DataFrame:
    # the reader's query passes the same normalisation as the text
    return docs(spark, sf).where(search.text_hit(text.search_text("text"), "an the")).select("doc_id")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("island"), F.col("o_orderpriority").alias("contribution"),
        F.to_date("o_orderdate").alias("published"), F.col("c_name").alias("text"),
    )


WINDOW = (date(1995, 3, 1), date(1997, 6, 30))
IN_WINDOW = "CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1997-06-30'"


@query(f"""SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE {IN_WINDOW}
  AND c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)""")
def search_conjunctive(spark: SparkSession, sf: str) -> DataFrame:
    segment = table(spark, sf, "customer").agg(F.min("c_mktsegment")).first()[0]
    priority = table(spark, sf, "orders").agg(F.min("o_orderpriority")).first()[0]
    return search.filter_catalog(orders(spark, sf), island=segment, contribution=priority, window=WINDOW).select("id")


@query(f"""SELECT p.v AS value, count(o.id) AS n FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) p LEFT JOIN
  (SELECT o_orderkey AS id, o_orderpriority AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE {IN_WINDOW}
   AND c_mktsegment = (SELECT min(c_mktsegment) FROM customer)) o ON o.v = p.v GROUP BY 1""")
def facet_contribution(spark: SparkSession, sf: str) -> DataFrame:
    segment = table(spark, sf, "customer").agg(F.min("c_mktsegment")).first()[0]
    rows = search.filter_catalog(orders(spark, sf), island=segment, window=WINDOW)  # not the facet's own filter
    values = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("value")).distinct()
    return search.facet_counts(rows, "contribution", values)


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def facet_category_all(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return search.facet_counts(p, "p_brand", p.select(F.col("p_brand").alias("value")).distinct())


@query("SELECT CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, count(*) AS n FROM orders GROUP BY 1")
def day_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return search.day_histogram(table(spark, sf, "orders"), "o_orderdate")


@query("SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders")
def date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return search.date_bounds(table(spark, sf, "orders"), "o_orderdate")


@query("""WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders),
  r AS (SELECT o_orderkey AS id, greatest(least(CAST(o_orderdate AS DATE) + 400, high), low) AS a,
    CASE WHEN o_orderkey % 4 = 0 THEN high ELSE greatest(least(CAST(o_orderdate AS DATE) - 30, high), low) END AS z FROM orders, b)
  SELECT id, least(a, z) AS range_start, greatest(a, z) AS range_end FROM r""")
def date_window_normalised(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    bounds = F.broadcast(search.date_bounds(table(spark, sf, "orders"), "o_orderdate"))  # one row
    end = F.when(F.col("id") % 4 != 0, F.date_sub("d", 30))
    a, z = dates.normalize_range(F.date_add("d", 400), end, F.col("low"), F.col("high"))
    return o.crossJoin(bounds).select("id", a.alias("range_start"), z.alias("range_end"))


@query("""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%-d')
    WHEN 2 THEN strftime(o_orderdate, '%Y-02-3') || CAST(o_orderkey % 3 AS VARCHAR) WHEN 3 THEN '00' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%y') END AS raw FROM orders)
  SELECT id, raw, CASE WHEN regexp_full_match(raw, '\\d{4}-\\d{2}-\\d{2}') AND raw >= '0100' THEN try_cast(raw AS DATE) END AS iso,
    CASE WHEN regexp_full_match(raw, '\\d{2}/\\d{2}/\\d{2}') THEN try_cast('20' || raw[7:8] || '-' || raw[4:5] || '-' || raw[1:2] AS DATE) END AS dmy FROM s""")
def strict_dates(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(k % 5 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 5 == 1, F.date_format(d, "yyyy-M-d"))
        .when(k % 5 == 2, F.concat(F.date_format(d, "yyyy"), F.lit("-02-3"), (k % 3).cast("string")))
        .when(k % 5 == 3, F.concat(F.lit("00"), F.date_format(d, "yy-MM-dd")))
        .otherwise(F.date_format(d, "dd/MM/yy"))
    )
    rows = table(spark, sf, "orders").select(k.alias("id"), raw.alias("raw"))
    return rows.select("id", "raw", dates.strict_iso(F.col("raw")).alias("iso"), dates.day_month_year(F.col("raw")).alias("dmy"))


@query("""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) - CAST(greatest(isodow(o_orderdate) - 5, 0) AS INTEGER) AS announced FROM orders""")
def weekend_rollback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), dates.announcement_day(F.to_date("o_orderdate")).alias("announced"))


@query("""WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders)
  SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, strftime(o_orderdate, '%d/%m/%Y') AS shown,
    CAST(o_orderdate AS DATE) = low AND CAST(o_orderdate AS DATE) = high AS full_range, least(high, CAST(o_orderdate AS DATE)) - 2 AS overlap_start,
    strftime(o_orderdate, '%Y-%m-%d') AS prefix, CAST(o_orderdate AS DATE) AS parsed FROM orders, b""")
def date_format_index(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), F.col("o_orderdate").alias("at"))
    o = o.crossJoin(F.broadcast(search.date_bounds(table(spark, sf, "orders"), "o_orderdate")))
    return o.select(
        "id", dates.day_index(F.col("d")).cast("long").alias("day"), dates.show_date(F.col("d")).alias("shown"),
        dates.is_full_range(F.col("d"), F.col("d"), F.col("low"), F.col("high")).alias("full_range"),
        dates.overlap_start(F.col("high"), F.col("d")).alias("overlap_start"), F.col("at").cast("string").substr(1, 10).alias("prefix"),
        dates.long_date(F.date_format("d", "EEEE, d MMMM yyyy")).alias("parsed"),
    )


PHRASES = ("and the", "the that", "of in", "der die", "un mente", "les des", "with an")


@query("""WITH t AS (SELECT doc_id, replace(lower(coalesce(text, '')), '--', '-') AS t FROM documents)
  SELECT doc_id FROM t WHERE (contains(t, 'license') OR regexp_matches(t, '\\bis\\b')) AND (""" + " OR ".join(f"contains(t, '{p}')" for p in PHRASES) + ")")
def relevance_rule(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where(text.relevance(F.coalesce("text", F.lit("")), "license", "is", PHRASES)).select("doc_id")


@query("""SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'needs-review' WHEN (quality * 60 + (1 - toxic) * 40) / 100.0 >= 0.78 THEN 'included'
  WHEN quality = 0 THEN 'excluded' ELSE 'needs-review' END AS route FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def threshold_routing(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    confidence = (F.col("quality") * 60 + (1 - F.col("toxic")) * 40) / 100.0
    route = F.when(confidence.isNull(), "needs-review").when(confidence >= 0.78, "included").when(F.col("quality") == 0, "excluded")
    return d.select("doc_id", route.otherwise("needs-review").alias("route"))


@query("""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def alias_match(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", F.lower("text").alias("t"))
    return search.matching(d, table(spark, sf, "benchmark").select("item_id", F.lower("text").alias("a")))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || n_chars || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS digest FROM documents""")
def canonical_digest(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2(text.canonical_json("doc_id", "lang", "source", "n_chars"), 256).alias("digest"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || '}') AS digest,
  left(sha256(coalesce(text, '')), 16) AS short_digest FROM documents""")
def volatile_digest(spark: SparkSession, sf: str) -> DataFrame:
    lasting = docs(spark, sf).drop("source", "n_chars")
    return lasting.select(
        "doc_id", F.sha2(text.canonical_json("doc_id", "lang"), 256).alias("digest"),
        F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("short_digest"),
    )


@query("""SELECT doc_id, source, length(CASE WHEN length(text) <= 158 THEN text ELSE regexp_replace(substr(text, 1, 157), '\\s+\\S*$', '') || '…' END) AS shown,
  array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS head FROM documents ORDER BY doc_id LIMIT 12""")
def capped_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).orderBy("doc_id").limit(12)  # the report shows twelve rows
    return d.select(
        "doc_id", "source", F.length(text.truncate_words(F.col("text"))).cast("long").alias("shown"),
        F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("head"),
    )


@query("""SELECT c_custkey AS id, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS author_key FROM customer""")
def author_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), text.author_key("c_name").alias("author_key"))


@query("""SELECT c_custkey AS id, regexp_matches(c_name, '(?i)\\bcustomer#\\d*5\\b') AS skipped, c_mktsegment FROM customer""")
def author_skip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").rlike(r"(?i)\bcustomer#\d*5\b").alias("skipped"), "c_mktsegment")


@query("""WITH a AS (SELECT conv_id, list(w ORDER BY turn) AS names FROM (SELECT conv_id, turn, trim(split_part(coalesce(text, ''), ' ', 1)) AS w FROM conversations) WHERE w <> '' GROUP BY 1)
  SELECT conv_id, CASE WHEN len(names) = 1 THEN names[1] WHEN len(names) = 2 OR (len(names) <= 4 AND length(array_to_string(names, ', ')) <= 80)
    THEN array_to_string(names, ', ') ELSE names[1] || ' et al.' END AS label FROM a""")
def author_label(spark: SparkSession, sf: str) -> DataFrame:
    word = F.trim(F.get(F.split(F.coalesce("text", F.lit("")), " "), F.lit(0)))
    c = table(spark, sf, "conversations").select("conv_id", "turn", word.alias("w")).where("w <> ''")
    names = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "w"))).alias("xs"))
    return names.select("conv_id", text.author_label(F.transform("xs", lambda x: x["w"])).alias("label"))


@query("""WITH p AS (SELECT p_partkey AS id, trim(regexp_replace(p_name || ' and ' || p_type, '\\s+', ' ', 'g')) AS t, p_brand FROM part),
  s AS (SELECT id, t, p_brand, string_split(t, ' ') AS w FROM p),
  o AS (SELECT id, i, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i+1:], ' ') AS b FROM s, range(1, 30) r(i) WHERE i < len(w)),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY greatest(length(a), length(b)), CASE WHEN regexp_matches(b, '^(?i)(?:&|and\\b|or\\b)') THEN 1 ELSE 0 END, abs(length(a) - length(b)), i) AS rn FROM o)
  SELECT s.id, CASE WHEN len(w) < 2 OR length(t) * 7.4 + 8 <= 168 THEN t ELSE a || chr(10) || b END AS lines, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE 'rest' END AS kind
  FROM s LEFT JOIN k ON k.id = s.id AND rn = 1""")
def label_wrap(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" and "), "p_type").alias("t"), "p_brand")
    kinds = {"Brand#11": "first", "Brand#12": "second", "other": "rest"}
    return p.select("id", F.array_join(text.wrap_label(F.col("t")), "\n").alias("lines"), text.enum_label(F.col("p_brand"), kinds).alias("kind"))


@query(r"""WITH s AS (SELECT doc_id, coalesce(text, '') || ' arXiv:2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') || 'v2' AS t, trim(regexp_replace(text, '^\s*\[[^\]]+\]\s*', '')) AS b FROM documents)
  SELECT doc_id, array_to_string(list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(t, '(?i)(?:^|[^a-z0-9.\-])(\d{4}\.\d{4,5}|[a-z][a-z0-9.\-]+/\d{7})(?:v\d+)?(?:[^a-z0-9/]|$)', 1)])), ',') AS ids,
    CASE WHEN regexp_matches(b, '^(?i)cited by:') THEN false ELSE b IS NOT NULL AND b <> '' END AS substantive FROM s""")
def id_extract_lookaround(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" arXiv:2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0"), F.lit("v2"))
    rows = docs(spark, sf).select("doc_id", text.bare_ids(said).alias("ids"), text.is_substantive(F.col("text")).alias("substantive"))
    return rows.select("doc_id", F.array_join("ids", ",").alias("ids"), "substantive")


SPLITS = """p AS (SELECT p_partkey AS id, trim(regexp_replace(p_name || ' and ' || p_type, '\\s+', ' ', 'g')) AS t, p_brand FROM part), s AS (SELECT id, t, p_brand, string_split(t, ' ') AS w FROM p),
  o AS (SELECT id, min(greatest(length(array_to_string(w[1:i], ' ')), length(array_to_string(w[i+1:], ' ')))) AS widest FROM s, range(1, 30) r(i) WHERE i < len(w) GROUP BY 1)"""


@query(f"""WITH {SPLITS} SELECT s.id, round(greatest(92, 7.4 * CASE WHEN len(w) < 2 OR length(t) * 7.4 + 8 <= 168 THEN length(t) ELSE widest END + 8, length(p_brand) * 5.5 + 8), 6)::DOUBLE AS width,
  CASE WHEN len(w) < 2 OR length(t) * 7.4 + 8 <= 168 THEN 34 ELSE 50 END::DOUBLE AS height FROM s LEFT JOIN o ON o.id = s.id""")
def label_box(spark: SparkSession, sf: str) -> DataFrame:
    box = text.label_box(F.concat("p_name", F.lit(" and "), "p_type"), F.col("p_brand")).alias("b")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), box).select("id", F.round("b.width", 6).alias("width"), "b.height")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(CAST(o_orderdate AS TIMESTAMP) + (CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 0 ELSE -9 END) * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS submitted,
  o_orderkey % 2 = 0 AS zoned FROM orders""")
def submission_second(spark: SparkSession, sf: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    zone = F.when(k % 4 == 0, " -0500").when(k % 4 == 1, " UTC").when(k % 4 == 2, " +0900").otherwise("")
    said = F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm:ss"), zone)
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "+02:00").otherwise(""))
    return table(spark, sf, "orders").select(k.alias("id"), dates.submission_second(said).alias("submitted"), dates.instant(iso).isNotNull().alias("zoned"))


@query("""WITH known AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand <> 'Brand#11'), l AS (SELECT p_partkey AS id, p_brand, unnest(range(5)) AS pos,
    unnest(['Brand#11', 'Brand#' || (p_partkey % 5 + 1) || (p_partkey % 5 + 1), 'Brand#' || (p_partkey % 3 + 2) || '3', 'nowhere', 'Brand#' || (p_partkey % 4 + 1) || '2']) AS m FROM part),
  f AS (SELECT id, p_brand, m, min(pos) AS pos FROM l GROUP BY ALL), k AS (SELECT id, m, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM f JOIN known ON v = m WHERE m <> p_brand)
  SELECT p_partkey AS id, any_value(p_brand) || coalesce(string_agg('|' || m, '' ORDER BY pos), '') AS islands FROM part LEFT JOIN k ON k.id = p_partkey AND rn <= 2 GROUP BY p_partkey""")
def known_membership(spark: SparkSession, sf: str) -> DataFrame:
    """The primary island, then up to two others that are known and aren't the observation (here Brand#11)."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    brand = lambda a, b: F.concat(F.lit("Brand#"), a.cast("string"), b.cast("string") if not isinstance(b, str) else F.lit(b))
    listed = F.array(F.lit("Brand#11"), brand(k % 5 + 1, k % 5 + 1), brand(k % 3 + 2, "3"), F.lit("nowhere"), brand(k % 4 + 1, "2"))
    rows = p.select(k.alias("id"), "p_brand", F.posexplode(F.array_distinct(listed)).alias("pos", "m"))
    known = p.select(F.col("p_brand").alias("m")).distinct().where("m <> 'Brand#11'")
    kept = rows.join(known, "m").where("m <> p_brand").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("xs"))
    others = F.transform(F.slice("xs", 1, 2), lambda x: x["m"])
    joined = p.select(k.alias("id"), "p_brand").join(kept, "id", "left")
    return joined.select("id", F.array_join(F.concat(F.array("p_brand"), F.coalesce(others, F.array().cast("array<string>"))), "|").alias("islands"))
