"""What the readers make of files: catalogues, candidate logs, run manifests, id lists and manual snapshots, each written from
the tables as documents of a bounded size; and small rules of addresses and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import dates, text
from folioscope.operators import layout, search
from folioscope.plans import maps
from folioscope.registry import query
from folioscope.session import fresh_path, table
from folioscope.sources import readers

SIZE = 500  # rows of a document


def documents(rows: DataFrame, key: str, body: Column, name: str) -> str:
    """A folder with one file for each SIZE values of ``key``; ``body`` makes a document of ``xs``, the rows in order."""
    path = fresh_path(rows.sparkSession, name)
    doc = F.floor(F.col(key) / SIZE).alias("doc")
    lists = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c != key]))).alias("xs"))
    lists.select("doc", body.alias("value")).repartition("doc").write.partitionBy("doc").text(path)
    return path


def listed(**fields) -> Column:
    """A JSON array of the rows in ``xs``, each with these fields."""
    return F.transform("xs", lambda x: F.struct(*[f(x).alias(n) for n, f in fields.items()]))


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY p_partkey // {SIZE} ORDER BY p_partkey) - 1 AS INTEGER) AS pos, p_name || ' "é"' AS title, p_size AS rank,
  p_brand || '|' || p_type AS tags, CAST(p_retailprice AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS summary FROM part""")
def catalogue_documents(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type", F.col("p_retailprice").cast("double").alias("price"))
    papers = listed(
        id=lambda x: x["p_partkey"].cast("string"), title=lambda x: F.concat(x["p_name"], F.lit(' "é"')), layoutRank=lambda x: x["p_size"],
        tags=lambda x: F.array(x["p_brand"], x["p_type"]), x=lambda x: x["price"], other=lambda x: F.lit("not read"),
    )
    path = documents(p, "p_partkey", F.to_json(F.struct(F.lit(2).alias("schemaVersion"), papers.alias("papers"))), "catalogues")
    return readers.papers(spark, path).select("id", "pos", "title", F.col("layoutRank").alias("rank"), F.array_join("tags", "|").alias("tags"), "x", "summary")


@query("""WITH c AS (SELECT d.doc_id AS k, CASE WHEN d.doc_id % 13 = 5 THEN 'x' ELSE '2401.' || lpad(CAST(d.doc_id % 100000 AS VARCHAR), 5, '0') END AS id, d.doc_id % 9 AS version,
    CASE WHEN d.doc_id % 7 = 3 THEN 'short' ELSE sha256(coalesce(source, '')) END AS digest, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 0 THEN 'excluded' ELSE 'relevant' END AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
  SELECT k, id, CAST(version AS INTEGER) AS version, status, CASE WHEN id = 'x' THEN 'id' WHEN version = 0 THEN 'version' WHEN digest = 'short' THEN 'digest' WHEN status = 'unknown' THEN 'status' END AS error FROM c""")
def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    k, q = F.col("doc_id"), F.col("quality")
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    d = d.select(
        "doc_id", F.when(k % 13 == 5, "x").otherwise(F.concat(F.lit("2401."), F.lpad((k % 100000).cast("string"), 5, "0"))).alias("id"), (k % 9).cast("int").alias("version"),
        F.when(k % 7 == 3, "short").otherwise(F.sha2(F.coalesce("source", F.lit("")), 256)).alias("digest"), F.when(q.isNull(), "unknown").when(q == 0, "excluded").otherwise("relevant").alias("status"),
    )
    rows = listed(arxivId=lambda x: x["id"], version=lambda x: x["version"], metadataSha256=lambda x: x["digest"], status=lambda x: x["status"], title=lambda x: x["doc_id"].cast("string"))
    path = documents(d, "doc_id", F.to_json(F.struct(rows.alias("candidates"))), "candidates")
    return readers.candidate_log(spark, path).select(F.col("title").cast("long").alias("k"), F.col("arxivId").alias("id"), "version", "status", "error")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT strftime(day, '%Y-%m-%d') AS window, day(day) % 3 <> 0 AS zoned, event_type AS status, n FROM d""")
def run_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest a day, whose tallies are read from the document itself, whatever statuses it has."""
    e = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").count()
    tallies = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count"))))
    at = F.concat(F.col("day").cast("string"), F.lit("T10:00:00"), F.when(F.dayofmonth("day") % 3 != 0, "Z").otherwise(""))
    days = e.groupBy("day").agg(tallies.alias("m"))
    runs = days.select(F.lit(3).alias("schemaVersion"), at.alias("runAt"), F.col("day").cast("string").alias("scanWindow"), F.struct(F.col("m").alias("tallies")).alias("counts"))
    named = fresh_path(spark, "manifests")
    runs.write.option("maxRecordsPerFile", 1).json(named)
    read = readers.manifests(spark, named)
    told = F.explode(F.try_variant_get("body", "$.counts.tallies", "map<string, bigint>")).alias("status", "n")
    return read.select(F.col("scanWindow").alias("window"), F.col("at").isNotNull().alias("zoned"), told)


@query("""SELECT DISTINCT 'array' AS kind, c_name AS id FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT 'object', c_name FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT DISTINCT 'lines', c_name FROM customer WHERE c_custkey % 3 = 2""")
def listed_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    twice = F.transform(F.concat("xs", "xs"), lambda x: x["c_name"])
    forms = {
        "array": F.to_json(twice), "object": F.to_json(F.struct(twice.alias("ids"))),
        "lines": F.concat(F.lit("\n  "), F.array_join(F.transform(twice, lambda n: F.concat(n, F.lit("  "))), "\n"), F.lit("\n")),
    }
    found = [readers.id_list(spark, documents(c.where(F.col("c_custkey") % 3 == k), "c_custkey", body, "ids")).select(F.lit(kind).alias("kind"), "id") for k, (kind, body) in enumerate(forms.items())]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH s AS (SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_suppkey % 20) AS d FROM lineitem GROUP BY 1)
  SELECT CAST(k AS VARCHAR) AS id, n AS n_references, CASE WHEN k % 5 = 0 THEN 'incomplete' WHEN k % 7 = 0 THEN 'version' WHEN n <> d THEN 'references' END AS error FROM s""")
def manual_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey")
    refs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_suppkey") % 20).cast("string")).alias("refs"))
    rows = listed(arxivId=lambda x: x["l_orderkey"].cast("string"), version=lambda x: x["version"], complete=lambda x: x["complete"], references=lambda x: x["refs"])
    marked = refs.select("l_orderkey", F.when(k % 7 == 0, 0).otherwise(1).alias("version"), (k % 5 != 0).alias("complete"), "refs")
    path = documents(marked, "l_orderkey", F.to_json(F.struct(rows.alias("snapshots"))), "snapshots")
    return readers.manual_snapshots(spark, path).select(F.col("arxivId").alias("id"), F.size("references").cast("long").alias("n_references"), "error")


@query("""WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders),
  r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN low ELSE CAST(o_orderdate AS DATE) END AS s, high AS e, low, high FROM orders, b)
  SELECT id, CASE WHEN s = low AND e = high THEN '' ELSE 'from=' || strftime(s, '%Y-%m-%d') || '&to=' || strftime(e, '%Y-%m-%d') END AS params, s AS start, e AS stop,
    CASE id % 4 WHEN 0 THEN low WHEN 1 THEN low WHEN 2 THEN s ELSE least(s, DATE '1996-01-01') END AS read_start, CASE id % 4 WHEN 0 THEN high WHEN 1 THEN s WHEN 2 THEN high ELSE greatest(s, DATE '1996-01-01') END AS read_stop FROM r""")
def range_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges as URL parameters and back, and what is read from parameters that are absent, out of bounds or in the wrong order."""
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d")).crossJoin(F.broadcast(search.date_bounds(o, "o_orderdate")))  # one row
    k, low, high = F.col("id"), F.col("low"), F.col("high")
    s = F.when(k % 3 == 0, low).otherwise(F.col("d"))
    day = F.date_format(s, "yyyy-MM-dd")
    odd = (
        F.when(k % 4 == 0, "from=1996-02-30&to=").when(k % 4 == 1, F.concat(F.lit("q=from&to="), day, F.lit("&from=1700-01-01")))
        .when(k % 4 == 2, F.concat(F.lit("to=2999-01-01&from="), day)).otherwise(F.concat(F.lit("from="), day, F.lit("&to=1996-01-01")))
    )
    params = dates.range_query(s, high, low, high)
    back, read = dates.range_of_query(params, low, high), dates.range_of_query(odd, low, high)
    return rows.select("id", params.alias("params"), back["start"].alias("start"), back["end"].alias("stop"), read["start"].alias("read_start"), read["end"].alias("read_stop"))


@query(f"""WITH {maps.PTS}, p AS (SELECT id, x * 100 AS dx, y * 100 AS dy, 6 + grp AS clear FROM pts), o AS (SELECT *, dx - greatest(-8, least(dx, 8)) AS ox, dy - greatest(-5, least(dy, 5)) AS oy FROM p),
  w AS (SELECT *, sqrt(ox * ox + oy * oy) AS far, 8 + clear + dx AS a, 8 + clear - dx AS b, 5 + clear + dy AS c, 5 + clear - dy AS d FROM o)
  SELECT id, round(CASE WHEN far > 1e-6 THEN CASE WHEN far < clear THEN ox * (clear - far) / far ELSE 0 END WHEN a <= least(b, c, d) THEN -a WHEN b <= least(c, d) THEN b ELSE 0 END, 6) + 0.0::DOUBLE AS x,
    round(CASE WHEN far > 1e-6 THEN CASE WHEN far < clear THEN oy * (clear - far) / far ELSE 0 END WHEN a <= least(b, c, d) OR b <= least(c, d) THEN 0 WHEN c <= d THEN -c ELSE d END, 6) + 0.0::DOUBLE AS y FROM w""")
def label_exits(spark: SparkSession, sf: str) -> DataFrame:
    p = maps.points(spark, sf)
    move = layout.exit_columns(F.col("x") * 100, F.col("y") * 100, 8.0, 5.0, 6.0 + F.col("group"))
    return p.select("id", *[(F.round(move[c], 6) + 0.0).alias(c) for c in ("x", "y")])


@query("""SELECT o_orderkey AS id, 'https://arxiv.org/catchup/' || lower(c_mktsegment) || '/' || strftime(o_orderdate, '%Y-%m-%d') AS url FROM orders JOIN customer ON c_custkey = o_custkey""")
def catch_up_addresses(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("id"), text.catch_up_url("https://arxiv.org/catchup", F.lower("c_mktsegment"), F.to_date("o_orderdate")).alias("url"))
