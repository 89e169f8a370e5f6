"""Citation graph: papers are parts, a line item is a citation from its order key to its part key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import numbers
from folioscope.operators import graph
from folioscope.operators.scan import scan
from folioscope.registry import query
from folioscope.session import materialize, table


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def cites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def edges(spark: SparkSession, sf: str, distinct: bool = True) -> DataFrame:
    return graph.mapped_edges(cites(spark, sf), papers(spark, sf), distinct)


EDGES = """edges AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem
  WHERE l_orderkey <> l_partkey AND l_orderkey IN (SELECT p_partkey FROM part) AND l_partkey IN (SELECT p_partkey FROM part))"""
COUNTS = f"""{EDGES}, counts AS (SELECT p_partkey AS id, count(src) AS n FROM part LEFT JOIN edges ON dst = p_partkey GROUP BY 1)"""


@query(f"WITH {COUNTS} SELECT id, n FROM counts")
def reverse_citations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.incoming_counts(edges(spark, sf), papers(spark, sf))


@query("""SELECT p_partkey AS id, count(l_orderkey) AS n FROM part
  LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT p_partkey FROM part)) ON l_partkey = p_partkey GROUP BY 1""")
def reverse_citations_raw(spark: SparkSession, sf: str) -> DataFrame:
    return graph.incoming_counts(edges(spark, sf, distinct=False), papers(spark, sf))


@query(f"WITH {EDGES} SELECT count(*) AS n_edges FROM edges")
def edge_count(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).agg(F.count("*").alias("n_edges"))


@query(f"WITH {EDGES} SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS cited_by FROM edges GROUP BY 1")
def citation_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = graph.cited_by(edges(spark, sf))
    return lists.select("id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("cited_by"))


@query(f"""WITH {COUNTS}, d AS (SELECT id, n, sqrt(196 + 1740 * least(1.0, ln(1 + n) / ln(65))) AS diameter FROM counts)
  SELECT id, n, round(diameter, 6) AS diameter, round((diameter / 2 + 5) * 1.12, 6) AS radius FROM d""")
def citation_diameter(spark: SparkSession, sf: str) -> DataFrame:
    counts = graph.incoming_counts(edges(spark, sf), papers(spark, sf))
    sized = counts.withColumn("d", numbers.citation_diameter(F.col("n")))
    return sized.select("id", "n", F.round("d", 6).alias("diameter"), F.round(numbers.collision_radius(F.col("d")), 6).alias("radius"))


# Versions: a paper is a user, its version the number of its events of a kind.
VERSIONS = f"""kinds AS (SELECT min(event_type) AS lo, max(event_type) AS hi FROM events),
observed AS (SELECT user_id AS id, CAST(count(*) FILTER (event_type = lo) AS BIGINT) AS version FROM events, kinds GROUP BY 1),
catalogue AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 19 END AS version FROM customer WHERE c_custkey IN (SELECT user_id FROM events)),
heads AS (SELECT user_id AS id, CAST(count(*) FILTER (event_type = hi) AS BIGINT) AS version FROM events, kinds GROUP BY 1 HAVING count(*) FILTER (event_type = hi) > 12),
joined AS (SELECT c.id, nullif(greatest(coalesce(c.version, -1), coalesce(o.version, -1)), -1) AS expected, h.version AS newest
  FROM catalogue c LEFT JOIN observed o USING (id) LEFT JOIN heads h USING (id)),
status AS (SELECT id, expected, newest, CASE WHEN expected IS NULL THEN 'unknown' WHEN newest IS NULL THEN 'missing'
  WHEN newest = expected THEN 'exact' ELSE 'stale' END AS status FROM joined)"""


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalogue, observed, heads), each (id, version)."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type")
    kinds = F.broadcast(events.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")))  # one row
    both = events.crossJoin(kinds).groupBy("id").agg(
        F.sum(F.when(F.col("event_type") == F.col("lo"), 1).otherwise(0)).alias("seen"),
        F.sum(F.when(F.col("event_type") == F.col("hi"), 1).otherwise(0)).alias("head"),
    )
    both = materialize(both, "versions")  # a row a paper; read three times, the events once
    key = F.col("c_custkey")
    catalogue = (
        table(spark, sf, "customer")
        .select(key.alias("id"), F.when(key % 7 != 0, key % 19).alias("version"))
        .join(both.select("id"), "id", "left_semi")
    )
    return catalogue, both.select("id", F.col("seen").alias("version")), both.where("head > 12").select("id", F.col("head").alias("version"))


def status(spark: SparkSession, sf: str) -> DataFrame:
    return graph.snapshot_status(*versions(spark, sf))


@query(f"WITH {VERSIONS} SELECT id, expected FROM joined")
def expected_version(spark: SparkSession, sf: str) -> DataFrame:
    return status(spark, sf).select("id", "expected")


@query(f"WITH {VERSIONS} SELECT id, expected, status, newest FROM status")
def snapshot_status(spark: SparkSession, sf: str) -> DataFrame:
    return status(spark, sf)


@query(f"""WITH {VERSIONS} SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem JOIN status s ON s.id = l_orderkey
  WHERE s.status = 'exact' AND l_orderkey <> l_partkey AND l_partkey IN (SELECT id FROM status)""")
def mapped_citations(spark: SparkSession, sf: str) -> DataFrame:
    st = materialize(status(spark, sf), "status")  # read three times
    refs = cites(spark, sf).select(F.col("src").alias("id"), F.col("dst").alias("ref"))
    refs = refs.join(st.select("id", F.col("expected").alias("version")), "id")
    return graph.mapped_citations(st, refs).select("src", "dst")


@query(f"""WITH {VERSIONS}, w AS (SELECT id, expected AS version FROM status WHERE status IN ('missing', 'stale')
  UNION SELECT id, version FROM catalogue WHERE id % 3 = 0 UNION SELECT id, CAST(NULL AS BIGINT) FROM catalogue WHERE id % 5 = 0)
  SELECT id, version FROM w WHERE version IS NOT NULL OR id NOT IN (SELECT id FROM w WHERE version IS NOT NULL)""")
def missing_targets(spark: SparkSession, sf: str) -> DataFrame:
    catalogue, observed, heads = versions(spark, sf)
    catalogue = materialize(catalogue, "catalogue")  # read three times
    explicit = catalogue.where("id % 5 = 0").select("id", F.lit(None).cast("long").alias("version"))
    return graph.reference_targets(graph.snapshot_status(catalogue, observed, heads), catalogue.where("id % 3 = 0"), explicit)


@query(f"""WITH {VERSIONS}, w AS (SELECT id, expected AS version FROM status WHERE status IN ('missing', 'stale')
  UNION SELECT id, version FROM catalogue WHERE id % 3 = 0 UNION SELECT id, CAST(NULL AS BIGINT) FROM catalogue WHERE id % 5 = 0),
  t AS (SELECT id, version FROM w WHERE version IS NOT NULL OR id NOT IN (SELECT id FROM w WHERE version IS NOT NULL))
  SELECT id, version, row_number() OVER (ORDER BY id, coalesce(version, -1)) AS place FROM t""")
def target_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each target in the order in which they are fetched: by id, those without a version first."""
    targets = missing_targets(spark, sf).withColumn("at", F.coalesce("version", F.lit(-1)))
    return scan(targets, [], ["id", "at"], {"place": ("count", F.lit(1))}).drop("at")


@query(f"""WITH {VERSIONS} SELECT count(*) AS papers, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'stale') AS stale,
  count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unknown') AS unknown, bool_and(status = 'exact') AS complete FROM status""")
def snapshot_append(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return status(spark, sf).agg(
        F.count("*").alias("papers"), n("exact"), n("stale"), n("missing"), n("unknown"), F.bool_and(F.col("status") == "exact").alias("complete")
    )


@query("""SELECT l_orderkey AS id, string_agg(p_brand, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS brands FROM
  (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 25) GROUP BY 1""")
def fan_out_lookup(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("x")
    )
    wanted = lines.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    wanted = wanted.select("id", F.transform("xs", lambda x: x["l_partkey"]).alias("list"))
    values = table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value"))
    return graph.fan_out(values, wanted).select("id", F.array_join("values", ",").alias("brands"))
