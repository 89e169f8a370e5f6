"""Structures that are written once and kept up: bucketed tables, signed citation deltas, trigram postings, facet bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import deltas, facets, search
from folioscope.operators.postings import Postings
from folioscope.plans import catalogue, citations
from folioscope.registry import query
from folioscope.session import fresh_path, materialize, table
from folioscope.sources.buckets import BucketTable


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1000 <= 1 THEN 'new' WHEN o_orderkey % 2 = 0 THEN 'old' WHEN o_orderkey % 500 = 3 THEN 'late' END AS origin FROM orders)
  SELECT id, origin FROM o WHERE origin IS NOT NULL AND id % 7 <> 0""")
def bucket_sinks(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert, insert-or-ignore, removal and a promotion that fails its gates, each rewriting the buckets it meets."""
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    said = lambda where, origin: keys.where(where).withColumn("origin", F.lit(origin))
    held = BucketTable(spark, fresh_path(spark, "buckets"), ["id"], "id long, origin string", 16)
    held.upsert(said("id % 2 = 0", "old"))
    held.upsert(said("id % 1000 <= 1", "new"))
    held.insert_ignore(said("id % 2 = 0 or id % 500 = 3", "late"))
    held.keep_only(keys.where("id % 7 <> 0"))
    held.promote(said("id % 3 = 0", "staged"), passed=False)
    return held.read()


@query(f"""WITH {citations.EDGES}, was AS (SELECT DISTINCT dst FROM edges WHERE src % 10 <> 3 OR dst % 2 = 0), now AS (SELECT * FROM edges WHERE src % 10 <> 3 OR dst % 3 <> 0)
  SELECT CAST(t.dst AS VARCHAR) AS id, coalesce(string_agg(CAST(src AS VARCHAR), ',' ORDER BY src), '') AS cited_by, count(src) AS n
  FROM (SELECT dst FROM was UNION SELECT dst FROM now) t LEFT JOIN now ON now.dst = t.dst GROUP BY 1""")
def citation_delta(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the papers changes its references; the index follows by signed edges."""
    edges = materialize(citations.edges(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), "edges")
    order = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("src"), F.col("p_partkey").cast("long").alias("pos"))
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    changed = edges.where(src % 10 == 3)
    before = changed.where(dst % 2 == 0)
    held = BucketTable(spark, fresh_path(spark, "index"), ["id"], deltas.INDEX, 16)
    held.upsert(deltas.index_of(edges.where(src % 10 != 3).union(before), order))
    deltas.update_index(held, before, changed.where(dst % 3 != 0), order)
    return held.read().select("id", F.array_join(F.transform("cited_by", lambda e: e["src"]), ",").alias("cited_by"), "n")


TERMS = ("an the", "license", "qu", "z", "der die", "tion of the", "xqzj", "")


@query(f"""WITH t AS (SELECT doc_id, {catalogue.NORM.format('text')} AS t FROM documents) SELECT term, doc_id FROM t, (SELECT unnest({list(TERMS)}) AS term) WHERE contains(t, term)""")
def search_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Several searches of one posting table: long and short, common, rare and absent."""
    texts = catalogue.docs(spark, sf).select(F.col("doc_id").alias("id"), text.search_text("text").alias("t"))
    held = Postings(spark, fresh_path(spark, "postings")).build(texts)
    found = [held.search(t).select(F.lit(t).alias("term"), F.col("id").alias("doc_id")) for t in TERMS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


FACETS = ("island", "contribution", "status")


def _facet_sql() -> str:
    parts = []
    for f in FACETS:
        a, b = (x for x in FACETS if x != f)
        own = {f: "CAST(NULL AS VARCHAR)", a: f"sa.v AS {a}", b: f"sb.v AS {b}"}
        cols = ", ".join(f"{own[x]} AS {x}" if x == f else own[x] for x in FACETS)
        parts.append(f"""SELECT '{f}' AS facet, w.v AS value, {cols}, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {f} AS v FROM o) w
  CROSS JOIN (SELECT DISTINCT {a} AS v FROM o UNION SELECT '{search.ALL}') sa CROSS JOIN (SELECT DISTINCT {b} AS v FROM o UNION SELECT '{search.ALL}') sb
  LEFT JOIN c ON c.{f} = w.v AND c.{a} = sa.v AND c.{b} = sb.v""")
    names = ", ".join(f"coalesce({f}, '{search.ALL}') AS {f}" for f in FACETS)
    return f"""WITH o AS (SELECT o_orderkey AS id, c_mktsegment AS island, o_orderpriority AS contribution, o_orderstatus AS status, {catalogue.IN_WINDOW} AS inside FROM orders JOIN customer ON o_custkey = c_custkey),
  c AS (SELECT {names}, count(*) AS n FROM o WHERE inside GROUP BY CUBE ({', '.join(FACETS)}))
  """ + " UNION ALL ".join(parts)


@query(_facet_sql())
def facet_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    """All counts of three facets inside the date window, each under every selection of the other two."""
    rows = catalogue.orders(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "id")
    within = search.filter_catalog(catalogue.orders(spark, sf), window=catalogue.WINDOW).select("id")
    return facets.all_counts(rows, "id", [*FACETS], within)
