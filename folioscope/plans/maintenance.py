"""Incremental maintenance: frontiers, replay, versions, review, gates and sinks.

Announcements are events (source: event type, paper: user), screening decisions are labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import frontier, state, validate
from folioscope.operators.scan import scan
from folioscope.registry import query
from folioscope.session import materialize, table

BLOCK = 4096  # event numbers that one task runs through
DAY = "CAST(CAST(ts AS DATE) AS VARCHAR)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))


def seen(spark: SparkSession, sf: str) -> DataFrame:
    """Newest first: position 0 is a source's last event."""
    return table(spark, sf, "events").select(F.col("event_type").alias("source"), (-F.col("event_id")).alias("pos"), F.col("user_id").alias("id"))


SEEN = "SELECT event_type AS source, -event_id AS pos, user_id AS id FROM events"


@query(f"""WITH s AS ({SEEN}), m AS (SELECT DISTINCT source, id FROM s WHERE id % 23 = 7 AND source <> (SELECT max(event_type) FROM events)),
  stop AS (SELECT source, min(pos) AS stop FROM s JOIN m USING (source, id) GROUP BY 1), f AS (SELECT source, id, min(pos) AS pos FROM s GROUP BY 1, 2)
  SELECT f.source, pos, id, stop IS NOT NULL AS hit FROM f LEFT JOIN stop ON f.source = stop.source WHERE stop IS NULL OR pos < stop""")
def frontier_delta(spark: SparkSession, sf: str) -> DataFrame:
    s = seen(spark, sf)
    last = F.broadcast(table(spark, sf, "events").agg(F.max("event_type").alias("last")))
    marks = s.where("id % 23 = 7").join(last, F.col("source") != F.col("last"), "left_semi")
    return frontier.delta(s, marks)


@query(f"""WITH f AS (SELECT source, id, min(pos) AS pos FROM ({SEEN}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, id) AS place FROM f)
  SELECT source, place, id FROM r WHERE place <= 10""")
def next_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.following(seen(spark, sf))


@query("""SELECT sha256(text) AS digest, min(doc_id) AS pos, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def page_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return d.groupBy("digest").agg(F.min("doc_id").alias("pos"), F.count("*").alias("n")).where("n > 1")


BATCHES = f"""batches AS (SELECT event_type AS source, {DAY} AS batch_key, sha256(string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR))) AS content_sha,
  count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2)"""


def batches(spark: SparkSession, sf: str) -> DataFrame:
    ids = events(spark, sf).select(F.col("event_type").alias("source"), F.col("day").alias("batch_key"), F.col("user_id").cast("string").alias("id")).distinct()
    lists = ids.groupBy("source", "batch_key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.select("source", "batch_key", F.sha2(F.array_join("ids", ","), 256).alias("content_sha"), F.size("ids").cast("long").alias("n"))


@query(f"""WITH {BATCHES}, b AS (SELECT *, CAST(batch_key[9:10] AS INTEGER) AS d FROM batches)
  SELECT source, batch_key, content_sha, CASE WHEN d % 3 = 0 THEN 'new' WHEN d % 3 = 1 THEN 'replayed' ELSE 'conflict' END AS state FROM b""")
def batch_replay(spark: SparkSession, sf: str) -> DataFrame:
    b = batches(spark, sf).withColumn("ids_sha", F.col("content_sha"))
    d = F.substring("batch_key", 9, 2).cast("int")
    old = b.where(d % 3 != 0).withColumn("ids_sha", F.when(d % 3 == 1, F.col("ids_sha")).otherwise(F.lit("other")))
    return state.record_batches(old, b).select("source", "batch_key", "content_sha", "state")


@query("""SELECT user_id, CAST(min(ts) AS VARCHAR) AS first_ts, arg_min(event_type, (ts, event_type)) AS source FROM events GROUP BY 1""")
def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    first = state.first_seen(events(spark, sf), "user_id", "ts", "event_type")
    return first.select("user_id", F.col("ts").cast("string").alias("first_ts"), F.col("event_type").alias("source"))


# a paper's versions are its events in order
VER = "v AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, event_type, value, props, event_id FROM events)"


def vers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_type", "value", "props", "event_id")
    return scan(e, ["id"], ["event_id"], {"version": ("count", F.lit(1))}, block=F.floor(F.col("event_id") / BLOCK))


@query(f"WITH {VER} SELECT id, max(version) AS version, arg_max(event_type, version) AS event_type FROM v GROUP BY 1")
def version_heads(spark: SparkSession, sf: str) -> DataFrame:
    # a paper's last version is the number of its events
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("version"), F.max_by("event_type", "event_id").alias("event_type"))


@query(f"""WITH {VER} SELECT id, version, max(CASE WHEN event_id % 3 = 0 THEN version END) OVER (PARTITION BY id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM v""")
def previous_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id")
    return state.numbered_since(e, "id", "event_id", F.col("event_id") % 3 == 0, BLOCK).select("id", F.col("place").alias("version"), F.col("last").alias("prior"))


@query("""WITH r AS (SELECT user_id AS id, event_type AS source, max(event_id) AS batch FROM events GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source) AS rn FROM r) SELECT id, source, batch FROM k WHERE rn <= 16""")
def latest_per_source(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("source")).agg(F.max("event_id").alias("batch"))
    rn = F.row_number().over(Window.partitionBy("id").orderBy("source"))
    return last.withColumn("rn", rn).where("rn <= 16").drop("rn")


OBS = f"""{VER}, cat AS (SELECT c_custkey AS id, c_custkey % 9 AS published FROM customer),
  old AS (SELECT id, version, sha256(event_type) AS digest, CASE WHEN event_id % 2 = 0 THEN 'relevant' ELSE 'excluded' END AS status, sha256(event_type) AS reviewed FROM v WHERE version <= 20),
  new AS (SELECT id, version, CASE WHEN version % 5 = 0 THEN sha256(event_type || version) ELSE sha256(event_type) END AS digest FROM v WHERE version BETWEEN 10 AND 30),
  obs AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.version, n.version) AS version, coalesce(n.digest, o.digest) AS digest,
    CASE WHEN o.id IS NULL AND coalesce(coalesce(n.version, o.version) <= published, false) THEN 'relevant' WHEN o.id IS NULL THEN 'pending' WHEN n.digest <> o.digest THEN 'pending' ELSE o.status END AS status,
    CASE WHEN o.id IS NULL AND coalesce(n.version <= published, false) THEN n.digest ELSE o.reviewed END AS reviewed, published
    FROM old o FULL JOIN new n ON o.id = n.id AND o.version = n.version LEFT JOIN cat ON cat.id = coalesce(o.id, n.id))"""


def observed(spark: SparkSession, sf: str, held: str, found: str) -> tuple[DataFrame, DataFrame]:
    v = vers(spark, sf)
    sha = F.sha2("event_type", 256)
    old = v.where(held).select(
        "id", "version", sha.alias("digest"), F.when(F.col("event_id") % 2 == 0, "relevant").otherwise("excluded").alias("status"), sha.alias("reviewed")
    )
    changed = F.sha2(F.concat("event_type", F.col("version").cast("string")), 256)
    new = v.where(found).select("id", "version", F.when(F.col("version") % 5 == 0, changed).otherwise(sha).alias("digest"))
    catalogue = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 9).alias("published"))
    return state.observe(old, new, catalogue), catalogue



# the sides overlap and leave no version out
OBS_WHOLE = OBS.replace("version <= 20", "version % 3 <> 0").replace("version BETWEEN 10 AND 30", "version % 3 <> 1")


@query(f"WITH {OBS_WHOLE} SELECT id, version, digest, status, reviewed FROM obs")
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    return observed(spark, sf, "version % 3 <> 0", "version % 3 <> 1")[0]


QUEUE = """q AS (SELECT d.doc_id, n_chars AS version, sha256(coalesce(source, '')) AS digest, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 AND toxic = 0 THEN 'relevant' WHEN quality = 0 THEN 'excluded' ELSE 'ambiguous' END AS status,
    CASE WHEN quality IS NULL THEN NULL WHEN d.doc_id % 13 = 0 THEN 'other' ELSE sha256(coalesce(source, '')) END AS reviewed, d.doc_id % 2 = 0 AS in_cat, CASE WHEN d.doc_id % 10 <> 0 THEN n_chars - d.doc_id % 3 END AS published,
    d.doc_id IN (SELECT item_id FROM benchmark) AS logged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  r AS (SELECT *, CASE WHEN status = 'relevant' AND NOT in_cat THEN 'accepted_unpublished' WHEN status = 'relevant' AND (published IS NULL OR published < version) THEN 'accepted_revision_unpublished'
    WHEN status = 'ambiguous' THEN 'ambiguous_unpublished' WHEN reviewed IS NOT NULL AND reviewed <> digest THEN 'metadata_changed' WHEN in_cat THEN 'new_version' ELSE 'new_paper' END AS reason FROM q
    WHERE status = 'pending' OR reviewed IS NULL OR reviewed <> digest OR (status = 'relevant' AND (NOT in_cat OR published IS NULL OR published < version)) OR (status = 'ambiguous' AND NOT logged))"""


def review(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).where("want").drop("want")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, with the reason for a review and whether they want one."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    log = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("logged")).distinct()
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left").join(log, "doc_id", "left")
    digest, k = F.sha2(F.coalesce("source", F.lit("")), 256), F.col("doc_id")
    status = F.when(F.col("quality").isNull(), "pending").when((F.col("quality") == 1) & (F.col("toxic") == 0), "relevant").when(F.col("quality") == 0, "excluded").otherwise("ambiguous")
    q = d.select(
        "doc_id", F.col("n_chars").alias("version"), digest.alias("digest"), status.alias("status"), F.coalesce("logged", F.lit(False)).alias("logged"),
        F.when(F.col("quality").isNotNull(), F.when(k % 13 == 0, "other").otherwise(digest)).alias("reviewed"),
        (k % 2 == 0).alias("in_cat"), F.when(k % 10 != 0, F.col("n_chars") - k % 3).alias("published"),
    )
    c = F.col
    behind = ~c("in_cat") | c("published").isNull() | (c("published") < c("version"))
    want = (
        (c("status") == "pending") | c("reviewed").isNull() | (c("reviewed") != c("digest"))
        | ((c("status") == "relevant") & behind) | ((c("status") == "ambiguous") & ~c("logged"))
    )
    reason = state.review_reason(c("status"), c("in_cat"), c("published"), c("version"), c("reviewed"), c("digest"), F.lit(False))
    return q.withColumns({"want": F.coalesce(want, F.lit(False)), "reason": reason})


@query(f"WITH {QUEUE} SELECT doc_id, version, status, reason FROM r")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return review(spark, sf).select("doc_id", "version", "status", "reason")


@query(f"""WITH {QUEUE}, a AS (SELECT 1 AS stage, version AS ord, doc_id AS id FROM r UNION ALL SELECT 2, n_chars, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)),
  t AS (SELECT count(*) AS total FROM a) SELECT CAST(stage AS INTEGER) AS stage, id, total, total > 500 AS truncated FROM a, t ORDER BY stage, ord, id LIMIT 500""")
def review_budget(spark: SparkSession, sf: str) -> DataFrame:
    stage = F.when(F.col("want"), 1).otherwise(2).alias("stage")
    rows = materialize(judged(spark, sf).select(stage, F.col("doc_id").alias("id"), F.col("version").alias("ord")), "review")
    return state.staged_budget(rows, 500).select("stage", "id", "total", "truncated")  # the budget is the feature


@query(f"""WITH {QUEUE}, g AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (reviewed <> digest) AS changed, count(*) FILTER (status = 'relevant' AND NOT in_cat) AS unpublished,
  count(*) FILTER (status = 'ambiguous' AND NOT logged) AS ambiguous, (SELECT count(DISTINCT event_type) FROM events) AS lanes FROM q)
  SELECT *, CASE WHEN lanes < 5 THEN 'lanes' WHEN pending + changed > 0 THEN 'pending' WHEN unpublished > 0 THEN 'unpublished' WHEN ambiguous > 0 THEN 'ambiguous' END AS first_failure FROM g""")
def completion_gates(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    log = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("logged")).distinct()
    d = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").join(log, "doc_id", "left")
    q, k = F.col("quality"), F.col("doc_id")
    count = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    counts = d.agg(
        count(q.isNull(), "pending"), count(q.isNotNull() & (k % 13 == 0), "changed"),
        count((q == 1) & (F.col("toxic") == 0) & (k % 2 != 0), "unpublished"),
        count(q.isNotNull() & (q != 0) & ~((q == 1) & (F.col("toxic") == 0)) & F.col("logged").isNull(), "ambiguous"),
    )
    lanes = table(spark, sf, "events").agg(F.countDistinct("event_type").alias("lanes"))
    both = counts.crossJoin(F.broadcast(lanes))  # one row each
    gates = validate.first_failure(
        ("lanes", F.col("lanes") >= 5), ("pending", F.col("pending") + F.col("changed") == 0),
        ("unpublished", F.col("unpublished") == 0), ("ambiguous", F.col("ambiguous") == 0),
    )
    return both.withColumn("first_failure", gates)


@query("SELECT doc_id AS id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def unhydrated(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id")).join(held, "id", "left_anti")


@query("""SELECT c_custkey AS id, CAST(max(o_orderdate) AS VARCHAR) AS served FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY max(o_orderdate) NULLS FIRST, 1 LIMIT 8""")
def author_rotation(spark: SparkSession, sf: str) -> DataFrame:
    served = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("at"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(served, "id", "left")
    top = c.orderBy(F.asc_nulls_first("at"), "id").limit(8)  # eight are due a run
    return top.select("id", F.col("at").cast("string").alias("served"))


@query(f"SELECT event_type AS source, min({DAY}) AS low, max({DAY}) AS high, count(DISTINCT user_id) AS ids, count(DISTINCT props) AS modes FROM events GROUP BY 1")
def coverage_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(F.col("event_type").alias("source")).agg(
        F.min("day").alias("low"), F.max("day").alias("high"), F.countDistinct("user_id").alias("ids"),
        F.countDistinct("props").alias("modes"),
    )


@query(f"SELECT event_type AS source, min({DAY}) AS low, max({DAY}) AS high FROM events WHERE NOT (event_type = 'click' AND day(ts) > 20) GROUP BY 1 HAVING min({DAY}) > '2024-01-01' OR max({DAY}) < '2024-01-30'")
def coverage_gap(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where(~((F.col("event_type") == "click") & (F.dayofmonth("ts") > 20)))
    g = e.groupBy(F.col("event_type").alias("source")).agg(F.min("day").alias("low"), F.max("day").alias("high"))
    return g.where("low > '2024-01-01' or high < '2024-01-30'")


@query(f"""WITH f AS (SELECT {DAY} AS day, event_type AS source, user_id, min(event_id) AS pos FROM events GROUP BY 1, 2, 3)
  SELECT day, source, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY pos) AS ids FROM f GROUP BY 1, 2""")
def listing_groups(spark: SparkSession, sf: str) -> DataFrame:
    first = events(spark, sf).groupBy("day", F.col("event_type").alias("source"), "user_id").agg(F.min("event_id").alias("pos"))
    lists = first.groupBy("day", "source").agg(F.array_sort(F.collect_list(F.struct("pos", "user_id"))).alias("xs"))
    return lists.select("day", "source", F.array_join(F.transform("xs", lambda x: x["user_id"].cast("string")), ",").alias("ids"))


@query("""SELECT p_partkey AS id, array_to_string(list_slice([w FOR w, i IN m IF w <> '' AND list_position(m, w) = i], 1, 3), '|') AS islands
  FROM (SELECT p_partkey, [p_brand] || string_split(p_name, ' ') AS m FROM part)""")
def membership_normalise(spark: SparkSession, sf: str) -> DataFrame:
    members = F.array_distinct(F.concat(F.array("p_brand"), F.split("p_name", " ")))
    kept = F.slice(F.filter(members, lambda x: x != ""), 1, 3)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(kept, "|").alias("islands"))


@query("""SELECT l_orderkey AS id, CAST(min(l_linenumber) AS BIGINT) AS lo, CAST(max(l_linenumber) AS BIGINT) AS hi, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1
  HAVING min(l_linenumber) <> 1 OR count(*) <> count(DISTINCT l_linenumber) OR max(l_linenumber) <> count(*)""")
def rank_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    bad = validate.not_contiguous(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
    return bad.select(F.col("l_orderkey").alias("id"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "n", "d")



@query("""SELECT 'domain' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS detail FROM lineitem WHERE l_quantity > 49
  UNION ALL SELECT 'self', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_orderkey = l_partkey
  UNION ALL SELECT 'foreign', CAST(l_orderkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT p_partkey FROM part)
  UNION ALL SELECT 'unused', CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
  UNION ALL SELECT 'cross', CAST(l_orderkey AS VARCHAR), l_linestatus FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F'""")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    l, p, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    key = "l_orderkey"
    own = validate.rules(
        l, key,
        ("domain", F.col("l_quantity") > 49, F.col("l_quantity").cast("long")),
        ("self", F.col(key) == F.col("l_partkey"), F.col("l_partkey")),
        ("cross", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "F"), F.col("l_linestatus")),
    )
    foreign = validate.missing_key(l, "foreign", key, p, "p_partkey", key)
    return validate.together(own, foreign, validate.missing_key(s, "unused", "s_suppkey", l, "l_suppkey", "s_suppkey"))


@query("""SELECT p_partkey AS id, (SELECT coalesce(max(p_size), -1) FROM part) + row_number() OVER (ORDER BY p_partkey) AS rank FROM part WHERE p_size = 1""")
def next_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    top = F.broadcast(p.agg(F.coalesce(F.max("p_size"), F.lit(-1)).cast("long").alias("top")))  # one row
    new = p.where("p_size = 1").select(F.col("p_partkey").alias("id"))
    return state.numbered(new, [], "id").crossJoin(top).select("id", (F.col("top") + F.col("place")).alias("rank"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'old' ELSE 'new' END AS origin FROM orders""")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    new = o.where("id % 3 = 0 or id % 2 <> 0").withColumn("origin", F.lit("new"))
    return state.upsert(o.where("id % 2 = 0").withColumn("origin", F.lit("old")), new, ["id"])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM customer""")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    new = c.where("id % 3 = 0 or id % 2 <> 0").withColumn("origin", F.lit("new"))
    return state.insert_ignore(c.where("id % 2 = 0").withColumn("origin", F.lit("old")), new, ["id"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 48)")
def delete_not_in(spark: SparkSession, sf: str) -> DataFrame:
    keep = table(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey"))
    return state.keep_only(table(spark, sf, "supplier").select("s_suppkey", "s_name"), keep, ["s_suppkey"])


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS title, p_partkey % 4 = 0 AND upper(p_name) <> p_name AS changed FROM part""")
def metadata_overlay(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    new = p.where("id % 4 = 0").select("id", F.upper("p_name").alias("fetched"))
    changed = F.coalesce(F.col("fetched") != F.col("p_name"), F.lit(False))
    return p.join(new, "id", "left").select("id", F.coalesce("fetched", "p_name").alias("title"), changed.alias("changed"))


MIGRATION = "CASE WHEN p_partkey % 50 = 0 THEN 'override' WHEN p_brand LIKE '%1' THEN replace(p_brand, 'Brand', 'Island') ELSE p_brand END"


@query(f"SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT {MIGRATION} AS k, count(*) AS n FROM part GROUP BY 1) b ON a.k = b.k")
def migration_mapping(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    to = F.when(F.col("p_partkey") % 50 == 0, "override").when(F.col("p_brand").endswith("1"), F.replace("p_brand", F.lit("Brand"), F.lit("Island"))).otherwise(F.col("p_brand"))
    a = p.groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("a"))
    b = p.groupBy(to.alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("a", F.lit(0)).alias("before"), F.coalesce("b", F.lit(0)).alias("after"))


@query("""SELECT o_orderkey AS id, c_name, l_partkey AS part FROM orders LEFT JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = o_custkey""")
def heads_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    l = table(spark, sf, "lineitem")
    both = o.join(l, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_suppkey") == F.col("o_custkey")))
    return both.select(F.col("o_orderkey").alias("id"), "c_name", F.col("l_partkey").alias("part"))


@query("""SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'N' AND b.l_orderkey = a.l_orderkey AND b.l_suppkey = a.l_suppkey AND b.l_linenumber = a.l_linenumber)""")
def exact_log_anti(spark: SparkSession, sf: str) -> DataFrame:
    key = ["l_orderkey", "l_suppkey", "l_linenumber"]
    l = table(spark, sf, "lineitem")
    left = l.select(*key).join(l.where("l_returnflag = 'N'").select(*key), key, "left_anti")
    return left.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("""SELECT c_custkey AS id, concat_ws(' ', c_mktsegment, n_name, r_name) AS terms FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def label_terms(spark: SparkSession, sf: str) -> DataFrame:
    # nation and region are fixed-size dimensions (25 and 5 rows)
    dims = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    c = table(spark, sf, "customer").join(F.broadcast(dims), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", "n_name", "r_name").alias("terms"))


@query("""SELECT c_custkey AS id, CAST(max(o_orderdate) AS VARCHAR) AS cursor, max(o_orderdate) IS NULL AS missing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def registry_cursor(spark: SparkSession, sf: str) -> DataFrame:
    at = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").cast("string").alias("cursor"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(at, "id", "left").withColumn("missing", F.col("cursor").isNull())


@query("""SELECT coalesce(c.id, e.id) AS id, c.id IS NOT NULL AS in_catalogue, coalesce(e.n, 0) AS versions FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0) c
  FULL JOIN (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1) e ON e.id = c.id""")
def known_set(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(True).alias("c"))
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    return c.join(e, "id", "full_outer").select("id", F.coalesce("c", F.lit(False)).alias("in_catalogue"), F.coalesce("n", F.lit(0)).alias("versions"))


@query("""SELECT user_id AS id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM (SELECT user_id, 'fresh:' || event_type AS reason FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, 'pending' FROM events WHERE event_id % 5 = 0) GROUP BY 1""")
def reemit_merge(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    fresh = e.where("event_id % 2 = 0").select("user_id", F.concat(F.lit("fresh:"), "event_type").alias("reason"))
    pending = e.where("event_id % 5 = 0").select("user_id", F.lit("pending").alias("reason"))
    sets = fresh.union(pending).groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("reason")).alias("r"))
    return sets.select("id", F.array_join("r", ",").alias("reasons"))


@query("""(SELECT 'planned' AS side, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)) UNION ALL (SELECT 'manual', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part))""")
def override_anti(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    one = p.join(s, "id", "left_anti").select(F.lit("planned").alias("side"), "id")
    return one.union(s.join(p, "id", "left_anti").select(F.lit("manual").alias("side"), "id"))


COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in COUNTED) + " UNION ALL SELECT 'labels:relevant', count(*) FILTER (quality = 1 AND toxic = 0) FROM labels")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in COUNTED]
    parts.append(table(spark, sf, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("n")).select(F.lit("labels:relevant").alias("name"), "n"))
    return validate.together(*parts)



def version_lists(v: DataFrame) -> DataFrame:
    m = v.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("version", "event_type"))).alias("xs"))
    return m.select("id", F.array_join(F.transform("xs", lambda x: F.concat_ws(":", x["version"].cast("string"), x["event_type"])), ",").alias("versions"))


@query(f"WITH {VER} SELECT id, string_agg(CAST(version AS VARCHAR) || ':' || event_type, ',' ORDER BY version) AS versions FROM v GROUP BY 1")
def heads_map(spark: SparkSession, sf: str) -> DataFrame:
    return version_lists(vers(spark, sf))


@query("""WITH p AS (SELECT turn AS page, coalesce(text, '') AS id, conv_id FROM conversations), f AS (SELECT id, min((conv_id, page)) AS first FROM p GROUP BY 1)
  SELECT page, count(*) AS shown, count(*) FILTER ((conv_id, page) = first) AS fresh, count(*) - count(DISTINCT p.id) AS repeats FROM p JOIN f ON f.id = p.id GROUP BY 1""")
def delta_totals(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conversations").select(F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("id"), F.struct("conv_id", "turn").alias("at"))
    first = p.groupBy("id").agg(F.min("at").alias("first"))
    return p.join(first, "id").groupBy("page").agg(
        F.count("*").alias("shown"), F.count_if(F.col("at") == F.col("first")).alias("fresh"), (F.count("*") - F.countDistinct("id")).alias("repeats")
    )


@query("""SELECT (SELECT CAST(max(o_orderdate) AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') AS completed, (SELECT CAST(max(ts) AS VARCHAR) FROM events) AS stated,
  (SELECT max(ts) FROM events) >= (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F') AS fresh""")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").agg(F.max("o_orderdate").alias("a"))
    said = table(spark, sf, "events").agg(F.max("ts").alias("b"))
    return done.crossJoin(said).select(F.col("a").cast("string").alias("completed"), F.col("b").cast("string").alias("stated"), (F.col("b") >= F.col("a")).alias("fresh"))


@query("SELECT 'duplicate' AS rule, l_orderkey || '/' || l_linenumber AS key, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return validate.duplicates(table(spark, sf, "lineitem"), "duplicate", ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS place, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS version FROM orders""")
def catalogue_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), "o_orderdate", "o_orderkey")
    version = F.coalesce(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")), F.lit(-1))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("place"), version.alias("version"))


@query("(SELECT 'newest' AS which, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) UNION ALL (SELECT 'oldest', o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1)")
def newest_oldest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    a = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select(F.lit("newest").alias("which"), F.col("o_orderkey").alias("id"))
    b = o.where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(1).select(F.lit("oldest").alias("which"), F.col("o_orderkey").alias("id"))
    return a.union(b)


@query("""SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ordinal, round((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) * (pi() * (3 - sqrt(5))), 6) AS angle FROM part""")
def ordinals(spark: SparkSession, sf: str) -> DataFrame:
    from folioscope.functions.numbers import GOLDEN_ANGLE

    n = F.col("place") - 1
    return state.numbered(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"], "p_partkey").select(F.col("p_partkey").alias("id"), n.alias("ordinal"), F.round(n * F.lit(GOLDEN_ANGLE), 6).alias("angle"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'updated' END AS change, o_orderstatus = 'F' AS observation FROM orders
  WHERE o_orderkey % 4 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > o_orderdate AND l_quantity > 49)""")
def changed_records(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    l = table(spark, sf, "lineitem").where("l_quantity > 49").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("updated"))
    old = o.where("o_orderkey % 4 <> 0").select("o_orderkey", F.col("o_orderdate").alias("known"))
    both = o.select("o_orderkey", "o_orderstatus").join(old, "o_orderkey", "left").join(l, "o_orderkey", "left")
    new, later = F.col("known").isNull(), F.coalesce(F.col("updated") > F.col("known"), F.lit(False))
    return both.where(new | later).select(F.col("o_orderkey").alias("id"), F.when(new, "new").otherwise("updated").alias("change"), (F.col("o_orderstatus") == "F").alias("observation"))


@query(f"WITH {VER} SELECT id, bool_or(version % 2 = 0) AS discovered, CAST(min(version) AS BIGINT) AS first_batch, CAST(min(CASE WHEN version % 2 = 0 THEN version END) AS BIGINT) AS promoted FROM v GROUP BY 1")
def coverage_only(spark: SparkSession, sf: str) -> DataFrame:
    discover = F.col("version") % 2 == 0
    return vers(spark, sf).groupBy("id").agg(F.bool_or(discover).alias("discovered"), F.min("version").alias("first_batch"), F.min(F.when(discover, F.col("version"))).alias("promoted"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status, count(*) AS decisions FROM events GROUP BY 1")
def status_from_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("decisions"))


@query("""WITH c AS (SELECT user_id AS key, max(event_id) AS cursor FROM events WHERE event_id < (SELECT max(event_id) / 2 FROM events) GROUP BY 1), s AS (SELECT user_id AS key, max(event_id) AS cursor FROM events GROUP BY 1),
  g AS (SELECT count(DISTINCT event_type) >= 5 AS ok FROM events) SELECT coalesce(s.key, c.key) AS key, CASE WHEN ok THEN coalesce(s.cursor, c.cursor) ELSE c.cursor END AS cursor FROM s FULL JOIN c ON s.key = c.key, g WHERE ok OR c.key IS NOT NULL""")
def cursor_promotion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ends = e.agg(F.max("event_id").alias("last"), (F.countDistinct("event_type") >= 5).alias("ok")).first()
    half = e.where(F.col("event_id") < F.lit(ends["last"]) / 2)
    cursors = lambda d: d.groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("cursor"))
    return state.promote(cursors(half), cursors(e), ["key"], F.lit(bool(ends["ok"])))


@query(f"""WITH f AS (SELECT event_type AS source, user_id AS id, min(-event_id) AS pos FROM events WHERE event_id >= 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, id) AS place FROM f)
  SELECT source, count(*) FILTER (place <= 10) AS adopted, sha256(source || '|' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FILTER (place <= 10)) AS delta_key,
    count(*) FILTER (place > 10) AS left_out FROM r GROUP BY 1""")
def baseline_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    s = seen(spark, sf)
    front = frontier.following(s)
    lists = front.groupBy("source").agg(F.count("*").alias("adopted"), F.array_sort(F.collect_list(F.struct("place", "id"))).alias("xs"))
    ids = F.array_join(F.transform("xs", lambda x: x["id"].cast("string")), ",")
    every = s.groupBy("source").agg(F.countDistinct("id").alias("all"))
    return lists.join(every, "source").select("source", "adopted", F.sha2(F.concat("source", F.lit("|"), ids), 256).alias("delta_key"), (F.col("all") - F.col("adopted")).alias("left_out"))


@query("""SELECT o_orderkey AS id, o_orderkey % 7 AS claimed, count(l_orderkey) AS counted, count(l_orderkey) > 6 AS over_cap FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(l_orderkey) <> o_orderkey % 7""")
def claim_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).alias("claimed"))
    both = o.join(n, "id", "left").withColumn("counted", F.coalesce("n", F.lit(0))).where("counted <> claimed")
    return both.select("id", "claimed", "counted", (F.col("counted") > 6).alias("over_cap"))
