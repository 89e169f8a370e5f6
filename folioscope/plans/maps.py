"""Layout analytics over embeddings: a point is the first two coordinates, its group the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import numbers
from folioscope.operators import islands, layout
from folioscope.registry import query
from folioscope.session import table

PTS = "pts AS (SELECT vec_id AS id, label AS grp, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


FNV = "list_reduce([2166136261::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split({0}, '')], lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT p_partkey AS id, {FNV.format('p_partkey || $$:$$ || p_brand')} AS hash, round({FNV.format('p_partkey || $$:$$ || p_brand')} / 4294967295.0 * 2 * pi(), 6) AS angle FROM part")
def fnv_direction(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.col("p_partkey").cast("string"), F.lit(":"), "p_brand")
    angle = numbers.direction(F.col("p_partkey").cast("string"), F.col("p_brand"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), numbers.fnv1a(key).alias("hash"), F.round(angle, 6).alias("angle"))


@query(f"""WITH {PTS}, o AS (SELECT *, row_number() OVER w - 1 AS i, sum(pi() * (10 + 4) * (10 + 4)) OVER (PARTITION BY grp ORDER BY id ROWS UNBOUNDED PRECEDING) AS area FROM pts WINDOW w AS (PARTITION BY grp ORDER BY id)),
  c AS (SELECT *, {FNV.format('grp || $$:compact$$')} / 4294967295.0 * 2 * pi() + i * (pi() * (3 - sqrt(5))) AS compact FROM o),
  s AS (SELECT *, (CASE WHEN sqrt(x * x + y * y) > 1e-9 THEN atan2(y, x) ELSE compact END) - compact AS d FROM c),
  a AS (SELECT *, compact + greatest(-pi() / 18, least((d - 2 * pi() * floor((d + pi()) / (2 * pi()))) * 0.06, pi() / 18)) AS angle FROM s)
  SELECT grp AS "group", id, round(angle, 6) AS angle, round(greatest(sqrt(area / (pi() * 0.58)), least((60 + 19) / abs(cos(angle)), (17 + 19) / abs(sin(angle)))), 6) AS target FROM a""")
def layout_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).withColumn("rank", F.col("id")).withColumn("radius", F.lit(10.0))
    return layout.sunflower(p).select("group", "id", F.round("angle", 6).alias("angle"), F.round("target", 6).alias("target"))


@query(f"WITH {PTS} SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2), 6) AS distance FROM pts a JOIN pts b ON a.id < b.id WHERE sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) < 0.05")
def grid_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return layout.grid_neighbours(points(spark, sf), 0.05).select("a", "b", F.round("distance", 6).alias("distance"))


CIRCLES = f"{PTS}, g AS (SELECT grp, avg(x) AS x, avg(y) AS y, sqrt(var_pop(x) + var_pop(y)) AS radius FROM pts GROUP BY 1)"


def circles(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("group").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("radius"))


@query(f"WITH {CIRCLES} SELECT count(*) AS pairs, round(max(greatest(0, a.radius + b.radius + 0.1 - sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2))), 6) AS overlap FROM g a JOIN g b ON a.grp < b.grp")
def outer_overlap(spark: SparkSession, sf: str) -> DataFrame:
    # the islands of a map: one row a group, all pairs of them
    a, b = circles(spark, sf).alias("a"), circles(spark, sf).alias("b")
    d = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    over = layout.overlap_column(d, F.col("a.radius"), F.col("b.radius"), 0.1)
    return a.join(b, F.col("a.group") < F.col("b.group")).agg(F.count("*").alias("pairs"), F.round(F.max(over), 6).alias("overlap"))


@query(f"""WITH {PTS}, m AS (SELECT grp, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM pts GROUP BY 1),
  h AS (SELECT grp, (xx + yy) / 2 AS mean, sqrt(((xx - yy) / 2) ^ 2 + xy * xy) AS half FROM m) SELECT grp AS "group", round(sqrt((mean + half) / greatest(mean - half, 1e-12)), 6) AS ratio FROM h""")
def axis_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return layout.principal_axis_ratio(points(spark, sf)).select("group", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {CIRCLES}, e AS (SELECT min(100 * x - 100 * radius - 14) AS x0, max(100 * x + 100 * radius + 14) AS x1, min(100 * y - 100 * radius - 14) AS y0, max(100 * y + 100 * radius + 14) AS y1 FROM g), m AS (SELECT * FROM (VALUES ('uniform', 20.0), ('citations', 80.0)) t(mode, asked))
  SELECT mode, greatest(asked, ceil((x1 - x0) / 8) * 8) AS width, greatest(asked, ceil((y1 - y0) / 8) * 8) AS height FROM e, m""".replace("20.0", "20::DOUBLE").replace("80.0", "80::DOUBLE"))
def canvas_fit(spark: SparkSession, sf: str) -> DataFrame:
    c = circles(spark, sf).select("group", *[(F.col(k) * 100).alias(k) for k in ("x", "y", "radius")])
    modes = [layout.canvas(c, s, s).select(F.lit(m).alias("mode"), "width", "height") for m, s in (("uniform", 20), ("citations", 80))]
    return modes[0].union(modes[1])


@query(f"WITH {PTS} SELECT id, floor(x * 1000 + 0.5) / 1000 AS x3, greatest(-0.1, least(y, 0.1)) AS y_clamped, round(sqrt(x * x + y * y), 6) AS norm FROM pts")
def rounding(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).select(
        "id", numbers.round_half_up(F.col("x")).alias("x3"), numbers.clamp(F.col("y"), -0.1, 0.1).alias("y_clamped"), F.round(F.hypot("x", "y"), 6).alias("norm")
    )


@query("""SELECT vec_id AS id, len([v FOR v IN embedding IF v > 0.2]) > 0 AS some_large, len([v FOR v IN embedding IF abs(v) < 1]) = len(embedding) AS all_small,
  label || '=' || len(embedding) AS entry FROM embeddings""")
def array_map_ops(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    m = F.map_from_entries(F.array(F.struct(F.col("label").cast("string"), F.size(e).cast("string"))))
    entry = F.array_join(F.transform(F.map_entries(m), lambda kv: F.concat_ws("=", kv["key"], kv["value"])), ",")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.exists(e, lambda v: v > F.lit(0.2).cast("float")).alias("some_large"), F.forall(e, lambda v: F.abs(v) < 1).alias("all_small"), entry.alias("entry")
    )


@query("SELECT event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k')) AS value FROM events")
def json_fallback(spark: SparkSession, sf: str) -> DataFrame:
    value = F.coalesce(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", value.alias("value"))


# the largest of the circles about three points each is that about all
@query(f"""WITH {PTS}, t AS (SELECT a.grp, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3, (b.x - c.x) ^ 2 + (b.y - c.y) ^ 2 AS a2, (a.x - c.x) ^ 2 + (a.y - c.y) ^ 2 AS b2, (a.x - b.x) ^ 2 + (a.y - b.y) ^ 2 AS c2,
    2 * (a.x * (b.y - c.y) + b.x * (c.y - a.y) + c.x * (a.y - b.y)) AS d FROM pts a JOIN pts b ON b.grp = a.grp AND b.id > a.id JOIN pts c ON c.grp = a.grp AND c.id > b.id),
  r AS (SELECT grp, CASE WHEN a2 >= b2 + c2 THEN (x2 + x3) / 2 WHEN b2 >= a2 + c2 THEN (x1 + x3) / 2 WHEN c2 >= a2 + b2 THEN (x1 + x2) / 2 ELSE ((x1 * x1 + y1 * y1) * (y2 - y3) + (x2 * x2 + y2 * y2) * (y3 - y1) + (x3 * x3 + y3 * y3) * (y1 - y2)) / d END AS x,
    CASE WHEN a2 >= b2 + c2 THEN (y2 + y3) / 2 WHEN b2 >= a2 + c2 THEN (y1 + y3) / 2 WHEN c2 >= a2 + b2 THEN (y1 + y2) / 2 ELSE ((x1 * x1 + y1 * y1) * (x3 - x2) + (x2 * x2 + y2 * y2) * (x1 - x3) + (x3 * x3 + y3 * y3) * (x2 - x1)) / d END AS y, x1, y1, x2, y2 FROM t),
  m AS (SELECT grp, x, y, greatest((x1 - x) ^ 2 + (y1 - y) ^ 2, (x2 - x) ^ 2 + (y2 - y) ^ 2) AS r2 FROM r), k AS (SELECT grp, max(r2) AS r2, arg_max(x, r2) AS x, arg_max(y, r2) AS y FROM m GROUP BY 1)
  SELECT grp AS "group", round(x, 6) AS x, round(y, 6) AS y, round(sqrt(r2), 6) AS radius FROM k""")
def mec_by_group(spark: SparkSession, sf: str) -> DataFrame:
    c = layout.enclosing_circles(points(spark, sf))
    return c.select("group", *[F.round(v, 6).alias(v) for v in ("x", "y", "radius")])


@query()
def pack_by_group(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("group", "id", (F.col("x") * 400).alias("x"), (F.col("y") * 400).alias("y"), F.col("id").alias("rank"), F.lit(6.0).alias("radius"))
    return layout.pack(p)


@query()
def island_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Both modes of the embeddings' map: circles of one size, and sized by the citations of a part."""
    p = points(spark, sf).withColumnRenamed("id", "rank")
    cited = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("rank")).agg(F.count("*").alias("n"))
    sized = p.join(cited, "rank", "left").select("group", "rank", "x", "y", numbers.collision_radius(numbers.citation_diameter(F.coalesce("n", F.lit(0)))).alias("cited"))
    modes = [sized.select(F.lit(m).alias("map"), "group", F.col("rank").alias("id"), "rank", "x", "y", r.alias("radius")) for m, r in (("uniform", F.lit(14.56)), ("citations", F.col("cited")))]
    members = modes[0].unionByName(modes[1])
    homes = members.groupBy("map", "group").agg((F.avg("x") * 400 + 580).alias("x"), (F.avg("y") * 400 + 390).alias("y"))
    firm = (F.col("group") == 0).alias("firm")
    rings = homes.select("map", "group", "x", "y", F.lit(120.0).alias("label_width"), F.lit(34.0).alias("label_height"), firm)
    return islands.arrange(members, rings)[1].select("map", "group", *[F.round(c, 3).alias(c) for c in ("x", "y", "radius", "content", "width", "height")])
