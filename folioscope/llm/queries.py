"""The operN queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    bpe,
    centroids,
    chat_format,
    fingerprints,
    language_id,
    license_scan,
    mixing,
    near_dups,
    quality_classifier,
    quality_rules,
    sharding,
    spelling,
    token_counts,
)
from folioscope.session import fresh_path, table

OVER = 4096


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), fresh_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select(
        "doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = language_id.fold(4)
    prototypes = language_id.fit(docs.where(fold != 2))
    scored = language_id.predict(docs.select("doc_id", "text"), prototypes)
    return scored.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(df: DataFrame) -> DataFrame:
        return df.withColumn("edited", F.sha2("edited", 256)).withColumnRenamed("edited", "edited_sha256")

    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"), digest)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(license_scan.scan(table(spark, sf_dir, "documents")))


def op9_source_mixing(spark: SparkSession, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``weights``: target weights by source; the square roots of the sources' sizes where none are given."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.mix(docs, weights=weights or mixing.target_weights(docs))
    return mixed.select("doc_id", "source", *[F.col(f"__mix_{c}").alias(c) for c in ("block", "slot", "release", "deadline", "place")])


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    back = chat_format.read_back(chat_format.expand(rows.unionByName(more)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clusters = centroids.cluster(table(spark, sf_dir, "embeddings"))
    named = F.broadcast(clusters.select("cluster", "cluster_inertia", "inertia", "centroid_sha256"))  # a row a cluster
    return rows.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "lang", "source", size, F.crc32(text).alias("text_crc32"))
    placed = sharding.shard(docs, ["lang", "source", "size"], ["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_bpe_round_trip, op3_quality_rules, op4_near_duplicates, op5_quality_classifier,
        op6_language_id, op7_fingerprints, op8_license_scan, op9_source_mixing, op10_chat_format, op11_spelling_variants,
        op12_centroid_clustering, op13_sharding, pipeline,
    )
}

_TURNS = """
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')
"""

OP10_SQL = f"""
WITH t AS ({_TURNS}),
e AS (
  SELECT *, CAST(length(replace(role, '\\', '\\\\')) + length(replace(text, '\\', '\\\\'))
    - 2 * ((length(role) - length(replace(role, '### ', ''))) / 4 + (length(text) - length(replace(text, '### ', ''))) / 4)
    - 5 * ((length(role) - length(replace(role, '</turn>', ''))) / 7 + (length(text) - length(replace(text, '</turn>', ''))) / 7)
    + 14 AS BIGINT) AS chars
  FROM t
),
w AS (
  SELECT *, sum(chars) OVER p AS upto,
    role = 'assistant' OR row_number() OVER p = count(*) OVER (PARTITION BY conv_id) AS ends
  FROM e WINDOW p AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (ends) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""

_COMMON = " UNION ALL ".join(
    f"SELECT '{lang}' AS lang, unnest([{', '.join(repr(w) for w in words)}]) AS word" for lang, words in quality_rules.COMMON.items()
)
_HALF = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
_TERM = f"({_HALF.format('p', 'q')} + {_HALF.format('q', 'p')}) / 2"

OP3_SQL = f"""
WITH common AS ({_COMMON}),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) r(i)),
rep AS (SELECT doc_id, g FROM tri GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN rep USING (doc_id, g)) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
c AS (SELECT doc_id, lang, len(w) AS n_words, [length(regexp_replace(t, p, '', 'g')) FOR p IN
  ['[^a-z]+', '[^\\x20\\x09-\\x0D]+', '[^.,]+', '[^#*$%&|<>]+', '[^A-Z]+', '[^0-9]+', '[\\x00-\\x7F]+']] AS k, length(t) AS n FROM d),
f AS (SELECT doc_id, lang, n_words, n - k[2] AS word_chars, k[4] AS n_symbols, k || [n - list_sum(k)] AS classes, n FROM c),
found AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, lower(unnest(w)) AS word FROM d) WHERE word IN (SELECT word FROM common) GROUP BY 1, 2),
langs AS (SELECT lang, sum(n_words) AS words, sum(n) AS chars FROM f WHERE lang IN (SELECT lang FROM common) GROUP BY 1 HAVING sum(n_words) > 0),
ref_class AS (SELECT lang, i, sum(classes[i]) / any_value(chars) AS q FROM f JOIN langs USING (lang), range(1, 9) r(i) GROUP BY 1, 2),
ref_word AS (SELECT c.lang, c.word, coalesce(sum(x.n), 0) / any_value(l.words) AS q FROM common c JOIN langs l ON l.lang = c.lang
  LEFT JOIN (SELECT f.lang, word, found.n FROM found JOIN f USING (doc_id)) x ON x.lang = c.lang AND x.word = c.word GROUP BY 1, 2),
class_d AS (SELECT doc_id, lang, sqrt(greatest(sum({_TERM}), 0)) AS v FROM (SELECT doc_id, r.lang, classes[i] / n AS p, q FROM f, ref_class r WHERE n_words > 0) GROUP BY 1, 2),
bins AS (SELECT f.doc_id, r.lang, r.word, coalesce(x.n, 0) / n_words AS p, q FROM f CROSS JOIN ref_word r LEFT JOIN found x ON x.doc_id = f.doc_id AND x.word = r.word WHERE n_words > 0),
all_bins AS (SELECT doc_id, lang, p, q FROM bins UNION ALL SELECT doc_id, lang, 1 - sum(p), 1 - sum(q) FROM bins GROUP BY 1, 2),
word_d AS (SELECT doc_id, lang, sqrt(greatest(sum({_TERM}), 0)) AS v FROM all_bins GROUP BY 1, 2),
best AS (SELECT doc_id, lang, a.v AS c, b.v AS w, row_number() OVER (PARTITION BY doc_id ORDER BY a.v + b.v, lang) AS rn FROM class_d a JOIN word_d b USING (doc_id, lang)),
g AS (SELECT f.doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, b.lang AS nearest, b.c, b.w,
  n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words AS base_failed
  FROM f LEFT JOIN dup USING (doc_id) LEFT JOIN cov ON cov.doc_id = f.doc_id LEFT JOIN best b ON b.doc_id = f.doc_id AND rn = 1)
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(c <= 0.22 + 0.7 / sqrt(greatest(n_words, 1)) AND (n_words < 80 OR w <= 0.17 + 1.3 / sqrt(greatest(n_words, 1))), false) AS kept,
  nearest, round(c, 6) AS class_distance, round(w, 6) AS word_distance FROM g
"""

#: Unsigned crc32 of a text's UTF-8, by the table of its polynomial.
_CRC_TABLE = """crc_steps(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM crc_steps WHERE k = 8)"""


def _crc(text: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])))"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY 1, 2),
hashed AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM each, crc_table),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS cut FROM words, unnest(range(1, length(word) + 1)) r(i)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.cut
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.cut),
best AS (SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY 1),
tops AS (SELECT near.word, any_value(n_near) AS n_near, any_value(most) AS most, min(other) FILTER (n = most) AS top FROM near JOIN best USING (word) GROUP BY 1),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN top END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n
  FROM words LEFT JOIN tops USING (word)),
walk(word, reached) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.reached WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, walk.reached AS root, forms.n, CAST(forms.n_near AS BIGINT) AS n_near, CAST(forms.form_n AS BIGINT) AS form_n
FROM forms JOIN walk USING (word) JOIN forms ends ON ends.word = walk.reached WHERE ends.form IS NULL
"""


def _op12_sql(k: int, rounds: int) -> str:
    """Every round as a table of (cluster, i, y)."""
    parts = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT r, i, q[i] AS x FROM kept, range(1, 65) t(i)),
seeds AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS cluster, q FROM kept),
c0 AS MATERIALIZED (SELECT cluster, i, q[i] AS y FROM seeds, range(1, 65) t(i) WHERE cluster < {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""
d{n} AS (SELECT r, cluster, sum((x - y) * (x - y)) AS d FROM v JOIN c{n} USING (i) GROUP BY 1, 2),
a{n} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{n} GROUP BY 1)""")
        if n < rounds:
            parts.append(f"""
c{n + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(s, y) AS y FROM c{n} LEFT JOIN (
  SELECT cluster, i, CAST(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*) AS HUGEINT) // count(*) AS s FROM v JOIN a{n} USING (r) GROUP BY 1, 2) m USING (cluster, i))""")
    return ",".join(parts) + f""",
named AS (SELECT cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (r) JOIN named USING (cluster)
"""


OP12_SQL = _op12_sql(centroids.CLUSTERS, centroids.ROUNDS)


def _op13_sql(dimensions: list[str], bits: int, shards: int) -> str:
    made, width = sharding.turns(len(dimensions))
    parts = [f"""
WITH RECURSIVE {_CRC_TABLE},
d AS MATERIALIZED (SELECT doc_id, lang, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table)"""]
    for k, name in enumerate(dimensions):
        parts.append(f"""
n{k} AS (SELECT {name}, count(*) AS n FROM d GROUP BY 1),
q{k} AS (SELECT {name}, coalesce(sum(n) OVER (ORDER BY {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {1 << bits} // sum(n) OVER () AS p{k} FROM n{k})""")
    joins = " ".join(f"JOIN q{k} ON d.{name} IS NOT DISTINCT FROM q{k}.{name}" for k, name in enumerate(dimensions))
    cells = ", ".join(f"CAST(p{k} AS BIGINT) AS p{k}" for k in range(len(dimensions)))
    parts.append(f"""
turns AS (SELECT {made} AS turns),
h{bits} AS (SELECT d.doc_id, d.size, d.text_crc32, {cells}, CAST(0 AS BIGINT) AS packed FROM d {joins})""")
    for level in range(bits - 1, -1, -1):
        corner = " + ".join(f"((p{k} >> {level}) & 1) * {1 << k}" for k in range(len(dimensions)))
        held = ", ".join(f"p{k}" for k in range(len(dimensions)))
        parts.append(f"""
h{level} AS (SELECT doc_id, size, text_crc32, {held},
  ((packed >> {width}) << {len(dimensions) + width}) + turns[(packed & {(1 << width) - 1}) * {1 << len(dimensions)} + {corner} + 1] AS packed FROM h{level + 1}, turns)""")
    return ",".join(parts) + f""",
r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY packed >> {width}, doc_id NULLS FIRST, text_crc32) - 1 AS rank, count(*) OVER () AS n FROM h0),
s AS (SELECT *, rank * {shards} // n AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(rank - (shard * n + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""


OP13_SQL = _op13_sql(["lang", "source", "size"], sharding.BITS, sharding.SHARDS)

ORACLE_SQL = {
    "op3_quality_rules": OP3_SQL, "op10_chat_format": OP10_SQL, "op11_spelling_variants": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL, "op13_sharding": OP13_SQL,
}
