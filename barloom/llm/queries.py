"""The registered queries op1 to op13: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, language_id, language_model, line_dedup, mixing, nearest, periodic_runs, pii, quality_classifier, quality_rules, simhash, url_filter
from .base import as_text, fold, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = {k.name: F.col(f"pii.{k.name}") for k in pii.BASE + pii.FURTHER}
    base = [spans[k.name] for k in pii.BASE]
    counts = lambda kinds: [F.size(spans[k.name]).cast("long").alias(f"n_{k.name}") for k in kinds]
    return out.select("doc_id", *counts(pii.BASE), F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(list(spans.values())).alias("spans"), *counts(pii.FURTHER))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    w = quality_classifier.fit(docs, labels, fold("_id", 3) != 1)
    out = quality_classifier.score(docs, w)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select(F.col("_c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, words = language_model.fit(docs, fold("_id", 10) != 0)
    out = language_model.score(docs, model, words)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = line_dedup.dedup(docs, line_dedup.LineIndex.build(docs), ["doc_id"])
    return out.select(F.col("_c0").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs, fold("_id", 4) != 2), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("_id") % 50 == 0)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in texts whose crc32(doc_id) ends in 0, words from some place on repeat with some period."""
    h, words = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")), F.regexp_extract_all(as_text(docs, "text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", as_text(docs, "text").alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w")))
    rows = rows.withColumn("p", 1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    word = F.transform("w", lambda x, i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.find(planted(table(spark, sf_dir, "documents")), ["doc_id"]).withColumn("best", periodic_runs.longest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    digests = [F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")]
    return out.select(F.col("_c0").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *best, exponent, *digests)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_language_model": op7_language_model,
    "op8_url_filter": op8_url_filter,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_LINES = "string_split(coalesce(text, ''), chr(10))"

def _rounds(n: int) -> str:
    """Rounds of clustering, one after another; x % c + c) % c rounds quotients down."""
    near = "SELECT vec_id, v, unnest(arg_min({k: k, d: d}, (d, k))) FROM (SELECT vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x, %s) GROUP BY vec_id, v"
    out = ""
    for i in range(n):
        out += f""",
a{i} AS MATERIALIZED ({near % f"c{i}"}),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT k, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS y, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (k))"""
    return out + f",\nz AS ({near % f'c{n}'})"


#: op1 needs look-behind, op5 XXH64, op12 a checksum that SQL lacks, and the others learn: tests hold these against plain versions and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS digest FROM documents),
p AS (SELECT source, sum(size) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s GROUP BY source),
q AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM p),
v AS (SELECT a.ratio, ((SELECT sum(source_size) FROM q) - coalesce(sum(CASE WHEN b.ratio < a.ratio THEN 3.0::DOUBLE * b.source_size END), 0)) / sum(CASE WHEN b.ratio >= a.ratio THEN b.w END) AS level FROM q a, q b GROUP BY a.source, a.ratio),
z AS (SELECT min(level) FILTER (WHERE ratio = (SELECT min(ratio) FROM v WHERE ratio > level)) AS stop FROM v),
t AS (SELECT source, source_size, CASE WHEN stop IS NULL OR ratio <= stop THEN 3.0::DOUBLE * source_size ELSE w * stop END AS target FROM q, z),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(target) AS BIGINT) // source_size * size + greatest(0, least(size, CAST(round(target) AS BIGINT) % source_size - start)) END AS BIGINT) AS taken
FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source""",
    "op6_decontaminate": f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM bi),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw)),
h AS (SELECT doc_id, i, m, item FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM di) JOIN bw USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op8_url_filter": f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UP}', '{_LOW}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES {', '.join(str(x) for x in url_filter.RULES)}),
f AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host || path <> '' AND (len(list_intersect(string_split(host, '.'), {list(url_filter.SITES)})) > 0 OR starts_with(md5(host || path), '0')) THEN 'block' ELSE 'allow' END) AS verdict FROM u LEFT JOIN f USING (page_id)""",
    "op9_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
g AS (SELECT k.*, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id""",
    "op11_nearest_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op13_centroid_clustering": f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM x ORDER BY h, v LIMIT 40)){_rounds(5)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c5 USING (k)""",
}
