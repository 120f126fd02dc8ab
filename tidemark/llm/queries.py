"""Queries over the whole tables, one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, embedding_dedup, exact_dedup, language_id, mixing, near_dedup, quality, substring_dedup, token_table, url_filter

URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.coalesce("first_start", F.lit(-1)).alias("first_start"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.near_vectors(spark, table(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_table.token_table(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_minhash_near_dedup, op3_exact_dedup, op4_url_filter, op5_embedding_near_dedup, op6_byte_bpe, op7_quality, op8_token_table, op9_mixing, op10_substring_dedup)
}

SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op4_url_filter": r"""
        WITH cutup AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/(.|\n|\r)*$') AS path FROM cutup
        ), rules(verdict, rhost, rpath) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), fits AS (
            SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
            FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND k = 1""",
    "op9_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents
        ), sources AS (
            SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, CAST(n * 2 AS DOUBLE) AS cap FROM sources
        ), levels AS (
            SELECT *, (CAST(sum(n) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM weighed
        ), chosen AS (
            SELECT here AS level FROM levels WHERE here * weight <= cap ORDER BY cap / weight, rank LIMIT 1
        ), goals AS (
            SELECT source, CAST(n AS BIGINT) AS source_size, coalesce(least((SELECT level FROM chosen) * weight, cap), cap) AS target FROM weighed
        ), sloped AS (
            SELECT w.source, g.source_size, g.target, CAST(CASE w.rank % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0 ELSE -0.5 END AS DOUBLE) AS slope FROM weighed w JOIN goals g ON w.source IS NOT DISTINCT FROM g.source
        ), laid AS (
            SELECT s.doc_id, s.size, s.k, g.source_size, g.target, g.slope, coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CAST(s.size AS DOUBLE) / 2 AS mid
            FROM sized s JOIN sloped g ON s.source IS NOT DISTINCT FROM g.source
        ), plays AS (
            SELECT *, (mid + e * source_size) / target AS u FROM laid, range(2) t(e) WHERE size > 0 AND mid + e * source_size < target
        ), placed AS (
            SELECT *, CASE WHEN slope = 0 THEN u ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END AS position FROM plays
        ), started AS (
            SELECT doc_id, size, coalesce(sum(size) OVER (ORDER BY position, k, doc_id, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed
        ), taken AS (
            SELECT doc_id, sum(size) AS taken, min(start) AS first_start FROM started GROUP BY doc_id
        )
        SELECT doc_id, l.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(first_start, -1) AS BIGINT) AS first_start FROM laid l LEFT JOIN taken USING (doc_id)""",
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), shingles AS (
            SELECT doc_id, unnest(list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
            JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))
        ), both_ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
        )
        SELECT r.a AS doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a GROUP BY r.a""",
    "op5_embedding_near_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), usable AS (
            SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= CAST(0.98 AS DOUBLE)
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a
        )
        SELECT r.a AS vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = r.a) AS BIGINT) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r GROUP BY r.a""",
    "op10_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), windows AS (
            SELECT r, i, array_to_string(w[i : i + 34], ' ') AS passage FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words)
        ), repeated AS (
            SELECT passage FROM windows GROUP BY passage HAVING count(*) > 1
        ), covered AS (
            SELECT DISTINCT r, i + k AS j FROM windows SEMI JOIN repeated USING (passage), range(35) t(k)
        ), kept AS (
            SELECT x.r, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.j) AS text FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words) x ANTI JOIN covered c ON x.r = c.r AND x.j = c.j GROUP BY x.r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (r)""",
}
