"""One registered query per operator, and the pipeline, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


@query("op1_topk_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 20""")
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import topk_search
    return topk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups
    g = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest
    return pii_digest(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, held_out, predict
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), any_case=True)
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "n_changed",
                        F.round(F.col("n_windows") / F.col("item_windows"), 6).alias("share"))


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode
    return encode(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


SHARD_BYTES = 1 << 20


@query("op6_sharding", f"""
WITH d AS (
  SELECT doc_id, COALESCE(octet_length(encode(text)), 0) AS bytes,
         array_to_string(list_transform(string_split(md5(CAST(doc_id AS VARCHAR)), ''),
                                        lambda c: lpad(bin(CAST('0x' || c AS INTEGER)), 4, '0')), '') AS bits
  FROM documents),
s AS (
  SELECT doc_id, bytes, n, left(bits, CAST(n AS BIGINT)) AS shard,
         SUM(bytes) OVER (PARTITION BY n, left(bits, CAST(n AS BIGINT))) AS shard_bytes,
         COUNT(*) OVER (PARTITION BY n, left(bits, CAST(n AS BIGINT))) AS shard_rows
  FROM d CROSS JOIN range(0, 129) r(n))
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, shard, CAST(n AS INTEGER) AS depth, CAST(0 AS BIGINT) AS part,
       shard_rows, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM s WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import NEW, extendible_shards, read_shards, write_shards
    docs = table(spark, sf_dir, "documents").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = extendible_shards(docs, "doc_id", F.col("bytes"), SHARD_BYTES)
    path = new_folder(spark, "document-shards")
    write_shards(out, path)
    return read_shards(spark, path, out.schema).select("doc_id", "bytes", *NEW)


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return extract_text(pages).select("page_id", "text", F.length("text").alias("n_chars"))


@query("op2_warc_index", """
WITH p AS (
  SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS n, sha256(COALESCE(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""")
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import capture_index
    index = capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompress import substring_dedup
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query("op11_minhash")
def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_groups
    g = minhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, shingle=3)
    return g.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"), top=8).withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_collocations", r"""
WITH d AS (
  SELECT COALESCE(lang, 'und') AS lang,
         translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, k AS words, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, words, phrase, COUNT(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, SUM(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 10),
often AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 10),
parts AS MATERIALIZED (
  SELECT lang, words, phrase, a, k, array_to_string(ws[1:k], ' ') AS p1, array_to_string(ws[k + 1:], ' ') AS p2
  FROM c JOIN (VALUES (1), (2)) v(k) ON k < c.words),
cut AS (
  SELECT parts.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts JOIN often x ON x.lang = parts.lang AND x.phrase = p1 JOIN often y ON y.lang = parts.lang AND y.phrase = p2),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, phrase, MAX(a) AS longer FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE words = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE words = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), top=2000)
