"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, isomedia, jaccard, mixture, pii, sharding, substring, toxicity, warc
from .common import documents

SHARDS = [1.0] * 40
MIX = [3.0, 1.0, 2.0]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar(documents(spark, sf_dir), links=True)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARDS)


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select(
        F.col("capture").try_cast("long").alias("page_id"),
        F.coalesce("origin.response.payload_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.coalesce("origin.response.payload_digest", "response.payload_digest").alias("payload_digest"),
        "record_type",
        F.col("origin.capture").try_cast("long").alias("refers_to"),
    )


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir))


def op6_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = isomedia.inspect(isomedia.write_media(documents(spark, sf_dir)), with_payload=True)
    payload, keys = F.col("info.payload"), F.col("info.keyframes")
    ranges = F.array_join(F.transform(keys, lambda k: F.concat_ws("+", k.offset, k["size"])), ",")
    return rows.select(
        "doc_id",
        F.col("info.original_bytes").alias("n_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("codec="), "info.codec", F.lit(" duration="), "info.duration", F.lit("/"), "info.timescale", F.lit(" keyframes="), ranges).alias("feature"),
    )


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.mix(documents(spark, sf_dir), MIX)
    return rows.select(
        "doc_id", "size", F.col("__loom_source_size").alias("source_size"), F.col("__loom_target").alias("target"),
        (F.col("__loom_copies") * F.col("size")).alias("taken"),
    )


def vocabulary() -> tuple[bytes, str]:
    """The rank file and pattern of the queries."""
    import public_tokenizers

    return bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def coded(df: DataFrame) -> DataFrame:
    """doc_id and the digests of a text's ids and of the bytes decoded from them."""
    ranks, pattern = vocabulary()
    rows = bpe.round_trip(df, ranks, pattern)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(documents(spark, sf_dir))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> dict | None:
    return toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_exact_dedup, op3_rendezvous_sharding, op4_warc_transactions, op5_pii_surrogates, op6_iso_media, op7_source_mixture, op8_bpe_duckdb, op9_toxicity_bigru, op10_rlz_substring_dedup)}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(2, len(ws) - 3))) t(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, e.b FROM r JOIN e ON r.node = e.a)
        SELECT start AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(node) AS component_id, (SELECT count(*) FROM e WHERE e.a = start) AS n_links
        FROM r LEFT JOIN n ON n.doc_id = start GROUP BY start""",
    "op4_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hexed FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS origin FROM p)
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hexed, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> origin THEN origin END AS refers_to
        FROM o""",
    "op10_rlz_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        v AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM w, unnest(range(1, len(ws) - 33)) t(i)),
        d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM v) WHERE n > 1),
        g AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM d, unnest(range(35)) t(k) GROUP BY doc_id),
        k AS (SELECT w.doc_id, ws, coalesce(len(gone), 0) AS n_removed,
                     CASE WHEN gone IS NULL THEN ws ELSE (SELECT coalesce(list(ws[i] ORDER BY i), []) FROM unnest(range(1, len(ws) + 1)) t(i) WHERE NOT list_contains(gone, i)) END AS kept
              FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op7_source_mixture": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        w AS (
            SELECT *, CASE nth % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap,
                   CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM s),
        f AS (
            SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM w),
        l AS (
            SELECT *, (SELECT arg_min(own, (cap / weight, nth)) FROM f WHERE own <= cap / weight) AS level FROM f),
        t AS (
            SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM l),
        r AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate FROM t)
        SELECT d.doc_id, d.size, r.source_size, r.target,
               d.size * CAST(floor(r.rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
                                                       < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
}
