"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, work_path


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of nothing but responses, the same deduplicated, and what is read back of those."""
    from .warc import dedup_archives, read_archives, write_archives

    path, fresh = work_path(spark, "warc"), work_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, revisits=False)
    dedup_archives(spark, path, fresh)
    return read_archives(spark, fresh, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    out = round_trip(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no path; theirs is made of the source and the thousands of the id."""
    from .licenses import scan

    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(table(spark, sf_dir, "documents"), path)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call counts and fills the cache, the second finds every text in it."""
    from .tokcount import count_tokens

    cache = work_path(spark, "token-counts")
    count_tokens(table(spark, sf_dir, "documents"), cache=cache)
    out = count_tokens(table(spark, sf_dir, "documents"), cache=cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find, in_order, written_out

    found = find(table(spark, sf_dir, "documents"))
    base = in_order(F.concat(*(F.col(k) for k in KINDS)))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(written_out(base), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_language": op5_language,
    "op6_bpe": op6_bpe,
    "op7_main_text": op7_main_text,
    "op8_licenses": op8_licenses,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
}

#: SQL gives the four base-32 digits of each five hex digits.
_BASE32 = " || ".join(f"to_base(('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT, 32, 4)" for i in range(8))

SQL: dict[str, str] = {
    "op1_nearest": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
              AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM pairs)
        SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10""",
    "op2_warc": f"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
        d AS (
            SELECT *, translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
                   max(page_id) OVER (PARTITION BY sha) AS original
            FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
        FROM d""",
}
