"""The queries over the tables: each operator with production parameters, and its digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, mixing, ogg, pieces, pii, quality, secrets, token_store, toxicity, urls
from .common import shared_dir, span_text

#: Places of the tokenizers' files; None: those of the installed package.
TOKENIZERS: dict[str, str | None] = {"byte_bpe_50k.json": None, "piece_bpe_32k.model": None}

#: URL rules: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Listed canonical URLs that the filter blocks where no rule decides: hosts with all
#: their paths.  A stand-in for a published list of hosts, which would be a table.
URL_LIST = [(f"{name}.example.{zone}", "") for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org")]

TOXIC_FROM = 0.3


def tokenizer(name: str) -> str:
    if TOKENIZERS[name]:
        return TOKENIZERS[name]
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _span_columns(kinds: list[str]) -> list[Column]:
    return [*(_count(F.col("base"), k) for k in kinds), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", *_span_columns(["assign", "access", "hex"]))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"))
    return token_store.read_digests(spark, path).withColumnRenamed("doc", "doc_id")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).select("doc_id", *_span_columns(["email", "ip", "card", "phone"]))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.assess(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "p_good")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = ogg.mux_documents(table(spark, sf_dir, "documents"))
    kept = media.select("doc_id", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = ogg.demux_media(kept, ["doc_id", "media_bytes", "media_sha256"])
    feature = F.format_string("pages=%d packets=%d us=%d mean=%.4f deviation=%.4f", "pages", "packets", "duration_us", "mean", "deviation")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(h, p, a, 1, False) for h, p, a in URL_RULES] + [(h, p, "block", 0, True) for h, p in URL_LIST]
    rules = spark.createDataFrame(rows, "host string, path string, action string, priority int, canonical boolean")
    judged = urls.judge(table(spark, sf_dir, "pages"), rules)
    return judged.select("page_id", "host", "path", F.when(F.col("priority") == 1, F.col("rule")).alias("rule"), F.coalesce("action", F.lit("allow")).alias("verdict"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    return pieces_digest(pieces.encode_documents(table(spark, sf_dir, "documents"), model), model)


def pieces_digest(encoded: DataFrame, model: str) -> DataFrame:
    kept = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    back = pieces.decode_documents(kept, model, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    scored = toxicity.score(docs, model.classifier, ["doc_id"])
    return scored.select("doc_id", F.coalesce(~toxicity.learnable(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_token_store, op3_personal_data, op4_mix_sources, op5_quality_rules, op6_jaccard_join, op7_ogg_media, op8_url_filter, op9_sentence_pieces, op10_toxicity)}


_LISTED = ", ".join(f"('{h}', '{p}', '{a}', 1)" for h, p, a in URL_RULES)
_BLOCKED = ", ".join(f"('{h}', '{p}')" for h, p in URL_LIST)


def oracle_sql() -> dict[str, str]:
    return {
        "op8_url_filter": rf"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(h, p, action) AS (VALUES {_LISTED}),
blocked(h, p) AS (VALUES {_BLOCKED}),
plain AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '\.+$', '') AS chost,
         CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/+', '/', 'g') END AS cpath
  FROM cut),
met AS (
  SELECT page_id, host, path, 1 AS priority, action, h || p AS rule FROM plain JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  UNION ALL
  SELECT page_id, host, path, 0, 'block', h || p FROM plain JOIN blocked ON host <> '' AND (chost = h OR ends_with(chost, '.' || h)) AND starts_with(cpath, p)
  UNION ALL
  SELECT page_id, host, path, -1, 'allow', NULL FROM plain),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, host, path ORDER BY priority DESC, length(rule) DESC) AS k FROM met)
SELECT page_id, host, path, CASE WHEN priority = 1 THEN rule END AS rule, action AS verdict
FROM best WHERE k = 1""",
    }
