"""Registered queries of the operators, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sofralytics.llm import alignment, host_rules, imatch, katz, license_scan, mixing, pii, quality_cnn, sentencepiece, sharding, simhash, url_filter, whitening
from sofralytics.llm.common import documents, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[: pii.BASE])],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op9_host_rules")
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_rules.apply_rules(documents(spark, sf_dir), F.col("source"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_rate", "host_kept", "rule_failed"
    )


# Shares in proportion to the square root of a source's characters, as many characters as there are.
MIX_SQL = """
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY source),
total AS (SELECT sum(pow(CAST(chars AS DOUBLE), 0.5)) AS weight, sum(chars) AS chars FROM sizes),
rates AS (SELECT s.source, CASE WHEN s.chars > 0 THEN pow(CAST(s.chars AS DOUBLE), 0.5) / t.weight * t.chars / s.chars ELSE 0 END AS rate FROM sizes s, total t),
parts AS (SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, r.rate, greatest(CAST(ceil(r.rate / 16.0) AS INTEGER), 1) AS parts FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
draws AS (SELECT *, (CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':~:' || CAST(part AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u, rate / parts AS mean
          FROM (SELECT *, unnest(range(1, parts + 1)) AS part FROM parts)),
terms AS (SELECT mean, k, sum(exp(-mean) * CASE WHEN k = 0 THEN 1 ELSE exp(k * ln(mean) - lgamma(k + 1)) END) OVER (PARTITION BY mean ORDER BY k) AS cdf
          FROM (SELECT mean, unnest(range(0, CAST(floor(mean * 12 + 60) AS INTEGER))) AS k FROM (SELECT DISTINCT mean FROM draws WHERE mean > 0))),
counts AS (SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, CAST(sum(CASE WHEN d.mean > 0 THEN (SELECT count(*) FROM terms t WHERE t.mean = d.mean AND t.cdf < d.u) ELSE 0 END) AS INTEGER) AS copies
           FROM draws d GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM counts
"""


@query("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("mix_key")


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    small_batches(spark)
    net = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), quality_cnn.text_score(net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_cnn.THRESHOLD).cast("int"))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    model = url_filter.train(url_filter.labelled_by_rules(pages, RULES))
    return url_filter.judge(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "p_block")


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return sentencepiece.encode(documents(spark, sf_dir).select("doc_id", "text"), sentencepiece.Vocabulary.load(PIECES))


@query("op8_imatch")
def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch.neighbours(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        imatch.written(F.col("found")).alias("fingerprint"),
        imatch.written(F.col("edited_found")).alias("edited_fingerprint"),
        imatch.likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        imatch.likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return license_scan.scan(docs, license_scan.train(docs))


@query("op6_katz")
def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = katz.train(docs)
    scored = katz.score(docs, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")


# CRC-32 byte by byte over the bytes' hexadecimal digits; numbers drawn from md5 as in the operator.
SHARD_SQL = """
WITH steps AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(x AS BIGINT) FOR x IN range(8)]),
                 lambda r, s: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
keyed AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '~') AS k, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
            xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
              lambda r, b: xor(t[CAST(xor(r & 255, b) AS INTEGER) + 1], r >> 8))) AS text_crc32
          FROM documents, crc),
drawn AS (SELECT *, [substr(md5('13:' || k || ':' || CAST(i AS VARCHAR)), 1, 13) FOR i IN range(9)] AS u FROM keyed),
dealt AS (SELECT *, CAST(list_position(u[1:8], list_max(u[1:8])) - 1 AS INTEGER) AS shard, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS grown_shard FROM drawn)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5('13:slot:' || k), 1, 13), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM dealt
"""
SHARDS = [1.0] * 8


@query("op13_sharding", SHARD_SQL)
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = documents(spark, sf_dir).select("doc_id", sharding.size_of(text).alias("size"), sharding.checksum(text).alias("text_crc32"))
    docs = docs.withColumn("grown_shard", sharding.shard_of(F.col("doc_id"), [*SHARDS, 1.0]))
    found = sharding.slots(sharding.assigned(docs, "doc_id", SHARDS), "doc_id", ["text_crc32", "size"])
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(rows, "embedding", 16)
    explained = F.array(*[F.lit(e) for e in model.explained]).cast("array<double>")
    found = whitening.whitened(rows, "embedding", model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    found = alignment.align(documents(spark, sf_dir).select("doc_id", "text"), BYTE_LEVEL, PIECES, groups=digest)
    return found.withColumnRenamed("groups", "groups_sha256")
