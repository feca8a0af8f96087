"""The numbered corpus operators as queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, cuckoo, divergence, extract, fingerprint, katz, minhash, mixing, oracles, quality, repeats, search, url_filter
from .common import read

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LISTED = ("casino-win.example.com", "ads-track.example.com", "ads-track.example.org", "free-bets.example.com", "spam-farm.example.com", "cheap-pills.example.com", "adult-x.example.net")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(h, "") for h in LISTED], "host string, path string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules, listed).drop("url")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("th", "label")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", (quality.fold() == 0).alias("held_out"))
    return quality.classify(rows, model, keep=["doc_id", "held_out"])


VOCABULARY = "word_bpe_49k.json"


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode(read(spark, sf_dir, "documents"), VOCABULARY, outputs=("n_tokens", "packed", "decoded"), keep=["doc_id"])
    return made.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = quality.fold() == 1
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", side.alias("held_out"), (~side).alias("train"))
    return katz.score_texts(docs).withColumns({c: F.round(c, 7) for c in ("base_score", "score")})  # sums in any order agree so far


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edited(read(spark, sf_dir, "documents"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where(search.is_query()).select(F.col("doc_id").alias("query_id"), "text")).withColumn("score", F.round("score", 6))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.duplicates(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_html_text, op3_near_duplicates, op4_quality, op5_bpe, op6_repeats, op7_katz, op8_source_mixing, op9_fingerprints, op10_search, op11_filter_audit, op12_source_divergence, op13_exact_dedup)}
ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.sql(RULES, LISTED),
    "op3_near_duplicates": oracles.NEAR_DUPLICATES,
    "op6_repeats": oracles.REPEATS,
    "op7_katz": oracles.KATZ,
    "op8_source_mixing": mixing.SQL,
    "op9_fingerprints": fingerprint.SQL,
    "op10_search": oracles.SEARCH,
    "op11_filter_audit": audit.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_exact_dedup": cuckoo.SQL,
}
