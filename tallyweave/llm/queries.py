"""The operators of this subpackage over the synthetic tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import (
    decontamination,
    embedding_whitening,
    html_extraction,
    jaccard_join,
    language_id,
    media_columns,
    oracles,
    quality_classifier,
    quality_rules,
    ranked_search,
    secret_scans,
    sharding,
    source_mixing,
    url_filters,
)
from tallyweave.llm.common import checkpointed, read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.filter_urls(pages, url_filters.default_rules())
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secret_scans.scan_secrets(docs)
    kind = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    return spans.select("doc_id", kind("assign"), kind("access"), kind("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = checkpointed(docs.select("doc_id", "source", source_mixing.word_count(F.col("text")).alias("size")))
    mixed = source_mixing.mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leak_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.col("text")
    rows = checkpointed(docs.select("doc_id", sharding.text_bytes(text).alias("size"), sharding.text_checksum(text).alias("text_crc32")))
    cut = sharding.shard_by_bytes(rows, 16)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = language_id.fold(F.col("doc_id"), 4) == 2
    content = language_id.dictionaries(language_id.sample_texts(docs.filter(~held_out)))
    found = language_id.identify(docs.select("doc_id", "text"), content)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return media_columns.media_facts(docs)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = language_id.fold(F.col("doc_id"), 5) == 0
    ranker = quality_classifier.fit(quality_classifier.labelled_sample(docs, labels.filter(~held_out)))
    scored = quality_classifier.score(docs.select("doc_id", "text"), ranker)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_classifier.CUT_SCORE).cast("int").alias("predicted"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extraction.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = checkpointed(quality_rules.text_facts(read(spark, sf_dir, "documents").select("doc_id", "text")))
    found = quality_rules.judged(facts, quality_rules.estimate(facts))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (F.col("probability") >= quality_rules.THRESHOLD)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, failed.alias("base_failed"), kept.alias("kept"), "probability")


_ALL = (
    op1_url_filters,
    op2_secret_scans,
    op3_source_mixing,
    op4_decontamination,
    op5_sharding,
    op6_language_id,
    op7_media_columns,
    op8_quality_classifier,
    op9_html_extraction,
    op10_jaccard_join,
    op11_ranked_search,
    op12_embedding_whitening,
    op13_quality_rules,
)
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}
ORACLES = oracles.ORACLES
