"""From raw documents to balanced shards: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``. A driver may write each result and hand its rows to the next stage;
``run`` checkpoints between stages instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontamination, jaccard_join, quality_classifier, sharding, source_mixing
from tallyweave.llm.common import checkpointed, read

SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; learnt from the labels of ``docs``."""
    sample = quality_classifier.labelled_sample(docs, read(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")  # so that no column of docs can clash
    scored = quality_classifier.score(whole, quality_classifier.fit(sample), into="_score")
    return scored.filter(F.col("_score") >= quality_classifier.CUT_SCORE).select("_row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8."""
    return jaccard_join.drop_near_copies(docs, n=5, percent=80)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for: 150 % of all words, at most twice a source."""
    return source_mixing.mixed_documents(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix goes: shard and slot."""
    text = F.col("text")
    rows = checkpointed(docs.select("doc_id", "source", sharding.text_bytes(text).alias("size"), sharding.text_checksum(text).alias("text_crc32")))
    return sharding.shard_by_bytes(rows, SHARDS)


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_distinct),
    ("decontamination", keep_clean),
    ("source_mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Neither the learnt scores nor the closure over links can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
