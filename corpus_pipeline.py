"""Corpus pipeline: each stage works on all that the one before it kept.

1. quality: the classifier is fitted on labelled rows that are left, and rows it rejects go;
2. near_dedup: one document of each near-duplicate group stays (80 per cent of five-word shingles);
3. decontaminate: documents that hold a benchmark passage go;
4. mix: rows are put in the order of a Pfair mixture of their sources;
5. shard: every row gets its shard, and its slot there by the order of the mixture.

All stages but the last return the columns of `documents`, whatever further
ones there are and however they are named. As Spark does not keep the order of
files that it reads, the last stage finds the positions of the mixture again:
they hang on ids, sources and texts only.

Null and empty texts are scored like others, are no near duplicates and hold no
benchmark item; a null source is a source of its own. Of equal rows one stays;
other rows of a null or repeated id are documents of their own. Texts of any
length are read whole. Ties are broken by ids and hashes of texts. An empty
table gives an empty result. A stage's table is deleted when the next one is
written; the last one's stays below the checkpoint folder, as run()'s rows are
read from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontaminate, mixing, neardup, quality, sharding
from plinth.llm.common import aside, remove_table, table, write_and_read, write_table  # noqa: F401  tests use write_and_read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.distinct_documents(docs, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(docs: DataFrame, weights: dict[str, float], text_hash: Column) -> DataFrame:
    """`docs` plus mix_position; ids can be null or repeated, then texts tell rows apart."""
    keyed = docs.withColumn("_key", F.struct("doc_id", text_hash.alias("text_hash")))
    return mixing.mix(keyed, weights, id_col="_key").select(*docs.columns, "mix_position")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden, back = aside(docs, "doc_id", "text", "source")
    rows = mixed(hidden, mixing.tempered(docs, power=0.7), F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return back(rows.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position"))


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = mixing.tempered(docs, power=0.7)
    rows = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("_text_hash"))
    place = lambda light: mixed(light, weights, F.col("_text_hash")).withColumnRenamed("mix_position", "position")
    return sharding.shard(rows, shards=24, place=place).drop("source", "_text_hash")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: SQL can't express the classifier or the schedule; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir), name)
        if before:
            remove_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
