"""The corpus pipeline: stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir), judges all of its input, and returns a
DataFrame that is written as Parquet and read again as the next one's `docs`.

Rows with null or empty texts are kept by all stages but the first, which scores
them as it does any text. Rows with a null doc_id are never dropped as copies. Very
long texts are read whole. Repeated rows are copies: one of them stays. Further
columns pass through, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkway.llm import decontaminate, jaccard, packing, quality_fm, sentences
from sparkway.llm.common import bound_batches, delete, delete_on_exit, drop_scratch, fresh, materialize, scratch_root, table

#: Near-duplicates: words in a shingle, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (80, 100)
SCOPE = "pipeline"
#: Stages can't be written as SQL: trained scores, hashed joins and a tokenizer.
ORACLE_SQL = None


def begin(spark: SparkSession) -> None:
    """Before a stage: what the last one kept beside its result is deleted."""
    bound_batches(spark)
    drop_scratch(spark, SCOPE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    begin(spark)
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a key of each row, the same in each read: a hash of its place in a Parquet file, or else a number that is written with it once."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.xxhash64(place["file_path"], place["row_index"]))
    except AnalysisException:  # not rows of a file as they are
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), SCOPE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: of the smallest doc_id, and of its rows the first by key. Rows without an id, and without words, stay.

    Rows are judged one by one under a key of their own, whatever other rows have their doc_id.
    """
    begin(spark)
    row, doc = fresh(docs.columns, "_row", "_doc")
    keyed = with_row_key(docs, row)
    named = keyed.where("doc_id is not null")
    groups = jaccard.join(named.select(F.col(row).alias("doc_id"), "text"), SHINGLE, *SIMILAR, scope=SCOPE).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    # Only groups of several rows lose any; their least row is not that of the component for one row at least.
    several = groups.where(F.col(row) != F.col("component_id")).select("component_id").distinct()
    joined = groups.join(several, "component_id", "left_semi").join(named.select(row, F.col("doc_id").alias(doc)), row)
    joined = materialize(joined, SCOPE)
    stay = joined.groupBy("component_id").agg(F.min(F.struct(doc, row)).alias("_first")).select(F.col(f"_first.{row}").alias(row))
    gone = materialize(joined.select(row).join(stay, row, "left_anti"), SCOPE)
    return keyed.join(gone, row, "left_anti").drop(row)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts sentences of passages that occur earlier."""
    begin(spark)
    return sentences.dedup(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words of benchmark windows."""
    begin(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    begin(spark)
    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), scope=SCOPE)


STAGES = [("quality_classifier", keep_quality), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", drop_repeated_passages), ("benchmark_decontamination", drop_benchmark), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote is deleted once the next has read it; the last folder when the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        delete_on_exit(spark, path)
        if before:
            delete(spark, before)
        before = path
    drop_scratch(spark, SCOPE)
    return docs
