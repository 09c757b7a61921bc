"""Bounded training samples: ids are chosen first, so that only their texts are touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5) -> DataFrame:
    """doc_id, fold, y, text of at most `rows` labelled ids whose fold isn't 0.

    The choice follows a hash of the id, so it is the same for any partitioning;
    the ids are a table of at most `rows` rows and may be broadcast. A doc_id
    with several labels takes the largest.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).withColumn("fold", crc_mod("doc_id", folds)).where("fold != 0")
    ids = ids.groupBy("doc_id", "fold").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "fold", "y", "text")


def by_language(docs: DataFrame, rows: int, most: int, held_out: int = 1, folds: int = 3) -> tuple[DataFrame, list[str]]:
    """lang, text of about `rows` documents a language, and at most some `most` in all, outside the held-out fold; and the languages.

    A hash of the id decides with a probability set by the language's count;
    there are as many counts as languages. A repeated id counts once, with its least
    language and text; the bound goes by order of the hash, so the choice is the same
    for any partitioning.
    """
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held_out))
    counts = {r["lang"]: r["count"] for r in ok.groupBy("lang").count().collect()}
    if not counts:
        return ok.select("lang", "text").limit(0), []
    each = max(1, min(rows, most // len(counts)))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, share double")
    picked = ok.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    once = picked.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("_t"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * each * len(counts)).select("_t.lang", "_t.text"), sorted(counts)
