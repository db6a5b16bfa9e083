"""Content hashes, manifests, stale predictions, reproduction (V1-V4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """V1: (doc_id, sha256) of every document."""
    return docs.select("doc_id", F.sha2(F.col(text), 256).alias("sha256"))


def aggregate_hash(hashes: DataFrame, buckets: int = 256) -> DataFrame:
    """V1: one hash for all (doc_id, sha256), whatever their order.

    Two levels: sorted lines are hashed in buckets of the document hash, then the buckets'
    hashes in order; the bucket count is part of the definition."""
    line = F.concat_ws(":", F.col("doc_id").cast("string"), "sha256")
    rows = hashes.select(F.pmod(F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long"), F.lit(buckets)).alias("b"), line.alias("line"))
    per = rows.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    return per.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"))


def verify_manifest(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """V2: (doc_id, status): same, changed, missing (only in the manifest) or extra."""
    m = manifest.select("doc_id", F.col("sha256").alias("frozen"))
    j = current.join(m, "doc_id", "full_outer")
    status = F.when(F.col("frozen").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("frozen"), "same").otherwise("changed")
    return j.select("doc_id", status.alias("status"))


def stale_predictions(predictions: DataFrame, current: DataFrame, lineage: str) -> DataFrame:
    """V3: (doc_id, status) of prediction records (doc_id, run_sha256, source_sha256)."""
    j = predictions.join(current.select("doc_id", "sha256"), "doc_id", "left")
    status = F.when(F.col("sha256").isNull(), "no_source").when(~F.col("source_sha256").eqNullSafe(F.col("sha256")), "source_changed").when(~F.col("run_sha256").eqNullSafe(F.lit(lineage)), "other_run").otherwise("fresh")
    return j.select("doc_id", status.alias("status"))


def reproduce(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """V4: rows on which two score tables disagree, with the side that has them."""
    a = recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed"))
    return a.union(stored.exceptAll(recomputed).withColumn("side", F.lit("stored")))
