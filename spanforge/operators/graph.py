"""Graph completion by mapping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio


def map_ids(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions with the values that the mapping (key, value) has for their id, or else for
    the part before the first dot; several values give several rows, none a null."""
    m = F.broadcast(mapping.groupBy("key").agg(F.collect_set("value").alias("values")))  # dimension table
    a = m.select(F.col("key").alias("norm"), F.col("values").alias("exact"))
    b = m.select(F.col("key").alias("parent"), F.col("values").alias("above"))
    j = mentions.join(a, "norm", "left").withColumn("parent", F.substring_index("norm", ".", 1)).join(b, "parent", "left")
    return j.withColumn("value", F.explode_outer(F.coalesce("exact", "above"))).drop("parent", "exact", "above")


def complete(mentions: DataFrame, mapping: DataFrame, phases: DataFrame, exploited: DataFrame, override: tuple[str, str] = ("initial-access", "exploitation")) -> DataFrame:
    """Edges (doc_id, relation, head, tail, support, provenance) from ids to tactics
    (implies) and from tactics to phases (belongs_to_phase), once a document.

    phases: (tactic, phase). A technique that is the tail of an exploit relation of the
    document (exploited: doc_id, norm) takes override[1] as the phase of tactic override[0]."""
    rows = map_ids(mentions.where("norm is not null"), mapping).where("value is not null")
    flag = exploited.select("doc_id", "norm").distinct().withColumn("hit", F.lit(True))
    rows = rows.join(flag, ["doc_id", "norm"], "left").join(F.broadcast(phases.select(F.col("tactic").alias("value"), "phase")), "value", "left")
    rows = rows.withColumn("phase", F.when(F.col("hit") & (F.col("value") == override[0]), override[1]).otherwise(F.col("phase")))
    implies = rows.select("doc_id", F.lit("implies").alias("relation"), F.col("norm").alias("head"), F.col("value").alias("tail"), "id")
    belongs = rows.where("phase is not null").select("doc_id", F.lit("belongs_to_phase").alias("relation"), F.col("value").alias("head"), F.col("phase").alias("tail"), "id")
    return implies.union(belongs).groupBy("doc_id", "relation", "head", "tail").agg(F.count("*").alias("support"), F.array_sort(F.collect_set("id")).alias("provenance"))


def unmapped(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """K3: (norm, n, n_docs) of ids that neither they nor their parents have a mapping for."""
    rows = map_ids(mentions.where("norm is not null"), mapping).where("value is null")
    return rows.groupBy("norm").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def document_status(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """K3: (doc_id, status): complete, or review where an id is unmapped."""
    rows = map_ids(mentions.where("norm is not null"), mapping)
    return rows.groupBy("doc_id").agg(F.when(F.bool_or(F.col("value").isNull()), "review").otherwise("complete").alias("status"))


def coverage(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions with an id, those mapped, and the rate, by type."""
    keys = ["doc_id", "start", "end", "type"]
    rows = map_ids(mentions.where("norm is not null"), mapping).groupBy(*keys).agg(F.max(F.col("value").isNotNull()).alias("mapped"))
    out = rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if("mapped").alias("n_mapped"))
    return out.withColumn("rate", ratio(F.col("n_mapped"), F.col("n")))
