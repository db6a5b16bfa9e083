"""Five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is
written as Parquet and reread before the next one. All but the last return the columns of
``documents``.

Edge cases: null and empty texts pass the quality stage (nothing speaks against them), are
equal to each other in the duplicate stages, have no words for the mix, and are one end token
in a sequence; rows that repeat id and text become one in the exact stage; a null id is kept
like any other and never names a group; an empty table gives an empty result; further columns
of the documents are carried through the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import exact_dedup, mixing, near_sets, packing, quality_lm
from spanforge.llm.common import materialize, small, table


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows named by the stored table (id, row_key), a hash of the text."""
    d = small(dropped).select(F.col("id").alias("_i"), F.col("row_key").alias("_k"))
    return docs.join(d, docs["doc_id"].eqNullSafe(F.col("_i")) & (F.xxhash64(docs["text"]) == F.col("_k")), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go."""
    out = quality_lm.classify(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return _without(docs, materialize(out.where("not kept").select("id", "row_key"), "rejected"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in any case) the row with the largest id stays."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    out = exact_dedup.exact_dedup(docs, f"id > {((lo or 0) + (hi or 0)) // 2}")
    out = materialize(out.select("id", "row_key", "kept"), "kept")
    rows = out.groupBy("id", "row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    left = _without(docs, materialize(rows.where("not kept").select("id", "row_key"), "dropped"))
    again = rows.where("kept and n > 1")
    if not again.take(1):
        return left
    # the same row several times: one stays
    once = left.dropDuplicates(["doc_id", "text"])
    return once


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard ratio of 0.8 (words by five) the document with the smallest id stays."""
    out = near_sets.near_duplicates(docs)
    return _without(docs, materialize(out.where("not (id <=> component_id)").select("id", "row_key"), "near"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in the order of its training position."""
    copies = mixing.order_mix(mixing.mix(docs), sort=False).select(F.col("id").alias("_i"), F.col("row_key").alias("_k"), "position").distinct()
    rows = docs.join(copies, docs["doc_id"].eqNullSafe(F.col("_i")) & (F.xxhash64(docs["text"]) == F.col("_k")))
    ordered = rows.repartitionByRange(F.col("position")).sortWithinPartitions("position", "doc_id")
    return ordered.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document with their sequence and place in it."""
    out = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]
#: Perplexities and fingerprints have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
