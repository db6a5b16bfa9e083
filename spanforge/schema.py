"""Table schemas and the default ontology (every table is replaceable by the caller)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MENTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("normalized_id", T.StringType()), T.StructField("evidence", T.StringType()), T.StructField("notes", T.StringType())])
RELATION = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("evidence", T.StringType()), T.StructField("evidence_start", T.IntegerType()), T.StructField("evidence_end", T.IntegerType()), T.StructField("adjudication_basis", T.StringType())])
DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("schema_version", T.StringType()), T.StructField("annotation_protocol_version", T.StringType()),
    T.StructField("boundary_contract_version", T.StringType()), T.StructField("annotation_status", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("entities", T.ArrayType(MENTION)), T.StructField("relations", T.ArrayType(RELATION)),
])

# The closed vocabularies of mention types, and of relations with their ends.
ENTITY_TYPES = ["Vulnerability", "Configuration", "Weakness", "AttackTechnique", "AttackTactic", "KillChainPhase"]
RELATION_SIGNATURES = [
    ("affects", "Vulnerability", "Configuration", "text"),
    ("instantiates", "Vulnerability", "Weakness", "text"),
    ("exploited_by", "Vulnerability", "AttackTechnique", "text"),
    ("implies", "AttackTechnique", "AttackTactic", "mapping"),
    ("belongs_to_phase", "AttackTactic", "KillChainPhase", "mapping"),
]


def dim_entity_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ENTITY_TYPES], "type string")


def dim_relation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATION_SIGNATURES, "type string, head_type string, tail_type string, layer string")
