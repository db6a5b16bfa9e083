"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DOCUMENT
from .records import read_records


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file; files whose name begins with _ are left out (Spark's
    readers skip them), and a file that does not parse has a null doc_id and its text in
    _corrupt_record."""
    schema = T.StructType([*DOCUMENT.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("source_file", F.input_file_name())


def mentions_of(annotations: DataFrame) -> DataFrame:
    """(doc_id, id, start, end, type, surface, norm)."""
    e = annotations.select("doc_id", F.explode("entities").alias("e"))
    return e.select("doc_id", "e.id", "e.start", "e.end", "e.type", F.col("e.text").alias("surface"), F.col("e.normalized_id").alias("norm"))


def relations_of(annotations: DataFrame) -> DataFrame:
    """(doc_id, id, type, head, tail, evidence, ev_start, ev_end, basis)."""
    r = annotations.select("doc_id", F.explode("relations").alias("r"))
    return r.select("doc_id", "r.id", "r.type", "r.head", "r.tail", "r.evidence", F.col("r.evidence_start").alias("ev_start"), F.col("r.evidence_end").alias("ev_end"), F.col("r.adjudication_basis").alias("basis"))


def read_splits(spark: SparkSession, path: str, names: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """S3: (doc_id, split) of a JSON object of arrays of ids; other keys are metadata."""
    raw = spark.read.text(path, wholetext=True)
    schema = ", ".join(f"{n} array<string>" for n in names)
    parsed = raw.select(F.from_json("value", schema).alias("s"))
    out = None
    for n in names:
        part = parsed.select(F.explode(F.col("s")[n]).alias("doc_id"), F.lit(n).alias("split"))
        out = part if out is None else out.union(part)
    return out


def documents_of_split(docs: DataFrame, splits: DataFrame, split: str = "all") -> DataFrame:
    """S3: documents of a split (all: of every split); one that is listed but missing fails the
    job when it is read."""
    want = splits if split == "all" else splits.where(F.col("split") == split)
    j = want.select(F.col("doc_id").alias("listed"), "split").join(docs, F.col("listed") == F.col("doc_id"), "left")
    check = F.when(F.col("doc_id").isNull(), F.raise_error(F.concat(F.lit("listed document is missing: "), "listed"))).otherwise(F.col("doc_id"))
    return j.withColumn("doc_id", check).drop("listed")


def write_predictions(predictions: DataFrame, path: str, only_missing: bool = True) -> None:
    """Records by method and split; with ``only_missing`` those that the sink has already
    (doc_id, run_sha256) are left out, so a stopped run goes on where it was."""
    spark = predictions.sparkSession
    todo = predictions
    if only_missing and _exists(spark, path):
        done = spark.read.parquet(path).select("doc_id", "method", "run_sha256")
        todo = predictions.join(done, ["doc_id", "method", "run_sha256"], "left_anti")
    todo.write.mode("append").partitionBy("method", "split").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_window_cache(windows: DataFrame, path: str) -> None:
    """JSON lines; refuses a path that exists."""
    windows.write.mode("errorifexists").json(path)


def read_window_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_feed(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(file, record, year, criteria) of vulnerability feeds, one JSON file (or .gz) a year, in
    either of the two record shapes; criteria are collected at any depth of the configurations.

    Records are streamed out of a file one by one; ``partitions`` deals them out before they are
    searched. Files that break off give the records before the break, see unreadable_feeds."""
    rows = read_records(spark, path, ["vulnerabilities", "CVE_Items"]).where("record is not null").drop("error")
    rows = rows.repartition(partitions) if partitions else rows
    get = lambda *paths: F.coalesce(*(F.get_json_object("record", p) for p in paths))
    name = F.upper(F.trim(get("$.cve.id", "$.id", "$.cve.CVE_data_meta.ID")))
    body = get("$.cve.configurations", "$.configurations")
    found = F.regexp_extract_all(body, F.lit(r'"(?:criteria|cpe23Uri)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    rows = rows.select("file", F.when(name.rlike(r"^CVE-\d{4}-\d+$"), name).alias("record"), F.explode(found).alias("c")).where("record is not null")
    # a JSON string escapes backslashes, which product ids use before colons
    return rows.select("file", "record", F.regexp_extract("record", r"^CVE-(\d{4})-", 1).alias("year"), F.replace("c", F.lit("\\\\"), F.lit("\\")).alias("criteria")).distinct()


def unreadable_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(file, error) of feed files that cannot be read to their end."""
    return read_records(spark, path, ["vulnerabilities", "CVE_Items"]).where("error is not null").select("file", "error")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object whose values are strings or arrays of strings."""
    raw = spark.read.text(path, wholetext=True)
    many = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    values = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    return many.select("key", F.explode(values).alias("value"))


def write_review_queue(queue: DataFrame, path: str) -> None:
    """CSV with blank columns for the reviewer."""
    queue.withColumn("decision", F.lit("")).withColumn("reviewer", F.lit("")).withColumn("comment", F.lit("")).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def mention_inventory(mentions: DataFrame) -> DataFrame:
    """One row a type, surface and id, with its documents joined by |."""
    return mentions.groupBy("type", "surface", "norm").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))), "|").alias("documents"))


def write_inventory(mentions: DataFrame, path: str) -> None:
    mention_inventory(mentions).write.mode("errorifexists").option("header", True).csv(path)


def write_completed_graph(edges: DataFrame, path: str) -> None:
    """Implied edges in a table of their own, apart from the text layer."""
    edges.withColumn("layer", F.lit("mapping")).write.mode("overwrite").partitionBy("layer").parquet(path)
