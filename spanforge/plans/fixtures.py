"""Annotation tables derived from ``documents``: the inputs of the registered queries.

Mentions are words of six and more ASCII letters, drawn and typed by a keyed hash of document
and offset, so that another engine can build the same tables; ``PRELUDE`` is their SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import keyed_number
from ..operators.dedup import stored
from ..operators.textscan import scan

WORDS = "[A-Za-z]{6,}"
COLUMNS = ["doc_id", "start", "end", "type", "surface", "norm", "id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Annotations:
    """docs, gold, pred, pred2, gold_rel, pred_rel, pred2_rel and splits of one input directory; texts
    are scanned for mentions when these are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.docs = table(spark, sf_dir, "documents")
        day = keyed_number(F.col("doc_id").cast("string")) % 5
        self.splits = self.docs.select("doc_id", F.when(day < 3, "train").when(day == 3, "dev").otherwise("test").alias("split"))

    @cached_property
    def tokens(self) -> DataFrame:
        # texts are dealt out first: what is scanned stays where it was read
        tok = scan(self.docs.select("doc_id", "text").repartition("doc_id"), WORDS).withColumn("h", keyed_number(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("start").cast("string"))))
        tok = stored(tok.drop("i"))  # texts are scanned once, however often a query asks for its mentions
        kind = F.element_at(F.array(*[F.lit(t) for t in ("Vulnerability", "Configuration", "Weakness", "AttackTechnique")]), (F.expr("h div 16") % 4 + 1).cast("int"))
        return tok.withColumn("type", kind).withColumn("norm", F.when(F.expr("h div 64") % 10 < 9, F.upper("surface")))

    @cached_property
    def _named(self) -> DataFrame:
        return self.tokens.withColumn("id", F.concat(F.lit("E"), F.col("start").cast("string")))

    def _predicted(self, hit, cut, extra) -> DataFrame:
        is_gold = F.col("h") % 10 < 3
        short = F.when(is_gold & cut, 2).otherwise(0)
        rows = self._named.where((is_gold & hit) | (~is_gold & extra)).withColumn("_cut", short)
        rows = rows.withColumn("end", F.col("end") - F.col("_cut")).withColumn("surface", F.expr("substr(surface, 1, length(surface) - _cut)"))
        return rows.select(*COLUMNS)

    gold = cached_property(lambda self: self._named.where(F.col("h") % 10 < 3).select(*COLUMNS))
    pred = cached_property(lambda self: self._predicted(F.expr("h div 1024") % 10 < 8, F.expr("h div 16384") % 10 == 0, F.expr("h div 256") % 100 == 57))
    pred2 = cached_property(lambda self: self._predicted(F.expr("h div 262144") % 10 < 7, F.expr("h div 4194304") % 10 == 0, F.expr("h div 67108864") % 100 == 23))
    gold_rel = cached_property(lambda self: self._relations(self.gold))
    pred_rel = cached_property(lambda self: self._relations(self.pred))
    pred2_rel = cached_property(lambda self: self._relations(self.pred2))

    @staticmethod
    def _relations(m: DataFrame) -> DataFrame:
        w = Window.partitionBy("doc_id").orderBy("start")
        nxt = {c: F.lead(c).over(w) for c in ("start", "end", "type", "id")}
        rows = m.select("doc_id", "start", "end", F.col("type").alias("head_type"), F.col("id").alias("head"), nxt["start"].alias("ts"), nxt["end"].alias("te"), nxt["type"].alias("tt"), nxt["id"].alias("tail"))
        rows = rows.where("head_type = 'Vulnerability' and tt <> 'Vulnerability' and ts - end <= 300")
        kind = F.when(F.col("tt") == "Configuration", "affects").when(F.col("tt") == "Weakness", "instantiates").otherwise("exploited_by")
        return rows.select("doc_id", F.concat(F.lit("R"), F.col("start").cast("string")).alias("id"), kind.alias("type"), "head", "tail", F.col("start").alias("ev_start"), F.col("te").alias("ev_end"))


def _pred_sql(name: str, hit: int, most: int, cut: int, extra: int, only: int) -> str:
    short = f"CASE WHEN h % 10 < 3 AND (h // {cut}) % 10 = 0 THEN 2 ELSE 0 END"
    return f"""{name} AS (SELECT doc_id, s, e - {short} AS e, type, substr(surface, 1, len(surface) - {short}) AS surface, norm, id FROM tok
  WHERE (h % 10 < 3 AND (h // {hit}) % 10 < {most}) OR (h % 10 >= 3 AND (h // {extra}) % 100 = {only}))"""


def _rel_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT doc_id, 'R' || s AS id, CASE tt WHEN 'Configuration' THEN 'affects' WHEN 'Weakness' THEN 'instantiates' ELSE 'exploited_by' END AS type,
    id AS head, tail, s AS ev_start, te AS ev_end
  FROM (SELECT *, lead(s) OVER w AS ts, lead(e) OVER w AS te, lead(type) OVER w AS tt, lead(id) OVER w AS tail FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY s)) q
  WHERE type = 'Vulnerability' AND tt <> 'Vulnerability' AND ts - e <= 300)"""


SPLITS = """splits AS (SELECT doc_id, CASE WHEN x < 3 THEN 'train' WHEN x = 3 THEN 'dev' ELSE 'test' END AS split
  FROM (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) % 5 AS x FROM documents) q)"""
#: CTEs tok, gold, pred, pred2, gold_rel, pred_rel, pred2_rel and splits, columns as above with s and e for start and end.
PRELUDE = f"""WITH ex AS (
  SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(p) AS p, unnest(m) AS surface
  FROM (SELECT doc_id, regexp_extract_all(text, '([\\s\\S]*?)({WORDS})', 1) AS p, regexp_extract_all(text, '([\\s\\S]*?)({WORDS})', 2) AS m FROM documents) q),
t0 AS (SELECT doc_id, surface, CAST(sum(len(p) + len(surface)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM ex),
t1 AS (SELECT doc_id, surface, e - len(surface) AS s, e FROM t0),
t2 AS (SELECT *, CAST('0x' || substr(md5(concat(doc_id, ':', s)), 1, 12) AS BIGINT) AS h FROM t1),
tok AS (SELECT doc_id, s, e, surface, h, 'E' || s AS id,
    CASE (h // 16) % 4 WHEN 0 THEN 'Vulnerability' WHEN 1 THEN 'Configuration' WHEN 2 THEN 'Weakness' ELSE 'AttackTechnique' END AS type,
    CASE WHEN (h // 64) % 10 < 9 THEN upper(surface) END AS norm FROM t2),
gold AS (SELECT doc_id, s, e, type, surface, norm, id FROM tok WHERE h % 10 < 3),
{_pred_sql("pred", 1024, 8, 16384, 256, 57)},
{_pred_sql("pred2", 262144, 7, 4194304, 67108864, 23)},
{_rel_sql("gold_rel", "gold")},
{_rel_sql("pred_rel", "pred")},
{_rel_sql("pred2_rel", "pred2")},
{SPLITS}
"""
