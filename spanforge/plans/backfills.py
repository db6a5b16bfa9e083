"""Queries of the backfill from a document's own seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keyed_number
from ..operators import backfill, textscan
from .fixtures import Annotations
from .registry import query


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_VALID = f"{{0}} IS NOT NULL AND NOT list_contains({_sql_list(backfill.EXCLUDED)}, lower({{0}})) AND NOT starts_with(lower({{0}}), 'cpe:2.3') AND (len({{0}}) >= 4 OR regexp_matches({{0}}, '^\\p{{{{Lu}}}}{{{{3}}}}$'))"
_BASE = "CASE WHEN ends_with(lower({0}), ' server') THEN trim(substr({0}, 1, len({0}) - 7)) END"
SEEDS = f""", pz AS (SELECT *, CAST('0x' || substr(md5(concat('p', doc_id, id)), 1, 12) AS BIGINT) % 6 AS z FROM pred WHERE type = 'Configuration'),
pn AS (SELECT doc_id, s, norm, CASE z WHEN 0 THEN 'Microsoft ' || surface || ' Exchange Server' WHEN 1 THEN surface || ' Server' WHEN 2 THEN 'Apache ' || surface WHEN 3 THEN upper(substr(surface, 1, 3)) WHEN 4 THEN surface || ' devices' ELSE surface END AS surface FROM pz),
pc AS (SELECT doc_id, s, norm, CASE WHEN regexp_matches(lower(surface), '(?:^| )(?:{"|".join(backfill.PROTECTED)})$') THEN surface ELSE regexp_replace(surface, '\\s+(?:{"|".join(backfill.NOUNS)})$', '', 'i') END AS c FROM pn),
pb AS (SELECT *, CASE WHEN list_contains({_sql_list(backfill.VENDORS)}, lower(regexp_extract(c, '^(\\S+)\\s+\\S', 1))) THEN regexp_replace(c, '^\\S+\\s+', '') END AS b FROM pc),
pf AS (SELECT doc_id, s, norm, unnest([0, 1, 2, 3]) AS form, unnest([c, {_BASE.format("c")}, b, {_BASE.format("b")}]) AS seed FROM pb),
po AS (SELECT *, 0 AS paired FROM pf WHERE {_VALID.format("seed")}),
ab AS (SELECT doc_id, s, lower(substr(surface, 1, 3)) AS key, surface AS other FROM pred WHERE type = 'Weakness' UNION ALL SELECT doc_id, s, lower(surface), upper(substr(surface, 1, 3)) FROM pred WHERE type = 'Weakness'),
ao AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY s DESC, other DESC) AS r FROM ab) q WHERE r = 1),
pp AS (SELECT * FROM po UNION ALL SELECT po.doc_id, po.s, po.norm, po.form, ao.other, 1 FROM po JOIN ao ON ao.doc_id = po.doc_id AND ao.key = lower(po.seed) WHERE {_VALID.format("ao.other")}),
nm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seed ORDER BY s, form, paired, norm) AS r FROM pp WHERE norm IS NOT NULL) q WHERE r = 1),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(seed) ORDER BY s, form, paired, coalesce(norm, ''), seed) AS r FROM pp) q WHERE r = 1)"""


@query(SEEDS + """ SELECT ft.doc_id, ft.seed, nm.norm, CAST(row_number() OVER (PARTITION BY ft.doc_id ORDER BY ft.s, ft.form, ft.paired, coalesce(ft.norm, ''), ft.seed) AS INTEGER) AS rank
  FROM ft LEFT JOIN nm ON nm.doc_id = ft.doc_id AND nm.seed = ft.seed""")
def document_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of every document; by hash, products get a vendor, a server name or a noun, or
    keep three capitals; weaknesses stand for abbreviations of three letters."""
    a = Annotations(spark, sf_dir)
    w = F.col("surface")
    z = keyed_number(F.concat(F.lit("p"), F.col("doc_id").cast("string"), "id")) % 6
    named = F.when(z == 0, F.concat(F.lit("Microsoft "), w, F.lit(" Exchange Server"))).when(z == 1, F.concat(w, F.lit(" Server"))).when(z == 2, F.concat(F.lit("Apache "), w))
    named = named.when(z == 3, F.upper(F.substr(w, F.lit(1), F.lit(3)))).when(z == 4, F.concat(w, F.lit(" devices"))).otherwise(w)
    pairs = a.pred.where("type = 'Weakness'").select("doc_id", "start", F.upper(F.substr(w, F.lit(1), F.lit(3))).alias("short"), w.alias("long"))
    return backfill.seeds(a.pred.where("type = 'Configuration'").withColumn("surface", named), pairs)


@query()
def seed_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products found again by their document's seeds in sentences with a vulnerability."""
    a = Annotations(spark, sf_dir)
    m = backfill.trim_nouns(a.pred)
    found = backfill.seeds(m.where("type = 'Configuration'"))
    sents = textscan.sentences(a.docs.select("doc_id", "text"), "dot")
    return backfill.backfill(a.docs, m, found, sents, a.gold.where("type = 'Vulnerability'"))
