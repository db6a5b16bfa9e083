"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, html_extract, mixing, packing, pii, quality_lm, simhash, suffix_dedup, token_align, url_filter, warc, weak_rules
from .common import md5_number, table


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(table(spark, sf_dir, "documents"), key="surrogate-key-1")
    return out.select(F.col("id").alias("doc_id"), "text", "n_entities", "kinds")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that ``labels`` call good are the trusted text."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    out = quality_lm.classify(table(spark, sf_dir, "documents"), trusted)
    return out.select(F.col("id").alias("doc_id"), "lang", "perplexity", "threshold", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The half of ``documents`` with the larger ids is the snapshot, the rest the new batch."""
    docs = table(spark, sf_dir, "documents")
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = ((lo or 0) + (hi or 0)) // 2
    out = exact_dedup.exact_dedup(docs, f"id > {middle}")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL3 = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {AZ})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weak_rules.judge(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(F.col("id").alias("doc_id"), *base, (~F.col("base_failed") & F.col("good")).alias("kept"), "posterior")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(parts)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their training positions."""
    out = mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))
    ends = (F.when(F.size("positions") > 0, F.element_at("positions", k)).alias(name) for k, name in ((1, "first_position"), (-1, "last_position")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", *ends)


def _position_sql(u: str) -> str:
    """The schedules' inverted integrals, as mixing.position_at has them."""
    number = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        whens = []
        for u0, u1, t0, w0, slope in mixing._demand(knots):
            need = f"({u} - {number(u0)})"
            x = f"{number(t0)} + 2 * {need} / ({number(w0)} + sqrt(greatest(0.0, {number(w0 * w0)} + {number(2 * slope)} * {need})))"
            whens.append(f"WHEN {u} <= {number(u1)} THEN {x}")
        whens[-1] = "ELSE " + whens[-1].split(" THEN ", 1)[1]
        inner = f"CASE {' '.join(whens)} END" if len(whens) > 1 else whens[0][5:]
        cases.append(f"WHEN place % {len(mixing.SCHEDULES)} = {k} THEN least({inner}, 1.0)")
    return f"CASE {' '.join(cases)} END"


SQL10 = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat(doc_id, ':mix')), 1, 12) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
              2.0::DOUBLE * source_size AS most FROM s1),
s3 AS (SELECT *, most / weight AS fills_at FROM s2),
s4 AS (SELECT a.source, a.fills_at, a.place,
              (1.5::DOUBLE * (SELECT sum(source_size) FROM s3)
               - coalesce((SELECT sum(b.most) FROM s3 b WHERE b.fills_at < a.fills_at OR (b.fills_at = a.fills_at AND b.place < a.place)), 0))
              / (SELECT sum(b.weight) FROM s3 b WHERE b.fills_at > a.fills_at OR (b.fills_at = a.fills_at AND b.place >= a.place)) AS level
       FROM s3 a),
lv AS (SELECT level FROM s4 WHERE level <= fills_at ORDER BY fills_at, place LIMIT 1),
t AS (SELECT source, source_size, place, least(most, (SELECT level FROM lv) * weight) AS target FROM s3),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN source_size > 0 THEN middle / source_size ELSE 0 END AS u,
             CAST(floor(rate) + CASE WHEN middle < target - floor(rate) * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies
      FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
       CASE WHEN copies > 0 THEN """ + _position_sql("(u / copies)") + """ END AS first_position,
       CASE WHEN copies > 0 THEN """ + _position_sql("((copies - 1 + u) / copies)") + """ END AS last_position
FROM c
"""


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts of ``pages``: put on, taken off and put on again by hash."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("h")).where("h is not null").distinct().withColumn("x", md5_number(F.concat("h", F.lit(":list"))))

    def entry(where: str, kind: str, pattern: str, action: str, at: str, name: str) -> DataFrame:
        return hosts.where(where).selectExpr(f"{name} AS list", f"{kind} AS kind", f"{pattern} AS pattern", f"'{action}' AS action", f"cast({at} AS int) AS at")

    name = "elt(cast(x % 3 AS int) + 1, 'adult', 'malware', 'spam')"
    kind = "CASE WHEN (x div 3) % 2 = 0 THEN 'host' ELSE 'domain' END"
    return (
        entry("x % 4 < 2", kind, "h", "add", "x % 200", name)
        .union(entry("x % 8 < 2", kind, "h", "remove", "x % 200 + 20 + (x div 8) % 100", name))
        .union(entry("x % 16 = 0", kind, "h", "add", "x % 200 + 180", name))
        .union(entry("x % 8 = 3", "'prefix'", "concat(h, '/en')", "add", "100", "'locale'"))
        .union(entry("h LIKE '%cheap-pills%' OR h LIKE '%spam-farm%'", "'domain'", "h", "add", "30", "'spam'"))
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are ``pages`` with a fetch day by hash of the page id."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (md5_number(F.concat(F.col("page_id"), F.lit(":day"))) % 365).cast("int").alias("day"))
    out = url_filter.evaluate(captures, _list_entries(pages), "page_id", "url", "day")
    return out.select(F.col("id").alias("page_id"), "url", "host", F.col("fetched_at").alias("day"), "blocked", "n_active", "lists", "since")


SQL9 = """
WITH c AS (
  SELECT page_id, url, nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/:?#]+)', 1), '') AS host,
         regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         CAST(CAST('0x' || substr(md5(concat(page_id, ':day')), 1, 12) AS BIGINT) % 365 AS INTEGER) AS day
  FROM pages),
h AS (SELECT host AS h, CAST('0x' || substr(md5(concat(host, ':list')), 1, 12) AS BIGINT) AS x FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL) q),
named AS (SELECT *, CASE x % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS name,
                 CASE WHEN (x // 3) % 2 = 0 THEN 'host' ELSE 'domain' END AS kd FROM h),
e AS (
  SELECT name AS list, kd AS kind, h AS pattern, 0 AS off, x % 200 AS day0 FROM named WHERE x % 4 < 2
  UNION SELECT name, kd, h, 1, x % 200 + 20 + (x // 8) % 100 FROM named WHERE x % 8 < 2
  UNION SELECT name, kd, h, 0, x % 200 + 180 FROM named WHERE x % 16 = 0
  UNION SELECT 'locale', 'prefix', h || '/en', 0, 100 FROM named WHERE x % 8 = 3
  UNION SELECT 'spam', 'domain', h, 0, 30 FROM named WHERE h LIKE '%cheap-pills%' OR h LIKE '%spam-farm%'),
g AS (SELECT list, kind, pattern, day0, max(off) AS off FROM e GROUP BY list, kind, pattern, day0),
iv AS (SELECT *, lead(day0) OVER (PARTITION BY list, kind, pattern ORDER BY day0) AS until FROM g),
hit AS (
  SELECT c.page_id, iv.list, iv.kind, iv.pattern, iv.day0 FROM c JOIN iv
    ON iv.off = 0 AND c.day >= iv.day0 AND (iv.until IS NULL OR c.day < iv.until)
   AND ((iv.kind = 'host' AND iv.pattern = c.host)
     OR (iv.kind = 'domain' AND (iv.pattern = c.host OR c.host LIKE '%.' || iv.pattern))
     OR (iv.kind = 'prefix' AND (c.host || c.path = iv.pattern OR c.host || c.path LIKE iv.pattern || '/%')))),
f AS (SELECT page_id, count(DISTINCT list || ' ' || kind || ' ' || pattern) AS n_active,
             string_agg(DISTINCT list, ',' ORDER BY list) AS lists, CAST(max(day0) AS INTEGER) AS since
      FROM hit GROUP BY page_id)
SELECT c.page_id, c.url, c.host, c.day, f.page_id IS NOT NULL AS blocked, coalesce(f.n_active, 0) AS n_active,
       coalesce(f.lists, '') AS lists, f.since
FROM c LEFT JOIN f ON c.page_id = f.page_id
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector is an anchor; every 7th has the next label instead of its own."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantized(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


SQL11 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS r
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
       AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= 3
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    out = token_align.align(table(spark, sf_dir, "documents"), a, b)
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to bundles, and what is read back from them."""
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL13 = """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (5 * (3 - k % 4))) & 31 AS INTEGER) + 1, 1), '' ORDER BY k) AS b32
      FROM (SELECT DISTINCT h FROM d) x, range(32) r(k) GROUP BY h),
g AS (SELECT page_id, html, h, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g JOIN q ON q.h = g.h
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_surrogates, op2_quality_classifier, op3_exact_dedup, op4_quality_rules, op5_best_fit_packing, op6_html_extraction, op7_suffix_dedup,
        op8_simhash, op9_url_filter, op10_mixing, op11_hard_negatives, op12_token_alignment, op13_warc,
    )
}
ORACLE_SQL = {"op3_exact_dedup": SQL3, "op9_url_filter": SQL9, "op10_mixing": SQL10, "op11_hard_negatives": SQL11, "op13_warc": SQL13}
