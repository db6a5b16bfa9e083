"""Queries of the text scans and the windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cut, piece_span_is_exact, pieces
from ..operators import chunk, metrics, terms, textscan
from ..operators.dedup import stored
from ..schema import ENTITY_TYPES, RELATION_SIGNATURES, dim_entity_type, dim_relation
from .fixtures import WORDS, Annotations, table
from .registry import query
from .scores import ENDS, PRF


@query(""" SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS start_sum, CAST(sum(e) AS BIGINT) AS end_sum, count(*) AS n_exact FROM tok GROUP BY doc_id""")
def mention_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern matches with offsets, all of them exact slices."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = textscan.scan(docs.repartition("doc_id"), WORDS).join(docs.select("doc_id", pieces(F.col("text")).alias("parts")), "doc_id")
    ok = piece_span_is_exact(F.col("parts"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("surface"))
    return m.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("start_sum"), F.sum("end").alias("end_sum"), F.count_if(ok).alias("n_exact"))


@query(""", g AS (SELECT gold.*, lower(surface) AS key FROM gold JOIN splits ON gold.doc_id = splits.doc_id WHERE split <> 'test'),
i AS (SELECT type, key, norm, count(*) AS c, min(doc_id * 10000000 + s) AS f FROM g GROUP BY type, key, norm),
b AS (SELECT type, key, norm, row_number() OVER (PARTITION BY type, key ORDER BY c DESC, f, norm NULLS FIRST) AS r FROM i),
u AS (SELECT type, key, surface, row_number() OVER (PARTITION BY type, key ORDER BY doc_id, s) AS r, count(*) OVER (PARTITION BY type, key) AS n FROM g)
SELECT u.type, u.key, u.surface, b.norm, u.n FROM u JOIN b ON u.type = b.type AND u.key = b.key AND b.r = 1 WHERE u.r = 1""")
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gazetteer of train and dev gold."""
    a = Annotations(spark, sf_dir)
    return textscan.build_gazetteer(a.gold.join(a.splits.where("split <> 'test'"), "doc_id"))


@query(""", gs AS (SELECT gold.*, lower(surface) AS key FROM gold JOIN splits ON gold.doc_id = splits.doc_id WHERE split <> 'test'), gz AS (SELECT DISTINCT type, key FROM gs),
gt AS (SELECT gold.* FROM gold JOIN splits ON gold.doc_id = splits.doc_id WHERE split = 'test'),
tx AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(p) AS p, unnest(m) AS w FROM (SELECT d.doc_id, regexp_extract_all(text, '([\\s\\S]*?)([\\p{L}\\p{N}_]+)', 1) AS p, regexp_extract_all(text, '([\\s\\S]*?)([\\p{L}\\p{N}_]+)', 2) AS m FROM documents d JOIN splits ON d.doc_id = splits.doc_id WHERE split = 'test') q),
ty AS (SELECT doc_id, lower(w) AS key, len(w) AS n, CAST(sum(len(p) + len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM tx), fo AS (SELECT doc_id, e - n AS s, e, type FROM ty JOIN gz ON gz.key = ty.key),
b AS (SELECT doc_id, s, e, type, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, s, e, type, 0 AS src FROM gt UNION ALL SELECT DISTINCT doc_id, s, e, type, 1 FROM fo) u GROUP BY doc_id, s, e, type),
c AS (SELECT coalesce(type, 'ALL') AS type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM b GROUP BY GROUPING SETS ((), (type)))
SELECT type, tp, fp, fn, """ + PRF + " FROM c")
def gazetteer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer matches on test documents, scored against their gold."""
    a = Annotations(spark, sf_dir)
    seen = a.splits.where("split <> 'test'").select("doc_id")
    g = textscan.build_gazetteer(a.gold.join(seen, "doc_id", "left_semi"))
    test = a.docs.select("doc_id", "text").join(seen, "doc_id", "left_anti")
    found = textscan.match_gazetteer(test, g)
    return metrics.micro(metrics.mention_counts(a.gold.join(seen, "doc_id", "left_anti"), found), [], "type")


@query(""", gp AS (SELECT gold.doc_id, s, e, surface, lead(s) OVER q AS s2, lead(e) OVER q AS e2 FROM gold JOIN splits ON gold.doc_id = splits.doc_id WHERE split <> 'test' WINDOW q AS (PARTITION BY gold.doc_id ORDER BY s)),
ky AS (SELECT DISTINCT lower(surface) AS w1, lower(substr(text, s + 1, e2 - s)) AS key FROM gp JOIN documents d ON d.doc_id = gp.doc_id WHERE s2 - e BETWEEN 1 AND 3),
hi AS (SELECT key, t.doc_id FROM tok t JOIN splits ON t.doc_id = splits.doc_id AND split = 'test' JOIN documents d ON d.doc_id = t.doc_id JOIN ky ON lower(t.surface) = w1 AND lower(substr(text, s + 1, len(key))) = key
  WHERE NOT regexp_matches(substr(text, s, CASE WHEN s = 0 THEN 0 ELSE 1 END), '[\\p{L}\\p{N}_]') AND NOT regexp_matches(substr(text, s + 1 + len(key), 1), '[\\p{L}\\p{N}_]'))
SELECT key, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM hi GROUP BY key""")
def gazetteer_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of neighbouring gold mentions with what stands between them, in test documents."""
    a = Annotations(spark, sf_dir)
    seen = a.splits.where("split <> 'test'").select("doc_id")
    docs = a.docs.select("doc_id", "text")
    w = Window.partitionBy("doc_id").orderBy("start")
    pairs = a.gold.join(seen, "doc_id", "left_semi").select("doc_id", "start", "end", F.lead("start").over(w).alias("s2"), F.lead("end").over(w).alias("e2")).where("s2 - end between 1 and 3")
    keys = pairs.join(docs.select("doc_id", pieces(F.col("text")).alias("parts")), "doc_id").select(F.lower(cut(F.col("parts"), F.col("start"), F.col("e2") - F.col("start"))).alias("key"))
    hits = terms.term_hits(docs.join(seen, "doc_id", "left_anti"), keys)
    return hits.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(""", x AS (SELECT t.* FROM tok t LEFT JOIN pred p ON p.doc_id = t.doc_id AND p.s = t.s AND p.e = t.e AND p.type = t.type WHERE p.s IS NULL AND t.h % 10 < 3),
u AS (SELECT doc_id, type FROM pred UNION ALL SELECT doc_id, type FROM x)
SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM u GROUP BY type""")
def fill_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions completed with scanned mentions at free spans."""
    a = Annotations(spark, sf_dir)
    out = textscan.fill_in(a.gold, a.pred)
    return out.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _sentence_sql(pattern: str) -> str:
    return f"""WITH p AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[^{pattern}]*[{pattern}]|[^{pattern}]+$'), lambda x: len(x) > 0) AS parts FROM documents)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n, CAST(len(text) AS BIGINT) AS covered FROM p WHERE len(text) > 0"""


@query(_sentence_sql(".\\n。"), prelude=False)
def sentences_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 (dot): sentences a document; they cover the text."""
    s = textscan.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "dot")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query(_sentence_sql(".\\n。!?！？"), prelude=False)
def sentences_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 (mark)."""
    s = textscan.sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), "mark")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query("""WITH x AS (SELECT doc_id, unnest(string_split(replace(text, ', ', ' • '), chr(10))) AS line FROM documents),
y AS (SELECT doc_id, line, regexp_matches(line, '^\\s*(?:[-*]|\\d+[.)])\\s+') AS marked, (len(line) - len(replace(line, ' • ', ''))) // 3 AS n, strpos(line, ' • ') AS first FROM x)
SELECT doc_id, CAST(sum(n + CASE WHEN marked THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(sum(len(line) - CASE WHEN marked THEN 0 ELSE first END) AS BIGINT) AS chars FROM y WHERE n > 0 OR marked GROUP BY doc_id""", prelude=False)
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of list lines, commas being made signs inside lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit(" • ")).alias("text"))
    b = textscan.blocks(docs).where("kind = 'list'")
    return b.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n FROM x WHERE len(line) <= 2000 AND len(line) - len(replace(line, '|', '')) >= 2 GROUP BY doc_id""", prelude=False)
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows a document."""
    b = textscan.blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return b.where("kind = 'table'").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(""", w AS (SELECT doc_id, s, e, CASE WHEN s - coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000000) > 30 THEN 1 ELSE 0 END AS nw FROM gold),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM w)
SELECT doc_id, min(s) AS run_start, max(e) AS run_end, count(*) AS n FROM r GROUP BY doc_id, run HAVING count(*) >= 5 AND max(e) - min(s) >= 100""")
def dense_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense runs of gold mentions."""
    a = Annotations(spark, sf_dir)
    r = textscan.dense_runs(a.gold, gap=30, least=5, span=100)
    return r.select("doc_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "n")


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents) q),
s AS (SELECT *, CASE WHEN regexp_matches(line, '[0-9]{8}') THEN 3 WHEN regexp_matches(line, '@') THEN 2 WHEN regexp_matches(line, '[0-9]') THEN 1 ELSE 0 END AS sc FROM l),
n AS (SELECT *, max(sc) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM s),
a AS (SELECT *, max(near) OVER (PARTITION BY doc_id) AS any_near FROM n),
f AS (SELECT * FROM a WHERE CASE WHEN any_near > 0 THEN near > 0 AND trim(line) <> '' ELSE k < 6 END),
b AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f)
SELECT doc_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_sum FROM b WHERE any_near = 0 OR upto <= 6000 GROUP BY doc_id""", prelude=False)
def focus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus lines around numbers and addresses."""
    f = textscan.focus_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), {"[0-9]{8}": 3, "@": 2, "[0-9]": 1})
    return f.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("k_sum"))


@query(""", g AS (SELECT gold.doc_id, greatest(0, s - 180) AS a, least(len(text), e + 180) AS b FROM gold JOIN documents ON gold.doc_id = documents.doc_id),
w AS (SELECT *, CASE WHEN a < 1 + coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) THEN 0 ELSE 1 END AS nw FROM g),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM w),
m AS (SELECT doc_id, isl, min(a) AS a, max(b) AS b FROM r GROUP BY doc_id, isl), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM m)
SELECT doc_id, k, a AS from_, b AS to_ FROM k WHERE k <= 2""")
def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two context snippets."""
    a = Annotations(spark, sf_dir)
    s = textscan.snippets(a.gold, a.docs)
    return s.select("doc_id", F.col("k").cast("long").alias("k"), F.col("start").alias("from_"), F.col("end").alias("to_"))


@query()
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abbreviation dictionary of the documents in capitals, with a definition after every
    two long words that only a blank parts: long form first, and short form first before a comma."""
    two = "([A-Z])([A-Z]{3,}) ([A-Z])([A-Z]{3,})"
    defined = F.regexp_replace(F.regexp_replace(F.upper("text"), f"{two},", "$1$3 ($1$2 $3$4),"), f"{two} ", "$1$2 $3$4 ($1$3) ")
    return terms.abbreviations(table(spark, sf_dir, "documents").select("doc_id", defined.alias("text")))


# ---- windows -----------------------------------------------------------------------------
WIN = """, n AS (SELECT doc_id, len(text) AS n FROM documents), wk AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 3000 THEN 1 ELSE (n - 3000 + 2599) // 2600 + 1 END)) AS w FROM n),
win AS (SELECT doc_id, w, w * 2600 AS w_start, least(n, w * 2600 + 3000) AS w_end FROM wk),
own AS (SELECT *, coalesce(lag(w_end) OVER q + w_start, -1099511627776) AS lo, coalesce(lead(w_start) OVER q + w_end, 1099511627776) AS hi FROM win WINDOW q AS (PARTITION BY doc_id ORDER BY w_start, w_end, w))"""


@query(WIN + " SELECT doc_id, count(*) AS n, CAST(sum(w_end - w_start) AS BIGINT) AS chars FROM win GROUP BY doc_id")
def windows_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with fixed stride."""
    w = chunk.stride_windows(table(spark, sf_dir, "documents"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("w_end") - F.col("w_start")).cast("long").alias("chars"))


@query()
def windows_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that end and begin at natural breaks."""
    return chunk.windows(table(spark, sf_dir, "documents"), snap=150)


@query(WIN + """ SELECT w, count(*) AS n FROM gold JOIN own ON gold.doc_id = own.doc_id AND s + e >= lo AND s + e < hi GROUP BY w""")
def window_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gold mention in the one window that owns it."""
    a = Annotations(spark, sf_dir)
    o = chunk.owned(a.gold, chunk.ownership(chunk.stride_windows(a.docs)))
    return o.groupBy(F.col("w").cast("long").alias("w")).agg(F.count("*").alias("n"))


@query(WIN + """, g AS (SELECT gold.doc_id, w, s - w_start AS s, e - w_start AS e FROM gold JOIN win ON gold.doc_id = win.doc_id AND s >= w_start AND e <= w_end)
SELECT doc_id, count(*) AS n, CAST(sum(s) AS BIGINT) AS start_sum, CAST(max(e) AS BIGINT) AS last_end FROM g GROUP BY doc_id""")
def window_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold mentions of every window, relative to it."""
    a = Annotations(spark, sf_dir)
    p = chunk.project_mentions(a.gold, chunk.stride_windows(a.docs))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("start_sum"), F.max("end").alias("last_end"))


@query(WIN + """, r AS (SELECT g.doc_id, w, greatest(ev_start, w_start) > ev_start OR least(ev_end, w_end) < ev_end AS cut, least(ev_end, w_end) - greatest(ev_start, w_start) AS len
  FROM gold_rel g JOIN win ON g.doc_id = win.doc_id AND ev_start < w_end AND ev_end > w_start)
SELECT count(*) AS n, count(*) FILTER (WHERE cut) AS n_cut, CAST(sum(len) AS BIGINT) AS chars FROM r""")
def window_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence clipped to windows."""
    a = Annotations(spark, sf_dir)
    p = chunk.project_evidence(a.gold_rel, chunk.stride_windows(a.docs))
    return p.agg(F.count("*").alias("n"), F.count_if("truncated").alias("n_cut"), F.sum(F.col("ev_end") - F.col("ev_start")).alias("chars"))


@query(WIN + """, p AS (SELECT pred.doc_id, w, s, e, type FROM pred JOIN win ON pred.doc_id = win.doc_id AND s >= w_start AND e <= w_end),
d AS (SELECT doc_id, s, e, type, min(w) AS w FROM p GROUP BY doc_id, s, e, type), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, type) AS k FROM d)
SELECT doc_id, 'E' || k AS id, s AS from_, e AS to_, type FROM k""")
def window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window predictions moved to the document and merged."""
    a = Annotations(spark, sf_dir)
    w = chunk.stride_windows(a.docs)
    moved = chunk.to_document(chunk.project_mentions(a.pred, w), w)
    merged, _ = chunk.merge_windows(moved)
    return merged.select("doc_id", "id", F.col("start").alias("from_"), F.col("end").alias("to_"), "type")


@query(WIN + """, b AS (SELECT doc_id, s, e, type, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, s, e, type, 0 AS src FROM gold UNION ALL SELECT DISTINCT doc_id, s, e, type, 1 FROM pred) u GROUP BY doc_id, s, e, type),
o AS (SELECT b.*, own.w FROM b JOIN own ON b.doc_id = own.doc_id AND s + e >= lo AND s + e < hi)
SELECT w, count(*) FILTER (WHERE g) AS support, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE g) > 0 AS applicable, CASE WHEN count(*) FILTER (WHERE g) > 0 THEN count(*) FILTER (WHERE g AND p) / CAST(count(*) FILTER (WHERE g) AS DOUBLE) END AS recall FROM o GROUP BY w""")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict recall of owned mentions by window number; null where nothing applies."""
    from ..operators.match import exact_match

    a = Annotations(spark, sf_dir)
    o = chunk.owned(exact_match(a.gold, a.pred), chunk.ownership(chunk.stride_windows(a.docs)))
    out = o.groupBy(F.col("w").cast("long").alias("w")).agg(F.count_if("in_gold").alias("support"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"))
    return out.withColumn("applicable", F.col("support") > 0).withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")))


@query(WIN + f""", go AS (SELECT gold.*, w FROM gold JOIN own ON gold.doc_id = own.doc_id AND s + e >= lo AND s + e < hi),
po AS (SELECT pred.*, w FROM pred JOIN own ON pred.doc_id = own.doc_id AND s + e >= lo AND s + e < hi AND s >= w_start AND e <= w_end),
b AS (SELECT doc_id, w, s, e, type, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, w, s, e, type, 0 AS src FROM go UNION ALL SELECT DISTINCT doc_id, w, s, e, type, 1 FROM po) u GROUP BY doc_id, w, s, e, type),
c AS (SELECT type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM b GROUP BY type),
nr AS (SELECT g.type, count(*) AS near FROM go g JOIN po p ON p.doc_id = g.doc_id AND p.w = g.w AND p.type = g.type AND greatest(g.s, p.s) < least(g.e, p.e) AND 2 * (least(g.e, p.e) - greatest(g.s, p.s)) >= greatest(g.e, p.e) - least(g.s, p.s) GROUP BY g.type),
ni AS (SELECT g.type, count(*) AS norm_total, count(*) FILTER (WHERE p.norm = g.norm) AS norm_right FROM go g JOIN po p ON p.doc_id = g.doc_id AND p.w = g.w AND p.s = g.s AND p.e = g.e AND p.type = g.type WHERE g.norm IS NOT NULL GROUP BY g.type),
lb(type) AS (VALUES {", ".join(f"('{t}')" for t in ENTITY_TYPES)}),
f AS (SELECT lb.type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(norm_total, 0) AS norm_total, coalesce(norm_right, 0) AS norm_right, coalesce(near, 0) AS near FROM lb LEFT JOIN c ON c.type = lb.type LEFT JOIN nr ON nr.type = lb.type LEFT JOIN ni ON ni.type = lb.type),
x AS (SELECT *, {PRF} FROM f)
SELECT type, tp, fp, fn, norm_total, norm_right, greatest(0, near - tp) AS boundary_only, CASE WHEN tp + fp + fn > 0 THEN precision END AS precision, CASE WHEN tp + fp + fn > 0 THEN recall END AS recall, CASE WHEN tp + fp + fn > 0 THEN f1 END AS f1,
 tp + fn AS gold_support, tp + fp AS predicted_support, tp + fp + fn > 0 AS applicable, CASE WHEN norm_total > 0 THEN norm_right / CAST(norm_total AS DOUBLE) END AS norm_accuracy FROM x""")
def window_mention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window's predictions scored on the region that it owns, by label."""
    a = Annotations(spark, sf_dir)
    w = stored(chunk.stride_windows(a.docs))
    regions = chunk.ownership(w)
    given = chunk.to_document(chunk.project_mentions(a.pred.select("doc_id", "start", "end", "type", "norm"), w), w)
    return metrics.window_mention_scores(a.gold, given, regions, dim_entity_type(spark))


@query(WIN + f"""{ENDS}, r AS (SELECT *, CASE WHEN s0 % 11 = 0 THEN NULL ELSE te END AS te2 FROM (SELECT *, hs AS s0 FROM pe) q),
go AS (SELECT ge.*, w FROM ge JOIN own ON ge.doc_id = own.doc_id AND hs + te >= lo AND hs + te < hi),
po AS (SELECT r.*, w FROM r JOIN own ON r.doc_id = own.doc_id AND ev_start + ev_end >= lo AND ev_start + ev_end < hi AND ev_start >= w_start AND ev_end <= w_end),
b AS (SELECT doc_id, w, hs, he, type, ts, te, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, w, hs, he, type, ts, te, 0 AS src FROM go UNION ALL SELECT DISTINCT doc_id, w, hs, he, type, ts, te, 1 FROM po WHERE te2 IS NOT NULL) u GROUP BY doc_id, w, hs, he, type, ts, te),
c AS (SELECT type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM b GROUP BY type),
lb(type) AS (VALUES {", ".join(f"('{t}')" for t, *_ in RELATION_SIGNATURES)}),
f AS (SELECT lb.type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM lb LEFT JOIN c ON c.type = lb.type), x AS (SELECT *, {PRF} FROM f)
SELECT type, tp, fp, fn, CASE WHEN tp + fp + fn > 0 THEN precision END AS precision, CASE WHEN tp + fp + fn > 0 THEN recall END AS recall, CASE WHEN tp + fp + fn > 0 THEN f1 END AS f1, tp + fn AS gold_support, tp + fp AS predicted_support, tp + fp + fn > 0 AS applicable FROM x""")
def window_relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for relations by the hull of their ends; one in eleven has an unknown tail."""
    a = Annotations(spark, sf_dir)
    w = chunk.stride_windows(a.docs)
    given = chunk.project_evidence(a.pred_rel.withColumn("tail", F.when(F.col("ev_start") % 11 == 0, F.lit("?")).otherwise(F.col("tail"))), w).where("not truncated")
    moved = given.join(w.select("doc_id", "w", "w_start"), ["doc_id", "w"]).withColumn("ev_start", F.col("ev_start") + F.col("w_start")).withColumn("ev_end", F.col("ev_end") + F.col("w_start"))
    return metrics.window_relation_scores(a.gold_rel, a.gold, moved, a.pred, chunk.ownership(w), dim_relation(spark))


@query(WIN + """, l AS (SELECT win.doc_id, w_start, concat(w_start, ':', w_end, ':', sha256(substr(text, w_start + 1, w_end - w_start))) AS line FROM win JOIN documents d ON d.doc_id = win.doc_id),
p AS (SELECT doc_id, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY w_start)) AS d FROM l GROUP BY doc_id)
SELECT split, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_windows, CAST(sum(CAST('0x' || substr(d, 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM p JOIN splits ON p.doc_id = splits.doc_id GROUP BY split""")
def window_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows and their digest by split."""
    a = Annotations(spark, sf_dir)
    return chunk.inventory(chunk.stride_windows(a.docs), a.docs, a.splits)


@query(WIN + """, dw AS (SELECT doc_id, s, e, CASE WHEN s - coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000000) > 30 THEN 1 ELSE 0 END AS nw FROM gold),
dr AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM dw),
rn AS (SELECT doc_id, min(s) AS r0, max(e) AS r1 FROM dr GROUP BY doc_id, run HAVING count(*) >= 5 AND max(e) - min(s) >= 100),
ir AS (SELECT g.doc_id, g.s, r0 FROM (SELECT DISTINCT doc_id, s FROM gold) g JOIN rn ON rn.doc_id = g.doc_id AND g.s >= r0 AND g.s < r1),
j AS (SELECT win.*, s, row_number() OVER (PARTITION BY win.doc_id, w, r0 ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY win.doc_id, w, r0) AS n FROM win JOIN ir ON ir.doc_id = win.doc_id AND s >= w_start AND s < w_end),
cu AS (SELECT doc_id, w, w_start, w_end, w_start AS cut FROM win UNION SELECT doc_id, w, w_start, w_end, s FROM j WHERE k > 0 AND k % CAST(ceil(n / ceil(n / 3.0)) AS BIGINT) = 0 AND s > w_start),
o AS (SELECT *, lead(cut) OVER q AS nx, row_number() OVER q - 1 AS piece FROM cu WINDOW q AS (PARTITION BY doc_id, w ORDER BY cut))
SELECT doc_id, w, piece, CASE WHEN piece > 0 THEN greatest(w_start, cut - 100) ELSE w_start END AS w_start, CAST(least(w_end, coalesce(nx + 100, w_end)) AS BIGINT) AS w_end FROM o""")
def dense_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows cut where mentions are dense."""
    a = Annotations(spark, sf_dir)
    runs = textscan.dense_runs(a.gold, gap=30, least=5, span=100)
    return chunk.split_dense(chunk.stride_windows(a.docs), a.gold, runs, most=3)


@query(WIN + """ SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(replace(substr(text, w_start + 1, w_end - w_start), ' ', ''))) AS BIGINT) AS chars FROM win JOIN documents d ON d.doc_id = win.doc_id WHERE w > 0""")
def window_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function over the windows that were not done before (all but the first)."""
    docs = table(spark, sf_dir, "documents")
    w = chunk.stride_windows(docs)
    cut = w.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "w", F.substr("text", (F.col("w_start") + 1).cast("int"), (F.col("w_end") - F.col("w_start")).cast("int")).alias("text"))

    def count(batches):
        for pdf in batches:
            yield pdf[["doc_id", "w"]].assign(chars=pdf["text"].str.replace(" ", "").str.len())

    out = chunk.predict(cut, w.where("w = 0"), count, "doc_id long, w int, chars long")
    return out.agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
