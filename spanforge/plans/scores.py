"""Queries of the scoring family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, metrics
from ..schema import ENTITY_TYPES, RELATION_SIGNATURES, dim_entity_type, dim_relation
from .fixtures import Annotations
from .registry import query

# fixed fragments: ratios as functions.text.prf gives them
PRF = """CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision,
 CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
 CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / ((tp / CAST(tp + fp AS DOUBLE)) + (tp / CAST(tp + fn AS DOUBLE))) END AS f1"""
_SUMS = "CAST(sum(CASE WHEN g AND p THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN p AND NOT g THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN g AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS fn"


def _full(keys: str, gold: str, pred: str) -> str:
    """Rows of both sides with flags g and p."""
    return f"""SELECT {keys}, bool_or(src = 0) AS g, bool_or(src = 1) AS p
  FROM (SELECT DISTINCT {keys}, 0 AS src FROM {gold} a UNION ALL SELECT DISTINCT {keys}, 1 AS src FROM {pred} b) u GROUP BY {keys}"""


@query(f""", b AS ({_full("doc_id, s, e, type", "gold", "pred")}),
c AS (SELECT coalesce(type, 'ALL') AS type, {_SUMS} FROM b GROUP BY GROUPING SETS ((), (type)))
SELECT type, tp, fp, fn, {PRF} FROM c""")
def mention_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict mention scores by type and overall."""
    a = Annotations(spark, sf_dir)
    return metrics.micro(metrics.mention_counts(a.gold, a.pred), [], "type")


def _overlap_sql(fits: str) -> str:
    """One-to-one matches are overlapping pairs here, words of the fixture being disjoint."""
    return f""", g AS (SELECT type, count(*) AS n FROM (SELECT DISTINCT doc_id, s, e, type FROM gold) q GROUP BY type), p AS (SELECT type, count(*) AS n FROM (SELECT DISTINCT doc_id, s, e, type FROM pred) q GROUP BY type),
j AS (SELECT g.type, count(*) AS n FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.type = p.type AND greatest(g.s, p.s) < least(g.e, p.e) AND {fits} GROUP BY g.type),
b AS (SELECT coalesce(g.type, p.type) AS type, coalesce(g.n, 0) AS ng, coalesce(p.n, 0) AS np, coalesce(j.n, 0) AS m FROM g FULL JOIN p ON g.type = p.type LEFT JOIN j ON j.type = g.type),
c AS (SELECT coalesce(type, 'ALL') AS type, CAST(sum(m) AS BIGINT) AS tp, CAST(sum(np - m) AS BIGINT) AS fp, CAST(sum(ng - m) AS BIGINT) AS fn FROM b GROUP BY GROUPING SETS ((), (type)))
SELECT type, tp, fp, fn, {PRF} FROM c"""


@query(_overlap_sql("true"))
def mention_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one overlap matching by type and overall."""
    a = Annotations(spark, sf_dir)
    return metrics.micro(metrics.overlap_counts(a.gold, a.pred), [], "type")


@query(_overlap_sql("2 * (least(g.e, p.e) - greatest(g.s, p.s)) >= greatest(g.e, p.e) - least(g.s, p.s)"))
def mention_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where spans share at least half of their union."""
    a = Annotations(spark, sf_dir)
    return metrics.micro(metrics.overlap_counts(a.gold, a.pred, threshold=0.5), [], "type")


@query(""", j AS (SELECT g.doc_id, g.type, g.s AS g_start, g.e AS g_end, p.s AS p_start, p.e AS p_end FROM gold g JOIN pred p
  ON g.doc_id = p.doc_id AND g.type = p.type AND greatest(g.s, p.s) < least(g.e, p.e))
SELECT type, count(*) AS n_pairs, CAST(sum(CASE WHEN (least(g_end, p_end) - greatest(g_start, p_start)) * 2 >= greatest(g_end, p_end) - least(g_start, p_start) THEN 1 ELSE 0 END) AS BIGINT) AS n_half
FROM j GROUP BY type""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of a type, and those with Jaccard of a half or more."""
    a = Annotations(spark, sf_dir)
    j = match.overlap_pairs(a.gold, a.pred)
    return j.groupBy("type").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("jaccard") >= 0.5).alias("n_half"))


def _ends_sql(name: str, rel: str, m: str) -> str:
    return f"""{name} AS (SELECT r.doc_id, r.id, r.type, r.ev_start, r.ev_end, h.s AS hs, h.e AS he, h.type AS ht, h.norm AS hn, t.s AS ts, t.e AS te, t.type AS tt, t.norm AS tn
  FROM {rel} r JOIN {m} h ON r.doc_id = h.doc_id AND r.head = h.id JOIN {m} t ON r.doc_id = t.doc_id AND r.tail = t.id)"""


ENDS = f", {_ends_sql('ge', 'gold_rel', 'gold')}, {_ends_sql('pe', 'pred_rel', 'pred')}"


@query(f"""{ENDS}, b AS ({_full("doc_id, hs, he, ht, type, ts, te, tt", "ge", "pe")}),
c AS (SELECT coalesce(type, 'ALL') AS type, {_SUMS} FROM b GROUP BY GROUPING SETS ((), (type)))
SELECT type, tp, fp, fn, {PRF} FROM c""")
def relation_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict relation scores."""
    a = Annotations(spark, sf_dir)
    return metrics.micro(metrics.relation_counts(a.gold_rel, a.gold, a.pred_rel, a.pred), [], "type")


def _norm_sql(n: str, s: str, e: str, t: str) -> str:
    return f"coalesce({n}, '~' || {t} || ':' || {s} || '-' || {e})"


FACTS = f"""{ENDS}, gf AS (SELECT doc_id, ht, {_norm_sql("hn", "hs", "he", "ht")} AS hn, type, tt, {_norm_sql("tn", "ts", "te", "tt")} AS tn FROM ge),
pf AS (SELECT doc_id, ht, {_norm_sql("hn", "hs", "he", "ht")} AS hn, type, tt, {_norm_sql("tn", "ts", "te", "tt")} AS tn FROM pe)"""


@query(f"""{FACTS}, b AS ({_full("doc_id, ht, hn, type, tt, tn", "gf", "pf")}),
c AS (SELECT coalesce(type, 'ALL') AS type, {_SUMS} FROM b GROUP BY GROUPING SETS ((), (type)))
SELECT type, tp, fp, fn, {PRF} FROM c""")
def relation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized-fact scores."""
    a = Annotations(spark, sf_dir)
    return metrics.micro(metrics.fact_counts(a.gold_rel, a.gold, a.pred_rel, a.pred), [], "type")


@query(f"""{FACTS} SELECT ht AS head_type, hn AS head_norm, type, tt AS tail_type, tn AS tail_norm, count(DISTINCT doc_id) AS support FROM gf
WHERE hn NOT LIKE '~%' AND tn NOT LIKE '~%' GROUP BY ht, hn, type, tt, tn""")
def corpus_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: facts of the whole corpus with the documents that support them."""
    a = Annotations(spark, sf_dir)
    f = match.facts(a.gold_rel, a.gold).where("head_norm not like '~%' and tail_norm not like '~%'")
    return f.groupBy("head_type", "head_norm", "type", "tail_type", "tail_norm").agg(F.count("*").alias("support"))  # facts are distinct a document


@query(f"""{ENDS}, b AS ({_full("doc_id, s, e, type", "gold", "pred")}),
c AS (SELECT type, {_SUMS} FROM b GROUP BY type), d AS (SELECT *, {PRF} FROM c)
SELECT sum(f1) / 6 AS macro_f1, sum(CASE WHEN 4 * precision + recall = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END) / 6 AS macro_fbeta, sum(recall) / 6 AS macro_recall FROM d""")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro scores over the six labels of the ontology."""
    a = Annotations(spark, sf_dir)
    by_type = metrics.micro(metrics.mention_counts(a.gold, a.pred), ["type"])
    return metrics.macro(by_type, dim_entity_type(spark), [])


_SIG = ", ".join(f"('{t}', '{h}', '{x}')" for t, h, x, _ in RELATION_SIGNATURES[:2])


@query(f""", sig(type, ht, tt) AS (VALUES {_SIG}), m AS (SELECT count(*) AS n, count(*) FILTER (WHERE type IN ('Vulnerability', 'Configuration', 'Weakness')) AS ok FROM pred),
{_ends_sql("pe", "pred_rel", "pred")}, r AS (SELECT count(*) AS n, count(sig.type) AS ok FROM pe LEFT JOIN sig ON pe.type = sig.type AND pe.ht = sig.ht AND pe.tt = sig.tt)
SELECT m.n AS n_mentions, m.ok AS ok_mentions, r.n AS n_relations, r.ok AS ok_relations, m.ok / CAST(m.n AS DOUBLE) AS mention_rate, r.ok / CAST(r.n AS DOUBLE) AS relation_rate, (m.ok + r.ok) / CAST(m.n + r.n AS DOUBLE) AS rate FROM m, r""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement with a smaller ontology of three types and two signatures."""
    a = Annotations(spark, sf_dir)
    return metrics.consistency(a.pred, a.pred_rel, dim_entity_type(spark).where(F.col("type").isin(ENTITY_TYPES[:3])), dim_relation(spark).where("type in ('affects', 'instantiates')"), [])


@query(""", g AS (SELECT doc_id, s, e, type, norm FROM gold WHERE norm IS NOT NULL), p AS (SELECT doc_id, s, e, type, coalesce(norm, '~') AS pn FROM pred),
j AS (SELECT g.type, g.norm, p.pn FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type),
c AS (SELECT type, count(*) AS n_gold, count(pn) AS n_found, count(*) FILTER (WHERE pn = norm) AS n_right FROM j GROUP BY type)
SELECT *, n_right / CAST(n_gold AS DOUBLE) AS accuracy, CASE WHEN n_found = 0 THEN 0.0 ELSE n_right / CAST(n_found AS DOUBLE) END AS accuracy_found FROM c""")
def normalization_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id accuracy end to end and on found spans."""
    a = Annotations(spark, sf_dir)
    return metrics.normalization_accuracy(a.gold, a.pred, [])


AMBIGUITY = f""", {_ends_sql("pe", "pred_rel", "pred")},
q AS (SELECT pe.doc_id, pe.id, pe.type, pe.ev_start, pe.ev_end, count(*) FILTER (WHERE m.type = pe.ht) AS nh, count(*) FILTER (WHERE m.type = pe.tt) AS nt
  FROM pe LEFT JOIN pred m ON m.doc_id = pe.doc_id AND m.s >= pe.ev_start AND m.e <= pe.ev_end GROUP BY pe.doc_id, pe.id, pe.type, pe.ev_start, pe.ev_end)"""


@query(AMBIGUITY + """ SELECT type, count(*) AS n, count(*) FILTER (WHERE ev_end - ev_start > 200 OR nh <> 1 OR nt <> 1) AS n_ambiguous,
count(*) FILTER (WHERE ev_end - ev_start > 200 OR nh <> 1 OR nt <> 1) / CAST(count(*) AS DOUBLE) AS rate FROM q GROUP BY type""")
def evidence_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose evidence is too long or does not single out its ends."""
    a = Annotations(spark, sf_dir)
    return metrics.ambiguity(metrics.evidence_reasons(a.pred_rel, a.pred, a.docs), ["type"])


@query(AMBIGUITY + """ SELECT 'long' AS reason, count(*) AS n FROM q WHERE ev_end - ev_start > 200 HAVING count(*) > 0
UNION ALL SELECT 'several', count(*) FROM q WHERE nh > 1 OR nt > 1 HAVING count(*) > 0 UNION ALL SELECT 'missing', count(*) FROM q WHERE nh = 0 OR nt = 0 HAVING count(*) > 0""")
def ambiguity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the reasons."""
    a = Annotations(spark, sf_dir)
    return metrics.reason_counts(metrics.evidence_reasons(a.pred_rel, a.pred, a.docs))


@query(f""", {_ends_sql("pe", "pred_rel", "pred")}, m AS (SELECT count(*) AS n FROM pred), r AS (SELECT count(*) AS n, count(*) FILTER (WHERE type IN ('affects', 'instantiates', 'exploited_by')) AS ok FROM pe)
SELECT m.n AS n_mentions, m.n AS valid_mentions, r.n AS n_relations, r.ok AS valid_relations, r.n AS verifiable_evidence FROM m, r""")
def raw_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of raw predictions."""
    a = Annotations(spark, sf_dir)
    return metrics.raw_quality(a.docs, a.pred, a.pred_rel, dim_entity_type(spark), dim_relation(spark))


@query(f"""{ENDS}, c AS (SELECT ge.*, h.s IS NOT NULL AND t.s IS NOT NULL AS av, p.doc_id IS NOT NULL AS hit FROM ge
  LEFT JOIN pred h ON h.doc_id = ge.doc_id AND h.s = ge.hs AND h.e = ge.he AND h.type = ge.ht
  LEFT JOIN pred t ON t.doc_id = ge.doc_id AND t.s = ge.ts AND t.e = ge.te AND t.type = ge.tt
  LEFT JOIN pe p ON p.doc_id = ge.doc_id AND p.type = ge.type AND p.hs = ge.hs AND p.he = ge.he AND p.ts = ge.ts AND p.te = ge.te),
d AS (SELECT type, count(*) AS n_gold, count(*) FILTER (WHERE av) AS n_available, count(*) FILTER (WHERE av AND hit) AS n_found, count(*) FILTER (WHERE NOT av) AS n_end_missing FROM c GROUP BY type)
SELECT *, CASE WHEN n_available = 0 THEN 0.0 ELSE n_found / CAST(n_available AS DOUBLE) END AS recall FROM d""")
def conditional_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall among relations whose ends were found."""
    a = Annotations(spark, sf_dir)
    return metrics.conditional_recall(a.gold_rel, a.gold, a.pred_rel, a.pred)


@query(""", n AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gold_rel)), c AS (SELECT n.doc_id, count(p.id) AS k FROM n LEFT JOIN pred_rel p ON p.doc_id = n.doc_id GROUP BY n.doc_id)
SELECT count(*) AS n_negative, count(*) FILTER (WHERE k > 0) AS n_with_predictions, CAST(sum(k) AS BIGINT) AS n_predictions, count(*) FILTER (WHERE k > 0) / CAST(count(*) AS DOUBLE) AS rate FROM c""")
def negative_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on documents without gold relations."""
    a = Annotations(spark, sf_dir)
    return metrics.negative_documents(a.docs, a.gold_rel, a.pred_rel)


@query(""", u AS (SELECT doc_id, 'document' AS item, '' AS type FROM documents UNION ALL SELECT doc_id, 'mention', type FROM gold UNION ALL SELECT doc_id, 'relation', type FROM gold_rel)
SELECT split, item, type, count(*) AS n, count(DISTINCT u.doc_id) AS n_docs FROM u JOIN splits ON u.doc_id = splits.doc_id GROUP BY split, item, type""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by split."""
    a = Annotations(spark, sf_dir)
    return metrics.corpus_stats(a.docs, a.gold, a.gold_rel, a.splits)


@query(""", m AS (SELECT doc_id, type, lower(surface) AS s, count(*) AS c FROM gold GROUP BY doc_id, type, lower(surface)), r AS (SELECT doc_id, type, count(*) AS c FROM gold_rel GROUP BY doc_id, type),
f AS (SELECT doc_id, 'has:' || type AS f FROM m UNION SELECT doc_id, 'repeated_mention' FROM m WHERE c > 1 UNION SELECT doc_id, 'rel:' || type FROM r UNION SELECT doc_id, 'multi:' || type FROM r WHERE c > 1
  UNION SELECT doc_id, 'negative' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gold_rel))
SELECT documents.doc_id, coalesce(string_agg(f, ',' ORDER BY f), '') AS features FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id GROUP BY documents.doc_id""")
def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets."""
    a = Annotations(spark, sf_dir)
    return metrics.document_features(a.docs, a.gold, a.gold_rel).select("doc_id", F.array_join("features", ",").alias("features"))


@query(""", fp AS (SELECT p.type, p.surface, count(*) AS n FROM pred p LEFT JOIN gold g ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.type = p.type WHERE g.s IS NULL GROUP BY p.type, p.surface),
k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, surface) AS rank FROM fp) SELECT type, surface, n, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20""")
def frequent_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top false positives a type (a top-k report)."""
    a = Annotations(spark, sf_dir)
    return metrics.frequent_false_positives(a.gold, a.pred)


@query(""", g AS (SELECT g.doc_id, least(3, (g.s + g.e) * 3 // (2 * len(d.text)) + 1) AS part, p.s AS hit FROM gold g JOIN documents d ON d.doc_id = g.doc_id
  LEFT JOIN pred p ON p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.type = g.type)
SELECT CAST(part AS INTEGER) AS part, count(*) AS n_gold, count(hit) AS n_found, count(hit) / CAST(count(*) AS DOUBLE) AS recall FROM g GROUP BY part""")
def recall_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall in the thirds of a text."""
    a = Annotations(spark, sf_dir)
    return metrics.recall_by_depth(a.gold, a.pred, a.docs)
