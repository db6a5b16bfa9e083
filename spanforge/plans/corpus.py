"""Queries of corpus hygiene, statistics, rankings, graph and integrity."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keyed_number
from ..operators import chunk, dedup, graph, integrity, match, metrics, predictors, rank, stats, textscan
from ..schema import dim_entity_type, dim_relation
from .fixtures import SPLITS, Annotations, table
from .registry import query
from .scores import PRF
from .texts import WIN


@query(""" SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest, count(*) AS n_docs, count(DISTINCT split) AS n_splits, min(documents.doc_id) AS first_doc
FROM documents JOIN splits ON documents.doc_id = splits.doc_id GROUP BY 1 HAVING count(*) > 1""")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts and the splits that they span."""
    a = Annotations(spark, sf_dir)
    return dedup.exact_groups(a.docs, a.splits)


def _shingle_sql(name: str, source: str, key: str) -> str:
    """CTE of distinct five-word shingles a text."""
    return rf"""{name}_w AS (SELECT {key} AS k, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM {source}),
{name} AS (SELECT k, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM {name}_w)"""


# one row a shingle set, under its smallest id; pairs of sets by their common shingles
PAIRS = _shingle_sql("sh", "documents", "doc_id") + """,
sg AS (SELECT k, len(g) AS n, g, min(k) OVER (PARTITION BY md5(array_to_string(list_sort(g), chr(10))), len(g)) AS rep FROM sh),
ix AS (SELECT k, n, unnest(g) AS g FROM sg WHERE k = rep),
cm AS (SELECT x.k AS a, y.k AS b, x.n AS na, y.n AS nb, count(*) AS c FROM ix x JOIN ix y ON x.g = y.g AND x.k < y.k GROUP BY 1, 2, 3, 4),
np AS (SELECT a, b, c / CAST(na + nb - c AS DOUBLE) AS jaccard FROM cm WHERE c >= 0.75 * (na + nb - c))"""
GROUPS = f"""WITH RECURSIVE {PAIRS}, ed AS (SELECT a, b FROM np UNION ALL SELECT b, a FROM np UNION ALL SELECT rep, k FROM sg WHERE k <> rep UNION ALL SELECT k, rep FROM sg WHERE k <> rep),
rc(k, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ed.b, rc.m FROM rc JOIN ed ON ed.a = rc.k), gr AS (SELECT k AS doc_id, min(m) AS group_id FROM rc GROUP BY k)"""


@query(f"WITH {PAIRS} SELECT * FROM np", prelude=False)
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs of different shingle sets."""
    return dedup.near_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(GROUPS + " SELECT * FROM gr", prelude=False)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive duplicate groups."""
    return dedup.duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"{GROUPS}, {SPLITS} SELECT group_id, count(*) AS n_docs, count(DISTINCT split) AS n_splits FROM gr JOIN splits ON splits.doc_id = gr.doc_id GROUP BY group_id HAVING count(DISTINCT split) > 1", prelude=False)
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups that span splits."""
    a = Annotations(spark, sf_dir)
    return dedup.leakage(a.docs.select("doc_id", "text"), a.splits)


@query(f"""WITH {_shingle_sql("sh", "documents", "doc_id")}, {_shingle_sql("bs", "benchmark", "item_id")},
d AS (SELECT k AS doc_id, unnest(g) AS g FROM sh), b AS (SELECT k AS item_id, len(g) AS n, unnest(g) AS g FROM bs)
SELECT doc_id, item_id, count(*) / CAST(n AS DOUBLE) AS share FROM d JOIN b ON d.g = b.g GROUP BY doc_id, item_id, n HAVING count(*) / CAST(n AS DOUBLE) >= 0.5""", prelude=False)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's shingles."""
    return dedup.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM conversations),
j AS (SELECT a.conv_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn),
r AS (SELECT conv_id, i / CAST(greatest(na + nb - i, 1) AS DOUBLE) AS j FROM j)
SELECT conv_id, max(j) AS largest, max(j) < 0.8 AS diverse FROM r GROUP BY conv_id""", prelude=False)
def variant_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the turns of a conversation are."""
    return dedup.diversity(table(spark, sf_dir, "conversations").select("conv_id", "text"), "conv_id").select("conv_id", "largest", "diverse")


@query("""WITH c AS (SELECT DISTINCT regexp_replace(text, '\\s+', '', 'g') AS sig FROM conversations),
k AS (SELECT md5(sig) AS m, CAST('0x' || substr(md5(concat('7:', md5(sig))), 1, 12) AS BIGINT) AS h FROM c)
SELECT m FROM k ORDER BY h, m LIMIT 50""", prelude=False)
def dedup_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed-hash sample of distinct texts (a sampling operator)."""
    rows = dedup.dedup_and_sample(table(spark, sf_dir, "conversations"), "text", 50, "7")
    return rows.select(F.md5(F.regexp_replace("text", r"\s+", "")).alias("m"))


@query(""", u AS (SELECT doc_id, s, e, type, surface FROM pred UNION SELECT doc_id, s, e, type, surface FROM pred2) SELECT type, count(*) AS n FROM u GROUP BY type""")
def union_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two methods' mentions united."""
    a = Annotations(spark, sf_dir)
    return dedup.union_first(a.pred, a.pred2).groupBy("type").agg(F.count("*").alias("n"))


def _method_counts(a: Annotations) -> DataFrame:
    out = None
    for name, pred in (("a", a.pred), ("b", a.pred2)):
        c = metrics.mention_counts(a.gold, pred).groupBy("doc_id").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
        c = c.select(F.lit(name).alias("method"), F.lit("mention").alias("metric"), "doc_id", "tp", "fp", "fn")
        out = c if out is None else out.union(c)
    return dedup.stored(out)


_FULL = "SELECT doc_id, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, s, e, type, 0 AS src FROM gold UNION ALL SELECT DISTINCT doc_id, s, e, type, 1 FROM {p}) u GROUP BY doc_id, s, e, type"
COUNTS = f""", ba AS ({_FULL.format(p="pred")}), bb AS ({_FULL.format(p="pred2")}),
ct AS (SELECT 'a' AS method, doc_id, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM ba GROUP BY doc_id
  UNION ALL SELECT 'b', doc_id, count(*) FILTER (WHERE g AND p), count(*) FILTER (WHERE p AND NOT g), count(*) FILTER (WHERE g AND NOT p) FROM bb GROUP BY doc_id)"""
BOOT = COUNTS + """, dk AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM (SELECT DISTINCT doc_id FROM ct) q), nn AS (SELECT count(*) AS n FROM dk),
rd AS (SELECT r, unnest(range(0, (SELECT n FROM nn))) AS d FROM (SELECT unnest(range(0, 1000)) AS r) q),
dr AS (SELECT r, CAST('0x' || substr(md5(concat('0:', r, ':', d)), 1, 12) AS BIGINT) % (SELECT n FROM nn) AS k, count(*) AS t FROM rd GROUP BY 1, 2),
sm AS (SELECT r, method, sum(tp * t) AS tp, sum(fp * t) AS fp, sum(fn * t) AS fn FROM dr JOIN dk ON dr.k = dk.k JOIN ct ON ct.doc_id = dk.doc_id GROUP BY r, method),
f AS (SELECT r, method, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM sm)"""


@query(BOOT + " SELECT method, 'mention' AS metric, quantile_cont(f1, 0.025) AS low, quantile_cont(f1, 0.975) AS high FROM f GROUP BY method")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of two methods' F1 under the same draws."""
    samples = stats.bootstrap(_method_counts(Annotations(spark, sf_dir)))
    return stats.intervals(samples, 0.95).drop("mean")


@query()
def bootstrap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals by binomial splits over ranges of documents, without a row for every draw."""
    return stats.intervals(stats.bootstrap_ranges(_method_counts(Annotations(spark, sf_dir))), 0.95)


@query(BOOT + """, d AS (SELECT x.r, x.f1 - y.f1 AS d FROM f x JOIN f y ON x.r = y.r AND x.method = 'a' AND y.method = 'b')
SELECT 'b' AS method, 'mention' AS metric, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, avg(CASE WHEN d > 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0.0 END) AS p_greater, avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) AS p_tie FROM d""")
def bootstrap_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences."""
    samples = stats.bootstrap(_method_counts(Annotations(spark, sf_dir)))
    return stats.differences(samples, "a")


@query(COUNTS + """, two AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.tp, 0) AS ta, coalesce(x.fp, 0) AS pa, coalesce(x.fn, 0) AS na, coalesce(y.tp, 0) AS tb, coalesce(y.fp, 0) AS pb, coalesce(y.fn, 0) AS nb
  FROM (SELECT * FROM ct WHERE method = 'a') x FULL JOIN (SELECT * FROM ct WHERE method = 'b') y ON x.doc_id = y.doc_id),
tr AS (SELECT two.*, r, r > 0 AND CAST('0x' || substr(md5(concat('0:', r, ':', doc_id)), 1, 12) AS BIGINT) % 2 = 1 AS sw FROM two, (SELECT unnest(range(0, 1001)) AS r) q),
sm AS (SELECT r, sum(CASE WHEN sw THEN tb ELSE ta END) AS ta, sum(CASE WHEN sw THEN pb ELSE pa END) AS pa, sum(CASE WHEN sw THEN nb ELSE na END) AS na, sum(CASE WHEN sw THEN ta ELSE tb END) AS tb, sum(CASE WHEN sw THEN pa ELSE pb END) AS pb, sum(CASE WHEN sw THEN na ELSE nb END) AS nb FROM tr GROUP BY r),
d AS (SELECT r, 2 * ta / CAST(2 * ta + pa + na AS DOUBLE) - 2 * tb / CAST(2 * tb + pb + nb AS DOUBLE) AS d FROM sm), o AS (SELECT d AS observed FROM d WHERE r = 0)
SELECT 'mention' AS metric, observed, (count(*) FILTER (WHERE abs(d) >= abs(observed) - 1e-15) + 1) / CAST(1001 AS DOUBLE) AS p_value FROM d, o WHERE r > 0 GROUP BY observed""")
def randomization_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label swapping by document."""
    return stats.randomization(_method_counts(Annotations(spark, sf_dir)), "a", "b")


def _repeats(a: Annotations) -> DataFrame:
    """Scores of three methods by split, which stands for the repeat."""
    c = _method_counts(a).join(a.splits, "doc_id").groupBy("method", F.col("split").alias("repeat")).agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    return c.select("method", "repeat", (2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("score"))


@query(COUNTS + """, s AS (SELECT method, split, 2 * sum(tp) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) AS score FROM ct JOIN splits ON ct.doc_id = splits.doc_id GROUP BY method, split),
g AS (SELECT x.*, x.score - y.score AS gain FROM s x JOIN s y ON x.split = y.split AND y.method = 'b')
SELECT method, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS deviation, avg(gain) AS gain, count(*) FILTER (WHERE gain > 0) AS n_positive, count(*) FILTER (WHERE gain < -0.02) AS n_large_drop FROM g GROUP BY method""")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, deviations and paired gains over repeats."""
    return stats.repeat_summary(_repeats(Annotations(spark, sf_dir)), "b")


_BT = "SELECT '{m}' AS method, type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM (SELECT doc_id, s, e, type, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, s, e, type, 0 AS src FROM gold UNION ALL SELECT DISTINCT doc_id, s, e, type, 1 FROM {p}) u GROUP BY doc_id, s, e, type) b GROUP BY type"


@query(f""", c AS ({_BT.format(m="a", p="pred")} UNION ALL {_BT.format(m="b", p="pred2")}),
f AS (SELECT method, type, tp / CAST(tp + fn AS DOUBLE) AS recall, 2 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / ((tp / CAST(tp + fp AS DOUBLE)) + (tp / CAST(tp + fn AS DOUBLE))) AS f1 FROM c),
g AS (SELECT x.*, x.f1 - y.f1 AS gain FROM f x JOIN f y ON x.type = y.type AND y.method = 'a')
SELECT method, bool_and(gain >= -0.02) AS keeps_f1, bool_and(recall >= 0.5) AS keeps_recall, bool_and(CASE WHEN type = 'Weakness' THEN gain >= 0 ELSE true END) AS gains, min(gain) AS worst FROM g GROUP BY method""")
def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of each method against a baseline."""
    a = Annotations(spark, sf_dir)
    parts = [metrics.mention_counts(a.gold, p).withColumn("method", F.lit(m)) for m, p in (("a", a.pred), ("b", a.pred2))]
    by_type = metrics.micro(parts[0].union(parts[1]), ["method", "type"])
    return stats.guardrails(by_type, "a", "Weakness", least_recall=0.5)


@query(COUNTS + """, u AS (SELECT method, split, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ct JOIN splits ON ct.doc_id = splits.doc_id GROUP BY method, split),
s AS (SELECT method, split, 'precision' AS metric, tp / CAST(tp + fp AS DOUBLE) AS score FROM u UNION ALL SELECT method, split, 'recall', tp / CAST(tp + fn AS DOUBLE) FROM u UNION ALL SELECT method, split, 'f1', 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) FROM u),
k(metric, lg, fl, ld, ml) AS (VALUES ('precision', CAST(NULL AS DOUBLE), 0.5, 0.001, 0), ('recall', 0.0, 0.9, NULL, NULL)),
g AS (SELECT x.*, x.score - y.score AS gain, lg, fl, ld, ml FROM s x JOIN s y ON x.split = y.split AND x.metric = y.metric AND y.method = 'b' LEFT JOIN k ON k.metric = x.metric),
q AS (SELECT method, metric, lg, fl, ml, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS deviation, avg(gain) AS gain, count(*) FILTER (WHERE CASE WHEN lg = 0 THEN gain >= -1e-12 ELSE gain > 0 END) AS n_positive, count(*) FILTER (WHERE gain < -ld) AS n_large_drop FROM g GROUP BY ALL),
z AS (SELECT *, CASE WHEN lg IS NULL THEN true ELSE gain + 1e-12 >= lg AND n_positive >= 2 END AS gains, (fl IS NULL OR mean >= fl) AND (ml IS NULL OR n_large_drop <= ml) AS holds FROM q)
SELECT method, metric, n, mean, deviation, gain, n_positive, n_large_drop, gains, holds, gains AND holds AS passes FROM z""")
def paired_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores of two methods over three repeats, gated by paired gains, floors
    and large drops."""
    a = Annotations(spark, sf_dir)
    c = _method_counts(a).join(a.splits, "doc_id").groupBy("method", F.col("split").alias("repeat")).agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    scores = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), e.alias("score")) for m, e in (("precision", F.col("tp") / (F.col("tp") + F.col("fp"))), ("recall", F.col("tp") / (F.col("tp") + F.col("fn"))), ("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))))))
    rules = spark.createDataFrame([("precision", None, 0.5, 0.001, 0), ("recall", 0.0, 0.9, None, None)], "metric string, least_gain double, floor double, large_drop double, most_large_drops int")
    return stats.paired_gates(c.select("method", "repeat", scores.alias("z")).select("method", "repeat", "z.*"), "b", rules)


@query(""", b AS (SELECT doc_id, s, e, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, s, e, 0 AS src FROM gold WHERE type = 'Configuration' UNION ALL SELECT DISTINCT doc_id, s, e, 1 FROM pred WHERE type = 'Configuration') u GROUP BY doc_id, s, e),
c AS (SELECT d.doc_id, count(*) FILTER (WHERE g) AS n_gold, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT *, CASE WHEN n_gold > 0 THEN tp / CAST(n_gold AS DOUBLE) END AS recall, CASE WHEN n_gold > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1 FROM c""")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product scores of every document."""
    a = Annotations(spark, sf_dir)
    return metrics.document_scores(a.docs, a.gold, a.pred)


@query(WIN + """, v AS (SELECT gold.doc_id, count(*) AS n FROM gold JOIN win ON gold.doc_id = win.doc_id AND s >= w_start AND e <= w_end GROUP BY gold.doc_id),
m AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id), ww AS (SELECT doc_id, count(*) AS n FROM win GROUP BY doc_id)
SELECT split, count(*) AS n_docs, CAST(sum(len(text)) AS BIGINT) AS n_chars, CAST(sum(ww.n) AS BIGINT) AS n_windows, CAST(sum(coalesce(m.n, 0)) AS BIGINT) AS n_mentions, CAST(sum(coalesce(v.n, 0)) AS BIGINT) AS n_window_mentions, max(ww.n) AS most_windows
FROM documents d JOIN splits ON splits.doc_id = d.doc_id LEFT JOIN ww ON ww.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id GROUP BY split""")
def corpus_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters, windows and mentions by split."""
    a = Annotations(spark, sf_dir)
    return metrics.corpus_sizes(a.docs, chunk.stride_windows(a.docs), a.gold, a.splits)


def _typed(tok: str) -> str:
    return f"CASE WHEN len({tok}) >= 14 THEN 'Unlisted' WHEN len({tok}) % 2 = 0 THEN 'Configuration' ELSE 'Weakness' END"


@query(f""", pr AS (SELECT 'long' AS method, doc_id, s, e, {_typed("surface")} AS type FROM tok WHERE len(surface) >= 9 UNION ALL SELECT 'longer', doc_id, s, e, {_typed("surface")} FROM tok WHERE len(surface) >= 11),
k AS (SELECT DISTINCT method, doc_id, s, e, type FROM pr WHERE type <> 'Unlisted'), gg AS (SELECT DISTINCT method, gold.doc_id, s, e, type FROM gold, (VALUES ('long'), ('longer')) m(method)),
b AS (SELECT method, doc_id, s, e, type, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT *, 0 AS src FROM gg UNION ALL SELECT *, 1 FROM k) u GROUP BY method, doc_id, s, e, type),
c AS (SELECT method, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM b GROUP BY method)
SELECT method, tp, fp, fn, {PRF} FROM c""")
def predictor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered predictors, run on the train documents and then on all, where only
    those without results are predicted; scored by method."""
    a = Annotations(spark, sf_dir)

    def words(least: int):
        def predict(docs: DataFrame):
            m = textscan.scan(docs.select("doc_id", "text"), f"[A-Za-z]{{{least},}}")
            n = F.char_length("surface")
            kind = F.when(n >= 14, "Unlisted").when(n % 2 == 0, "Configuration").otherwise("Weakness")
            return m.select("doc_id", "start", "end", "surface", kind.alias("type"), F.concat(F.lit("E"), F.col("start").cast("string")).alias("id")), None

        return predict

    known = predictors.Predictors(dim_entity_type(spark), dim_relation(spark))
    known.register("long", words(9))
    known.register("longer", words(11))
    folder = f"{dedup.shared_folder(spark)}/{uuid.uuid4().hex}"
    out = None
    for name in known.names():
        known.run(name, a.docs.join(a.splits.where("split = 'train'"), "doc_id", "left_semi"), folder)
        m, _ = known.run(name, a.docs, folder)
        out = m if out is None else out.unionByName(m)
    gold = a.gold.withColumn("method", F.explode(F.array(*(F.lit(n) for n in known.names()))))
    return metrics.micro(metrics.mention_counts(gold, out, ["method"]), ["method"])


# ---- rankings and samples ---------------------------------------------------------------
@query(f""", x AS (SELECT doc_id, s // 2600 AS w, type, g, p FROM (SELECT doc_id, s, e, type, bool_or(src = 0) AS g, bool_or(src = 1) AS p FROM (SELECT DISTINCT doc_id, s, e, type, 0 AS src FROM gold UNION ALL SELECT DISTINCT doc_id, s, e, type, 1 FROM pred) u GROUP BY doc_id, s, e, type) q WHERE type = 'Weakness'),
c AS (SELECT doc_id, w, count(*) FILTER (WHERE g AND NOT p) AS missed, count(*) FILTER (WHERE p AND NOT g) AS spurious FROM x GROUP BY doc_id, w),
n AS (SELECT g.doc_id, g.s // 2600 AS w, count(*) AS boundary FROM gold g JOIN pred p ON p.doc_id = g.doc_id AND p.type = g.type AND greatest(p.s, g.s) < least(p.e, g.e) AND (p.s <> g.s OR p.e <> g.e) WHERE g.type = 'Weakness' GROUP BY 1, 2)
SELECT c.doc_id, c.w, missed, spurious, coalesce(boundary, 0) AS boundary, CAST(row_number() OVER (ORDER BY missed DESC, coalesce(boundary, 0) DESC, spurious DESC, c.doc_id, c.w) AS INTEGER) AS rank
FROM c LEFT JOIN n ON n.doc_id = c.doc_id AND n.w = c.w WHERE missed + spurious > 0""")
def error_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: stretches of 2,600 characters by their errors in weaknesses."""
    a = Annotations(spark, sf_dir)
    w = F.expr("start div 2600")
    counts = match.exact_match(a.gold, a.pred).select("doc_id", w.alias("w"), "type", (F.col("in_gold") & ~F.col("in_pred")).cast("long").alias("fn"), (F.col("in_pred") & ~F.col("in_gold")).cast("long").alias("fp"))
    near = match.overlap_pairs(a.gold, a.pred).where("g_start <> p_start or g_end <> p_end").select("doc_id", F.expr("g_start div 2600").alias("w"), "type")
    return rank.error_windows(counts, near, "Weakness").select("doc_id", "w", "missed", "spurious", "boundary", "rank")


@query(COUNTS + """, g AS (SELECT *, tp >= 5 AS a, fp * 5 <= tp AS b FROM ct WHERE method = 'a')
SELECT doc_id, CASE WHEN a AND b THEN '' WHEN a THEN 'precise' WHEN b THEN 'enough' ELSE 'enough,precise' END AS failed,
  CASE WHEN a AND b THEN CAST(row_number() OVER (PARTITION BY a AND b ORDER BY tp DESC, fp, doc_id) AS INTEGER) END AS rank FROM g""")
def ranked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: documents ranked inside those that pass both gates."""
    c = _method_counts(Annotations(spark, sf_dir)).where("method = 'a'")
    out = rank.ranked_records(c, {"enough": F.col("tp") >= 5, "precise": F.col("fp") * 5 <= F.col("tp")}, [F.desc("tp"), F.col("fp"), F.col("doc_id")])
    return out.select("doc_id", F.array_join("failed", ",").alias("failed"), "rank")


@query(""", n AS (SELECT d.doc_id, count(r.id) AS n FROM documents d LEFT JOIN gold_rel r ON r.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, n AS n_relations FROM n ORDER BY (n > 0) DESC, doc_id LIMIT 25""")
def relations_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 documents, those with relations first (a top-k report)."""
    a = Annotations(spark, sf_dir)
    n = a.gold_rel.groupBy("doc_id").agg(F.count("*").alias("n_relations"))
    s = a.docs.select("doc_id").join(n, "doc_id", "left").na.fill(0).withColumn("seq", F.col("doc_id"))
    return rank.relations_first(s, 25).select("doc_id", "n_relations")


_FAMILY = "concat('aa', lpad(cast({div} % 100 as {text}), 2, '0'), '-', lpad(cast({half} % 1000 as {text}), 3, '0'), case when doc_id % 2 = 0 then 'a' else 'b' end)"


@query(f""", k AS (SELECT {_FAMILY.format(div="(doc_id // 2000)", half="(doc_id // 2)", text="varchar")} AS key, split FROM splits), u AS (SELECT 'id' AS kind, key, split FROM k UNION ALL SELECT 'family', substr(key, 1, 8), split FROM k)
SELECT kind, key, count(DISTINCT split) AS n_splits FROM u GROUP BY kind, key HAVING count(DISTINCT split) > 1""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of two ids that fall into different splits."""
    a = Annotations(spark, sf_dir)
    named = a.splits.select(F.expr(_FAMILY.format(div="(doc_id div 2000)", half="(doc_id div 2)", text="string")).alias("doc_id"), "split")
    return dedup.split_overlap(named)


@query("""WITH c AS (SELECT source AS candidate_id, avg(n_chars) AS reward, count(*) / 10.0 AS precision, min(lang) AS text FROM documents GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY reward DESC, precision DESC, len(text), candidate_id) AS rank FROM c)
SELECT candidate_id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank <= 5 THEN 'selected' ELSE 'dropped' END AS decision FROM k""", prelude=False)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources ranked as candidates."""
    c = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("candidate_id")).agg(F.avg("n_chars").alias("reward"), (F.count("*") / 10.0).alias("precision"), F.min("lang").alias("text"))
    return rank.leaderboard(c, 5).select("candidate_id", "rank", "decision")


@query("""WITH c AS (SELECT source AS candidate_id, avg(n_chars) AS objective_f1, max(n_chars) AS micro_f1, count(*) AS precision, min(lang) AS text, count(*) % 2 = 0 AS eligible FROM documents GROUP BY source)
SELECT candidate_id FROM c WHERE eligible ORDER BY objective_f1 DESC, micro_f1 DESC, precision DESC, len(text), candidate_id LIMIT 1""", prelude=False)
def final_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eligible candidate (a top-1 report)."""
    c = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("candidate_id")).agg(F.avg("n_chars").alias("objective_f1"), F.max("n_chars").alias("micro_f1"), F.count("*").alias("precision"), F.min("lang").alias("text"), (F.count("*") % 2 == 0).alias("eligible"))
    return rank.final_choice(c).select("candidate_id")


@query(COUNTS + """, l AS (SELECT source AS candidate_id, tp, fp, fn FROM ct JOIN documents ON ct.doc_id = documents.doc_id), s AS (SELECT candidate_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS n FROM l GROUP BY candidate_id),
t AS (SELECT sum(n) AS t FROM s) SELECT candidate_id, n, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS reward, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) + sqrt(ln(t) / n) AS bound FROM s, t""")
def confidence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper confidence bounds of sources in an evaluation log."""
    a = Annotations(spark, sf_dir)
    log = _method_counts(a).join(a.docs.select("doc_id", F.col("source").alias("candidate_id")), "doc_id").withColumn("n", F.lit(1).cast("long"))
    return rank.confidence_bounds(log)


@query(""", m AS (SELECT g.doc_id, g.type, g.s, g.e FROM gold g LEFT JOIN pred p ON p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.type = g.type WHERE p.s IS NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY type, doc_id ORDER BY s, e) AS i FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY i, doc_id) AS rank FROM a WHERE i <= 4)
SELECT type, doc_id, s AS from_, CAST(rank AS INTEGER) AS rank FROM b WHERE rank <= 4""")
def diverse_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missed mentions, spread over documents (a top-k report)."""
    a = Annotations(spark, sf_dir)
    missed = a.gold.select("doc_id", "start", "end", "type").join(a.pred.select("doc_id", "start", "end", "type"), ["doc_id", "start", "end", "type"], "left_anti")
    return rank.diverse_examples(missed, ["type"]).select("type", "doc_id", F.col("start").alias("from_"), "rank")


@query("""WITH g AS (SELECT source AS group_id, count(*) AS n_docs, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS en, CAST(sum(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS BIGINT) AS other FROM documents GROUP BY source),
t AS (SELECT g.*, trial, CAST('0x' || substr(md5(concat('0:', trial, ':', group_id)), 1, 12) AS BIGINT) AS h FROM g, (SELECT unnest(range(0, 200)) AS trial) q),
u AS (SELECT *, sum(n_docs) OVER (PARTITION BY trial ORDER BY h, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n_docs) OVER (PARTITION BY trial) AS n FROM t),
v AS (SELECT *, CASE WHEN upto <= 0.6 * n + 1e-9 THEN 'train' WHEN upto <= 0.8 * n + 1e-9 THEN 'dev' ELSE 'test' END AS split FROM u),
w AS (SELECT trial, split, sum(n_docs) AS n_docs, sum(en) AS en, sum(other) AS other, CASE split WHEN 'train' THEN 0.6 ELSE 0.2 END AS share FROM v GROUP BY trial, split),
tt AS (SELECT sum(n_docs) AS n, sum(en) AS en, sum(other) AS other FROM g),
sc AS (SELECT trial, sum(4 * power(w.n_docs / CAST(tt.n AS DOUBLE) / share - 1, 2) + power(w.en / CAST(tt.en AS DOUBLE) / share - 1, 2) + CASE WHEN w.en = 0 THEN 1000 ELSE 0 END + power(w.other / CAST(tt.other AS DOUBLE) / share - 1, 2) + CASE WHEN w.other = 0 THEN 1000 ELSE 0 END) + 1000 * (3 - count(*)) AS score FROM w, tt GROUP BY trial),
b AS (SELECT trial FROM sc ORDER BY score, trial LIMIT 1)
SELECT v.group_id, v.split FROM v JOIN b ON v.trial = b.trial""", prelude=False)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources split 60/20/20, languages balanced."""
    g = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("group_id")).agg(F.count("*").alias("n_docs"), F.sum((F.col("lang") == "en").cast("long")).alias("en"), F.sum((F.col("lang") != "en").cast("long")).alias("other"))
    return rank.stratified_split(g, {"train": 0.6, "dev": 0.2, "test": 0.2}, ["en", "other"])


@query()
def coverage_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover the features twice."""
    a = Annotations(spark, sf_dir)
    f = metrics.document_features(a.docs, a.gold, a.gold_rel).select("doc_id", F.explode("features").alias("f"))
    return rank.coverage_batch(dedup.stored(f), 8, need=2)


@query()
def quota_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters positives, the rest by coverage."""
    a = Annotations(spark, sf_dir)
    f = dedup.stored(metrics.document_features(a.docs, a.gold, a.gold_rel).select("doc_id", F.explode("features").alias("f")))
    return rank.quota_batch(dedup.stored(a.gold_rel.where("type = 'affects'").select("doc_id").distinct()), f, 12, 3)


# ---- integrity --------------------------------------------------------------------------
@query(""", c AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 97 <> 3), m AS (SELECT doc_id, CASE WHEN doc_id % 89 = 1 THEN sha256(text || '!') ELSE sha256(text) END AS f FROM documents WHERE doc_id % 83 <> 2)
SELECT coalesce(c.doc_id, m.doc_id) AS doc_id, CASE WHEN f IS NULL THEN 'extra' WHEN h IS NULL THEN 'missing' WHEN h = f THEN 'same' ELSE 'changed' END AS status FROM c FULL JOIN m ON c.doc_id = m.doc_id""")
def verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: the corpus against a manifest from which rows were dropped, changed and added.

    The test manifest is made here; both tables are whole but for the planted differences."""
    docs = table(spark, sf_dir, "documents")
    frozen = docs.where("doc_id % 83 <> 2").select("doc_id", F.when(F.col("doc_id") % 89 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return integrity.verify_manifest(integrity.content_hashes(docs.where("doc_id % 97 <> 3")), integrity.content_hashes(frozen))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS s FROM documents), l AS (SELECT CAST('0x' || substr(s, 1, 8) AS BIGINT) % 256 AS b, concat(doc_id, ':', s) AS line FROM h),
p AS (SELECT b, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM l GROUP BY b)
SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS sha256, CAST(sum(n) AS BIGINT) AS n_docs FROM p""", prelude=False)
def aggregate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one hash of the corpus."""
    return integrity.aggregate_hash(integrity.content_hashes(table(spark, sf_dir, "documents")))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE 'run' END AS run, CASE WHEN doc_id % 7 = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS src FROM documents)
SELECT p.doc_id, CASE WHEN src <> sha256(text) THEN 'source_changed' WHEN run <> 'run' THEN 'other_run' ELSE 'fresh' END AS status FROM p JOIN documents d ON p.doc_id = d.doc_id""", prelude=False)
def stale_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: predictions whose run or source is not the current one."""
    docs = table(spark, sf_dir, "documents")
    p = docs.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "old").otherwise("run").alias("run_sha256"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("source_sha256"))
    return integrity.stale_predictions(p, integrity.content_hashes(docs), "run")


@query(COUNTS + """, st AS (SELECT doc_id, tp + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS tp, fp, fn FROM ct WHERE method = 'a')
SELECT ct.doc_id, ct.tp, ct.fp, ct.fn, 'recomputed' AS side FROM ct JOIN st ON st.doc_id = ct.doc_id WHERE method = 'a' AND ct.tp <> st.tp UNION ALL SELECT st.doc_id, st.tp, st.fp, st.fn, 'stored' FROM st WHERE doc_id % 50 = 0""")
def reproduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: recomputed scores against a stored table with planted errors."""
    c = _method_counts(Annotations(spark, sf_dir)).where("method = 'a'").select("doc_id", "tp", "fp", "fn")
    return integrity.reproduce(c, c.withColumn("tp", F.col("tp") + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)))


# ---- graph ------------------------------------------------------------------------------
def _graph_tables(a: Annotations):
    """Ids are mapped to groups by their first letter (some are not), groups to phases."""
    ids = a.gold.where("norm is not null").select(F.col("norm").alias("key")).distinct()
    letter = F.substring("key", 1, 1)
    mapping = ids.where(keyed_number(F.col("key")) % 5 > 0).select("key", F.explode(F.when(keyed_number(F.col("key")) % 5 == 1, F.array(letter, F.lit("initial-access"))).otherwise(F.array(letter))).alias("value"))
    phases = mapping.select(F.col("value").alias("tactic")).distinct().select("tactic", F.when(F.col("tactic") < "M", "first").otherwise("second").alias("phase"))
    return mapping, phases


GRAPH = """, ids AS (SELECT DISTINCT norm AS key, CAST('0x' || substr(md5(norm), 1, 12) AS BIGINT) % 5 AS x FROM gold WHERE norm IS NOT NULL),
mp AS (SELECT key, substr(key, 1, 1) AS value FROM ids WHERE x > 0 UNION SELECT key, 'initial-access' FROM ids WHERE x = 1)"""


@query(GRAPH + """, xt AS (SELECT DISTINCT g.doc_id, t.norm FROM gold_rel g JOIN gold t ON t.doc_id = g.doc_id AND t.id = g.tail WHERE g.type = 'exploited_by'),
r AS (SELECT g.doc_id, g.norm, g.id, mp.value, CASE WHEN xt.norm IS NOT NULL AND mp.value = 'initial-access' THEN 'exploitation' WHEN mp.value < 'M' THEN 'first' ELSE 'second' END AS phase FROM gold g JOIN mp ON mp.key = g.norm LEFT JOIN xt ON xt.doc_id = g.doc_id AND xt.norm = g.norm),
u AS (SELECT doc_id, 'implies' AS relation, norm AS head, value AS tail, id FROM r UNION ALL SELECT doc_id, 'belongs_to_phase', value, phase, id FROM r)
SELECT doc_id, relation, head, tail, count(*) AS support, string_agg(DISTINCT id, ',' ORDER BY id) AS provenance FROM u GROUP BY doc_id, relation, head, tail""")
def complete_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied edges with support and provenance."""
    a = Annotations(spark, sf_dir)
    mapping, phases = _graph_tables(a)
    tails = a.gold.select("doc_id", F.col("id").alias("tail"), "norm")
    exploited = a.gold_rel.where("type = 'exploited_by'").join(tails, ["doc_id", "tail"]).select("doc_id", "norm")
    out = graph.complete(a.gold, mapping, phases, exploited)
    return out.withColumn("provenance", F.array_join("provenance", ","))


@query(GRAPH + """ SELECT g.norm, count(*) AS n, count(DISTINCT g.doc_id) AS n_docs FROM gold g JOIN ids ON ids.key = g.norm WHERE x = 0 GROUP BY g.norm""")
def unmapped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: ids without a mapping."""
    a = Annotations(spark, sf_dir)
    return graph.unmapped(a.gold, _graph_tables(a)[0])


@query(GRAPH + """ SELECT g.doc_id, CASE WHEN bool_or(x = 0) THEN 'review' ELSE 'complete' END AS status FROM gold g JOIN ids ON ids.key = g.norm GROUP BY g.doc_id""")
def mapping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: documents for review."""
    a = Annotations(spark, sf_dir)
    return graph.document_status(a.gold, _graph_tables(a)[0])


@query(GRAPH + """ SELECT g.type, count(*) AS n, count(*) FILTER (WHERE x > 0) AS n_mapped, count(*) FILTER (WHERE x > 0) / CAST(count(*) AS DOUBLE) AS rate FROM gold g JOIN ids ON ids.key = g.norm GROUP BY g.type""")
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by type."""
    a = Annotations(spark, sf_dir)
    return graph.coverage(a.gold, _graph_tables(a)[0])
