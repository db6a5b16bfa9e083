"""What went wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .match import SPAN, overlap_pairs, with_ends


def taxonomy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, type, n): misses by boundary (and over- or under-extended), repeated
    surfaces, complete misses; spurious ones with nothing near; wrong ids on right spans."""
    g = gold.select(*SPAN, F.lower("surface").alias("s")).dropDuplicates(SPAN)
    often = F.count("*").over(Window.partitionBy("doc_id", "s")) > 1
    missed = g.withColumn("often", often).join(pred.select(*SPAN), SPAN, "left_anti")
    p = overlap_pairs(gold, pred)
    per = p.groupBy("doc_id", "type", F.col("g_start").alias("start"), F.col("g_end").alias("end")).agg(
        F.bool_or((F.col("p_start") <= F.col("g_start")) & (F.col("p_end") >= F.col("g_end"))).alias("over"), F.bool_or((F.col("g_start") <= F.col("p_start")) & (F.col("g_end") >= F.col("p_end"))).alias("under"))
    m = missed.join(per.withColumn("near", F.lit(True)), SPAN, "left")
    flags = F.array(F.lit("missed"), F.when(F.col("near"), "boundary"), F.when(F.col("over"), "overextended"), F.when(F.col("under"), "underextended"), F.when(F.col("often"), "repeated"), F.when(F.col("near").isNull(), "completely_missed"))
    rows = m.select("type", F.explode(F.array_compact(flags)).alias("kind"))
    extra = pred.select(*SPAN).distinct().join(gold.select(*SPAN), SPAN, "left_anti")
    touch = p.select("doc_id", "type", F.col("p_start").alias("start"), F.col("p_end").alias("end")).distinct().withColumn("near", F.lit(True))
    spurious = extra.join(touch, SPAN, "left").select("type", F.explode(F.array_compact(F.array(F.lit("spurious"), F.when(F.col("near").isNull(), "nothing_near")))).alias("kind"))
    ids = gold.where("norm is not null").select(*SPAN, "norm").join(pred.select(*SPAN, F.col("norm").alias("pn")), SPAN).where("not (pn <=> norm)").select("type", F.lit("wrong_id").alias("kind"))
    return rows.union(spurious).union(ids).groupBy("kind", "type").agg(F.count("*").alias("n"))


def cross_facts(gold_rel: DataFrame, gold: DataFrame, pred_rel: DataFrame, pred: DataFrame) -> DataFrame:
    """(type, n_spurious, n_cross): spurious relations, and those of them whose head and tail are
    both ends of gold relations of the type in the document, though of different ones."""
    keys = ["doc_id", "type", *(f"{e}_{c}" for e in ("head", "tail") for c in ("start", "end", "type"))]
    g, p = (with_ends(r, m).select(*keys).distinct() for r, m in ((gold_rel, gold), (pred_rel, pred)))
    out = p.join(g, keys, "left_anti")
    for e in ("head", "tail"):
        ends = ["doc_id", "type", f"{e}_start", f"{e}_end", f"{e}_type"]
        out = out.join(g.select(*ends).distinct().withColumn(f"known_{e}", F.lit(True)), ends, "left")
    return out.groupBy("type").agg(F.count("*").alias("n_spurious"), F.count_if(F.col("known_head") & F.col("known_tail")).alias("n_cross"))


def routing(gold_rel, gold, raw_rel, raw, final_rel) -> DataFrame:
    """Missed gold relations by where they were lost: dropped after prediction, both ends
    present, one missing, none present."""
    keys = ["doc_id", "type", *(f"{e}_{c}" for e in ("head", "tail") for c in ("start", "end", "type"))]
    g = with_ends(gold_rel, gold).select(*keys).distinct()
    lost = g.join(with_ends(final_rel, raw).select(*keys), keys, "left_anti")
    lost = lost.join(with_ends(raw_rel, raw).select(*keys).distinct().withColumn("in_raw", F.lit(True)), keys, "left")
    for end in ("head", "tail"):
        s = raw.select("doc_id", F.col("start").alias(f"{end}_start"), F.col("end").alias(f"{end}_end"), F.col("type").alias(f"{end}_type")).distinct().withColumn(f"has_{end}", F.lit(True))
        lost = lost.join(s, ["doc_id", f"{end}_start", f"{end}_end", f"{end}_type"], "left")
    h, t = F.col("has_head").isNotNull(), F.col("has_tail").isNotNull()
    route = F.when(F.col("in_raw"), "postprocess").when(h & t, "unlinked").when(h, "missing_tail").when(t, "missing_head").otherwise("both_missing")
    return lost.groupBy("type", route.alias("route")).agg(F.count("*").alias("n"))


def evidence_failures(relations: DataFrame, mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """(failure, n) over relations with an evidence text."""
    m = mentions.select("doc_id", "id", "surface", "start", "end").dropDuplicates(["doc_id", "id"])
    r = relations
    for end in ("head", "tail"):
        r = r.join(m.select("doc_id", F.col("id").alias(end), F.col("surface").alias(f"{end}_s"), F.col("start").alias(f"{end}_a"), F.col("end").alias(f"{end}_b")), ["doc_id", end], "left")
    r = r.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id", "left")
    ends = F.col("head_s").isNotNull() & F.col("tail_s").isNotNull()
    some = ends & F.coalesce(F.col("evidence") != "", F.lit(False))
    exact = F.coalesce(F.substr("_t", (F.col("ev_start") + 1).cast("int"), (F.col("ev_end") - F.col("ev_start")).cast("int")) == F.col("evidence"), F.lit(False))
    held = (F.col("ev_start") <= F.least("head_a", "tail_a")) & (F.col("ev_end") >= F.greatest("head_b", "tail_b"))
    flags = F.array(
        F.when(~ends, "missing_end"), F.when(ends & ~some, "missing_text"), F.when(some & ~F.col("_t").contains(F.col("evidence")), "not_verbatim"),
        F.when(some & ~F.col("evidence").contains(F.col("head_s")), "missing_head"), F.when(some & ~F.col("evidence").contains(F.col("tail_s")), "missing_tail"),
        F.when(some & ~exact, "bad_offsets"), F.when(some & exact & ~held, "wrong_mention"))
    return r.select(F.explode(F.array_compact(flags)).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


def call_trace(trace: DataFrame) -> DataFrame:
    """Per stage of a call log (run, stage, attempt, cached, ok): calls, replays, failures,
    and whether every repeat ran by itself."""
    return trace.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("cached").alias("n_replayed"), F.count_if(~F.col("ok")).alias("n_failed"), F.max("attempt").alias("most_attempts"), F.bool_and(~F.col("cached")).alias("independent"))


def probe_acceptance(samples: DataFrame) -> DataFrame:
    """Over probe results (exhausted, parsed, n_pred, n_distinct, n_gold) the failures, spans
    given twice, and the largest ratio of predicted to gold."""
    ratio = F.max(F.col("n_pred") / F.greatest("n_gold", F.lit(1)))
    return samples.agg(F.count("*").alias("n"), F.count_if("exhausted").alias("n_exhausted"), F.count_if(~F.col("parsed")).alias("n_unparseable"), F.coalesce(F.sum(F.col("n_pred") - F.col("n_distinct")), F.lit(0)).alias("n_repeated"), ratio.alias("largest_ratio"))
