"""Relations from mentions and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import span_distance
from .dedup import stored
from .sweep import overlap_join

# Trigger words of exploitation, and what negates them.
EXPLOIT_TERMS = r"(?i)(?<![A-Za-z])(?:exploit(?:ed|ing|s|ation)?|leverag(?:e|ed|ing)|trigger(?:ed|ing|s)?)(?![A-Za-z])|利用|漏洞利用|触发"
NEGATED = r"(?i)(?:not|never|no evidence of|without)\s+(?:been\s+|being\s+|known\s+)?(?:actively\s+)?exploit"
#: (source type, target type, relation, pattern the sentence must match or None)
PAIRINGS = [("Vulnerability", "Configuration", "affects", None), ("Vulnerability", "Weakness", "instantiates", None), ("Vulnerability", "AttackTechnique", "exploited_by", EXPLOIT_TERMS)]


def in_sentence(mentions: DataFrame, sents: DataFrame) -> DataFrame:
    """Mentions with the sentence (k, s0, s1) in which they start. Sentences partition a text,
    so it is the last one that begins at or before the mention: an as-of pass, no range join."""
    marks = sents.select("doc_id", "start", F.struct("k", F.col("start").alias("s0"), F.col("end").alias("s1")).alias("_sent"))
    return last_before(mentions, marks, "_sent").where("_sent is not null").select(*mentions.columns, "_sent.k", "_sent.s0", "_sent.s1")


def last_before(rows: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """Per row the value of the last mark of its document at or before its start.

    Marks and rows are merged in one ordered pass, so no range join is needed."""
    cols = rows.columns
    m = marks.select("doc_id", "start", F.col(value).alias("_v"), F.lit(0).alias("_o"))
    both = rows.withColumn("_o", F.lit(1)).unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("start", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_o = 1").select(*cols, value)


def local_targets(mentions: DataFrame, sents: DataFrame, source: str, target: str, most: int = 2, reach: int = 300) -> DataFrame:
    """Per source mention up to ``most`` targets that start in its sentence, nearest first."""
    m = in_sentence(mentions, sents)
    h = m.where(F.col("type") == source).select("doc_id", "k", "s0", "s1", F.col("id").alias("head"), F.col("start").alias("hs"), F.col("end").alias("he"))
    t = m.where(F.col("type") == target).select("doc_id", "k", F.col("id").alias("tail"), F.col("start").alias("ts"), F.col("end").alias("te"))
    j = h.join(t, ["doc_id", "k"]).withColumn("distance", span_distance(F.col("hs"), F.col("he"), F.col("ts"), F.col("te"))).where(F.col("distance") <= reach)
    w = Window.partitionBy("doc_id", "head").orderBy("distance", "ts", "tail")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def build_relations(mentions: DataFrame, docs: DataFrame, sents: DataFrame, pairings=PAIRINGS, most: int = 2, reach: int = 300) -> DataFrame:
    """Relations of every pairing, numbered R1.. a document; evidence is the sentence."""
    out = None
    text = docs.select("doc_id", F.col("text").alias("_t"))
    for source, target, relation, trigger in pairings:
        part = local_targets(mentions, sents, source, target, most, reach).withColumn("type", F.lit(relation))
        if trigger:
            part = part.join(text, "doc_id").where(F.substr("_t", (F.col("s0") + 1).cast("int"), (F.col("s1") - F.col("s0")).cast("int")).rlike(trigger)).drop("_t")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("doc_id").orderBy("hs", "type", "rank")
    return out.select("doc_id", F.concat(F.lit("R"), F.row_number().over(order).cast("string")).alias("id"), "type", "head", "tail", F.col("s0").alias("ev_start"), F.col("s1").alias("ev_end"), "distance")


def ends_by_evidence(candidates: DataFrame, mentions: DataFrame) -> DataFrame:
    """The pair of mentions that a relation means, by its evidence.

    candidates: (doc_id, id, type, heads, tails, ev_start, ev_end) with arrays of mention ids
    and one row an occurrence of the evidence. Per occurrence the smallest (distance, head
    start, tail start, ids) inside it; a relation without any takes the smallest overall."""
    m = mentions.select("doc_id", F.col("id").alias("m"), F.col("start").alias("ms"), F.col("end").alias("me"))
    h = candidates.withColumn("m", F.explode("heads")).join(m, ["doc_id", "m"]).select("doc_id", "id", "type", "ev_start", "ev_end", "tails", F.col("m").alias("head"), F.col("ms").alias("hs"), F.col("me").alias("he"))
    t = h.withColumn("m", F.explode("tails")).join(m, ["doc_id", "m"]).where("m <> head")
    j = t.withColumn("distance", span_distance(F.col("hs"), F.col("he"), F.col("ms"), F.col("me")))
    best = F.struct("distance", "hs", F.col("ms").alias("ts"), "head", F.col("m").alias("tail"))
    inside = (F.col("hs") >= F.col("ev_start")) & (F.col("he") <= F.col("ev_end")) & (F.col("ms") >= F.col("ev_start")) & (F.col("me") <= F.col("ev_end"))
    per = j.groupBy("doc_id", "id", "type", "ev_start", "ev_end").agg(F.min(F.when(inside, best)).alias("local"), F.min(best).alias("any"))
    has = F.max(F.col("local").isNotNull()).over(Window.partitionBy("doc_id", "id"))
    per = per.withColumn("has", has).where("local is not null or not has").withColumn("b", F.coalesce("local", "any"))
    return per.select("doc_id", "id", "type", "b.head", "b.tail", F.col("local").isNotNull().alias("by_evidence")).distinct()


def reanchor(relations: DataFrame, mentions: DataFrame, end: str) -> DataFrame:
    """An end that lies outside the evidence moves to the only equivalent mention (same
    type and id) inside it; without one, or with several, it stays."""
    m = mentions.select("doc_id", F.col("id").alias(end), F.col("start").alias("ms"), F.col("end").alias("me"), F.col("type").alias("mt"), "norm")
    r = relations.join(m, ["doc_id", end])
    outside = r.where("(ms < ev_start or me > ev_end) and norm is not null").select("doc_id", F.col("id").alias("rel"), "ev_start", "ev_end", "mt", "norm")
    e = mentions.select("doc_id", F.col("id").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("type").alias("mt"), "norm")
    found = outside.join(e, ["doc_id", "mt", "norm"]).where("s >= ev_start and e <= ev_end").groupBy("doc_id", F.col("rel").alias("id")).agg(F.count("*").alias("n"), F.min("other").alias("other")).where("n = 1")
    out = relations.join(found.select("doc_id", "id", "other"), ["doc_id", "id"], "left")
    return out.withColumn("moved", F.col("other").isNotNull()).withColumn(end, F.coalesce("other", end)).drop("other").select(*relations.columns, "moved")


def reanchor_pairs(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """J10 for both ends: a relation moves to the one pair of equivalent mentions (same type and
    id, or same surface without an id) inside its evidence that is closer than its own ends and
    than any other pair; with several closest pairs it stays.

    The closest pair is found in one ordered pass over the evidence's mentions, and pairs at
    that distance by a sweep, so no evidence is searched pair by pair."""
    relations = stored(relations)
    key = F.concat_ws(":", "type", F.when(F.trim("norm") != "", F.concat(F.lit("="), F.lower("norm"))).otherwise(F.lower(F.trim("surface"))))
    m = mentions.select("doc_id", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), key.alias("key"))
    r = relations.select("doc_id", F.col("id").alias("rel"), F.col("ev_start").cast("long").alias("start"), F.col("ev_end").cast("long").alias("end"), "head", "tail")
    for end in ("head", "tail"):
        own = m.select("doc_id", F.col("id").alias(end), F.col("start").alias(f"{end}_s"), F.col("end").alias(f"{end}_e"), F.col("key").alias(f"{end}_key"))
        r = r.join(own, ["doc_id", end])
    r = r.where("head_key <> tail_key").withColumn("mine", span_distance(F.col("head_s"), F.col("head_e"), F.col("tail_s"), F.col("tail_e")))
    j = overlap_join(r.select("doc_id", "start", "end", "rel", "head_key", "tail_key", "mine"), m, ["doc_id"]).where("r_start >= l_start and r_end <= l_end and r_key in (l_head_key, l_tail_key)")
    c = j.select("doc_id", F.col("l_rel").alias("rel"), F.col("l_mine").alias("mine"), (F.col("r_key") == F.col("l_head_key")).alias("is_head"), F.col("r_id").alias("m"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    c = stored(c)  # read by the ordered pass and by both sides of the sweep
    w = Window.partitionBy("doc_id", "rel").orderBy("start", "end", "m").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.when(F.col("is_head"), F.max(F.when(~F.col("is_head"), F.col("end"))).over(w)).otherwise(F.max(F.when(F.col("is_head"), F.col("end"))).over(w))
    gap = F.when(reach.isNotNull(), F.greatest(F.lit(0), F.col("start") - reach))
    best = c.withColumn("gap", gap).groupBy("doc_id", "rel", "mine").agg(F.min("gap").alias("best")).where("best < mine")
    near = c.join(best.select("doc_id", "rel", "best"), ["doc_id", "rel"])
    sides = [near.where(F.col("is_head") == side).select("doc_id", "rel", "start", (F.col("end") + F.col("best")).alias("end"), "m") for side in (True, False)]
    pairs = overlap_join(*sides, ["doc_id", "rel"], touching=True)
    one = pairs.groupBy("doc_id", "rel").agg(F.count("*").alias("n"), F.min("l_m").alias("new_head"), F.min("r_m").alias("new_tail")).where("n = 1")
    out = relations.join(one.select("doc_id", F.col("rel").alias("id"), "new_head", "new_tail"), ["doc_id", "id"], "left")
    out = out.withColumn("moved", F.col("new_head").isNotNull()).withColumn("head", F.coalesce("new_head", "head")).withColumn("tail", F.coalesce("new_tail", "tail"))
    return out.select(*relations.columns, "moved")


def evidence_interval(with_ends: DataFrame, docs: DataFrame, evidence: str = "evidence", longest: int = 1200) -> DataFrame:
    """(iv_start, iv_end) of a relation's evidence.

    Offsets that cut out the evidence stand; else its first occurrence; an interval that
    misses an end is widened to both ends if that stays within ``longest``, else null."""
    r = with_ends.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    exact = F.coalesce(F.substr("_t", F.col("ev_start").cast("int") + F.lit(1), (F.col("ev_end") - F.col("ev_start")).cast("int")) == F.col(evidence), F.lit(False))
    at = F.expr(f"locate({evidence}, _t)") - 1
    lo = F.when(exact, F.col("ev_start")).when((F.char_length(evidence) > 0) & (at >= 0), at)
    hi = F.when(exact, F.col("ev_end")).otherwise(lo + F.char_length(evidence))
    wide_lo, wide_hi = F.least(lo, "head_start", "tail_start"), F.greatest(hi, "head_end", "tail_end")
    covers = (lo <= F.least("head_start", "tail_start")) & (hi >= F.greatest("head_end", "tail_end"))
    one = ((lo <= F.col("head_start")) & (hi >= F.col("head_end"))) | ((lo <= F.col("tail_start")) & (hi >= F.col("tail_end")))
    fits = covers | (one & (wide_hi - wide_lo <= longest))
    return r.withColumn("iv_start", F.when(fits, F.when(covers, lo).otherwise(wide_lo))).withColumn("iv_end", F.when(fits, F.when(covers, hi).otherwise(wide_hi))).drop("_t")


def prefer(relations_with_ends: DataFrame) -> DataFrame:
    """Of relations with one type and ends the one with the smallest end gap, then the
    shortest evidence, then the smallest id."""
    gap = span_distance(F.col("head_start"), F.col("head_end"), F.col("tail_start"), F.col("tail_end"))
    w = Window.partitionBy("doc_id", "type", "head", "tail").orderBy(gap, F.col("ev_end") - F.col("ev_start"), "id")
    return relations_with_ends.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def explicit_facts(mentions: DataFrame, docs: DataFrame, block_rows: DataFrame, source: str = "Vulnerability", target: str = "AttackTechnique", trigger: str = EXPLOIT_TERMS, negated: str = NEGATED, reach: int = 160, longest: int = 800) -> DataFrame:
    """X10 (third shape): blocks (doc_id, start, end) with one source and one target mention, a
    trigger, no negation, ends within ``reach``: (doc_id, head, tail, b_start, b_end)."""
    b = block_rows.where(F.col("end") - F.col("start") <= longest).select("doc_id", F.col("start").alias("b_start"), F.col("end").alias("b_end")).distinct()
    j = b.join(mentions.where(F.col("type").isin(source, target)), "doc_id").where("start >= b_start and end <= b_end")

    def only(kind: str, c: str) -> Column:
        return F.min(F.when(F.col("type") == kind, F.col(c)))

    per = j.groupBy("doc_id", "b_start", "b_end").agg(F.count_if(F.col("type") == source).alias("n_s"), F.count_if(F.col("type") == target).alias("n_t"), *(only(k, c).alias(f"{x}_{c}") for k, x in ((source, "h"), (target, "t")) for c in ("id", "start", "end")))
    per = per.where("n_s = 1 and n_t = 1").where(span_distance(F.col("h_start"), F.col("h_end"), F.col("t_start"), F.col("t_end")) <= reach)
    cut = F.substr("text", (F.col("b_start") + 1).cast("int"), (F.col("b_end") - F.col("b_start")).cast("int"))
    per = per.join(docs.select("doc_id", "text"), "doc_id").where(cut.rlike(trigger) & ~cut.rlike(negated))
    w = Window.partitionBy("doc_id", "h_id", "t_id").orderBy(F.col("b_end") - F.col("b_start"), "b_start")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("doc_id", F.col("h_id").alias("head"), F.col("t_id").alias("tail"), "b_start", "b_end")


def scoped(mentions: DataFrame, headings: DataFrame, records: DataFrame) -> DataFrame:
    """X11: mentions under a scope heading with the one record id that governs it.

    headings: (doc_id, start, scope) marks where a scope begins (true) or ends (false);
    records: (doc_id, start, record) marks; a scope with several records gives null."""
    m = last_before(mentions, headings, "scope").where("scope")
    return last_before(m, records, "record")


def recover(evidence: DataFrame, scanned: DataFrame, existing: DataFrame) -> DataFrame:
    """Scanned mentions inside evidence spans (doc_id, ev_start, ev_end, norm of the head)
    that carry the head's id and sit where no mention is yet."""
    j = scanned.join(evidence.select("doc_id", "ev_start", "ev_end", "norm").distinct(), ["doc_id", "norm"]).where("start >= ev_start and end <= ev_end").select(*scanned.columns).distinct()
    return j.join(existing.select("doc_id", "start", "end", "type"), ["doc_id", "start", "end", "type"], "left_anti")


def anchored_backfill(seeds: DataFrame, sents: DataFrame, docs: DataFrame, anchors: DataFrame, existing: DataFrame) -> DataFrame:
    """First occurrence of a document's own seeds (doc_id, surface) in every sentence that
    holds an anchor mention, longest seed first, without overlap with ``existing``."""
    from .textscan import greedy_non_overlap

    s = in_sentence(anchors.select("doc_id", "start"), sents).select("doc_id", "k", "s0", "s1").distinct()
    cut = s.join(docs.select("doc_id", "text"), "doc_id").withColumn("sentence", F.substr("text", (F.col("s0") + 1).cast("int"), (F.col("s1") - F.col("s0")).cast("int"))).drop("text")
    j = cut.join(seeds.select("doc_id", "surface").distinct(), "doc_id").withColumn("at", F.expr("locate(surface, sentence)")).where("at > 0")
    hits = j.select("doc_id", (F.col("s0") + F.col("at") - 1).alias("start"), (F.col("s0") + F.col("at") - 1 + F.char_length("surface")).alias("end"), "surface")
    taken = existing.select("doc_id", F.col("start").alias("xs"), F.col("end").alias("xe"))
    clear = hits.join(taken, (hits["doc_id"] == taken["doc_id"]) & (F.col("start") < F.col("xe")) & (F.col("end") > F.col("xs")), "left_anti")
    return greedy_non_overlap(clear.withColumn("shorter", -F.char_length("surface")), ["doc_id"], ["shorter", "start", "surface"]).drop("shorter")


def evidence_score(evidence: Column, surface: Column) -> Column:
    """How self-contained a candidate evidence is."""
    t = F.trim(evidence)
    n = F.char_length(evidence)
    lower = t.rlike(r"^[\p{Ll}]") & ~t.startswith("cpe:")
    score = (
        F.when(evidence.contains(surface), 50.0).otherwise(0.0) - F.when(evidence.startswith(" ") | lower, 30.0).otherwise(0.0)
        + F.when(t.rlike(r"(?:[.!?。]|[.)]\"|\.'|\]\.)$"), 20.0).when(t.endswith("\n"), 10.0).otherwise(0.0)
        + F.when((n >= 50) & (n <= 350), 25.0).when(n > 500, -20.0).otherwise(0.0) + F.least(n, F.lit(350)) * 0.1
    )
    return F.when(t == "", F.lit(-100.0)).otherwise(score)

