"""Explicit facts in texts (X10): a listed or named thing under the scope that governs it.

Three shapes: a heading that names a scope and hands it to the bullets after it; a named row
whose sentence lists ids; a block that states one id and one scope with a trigger. Everything
is found by scans and interval joins on offsets; no text is cut again for a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .link import EXPLOIT_TERMS
from .sweep import overlap_join
from .textscan import blocks, scan, sentences, smallest_block

# Ids, bullets, the heading, the row and the negations of explicit exploitation,
# the techniques that stand for exploitation by themselves, and the reaches of each shape.
ITEM = r"(?i)\bCVE-\s*\d{4}-\s*\d{4,7}\b"
SCOPE = r"(?i)\bT\d{4}(?:\.\d{3})?\b"
BULLETS = "•‣◦▪●"
HEADING = r"(?i)\b(?:cyber\s+threat\s+|cyber\s+|threat\s+)?actors\s+(?:have|has|had)\s+exploited\s+the\s+following\s+CVEs\b[^.!?]{0,180}?\[T\d{4}(?:\.\d{3})?\][^:]{0,120}:"
ROW = r"(?i)\bExploit\s+Public-\s*Facing\s+Application\s+T\d{4}(?:\.\d{3})?\b"
NEGATIONS = r"(?i)\b(?:not|never|without)\s+exploit(?:ed|ing|s|ation)?\b"
SCOPES = ["T1068", "T1190", "T1203", "T1210", "T1211"]
LIST_REACH, FIRST_GAP, NEXT_GAP, LONGEST, REACH = 2000, 80, 500, 800, 160

FACT = ["doc_id", "item", "item_start", "item_end", "scope", "scope_start", "scope_end", "ev_start", "ev_end"]


def _bare(column: str) -> Column:
    return F.upper(F.regexp_replace(column, r"\s+", ""))


def listed(docs: DataFrame, heading: str = HEADING, item: str = ITEM, scope: str = r"(?i)\[(T\d{4}(?:\.\d{3})?)\]") -> DataFrame:
    """First shape: the items of the bullets that follow a heading without a break. A list breaks
    at a bullet without an item, or too far from the heading or from the bullet before."""
    name = F.regexp_extract("surface", scope, 1)
    heads = scan(docs, heading).select("doc_id", F.col("end").alias("start"), (F.col("end") + LIST_REACH - 1).alias("end"), F.col("start").alias("h"), name.alias("scope"), (F.col("start") + F.position(F.concat(F.lit("["), name, F.lit("]")), F.col("surface"))).alias("at"))
    marks = scan(docs, rf"(?<!\S)[{BULLETS}](?=\s)\s*(?:{item})?").select("doc_id", "start", (F.col("start") + 1).alias("end"), F.col("end").alias("stop"), F.regexp_extract("surface", item, 0).alias("found"))
    j = overlap_join(heads, marks, ["doc_id"])
    w = Window.partitionBy("doc_id", "l_h").orderBy("r_start")
    before = F.lag("r_start").over(w)
    ends = (F.col("r_found") == "") | (F.col("r_start") - F.coalesce(before, F.col("l_start")) > F.when(before.isNull(), FIRST_GAP).otherwise(NEXT_GAP))
    j = j.withColumn("ends", ends.cast("int"))
    kept = j.withColumn("ended", F.max("ends").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("ended = 0")
    return kept.select("doc_id", _bare("r_found").alias("item"), (F.col("r_stop") - F.char_length("r_found")).alias("item_start"), F.col("r_stop").alias("item_end"), F.upper("l_scope").alias("scope"), F.col("l_at").alias("scope_start"), (F.col("l_at") + F.char_length("l_scope")).alias("scope_end"), F.col("l_h").alias("ev_start"), F.col("r_stop").alias("ev_end"))


def named_rows(docs: DataFrame, row: str = ROW, item: str = ITEM, scope: str = r"(?i)T\d{4}(?:\.\d{3})?$") -> DataFrame:
    """Second shape: the items between a named row and the next full stop. The row's own name is
    the trigger."""
    tokens = scan(docs, rf"{row}|{item}|\.")
    name = F.regexp_extract("surface", scope, 0)
    back = Window.partitionBy("doc_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = tokens.withColumn("stop", F.last(F.when(F.col("surface") == ".", F.col("end")), ignorenulls=True).over(back))
    rows = tokens.where(F.col("surface").rlike(row) & (F.col("stop") - F.col("start") <= LONGEST))
    rows = rows.select("doc_id", F.col("end").alias("start"), F.col("stop").alias("end"), F.col("start").alias("h"), name.alias("scope"), (F.col("end") - F.char_length(name)).alias("at"), F.col("end").alias("till"))
    items = tokens.where(F.col("surface").rlike(item) & ~F.col("surface").rlike(row)).select("doc_id", "start", "end", "surface")
    j = overlap_join(rows, items, ["doc_id"]).where("r_start >= l_start and r_end <= l_end")
    return j.select("doc_id", _bare("r_surface").alias("item"), F.col("r_start").alias("item_start"), F.col("r_end").alias("item_end"), F.upper("l_scope").alias("scope"), F.col("l_at").alias("scope_start"), F.col("l_till").alias("scope_end"), F.col("l_h").alias("ev_start"), F.col("l_end").alias("ev_end"))


def stated(docs: DataFrame, item: str = ITEM, scope: str = SCOPE, scopes: list[str] | None = None, trigger: str = EXPLOIT_TERMS, negated: str = NEGATIONS, heading: str = HEADING) -> DataFrame:
    """Third shape: a block (the smallest list item or table row, else the sentence) with one item
    and one scope near each other, a trigger, no negation and no heading of the first shape."""
    named = scan(docs, scope)
    known = named.where(F.upper("surface").isin(SCOPES if scopes is None else scopes)).select("doc_id", "start", "end", "surface")
    inside = smallest_block(known, blocks(docs).where("kind in ('list', 'table')"))
    sents = sentences(docs, "spaced").select("doc_id", F.col("start").alias("s0"), F.col("end").alias("s1"))
    at = overlap_join(inside.where("b_start is null").select("doc_id", "start", "end", "surface"), sents.select("doc_id", F.col("s0").alias("start"), F.col("s1").alias("end")), ["doc_id"]).where("l_start >= r_start and l_start < r_end")
    where = inside.where("b_start is not null").select("doc_id", "start", "end", "surface", "b_start", "b_end").union(at.select("doc_id", "l_start", "l_end", "l_surface", "r_start", "r_end"))
    where = where.where(F.col("b_end") - F.col("b_start") <= LONGEST)
    marks = None
    for kind, pattern in (("item", item), ("scope", scope), ("trigger", trigger), ("negated", negated), ("heading", heading)):
        part = scan(docs, pattern).select("doc_id", "start", "end", F.lit(kind).alias("kind"), "surface")
        marks = part if marks is None else marks.union(part)
    spans = where.select("doc_id", F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("start").alias("ts"), F.col("end").alias("te"), F.col("surface").alias("scope"))
    j = overlap_join(spans, marks, ["doc_id"]).where("r_start >= l_start and r_end <= l_end")
    is_item = F.col("r_kind") == "item"
    counts = [F.count_if(F.col("r_kind") == k).alias(f"n_{k}") for k in ("item", "scope", "trigger", "negated", "heading")]
    per = j.groupBy("doc_id", "l_start", "l_end", "l_ts", "l_te", "l_scope").agg(*counts, *(F.min(F.when(is_item, F.col(c))).alias(c) for c in ("r_start", "r_end", "r_surface")))
    near = F.least(F.abs(F.col("r_start") - F.col("l_te")), F.abs(F.col("l_ts") - F.col("r_end"))) <= REACH
    per = per.where("n_item = 1 and n_scope = 1 and n_trigger > 0 and n_negated = 0 and n_heading = 0").where(near)
    return per.select("doc_id", _bare("r_surface").alias("item"), F.col("r_start").alias("item_start"), F.col("r_end").alias("item_end"), F.upper("l_scope").alias("scope"), F.col("l_ts").alias("scope_start"), F.col("l_te").alias("scope_end"), F.col("l_start").alias("ev_start"), F.col("l_end").alias("ev_end"))


def exploit_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, item, scope, their offsets, ev_start, ev_end, shape) of all three shapes over
    docs (doc_id, text); of facts with the same two spans the first shape's stands."""
    out = None
    for shape, rows in enumerate((listed(docs), named_rows(docs), stated(docs)), 1):
        part = rows.select(*FACT).withColumn("shape", F.lit(shape))
        out = part if out is None else out.union(part)
    w = Window.partitionBy("doc_id", "item_start", "item_end", "scope_start", "scope_end").orderBy("shape", "ev_start")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
