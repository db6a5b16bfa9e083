"""Joins between mention tables (J1-J6, J12, J20) and one-to-one matching."""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_id
from .sweep import nearest_spans, overlap_join
from .textscan import islands

SPAN = ["doc_id", "start", "end", "type"]


def distinct_spans(mentions: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Spans are sets: duplicates collapse before anything is counted."""
    return mentions.select(*extra, *SPAN).distinct()


def exact_match(gold: DataFrame, pred: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Every span of either side with in_gold and in_pred."""
    keys = [*extra, *SPAN]
    g = distinct_spans(gold, extra).withColumn("in_gold", F.lit(True))
    p = distinct_spans(pred, extra).withColumn("in_pred", F.lit(True))
    both = g.join(p, keys, "full_outer")
    return both.select(*keys, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.coalesce("in_pred", F.lit(False)).alias("in_pred"))


def overlap_pairs(gold: DataFrame, pred: DataFrame, extra: list[str] = (), same_type: bool = True) -> DataFrame:
    """Pairs of overlapping spans of one document (and type), with their Jaccard ratio."""
    keys = [*extra, "doc_id", *(["type"] if same_type else [])]
    j = overlap_join(distinct_spans(gold, extra), distinct_spans(pred, extra), keys)
    for side, name in (("l", "g"), ("r", "p")):
        for c in ("start", "end", *([] if same_type else ["type"])):
            j = j.withColumnRenamed(f"{side}_{c}", f"{name}_{c}")
    inter = F.least("g_end", "p_end") - F.greatest("g_start", "p_start")
    return j.withColumn("jaccard", inter / (F.greatest("g_end", "p_end") - F.least("g_start", "p_start")))


def _sweep(gold: list, pred: list) -> int:
    """Pairs of a maximum matching of overlapping intervals.

    The interval with the smallest end on either side is matched with the open opposite
    neighbour of smallest end; the neighbours left all reach over that end, so nothing is lost.
    Two heaps hold what has begun before the end reached, by end."""
    sides = [sorted(gold), sorted(pred)]
    at, begun, used, n = [0, 0], [[], []], [set(), set()], 0
    for e, s, side, k in sorted((e, s, side, k) for side in (0, 1) for k, (s, e) in enumerate(sides[side])):
        if k in used[side]:
            continue
        used[side].add(k)
        other, heap = 1 - side, begun[1 - side]
        while at[other] < len(sides[other]) and sides[other][at[other]][0] < e:
            heapq.heappush(heap, (sides[other][at[other]][1], at[other]))
            at[other] += 1
        while heap and heap[0][1] in used[other]:
            heapq.heappop(heap)
        if heap and heap[0][0] > s:
            used[other].add(heapq.heappop(heap)[1])
            n += 1
    return n


def _augment(gold: list, pred: list, threshold: float) -> int:
    """Pairs of a maximum matching where the spans' Jaccard ratio reaches the threshold."""
    gold, pred, active, at, near = sorted(gold), sorted(pred), [], 0, []
    for s, e in gold:
        while at < len(pred) and pred[at][0] < e:
            active.append(at)
            at += 1
        active = [k for k in active if pred[k][1] > s]
        near.append([k for k in active if pred[k][0] < e and (min(e, pred[k][1]) - max(s, pred[k][0])) >= threshold * (max(e, pred[k][1]) - min(s, pred[k][0]))])
    mate: dict[int, int] = {}
    taken: dict[int, int] = {}

    def place(root: int) -> bool:
        reached, path = {}, [(root, iter(near[root]))]
        while path:
            g, left = path[-1]
            for k in left:
                if k in reached:
                    continue
                reached[k] = g
                if k in mate:
                    path.append((mate[k], iter(near[mate[k]])))
                    break
                while True:  # the chain of spans that led here moves on by one
                    g, before = reached[k], taken.get(reached[k])
                    mate[k], taken[g] = g, k
                    if g == root:
                        return True
                    k = before
            else:
                path.pop()
        return False

    return sum(map(place, range(len(gold))))


def matched_counts(gold: DataFrame, pred: DataFrame, extra: list[str] = (), threshold: float | None = None) -> DataFrame:
    """(extra, doc_id, type, n_gold, n_pred, matched): size of a maximum one-to-one
    matching of overlapping spans of a type, or of those with Jaccard >= threshold.

    Spans fall into islands that do not touch; an island with one span on a side, or on
    neither, is settled natively, and only crowded ones go to Python, one island a group."""
    keys = [*extra, "doc_id", "type"]
    both = distinct_spans(gold, extra).withColumn("side", F.lit(0)).union(distinct_spans(pred, extra).withColumn("side", F.lit(1)))
    isl = islands(both.where("end > start"), keys)
    per = isl.groupBy(*keys, "island").agg(F.sum(1 - F.col("side")).alias("g"), F.sum("side").alias("p"), F.sum(F.when(F.col("side") == 0, F.col("start"))).alias("gs"), F.sum(F.when(F.col("side") == 0, F.col("end"))).alias("ge"), F.sum(F.when(F.col("side") == 1, F.col("start"))).alias("ps"), F.sum(F.when(F.col("side") == 1, F.col("end"))).alias("pe"))
    inter, union = F.least("ge", "pe") - F.greatest("gs", "ps"), F.greatest("ge", "pe") - F.least("gs", "ps")
    pair_fits = F.lit(True) if threshold is None else inter >= threshold * union
    easy = per.where("g = 0 or p = 0 or (g = 1 and p = 1)").select(*keys, "g", "p", F.when((F.col("g") == 1) & (F.col("p") == 1) & pair_fits, 1).otherwise(0).alias("m"))
    hard_keys = per.where("g > 0 and p > 0 and g + p > 2").select(*keys, "island")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        g, p = (list(zip(part["start"], part["end"])) for part in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]))
        m = _sweep(g, p) if threshold is None else _augment(g, p, threshold)
        return pdf[keys].head(1).assign(g=len(g), p=len(p), m=m)

    hard = isl.join(hard_keys, [*keys, "island"], "left_semi").groupBy(*keys, "island").applyInPandas(match, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "g long, p long, m int"]))
    counts = easy.union(hard).groupBy(*keys).agg(F.sum("m").alias("matched"))
    # spans without length overlap nothing, but count
    sizes = both.groupBy(*keys).agg(F.sum(1 - F.col("side")).alias("n_gold"), F.sum("side").alias("n_pred"))
    return sizes.join(counts, keys, "left").select(*keys, "n_gold", "n_pred", F.coalesce("matched", F.lit(0)).alias("matched"))


def with_ends(relations: DataFrame, mentions: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Relations with the spans, types and ids of both ends; dangling ones vanish.

    Of mentions that share an id the last one (by span) stands."""
    keys = [*extra, "doc_id"]
    w = Window.partitionBy(*keys, "id").orderBy(F.desc("start"), F.desc("end"))
    m = mentions.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    out = relations
    for end in ("head", "tail"):
        side = m.select(*(F.col(k) for k in keys), F.col("id").alias(end), F.col("start").alias(f"{end}_start"), F.col("end").alias(f"{end}_end"), F.col("type").alias(f"{end}_type"), F.col("norm").alias(f"{end}_norm"))
        out = out.join(side, [*keys, end])
    return out


def facts(relations: DataFrame, mentions: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Normalized facts, once a document: types and canonical ids of both ends."""
    r = with_ends(relations, mentions, extra)
    norms = [canonical_id(F.col(f"{e}_norm"), F.col(f"{e}_start"), F.col(f"{e}_end"), F.col(f"{e}_type")).alias(f"{e}_norm") for e in ("head", "tail")]
    return r.select(*extra, "doc_id", "head_type", norms[0], F.col("type"), "tail_type", norms[1]).distinct()


def contained(mentions: DataFrame, spans: DataFrame, span_keys: list[str]) -> DataFrame:
    """Per span (its keys) and mention type, the mentions that lie inside."""
    s = spans.select("doc_id", "start", "end", F.struct(*span_keys).alias("span"))
    j = overlap_join(s, mentions.select("doc_id", "start", "end", "type"), ["doc_id"], touching=True)
    j = j.where("r_start >= l_start and r_end <= l_end")
    return j.groupBy("l_span", "r_type").agg(F.count("*").alias("n")).select("l_span.*", F.col("r_type").alias("type"), "n")


def nearest(emitted: DataFrame, gold: DataFrame) -> DataFrame:
    """Per emitted span the gold span of its document and type with the smallest sum of
    offset differences; null without one.

    Exact hits are settled by a join; the others of a document go through one sweep."""
    e, g = distinct_spans(emitted), distinct_spans(gold)
    hit = e.join(g, SPAN, "left_semi").select(*SPAN, F.lit(0).cast("long").alias("cost"), F.col("start").cast("long").alias("g_start"), F.col("end").cast("long").alias("g_end"))
    kinds = {f.name: f.dataType for f in e.schema}

    def near(batches):
        now, queries, spans = None, [], []

        def found():
            best = nearest_spans(queries, spans) if spans else [(None,) * 3] * len(queries)
            return [(*now, *q, *b) for q, b in zip(queries, best)]

        for b in batches:
            rows = []
            for d, t, s, e, is_gold in zip(*(c.to_pylist() for c in b.columns)):
                if (d, t) != now:
                    rows += found() if queries else []
                    now, queries, spans = (d, t), [], []
                (spans if is_gold else queries).append((s, e))
            yield out(b.schema, rows)
            last = b.schema
        if queries:
            yield out(last, found())

    def out(given, rows):
        types = [given.field("doc_id").type, given.field("type").type, *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=["doc_id", "type", "start", "end", "cost", "g_start", "g_end"])

    cols = ["doc_id", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")]
    both = e.join(g, SPAN, "left_anti").select(*cols, F.lit(False).alias("is_gold")).union(g.select(*cols, F.lit(True)))
    both = both.repartition("doc_id", "type").sortWithinPartitions("doc_id", "type")
    schema = f"doc_id {kinds['doc_id'].simpleString()}, type {kinds['type'].simpleString()}, start long, end long, cost long, g_start long, g_end long"
    rest = both.mapInArrow(near, schema).select(*(F.col(c).cast(kinds[c]).alias(c) for c in SPAN), "cost", "g_start", "g_end")
    return hit.union(rest)
