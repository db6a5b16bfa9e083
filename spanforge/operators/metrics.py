"""Scores (A1-A18, A22-A25, A28): counts first, ratios last and unrounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_id, piece_span_is_exact, pieces, prf, ratio
from . import chunk
from .dedup import stored
from .match import SPAN, contained, exact_match, facts, matched_counts, with_ends

COUNTS = ["tp", "fp", "fn"]


def _tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    g, p = F.col("in_gold"), F.col("in_pred")
    return rows.groupBy(*keys).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))


def with_ratios(counts: DataFrame) -> DataFrame:
    return counts.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def micro(counts: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """Summed counts and their ratios; with ``by`` also each of its values, in one
    pass of grouping sets (the overall row has by = ALL)."""
    sums = [F.sum(c).cast("long").alias(c) for c in COUNTS]
    if by is None:
        return with_ratios(counts.groupBy(*keys).agg(*sums))
    c = counts.withColumn(by, F.coalesce(by, F.lit("")))
    grouped = c.groupingSets([[*keys], [*keys, by]], *keys, by).agg(*sums)
    return with_ratios(grouped.withColumn(by, F.coalesce(by, F.lit("ALL"))))


def mention_counts(gold: DataFrame, pred: DataFrame, extra: list[str] = ()) -> DataFrame:
    """A1: strict (extra, doc_id, type, tp, fp, fn)."""
    return _tally(exact_match(gold, pred, extra), [*extra, "doc_id", "type"])


def overlap_counts(gold: DataFrame, pred: DataFrame, extra: list[str] = (), threshold: float | None = None) -> DataFrame:
    """A2: the same with a one-to-one matching of overlapping spans of a type."""
    m = matched_counts(gold, pred, extra, threshold)
    return m.select(*extra, "doc_id", "type", F.col("matched").cast("long").alias("tp"), (F.col("n_pred") - F.col("matched")).alias("fp"), (F.col("n_gold") - F.col("matched")).alias("fn"))


def _compare(gold: DataFrame, pred: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    g = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True))
    p = pred.select(*keys).distinct().withColumn("in_pred", F.lit(True))
    both = g.join(p, keys, "full_outer").na.fill(False, ["in_gold", "in_pred"])
    return _tally(both, group)


def relation_counts(gold_rel, gold, pred_rel, pred, extra: list[str] = ()) -> DataFrame:
    """A4: strict relations on (head span and type, relation type, tail span and type)."""
    keys = [*extra, "doc_id", "head_start", "head_end", "head_type", "type", "tail_start", "tail_end", "tail_type"]
    return _compare(with_ends(gold_rel, gold, extra), with_ends(pred_rel, pred, extra), keys, [*extra, "doc_id", "type"])


def fact_counts(gold_rel, gold, pred_rel, pred, extra: list[str] = ()) -> DataFrame:
    """A5: normalized facts, deduplicated a document."""
    keys = [*extra, "doc_id", "head_type", "head_norm", "type", "tail_type", "tail_norm"]
    return _compare(facts(gold_rel, gold, extra), facts(pred_rel, pred, extra), keys, [*extra, "doc_id", "type"])


def macro(by_type: DataFrame, labels: DataFrame, keys: list[str], beta: float = 2.0) -> DataFrame:
    """Means of F1, F-beta and recall over a fixed list of labels; an absent label is 0."""
    from ..functions.text import f_beta

    n = labels.select("type").distinct().count()  # a closed vocabulary
    rows = by_type.join(F.broadcast(labels.select("type").distinct()), "type", "left_semi")
    mean = [(F.sum(c) / F.lit(n)).alias(name) for c, name in ((F.col("f1"), "macro_f1"), (f_beta(F.col("precision"), F.col("recall"), beta), "macro_fbeta"), (F.col("recall"), "macro_recall"))]
    return rows.groupBy(*keys).agg(*mean)


def composite(mention_f1: Column, relation_f1: Column, weight: float = 0.4) -> Column:
    return weight * mention_f1 + (1 - weight) * relation_f1


def consistency(mentions: DataFrame, relations: DataFrame, types: DataFrame, signatures: DataFrame, keys: list[str]) -> DataFrame:
    """Share of mentions of a known type, of relations whose type and ends fit a
    signature, and of both; without any item the rate is 1."""
    m = mentions.join(F.broadcast(types.select("type").withColumn("known", F.lit(True))), "type", "left")
    m = m.groupBy(*keys).agg(F.count("*").alias("n_mentions"), F.count_if(F.coalesce("known", F.lit(False))).alias("ok_mentions"))
    ends = mentions.select(*keys, "doc_id", "id", "type").dropDuplicates([*keys, "doc_id", "id"])
    r = relations
    for end in ("head", "tail"):
        r = r.join(ends.select(*keys, "doc_id", F.col("id").alias(end), F.col("type").alias(f"{end}_type")), [*keys, "doc_id", end], "left")
    r = r.join(F.broadcast(signatures.select("type", "head_type", "tail_type").withColumn("known", F.lit(True))), ["type", "head_type", "tail_type"], "left")
    r = r.groupBy(*keys).agg(F.count("*").alias("n_relations"), F.count_if(F.coalesce("known", F.lit(False))).alias("ok_relations"))
    both = m.unionByName(r, allowMissingColumns=True)
    out = both.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_mentions", "ok_mentions", "n_relations", "ok_relations")))
    a, b, c, d = (F.col(x) for x in ("ok_mentions", "n_mentions", "ok_relations", "n_relations"))
    return out.select(*keys, "n_mentions", "ok_mentions", "n_relations", "ok_relations", ratio(a, b, 1.0).alias("mention_rate"), ratio(c, d, 1.0).alias("relation_rate"), ratio(a + c, b + d, 1.0).alias("rate"))


def normalization_accuracy(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Right ids among all gold mentions with an id (misses are wrong), and among
    those whose span was found."""
    canon = canonical_id(F.col("norm"), F.col("start"), F.col("end"), F.col("type"))
    span = [*keys, *SPAN]
    g = gold.where("norm is not null").withColumn("gn", canon).groupBy(*span).agg(F.max("gn").alias("gn"))
    p = pred.withColumn("pn", canon).groupBy(*span).agg(F.max("pn").alias("pn"))
    j = g.join(p, span, "left")
    out = j.groupBy(*keys, "type").agg(F.count("*").alias("n_gold"), F.count("pn").alias("n_found"), F.count_if(F.col("gn") == F.col("pn")).alias("n_right"))
    return out.select("*", ratio(F.col("n_right"), F.col("n_gold")).alias("accuracy"), ratio(F.col("n_right"), F.col("n_found")).alias("accuracy_found"))


def evidence_reasons(relations: DataFrame, mentions: DataFrame, docs: DataFrame, longest: int = 200) -> DataFrame:
    """(doc_id, id, reasons) for every relation: invalid, long, several or missing
    mentions of an end's type inside the evidence. Evidence columns: ev_start, ev_end."""
    r = relations.join(docs.select("doc_id", F.char_length("text").alias("_n")), "doc_id", "left")
    types = mentions.select("doc_id", F.col("id"), "type").dropDuplicates(["doc_id", "id"])
    for end in ("head", "tail"):
        r = r.join(types.select("doc_id", F.col("id").alias(end), F.col("type").alias(f"{end}_type")), ["doc_id", end], "left")
    spans = r.select("doc_id", F.col("id").alias("rel"), F.col("ev_start").alias("start"), F.col("ev_end").alias("end"))
    inside = contained(mentions, spans, ["doc_id", "rel"])
    for end in ("head", "tail"):
        n = inside.select("doc_id", F.col("rel").alias("id"), F.col("type").alias(f"{end}_type"), F.col("n").alias(f"n_{end}"))
        r = r.join(n, ["doc_id", "id", f"{end}_type"], "left")
    valid = F.coalesce((F.col("ev_start") >= 0) & (F.col("ev_end") > F.col("ev_start")) & (F.col("ev_end") <= F.col("_n")), F.lit(False))
    n_head, n_tail = F.coalesce("n_head", F.lit(0)), F.coalesce("n_tail", F.lit(0))
    why = F.array(F.when(~valid, "invalid"), F.when(valid & (F.col("ev_end") - F.col("ev_start") > longest), "long"), F.when(valid & ((n_head > 1) | (n_tail > 1)), "several"), F.when(valid & ((n_head == 0) | (n_tail == 0)), "missing"))
    return r.select("doc_id", "id", "type", F.array_compact(why).alias("reasons"))


def ambiguity(reasons: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Relations, ambiguous ones and their rate (0 without any), overall or by key."""
    out = reasons.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.size("reasons") > 0).alias("n_ambiguous"))
    return out.withColumn("rate", ratio(F.col("n_ambiguous"), F.col("n")))


def reason_counts(reasons: DataFrame, keys: list[str] = ()) -> DataFrame:
    """How often each reason was given."""
    return reasons.select(*keys, F.explode("reasons").alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def raw_quality(docs, mentions, relations, types, signatures) -> DataFrame:
    """Valid mentions (known type, exact span), fitting signatures, evidence in bounds."""
    m = mentions.join(docs.select("doc_id", pieces(F.col("text")).alias("_parts")), "doc_id", "left").join(F.broadcast(types.withColumn("known", F.lit(True))), "type", "left")
    ok = F.coalesce("known", F.lit(False)) & piece_span_is_exact(F.col("_parts"), F.col("start"), F.col("end"), F.col("surface"))
    a = m.agg(F.count("*").alias("n_mentions"), F.count_if(ok).alias("valid_mentions"))
    r = with_ends(relations, mentions).join(F.broadcast(signatures.select("type", "head_type", "tail_type").withColumn("fits", F.lit(True))), ["type", "head_type", "tail_type"], "left")
    r = r.join(docs.select("doc_id", F.char_length("text").alias("_n")), "doc_id")
    covers = (F.col("ev_start") <= F.least("head_start", "tail_start")) & (F.col("ev_end") >= F.greatest("head_end", "tail_end")) & (F.col("ev_end") <= F.col("_n"))
    b = r.agg(F.count("*").alias("n_relations"), F.count_if(F.coalesce("fits", F.lit(False))).alias("valid_relations"), F.count_if(covers).alias("verifiable_evidence"))
    return a.unionByName(b, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in [*a.columns, *b.columns]))


def conditional_recall(gold_rel, gold, pred_rel, pred) -> DataFrame:
    """Recall of gold relations among those whose two ends were predicted, by type."""
    g = with_ends(gold_rel, gold).select("doc_id", "type", "head_start", "head_end", "head_type", "tail_start", "tail_end", "tail_type").distinct()
    p = with_ends(pred_rel, pred).select(*g.columns).distinct().withColumn("hit", F.lit(True))
    spans = pred.select(*SPAN).distinct()
    for end in ("head", "tail"):
        s = spans.select("doc_id", F.col("start").alias(f"{end}_start"), F.col("end").alias(f"{end}_end"), F.col("type").alias(f"{end}_type")).withColumn(f"has_{end}", F.lit(True))
        g = g.join(s, ["doc_id", f"{end}_start", f"{end}_end", f"{end}_type"], "left")
    g = g.join(p, [c for c in p.columns if c != "hit"], "left")
    both = F.col("has_head").isNotNull() & F.col("has_tail").isNotNull()
    out = g.groupBy("type").agg(F.count("*").alias("n_gold"), F.count_if(both).alias("n_available"), F.count_if(both & F.col("hit").isNotNull()).alias("n_found"), F.count_if(~both).alias("n_end_missing"))
    return out.withColumn("recall", ratio(F.col("n_found"), F.col("n_available")))


def _by_label(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts (type, tp, fp, fn, ..) for every label of a closed vocabulary, with support; the
    ratios are null where neither side has the label."""
    n = [c for c in counts.columns if c != "type"]
    full = F.broadcast(labels.select("type").distinct()).join(counts, "type", "left").na.fill(0, n)
    some = F.col("tp") + F.col("fp") + F.col("fn") > 0
    ratios = [F.when(some, c).alias(name) for c, name in zip(prf(F.col("tp"), F.col("fp"), F.col("fn")), ("precision", "recall", "f1"))]
    return full.select("type", *n, *ratios, (F.col("tp") + F.col("fn")).alias("gold_support"), (F.col("tp") + F.col("fp")).alias("predicted_support"), some.alias("applicable"))


def window_mention_scores(gold: DataFrame, predicted: DataFrame, regions: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Strict mention scores by label, every window being scored on its own region only.

    predicted: what each window gave (doc_id, w, .., document offsets); regions: windows from
    ``chunk.ownership``. Beside the scores: gold and predicted support, matches that only a
    one-to-one match of Jaccard >= threshold finds (boundary_only), and right ids among strict
    hits whose gold has an id. Labels without support have null ratios."""
    regions = stored(regions)
    cols = [*SPAN, "norm"]
    # three scores read both sides: regions and owners are found once
    g = stored(chunk.owned(gold.select(*cols), regions))
    p = stored(chunk.owned_predictions(predicted.select("w", *cols), regions))
    counts = micro(mention_counts(g, p, ["w"]), ["type"]).select("type", *COUNTS)
    near = overlap_counts(g, p, ["w"], threshold).groupBy("type").agg(F.sum("tp").alias("_near"))
    ids = normalization_accuracy(g, p, ["w"]).groupBy("type").agg(F.sum("n_found").alias("norm_total"), F.sum("n_right").alias("norm_right"))
    both = counts.join(near, "type", "left").join(ids, "type", "left").na.fill(0)
    both = both.withColumn("boundary_only", F.greatest(F.lit(0), F.col("_near") - F.col("tp"))).drop("_near")
    return _by_label(both, labels).withColumn("norm_accuracy", F.when(F.col("norm_total") > 0, F.col("norm_right") / F.col("norm_total")))


def window_relation_scores(gold_rel: DataFrame, gold: DataFrame, predicted_rel: DataFrame, predicted: DataFrame, regions: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for relations on (head span and type, relation type, tail span and type).

    A relation belongs to the window that owns the middle of the hull of its ends, or of its
    evidence where an end is unknown; as in all relation scores, those without two known ends are
    no facts and count nowhere. predicted_rel:
    (doc_id, w, type, head, tail, ev_start, ev_end), ends being ids of ``predicted``, the mentions
    that were given to all windows."""
    ends = [f"{e}_{c}" for e in ("head", "tail") for c in ("start", "end", "type")]
    keys = ["w", "doc_id", "type", *ends]

    def sided(rel: DataFrame, mentions: DataFrame) -> DataFrame:
        m = mentions.select("doc_id", "id", "start", "end", "type").withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("start"), F.desc("end")))).where("_r = 1")
        for e in ("head", "tail"):
            rel = rel.join(m.select("doc_id", F.col("id").alias(e), F.col("start").alias(f"{e}_start"), F.col("end").alias(f"{e}_end"), F.col("type").alias(f"{e}_type")), ["doc_id", e], "left")
        return chunk.relation_hull(rel)

    g = chunk.owned(sided(gold_rel, gold), regions, "hull_start", "hull_end").dropna(subset=ends).select(*keys).distinct()
    p = chunk.owned_predictions(sided(predicted_rel, predicted), regions, "hull_start", "hull_end")
    p = p.dropna(subset=ends).select(*keys).distinct()
    both = g.withColumn("in_gold", F.lit(True)).join(p.withColumn("in_pred", F.lit(True)), keys, "full_outer").na.fill(False, ["in_gold", "in_pred"])
    return _by_label(_tally(both, ["type"]), labels)


def negative_documents(docs, gold_rel, pred_rel) -> DataFrame:
    """Documents without gold relations, those with predicted ones, and their rate."""
    neg = docs.select("doc_id").join(gold_rel.select("doc_id"), "doc_id", "left_anti")
    n = pred_rel.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = neg.join(n, "doc_id", "left").agg(F.count("*").alias("n_negative"), F.count("n").alias("n_with_predictions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_predictions"))
    return out.withColumn("rate", ratio(F.col("n_with_predictions"), F.col("n_negative")))


def corpus_stats(docs, mentions, relations, splits) -> DataFrame:
    """By split and kind of item: items, and documents that hold one."""
    s = splits.select("doc_id", "split")
    parts = [docs.select("doc_id", F.lit("document").alias("item"), F.lit("").alias("type")), mentions.select("doc_id", F.lit("mention").alias("item"), "type"), relations.select("doc_id", F.lit("relation").alias("item"), "type")]
    rows = parts[0].union(parts[1]).union(parts[2]).join(s, "doc_id")
    # a document's items are counted first, so that no distinct count has to sort them
    per = rows.groupBy("split", "item", "type", "doc_id").agg(F.count("*").alias("c"))
    return per.groupBy("split", "item", "type").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs"))


def document_features(docs, mentions, relations) -> DataFrame:
    """(doc_id, features): types present, relation types, negative, repeated mention."""
    m = mentions.groupBy("doc_id", "type", F.lower("surface").alias("s")).agg(F.count("*").alias("c"))
    rows = m.select("doc_id", F.concat(F.lit("has:"), "type").alias("f")).union(m.where("c > 1").select("doc_id", F.lit("repeated_mention")))
    r = relations.groupBy("doc_id", "type").agg(F.count("*").alias("c"))
    rows = rows.union(r.select("doc_id", F.concat(F.lit("rel:"), "type"))).union(r.where("c > 1").select("doc_id", F.concat(F.lit("multi:"), "type")))
    rows = rows.union(docs.select("doc_id").join(relations.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("negative")))
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("f")).alias("features"))
    return docs.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce("features", F.array().cast("array<string>")).alias("features"))


def frequent_false_positives(gold, pred, most: int = 20) -> DataFrame:
    """The surfaces most often predicted where gold has nothing, top ``most`` a type."""
    fp = pred.join(gold.select(*SPAN), SPAN, "left_anti").groupBy("type", "surface").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy(F.desc("n"), "surface")
    return fp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def document_scores(docs, gold, pred, kind: str = "Configuration") -> DataFrame:
    """Per document strict counts of one type; recall and F1 are null without gold."""
    c = mention_counts(gold.where(F.col("type") == kind), pred.where(F.col("type") == kind)).select("doc_id", *COUNTS)
    out = docs.select("doc_id").join(c, "doc_id", "left").na.fill(0, COUNTS).withColumn("n_gold", F.col("tp") + F.col("fn"))
    _, recall, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("doc_id", "n_gold", *COUNTS, F.when(F.col("n_gold") > 0, recall).alias("recall"), F.when(F.col("n_gold") > 0, f1).alias("f1"))


def corpus_sizes(docs, wins, mentions, splits, text: str = "text") -> DataFrame:
    """Per split documents, characters, windows, the most windows of a document, mentions,
    and mentions as windows see them (once in each window that holds them)."""
    per = docs.select("doc_id", F.coalesce(F.char_length(text), F.lit(0)).alias("n_chars"))
    seen = chunk.project_mentions(mentions.select("doc_id", "start", "end"), wins)
    for rows, name in ((wins, "n_windows"), (mentions, "n_mentions"), (seen, "n_window_mentions")):
        per = per.join(rows.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").na.fill(0, [name])
    sums = [F.sum(c).alias(c) for c in ("n_chars", "n_windows", "n_mentions", "n_window_mentions")]
    return per.join(splits.select("doc_id", "split"), "doc_id").groupBy("split").agg(F.count("*").alias("n_docs"), *sums, F.max("n_windows").alias("most_windows"))


def recall_by_depth(gold, pred, docs, parts: int = 3) -> DataFrame:
    """Strict recall by where in the text a mention's middle lies (1 .. parts)."""
    n = docs.select("doc_id", F.char_length("text").alias("_n"))
    g = gold.select(*SPAN).distinct().join(n, "doc_id")
    third = F.least(F.lit(parts), F.floor((F.col("start") + F.col("end")) * parts / (2 * F.col("_n"))).cast("int") + 1)
    g = g.withColumn("part", third).join(pred.select(*SPAN).distinct().withColumn("hit", F.lit(1)), SPAN, "left")
    out = g.groupBy("part").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_found"))
    return out.withColumn("recall", ratio(F.col("n_found"), F.col("n_gold")))
