"""Catalogue checks and corrections."""

from __future__ import annotations

from bisect import insort
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import product_family
from .textscan import OUT


def catalogue_check(items: DataFrame, links: DataFrame, feed: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Status of every product mention against the products of its linked records.

    items: (doc_id, id, norm); links: (doc_id, id, record); feed: (record, criteria). Families
    are part:vendor:product; a decision KEEP (doc_id, id, decision) overrides."""
    fam = feed.select("record", product_family(F.col("criteria")).alias("fam")).where("fam is not null").distinct()
    mine = items.withColumn("fam", product_family(F.col("norm")))
    linked = links.groupBy("doc_id", "id").agg(F.count("*").alias("n_links"))
    tail = F.regexp_extract("fam", r"^[^:]*:(.*)$", 1)
    seen = links.join(fam.withColumnRenamed("fam", "their"), "record").select("doc_id", "id", "their").distinct()
    j = mine.join(seen, ["doc_id", "id"], "left")
    same, near = F.col("their") == F.col("fam"), F.regexp_extract("their", r"^[^:]*:(.*)$", 1) == tail
    per = j.groupBy("doc_id", "id", "norm", "fam").agg(F.count("their").alias("n_their"), F.coalesce(F.bool_or(same), F.lit(False)).alias("same"), F.coalesce(F.bool_or(near), F.lit(False)).alias("near"))
    every = fam.select("fam").distinct().withColumn("anywhere", F.lit(True))
    per = per.join(linked, ["doc_id", "id"], "left").join(every, "fam", "left")
    status = (
        F.when(F.col("fam").isNull(), "invalid_id").when(F.col("n_links").isNull(), "no_linked_record").when(F.col("n_their") == 0, "no_record_products").when(F.col("same"), "validated")
        .when(F.col("near"), "part_mismatch").when(F.col("anywhere"), "known_but_not_linked").otherwise("family_not_linked")
    )
    if decisions is not None:
        per = per.join(decisions.select("doc_id", "id", "decision"), ["doc_id", "id"], "left")
        status = F.when(F.col("decision") == "KEEP", "validated_by_decision").otherwise(status)
    return per.select("doc_id", "id", "norm", status.alias("status"))


def _most(a: list[str], b: list[str]) -> np.ndarray:
    """Upper bounds of the block ratios of strings a (rows) and b: at most so many characters can be in matching blocks as both have."""
    signs = {c: k for k, c in enumerate(sorted(set("".join(a))))}
    counts = [np.zeros((len(x), len(signs)), np.int32) for x in (a, b)]
    for strings, n in zip((a, b), counts):
        for k, s in enumerate(strings):
            for c in s:
                if c in signs:
                    n[k, signs[c]] += 1
    size = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])
    shared = sum((np.minimum.outer(counts[0][:, k], counts[1][:, k]) for k in range(len(signs))), np.zeros(size.shape, np.int64))
    return np.where(size > 0, 2.0 * shared / np.maximum(size, 1), 1.0)


def block_ratio(a: str, b: str) -> float:
    """Twice the characters in longest matching blocks, found again left and right of each, over
    both lengths."""
    return SequenceMatcher(None, a, b).ratio()


def family_similarity(a: str, b: str) -> float:
    """0.12 for the same part, 0.28 and 0.60 times the block ratios of vendors and products."""
    (part_a, vendor_a, product_a), (part_b, vendor_b, product_b) = a.split(":", 2), b.split(":", 2)
    return round((0.12 if part_a == part_b else 0.0) + 0.28 * block_ratio(vendor_a, vendor_b) + 0.60 * block_ratio(product_a, product_b), 4)


#: Items of a document that meet its candidates in one row.
ITEMS = 256


@lru_cache(1 << 14)
def _matcher(b: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", b)  # what it knows of b serves every a


@lru_cache(1 << 17)
def _ratio(a: str, b: str) -> float:
    m = _matcher(b)
    m.set_seq1(a)
    return m.ratio()


def _ranked(families: list[str], criteria: list[str], theirs: list[str], most: int) -> list[list[tuple[float, str]]]:
    """Per family the (-score, criteria) of its ``most`` best candidates. Candidates are taken by falling
    bound, and none is scored whose bound is below the last place."""
    mine, other = ([f.split(":", 2) for f in x] for x in (families, theirs))
    part = np.array([x[0] for x in mine])[:, None] == np.array([x[0] for x in other])
    bound = 0.12 * part + 0.28 * _most([x[1] for x in mine], [x[1] for x in other]) + 0.6 * _most([x[2] for x in mine], [x[2] for x in other]) + 1e-4
    out = []
    for (p, vendor, product), limits in zip(mine, bound):
        best: list[tuple[float, str]] = []
        for k in np.argsort(-limits, kind="stable"):
            if len(best) == most and limits[k] < -best[-1][0]:
                break
            q, their_vendor, their_product = other[k]
            score = round((0.12 if p == q else 0.0) + 0.28 * _ratio(vendor, their_vendor) + 0.60 * _ratio(product, their_product), 4)
            insort(best, (-score, criteria[k]))
            del best[most:]
        out.append(best)
    return out


def ranked_candidates(items: DataFrame, candidates: DataFrame, most: int = 12) -> DataFrame:
    """Per item the ``most`` candidates of highest family_similarity, ties by criteria.

    candidates: (doc_id, id, criteria), or (doc_id, criteria) where a document's candidates are those of
    all its items. Items and candidates are shuffled as they are and meet in rows of at most
    ITEMS items, so that no pair is a row; bounds from shared characters tell which pairs are scored."""
    keys = ["doc_id", "id"] if "id" in candidates.columns else ["doc_id"]
    c = candidates.select(*keys, "criteria", product_family(F.col("criteria")).alias("b")).where("b is not null").distinct()
    c = c.groupBy(*keys).agg(F.collect_list(F.struct("criteria", "b")).alias("c"))
    i = items.select("doc_id", "id", product_family(F.col("norm")).alias("a")).where("a is not null").groupBy("doc_id", "id").agg(F.collect_set("a").alias("a"))
    if len(keys) == 1:
        i = i.withColumn("_b", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1) / ITEMS))
        i = i.groupBy("doc_id", "_b").agg(F.collect_list(F.struct("id", "a")).alias("i"))
        # few bytes and much work: a fixed number of partitions is not coalesced
        parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = i.join(c, "doc_id").select("doc_id", "i", "c", "_b").repartition(parts, "doc_id", "_b").drop("_b")
    else:
        rows = i.join(c, keys).select("doc_id", F.array(F.struct("id", "a")).alias("i"), "c")

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                mine, theirs = (batch[x].slice(k, 1).flatten() for x in "ic")
                ids, lists = mine.field("id").to_pylist(), mine.field("a").to_pylist()
                families = sorted({a for x in lists for a in x})
                best = dict(zip(families, _ranked(families, theirs.field("criteria").to_pylist(), theirs.field("b").to_pylist(), most)))
                for one, x in zip(ids, lists):
                    for rank, (score, criteria) in enumerate(sorted(y for a in x for y in best[a])[:most], 1):
                        for column, value in zip(out, (k, one, criteria, -score, rank)):
                            column.append(value)
                if len(out[0]) >= OUT or k == batch.num_rows - 1:
                    cols = [batch["doc_id"].take(pa.array(out[0], pa.int64())), pa.array(out[1], mine.field("id").type), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "id", "criteria", "score", "rank"])
                    out = [[], [], [], [], []]

    kind = {f.name: f.dataType.simpleString() for f in rows.schema["i"].dataType.elementType} | {"doc_id": rows.schema["doc_id"].dataType.simpleString()}
    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, id {kind['id']}, criteria string, score double, rank int")


def family_presence(wanted: DataFrame, feed: DataFrame) -> DataFrame:
    """(fam, years) in which the feed (year, criteria) holds the wanted families."""
    f = feed.select("year", product_family(F.col("criteria")).alias("fam")).where("fam is not null").distinct()
    hit = f.join(wanted.select("fam").distinct(), "fam", "left_semi")
    return hit.groupBy("fam").agg(F.array_sort(F.collect_set("year")).alias("years"))


def expand_rules(rules: DataFrame, findings: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Decisions (rule_id, doc_id, id, action, new_value) of rules whose set keys all
    match, and violations: rules with another number of matches than expected, and items that
    several rules claim. A rule's key that is null matches anything; at least one is set."""
    r = F.broadcast(rules.select("rule_id", "action", "new_value", "expected", *(F.col(k).alias(f"r_{k}") for k in keys)))  # a hand-written ledger
    cond = F.coalesce(*(F.col(f"r_{k}") for k in keys)).isNotNull()
    for k in keys:
        cond = cond & (F.col(f"r_{k}").isNull() | (F.col(f"r_{k}") == F.col(k)))
    hits = findings.join(r, cond).select("rule_id", "doc_id", "id", "action", "new_value")
    n = rules.select("rule_id", "expected").join(hits.groupBy("rule_id").agg(F.count("*").alias("n")), "rule_id", "left").na.fill(0, ["n"])
    wrong = n.where("n <> expected").select("rule_id", F.lit("count").alias("problem"), F.col("n").cast("string").alias("detail"))
    twice = hits.groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.min("rule_id").alias("rule_id")).where("n > 1")
    return hits, wrong.union(twice.select("rule_id", F.lit("claimed_twice"), F.concat_ws("/", F.col("doc_id").cast("string"), "id")))


def apply_decisions(mentions: DataFrame, relations: DataFrame, decisions: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Mentions and relations after the decisions, what was quarantined of both (relations
    with the reason), and violations (doc_id, id, action, problem).

    decisions: (doc_id, id, action KEEP / REVISE / REJECT, old_norm, new_norm, new_start, new_end),
    and if wanted old_start, old_end, old_surface and new_surface. Violations change nothing:
    several decisions on one item; an item that is not there (a rejected one may be gone); one
    whose id, or whose span and surface where they are given, are neither the old nor the new
    ones; a new span that lies outside the text or does not read new_surface. Running twice
    changes nothing more. Rejected mentions take their relations with them."""
    optional = [c for c in ("old_start", "old_end", "old_surface", "new_surface") if c in decisions.columns]
    d = decisions.select("doc_id", "id", "action", "old_norm", "new_norm", "new_start", "new_end", *optional)
    for c in {"old_start", "old_end", "old_surface", "new_surface"} - set(optional):
        d = d.withColumn(c, F.lit(None).cast("string" if c.endswith("surface") else "int"))
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "id")))
    # only texts that a new span is cut from meet the decisions
    spans = d.where("new_start is not null").select("doc_id", "new_start", "new_end").distinct()
    cut = F.when((F.col("new_start") >= 0) & (F.col("new_end") > F.col("new_start")) & (F.col("new_end") <= F.char_length("text")), F.substr("text", (F.col("new_start") + 1).cast("int"), (F.col("new_end") - F.col("new_start")).cast("int")))
    spans = spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "new_start", "new_end", cut.alias("_cut"))
    d = d.join(spans, ["doc_id", "new_start", "new_end"], "left")
    j = mentions.join(d, ["doc_id", "id"], "left")
    known = F.col("norm").eqNullSafe(F.col("old_norm")) | F.col("norm").eqNullSafe(F.coalesce("new_norm", "old_norm"))

    def stands(which: str) -> Column:
        """The mention is where, and reads as, the decision says; what is not stated fits."""
        fits = F.lit(True)
        for c in ("start", "end", "surface"):
            fits = fits & (F.col(f"{which}_{c}").isNull() | (F.col(c) == F.col(f"{which}_{c}")))
        return fits

    # a span that moves is where it was or where it goes; without a new one, only where it was
    placed = stands("old") | (F.col("new_start").isNotNull() & stands("new"))
    fits = F.col("new_start").isNull() | (F.col("_cut").isNotNull() & (F.col("new_surface").isNull() | (F.col("_cut") == F.col("new_surface"))))
    why = F.when(F.col("_n") > 1, "decided_twice").when(~F.coalesce(known, F.lit(False)), "other_id").when(~F.coalesce(placed, F.lit(False)), "other_span").when(~F.coalesce(fits, F.lit(False)), "no_slice")
    j = j.withColumn("_why", F.when(F.col("action").isNotNull(), why))
    good = F.col("action").isNotNull() & F.col("_why").isNull()
    revise, reject = good & (F.col("action") == "REVISE"), good & (F.col("action") == "REJECT")
    moved = revise & F.col("new_start").isNotNull()
    fixed = {
        "norm": F.when(revise, F.coalesce("new_norm", "norm")).otherwise(F.col("norm")), "surface": F.when(moved, F.col("_cut")).otherwise(F.col("surface")),
        "start": F.when(moved, F.col("new_start")).otherwise(F.col("start")), "end": F.when(moved, F.col("new_end")).otherwise(F.col("end")),
    }
    kept = j.where(~F.coalesce(reject, F.lit(False))).select(*[fixed.get(c, F.col(c)).alias(c) for c in mentions.columns]).distinct()
    gone = j.where(reject).select(*mentions.columns).distinct()
    ids = gone.select("doc_id", F.col("id").alias("x")).distinct()
    ends = relations.select("doc_id", "id", F.explode(F.array_distinct(F.array("head", "tail"))).alias("x"))
    touch = ends.join(ids, ["doc_id", "x"]).groupBy("doc_id", "id").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("_x"))
    torn = relations.join(touch, ["doc_id", "id"]).select(*relations.columns, F.concat(F.lit("rejected end: "), "_x").alias("reason"))
    bad = j.where("_why is not null").select("doc_id", "id", "action", F.col("_why").alias("problem"))
    absent = d.join(mentions.select("doc_id", "id"), ["doc_id", "id"], "left_anti").select("doc_id", "id", "action", F.when(F.col("_n") > 1, "decided_twice").when(F.col("action") != "REJECT", "no_item").alias("problem")).where("problem is not null")
    return {
        "mentions": kept, "relations": relations.join(touch, ["doc_id", "id"], "left_anti").select(*relations.columns),
        "quarantine": gone, "quarantined_relations": torn, "violations": bad.union(absent).distinct(),
    }
