"""Overlapping windows, exclusive ownership and merging back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .link import last_before
from .sweep import overlap_join

MAX_CHARS, OVERLAP = 3000, 400
#: Where a window may end, best first among equals by position: the latest in its second half.
BREAKS = ("\n\n", "\n", "。", ". ")
_STARTS = (re.compile(r"\n(?=[^\n]*CVE-\d{4}-\d{4,})"), re.compile(r"\n\n"), re.compile(r"[.!?。]\s+"), re.compile(r"\n"))


def window_bounds(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, snap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the windows of one text; snap: how far a start may move to the nearest
    heading, paragraph, sentence or line (C2; 0 leaves it)."""
    n, out, start = len(text), [], 0
    if n <= max_chars:
        return [(0, n)]
    while True:
        end = min(n, start + max_chars)
        if end < n:
            half = start + max_chars // 2
            cut = max((k + len(b) for b in BREAKS if (k := text.rfind(b, half, end)) >= 0), default=end)
            end = cut
        out.append((start, end))
        if end >= n:
            return out
        nxt = max(start + 1, end - overlap)
        if snap:
            nxt = max(start + 1, min(_snapped(text, nxt, snap), end))
        start = nxt


def _snapped(text: str, at: int, reach: int) -> int:
    lo, hi = max(0, at - reach), min(len(text), at + reach)
    for pattern in _STARTS:
        ends = [m.end() for m in pattern.finditer(text, lo, hi)]
        if ends:
            return min(ends, key=lambda e: (abs(e - at), e))
    return at


def windows(docs: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, snap: int = 0, text: str = "text") -> DataFrame:
    """(doc_id, w, w_start, w_end); sequential in a text, so one Arrow function a row."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: window_bounds(t or "", max_chars, overlap, snap))

    rows = docs.select("doc_id", F.posexplode(cut(text)).alias("w", "z"))
    return rows.select("doc_id", "w", F.col("z.s").alias("w_start"), F.col("z.e").alias("w_end"))


def stride_windows(docs: DataFrame, length: int = MAX_CHARS, stride: int = MAX_CHARS - OVERLAP, text: str = "text") -> DataFrame:
    """C1 with fixed stride, without Python: the last window ends the text."""
    n = F.char_length(text)
    last = F.when(n <= length, 0).otherwise(F.ceil((n - length) / stride).cast("int"))
    rows = docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("w"))
    return rows.select("doc_id", "w", (F.col("w") * stride).alias("w_start"), F.least("n", F.col("w") * stride + length).alias("w_end"))


def split_dense(wins: DataFrame, mentions: DataFrame, runs: DataFrame, most: int = 20, seam: int = 100, records: DataFrame | None = None) -> DataFrame:
    """Windows that hold a dense run are cut into pieces that begin at most ``most`` of the
    run's mentions each, as even as can be; pieces reach ``seam`` over inner cuts on both sides,
    all is covered.

    A cut falls on the start of a piece's first mention, or, with ``records`` (doc_id, start), on
    the last record border that lies between it and the mention before; a record that holds both
    moves the cut back to where it begins, so that no record is split while its mentions fit."""
    w = wins.select("doc_id", "w", F.col("w_start").cast("long").alias("w_start"), F.col("w_end").cast("long").alias("w_end"))
    m = mentions.select("doc_id", F.col("start").cast("long").alias("start")).distinct().withColumn("end", F.col("start") + 1)
    r = runs.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    in_run = overlap_join(m, r, ["doc_id"]).select("doc_id", F.col("l_start").alias("start"), F.col("l_end").alias("end"), F.col("r_start").alias("run"))
    spans = w.select("doc_id", F.col("w_start").alias("start"), F.col("w_end").alias("end"), "w")
    j = overlap_join(in_run, spans, ["doc_id"]).select("doc_id", F.col("r_w").alias("w"), F.col("r_start").alias("w_start"), F.col("r_end").alias("w_end"), F.col("l_run").alias("run"), F.col("l_start").alias("start"))
    by_run = Window.partitionBy("doc_id", "w", "run")
    if records is None:
        j = j.withColumn("border", F.col("start")).withColumn("size", F.lit(1))
    else:  # whole records are dealt out instead of mentions
        j = last_before(j, records.select("doc_id", F.col("start").cast("long").alias("start"), F.col("start").cast("long").alias("border")), "border")
        j = j.withColumn("border", F.greatest(F.coalesce("border", F.col("w_start")), F.col("w_start")))
        j = j.groupBy("doc_id", "w", "w_start", "w_end", "run", "border").agg(F.count("*").alias("size"), F.min("start").alias("start"))
    before = F.sum("size").over(by_run.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    j = j.withColumn("k", before).withColumn("n", F.sum("size").over(by_run)).withColumn("fit", F.max("size").over(by_run))
    pieces = F.ceil(F.col("n") / most)
    each = F.ceil(F.col("n") / pieces)
    if records is not None:  # a piece takes whole records: room for the largest one is left, unless it fills a piece alone
        each = F.greatest(F.lit(1), F.least(each, most - F.col("fit") + 1))
    part = F.floor(F.col("k") / each)
    first = F.row_number().over(Window.partitionBy("doc_id", "w", "run", "part").orderBy("start"))
    cuts = j.withColumn("part", part).withColumn("first", first).where((F.col("first") == 1) & (F.col("part") > 0) & (F.col("border") > F.col("w_start")))
    cuts = cuts.select("doc_id", "w", "w_start", "w_end", F.col("border").alias("cut"))
    starts = w.withColumn("cut", F.col("w_start")).unionByName(cuts).distinct()
    by = Window.partitionBy("doc_id", "w").orderBy("cut")
    out = starts.withColumn("next", F.lead("cut").over(by)).withColumn("piece", F.row_number().over(by) - 1)
    lo = F.greatest("w_start", F.col("cut") - F.when(F.col("piece") > 0, seam).otherwise(0))
    return out.select("doc_id", "w", "piece", lo.alias("w_start"), F.least("w_end", F.coalesce(F.col("next") + seam, F.col("w_end"))).alias("w_end"))


def ownership(wins: DataFrame) -> DataFrame:
    """C4: twice the bounds of each window's own region, the middle of every overlap being the
    border: own_lo2 <= position * 2 < own_hi2. The first and the last region are open."""
    by = Window.partitionBy("doc_id").orderBy("w_start", "w_end", "w")
    lo = F.coalesce(F.lag("w_end").over(by) + F.col("w_start"), F.lit(-(1 << 40)))
    hi = F.coalesce(F.lead("w_start").over(by) + F.col("w_end"), F.lit(1 << 40))
    return wins.withColumn("own_lo2", lo).withColumn("own_hi2", hi)


def owned(spans: DataFrame, wins: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Every span with the one window that owns its middle (``wins`` from ``ownership``).

    Regions partition a text, so the owner is the last one that begins at or before the middle:
    an as-of pass, no range join. Spans without offsets have no owner."""
    rows = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select("doc_id", (F.col(start) + F.col(end)).cast("long").alias("start"), F.struct(*spans.columns).alias("_row"))
    marks = wins.where("own_lo2 < own_hi2").select("doc_id", F.col("own_lo2").cast("long").alias("start"), F.struct("w", "own_hi2").alias("_own"))
    return last_before(rows, marks, "_own").where(F.col("start") < F.col("_own.own_hi2")).select("_row.*", "_own.w")


def owned_predictions(predictions: DataFrame, wins: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Of what every window predicted (doc_id, w, .., document offsets) the rows that lie in
    the window's own region; what it saw of its neighbours' regions goes."""
    return owned(predictions.withColumnRenamed("w", "_by"), wins, start, end).where("_by = w").drop("_by")


def relation_hull(relations_with_ends: DataFrame) -> DataFrame:
    """C5 for relations: the hull of both ends, or the evidence where an end is missing."""
    lo, hi = F.least("head_start", "tail_start"), F.greatest("head_end", "tail_end")
    both = F.col("head_start").isNotNull() & F.col("tail_start").isNotNull()
    return relations_with_ends.withColumn("hull_start", F.when(both, lo).otherwise(F.col("ev_start"))).withColumn("hull_end", F.when(both, hi).otherwise(F.col("ev_end")))


def _in_windows(rows: DataFrame, wins: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with every window that their closed span touches: a sweep a document."""
    spans = rows.select("doc_id", F.col(start).alias("start"), F.col(end).alias("end"), F.struct(*rows.columns).alias("row"))
    w = wins.select("doc_id", F.col("w_start").alias("start"), F.col("w_end").alias("end"), "w")
    j = overlap_join(spans, w, ["doc_id"], touching=True)
    return j.select("l_row.*", F.col("r_w").alias("w"), F.col("r_start").alias("w_start"), F.col("r_end").alias("w_end"))


def project_mentions(mentions: DataFrame, wins: DataFrame) -> DataFrame:
    """Mentions that lie in a window, with offsets relative to it."""
    j = _in_windows(mentions, wins, "start", "end").where("start >= w_start and end <= w_end")
    return j.withColumn("start", F.col("start") - F.col("w_start")).withColumn("end", F.col("end") - F.col("w_start")).drop("w_start", "w_end")


def project_evidence(relations: DataFrame, wins: DataFrame) -> DataFrame:
    """Evidence clipped to each window that it touches, flagged where it was cut."""
    j = _in_windows(relations, wins, "ev_start", "ev_end").where("ev_start < w_end and ev_end > w_start")
    lo, hi = F.greatest("ev_start", "w_start"), F.least("ev_end", "w_end")
    j = j.withColumn("truncated", (lo > F.col("ev_start")) | (hi < F.col("ev_end")))
    return j.withColumn("_lo", lo - F.col("w_start")).withColumn("ev_end", hi - F.col("w_start")).withColumn("ev_start", F.col("_lo")).drop("_lo", "w_start", "w_end")


def to_document(window_mentions: DataFrame, wins: DataFrame) -> DataFrame:
    """Offsets of window predictions moved to the document."""
    w = wins.select("doc_id", "w", "w_start")
    j = window_mentions.join(w, ["doc_id", "w"])
    return j.withColumn("start", F.col("start") + F.col("w_start")).withColumn("end", F.col("end") + F.col("w_start")).drop("w_start")


def merge_windows(mentions: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """One mention a span and type, from the earliest window, numbered E1.. in
    order of (start, end, type); relation ends follow, self and repeated relations go.

    mentions: (doc_id, w, id, start, end, type, ..); relations: (doc_id, w, type, head, tail, ..)."""
    span = ["doc_id", "start", "end", "type"]
    first = mentions.withColumn("_r", F.row_number().over(Window.partitionBy(*span).orderBy("w", "id"))).where("_r = 1").drop("_r")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "type"))
    merged = first.withColumn("new_id", F.concat(F.lit("E"), number.cast("string")))
    out = merged.drop("id", "w").withColumnRenamed("new_id", "id")
    if relations is None:
        return out, None
    ids = mentions.select(*span, "w", "id").join(merged.select(*span, "new_id"), span).select("doc_id", "w", "id", "new_id").distinct()
    r = relations
    for end in ("head", "tail"):
        r = r.join(ids.select("doc_id", "w", F.col("id").alias(end), F.col("new_id").alias(f"_{end}")), ["doc_id", "w", end])
    r = r.where("_head <> _tail").withColumn("head", F.col("_head")).withColumn("tail", F.col("_tail")).drop("_head", "_tail")
    r = r.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "type", "head", "tail").orderBy("w"))).where("_r = 1").drop("_r", "w")
    order = Window.partitionBy("doc_id").orderBy("head", "tail", "type")
    return out, r.withColumn("id", F.concat(F.lit("R"), F.row_number().over(order).cast("string")))


def inventory(wins: DataFrame, docs: DataFrame, splits: DataFrame, text: str = "text") -> DataFrame:
    """Per split the windows and a digest of (document, bounds, text hash) that does not
    depend on row order: digests of documents are built first, then those of the split."""
    cut = F.substr(F.col(text), (F.col("w_start") + 1).cast("int"), (F.col("w_end") - F.col("w_start")).cast("int"))
    rows = wins.join(docs.select("doc_id", text), "doc_id").select("doc_id", "w_start", F.concat_ws(":", "w_start", "w_end", F.sha2(cut, 256)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("w_start", "line"))), lambda x: x["line"])
    per = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("d"))
    per = per.join(splits.select("doc_id", "split"), "doc_id")
    # a sum of 60-bit numbers: order-free and of one size, whatever the number of documents
    number = F.conv(F.substring("d", 1, 12), 16, 10).cast("decimal(38,0)")
    return per.groupBy("split").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_windows"), F.sum(number).cast("string").alias("digest"))


def predict(wins: DataFrame, done: DataFrame, predictor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, batch: int = 32) -> DataFrame:
    """Runs a user's function over the windows that ``done`` does not have yet."""
    todo = wins.join(done.select("doc_id", "w").distinct(), ["doc_id", "w"], "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from predictor(part for pdf in batches for part in (pdf.iloc[k : k + batch] for k in range(0, len(pdf), batch)))

    return todo.mapInPandas(run, schema)
