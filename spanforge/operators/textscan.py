"""Scans inside documents that give tables with offsets.

Offsets are 0-based, end-exclusive and count code points. Every operator keeps the document
as partition key, so one exchange on it serves what follows."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The four sentence definitions, as the pattern of what ends a sentence.
SENTENCE_ENDS = {"dot": r"[.\n。]", "mark": r"[.\n。!?！？]", "spaced": r"[.!?](?=\s|$)", "block": r"[.!?]\s+|\n{2,}"}


#: Matches of an output batch, and a number above any offset.
OUT, OFFSETS = 1 << 15, 1 << 42


def scan(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, i, start, end, surface) of every match; the pattern has no groups of its own
    and no empty match.

    Matches and the lengths of what lies between them alternate, so a running sum inside a
    document's row gives the offsets: nothing is shuffled or sorted."""
    whole = F.coalesce(F.col(text), F.lit(""))
    gaps = F.transform(F.split(whole, pattern, -1), lambda p: F.char_length(p))
    rows = docs.select("doc_id", gaps.alias("gaps"), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("found"))
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("i", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("surface", T.StringType())])
    return rows.mapInArrow(_offsets, out)


def _offsets(batches):
    """Rows (doc_id, gaps, found) to one row a match; a document has one gap more than matches."""
    for batch in batches:
        n = pc.list_value_length(batch["found"]).to_numpy(zero_copy_only=False).astype(np.int64)
        words, gaps = batch["found"].flatten(), batch["gaps"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(gaps) != len(words) + len(n):
            raise ValueError("the pattern matches empty strings")
        row = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        i = np.arange(len(row)) - first[row]
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(gaps[np.arange(len(row)) + row] + size)  # skips the last gap of each row before
        end = upto - np.concatenate([[0], upto])[first][row]
        cols = [batch["doc_id"].take(pa.array(row)), pa.array(i.astype(np.int32)), pa.array(end - size), pa.array(end), words]
        whole = pa.RecordBatch.from_arrays(cols, names=["doc_id", "i", "start", "end", "surface"])
        for at in range(0, whole.num_rows, OUT):
            yield whole.slice(at, OUT)


def scan_types(docs: DataFrame, patterns: dict[str, str], norm=None, text: str = "text") -> DataFrame:
    """X1 for several typed patterns: (doc_id, start, end, type, surface, norm)."""
    out = None
    for kind, pattern in patterns.items():
        part = scan(docs, pattern, text).select("doc_id", "start", "end", F.lit(kind).alias("type"), "surface")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("norm", (norm or F.upper)(F.col("surface")))


def fill_in(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Mentions of ``found`` at no span and type of ``existing``, joined to it."""
    keys = ["doc_id", "start", "end", "type"]
    return existing.unionByName(found.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def sentences(docs: DataFrame, mode: str = "dot", text: str = "text") -> DataFrame:
    """(doc_id, k, start, end) of a partition of every text; a sentence holds its end mark.

    mode: dot, mark, spaced or block, see SENTENCE_ENDS. Empty texts have no sentence. As in a
    scan, running sums inside a document's row give the offsets."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lengths = lambda parts: F.transform(parts, lambda p: F.char_length(p))
    rows = docs.select("doc_id", lengths(F.split(whole, SENTENCE_ENDS[mode], -1)).alias("gaps"), lengths(F.regexp_extract_all(whole, F.lit(SENTENCE_ENDS[mode]), F.lit(0))).alias("marks"))
    return rows.mapInArrow(_sentence_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k int, start long, end long")


def _sentence_rows(batches):
    """Rows (doc_id, gaps, marks) of lengths to one row a sentence; each mark ends one, and so does the last gap if it is any."""
    for batch in batches:
        n = pc.list_value_length(batch["gaps"]).to_numpy(zero_copy_only=False).astype(np.int64)
        gaps, marks = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("gaps", "marks"))
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        last = k == n[row] - 1
        size = gaps.copy()
        size[~last] += marks
        upto = np.cumsum(size)
        start = upto - size
        start -= start[np.cumsum(n) - n][row]
        some = size > 0
        cols = [batch["doc_id"].take(pa.array(row[some])), pa.array(k[some].astype(np.int32)), pa.array(start[some]), pa.array((start + size)[some])]
        whole = pa.RecordBatch.from_arrays(cols, names=["doc_id", "k", "start", "end"])
        for at in range(0, whole.num_rows, OUT):
            yield whole.slice(at, OUT)


def scan_in_sentences(docs: DataFrame, pattern: str, mode: str = "dot", text: str = "text") -> DataFrame:
    """(doc_id, start, surface, k) of every match of a pattern with the number of the sentence that it
    starts in: both are told from the document's row, so nothing is shuffled or sorted."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lengths = lambda parts: F.transform(parts, lambda p: F.char_length(p))
    ends = SENTENCE_ENDS[mode]
    rows = docs.select(
        "doc_id", lengths(F.split(whole, pattern, -1)).alias("gaps"), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("found"),
        lengths(F.split(whole, ends, -1)).alias("s_gaps"), lengths(F.regexp_extract_all(whole, F.lit(ends), F.lit(0))).alias("s_marks"),
    )

    def run(batches):
        for b in batches:
            row = pa.array(np.arange(b.num_rows))
            marks = pa.Table.from_batches(_sentence_rows([pa.RecordBatch.from_arrays([row, b["s_gaps"], b["s_marks"]], names=["doc_id", "gaps", "marks"])]), _SENTENCES)
            hits = pa.Table.from_batches(_offsets([pa.RecordBatch.from_arrays([row, b["gaps"], b["found"]], names=["doc_id", "gaps", "found"])]), _HITS)
            if not hits.num_rows:
                continue
            key = lambda t: t["doc_id"].to_numpy() * OFFSETS + t["start"].to_numpy()
            at = np.searchsorted(key(marks), key(hits), "right") - 1
            out = pa.Table.from_arrays([b["doc_id"].take(hits["doc_id"].combine_chunks()), hits["start"], hits["surface"], marks["k"].take(pa.array(at))], names=["doc_id", "start", "surface", "k"])
            yield from out.combine_chunks().to_batches(OUT)

    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, surface string, k int")


_SENTENCES = pa.schema([("doc_id", pa.int64()), ("k", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_HITS = pa.schema([("doc_id", pa.int64()), ("i", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string())])


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, k, start, end, line) of every \\n-split line."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("k", "line"))
    upto = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.char_length("line") + 1).over(upto) - 1
    return rows.select("doc_id", "k", (end - F.char_length("line")).alias("start"), end.alias("end"), "line")


# Signs that begin an item inside a line, and the longest table row.
BULLETS, LONGEST_ROW = "\u2022\u2023\u25e6\u25aa\u25cf\uf077\uf0a7\uf0b7", 2000


def list_items(line_rows: DataFrame) -> DataFrame:
    """(doc_id, start, end) of the items of list lines: from a sign or number at the line's
    begin, and from every sign after a blank, to the next one or the line's end. Blank items are
    none; a sign that no blank follows is none."""
    pieces = F.split("line", rf"(?<!\S)(?=[{BULLETS}]\s)", -1)
    rows = line_rows.where(F.col("line").rlike(rf"^\s*(?:[-*]|\d+[.)])\s+|(?<!\S)[{BULLETS}]\s")).select("doc_id", F.col("start").alias("_at"), F.posexplode(pieces).alias("_k", "_p"))
    upto = Window.partitionBy("doc_id", "_at").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.col("_at") + F.sum(F.char_length("_p")).over(upto)).withColumn("start", F.col("end") - F.char_length("_p"))
    item = (F.col("_k") > 0) | F.col("_p").rlike(rf"^\s*(?:[-*{BULLETS}]|\d+[.)])\s+")
    return rows.where(item & F.col("_p").rlike(r"\S")).select("doc_id", "start", "end")


def is_table_row(line: Column) -> Column:
    """At most 2,000 characters, cut by two pipes and more, or else by tabs, into two filled cells and more."""
    def filled(sign: str) -> Column:
        return F.size(F.filter(F.split(line, sign, -1), lambda c: c.rlike(r"\S")))

    pipes = F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit("")))
    return (F.char_length(line) <= LONGEST_ROW) & F.when(pipes >= 2, filled(r"\|") >= 2).otherwise(line.contains("\t") & (filled("\t") >= 2))


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, end, kind): list items, table rows that are no list lines, and
    reference zones, from such a heading to the next heading or the end."""
    ln = lines(docs, text)
    items = list_items(ln)
    marked = F.col("line").rlike(rf"^\s*(?:[-*]|\d+[.)])\s+|(?<!\S)[{BULLETS}]\s")
    row = ln.where(~marked & is_table_row(F.col("line")))
    heading = F.col("line").rlike(r"^\s*(?:#+\s*\S|[A-Z][A-Za-z ]{2,60}:?\s*$)")
    reference = F.col("line").rlike(r"(?i)^\s*#*\s*(?:references|external links|sources|bibliography|further reading)\s*:?\s*$")
    w = Window.partitionBy("doc_id").orderBy("start")
    heads = ln.where(heading | reference).withColumn("ref", reference).withColumn("next", F.lead("start").over(w))
    n = docs.select("doc_id", F.char_length(text).cast("long").alias("n"))
    zone = heads.where("ref").join(n, "doc_id").select("doc_id", "start", F.coalesce("next", "n").alias("end"), F.lit("references").alias("kind"))
    return items.select("doc_id", "start", "end", F.lit("list").alias("kind")).union(row.select("doc_id", "start", "end", F.lit("table").alias("kind"))).union(zone)


def smallest_block(mentions: DataFrame, block_rows: DataFrame) -> DataFrame:
    """Every mention with the shortest block that holds its start (null if none)."""
    from .sweep import overlap_join

    at = mentions.select("doc_id", "start", (F.col("start") + 1).alias("end"), F.col("start").alias("s")).distinct()
    j = overlap_join(at, block_rows.select("doc_id", "start", "end"), ["doc_id"])
    best = F.min(F.struct((F.col("r_end") - F.col("r_start")).alias("len"), F.col("r_start").alias("b_start"), F.col("r_end").alias("b_end")))
    per = j.groupBy(F.col("doc_id"), F.col("l_s").alias("start")).agg(best.alias("b")).select("doc_id", "start", "b.b_start", "b.b_end")
    return mentions.distinct().join(per, ["doc_id", "start"], "left").select(*mentions.columns, "b_start", "b_end")


def dense_runs(mentions: DataFrame, gap: int = 120, least: int = 25, span: int = 1000) -> DataFrame:
    """(doc_id, start, end, n) of runs of mentions with small gaps between end and start."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    new = (F.col("start") - F.coalesce(F.max("end").over(upto), F.lit(-(10**9)))) > gap
    rows = mentions.withColumn("new", new.cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    return runs.where((F.col("n") >= least) & (F.col("end") - F.col("start") >= span)).select("doc_id", "start", "end", "n")


def islands(spans: DataFrame, keys: list[str], reach: int = 0) -> DataFrame:
    """Every row with the number of its island: spans of one key that overlap, or lie within
    ``reach`` of the span before."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", (before.isNull() | (F.col("start") >= before + reach)).cast("int"))
    return rows.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def greedy_non_overlap(spans: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """In the order of ``rank`` a span is kept if it overlaps none that is kept already.

    One pass over the sorted spans of a key cuts them into islands that do not touch; a span alone
    on its island stays, and only crowded ones replay the order."""
    names = spans.columns

    def kept(table: pa.Table, island: np.ndarray) -> pa.RecordBatch:
        n = np.bincount(island - island[0])[island - island[0]]
        stay = n == 1
        if not stay.all():
            many = np.flatnonzero(~stay)
            pdf = table.select(list(dict.fromkeys(["start", "end", *rank]))).take(pa.array(many)).to_pandas().assign(_k=many, _i=island[many])
            now, starts, taken = None, [], []
            for k, i, s, e in pdf.sort_values(["_i", *rank], kind="stable")[["_k", "_i", "start", "end"]].itertuples(index=False):
                if i != now:
                    now, starts, taken = i, [], []
                at = bisect_right(starts, s)  # what is kept does not overlap, so neighbours tell
                if (at == 0 or taken[at - 1] <= s or e <= starts[at - 1]) and (at == len(starts) or e <= starts[at] or s >= taken[at]):
                    starts.insert(at, s)
                    taken.insert(at, e)
                    stay[k] = True
        return table.filter(pa.array(stay)).combine_chunks()

    def run(batches):
        carry = None
        for b in batches:
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([carry, table]).combine_chunks() if carry is not None else table
            if not table.num_rows:
                continue
            group = np.cumsum(_changes(table, keys))
            s, e = (table[c].cast(pa.int64()).to_numpy() for c in ("start", "end"))
            reached = np.maximum.accumulate(group * OFFSETS + e)
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (group[1:] * OFFSETS + s[1:] >= reached[:-1])])
            island = np.cumsum(new)
            done = island < island[-1]  # the last one may go on in the next batch
            if done.any():
                yield from kept(table.filter(pa.array(done)), island[done]).to_batches()
            carry = table.filter(pa.array(~done))
        if carry is not None:
            yield from kept(carry, np.ones(carry.num_rows, np.int64)).to_batches()

    return spans.repartition(*keys).sortWithinPartitions(*keys, "start", "end").mapInArrow(run, spans.schema).select(*names)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row has other keys than the row before; nulls are alike."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        a, b = table[k].slice(0, table.num_rows - 1), table[k].slice(1)
        new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
    return new


def build_gazetteer(mentions: DataFrame, generic: list[str] = (), least: int = 3, order: str = "start") -> DataFrame:
    """(type, key, surface, norm, n): per type and case-folded surface the first surface
    seen and the most frequent id, ties by first sight."""
    m = mentions.where(F.char_length("surface") >= least).withColumn("key", F.lower("surface")).where(~F.col("key").isin(list(generic) or [""]))
    ids = m.groupBy("type", "key", "norm").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", order)).alias("first"))
    best = ids.groupBy("type", "key").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "norm")).alias("b"))
    surface = m.groupBy("type", "key").agg(F.min(F.struct("doc_id", order, "surface"))["surface"].alias("surface"), F.count("*").alias("n"))
    return surface.join(best, ["type", "key"]).select("type", "key", "surface", F.col("b.norm").alias("norm"), "n")


def match_gazetteer(docs: DataFrame, gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, end, type, surface, norm) of gazetteer keys, guarded where a key begins or
    ends with a letter or digit, longest first without overlap in a type.

    Keys may hold any signs; one automaton reads a text once for all of them."""
    from .terms import term_hits

    hits = term_hits(docs, gazetteer, text).join(gazetteer.select("type", "key", "norm"), "key")
    hits = hits.withColumn("shorter", F.col("start") - F.col("end")).select("doc_id", "start", "end", "type", "surface", "norm", "key", "shorter")
    return greedy_non_overlap(hits, ["doc_id", "type"], ["shorter", "key", "start"]).select("doc_id", "start", "end", "type", "surface", "norm")


def snippets(mentions: DataFrame, docs: DataFrame, reach: int = 180, most: int = 2, text: str = "text") -> DataFrame:
    """The first ``most`` context snippets a document: spans widened by ``reach``, those
    that touch joined."""
    n = docs.select("doc_id", F.col(text).alias("_t"), F.char_length(text).alias("_n"))
    wide = mentions.join(n, "doc_id").select("doc_id", F.greatest(F.lit(0), F.col("start") - reach).alias("start"), F.least("_n", F.col("end") + reach).alias("end"))
    joined = islands(wide, ["doc_id"], reach=1).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    first = joined.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))).where(F.col("k") <= most)
    return first.join(n, "doc_id").select("doc_id", "k", "start", "end", F.substr("_t", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("snippet"))


def focus_lines(docs: DataFrame, scores: dict[str, int], around: int = 2, budget: int = 6000, text: str = "text") -> DataFrame:
    """(doc_id, k, line): non-empty lines within ``around`` of a scoring one, within
    the character budget; a document without any keeps its first six lines."""
    ln = lines(docs, text)
    score: Column = F.lit(0)
    for pattern, points in scores.items():
        score = F.greatest(score, F.when(F.col("line").rlike(pattern), points).otherwise(0))
    w = Window.partitionBy("doc_id").orderBy("k")
    near = F.max(score).over(w.rowsBetween(-around, around))
    rows = ln.withColumn("near", near).withColumn("any", F.max("near").over(Window.partitionBy("doc_id")))
    rows = rows.where(F.when(F.col("any") > 0, (F.col("near") > 0) & (F.trim("line") != "")).otherwise(F.col("k") < 6))
    rows = rows.withColumn("upto", F.sum(F.char_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where((F.col("any") == 0) | (F.col("upto") <= budget)).select("doc_id", "k", "line")


def shingles(docs: DataFrame, size: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, n, hashes): distinct word shingles as 64-bit hashes; n is their number."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    # words are hashed once, a shingle is the hash of its words' hashes
    grams = F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(size)))))
    rows = docs.select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("w")).select("doc_id", F.array_distinct(F.coalesce(grams, F.array().cast("array<bigint>"))).alias("hashes"))
    return rows.select("doc_id", F.size("hashes").alias("n"), "hashes")
