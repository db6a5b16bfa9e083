"""Backfill of products from a document's own seeds, near records only.

Seeds are the products that a document already has, in the forms in which it may name them
again; hits count only in sentences that hold an anchor, such as a record's id."""

from __future__ import annotations

import bisect
import re
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .link import in_sentence

# Nouns cut from the end of a seed; names whose last noun stays; vendors cut from the
# front; terms that are no product; what marks a log or a file; how far it is sought.
NOUNS = ["server", "servers", "application", "applications", "devices", "instance", "instances", "data center"]
PROTECTED = [
    "windows server", "exchange server", "http server", "apache http server", "weblogic server", "sql server", "sharepoint server", "sap content server", "content server",
    "wso2 identity server", "identity server", "confluence server", "netweaver application server", "data center and server",
]
VENDORS = ["microsoft", "fortinet", "adobe", "atlassian", "apache", "cisco", "vmware", "ivanti", "citrix", "oracle", "sap"]
EXCLUDED = [
    "host", "system", "server", "application", "devices", "endpoint", "network", "agency", "database", "cpg 1.e", "ms-isac", "sdlc", "software development lifecycle",
    "remote desktop protocol", "local security authority subsystem service", "windows remote management (winrm)", "virtual private servers", "vpns",
    "national institute of standards and technology", "national institute for standards and technology",
    "rdp", "ssh", "vpn", "smb", "cve", "cwe", "cpe", "log", "app", "web", "ftp", "tls", "ssl", "api", "tcp", "udp", "ioc", "c2", "cnc", "dns", "ips", "ids", "nat", "lan", "wan",
    "url", "uri", "sql", "xml", "pdf", "doc", "exe", "dll", "zip", "tar", "apt", "csa", "tac", "soc", "mit", "poc", "dos", "ddos", "http", "https",
]
NOISE = r"(?i)\.log|\.exe|httpproxy|log file|event log|audit log"
REACH = 30
WORD = r"[\p{L}\p{N}_]+"
#: The same word, a border between two characters of one, and NOISE, inside texts.
WORDS, BORDER, LOGS = re.compile(r"(?<!\w)\w+"), re.compile(r"\w\w"), re.compile(NOISE, re.ASCII)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_noun(surface: Column) -> Column:
    """The surface without one noun of NOUNS at its end, unless it ends in a protected name."""
    protected = F.lower(_bare(surface)).rlike(rf"(?:^| )(?:{'|'.join(PROTECTED)})\z")
    return F.when(protected, surface).otherwise(F.regexp_replace(surface, rf"(?i)\s+(?:{'|'.join(NOUNS)})\z", ""))


def trim_nouns(mentions: DataFrame, product: str = "Configuration") -> DataFrame:
    """Product mentions without such a noun; the end moves with the surface."""
    new = F.when(F.col("type") == product, without_noun(F.col("surface"))).otherwise(F.col("surface"))
    cut = F.char_length("surface") - F.char_length(new)
    done = {"end": (F.col("end") - cut).cast(mentions.schema["end"].dataType), "surface": new}
    return mentions.select(*(done.get(c, F.col(c)).alias(c) for c in mentions.columns))


def _server_base(c: Column) -> Column:
    return F.when(F.lower(c).endswith(" server"), _bare(F.substr(c, F.lit(1), F.char_length(c) - F.lit(7))))


def is_seed(c: Column) -> Column:
    """Four characters and more, or three capitals; no excluded term, no product id."""
    return ~F.lower(c).isin(EXCLUDED) & ~F.lower(c).startswith("cpe:2.3") & ((F.char_length(c) >= 4) | c.rlike(r"^\p{Lu}{3}\z"))


def seeds(products: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id, seed, norm, rank) a document, a seed once whatever its case.

    products: (doc_id, start, surface, norm). A product gives its surface without a last noun, that
    without ``server``, and both without a vendor in front; pairs (doc_id, start, short, long) add
    the other form of an abbreviation, the last definition of a form standing. The spelling
    that comes first stands, with its first id that is not null; rank is the order in which seeds
    came. Null surfaces and ids of documents give none."""
    clean = _bare(without_noun(_bare(F.col("surface"))))
    rows = products.select("doc_id", F.col("start").cast("long").alias("start"), "norm", clean.alias("c")).dropna(subset=["doc_id", "c"])
    bare = F.when(F.lower(F.regexp_extract("c", r"^(\S+)\s+\S", 1)).isin(VENDORS), F.regexp_replace("c", r"^\S+\s+", ""))
    forms = rows.select("doc_id", "start", "norm", F.posexplode(F.array(F.col("c"), _server_base(F.col("c")), bare, _server_base(bare))).alias("form", "seed"))
    own = forms.where(is_seed(F.col("seed"))).withColumn("paired", F.lit(0))
    if pairs is not None:
        both = pairs.select("doc_id", "start", F.lower("short").alias("_key"), F.col("long").alias("_other")).union(pairs.select("doc_id", "start", F.lower("long"), "short"))
        other = both.groupBy("doc_id", "_key").agg(F.max_by("_other", F.struct("start", "_other")).alias("_other"))
        more = own.withColumn("_key", F.lower("seed")).join(other, ["doc_id", "_key"])
        own = own.unionByName(more.select("doc_id", "start", "norm", "form", F.col("_other").alias("seed"), F.lit(1).alias("paired")).where(is_seed(F.col("seed"))))
    came = F.struct("start", "form", "paired", F.coalesce("norm", F.lit("")).alias("tie"))
    spelled = own.groupBy("doc_id", "seed").agg(F.min(came).alias("came"), F.min_by("norm", F.when(F.col("norm").isNotNull(), came)).alias("norm"))
    one = spelled.groupBy("doc_id", F.lower("seed").alias("_low")).agg(F.min(F.struct("came", "seed", "norm")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("s.came", "s.seed"))
    return one.select("doc_id", F.col("s.seed").alias("seed"), F.col("s.norm").alias("norm"), rank.alias("rank"))


def _hits(text: str, sents: list[tuple[int, int]], seeds: list[dict], taken: list[tuple[int, int]]):
    """(start, end, seed) of the mentions to add to the sentences of a text, see ``backfill``: seeds in the
    order longest first, then rank, and taken spans in order of their starts."""
    by_word: dict[str, list[int]] = {}
    for k, x in enumerate(seeds):
        by_word.setdefault(x["w"], []).append(k)
    starts = [s for s, _ in taken]
    reach = list(accumulate((e for _, e in taken), max))  # how far spans up to each one go
    for s0, s1 in sents:
        found = []
        for m in takewhile(lambda m: m.start() < s1, WORDS.finditer(text, s0)):
            for j in by_word.get(m[0].lower(), ()):
                start, end = m.start() - seeds[j]["o"], m.start() - seeds[j]["o"] + seeds[j]["n"]
                if start < s0 or end > s1 or text[start:end].lower() != seeds[j]["low"]:
                    continue
                alone = not BORDER.match(text, end - 1) and (start == 0 or not BORDER.match(text, start - 1))
                if not alone or LOGS.search(text[max(0, start - REACH) : end + REACH]):
                    continue
                before = bisect.bisect_left(starts, end)  # spans that begin before the hit ends
                if before == 0 or reach[before - 1] <= start:
                    found.append((j, start, end))
        had, spans = set(), []
        for j, start, end in sorted(found):
            i = bisect.bisect_left(spans, (start, end))
            if j not in had and (i == 0 or spans[i - 1][1] <= start) and (i == len(spans) or spans[i][0] >= end):
                had.add(j)
                spans.insert(i, (start, end))
                yield start, end, seeds[j]


def backfill(docs: DataFrame, mentions: DataFrame, found: DataFrame, sents: DataFrame, anchors: DataFrame, product: str = "Configuration") -> DataFrame:
    """(doc_id, start, end, type, surface, norm) of the mentions to add.

    In each sentence with an anchor (doc_id, start), every seed (of ``seeds``) takes its first place,
    in any case and in whole words, that overlaps neither ``mentions`` nor a place taken by a
    seed before it (longest first), and has no log or file within REACH characters. Seeds meet
    the sentences' words by their own first word, so that no sentence is searched seed by seed; a
    seed without a letter or digit finds nothing. Null texts have no sentences. A document's seeds, spans
    and sentences' offsets meet its text in one row: words and parts of texts are not shuffled."""
    first = F.regexp_extract("seed", WORD, 0)
    keyed = found.select("doc_id", "seed", "norm", "rank", F.lower("seed").alias("low"), F.lower(first).alias("w"), (F.instr("seed", first) - 1).alias("o"), F.char_length("seed").alias("n")).where("w <> ''")
    own = keyed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), "rank", "norm", "low", "w", "o", "n"))).alias("seeds"))
    at = in_sentence(anchors.select("doc_id", "start"), sents).select("doc_id", F.col("s0").alias("s"), F.col("s1").alias("e"), F.lit(True).alias("sent")).distinct()
    spans = mentions.select("doc_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.lit(False).alias("sent")).where("e > s")
    marks = at.union(spans).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "e", "sent"))).alias("marks"), F.count_if("sent").alias("n")).where("n > 0").drop("n")
    rows = own.join(marks, "doc_id").join(docs.select("doc_id", "text").where("text <> ''"), "doc_id").select("doc_id", "text", "seeds", "marks")

    def run(batches):
        for b in batches:
            got: list[tuple] = []
            for k in range(b.num_rows):
                text, marks = b["text"][k].as_py(), b["marks"][k].as_py()
                here, taken = ([(m["s"], m["e"]) for m in marks if m["sent"] == x] for x in (True, False))
                got += [(k, s, e, text[s:e], seed["norm"]) for s, e, seed in _hits(text, here, b["seeds"][k].as_py(), taken)]
            if got:
                row, start, end, surface, norm = zip(*got)
                cols = [b["doc_id"].take(pa.array(row)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(surface, pa.string()), pa.array(norm, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "end", "surface", "norm"])

    one = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, end long, surface string, norm string")
    return one.select("doc_id", "start", "end", F.lit(product).alias("type"), "surface", "norm")
