"""Cleaning of mention and relation tables, and of raw model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_cwe, piece_span_is_exact, pieces
from .dedup import stored
from .link import last_before
from .sweep import overlap_join
from .textscan import scan_in_sentences, sentences

# Nouns that describe a product and are no part of its name. server(s), application(s), devices,
# instance(s), data center; the others are our own.
DESCRIPTORS = [
    "server", "servers", "application", "applications", "devices", "instance", "instances", "data center",
    "appliance", "appliances", "device", "software", "product", "products", "platform", "component", "service", "services", "system", "systems", "library",
]


def keep_ontology(mentions: DataFrame, relations: DataFrame, types: DataFrame, relation_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of listed types; relations of listed types whose both ends stay."""
    m = mentions.join(F.broadcast(types.select("type")), "type", "left_semi").select(*mentions.columns)
    ids = m.select("doc_id", "id").distinct()
    r = relations.join(F.broadcast(relation_types.select("type")), "type", "left_semi")
    for end in ("head", "tail"):
        r = r.join(ids.withColumnRenamed("id", end), ["doc_id", end], "left_semi")
    return m, r.select(*relations.columns)


def trim_descriptors(mentions: DataFrame, protected: DataFrame, product: str = "Configuration", nouns: list[str] = tuple(DESCRIPTORS)) -> DataFrame:
    """Trailing descriptor nouns cut from product surfaces that are not protected names
    (protected: name); the end offset moves with the surface."""
    cut = F.regexp_replace("surface", rf"(?i)(?:\s+(?:{'|'.join(nouns)}))+\s*$", "")
    j = mentions.join(F.broadcast(protected.select(F.lower("name").alias("_p")).distinct()), F.lower("surface") == F.col("_p"), "left")
    new = F.when((F.col("type") == product) & F.col("_p").isNull() & (cut != ""), cut).otherwise(F.col("surface"))
    j = j.withColumn("_new", new).withColumn("end", F.col("end") - (F.char_length("surface") - F.char_length("_new")))
    return j.withColumn("surface", F.col("_new")).select(*mentions.columns)


def repair_products(mentions: DataFrame, vendors: list[str], product: str = "Configuration") -> DataFrame:
    """Product mentions after repair, with the action taken; a mention ``A and B`` becomes
    two, an acronym or colon prefix is cut, and bare vendors and descriptors are dropped
    (action drop_*, rows stay). Other mentions pass with action keep."""
    whole = F.lower(F.regexp_replace("surface", r"^\s+|\s+$", ""))
    mine = F.col("type") == product
    drop = F.when(mine & whole.isin([v.lower() for v in vendors] or [None]), "drop_vendor").when(mine & whole.isin(DESCRIPTORS), "drop_descriptor")
    names = [c for c in mentions.columns if c not in ("id", "surface", "start", "end")]
    fix = mine & F.col("_drop").isNull()
    rows = mentions.withColumn("_drop", drop)
    rows = rows.withColumn("_pre", F.when(fix, F.regexp_extract("surface", r"^((?:[A-Z]{2,6}\s+)?[^:]{0,40}:\s+)\S", 1)).otherwise(""))
    rows = rows.withColumn("_s", F.expr("substr(surface, length(_pre) + 1)"))
    rows = rows.withColumn("_acr", F.when(fix, F.regexp_extract("_s", r"\s+\([A-Z0-9]{2,8}\)\z", 0)).otherwise(""))
    rows = rows.withColumn("_s", F.expr("substr(_s, 1, length(_s) - length(_acr))"))
    both = r"^(\S+(?: \S+){0,3}) and (\S+(?: \S+){0,3})\z"
    left, right = F.regexp_extract("_s", both, 1), F.regexp_extract("_s", both, 2)
    two = fix & (left != "")
    one = F.struct(F.lit(0).alias("o"), F.col("_s").alias("t"))
    parts = F.when(two, F.array(F.struct(F.lit(0).alias("o"), left.alias("t")), F.struct((F.char_length("_s") - F.char_length(right)).alias("o"), right.alias("t")))).otherwise(F.array(one))
    action = F.coalesce("_drop", F.when(two, "split").when(F.col("_acr") != "", "cut_acronym").when(F.col("_pre") != "", "cut_prefix").otherwise("keep"))
    out = rows.select(*names, "id", "start", "end", "_drop", "_pre", "_s", action.alias("action"), mine.alias("_mine"), F.posexplode(parts).alias("_k", "_z"))
    start = F.col("start") + F.char_length("_pre") + F.col("_z.o")
    done = {
        "id": F.concat("id", F.when(F.col("_k") > 0, "b").otherwise("")), "surface": F.col("_z.t"), "start": F.when(F.col("_mine") & F.col("_drop").isNull(), start).otherwise(F.col("start")),
        "end": F.when(F.col("_mine") & F.col("_drop").isNull(), start + F.char_length("_z.t")).otherwise(F.col("end")),
    }
    kinds = {f.name: f.dataType for f in mentions.schema}
    return out.select(*(done.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in mentions.columns), "action")


def ground(raw: DataFrame, docs: DataFrame, unique_only: list[str] = ("Configuration",)) -> DataFrame:
    """P10: mentions at verified offsets; where those are wrong, at every occurrence of the
    surface (as written, else in any case); a type of ``unique_only`` only if there is one."""
    ok = piece_span_is_exact(F.col("_parts"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("surface"))
    told = stored(raw.join(docs.select("doc_id", pieces(F.col("text")).alias("_parts")), "doc_id").select(*raw.columns, ok.alias("_ok")))
    good = told.where("_ok").select(*raw.columns)
    # only what has to be sought meets whole texts
    rest = told.where("not _ok and surface <> ''").drop("_ok").join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    quoted = F.concat(F.lit("\\Q"), F.replace("surface", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    rest = rest.withColumn("_p", F.when(F.col("_t").contains(F.col("surface")), quoted).otherwise(F.concat(F.lit("(?i)"), quoted)))
    parts = F.split("_t", F.col("_p"), -1)
    # the pieces between occurrences give their offsets; occurrences have the surface's length
    rows = rest.withColumn("_n", F.size(parts) - 1).where("_n > 0").where(~F.col("type").isin(list(unique_only)) | (F.col("_n") == 1))
    length = F.char_length("surface")
    rows = rows.select(*[c for c in raw.columns if c not in ("start", "end")], F.posexplode(F.slice(parts, F.lit(1), F.col("_n"))).alias("_k", "_piece"))
    keys = [c for c in raw.columns if c not in ("start", "end")]
    w = Window.partitionBy("doc_id", "id").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.char_length("_piece")).over(w) + F.col("_k") * length
    found = rows.withColumn("start", start).withColumn("end", F.col("start") + length)
    kinds = {f.name: f.dataType for f in raw.schema}
    return good.unionByName(found.select(*keys, *(F.col(c).cast(kinds[c]).alias(c) for c in ("start", "end"))))


def parse_outputs(outputs: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Model output as a struct with its status: direct, fenced, braced or unparseable."""
    fenced = F.nullif(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.lit(""))

    def parsed(c):
        # a record that parses to nothing but nulls did not parse
        p = F.from_json(c, schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
        return F.when(c.isNotNull() & p["_corrupt_record"].isNull() & F.trim(c).startswith("{"), p.dropFields("_corrupt_record"))

    a, b, c = parsed(F.col(raw)), parsed(fenced), parsed(braced)
    status = F.when(a.isNotNull(), "direct").when(b.isNotNull(), "fenced").when(c.isNotNull(), "braced").otherwise("unparseable")
    return outputs.withColumn("parsed", F.coalesce(a, b, c)).withColumn("status", status)


def clean_records(raw: DataFrame, docs: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean mentions, and per document the counts of what was wrong: bad type, bad
    offsets, text mismatch, duplicates, overlapping pairs of a type among the clean."""
    from .match import SPAN

    j = raw.join(F.broadcast(types.select("type").withColumn("_k", F.lit(True))), "type", "left").join(docs.select("doc_id", F.char_length("text").alias("_n"), pieces(F.col("text")).alias("_t")), "doc_id")
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("_n"))
    exact = piece_span_is_exact(F.col("_t"), F.col("start").cast("int"), F.col("end").cast("int"), F.col("surface"))
    # spans are checked where they meet the text, so that no text goes on to further exchanges
    why = F.when(F.col("_k").isNull(), "bad_type").when(~F.coalesce(inside, F.lit(False)), "bad_offsets").when(~exact, "text_mismatch")
    j = j.select(*raw.columns, why.alias("_why"))
    first = F.row_number().over(Window.partitionBy(*SPAN).orderBy("id"))
    j = stored(j.withColumn("why", F.when(F.col("_why").isNotNull(), F.col("_why")).when(first > 1, "duplicate")).drop("_why"))
    clean = j.where("why is null").select(*raw.columns)
    spans = clean.select("doc_id", "type", "start", "end")
    pairs = overlap_join(spans, spans, ["doc_id", "type"]).where("l_start < r_start or (l_start = r_start and l_end < r_end)").groupBy("doc_id").agg(F.count("*").alias("overlapping_pairs"))
    counts = j.groupBy("doc_id").agg(*(F.count_if(F.col("why") == x).alias(x) for x in ("bad_type", "bad_offsets", "text_mismatch", "duplicate")), F.count_if(F.col("why").isNull()).alias("clean"))
    return clean, counts.join(pairs, "doc_id", "left").na.fill(0, ["overlapping_pairs"])


def core_phrases(mentions: DataFrame, phrases: DataFrame, generic: list[str] = ()) -> DataFrame:
    """Surfaces reduced to the earliest, then longest phrase of their type's list (phrases:
    type, phrase) that they hold; articles go, generic terms are dropped."""
    s = F.regexp_replace("surface", r"(?i)^(?:the|a|an)\s+", "")
    rows = mentions.withColumn("_s", s).where(~F.lower("_s").isin(list(generic) or [""]))
    j = rows.join(F.broadcast(phrases.select("type", F.lower("phrase").alias("_p"))), "type", "left").withColumn("_at", F.expr("locate(_p, lower(_s))"))
    best = F.min(F.when(F.col("_at") > 0, F.struct("_at", (-F.char_length("_p")).alias("n"), "_p"))).alias("b")
    per = j.groupBy(*mentions.columns, "_s").agg(best)
    core = F.when(F.col("b").isNotNull(), F.substr("_s", F.col("b._at").cast("int"), F.char_length("b._p"))).otherwise(F.col("_s"))
    return per.withColumn("core", core).select(*mentions.columns, "core")


def contract_issues(relations: DataFrame, mentions: DataFrame, signatures: DataFrame) -> DataFrame:
    """(doc_id, id, issue) per raw relation: illegal type, unknown ends, wrong argument
    types, evidence that does not cover an end."""
    m = mentions.select("doc_id", "id", "type", "start", "end").dropDuplicates(["doc_id", "id"])
    r = relations
    for end in ("head", "tail"):
        r = r.join(m.select("doc_id", F.col("id").alias(end), F.col("type").alias(f"{end}_t"), F.col("start").alias(f"{end}_s"), F.col("end").alias(f"{end}_e")), ["doc_id", end], "left")
    r = r.join(F.broadcast(signatures.select("type", F.col("head_type").alias("want_head"), F.col("tail_type").alias("want_tail"))), "type", "left")
    legal = F.col("want_head").isNotNull()

    def misses(end: str):
        return (F.col(f"{end}_s") < F.col("ev_start")) | (F.col(f"{end}_e") > F.col("ev_end"))

    issues = F.array(
        F.when(~legal, "illegal_type"), F.when(F.col("head_t").isNull(), "unknown_head"), F.when(F.col("tail_t").isNull(), "unknown_tail"),
        F.when(legal & ((F.col("head_t") != F.col("want_head")) | (F.col("tail_t") != F.col("want_tail"))), "wrong_arguments"),
        F.when(misses("head"), "evidence_misses_head"), F.when(misses("tail"), "evidence_misses_tail"))
    return r.select("doc_id", "id", F.explode(F.array_compact(issues)).alias("issue"))


def local_ids(mentions: DataFrame, docs: DataFrame, kind: str = "Weakness", pattern: str = r"(?i)CWE-\s*\d+", canonical=canonical_cwe, own: bool = True) -> DataFrame:
    """Mentions of ``kind`` keep their id only if the text around them states it, from the last
    sentence mark before the mention to the first one after it; else the id is cleared.

    own: an id in the surface itself stands first. Ids are scanned once and meet mentions by
    document and id; where they lie is told by the numbers of sentences."""
    sents = stored(sentences(docs, "mark").select("doc_id", "start", "k"))
    said = scan_in_sentences(docs, pattern, "mark").select("doc_id", canonical(F.col("surface")).alias("said"), "k")
    rest, mine = mentions.where(F.col("type") != kind), mentions.where(F.col("type") == kind)
    # sentences meet spans and ids alone
    keys = ["doc_id", "id", "start", "end"]
    at = last_before(mine.select(*keys, canonical(F.col("norm")).alias("_id")).where("_id is not null").distinct(), sents.withColumnRenamed("k", "_k0"), "_k0")
    at = last_before(at.withColumn("_s", F.col("start")).withColumn("start", F.col("end")), sents.withColumnRenamed("k", "_k1"), "_k1").withColumn("start", F.col("_s"))
    near = at.join(said, (at["doc_id"] == said["doc_id"]) & (F.col("_id") == F.col("said")) & F.col("k").between(F.col("_k0"), F.col("_k1")), "left_semi").select(*keys, "_id").distinct().withColumn("_near", F.lit(True))
    out = mine.withColumn("_id", canonical(F.col("norm"))).join(near, [*keys, "_id"], "left").withColumn("_own", canonical(F.regexp_extract("surface", pattern, 0)) if own else F.lit(None).cast("string"))
    out = out.withColumn("norm", F.coalesce("_own", F.when(F.col("_near"), F.col("_id"))))
    return rest.unionByName(out.select(*mentions.columns))
