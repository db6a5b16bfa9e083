"""Outputs of older extractors brought in order: surfaces, places, signatures."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import stored
from .textscan import OUT

# Closed vocabularies of two types, phrases of security methods, generic product
# terms, and the words that go at the ends of surfaces.
TACTICS = [
    "initial access", "execution", "persistence", "privilege escalation", "defense evasion", "credential access", "lateral movement",
    "collection", "exfiltration", "impact", "reconnaissance", "discovery", "resource development", "command and control",
]
PHASES = ["reconnaissance", "weaponization", "delivery", "exploitation", "installation", "command and control", "actions on objectives"]
METHODS = [
    "server-side request forgery", "remote code execution", "arbitrary code execution", "insecure deserialization", "cross-site scripting",
    "arbitrary file disclosure", "arbitrary file write", "arbitrary file read", "information disclosure", "information exposure",
    "authentication bypass", "privilege escalation", "directory traversal", "path traversal", "command injection", "code injection",
    "sql injection", "ognl injection", "deserialization", "buffer overflow", "format string", "use-after-free", "memory corruption",
    "race condition", "ssrf", "xss", "rce",
]
METHOD_PATTERN = r"(?i)\b(?:[A-Za-z][\w/+.-]*\s+){0,4}(?:injection|traversal|deserialization|disclosure|exposure|execution|overflow|bypass|forgery|escalation|corruption|spoofing|validation|race condition|use-after-free)\b"
GENERIC = ["software", "system", "server", "package", "application", "product", "component", "service"]
_EDGES = r"""[ \t\r\n\-:;,.'"()\[\]]+"""
_LEAD, _NOUN, _VERSION = r"(?i)^(?:the|affected|vulnerable)\s+", r"(?i)\s+\b(?:package|packages|application|applications|software|products?|components?)\b$", r"\s+\d+(?:\.\d+){1,3}$"
_FLAW, _FLAW_NOUN = r"(?i)\b(?:vulnerability|flaw|issue)\b", r"(?i)\s+\b(?:vulnerability|flaw|weakness)\b$"
SIGNATURES = [
    ("affects", "Vulnerability", "Configuration"), ("instantiates", "Vulnerability", "Weakness"), ("leverages", "AttackPattern", "Weakness"),
    ("realizes", "AttackPattern", "AttackTechnique"), ("implies", "AttackTechnique", "AttackTactic"), ("belongs_to_phase", "AttackTactic", "KillChainPhase"),
]


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_EDGES}", ""), f"{_EDGES}$", "")


def _some(text: Column) -> Column:
    return F.when(text != "", text)


def listed_phrase(text: Column, phrases: list[str]) -> Column:
    """The listed phrase that begins first in a text, of these the longest, as written; else null."""
    listed = sorted({p.lower() for p in phrases}, key=lambda p: -len(p))  # of those that begin at one place the first stands
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in listed) or r"\b\B"

    def found(low: Column) -> Column:
        at = F.regexp_instr(low, F.lit(pattern))
        return F.when(at > 0, F.substr(text, at, F.char_length(F.regexp_extract(low, pattern, 0))))

    # the lambda names the text in small letters, so that it is made once
    return F.element_at(F.transform(F.array(F.lower(text)), found), 1)


def with_core(rows: DataFrame, phrases: list[str] = tuple(METHODS), generic: list[str] = tuple(GENERIC)) -> DataFrame:
    """Rows (type, surface, ..) with ``surface`` reduced to what names the thing, by its type; rows
    that nothing is left of go.

    Vulnerabilities: the id in it, or the whole, unless it is a description of over 30 characters.
    Products: without article, category noun and version; generic terms go. Weaknesses and
    patterns: a listed phrase, else one that ends in a method's noun, else the surface without its
    noun, or a pattern's id or 40 characters at most. Tactics and phases: terms of their lists, in
    small letters. Other types stay. Null surfaces go."""
    text, kind, low = F.col("_text"), F.col("type"), F.lower("_text")
    rows = rows.withColumn("_text", _bare(F.regexp_replace("surface", r"\s+", " ")))
    product = _bare(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _LEAD, ""), _NOUN, ""), _VERSION, ""))
    cve = _some(F.regexp_extract(text, r"(?i)CVE-\d{4}-\d{4,7}", 0))
    method = F.when(kind.isin("Weakness", "AttackPattern"), F.coalesce(listed_phrase(text, list(phrases)), _some(F.regexp_extract(text, METHOD_PATTERN, 0))))
    rows = rows.withColumn("_method", method).withColumn("_product", F.when(kind == "Configuration", product))
    vulnerability = F.coalesce(cve, F.when(~(text.rlike(_FLAW) & (F.char_length(text) > 30)), F.regexp_replace(text, r"(?i)\s+\((?:cve-[^)]+)\)$", "")))
    weakness = F.coalesce("_method", F.trim(F.regexp_replace(text, _FLAW_NOUN, "")))
    pattern = F.coalesce("_method", _some(F.regexp_extract(text, r"(?i)CAPEC-\d+", 0)), F.when(F.char_length(text) <= 40, text))
    out = (
        F.when(kind == "Vulnerability", vulnerability).when(kind == "Configuration", F.when(~F.lower("_product").isin(list(generic) or [""]), F.col("_product")))
        .when(kind == "Weakness", weakness).when(kind == "AttackPattern", pattern).when(kind == "AttackTactic", F.when(low.isin(TACTICS), low)).when(kind == "KillChainPhase", F.when(low.isin(PHASES), low)).otherwise(text)
    )
    # a filter on the reduced surface would reduce it a second time; what explode_outer gives is not sought again below
    return rows.withColumn("surface", F.explode_outer(F.array(out))).drop("_text", "_method", "_product").where("surface <> ''")


def _placed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, .., surface) with the surface as the text has it first: as written, else in
    any case; start and end follow, and ``_again`` is the first place of what was found. Rows whose surface
    the text lacks go. A document's rows meet its text in one row, where a surface is sought once."""
    rest = [c for c in rows.columns if c not in ("doc_id", "start", "end")]
    met = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("_z")).join(docs.select("doc_id", F.col("text").alias("_t")).where("_t is not null"), "doc_id")

    def place(text: str, low: str, s: str) -> tuple[int, str, int]:
        at = text.find(s)
        if at < 0:
            at = low.find(s.lower())
        found = text[at : at + len(s)]
        return at, found, text.find(found)

    def run(batches):
        for b in batches:
            z = b["_z"].flatten()
            sought, first = z.field("surface").to_pylist(), 0
            kept: list[tuple[int, int, int, str, int]] = []
            for k, n in enumerate(pc.list_value_length(b["_z"]).to_pylist()):
                text = b["_t"][k].as_py()
                low = text.lower()
                places = {s: place(text, low, s) for s in set(sought[first : first + n])}
                kept += [(k, i, *places[sought[i]]) for i in range(first, first + n) if places[sought[i]][0] >= 0]
                first += n
            for lo in range(0, len(kept), OUT):
                row, i, at, found, again = zip(*kept[lo : lo + OUT])
                some = z.take(pa.array(i))
                cols = [b["doc_id"].take(pa.array(row)), *(pa.array(found, pa.string()) if c == "surface" else some.field(c) for c in rest)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at, pa.int32()), pa.array(again, pa.int32())], names=["doc_id", *rest, "_at", "_again"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = met.select("doc_id", "_t", "_z").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *rest)) + ", _at int, _again int")
    return out.withColumnRenamed("_at", "start").withColumn("end", F.col("start") + F.char_length("surface"))


def legacy_clean(mentions: DataFrame, relations: DataFrame, docs: DataFrame, signatures: DataFrame, types: DataFrame | None = None, phrases: list[str] = tuple(METHODS), generic: list[str] = tuple(GENERIC)) -> tuple[DataFrame, DataFrame]:
    """Mentions whose surfaces are reduced to their core, at the first place where the text
    has it, and relations between them that fit a signature.

    Reduction and search run twice, as what the first leaves may hold more to reduce. Of mentions
    that end on one span and type the first (by old start, then id) stays; relations with an end
    that went, to themselves, or against their signature go, and of equal ones (type, head, tail)
    the smallest id stays. Null or empty surfaces, null texts and unknown types give nothing."""
    m = mentions if types is None else mentions.join(F.broadcast(types.select("type").distinct()), "type", "left_semi")
    m = _placed(with_core(m.withColumn("_old", F.col("start")), phrases, generic), docs).withColumn("_found", F.col("surface"))
    m = stored(with_core(m, phrases, generic))  # reduced once, read for what stands and for what is sought again
    stands = m.where("surface = _found").withColumn("start", F.col("_again")).withColumn("end", F.col("start") + F.char_length("surface"))
    again = stored(_placed(m.where("surface <> _found").drop("_again", "_found"), docs))
    again = again.drop("_again")
    m = stands.select(again.columns).union(again)
    first = F.row_number().over(Window.partitionBy("doc_id", "start", "end", "type").orderBy("_old", "id"))
    kinds = {f.name: f.dataType for f in mentions.schema}
    m = stored(m.withColumn("_r", first).where("_r = 1").select(*(F.col(c).cast(kinds[c]).alias(c) for c in mentions.columns)))
    ids = m.select("doc_id", "id", "type").dropDuplicates(["doc_id", "id"])
    r = relations.where("head <> tail")
    for end in ("head", "tail"):
        r = r.join(ids.select("doc_id", F.col("id").alias(end), F.col("type").alias(f"{end}_type")), ["doc_id", end])
    r = r.join(F.broadcast(signatures.select("type", "head_type", "tail_type").distinct()), ["type", "head_type", "tail_type"], "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", "type", "head", "tail").orderBy("id"))
    return m, r.withColumn("_r", again).where("_r = 1").select(*relations.columns)
