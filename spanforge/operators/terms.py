"""Terms in texts: a multi-term automaton (X3) and abbreviation definitions."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import stored

#: Characters of keys in one automaton; more are matched in several passes.
AUTOMATON_CHARS = 8_000_000
#: Words of the longest key that is joined, bits that tell which runs of words may be keys (8 MB), texts of an output batch.
MOST_WORDS, BITS, TEXTS = 8, 1 << 26, 256
_RUN = re.compile(r"\w+")


# ---- gazetteer terms --------------------------------------------------------------------------
def folded(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, and the offset of each of its characters in the text where they
    are not the same."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), [k for k, p in enumerate(parts) for _ in p]


def hits_in(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, key) of every key in the text that no word goes on from: a key that begins
    (ends) with a letter or digit has no letter, digit or underscore before (after) it."""
    low, at = folded(text)
    word = lambda k: 0 <= k < len(low) and (low[k].isalnum() or low[k] == "_")
    out = []
    for last, key in automaton.iter(low):
        first = last - len(key) + 1
        if (key[0].isalnum() and word(first - 1)) or (key[-1].isalnum() and word(last + 1)):
            continue
        if at is not None and (first and at[first - 1] == at[first] or last + 1 < len(at) and at[last + 1] == at[last]):
            continue  # begins or ends inside a character
        out.append((first, last + 1, key) if at is None else (at[first], at[last] + 1, key))
    return out


def word_runs(key: str) -> int:
    """How many words a guarded key holds, 0 for a key that begins or ends with another sign."""
    low = key.lower()
    return len(_RUN.findall(key)) if low == key and key[0].isalnum() and key[-1].isalnum() else 0


def term_hits(docs: DataFrame, keys: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, end, surface, key): every guarded occurrence of the lower-case keys, whatever
    signs they hold.

    A key that begins and ends with a letter or digit can only occur from the begin of a word to the
    end of one, so it is joined with the runs of as many words in the texts; a bit map of the keys
    keeps back runs that are none. An Aho-Corasick automaton reads a text once for all other keys of a
    pass, and for keys of more than MOST_WORDS words; passes are as many as the characters of these ask for."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()

    def shape(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_runs(k) for k in b.column(0).to_pylist()], pa.int32())], names=["key", "words"])

    keys = stored(keys.where("key <> ''").select("key").distinct().mapInArrow(shape, "key string, words int"))
    plain = F.col("words").between(1, MOST_WORDS)
    sizes = [r["words"] for r in keys.where(plain).select("words").distinct().collect()]
    rows = docs.select("doc_id", F.col(text).alias("t"))
    schema = f"doc_id {kind}, start long, end long, surface string, key string"
    runs = rows.mapInArrow(_known_runs(sorted(sizes), spark.sparkContext.broadcast(_bits(keys.where(plain))), BITS), schema)
    found = runs.join(keys.where(plain).select("key"), "key").select("doc_id", "start", "end", "surface", "key")
    odd = keys.where(~plain)
    passes = -(-(odd.agg(F.sum(F.char_length("key"))).first()[0] or 0) // AUTOMATON_CHARS)
    for k in range(passes):
        part = odd.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).select("key")
        found = found.union(rows.mapInArrow(_automaton_hits(spark.sparkContext.broadcast(part.toArrow()["key"].to_pylist())), schema))
    return found


def _batch(given: pa.RecordBatch, rows: list) -> pa.RecordBatch:
    types = (given.schema.types[0], pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows) if rows else [[]] * 5, types)], names=["doc_id", "start", "end", "surface", "key"])


def _bits(keys: DataFrame) -> np.ndarray:
    """A bit for each key, at its checksum modulo BITS."""
    at = keys.select((F.crc32(F.encode("key", "utf-8")) % BITS).alias("at")).select(F.expr("at div 63").alias("k"), F.expr("shiftleft(1L, cast(at % 63 as int))").alias("b"))
    got = at.groupBy("k").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(BITS // 63 + 1, np.int64)
    bits[got["k"].to_numpy()] = got["b"].to_numpy()
    return bits


def _known_runs(sizes: list[int], shared, n_bits: int):
    def run(batches):
        bits = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part, rows = b.slice(lo, TEXTS), []
                for d, t in zip(*(c.to_pylist() for c in part.columns)):
                    rows += [(d, s, e, t[s:e], key) for s, e, key in runs_in(t, sizes, bits, n_bits)] if t and sizes else []
                yield _batch(b, rows)

    return run


def runs_in(text: str, sizes: list[int], bits: np.ndarray, n_bits: int) -> list[tuple[int, int, str]]:
    """(start, end, lower-case run) of the runs of so many words whose bits are set."""
    low, at = folded(text)
    words = [m.span() for m in _RUN.finditer(low)]
    out = []
    for n in sizes:
        some = [low[a[0] : z[1]] for a, z in zip(words, words[n - 1 :])]
        code = np.fromiter((crc32(x.encode("utf-8", "surrogatepass")) for x in some), np.int64, len(some)) % n_bits
        for k in np.flatnonzero(bits[code // 63] >> (code % 63) & 1):
            first, last = words[k][0], words[k + n - 1][1] - 1
            if at is None:
                out.append((first, last + 1, some[k]))
            elif not (first and at[first - 1] == at[first] or last + 1 < len(at) and at[last + 1] == at[last]):
                out.append((at[first], at[last] + 1, some[k]))  # none that begins or ends inside a character
    return out


def _automaton_hits(shared):
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for key in shared.value:
            automaton.add_word(key, key)
        automaton.make_automaton()
        for b in batches:
            yield _batch(b, [(d, s, e, t[s:e], key) for d, t in zip(*(c.to_pylist() for c in b.columns)) if t and len(automaton) for s, e, key in hits_in(t, automaton)])

    return run


# ---- abbreviations ------------------------------------------------------------------------------
# Shape of a short form, longest bracket and reach before it, what is trimmed, and
# how many words before a bracket may belong to a short form of n characters.
SHORT = r"[A-Za-z][A-Za-z0-9._/-]{1,14}"
LONGEST, TRIMMED = 160, " \t,;:-"


def most_words(n: int) -> int:
    return min(n + 5, max(2 * n, 4), 12)


_BRACKET = re.compile(rf"\(([^()\n]{{2,{LONGEST}}})\)")
_BEFORE = re.compile(rf"\b({SHORT})\s*$")
_SHORT = re.compile(SHORT)


def is_short(form: str) -> bool:
    """Two capitals and more, or one and a digit, among two and more letters and digits."""
    capitals = sum(c.isupper() for c in form if c.isalpha())
    return bool(_SHORT.fullmatch(form)) and sum(c.isalnum() for c in form) >= 2 and (capitals >= 2 or capitals == 1 and any(c.isdigit() for c in form))


def aligned(short: str, long: str) -> str | None:
    """The shortest end of ``long`` in which the short form's letters and digits come in order,
    the first of them at the start of a word; null if it is one word or not longer than the form.

    Each letter, from the last, takes its latest place before the one after it: later places
    never leave less room for the letters before."""
    low = [c.casefold() for c in long]
    places: dict[str, list[int]] = {}
    for k, c in enumerate(low):
        places.setdefault(c, []).append(k)
    letters, at = [c.casefold() for c in short if c.isalnum()], len(long)
    for n, c in enumerate(reversed(letters), 1):
        fits = (k for k in reversed(places.get(c, ())) if k < at and (n < len(letters) or k == 0 or not long[k - 1].isalnum()))
        at = next(fits, -1)
        if at < 0:
            return None
    out = long[at:].strip(TRIMMED)
    return out if len(out.split()) >= 2 and len(out) > len(short) else None


def definitions(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, short, long, order) of the abbreviations that a text defines, a pair once."""
    found, seen = [], set()
    for order in ("long first", "short first"):
        for m in _BRACKET.finditer(text):
            before = re.split(r"[()\n]", text[max(0, m.start() - LONGEST - 40) : m.start()])[-1]
            if order == "long first":
                short, run = m[1], before.rstrip()[-LONGEST - 1 :]
                if not is_short(short):
                    continue
                clause = re.split(r"[.!?;:]", run)[-1].strip(TRIMMED)
                long = aligned(short, " ".join(clause.split()[-most_words(len(short)) :]))
                if long is None:
                    continue
                start = text.rfind(long.split()[0], 0, m.start())
            else:
                b = _BEFORE.search(before)
                long = m[1].strip(TRIMMED)
                if not b or len(m[1]) < 3 or not is_short(b[1]) or (aligned(b[1], long) or "").casefold() != long.casefold():
                    continue
                short, start = b[1], m.start() - len(before) + b.start(1)
            key = short.casefold(), long.casefold()
            if key not in seen:
                seen.add(key)
                found.append((start, m.end(), short, long, order))
    return sorted(found)


def abbreviation_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, start, end, short, long, order) of every definition, ``Long Form (SF)`` as well as
    ``SF (Long Form)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(d, *x) for d, t in zip(*(c.to_pylist() for c in b.columns)) for x in definitions(t)]
            types = (b.schema.types[0], pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows) if rows else [[]] * 6, types)], names=["doc_id", "start", "end", "short", "long", "order"])

    bracketed = docs.select("doc_id", F.col(text).alias("t")).where(F.col("t").contains("("))
    return bracketed.mapInArrow(run, f"doc_id {kind}, start long, end long, short string, long string, order string")


def abbreviations(docs: DataFrame, text: str = "text") -> DataFrame:
    """Corpus dictionary (short, long, n_docs, n_long, best): documents that define a pair, long
    forms that compete for a short form, and whether most documents mean this one."""
    pairs = abbreviation_pairs(docs, text)
    out = pairs.groupBy("short", F.lower("long").alias("long")).agg(F.countDistinct("doc_id").alias("n_docs"))
    w = Window.partitionBy("short")
    return out.withColumn("n_long", F.count("*").over(w)).withColumn("best", F.row_number().over(w.orderBy(F.desc("n_docs"), "long")) == 1)
