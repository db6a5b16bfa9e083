"""Best-fit packing (5): best-fit decreasing over remaining capacities.

Documents become token pieces of at most ``capacity``; pieces of one length are
interchangeable, so the packing is decided on the histogram of lengths, which has at most
``capacity`` entries at any corpus size. For every length, from the longest, a segment tree
over remaining capacities finds the tightest open bins in logarithmic time; all bins of that
capacity are served at once, each with as many pieces as fit, which is what best-fit
decreasing would do piece by piece. The plan (runs of ranks and bins) is a small table whose
size depends on the lengths only. Pieces get their rank inside their length by two-level
counting and look up their bin.

Edge cases: null or empty text is the end token alone; rows that repeat an id are packed as
rows of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
LEAST_BLOCK = 512
#: Bound on what a worker remembers of words it has tokenised: four tables of this many words and parts
#: of words, all shorter than LONG_WORD characters.
KEPT_WORDS, LONG_WORD = 100_000, 64


class CapacityTree:
    """Segment tree over capacities 0..n: how many open bins have each; tightest() finds the
    smallest capacity of at least ``need`` with an open bin."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = self.leaves + capacity
        while at:
            self.sums[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = self.leaves + need
        if self.sums[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs (length, rank, bin, each, offset): from ``rank`` on, pieces of this length go
    ``each`` to a bin, beginning with ``bin``, the first of them at ``offset``."""
    tree, open_bins, runs, n_bins = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, bins: int) -> None:
        if left and bins:
            open_bins.setdefault(left, []).append((first, bins))
            tree.add(left, bins)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:  # new bins for all that is left
                left, each = capacity, capacity // length
                first, bins = n_bins, -(-todo // each)
                n_bins += bins
            else:
                each = left // length
                first, bins = open_bins[left].pop()
                tree.add(left, -bins)
                if bins * each > todo:
                    used = -(-todo // each)
                    put(left, first + used, bins - used)
                    bins = used
            runs.append((length, rank, first, each, capacity - left))
            took = min(todo, bins * each)
            put(left - each * length, first, took // each)
            if took % each:
                put(left - took % each * length, first + took // each, 1)
            rank += took
            todo -= took
    return pd.DataFrame(runs, columns=["length", "rank", "bin", "each", "offset"], dtype="int64")


# ---- tokens -------------------------------------------------------------------------------
def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 characters
    for themselves, the other bytes numbered from U+0100."""
    shown = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xFF and c != 0xAD]
    hidden = [c for c in range(256) if c not in shown]
    return {c: chr(c) for c in shown} | {c: chr(256 + k) for k, c in enumerate(hidden)}


class WordTokens(dict):
    """Token ids of a word as packed 32-bit numbers; unknown words go through the tokenizer.

    The tokenizer's pieces never span white space, so a text's ids are its words' ids in
    order. A word of letters with trailing marks is looked up in two parts, which cut where
    the tokenizer's own pattern cuts; its letters, in lower case and composed already, go to
    the merge model directly."""

    MARKS = ".,;:!?#*$%&|<>()[]\"-_/"
    SCRIPTS_END = "\u0530"  # Latin, Greek and Cyrillic: lower case of a letter is one letter, or is checked

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge, self.letters = tokenizer, tokenizer.model.tokenize, _byte_letters()
        # two generations each: what is still in use when one is full moves on to the next
        self.older, self.parts, self.older_parts = {}, {}, {}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.merge(letters.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def part(self, text: str, make) -> bytes:
        found = self.parts.get(text)
        if found is None:
            found = self.older_parts.get(text) or make(text)
            if len(self.parts) > KEPT_WORDS:
                self.older_parts, self.parts = self.parts, {}
            if len(text) < LONG_WORD:
                self.parts[text] = found
        return found

    def __missing__(self, raw: bytes) -> bytes:
        ids = self.older.get(raw)
        if ids is None:
            ids = self.tokenize(raw)
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        if len(raw) < LONG_WORD:
            self[raw] = ids
        return ids

    def tokenize(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        core = word.rstrip(self.MARKS)
        low = core.lower() if core.isascii() else "".join(c.lower() for c in core)
        if not core.isalpha() or not core.isascii() and not (low.isalpha() and max(core) < self.SCRIPTS_END and is_normalized("NFC", core)):
            return self.part(word, self.encode)
        tail = word[len(core):]
        return self.part(low, self.merged) + (self.part(tail, self.encode) if tail else b"")


_WORDS: dict[str, WordTokens] = {}


def _words(path: str) -> WordTokens:
    """One tokenizer and word memory a worker process, whatever the number of its tasks."""
    if path not in _WORDS:
        from tokenizers import Tokenizer

        _WORDS[path] = WordTokens(Tokenizer.from_file(path))
    return _WORDS[path]


def token_ids(words: WordTokens, raw: bytes) -> bytes:
    """Ids of a UTF-8 text; split() cuts at the six ASCII blanks only, all of which are blanks to the tokenizer."""
    return b"".join(map(words.__getitem__, raw.split()))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, crc) of every document's tokens, end token included."""
    end = array("I", [end_id]).tobytes()

    def run(batches):
        words = _words(tokenizer_path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(b.column(1).cast(pa.binary())):
                ids = token_ids(words, raw.as_py() or b"") + end
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s : 4 * (s + capacity)]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))], names=["id", "piece", "start", "length", "crc"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, crc long")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (id, piece, start, length, crc) with sequence_id and offset."""
    parts = materialize(parts, "pieces")
    n = parts.count()
    parts = parts.withColumn("block", F.pmod(F.hash("id", "piece"), F.lit(max(1, n // max(LEAST_BLOCK, int(n**0.5))))))
    counts = parts.groupBy("length", "block").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows, whatever the corpus
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "block").orderBy("id", "piece", "start")
    ranked = parts.withColumn("r", F.row_number().over(inside) - 1).join(ahead, ["length", "block"])
    ranked = ranked.select("id", "piece", "start", "length", "crc", (F.col("r") + F.col("ahead")).alias("rank"))
    keys = (plan["length"].to_numpy() << 48) + plan["rank"].to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [plan[c].to_numpy()[order] for c in ("rank", "bin", "each", "offset")]

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            k = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            first, bins, each, offset = (c[k] for c in columns)
            inner = rank - first
            yield pdf.drop(columns="rank").assign(sequence_id=bins + inner // each, offset=offset + inner % each * length)

    return ranked.mapInPandas(place, "id long, piece int, start long, length long, crc long, sequence_id long, offset long")
