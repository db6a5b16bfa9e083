"""Cross-tokenizer alignment (12): divide and conquer at shared cuts.

A text is cut by two tokenizers, a byte-level one (A) and a piece one (B). Byte offsets where a
token of either ends are cuts. An interval of tokens looks for a shared cut near its middle:
the middle end of A is bisected into the ends of B, then its neighbours outward; the interval
falls into two at the cut, and one without a cut inside is a leaf group. All intervals of a
batch of texts are at the same depth at the same time, so a depth costs a few array steps.

A link is a pair of an A and a B token whose byte ranges overlap. Links are counted by id pair
over the corpus: tasks add up what they hold, the shuffle adds the tasks. The most frequent
pairs (at most ``HEAD_PAIRS``) are sent to the tasks that score documents; entries of rarer
pairs are joined through a shuffle, so results are the same at every size.

Edge cases: null, empty and unequal texts (joined token bytes differ from blank + text) have
zeros and an empty digest; long texts are whole; a null id and rows that repeat an id are rows
of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Id pairs that are sent to every task, the most frequent ones.
HEAD_PAIRS = 1_000_000
#: Characters of text that are aligned together; entries that a task adds up together.
BATCH_CHARS, BATCH_ENTRIES = 1_000_000, 2_000_000
#: Words that a worker remembers with their tokens; longer words are not remembered.
KEPT_WORDS, LONG_WORD = 300_000, 48
#: Ends next to the middle that are bisected one by one; after them an interval is looked through as a whole.
PROBES = 6
#: Fixed value: the pattern by which the byte-level vocabulary cuts a text.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ---- tokenizers -----------------------------------------------------------------------------
def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xFF and c != 0xAD]
    hidden = [c for c in range(256) if c not in shown]
    return {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}


class ByteTokens:
    """A byte-level vocabulary: ``bytes_of[id]``, encode(text).

    Where merges are ranked as ids are, the ranks themselves encode (the same ids, faster);
    other vocabularies, and texts that the fast way refuses, go through the tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        vocab, letters = spec["model"]["vocab"], _letters()
        added = {x["id"]: x["content"] for x in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *added]) + 1
        self.bytes_of = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = added[i].encode() if i in added else bytes(letters[c] for c in word)
        for i, word in added.items():
            self.bytes_of[i] = word.encode()
        self.fast = None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ranked = [vocab["".join(m)] for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        if ranked == list(range(256, 256 + len(ranked))) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in added}
            self.fast = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # its pattern matcher gives up on some very long runs
                pass
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A piece vocabulary with byte fallback: ``bytes_of[id]``, encode(text)."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        single = re.compile("<0x([0-9A-F]{2})>$")
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := single.match(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces)
        self.blank = self.model.piece_to_id("▁")

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


# ---- alignment --------------------------------------------------------------------------------
def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which ends of A are ends of B too. ``last``: the index of the last A token of every text,
    where both end; texts follow each other in ends_a and ends_b."""
    cut = np.zeros(len(ends_a), bool)
    cut[last] = True
    lo = np.concatenate([[0], last[:-1] + 1])
    hi = last.copy()  # inner ends are lo .. hi - 1

    def ends_too(k: np.ndarray) -> np.ndarray:
        return ends_b[np.searchsorted(ends_b, ends_a[k])] == ends_a[k]

    while True:
        some = hi > lo
        lo, hi = lo[some], hi[some]
        if not len(lo):
            return cut
        mid, at = (lo + hi - 1) // 2, np.full(len(lo), -1)
        todo = np.arange(len(lo))
        for step in range(PROBES + 1):
            for sign in (1, -1)[: 1 + bool(step)]:
                k = mid[todo] + sign * step
                inside = (k >= lo[todo]) & (k < hi[todo])
                hit = np.zeros(len(todo), bool)
                hit[inside] = ends_too(k[inside])
                at[todo[hit]] = k[hit]
                todo = todo[~hit]
        todo = todo[(hi - lo)[todo] > 2 * PROBES + 1]
        if len(todo):  # far from any shared cut: the whole interval, nearest to the middle first
            n = hi[todo] - lo[todo]
            first = np.cumsum(n) - n
            k = np.arange(n.sum()) - np.repeat(first - lo[todo], n)
            far = np.where(ends_too(k), np.abs(k - np.repeat(mid[todo], n)), len(ends_a))
            nearest = np.minimum.reduceat(far, first)
            is_it = np.flatnonzero((far == np.repeat(nearest, n)) & (far < len(ends_a)))
            at[todo[np.searchsorted(first, is_it, "right") - 1]] = k[is_it]
        found = at >= 0  # the others are leaf groups
        lo, hi, at = lo[found], hi[found], at[found]
        cut[at] = True
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at, hi])


class Aligner:
    """Both tokenizers and what a batch of texts is aligned to."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokens(a_path), PieceTokens(b_path)
        self.words = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
        self.kept: dict[str, tuple[bytes, bytes, bool]] = {}
        self.n_a, self.n_b = len(self.a.bytes_of), len(self.b.bytes_of)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes_of]) for t in (self.a, self.b))
        # a token's digits with what follows it: a comma, or the end of the group's side
        self.said = np.array([f"{i}{end}".encode() for i in range(self.n_a) for end in ",|"] + [f"{i}{end}".encode() for i in range(self.n_b) for end in ",;"], object)

    def whole(self, text: str) -> tuple[bytes, bytes, bool]:
        """Packed ids of A and B for blank + text, and whether both sides' bytes are the text's."""
        a, b, raw = self.a.encode(" " + text), self.b.encode(text) if text else [self.b.blank], (" " + text).encode()
        same = b"".join(map(self.a.bytes_of.__getitem__, a)) == raw == b"".join(map(self.b.bytes_of.__getitem__, b))
        return array("i", a).tobytes(), array("i", b).tobytes(), same

    def learn(self, words: list[str]) -> None:
        """Tokenises unknown words in one go: one that ends in anything but white space ends a
        piece of both sides when another one follows."""
        solid = [w for w in words if not w[-1].isspace()]
        line = "".join(solid)
        if solid:
            *ids, same = self.whole(line[1:])
            if same:
                sides = []
                stops = np.cumsum([len(w.encode()) for w in solid])
                for x, lengths in zip(ids, (self.len_a, self.len_b)):
                    ends = np.searchsorted(np.cumsum(lengths[np.frombuffer(x, np.int32)]), stops) * 4 + 4
                    sides.append([x[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist())])
                self.kept.update(zip(solid, zip(*sides, [True] * len(solid))))
        for w in words:
            if w not in self.kept:
                self.kept[w] = self.whole(w[1:])

    def tokens(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Packed ids of each text; none if a side's bytes differ from blank + text.

        A blank after anything but white space is a border of both sides: A's pattern begins a
        piece there, and no piece of B has a blank after another character. Words so cut are
        tokenised on their own and remembered."""
        if not self.b.by_word:
            both = [self.whole(t) if t else (b"", b"", True) for t in texts]
            return [x[:2] if x[2] else (b"", b"") for x in both]
        split = [self.words.findall(" " + t) if t else () for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        new = [w for w in set().union(*split) if w not in self.kept]
        self.learn(new)
        out = []
        for words in split:
            a, b, same = zip(*map(self.kept.__getitem__, words)) if words else ((), (), ())
            out.append((b"".join(a), b"".join(b)) if all(same) else (b"", b""))
        for w in new:
            if len(w) > LONG_WORD:
                del self.kept[w]
        return out

    def align(self, texts: list[str | None]) -> tuple:
        """Per text n_a, n_b, n_groups, n_links, digest; offsets, id pairs and counts of its links."""
        both = self.tokens(texts)
        n_a, n_b = (np.array([len(x[k]) // 4 for x in both], np.int64) for k in (0, 1))
        a, b = (np.frombuffer(b"".join(x[k] for x in both), np.int32).astype(np.int64) for k in (0, 1))
        zero = np.zeros(len(texts), np.int64)
        if not len(a):
            return n_a, n_b, zero, zero, [""] * len(texts), np.zeros(len(texts) + 1, np.int32), a, a
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        last = np.cumsum(n_a)[n_a > 0] - 1
        cut_a = shared_cuts(ends_a, ends_b, last)
        last_a = np.flatnonzero(cut_a)  # of each group
        last_b = np.searchsorted(ends_b, ends_a[last_a])
        cut_b = np.zeros(len(b), bool)
        cut_b[last_b] = True
        of_a, of_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(text_of_a[last_a], minlength=len(texts))
        # groups in words: the A tokens of a group, then its B tokens
        first_b = np.concatenate([[0], last_b[:-1] + 1])
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + first_b[of_a]] = 2 * a + cut_a
        codes[np.arange(len(b)) + last_a[of_b] + 1] = 2 * (self.n_a + b) + cut_b
        said, stops = self.said[codes].tolist(), np.cumsum(n_a + n_b)
        digests = [hashlib.sha256(b"".join(said[e - n : e])[:-1]).hexdigest() if n else "" for n, e in zip((n_a + n_b).tolist(), stops.tolist())]
        # links: between two ends of any side lies one pair of tokens
        at_a, at_b = np.zeros(ends_a[-1] + 1, np.int32), np.zeros(ends_a[-1] + 1, np.int32)
        at_a[ends_a] = at_b[ends_b] = 1
        ends = np.flatnonzero(at_a | at_b)
        in_a, in_b = ((np.cumsum(x) - x)[ends] for x in (at_a, at_b))  # tokens that end before
        of_text = text_of_a[in_a]
        n_links = np.bincount(of_text, minlength=len(texts))
        all_pairs = self.n_a * self.n_b
        key, times = np.unique(of_text * all_pairs + a[in_a] * self.n_b + b[in_b], return_counts=True)
        offsets = np.searchsorted(key, np.arange(len(texts) + 1) * all_pairs).astype(np.int32)
        return n_a, n_b, n_groups, n_links, digests, offsets, key % all_pairs, times


def _batches(column: pa.Array):
    """(from, to) of consecutive texts with some BATCH_CHARS together."""
    start = size = 0
    for k, n in enumerate(pa.compute.utf8_length(column).fill_null(0).to_pylist()):
        if size and size + n > BATCH_CHARS:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(column):
        yield start, len(column)


ALIGNED = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with its groups' digest and, once each, the id pairs of its links
    (A id times B's vocabulary plus B id) with their number of times."""

    def run(batches):
        at = None
        for batch in batches:
            at = at or Aligner(a_path, b_path)
            for lo, hi in _batches(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                *numbers, digests, offsets, pairs, times = at.align(part.column(1).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (pairs, times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, numbers), pa.array(digests, pa.string()), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, links, best): links of each id pair over the corpus; best if no pair of its B id has more."""

    def run(batches):
        kept, size = [], 0

        def added():
            pair, of = np.unique(np.concatenate([x for x, _ in kept]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.bincount(of, np.concatenate([y for _, y in kept])).astype(np.int64))], names=["pair", "links"])

        for batch in batches:
            kept.append(tuple(batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1)))
            size += len(kept[-1][0])
            if size > BATCH_ENTRIES:
                yield added()
                kept, size = [], 0
        if size:
            yield added()

    counts = rows.select("pairs", "times").mapInArrow(run, "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    counts = materialize(counts, "pairs")
    most = counts.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("links").alias("most"))  # at most a row for each id of B
    return counts.join(F.broadcast(most), F.col("pair") % n_b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def _head(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent pairs, at most ``most`` of them, and the others."""
    step = F.floor(F.log2(F.col("links").cast("double")) * 8)
    by_step = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)  # some hundred rows
    total, least = 0, None
    for s, n in by_step:
        if total + n > most:
            break
        total, least = total + n, s
    if total == sum(n for _, n in by_step):
        return counts, None
    if least is None:
        return counts.limit(0), counts
    return counts.where(step >= least), counts.where(step < least)


def score(rows: DataFrame, counts: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """n_best and count_sum of every stored row of aligned()."""
    head, tail = _head(counts, head_pairs)
    table = head.orderBy("pair").toArrow()
    names = ["pair", "links", "best"]
    pair, links, best = (rows.sparkSession.sparkContext.broadcast(table[c].to_numpy()) for c in names)

    def run(batches):
        p, n, top = np.append(pair.value, -1), np.append(links.value, 0), np.append(best.value.astype(np.int64), 0)
        for batch in batches:
            sizes = batch.column("pairs").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(sizes)), sizes)
            mine, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            at = np.searchsorted(p[:-1], mine)
            known = p[at] == mine
            at = np.where(known, at, len(p) - 1)
            sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
            for x, value in zip(sums, (top[at] * times, n[at] * times)):
                np.add.at(x, of, value)
            offsets = np.searchsorted(of[~known], np.arange(len(sizes) + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[~known])) for x in (mine, times)]
            keep = [k for k, c in enumerate(batch.schema.names) if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *map(pa.array, sums), *rest], names=[*(batch.schema.names[k] for k in keep), "n_best", "count_sum", "pairs", "times"])

    kept = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    scored = rows.mapInArrow(run, kept + ", pairs array<long>, times array<long>")
    if tail is None:
        return scored.drop("row", "pairs", "times")
    scored = materialize(scored, "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(tail, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("links")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    out = scored.drop("pairs", "times").join(rest, "row", "left")
    out = out.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return out.drop("row", "_sum", "_best")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """A row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose
    id pair is the most frequent of its B id), count_sum (of the counts of its links' pairs)."""
    rows = aligned(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"), "aligned")
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    return score(rows, pair_counts(rows, n_b), head_pairs)
