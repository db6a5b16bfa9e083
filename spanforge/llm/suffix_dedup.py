"""Suffix-array dedup (7): remove every byte covered by a 100-byte string seen earlier.

Of the 69 grams of 32 bytes inside a 100-byte window, the one with the smallest hash is the
window's anchor, so equal windows have equal anchors. An anchor's context is the union of
all windows around it.

1. Each task finds the anchors of its texts and sorts them by (gram, context, document,
   position). An occurrence whose whole context came earlier is covered by earlier text: it
   is settled at once. Only the first of each context leaves the task.
2. Shuffled by gram, the same rule settles the rest. What stays open are the first
   occurrences of contexts that share a gram but are not equal, mostly the two ends of
   repeated passages.
3. Their bytes are gathered by gram. Each group gets a suffix array, built by linear grouping
   (suffix_array.py); windows that stand next to each other in it and are equal form a class,
   of which all but the earliest are covered.
4. A gram with more than ``MOST_CONTEXTS`` open contexts does not fit one suffix array: its
   windows go one by one through steps 1 and 2 (a window is then its own context), which
   spreads them over all tasks.
5. Covered spans meet their texts again by document.

Equal contexts are told by 64-bit hashes of gram and context; suffix arrays compare the bytes of the rest.

A document is named by its id i and a 64-bit hash k of its text.

Edge cases: null and empty texts have no bytes; texts are read whole (long ones in pieces
that overlap by 99 bytes); a null id comes before all others; rows of one id (or without one)
come in the order of their hashes, and rows that repeat id and text are one document with one
result each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .suffix_array import suffix_array

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1  # gram starts inside a window: one of them is its anchor
MOST_CONTEXTS = 12
_CHUNK, _PIECE, _HELD = 1 << 18, 1 << 22, 1_500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of them."""
    size = 1 << max(19, int(n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            inverse = pow(_BASE, -1, 1 << 64)
            made = []
            for base in (_BASE, inverse):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return pick(x[:-rest], x[rest:]) if rest else x


class Hashes:
    """Hashes of any slice of a byte string, from one running sum."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.power, self.inverse = _powers(len(data) + 1)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = len(self.sums) - width
            return _mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Anchors of texts laid end to end: data[first[k]:last[k]] is text k.

    Of the grams inside a window the smallest hash is the window's anchor, so equal windows
    have equal anchors at equal places. Returns (text number, position in data, gram hash,
    context hash, context start, context end); the context holds every window of the text
    that the anchor's gram lies in."""
    empty = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    hashes = Hashes(data)
    h = hashes.all(GRAM) | np.uint64(1)
    least = _sliding(h, SPAN, np.minimum)  # one for each window start
    text_end = np.repeat(last, last - first)
    inside = np.arange(len(least)) + WINDOW <= text_end[: len(least)]
    least[~inside] = 0
    pad = np.zeros(SPAN - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum)
    at = np.flatnonzero(most == h)
    text = np.searchsorted(last, at, side="right")
    start, end = np.maximum(at - (SPAN - 1), first[text]), np.minimum(at + WINDOW, last[text])
    with np.errstate(over="ignore"):
        context = hashes.of(start, end) ^ _mix(((at - start) * 1024 + end - at).astype(np.uint64))
    return text, at, h[at], context, start, end


def _laid_out(texts):
    """Portions (data, first, last, number, offset) of (number, bytes) laid end to end."""
    held, size = [], 0

    def portion():
        length = np.array([len(x) for _, _, x in held], np.int64)
        last = np.cumsum(length)
        return np.frombuffer(b"".join(x for _, _, x in held), np.uint8), last - length, last, np.array([k for k, _, _ in held]), np.array([o for _, o, _ in held], np.int64)

    for k, raw in texts:
        for o in range(0, max(len(raw) - WINDOW + 1, 1), _PIECE):
            part = raw[o : o + _PIECE + WINDOW - 1]
            if held and size + len(part) > _CHUNK:
                yield portion()
                held, size = [], 0
            held.append((k, o, part))
            size += len(part)
    if held:
        yield portion()


def _rows(names: str, *columns) -> pa.RecordBatch:
    kinds = {"q": pa.int32()}
    arrays = [pa.array(c.view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c, kinds.get(n, pa.int64())) for n, c in zip(names.split(), columns)]
    return pa.RecordBatch.from_arrays(arrays, names=names.split())


def _settle(a, x, i, k, p, q):
    """Sorts occurrences; returns (those of the firsts of each (a, x), spans of the others)."""
    order = np.lexsort((p, k, i, x, a))
    a, x, i, k, p, q = (c[order] for c in (a, x, i, k, p, q))
    first, again = np.ones(len(a), bool), np.zeros(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1])
    again[1:] = ~first[1:] & _same(i, k, p)  # a repeated row's occurrence covers nothing
    rest = ~first & ~again
    return tuple(c[first] for c in (a, x, i, k, p, q)), _spans(i[rest], k[rest], p[rest], q[rest])


def _same(*columns):
    out = True
    for c in columns:
        out = out & (c[1:] == c[:-1])
    return out


def _spans(i, k, p, q):
    """(i, k, start, end) that contexts cover; q holds their lengths left and right of p."""
    return _merged(i, k, p - (q >> 8), p + (q & 255))


def _merged(i, k, start, end):
    """Overlapping spans of one document made one."""
    if not len(i):
        return i, k, start, end
    order = np.lexsort((start, k, i))
    i, k, start, end = (c[order] for c in (i, k, start, end))
    new = np.ones(len(i), bool)
    # spans come by start and have at most 169 bytes: looking one back is enough to join most
    new[1:] = ~(_same(i, k) & (start[1:] <= end[:-1]))
    at = np.flatnonzero(new)
    return i[at], k[at], start[at], np.maximum.reduceat(end, at)


def _with_spans(firsts, spans):
    """Batches of open occurrences, and of spans with q = -1, x their end, spread by a."""
    yield _rows("a x i k p q", *firsts)
    i, k, p, end = spans
    if len(i):
        yield _rows("a x i k p q", _mix((i * 31 + k + p).astype(np.uint64)).view(np.int64), end, i, k, p, np.full(len(i), -1, np.int32))


def _occurrences(batches):
    """Step 1: open occurrences (a, x, i, k, p, q), and spans with q = -1, x their end."""
    held: list[tuple] = []

    def flush():
        out = _settle(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        yield from _with_spans(*out)

    n = 0
    for b in batches:
        ids, keys = (b.column(c).to_numpy() for c in (0, 1))
        for data, first, last, number, offset in _laid_out((r, t) for r, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()) if t and len(t) >= WINDOW):
            text, at, a, x, start, end = anchors(data, first, last)
            r = number[text]
            held.append((a.view(np.int64), x.view(np.int64), ids[r], keys[r], offset[text] + at - first[text], ((at - start << 8) + end - at).astype(np.int32)))
            n += len(a)
            if n > _HELD:
                yield from flush()
                n = 0
    if held:
        yield from flush()


def _grouped(most: int):
    """Step 2, over rows sorted by (a, x, i, k, p): (i, k, p, end, a, q) with q = -1 for settled
    spans, 0 for open occurrences, 1 for open ones of a gram with over ``most`` of them."""

    def run(batches):
        tail: tuple | None = None  # the last row seen
        group, n_open, spilling = [], 0, False  # open occurrences of the gram that may go on

        def emit(parts, q):
            i, k, p, a = (np.concatenate(c) for c in zip(*parts))
            return _rows("i k p end a q", i, k, p, np.zeros(len(i), np.int64), a, np.full(len(i), q, np.int32))

        for b in batches:
            a, x, i, k, p, q = (b.column(c).to_numpy() for c in range(6))
            span = q < 0
            if span.any():
                yield _rows("i k p end a q", i[span], k[span], p[span], x[span], a[span], q[span])
                a, x, i, k, p, q = (c[~span] for c in (a, x, i, k, p, q))
            if not len(a):
                continue
            new_a, new_x, again = np.ones(len(a), bool), np.ones(len(a), bool), np.zeros(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_x[1:] = new_a[1:] | (x[1:] != x[:-1])
            again[1:] = ~new_x[1:] & _same(i, k, p)
            if tail is not None and a[0] == tail[0]:
                new_a[0] = False
                new_x[0] = x[0] != tail[1]
                again[0] = not new_x[0] and (i[0], k[0], p[0]) == tail[2:]
            tail = (a[-1], x[-1], i[-1], k[-1], p[-1])
            rest = ~new_x & ~again
            if rest.any():
                si, sk, sp, se = _spans(i[rest], k[rest], p[rest], q[rest])
                yield _rows("i k p end a q", si, sk, sp, se, np.zeros(len(si), np.int64), np.full(len(si), -1, np.int32))
            fa, fi, fk, fp, fn = a[new_x], i[new_x], k[new_x], p[new_x], new_a[new_x]
            cuts = np.flatnonzero(fn)
            if len(fa) and (not len(cuts) or cuts[0] > 0):  # goes on with the group before
                e = cuts[0] if len(cuts) else len(fa)
                group.append((fi[:e], fk[:e], fp[:e], fa[:e]))
                n_open += e
            if len(cuts):
                if group and (spilling or n_open > 1):
                    yield emit(group, 1 if spilling or n_open > most else 0)
                # groups that begin and end inside this batch
                sizes = np.diff(np.append(cuts, len(fa)))
                inner = np.repeat(sizes, sizes)
                whole = slice(cuts[0], cuts[-1])
                many = inner[: cuts[-1] - cuts[0]]
                for q_out, pick in ((0, (many > 1) & (many <= most)), (1, many > most)):
                    if pick.any():
                        yield emit([tuple(c[whole][pick] for c in (fi, fk, fp, fa))], q_out)
                group, n_open, spilling = [tuple(c[cuts[-1] :] for c in (fi, fk, fp, fa))], len(fa) - cuts[-1], False
            if n_open > most and group:
                yield emit(group, 1)
                group, spilling = [], True
        if group and (spilling or n_open > 1):
            yield emit(group, 1 if spilling else 0)

    return run


def _first_seen(rows: DataFrame, most: int) -> DataFrame:
    order = rows.repartition("a").sortWithinPartitions("a", "x", "i", "k", "p")
    return order.mapInArrow(_grouped(most), "i long, k long, p long, end long, a long, q int")


def _own_windows(batches):
    """Step 3: per open occurrence its own windows' bytes, (a, i, k, p, n, bytes), if it is not
    hot; a hot one's windows (a, i, k, p, n = 0, x = window hash)."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        i, key = (b.column(k).to_numpy() for k in (0, 1))
        raws, wanted, grams, hots = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
        raws = [unpack.decompress(r) for r in raws]
        wanted, grams, hots = ([np.frombuffer(w, kind) for w in c] for c, kind in ((wanted, np.int64), (grams, np.int64), (hots, np.int8)))
        order = [np.argsort(w, kind="stable") for w in wanted]
        for data, first, last, number, offset in _laid_out(enumerate(raws)):
            h = Hashes(data)
            gram = h.all(GRAM) | np.uint64(1) if len(data) >= GRAM else np.empty(0, np.uint64)
            if len(gram) < SPAN:
                continue
            least = _sliding(gram, SPAN, np.minimum)
            at, text, a, hot = [], [], [], []
            for t, (k, o) in enumerate(zip(number, offset)):
                w, g, ht = wanted[k][order[k]], grams[k][order[k]], hots[k][order[k]]
                lo, hi = np.searchsorted(w, (o, o + last[t] - first[t] - GRAM + 1))
                at.append(w[lo:hi] - o + first[t])
                text.append(np.full(hi - lo, t))
                a.append(g[lo:hi])
                hot.append(ht[lo:hi])
            at, text, a, hot = map(np.concatenate, (at, text, a, hot))
            starts = at[:, None] + np.arange(-SPAN + 1, 1)[None, :]
            fits = (starts >= first[text][:, None]) & (starts + WINDOW <= last[text][:, None])
            own = fits & (least[np.clip(starts, 0, len(least) - 1)] == gram[np.minimum(at, len(gram) - 1)][:, None])
            some = own.any(1)
            at, text, a, hot, own, starts = (c[some] for c in (at, text, a, hot, own, starts))
            if not len(at):
                continue
            lo = starts[np.arange(len(at)), own.argmax(1)]
            hi = starts[np.arange(len(at)), own.shape[1] - 1 - own[:, ::-1].argmax(1)]
            doc = number[text]
            p = offset[text] - first[text]
            flat = data.tobytes()
            cold = np.flatnonzero(hot == 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[cold]), pa.array(i[doc][cold]), pa.array(key[doc][cold]), pa.array((p + lo)[cold]), pa.array((hi - lo + 1)[cold].astype(np.int32)), pa.array([flat[s:e] for s, e in zip(lo[cold], hi[cold] + WINDOW)], pa.binary()), pa.nulls(len(cold), pa.int64())], names=["a", "i", "k", "p", "n", "bytes", "x"])
            row, col = np.nonzero(own[hot != 0])
            if len(row):
                back = np.flatnonzero(hot != 0)[row]
                s = starts[hot != 0][row, col]
                s, once = np.unique(s, return_index=True)  # a window with its gram in two places comes twice
                back = back[once]
                x = h.of(s, s + WINDOW).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[back] ^ (x >> 7)), pa.array(i[doc][back]), pa.array(key[doc][back]), pa.array(p[back] + s), pa.array(np.zeros(len(s), np.int32)), pa.nulls(len(s), pa.binary()), pa.array(x)], names=["a", "i", "k", "p", "n", "bytes", "x"])


def covered_windows(contexts: list[bytes], names: list[tuple[int, int, int]], counts: list[int]) -> list[tuple[int, int, int]]:
    """Of the first ``counts[c]`` windows of each context those that are equal to an earlier
    one, as (i, k, p); ``names[c]`` is (i, k, p) of context c's first window."""
    text = b"\x00".join(contexts)
    window_at, owner, at = [-1] * len(text), [], 0  # the number of the window at each place, the context of each window
    first = []
    for c, (context, n) in enumerate(zip(contexts, counts)):
        first.append(len(owner))
        window_at[at : at + n] = range(len(owner), len(owner) + n)
        owner += [c] * n
        at += len(context) + 1
    numbers = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    cut = np.cumsum([len(c) + 1 for c in contexts])[:-1] - 1
    numbers[cut] = 0  # between contexts: a symbol of no text
    out, last, members = [], None, []

    def name(w):
        i, k, p = names[owner[w]]
        return i, k, p + w - first[owner[w]]

    def close():
        if len(members) > 1:  # a window with its gram in two places comes twice under one name
            out.extend(sorted(set(map(name, members)))[1:])

    for s in suffix_array(numbers):
        w = window_at[s]
        if w < 0:
            continue
        window = text[s : s + WINDOW]
        if window != last:
            close()
            members, last = [w], window
        else:
            members.append(w)
    close()
    return sorted(set(out))


def _by_suffix_array(batches):
    """Step 3, over contexts sorted by gram: spans (i, k, p, end, a, q = -1)."""
    held: list[tuple] = []
    gram = None

    def close():
        rows = covered_windows([r[1] for r in held], [r[0] for r in held], [r[2] for r in held]) if len(held) > 1 else []
        held.clear()
        return rows

    def spans(found):
        i, k, p = np.array(found, np.int64).reshape(-1, 3).T
        i, k, start, end = _merged(i, k, p, p + WINDOW)
        return _rows("i k p end a q", i, k, start, end, np.zeros(len(i), np.int64), np.full(len(i), -1, np.int32))

    for b in batches:
        found = []
        for a, i, k, p, n, c in zip(*(b.column(c).to_pylist() for c in range(6))):
            if a != gram:
                found += close()
                gram = a
            held.append(((i, k, p), c, n))
        if found:
            yield spans(found)
    if found := close():
        yield spans(found)


def _local_firsts(batches):
    """Hot windows of a task, each its own context: as _occurrences gives them."""
    for b in batches:
        a, i, k, p, x = (b.column(c).to_numpy() for c in range(5))
        if len(a):
            yield from _with_spans(*_settle(a, x, i, k, p, np.full(len(a), WINDOW, np.int32)))


def _packed(docs: DataFrame) -> DataFrame:
    """The texts for a shuffle, compressed one by one."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["i", "k", "z"])

    return docs.mapInArrow(run, "i long, k long, z binary")


def _cut(batches):
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for z, starts, ends in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
            raw = unpack.decompress(z)
            removed = spans = 0
            parts, at = [], 0
            for s, e in sorted(zip(np.frombuffer(starts, np.int64).tolist(), np.frombuffer(ends, np.int64).tolist())) if starts else ():
                if s > at or not spans and s == 0:
                    parts.append(raw[at:s])
                    spans += 1
                    removed += e - s
                    at = e
                elif e > at:
                    removed += e - at
                    at = e
            parts.append(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(removed)
            n_spans.append(spans)
            kept.append(hashlib.sha256(b"".join(parts)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string())], names=["i", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


_NO_ID = -(1 << 63)


def _flat(fields: dict[str, type]):
    """Columns i, k, z and, of the list w of structs, each field's numbers as bytes."""

    def run(batches):
        for b in batches:
            lists = b.column(3).to_pylist()
            cols = [pa.array([None if w is None else np.array([r[f] for r in w], kind).tobytes() for w in lists], pa.binary()) for f, kind in fields.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], names=["i", "k", "z", *fields])

    return run


def dedup_spans(docs: DataFrame, most: int = MOST_CONTEXTS) -> DataFrame:
    """(i, k, p, end): covered spans of documents (i, k, t)."""
    opened = materialize(_first_seen(docs.mapInArrow(_occurrences, "a long, x long, i long, k long, p long, q int"), most), "occurrences")
    per_doc = opened.where("q >= 0").groupBy(F.col("i").alias("di"), F.col("k").alias("dk")).agg(F.sort_array(F.collect_list(F.struct(F.col("p").alias("at"), "a", "q"))).alias("w"))
    texts = _packed(docs).dropDuplicates(["i", "k"]).join(per_doc.hint("merge"), (F.col("i") == F.col("di")) & (F.col("k") == F.col("dk"))).select("i", "k", "z", "w")
    wide = texts.mapInArrow(_flat({"at": np.int64, "a": np.int64, "q": np.int8}), "i long, k long, z binary, at binary, a binary, q binary")
    windows = materialize(wide.mapInArrow(_own_windows, "a long, i long, k long, p long, n int, bytes binary, x long"), "windows")
    cold = windows.where("x is null").select("a", "i", "k", "p", "n", "bytes").repartition("a").sortWithinPartitions("a")
    by_array = cold.mapInArrow(_by_suffix_array, "i long, k long, p long, end long, a long, q int")
    hot = windows.where("x is not null").select("a", "i", "k", "p", "x").mapInArrow(_local_firsts, "a long, x long, i long, k long, p long, q int")
    found = opened.where("q < 0").union(by_array).union(_first_seen(hot, 1 << 60).where("q < 0"))
    return found.select("i", "k", "p", "end")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_CONTEXTS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("i"), F.xxhash64(text_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    per_doc = dedup_spans(rows, most).groupBy(F.col("i").alias("di"), F.col("k").alias("dk")).agg(F.collect_list(F.struct(F.col("p").alias("s"), F.col("end").alias("e"))).alias("w"))
    texts = _packed(rows).join(per_doc.hint("merge"), (F.col("i") == F.col("di")) & (F.col("k") == F.col("dk")), "left").select("i", "k", "z", "w")
    wide = texts.mapInArrow(_flat({"s": np.int64, "e": np.int64}), "i long, k long, z binary, s binary, e binary")
    out = wide.mapInArrow(_cut, "i long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("i") != _NO_ID, F.col("i")).alias("id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
