"""Interval joins by a sweep, and nearest spans by dominance queries.

Both sides of a join are sorted together by start and streamed past a set of open spans, so
the work is that of sorting plus one step a pair; nothing pairs all rows of a document. Rows
are dealt by document and by ranges of ``STRETCH`` offsets: a document with very many spans is
swept in several tasks, a span lies in every range that it touches, and a pair is found in the
range where its later span starts."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Offsets of a range, and pairs of an output batch.
STRETCH, PAIRS = 1 << 16, 1 << 16
_KEY = 1 << 42  # above any (doubled) offset


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Number of each row's run of equal keys."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        c = table[k].combine_chunks() if table[k].num_chunks != 1 else table[k].chunk(0)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _pairs(start: np.ndarray, end: np.ndarray, side: np.ndarray, old: int):
    """(earlier, later) positions of overlapping rows of different sides, in pieces. Rows are
    sorted by start; of the first ``old`` rows, pairs among themselves are known already."""
    for a in (0, 1):
        mine, theirs = np.flatnonzero(side == a), np.flatnonzero(side == 1 - a)
        first = np.maximum(np.searchsorted(theirs, mine), np.searchsorted(theirs, old))
        n = np.maximum(np.searchsorted(start[theirs], end[mine]) - first, 0)
        mine, first, n = mine[n > 0], first[n > 0], n[n > 0]
        upto = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            m = n[lo:hi]
            yield np.repeat(mine[lo:hi], m), theirs[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - first[lo:hi], m)]
            lo = hi


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], touching: bool = False) -> DataFrame:
    """Pairs of rows of equal keys whose spans [start, end) overlap: the keys, and all other
    columns as l_<name> and r_<name>. Spans without length overlap nothing.

    touching: spans are closed, so that neighbours that share a border pair too, as do spans
    without length."""
    sides = []
    for name, df in (("l", left), ("r", right)):
        rest = [c for c in df.columns if c not in keys]
        s, e = (F.col("start").cast("long"), F.col("end").cast("long"))
        s, e = (2 * s, 2 * e + 1) if touching else (s, e)
        rows = df.select(*keys, F.struct(*rest).alias(name), s.alias("_s"), e.alias("_e"), F.lit(int(name == "r")).alias("_side")).where("_e > _s")
        sides.append(rows.dropna(subset=keys))
    kinds = {n: df.schema[n].dataType for n, df in zip("lr", sides)}
    both = sides[0].withColumn("r", F.lit(None).cast(kinds["r"])).unionByName(sides[1].withColumn("l", F.lit(None).cast(kinds["l"])))
    both = both.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / STRETCH), F.floor((F.col("_e") - 1) / STRETCH))))
    by = [*keys, "_b"]
    dealt = both.select(*by, "_s", "_e", "_side", "l", "r").repartition(*by).sortWithinPartitions(*by, "_s", "_e", "_side")

    def run(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            old = carry.num_rows if carry is not None else 0
            if old:
                table = pa.concat_tables([carry, table])
            group = _groups(table, by)
            s, e, side, b = (table[c].to_numpy() for c in ("_s", "_e", "_side", "_b"))
            for i, j in _pairs(group * _KEY + s, group * _KEY + e, side, old):
                here = s[j] // STRETCH == b[j]
                i, j = i[here], j[here]
                if len(i):
                    swap = side[i] == 1
                    li, ri = pa.array(np.where(swap, j, i)), pa.array(np.where(swap, i, j))
                    out = pa.Table.from_arrays([*(table[k].take(li) for k in keys), table["l"].take(li), table["r"].take(ri)], names=[*keys, "l", "r"])
                    yield from out.combine_chunks().to_batches()
            if table.num_rows:
                carry = table.filter(pa.array((group == group[-1]) & (e > s[-1])))

    schema = dealt.select(*keys, "l", "r").schema
    out = dealt.mapInArrow(run, schema)
    named = [F.col(f"{n}.{f.name}").alias(f"{n}_{f.name}") for n in "lr" for f in kinds[n]]
    return out.select(*keys, *named)


class _Least:
    """Smallest value at or below a rank, as values come in."""

    def __init__(self, n: int):
        self.tree = [None] * (n + 1)

    def put(self, rank: int, value: tuple) -> None:
        rank += 1
        while rank < len(self.tree):
            if self.tree[rank] is None or value < self.tree[rank]:
                self.tree[rank] = value
            rank += rank & -rank

    def upto(self, rank: int) -> tuple | None:
        best, rank = None, rank + 1
        while rank > 0:
            x = self.tree[rank]
            if x is not None and (best is None or x < best):
                best = x
            rank -= rank & -rank
        return best


def nearest_spans(queries: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Per query (start, end) the (cost, start, end) of the span with the smallest sum of offset
    differences, ties by start and end.

    In each of the four quadrants around a query the cost is a sum of the query's part and the
    span's part, so a sweep over starts with least values by rank of end finds the best of it."""
    ends = sorted({e for _, e in spans})
    top, order = len(ends) - 1, sorted(spans)
    found: list = [None] * len(queries)

    def keep(k: int, part: int, x: tuple | None) -> None:
        if x is not None:
            y = (part + x[0], x[1], x[2])
            if found[k] is None or y < found[k]:
                found[k] = y

    by_start = sorted(range(len(queries)), key=lambda k: queries[k])
    for later in (True, False):
        above, below = _Least(top + 1), _Least(top + 1)
        todo = list(order) if later else order[::-1]  # taken from its end
        for k in reversed(by_start) if later else by_start:
            s, e = queries[k]
            while todo and (todo[-1][0] >= s if later else todo[-1][0] < s):
                gs, ge = todo.pop()
                rank = bisect_left(ends, ge)
                lead = gs if later else -gs
                above.put(top - rank, (lead + ge, gs, ge))
                below.put(rank, (lead - ge, gs, ge))
            rank, lead = bisect_left(ends, e), -s if later else s
            keep(k, lead - e, above.upto(top - rank))  # spans that end at or after the query
            keep(k, lead + e, below.upto(rank - 1))
    return found
