"""Near duplicates by word shingles: every pair of texts whose Jaccard ratio reaches a threshold.

SimHash links (8) and shared prefix shingles name candidates; a pair counts only after its
whole shingle sets are compared. The prefix is exact: of n shingles in one order for all
texts, two sets of ratio t share one of the first n - ceil(t n) + 1. Shingles that are common
in a sample of the texts come last in that order; which ones do changes the cost, never the
result. Candidates come in two steps, so that a large group of near copies makes no pair of
each two: first every member of a prefix group with the group's head, then, where a group
holds several components, the pairs across components. A bitmap of each set (a bit for each
hash modulo BITS) bounds a pair's difference from below, so pairs that it rules out need no
comparison of whole sets.

Edge cases: a text of fewer words than a shingle is one shingle; null and empty texts are
equal to each other only; a null id never becomes a component id unless all ids of the
component are null.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_batches, connected_components, materialize, small

SHINGLE, THRESHOLD = 5, 0.8
#: One text in SAMPLE tells which shingles are common: those in HOT sampled texts, at most MOST_HOT.
SAMPLE, HOT, MOST_HOT = 8, 2, 1_000_000
BITS, FOLD = 2048, 8
HEADS = 4
#: Texts whose sets a worker holds at once.
TEXTS = 64
#: Rows of prefixes and bit maps in a batch.
PREFIXES = 256


def shingle_set(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    return _distinct(list(simhash.shingle_hashes(raw, shingle)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.xxhash64(text_col).alias("row_key"), F.col(text_col).cast("string").alias("t"))


def _sets(texts: DataFrame, key: str, shingle: int) -> DataFrame:
    """(key, hashes) of (key, t)."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                part = b.slice(k, TEXTS)
                sets = [shingle_set(t.as_py() or b"", shingle) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=[key, "hashes"])

    return texts.select(key, "t").mapInArrow(run, f"{key} long, hashes array<long>")


def _common(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    some = _texts(docs, text_col).where(F.pmod("row_key", F.lit(SAMPLE)) == 0)
    counts = _sets(some, "row_key", shingle).select(F.explode("hashes").alias("g")).groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= HOT)
    with bounded_batches(docs.sparkSession):
        got = counts.orderBy(F.desc("c"), "g").limit(MOST_HOT).select("g").toArrow()
    return np.sort(got.column("g").to_numpy().view(np.uint64))


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[hashes & np.uint64(BITS - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def _prefix_rows(batches, last: np.ndarray, shingle: int, threshold: float):
    for whole in batches:
        for at in range(0, whole.num_rows, PREFIXES):
            b = whole.slice(at, PREFIXES)
            fp, sig, n, prefix, bits = [], [], [], [], []
            for t in b.column(2).cast(pa.binary()):
                parts = list(simhash.shingle_hashes(t.as_py() or b"", shingle))
                h = _distinct(parts)
                fp.append(simhash.of_hashes(parts))
                sig.append(xxhash.xxh64_intdigest(h.tobytes(), simhash.SEED))
                n.append(len(h))
                late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
                most = len(h) - math.ceil(threshold * len(h) - 1e-9) + 1 if len(h) else 0
                prefix.append(np.concatenate([h[~late], h[late]])[:most])
                bits.append(_bitmap(h))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, sig, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, _lists(prefix), _lists(bits)], names=["id", "row_key", "fp", "sig", "n", "prefix", "bits"])


def _prefixes(docs: DataFrame, common: np.ndarray, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """(id, row_key, fp, sig, n, prefix, bits): sig names the shingle set."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        return _prefix_rows(batches, sent.value, shingle, threshold)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, row_key long, fp long, sig long, n long, prefix array<long>, bits array<long>")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of set names whose ratio reaches the threshold."""
    asked = lambda p: materialize(rows.join(p.select(F.col("a").alias("sig")).union(p.select("b")).distinct(), "sig").groupBy("sig").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bits").alias("bits")), "asked")
    one = small(asked(pairs), 50_000)  # some 300 bytes a row
    side = lambda x, *c: one.select(F.col("sig").alias(x), *(F.col(k).alias(k + x) for k in c))
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    may = differ * F.lit(1 + threshold) <= F.lit(1 - threshold) * (F.col("na") + F.col("nb")) + 1e-6
    left = materialize(pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b").where(may).select("a", "b"), "left")
    named = materialize(one.select("sig", "row_key").join(left.select(F.col("a").alias("sig")).union(left.select("b")).distinct(), "sig"), "named")
    texts = _texts(docs, text_col).join(small(named), "row_key").dropDuplicates(["sig"])
    sets = materialize(_sets(texts, "sig", shingle), "sets")
    j = left.join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    return materialize(j.where(both >= F.lit(threshold) * (F.size("ha") + F.size("hb") - both) - 1e-9).select("a", "b"), "pairs")


def _candidates(left: DataFrame, right: DataFrame, threshold: float, across) -> DataFrame:
    """(a, b), a < b, of rows (g, sig, n, pos, part) that share g and may reach the threshold."""
    x, y = left.alias("x"), right.alias("y")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    # g is the first shared shingle of some row of the pair: no more than the rest can follow
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    may = (small >= F.lit(threshold) * large - 1e-9) & (most * F.lit(1 + threshold) >= F.lit(threshold) * (small + large) - 1e-6)
    j = x.join(y, (F.col("x.g") == F.col("y.g")) & across & may)
    return j.select(F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, row_key, component_id) for every row; component_id is the smallest id reachable."""
    rows = materialize(_prefixes(docs, _common(docs, text_col, shingle), id_col, text_col, shingle, threshold), "prefixes")
    check = lambda pairs: _verified(pairs, rows, docs, text_col, shingle, threshold)

    items = rows.select("sig", "n", F.posexplode("prefix").alias("pos", "g"))
    # groups of the same members take up to HEADS different heads, so that few components stay apart
    turn = F.xxhash64("sig", F.pmod("g", F.lit(HEADS)))
    heads = items.groupBy("g").agg(F.min_by("sig", turn).alias("head"), F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("g", "head")
    shared = materialize(items.join(heads, "g"), "shared")
    by_head = _candidates(shared.where("sig = head").distinct(), shared.where("sig <> head"), threshold, F.lit(True))
    one = rows.groupBy("fp").agg(F.min("sig").alias("sig"))
    same_fp = rows.join(one.withColumnRenamed("sig", "first"), "fp").where("sig <> first").select(F.least("sig", "first").alias("a"), F.greatest("sig", "first").alias("b"))
    linked = simhash.links(materialize(one.select("fp"), "distinct")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    by_fp = linked.join(one.select(F.col("fp").alias("fa"), F.col("sig").alias("sa")), "fa").join(one.select(F.col("fp").alias("fb"), F.col("sig").alias("sb")), "fb")
    by_fp = by_fp.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    first = materialize(by_head.union(same_fp).union(by_fp).distinct(), "candidates")
    found = check(first)

    part = connected_components(found)
    parted = materialize(shared.select("g", "sig", "n", "pos").join(part, F.col("sig") == F.col("node"), "left").select("g", "sig", "n", "pos", F.coalesce("component", "sig").alias("part")), "parted")
    mixed = parted.groupBy("g").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("g")
    open_ = materialize(parted.join(mixed, "g").distinct(), "open")
    # the bitmap folded to FOLD longs goes into the join itself
    fold = [reduce(lambda a, b: a.bitwiseOR(b), [F.element_at("bits", k + 1) for k in range(j, BITS // 64, FOLD)]).alias(f"w{j}") for j in range(FOLD)]
    asked = materialize(open_.select(F.col("sig").alias("s")).distinct(), "asked")
    folded = materialize(rows.join(small(asked), F.col("sig") == F.col("s"), "left_semi").select(F.col("sig").alias("s"), *fold).distinct(), "folded")
    open_ = open_.join(small(folded, 200_000), F.col("sig") == F.col("s")).drop("s")
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x.w{j}").bitwiseXOR(F.col(f"y.w{j}"))) for j in range(FOLD)])
    across = (F.col("x.sig") < F.col("y.sig")) & (F.col("x.part") != F.col("y.part")) & (differ * F.lit(1 + threshold) <= F.lit(1 - threshold) * (F.col("x.n") + F.col("y.n")) + 1e-6)
    second = materialize(_candidates(open_, open_, threshold, across).join(first, ["a", "b"], "left_anti"), "candidates")
    part = connected_components(found.union(check(second)))

    ids = rows.groupBy("sig").agg(F.min("id").alias("least"))
    named = materialize(ids.join(part, F.col("sig") == F.col("node"), "left").select("sig", "least", F.coalesce("component", "sig").alias("component")), "members")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = materialize(named.join(least, "component").select("sig", "component_id"), "labels")
    return rows.join(label, "sig").select("id", "row_key", "component_id")
