"""Significance and repeated runs."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyed_number, ratio
from .order import global_rank


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


#: Draws that a task holds at once, and draws of all replicates that meet one block of documents.
DRAWS, BLOCK_DRAWS = 1 << 20, 16_000_000


def bootstrap(counts: DataFrame, replicates: int = 1000, seed: str = "0") -> DataFrame:
    """(replicate, method, metric, f1): documents drawn with replacement, the same draws
    for all methods.

    counts: (method, metric, doc_id, tp, fp, fn). The documents are numbered by ranges; draw d of
    replicate r is a keyed hash of (seed, r, d). No draw is a row: a task draws for one replicate
    at a time and sends each block of documents the places drawn in it, two bytes a draw; a block
    meets the draws of all replicates once, and only sums leave it."""
    spark = counts.sparkSession
    kinds = {c: counts.schema[c].dataType.simpleString() for c in ("method", "metric")}
    docs = counts.select("doc_id").distinct()
    n = docs.count()
    numbered = global_rank(docs, ["doc_id"]).select("doc_id", (F.col("rank") - 1).cast("long").alias("k"))
    block = max(1, min(1 << 16, BLOCK_DRAWS // max(replicates, 1)))
    parts = -(-n // DRAWS)

    def draw(batches):
        for batch in batches:
            for unit in batch["id"].to_pylist():
                r, part = divmod(unit, parts)
                k = md5_numbers(f"{seed}:{r}:".encode(), part * DRAWS, min(n, (part + 1) * DRAWS)) % n
                at, place = np.divmod(k, block)
                place = place.astype("<u2")[np.argsort(at, kind="stable")]
                ends = np.cumsum(np.bincount(at))
                hit = [(b, place[e - m : e].tobytes()) for b, (e, m) in enumerate(zip(ends, np.diff(ends, prepend=0))) if m]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in hit], pa.int64()), pa.array([r] * len(hit), pa.int64()), pa.array([x for _, x in hit], pa.binary())], names=["_b", "replicate", "places"])

    def sums(rows: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or drawn.empty:
            return pd.DataFrame({c: [] for c in names})
        cells = rows.groupby(["method", "metric"], dropna=False, sort=True)
        cell, keys = cells.ngroup().to_numpy(), list(cells.size().index)
        values = np.zeros((block, len(keys) * 4))
        for i, v in enumerate((np.ones(len(rows)), *(rows[c].fillna(0).to_numpy(float) for c in ("tp", "fp", "fn")))):
            np.add.at(values, (rows["_k"].to_numpy(), cell * 4 + i), v)
        out = np.stack([np.bincount(np.frombuffer(x, "<u2"), minlength=block) @ values for x in drawn["places"]])
        return pd.concat([pd.DataFrame({"replicate": drawn["replicate"], "method": m, "metric": q, **{c: out[:, i * 4 + j] for j, c in enumerate(names[3:])}}) for i, (m, q) in enumerate(keys)])

    names = ["replicate", "method", "metric", "t", "tp", "fp", "fn"]
    units = replicates * parts
    tasks = max(1, min(units, spark.sparkContext.defaultParallelism + replicates * n // (16 * DRAWS)))
    draws = spark.range(0, units, 1, tasks).mapInArrow(draw, "_b long, replicate long, places binary")
    held = counts.join(numbered, "doc_id").select("method", "metric", F.expr(f"k div {block}").alias("_b"), (F.col("k") % block).alias("_k"), *(F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn")))
    schema = f"replicate long, method {kinds['method']}, metric {kinds['metric']}, t double, tp double, fp double, fn double"
    met = held.groupBy("_b").cogroup(draws.groupBy("_b")).applyInPandas(sums, schema)
    total = met.groupBy("replicate", "method", "metric").agg(*(F.sum(c).alias(c) for c in names[3:])).where("t > 0")
    return total.select("replicate", "method", "metric", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


# The shifts and sine constants of MD5 (RFC 1321), and its state at the start.
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LANES = 1 << 15


def md5_numbers(prefix: bytes, lo: int, hi: int) -> np.ndarray:
    """keyed_number of ``prefix`` and each decimal number from lo to below hi: the first 48 bits of
    the MD5, for thousands of numbers a step."""
    if len(prefix) + len(str(hi)) > 55:  # more than one block of MD5
        return np.array([int.from_bytes(hashlib.md5(prefix + b"%d" % d).digest()[:6], "big") for d in range(lo, hi)], np.int64)
    out = [np.empty(0, np.int64)]
    while lo < hi:
        end = min(hi, lo + _LANES, 10 ** len(str(lo)))  # as many digits each
        out.append(_md5_lanes(prefix, lo, end))
        lo = end
    return np.concatenate(out)


def _md5_lanes(prefix: bytes, lo: int, end: int) -> np.ndarray:
    width, d = len(str(lo)), np.arange(lo, end)
    size = len(prefix) + width
    block = np.zeros((64, end - lo), np.uint8)
    block[: len(prefix)] = np.frombuffer(prefix, np.uint8)[:, None]
    for j in range(width):
        block[len(prefix) + j] = d // 10 ** (width - 1 - j) % 10 + 48
    block[size] = 0x80
    block[56], block[57] = size * 8 & 255, size * 8 >> 8
    words = [np.ascontiguousarray(block[4 * i : 4 * i + 4].T).view("<u4").ravel() for i in range(16)]
    a, b, c, e = (np.full(end - lo, x, np.uint32) for x in _STATE)
    f = np.empty(end - lo, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, e, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, e, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, e, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, e, out=f)
        else:
            g = 7 * i % 16
            np.invert(e, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += words[g]
        f += np.uint32(_SINES[i])
        np.left_shift(f, _SHIFTS[i], out=a)
        np.right_shift(f, 32 - _SHIFTS[i], out=f)
        a |= f
        a += b
        a, b, c, e = e, a, b, c
    a, b = a + np.uint32(_STATE[0]), b + np.uint32(_STATE[1])
    return a.byteswap().astype(np.int64) << 16 | (b.byteswap() >> 16).astype(np.int64)


def bootstrap_ranges(counts: DataFrame, replicates: int = 1000, seed: int = 0, per_range: int = 65536) -> DataFrame:
    """R5 for corpora: as ``bootstrap``, without a row for every draw.

    Documents fall into ranges of some ``per_range`` by a hash of their id. A replicate's draws are
    split binomially down a tree over the ranges; every node has its own keyed generator, so each
    task finds the share of its range by walking from the root, and no draw is shuffled. Inside a
    range the share is dealt to its documents, and only sums leave the task. The driver sees one
    count a range. Rows that repeat a document, method and metric add up; a null id is one document;
    an empty table gives an empty result. Equal seeds give equal results however the input is
    partitioned."""
    kinds = {c: counts.schema[c].dataType.simpleString() for c in ("method", "metric")}
    once = counts.groupBy("doc_id", "method", "metric").agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    docs = counts.select("doc_id").distinct()
    depth = max(0, (max(docs.count(), 1) - 1) // per_range).bit_length()
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << depth)).cast("int")
    sizes = [0] * (1 << depth)
    for r in docs.groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect():
        sizes[r["b"]] = r["n"]
    upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["_b"].iloc[0])
        share = range_draws(upto, b, depth, replicates, seed)
        at, ids = pd.factorize(rows["doc_id"], sort=True, use_na_sentinel=False)
        cells = rows.groupby(["method", "metric"], dropna=False, sort=True)
        cell, names = cells.ngroup().to_numpy(), list(cells.size().index)
        rng = np.random.default_rng([seed, 1, b])
        values = np.zeros((len(ids), len(names) * 3))
        for k, c in enumerate(("tp", "fp", "fn")):
            np.add.at(values, (at, cell * 3 + k), rows[c].fillna(0).to_numpy(float))
        out = np.empty((replicates, values.shape[1]))
        for r in range(replicates):
            out[r] = np.bincount(rng.integers(0, len(ids), share[r]), minlength=len(ids)) @ values
        out = out.astype(np.int64)
        parts = [pd.DataFrame({"replicate": np.arange(replicates), "method": m, "metric": q, "tp": out[:, i * 3], "fp": out[:, i * 3 + 1], "fn": out[:, i * 3 + 2]}) for i, (m, q) in enumerate(names)]
        return pd.concat(parts)

    schema = f"replicate long, method {kinds['method']}, metric {kinds['metric']}, tp long, fp long, fn long"
    drawn = once.withColumn("_b", at).groupBy("_b").applyInPandas(sums, schema)
    total = drawn.groupBy("replicate", "method", "metric").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return total.select("replicate", "method", "metric", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "tp", "fp", "fn")


def range_draws(upto: np.ndarray, b: int, depth: int, replicates: int, seed: int) -> np.ndarray:
    """Draws that fall to range b in every replicate; ``upto`` holds running document counts."""
    draws = np.full(replicates, upto[-1], dtype=np.int64)
    lo, hi = 0, 1 << depth
    for level in range(depth):
        mid = (lo + hi) // 2
        size = upto[hi] - upto[lo]
        left = np.random.default_rng([seed, 0, level, lo]).binomial(draws, (upto[mid] - upto[lo]) / size if size else 0.0)
        draws, lo, hi = (left, lo, mid) if b < mid else (draws - left, mid, hi)
    return draws


def intervals(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile intervals (linear) of F1 per method and metric."""
    lo = (1 - level) / 2
    return samples.groupBy("method", "metric").agg(F.percentile("f1", F.lit(lo)).alias("low"), F.percentile("f1", F.lit(1 - lo)).alias("high"), F.avg("f1").alias("mean"))


def differences(samples: DataFrame, reference: str, level: float = 0.95) -> DataFrame:
    """Reference minus each other method: interval, share of replicates where the reference is
    greater (ties count half), share of ties."""
    lo = (1 - level) / 2
    ref = samples.where(F.col("method") == reference).select("replicate", "metric", F.col("f1").alias("ref"))
    d = samples.where(F.col("method") != reference).join(ref, ["replicate", "metric"]).withColumn("d", F.col("ref") - F.col("f1"))
    better = F.avg(F.when(F.col("d") > 0, 1.0).when(F.col("d") == 0, 0.5).otherwise(0.0))
    return d.groupBy("method", "metric").agg(F.percentile("d", F.lit(lo)).alias("low"), F.percentile("d", F.lit(1 - lo)).alias("high"), better.alias("p_greater"), F.avg((F.col("d") == 0).cast("double")).alias("p_tie"))


def randomization(counts: DataFrame, a: str, b: str, rounds: int = 1000, seed: str = "0") -> DataFrame:
    """(metric, observed, p_value): two-sided label swapping by document, plus-one p value.

    The unrounded difference is the threshold, with a tolerance of 1e-15."""
    side = {m: counts.where(F.col("method") == m).select("metric", "doc_id", *(F.col(c).alias(f"{c}_{k}") for c in ("tp", "fp", "fn"))) for m, k in ((a, "a"), (b, "b"))}
    both = side[a].join(side[b], ["metric", "doc_id"], "full_outer").na.fill(0)
    trials = both.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))  # round 0 is the data as they are
    key = F.concat_ws(":", F.lit(seed), F.col("round").cast("string"), F.col("doc_id").cast("string"))
    swap = (F.col("round") > 0) & (keyed_number(key) % 2 == 1)
    pick = [F.sum(F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{k}"))).alias(f"{c}_{k}") for c in ("tp", "fp", "fn") for k, o in (("a", "b"), ("b", "a"))]
    sums = trials.groupBy("metric", "round").agg(*pick)
    f = sums.select("metric", "round", (_f1(F.col("tp_a"), F.col("fp_a"), F.col("fn_a")) - _f1(F.col("tp_b"), F.col("fp_b"), F.col("fn_b"))).alias("d"))
    seen = f.where("round = 0").select("metric", F.col("d").alias("observed"))
    out = f.where("round > 0").join(F.broadcast(seen), "metric").groupBy("metric", "observed").agg(F.count_if(F.abs("d") >= F.abs("observed") - 1e-15).alias("hits"))
    return out.select("metric", "observed", ((F.col("hits") + 1) / F.lit(rounds + 1)).alias("p_value"))


def repeat_summary(runs: DataFrame, baseline: str, drop: float = 0.02) -> DataFrame:
    """Per method the mean and population deviation of its score over repeats, the mean
    paired gain on the baseline, repeats with a gain, and repeats with a large drop."""
    base = runs.where(F.col("method") == baseline).select("repeat", F.col("score").alias("base"))
    j = runs.join(F.broadcast(base), "repeat", "left").withColumn("gain", F.col("score") - F.col("base"))
    return j.groupBy("method").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.avg("gain").alias("gain"), F.count_if(F.col("gain") > 0).alias("n_positive"), F.count_if(F.col("gain") < -drop).alias("n_large_drop"))


def guardrails(by_type: DataFrame, baseline: str, target: str, most_drop: float = 0.02, least_recall: float = 0.0, least_gain: float = 0.0) -> DataFrame:
    """Per method whether no type's F1 falls by over ``most_drop``, no recall is under its
    floor, and the target type gains at least ``least_gain``."""
    base = by_type.where(F.col("method") == baseline).select("type", F.col("f1").alias("base"))
    j = by_type.join(F.broadcast(base), "type", "left").withColumn("gain", F.col("f1") - F.coalesce("base", F.lit(0.0)))
    return j.groupBy("method").agg(
        F.bool_and(F.col("gain") >= -most_drop).alias("keeps_f1"), F.bool_and(F.col("recall") >= least_recall).alias("keeps_recall"),
        F.bool_and(F.when(F.col("type") == target, F.col("gain") >= least_gain).otherwise(True)).alias("gains"), F.min("gain").alias("worst"))


def paired_gates(runs: DataFrame, baseline: str, rules: DataFrame, share: float = 2 / 3) -> DataFrame:
    """Per method and metric of repeated runs (method, metric, repeat, score) the mean,
    population deviation and paired gains on the baseline, and whether the metric's rule holds.

    rules: (metric, least_gain, floor, large_drop, most_large_drops), null values asking nothing. A
    rule holds if the mean gain reaches least_gain, gains are positive (at a least_gain of 0: not
    negative) in at least ``share`` of the repeats and in one, the mean reaches the floor, and at
    most so many repeats fall by over large_drop. A metric without a rule holds; a repeat that
    the baseline lacks has no gain and counts as not positive."""
    tiny = 1e-12
    base = runs.where(F.col("method") == baseline).groupBy("metric", "repeat").agg(F.avg("score").alias("base"))
    j = runs.join(base, ["metric", "repeat"], "left").join(F.broadcast(rules), "metric", "left").withColumn("gain", F.col("score") - F.col("base"))
    positive = F.when(F.col("least_gain") == 0, F.col("gain") >= -tiny).otherwise(F.col("gain") > 0)
    of_rule = ["least_gain", "floor", "large_drop", "most_large_drops"]
    out = j.groupBy("method", "metric", *of_rule).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), F.avg("gain").alias("gain"),
        F.count_if(positive).alias("n_positive"), F.count_if(F.col("gain") < -F.col("large_drop")).alias("n_large_drop"))
    enough = F.col("n_positive") >= F.greatest(F.lit(1), F.ceil(F.col("n") * share - tiny))
    gains = F.when(F.col("least_gain").isNotNull(), F.coalesce((F.col("gain") + tiny >= F.col("least_gain")) & enough, F.lit(False))).otherwise(True)
    holds = F.when(F.col("floor").isNotNull(), F.col("mean") + tiny >= F.col("floor")).otherwise(True) & F.when(F.col("most_large_drops").isNotNull(), F.col("n_large_drop") <= F.col("most_large_drops")).otherwise(True)
    return out.select("method", "metric", "n", "mean", "deviation", "gain", "n_positive", "n_large_drop", gains.alias("gains"), holds.alias("holds"), (gains & holds).alias("passes"))
