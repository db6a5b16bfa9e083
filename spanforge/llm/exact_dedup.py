"""Exact dedup (3): binary-fuse filters over an immutable snapshot screen a new batch.

A snapshot is stored as exact buckets (one row a digest) and, for each shard of digests, one
static binary-fuse filter. An incoming digest is first held against its shard's filter;
only the positives are joined with the exact buckets. Duplicates inside the new batch are
grouped on their own. Every bucket with more than one row is then checked byte for byte
(its smallest and its largest text must be the same); a bucket that fails, that is a digest
collision, is split by the texts themselves.

Edge cases: a null text counts as empty; rows that repeat the same id and text have one kept
row; a null id is smaller than any other; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, materialize

KEYS_PER_SHARD = 200_000


# ---- binary-fuse filter, 3-wise, 8-bit fingerprints -------------------------------------
def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _slots(keys: np.ndarray, seed: int, segment: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(windows * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, windows, fingerprints) of distinct uint64 keys.

    Slots with one key are peeled round by round; fingerprints are then filled in from the
    last round to the first. All keys of a round are independent, so a round is one array step."""
    n = len(keys)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    windows = max(1, -(-int(n * factor) // segment) - 2)
    for seed in range(1, 200):
        slots, marks = _slots(keys, seed, segment, windows)
        size = (windows + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        xor = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(xor, row, np.arange(n))
        rounds, alone = [], np.flatnonzero(count == 1)
        while len(alone):
            key, at = np.unique(xor[alone], return_index=True)
            rounds.append((key, alone[at]))
            for row in slots[:, key]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(xor, row, key)
            touched = np.unique(slots[:, key])
            alone = touched[count[touched] == 1]
        if sum(len(k) for k, _ in rounds) == n:
            prints = np.zeros(size, np.uint8)
            for key, at in reversed(rounds):
                prints[at] = 0
                prints[at] = marks[key] ^ prints[slots[0, key]] ^ prints[slots[1, key]] ^ prints[slots[2, key]]
            return seed, segment, windows, prints.tobytes()
        if seed % 10 == 0:
            windows += max(1, windows // 8)
    raise ValueError("no seed peels these keys; are they distinct?")


def may_contain(built: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, segment, windows, prints = built
    slots, marks = _slots(keys, seed, segment, windows)
    p = np.frombuffer(prints, np.uint8)
    return (p[slots[0]] ^ p[slots[1]] ^ p[slots[2]]) == marks


def _numbers(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes.fromhex(d[:16].ljust(16, "0")) for d in digests), ">u8").astype(np.uint64)


# ---- the operator -------------------------------------------------------------------------
def digests(docs: DataFrame, id_col: str, text_col: str, with_text: bool = False) -> DataFrame:
    """(id, row_key, sha) of every row's text, A-Z in lower case, as UTF-8; with_text adds
    those bytes. row_key, a hash of the unchanged text, tells rows of one id apart."""

    def run(batches):
        for b in batches:
            norm = [(t or b"").translate(LOWER_AZ) for t in b.column(2).cast(pa.binary()).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([hashlib.sha256(t).hexdigest() for t in norm], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(norm, pa.binary())] if with_text else []), names=["id", "row_key", "sha", "bytes"][: 3 + with_text])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, row_key long, sha string" + ", bytes binary" * with_text)


def build_snapshot(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Exact buckets (key, top, n, shard) and filters (shard, seed, segment, windows, prints)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(np.unique(_numbers(pdf["key"])))
        return pd.DataFrame([[pdf["shard"].iloc[0], *made]], columns=["shard", "seed", "segment", "windows", "prints"])

    buckets = rows.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n")).withColumn("shard", _shard(shards))
    filters = buckets.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, seed int, segment int, windows int, prints binary")
    return buckets, filters


def _shard(shards: int):
    return F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows of ``batch`` (distinct keys, with their shard) that the snapshot's filters let pass."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0]
        f = right.iloc[0]
        return left[may_contain((int(f["seed"]), int(f["segment"]), int(f["windows"]), f["prints"]), _numbers(left["key"]))]

    return batch.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, batch.schema)


def exact_dedup(docs: DataFrame, in_snapshot: str, id_col: str = "doc_id", text_col: str = "text", key_chars: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, sha, row_key) for every row of ``docs``.

    ``in_snapshot`` is a SQL condition on ``id``: rows that meet it form the immutable
    snapshot, all others the new batch. key_chars: hex digits of the digest that make the
    bucket key (fewer only to test collisions)."""
    w = Window.partitionBy("id", "sha").orderBy("id")
    rows = digests(docs, id_col, text_col).withColumn("key", F.substring("sha", 1, key_chars))
    rows = rows.withColumn("again", F.row_number().over(w) > 1).withColumn("old", F.coalesce(F.expr(in_snapshot), F.lit(False)))
    rows = materialize(rows, "digests")
    n = rows.count()
    shards = max(12, -(-n // KEYS_PER_SHARD))
    buckets, filters = build_snapshot(rows.where("old"), shards)
    batch = rows.where("not old").groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n")).withColumn("shard", _shard(shards))
    buckets, batch = materialize(buckets, "buckets"), materialize(batch, "batch")

    # positives of the filters meet the exact buckets; the batch's own groups stay apart
    met = screen(batch, filters).select("key", "top", "n").join(buckets.select("key", F.col("top").alias("old_top"), F.col("n").alias("old_n")), "key")
    met = met.select("key", F.greatest("top", "old_top").alias("keep_id"), (F.col("n") + F.col("old_n")).alias("group_size"))
    met = materialize(met, "met")
    own = batch.where("n > 1").join(met, "key", "left_anti").union(buckets.where("n > 1").join(met, "key", "left_anti"))
    groups = met.union(own.select("key", F.col("top").alias("keep_id"), F.col("n").alias("group_size")))
    groups = materialize(groups, "groups")

    bad = _collided(docs, id_col, text_col, groups, key_chars)
    plain = rows.join(groups, "key", "left")
    if bad is not None:
        plain = rows.join(bad.select("key"), "key", "left_anti").join(groups, "key", "left")
    out = plain.select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "again", "sha", "row_key")
    if bad is not None:
        # the bucket held different texts: the full digest and the bytes decide
        texts = digests(docs, id_col, text_col, with_text=True).withColumn("key", F.substring("sha", 1, key_chars)).join(bad.select("key"), "key", "left_semi")
        same = texts.groupBy("bytes").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        split = texts.join(same, "bytes").withColumn("again", F.row_number().over(w) > 1)
        out = out.union(split.select("id", "keep_id", "group_size", "again", "sha", "row_key"))
    return out.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("again")).alias("kept"), "sha", "row_key")


def _collided(docs, id_col, text_col, groups, key_chars):
    """Keys whose rows do not all hold the same bytes; None if there is none.

    The rows of groups come by a join that AQE may split; two salted steps of minimum and
    maximum, combined before each shuffle, then compare a whole bucket's bytes."""
    texts = digests(docs, id_col, text_col, with_text=True).withColumn("key", F.substring("sha", 1, key_chars))
    texts = texts.join(groups.select("key").hint("merge"), "key", "left_semi").withColumn("salt", F.pmod(F.hash("id"), F.lit(64)))
    part = texts.select("key", "salt", "bytes").repartition("key", "salt").groupBy("key", "salt").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
    bad = part.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("key")
    bad = materialize(bad, "collided")
    return bad if bad.take(1) else None
