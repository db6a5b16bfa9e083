"""SimHash near-dedup (8): BK-trees over shards of 64-bit fingerprints.

Fingerprints are first made distinct. Two that differ in at most ``radius`` = 4 bits agree
on at least two of six blocks of bits, so each is sent to the fifteen shards named by a pair
of blocks, and any linked pair meets in some shard. A shard's members form a BK-tree: a
node's children are keyed by their integer Hamming distance to it, and a search follows only
the edges within the radius. All members search at once, so a node costs one array step.
A shard tree lives in the task that owns its shard (all trees together grow with the corpus,
so they are not broadcast to everyone); it emits only links that join what was apart.
A shard with more than ``SHARD_ROWS`` members is cut again by pairs of blocks of the bits
that it does not share yet, until it fits; no row or link is dropped on the way.

Edge cases: a null or empty text has fingerprint zero and links like any other; short texts
are one shingle; a null id never becomes a component id unless all ids of the component are
null; repeated rows give a row each; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, connected_components, materialize

RADIUS, SHINGLE, SEED = 4, 4, 42
SAME = 2  # of radius + SAME blocks, SAME are untouched by radius changes
SHARD_ROWS = 4096
_CHUNK = 1 << 16


def shingle_hashes(raw: bytes, shingle: int = SHINGLE):
    """XXH64 of every shingle, in arrays of bounded size."""
    words = raw.translate(LOWER_AZ).split()
    if not words:
        return
    text = b" ".join(words)
    if len(words) <= shingle:
        yield np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
        return
    ends = list(accumulate(map((1).__add__, map(len, words))))  # one past the blank after each word
    hashed, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    starts = [0, *ends[: n - 1]]
    for k in range(0, n, _CHUNK):
        yield np.array([hashed(text[a : b - 1], SEED) for a, b in zip(starts[k : k + _CHUNK], ends[k + shingle - 1 : k + shingle - 1 + _CHUNK])], np.uint64)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if set in over half of the shingles' XXH64."""
    return of_hashes(shingle_hashes(raw, shingle))


def of_hashes(parts) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, row_key, fp): a hash of the text, and the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in b.column(2).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id", "row_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, row_key long, fp long")


# ---- BK-tree ------------------------------------------------------------------------------
def bk_tree(fp: np.ndarray) -> dict | None:
    """{"at": index, "next": {distance: subtree}} over distinct fingerprints."""
    root: dict = {}
    todo = [(root, np.arange(len(fp)))] if len(fp) else []
    while todo:
        node, members = todo.pop()
        node["at"], node["next"], rest = int(members[0]), {}, members[1:]
        if len(rest):
            d = np.bitwise_count(fp[rest] ^ fp[node["at"]])
            order = np.argsort(d, kind="stable")
            d, rest = d[order], rest[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for part, dist in zip(np.split(rest, cuts), d[np.r_[0, cuts]]):
                node["next"][int(dist)] = child = {}
                todo.append((child, part))
    return root or None


def search(tree: dict | None, fp: np.ndarray, queries: np.ndarray, radius: int):
    """Yields (node index, indices of ``queries`` within the radius of that node)."""
    todo = [(tree, np.arange(len(queries)))] if tree else []
    while todo:
        node, asking = todo.pop()
        d = np.bitwise_count(queries[asking] ^ fp[node["at"]]).astype(np.int64)
        yield node["at"], asking[d <= radius]
        for edge, child in node["next"].items():
            near = asking[np.abs(d - edge) <= radius]
            if len(near):
                todo.append((child, near))


def shard_links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs within the radius, as few as join the same members."""
    if len(fp) == 2:
        return [(0, 1)] if int(fp[0] ^ fp[1]).bit_count() <= radius else []
    links, part = [], np.arange(len(fp))
    for at, hits in search(bk_tree(fp), fp, fp, radius):
        labels, first = np.unique(part[hits], return_index=True)
        if len(labels) > 1:
            mine = part[at]
            links += [(at, int(hits[k])) for lab, k in zip(labels, first) if lab != mine]
            part[np.isin(part, labels)] = labels[0]
    return links


def _masks(used: int, radius: int) -> list[int]:
    """For the bits not in ``used``: the pairs out of radius + 2 blocks, each joined with used."""
    bits = [b for b in range(64) if not used >> b & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, radius + SAME)]
    return [used | blocks[i] | blocks[j] for i in range(len(blocks)) for j in range(i)]


def _sharded(rows: DataFrame, radius: int) -> DataFrame:
    """(mask, key, fp): a row for each finer shard of each (mask, fp)."""

    def run(batches):
        for b in batches:
            used, fp = (b.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            for u in np.unique(used):
                mine = fp[used == u]
                for m in _masks(int(u), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), m, np.uint64).view(np.int64)), pa.array((mine & np.uint64(m)).view(np.int64)), pa.array(mine.view(np.int64))], names=["mask", "key", "fp"])

    return rows.mapInArrow(run, "mask long, key long, fp long")


def _linked(shards: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b, mask): links inside shards, with mask null; or, of shards over ``most``, their rows (a = b, with the mask)."""

    def run(batches):
        held: list[np.ndarray] = []  # the rows of the shard that may go on in the next batch
        n, last, spilling, limit = 0, None, False, most

        def close(parts):
            fp = np.concatenate(parts)
            return [(int(fp[a].view(np.int64)), int(fp[b].view(np.int64))) for a, b in shard_links(fp, radius)]

        for b in batches:
            mask, key, fp = (b.column(k).to_numpy() for k in range(3))
            if not len(fp):
                continue
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            links, over, over_mask = [], [], []
            for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
                name = (mask[s], key[s])
                if k or name != last:
                    if held and n > 1 and not spilling:
                        links += close(held)
                    held, n, spilling = [], 0, False
                last = name
                # too few bits left to cut: at most 2 ** 5 members, which stay together
                limit = most if 64 - int(np.bitwise_count(mask[s : s + 1].view(np.uint64))[0]) >= radius + SAME else 1 << 32
                if e - s == 1 and e < len(fp) and not n:
                    continue  # alone in its shard
                n += e - s
                held.append(fp[s:e])
                if n > limit:
                    over += held
                    over_mask += [np.full(len(x), name[0]) for x in held]
                    held, spilling = [np.empty(0, np.uint64)], True
            if links:
                a = np.array(links, np.int64)
                yield _batch(a[:, 0], a[:, 1], None)
            if over:
                a = np.concatenate(over).view(np.int64)
                yield _batch(a, a, np.concatenate(over_mask))
        if held and n > 1 and not spilling and (links := close(held)):
            a = np.array(links, np.int64)
            yield _batch(a[:, 0], a[:, 1], None)

    return shards.mapInArrow(run, "a long, b long, mask long")


def _batch(a, b, mask):
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if mask is None else pa.array(mask, pa.int64())], names=["a", "b", "mask"])


def links(distinct_fps: DataFrame, radius: int = RADIUS, most: int = SHARD_ROWS) -> DataFrame:
    """(a, b): fingerprints within the radius, enough of them to join every component."""
    out, rows = None, distinct_fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while rows is not None:
        shards = _sharded(rows, radius)
        shards = shards.repartition("mask", "key").sortWithinPartitions("mask", "key")
        made = materialize(_linked(shards, radius, most), "links")
        part = made.where("mask is null").select("a", "b")
        out = part if out is None else out.union(part)
        rest = made.where("mask is not null").select("mask", F.col("a").alias("fp")).distinct()
        rows = rest if rest.take(1) else None
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, most: int = SHARD_ROWS) -> DataFrame:
    """(id, row_key, fp, component_id) for every row; component_id is the smallest id reachable."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    parts = connected_components(links(distinct, radius, most))
    named = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "members")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = materialize(named.join(least, "component").select(F.col("fp").alias("f"), "component_id"), "labels")
    return rows.join(label, F.col("fp") == F.col("f")).select("id", "row_key", "fp", "component_id")
