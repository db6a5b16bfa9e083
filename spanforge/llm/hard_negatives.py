"""Hard-negative mining (11): anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster, every row gets an upper bound of its score
with any member: its norm times the cosine of what is left of its angle to the centre after
the cluster's widest angle is taken off. Rows are sorted by that bound once for the cluster,
and every member walks the same list, block by block, until the bound of the next row shows
that no later row can change its result.

Rows are dealt to shards by a hash of their id and anchors to blocks of whole or parted
clusters; each pair of a block and a shard is a group of bounded size, with its lists in its
own task, and the best of the shards are merged by rank. Nothing but the centres (fitted on at
most ``FIT_ANCHORS`` anchors; they change the cost, not the result) passes through the driver.

Edge cases: rows with a null id, label or vector, or a component that is null or not finite,
take no part; of rows that repeat an id one stays (smallest label, then smallest vector);
vectors shorter than the longest count as filled up with zeros; scores are exact whole numbers
and an error is raised if one does not fit a long; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Anchors that the centres are fitted on, and centres.
FIT_ANCHORS, CLUSTERS = 10_000, 64
#: Bounds of a group: anchors of a block, rows of a shard (on average, both dealt by hash).
BLOCK_ANCHORS, SHARD_ROWS = 8_192, 65_536
_EXACT = 2**53
_NEVER = -(2**63)


def quantized(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, label, vec): every valid row once, components floor(scale * x)."""

    def run(batches):
        for b in batches:
            sizes = b.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = b.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])  # nulls are NaN here
            ends = np.cumsum(sizes)
            keep = pa.array((odd[ends] == odd[ends - sizes]) & b.column(2).is_valid().to_numpy(zero_copy_only=False))
            vec = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.floor(scale * flat)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec], names=["id", "label", "vec"]).filter(keep)

    valid = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null and v is not null")
    out = valid.mapInArrow(run, "id long, label long, vec array<double>")
    return out.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")


# ---- clusters -------------------------------------------------------------------------------
def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as an array of ``dim`` columns, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim))
    first = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(first, sizes)] = flat
    return out


def _directions(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def fit_centres(sample: np.ndarray, most: int = CLUSTERS, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from evenly spread rows of the sample."""
    d = _directions(sample)
    k = max(1, min(most, len(d) // 16))
    centres = d[np.linspace(0, len(d) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        mine = (d @ centres.T).argmax(1)
        for c in range(k):
            if (mine == c).any():
                centres[c] = _directions(d[mine == c].sum(0)[None])[0]
    return centres


def clustered(rows: DataFrame, is_anchor: Column, dim: int) -> tuple[DataFrame, np.ndarray, int]:
    """Stored anchors (anchor_id, label, vec, cluster, block), the centres, the number of blocks."""
    anchors = rows.where(is_anchor)
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(FIT_ANCHORS).select("vec").toArrow()
    centres = fit_centres(_matrix(sample["vec"], dim)) if sample.num_rows else np.zeros((1, dim))

    def run(batches):
        for b in batches:
            mine = (_directions(_matrix(b.column(2), dim)) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mine, pa.int32())], names=["anchor_id", "label", "vec", "cluster"])

    found = materialize(anchors.mapInArrow(run, "anchor_id long, label long, vec array<double>, cluster int"), "anchors")
    counts = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # at most CLUSTERS rows
    before = np.cumsum([0, *(counts.get(c, 0) for c in range(len(centres)))]).tolist()
    at = F.element_at(F.array(*map(F.lit, before)), F.col("cluster") + 1)
    size = F.element_at(F.array(*[F.lit(max(1, counts.get(c, 0))) for c in range(len(centres))]), F.col("cluster") + 1)
    block = F.floor((at + F.pmod(F.xxhash64("anchor_id"), size)) / BLOCK_ANCHORS).cast("int")
    return found.withColumn("block", block), centres, before[-1] // BLOCK_ANCHORS + 1


# ---- lists and walks --------------------------------------------------------------------------
def shared_list(vectors: np.ndarray, members: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by falling bound, and the bounds for a member of norm one."""
    norm = np.sqrt((vectors * vectors).sum(1))
    cos_row = np.clip(np.divide(vectors @ centre, norm, out=np.zeros(len(norm)), where=norm > 0), -1, 1)
    widest = np.arccos(np.clip((_directions(members) @ centre).min(), -1, 1))
    bound = norm * (np.cos(np.maximum(0, np.arccos(cos_row) - widest)) + 1e-6)  # more than rounding takes away
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class _Keys:
    """Scores and ids of a shard in one sortable number: higher scores first, then smaller ids."""

    def __init__(self, anchors: np.ndarray, vectors: np.ndarray, ids: np.ndarray):
        self.base, self.rank = len(ids) + 1, np.empty(len(ids), np.int64)
        self.by_rank = np.sort(ids)
        self.rank[np.argsort(ids)] = len(ids) - np.arange(len(ids))
        most = anchors.shape[1] * float(np.abs(anchors).max(initial=0)) * float(np.abs(vectors).max(initial=0))
        self.plain = most < _EXACT and most * 100 * self.base < 2**62
        if self.plain:
            self.anchors, self.vectors, self.never = anchors, vectors, _NEVER
        else:  # whole numbers of any size
            whole = np.frompyfunc(int, 1, 1)
            self.anchors, self.vectors, self.never = whole(anchors), whole(vectors), -(10**700)

    def scores(self, who: np.ndarray, what: np.ndarray) -> np.ndarray:
        s = self.anchors[who] @ self.vectors[what].T
        return s.astype(np.int64) if self.plain else s

    def keys(self, scores: np.ndarray, what: np.ndarray) -> np.ndarray:
        return scores * self.base + (self.rank[what] if self.plain else self.rank[what].astype(object))

    def best(self, keys: np.ndarray, k: int) -> np.ndarray:
        """The k largest of each row, in rising order."""
        if self.plain and keys.shape[1] > 4 * k:
            keys = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:]
        return np.sort(keys, axis=1)[:, -k:]

    def score(self, keys: np.ndarray) -> np.ndarray:
        return keys // self.base

    def id(self, keys: np.ndarray) -> np.ndarray:
        return self.by_rank[len(self.by_rank) - (keys % self.base).astype(np.int64)]


def walk_group(anchors: pa.Table, rows: pa.Table, centres: np.ndarray, dim: int, positives: int = 0, negatives: int = 0, low: int = 50, high: int = 95) -> list[tuple]:
    """The shard's best rows for the anchors of a block: (anchor_id, id, score) of the first
    ``positives`` rows of the same label, or (anchor_id, positive_id, positive_score, id, score)
    of the first ``negatives`` rows of another label, for each of the anchor's positives, with
    low * positive_score <= 100 * score <= high * positive_score."""
    if not anchors.num_rows or not rows.num_rows:
        return []
    u, v = _matrix(anchors["vec"], dim), _matrix(rows["vec"], dim)
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    names, mine, cluster = (anchors[c].to_numpy() for c in ("anchor_id", "label", "cluster"))
    keys, norm, out = _Keys(u, v, ids), np.sqrt((u * u).sum(1)), []
    if negatives:
        pos = anchors["positives"].to_pylist()
        slots = max(map(len, pos))
        limit = np.full((len(u), slots), -1, np.int64 if keys.plain else object)  # no row is in a band below zero
        for k, x in enumerate(pos):
            limit[k, : len(x)] = [p["score"] for p in x]
        top = np.full((len(u), slots, negatives), keys.never, limit.dtype)
    else:
        top = np.full((len(u), positives), keys.never, np.int64 if keys.plain else object)
    for c in np.unique(cluster):
        who = np.flatnonzero(cluster == c)
        order, bound = shared_list(v, u[who], centres[c])
        at, step = 0, 512
        while len(who) and at < len(order):
            what = order[at : at + step]
            at, step = at + len(what), min(4096, 2 * step)
            s = keys.scores(who, what)
            k = keys.keys(s, what)
            same = mine[who][:, None] == labels[what][None]
            if negatives:
                for j in range(slots):
                    p = limit[who, j][:, None]
                    in_band = ~same & (p >= 0) & (low * p <= 100 * s) & (100 * s <= high * p)
                    top[who, j] = keys.best(np.concatenate([top[who, j], np.where(in_band, k, keys.never)], axis=1), negatives)
                # done when every band is full or the bound is below it
                need = np.maximum(keys.score(top[who][:, :, 0]), -(-low * limit[who] // 100))
                need = np.where(limit[who] >= 0, need, 2**62).min(1)
            else:
                other = names[who][:, None] != ids[what][None]
                top[who] = keys.best(np.concatenate([top[who], np.where(same & other, k, keys.never)], axis=1), positives)
                need = keys.score(top[who][:, 0])
            if at < len(order):
                who = who[norm[who] * bound[at] >= need.astype(float)]
    found = top != keys.never
    for x in zip(*np.nonzero(found)):
        key = top[x]
        score, i = int(key) // keys.base, int(keys.by_rank[len(ids) - int(key) % keys.base])
        if negatives:
            p = pos[x[0]][x[1]]
            out.append((int(names[x[0]]), p["id"], p["score"], i, score))
        else:
            out.append((int(names[x[0]]), i, score))
    return out


def _search(anchors: DataFrame, rows: DataFrame, blocks: int, shards: int, names: list[str], centres: np.ndarray, dim: int, **how) -> DataFrame:
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(key, left, right):
        found = walk_group(left, right, centres, dim, **how)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * len(names), schema=schema)

    left = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def _first(df: DataFrame, by: list[str], score: str, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over the rows of
    quantized(): for each anchor and each of its first positives the first negatives whose score
    is between low and high hundredths of the positive's."""
    spark = rows.sparkSession
    rows = materialize(rows, "vectors")
    n, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    dim = max(1, dim or 1)
    anchors, centres, blocks = clustered(rows, is_anchor, dim)
    shards = max(-(-n // SHARD_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = _search(anchors, rows, blocks, shards, ["anchor_id", "id", "score"], centres, dim, positives=positives)
    pos = _first(found, ["anchor_id"], "score", "id", positives)
    pos = materialize(pos.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _search(anchors.join(pos, "anchor_id"), rows, blocks, shards, names, centres, dim, negatives=negatives, low=low, high=high)
    out = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
