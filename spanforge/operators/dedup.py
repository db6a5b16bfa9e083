"""Duplicates and leakage across splits."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textscan import shingles


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; for local masters without one, the warehouse.

    On a cluster a warehouse that names no store is a folder of each machine, which others do not
    see: an error says so."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and (where.startswith("file:") or "://" not in where):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where.rstrip("/") + "/stages"


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the folder that all executors share."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def family(doc_id, pattern: str = r"^([a-z]{2}\d{2}-\d{3})[a-z]?"):
    """The family of an id such as aa22-249a; other ids are their own."""
    f = F.regexp_extract(doc_id.cast("string"), pattern, 1)
    return F.when(f == "", doc_id.cast("string")).otherwise(f)


def split_overlap(splits: DataFrame) -> DataFrame:
    """(kind, key, n_splits) of ids and families that occur in more than one split."""
    ids = splits.select(F.lit("id").alias("kind"), F.col("doc_id").cast("string").alias("key"), "split")
    fams = splits.select(F.lit("family").alias("kind"), family(F.col("doc_id")).alias("key"), "split")
    return ids.union(fams).groupBy("kind", "key").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def normal_text(text):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def exact_groups(docs: DataFrame, splits: DataFrame, text: str = "text") -> DataFrame:
    """(digest, n_docs, n_splits, first_doc) of equal texts up to case and blanks."""
    rows = docs.select("doc_id", F.sha2(normal_text(F.col(text)), 256).alias("digest")).join(splits, "doc_id")
    per = rows.groupBy("digest", "split").agg(F.count("*").alias("c"), F.min("doc_id").alias("m"))
    return per.groupBy("digest").agg(F.sum("c").alias("n_docs"), F.count("*").alias("n_splits"), F.min("m").alias("first_doc")).where("n_docs > 1")


def near_pairs(docs: DataFrame, threshold: float = 0.75, size: int = 5, text: str = "text") -> DataFrame:
    """D3: (a, b, jaccard), a < b: representatives of different shingle sets whose Jaccard
    ratio reaches the threshold.

    Equal sets are one representative (their smallest id; see ``near_members``), so a group of
    copies is one row. Sets without shingles are equal to each other only."""
    return _near(stored(near_members(docs, size, text)), threshold)


#: One document in SAMPLE tells which shingles are common: those of HOT sampled ones and more, at most MOST_HOT.
SAMPLE, HOT, MOST_HOT = 8, 2, 1_000_000
#: Sets whose prefixes are taken at once.
SETS = 512


def _near(members: DataFrame, threshold: float) -> DataFrame:
    """near_pairs of stored members. The inverted index holds the first |A| - ceil(t |A|) + 1 shingles
    of each set in one order (the prefix that any partner must share): those that a sample of the
    documents holds most often come last, which changes the cost and not the result. Sizes and
    places in that order bound the candidates, and pairs are verified on whole sets."""
    common = _common(members)
    prefix = members.where("n > 0").select("signature", "hashes").mapInArrow(_prefixes(members.sparkSession, common, threshold), "g long, signature long, n int, pos int")
    # dealt by shingle once: copies become one row, and shingles of one set only go
    once = prefix.repartition("g").groupBy("g", "signature").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    shared = stored(once.withColumn("_c", F.count("*").over(Window.partitionBy("g"))).where("_c > 1").drop("_c"))
    x, y = shared.alias("x"), shared.alias("y")
    lesser, greater = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    # of the first shingle that two sets share, no more than what follows can be shared too
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    may = (lesser >= F.lit(threshold) * greater - 1e-9) & (most * F.lit(1 + threshold) >= F.lit(threshold) * (lesser + greater) - 1e-6)
    cand = stored(x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.signature") < F.col("y.signature")) & may).select(F.col("x.signature").alias("x"), F.col("y.signature").alias("y")).distinct())
    asked = cand.select(F.col("x").alias("signature")).union(cand.select("y")).distinct()
    rep = stored(members.groupBy("signature").agg(F.min("doc_id").alias("doc_id")).join(asked, "signature"))
    sets = stored(members.select("signature", "doc_id", "hashes").join(rep, ["signature", "doc_id"]))
    side = lambda k: sets.select(F.col("signature").alias(k), F.col("doc_id").alias(f"d{k}"), F.col("hashes").alias(f"h{k}"))
    inter = F.size(F.array_intersect("hx", "hy"))
    j = cand.join(side("x"), "x").join(side("y"), "y").select("dx", "dy", (inter / (F.size("hx") + F.size("hy") - inter)).alias("jaccard"))
    return j.where(F.col("jaccard") >= threshold).select(F.least("dx", "dy").alias("a"), F.greatest("dx", "dy").alias("b"), "jaccard")


def _common(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample, ascending, and how many of its documents hold each."""
    some = members.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.explode("hashes").alias("g"))
    got = some.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= HOT).orderBy(F.desc("c"), "g").limit(MOST_HOT).toArrow()
    g, c = (got[k].to_numpy() for k in ("g", "c"))
    order = np.argsort(g)
    return g[order], c[order]


def _prefixes(spark: SparkSession, common: tuple[np.ndarray, np.ndarray], threshold: float):
    """Rows (signature, hashes) to rows (g, signature, n, pos) of the prefixes."""
    sent = spark.sparkContext.broadcast(common)

    def run(batches):
        late, counts = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, SETS):
                b = whole.slice(at, SETS)
                n = pc.list_value_length(b["hashes"]).to_numpy(zero_copy_only=False).astype(np.int64)
                g = b["hashes"].flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                c = np.zeros(len(g), np.int64)
                if len(late):
                    k = np.minimum(np.searchsorted(late, g), len(late) - 1)
                    c = np.where(late[k] == g, counts[k], 0)
                order = np.lexsort((g, c, row))  # stays within rows, which are in order already
                pos = np.arange(len(g)) - (np.cumsum(n) - n)[row]
                keep = pos < (n - np.ceil(threshold * n - 1e-9) + 1)[row]
                cols = [pa.array(g[order][keep]), b["signature"].take(pa.array(row[keep])), pa.array(n[row][keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "signature", "n", "pos"])

    return run


def near_members(docs: DataFrame, size: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, n, hashes, signature): shingle sets, equal ones under one signature."""
    s = shingles(docs, size, text)
    return s.withColumn("signature", F.xxhash64(F.array_sort("hashes"), "n"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100, save=stored) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reached.

    Alternating large-star and small-star steps until nothing changes: each is one grouped
    minimum (combined before the shuffle, so a hub costs one row a task) and one equi-join that
    AQE may split. Every round is a table in the shared folder; only the two sums that tell
    whether a round changed anything reach the driver. Too few ``rounds`` raise an error."""
    e = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: a neighbour above u goes to the minimum of u's neighbourhood
        e = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = e.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = save(small.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = e.select("u", "v").union(e.select("v", "v"))
            return nodes.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def duplicate_groups(docs: DataFrame, threshold: float = 0.75, size: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, group_id): families and near pairs joined transitively; group_id is the
    smallest id. Near-duplicate links join documents below the threshold too, by design."""
    members = stored(near_members(docs, size, text))
    rep = members.groupBy("signature").agg(F.min("doc_id").alias("rep"))
    chain = members.join(rep, "signature").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    fam = docs.select("doc_id", family(F.col("doc_id")).alias("f"))
    head = fam.groupBy("f").agg(F.min("doc_id").alias("head"))
    by_family = fam.join(head, "f").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    comp = components(_near(members, threshold).select("a", "b").union(chain).union(by_family))
    return docs.select("doc_id").join(comp, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("group_id"))


def leakage(docs: DataFrame, splits: DataFrame, threshold: float = 0.75, text: str = "text") -> DataFrame:
    """D3 across splits: (group_id, n_docs, n_splits) of duplicate groups that span splits."""
    g = duplicate_groups(docs, threshold, text=text).join(splits, "doc_id")
    return g.groupBy("group_id").agg(F.count("*").alias("n_docs"), F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, size: int = 5) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least ``threshold`` of the shingles of
    a benchmark item. Equal-key join on shingles; only the benchmark's own can match."""
    items = shingles(benchmark.select(F.col("item_id").alias("doc_id"), "text"), size)
    b = items.select(F.col("doc_id").alias("item_id"), F.col("n").alias("n_item"), F.explode_outer("hashes").alias("g"))
    # explode infers a filter on the array, which is pushed below the words' projection and would
    # split the text again for every shingle; explode_outer infers none, and the join drops nulls
    d = shingles(docs, size).select("doc_id", F.explode_outer("hashes").alias("g"))
    hit = d.join(b, "g").groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("k"))
    return hit.select("doc_id", "item_id", (F.col("k") / F.col("n_item")).alias("share")).where(F.col("share") >= threshold)


def diversity(variants: DataFrame, key: str, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Per key the largest and mean token-set Jaccard ratio among its variants, and whether
    the largest stays below the threshold. Variants of one key are few by nature."""
    t = variants.select(key, F.monotonically_increasing_id().alias("i"), F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")).alias("w"))
    t = stored(t)
    a, b = t.select(key, F.col("i").alias("ia"), F.col("w").alias("wa")), t.select(key, F.col("i").alias("ib"), F.col("w").alias("wb"))
    j = F.size(F.array_intersect("wa", "wb")) / F.greatest(F.size(F.array_union("wa", "wb")), F.lit(1))
    return a.join(b, key).where("ia < ib").groupBy(key).agg(F.max(j).alias("largest"), F.avg(j).alias("mean"), (F.max(j) < threshold).alias("diverse"))


def dedup_and_sample(rows: DataFrame, text: str, n: int, seed: str = "0") -> DataFrame:
    """One row a text without blanks, then a keyed-hash sample of n."""
    from ..functions.text import keyed_number

    sig = F.md5(F.regexp_replace(text, r"\s+", ""))
    once = rows.withColumn("_sig", sig).dropDuplicates(["_sig"])
    return once.orderBy(keyed_number(F.concat(F.lit(seed + ":"), "_sig")), "_sig").limit(n).drop("_sig")


def union_first(primary: DataFrame, supplement: DataFrame) -> DataFrame:
    """Both tables, a span, type and surface once, the primary row winning."""
    both = primary.withColumn("_o", F.lit(0)).unionByName(supplement.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("doc_id", "start", "end", "type", "surface").orderBy("_o")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_o", "_r")
