"""Rankings and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyed_number
from .dedup import stored
from .order import global_rank


def leaderboard(candidates: DataFrame, top: int) -> DataFrame:
    """Rank by reward, precision, shorter text, id; the first ``top`` are selected."""
    ranked = global_rank(candidates, [F.desc("reward"), F.desc("precision"), F.char_length("text"), "candidate_id"])
    return ranked.withColumn("decision", F.when(F.col("rank") <= top, "selected").otherwise("dropped"))


def final_choice(candidates: DataFrame) -> DataFrame:
    """The best eligible candidate by objective, micro F1, precision, shorter text, id; an
    error when none is eligible. Null scores come last."""
    down = [F.coalesce(-F.col(c), F.lit(float("inf"))).alias(c) for c in ("objective_f1", "micro_f1", "precision")]
    order = F.struct(*down, F.coalesce(F.char_length("text"), F.lit(0)).alias("n"), "candidate_id")
    best = candidates.where("eligible").agg(F.min_by(F.struct(*candidates.columns), order).alias("b"))
    return best.select(F.when(F.col("b").isNull(), F.raise_error(F.lit("no candidate is eligible"))).otherwise(F.col("b")).alias("b")).select("b.*")


def confidence_bounds(log: DataFrame, c: float = 1.0) -> DataFrame:
    """Per candidate of an evaluation log (candidate_id, tp, fp, fn, n) the reward (F1 of
    the sums) and reward + c sqrt(ln t / n), t being all evaluations; infinity when unseen."""
    s = log.groupBy("candidate_id").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn", "n")))
    t = F.lit(log.agg(F.sum("n")).first()[0] or 0)  # one number
    reward = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    bound = F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(reward + c * F.sqrt(F.log(F.greatest(t, F.lit(1))) / F.col("n")))
    return s.select("candidate_id", "n", reward.alias("reward"), bound.alias("bound"))


def error_windows(counts: DataFrame, boundary: DataFrame, kind: str) -> DataFrame:
    """T4: windows with errors of one type, by missed, boundary pairs, spurious, id."""
    c = counts.where(F.col("type") == kind).groupBy("doc_id", "w").agg(F.sum("fn").alias("missed"), F.sum("fp").alias("spurious"))
    b = boundary.where(F.col("type") == kind).groupBy("doc_id", "w").agg(F.count("*").alias("boundary"))
    rows = c.join(b, ["doc_id", "w"], "left").na.fill(0).where("missed + spurious > 0")
    return global_rank(rows, [F.desc("missed"), F.desc("boundary"), F.desc("spurious"), "doc_id", "w"])


def ranked_records(records: DataFrame, gates: dict[str, Column], order: list[Column]) -> DataFrame:
    """T5: records ranked inside those that pass every gate; failed gates are listed."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in gates.items())))
    rows = records.withColumn("failed", failed).withColumn("feasible", F.size("failed") == 0)
    return global_rank(rows.where("feasible"), order).unionByName(rows.where("not feasible"), allowMissingColumns=True)


def diverse_examples(errors: DataFrame, keys: list[str], limit: int = 4) -> DataFrame:
    """Up to ``limit`` a key, one of each document before any second one."""
    inner = F.row_number().over(Window.partitionBy(*keys, "doc_id").orderBy("start", "end"))
    outer = F.row_number().over(Window.partitionBy(*keys).orderBy("_in", "doc_id"))
    return errors.withColumn("_in", inner).where(F.col("_in") <= limit).withColumn("rank", outer).where(F.col("rank") <= limit).drop("_in")


def relations_first(samples: DataFrame, n: int) -> DataFrame:
    """N samples, those with relations first, else in their order (seq)."""
    return samples.orderBy(F.desc((F.col("n_relations") > 0).cast("int")), "seq").limit(n)


def stratified_split(groups: DataFrame, sizes: dict[str, float], strata: list[str], trials: int = 200, seed: str = "0") -> DataFrame:
    """(group_id, split): the best of ``trials`` random group orders.

    groups: (group_id, n_docs, and a count for each stratum). In each trial the groups are
    ordered by a keyed hash and cut where the running documents reach the splits' shares, so
    a group is never split. The score is the squared relative error of every stratum's share
    in every split, plus 1,000 for each split that misses a stratum; trial by trial it is a
    grouped sum, and one row names the winner."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("n_docs"), *(F.sum(s) for s in strata)).first()
    n, totals = total[0] or 0, dict(zip(strata, total[1:]))
    rows = groups.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    h = keyed_number(F.concat_ws(":", F.lit(seed), F.col("trial").cast("string"), F.col("group_id").cast("string")))
    w = Window.partitionBy("trial").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("n_docs").over(w)
    at, split, edge = 0.0, None, None
    for name, share in sizes.items():
        at += share
        edge = F.col("upto") <= at * n + 1e-9
        split = F.when(edge, name) if split is None else split.when(edge, name)
    rows = rows.withColumn("h", h).withColumn("upto", upto).withColumn("split", split.otherwise(list(sizes)[-1]))
    got = rows.groupBy("trial", "split").agg(F.sum("n_docs").alias("n_docs"), *(F.sum(s).alias(s) for s in strata))
    want = spark.createDataFrame([(k, float(v)) for k, v in sizes.items()], "split string, share double")
    full = got.join(F.broadcast(want), "split")
    error = (F.col("n_docs") / F.lit(max(n, 1)) / F.col("share") - 1) ** 2 * F.lit(4.0)
    for s in strata:
        if totals[s]:
            error = error + (F.col(s) / F.lit(totals[s]) / F.col("share") - 1) ** 2 + F.when(F.col(s) == 0, 1000.0).otherwise(0.0)
    missing = F.lit(1000.0) * (len(sizes) - F.count("*"))
    best = full.groupBy("trial").agg((F.sum(error) + missing).alias("score")).orderBy("score", "trial").limit(1)
    return rows.join(F.broadcast(best.select("trial")), "trial").select("group_id", "split")


#: Documents whose gain is counted again together, upper bounds that the driver holds at first, and
#: recounts of one pick after which all gains are counted in one pass.
RECOUNT, HEAD, RECOUNTS = 32, 1024, 4


def _recount(features: DataFrame, docs: list, chosen: list, need: int) -> dict:
    """Gains of some documents: their features that the chosen ones hold fewer than ``need`` times."""
    mine = features.where(F.col("doc_id").isin(docs))
    have = features.where(F.col("doc_id").isin(chosen)).groupBy("f").agg(F.count("*").alias("have")).where(F.col("have") >= need)
    left = mine.join(have, "f", "left_anti") if chosen else mine
    return {r["doc_id"]: r["n"] for r in left.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}


def _largest(features: DataFrame, chosen: list, need: int) -> tuple | None:
    """(-gain, doc_id) of the best document that is not chosen, by one grouped count of all gains."""
    mine = F.col("doc_id").isin(chosen)
    covered = features.where(mine).groupBy("f").agg(F.count("*").alias("have")).where(F.col("have") >= need).select("f")
    left = features.where(~mine).join(covered, "f", "left_anti") if chosen else features
    best = left.groupBy("doc_id").agg((-F.count("*")).alias("n")).agg(F.min(F.struct("n", "doc_id")).alias("b")).first()["b"]
    return best and (best["n"], best["doc_id"])


def coverage_batch(features: DataFrame, k: int, need: int = 1) -> DataFrame:
    """Up to k documents that greedily cover features, each wanted ``need`` times; the
    largest gain first, ties by id.

    features: (doc_id, f), a row once. Gains only fall as features are covered, so an older gain
    bounds a newer one: all gains are counted once, and afterwards only documents at the top of
    the bounds are counted again, until the best of them is not below the next bound. Where many documents have like features their
    bounds fall together; once a pick has taken ``RECOUNTS`` recounts, it and all later picks are one
    grouped pass each, of which one row reaches the driver."""
    from pyspark.sql import types as T

    totals = stored(features.groupBy("doc_id").agg(F.count("*").alias("n")))
    order, size, chosen, bound, fresh = (F.desc("n"), F.col("doc_id")), 0, [], {}, set()

    def top() -> list:
        """Bounds, largest first; more of the table is read when few of it are left above its end."""
        nonlocal size
        while True:
            rows = sorted(((-n, d) for d, n in bound.items()))
            if size and (len(bound) + len(chosen) < size or rows and rows[0] <= last[0]):
                return rows
            size = max(HEAD, 8 * size)
            for r in totals.orderBy(*order).limit(size).collect():
                last[:] = [(-r["n"], r["doc_id"])]
                if r["doc_id"] not in bound and r["doc_id"] not in chosen:
                    bound[r["doc_id"]] = r["n"]
            if not last:
                return []

    last: list = []
    recounts = 0
    while len(chosen) < k:
        if recounts >= RECOUNTS:
            best = _largest(features, chosen, need)
            if best is None:
                break
            chosen.append(best[1])
            continue
        rows = top()
        if not rows or rows[0][0] == 0:
            break
        if rows[0][1] in fresh:  # counted against all that is chosen, and first of all bounds
            chosen.append(rows[0][1])
            del bound[rows[0][1]]
            fresh, recounts = set(), 0
            continue
        again = [d for _, d in rows if d not in fresh][:RECOUNT]
        gains = _recount(features, again, chosen, need)
        bound.update({d: gains.get(d, 0) for d in again})
        fresh |= set(again)
        recounts += 1
    kind = features.schema["doc_id"].dataType
    return features.sparkSession.createDataFrame([(k, d) for k, d in enumerate(chosen)], T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind)]))


def quota_batch(positives: DataFrame, features: DataFrame, k: int, turn: int, seed: str = "0") -> DataFrame:
    """At most three quarters positives, taken from a keyed-hash order by a window that
    moves on with every turn; the rest covers features."""
    most = (3 * k) // 4
    n = positives.count()
    place = keyed_number(F.concat(F.lit(seed + ":"), F.col("doc_id").cast("string")))
    ring = global_rank(positives.select("doc_id"), [place, "doc_id"]).withColumn("_k", F.col("rank") - 1)
    part = stored(ring.where(F.pmod(F.col("_k") - turn * most, F.lit(max(n, 1))) < most).select("doc_id"))
    rest = coverage_batch(stored(features.join(part, "doc_id", "left_anti")), k - min(most, n))
    return part.withColumn("part", F.lit("positive")).union(rest.select("doc_id", F.lit("coverage")))
