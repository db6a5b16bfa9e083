"""Global ranks, closest pairs and cross facts against brute force."""

import random

from pyspark.sql import functions as F

from spanforge.operators import errors, link, order, rank

M = "doc_id int, id string, start int, end int, type string, surface string, norm string"
R = "doc_id int, id string, type string, head string, tail string, ev_start int, ev_end int"


def test_global_rank(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(5)]), rng.random()) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b double").repartition(7)
    out = order.global_rank(df, [F.desc("a"), "b", "id"])
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert [r["id"] for r in out.orderBy("rank").collect()] == [r[0] for r in want]
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 501))
    assert order.global_rank(df.limit(0), ["id"]).count() == 0
    for made in (out, rank.leaderboard(spark.createDataFrame([("a", 1.0, 1.0, "t"), ("b", 2.0, 1.0, "t")], "candidate_id string, reward double, precision double, text string"), 1)):
        assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()


def test_ranked_records(spark):
    rows = spark.createDataFrame([(1, 5, True), (2, 9, True), (3, 7, False), (4, 9, None)], "id int, x int, ok boolean")
    got = {r["id"]: (r["rank"], r["failed"]) for r in rank.ranked_records(rows, {"ok": F.col("ok"), "big": F.col("x") > 4}, [F.desc("x"), F.col("id")]).collect()}
    assert got == {1: (2, []), 2: (1, []), 3: (None, ["ok"]), 4: (None, ["ok"])}


def test_closest_pairs(spark):
    rng = random.Random(11)
    mentions, relations = [], []
    for d in range(60):
        for k in range(rng.randint(2, 9)):
            s = rng.randint(0, 60)
            surface = rng.choice(["aa", "Aa", "bb"])
            mentions.append((d, f"E{k}", s, s + rng.randint(1, 6), rng.choice("VC"), surface, rng.choice([surface.upper(), None, "  "])))
        ids = [m for m in mentions if m[0] == d]
        for k in range(4):
            h, t = rng.sample(ids, 2)
            lo = rng.randint(0, 30)
            relations.append((d, f"R{k}", "x", h[1], t[1], lo, lo + rng.randint(5, 60)))
    key = lambda m: (m[4], m[6].strip().lower(), 1) if m[6] and m[6].strip() else (m[4], m[5].lower(), 0)
    gap = lambda a, b: max(0, max(a[2], b[2]) - min(a[3], b[3]))
    want, moved = {}, 0
    for d, i, _, h, t, lo, hi in relations:
        own = {m[1]: m for m in mentions if m[0] == d}
        inside = [m for m in own.values() if lo <= m[2] and m[3] <= hi]
        pairs = [(gap(a, b), a[1], b[1]) for a in inside for b in inside if a[1] != b[1] and key(a) == key(own[h]) and key(b) == key(own[t])]
        best = min((p[0] for p in pairs), default=None)
        top = [p for p in pairs if p[0] == best]
        new = len(top) == 1 and best < gap(own[h], own[t])
        moved += new
        want[d, i] = (*top[0][1:], True) if new else (h, t, False)
    got = {(r["doc_id"], r["id"]): (r["head"], r["tail"], r["moved"]) for r in link.reanchor_pairs(spark.createDataFrame(relations, R), spark.createDataFrame(mentions, M)).collect()}
    assert got == want and moved > 5


def test_cross_facts(spark):
    m = spark.createDataFrame([(1, f"E{k}", 10 * k, 10 * k + 3, "VC"[k % 2], "s", None) for k in range(6)], M)
    gold = spark.createDataFrame([(1, "R1", "affects", "E0", "E1", 0, 90), (1, "R2", "affects", "E2", "E3", 0, 90), (1, "R3", "other", "E4", "E5", 0, 90)], R)
    pred = spark.createDataFrame([(1, "R1", "affects", "E0", "E1", 0, 90), (1, "R2", "affects", "E0", "E3", 0, 90), (1, "R3", "affects", "E4", "E1", 0, 90), (1, "R4", "other", "E0", "E3", 0, 90)], R)
    got = {r["type"]: (r["n_spurious"], r["n_cross"]) for r in errors.cross_facts(gold, m, pred, m).collect()}
    assert got == {"affects": (2, 1), "other": (1, 0)}


def test_bootstrap_by_ranges(spark):
    from spanforge.operators import stats

    rng = random.Random(5)
    rows = [(m, "f", d if d < 299 else None, rng.randint(0, 5), rng.randint(0, 3), rng.randint(0, 3)) for d in range(300) for m in "ab"]
    rows += [(m, "n", d if d < 299 else None, 1, 0, 0) for d in range(300) for m in "ab"]
    c = spark.createDataFrame(rows, "method string, metric string, doc_id int, tp int, fp int, fn int")
    one = stats.bootstrap_ranges(c, 400, per_range=16)
    got = {(r["replicate"], r["method"], r["metric"]): (r["tp"], r["fp"], r["fn"]) for r in one.collect()}
    assert len(got) == 1600 and all(v == (300, 0, 0) for k, v in got.items() if k[2] == "n"), "the draws of a replicate sum to the documents"
    again = stats.bootstrap_ranges(c.repartition(5, "tp"), 400, per_range=16)
    assert {(r["replicate"], r["method"], r["metric"]): (r["tp"], r["fp"], r["fn"]) for r in again.collect()} == got, "partitions do not matter"
    # mean and deviation of a drawn sum are those of sampling with replacement
    x = [t for m, q, _, t, _, _ in rows if m == "a" and q == "f"]
    mean = sum(x) / 300
    dev = (sum((v - mean) ** 2 for v in x)) ** 0.5
    sums = [v[0] for k, v in got.items() if k[1:] == ("a", "f")]
    mid = sum(sums) / len(sums)
    assert abs(mid - sum(x)) < 4 * dev / 20 and 0.85 < (sum((v - mid) ** 2 for v in sums) / len(sums)) ** 0.5 / dev < 1.15
    plain = {r["method"]: r for r in stats.intervals(stats.bootstrap(c.where("metric = 'f' and doc_id is not null"), 400)).collect()}
    tree = {r["method"]: r for r in stats.intervals(one.where("metric = 'f'")).collect()}
    for m in "ab":
        assert abs(plain[m]["low"] - tree[m]["low"]) < 0.012 and abs(plain[m]["high"] - tree[m]["high"]) < 0.012
    same = stats.bootstrap_ranges(c.where("method = 'a'").union(c.where("method = 'a'").withColumn("method", F.lit("b"))), 30, per_range=16)
    assert {r["p_tie"] for r in stats.differences(same, "a").collect()} == {1.0}, "the draws are shared"
    assert stats.bootstrap_ranges(c.limit(0), 10).count() == 0
