"""Annotation operators against brute force and hand-made edge cases."""

import gzip
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.functions import text as fx
from spanforge.operators import audit, chunk, corrections, dedup, graph, integrity, link, match, metrics, normalize, rank, stats, terms, textscan
from spanforge.schema import dim_entity_type, dim_relation
from spanforge.sources import tables

M = "doc_id int, id string, start int, end int, type string, surface string, norm string"
R = "doc_id int, id string, type string, head string, tail string, ev_start int, ev_end int"


def column(spark, expr, *values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def test_normalizers(spark):
    assert column(spark, fx.canonical_cve, "cve - 2021 - 44228", "CVE-2021-1", "see CVE-2021-44228", None) == ["CVE-2021-44228", None, None, None]
    assert column(spark, fx.canonical_cwe, "cwe 79", "CWE-79x") == ["CWE-79", None]
    assert column(spark, fx.technique_id, "t1059 . 003", "TA0001") == ["T1059.003", None]
    good = r"cpe:2.3:a:acme:web\:tool:1.0:*:*:*:*:*:*:*"
    assert column(spark, fx.product_family, good, "cpe:2.3:x:a:b:*:*:*:*:*:*:*:*", "cpe:2.3:a:*:b:*:*:*:*:*:*:*:*", None) == [r"a:acme:web\:tool", None, None, None]
    assert column(spark, fx.product_version, good) == ["1.0"]


def test_offsets_count_code_points(spark):
    docs = spark.createDataFrame([(1, "é𝒳 abcdef Ghijkl"), (2, ""), (3, None)], "doc_id int, text string")
    rows = textscan.scan(docs, "[A-Za-z]{6,}").orderBy("start").collect()
    assert [(r["start"], r["end"], r["surface"]) for r in rows] == [(3, 9, "abcdef"), (10, 16, "Ghijkl")]


@pytest.mark.parametrize("mode", ["dot", "mark", "spaced", "block"])
def test_sentences_partition_the_text(spark, mode):
    texts = ["One. Two! Three? v1.2.3 ends\n\nNew。End", "", "no end", "..", "a.b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in textscan.sentences(docs, mode).orderBy("doc_id", "k").collect():
        got.setdefault(r["doc_id"], []).append(texts[r["doc_id"]][r["start"] : r["end"]])
    assert {k: "".join(v) for k, v in got.items()} == {k: t for k, t in enumerate(texts) if t}
    if mode == "spaced":
        assert got[0][0] == "One." and any("v1.2.3" in s for s in got[0])


def best_matching(gold, pred, fits):
    best = 0
    small, large = (gold, pred) if len(gold) <= len(pred) else (pred, gold)
    for perm in itertools.permutations(range(len(large)), len(small)):
        best = max(best, sum(fits(*((s, large[k]) if small is gold else (large[k], s))) for s, k in zip(small, perm)))
    return best


def test_matching_is_maximum(spark):
    rng = random.Random(7)
    gold, pred, want = [], [], {0.0: {}, 0.5: {}}
    for d in range(150):
        sides = []
        for rows in (gold, pred):
            spans = {(s, s + rng.randint(0, 8)) for s in (rng.randint(0, 20) for _ in range(rng.randint(0, 5)))}
            sides.append(sorted(spans))
            rows += [(d, s, e, "t") for s, e in spans]

        def inter(a, b):
            return min(a[1], b[1]) - max(a[0], b[0])

        want[0.0][d] = best_matching(*sides, lambda a, b: inter(a, b) > 0)
        want[0.5][d] = best_matching(*sides, lambda a, b: inter(a, b) > 0 and inter(a, b) >= 0.5 * (max(a[1], b[1]) - min(a[0], b[0])))
    schema = "doc_id int, start int, end int, type string"
    g, p = spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)
    for threshold in (None, 0.5):
        got = {r["doc_id"]: r["matched"] for r in match.matched_counts(g, p, threshold=threshold).collect()}
        assert all(got.get(d, 0) == n for d, n in want[threshold or 0.0].items())
    pairs = sorted(map(tuple, match.overlap_pairs(g, p).select("doc_id", "type", "g_start", "g_end", "p_start", "p_end").collect()))
    assert pairs == sorted({(x[0], "t", *x[1:3], *y[1:3]) for x in gold for y in pred if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])})


def test_scores(spark):
    gold = spark.createDataFrame([(1, "E1", 0, 5, "A", "alpha", "x"), (1, "E1", 0, 5, "A", "alpha", "x"), (1, "E2", 6, 9, "B", "bet", None), (2, "E1", 0, 3, "A", "alp", "y")], M)
    pred = spark.createDataFrame([(1, "E1", 0, 5, "A", "alpha", "z"), (1, "E2", 6, 9, "B", "bet", None), (1, "E3", 20, 25, "C", "c", None)], M)
    rows = {r["type"]: r for r in metrics.micro(metrics.mention_counts(gold, pred), [], "type").collect()}
    assert (rows["ALL"]["tp"], rows["ALL"]["fp"], rows["ALL"]["fn"]) == (2, 1, 1) and rows["C"]["f1"] == 0.0 and rows["A"]["recall"] == 0.5
    na = {r["type"]: r for r in metrics.normalization_accuracy(gold, pred, []).collect()}
    assert na["A"]["n_gold"] == 2 and na["A"]["n_found"] == 1 and na["A"]["n_right"] == 0
    rel = spark.createDataFrame([(1, "R1", "x", "E1", "E2", 0, 9), (1, "R2", "x", "E1", "E9", 0, 9)], R)
    assert metrics.micro(metrics.relation_counts(rel, gold, rel, pred), []).first()["tp"] == 1
    # without ids the sentinel of the span never matches another span
    f = match.facts(rel, gold).first()
    assert f["tail_norm"] == "~B:6-9" and f["head_norm"] == "X"
    empty = metrics.consistency(gold.limit(0), rel.limit(0), dim_entity_type(spark), dim_relation(spark), []).first()
    assert empty["mention_rate"] == empty["relation_rate"] == empty["rate"] == 1.0


def test_evidence_length_limit(spark):
    docs = spark.createDataFrame([(1, "x" * 500)], "doc_id int, text string")
    m = spark.createDataFrame([(1, "E1", 0, 3, "A", "xxx", None), (1, "E2", 5, 8, "B", "xxx", None)], M)
    rel = spark.createDataFrame([(1, "R1", "t", "E1", "E2", 0, 200), (1, "R2", "t", "E1", "E2", 0, 201), (1, "R3", "t", "E1", "E2", 4, 9), (1, "R4", "t", "E1", "E2", 9, 4)], R)
    got = {r["id"]: r["reasons"] for r in metrics.evidence_reasons(rel, m, docs).collect()}
    assert got == {"R1": [], "R2": ["long"], "R3": ["missing"], "R4": ["invalid"]}


def test_windows(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc .\n") for _ in range(n)) for n in (0, 10, 3000, 3001, 9000, 20000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for w in (chunk.windows(docs), chunk.windows(docs, snap=100), chunk.stride_windows(docs)):
        own = chunk.ownership(w)
        for d, rows in itertools.groupby(sorted(map(tuple, own.select("doc_id", "w", "w_start", "w_end", "own_lo2", "own_hi2").collect())), key=lambda r: r[0]):
            rows = list(rows)
            assert rows[0][2] == 0 and rows[-1][3] == len(texts[d]) and all(b[2] <= a[3] and b[2] > a[2] for a, b in zip(rows, rows[1:]))
            assert all(a[5] == b[4] for a, b in zip(rows, rows[1:])), "regions partition the text"
            assert all(r[3] - r[2] <= 3000 for r in rows)
    # a mention centred on a border belongs to the later window only
    w = chunk.ownership(spark.createDataFrame([(1, 0, 0, 100), (1, 1, 80, 180)], "doc_id int, w int, w_start int, w_end int"))
    assert [r["w"] for r in chunk.owned(spark.createDataFrame([(1, 85, 95)], "doc_id int, start int, end int"), w).collect()] == [1]


def test_merge_windows(spark):
    m = spark.createDataFrame([(1, 0, "E1", 5, 9, "A"), (1, 1, "E7", 5, 9, "A"), (1, 1, "E8", 12, 14, "B"), (1, 1, "E9", 12, 14, "B")], "doc_id int, w int, id string, start int, end int, type string")
    r = spark.createDataFrame([(1, 1, "x", "E7", "E8"), (1, 1, "x", "E7", "E9"), (1, 1, "x", "E8", "E9")], "doc_id int, w int, type string, head string, tail string")
    mm, rr = chunk.merge_windows(m, r)
    assert [(x["id"], x["start"]) for x in mm.orderBy("start").collect()] == [("E1", 5), ("E2", 12)]
    assert [(x["head"], x["tail"]) for x in rr.collect()] == [("E1", "E2")]


def test_dense_pieces_cover_windows(spark):
    m = spark.createDataFrame([(1, 50 + 10 * k, 55 + 10 * k) for k in range(60)], "doc_id int, start int, end int")
    runs = textscan.dense_runs(m, gap=20, least=5, span=100)
    assert [tuple(r) for r in runs.collect()] == [(1, 50, 645, 60)]
    w = spark.createDataFrame([(1, 0, 0, 1000)], "doc_id int, w int, w_start int, w_end int")
    parts = sorted((r["w_start"], r["w_end"]) for r in chunk.split_dense(w, m, runs, most=20, seam=30).collect())
    assert parts == [(0, 280), (220, 480), (420, 1000)]


def test_near_pairs_and_groups(spark):
    rng = random.Random(5)
    base = [rng.choices([f"w{k}" for k in range(300)], k=rng.randint(20, 60)) for _ in range(15)]
    texts = []
    for k in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = "edit" + str(k)
        texts.append(" ".join(t))
    texts += ["short", "two words", "", texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (re.findall(r"\w+", t.lower()) for t in texts)]
    want = {}
    reps = {s: min(k for k, x in enumerate(sets) if x == s) for s in sets}
    for a, b in itertools.combinations(sorted(reps.values()), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75:
            want[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {(r["a"], r["b"]): r["jaccard"] for r in dedup.near_pairs(docs).collect()}
    assert got == pytest.approx(want)
    comp = list(range(len(texts)))
    links = [*want, *((reps[s], k) for k, s in enumerate(sets))]
    for _ in texts:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["doc_id"]: r["group_id"] for r in dedup.duplicate_groups(docs).collect()} == dict(enumerate(comp))


def test_greedy_keeps_the_longest(spark):
    spans = spark.createDataFrame([(1, 0, 4, "t"), (1, 2, 9, "t"), (1, 8, 10, "t"), (1, 20, 22, "t"), (2, 0, 1, "t")], "doc_id int, start int, end int, type string").withColumn("shorter", F.col("start") - F.col("end"))
    got = sorted((r["doc_id"], r["start"]) for r in textscan.greedy_non_overlap(spans, ["doc_id", "type"], ["shorter", "start"]).collect())
    assert got == [(1, 2), (1, 20), (2, 0)]


def test_gazetteer_and_abbreviations(spark):
    docs = spark.createDataFrame([(1, "Use Acme Web Tool, acme web! Domain Name System (DNS) helps.")], "doc_id int, text string")
    gaz = spark.createDataFrame([("P", "acme web tool", "1"), ("P", "acme web", "2")], "type string, key string, norm string")
    got = sorted((r["start"], r["end"], r["norm"]) for r in textscan.match_gazetteer(docs, gaz).collect())
    assert got == [(4, 17, "1"), (19, 27, "2")]
    assert [(r["short"], r["long"]) for r in terms.abbreviations(docs).collect()] == [("DNS", "domain name system")]


def test_linking(spark):
    t = "CVE-2021-44228 affects Acme Web. It was exploited with T1190 in CVE-2020-1111. Not exploited: T1059."
    docs = spark.createDataFrame([(1, t)], "doc_id int, text string")

    def at(s, i, kind):
        return (1, i, t.index(s), t.index(s) + len(s), kind, s, s)

    m = spark.createDataFrame([at("CVE-2021-44228", "E1", "Vulnerability"), at("Acme Web", "E2", "Configuration"), at("T1190", "E3", "AttackTechnique"), at("CVE-2020-1111", "E4", "Vulnerability"), at("T1059", "E5", "AttackTechnique")], M)
    sents = textscan.sentences(docs, "spaced")
    got = sorted((r["type"], r["head"], r["tail"]) for r in link.build_relations(m, docs, sents).collect())
    assert got == [("affects", "E1", "E2"), ("exploited_by", "E4", "E3")]
    f = link.explicit_facts(m, docs, sents.select("doc_id", "start", "end"))
    assert [(r["head"], r["tail"]) for r in f.collect()] == [("E4", "E3")]
    heads = spark.createDataFrame([(1, 0, "a"), (1, 40, "b")], "doc_id int, start int, h string")
    assert {r["id"]: r["h"] for r in link.last_before(m, heads, "h").collect()}["E4"] == "b"
    cand = spark.createDataFrame([(1, "R1", "x", ["E1", "E4"], ["E3"], 0, len(t)), (1, "R2", "x", ["E1"], ["E3"], 0, 5)], "doc_id int, id string, type string, heads array<string>, tails array<string>, ev_start int, ev_end int")
    assert {r["id"]: (r["head"], r["by_evidence"]) for r in link.ends_by_evidence(cand, m).collect()} == {"R1": ("E4", True), "R2": ("E1", False)}


def test_audit_and_postprocess(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id int, text string")
    m = spark.createDataFrame([(1, "E1", 0, 5, "Vulnerability", "alpha", "V"), (1, "E2", 6, 10, "Configuration", "beta", None), (1, "E3", 6, 10, "Configuration", "beta", "c"), (1, "E4", 11, 15, "Weakness", "gamm?", "W")], M)
    r = spark.createDataFrame([(1, "R1", "affects", "E1", "E2", 0, 10), (1, "R2", "affects", "E2", "E1", 0, 10), (1, "R3", "affects", "E1", "E9", 0, 10), (1, "R4", "affects", "E1", "E2", 3, 10), (1, "R5", "affects", "E1", "E1", 0, 10)], R)
    got = sorted((x["kind"], x["item_id"]) for x in audit.structural(docs, m, r, dim_relation(spark), ["Configuration"]).collect())
    assert got == [("bad_signature", "R2"), ("bad_signature", "R5"), ("dangling_tail", "R3"), ("duplicate_relation", "R4"), ("duplicate_span", "E3"), ("evidence_misses_end", "R4"), ("invalid_span", "E4"), ("missing_id", "E2"), ("orphan", "E3"), ("self_relation", "R5")]
    mm, rr = audit.postprocess(m, r, docs, textscan.sentences(docs), dim_relation(spark))
    assert {x["id"]: x["reason"] for x in mm.collect()} == {"E1": None, "E2": None, "E3": "duplicate_mention", "E4": None}
    assert {x["id"]: x["reason"] for x in rr.collect()} == {"R1": None, "R2": "illegal_signature", "R3": "missing_end", "R4": "evidence_misses_end", "R5": "missing_end"}
    assert not audit.gate(audit.structural(docs, m, r, dim_relation(spark))).first()["passes"]
    assert audit.gate(audit.structural(docs, m.limit(0), r.limit(0), dim_relation(spark))).first()["passes"]


def test_corrections(spark):
    fam = "cpe:2.3:a:acme:{}:*:*:*:*:*:*:*:*"
    items = spark.createDataFrame([(1, f"E{k}", n) for k, n in enumerate([fam.format("web"), fam.format("db"), "bad", fam.format("web"), fam.format("os"), fam.format("far"), fam.format("kept")])], "doc_id int, id string, norm string")
    links = spark.createDataFrame([(1, "E0", "r1"), (1, "E1", "r1"), (1, "E2", "r1"), (1, "E4", "r2"), (1, "E5", "r3"), (1, "E6", "r3")], "doc_id int, id string, record string")
    feed = spark.createDataFrame([("r1", fam.format("web")), ("r2", fam.format("os").replace(":a:", ":o:", 1)), ("r3", fam.format("db"))], "record string, criteria string")
    keep = spark.createDataFrame([(1, "E6", "KEEP")], "doc_id int, id string, decision string")
    got = {r["id"]: r["status"] for r in corrections.catalogue_check(items, links, feed, keep).collect()}
    assert got == {"E0": "validated", "E1": "known_but_not_linked", "E2": "invalid_id", "E3": "no_linked_record", "E4": "part_mismatch", "E5": "family_not_linked", "E6": "validated_by_decision"}
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id int, text string")
    m = spark.createDataFrame([(1, "E1", 0, 5, "A", "alpha", "x"), (1, "E2", 6, 10, "B", "beta", "y"), (1, "E3", 11, 16, "C", "gamma", "z")], M)
    r = spark.createDataFrame([(1, "R1", "t", "E1", "E2", 0, 10), (1, "R2", "t", "E1", "E3", 0, 16)], R)
    d = spark.createDataFrame([(1, "E1", "REVISE", "x", "x2", 0, 4), (1, "E2", "REJECT", "y", None, None, None), (1, "E3", "REVISE", "other", "q", None, None)], "doc_id int, id string, action string, old_norm string, new_norm string, new_start int, new_end int")
    one = corrections.apply_decisions(m, r, d, docs)
    two = corrections.apply_decisions(one["mentions"], one["relations"], d, docs)
    for out in (one, two):
        assert sorted((x["id"], x["surface"], x["norm"]) for x in out["mentions"].collect()) == [("E1", "alph", "x2"), ("E3", "gamma", "z")]
        assert [x["id"] for x in out["relations"].collect()] == ["R2"] and [x["id"] for x in out["violations"].collect()] == ["E3"]
    assert [x["id"] for x in one["quarantine"].collect()] == ["E2"]


def test_statistics(spark):
    rng = random.Random(1)
    rows = [(m, "f", d, rng.randint(0, 5), rng.randint(0, 3), rng.randint(0, 3)) for d in range(12) for m in "ab"]
    c = spark.createDataFrame(rows, "method string, metric string, doc_id int, tp int, fp int, fn int")
    s = stats.bootstrap(c, 50)
    assert s.count() == 100 and {r["method"] for r in stats.intervals(s).collect()} == {"a", "b"}
    same = stats.bootstrap(c.where("method = 'a'").union(c.where("method = 'a'").withColumn("method", F.lit("b"))), 30)
    d = stats.differences(same, "a").first()
    assert d["p_greater"] == 0.5 and d["p_tie"] == 1.0 and d["low"] == d["high"] == 0.0, "the draws are shared"
    p = stats.randomization(c.where("method = 'a'").union(c.where("method = 'a'").withColumn("method", F.lit("b"))), "a", "b", 20).first()
    assert p["observed"] == 0.0 and p["p_value"] == 1.0


def test_split_and_batches(spark):
    g = spark.createDataFrame([(f"g{k}", 1 + k % 4, k % 3, 1) for k in range(30)], "group_id string, n_docs int, a int, b int")
    s = rank.stratified_split(g, {"train": 0.6, "dev": 0.2, "test": 0.2}, ["a", "b"], trials=30).join(g, "group_id").groupBy("split").agg(F.sum("n_docs").alias("n")).collect()
    n = {r["split"]: r["n"] for r in s}
    assert sum(n.values()) == sum(1 + k % 4 for k in range(30)) and abs(n["train"] / sum(n.values()) - 0.6) < 0.08
    f = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "a")], "doc_id int, f string")
    assert [r["doc_id"] for r in rank.coverage_batch(f, 5).orderBy("rank").collect()] == [1, 2]


def test_graph_and_integrity(spark):
    m = spark.createDataFrame([(1, "E1", 0, 5, "T", "x", "T1.001"), (1, "E2", 6, 9, "T", "y", "T2"), (2, "E1", 0, 5, "T", "z", "T9")], M)
    mp = spark.createDataFrame([("T1", "initial-access"), ("T1", "execution"), ("T2", "impact")], "key string, value string")
    ph = spark.createDataFrame([("initial-access", "delivery"), ("execution", "exploit"), ("impact", "actions")], "tactic string, phase string")
    ex = spark.createDataFrame([(1, "T1.001")], "doc_id int, norm string")
    e = {(r["relation"], r["head"], r["tail"]) for r in graph.complete(m, mp, ph, ex).collect()}
    assert ("implies", "T1.001", "execution") in e and ("belongs_to_phase", "initial-access", "exploitation") in e and ("belongs_to_phase", "initial-access", "delivery") not in e
    assert [r["norm"] for r in graph.unmapped(m, mp).collect()] == ["T9"]
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id int, text string")
    h = integrity.content_hashes(docs)
    assert integrity.aggregate_hash(h).first() == integrity.aggregate_hash(h.orderBy(F.desc("doc_id"))).first()
    old = integrity.content_hashes(spark.createDataFrame([(1, "a"), (2, "B"), (9, "z")], "doc_id int, text string"))
    assert {r["doc_id"]: r["status"] for r in integrity.verify_manifest(h, old).collect()} == {1: "same", 2: "changed", 3: "extra", 9: "missing"}


def test_cleaning(spark):
    docs = spark.createDataFrame([(1, "Acme Server and acme server, Tool.")], "doc_id int, text string")
    raw = spark.createDataFrame([(1, "E1", 99, 100, "Vulnerability", "acme server", None), (1, "E2", 0, 4, "Configuration", "Acme", None), (1, "E3", 5, 6, "Configuration", "Tool", None), (1, "E4", 5, 6, "Weakness", "ACME", None)], M)
    got = sorted((r["id"], r["start"]) for r in normalize.ground(raw, docs).collect())
    assert got == [("E1", 16), ("E2", 0), ("E3", 29), ("E4", 0), ("E4", 16)]
    m = spark.createDataFrame([(1, "E1", 0, 11, "Configuration", "Acme Server", None), (1, "E2", 0, 9, "Configuration", "Net Suite", None)], M)
    t = {r["id"]: (r["surface"], r["end"]) for r in normalize.trim_descriptors(m, spark.createDataFrame([("net suite",)], "name string")).collect()}
    assert t == {"E1": ("Acme", 4), "E2": ("Net Suite", 9)}
    p = spark.createDataFrame([(1, "E1", 5, 12, "Configuration", "A1 and B2", None), (1, "E2", 0, 4, "Configuration", "Acme", None)], M)
    got = sorted((r["surface"], r["start"], r["action"]) for r in normalize.repair_products(p, ["acme"]).collect())
    assert got == [("A1", 5, "split"), ("Acme", 0, "drop_vendor"), ("B2", 12, "split")]
    o = spark.createDataFrame([('{"a": 1}',), ('x ```json\n{"a": 2}\n``` y',), ('so {"a": 3} end',), ("{broken",), (None,)], "raw string")
    assert [(r["status"], r["parsed"]["a"] if r["parsed"] else None) for r in normalize.parse_outputs(o, "a int").collect()] == [("direct", 1), ("fenced", 2), ("braced", 3), ("unparseable", None), ("unparseable", None)]


def test_sources(spark, tmp_path):
    doc = {"doc_id": "d1", "text": "alpha", "entities": [{"id": "E1", "text": "alpha", "type": "A", "start": 0, "end": 5, "normalized_id": None}], "relations": [{"id": "R1", "type": "t", "head": "E1", "tail": "E1", "evidence": "alpha"}]}
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "d1.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "gold" / "_manifest.json").write_text("{}")
    a = tables.read_annotations(spark, str(tmp_path / "gold"))
    assert a.count() == 1 and tables.mentions_of(a).first()["surface"] == "alpha" and tables.relations_of(a).first()["head"] == "E1"
    (tmp_path / "split.json").write_text(json.dumps({"train": ["d1"], "dev": ["d2"], "test": [], "seed": 3}))
    s = tables.read_splits(spark, str(tmp_path / "split.json"))
    assert tables.documents_of_split(a, s, "train").count() == 1
    with pytest.raises(Exception, match="missing: d2"):
        tables.documents_of_split(a, s).collect()
    (tmp_path / "feed").mkdir()
    cpe = r"cpe:2.3:a:acme:web\:tool:1:*:*:*:*:*:*:*"
    new = {"vulnerabilities": [{"cve": {"id": "CVE-2021-1", "configurations": [{"nodes": [{"cpeMatch": [{"criteria": cpe}]}]}]}}]}
    old = {"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": "CVE-2019-2"}}, "configurations": {"nodes": [{"children": [{"cpe_match": [{"cpe23Uri": cpe}]}]}]}}]}
    with gzip.open(tmp_path / "feed" / "2021.json.gz", "wt") as f:
        json.dump(new, f)
    (tmp_path / "feed" / "2019.json").write_text(json.dumps(old))
    assert sorted((r["record"], r["year"], r["criteria"]) for r in tables.read_feed(spark, str(tmp_path / "feed"), 2).collect()) == [("CVE-2019-2", "2019", cpe), ("CVE-2021-1", "2021", cpe)]
    (tmp_path / "map.json").write_text(json.dumps({"T1": ["a", "b"], "T2": "c"}))
    assert sorted(map(tuple, tables.read_mapping(spark, str(tmp_path / "map.json")).collect())) == [("T1", "a"), ("T1", "b"), ("T2", "c")]
    p = spark.createDataFrame([("d1", "m", "dev", "h"), ("d2", "m", "dev", "h")], "doc_id string, method string, split string, run_sha256 string")
    sink = str(tmp_path / "sink")
    tables.write_predictions(p.limit(1), sink)
    tables.write_predictions(p, sink)
    assert spark.read.parquet(sink).count() == 2
    tables.write_window_cache(p, str(tmp_path / "cache"))
    assert tables.read_window_cache(spark, str(tmp_path / "cache"), "doc_id string").count() == 2
    with pytest.raises(Exception, match="already exists"):
        tables.write_window_cache(p, str(tmp_path / "cache"))
    tables.write_review_queue(p, str(tmp_path / "queue"))
    assert spark.read.option("header", True).csv(str(tmp_path / "queue")).columns[-3:] == ["decision", "reviewer", "comment"]
    tables.write_completed_graph(p, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph")).count() == 2


def test_entry_imports_without_optional_parts(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 5
