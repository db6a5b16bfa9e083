"""Term automaton, abbreviations, explicit facts, graded similarity and dense cuts against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanforge.operators import audit, chunk, corrections, facts, terms, textscan


# ---- X3 ----
def hits_brute(text, keys):
    word = lambda c: c.isalnum() or c == "_"
    out = set()
    for key in keys:
        for s in range(len(text)):
            for e in range(s + 1, min(len(text), s + len(key)) + 1):
                if text[s:e].lower() != key:
                    continue
                if key[0].isalnum() and s and word(text[s - 1]) or key[-1].isalnum() and e < len(text) and word(text[e]):
                    continue
                out.add((s, e, text[s:e], key))
    return out


KEYS = ["c++", ".net", "a", "a b", "b", "ab", "é", "node.js", "c", "+", "b a", "ß", "i̇", "x_y", "a.", " a"]


@pytest.mark.parametrize("chars", [terms.AUTOMATON_CHARS, 7])
def test_term_hits(spark, monkeypatch, chars):
    monkeypatch.setattr(terms, "AUTOMATON_CHARS", chars)
    rng = random.Random(3)
    texts = ["Use C++ and .NET, c++11 or ASP.NET; C+ +", "", "İ iİ x_y x_yz É", "A B A.B_a", *("".join(rng.choices("aAbB c+.é_ ", k=rng.randint(1, 30))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc_id int, text string")
    keys = spark.createDataFrame([(k,) for k in [*KEYS, "a", ""]], "key string")
    got = [(r["doc_id"], r["start"], r["end"], r["surface"], r["key"]) for r in terms.term_hits(docs, keys).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, *h) for i, t in enumerate(texts) for h in hits_brute(t, KEYS)}
    assert terms.term_hits(docs, keys.limit(0)).count() == 0
    found = textscan.match_gazetteer(docs.limit(1), spark.createDataFrame([("P", "c++", "1"), ("P", ".net", "2"), ("Q", "c", "3")], "type string, key string, norm string"))
    assert sorted((r["surface"], r["type"], r["norm"]) for r in found.collect()) == [(".NET", "P", "2"), (".NET", "P", "2"), ("C", "Q", "3"), ("C", "Q", "3"), ("C++", "P", "1"), ("c", "Q", "3"), ("c++", "P", "1")]


# ---- X8 ----
def aligned_brute(short, long):
    """Every end of the long form that begins a word, from the shortest: the first with the letters in order."""
    letters = [c.casefold() for c in short if c.isalnum()]
    for k in range(len(long) - 1, -1, -1):
        if long[k].casefold() != letters[0] or (k and long[k - 1].isalnum()):
            continue
        it = iter(long[k:].casefold())
        if all(c in it for c in letters):
            out = long[k:].strip(" \t,;:-")
            return out if len(out.split()) >= 2 and len(out) > len(short) else None
    return None


def test_alignment():
    rng = random.Random(5)
    some = 0
    for _ in range(4000):
        short = "".join(rng.choices("ABc1", k=rng.randint(2, 5)))
        long = "".join(rng.choices("abc1 -", k=rng.randint(1, 25)))
        want = aligned_brute(short, long)
        assert terms.aligned(short, long) == want
        some += want is not None
    assert some > 300


def test_abbreviations(spark):
    docs = spark.createDataFrame([
        (1, "Acme Secure Gateway (ASG) was assessed. ASG remained online. NCE (Network Control Engine) was mentioned separately."),
        (2, "We use the acme secure gateway (ASG), an application security group (ASG); IPv6 (Internet Protocol version 6) too."),
        (3, "ASG remained online."), (4, None), (5, ""), (6, "not one (abc), nor two words (Tw), nor\nline (LN) breaks (see Figure 2)"), (7, "Acme Secure Gateway (ASG), again Acme Secure Gateway (ASG)"),
    ], "doc_id int, text string")
    got = terms.abbreviation_pairs(docs).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["short"], r["long"]) for r in got] == [
        (1, "ASG", "Acme Secure Gateway"), (1, "NCE", "Network Control Engine"), (2, "ASG", "acme secure gateway"), (2, "ASG", "application security group"),
        (2, "IPv6", "Internet Protocol version 6"), (7, "ASG", "Acme Secure Gateway"),
    ]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [text[r["doc_id"]][r["start"] : r["end"]] for r in got[:2]] == ["Acme Secure Gateway (ASG)", "NCE (Network Control Engine)"]
    rows = {(r["short"], r["long"]): (r["n_docs"], r["n_long"], r["best"]) for r in terms.abbreviations(docs).collect()}
    assert rows["ASG", "acme secure gateway"] == (3, 2, True) and rows["ASG", "application security group"] == (1, 2, False)


# ---- X10 ----
HEAD = "Cyber threat actors have exploited the following CVEs to gain access [T1190] in networks:"


FACTS = [
    (f"{HEAD} • CVE-2021-44228 log • CVE- 2020-1111 x • other • CVE-2019-2222", [("CVE-2020-1111", "T1190", 1), ("CVE-2021-44228", "T1190", 1)]),
    (f"{HEAD} {'far ' * 25}• CVE-2021-44228", []),  # too far from the heading
    (f"{HEAD} • CVE-2021-44228 {'far ' * 130}• CVE-2020-1111", [("CVE-2021-44228", "T1190", 1)]),  # a gap ends the list
    (f"{HEAD}• CVE-2021-44228", []),  # no bullet of its own
    (f"{HEAD} • CVE-2021-44228 and {HEAD} • CVE-2020-1111", [("CVE-2020-1111", "T1190", 1), ("CVE-2020-1111", "T1190", 1), ("CVE-2021-44228", "T1190", 1)]),
    ("Exploit Public-Facing Application T1190 They used CVE-2021-1111, CVE-2021-2222. CVE-2021-3333.", [("CVE-2021-1111", "T1190", 2), ("CVE-2021-2222", "T1190", 2)]),
    ("Exploit Public- Facing Application T1190 no end CVE-2021-1111, CVE-2021-2222", []),
    (f"Exploit Public-Facing Application T1190 {'long ' * 160}CVE-2021-1111, CVE-2021-2222.", []),
    ("They exploited CVE-2021-1111 (T1203). Other words.", [("CVE-2021-1111", "T1203", 3)]),
    ("They never exploited CVE-2021-1111 (T1203).", []),
    ("They exploited CVE-2021-1111 and CVE-2021-2222 (T1203).", []),
    ("They exploited CVE-2021-1111 (T1059).", []),
    ("They saw CVE-2021-1111 (T1203).", []),
    (f"They exploited CVE-2021-1111 {'and so on ' * 20}(T1203).", []),
    ("- exploited CVE-2021-1111, no\n- exploited CVE-2021-2222 by T1068\nthe end", [("CVE-2021-2222", "T1068", 3)]),
    ("nothing", []), ("", []),
]


def test_exploit_facts(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(FACTS)] + [(99, None)], "doc_id int, text string")
    got = {k: [] for k in range(len(FACTS))}
    for r in facts.exploit_facts(docs).collect():
        text = FACTS[r["doc_id"]][0]
        assert re.sub(r"\s", "", text[r["item_start"] : r["item_end"]]).upper() == r["item"] and text[r["scope_start"] : r["scope_end"]].upper() == r["scope"]
        assert r["ev_start"] <= min(r["item_start"], r["scope_start"]) and r["ev_end"] >= r["item_end"]
        got[r["doc_id"]].append((r["item"], r["scope"], r["shape"]))
    assert [sorted(x) for x in got.values()] == [want for _, want in FACTS]


# ---- J16 ----
def test_ranked_candidates(spark):
    rng = random.Random(4)
    name = lambda n: "".join(rng.choices("abcd_", k=rng.randint(1, n)))
    cpe = lambda: f"cpe:2.3:{rng.choice('aoh')}:{name(5)}:{name(9)}:1:*:*:*:*:*:*:*"
    items = [(d, f"E{k}", cpe()) for d in range(3) for k in range(4)] + [(0, "E9", "bad"), (0, "E8", None)]
    cands = [(d, i, c) for d, i, _ in items for c in [cpe() for _ in range(60)]] + [(1, "E1", "bad")]
    cands += cands[:5]
    got = {}
    for r in corrections.ranked_candidates(spark.createDataFrame(items, "doc_id int, id string, norm string"), spark.createDataFrame(cands, "doc_id int, id string, criteria string")).collect():
        got.setdefault((r["doc_id"], r["id"]), []).append((r["rank"], r["criteria"], r["score"]))
    family = lambda c: ":".join(c.split(":")[2:5])
    for d, i, norm in items[:-2]:
        mine = {c for a, b, c in cands if (a, b) == (d, i) and c != "bad"}
        want = sorted((-corrections.family_similarity(family(norm), family(c)), c) for c in mine)[:12]
        assert sorted(got[d, i]) == [(k, c, -s) for k, (s, c) in enumerate(want, 1)]
    assert (0, "E9") not in got and (0, "E8") not in got
    assert corrections.family_similarity("a:acme:tool", "a:acne:tool") == pytest.approx(0.12 + 0.28 * 0.75 + 0.6)


# ---- C3 ----
def test_dense_cuts_at_records(spark):
    rng = random.Random(9)
    at, records, ids = 40, [], []
    for _ in range(40):  # records of one to seven ids
        records.append(at)
        for _ in range(rng.randint(1, 7)):
            ids.append(at)
            at += rng.randint(8, 30)
    m = spark.createDataFrame([(1, s, s + 5) for s in ids], "doc_id int, start int, end int")
    runs = textscan.dense_runs(m, gap=60)
    w = spark.createDataFrame([(1, 0, 0, at + 50)], "doc_id int, w int, w_start int, w_end int")
    for marks, borders in ((spark.createDataFrame([(1, s) for s in records], "doc_id int, start int"), set(records)), (None, set(ids))):
        parts = [(r["w_start"], r["w_end"]) for r in chunk.split_dense(w, m, runs, most=20, seam=0, records=marks).orderBy("piece").collect()]
        assert parts[0][0] == 0 and parts[-1][1] == at + 50 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert {s for s, _ in parts[1:]} <= borders
        sizes = [sum(s <= x < e for x in ids) for s, e in parts]
        assert max(sizes) <= 20 and len(parts) > len(ids) // 20
        if marks is None:
            assert max(sizes) - min(sizes) <= len(sizes)  # as even as can be


# ---- Q2 ----
def test_after_exploitation(spark):
    rows = [("After exploiting the flaw they kept persistence", True), ("After exploitation nothing else", False), ("exploited it and then gained credentials", True), ("lateral movement was seen", False), ("following the exploit, C2", True)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(audit.after_exploitation(F.col("t")) != F.col("want")).count() == 0


# ---- Q6, P7 ----
def test_postprocess_gates_additions_and_orphans(spark):
    from spanforge.schema import dim_relation

    text = "CVE-2021-1111 hits Acme Web. They exploited CVE-2021-2222 (T1203). TA0001 and RCE, XSS. Lone Tool."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")

    def at(i, s, kind, norm=None):
        return (1, i, text.index(s), text.index(s) + len(s), kind, s, norm)

    rows = [at("E1", "CVE-2021-1111", "Vulnerability"), at("E2", "Acme Web", "Configuration"), at("E3", "CVE-2021-2222", "Vulnerability"), at("E4", "T1203", "AttackTechnique"), at("E5", "TA0001", "AttackTechnique"), at("E6", "RCE", "Weakness", "CWE-94"), at("E7", "XSS", "Weakness"), at("E8", "Lone Tool", "Configuration"), at("E9", "Lone", "Vulnerability")]
    m = spark.createDataFrame(rows, "doc_id int, id string, start int, end int, type string, surface string, norm string")
    r = spark.createDataFrame([(1, "R1", "affects", "E1", "E2", 0, 28), (1, "R2", "affects", "E9", "E8", 0, len(text))], "doc_id int, id string, type string, head string, tail string, ev_start int, ev_end int")
    m, r = audit.postprocess(m, r, docs, textscan.sentences(docs, "spaced"), dim_relation(spark), gates=audit.id_gates())
    added = audit.add_facts(m, r, facts.exploit_facts(docs), docs)
    assert [(x["type"], x["head"], x["tail"]) for x in added.collect()] == [("exploited_by", "E3", "E4")]
    assert {x["id"]: x["reason"] for x in r.collect()} == {"R1": None, "R2": "missing_end"}
    m = audit.drop_orphans(m, r.where("reason is null"))
    assert {x["id"]: x["reason"] for x in m.collect()} == {
        "E1": None, "E2": None, "E3": None, "E4": None, "E5": "tactic_as_technique", "E6": "consequence_as_weakness", "E7": "weakness_without_id", "E8": "product_without_relation", "E9": "vulnerability_without_id",
    }
    once_more = audit.add_facts(m, r.unionByName(added.selectExpr("doc_id", "id", "type", "head", "tail", "ev_start", "ev_end", "cast(null as string) reason", "cast(null as int) stage")), facts.exploit_facts(docs), docs)
    assert once_more.count() == 0


def test_local_ids(spark):
    from spanforge.operators import normalize

    text = "Injection is CWE- 79! Overflow here. CWE-120 there; CWE-89 flaw"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    cases = [("Injection", "CWE-79", "CWE-79"), ("Overflow", "CWE-120", None), ("there", "cwe-120", "CWE-120"), ("CWE-89 flaw", "CWE-1", "CWE-89"), ("flaw", None, None)]
    rows = [(1, f"E{k}", text.index(s), text.index(s) + len(s), "Weakness", s, n) for k, (s, n, _) in enumerate(cases)] + [(1, "P", 0, 3, "Configuration", "Inj", "kept")]
    got = {r["id"]: r["norm"] for r in normalize.local_ids(spark.createDataFrame(rows, "doc_id int, id string, start int, end int, type string, surface string, norm string"), docs).collect()}
    assert got == {f"E{k}": want for k, (_, _, want) in enumerate(cases)} | {"P": "kept"}
