"""Window scores, corrections, older outputs and healed evidence against brute force."""

import random

from pyspark.sql import functions as F

from spanforge.operators import chunk, corrections, evidence, legacy, metrics
from spanforge.schema import dim_entity_type, dim_relation

M = "doc_id int, id string, start int, end int, type string, surface string, norm string"
R = "doc_id int, id string, type string, head string, tail string, ev_start int, ev_end int"


def regions(n, length, stride):
    """(w, start, end, lo2, hi2) of the windows of a text of n characters."""
    starts = [0]
    while starts[-1] + length < n:
        starts.append(starts[-1] + stride)
    ends = [min(n, s + length) for s in starts]
    lo = [-10**9] + [ends[k - 1] + starts[k] for k in range(1, len(starts))]
    return [(k, starts[k], ends[k], lo[k], lo[k + 1] if k + 1 < len(starts) else 10**9) for k in range(len(starts))]


def test_window_scores(spark):
    rng = random.Random(4)
    docs = [(d, "x" * rng.randint(1, 400)) for d in range(12)]
    types = ["Vulnerability", "Configuration", "Weakness"]
    gold, pred, given = [], [], []
    for d, text in docs:
        spans = sorted({(s, min(len(text), s + rng.randint(1, 20)), rng.choice(types)) for s in (rng.randint(0, len(text) - 1) for _ in range(25))})
        for k, (s, e, t) in enumerate(spans):
            if rng.random() < 0.7:
                gold.append((d, f"E{k}", s, e, t, "x", "N" if rng.random() < 0.8 else None))
            if rng.random() < 0.7:
                pred.append((d, f"E{k}", s, e, t, "x", rng.choice(["N", "O", None])))
    wins = {d: regions(len(t), 100, 80) for d, t in docs}
    for row in pred:  # every window may give what it sees
        given += [(*row, w) for w, s, e, *_ in wins[row[0]] if row[2] >= s and row[3] <= e and rng.random() < 0.9]
    owner = {(d, m): w for d, ws in wins.items() for m in range(0, 900) for w, _, _, lo, hi in ws if lo <= m < hi}
    g = {(r[0], owner[r[0], r[2] + r[3]], r[2], r[3], r[4]): r[6] for r in gold}
    p = {(r[0], r[7], r[2], r[3], r[4]): r[6] for r in given if owner[r[0], r[2] + r[3]] == r[7]}
    D = spark.createDataFrame(docs, "doc_id int, text string")
    own = chunk.ownership(chunk.stride_windows(D, 100, 80))
    out = {r["type"]: r for r in metrics.window_mention_scores(spark.createDataFrame(gold, M), spark.createDataFrame(given, M + ", w int"), own, dim_entity_type(spark)).collect()}
    for t in types:
        a, b = {x for x in g if x[4] == t}, {x for x in p if x[4] == t}
        r = out[t]
        assert (r["tp"], r["fp"], r["fn"]) == (len(a & b), len(b - a), len(a - b)) and r["applicable"]
        assert (r["gold_support"], r["predicted_support"]) == (len(a), len(b))
        hits = [x for x in a & b if g[x] is not None]
        assert (r["norm_total"], r["norm_right"]) == (len(hits), sum(p[x] == g[x] for x in hits))
    assert sorted(t for t, r in out.items() if not r["applicable"] and r["f1"] is None and r["tp"] == 0) == ["AttackTactic", "AttackTechnique", "KillChainPhase"]
    empty = metrics.window_mention_scores(spark.createDataFrame([], M), spark.createDataFrame([], M + ", w int"), own, dim_entity_type(spark)).collect()
    assert len(empty) == 6 and not any(r["applicable"] for r in empty)


def test_relations_belong_to_the_middle_of_their_ends(spark):
    docs = spark.createDataFrame([(1, "x" * 180)], "doc_id int, text string")
    own = chunk.ownership(chunk.stride_windows(docs, 100, 80))  # two windows, border at 90
    m = spark.createDataFrame([(1, "A", 80, 84, "Vulnerability", "x", None), (1, "B", 90, 96, "Configuration", "x", None), (1, "C", 96, 99, "Vulnerability", "x", None)], M)
    gold = spark.createDataFrame([(1, "R1", "affects", "A", "B", 0, 10), (1, "R2", "affects", "C", "B", 0, 10)], R)
    W = R + ", w int"
    # middle 88 is the first window's, 94.5 the second's; an unknown end goes by its evidence and counts nowhere
    given = spark.createDataFrame([(1, "p1", "affects", "A", "B", 100, 120, 0), (1, "p2", "affects", "A", "B", 100, 120, 1), (1, "p3", "affects", "C", "B", 0, 1, 0), (1, "p4", "affects", "C", "?", 0, 9, 0), (1, "p5", "implies", "A", "B", 0, 1, 0)], W)
    out = {r["type"]: (r["tp"], r["fp"], r["fn"], r["applicable"]) for r in metrics.window_relation_scores(gold, m, given, m, own, dim_relation(spark)).collect()}
    assert out["affects"] == (1, 0, 1, True) and out["implies"] == (0, 1, 0, True) and out["instantiates"] == (0, 0, 0, False)
    other = m.withColumn("type", F.when(F.col("id") == "B", "Weakness").otherwise(F.col("type")))
    out = {r["type"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.window_relation_scores(gold, m, given, other, own, dim_relation(spark)).collect()}
    assert out["affects"] == (0, 1, 2), "a relation whose end has another type is another relation"


def test_corrections_check_spans_and_tear_relations(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id int, text string")
    m = spark.createDataFrame([(1, "E1", 0, 5, "A", "alpha", "x"), (1, "E2", 6, 10, "B", "beta", "y"), (1, "E3", 11, 16, "C", "gamma", None), (1, "E4", 17, 22, "C", "delta", "z")], M)
    r = spark.createDataFrame([(1, "R1", "t", "E1", "E2", 0, 10), (1, "R2", "t", "E1", "E3", 0, 16), (1, "R3", "t", "E2", "E2", 0, 16)], R)
    schema = "doc_id int, id string, action string, old_norm string, new_norm string, new_start int, new_end int, old_start int, old_end int, old_surface string, new_surface string"
    d = [
        (1, "E1", "REVISE", "x", None, 0, 10, 0, 5, "alpha", "alpha beta"), (1, "E2", "REJECT", "y", None, None, None, 6, 10, "beta", None),
        (1, "E3", "REVISE", None, "w", 11, 15, 11, 16, "gamma", "gamm!"), (1, "E4", "REVISE", "z", "q", None, None, 16, 22, None, None), (1, "E9", "KEEP", "z", None, None, None, None, None, None, None),
    ]
    decisions = spark.createDataFrame(d, schema)
    one = corrections.apply_decisions(m, r, decisions, docs)
    two = corrections.apply_decisions(one["mentions"], one["relations"], decisions, docs)
    for out in (one, two):
        assert sorted((x["id"], x["start"], x["end"], x["surface"], x["norm"]) for x in out["mentions"].collect()) == [("E1", 0, 10, "alpha beta", "x"), ("E3", 11, 16, "gamma", None), ("E4", 17, 22, "delta", "z")]
        assert sorted((x["id"], x["problem"]) for x in out["violations"].collect()) == [("E3", "no_slice"), ("E4", "other_span"), ("E9", "no_item")]
    assert sorted((x["id"], x["reason"]) for x in one["quarantined_relations"].collect()) == [("R1", "rejected end: E2"), ("R3", "rejected end: E2")]
    assert two["quarantined_relations"].count() == 0 and [x["id"] for x in two["relations"].collect()] == ["R2"]


def test_legacy_outputs(spark):
    text = "In Acme Server 2.1 a Remote Code Execution flaw, see cve-2021-1234, lets Execution begin. acme server"
    rows = [
        (1, "a", 0, 1, "Configuration", " the Acme  Server 2.1 ", None), (1, "b", 5, 9, "Configuration", "acme server", None), (1, "c", 0, 1, "Configuration", "The Server", None),
        (1, "d", 0, 1, "Weakness", "a remote code execution in rce", None), (1, "e", 0, 1, "Weakness", "execution flaw", None), (1, "f", 0, 1, "Vulnerability", "(cve-2021-1234)", None),
        (1, "g", 0, 1, "Vulnerability", "a vulnerability that lets anyone in at once", None), (1, "h", 0, 1, "AttackTactic", "EXECUTION", None), (1, "i", 0, 1, "AttackTactic", "begin", None),
        (1, "j", 9, 9, "Configuration", "Acme Server", None), (1, "k", 0, 1, "Configuration", "Zeta", None), (1, "l", 0, 1, "Configuration", None, None), (2, "a", 0, 1, "Configuration", "x", None), (1, "m", 0, 1, "Other", "In", None),
    ]
    rel = [(1, "R1", "affects", "f", "a", 0, 1), (1, "R0", "affects", "f", "a", 0, 1), (1, "R2", "affects", "f", "k", 0, 1), (1, "R3", "affects", "a", "f", 0, 1), (1, "R4", "instantiates", "f", "d", 0, 1), (1, "R5", "affects", "f", "f", 0, 1)]
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    types = spark.createDataFrame([(t,) for t in ("Configuration", "Weakness", "Vulnerability", "AttackTactic")], "type string")
    sig = spark.createDataFrame(legacy.SIGNATURES, "type string, head_type string, tail_type string")
    m, r = legacy.legacy_clean(spark.createDataFrame(rows, M), spark.createDataFrame(rel, R), docs, sig, types)
    got = {x["id"]: (x["start"], x["surface"]) for x in m.collect()}
    at = {"a": "Acme Server", "b": "acme server", "d": "Remote Code Execution", "f": "cve-2021-1234"}
    # a small letter finds its own writing first; the tactic's is found in any case, in the weakness; "execution" stands within it too
    want = {k: (text.index(s), s) for k, s in at.items()} | {"e": (text.index("Execution"), "Execution"), "h": (text.index("Execution"), "Execution")}
    assert got == want
    assert sorted(x["id"] for x in r.collect()) == ["R0", "R4"]
    m, r = legacy.legacy_clean(spark.createDataFrame([], M), spark.createDataFrame([], R), docs, sig)
    assert m.count() == 0 and r.count() == 0


def plainly_healed(text, s, e):
    """The rule of evidence.healed character by character."""
    if not (0 <= s < e <= len(text)):
        return None
    word = lambda c: c.isalnum() or c in "-_"
    while s and word(text[s - 1]):
        s -= 1
    while e < len(text) and word(text[e]):
        e += 1
    for a, b in ("()", "[]"):
        if text[s:e].count(a) > text[s:e].count(b):
            for stop in range(e, min(len(text), e + 80) + 1):
                if text[s:stop].count(a) == text[s:stop].count(b):
                    e = stop
                    break
                if stop < len(text) and text[stop] in "\n\r•":
                    break
    if any(text[s:e].endswith(x) for x in (": [", ":[", ":")):
        while e > s and text[e - 1] in ": [":
            e -= 1
    if e > s and e < len(text) and text[e] in ".?!。" and not (text[e - 1].isdigit() and text[e + 1 : e + 2].isdigit()):
        e += 1
        while e < len(text) and text[e] in "\")]}'":
            e += 1
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    return (s, e) if s < e else None


def test_healed_spans(spark):
    rng = random.Random(9)
    rows, texts = [], []
    for d in range(60):
        texts.append("".join(rng.choices("ab1 ()[]:.\n•\"", k=rng.randint(0, 220))))
        rows += [(d, s, s + rng.randint(0, 30)) for s in (rng.randint(-1, 220) for _ in range(40))]
    rows += [(0, None, 3), (0, 3, None), (99, 0, 1)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    got = {(r["doc_id"], r["start"], r["end"]): (r["h_start"], r["h_end"], r["evidence"]) for r in evidence.heal_spans(spark.createDataFrame(rows, "doc_id int, start int, end int"), docs).collect()}
    want = {}
    for d, s, e in rows:
        h = plainly_healed(texts[d], s, e) if d < 60 and s is not None and e is not None else None
        if h:
            want[d, s, e] = (*h, texts[d][h[0] : h[1]])
    assert got == want and len(want) > 500


def test_evidence_of_products(spark):
    text = "Old text. The flaw hits Acme (a tool of many uses) badly. Beta is safe."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    m = spark.createDataFrame([(1, "E1", text.index("Acme"), text.index("Acme") + 4, "Configuration", "Acme", None), (1, "E2", text.index("Beta"), text.index("Beta") + 4, "Configuration", "Beta", None)], M)
    r = spark.createDataFrame([(1, "R1", "affects", "V", "E1", text.index("he flaw"), text.index("tool")), (1, "R2", "affects", "V", "E1", 0, 3)], R)
    got = {x["id"]: (x["evidence"], x["source"]) for x in evidence.evidence_of(m, r, docs).collect()}
    assert got == {"E1": ("The flaw hits Acme (a tool of many uses)", "affects"), "E2": ("Beta is safe.", "sentence")}


def test_list_items_and_table_rows(spark):
    from spanforge.operators import textscan

    rng = random.Random(5)
    pieces = ["•", "• ", " • ", "● ", "- ", "1. ", "12) ", "word", " ", "\t", "|", "| a ", "x.", "\n", "\n", "\n  "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(120)] + ["", "a | " + "b" * 2100 + " | c", "a\tb", "a\t ", "| |", "x | y | "]
    signs = textscan.BULLETS
    want = set()
    for d, text in enumerate(texts):
        at = 0
        for line in text.split("\n"):
            body = line.lstrip(" \t")
            digits = len(body) - len(body.lstrip("0123456789"))
            head = 1 if body[:1] and body[0] in "-*" + signs else digits + 1 if digits and body[digits : digits + 1] and body[digits] in ".)" else 0
            inner = [k for k, c in enumerate(line) if c in signs and (k == 0 or line[k - 1] in " \t") and line[k + 1 : k + 2] in (" ", "\t") and line[k + 1 : k + 2]]
            marks = sorted({*inner, *([0] if head and body[head : head + 1] in (" ", "\t") and body[head : head + 1] else [])})
            for s, e in zip(marks, [*marks[1:], len(line)]):
                if line[s:e].strip(" \t"):
                    want.add((d, at + s, at + e, "list"))
            cells = line.split("|") if line.count("|") >= 2 else line.split("\t") if "\t" in line else []
            if not marks and len(line) <= 2000 and sum(bool(c.strip(" \t")) for c in cells) >= 2:
                want.add((d, at, at + len(line), "table"))
            at += len(line) + 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {tuple(r) for r in textscan.blocks(docs).where("kind <> 'references'").collect()}
    assert got == want and {k for *_, k in want} == {"list", "table"}
