"""Seeds and the backfill from them against brute force."""

import random
import re

from spanforge.operators import backfill, textscan

P = "doc_id int, start int, surface string, norm string"


def test_seeds(spark):
    rows = [
        (1, 0, "Microsoft Exchange Server", None), (1, 40, "exchange", "x1"), (1, 50, "Acme Portal application", "a"), (1, 60, "ZCS", "z"), (1, 70, "zcs", "no"), (1, 80, "VPN", None), (1, 90, None, None),
        (1, 99, " Fortinet  FortiOS devices ", None), (1, 110, "cpe:2.3:a:b", None), (2, 0, "server", None), (2, 9, "SQL Server", None), (None, 0, "Nobody", None),
    ]
    pairs = [(1, 5, "ZCS", "Zimbra Old"), (1, 9, "ZCS", "Zimbra Suite"), (2, 0, "ZCS", "Other Suite")]
    got = backfill.seeds(spark.createDataFrame(rows, P), spark.createDataFrame(pairs, "doc_id int, start int, short string, long string"))
    of = {(r["doc_id"], r["rank"]): (r["seed"], r["norm"]) for r in got.collect()}
    first = ["Microsoft Exchange Server", "Microsoft Exchange", "Exchange Server", "Exchange", "Acme Portal", "ZCS", "Zimbra Suite", "Fortinet  FortiOS", "FortiOS"]
    assert [of[1, k + 1][0] for k in range(len(of) - 1)] == first
    assert of[1, 4] == ("Exchange", None) and of[1, 5][1] == "a" and of[1, 7][1] == "z", "an id belongs to the spelling that has it"
    assert {k: v for k, v in of.items() if k[0] == 2} == {(2, 1): ("SQL Server", None)}
    assert backfill.seeds(spark.createDataFrame([], P)).count() == 0


def test_trim_nouns(spark):
    rows = [(1, "a", 3, 16, "Configuration", "Portal server", None), (1, "b", 0, 10, "Configuration", "SQL Server", None), (1, "c", 0, 13, "Weakness", "Portal server", None)]
    got = backfill.trim_nouns(spark.createDataFrame(rows, "doc_id int, id string, start int, end int, type string, surface string, norm string"))
    assert {r["id"]: (r["end"], r["surface"]) for r in got.collect()} == {"a": (9, "Portal"), "b": (10, "SQL Server"), "c": (13, "Portal server")}


def test_backfill(spark):
    rng = random.Random(3)
    texts, found, anchors, mentions = {}, [], [], []
    names = ["Alpha", "alpha beta", "Beta", "C++", "gamma_x", "Alpha Beta Node", ".NET", "delta-one"]
    for d in range(40):
        words = rng.choices([*names, "CVE", "betas", "x.exe", "Log file", "filler words here and there", "BETA"], k=rng.randint(3, 40))
        texts[d] = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", ""]) for w in words)
        anchors += [(d, m.start()) for m in re.finditer("CVE", texts[d])]
        found += [(d, s, s.upper() if rng.random() < 0.5 else None, k) for k, s in enumerate(rng.sample(names, 5))]
        s = rng.randint(0, len(texts[d]) - 1)
        mentions += [(d, s, s + 4)]
    want = set()
    for d, text in texts.items():
        cuts = [0, *[k + 1 for k, c in enumerate(text) if c in ".\n"], len(text)]
        for lo, hi in zip(cuts, cuts[1:]):
            if not any(a == d and lo <= k < hi for a, k in anchors):
                continue
            taken = []
            for _, seed, norm, _ in sorted((f for f in found if f[0] == d), key=lambda f: (-len(f[1]), f[3])):
                for k in range(lo, hi - len(seed) + 1):
                    e = k + len(seed)
                    if text[k:e].lower() != seed.lower() or re.match(r"\w\w", text[e - 1 : e + 1]) or (k > 0 and re.match(r"\w\w", text[k - 1 : k + 1])):
                        continue
                    if any(k < y and e > x for x, y in taken) or any(m == d and k < y and e > x for m, x, y in mentions) or re.search(backfill.NOISE, text[max(0, k - 30) : e + 30]):
                        continue
                    taken.append((k, e))
                    want.add((d, k, e, text[k:e], norm))
                    break
    docs = spark.createDataFrame([*texts.items(), (99, None), (98, "")], "doc_id int, text string")
    sents = textscan.sentences(docs, "dot")
    args = spark.createDataFrame(mentions, "doc_id int, start int, end int"), spark.createDataFrame(found, "doc_id int, seed string, norm string, rank int"), sents
    got = backfill.backfill(docs, *args, spark.createDataFrame(anchors, "doc_id int, start int"))
    assert {(r["doc_id"], r["start"], r["end"], r["surface"], r["norm"]) for r in got.collect()} == want and len(want) > 30
    assert backfill.backfill(docs, *args, spark.createDataFrame([], "doc_id int, start int")).count() == 0
