"""Candidates of a document rank for all its items, in rows of a bounded number of items."""

import random

from spanforge.operators import corrections


def test_ranked_candidates_of_documents(spark, monkeypatch):
    monkeypatch.setattr(corrections, "ITEMS", 3)
    rng = random.Random(7)
    name = lambda: "".join(rng.choices("abcé_", k=rng.randint(1, 8)))
    cpe = lambda: f"cpe:2.3:{rng.choice('ao')}:{name()}:{name()}:{rng.randint(1, 3)}:*:*:*:*:*:*:*"
    items = [(d, f"E{k}", cpe()) for d in range(2) for k in range(10)] + [(5, "E1", cpe()), (0, "bad", "x")]
    cands = [(d, cpe()) for d in (0, 1, 9) for _ in range(50)] + [(0, "x")]
    cands += [(d, c.replace(":1:*", ":2:*")) for d, c in cands]
    out = corrections.ranked_candidates(spark.createDataFrame(items, "doc_id long, id string, norm string"), spark.createDataFrame(cands, "doc_id long, criteria string"))
    got = {}
    for r in out.collect():
        got.setdefault((r["doc_id"], r["id"]), []).append((r["rank"], r["criteria"], r["score"]))
    family = lambda c: ":".join(c.split(":")[2:5])
    want = {}
    for d, i, norm in items[:20]:
        best = sorted((-corrections.family_similarity(family(norm), family(c)), c) for c in {c for e, c in cands if e == d and c != "x"})[:12]
        want[d, i] = [(k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert {k: sorted(v) for k, v in got.items()} == want
