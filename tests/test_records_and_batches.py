"""Records streamed out of large files, and the lazy greedy cover against the plain one."""

import gzip
import json
import random

import pytest

from spanforge.operators import rank
from spanforge.sources import records, tables


def cut(text, n):
    return [text[k : k + n] for k in range(0, len(text), n)]


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_array_records(n):
    rng = random.Random(n)
    odd = ['"', "\\", "{", "}", "[", "]", "é", "漢", "a", ":", ",", "\n"]
    for _ in range(30):
        word = lambda: "".join(rng.choices(odd, k=rng.randint(0, 6)))
        thing = lambda d: {word(): (word() if d == 0 else [thing(d - 1), word(), 3, None]) for _ in range(rng.randint(0, 3))}
        data = {"keys": [thing(2) for _ in range(rng.randint(0, 4))], "other": [thing(1)], "in": {"keys": [thing(1)]}, "more": [thing(1), 5, [thing(0)], thing(0)]}
        text = json.dumps(data, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        got = [(k, json.loads(r)) for k, r in records.array_records(cut(text, n), {"keys", "more"})]
        assert got == [("keys", x) for x in data["keys"]] + [("more", x) for x in data["more"] if isinstance(x, dict)]
    with pytest.raises(ValueError):
        list(records.array_records(cut('{"keys": [{"a": 1}, {"b"', n), {"keys"}))


def test_large_feed_is_streamed(spark, tmp_path):
    """No piece of a file is larger than asked for; a file that breaks off is told of."""
    folder = tmp_path / "feed"
    folder.mkdir()
    item = lambda k: {"cve": {"id": f"CVE-2021-{10000 + k}", "note": "x" * 500, "configurations": [{"nodes": [{"cpeMatch": [{"criteria": f"cpe:2.3:a:v:p{k}\\:x:1:*:*:*:*:*:*:*"}]}]}]}}
    whole = json.dumps({"format": "x", "vulnerabilities": [item(k) for k in range(3000)]})
    with gzip.open(folder / "2021.json.gz", "wt") as f:
        f.write(whole)
    (folder / "2022.json").write_text(whole[:5000])
    (folder / "_manifest.json").write_text("{}")
    got = records.read_records(spark, str(folder), ["vulnerabilities"], piece=4096)
    rows = got.collect()
    n = sum(r["record"] is not None for r in rows if r["file"].endswith(".gz"))
    assert n == 3000 and max(len(r["record"]) for r in rows if r["record"]) < 1000
    bad = tables.unreadable_feeds(spark, str(folder)).collect()
    assert [r["file"].rsplit("/", 1)[1] for r in bad] == ["2022.json"] and "ends inside" in bad[0]["error"]
    feed = tables.read_feed(spark, str(folder), 3)
    assert feed.where("file like '%.gz'").count() == 3000
    assert feed.where("record = 'CVE-2021-10007'").first()["criteria"] == "cpe:2.3:a:v:p7\\:x:1:*:*:*:*:*:*:*"


def greedy(features, k, need):
    have, chosen = {}, []
    for _ in range(k):
        gain = {d: sum(have.get(f, 0) < need for f in fs) for d, fs in features.items() if d not in chosen}
        best = min(gain, key=lambda d: (-gain[d], d), default=None)
        if best is None or not gain[best]:
            break
        chosen.append(best)
        for f in features[best]:
            have[f] = have.get(f, 0) + 1
    return chosen


@pytest.mark.parametrize("head, batch, need", [(1024, 32, 1), (4, 2, 2), (1, 1, 1)])
def test_lazy_cover(spark, monkeypatch, head, batch, need):
    monkeypatch.setattr(rank, "HEAD", head)
    monkeypatch.setattr(rank, "RECOUNT", batch)
    rng = random.Random(head)
    features = {d: set(rng.sample(range(30), rng.randint(1, 9))) for d in range(120)}
    counted = []
    plain = rank._recount
    monkeypatch.setattr(rank, "_recount", lambda f, docs, chosen, n: counted.append(len(docs)) or plain(f, docs, chosen, n))
    df = spark.createDataFrame([(d, f) for d, fs in features.items() for f in fs], "doc_id int, f int").repartition(2).persist()
    got = [r["doc_id"] for r in rank.coverage_batch(df, 6, need).orderBy("rank").collect()]
    assert got == greedy(features, 6, need)
    assert sum(counted) < 6 * 120 / 2, "far fewer gains are counted than by counting all of them at every pick"
    assert rank.coverage_batch(df.limit(0), 3).count() == 0


def test_anchored_backfill(spark):
    from spanforge.operators import link, textscan

    rng = random.Random(12)
    texts, anchors, seeds, existing = {}, [], [], []
    for d in range(25):
        words = rng.choices(["aa", "aab", "b", "b aa", "CVE", "x"], k=rng.randint(3, 25))
        texts[d] = " ".join(w + rng.choice(["", "", ".", "\n"]) for w in words)
        anchors += [(d, k) for k in range(len(texts[d])) if texts[d].startswith("CVE", k)]
        seeds += [(d, s) for s in rng.sample(["aa", "aab", "b aa", "b", "zz"], 3)]
        s = rng.randint(0, len(texts[d]) - 1)
        existing += [(d, s, s + 2)]
    want = set()
    for d, text in texts.items():
        cuts = [0, *[k + 1 for k, c in enumerate(text) if c in ".\n"], len(text)]
        for lo, hi in zip(cuts, cuts[1:]):
            if not any(a == d and lo <= k < hi for a, k in anchors):
                continue
            hits = [(-len(s), lo + text[lo:hi].index(s), s) for e, s in seeds if e == d and s in text[lo:hi]]
            hits = [(n, a, s) for n, a, s in hits if not any(e == d and a < y and a - n > x for e, x, y in existing)]
            taken = []
            for n, a, s in sorted(hits):
                if all(a - n <= x or a >= y for x, y in taken):
                    taken.append((a, a - n))
                    want.add((d, a, a - n, s))
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = link.anchored_backfill(spark.createDataFrame(seeds, "doc_id int, surface string"), textscan.sentences(docs, "dot"), docs, spark.createDataFrame(anchors, "doc_id int, start int"), spark.createDataFrame(existing, "doc_id int, start int, end int"))
    assert {(r["doc_id"], r["start"], r["end"], r["surface"]) for r in got.collect()} == want and len(want) > 10


def test_quota_batch(spark):
    positives = spark.createDataFrame([(d,) for d in range(20)], "doc_id int")
    features = spark.createDataFrame([(d, f"f{d % 9}") for d in range(60)], "doc_id int, f string")
    turns = [{r["doc_id"]: r["part"] for r in rank.quota_batch(positives, features, 8, t).collect()} for t in range(4)]
    for t in turns:
        assert len(t) == 8 and sum(p == "positive" for p in t.values()) == 6 and all(d < 20 for d, p in t.items() if p == "positive")
    first = [{d for d, p in t.items() if p == "positive"} for t in turns]
    assert not first[0] & first[1] and len(set().union(*first)) == 20, "turns go around the ring"
