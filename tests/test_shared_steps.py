"""Steps that several queries share: done once, and narrow."""

import random
import re

from pyspark.sql import functions as F

from spanforge.operators import dedup, terms, textscan
from spanforge.plans import fixtures


def _near_docs(spark, n=60):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    rows = []
    for k in range(n):
        own = [f"w{k // 3}x{j}" for j in range(60)]
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = f"z{rng.random()}"
        rows.append((k, " ".join(own + common if k % 2 else own)))
    rows += [(n + k, rows[k][1]) for k in range(10)] + [(n + 10, ""), (n + 11, None), (n + 12, "a b c d e"), (n + 13, "A b, c d e!")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _sets(docs):
    out = {}
    for d, t in docs.collect():
        w = [x for x in re.split(r"\W+", (t or "").lower()) if x]
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return out


def test_near_pairs_with_common_shingles(spark, monkeypatch):
    """whatever the sample says of the order, the pairs are all pairs."""
    docs = _near_docs(spark)
    first = {}
    for d, s in sorted(_sets(docs).items()):
        first.setdefault(s, d)
    reps = [(d, s) for s, d in first.items() if s]
    want = {(min(a, b), max(a, b)): len(x & y) / len(x | y) for i, (a, x) in enumerate(reps) for b, y in reps[:i] if len(x & y) >= 0.75 * len(x | y)}
    assert len(want) > 5
    for sample, most in ((1, 1000), (8, 1000), (1, 3)):
        monkeypatch.setattr(dedup, "SAMPLE", sample)
        monkeypatch.setattr(dedup, "MOST_HOT", most)
        assert {(r["a"], r["b"]): r["jaccard"] for r in dedup.near_pairs(docs).collect()} == want


def test_groups_make_shingles_once(spark, monkeypatch):
    """one pass over the texts serves copies and near copies."""
    made = []
    members = dedup.near_members
    monkeypatch.setattr(dedup, "near_members", lambda *a, **k: made.append(1) or members(*a, **k))
    assert dedup.duplicate_groups(_near_docs(spark)).where("doc_id >= 60 and doc_id < 70 and group_id >= 60").count() == 0
    assert len(made) == 1


def test_splits_need_no_scan(spark, monkeypatch):
    """texts are scanned for mentions only if a query asks for mentions."""
    scans = []
    scan = fixtures.scan
    monkeypatch.setattr(fixtures, "scan", lambda *a: scans.append(1) or scan(*a))
    a = fixtures.Annotations(spark, "/root/testdata/sf0.001")
    assert a.splits.count() == a.docs.count() and not scans
    assert a.gold.count() and a.pred.count() and len(scans) == 1


def test_hits_of_joined_keys_are_those_of_the_automaton(spark, monkeypatch):
    """keys of whole words are joined, and no bit map, however full, changes that."""
    rng = random.Random(7)
    alphabet = ["a", "b", "ab", "İx", "x_", "é", "٣", "c++", ".net", "a-b"]
    texts = ["".join(rng.choice(alphabet) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(25)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    low = [t.lower() for t in texts]
    keys = {k for t in low for _ in range(12) if (k := t[(i := rng.randrange(len(t) - 9)) : i + rng.randrange(1, 9)])}
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    found = lambda: sorted((r["doc_id"], r["start"], r["end"], r["surface"], r["key"]) for r in terms.term_hits(docs, table).collect())
    joined = found()
    monkeypatch.setattr(terms, "BITS", 64)
    assert found() == joined
    monkeypatch.setattr(terms, "MOST_WORDS", 0)
    assert found() == joined and len(joined) > 100


def test_no_pass_for_keys_of_words(spark, monkeypatch):
    """passes over the texts do not grow with the keys."""
    monkeypatch.setattr(terms, "AUTOMATON_CHARS", 5)
    monkeypatch.setattr(terms, "_automaton_hits", lambda *a: 1 / 0)
    docs = spark.createDataFrame([(1, "alpha beta, gamma")], "doc_id int, text string")
    keys = spark.createDataFrame([("alpha beta",), ("beta, gamma",), ("gamma",), ("amma",)], "key string")
    assert {r["key"] for r in terms.term_hits(docs, keys).collect()} == {"alpha beta", "beta, gamma", "gamma"}


def test_greedy_across_batches(spark):
    """one pass gives what replaying the whole order gives, wherever batches end."""
    rng = random.Random(1)
    rows = [(d, s, s + rng.randrange(0, 9), k) for d in (1, None, 2) for k, s in enumerate(rng.choices(range(60), k=25))]
    spans = spark.createDataFrame(rows, "doc_id int, start int, end int, k int").withColumn("shorter", F.expr("start - end"))
    want = set()
    for d in (1, None, 2):
        kept = []
        for s, e, k in sorted(((s, e, k) for x, s, e, k in rows if x == d), key=lambda x: (x[0] - x[1], x[2])):
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, k))
        want |= {(d, *x) for x in kept}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("2", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = textscan.greedy_non_overlap(spans, ["doc_id"], ["shorter", "k"]).collect()
            assert {(r["doc_id"], r["start"], r["end"], r["k"]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_sentences_without_exchange(spark):
    """Sentences come out of the rows of the documents."""
    rng = random.Random(2)
    texts = ["", None, ".", "a", "\n\n", "a. b", "x.\n", *("".join(rng.choices("ab .!?\n。é", k=rng.randrange(1, 30))) for _ in range(80))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for mode, pattern in textscan.SENTENCE_ENDS.items():
        got = textscan.sentences(docs, mode)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = set()
        for d, t in enumerate(texts):
            cuts = [0, *(m.end() for m in re.finditer(pattern, t or "")), len(t or "")]
            cuts = sorted({c for c in cuts if c < len(t or "")}) + [len(t or "")]
            want |= {(d, k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
        rows = [(r["doc_id"], r["k"], r["start"], r["end"]) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_matches_know_their_sentence(spark):
    """a match and its sentence come out of one row of the documents, without exchange."""
    rng = random.Random(4)
    texts = ["", None, "ab", *("".join(rng.choices("ab .!?\n。é", k=rng.randrange(1, 40))) for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for mode, pattern in textscan.SENTENCE_ENDS.items():
        got = textscan.scan_in_sentences(docs, "[ab]+", mode)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        starts = {d: sorted({0, *(m.end() for m in re.finditer(pattern, t or ""))}) for d, t in enumerate(texts)}
        want = {(d, m.start(), m[0], sum(s <= m.start() for s in starts[d]) - 1) for d, t in enumerate(texts) for m in re.finditer("[ab]+", t or "")}
        rows = [(r["doc_id"], r["start"], r["surface"], r["k"]) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
