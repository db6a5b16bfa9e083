"""Work that grows with the input, on plans and on inputs that once made it grow faster."""

import hashlib
import os
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.llm import near_sets, quality_lm
from spanforge.operators import audit, legacy, normalize, rank, stats, textscan
from spanforge.plans import queries
from spanforge.schema import dim_entity_type, dim_relation

M = "doc_id int, id string, start int, end int, type string, surface string, norm string"
R = "doc_id int, id string, type string, head string, tail string, ev_start int, ev_end int"


def nodes(plan):
    yield plan
    below = plan.children()
    for k in range(below.size()):
        yield from nodes(below.apply(k))


def windows_with(df, column):
    """Window operators whose rows carry a column; each of them is behind an exchange."""
    found = []
    for p in nodes(df._jdf.queryExecution().optimizedPlan()):
        out = p.output()
        if p.nodeName() == "Window" and column in {out.apply(k).name() for k in range(out.size())}:
            found.append(p.nodeName())
    return found


def small(spark):
    docs = spark.createDataFrame([(1, "alpha hits beta. then gamma")], "doc_id int, text string")
    m = spark.createDataFrame([(1, "E0", 0, 5, "Vulnerability", "alpha", "A"), (1, "E1", 11, 15, "Configuration", "betx", "B")], M)
    return docs, m, spark.createDataFrame([(1, "R0", "affects", "E0", "E1", 0, 15)], R)


def test_audit_keeps_texts_out_of_exchanges(spark):
    docs, m, r = small(spark)
    found = audit.structural(docs, m, r, dim_relation(spark))
    assert {(x["kind"], x["item_id"]) for x in found.collect()} == {("invalid_span", "E1")}
    assert not windows_with(found, "text")
    assert not windows_with(audit.postprocess(m, r, docs, textscan.sentences(docs), dim_relation(spark))[1], "text")


def test_cleaning_keeps_texts_out_of_exchanges(spark, monkeypatch):
    docs, m, _ = small(spark)
    monkeypatch.setattr(normalize, "stored", lambda df: df, raising=False)
    clean, counts = normalize.clean_records(m, docs, dim_entity_type(spark))
    assert [x["id"] for x in clean.collect()] == ["E0"] and counts.first()["text_mismatch"] == 1
    assert not windows_with(clean, "_t")


@pytest.mark.parametrize("pattern", ["[A-Za-z]{6,}", r"[.!?]\s+|\n{2,}", r"(?<!\S)•(?=\s)"])
def test_scan_without_exchange(spark, pattern):
    rng = random.Random(1)
    texts = ["".join(rng.choices(["\U0001f600", "é", "• ", "words", "a", ". ", "\n", "\n\n"], k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "wordsa", "• "]
    rows = textscan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), pattern)
    want = {(d, i, m.start(), m.end(), m.group()) for d, t in enumerate(texts) for i, m in enumerate(re.finditer(pattern, t or ""))}
    assert {tuple(r) for r in rows.collect()} == want and len(want) > 5
    assert not [p for p in nodes(rows._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Window"]


def test_pieces_of_a_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["\U0001f600", "é", "a", "\n", "\r"], k=n)) for n in (0, 1, 255, 256, 257, 512, 1500)]
    rows = [(t, s, e) for t in texts for s, e in ((rng.randint(-2, 1600), rng.randint(-2, 1600)) for _ in range(40))]
    df = spark.createDataFrame(rows, "t string, s int, e int").select("t", "s", "e", text.cut(text.pieces(F.col("t")), F.col("s"), F.col("e") - F.col("s")).alias("c"))
    df = df.withColumn("same", text.piece_span_is_exact(text.pieces(F.col("t")), F.col("s"), F.col("e"), F.col("c")))
    for r in df.collect():
        assert r["c"] == (r["t"][r["s"] : r["e"]] if 0 <= r["s"] <= r["e"] else None)
        assert r["same"] == (0 <= r["s"] < r["e"] <= len(r["t"]))


def test_cover_of_like_documents(spark, monkeypatch):
    """All gains fall to nothing after two picks; the bounds of all others stay."""
    df = spark.createDataFrame([(d, f) for d in range(2000) for f in range(3)], "doc_id int, f int").persist()
    counted = []
    plain = rank._recount
    monkeypatch.setattr(rank, "_recount", lambda *a: counted.append(1) or plain(*a))
    assert [r["doc_id"] for r in rank.coverage_batch(df, 5, 2).orderBy("rank").collect()] == [0, 1]
    assert len(counted) <= 8


def test_legacy_reduces_once(spark, monkeypatch):
    docs, m, r = small(spark)
    kept = []
    monkeypatch.setattr(legacy, "stored", lambda df: kept.append(df) or df.persist(), raising=False)
    out, _ = legacy.legacy_clean(m, r, docs, spark.createDataFrame(legacy.SIGNATURES, "type string, head_type string, tail_type string"))
    assert [(x["id"], x["start"], x["surface"]) for x in out.collect()] == [("E0", 0, "alpha")]
    assert len(kept) == 3, "each reduction and the result are tables, read as often as they are asked for"


def test_dangling_is_judged_at_the_very_end(spark):
    docs = spark.createDataFrame([(1, "some,\nmore,")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "E0", "some", 0, 4, "some,\n", 0, 6), (1, "E1", "more", 6, 10, "more,", 6, 11)], "doc_id int, id string, surface string, start int, end int, evidence string, ev_start int, ev_end int")
    assert audit.verify_evidence(items, docs).first()["n_dangling"] == 1


def against_sql(spark, tmp_path, name, texts):
    path = os.path.join(tmp_path, "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    got = queries.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return sorted(map(tuple, got.collect())), sorted(c.execute(queries.ORACLE_SQL[name]).fetchall())


def test_governed_headings_begin_where_they_are_planted(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "governed_facts", ["The threat and of it. A cyber threat and of that.", "x and of y."])
    assert got == want and len(want) == 4


def test_quality_model_takes_all_trusted_rows(spark):
    docs = spark.range(50_400).selectExpr("id as doc_id", "'en' as lang", "'some words' as text")
    want = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0).count()
    assert quality_lm.perplexities(docs, docs.select("doc_id")).where("held").count() == want > 12_000


@pytest.mark.parametrize("prefix", [b"0:17:", b"x" * 45 + b":3:", b"s" * 80])
def test_draws_are_the_keyed_hashes(prefix):
    for lo, hi in ((0, 1205), (9990, 10010), (5, 5)):
        want = [int(hashlib.md5(prefix + str(d).encode()).hexdigest()[:12], 16) for d in range(lo, hi)]
        assert stats.md5_numbers(prefix, lo, hi).tolist() == want


def test_bootstrap_has_no_row_for_a_draw(spark, monkeypatch):
    """Several portions of draws and blocks of documents; rows that add up, a null id, a rare metric."""
    rng = random.Random(5)
    rows = [(m, "f", d, *(rng.randint(0, 4) for _ in range(3))) for m in "ab" for d in [None, *range(38)] for _ in range(1 + (d == 3))] + [("a", "rare", 7, 1, 0, 2)]
    c = spark.createDataFrame(rows, "method string, metric string, doc_id int, tp int, fp int, fn int")
    monkeypatch.setattr(stats, "DRAWS", 11)
    monkeypatch.setattr(stats, "BLOCK_DRAWS", 20 * 8)
    df = stats.bootstrap(c, 20, "s")
    want = {}
    for r in range(20):
        sums = {}
        for d in range(39):
            k = int(hashlib.md5(f"s:{r}:{d}".encode()).hexdigest()[:12], 16) % 39  # 0 is the null id
            for m, q, doc, *n in rows:
                if doc is not None and doc + 1 == k:
                    sums[m, q] = [x + y for x, y in zip(sums.get((m, q), (0, 0, 0)), n)]
        want |= {(r, m, q): 2 * tp / max(1, 2 * tp + fp + fn) for (m, q), (tp, fp, fn) in sums.items()}
    got = {(x["replicate"], x["method"], x["metric"]): x["f1"] for x in df.collect()}
    assert got == pytest.approx(want) and 40 < len(want) < 60
    assert sum(int(str(p.numElements())) for p in nodes(df._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Range") <= 20 * 4


def test_product_ids_are_split_once(spark):
    ids = ["cpe:2.3:a:v\\\\:x:p:1.0:*:*:*:*:*:*:*", "CPE:2.3:H:V:P:-:*:*:*:*:*:*:*", "cpe:2.3:a:-:p:1:*:*:*:*:*:*:*", "cpe:2.3:a", "", None]
    df = spark.createDataFrame([(x,) for x in ids], "x string").select(text.product_family(F.col("x")).alias("f"), text.product_version(F.col("x")).alias("v"), text.is_product_id(F.col("x")).alias("ok"))
    assert [tuple(r) for r in df.collect()] == [("a:v\\\\:x:p", "1.0", True), ("h:v:p", "-", True)] + [(None, None, False)] * 4
    family = spark.range(1).select(text.product_family(F.lit("cpe")).alias("f"))
    assert str(family._jdf.queryExecution().analyzed()).count("split(") == 1


@pytest.mark.parametrize("step", [quality_lm._counts, quality_lm._present])
def test_quality_steps_hold_little(step):
    rng = random.Random(2)
    texts = ["".join(rng.choices("some words, AND 12\n", k=2000)) for _ in range(2400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2400)), pa.array([f"l{k % 6}" if k % 7 else None for k in range(2400)]), pa.array(texts)], names=["id", "lang", "t"])
    tracemalloc.start()
    got = {}
    for out in step([batch]):
        for lang, gram in zip(*(out.column(c).to_pylist() for c in (0, 1))):
            got.setdefault(lang, set()).add(gram)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = {}
    for k, t in enumerate(texts):
        gram, first, end = quality_lm._grams([t])
        want.setdefault(f"l{k % 6}" if k % 7 else "", set()).update(gram[first[0] : end[0]].tolist())
    assert got == want and peak < 100e6


def test_prefixes_leave_in_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(range(700)), pa.array([f"a b c d e f {k} g h i j" if k % 5 else None for k in range(700)])], names=["id", "row_key", "t"])
    out = list(near_sets._prefix_rows([batch], np.empty(0, np.uint64), 5, 0.8))
    assert [b.num_rows for b in out] == [256, 256, 188]
    assert [k for b in out for k in b["id"].to_pylist()] == list(range(700))
    for b in out:
        for k, n, prefix in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["prefix"].to_pylist()):
            h = near_sets.shingle_set((batch["t"][k].as_py() or "").encode(), 5).view(np.int64).tolist()
            assert n == len(h) and prefix == h[: n - -(-n * 4 // 5) + 1 if n else 0]
