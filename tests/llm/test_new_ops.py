"""Hard negatives, token alignment and WARC bundles against brute force, on small frames with odd rows."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import hard_negatives, token_align, warc

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# ---- 11 ----
def mined_brute(rows, every, positives=5, negatives=3, low=50, high=95):
    """rows: id -> (label, whole-number vector)."""
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    for a in (i for i in rows if i % every == 0):
        pos = sorted((-score(a, b), b) for b in rows if b != a and rows[b][0] == rows[a][0])[:positives]
        neg = sorted((-score(a, b), b) for b in rows if rows[b][0] != rows[a][0])
        for p, i in pos:
            found = [(-s, j) for s, j in neg if low * -p <= 100 * -s <= high * -p][:negatives]
            out |= {(a, i, k, j, -p, s) for k, (s, j) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block, shard, scale", [(8192, 65536, 1.0), (20, 90, 1.0), (20, 90, 1e15)])
def test_hard_negatives(spark, monkeypatch, block, shard, scale):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", block)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", shard)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 6))
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in (centre[i % 5] + 0.3 * rng.normal(size=6)) * scale]) for i in range(400)]
    rows += [(400 + k, k % 3, rows[7][2]) for k in range(60)]  # one vector many times: ties
    odd = [(None, 1, rows[0][2]), (900, None, rows[0][2]), (950, 1, None), (951, 1, [1.0, None, 2.0]), (952, 1, [float("nan")] * 6), (953, 1, [float("inf")] * 6)]
    rows += [(1000, 1, []), (1001, 2, [0.0] * 6), (1050, 0, [1.5, 2.5]), (1100, 1, [-1.0] * 6)]
    want = {i: (y, [int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v))) for i, y, v in rows}
    df = spark.createDataFrame(rows + odd + rows[:9], "vec_id long, label int, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("vec", F.lit(1))
    if scale > 1:  # scores beyond a long are refused, so one component only
        df = df.withColumn("embedding", F.transform(F.slice("embedding", 1, 1), lambda x: x / 1e10))
        want = {i: (y, [int(np.floor(256 * (v[0] / 1e10)))] if v else [0]) for i, y, v in rows}
    got = hard_negatives.mine(hard_negatives.quantized(df, "vec_id", F.col("label"), "embedding"), F.col("id") % 50 == 0).collect()
    assert len(got) == len({(r["anchor_id"], r["positive_id"], r["rank"]) for r in got})
    assert {tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got} == mined_brute(want, 50)
    assert got


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    q = lambda d: hard_negatives.mine(hard_negatives.quantized(d, "vec_id", F.col("label"), "embedding"), F.col("id") % 50 == 0)
    assert q(df).count() == 0
    assert q(spark.createDataFrame([(1, 1, [1.0]), (3, 2, [1.0])], "vec_id long, label int, embedding array<float>")).count() == 0


def test_walk_ends_early():
    """Rows are in the order of a true bound, and tight clusters walk a short part of the list."""
    rng = np.random.default_rng(0)
    centre = np.zeros(16)
    centre[0] = 1
    v = np.floor(256 * rng.normal(size=(3000, 16)))
    u = np.floor(2560 * (centre + 0.01 * rng.normal(size=(20, 16))))
    order, bound = hard_negatives.shared_list(v, u, centre)
    assert (np.diff(bound) <= 0).all()
    s = u @ v[order].T
    norm = np.sqrt((u * u).sum(1))
    assert (s <= norm[:, None] * bound[None]).all()
    fifth = np.sort(s, axis=1)[:, -5]
    assert (norm[:, None] * bound[None] >= fifth[:, None]).sum(1).max() < 300


# ---- 12 ----
class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        hidden = [c for c in range(256) if c not in shown]
        self.letter = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(hidden)}

    def sides(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.letter[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def aligned_brute(texts):
    plain, per, counts = Plain(), {}, Counter()
    for i, text in texts.items():
        a, b = plain.sides(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for t, x in side:
                out.append((t, at, at + len(x)))
                at += len(x)
            spans.append(out)
        ends = [{e for _, _, e in s} for s in spans]
        cuts = sorted(ends[0] & ends[1])
        groups = [[[t for t, _, e in s if lo < e <= hi] for s in spans] for lo, hi in zip([0, *cuts], cuts)]
        k, links = 0, []
        for x in spans[0]:
            while k and spans[1][k - 1][2] > x[1]:
                k -= 1
            for y in spans[1][k:]:
                if y[1] >= x[2]:
                    break
                if y[2] > x[1]:
                    links.append((x[0], y[0]))
                k += 1
        counts.update(links)
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        per[i] = (len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else "")
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return {i: (na, nb, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), d) for i, (na, nb, g, ls, d) in per.items()}


ODD = [None, "", " ", "  ", "a ", "\n", " \t x\r\n", "literal ▁ sign", "<|endoftext|> <s> </s> <unk> <0x41>", "\0 nul", "漢字かな交じり文 😀😀 é", "x" * 3000, " " * 2000, "ab\n cd\n\n  ef", "it's 'll we've", "same words here " * 400]


@pytest.mark.parametrize("head", [token_align.HEAD_PAIRS, 200, 0])
def test_token_alignment(spark, head):
    rng = random.Random(2)
    words = ["the", "zyx", "alignment", "über", "42", "don't", "—", "naïve", "<s>", "qq"]
    texts = dict(enumerate([*ODD, *(" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60))]))
    df = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id")], "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("row", F.lit(0))
    extra = {"n": "a null id", "r1": "a repeated id", "r2": "a repeated id"}
    want = aligned_brute(texts | extra)
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = token_align.align(df, A_PATH, B_PATH, head_pairs=head).collect()
    found = Counter((r["id"], *(r[c] for c in cols)) for r in got)
    assert found == Counter([*((i, *want[i]) for i in texts), (None, *want["n"]), (3, *want["r1"]), (3, *want["r2"])])
    assert token_align.align(df.limit(0), A_PATH, B_PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 9), min_size=1, max_size=80), st.lists(st.integers(1, 9), min_size=1, max_size=80)), min_size=1, max_size=4))
def test_shared_cuts(texts):
    """Any ends: every shared one is found, near the middle or not."""
    at, ends_a, ends_b, last = 0, [], [], []
    for a, b in texts:
        a, b = np.cumsum(a), np.cumsum(b)
        size = max(a[-1], b[-1]) + 1
        ends_a += [*(a + at), size + at]
        ends_b += [*(b + at), size + at]
        last.append(len(ends_a) - 1)
        at += size
    got = token_align.shared_cuts(np.array(ends_a), np.array(ends_b), np.array(last))
    assert got.tolist() == [x in set(ends_b) for x in ends_a]


# ---- 13 ----
def roles_brute(rows):
    """(page_id, bytes, digest, type, refers_to), sorted."""
    groups, out = defaultdict(list), []
    for i, url, t in rows:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        raw = t.encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out += [(i, len(raw), sha, "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


PAGES = [
    (5, "http://a/x y\r\nX: 1", "<p>one</p>"), (3, "http://b/é", "<p>one</p>"), (9, None, None), (8, "http://c", ""), (1, "http://d", "é漢😀\r\n\r\nWARC/1.1"), (2, "http://" + "u" * 5000, "x" * 300_000),
    (4, "http://e", "x" * 300_000), (None, "http://f", "only"), (7, "http://g", "twice"), (7, "http://g", "twice"), (7, "http://h", "twice"), (6, "http://g", "more"), (None, "n", "<p>one</p>"), (5, "http://a/other", "<p>one</p>"),
] + [(11, "http://r", "again")] * 2500


@pytest.mark.parametrize("frame, bundle", [(warc.FRAME_BYTES, warc.BUNDLE_BYTES), (2000, 4000)])
def test_warc(spark, frame, bundle):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("id", F.lit("clash")).withColumn("payload", F.lit(1)).repartition(3)
    index = warc.write(df, frame_bytes=frame, bundle_bytes=bundle)
    got = warc.read(spark, index).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == roles_brute(PAGES)
    names = [r["record_id"] for r in got]
    assert len(set(names)) == len(names) == index.count()
    # a revisit's target is a response with the same digest; payloads come back whole
    response = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    assert {(r["page_id"], r["payload"].decode()) for r in response.values()} == {(i, t) for i, t in {(1, PAGES[4][2]), (2, "x" * 300_000), (3, "<p>one</p>"), (8, ""), (None, "only"), (7, "twice"), (6, "more"), (11, "again")}}
    # one record by its place: one frame of one bundle
    rows = {r["record_id"]: r for r in index.collect()}
    some = spark.createDataFrame([(n,) for n in names[:40]] + [("urn:page:no",)], "record_id string")
    for r in warc.lookup(index, some).collect():
        fields, block, end = warc.parse_record(r["record"])
        assert fields["warc-record-id"] == f"<{r['record_id']}>" and end == len(r["record"]) == rows[r["record_id"]]["length"]
    # any Zstandard reader sees the records one after another; frames stand on their own
    for path in {r["path"] for r in rows.values()}:
        raw = open(path.removeprefix("file://"), "rb").read()
        stream = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        frames = warc.Frames(path)
        assert stream == b"".join(frames.read(k) for k in range(len(frames.sizes)))
        at, n = 0, 0
        while at < len(stream):
            fields, _, at = warc.parse_record(stream, at)
            n += 1
        assert n == sum(r["path"] == path for r in rows.values())
    assert warc.read(spark, warc.write(df.limit(0))).count() == 0


def test_warc_least_bytes_and_damage(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (2, "u", "aa"), (3, "v", "a" * 50), (4, "v", "a" * 50)], "page_id long, url string, html string")
    got = warc.read(spark, warc.write(df, least_bytes=10)).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["record_type"] == "response") == [(1, "response", None), (2, "response", None), (2, "response", None), (3, "response", None)]
    assert len({r["record_id"] for r in got}) == 5
    fields, block, _ = warc.parse_record(warc.record_bytes("response", "urn:x", None, b"abc", warc.digest(b"abd")))
    with pytest.raises(ValueError):
        warc.payload_of(fields, block)


@pytest.mark.parametrize("name, table", [("op11_hard_negatives", "embeddings"), ("op13_warc", "pages")])
def test_sql_of_new(spark, name, table):
    from spanforge.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    rows = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, (float, np.number)) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(want) == rows(got)
