"""The ten operators and the pipeline against brute force, on small frames with odd rows."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import exact_dedup, html_extract, mixing, packing, pii, quality_lm, simhash, suffix_array, suffix_dedup, url_filter, weak_rules
from spanforge.llm.common import connected_components

DATA = "/root/testdata/sf0.001"
LOREM = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in old copper kettles"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, a long text, copies in other case, passages, and a clashing column."""
    passage = "This passage of well over one hundred bytes is repeated in several documents, é and all, to be removed where it comes again. " * 2
    rows = [
        (1, LOREM, "en", "a"), (2, LOREM.upper(), "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, "   \n\t ", "fr", "b"),
        (6, passage + "one", "en", "a"), (7, "two " + passage, "en", "b"), (8, "x" * 350, "de", "c"), (9, "x" * 120, "de", "c"),
        (10, " ".join(f"w{k}" for k in range(6000)), "en", "c"), (11, LOREM + " again", "en", "a"), (12, "a b", "en", "d"), (13, "ÀÉ éà <|endoftext|> İstanbul's", "fr", "d"),
        (14, passage + "one", "en", "a"), (15, LOREM, "en", "e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(0))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def lower_az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ---- 1 ----
def test_pii(spark):
    rows = [
        (1, "mail ann.lee@mail.example.com or ANN.LEE@MAIL.EXAMPLE.COM, call +1 (017) 555-7713."), (2, "call +1-017-555-7713 or ann.lee@mail.example.com"),
        (3, None), (4, ""), (5, "nothing here, 4.0. and 12"), (6, "card 4068516892505468 ip 132.201.103.247 and 8.8.8.8."), (7, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"'),
        (8, "Mrs Anna Petrova met Mr Petrova and Госпожа Иванова"), (5, "nothing here, 4.0. and 12"), (9, "x" * 400_000 + " a@b.example.com"),
    ]
    out = pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    got = {r["id"]: r["text"] for r in out}
    assert len(out) == len(rows)
    assert got[3] is None and got[4] == "" and got[5] == rows[4][1]
    mails = re.findall(r"[\w.]+@[\w.]+\w", got[1] + " " + got[2])
    assert len({m.lower() for m in mails}) == 1 and mails[1].isupper() and mails[0] != "ann.lee@mail.example.com"
    assert re.sub(r"\D", "", re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])[0]) == re.sub(r"\D", "", re.search(r"\+1-\d{3}-\d{3}-\d{4}", got[2])[0]) != "10175557713"
    assert re.fullmatch(r"card 4\d{15} ip (\d+\.){3}\d+ and (\d+\.){3}\d+\.", got[6]) and "4068516892505468" not in got[6] and "8.8.8.8" not in got[6]
    assert got[9].startswith("x" * 400_000 + " ") and "a@b" not in got[9]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[7]) and "f3ef4d" not in got[7]
    m = re.fullmatch(r"Mrs (\w+) (\w+) met Mr (\w+) and Госпожа ([А-Яа-я]+)", got[8])
    assert m and m[2] == m[3] and m[1] in pii.GIVEN["latin", "f"] and "Petrova" not in got[8] and "Иванова" not in got[8]
    assert pii.replace_pii(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pii_persons_secrets_and_checks(spark):
    """Distinct persons, secrets and numbers stay distinct, equal ones equal, over all texts."""
    men = [f"{g} {s}" for s in ("Smith", "Baker") for g in ("John", "Peter", "James", "Thomas", "Michael", "Adam", "Hugo", "Emil", "Felix", "Carl", "Leon", "Oscar", "Paul", "Simon", "Victor", "Ivan", "Jonas", "Georg", "David", "Bruno")]
    secrets = ["sk-" + "aB3" * 8, "sk-" + "Ab3" * 8]
    rows = [(k, f"{'Mr ' if k % 2 else ''}{m} lives here. MR {m.upper()} too, and Mr {m.split()[1]}.") for k, m in enumerate(men)]
    rows += [(100, "Mrs Anna Petrova met Mrs Olga Petrova and Dr Anna Petrova"), (101, f"{secrets[0]} {secrets[1]}"), (102, "card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32."), (103, "Clara Jones, 12 Baker Street; Berliner Hauptstraße 5b and 7 rue de Rivoli 12")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("canon", F.lit(2))
    got = {r["id"]: r["text"] for r in pii.replace_pii(df.union(df.limit(3)), "k").collect()}
    made = {}
    for k, m in enumerate(men):
        t = re.fullmatch(r"(?:Mr )?(\S+) (\S+) lives here\. MR (\S+) (\S+) too, and Mr (\S+)\.", got[k])
        assert t and (t[3], t[4], t[5]) == (t[1].upper(), t[2].upper(), t[2]), got[k]
        made[m] = (t[1], t[2])
    assert len(set(made.values())) == len(men) and len({x[1] for x in made.values()}) == 2 and not {" ".join(x) for x in made.values()} & set(men)
    a = re.fullmatch(r"Mrs (\S+) (\S+) met Mrs (\S+) (\S+) and Dr (\S+) (\S+)", got[100])
    assert a[1] == a[5] != a[3] and a[2] == a[4] == a[6] and {a[1], a[3]} <= set(pii.GIVEN["latin", "f"])
    x, y = got[101].split()
    assert x != y and x not in secrets and re.fullmatch("sk-([a-z][A-Z][0-9]){8}", x) and re.fullmatch("sk-([A-Z][a-z][0-9]){8}", y)
    c = re.fullmatch(r"card (4\d{3}(?: \d{4}){3}), IBAN (GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d)\.", got[102])
    assert c[1] != "4111 1111 1111 1111" and luhn(c[1].replace(" ", ""))
    iban = c[2].replace(" ", "")
    assert int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1 and "WEST" not in iban
    assert "Jones" not in got[103] and "Baker" not in got[103] and "Hauptstraße 5" not in got[103] and "Rivoli" not in got[103]
    assert re.search(r", \d\d \w+ Street; Berliner \w+straße \d", got[103]) and re.search(r" rue de \w+ \d\d$", got[103])


def test_pii_more_forms(spark):
    """Names in several parts, particles, capitals, mails of one domain, IPv6; versions stay."""
    rows = [
        (1, "Ravi Kumar spoke to Wei Zhang."), (2, "Mary Anne Jones-Lee met John Q. Public."), (3, "Mr. Marco d'Arc and Dr. von Berg, then Anna van der Meer."), (4, "ADAM SMITH and Adam Smith; ANNA IS here"),
        (5, "from 2001:db8::ff00:42:8329 and 2001:DB8::FF00:42:8329, fe80:0:0:0:1:2:3:4; std::cout at 12:30:45, a::b"), (6, "version 1.2.3.4, v1.2.3.4, Release 10.0.0.1 but 10.0.0.1"),
        (7, "ann@corp.example.com, bob@corp.example.com, cid@other.example.com"), (8, " ".join(f"{c}@x.example.com" for c in "abcdefghijklmnopqrstuvwxyz")),
    ]
    got = {r["id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert re.fullmatch(r"(\w+) (\w+) spoke to (\w+) (\w+)\.", got[1]) and not {"Ravi", "Kumar", "Wei", "Zhang"} & set(re.findall(r"\w+", got[1]))
    assert re.fullmatch(r"\S+ \S+ met \S+ \S+\.", got[2]) and not re.search("Mary|Anne|Jones|Lee|Public|Q\\.", got[2])
    assert re.fullmatch(r"Mr\. \S+ \S+ and Dr\. \S+, then \S+ \S+\.", got[3]) and not re.search("Marco|Arc|Berg|Meer", got[3])
    a = re.fullmatch(r"([A-Z]+ [A-Z]+) and (\w+ \w+); ANNA IS here", got[4])
    assert a and a[1] == a[2].upper() != "ADAM SMITH"
    v = re.fullmatch(r"from (\S+) and (\S+), (\S+); std::cout at 12:30:45, a::b", got[5])
    assert v and v[1].upper() == v[2] and re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}", v[1]) and "8329" not in v[1] and v[3] != "fe80:0:0:0:1:2:3:4"
    assert re.fullmatch(r"version 1\.2\.3\.4, v1\.2\.3\.4, Release 10\.0\.0\.1 but (?!10\.0\.0\.1)\S+", got[6])
    d = [m.split("@")[1] for m in got[7].split(", ")]
    assert d[0] == d[1] != d[2] and d[0] != "corp.example.com"
    mails = got[8].split(" ")
    assert len(set(mails)) == 26 and not set(mails) & set(rows[7][1].split(" "))


def test_surrogates_stay_distinct(spark):
    ents = spark.range(800).select(F.lit("ssn").alias("kind"), F.format_string("%04d", "id").alias("canon"))
    out = pii.surrogates(ents, "k").toPandas()
    assert len(out) == out["surrogate"].nunique() == 800 and not set(out["surrogate"]) & set(out["canon"])


# ---- 2 ----
def kneser_ney(train, order=4):
    """log P(symbol | context) by the textbook, over symbol tuples."""
    counts = [{} for _ in range(order + 1)]
    for seq in train:
        padded = [1] * (order - 1) + list(seq)
        for k in range(order - 1, len(padded)):
            g = tuple(padded[k - order + 1 : k + 1])
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1
    disc, rest, total = {}, {}, {}
    for n in range(1, order + 1):
        m = [0] + [sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]
        d = []
        for k in (1, 2, 3):
            if m[k] and m[k + 1]:
                d.append(max(0.1, min(k - 0.1, k - (k + 1) * m[1] / (m[1] + 2 * m[2]) * m[k + 1] / m[k])))
            else:
                d.append(0.5 * min(k, 2))
        disc[n] = d
        for g, c in counts[n].items():
            total[g[:-1], n] = total.get((g[:-1], n), 0) + c
            rest[g[:-1], n] = rest.get((g[:-1], n), 0) + d[min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / 64
        n = len(g)
        low = p(g[1:])
        if (g[:-1], n) not in total:
            return low
        t, c = total[g[:-1], n], counts[n].get(g, 0)
        return max(0, c - disc[n][min(c, 3) - 1] if c else 0) / t + rest[g[:-1], n] / t * low

    return p


def test_quality_model_is_kneser_ney(spark, docs, empty):
    trusted = docs.where("doc_id in (1, 6, 7, 11, 12, 13, 14, 10)").select("doc_id")
    small = docs.where("doc_id <> 10")
    for bound in (10**6, 0):  # by broadcast, by join
        out = quality_lm.perplexities(docs, trusted, broadcast_rows=bound).toPandas()
        held = set(out[out["held"]]["id"])
        t = texts(docs)
        langs = {r["doc_id"]: r["lang"] or "" for r in docs.collect()}
        ids = {r["doc_id"] for r in trusted.collect()} - held
        table = quality_lm._alphabet()
        code = lambda s: [int(table[min(ord(c), 65536)]) for c in s]
        models = {}
        for lang in {langs[i] for i in ids}:
            models[lang] = kneser_ney([code(t[i]) for i in ids if langs[i] == lang])
        pool = kneser_ney([code(t[i]) for i in ids])
        for r in out.itertuples():
            p = models.get(langs[r.id], pool)
            s = [1, 1, 1] + code(t[r.id])
            want = sum(np.log(p(tuple(s[k - 3 : k + 1]))) for k in range(3, len(s)))
            assert r.size == len(t[r.id]) and r.logp == pytest.approx(want, rel=1e-4, abs=1e-4), (bound, r.id)
    assert quality_lm.classify(empty, trusted).count() == 0
    kept = quality_lm.classify(small, trusted.limit(0)).toPandas()
    assert kept["kept"].all() and len(kept) == small.count()


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_lm.classify(d, labels.where("quality = 1 and doc_id % 2 = 0")).toPandas()
    m = out.merge(labels.where("doc_id % 2 = 1").toPandas(), left_on="id", right_on="doc_id")
    assert m[m["quality"] == 1]["kept"].mean() > 0.98 and m[m["quality"] == 0]["kept"].mean() < 0.2


def test_quality_threshold_is_the_language_quantile(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "LEAST_HELD", 20)
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.where("quality = 1")
    p = quality_lm.perplexities(d, trusted).toPandas()
    p["loss"] = -p["logp"] / p["size"].clip(lower=1)
    held = p[p["held"] & (p["size"] > 0)]
    own = {x: g["loss"].quantile(0.99) for x, g in held.groupby("lang") if len(g) >= 20}
    assert 0 < len(own) < p["lang"].nunique()
    limit = p["lang"].map(own).fillna(held["loss"].quantile(0.99)) + 2 * np.maximum(0, p["size"].clip(lower=1) ** -0.5 - 200**-0.5)
    out = quality_lm.classify(d, trusted).toPandas().set_index("id")
    near = (p["loss"] - limit).abs() < 1e-9  # a held document that is the quantile itself
    assert (out["kept"].reindex(p["id"]).to_numpy() == (p["loss"] <= limit).to_numpy())[~near].all() and near.sum() < 8
    assert np.allclose(np.log(out["threshold"].reindex(p["id"])), limit)


# ---- 3 ----
def exact_brute(t):
    groups = {}
    for i, x in t.items():
        groups.setdefault(lower_az(x), []).append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("chars", [64, 1])
def test_exact_dedup(docs, empty, chars):
    want = exact_brute(texts(docs))
    for snapshot in ("id > 8", "id < 0", "true"):
        out = exact_dedup.exact_dedup(docs, snapshot, key_chars=chars).collect()
        assert {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out} == want and len(out) == len(want)
    assert exact_dedup.exact_dedup(empty, "id > 8").count() == 0


def test_exact_dedup_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "A")], "doc_id long, text string")
    out = exact_dedup.exact_dedup(d, "id > 1").collect()
    assert len(out) == 4 and sum(r["kept"] for r in out) == 2


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=600))
def test_binary_fuse_filter(keys):
    k = np.array(sorted(keys), np.uint64)
    built = exact_dedup.build_filter(k)
    assert exact_dedup.may_contain(built, k).all()
    other = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    assert exact_dedup.may_contain(built, other).mean() < 0.05


# ---- 4 ----
def rules_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set()
    rep = {j for k, g in enumerate(grams) if g in often for j in range(k, k + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(docs, empty):
    out = weak_rules.judge(docs).collect()
    t = texts(docs)
    assert {r["id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in out} == {i: rules_brute(x) for i, x in t.items()}
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in out)
    assert weak_rules.judge(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x0b\x1cé", max_size=60))
def test_rule_measures(t):
    assert weak_rules.measure(t, t.encode()) == rules_brute(t)


def test_em_finds_the_better_rules():
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.8
    right = np.array([0.95, 0.9, 0.7])
    votes = np.stack([np.where(y, 1, np.where(rng.random(len(y)) < r, -1, 1)) for r in right], 1)
    p, n = np.unique(votes, axis=0, return_counts=True)
    share, calls = weak_rules.estimate(p.astype(float), n.astype(float))
    assert abs(share - 0.8) < 0.03 and np.allclose(calls[0], right, atol=0.05)


# ---- 5 ----
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    hist = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_bins(hist, 20)
    used = {}
    for n, count in hist.items():
        runs = plan[plan["length"] == n].sort_values("rank")
        for r in range(count):
            run = runs[runs["rank"] <= r].iloc[-1]
            b, o = run["bin"] + (r - run["rank"]) // run["each"], run["offset"] + (r - run["rank"]) % run["each"] * n
            used.setdefault(b, []).append((o, n))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 20
    naive, open_ = 0, []
    for n in sorted(lengths, reverse=True):
        fit = [c for c in open_ if c >= n]
        if fit:
            c = min(fit)
            open_.remove(c)
        else:
            naive, c = naive + 1, 20
        open_.append(c - n)
    assert len(used) == naive


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = packing.pack(packing.pieces(docs, path)).toPandas()
    want = {}
    for i, t in texts(docs).items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k] = (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
    assert {(r.id, r.piece): (r.start, r.length, r.crc) for r in out.itertuples()} == want
    for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert packing.pack(packing.pieces(empty, path)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abAB.,'s!1 \n\t\x1c éÉİßσΣ\u0301<|>中") + ["<|endoftext|>", "don't"]), max_size=30).map("".join))
def test_word_tokens_equal_whole_text(t):
    tok = _tokenizer()
    assert np.frombuffer(packing.token_ids(packing.WordTokens(tok), t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


_TOK = []


def _tokenizer():
    if not _TOK:
        _TOK.append(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return _TOK[0]


# ---- 6 ----
def test_html(spark):
    long = "Main text of the article with enough words, commas, and sentences to be dense. " * 4
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><header>Site name</header>
    <article><h1>Head &amp; line</h1><p>{long}<p>Second <b>bold</b><br>{long}<div class="share">share</div><aside>Read also</aside></article>
    <div class="comments"><p>I think {long}</p></div><form><p>Mail: <input></p></form><footer>&copy; me</footer></body>"""
    rows = [(k, f"http://h/{k}", page.replace("Head", f"Head{k}")) for k in range(40)] + [(100, None, None), (101, "u", ""), (102, "u", "<p>" * 50 + "x"), (103, "u", 'a < b <p class="x'), (104, "u", "<!-- never closed " + page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(0))
    got = {r["id"]: r for r in html_extract.extract(df).collect()}
    assert len(got) == len(rows)
    block = " ".join(long.split())
    assert got[7]["text"].split("\n")[:3] == ["Head7 & line", block, "Second bold " + block]
    assert "I think" not in got[7]["text"] and "Home" not in got[7]["text"] and "Mail" not in got[7]["text"] and "Read also" not in got[7]["text"]
    assert got[100]["text"] == got[101]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


# ---- 7 ----
def repeats_brute(t, window=100):
    seen, out = set(), {}
    for i in sorted(t):
        b = t[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                gone[s : s + window] = b"\x01" * window
            else:
                seen.add(b[s : s + window])
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("most", [1000, 1])
def test_suffix_dedup(docs, empty, most):
    out = suffix_dedup.dedup(docs, most=most).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == repeats_brute(texts(docs))
    assert suffix_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("most", [1000, 2])
def test_suffix_dedup_random(spark, most):
    rng = np.random.default_rng(5)
    parts = ["".join(rng.choice(list("abcdé \n"), n)) for n in (90, 100, 101, 130, 260, 400)] + ["z" * 260, "ab" * 130]
    rows = {k: "".join(parts[j][rng.integers(0, 40) :] for j in rng.integers(0, len(parts), rng.integers(1, 5))) for k in range(70)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    out = suffix_dedup.dedup(df, most=most).collect()
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == repeats_brute(rows)


@pytest.mark.parametrize("most", [1000, 1])
def test_suffix_dedup_repeated_and_null_ids(spark, most):
    """Rows of one id, or none, are documents of their own, in the order of their texts' hashes."""
    rng = np.random.default_rng(11)
    shared = ["".join(rng.choice(list("abcdef "), 161)) for _ in range(4)]
    rows = [(k % 3 if k % 2 else None, shared[k % 4][: 120 + k % 40] + "".join(rng.choice(list("xyz"), k % 90)) + shared[(k + 1) % 4]) for k in range(60)]
    rows += rows[:9] + [(5, None), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = {(r["doc_id"], r["text"]): r["k"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, key[r]))
    want = repeats_brute({n: r[1] or "" for n, r in enumerate(order)})
    assert sum(v[1] > 0 for v in want.values()) > 20
    expected = sorted(((r[0] is None, r[0] or 0), want[order.index(r)]) for r in rows)
    got = sorted(((r["id"] is None, r["id"] or 0), (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in suffix_dedup.dedup(df, most=most).collect())
    assert got == expected and all(v[1] <= v[0] for _, v in got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(s):
    assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


# ---- 8 ----
def fp_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower_az(t))
    if not w:
        return 0
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    fp = {i: fp_brute(t) for i, t in texts(docs).items()}
    assert {r["id"]: r["fp"] % 2**64 for r in out} == fp
    assert {r["id"]: r["component_id"] for r in out} == components_brute(fp)
    assert simhash.near_duplicates(empty).count() == 0


def components_brute(fp, radius=4):
    comp = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= radius and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


@pytest.mark.parametrize("most", [4096, 6])
def test_links_join_every_component(spark, most):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    fps = {}
    for k in range(220):
        x = base[k % 12]
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        fps.setdefault(x, k)
    nodes = {i: x for x, i in fps.items()}
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, most=most).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    want = components_brute(nodes)
    for i in nodes:
        for j in nodes:
            assert (find(nodes[i]) == find(nodes[j])) == (want[i] == want[j])


def test_connected_components(spark):
    rng = np.random.default_rng(4)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(30)] + [(500, 500 + k) for k in range(1, 40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    nodes = sorted({x for p in e if p[0] != p[1] for x in p})
    comp = {x: x for x in nodes}
    for _ in nodes:
        for a, b in e:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


# ---- 9 ----
def test_url_filter(spark):
    caps = spark.createDataFrame([(1, "http://a.b.com/x/y?q", 5), (2, "https://B.com:80/", 15), (3, None, 5), (4, "nonsense", 5), (5, "http://a.b.com/x/y", None), (6, "http://user@a.b.com/z", 25), (1, "http://a.b.com/x/y?q", 5), (7, "http://ab.com/", 5)], "id int, url string, fetched_at int").withColumn("list", F.lit("clash"))
    ents = spark.createDataFrame([("l1", "domain", "b.com", "add", 3), ("l1", "domain", "b.com", "remove", 10), ("l1", "domain", "b.com", "add", 20), ("l2", "prefix", "a.b.com/x", "add", 5), ("l3", "host", "b.com", "add", 15), ("l3", "host", "b.com", "remove", 15), ("l4", "host", None, "add", 1)], "list string, kind string, pattern string, action string, at int")
    out = url_filter.evaluate(caps, ents).collect()
    got = {r["id"]: (r["blocked"], r["n_active"], r["lists"], r["since"]) for r in out}
    assert len(out) == 8
    assert got == {1: (True, 2, "l1,l2", 5), 2: (False, 0, "", None), 3: (False, 0, "", None), 4: (False, 0, "", None), 5: (False, 0, "", None), 6: (True, 1, "l1", 20), 7: (False, 0, "", None)}
    assert url_filter.evaluate(caps.limit(0), ents).count() == 0 and url_filter.evaluate(caps, ents.limit(0)).where("blocked").count() == 0


# ---- 10 ----
def test_mixing(spark, docs, empty):
    out = mixing.mix(docs).toPandas()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts(docs).items()}
    src = {r["doc_id"]: r["source"] for r in docs.collect()}
    order = [*sorted({s for s in src.values() if s is not None}), None]
    total = {s: sum(size[i] for i in size if src[i] == s) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(total.values())
    while open_:  # reshare until none is above its cap
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > 2 * total[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        open_ -= over
    for r in out.itertuples():
        s = src[r.id]
        assert r.size == size[r.id] and r.source_size == total[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
    for s in order:
        mine = out[[src[i] == s for i in out["id"]]]
        assert abs(mine["taken"].sum() - target[s]) <= max(mine["size"]) / 2 + 1e-6
    assert mixing.mix(docs).toPandas().sort_values("id")["taken"].tolist() == out.sort_values("id")["taken"].tolist()
    ordered = mixing.order_mix(mixing.mix(docs)).toPandas()
    assert ordered["position"].is_monotonic_increasing and ordered["position"].between(0, 1).all() and len(ordered) == out["copies"].sum()
    assert mixing.mix(empty).count() == 0


def test_schedule_is_inverted(spark):
    knots = ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))
    u = [k / 20 for k in range(21)]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.position_at(F.col("u"), F.lit(0), (knots,)).alias("t")).collect()]
    grid = np.linspace(0, 1, 200001)
    mass = np.cumsum(np.interp(grid, *zip(*knots)))
    assert np.allclose(got, np.interp(np.array(u) * mass[-1], mass, grid), atol=1e-3)


# ---- pipeline and SQL ----
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    from .test_near_sets import survivors

    sf = DATA
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = corpus_pipeline.STAGES
    assert [n for n, _ in stage] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    one = stage[0][1](spark, docs, sf).toPandas()
    two = stage[1][1](spark, spark.createDataFrame(one), sf).toPandas()
    assert set(two["doc_id"]) == {i for i, v in exact_brute(dict(zip(one["doc_id"], one["text"]))).items() if v[2]} and list(two.columns) == docs.columns
    three = stage[2][1](spark, spark.createDataFrame(two), sf).toPandas()
    assert set(three["doc_id"]) == survivors(dict(zip(two["doc_id"], two["text"])))
    d3 = spark.createDataFrame(three)
    four = stage[3][1](spark, d3, sf).toPandas()
    copies = {r["id"]: r["copies"] for r in mixing.mix(d3).collect()}
    assert four["doc_id"].value_counts().to_dict() == {i: c for i, c in copies.items() if c}
    got = corpus_pipeline.run(spark, sf).toPandas()
    tok = _tokenizer()
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in zip(four["doc_id"], four["text"])}
    assert got.groupby("doc_id")["length"].sum().to_dict() == {i: n[i] * copies[i] for i in n}
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op9_url_filter", "op10_mixing"])
def test_sql(spark, name):
    from spanforge.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, DATA).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda df: sorted(tuple("" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(want) == rows(got)


def test_no_local_paths():
    here = os.path.dirname(os.path.abspath(exact_dedup.__file__))
    assert not any("localCheckpoint(" in open(os.path.join(here, f)).read() for f in os.listdir(here) if f.endswith(".py"))
