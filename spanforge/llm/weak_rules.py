"""Quality rules (4): rules vote or abstain, EM estimates their accuracies.

Every document gets base measures and nine votes (1 good, -1 bad, 0 abstain). The model: a
document is good with probability p; given its class, a rule that does not abstain is right with an
accuracy of its own for that class, whatever the other rules say. Votes are summed up as patterns (at most 3 ** 9 rows
at any corpus size), expectation-maximisation runs on the pattern counts of the whole
corpus (of those documents that pass the base rules), and a document's posterior is a sum of log odds, computed as an ordinary column.

Edge cases: a null text counts as empty, has no words and fails the base rules; texts are
measured whole; rows that repeat an id give a row each; an empty table gives an empty
result (EM then keeps its start values); further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SYMBOLS = b"#*$%&|<>"
RULES = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "letters", "line_end", "marks")
#: (good when at most, bad when above) for measures where less is better; in between a rule abstains.
LIMITS = {"symbols": (0.02, 0.15), "dup_lines": (0.1, 0.4), "repeats": (0.1, 0.35), "capitals": (0.1, 0.3), "marks": (0.3, 0.8)}
_OTHERS = bytes(set(range(256)) - set(SYMBOLS))
_BLANK, _UPPER = b" \t\n\r\x0b\x0c", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_UPPER, _NOT_LETTER = bytes(set(range(256)) - set(_UPPER)), bytes(x for x in range(128) if not chr(x).isalpha())
_MARKS = b".,;:!?"
_NOT_MARKS = bytes(set(range(256)) - set(_MARKS))


def measure(text: str, raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeats += i + 3 - max(i, upto)
                upto = i + 3
    return n, word_chars, len(raw.translate(None, _OTHERS)), len(lines) - len(set(lines)), repeats


def votes(raw: bytes, measured: tuple[int, int, int, int, int]) -> list[int]:
    n, word_chars, n_symbols, n_dup_lines, n_repeat = measured
    if not n:
        return [-1] + [0] * (len(RULES) - 1)
    def less(name: str, x: float) -> int:
        return 1 if x <= LIMITS[name][0] else -1 if x > LIMITS[name][1] else 0
    letters = len(raw.translate(None, _NOT_LETTER))
    capitals = len(raw.translate(None, _NOT_UPPER))
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    ended = sum(x.rstrip(_BLANK)[-1:] in (b".", b"!", b"?", b'"') for x in lines) / len(lines)
    mean = word_chars / n
    return [
        1 if n >= 60 else -1 if n < 20 else 0,
        1 if 3 <= mean <= 9 else -1 if mean < 2 or mean > 14 else 0,
        less("symbols", n_symbols / n),
        less("dup_lines", n_dup_lines / len(lines)),
        less("repeats", n_repeat / n),
        less("capitals", capitals / max(letters, 1)),
        1 if letters >= 0.65 * len(raw) else -1 if letters < 0.5 * len(raw) else 0,
        1 if ended >= 0.5 else -1 if ended < 0.1 and len(lines) > 3 else 0,
        less("marks", len(raw.translate(None, _NOT_MARKS)) / n),
    ]


def measures_and_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, v_<rule>...)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                t = t or ""
                raw = t.encode()
                m = measure(t, raw)
                out.append((*m, *votes(raw, m)))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * (len(names) + len(RULES))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *names, *(f"v_{r}" for r in RULES)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} long" for c in names), *(f"v_{r} long" for r in RULES)]))


#: Start of EM and, with PRIOR_ROWS documents' weight, its prior: how often a vote that a rule
#: casts on a document of the class calls it bad.
GOOD_CALLED_BAD, BAD_CALLED_BAD, PRIOR_ROWS = 0.02, 0.3, 4.0
#: A rule that calls more than this share of the good documents bad would not have been written.
MOST_FALSE_ALARMS = 0.015


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """EM on (pattern, count): the share of good documents, and calls[class, rule], the chance
    that a cast vote is -1 on a bad (class 0) or a good (class 1) document.

    These are the rules' accuracies: 1 - calls[1] on good documents and calls[0] on bad ones.
    Abstaining says nothing. A bad vote never speaks for good: calls[0] >= calls[1]."""
    bad, cast = (patterns == -1).astype(float), (patterns != 0).astype(float)
    prior = np.array([[BAD_CALLED_BAD], [GOOD_CALLED_BAD]])
    share, calls = 0.8, np.repeat(prior, patterns.shape[1], axis=1)
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + bad @ np.log(calls[1] / calls[0]) + (cast - bad) @ np.log((1 - calls[1]) / (1 - calls[0]))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weight = np.stack([counts * (1 - post), counts * post])
        new = (weight @ bad + PRIOR_ROWS * prior) / (weight @ cast + PRIOR_ROWS)
        new[1] = np.minimum(new[1], MOST_FALSE_ALARMS)
        new[0] = np.maximum(new[0], new[1])
        new_share = float(np.clip((counts * post).sum() / counts.sum(), 0.05, 0.99)) if counts.sum() else share
        moved = abs(new - calls).max() + abs(new_share - share)
        share, calls = new_share, new
        if moved < 1e-10:
            break
    return share, calls


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, votes, posterior quality and verdict (good) for every row of ``docs``."""
    rows = materialize(measures_and_votes(docs, id_col, text_col), "votes")
    cols = [f"v_{r}" for r in RULES]
    # at most 3 ** 9 patterns, whatever the corpus
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    found = [tuple(r) for r in rows.where("not base_failed").groupBy(*cols).agg(F.count("*").alias("n")).collect()]
    patterns = np.array([r[:-1] for r in found], float).reshape(-1, len(cols))
    share, calls = estimate(patterns, np.array([r[-1] for r in found], float))
    odds = F.lit(float(np.log(share / (1 - share))))
    for c, bad, good in zip(cols, np.log(calls[1] / calls[0]), np.log((1 - calls[1]) / (1 - calls[0]))):
        odds = odds + F.when(F.col(c) < 0, float(bad)).when(F.col(c) > 0, float(good)).otherwise(0.0)
    rows = rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return rows.withColumn("good", F.col("posterior") >= threshold)
