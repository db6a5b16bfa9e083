"""Column functions on texts, identifiers and numbers (P2-P6, X16, hashes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_number(key: Column) -> Column:
    """48 bits of md5 as a long: a draw that any engine can repeat."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def canonical_id(norm: Column, start: Column, end: Column, kind: Column) -> Column:
    """Id for comparison: product ids lower-cased, others upper-cased without blanks; without
    an id a sentinel of the span, which can match nothing else."""
    bare = F.regexp_replace(norm, r"\s+", "")
    sentinel = F.concat(F.lit("~"), kind, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(norm.isNull() | (F.trim(norm) == ""), sentinel).when(F.lower(bare).startswith("cpe:2.3:"), F.lower(F.trim(norm))).otherwise(F.upper(bare))


def canonical_cve(text: Column) -> Column:
    """CVE id of a string that is nothing else, blanks inside forgiven; else null."""
    bare = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.when(bare.rlike(r"^CVE-\d{4}-\d{4,}$"), bare)


def canonical_cwe(text: Column) -> Column:
    digits = F.regexp_extract(F.upper(F.regexp_replace(text, r"\s+", "")), r"^CWE-?(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits))


def technique_id(text: Column) -> Column:
    found = F.regexp_extract(F.upper(F.regexp_replace(text, r"\s+", "")), r"^(T\d{4}(?:\.\d{3})?)$", 1)
    return F.when(found != "", found)


def product_parts(cpe: Column) -> Column:
    """The fields of a product id, cut at colons that are not escaped."""
    return F.split(cpe, r"(?<!\\):")


def _if_product(cpe: Column, value) -> Column:
    """value(fields) of a valid product id, else null; the id is split once for all tests."""

    def one(p: Column) -> Column:
        fields = F.transform(F.slice(p, 3, 3), lambda x: F.lower(x))
        ok = (F.size(p) == 13) & (F.lower(p[0]) == "cpe") & (p[1] == "2.3") & fields[0].isin("a", "o", "h") & ~fields[1].isin("*", "-", "") & ~fields[2].isin("*", "-", "")
        return F.when(ok, value(p))

    return F.transform(F.array(product_parts(cpe)), one)[0]


def is_product_id(cpe: Column) -> Column:
    return F.coalesce(_if_product(cpe, lambda p: F.lit(True)), F.lit(False))


def product_family(cpe: Column) -> Column:
    """part:vendor:product of a valid product id, else null."""
    return _if_product(cpe, lambda p: F.lower(F.array_join(F.slice(p, 3, 3), ":")))


def product_version(cpe: Column) -> Column:
    return _if_product(cpe, lambda p: p[5])


def span_is_exact(text: Column, start: Column, end: Column, surface: Column) -> Column:
    """text[start:end] is the surface, offsets counting code points from 0."""
    inside = (start >= 0) & (end > start) & (end <= F.char_length(text))
    return F.coalesce(inside & (F.substr(text, start + F.lit(1), end - start) == surface), F.lit(False))


#: Characters of a piece of a text, see pieces.
PIECE = 256


def pieces(text: Column) -> Column:
    """A text as an array of pieces of PIECE code points; the last may be shorter, a null stays null."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, n: Column) -> Column:
    """n code points of a text from start (0-based), out of its pieces: the way to a far place of a
    long text is an array access, not a count from its begin. Null for a negative start or n."""
    start, n = start.cast("int"), n.cast("int")
    first = F.floor(start / PIECE).cast("int")
    many = F.floor((start + n + (PIECE - 1)) / PIECE).cast("int") - first
    return F.when((start >= 0) & (n >= 0), F.substr(F.array_join(F.slice(parts, first + 1, many), ""), start % PIECE + 1, n))


def piece_span_is_exact(parts: Column, start: Column, end: Column, surface: Column) -> Column:
    """span_is_exact on the pieces of a text."""
    inside = (start >= 0) & (end > start)
    found = cut(parts, start, end - start)
    return F.coalesce(inside & (F.char_length(found) == end - start) & (found == surface), F.lit(False))


def span_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.greatest(s1, s2) - F.least(e1, e2))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, unrounded; empty denominators give 0."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1")]


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(b * p + r == 0, F.lit(0.0)).otherwise((1 + b) * p * r / (b * p + r))
