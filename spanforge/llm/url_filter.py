"""URL filters (9): a temporal join of captures with dated list entries.

List entries say when a pattern was put on or taken off a list. Per list and pattern they
become validity intervals. A capture is looked up under its host, every parent domain and
every path prefix, and an as-of join keeps the entries that were active at fetch time.
Only DataFrame functions are used; the join is an equi-join on (kind, pattern, salt) with the
time as residual: captures take one of ``SALTS`` salts by a hash of id and URL, the (far
fewer) intervals all of them, so a host that holds a third of all captures is spread.

Edge cases: a null or unparsable URL has no host and matches nothing; a null fetch time
matches nothing; entries with null pattern or time are void; of entries of one pattern at
one time, removal wins; repeated entries collapse; captures that repeat an id share one
verdict a (id, url, time) and each keep a row; empty tables give empty results or captures
without matches; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scheme, optional user info, host, optional port, path.
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
PATH = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
SALTS = 32


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(F.trim(url)), HOST, 1)
    return F.nullif(host, F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) from (list, kind, pattern, action, at); until is
    null while the entry stands. kind: host, domain (and below) or prefix (host and path)."""
    e = entries.where("pattern is not null and at is not null").groupBy("list", "kind", F.lower("pattern").alias("pattern"), "at").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    return e.withColumn("until", F.lead("at").over(w)).where("off = 0").select("list", "kind", "pattern", F.col("at").alias("since"), "until")


def lookup_keys(host: Column, url: Column) -> Column:
    """Array of (kind, pattern) under which a URL can stand on a list."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, n), ".").alias("pattern")))
    steps = F.filter(F.split(F.regexp_extract(F.trim(url), PATH, 1), "/"), lambda x: x != "")
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.lower(F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("pattern"))))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.concat(exact, domains, F.coalesce(prefixes, F.array().cast("array<struct<kind:string,pattern:string>>")))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Every capture (id, url, host, fetched_at) with blocked, n_active, lists and since.

    lists: names of the lists with an active entry, sorted; since: the latest start."""
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at")).withColumn("host", host_of(F.col("url")))
    keyed = c.where("host is not null and fetched_at is not null").withColumn("k", F.explode(lookup_keys(F.col("host"), F.lower("url")))).select("id", "url", "fetched_at", F.col("k.kind").alias("ck"), F.col("k.pattern").alias("cp"), F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).alias("cs"))
    e = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    active = keyed.join(e, (F.col("ck") == F.col("kind")) & (F.col("cp") == F.col("pattern")) & (F.col("cs") == F.col("salt")) & (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    found = active.groupBy(F.col("id").alias("i"), F.col("url").alias("u"), F.col("fetched_at").alias("t")).agg(
        F.countDistinct("list", "kind", "pattern").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max("since").alias("since"))
    out = c.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("url") == F.col("u")) & (F.col("fetched_at") == F.col("t")), "left")
    return out.select("id", "url", "host", "fetched_at", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "since")
