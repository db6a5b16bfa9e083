"""Mixing sources to target weights (10): a time-varying curriculum.

1. Each source's target is its weighted share of the wanted words, stopped at ``cap`` times
   its size; what a stopped source leaves goes to the others by weight until none is above.
2. Each source is walked in a keyed-hash order. Every document is taken floor(rate) times,
   and once more while the running size is within the source's remaining demand.
3. Each source has a weight schedule over training time (knots, linear in between). The
   schedule's integral is the cumulative token demand; a copy that lies at fraction u of its
   source's taken words trains at the time where the normalised integral reaches u.
4. Documents (``by_position``) or single copies (``order_mix``) are range-sorted by position.

Running sums run in two levels (blocks of the hash range, then inside a block), so the
largest source is spread over many tasks.

Edge cases: null text has size 0; a null source is a source of its own and comes last; a
source without words gets target 0 and its rows are taken floor(rate) = 0 times; rows that
share id, source and size share one decision (ties); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, md5_number

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2
#: Schedules, repeating as the weights do: (time, relative weight) knots over the run.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
LEAST_BLOCK = 256
HASH_BITS = 48


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, place, weight, target) from rows (source, size)."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    src = src.withColumn("place", F.row_number().over(by_name) - 1)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    # water level: sources are stopped in the order of cap / weight
    src = src.withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double")).withColumn("fills_at", F.col("most") / F.col("weight"))
    order = Window.orderBy("fills_at", "place")
    everything, before, rest = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumn("wanted", F.lit(share) * F.sum("source_size").over(everything))
    src = src.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    first = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "place", "level"))).over(everything)
    src = src.withColumn("level", first["level"])
    target = F.least("most", F.col("level") * F.col("weight"))
    return src.select("source", "source_size", "place", "weight", F.coalesce(target, F.col("most")).alias("target"))


def _demand(knots) -> list[tuple[float, float, float, float, float]]:
    """Segments (u0, u1, t0, w0, slope) of the normalised integral of a schedule."""
    area, parts = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        step = (w0 + w1) / 2 * (t1 - t0)
        parts.append((area, area + step, t0, w0, (w1 - w0) / (t1 - t0)))
        area += step
    return [(a / area, b / area, t0, w0 / area, s / area) for a, b, t0, w0, s in parts]


def position_at(u: Column, place: Column, schedules=SCHEDULES) -> Column:
    """The time at which the integrated schedule of a source reaches fraction u."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        inner = None
        for u0, u1, t0, w0, slope in reversed(_demand(knots)):
            need = u - F.lit(u0)
            # w0 x + slope x^2 / 2 = need, in the form that is stable for a slope near 0
            x = 2 * need / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * need)))
            inner = F.lit(t0) + x if inner is None else F.when(u <= F.lit(u1), F.lit(t0) + x).otherwise(inner)
        out = F.when(place % len(schedules) == k, F.least(inner, F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """(id, row_key, source, size, source_size, target, copies, taken, positions) for every row.

    positions: the training positions of its copies, from 0 to 1, ascending (empty when none is taken)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text_col).alias("row_key"))
    rows = materialize(rows, "sizes")
    n = rows.count()
    # as many blocks as rows in one, so that neither level of the running sums outgrows a task
    bits = (n // max(LEAST_BLOCK, int(n**0.5))).bit_length()
    key = md5_number(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":mix")))
    rows = rows.withColumn("h", key).withColumn("block", F.shiftright("h", HASH_BITS - bits) if bits else F.lit(0).cast("long"))
    targets = materialize(source_targets(rows, weights, share, cap), "targets")

    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("ahead"))
    blocks = blocks.join(targets, blocks["source"].eqNullSafe(targets["source"])).select(blocks["source"].alias("s"), F.col("block").alias("b"), "ahead", "source_size", "place", "target")
    inside = Window.partitionBy("source", "block").orderBy("h", F.col("id").asc_nulls_last(), "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(blocks, rows["source"].eqNullSafe(F.col("s")) & (rows["block"] == F.col("b")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    middle = F.col("ahead") + F.col("upto") - F.col("size") / F.lit(2.0)
    more = (middle < F.col("target") - whole * F.col("source_size")).cast("long")
    rows = rows.withColumn("copies", F.least(whole + more, F.lit(cap).cast("long")))
    rows = rows.withColumn("u", F.when(F.col("source_size") > 0, middle / F.col("source_size")).otherwise(F.lit(0.0)))
    # copy c of a document lies at (c + u) / copies of its source's run
    copy = lambda c: position_at((c + F.col("u")) / F.col("copies"), F.col("place"), schedules)
    every = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")), copy)).otherwise(F.array().cast("array<double>"))
    return rows.select("id", "row_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), every.alias("positions"))


def by_position(mixed: DataFrame) -> DataFrame:
    """``mixed`` range-sorted by the position of each document's first copy; documents without one come last."""
    first = F.when(F.size("positions") > 0, F.element_at("positions", 1))
    return mixed.orderBy(first.asc_nulls_last(), "id")


def order_mix(mixed: DataFrame, sort: bool = True) -> DataFrame:
    """One row a copy (id, row_key, source, size, copy, position), range-sorted by position."""
    rows = mixed.select("id", "row_key", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return rows.orderBy("position", "id", "copy") if sort else rows
