"""Global ranks without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import stored


def global_rank(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``rows`` with the number (from 1) that row_number over the whole table would give: a range
    exchange on the order, numbers inside the ranges, and the ranges' row counts added up in
    front. Only one count a partition passes through the driver. Rows equal in the whole order
    are numbered in any way, as by row_number."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = stored(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    before, upto = [], 0
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):
        before.append((r["_part"], upto))
        upto += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))
    return inside.join(offsets, "_part").withColumn(name, (F.col("_before") + F.col("_k")).cast("int" if upto < 2**31 else "long")).drop("_part", "_before", "_k")
