"""Exact percentiles of a column of any size: values in ranges, counts for each range, then the ranks asked for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import stored


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list:
    """The least values that at least each share of all (non-null) values isn't above; None for an empty
    column. A partition and the driver hold counts, no task holds all values."""
    dealt = df.select(F.col(column).alias("v")).where("v IS NOT NULL").repartitionByRange("v").sortWithinPartitions("v")
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "values")
    part = F.shiftright("place", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    total, wanted = sum(n for _, n in counts), {}
    for share in shares:
        rank = max(math.ceil(share * total), 1) - 1
        for p, n in counts:
            if rank < n:
                wanted[share] = (p << 33) + rank
                break
            rank -= n
    found = {r.place: r.v for r in placed.where(F.col("place").isin(list(set(wanted.values())))).collect()} if wanted else {}
    return [found.get(wanted.get(s)) for s in shares]
