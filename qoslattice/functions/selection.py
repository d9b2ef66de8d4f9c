"""Exact quantiles by selection: only the values around the asked ranks are sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of about equal size that a group's distinct values are cut into.
PARTS = 256


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, steps: list[float]) -> DataFrame:
    """(keys, q, value): the interpolated quantiles ``steps`` of each group of ``keys``, as
    ``percentile`` gives them; nulls don't count, and a group of nulls alone has no row.

    Equal values become one row with their number. Approximate quantiles, which are sketches
    of bounded size, cut a group's distinct values into parts; counts of the parts, summed up,
    tell in which of them each asked rank lies, and those alone are sorted. So no task holds
    more than a part, however large the group; where the cuts lie never shows in the result.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_times"))
    cuts = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", [i / PARTS for i in range(1, PARTS)], 10 * PARTS)).alias("_cuts"))
    cuts = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    parted = counts.join(cuts, on, "left").withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts", *[f"_k{i}" for i in range(len(keys))])
    # A row a part: the ranks, from 0 on, that it holds.
    group = Window.partitionBy(*keys)
    parts = parted.groupBy(*keys, "_part").agg(F.sum("_times").alias("_n"))
    parts = parts.withColumn("_upto", F.sum("_n").over(group.orderBy("_part"))).withColumn("_all", F.sum("_n").over(group))
    position = lambda q: (F.col("_all") - 1) * F.lit(float(q))
    asked = F.array(*[F.struct(F.lit(float(q)).alias("q"), position(q).alias("at")) for q in steps])
    held = lambda rank: (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
    wanted = F.filter(asked, lambda x: held(F.floor(x["at"])) | held(F.ceil(x["at"])))
    parts = parts.withColumn("_asked", wanted).filter(F.size("_asked") > 0).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_upto", "_n", "_asked")
    near = parted.join(parts, [*on, F.col("_part") == F.col("_p")])
    upto = F.col("_upto") - F.col("_n") + F.sum("_times").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    ranked = near.withColumn("_last", upto).withColumn("_first", F.col("_last") - F.col("_times")).select(*keys, "_v", "_first", "_last", F.explode("_asked").alias("_x"))
    here = lambda rank: F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_last")), F.col("_v")))
    found = ranked.groupBy(*keys, F.col("_x.q").alias("q"), F.col("_x.at").alias("_at")).agg(here(F.floor("_x.at")).alias("_low"), here(F.ceil("_x.at")).alias("_high"))
    low, high, at = F.col("_low"), F.col("_high"), F.col("_at")
    between = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    return found.select(*keys, "q", between.alias(value))


def quantiles(rows: DataFrame, keys: list[str], value: str, steps: list[float], few: bool) -> DataFrame:
    """The same by one aggregation where the caller has seen that groups are small, which
    spares three passes; else by selection."""
    if not few:
        return exact_quantiles(rows, keys, value, steps)
    found = rows.groupBy(*keys).agg(F.percentile(value, steps).alias("_p")).filter("_p IS NOT NULL")
    asked = F.arrays_zip(F.array(*[F.lit(float(q)) for q in steps]).alias("q"), F.col("_p").alias("v"))
    return found.select(*keys, F.explode(asked).alias("_x")).select(*keys, F.col("_x.q").alias("q"), F.col("_x.v").alias(value))
