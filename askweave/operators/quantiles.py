"""Exact percentiles without bringing all values into one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askweave.session import broadcast_if_fits, materialize


def quantiles(df: DataFrame, value: str, ratios: list[float], by: list[str] | None = None,
              method: str = "linear", buckets: int = 256) -> DataFrame:
    """``by..., ratio, quantile`` for each ratio.

    Equal values are counted first.  Approximate bounds cut the value range into
    buckets; running counts inside a bucket plus the sizes of earlier buckets give
    exact positions, and only the few rows at the wanted positions are kept.

    ``linear`` interpolates at ``(n - 1) * ratio``; ``nearest`` takes the value at
    that position rounded half to even.
    """
    by = by or []
    counted = materialize(
        df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c")), "values"
    )
    bounds = counted.agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 10000)).first()[0] or []
    limits = F.lit(sorted(set(bounds))) if bounds else F.array().cast("array<double>")
    placed = counted.withColumn("_b", F.size(F.filter(limits, lambda x: x < F.col("_v"))))
    sizes = placed.groupBy(*by, "_b").agg(F.sum("_c").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_b") if by else Window.orderBy("_b")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    sizes = sizes.withColumns({
        "_before": F.sum("_size").over(earlier) - F.col("_size"), "_n": F.sum("_size").over(whole)
    }).drop("_size")
    keys = [*by, "_b"]
    sizes = materialize(sizes, "bucket-sizes")  # groups times buckets: broadcast only within the bounds
    cond = [placed[k].eqNullSafe(sizes[k]) for k in keys]
    joined = placed.join(broadcast_if_fits(sizes), cond, "inner").select(placed["*"], sizes["_before"], sizes["_n"])
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_before") + F.sum("_c").over(inside) - 1
    joined = joined.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_c") + 1)

    def position(p: float):
        exact = (F.col("_n") - 1) * F.lit(float(p))
        if method == "nearest":
            near = F.bround(exact).cast("long")
            return near, near, F.lit(0.0)
        low = F.floor(exact)
        return low, F.ceil(exact), exact - low

    wanted = []
    for p in ratios:
        low, high, share = position(p)
        wanted.append(F.struct(F.lit(float(p)).alias("ratio"), low.alias("at"), (1 - share).alias("w")))
        wanted.append(F.struct(F.lit(float(p)).alias("ratio"), high.alias("at"), share.alias("w")))
    hit = joined.withColumn("x", F.explode(F.filter(
        F.array(*wanted), lambda x: (x["at"] >= F.col("_first")) & (x["at"] <= F.col("_last"))
    )))
    return hit.groupBy(*by, F.col("x.ratio").alias("ratio")).agg(F.sum(F.col("_v") * F.col("x.w")).alias("quantile"))


def quantile_columns(df: DataFrame, value: str, named: dict[str, float], by: list[str] | None = None,
                     method: str = "linear", digits: int = 6) -> DataFrame:
    """One row per group with one column per named ratio."""
    long = quantiles(df, value, sorted(set(named.values())), by, method)
    return long.groupBy(*(by or [])).agg(*[
        F.round(F.max(F.when(F.abs(F.col("ratio") - p) < 1e-12, F.col("quantile"))), digits).alias(name)
        for name, p in named.items()
    ])


def sweep_ratios() -> list[float]:
    """49 evenly spaced ratios from 0.02 to 0.98."""
    return [0.02 + (0.98 - 0.02) * i / 48 for i in range(49)]


def threshold_grid(df: DataFrame, value: str) -> list[float]:
    """Fixed coarse and fine steps plus the quantiles of the finite values, rounded and distinct."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    marks = [r["quantile"] for r in quantiles(finite, value, sweep_ratios()).collect()]
    steps = [i / 2 for i in range(-20, 21)] + [i / 10 for i in range(-20, 21)]
    return sorted({round(x, 6) for x in steps + marks if math.isfinite(x)})
