"""Deterministic samples: hash order, quotas, round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(seed: str, *parts: Column) -> Column:
    """Order key of a row: digest of seed and identity, independent of partitioning."""
    fields = [F.lit(seed)]
    for part in parts:
        fields += [F.lit("\u0000"), F.coalesce(part.cast("string"), F.lit("None"))]
    return F.sha2(F.concat(*fields), 256)


def per_stratum(df: DataFrame, stratum: list[str], key: str, n: int) -> DataFrame:
    """First ``n`` rows of each stratum in key order; rows beyond never leave their task."""
    w = Window.partitionBy(*stratum).orderBy(key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)


def quota_sample(df: DataFrame, stratum: str, quotas: dict[str, int], key: str, strict: bool = True) -> DataFrame:
    """Quota rows of each named stratum; raises when a stratum is too small and ``strict``."""
    quota = F.create_map(*[F.lit(v) for item in quotas.items() for v in item])
    named = df.where(F.col(stratum).isin(list(quotas)))
    if strict:
        found = {r[stratum]: r["count"] for r in named.groupBy(stratum).count().collect()}  # one row per quota
        short = {s: found.get(s, 0) for s, q in quotas.items() if found.get(s, 0) < q}
        if short:
            raise ValueError(f"Not enough rows: {short}")
    w = Window.partitionBy(stratum).orderBy(key)
    ranked = named.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(quotas.values()))
    return ranked.where(F.col("_n") <= quota[F.col(stratum)]).drop("_n")


def round_robin(df: DataFrame, stratum: list[str], key: str, size: int) -> DataFrame:
    """One row per stratum and turn until ``size`` rows are taken; adds ``turn`` and ``position``.

    No stratum can give more than ``size`` rows, so each is cut there before the
    final order over the survivors.
    """
    kept = per_stratum(df, stratum, key, size).withColumnRenamed("_n", "turn")
    order = [F.col("turn"), *[F.col(s) for s in stratum]]
    top = kept.orderBy(*order).limit(size)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def rebalance(df: DataFrame, flag: str, key: str, ratio: float = 2.0) -> DataFrame:
    """Keep all flagged rows and at most ``ratio`` times as many others, in key order."""
    flagged = df.where(F.col(flag))
    limit = int(flagged.count() * ratio)
    part = F.substring(F.col(key), 1, 3)
    rest = df.where(~F.col(flag)).withColumn("_part", part)
    # Keys are hexadecimal digests: at most 4096 parts, of which one holds the cut.
    room, cut = limit, None
    for row in sorted(rest.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        if row["count"] > room:
            cut = row["_part"]
            break
        room -= row["count"]
    if cut is None:
        return flagged.unionByName(rest.drop("_part"))
    inside = rest.where(F.col("_part") == cut).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(key))).where(F.col("_n") <= room)
    return flagged.unionByName(rest.where(F.col("_part") < cut).drop("_part")).unionByName(inside.drop("_part", "_n"))


def holdout(df: DataFrame, quotas: dict[str, int], seed: str, strict: bool = True) -> DataFrame:
    """Quota sample over relation buckets with a round-robin no-answer part and a final reshuffle.

    Needs ``id, question, is_answerable, bucket``.
    """
    df = df.withColumn("_key", stable_key(seed, F.col("id"), F.col("question")))
    plain = {k: v for k, v in quotas.items() if k != "NO_ANSWER"}
    answered = quota_sample(df.where("is_answerable"), "bucket", plain, "_key", strict).withColumn("stratum", F.col("bucket"))
    size = quotas.get("NO_ANSWER", 0)
    silent = round_robin(df.where("not is_answerable"), ["bucket"], "_key", size).drop("turn", "position")
    if strict and silent.count() < size:
        raise ValueError("Not enough unanswerable rows")
    both = answered.unionByName(silent.withColumn("stratum", F.lit("NO_ANSWER"))).drop("_key")
    return both.withColumn("order_key", stable_key(seed + ":final", F.col("id"), F.col("question")))
