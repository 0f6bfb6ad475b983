"""Sampling, set operations and the assertions that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *keys: str) -> Column:
    """A fixed pseudo-random order: the digest of a seed and the keys, the same in any engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def uniform_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows drawn by their hash; the same rows in every run."""
    return df.orderBy(hash_order(seed, *keys), *keys).limit(n)


def every_nth(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first, the (n+1)-th and so on of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % n == 0).drop("_n")


def quota_sample(df: DataFrame, group: str, quota: dict, seed: int, key: str, tier: Column | None = None) -> DataFrame:
    """Up to each group's quota, lower tiers first, by hash inside a tier."""
    table = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    order = [tier if tier is not None else F.lit(0), hash_order(seed, key), F.col(key)]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_n") <= F.coalesce(F.try_element_at(table, F.col(group)), F.lit(0))).drop("_n")


def quota_shortfall(sample: DataFrame, group: str, quota: dict) -> DataFrame:
    """Groups that have fewer rows than their quota."""
    from .aggregates import counts_over

    table = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    got = counts_over(sample, group, list(quota), "got").withColumn("quota", F.element_at(table, F.col(group)))
    return got.where("got < quota").select(group, "got", "quota")


def mandatory_and_fill(df: DataFrame, key: str, mandatory: list, n: int, seed: int) -> DataFrame:
    """The listed rows and others by hash, ``n`` in all."""
    first = F.when(F.col(key).isin(*mandatory), 0).otherwise(1)
    return df.orderBy(first, hash_order(seed, key), key).limit(n)


def merged_parts(parts: list[DataFrame], key: str, part: str, floors: dict[str, int] | None = None) -> DataFrame:
    """Union of the parts; fails at run time on a repeated key or a part below its floor.

    The checks are grouped counts joined to the rows, so the driver collects nothing.
    """
    from functools import reduce

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    repeated = rows.groupBy(key).agg(F.count("*").alias("_n"))
    out = rows.join(repeated, key)
    bad = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    out = out.where(bad).drop("_n")
    if floors:
        table = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
        sizes = rows.groupBy(part).agg(F.count("*").alias("_m"))
        low = F.col("_m") < F.coalesce(F.try_element_at(table, F.col(part)), F.lit(0))
        out = out.join(sizes, part).where(F.when(low, F.raise_error(F.concat(F.lit("part below its floor: "), F.col(part).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_m")
    return out


def in_all_arms(df: DataFrame, key: str, arm: str, n_arms: int) -> DataFrame:
    """Keys that occur in every arm."""
    return df.groupBy(key).agg(F.count_distinct(arm).alias("_n")).where(F.col("_n") == n_arms).select(key)


def not_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks; empty if ``a`` is a subset."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that only one side has, and which."""
    return not_in(a, b, keys).withColumn("side", F.lit("a")).unionByName(not_in(b, a, keys).withColumn("side", F.lit("b")))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` and the rows of ``old`` whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def common_to_all(df: DataFrame, group: str, member: str, among: str) -> DataFrame:
    """Members that occur with every value of ``among`` that their group has."""
    wanted = df.groupBy(group).agg(F.count_distinct(among).alias("_all"))
    got = df.groupBy(group, member).agg(F.count_distinct(among).alias("_n"))
    return got.join(wanted, group).where("_n = _all").select(group, member)
