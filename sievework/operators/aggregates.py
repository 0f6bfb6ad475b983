"""Summaries: counts over fixed keys, cross-tabs, arm tables, bag differences, paired tests."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For the sign test: pairs up to which it is in whole numbers, digits and bits beyond, Stirling's terms a / (b n^k).
_WHOLE, _DIGITS, _BITS = 1000, 60, 128
_STIRLING = ((1, 12, 1), (-1, 360, 3), (1, 1260, 5), (-1, 1680, 7), (1, 1188, 9), (-691, 360360, 11))
_PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459")


def counts_over(df: DataFrame, column: str, keys: Iterable, out: str = "n") -> DataFrame:
    """Row counts of the listed keys, 0 where a key doesn't occur, in the list's order as ``ordinal``."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[column]
    listed = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"ordinal int, {column} {kind}")
    got = df.groupBy(column).agg(F.count("*").alias(out))
    return listed.join(got, column, "left").select("ordinal", column, F.coalesce(out, F.lit(0)).alias(out))


def crosstab(df: DataFrame, row: str, column: str, values: Iterable) -> DataFrame:
    """Counts of ``row`` by the listed values of ``column``, 0 where none."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def rates(df: DataFrame, group: list[str], flags: dict[str, Column], digits: int = 2) -> DataFrame:
    """n, and for each flag how many rows have it and which percentage that is."""
    aggs = [F.count("*").alias("n")]
    for name, cond in flags.items():
        held = F.count(F.when(cond, 1))
        aggs += [held.alias(name), F.round(100.0 * held / F.count("*"), digits).alias(f"{name}_pct")]
    return df.groupBy(*group).agg(*aggs)


def most_frequent(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent values, equal counts by the values."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns).limit(k)


def summary(scores: DataFrame) -> DataFrame:
    """One row over score rows: items, scored, excluded, missing, mean and the percentages that parse and validate.

    A missing response counts with its score of 0; an excluded one doesn't count.
    """
    pct = lambda c: F.round(100.0 * F.count(F.when(F.col(c), 1)) / F.count("*"), 2)
    return scores.agg(
        F.count("*").alias("n_items"),
        F.count(F.when(~F.col("excluded"), 1)).alias("n_scored"),
        F.count(F.when(F.col("excluded"), 1)).alias("n_excluded"),
        F.count(F.when(F.col("missing"), 1)).alias("n_missing"),
        F.round(F.avg(F.when(~F.col("excluded"), F.col("score"))), 6).alias("mean"),
        pct("g1_json").alias("g1_json_pct"),
        pct("g2_schema").alias("g2_schema_pct"),
    )


def check_means(scores: DataFrame, checks: str = "checks") -> DataFrame:
    """Mean and number of each check over the graded rows; an absent check isn't counted."""
    graded = scores.where("not excluded and not missing")
    return graded.select(F.explode(checks).alias("check", "value")).groupBy("check").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def arm_table(df: DataFrame, group: list[str], arm: str, arms: list[str], value: str) -> DataFrame:
    """Mean of ``value`` for each group and arm, and the last arm's difference to the one before."""
    table = df.groupBy(*group).pivot(arm, arms).agg(F.avg(value))
    return table.withColumn("delta", F.col(arms[-1]) - F.col(arms[-2])) if len(arms) > 1 else table


def gate_rates(df: DataFrame, gates: str, by: list[str]) -> DataFrame:
    """How many rows reached each gate and how many passed; gates that weren't reached are absent from the map."""
    each = df.select(*by, F.explode(gates).alias("gate", "passed"))
    return each.groupBy(*by, "gate").agg(F.count("*").alias("reached"), F.count(F.when(F.col("passed"), 1)).alias("passed"))


def paired_check_means(a: DataFrame, b: DataFrame, key: str, checks: str = "checks") -> DataFrame:
    """Check means over the items where both arms have the check."""
    one = a.select(key, F.explode(checks).alias("check", "a"))
    two = b.select(key, F.explode(checks).alias("check", "b"))
    return one.join(two, [key, "check"]).groupBy("check").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b")).withColumn("delta", F.col("mean_b") - F.col("mean_a"))


def reason_histogram(df: DataFrame, item: str, reason: Column) -> DataFrame:
    """Items for each reason; an item counts once a reason."""
    return df.select(item, reason.alias("reason")).where("reason is not null").distinct().groupBy("reason").agg(F.count("*").alias("n_items"))


def spread(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, least, exact median and greatest."""
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.percentile(value, F.lit(0.5)).alias("median"), F.max(value).alias("greatest"))


def shape_histogram(df: DataFrame, group: list[str], shape: str) -> DataFrame:
    """Counts of the shapes of each group, and which is the mode (ties to the least shape)."""
    counts = df.groupBy(*group, shape).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), shape))
    return counts.withColumn("is_mode", rank == 1)


def bag_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that one side has more often than the other: (key, only_a, only_b)."""
    one = a.groupBy(key).agg(F.count("*").alias("_a"))
    two = b.groupBy(key).agg(F.count("*").alias("_b"))
    both = one.join(two, key, "full").select(key, F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))
    return both.where("_a <> _b").select(key, F.greatest(F.col("_a") - F.col("_b"), F.lit(0)).alias("only_a"), F.greatest(F.col("_b") - F.col("_a"), F.lit(0)).alias("only_b"))


def characters(df: DataFrame, text: str, out: str = "ch") -> DataFrame:
    """The characters of a text without white space, lower-cased, a row each."""
    bare = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)\s+", "")
    return df.select(F.explode(F.split(bare, "")).alias(out)).where(F.col(out) != "")


def with_block_share(df: DataFrame, block: list[str], cond: Column, out: str, at_least: float = 0.5) -> DataFrame:
    """Marks the rows of blocks in which so large a share of rows meets the condition."""
    share = F.avg(F.coalesce(cond, F.lit(False)).cast("int")).over(Window.partitionBy(*block))
    return df.withColumn(out, share >= at_least)


def sign_counts(pairs: DataFrame) -> DataFrame:
    """n, means, wins, losses and ties over (a, b) pairs."""
    n = lambda cond: F.count(F.when(cond, 1))
    return pairs.agg(
        F.count("*").alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(F.col("a") - F.col("b")).alias("mean_diff"),
        n(F.col("a") > F.col("b")).alias("wins"),
        n(F.col("a") < F.col("b")).alias("losses"),
        n(F.col("a") == F.col("b")).alias("ties"),
    )


def _ln_factorial(n: int) -> Decimal:
    """ln n!, from 1000 on by Stirling's series, of which the first term left out is below 1e-41."""
    if n < 1000:
        return Decimal(factorial(n)).ln()
    x = Decimal(n)
    series = sum(Decimal(a) / (b * x**k) for a, b, k in _STIRLING)
    return x * x.ln() - x + (2 * _PI * x).ln() / 2 + series


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial test of equal chances.

    Up to ``_WHOLE`` pairs without ties it's in whole numbers up to the last division.
    Beyond, where these have a bit a pair and a term a loss, the tail is its greatest
    term, by logarithms of ``_DIGITS`` digits, times the sum of the terms' ratios to it,
    of which some 7 times the root of the pairs are more than 0 in ``_BITS`` bits.
    """
    n, k = wins + losses, min(wins, losses)
    if 2 * k + 1 >= n:
        return 1.0
    if n <= _WHOLE:
        return float(Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n))
    with localcontext() as context:
        context.prec = _DIGITS
        greatest = (_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) - n * Decimal(2).ln()).exp()
        total, ratio = 0, 1 << _BITS
        while ratio:
            total += ratio
            ratio, k = ratio * k // (n - k + 1), k - 1
        return float(2 * greatest * total / (1 << _BITS))


def bootstrap_interval(pairs: DataFrame, group: list[str], order: list[str], resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """(group, n, low, high): the 2.5th and 97.5th percentile of the mean difference over resamples.

    A comparison's differences are one group in one task, in the given order, as the
    generator's draws are defined on the whole vector: 8 bytes a pair. Resamples are
    drawn in blocks of bounded size.
    """
    import numpy as np

    fields = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in group)

    def run(key, pdf):
        d = pdf.sort_values(order)["diff"].to_numpy(float)
        rng, means = np.random.default_rng(seed), []
        rows = max(1, min(resamples, 20_000_000 // max(1, len(d))))
        for at in range(0, resamples, rows):
            means.append(d[rng.integers(0, len(d), size=(min(rows, resamples - at), len(d)))].mean(axis=1))
        low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pdf.head(1)[group].assign(n=len(d), low=low, high=high)

    return pairs.select(*group, *order, "diff").groupBy(*group).applyInPandas(run, f"{fields}, n bigint, low double, high double")


def unsafe_counts(options: DataFrame, item: str, unsafe: Column) -> DataFrame:
    """Unsafe options and the items that have one."""
    return options.where(unsafe).agg(F.count("*").alias("options"), F.count_distinct(item).alias("items"))
