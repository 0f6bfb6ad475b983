"""Filters, funnels, cascades and partitions of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wording of questions that are off topic, and of those that are about pests all the same.
OFF_TOPIC = (
    r"(?i)fertili[sz]er|nutrient|urea|dap\b|potash|manure|irrigation|water\s?management|variety|seed rate|sowing|planting|price|market|msp|subsidy|loan|credit|"
    r"scheme|insurance|weather|rainfall|soil test|spacing|yield|weed"
)
ON_TOPIC = (
    r"(?i)pest|disease|insect|fung|blight|rot|wilt|mildew|rust|virus|mosaic|spot|borer|fly|mite|thrips|aphid|whitefly|caterpillar|worm|beetle|attack|infest|"
    r"damage|yellow|wilting|leaf|fruit|pod|stem|root|spray|control|treatment"
)
#: Cells that state nothing, after case folding and without dots.
PLACEHOLDERS = ("", "-", "--", "---", "----", "na", "n/a", "nil", "none", "not applicable")


def funnel(df: DataFrame, steps: Iterable[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all steps, row count after each step).

    All steps are counted in one pass over the rows: a row counts for a step if it
    passes that one and all before it. A condition that is null doesn't pass.
    """
    steps = list(steps)
    passed, so_far = [], F.lit(True)
    for _, cond in steps:
        so_far = so_far & F.coalesce(cond, F.lit(False))
        passed.append(so_far)
    sums = [F.count("*").alias("s0"), *[F.count(F.when(p, 1)).alias(f"s{i + 1}") for i, p in enumerate(passed)]]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("n_rows")) for i, n in enumerate(["raw", *[n for n, _ in steps]])])
    return df.where(so_far), df.agg(*sums).select(F.inline(rows))


def map_distinct(df: DataFrame, column: str, to: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with ``to`` looked up by ``column``; ``fn`` maps the distinct values only.

    ``fn`` gets a frame of the one column and returns (column, to). Nulls stay null.
    The distinct values are joined back by Spark's own choice of join.
    """
    found = fn(df.select(column).where(F.col(column).isNotNull()).distinct()).select(F.col(column).alias("_key"), to)
    return df.drop(to).join(found, F.col(column) == F.col("_key"), "left").drop("_key")


def has_mojibake(*texts: str) -> Column:
    """Four or more question marks in a row in any of the columns."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(t), F.lit("")).rlike(r"\?{4,}") for t in texts])


def without_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose values in the columns of ``pairs`` aren't listed there."""
    return df.join(pairs.distinct(), pairs.columns, "left_anti")


def first_reason(rules: Iterable[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does."""
    out = None
    for name, cond in rules:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def cascade(df: DataFrame, rules: Iterable[tuple[str, Column]], reason: str = "exclusion_reason") -> tuple[DataFrame, DataFrame]:
    """(rows that no rule excludes, the others with the first rule's name), both from one expression."""
    marked = df.withColumn(reason, first_reason(rules))
    return marked.where(F.col(reason).isNull()).drop(reason), marked.where(F.col(reason).isNotNull())


def is_off_topic(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t.rlike(OFF_TOPIC) & ~t.rlike(ON_TOPIC)


def slice_number(restricted: Column, answerability: Column) -> Column:
    """The slice of a question: 3 if restricted, else 5, 1 or 2 by answerability, 0 for none of these."""
    chain = F.when(F.coalesce(restricted, F.lit(False)), 3)
    for state, number in (("NO_REGISTERED_CHEMISTRY", 5), ("ANSWERABLE", 1), ("PEST_UNKNOWN", 2)):
        chain = chain.when(answerability == state, number)
    return chain.otherwise(0)


def resolution_status(crop: Column, gold_crop: Column, pest: Column, n_rows: Column) -> Column:
    """How far a lookup got, the first obstacle counting."""
    return (
        F.when(crop.isNull(), "no_crop").when(~crop.eqNullSafe(gold_crop), "crop_mismatch").when(pest.isNull(), "no_pest").when(n_rows > 0, "with_rows").otherwise("without_rows")
    )


def not_applicable(raw: Column, outcome: Column) -> Column:
    """Whether a cell says in words that no interval applies, rather than stating nothing."""
    key = F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit("."), F.lit(""))
    return (outcome == "not_applicable") & ~key.isin(*PLACEHOLDERS)


def label_flags(df: DataFrame) -> DataFrame:
    """Adds trainable, defective and biological to label facts."""
    fine = lambda c: F.coalesce(F.col(c).isin("numeric", "free_text"), F.lit(False))
    return df.withColumns(
        {
            "trainable": fine("dose_ai_branch") & fine("dose_formulation_branch"),
            "defective": F.coalesce(F.col("flag_pest_bled"), F.lit(False)) | F.coalesce(F.col("crop_multi_crop_split"), F.lit(False)),
            "biological": F.coalesce(F.col("source_file").startswith("bio_"), F.lit(False)),
        }
    )


def usable(df: DataFrame, name_pattern: str = "") -> DataFrame:
    """Flagged label facts that can be used: trainable, whole, uncontradicted, not named by the pattern."""
    fine = F.col("trainable") & ~F.col("defective") & (F.coalesce(F.col("contradiction"), F.lit("")) == "")
    if name_pattern:
        fine = fine & ~F.coalesce(F.lower("active_ingredient").rlike(name_pattern), F.lit(False))
    return df.where(fine)


def with_per_acre(df: DataFrame, prefixes: Iterable[str] = ("dose_ai", "dose_formulation")) -> DataFrame:
    """Adds the per-acre bounds of each dose; null unless the basis is an area."""
    from ..functions.values import per_acre

    new = {f"{p}_per_acre_{end}": per_acre(F.col(f"{p}_value_{end}"), F.col(f"{p}_basis")) for p in prefixes for end in ("min", "max")}
    return df.withColumns(new)
