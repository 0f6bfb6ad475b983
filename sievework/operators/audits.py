"""Audits: results against records, classes of errors, noise, integrity and surveys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values

AUDIT_BAND = 0.08


def differences(a: DataFrame, b: DataFrame, key: list[str], columns: Iterable[str]) -> DataFrame:
    """Fields that differ between two frames: (key, field, a, b); a missing row differs in ``<row>``."""
    columns = list(columns)
    one = a.select(*key, F.struct(*columns).alias("_a"))
    two = b.select(*key, F.struct(*columns).alias("_b"))
    both = one.join(two, key, "full")
    text = lambda side, c: F.col(side)[c].cast("string")
    missing = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.array(F.struct(F.lit("<row>").alias("field"), F.col("_a").isNotNull().cast("string").alias("a"), F.col("_b").isNotNull().cast("string").alias("b"))))
    each = F.filter(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.struct(F.lit(c).alias("field"), text("_a", c).alias("a"), text("_b", c).alias("b"))) for c in columns]), lambda d: d.isNotNull())
    return both.select(*key, F.explode(F.coalesce(missing, each)).alias("d")).select(*key, "d.*")


def dose_error(said: Column, top: Column, said_unit: Column, low: Column, high: Column, unit: Column, over_per_ha: Column) -> Column:
    """The class of a dose that was objected to.

    ``over_per_ha`` is the stated figure by the label's per-hectare one: near 1, an
    area's figure was passed off as an acre's.
    """
    ref = F.when(high.isNull(), low).when(said > high, high).otherwise(low)
    ratio = F.try_divide(said, ref)
    return (
        F.when(~values.unit_kind(F.lower(said_unit)).eqNullSafe(values.unit_kind(F.lower(unit))), "UNIT_DIMENSION_MISMATCH")
        .when(F.abs(over_per_ha - 1) <= AUDIT_BAND, "PER_HA_NUMBER_LABELLED_PER_ACRE")
        .when(top > F.coalesce(high, low) * (1 + AUDIT_BAND), "WRONG_HIGH_RANGE_TOP")
        .when(high.isNotNull() & said.between(low, high), "LOW_END_OK_TOP_OVER")
        .when(ratio.isNull(), "UNGRADEABLE")
        .when(F.abs(ratio - 1) <= AUDIT_BAND, "WITHIN_8PC_ROUNDING_EDGE")
        .when(ratio > 1, "WRONG_HIGH")
        .otherwise("WRONG_LOW")
    )


def registration_errors(options: DataFrame, labels: DataFrame, pests: DataFrame) -> DataFrame:
    """Unregistered options (item_id, position, crop_slug, canonical, ai_set) with the class of the error.

    ``labels`` is (label_idx, crop_slug, ai_set, pest_or_disease), ``pests`` the
    canonical names of its rows. A printed pest that holds the canonical name is
    taken for the same organism.
    """
    registered = pests.join(labels, "label_idx").select("crop_slug", "canonical", "ai_set").distinct()
    wrong = options.join(registered, ["crop_slug", "canonical", "ai_set"], "left_anti")
    on_crop = labels.groupBy("crop_slug", "ai_set").agg(F.array_sort(F.collect_set("pest_or_disease")).alias("printed"))
    met = wrong.join(on_crop, ["crop_slug", "ai_set"], "left")
    same = F.exists("printed", lambda p: F.contains(F.lower(p), F.lower(F.col("canonical"))))
    kind = F.when(F.col("canonical").isNull(), "iv_PEST_UNRESOLVED").when(F.col("printed").isNull(), "iii_INVENTION").when(same, "i_SYNONYM_FALSE_NEGATIVE").otherwise("ii_MIS_ASSOCIATION")
    return met.withColumn("klass", kind)


def refusals(scores: DataFrame, answerability: str, n_options: str) -> DataFrame:
    """Answerable, valid items and how many of them offer nothing."""
    return scores.where((F.col(answerability) == "ANSWERABLE") & F.col("g2_schema")).agg(F.count("*").alias("n"), F.count(F.when(F.col(n_options) == 0, 1)).alias("n_refused"))


def refolded(scores: DataFrame, check: str, new: Column, weights: dict[str, float], checks: str = "checks") -> DataFrame:
    """Scores with one check put right: ``counterfactual`` and the change."""
    present = {k: F.try_element_at(checks, F.lit(k)) for k in weights}
    present[check] = F.when(present[check].isNotNull(), F.coalesce(new, present[check]))
    total = values.weighted_mean(weights, present)
    return scores.withColumn("counterfactual", F.when(F.col("score").isNotNull(), total)).withColumn("change", F.col("counterfactual") - F.col("score"))


def noise_class(old: Column, new: Column, hit_limit: Column) -> Column:
    """Whether a second run gave the same text, one that goes on from a cut-off, or another."""
    return F.when(old == new, "IDENTICAL").when(hit_limit & new.startswith(old), "PREFIX").otherwise("DIFFERENT")


def noise_floor(runs: DataFrame) -> DataFrame:
    """Score differences by class: ``runs`` is (item_id, old, new, hit_limit, score_old, score_new)."""
    d = F.col("score_new") - F.col("score_old")
    kinds = runs.withColumn("klass", noise_class(F.col("old"), F.col("new"), F.col("hit_limit")))
    return kinds.groupBy("klass").agg(F.count("*").alias("n"), F.count(F.when(d != 0, 1)).alias("n_differ"), F.avg(F.abs(d)).alias("mean_abs"), F.avg(d).alias("mean_signed"))


def integrity(expected: DataFrame, rows: DataFrame, key: str, digest: Column, wanted: str) -> DataFrame:
    """Counts of repeated, missing and unknown keys and of rows whose digest isn't the recorded one, in one row."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    marked = expected.select(key).distinct().withColumn("_known", F.lit(True)).join(n, key, "full")
    keys = marked.agg(F.count(F.when(F.col("_n") > 1, 1)).alias("repeated"), F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_known").isNull(), 1)).alias("unknown"))
    wrong = rows.agg(F.count(F.when(~digest.eqNullSafe(F.col(wanted)), 1)).alias("wrong_digest"))
    return keys.join(wrong, F.lit(True))  # one row each


def rounding_modes(said: Column, low: Column) -> dict[str, Column]:
    """A point dose's verdict when compared as it is, exactly, and with the audit's band."""
    off = F.try_divide(F.abs(said - low), low)
    return {"tolerant": off <= 0.05, "exact": said == low, "banded": off <= AUDIT_BAND}


def touched_items(options: DataFrame, reviewed: DataFrame, key: list[str], klass: str) -> DataFrame:
    """Items with an option that rests on a reviewed row, by the row's class."""
    return options.join(reviewed.select(*key, klass), key).groupBy(klass).agg(F.count_distinct("item_id").alias("n_items"))


def slice_balance(scores: DataFrame, by: str = "slice") -> DataFrame:
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def survey(df: DataFrame, value: str, pattern: Column, examples: int = 5) -> DataFrame:
    """For each pattern the distinct values and rows, and its first values in order."""
    seen = df.groupBy(F.col(value).alias("_v"), pattern.alias("pattern")).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("_v"))
    first = seen.withColumn("_place", place).where(F.col("_place") <= examples).groupBy(F.col("pattern").alias("_p")).agg(F.array_sort(F.collect_list("_v")).alias("examples"))
    totals = seen.groupBy("pattern").agg(F.count("*").alias("n_values"), F.sum("_n").alias("n_rows"))
    return totals.join(first, F.col("pattern").eqNullSafe(F.col("_p")), "left").drop("_p")


def unmapped(observed: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Observed forms that a mapping lacks; a build fails unless this is empty."""
    return observed.select(*keys).distinct().join(mapping.select(*keys).distinct(), keys, "left_anti")


def transcription_check(listed: DataFrame, name: str, text: DataFrame, body: str) -> DataFrame:
    """Which listed names occur in a text, letters and digits only: (name, found).

    Names meet texts by their first characters, four at most, in an equi-join, and are
    then looked for whole. A name without a letter or digit is found where there is a text.
    """
    bare = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9]", "")
    names = listed.select(bare(name).alias("_name")).distinct().withColumn("_start", F.substring("_name", 1, 4))
    bodies = text.select(bare(body).alias("_body"))
    places = F.when(F.length("_body") > 0, F.sequence(F.lit(1), F.length("_body"))).otherwise(F.array().cast("array<int>"))
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(places, lambda i: F.substr("_body", i, n))))
    met = bodies.select("_body", F.explode(F.array_distinct(F.concat(starts, F.array(F.lit(""))))).alias("_start")).join(names, "_start")
    found = met.where(F.contains("_body", F.col("_name"))).select("_name").distinct().withColumn("_found", F.lit(True))
    return listed.withColumn("_name", bare(name)).join(found, "_name", "left").select(name, F.coalesce("_found", F.lit(False)).alias("found"))


def unaccounted(aligned: DataFrame) -> DataFrame:
    """Physical rows whose cells aren't all in their logical row."""
    return aligned.where("n_parts > 0 and matched < n_parts")


def stratified(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """``k`` rows of each group, evenly spread over its order."""
    w = Window.partitionBy(*group)
    tile = F.ntile(k).over(w.orderBy(*order))
    marked = df.withColumn("_t", tile)
    return marked.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_t").orderBy(*order))).where("_n = 1").drop("_t", "_n")


def control_sample(df: DataFrame, touched: DataFrame, group: list[str], key: str, targets: DataFrame, n: int, seed: int) -> DataFrame:
    """The target rows and ``n`` controls by hash from groups that weren't touched."""
    from .sets import uniform_sample

    controls = uniform_sample(df.join(touched.select(*group).distinct(), group, "left_anti"), n, seed, key)
    chosen = df.join(targets.select(key).distinct(), key, "left_semi")
    return chosen.withColumn("role", F.lit("target")).unionByName(controls.withColumn("role", F.lit("control")))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))
