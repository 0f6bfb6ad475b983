"""Reviews of finished data: second passes, flags, contradictions, replays, removals, snapshots and constructed items."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, domain
from ..functions.dose import with_parsed_dose
from ..functions.text import has_term, normalized
from ..session import ready
from .aggregates import sign_test
from .joins import term_matches


def refilled_doses(df: DataFrame, key: str, cell: str, ingredient: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their dose read again, rows that moved though they mustn't).

    Only cells that lack a unit get one, from the product's formulation; what was read
    otherwise must stay as it was, so the second frame has to be empty.
    """
    unit = F.when(F.col("first_code") == "NEEDS_UNIT", cells.formulation_unit(F.col(ingredient)))
    once = with_parsed_dose(df, cell, "first").withColumn("unit_given", unit)
    twice = with_parsed_dose(once, cell, "dose", unit_column="unit_given")
    fields = ("branch", "pattern", "basis", "value_min", "value_max", "unit", "code")
    moved = F.lit(False)
    for f in fields:
        moved = moved | ~F.col(f"first_{f}").eqNullSafe(F.col(f"dose_{f}"))
    kept = twice.select(*df.columns, "unit_given", *[f"dose_{f}" for f in fields])
    return kept, twice.where(moved & F.col("unit_given").isNull()).select(key)


def quality_flags(df: DataFrame, row_id: str, text: str, crop: str, named_crop: Column, banned: DataFrame, term: str, matchable: DataFrame) -> DataFrame:
    """Adds crop_mismatch, banned_mention (null where no text), local_terms and matchable to questions.

    ``named_crop`` is the one crop that the text names, or null; ``banned`` has the
    ``term`` of each banned chemical; ``matchable`` is (crop column, target): pairs that
    the label facts can answer, looked for in the text.
    """
    hits = term_matches(df, banned, row_id, text, term).select(row_id).distinct().withColumn("_banned", F.lit(True))
    known = term_matches(df, matchable.select(crop, "target"), row_id, text, "target", key=crop).select(row_id).distinct().withColumn("_known", F.lit(True))
    plain = normalized(text)
    local = F.exists(F.array(*[F.lit(w) for w in sorted({*domain.LOCAL_PESTS, *domain.LOCAL_CROPS})]), lambda w: has_term(plain, w))
    out = df.join(hits, row_id, "left").join(known, row_id, "left")
    return out.withColumns(
        {
            "crop_mismatch": F.coalesce(named_crop != F.col(crop), F.lit(False)),
            "banned_mention": F.when(F.col(text).isNotNull(), F.coalesce("_banned", F.lit(False))),
            "local_terms": local,
            "matchable": F.coalesce("_known", F.lit(False)),
        }
    ).drop("_banned", "_known")


def contradictions(facts: DataFrame, use: list[str], values: list[str]) -> DataFrame:
    """Uses that the facts state in several ways: (use, n_rows, n_ways). Null values are a way of their own."""
    way = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    ways = facts.groupBy(*use, way.alias("_way")).agg(F.count("*").alias("_n"))
    return ways.groupBy(*use).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_ways")).where("n_ways > 1")


def cross_checked(found: DataFrame, listed: DataFrame, use: list[str]) -> DataFrame:
    """Each use of either side with ``state``: confirmed, unlisted (found only) or unfounded (listed only)."""
    one, two = found.select(*use).distinct().withColumn("_f", F.lit(True)), listed.select(*use).distinct().withColumn("_l", F.lit(True))
    state = F.when(F.col("_f") & F.col("_l"), "confirmed").when(F.col("_f"), "unlisted").otherwise("unfounded")
    return one.join(two, use, "full").select(*use, state.alias("state"))


def option_replay(options: DataFrame, facts: DataFrame, use: list[str], tolerance: float = 0.05) -> DataFrame:
    """Each option (item_id, position, use, dose, phi) with the verdict of the best fact of its use.

    Verdicts, the first that applies: unregistered, dose_low, dose_high, period_short,
    fine. Of several facts the one with the mildest verdict counts. ``facts`` is (use,
    low, high, phi); a null high means a point dose, a null phi any period.
    """
    ranks = ("fine", "period_short", "dose_high", "dose_low", "unregistered")
    met = options.join(facts, use, "left")
    top = F.coalesce("high", "low")
    rank = (
        F.when(F.col("low").isNull(), 4).when(F.col("dose") < F.col("low") * (1 - tolerance), 3).when(F.col("dose") > top * (1 + tolerance), 2).when(F.coalesce(F.col("option_phi") < F.col("phi"), F.lit(False)), 1).otherwise(0)
    )
    best = met.groupBy("item_id", "position").agg(F.min(rank).alias("_rank"))
    return best.select("item_id", "position", F.get(F.array(*[F.lit(r) for r in ranks]), F.col("_rank")).alias("verdict"))


def rerun_list(replayed: DataFrame) -> DataFrame:
    """Items to run again: those with an option that isn't fine, with the verdicts as evidence."""
    return replayed.where("verdict <> 'fine'").groupBy("item_id").agg(F.count("*").alias("n_options"), F.array_sort(F.collect_set("verdict")).alias("verdicts"))


def judged_removals(removed: DataFrame, registered: DataFrame, use: list[str]) -> DataFrame:
    """Each removed option (item_id, position, use, reason) with ``judged``: right, or false_positive if its use is registered."""
    known = registered.select(*use).distinct().withColumn("_there", F.lit(True))
    wrong = F.col("_there").isNotNull() & (F.col("reason") == "unregistered")
    return removed.join(known, use, "left").withColumn("judged", F.when(wrong, "false_positive").otherwise("right")).drop("_there")


def residual_errors(kept: DataFrame, replayed: DataFrame) -> DataFrame:
    """Wrong options that are still there after the guard, by verdict: (verdict, n_options, n_items)."""
    left = kept.select("item_id", "position").join(replayed.where("verdict <> 'fine'"), ["item_id", "position"])
    return left.groupBy("verdict").agg(F.count("*").alias("n_options"), F.count_distinct("item_id").alias("n_items"))


def snapshot(df: DataFrame, key: list[str], columns: Iterable[str]) -> DataFrame:
    """(key, digest): the frozen state of a table's rows, to be written once and compared later."""
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(*key, F.sha2(content, 256).alias("digest"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a table has lost, gained or changed since its snapshot: (key, change)."""
    both = old.select(*key, F.col("digest").alias("_old")).join(new.select(*key, F.col("digest").alias("_new")), key, "full")
    change = F.when(F.col("_new").isNull(), "lost").when(F.col("_old").isNull(), "gained").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def range_verdicts(low: Column, top: Column, fact_low: Column, fact_high: Column, band: float = 0.08) -> dict[str, Column]:
    """Whether a stated range lies inside a fact's when compared as it is, exactly at both ends, and with the band."""
    high = F.coalesce(fact_high, fact_low)
    inside = lambda t: (low >= fact_low * (1 - t)) & (top <= high * (1 + t))
    return {"tolerant": inside(0.05), "exact": (low == fact_low) & (top == high), "banded": inside(band)}


def with_sign_test(counts: DataFrame, wins: str = "wins", losses: str = "losses", out: str = "p_value") -> DataFrame:
    """Adds the two-sided exact sign test's probability to rows of counted wins and losses."""
    ready(counts.sparkSession)

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([sign_test(int(a), int(b)) for a, b in zip(w, n, strict=True)], dtype=float)

    return counts.withColumn(out, p(wins, losses))


def tightened(schema: dict) -> dict:
    """A JSON schema that allows no other fields and asks for all: objects at every depth get both rules."""
    def walk(node):
        if isinstance(node, list):
            return [walk(x) for x in node]
        if not isinstance(node, dict):
            return node
        out = {k: walk(v) for k, v in node.items() if k not in ("default", "title")}
        if isinstance(node.get("properties"), dict):
            out["properties"] = {k: walk(v) for k, v in node["properties"].items()}
            out |= {"additionalProperties": False, "required": sorted(node["properties"])}
        return out

    return walk(schema)


def constructed_items(spark: SparkSession, facts: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Benchmark items made from the domain's lists: (item_id, bucket, crop_slug, canonical, query_text, escalate, n_options).

    Buckets: ``no_chemistry`` asks about targets that no chemical helps against,
    ``refusal`` for a restricted chemical on a crop, ``hard`` which of two targets
    that are taken for each other it is, ``expansion`` about each (crop, target) that
    ``facts`` (crop_slug, canonical) can answer.
    """
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]) for p in parts])
    item = lambda df, bucket, text, escalate, options: df.select(
        F.concat_ws(":", F.lit(bucket), "crop_slug", "canonical").alias("item_id"), F.lit(bucket).alias("bucket"), "crop_slug", "canonical", text.alias("query_text"), F.lit(escalate).alias("escalate"), F.lit(options).alias("n_options")
    )
    none = spark.createDataFrame([(c, n) for c, targets in domain.TARGETS.items() for n, _, chemistry in targets if chemistry == "none"], "crop_slug string, canonical string")
    pairs = spark.createDataFrame([(c, a, b) for c, a, d, b in domain.CONFUSABLE if c == d], "crop_slug string, canonical string, other string")
    limited = restrictions.select(F.col("name").alias("canonical"), F.explode("crops").alias("crop_slug"))
    return (
        item(none, "no_chemistry", say("What can be sprayed against ", "$canonical", " on ", "$crop_slug", "?"), True, 0)
        .unionByName(item(limited, "refusal", say("How much ", "$canonical", " should I use on ", "$crop_slug", "?"), True, 0))
        .unionByName(item(pairs, "hard", say("Is it ", "$canonical", " or ", "$other", " on my ", "$crop_slug", ", and what helps?"), False, 1))
        .unionByName(item(facts.select("crop_slug", "canonical").distinct(), "expansion", say("$canonical", " on ", "$crop_slug", ", what helps?"), False, 1))
    )
