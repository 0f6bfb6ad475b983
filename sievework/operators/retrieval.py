"""Resolving a question to a key, retrieving its label facts, and the prompts made of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, domain, names
from ..functions.text import has_term, normalized
from ..session import ready
from .joins import keep_if_any, longest_term, term_matches
from .verification import Labels, matched_pests, synonym_views
from .windows import capped

#: The greatest number of rows shown, and the lines of the fact sheet.
MAX_ROWS = 15
NOTICE = "Showing {included} of {available} registered options for this crop and pest (label order, not ranked). The list above is not exhaustive."
MISS_LINES = {
    "no_rows": "No registered chemistry found for this crop and pest in CIB&RC.",
    "unresolved": "Retrieval could not identify a specific crop and pest from this query. No fact sheet available.",
}
#: The fields of a fact-sheet row in their order.
SHEET_FIELDS = ("ai", "dose_basis", "dose_min", "dose_max", "dose_unit", "dose_per_acre_min", "dose_per_acre_max", "dose_raw", "phi_days", "phi_not_applicable", "phi_raw", "application_method", "biological")


def pest_tags(df: DataFrame, row_id: str, text: str, synonyms: DataFrame, views: list | None = None) -> DataFrame:
    """(row_id, canonical, pest_string, reason) for each row (row_id, crop_slug, text).

    A known name of the crop, the longest first; then a local term; then the first
    noun that stands for a pest, with its modifier. ``reason`` says why none is found.
    """
    rows = df.select(row_id, "crop_slug", F.col(text).alias("_text"))
    views = views if views is not None else synonym_views(synonyms)
    terms = matched_pests(synonyms.select("crop_slug", "surface_form").distinct(), "surface_form", views).where("canonical is not null").select("crop_slug", "surface_form", "canonical")
    known = longest_term(term_matches(rows, terms, row_id, "_text", "surface_form", key="crop_slug"), row_id, "surface_form")
    known = known.select(row_id, F.struct(F.col("canonical"), F.col("surface_form").alias("pest_string")).alias("_known"))
    norm = normalized("_text")
    local = F.coalesce(*[F.when(has_term(norm, F.lit(k)), F.struct(F.lit(domain.SYNONYMS[k]).alias("canonical"), F.lit(k).alias("pest_string"))) for k in domain.SYNONYMS if k in domain.LOCAL_PESTS])
    guess = matched_pests(rows.select(row_id, "crop_slug", F.get(names.pest_phrases(F.col("_text")), F.lit(0)).alias("phrase")).where("phrase is not null"), "phrase", views)
    keyed = synonyms.select(names.pest_key(F.col("surface_form")).alias("_key"), F.trim("canonical_name").alias("_c")).groupBy("_key").agg(F.count_distinct("_c").alias("_meanings"))
    guess = guess.withColumn("_key", names.pest_key(F.col("phrase"))).join(keyed, "_key", "left").select(row_id, F.struct("canonical", F.col("phrase").alias("pest_string"), (F.col("_meanings") > 1).alias("several")).alias("_guess"))
    out = rows.withColumn("_local", local).join(known, row_id, "left").join(guess, row_id, "left")
    first = lambda f: F.coalesce(F.col("_known")[f], F.col("_local")[f], F.col("_guess")[f])
    reason = (
        F.when(norm == "", "empty query").when(first("canonical").isNotNull(), "").when(F.col("_guess").isNull(), "no pest term found in query")
        .when(F.coalesce(F.col("_guess.several"), F.lit(False)), "ambiguous across crops").otherwise("no match in synonym table")
    )
    return out.select(row_id, first("canonical").alias("canonical"), F.coalesce(first("pest_string"), F.lit("")).alias("pest_string"), reason.alias("reason"))


def resolved_keys(df: DataFrame, row_id: str, text: str, synonyms: DataFrame, crop_hint: str | None = None, views: list | None = None) -> DataFrame:
    """(row_id, crop_slug, canonical, method) of questions from their text; a crop that is given wins over the text's."""
    named = names.single_crop(F.col(text))
    crop = F.coalesce(F.col(crop_hint), named) if crop_hint else named
    rows = df.select(row_id, F.col(text).alias("_text"), crop.alias("crop_slug"), cells.application_method(F.col(text)).alias("method"))
    tags = pest_tags(rows.where("crop_slug is not null"), row_id, "_text", synonyms, views)
    return rows.join(tags.select(row_id, "canonical"), row_id, "left").select(row_id, "crop_slug", "canonical", "method")


def retrieved(keys: DataFrame, row_id: str, labels: Labels, cap: int | None = MAX_ROWS) -> DataFrame:
    """The label rows of each key (row_id, crop_slug, canonical, method), in label order, ``cap`` at most.

    Trainable, whole, uncontradicted rows without a restricted component; then
    those of the asked method if there are some. ``rows_available`` counts before the cap.
    """
    fine = labels.rows.where("trainable and not defective and coalesce(contradiction, '') = ''")
    parts = fine.select("label_idx", "crop_slug", F.explode("ai_set").alias("component"))
    hit = parts.join(labels.restrictions, F.col("component") == F.col("name")).where(F.col("tier").isin("banned", "refused_registration") | (F.size("crops") == 0) | F.array_contains("crops", F.lower(F.trim("crop_slug"))))
    fine = fine.join(hit.select("label_idx").distinct(), "label_idx", "left_anti")
    met = keys.where("crop_slug is not null and canonical is not null").join(labels.pests.join(fine, "label_idx"), ["crop_slug", "canonical"])
    met = keep_if_any(met, [row_id], (F.col("application_method") == F.col("method")) & (F.coalesce("method", F.lit("")) != ""))
    return capped(met, [row_id], ["label_idx"], cap)


def sheet_row() -> Column:
    """A label row as a struct of the fact sheet's fields."""
    named = {
        "ai": "active_ingredient", "dose_basis": "dose_formulation_basis", "dose_min": "dose_formulation_value_min", "dose_max": "dose_formulation_value_max", "dose_unit": "dose_formulation_unit",
        "dose_per_acre_min": "dose_formulation_per_acre_min", "dose_per_acre_max": "dose_formulation_per_acre_max", "dose_raw": "dose_formulation_raw",
    }
    method = F.when(F.col("application_method") != "", F.col("application_method"))
    return F.struct(*[(method if f == "application_method" else F.col(named.get(f, f))).alias(f) for f in SHEET_FIELDS])


def fact_sheets(keys: DataFrame, row_id: str, labels: Labels, cap: int | None = MAX_ROWS) -> DataFrame:
    """Each key with its rows, ``rows_available`` and, where there are none, the reason of the miss."""
    got = retrieved(keys, row_id, labels, cap).groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("label_idx", sheet_row().alias("row")))).alias("_rows"), F.max("rows_available").alias("rows_available"))
    out = keys.join(got, row_id, "left").withColumn("rows", F.transform("_rows", lambda r: r["row"]))
    miss = F.when(F.col("rows").isNull(), F.when(F.col("crop_slug").isNotNull() & F.col("canonical").isNotNull(), "no_rows").otherwise("unresolved"))
    return out.withColumns({"miss_reason": miss, "rows_available": F.coalesce("rows_available", F.lit(0)), "rows_included": F.coalesce(F.size("rows"), F.lit(0))}).drop("_rows")


def _number(v):
    return None if v is None or v != v else int(v) if float(v).is_integer() else float(v)


def sheet_text(rows: list | None, miss_reason: str | None, available: int) -> str:
    """The fact sheet's block. Whole numbers are printed without a point."""
    if not rows:
        if miss_reason not in MISS_LINES:
            raise ValueError(f"an empty fact sheet needs a reason, not {miss_reason!r}")
        return f"<fact_sheet>\n{MISS_LINES[miss_reason]}\n</fact_sheet>"
    if available < len(rows):
        raise ValueError(f"{available} rows available, {len(rows)} given")
    numbers = {"dose_min", "dose_max", "dose_per_acre_min", "dose_per_acre_max", "phi_days"}
    body = json.dumps([{f: _number(r[f]) if f in numbers else r[f] for f in SHEET_FIELDS} for r in rows], ensure_ascii=False)
    notice = "\n" + NOTICE.format(included=len(rows), available=available) if available > len(rows) else ""
    return f"<fact_sheet>\n{body}{notice}\n</fact_sheet>"


def with_prompt(sheets: DataFrame, text: str, out: str = "user_message") -> DataFrame:
    """Adds the user message: the question with its crop, a blank line and the fact sheet."""
    ready(sheets.sparkSession)

    @F.pandas_udf("string")
    def blocks(row_json: pd.Series, miss: pd.Series, available: pd.Series) -> pd.Series:
        return pd.Series([sheet_text(json.loads(r) if r else None, m, int(n)) for r, m, n in zip(row_json, miss, available, strict=True)])

    rows = F.to_json("rows", {"ignoreNullFields": "false"})
    head = F.when(F.col("crop_slug").isNotNull(), F.concat(F.lit('<query crop="'), F.col("crop_slug"), F.lit('">'))).otherwise(F.lit("<query>"))
    query = F.concat(head, F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n</query>"))
    return sheets.withColumn(out, F.concat_ws("\n\n", query, blocks(rows, "miss_reason", "rows_available")))


def truncation_cost(gold: DataFrame, keys: DataFrame, row_id: str, labels: Labels, cap: int = MAX_ROWS) -> DataFrame:
    """For each gold option (row_id, ai_set) whether a shown or only a cut row has it."""
    all_rows = retrieved(keys, row_id, labels, None).withColumn("_n", F.row_number().over(Window.partitionBy(row_id).orderBy("label_idx")))
    met = gold.join(all_rows.select(row_id, "ai_set", (F.col("_n") <= cap).alias("_shown")), [row_id, "ai_set"], "left")
    return met.groupBy(row_id, "ai_set").agg(F.coalesce(F.bool_or("_shown"), F.lit(False)).alias("shown"), F.coalesce(F.bool_or(~F.col("_shown")), F.lit(False)).alias("cut"))


def token_count(text: Column) -> Column:
    """Stand-in for a chat template's token count: words and punctuation marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))
