"""Verification of answer records against label facts, as one relational plan.

Four grains: an item has options, an option has candidate label rows, each gets a
verdict, and verdicts are folded back by consensus. Candidates of an option are
narrowed by windows only where that leaves some. Gates and checks that weren't
reached or don't apply are absent, which is not the same as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, domain, names, values
from ..functions.records import with_checked_record
from .filters import label_flags
from .graph import cut
from .joins import first_of_key, narrow, prioritised

#: Weights of the checks, the checks that block an answer, and the tolerance of a point dose.
WEIGHTS = {"C1_dose": 0.30, "C2_phi": 0.25, "C3_formulation": 0.10, "C4_escalation": 0.15, "C5_causes_top1": 0.10, "C6_non_chemical": 0.10}
BLOCKING = ("C1_dose", "C2_phi")
REFUSAL_MISSES = ("C1_dose", "C2_phi", "C3_formulation")
TOLERANCE = 0.05
GATES = ("G1_json", "G2_schema", "G3_empty_when_not_answering", "G4_restricted_ai", "G5_triple_registered", "G6_unknown_phi_escalates", "G7_trainable_row", "G8_dose_basis", "G9_unstated_dose_earned")
AREA = ("per_ha", "per_acre")


@dataclass
class Labels:
    """Label facts ready for lookups: ``rows`` by label_idx, ``pests`` their canonical names, and the synonym views."""

    rows: DataFrame
    pests: DataFrame
    synonyms: DataFrame
    restrictions: DataFrame
    views: list[tuple[str, DataFrame, list[str]]]


def synonym_views(synonyms: DataFrame) -> list[tuple[str, DataFrame, list[str]]]:
    """The views that a name is looked up in: as printed, in normal form, and in normal form on any crop.

    The first row of a key counts. A name is found without its crop only if it
    means one thing on all crops, unmatchable fragments counting as a meaning.
    """
    base = synonyms.select(
        F.trim("crop_slug").alias("crop_slug"), F.trim("surface_form").alias("surface"), F.trim("canonical_name").alias("canonical"), F.trim("pest_type").alias("pest_type"), "ordinal",
        names.folded_name(F.col("surface_form")).alias("folded"), names.pest_key(F.col("surface_form")).alias("pest_key"),
    )
    keyed = base.where("pest_key <> ''")
    one_meaning = keyed.groupBy("pest_key").agg(F.count_distinct("canonical").alias("_n")).where("_n = 1").select("pest_key")
    return [
        ("exact", first_of_key(base, ["crop_slug", "folded"], ["ordinal"]), ["crop_slug", "folded"]),
        ("normalized", first_of_key(keyed, ["crop_slug", "pest_key"], ["ordinal"]), ["crop_slug", "pest_key"]),
        ("synonym", first_of_key(keyed.drop("crop_slug").join(one_meaning, "pest_key"), ["pest_key"], ["ordinal"]), ["pest_key"]),
    ]


def matched_pests(df: DataFrame, name: str, synonyms: DataFrame | list) -> DataFrame:
    """Adds canonical, pest_type, surface and confidence of the name in ``name`` on ``crop_slug``.

    ``synonyms`` is the table or its views, if those are at hand.

    An unmatchable fragment has a surface but no canonical name; what isn't found,
    or has no crop, has neither and is ``unmatched``.
    """
    plain = df.withColumns({"_crop": F.col("crop_slug"), "crop_slug": F.lower(F.trim(F.coalesce(F.col("crop_slug"), F.lit("")))), "folded": names.folded_name(F.col(name)), "pest_key": names.pest_key(F.col(name))})
    known = plain.withColumns({k: F.when((F.col("crop_slug") != "") & (F.col("folded") != ""), F.col(k)) for k in ("folded", "pest_key")}).withColumn("pest_key", F.when(F.col("pest_key") != "", F.col("pest_key")))
    found = prioritised(known, synonyms if isinstance(synonyms, list) else synonym_views(synonyms), ["canonical", "pest_type", "surface"])
    real = F.col("canonical").isNotNull() & (F.col("canonical") != domain.UNMATCHABLE)
    return found.withColumns(
        {"confidence": F.when(real, F.col("confidence")).otherwise("unmatched"), "pest_type": F.when(real, F.col("pest_type")), "canonical": F.when(real, F.col("canonical")), "crop_slug": F.col("_crop")}
    ).drop("_crop", "folded", "pest_key")


def matched_cells(df: DataFrame, row_id: str, column: str, synonyms: DataFrame | list) -> DataFrame:
    """(row_id, crop_slug, ordinal, mention, canonical, surface) for every mention of pest cells; a failed name is tried again by its binomial."""
    mentions = names.pest_mentions(df.select(row_id, "crop_slug", column), column)
    mentions = mentions.withColumn("_name", F.when(F.col("common") != "", F.col("common")).otherwise(F.col("mention")))
    one = matched_pests(mentions, "_name", synonyms)
    again = matched_pests(one.where("canonical is null and scientific is not null").select(row_id, "ordinal", "crop_slug", "scientific"), "scientific", synonyms)
    again = again.where("canonical is not null").select(row_id, "ordinal", F.struct("canonical", "surface").alias("_again"))
    both = one.join(again, [row_id, "ordinal"], "left")
    return both.select(row_id, "crop_slug", "ordinal", "mention", *[F.coalesce(F.col("_again")[c], F.col(c)).alias(c) for c in ("canonical", "surface")])


def prepared_labels(labels: DataFrame, synonyms: DataFrame, restrictions: DataFrame, contradictions: DataFrame) -> Labels:
    """Keys, flags and contradictions on the label facts, and the canonical names of their pest cells.

    All parts are looked up many times in one plan, so they are cut off here.
    """
    views = [(n, cut(v), k) for n, v, k in synonym_views(synonyms)]
    keys = ["source_file", "source_page", "source_row_index"]
    known = contradictions.select(*[F.col(k).cast("string").alias(k) for k in keys], F.concat_ws(": ", "group_id", "reason").alias("contradiction")).groupBy(*keys).agg(F.min("contradiction").alias("contradiction"))
    rows = label_flags(labels.withColumns({k: F.col(k).cast("string") for k in keys})).join(known, keys, "left")
    ingredient = F.col("active_ingredient")
    rows = rows.withColumns({"ai_set": cells.ingredient_set(ingredient), "strain": cells.strain_key(ingredient), "form_key": cells.formulation_key(ingredient), "application_method": F.coalesce("application_method", F.lit(""))})
    pests = matched_cells(labels, "label_idx", "pest_or_disease", views).where("canonical is not null").select("label_idx", "canonical").distinct()
    limits = restrictions.select(
        cells.restricted_name(F.col("active_ingredient")).alias("name"), F.lower(F.trim("tier")).alias("tier"), "active_ingredient",
        F.filter(F.transform(F.split(F.coalesce("restricted_crops", F.lit("")), ";"), lambda c: F.lower(F.trim(c))), lambda c: c != "").alias("crops"),
    )
    return Labels(cut(rows), cut(pests), cut(synonyms), cut(limits), views)


def answerability(crop: Column, canonical: Column, any_trainable: Column) -> Column:
    """Whether a question can be answered from the label facts, and if not, why."""
    return (
        F.when(~F.coalesce(F.lower(F.trim(crop)).isin(*domain.CROPS), F.lit(False)), "OUT_OF_SCOPE_CROP")
        .when(canonical.isNull(), "PEST_UNKNOWN")
        .when(F.coalesce(any_trainable, F.lit(False)), "ANSWERABLE")
        .otherwise("NO_REGISTERED_CHEMISTRY")
    )


def pair_facts(labels: Labels) -> DataFrame:
    """What the label facts say of each (crop_slug, canonical)."""
    rows = labels.pests.join(labels.rows, "label_idx")
    return rows.groupBy("crop_slug", "canonical").agg(F.bool_or("trainable").alias("any_trainable"), F.bool_and("defective").alias("all_defective"), F.bool_or("biological").alias("any_biological"), F.count("*").alias("n_rows"))


def _compatible(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | a.isin(*AREA) & b.isin(*AREA), F.lit(False))


def _candidates(options: DataFrame, labels: Labels) -> DataFrame:
    """Label rows of each option's (crop, pest, components), narrowed by method, strain and formulation where that leaves some."""
    registered = labels.pests.join(labels.rows, "label_idx")
    met = options.join(registered.drop("application_method").join(labels.rows.select("label_idx", F.col("application_method").alias("row_method")), "label_idx"), ["crop_slug", "canonical", "ai_set"])
    want = F.col("want_key")
    hits = [
        (F.col("asked_method") == F.col("row_method")) & (F.coalesce("asked_method", F.lit("")) != ""),
        (F.col("want_strain") != "") & (F.col("strain") == F.col("want_strain")),
        (want["code"].isNotNull() | want["strength"].isNotNull()) & F.col("form_key").eqNullSafe(want),
    ]
    return narrow(met, ["item_id", "position"], hits)


def _dose_verdict() -> Column:
    """Whether an option's dose fits a candidate's: null without figures, false for another dimension."""
    acre = F.col("option.dose.basis") == "per_acre"
    pick = lambda end: F.when(acre, F.col(f"dose_formulation_per_acre_{end}")).otherwise(F.col(f"dose_formulation_value_{end}"))
    unit, said = F.when(F.col("dose_formulation_unit") != "", F.col("dose_formulation_unit")), F.col("option.dose")
    low, high = values.in_base_unit(pick("min"), unit), values.in_base_unit(pick("max"), unit)
    fits = lambda x: F.when(high.isNotNull(), (x >= low) & (x <= high)).when(low == 0, x == low).otherwise(F.abs(x - low) / low <= TOLERANCE)
    mine, top = values.in_base_unit(said["value_min"], said["unit"]), values.in_base_unit(said["value_max"], said["unit"])
    return F.when(low.isNull() | mine.isNull(), F.lit(None).cast("boolean")).when(values.unit_kind(said["unit"]) != values.unit_kind(unit), F.lit(False)).otherwise(fits(mine) & F.when(said["value_max"].isNull(), F.lit(True)).otherwise(F.coalesce(fits(top), F.lit(False))))


def verify(items: DataFrame, labels: Labels, mode: str = "score") -> DataFrame:
    """One row for each item: gates, checks, ambiguous, failures, excluded, exclusion_reason, total, passed, answerability.

    ``items`` is (item_id, crop_slug, pest_query, application_method, gold_escalate,
    output). Modes: gate (passes at 1.0 only, ambiguous ones are excluded), score
    (graded, ambiguous ones left out) and filter (dose and waiting period block, as
    does ambiguity). ``failures`` holds a code and a detail each.
    """
    base = matched_pests(with_checked_record(items, "output"), "pest_query", labels.views).join(pair_facts(labels), ["crop_slug", "canonical"], "left")
    rec = F.col("checked.record")
    base = cut(base).withColumns({"answerability": answerability(F.col("crop_slug"), F.col("canonical"), F.col("any_trainable")), "asked_method": F.col("application_method")})

    said = base.where("checked.is_valid").select("item_id", "crop_slug", "canonical", "asked_method", rec["escalate_to_expert"].alias("escalates"), F.posexplode("checked.record.chemical_options").alias("position", "option"))
    name, form = F.col("option.active_ingredient"), F.col("option.formulation")
    said = said.withColumns({"ai_set": cells.ingredient_set(name), "want_strain": cells.strain_key(form), "want_key": cells.formulation_key(form)})

    parts = said.select("item_id", "crop_slug", F.explode("ai_set").alias("component"))
    hit = parts.join(labels.restrictions, F.col("component") == F.col("name"))
    crop = F.lower(F.trim(F.coalesce("crop_slug", F.lit(""))))
    hit = hit.where(F.col("tier").isin("banned", "refused_registration") | (F.size("crops") == 0) | F.array_contains("crops", crop))
    limited = hit.groupBy("item_id").agg(F.array_sort(F.collect_set("component")).alias("restricted"))

    said = cut(said)
    cand = _candidates(said, labels)
    period, label_days = F.col("option.phi_days"), F.col("phi_days")
    cand = cand.withColumns(
        {
            "same_basis": _compatible(F.col("option.dose.basis"), F.col("dose_formulation_basis")),
            "dose_ok": _dose_verdict(),
            "phi_ok": F.when(label_days.isNull() & period.isNull(), F.lit(True)).when(label_days.isNotNull(), F.coalesce(period == label_days, F.lit(False))),
            "unstated_ok": ~F.coalesce(F.col("dose_formulation_branch").isin("numeric", "free_text"), F.lit(False)),
            "form_ok": F.when(F.col("form_key.code").isNotNull() | F.col("form_key.strength").isNotNull(), F.col("form_key").eqNullSafe(F.col("want_key"))),
        }
    )
    dose_any = F.max("same_basis")
    graded_dose = lambda c: F.coalesce(F.when(dose_any, values.consensus(F.bool_and(F.when(F.col("same_basis"), F.col(c))), F.bool_or(F.when(F.col("same_basis"), F.col(c))), F.count(F.when(F.col("same_basis"), F.col(c))))), F.when(~dose_any, values.consensus_agg(F.col(c))))
    by_option = cand.groupBy("item_id", "position").agg(
        F.count("*").alias("n_cand"),
        F.min(F.when(F.coalesce(F.col("contradiction"), F.lit("")) != "", F.col("contradiction"))).alias("contradiction"),
        F.count_distinct(F.coalesce("phi_not_applicable", F.lit(False))).alias("na_states"),
        F.bool_or(F.coalesce("phi_not_applicable", F.lit(False))).alias("says_na"),
        F.bool_or("trainable").alias("any_train"),
        F.count(F.when(F.coalesce("dose_formulation_basis", F.lit("")) != "", 1)).alias("n_bases"),
        F.bool_or("same_basis").alias("basis_ok"),
        values.consensus_agg(F.col("unstated_ok")).alias("unstated"),
        graded_dose("dose_ok").alias("dose"),
        values.consensus_agg(F.col("phi_ok")).alias("phi"),
        F.bool_or("form_ok").alias("form"),
        F.bool_or(label_days.isNull() & ~F.coalesce("phi_not_applicable", F.lit(False))).alias("phi_unknown"),
    )
    o = said.join(by_option, ["item_id", "position"], "left").withColumn("n_cand", F.coalesce("n_cand", F.lit(0)))
    claims_na, unknown = F.col("option.phi_not_applicable"), period.isNull()
    one_state = F.col("na_states") <= 1
    has = F.col("n_cand") > 0
    phi_wrong = (has & ~one_state) == F.lit(False)
    o = o.withColumns(
        {
            "g6_bad": phi_wrong
            & (
                (claims_na & has & ~F.coalesce("says_na", F.lit(False)))
                | (~claims_na & F.coalesce("says_na", F.lit(False)) & unknown)
                | (unknown & ~claims_na & ~F.col("escalates"))
            ),
            "g6_open": has & (F.col("na_states") > 1),
            "g7_bad": has & ~F.coalesce("any_train", F.lit(False)),
            "g8_bad": has & (F.coalesce("n_bases", F.lit(0)) > 0) & ~F.coalesce("basis_ok", F.lit(False)),
            "g9_bad": (F.col("option.dose.basis") == "unstated") & (~F.col("escalates") | F.col("unstated").eqNullSafe("FALSE")),
            "g9_open": (F.col("option.dose.basis") == "unstated") & F.col("unstated").eqNullSafe("AMBIGUOUS"),
        }
    )
    ratio = lambda c: F.avg(F.when(F.col(c) == "TRUE", 1.0).when(F.col(c) == "FALSE", 0.0))
    failed = lambda code, cond: F.collect_list(F.when(cond, F.concat(F.lit(code + ": "), F.col("option.active_ingredient"))))
    by_item = o.groupBy("item_id").agg(
        F.count("*").alias("n_options"),
        F.bool_and(has).alias("g5"),
        F.min_by("contradiction", F.when(F.col("contradiction").isNotNull(), F.col("position"))).alias("contradiction"),
        (~F.bool_or("g6_bad")).alias("g6"),
        (~F.bool_or("g7_bad")).alias("g7"),
        (~F.bool_or("g8_bad")).alias("g8"),
        (~F.bool_or("g9_bad")).alias("g9"),
        F.bool_or("g6_open").alias("g6_open"),
        F.bool_or("g9_open").alias("g9_open"),
        F.bool_or(F.col("dose") == "AMBIGUOUS").alias("c1_open"),
        F.bool_or(F.col("phi") == "AMBIGUOUS").alias("c2_open"),
        ratio("dose").alias("c1"),
        ratio("phi").alias("c2"),
        F.avg(F.col("form").cast("double")).alias("c3"),
        F.coalesce(F.bool_or("phi_unknown"), F.lit(False)).alias("phi_unknown"),
        F.concat(failed("G5", ~has), failed("G6", F.col("g6_bad")), failed("G7", F.col("g7_bad")), failed("G8", F.col("g8_bad")), failed("G9", F.col("g9_bad")), failed("C1", F.col("dose") == "FALSE"), failed("C2", F.col("phi") == "FALSE"), failed("C3", F.col("form") == F.lit(False))).alias("option_failures"),
    )

    causes = base.where("checked.is_valid").select("item_id", "crop_slug", "canonical", F.posexplode(values.top_by(F.col("checked.record.likely_causes"), "confidence", 3)).alias("rank", "cause"))
    ranked = matched_pests(causes.withColumnRenamed("canonical", "gold").withColumn("cause_name", F.col("cause.name")), "cause_name", labels.views)
    right = F.coalesce(F.col("canonical") == F.col("gold"), F.lit(False))
    named = ranked.where("gold is not null").groupBy("item_id").agg(F.max(F.when(F.col("rank") == 0, right.cast("double"))).alias("top1"), F.max(right.cast("double")).alias("top3"))

    out = base.join(limited, "item_id", "left").join(by_item, "item_id", "left").join(named, "item_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(True))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    valid = F.col("checked.is_valid")
    damaged = F.col("surface").isNotNull() & F.col("canonical").isNull()
    early = F.when(valid & damaged, "the pest name is a damaged fragment").when(valid & no("all_defective"), "all label rows of the pair are defective")
    late = F.when(valid & F.col("contradiction").isNotNull(), F.concat(F.lit("documented contradiction: "), F.col("contradiction")))
    out = out.withColumns({"_early": early, "_late": F.when(early.isNull(), late)})
    full = valid & F.col("_early").isNull()
    graded = full & F.col("_late").isNull()
    empty = F.coalesce(F.size(rec["chemical_options"]) == 0, F.lit(True))
    gates = {
        "G1_json": F.col("checked.is_json"),
        "G2_schema": F.when(F.col("checked.is_json"), valid),
        "G3_empty_when_not_answering": F.when(full, rec["in_scope"] & rec["query_understood"] | empty),
        "G4_restricted_ai": F.when(full, F.col("restricted").isNull()),
        "G5_triple_registered": F.when(full, yes("g5")),
        "G6_unknown_phi_escalates": F.when(graded, yes("g6")),
        "G7_trainable_row": F.when(graded, yes("g7")),
        "G8_dose_basis": F.when(graded, yes("g8")),
        "G9_unstated_dose_earned": F.when(graded, yes("g9")),
    }
    gold = F.coalesce("gold_escalate", no("phi_unknown") | (F.col("answerability") == "PEST_UNKNOWN"))
    must = (F.col("answerability") == "NO_REGISTERED_CHEMISTRY") | no("any_biological")
    missed = (F.col("answerability") == "ANSWERABLE") & empty & F.lit(mode == "score")
    graded_checks = {"C1_dose": F.when(missed, 0.0).otherwise(F.col("c1")), "C2_phi": F.when(missed, 0.0).otherwise(F.col("c2"))}
    if mode != "filter":
        graded_checks |= {
            "C3_formulation": F.when(missed, 0.0).otherwise(F.col("c3")),
            "C4_escalation": (rec["escalate_to_expert"] == gold).cast("double"),
            "C5_causes_top1": F.col("top1"),
            "C5_causes_top3": F.col("top3"),
            "C6_non_chemical": F.when(must, (F.size(rec["non_chemical_first"]) > 0).cast("double")),
        }
    checks = {k: F.when(graded, v) for k, v in graded_checks.items()}
    open_points = F.filter(
        F.array(*[F.when(graded & no(c), F.lit(n)) for n, c in (("C1_dose", "c1_open"), ("C2_phi", "c2_open"), ("G6_phi_applicability", "g6_open"), ("G9_unstated_dose_earned", "g9_open"))]), lambda x: x.isNotNull()
    )
    out = out.withColumns({"ambiguous": open_points, "_gates_ok": sum((F.when(g == F.lit(False), 1).otherwise(0) for g in gates.values()), F.lit(0)) == 0})
    weighed = {k: v for k, v in checks.items() if k in WEIGHTS}
    blocked = F.lit(False)
    for k in BLOCKING:
        blocked = blocked | F.coalesce(checks[k] < 1, F.lit(False))
    ambiguous = F.size("ambiguous") > 0
    reason = F.coalesce("_early", "_late", F.when(ambiguous & F.lit(mode == "gate"), F.concat(F.lit("ambiguous ground truth: "), F.array_join("ambiguous", ", "))))
    out = out.withColumn("exclusion_reason", reason)
    excluded = F.col("exclusion_reason").isNotNull()
    if mode == "filter":
        blocked = blocked | (ambiguous & ~excluded)
        total = F.when(F.col("_gates_ok") & ~blocked, 1.0).otherwise(0.0)
        passed = F.col("_gates_ok") & ~blocked
    else:
        total = F.when(F.col("_gates_ok"), values.weighted_mean(WEIGHTS, weighed)).otherwise(0.0)
        passed = F.col("_gates_ok") & (total == 1.0) if mode == "gate" else F.col("_gates_ok")
    restricted = F.transform(F.coalesce("restricted", F.array().cast("array<string>")), lambda c: F.concat(F.lit("G4: "), c))
    other = [("G1: not JSON", ~F.col("checked.is_json")), ("G2: not a valid record", F.col("checked.is_json") & ~valid), ("C4: escalation", checks.get("C4_escalation", F.lit(1.0)) == 0), ("C5: top cause", checks.get("C5_causes_top1", F.lit(1.0)) == 0), ("C6: nothing non-chemical", checks.get("C6_non_chemical", F.lit(1.0)) == 0), ("C1/C2/C3: no option offered", graded & missed)]
    return out.select(
        "item_id",
        values.present_map({k: v for k, v in gates.items()}).alias("gates"),
        values.present_map({k: v.cast("double") for k, v in checks.items()}).alias("checks"),
        "ambiguous",
        F.concat(F.when(full, restricted).otherwise(F.array().cast("array<string>")), F.when(graded, F.coalesce("option_failures", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")), values.violations(other)).alias("failures"),
        excluded.alias("excluded"),
        F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"),
        total.alias("total"),
        (passed & ~excluded).alias("passed"),
        F.when(valid, F.col("answerability")).alias("answerability"),
    )


def score_rows(items: DataFrame, responses: DataFrame, labels: Labels) -> DataFrame:
    """The score row of each item: a missing response is 0, an excluded one has no score."""
    from .joins import with_responses

    met = with_responses(items, responses.withColumnRenamed("raw_response", "output"))
    done = verify(met.where("not missing"), labels, "score")
    rows = met.select("item_id", "missing").join(done, "item_id", "left")
    none = F.create_map().cast("map<string,double>")
    return rows.select(
        "item_id",
        F.when(F.col("missing"), 0.0).when(~F.col("excluded"), F.col("total")).alias("score"),
        F.coalesce("excluded", F.lit(False)).alias("excluded"),
        F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"),
        "missing",
        F.coalesce(F.try_element_at("gates", F.lit("G1_json")), F.lit(False)).alias("g1_json"),
        F.coalesce(F.try_element_at("gates", F.lit("G2_schema")), F.lit(False)).alias("g2_schema"),
        F.coalesce("checks", none).alias("checks"),
        F.when(F.col("missing"), F.array(F.lit("missing: no response for this item"))).otherwise(F.col("failures")).alias("failures"),
    )


def verified_item(results: DataFrame, causes_hit: DataFrame | None = None) -> DataFrame:
    """Several verdicts of an item (one for each pest asked about) as one: passed if all are, excluded if any is, the least total.

    ``causes_hit`` lists items whose pest stands anywhere among the causes; their
    failed top cause is forgiven and the total weighed anew.
    """
    if causes_hit is not None:
        known = causes_hit.select("item_id").distinct().withColumn("_any", F.lit(True))
        results = results.join(known, "item_id", "left")
        fix = F.coalesce("_any", F.lit(False)) & F.try_element_at("checks", F.lit("C5_causes_top1")).eqNullSafe(F.lit(0.0))
        fixed = F.map_zip_with("checks", F.create_map(F.lit("C5_causes_top1"), F.lit(1.0)), lambda k, a, b: F.coalesce(b, a))
        results = results.withColumn("checks", F.when(fix, fixed).otherwise(F.col("checks")))
        new = values.weighted_mean(WEIGHTS, {k: F.try_element_at("checks", F.lit(k)) for k in WEIGHTS})
        gates_ok = ~F.exists(F.map_values("gates"), lambda g: g == F.lit(False))
        results = results.withColumns({"total": F.when(fix & gates_ok, new).otherwise(F.col("total")), "passed": F.when(fix, gates_ok & (new == 1.0)).otherwise(F.col("passed"))})
    return results.groupBy("item_id").agg(F.bool_and("passed").alias("passed"), F.bool_or("excluded").alias("excluded"), F.min("total").alias("score"), F.flatten(F.collect_list("failures")).alias("failures"))
