"""Small hand-made frames for operators whose inputs the driver's tables don't hold."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, names
from ..functions.dose import with_parsed_dose
from ..operators.filters import not_applicable, with_per_acre
from ..operators.verification import Labels, prepared_labels

#: Cells as printed, each with what it is read as. Doses: (cell, default unit) -> (branch, pattern, basis, min, max, unit, code).
DOSES = [
    ("500", "g", "numeric", "BARE_NUMBER", "per_ha", 500.0, None, "g", ""),
    ("500", None, "unparseable", "BARE_NUMBER", "", None, None, "", "NEEDS_UNIT"),
    ("500-750", "g", "numeric", "BARE_RANGE", "per_ha", 500.0, 750.0, "g", ""),
    ("500 –1000", "g", "numeric", "BARE_RANGE", "per_ha", 500.0, 1000.0, "g", ""),
    ("750-500", "g", "unparseable", "BARE_RANGE", "", None, None, "", "REVERSED_RANGE"),
    ("0.1%", None, "numeric", "PCT_SINGLE", "concentration_pct", 0.1, None, "%", ""),
    ("0.28 % w/w", None, "numeric", "PCT_SINGLE", "concentration_pct", 0.28, None, "%", ""),
    ("0.10% or 100 gram in 100 lit water", None, "numeric", "PCT_WITH_EQUIV", "concentration_pct", 0.1, None, "%", ""),
    ("75 (0.0075%)", None, "numeric", "PCT_EQUIV_FIRST", "concentration_pct", 0.0075, None, "%", ""),
    ("2000gor  0.4%", None, "numeric", "PCT_EQUIV_FIRST", "concentration_pct", 0.4, None, "%", ""),
    ("0.025% -0.05%", None, "numeric", "PCT_RANGE_BOTH", "concentration_pct", 0.025, 0.05, "%", ""),
    ("0.005% 0.05%", None, "unparseable", "PCT_RANGE_BOTH", "", None, None, "", "AMBIGUOUS_PAIR"),
    ("1.8 g a.i/vine or 0.09%", None, "free_text", "PCT_WITH_FOREIGN_BASIS", "free_text", None, None, "", ""),
    ("2.5 ml per lit of water", None, "numeric", "PER_LITRE", "per_litre_water", 2.5, None, "ml", ""),
    ("10gm/lit res of  water", None, "numeric", "PER_LITRE", "per_litre_water", 10.0, None, "g", ""),
    ("25 ml/100 lit", None, "numeric", "PER_N_LITRE", "per_litre_water", 0.25, None, "ml", ""),
    ("70-87.5/100 l of  water", "g", "numeric", "PER_N_LITRE", "per_litre_water", 0.7, 0.875, "g", ""),
    ("38.75 g/10 kg seed", None, "numeric", "PER_N_KG_SEED", "per_kg_seed", 3.875, None, "g", ""),
    ("2-2.5 gm/  kg seed", None, "numeric", "PER_KG_SEED", "per_kg_seed", 2.0, 2.5, "g", ""),
    ("10 lit/tree", None, "numeric", "PER_TREE", "per_tree", 10.0, None, "l", ""),
    ("1.2 L/ Plant", None, "numeric", "PER_PLANT", "per_plant", 1.2, None, "l", ""),
    ("250  ml/sq.mtr", None, "numeric", "PER_SQ_M", "per_sq_m", 250.0, None, "ml", ""),
    ("2.5 kg/ha", None, "numeric", "PER_HA_EXPLICIT", "per_ha", 2.5, None, "kg", ""),
    ("30 + 15", None, "free_text", "COMPOUND", "free_text", None, None, "", ""),
    ("124.5+1000", None, "free_text", "COMPOUND", "free_text", None, None, "", ""),
    ("750  (Soil drench)", "g", "numeric", "NUM_WITH_METHOD", "per_ha", 750.0, None, "g", ""),
    ("500  20 ltr/ha (via  drone  application)", None, "free_text", "NUM_WITH_SECOND_QUANTITY", "free_text", None, None, "", ""),
    ("0.50 gm/tree (Root  feeding)", None, "numeric", "NUM_WITH_METHOD", "per_tree", 0.5, None, "g", ""),
    ("500  500  500", "g", "numeric", "BARE_NUMBER", "per_ha", 500.0, None, "g", ""),
    ("30-37.5    0.03-  0.0375%", None, "unparseable", "COLUMN_COLLAPSE", "", None, None, "", "COLUMN_COLLAPSE"),
    ("48 hrs.", None, "unparseable", "DEFECT_TIME_VALUE", "", None, None, "", "TIME_VALUE"),
    ("Kresoxim-methyl-  150 &  Chlorothalonil- 560", None, "unparseable", "DEFECT_AI_NAME", "", None, None, "", "AI_NAME"),
    ("594 +59.4 –", None, "unparseable", "DEFECT_TRUNCATED", "", None, None, "", "TRUNCATED"),
    ("37:3", None, "unparseable", "DEFECT_RATIO_OR_INEQUALITY", "", None, None, "", "RATIO_OR_INEQUALITY"),
    (">140", None, "unparseable", "DEFECT_RATIO_OR_INEQUALITY", "", None, None, "", "RATIO_OR_INEQUALITY"),
    ("Seed treatment: mix 10 g with the seed", None, "free_text", "PROSE_METHOD", "free_text", None, None, "", ""),
    ("5 ppm", None, "free_text", "UNSUPPORTED_UNIT", "free_text", None, None, "", ""),
    ("As required", None, "free_text", "PROSE_NO_NUMBER", "free_text", None, None, "", ""),
    ("-", None, "empty", "NULL_MARKER", "", None, None, "", ""),
    ("", None, "empty", "EMPTY", "", None, None, "", ""),
]
PERIODS = [
    ("0", 0, "resolved"), ("-", None, "not_applicable"), ("20-30", 30, "resolved"), ("20+7", 20, "resolved"), ("2 weeks", 14, "resolved"), ("12 hrs", 1, "resolved"), ("48 hrs", 2, "resolved"),
    ("3½-4months", 120, "resolved"), ("0 7", None, "raised"), ("IS:6313-2001 (Part-2)", None, "raised"), ("Seed dresser", None, "not_applicable"), ("N.A.", None, "not_applicable"),
    ("1 year", None, "raised"), ("2 days or 1 week", None, "raised"), ("Dilution in water- 500 liter/ha", None, "raised"), ("", None, "not_applicable"), ("15\ndays", 15, "resolved"),
]
CROP_CELLS = [
    ("Wheat, Gram", ["gram"], True, False, False), ("Pigeon pea or Red gram (Arhar/Tur)", ["tur"], False, False, False), ("Brinjal", [], False, False, False), ("Blackgram", [], False, False, False),
    ("T omato", ["tomato"], False, False, False), ("Cotton and Tomato", ["cotton", "tomato"], True, False, False), ("Bengal  Gram  (Gram or  Chickpea)", ["gram"], False, False, False),
    ("Pigeon Pea Helicoverpa armiger", ["tur"], False, True, False), ("Pulses  (Cowpea,  Mung bean,  Urdbean)", [], False, False, False), ("Rice (Paddy)  &cotton", ["cotton"], True, False, False),
    ("For rodent control in field, storage and crops like rice, soybean and coconut)", [], False, False, True), ("Soyabean", ["soybean"], False, False, False), ("", [], False, False, False),
]
PEST_CELLS = [
    ("Early & Late blight", ["Early blight", "Late blight"]), ("Damping off (Pythium aphanidermatum, Rhizoctonia solani)", ["Damping off (Pythium aphanidermatum, Rhizoctonia solani)"]),
    ("Rice weevil, Lesser grain Borer, Khapra Beetle", ["Rice weevil", "Lesser grain Borer", "Khapra Beetle"]), ("WhitefliesandRedspidermites", ["whiteflies", "red spider mites"]),
    ("Purple  Blotch and  Stemphyliu m", ["Purple Blotch", "stemphylium"]), ("Leaf miner (Liriomyza trifolii) Thrips spp. & Jassids", ["Leaf miner (Liriomyza trifolii)", "Thrips spp", "Jassids"]), ("", []),
]
INGREDIENTS = [
    ("Imidacloprid 17.8% SL", ["imidacloprid"], "", "SL", 17.8, "ml"), ("Chlorantraniliprole 18.50% SC", ["chlorantraniliprole"], "", "SC", 18.5, "ml"),
    ("Azoxystrobin 8.3% + Mancozeb 66.7% WG", ["azoxystrobin", "mancozeb"], "", "WG", 8.3, "g"), ("2,4-D", [], "", None, None, None), ("Chlorfenapyr 240 g/LSC", ["chlorfenapyr"], "", None, None, "ml"),
    ("NPV of Helicoverpa 2.0% AS Strain No. GBS/HNPV-01", ["npv of helicoverpa"], "GBSHNPV01", "AS", 2.0, "ml"), ("Deltamethrin 25%Tablet", ["deltamethrin"], "", None, 25.0, "g"), ("Dazomet", ["dazomet"], "", None, None, None),
]
METHOD_CELLS = [("Cotton (Soil  drench)", "soil_drench"), ("Soybean  (Seed  Treatment)", "seed_treatment"), ("Tomato  Foliar  application", "foliar"), ("Tomato  seedlings", "nursery"), ("Cotton", None)]

#: Label facts: file, row, crop cell, ingredient, pest cell, dose of ingredient, dose of product, period, unit of the product's column.
_LABELS = [
    ("insecticides.pdf", 1, "Cotton", "Imidacloprid 17.8% SL", "Jassids, Aphids", "20-25", "100-125 ml", "40"),
    ("insecticides.pdf", 2, "Cotton", "Acephate 75% SP", "Jassids", "292", "390 g", "15"),
    ("insecticides.pdf", 3, "Cotton", "Clothianidin 50% WDG", "Jassids", "15-20", "30-40 g", "20"),
    ("insecticides.pdf", 4, "Cotton (Soil drench)", "Clothianidin 50% WDG", "Jassids", "100-125", "200-250 g", "76"),
    ("insecticides.pdf", 5, "Cotton", "Imidacloprid 48% FS", "Jassids", "300-540", "5-9 ml/kg seed", "Seed dresser"),
    ("insecticides.pdf", 6, "Tomato", "Chlorantraniliprole 18.50% SC", "Fruit borer", "30", "150 ml", "3"),
    ("insecticides.pdf", 7, "Tomato", "Monocrotophos 36% SL", "Fruit borer", "500", "1500 ml", "-"),
    ("bio_insecticides.pdf", 8, "Tomato", "Azadirachtin 1% EC", "Fruit borer", "10", "1000 ml", "-"),
    ("fungicides.pdf", 9, "Grapes", "Metalaxyl 8% + Mancozeb 64% WP", "Downy mildew", "200+1600", "2500 g", "66"),
    ("fungicides.pdf", 10, "Grapes", "Azoxystrobin 23% SC", "Downy & Powdery mildew", "125", "500 ml", "7"),
    ("fungicides.pdf", 11, "Grapes", "Azoxystrobin 23% SC", "Downy mildew", "125", "400 ml", "7"),
    ("fungicides.pdf", 12, "Gram Wilt, Wheat", "Carbendazim 50% WP", "Wilt", "1", "2 g/kg seed", "NR"),
]
_SYNONYMS = [
    ("cotton", "Jassids", "Jassid", "pest"), ("cotton", "Jassid", "Jassid", "pest"), ("cotton", "Aphids", "Aphid", "pest"), ("cotton", "Jassids", "Leafhopper", "pest"), ("tomato", "Fruit borer", "Helicoverpa armigera", "pest"),
    ("pomegranate", "Fruit borer", "Deudorix isocrates", "pest"), ("grape", "Downy mildew", "Downy mildew", "disease"), ("grape", "Powdery mildew", "Powdery mildew", "disease"), ("gram", "Wilt", "Wilt", "disease"),
    ("cotton", "sucking insects", "UNMATCHABLE", "pest"), ("onion", "Purple blotch", "Purple blotch", "disease"),
]
_RESTRICTED = [("Monocrotophos", "restricted_use", "tomato;grape", "notification", "2018-08-08", ""), ("Carbofuran", "banned", "", "order", "2020-01-01", ""), ("Acephate", "restricted_use", "onion", "order", "2023-01-01", "")]
_CONTRADICTIONS = [("G1", "fungicides.pdf", "1", "11", "grape", "Azoxystrobin 23% SC", "two doses for one use")]


def label_rows(spark: SparkSession) -> DataFrame:
    """Raw cells to label facts: doses and periods read, crops mapped, per-acre bounds derived."""
    raw = spark.createDataFrame([(f, "1", str(n), n, *rest) for f, n, *rest in _LABELS], "source_file string, source_page string, source_row_index string, label_idx bigint, crop_raw string, active_ingredient string, pest_or_disease string, dose_ai string, dose_formulation string, waiting_period_phi string")
    parsed = with_parsed_dose(with_parsed_dose(raw, "dose_ai", "dose_ai", default_unit="g"), "dose_formulation", "dose_formulation")
    phi = parsed.withColumn("_phi", cells.waiting_period(F.col("waiting_period_phi")))
    facts = phi.withColumns({"phi_days": F.col("_phi.days"), "phi_outcome": F.col("_phi.outcome"), "phi_raw": F.col("waiting_period_phi"), "phi_not_applicable": not_applicable(F.col("waiting_period_phi"), F.col("_phi.outcome")), "application_method": F.coalesce(cells.application_method(F.col("crop_raw")), F.lit(""))}).drop("_phi", "dose_ai", "dose_formulation", "waiting_period_phi")
    mapped = names.crop_rows(facts, "crop_raw").where("crop_slug is not null").withColumnsRenamed({"multi_crop": "crop_multi_crop_split", "pest_bled": "flag_pest_bled"}).drop("not_a_crop")
    return with_per_acre(mapped)


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(_SYNONYMS)], "ordinal bigint, crop_slug string, surface_form string, canonical_name string, pest_type string")


def restrictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RESTRICTED, "active_ingredient string, tier string, restricted_crops string, instrument string, date string, notes string")


def contradictions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CONTRADICTIONS, "group_id string, source_file string, source_page string, source_row_index string, crop_slug string, active_ingredient string, reason string")


#: What is done without chemicals, and what the damage looks like: crop, pest, measures, evidence.
PRACTICES = [("cotton", "Jassid", ["yellow traps", "resistant seed"], "leaf edges curl"), ("grape", "Downy mildew", ["prune"], "white growth under the leaves")]


def practices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRACTICES, "crop_slug string, canonical string, non_chemical array<string>, evidence string")


def labels(spark: SparkSession) -> Labels:
    return prepared_labels(label_rows(spark), synonyms(spark), restrictions(spark), contradictions(spark))


def option(name: str, low, unit: str, basis: str, phi, high=None, formulation: str | None = None, na: bool = False) -> dict:
    return {"active_ingredient": name, "formulation": formulation or name, "dose": {"basis": basis, "value_min": low, "value_max": high, "unit": unit, "raw": "x"}, "phi_days": phi, "phi_not_applicable": na, "caution": "wear gloves"}


def record(options=(), in_scope=True, understood=True, escalate=False, causes=(), non_chemical=()) -> str:
    causes = [{"name": n, "type": "pest", "confidence": c, "evidence": "seen"} for n, c in causes]
    return json.dumps({"in_scope": in_scope, "query_understood": understood, "likely_causes": causes, "non_chemical_first": list(non_chemical), "chemical_options": list(options), "safety": ["wear gloves"], "escalate_to_expert": escalate}, separators=(",", ":"))


_ACEPHATE = option("Acephate 75% SP", 390.0, "g", "per_ha", 15)
_JASSID = (("Jassids", 0.9),)
#: (item, crop, pest, method, gold escalation, output, total in score mode, excluded).
ANSWERS = [
    ("good", "cotton", "Jassids", None, None, record([_ACEPHATE], causes=_JASSID), 1.0, False),
    ("kilo", "cotton", "Jassids", None, None, record([option("Acephate 75% SP", 0.39, "kg", "per_ha", 15)], causes=_JASSID), 1.0, False),
    ("high_dose", "cotton", "Jassids", None, None, record([option("Acephate 75% SP", 500.0, "g", "per_ha", 15)], causes=_JASSID), round(1 - 0.30 / 0.90, 6), False),
    ("wrong_phi", "cotton", "Jassids", None, None, record([option("Acephate 75% SP", 390.0, "g", "per_ha", 7)], causes=_JASSID), round(1 - 0.25 / 0.90, 6), False),
    ("over_escalated", "cotton", "Jassids", None, None, record([_ACEPHATE], escalate=True, causes=_JASSID), round(1 - 0.15 / 0.90, 6), False),
    ("wrong_cause", "cotton", "Jassids", None, None, record([_ACEPHATE], causes=(("Aphids", 0.9), ("Jassids", 0.5))), round(1 - 0.10 / 0.90, 6), False),
    ("invented", "cotton", "Jassids", None, None, record([option("Fakeicide 9% SL", 1.0, "ml", "per_ha", 1)], causes=_JASSID), 0.0, False),
    ("restricted", "tomato", "Fruit borer", None, None, record([option("Monocrotophos 36% SL", 1500.0, "ml", "per_ha", None)], escalate=True), 0.0, False),
    ("not_json", "cotton", "Jassids", None, None, "{oops", 0.0, False),
    ("not_valid", "cotton", "Jassids", None, None, '{"in_scope": true}', 0.0, False),
    ("fragment", "cotton", "sucking insects", None, None, record(), 1.0, True),
    ("contradicted", "grape", "Downy mildew", None, None, record([option("Azoxystrobin 23% SC", 500.0, "ml", "per_ha", 7)]), 1.0, True),
    ("refused", "cotton", "Jassids", None, None, record(causes=_JASSID), round(0.25 / 0.90, 6), False),
    ("drench", "cotton", "Jassids", "soil_drench", None, record([option("Clothianidin 50% WDG", 225.0, "g", "per_ha", 76)], causes=_JASSID), 1.0, False),
    ("two_uses", "cotton", "Jassids", None, None, record([option("Clothianidin 50% WDG", 225.0, "g", "per_ha", 76)], causes=_JASSID), 1.0, False),
    ("seed", "cotton", "Jassids", None, None, record([option("Imidacloprid 48% FS", 7.0, "ml", "per_kg_seed", None, na=True)], causes=_JASSID), 1.0, False),
    ("wrong_basis", "cotton", "Jassids", None, None, record([option("Acephate 75% SP", 390.0, "g", "per_tree", 15)], causes=_JASSID), 0.0, False),
]
RESPONSES = [
    ("kept", "jassids on cotton", record([_ACEPHATE]), []),
    ("dose_removed", "jassids on cotton", record([option("Acephate 75% SP", 900.0, "g", "per_ha", 15)]), ["removed_dose:0:HIGH", "all_removed_escalation"]),
    ("unregistered", "jassids on cotton", record([_ACEPHATE, option("Fakeicide 9% SL", 1.0, "ml", "per_ha", 1)]), ["removed_unregistered:1"]),
    ("no_crop", "insects everywhere", record([_ACEPHATE]), ["unvalidated_escalation"]),
    ("unknown_period", "jassids on cotton", record([option("Acephate 75% SP", 390.0, "g", "per_ha", None)]), ["forced_escalation"]),
    ("broken", "jassids on cotton", "{oops", ["unparseable"]),
]


def answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([a[:6] for a in ANSWERS], "item_id string, crop_slug string, pest_query string, application_method string, gold_escalate boolean, output string")


def responses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:3] for r in RESPONSES], "item_id string, query_text string, raw_response string")


def values_sql(rows: list[tuple], columns: list[str], types: list[str]) -> str:
    """The expected rows as SQL."""

    def one(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, list):
            return f"CAST([{', '.join(one(x, 'VARCHAR') for x in v)}] AS {t})"
        return "CAST(" + ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)) + f" AS {t})"

    body = ",\n".join("(" + ", ".join(one(v, t) for v, t in zip(r, types, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(columns)})"
