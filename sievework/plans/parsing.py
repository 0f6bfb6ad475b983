"""Queries of the cell parsers, the verifier and the guard on hand-made inputs; the SQL states the expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, domain, names
from ..functions.dose import with_parsed_dose
from ..functions.records import with_checked_record
from ..operators import generation, guard, retrieval, verification
from . import fixtures as X


def dose_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([r[:2] for r in X.DOSES], "cell string, unit_in string")
    out = with_parsed_dose(df, "cell", "d", unit_column="unit_in")
    return out.select("cell", F.coalesce("unit_in", F.lit("")).alias("unit_in"), "d_branch", "d_pattern", "d_basis", "d_value_min", "d_value_max", "d_unit", "d_code")


def phi_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(r[0],) for r in X.PERIODS], "cell string")
    return df.withColumn("p", cells.waiting_period(F.col("cell"))).select("cell", F.col("p.days").alias("days"), F.col("p.outcome").alias("outcome"))


def crop_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(r[0],) for r in X.CROP_CELLS], "cell string")
    return df.withColumn("c", names.mapped_crops(F.col("cell"))).select("cell", F.array_join("c.slugs", ";").alias("slugs"), "c.multi_crop", "c.pest_bled", "c.not_a_crop")


def pest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(r[0],) for r in X.PEST_CELLS], "cell string")
    return names.pest_mentions(df, "cell").select("cell", "ordinal", "mention")


def ingredient_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(r[0],) for r in X.INGREDIENTS], "name string")
    c = F.col("name")
    return df.select("name", F.array_join(cells.ingredient_set(c), ";").alias("parts"), cells.strain_key(c).alias("strain"), cells.formulation_key(c)["code"].alias("code"), cells.formulation_key(c)["strength"].alias("strength"), cells.formulation_unit(c).alias("unit"))


def method_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(r[0],) for r in X.METHOD_CELLS], "cell string")
    return df.select("cell", cells.application_method(F.col("cell")).alias("method"))


def verify_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.verify(X.answers(spark), X.labels(spark), "score").select("item_id", "total", "excluded")


def verify_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = verification.verify(X.answers(spark), X.labels(spark), "gate")
    return got.select("item_id", "passed", "excluded", F.array_join("ambiguous", ";").alias("ambiguous"))


def verify_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.verify(X.answers(spark), X.labels(spark), "filter").select("item_id", "passed")


def guard_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.guard(X.responses(spark), X.labels(spark)).select("item_id", F.array_join("actions", ";").alias("actions"), "guarded", "guardable", "changed")


def retrieve_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = X.labels(spark)
    keys = retrieval.resolved_keys(X.responses(spark), "item_id", "query_text", lab.synonyms, views=lab.views)
    sheets = retrieval.with_prompt(retrieval.fact_sheets(keys, "item_id", lab).join(X.responses(spark).select("item_id", "query_text"), "item_id"), "query_text")
    return sheets.select("item_id", "crop_slug", "canonical", "rows_available", "rows_included", F.coalesce("miss_reason", F.lit("")).alias("miss_reason"), "user_message")


def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = with_checked_record(X.answers(spark), "output")
    return got.select("item_id", "checked.is_json", "checked.is_valid", F.size("checked.errors").alias("n_errors"))


def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers of the label facts pass the gate themselves."""
    lab = X.labels(spark)
    rows = lab.pests.join(lab.rows.where("trainable and not defective and contradiction is null"), "label_idx").where("dose_formulation_branch = 'numeric'")
    gold = generation.gold_records(rows, X.practices(spark)).withColumn("item_id", F.concat_ws(":", "label_idx", "canonical"))
    cause = F.col("gold.likely_causes")[0]
    return gold.select("item_id", "gold.escalate_to_expert", generation.difficulty(F.col("gold")).alias("difficulty"), cause["type"].alias("type"), cause["evidence"].alias("evidence"), F.array_join("gold.non_chemical_first", ";").alias("measures"))


def generation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retry loop with the mock on the documents: what is broken at first is accepted in the second round."""
    items = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("S1_"), F.col("doc_id").cast("string")).alias("item_key"))
    answer = lambda df: df.withColumn("output", generation.mock_state(F.col("item_key"), F.col("attempt")))
    judge = lambda df: df.withColumns({"passed": F.col("output") == "good", "excluded": F.lit(False), "reasons": F.when(F.col("output") == "good", F.array().cast("array<string>")).otherwise(F.array(F.lit("broken")))})
    done = generation.retried(items, "item_key", answer, judge)
    return done.groupBy("attempts", "outcome").agg(F.count("*").alias("n"))


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = X.labels(spark)
    counts = lab.pests.withColumn("n_canonicals", F.count("*").over(Window.partitionBy("label_idx")))
    rows = counts.join(lab.rows, "label_idx").select("label_idx", "crop_slug", "canonical", "ai_set", "phi_days", "n_canonicals")
    return generation.spread_over_ingredients(generation.ordered_candidates(rows, 7), 2).select("crop_slug", "canonical", "label_idx", "rank")


QUERIES = {f.__name__: f for f in (dose_parse, phi_parse, crop_map, pest_split, ingredient_keys, method_extract, verify_score, verify_gate, verify_filter, guard_answers, retrieve_sheets, record_checks, gold_records, generation_rounds, candidate_order)}

#: What the label cells of the fixtures say: row, crop, ingredients, days to wait, none applies, defective, contradicted, product dose from and to; and the pests that they name.
_FACTS = [
    (1, "cotton", "imidacloprid", 40, False, False, False, 100.0, 125.0), (2, "cotton", "acephate", 15, False, False, False, 390.0, None), (3, "cotton", "clothianidin", 20, False, False, False, 30.0, 40.0),
    (4, "cotton", "clothianidin", 76, False, False, False, 200.0, 250.0), (5, "cotton", "imidacloprid", None, True, False, False, 5.0, 9.0), (6, "tomato", "chlorantraniliprole", 3, False, False, False, 150.0, None),
    (7, "tomato", "monocrotophos", None, False, False, False, 1500.0, None), (8, "tomato", "azadirachtin", None, False, False, False, 1000.0, None), (9, "grape", "mancozeb;metalaxyl", 66, False, False, False, 2500.0, None),
    (10, "grape", "azoxystrobin", 7, False, False, False, 500.0, None), (11, "grape", "azoxystrobin", 7, False, False, True, 400.0, None), (12, "gram", "carbendazim", None, True, True, False, 2.0, None),
]
_NAMED = {"Jassid": (1, 2, 3, 4, 5), "Aphid": (1,), "Helicoverpa armigera": (6, 7, 8), "Downy mildew": (9, 10, 11), "Powdery mildew": (10,), "Wilt": (12,)}
_facts = X.values_sql(_FACTS, ["label_idx", "crop_slug", "ai", "phi", "na", "defective", "contradicted", "low", "high"], ["BIGINT", "VARCHAR", "VARCHAR", "INTEGER", "BOOLEAN", "BOOLEAN", "BOOLEAN", "DOUBLE", "DOUBLE"])
_named = X.values_sql([(i, p) for p, rows in _NAMED.items() for i in rows], ["label_idx", "canonical"], ["BIGINT", "VARCHAR"])
_practices = X.values_sql([(c, p, ";".join(m), e) for c, p, m, e in X.PRACTICES], ["crop_slug", "canonical", "measures", "evidence"], ["VARCHAR"] * 4)
_diseases = ", ".join(f"'{n}'" for n in sorted({n for targets in domain.TARGETS.values() for n, kind, _ in targets if kind == "disease"}))

#: The rows of a fact sheet: row, product, basis, bounds, unit and wording of its dose, days, none applies, wording of the period, method.
_SHEET = [
    (1, "Imidacloprid 17.8% SL", "per_ha", 100.0, 125.0, "ml", "100-125 ml", 40, False, "40", None), (2, "Acephate 75% SP", "per_ha", 390.0, None, "g", "390 g", 15, False, "15", None),
    (3, "Clothianidin 50% WDG", "per_ha", 30.0, 40.0, "g", "30-40 g", 20, False, "20", None), (4, "Clothianidin 50% WDG", "per_ha", 200.0, 250.0, "g", "200-250 g", 76, False, "76", "soil_drench"),
    (5, "Imidacloprid 48% FS", "per_kg_seed", 5.0, 9.0, "ml", "5-9 ml/kg seed", None, True, "Seed dresser", None),
]
_sheet = X.values_sql([("cotton", "Jassid", *r) for r in _SHEET], ["crop_slug", "canonical", "label_idx", "name", "basis", "low", "high", "unit", "raw", "phi", "na", "phi_raw", "method"], ["VARCHAR", "VARCHAR", "BIGINT", "VARCHAR", "VARCHAR", "DOUBLE", "DOUBLE", "VARCHAR", "VARCHAR", "INTEGER", "BOOLEAN", "VARCHAR", "VARCHAR"])
_unresolved = "'" + retrieval.MISS_LINES["unresolved"].replace("'", "''") + "'"

_ambiguous = {"two_uses": "C1_dose;C2_phi"}
_gate_passes = ("good", "kilo", "refused", "drench", "seed")
_valid = [a for a in X.ANSWERS if a[0] not in ("not_json", "not_valid")]
SQL = {
    "dose_parse": X.values_sql([(r[0], r[1] or "", *r[2:]) for r in X.DOSES], ["cell", "unit_in", "d_branch", "d_pattern", "d_basis", "d_value_min", "d_value_max", "d_unit", "d_code"], ["VARCHAR"] * 5 + ["DOUBLE", "DOUBLE", "VARCHAR", "VARCHAR"]),
    "phi_parse": X.values_sql(X.PERIODS, ["cell", "days", "outcome"], ["VARCHAR", "INTEGER", "VARCHAR"]),
    "crop_map": X.values_sql([(r[0], ";".join(r[1]), *r[2:]) for r in X.CROP_CELLS], ["cell", "slugs", "multi_crop", "pest_bled", "not_a_crop"], ["VARCHAR", "VARCHAR", "BOOLEAN", "BOOLEAN", "BOOLEAN"]),
    "pest_split": X.values_sql([(c, i, m) for c, parts in X.PEST_CELLS for i, m in enumerate(parts)], ["cell", "ordinal", "mention"], ["VARCHAR", "INTEGER", "VARCHAR"]),
    "ingredient_keys": X.values_sql([(r[0], ";".join(r[1]), *r[2:]) for r in X.INGREDIENTS], ["name", "parts", "strain", "code", "strength", "unit"], ["VARCHAR"] * 4 + ["DOUBLE", "VARCHAR"]),
    "method_extract": X.values_sql(X.METHOD_CELLS, ["cell", "method"], ["VARCHAR", "VARCHAR"]),
    "verify_score": X.values_sql([(a[0], a[6], a[7]) for a in X.ANSWERS], ["item_id", "total", "excluded"], ["VARCHAR", "DOUBLE", "BOOLEAN"]),
    "verify_gate": X.values_sql([(a[0], a[0] in _gate_passes, a[7] or a[0] in _ambiguous, _ambiguous.get(a[0], "")) for a in X.ANSWERS], ["item_id", "passed", "excluded", "ambiguous"], ["VARCHAR", "BOOLEAN", "BOOLEAN", "VARCHAR"]),
    "verify_filter": X.values_sql([(a[0], a[0] in ("good", "kilo", "over_escalated", "wrong_cause", "refused", "drench", "seed")) for a in X.ANSWERS], ["item_id", "passed"], ["VARCHAR", "BOOLEAN"]),
    # What the guard writes is the response without the options it removes, escalated where it says so.
    "guard_answers": f"""WITH r AS ({X.values_sql([(r[0], r[2], ";".join(r[3])) for r in X.RESPONSES], ["item_id", "said", "actions"], ["VARCHAR"] * 3)}),
n AS (SELECT *, regexp_extract_all(actions, 'removed_[a-z]+:(\\d+)', 1) AS gone, CASE WHEN actions <> 'unparseable' THEN string_split(regexp_extract(said, '"chemical_options":\\[(.*)\\],"safety"', 1), '}},{{"active') END AS options FROM r),
k AS (SELECT *, list_filter(list_transform(range(len(options)), lambda i: CASE WHEN list_contains(gone, CAST(i AS VARCHAR)) THEN NULL ELSE (CASE WHEN i > 0 THEN '{{"active' ELSE '' END) || options[i + 1] || (CASE WHEN i + 1 < len(options) THEN '}}' ELSE '' END) END), lambda x: x IS NOT NULL) AS kept FROM n)
SELECT item_id, actions, CASE WHEN options IS NULL THEN said ELSE replace(replace(said, regexp_extract(said, '"chemical_options":(.*),"safety"', 1), '[' || array_to_string(kept, ',') || ']'),
CASE WHEN contains(actions, 'escalation') THEN '"escalate_to_expert":false' ELSE chr(0) END, '"escalate_to_expert":true') END AS guarded, options IS NOT NULL AS guardable, options IS NOT NULL AND actions <> '' AS changed FROM k""",
    "retrieve_sheets": f"""WITH f AS (SELECT *, list_transform([low, high, CASE WHEN basis = 'per_ha' THEN round(low / 2.4711, 4) END, CASE WHEN basis = 'per_ha' THEN round(high / 2.4711, 4) END],
  lambda x: CASE WHEN x IS NULL THEN 'null' WHEN x = round(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END) AS n FROM ({_sheet})),
s AS (SELECT crop_slug, canonical, count(*) AS rows, string_agg('{{"ai": "' || name || '", "dose_basis": "' || basis || '", "dose_min": ' || n[1] || ', "dose_max": ' || n[2] || ', "dose_unit": "' || unit || '", "dose_per_acre_min": ' || n[3] || ', "dose_per_acre_max": ' || n[4]
  || ', "dose_raw": "' || raw || '", "phi_days": ' || coalesce(CAST(phi AS VARCHAR), 'null') || ', "phi_not_applicable": ' || CAST(na AS VARCHAR) || ', "phi_raw": "' || phi_raw || '", "application_method": ' || coalesce('"' || method || '"', 'null') || ', "biological": false}}', ', ' ORDER BY label_idx) AS body FROM f GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN contains(query, 'cotton') THEN 'cotton' END AS crop_slug, CASE WHEN contains(query, 'jassids') THEN 'Jassid' END AS canonical FROM ({X.values_sql([r[:2] for r in X.RESPONSES], ["item_id", "query"], ["VARCHAR"] * 2)}))
SELECT item_id, q.crop_slug, q.canonical, coalesce(rows, 0) AS rows_available, CAST(coalesce(rows, 0) AS INTEGER) AS rows_included, CASE WHEN rows IS NULL THEN 'unresolved' ELSE '' END AS miss_reason,
'<query' || coalesce(' crop="' || q.crop_slug || '"', '') || '>' || chr(10) || query || chr(10) || '</query>' || chr(10) || chr(10) || '<fact_sheet>' || chr(10) || coalesce('[' || body || ']', {_unresolved}) || chr(10) || '</fact_sheet>' AS user_message
FROM q LEFT JOIN s ON s.crop_slug = q.crop_slug AND s.canonical = q.canonical""",
    "record_checks": X.values_sql([(a[0], a[0] != "not_json", a in _valid, 2 if a[0] == "not_valid" else 0) for a in X.ANSWERS], ["item_id", "is_json", "is_valid", "n_errors"], ["VARCHAR", "BOOLEAN", "BOOLEAN", "INTEGER"]),
    "gold_records": f"""WITH r AS (SELECT * FROM ({_facts}) JOIN ({_named}) USING (label_idx) WHERE NOT defective AND NOT contradicted),
u AS (SELECT *, bool_or(phi IS NULL AND NOT na) OVER (PARTITION BY crop_slug, canonical, ai) AS unknown FROM r)
SELECT label_idx || ':' || canonical AS item_id, unknown AS escalate_to_expert, CASE WHEN unknown AND phi IS NULL AND NOT na THEN 'edge_case' WHEN high IS NOT NULL AND high <> low THEN 'hard' ELSE 'standard' END AS difficulty,
CASE WHEN canonical IN ({_diseases}) THEN 'disease' ELSE 'pest' END AS type, coalesce(evidence, '') AS evidence, coalesce(measures, '') AS measures FROM u LEFT JOIN ({_practices}) USING (crop_slug, canonical)""",
    "candidate_order": f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY label_idx) AS named FROM ({_facts}) JOIN ({_named}) USING (label_idx)),
k AS (SELECT *, row_number() OVER (PARTITION BY crop_slug, canonical ORDER BY phi IS NULL, named > 1, sha256('7|' || label_idx), label_idx) AS rank FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY crop_slug, canonical, ai ORDER BY rank) AS n FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY crop_slug, canonical ORDER BY rank) AS q FROM o WHERE n = 1)
SELECT crop_slug, canonical, label_idx, CAST(rank AS INTEGER) AS rank FROM q WHERE q <= 2""",
    "generation_rounds": """
WITH d AS (SELECT sha256('S1_' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
b AS (SELECT list_reduce(list_prepend(0, list_transform(string_split(h, ''), lambda c: strpos('0123456789abcdef', c) - 1)), lambda a, x: (a * 16 + x) % 100) AS b FROM d)
SELECT CAST(CASE WHEN b < 5 THEN 3 WHEN b < 10 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN b < 5 THEN 'rejected_after_retries' ELSE 'accepted' END AS outcome, count(*) AS n FROM b GROUP BY 1, 2""",
}
