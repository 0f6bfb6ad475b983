"""Queries of scores, gates, audits, lookups and streams on rows made by rule from the tables; the SQL computes them anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import normalized
from ..operators import aggregates, audits, filters, joins, sets, windows
from ..operators.graph import shared_folder
from ..streaming import streams


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WEIGHTS = {"quality": 0.6, "toxic": 0.4}


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items and labels as responses: some are excluded, those without a label are missing and score 0."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    got = joins.with_responses(docs, _t(spark, sf_dir, "labels"), "doc_id")
    checks = F.map_filter(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.when(F.col("doc_id") % 3 > 0, 1.0 - F.col("toxic"))), lambda k, v: v.isNotNull())
    fold = V.weighted_mean(WEIGHTS, {k: F.try_element_at(checks, F.lit(k)) for k in WEIGHTS})
    return got.select(
        F.col("doc_id").alias("item_id"), "lang", "missing", (F.col("lang") == "es").alias("excluded"), checks.alias("checks"), F.when(F.col("missing"), 0.0).otherwise(fold).alias("score"),
        (F.col("n_chars") % 2 == 0).alias("g1_json"), (F.col("n_chars") % 6 == 0).alias("g2_schema"),
    )


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(spark, sf_dir).select("item_id", "missing", "excluded", F.round("score", 6).alias("score"))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(score_rows(spark, sf_dir))


def score_check_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.check_means(score_rows(spark, sf_dir))


def gates_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate is reached only if the one before was passed."""
    rows = score_rows(spark, sf_dir)
    gates = F.map_filter(F.create_map(F.lit("g1"), F.col("g1_json"), F.lit("g2"), F.when(F.col("g1_json"), F.col("g2_schema"))), lambda k, v: v.isNotNull())
    return aggregates.gate_rates(rows.withColumn("gates", gates), "gates", ["lang"])


def checks_in_both_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_rows(spark, sf_dir).where("not missing")
    other = rows.where("item_id % 2 = 0").withColumn("checks", F.transform_values("checks", lambda k, v: v / 2))
    got = aggregates.paired_check_means(rows, other, "item_id")
    return got.select("check", "n", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")])


def score_refolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audits.refolded(score_rows(spark, sf_dir).where("not missing"), "toxic", F.lit(1.0), WEIGHTS)
    return got.select("item_id", F.round("counterfactual", 6).alias("counterfactual"), F.round("change", 6).alias("change"))


def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audits.slice_balance(score_rows(spark, sf_dir).withColumn("slice", F.col("item_id") % 5))
    return got.select("slice", "n", F.round("mean", 6).alias("mean"))


def refusal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_rows(spark, sf_dir).withColumns({"state": F.when(F.col("lang") == "en", "ANSWERABLE").otherwise("OTHER"), "n_options": F.col("item_id") % 4})
    return audits.refusals(rows, "state", "n_options")


def rerun_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run that is the same, goes on from a cut-off, or differs, by the document's id."""
    i = F.col("doc_id") % 3
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.coalesce(F.substring("text", 1, 20), F.lit("")).alias("old"), i.alias("i"))
    new = F.when(F.col("i") == 0, F.col("old")).when(F.col("i") == 1, F.concat("old", F.lit("#"))).otherwise(F.concat(F.lit("#"), "old"))
    runs = docs.select("item_id", "old", new.alias("new"), (F.col("i") > 0).alias("hit_limit"), F.lit(0.5).alias("score_old"), (F.lit(0.5) + F.when(F.col("i") == 2, (F.col("item_id") % 5 - 2) / 8).otherwise(0.0)).alias("score_new"))
    got = audits.noise_floor(runs)
    return got.select("klass", "n", "n_differ", F.round("mean_abs", 6).alias("mean_abs"), F.round("mean_signed", 6).alias("mean_signed"))


def record_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = docs.where("doc_id % 10 <> 0").unionByName(docs.where("doc_id % 50 = 1")).unionByName(docs.where("doc_id = 0").select(F.lit(-1).cast("bigint").alias("doc_id"), "lang"))
    rows = rows.withColumn("recorded", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.md5("lang")))
    return audits.integrity(docs, rows, "doc_id", F.md5("lang"), "recorded")


def dose_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail price as what was said and a band around it as the label's point."""
    part = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("said"), (F.col("p_retailprice") * (1 + (F.col("p_size") % 5) * 0.03)).alias("low"))
    return part.select("p_partkey", *[c.alias(k) for k, c in audits.rounding_modes(F.col("said"), F.col("low")).items()])


def dose_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_size", F.col("p_partkey").alias("k"))
    rows = part.select((F.col("p_size") * 10.0).alias("said"), (F.col("p_size") * 10.0 + F.col("k") % 30).alias("top"), F.when(F.col("k") % 11 == 0, "ml").otherwise("g").alias("said_unit"), F.lit(200.0).alias("low"), F.when(F.col("k") % 2 == 0, 300.0).alias("high"), F.lit("g").alias("unit"), (F.col("k") % 20 / 10.0).alias("over"))
    kind = audits.dose_error(F.col("said"), F.col("top"), F.col("said_unit"), F.col("low"), F.col("high"), F.col("unit"), F.col("over"))
    return rows.groupBy(kind.alias("klass")).agg(F.count("*").alias("n"))


def registration_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as products of a crop, brands as pests: what is offered but not registered, by the class of the error."""
    part = _t(spark, sf_dir, "part")
    labels = part.select(F.col("p_partkey").alias("label_idx"), F.col("p_brand").alias("crop_slug"), F.array((F.col("p_size") % 7).cast("string")).alias("ai_set"), F.lower("p_name").alias("pest_or_disease"))
    pests = part.select(F.col("p_partkey").alias("label_idx"), F.substring_index(F.lower("p_name"), " ", 1).alias("canonical"))
    options = part.select(F.col("p_partkey").alias("item_id"), F.lit(0).alias("position"), F.col("p_brand").alias("crop_slug"), F.when(F.col("p_partkey") % 9 > 0, F.substring_index(F.lower("p_name"), " ", -1)).alias("canonical"), F.array((F.col("p_size") % 8).cast("string")).alias("ai_set"))
    return audits.registration_errors(options, labels, pests).groupBy("klass").agg(F.count("*").alias("n"))


def reviewed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), "l_partkey")
    reviewed = _t(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("klass"))
    return audits.touched_items(lines, reviewed, ["l_partkey"], "klass")


def value_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names by the number of letters of their first word."""
    got = audits.survey(_t(spark, sf_dir, "part"), "p_name", F.length(F.substring_index("p_name", " ", 1)))
    return got.select("pattern", "n_values", "n_rows", F.array_join("examples", ";").alias("examples"))


def unmapped_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return audits.unmapped(part, part.where("p_size > 3 and p_partkey % 2 = 0"), ["p_brand", "p_name"])


def transcribed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' names occur in the comments made of every other name."""
    names = _t(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_name")
    body = _t(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("see "), F.replace("c_name", F.lit("#"), F.lit(" # ")), F.lit(" there")).alias("body"))
    return audits.transcription_check(names, "c_name", body, "body")


def stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.stratified(_t(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderkey"], 4).select("o_orderpriority", "o_orderkey")


def target_and_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    targets = part.where("p_partkey % 100 = 7")
    return audits.control_sample(part, targets.where("p_partkey < 500"), ["p_brand"], "p_partkey", targets, 20, 9).select("p_partkey", "role")


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.confusion(_t(spark, sf_dir, "labels"), "quality", "toxic")


def stays_out_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return filters.without_pairs(part, part.where("p_partkey % 5 = 0").select("p_brand", "p_size")).select("p_partkey")


def mapped_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of names, worked out over the distinct names."""
    return filters.map_distinct(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "plain", lambda d: d.withColumn("plain", normalized("p_name")))


def lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    crop, gold = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).otherwise(F.lit("F"))
    pest = F.when(F.col("o_custkey") % 4 > 0, F.lit("x"))
    return o.groupBy(filters.resolution_status(crop, gold, pest, F.col("o_custkey") % 2).alias("status")).agg(F.count("*").alias("n"))


def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("bio_"), "source")).otherwise(F.col("source")).alias("source_file"), F.col("lang").alias("active_ingredient"))
    branch = lambda n: F.when(F.col("doc_id") % n == 0, "unparseable").when(F.col("doc_id") % n == 1, "free_text").otherwise("numeric")
    rows = d.withColumns({"dose_ai_branch": branch(5), "dose_formulation_branch": branch(7), "flag_pest_bled": F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 4 == 1), "crop_multi_crop_split": F.col("doc_id") % 9 == 0, "contradiction": F.when(F.col("doc_id") % 13 == 0, "G1")})
    return filters.usable(filters.label_flags(rows), "^fr$").select("doc_id", "biological")


def states_no_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("-", "N.A.", "not required", "", "7")]), (F.col("p_size") % 5 + 1).cast("int")).alias("raw"))
    outcome = F.when(F.col("raw") == "7", "resolved").otherwise("not_applicable")
    return part.select("p_partkey", filters.not_applicable(F.col("raw"), outcome).alias("said_so"))


def restrictions_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _t(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("component"), F.concat(F.lit(" C"), (F.col("p_size") % 6).cast("string")).alias("crop_slug"))
    listed = spark.createDataFrame([("brand#11", "banned", ["c1"]), ("brand#12", "restricted_use", []), ("brand#13", "restricted_use", ["c2", "c3"])], "name string, tier string, crops array<string>")
    return joins.applicable_restrictions(parts, listed).select("p_partkey", "tier")


def preferred_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return joins.preferred_hit(lines, ["l_orderkey"], F.col("l_returnflag") == "R", ["l_linenumber", "l_partkey", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_returnflag")


def every_row_has_a_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = joins.must_match(_t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"])
    return got.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def segment_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("n")).withColumn("segments", F.array("l_linestatus", "n", "l_returnflag", F.lit("?")))
    got = joins.segments_to_columns(rows, "segments", ["l_returnflag", "l_linestatus", "n"])
    return got.groupBy(F.array_join("segment_columns", ";", "-").alias("columns")).agg(F.count("*").alias("n"))


def rows_once_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    got = joins.content_union(lines, ["l_orderkey"], ["l_linenumber", "l_partkey"])
    return got.select("l_orderkey", "l_linenumber", "l_partkey")


def unsafe_option_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.unsafe_counts(_t(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_discount") > 0.08)


def parts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = [o.where(F.col("o_orderstatus") == s).withColumn("part", F.lit(s)) for s in "FOP"]
    return sets.merged_parts(parts, "o_orderkey", "part", {"F": 1, "O": 1}).groupBy("part").agg(F.count("*").alias("n"))


def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of documents laid out five a line, two points apart in height at most."""
    docs = _t(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page"), F.posexplode(F.slice(F.split(normalized("text"), " "), 1, 23)).alias("i", "text"))
    words = docs.select("page", (F.floor(F.col("i") / 5) * 10.0 + F.col("i") % 3).alias("top"), (F.col("i") % 5 * 50.0).alias("x0"), (F.col("i") % 5 * 50.0 + 40).alias("x1"), "text")
    return windows.lines_of_words(words, ["page"]).select("page", "line", "top", "x0", "x1", "text")


def rows_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as printed rows, and a logical row for every two of them."""
    lines = _t(spark, sf_dir, "lineitem").where("l_orderkey % 20 = 0").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("keys"))
    cell = lambda k: F.concat(F.lit("k"), k.cast("string"), F.lit("."))
    physical = lines.select("l_orderkey", F.posexplode("keys").alias("row", "k")).select("l_orderkey", "row", F.array(cell(F.col("k")), F.lit("")).alias("cells"))
    logical = lines.select("l_orderkey", F.explode(F.expr("sequence(0, cast(ceil(size(keys) / 2) as int) - 1)")).alias("row"), "keys").select("l_orderkey", "row", F.array_join(F.transform(F.slice("keys", 2 * F.col("row") + 1, 2), cell), " ").alias("text"))
    return windows.aligned_rows(physical, logical, ["l_orderkey"]).select("l_orderkey", "row", "logical_row", "matched", "n_parts")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of the events read as a stream, to its end."""
    return _drained(spark, sf_dir, lambda s: streams.windowed_counts(s, "ts", "1 day", "1 hour", ["event_type"])).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events no more than an hour apart."""
    return _drained(spark, sf_dir, lambda s: streams.sessions(s, "ts", "1 day", "1 hour", ["user_id"])).select(F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "user_id", "n")


def _drained(spark: SparkSession, sf_dir: str, made) -> DataFrame:
    """A stream over the events run to its end, its groups written to a folder."""
    import os

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = streams.table_stream(spark, path if not path.startswith("/") or os.path.isdir(path) else f"{path}*", schema)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = made(stream).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")


QUERIES = {
    f.__name__: f
    for f in (
        item_scores, score_summary, score_check_means, gates_reached, checks_in_both_arms, score_refolded, slice_means, refusal_counts, rerun_noise, record_integrity, dose_rounding, dose_error_classes, registration_classes,
        reviewed_items, value_survey, unmapped_forms, transcribed_names, stratified_rows, target_and_controls, label_confusion, stays_out_of_pairs, mapped_once, lookup_status, usable_rows, states_no_interval, restrictions_met,
        preferred_line, every_row_has_a_partner, segment_columns, rows_once_by_content, unsafe_option_counts, parts_merged, words_to_lines, rows_aligned, stream_windows, stream_sessions,
    )
}

_SCORES = """s AS (SELECT doc_id AS item_id, lang, n_chars, l.doc_id IS NULL AS missing, lang = 'es' AS excluded, CAST(quality AS DOUBLE) AS quality, CASE WHEN d.doc_id % 3 > 0 THEN 1.0 - toxic END AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, CASE WHEN missing THEN 0.0 ELSE (coalesce(0.6 * quality, 0) + coalesce(0.4 * toxic, 0)) / nullif((CASE WHEN quality IS NULL THEN 0 ELSE 0.6 END) + (CASE WHEN toxic IS NULL THEN 0 ELSE 0.4 END), 0) END AS score,
  n_chars % 2 = 0 AS g1_json, n_chars % 6 = 0 AS g2_schema FROM s)"""
_SCORES = _SCORES.replace("doc_id AS item_id", "d.doc_id AS item_id")
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_HASH = "sha256({seed} || '|' || CAST({key} AS VARCHAR))"
SQL = {
    "item_scores": f"WITH {_SCORES} SELECT item_id, missing, excluded, round(score, 6) AS score FROM r",
    "score_summary": f"""WITH {_SCORES} SELECT count(*) AS n_items, count(*) FILTER (NOT excluded) AS n_scored, count(*) FILTER (excluded) AS n_excluded, count(*) FILTER (missing) AS n_missing,
round(avg(score) FILTER (NOT excluded), 6) AS mean, round(100.0 * count(*) FILTER (g1_json) / count(*), 2) AS g1_json_pct, round(100.0 * count(*) FILTER (g2_schema) / count(*), 2) AS g2_schema_pct FROM r""",
    "score_check_means": f"""WITH {_SCORES}, c AS (SELECT 'quality' AS "check", quality AS v FROM r WHERE NOT excluded AND NOT missing UNION ALL SELECT 'toxic', toxic FROM r WHERE NOT excluded AND NOT missing)
SELECT "check", round(avg(v), 6) AS mean, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY 1""",
    "gates_reached": f"""WITH {_SCORES}, g AS (SELECT lang, 'g1' AS gate, g1_json AS p FROM r UNION ALL SELECT lang, 'g2', g2_schema FROM r WHERE g1_json)
SELECT lang, gate, count(*) AS reached, count(*) FILTER (p) AS passed FROM g WHERE p IS NOT NULL GROUP BY 1, 2""",
    "checks_in_both_arms": f"""WITH {_SCORES}, c AS (SELECT item_id, 'quality' AS "check", quality AS v FROM r WHERE NOT missing UNION ALL SELECT item_id, 'toxic', toxic FROM r WHERE NOT missing)
SELECT "check", count(*) AS n, round(avg(v), 6) AS mean_a, round(avg(v / 2), 6) AS mean_b, round(avg(v / 2) - avg(v), 6) AS delta FROM c WHERE v IS NOT NULL AND item_id % 2 = 0 GROUP BY 1""",
    "score_refolded": f"""WITH {_SCORES}, n AS (SELECT *, CASE WHEN score IS NOT NULL THEN (coalesce(0.6 * quality, 0) + CASE WHEN toxic IS NULL THEN 0 ELSE 0.4 END) / nullif((CASE WHEN quality IS NULL THEN 0 ELSE 0.6 END) + (CASE WHEN toxic IS NULL THEN 0 ELSE 0.4 END), 0) END AS c FROM r WHERE NOT missing)
SELECT item_id, round(c, 6) AS counterfactual, round(c - score, 6) AS change FROM n""",
    "slice_means": f"WITH {_SCORES} SELECT item_id % 5 AS slice, count(*) AS n, round(avg(score), 6) AS mean FROM r GROUP BY 1",
    "refusal_counts": f"WITH {_SCORES} SELECT count(*) AS n, count(*) FILTER (item_id % 4 = 0) AS n_refused FROM r WHERE lang = 'en' AND g2_schema",
    "rerun_noise": """WITH d AS (SELECT doc_id, doc_id % 3 AS i, left(coalesce(text, ''), 20) AS old, CASE WHEN doc_id % 3 = 2 THEN (doc_id % 5 - 2) / 8 ELSE 0.0 END AS d FROM documents),
k AS (SELECT *, CASE i WHEN 0 THEN 'IDENTICAL' WHEN 1 THEN 'PREFIX' ELSE CASE WHEN starts_with('#' || old, old) THEN 'PREFIX' ELSE 'DIFFERENT' END END AS klass FROM d)
SELECT klass, count(*) AS n, count(*) FILTER (d <> 0) AS n_differ, round(avg(abs(d)), 6) AS mean_abs, round(avg(d), 6) AS mean_signed FROM k GROUP BY 1""",
    "record_integrity": """SELECT count(*) FILTER (doc_id % 50 = 1) AS repeated, count(*) FILTER (doc_id % 10 = 0) AS missing, CAST(1 AS BIGINT) AS unknown,
count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 = 0) + count(*) FILTER (doc_id % 50 = 1 AND doc_id % 7 = 0) AS wrong_digest FROM documents""",
    "dose_rounding": "WITH p AS (SELECT p_partkey, p_retailprice AS said, p_retailprice * (1 + (p_size % 5) * 0.03::DOUBLE) AS low FROM part) SELECT p_partkey, abs(said - low) / low <= 0.05::DOUBLE AS tolerant, said = low AS exact, abs(said - low) / low <= 0.08::DOUBLE AS banded FROM p",
    "dose_error_classes": """WITH p AS (SELECT p_size * 10.0::DOUBLE AS said, p_size * 10.0::DOUBLE + p_partkey % 30 AS top, p_partkey % 11 = 0 AS ml, 200.0::DOUBLE AS low, CASE WHEN p_partkey % 2 = 0 THEN 300.0::DOUBLE END AS high, (p_partkey % 20) / 10.0::DOUBLE AS over FROM part),
r AS (SELECT *, said / (CASE WHEN high IS NULL THEN low WHEN said > high THEN high ELSE low END) AS ratio FROM p)
SELECT CASE WHEN ml THEN 'UNIT_DIMENSION_MISMATCH' WHEN abs(over - 1) <= 0.08::DOUBLE THEN 'PER_HA_NUMBER_LABELLED_PER_ACRE' WHEN top > coalesce(high, low) * 1.08::DOUBLE THEN 'WRONG_HIGH_RANGE_TOP' WHEN high IS NOT NULL AND said BETWEEN low AND high THEN 'LOW_END_OK_TOP_OVER'
WHEN abs(ratio - 1) <= 0.08::DOUBLE THEN 'WITHIN_8PC_ROUNDING_EDGE' WHEN ratio > 1 THEN 'WRONG_HIGH' ELSE 'WRONG_LOW' END AS klass, count(*) AS n FROM r GROUP BY 1""",
    "registration_classes": """WITH l AS (SELECT DISTINCT p_brand AS crop, p_size % 7 AS ai, lower(p_name) AS printed, string_split(lower(p_name), ' ')[1] AS canonical FROM part),
o AS (SELECT p_partkey, p_brand AS crop, p_size % 8 AS ai, CASE WHEN p_partkey % 9 > 0 THEN string_split(lower(p_name), ' ')[-1] END AS canonical FROM part),
w AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.crop = o.crop AND l.ai = o.ai AND l.canonical = o.canonical))
SELECT CASE WHEN canonical IS NULL THEN 'iv_PEST_UNRESOLVED' WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.crop = w.crop AND l.ai = w.ai) THEN 'iii_INVENTION'
WHEN EXISTS (SELECT 1 FROM l WHERE l.crop = w.crop AND l.ai = w.ai AND contains(l.printed, w.canonical)) THEN 'i_SYNONYM_FALSE_NEGATIVE' ELSE 'ii_MIS_ASSOCIATION' END AS klass, count(*) AS n FROM w GROUP BY 1""",
    "reviewed_items": "SELECT p_size AS klass, count(DISTINCT l_orderkey) AS n_items FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5 GROUP BY 1",
    "value_survey": """WITH v AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), p AS (SELECT *, length(string_split(p_name, ' ')[1]) AS pattern FROM v)
SELECT CAST(pattern AS INTEGER) AS pattern, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_rows, array_to_string(list_slice(list_sort(list(p_name)), 1, 5), ';') AS examples FROM p GROUP BY 1""",
    "unmapped_forms": "SELECT DISTINCT p_brand, p_name FROM part EXCEPT SELECT p_brand, p_name FROM part WHERE p_size > 3 AND p_partkey % 2 = 0",
    "transcribed_names": "SELECT c_name, c_custkey % 20 = 0 AS found FROM customer WHERE c_custkey % 10 = 0",
    "stratified_rows": """WITH t AS (SELECT o_orderpriority, o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS t FROM orders)
SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM t GROUP BY o_orderpriority, t""",
    "target_and_controls": f"""WITH k AS (SELECT p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 100 = 7 AND p_partkey < 500) ORDER BY {_HASH.format(seed="'9'", key='p_partkey')}, p_partkey LIMIT 20)
SELECT p_partkey, 'target' AS role FROM part WHERE p_partkey % 100 = 7 UNION ALL SELECT p_partkey, 'control' FROM k""",
    "label_confusion": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2",
    "stays_out_of_pairs": "SELECT p_partkey FROM part WHERE (p_brand, p_size) NOT IN (SELECT (p_brand, p_size) FROM part WHERE p_partkey % 5 = 0)",
    "mapped_once": f"SELECT p_partkey, p_name, {_NORM.format('p_name')} AS plain FROM part",
    "lookup_status": """SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'no_crop' WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'crop_mismatch' WHEN o_custkey % 4 = 0 THEN 'no_pest' WHEN o_custkey % 2 > 0 THEN 'with_rows' ELSE 'without_rows' END AS status, count(*) AS n
FROM orders GROUP BY 1""",
    "usable_rows": """SELECT doc_id, doc_id % 2 = 0 AS biological FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 4 <> 1 AND doc_id % 9 <> 0 AND doc_id % 13 <> 0 AND lang IS DISTINCT FROM 'fr'""",
    "states_no_interval": "SELECT p_partkey, p_size % 5 = 2 AS said_so FROM part",
    "restrictions_met": """SELECT p_partkey, 'banned' AS tier FROM part WHERE p_brand = 'Brand#11' UNION ALL SELECT p_partkey, 'restricted_use' FROM part WHERE p_brand = 'Brand#12'
UNION ALL SELECT p_partkey, 'restricted_use' FROM part WHERE p_brand = 'Brand#13' AND p_size % 6 IN (2, 3)""",
    "preferred_line": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber, l_partkey, l_quantity) = 1",
    "every_row_has_a_partner": "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "segment_columns": """SELECT CASE WHEN l_linestatus = l_returnflag THEN 'l_returnflag;n;-;-' ELSE 'l_linestatus;n;l_returnflag;-' END AS "columns", count(*) AS n FROM lineitem GROUP BY 1""",
    "rows_once_by_content": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey) = 1",
    "unsafe_option_counts": "SELECT count(*) AS options, count(DISTINCT l_orderkey) AS items FROM lineitem WHERE l_discount > 0.08::DOUBLE",
    "parts_merged": "SELECT o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 1",
    "words_to_lines": f"""WITH w AS (SELECT doc_id AS page, list_slice(string_split({_NORM.format('text')}, ' '), 1, 23) AS ws FROM documents WHERE text IS NOT NULL),
e AS (SELECT page, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w)
SELECT page, CAST(i // 5 AS INTEGER) AS line, min(i // 5 * 10.0::DOUBLE + i % 3) AS top, min(i % 5 * 50.0::DOUBLE) AS x0, max(i % 5 * 50.0::DOUBLE + 40) AS x1, string_agg(word, ' ' ORDER BY i) AS text FROM e GROUP BY page, i // 5""",
    "rows_aligned": """WITH k AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 20 = 0), n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS r FROM k)
SELECT l_orderkey, CAST(r AS INTEGER) AS row, CAST(r // 2 AS INTEGER) AS logical_row, CAST(1 AS INTEGER) AS matched, CAST(1 AS INTEGER) AS n_parts FROM n""",
    "stream_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS start, CAST(epoch(date_trunc('second', max(ts) + INTERVAL 1 HOUR)) AS BIGINT) AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, s""",
}
