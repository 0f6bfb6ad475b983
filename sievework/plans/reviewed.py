"""Queries of second passes, flags, replays, snapshots and constructed items; the SQL computes them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain, names
from ..operators import aggregates, audits, reviews, sets
from ..sources import tables


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers as dose cells, half of them without a unit, and products of four kinds."""
    cell = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") + 1).cast("string")).otherwise(F.concat((F.col("p_size") + 1).cast("string"), F.lit(" kg/ha")))
    product = F.element_at(F.array(*[F.lit(x) for x in ("Some 5% EC", "Some 75% WP", "Some", "Some 10 g/L")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", cell.alias("cell"), product.alias("ingredient"))


def units_refilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = reviews.refilled_doses(_cells(spark, sf_dir), "p_partkey", "cell", "ingredient")
    return kept.select("p_partkey", "unit_given", "dose_branch", "dose_value_min", "dose_unit", "dose_code")


def refill_moves_nothing_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, moved = reviews.refilled_doses(_cells(spark, sf_dir), "p_partkey", "cell", "ingredient")
    return kept.agg(F.count("*").alias("n"), F.count("unit_given").alias("n_given")).crossJoin(moved.agg(F.count("*").alias("n_moved")))  # one row each


def question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of a crop's word, a pest and a chemical."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(x) for x in values]), (by % len(values) + 1).cast("int"))
    k = F.col("p_partkey")
    text = F.concat(F.lit("My "), pick(("cotton", "kapas", "onion", "field"), k), F.lit(" has "), pick(("thrips", "wilt", "nothing"), F.col("p_size")), F.lit(", is "), pick(("endosulfan", "neem oil"), F.floor(k / 4)), F.lit(" good?"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", pick(("cotton", "onion"), F.floor(k / 2)).alias("crop_slug"), F.when(k % 17 > 0, text).alias("question"))
    banned = spark.createDataFrame([("Endosulfan",), ("Methyl parathion",)], "term string")
    known = spark.createDataFrame([("cotton", "Thrips"), ("onion", "Thrips"), ("cotton", "Wilt")], "crop_slug string, target string")
    got = reviews.quality_flags(rows, "p_partkey", "question", "crop_slug", names.single_crop(F.col("question")), banned, "term", known)
    return got.select("p_partkey", "crop_mismatch", "banned_mention", "local_terms", "matchable")


def contradicting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.contradictions(_t(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


def contradictions_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").where("l_partkey < 100")
    found = reviews.contradictions(lines, ["l_partkey"], ["l_returnflag"])
    listed = _t(spark, sf_dir, "part").where("p_partkey % 3 = 0 and p_partkey < 120").select(F.col("p_partkey").alias("l_partkey"))
    return reviews.cross_checked(found, listed, ["l_partkey"])


def _options(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as options of an order, parts as the facts on what may be used."""
    options = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("position")).agg(F.min("l_partkey").alias("use"), F.min("l_quantity").alias("dose"), F.max("l_suppkey").alias("option_phi"))
    part = _t(spark, sf_dir, "part").where("p_partkey % 5 > 0")
    facts = part.select(F.col("p_partkey").alias("use"), (F.col("p_size") * 0.5).alias("low"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * 1.0).alias("high"), F.when(F.col("p_partkey") % 3 == 0, F.lit(5)).alias("phi"))
    return options, facts


def options_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.option_replay(*_options(spark, sf_dir), ["use"])


def items_to_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reviews.rerun_list(reviews.option_replay(*_options(spark, sf_dir), ["use"]))
    return got.select("item_id", "n_options", F.array_join("verdicts", ";").alias("verdicts"))


def removals_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    options, facts = _options(spark, sf_dir)
    removed = options.where("dose > 30").withColumn("reason", F.when(F.col("position") % 2 == 0, "unregistered").otherwise("dose"))
    return reviews.judged_removals(removed, facts, ["use"]).groupBy("reason", "judged").agg(F.count("*").alias("n"))


def residuals_by_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    options, facts = _options(spark, sf_dir)
    return reviews.residual_errors(options.where("dose <= 30"), reviews.option_replay(options, facts, ["use"]))


def changed_since_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    later = part.where("p_partkey % 11 > 0").withColumn("p_size", F.when(F.col("p_partkey") % 13 == 0, F.lit(0)).otherwise(F.col("p_size"))).unionByName(part.where("p_partkey = 1").withColumn("p_partkey", F.lit(-1).cast("bigint")))
    shot = lambda df: reviews.snapshot(df, ["p_partkey"], ["p_name", "p_size"])
    return reviews.snapshot_changes(shot(part), shot(later), ["p_partkey"])


def ranges_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("low"), (F.col("p_size") * 1.0 + F.col("p_partkey") % 4).alias("top"), F.lit(20.0).alias("a"), F.when(F.col("p_partkey") % 2 == 0, 40.0).alias("b"))
    return part.select("p_partkey", *[c.alias(k) for k, c in reviews.range_verdicts(F.col("low"), F.col("top"), F.col("a"), F.col("b")).items()])


def paired_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_type", "user_id", "value")
    means = e.where("event_type in ('click', 'view')").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    counts = aggregates.sign_counts(means.where("click is not null and view is not null").select(F.col("click").alias("a"), F.col("view").alias("b")))
    return reviews.with_sign_test(counts).select("n", "wins", "losses", "ties", F.round("p_value", 6).alias("p_value"))


def constructed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([("acephate", ["onion", "tomato"]), ("monocrotophos", ["grape"])], "name string, crops array<string>")
    facts = spark.createDataFrame([(c, n) for c, targets in domain.TARGETS.items() for n, _, chemistry in targets if chemistry == "rich"], "crop_slug string, canonical string")
    return reviews.constructed_items(spark, facts, listed)


def sorted_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of two keys, numbered in it over ranges of the first."""
    got = sets.every_nth(_t(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderpriority", "o_orderkey"], 25)
    return got.select("o_orderstatus", "o_orderpriority", "o_orderkey")


def torn_lines_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts written as JSON lines and read again by the reader that forgives a torn last line."""
    import uuid

    from ..operators.graph import shared_folder

    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    _t(spark, sf_dir, "part").select("p_partkey", "p_name").write.json(folder)
    return tables.read_resumable(spark, folder, "p_partkey bigint, p_name string")


def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unique_rows(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))


def difference_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which orders differ from a copy that was rounded."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    other = o.where("o_orderkey % 9 > 0").withColumns({"price": F.round("price", 0), "o_orderstatus": F.when(F.col("o_orderkey") % 8 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return audits.differences(o, other, ["o_orderkey"], ["o_orderstatus", "price"]).groupBy("field").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        units_refilled, refill_moves_nothing_else, question_flags, contradicting_lines, contradictions_listed, options_replayed, items_to_rerun, removals_judged, residuals_by_verdict, changed_since_snapshot, ranges_compared,
        paired_sign_test, constructed_buckets, sorted_slices, torn_lines_read, unique_keys, difference_histogram,
    )
}

_OPTIONS = """o AS (SELECT l_orderkey AS item_id, l_linenumber AS position, min(l_partkey) AS use, min(l_quantity) AS dose, max(l_suppkey) AS option_phi FROM lineitem GROUP BY 1, 2),
f AS (SELECT p_partkey AS use, p_size * 0.5::DOUBLE AS low, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1.0::DOUBLE END AS high, CASE WHEN p_partkey % 3 = 0 THEN 5 END AS phi FROM part WHERE p_partkey % 5 > 0),
v AS (SELECT o.*, CASE WHEN low IS NULL THEN 'unregistered' WHEN dose < low * 0.95::DOUBLE THEN 'dose_low' WHEN dose > coalesce(high, low) * 1.05::DOUBLE THEN 'dose_high' WHEN option_phi < phi THEN 'period_short' ELSE 'fine' END AS verdict
  FROM o LEFT JOIN f USING (use))"""
_none = [(c, n) for c, targets in domain.TARGETS.items() for n, _, chemistry in targets if chemistry == "none"]
_rich = [(c, n) for c, targets in domain.TARGETS.items() for n, _, chemistry in targets if chemistry == "rich"]
_hard = [(c, a, b) for c, a, d, b in domain.CONFUSABLE if c == d]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
SQL = {
    "units_refilled": """WITH p AS (SELECT p_partkey, p_size + 1 AS v, p_partkey % 2 = 0 AS bare, CASE WHEN p_partkey % 4 = 0 THEN 'ml' END AS u FROM part)
SELECT p_partkey, u AS unit_given, CASE WHEN bare AND u IS NULL THEN 'unparseable' ELSE 'numeric' END AS dose_branch, CASE WHEN NOT bare OR u IS NOT NULL THEN CAST(v AS DOUBLE) END AS dose_value_min,
CASE WHEN NOT bare THEN 'kg' ELSE coalesce(u, '') END AS dose_unit, CASE WHEN bare AND u IS NULL THEN 'NEEDS_UNIT' ELSE '' END AS dose_code FROM p""",
    "refill_moves_nothing_else": "SELECT count(*) AS n, count(*) FILTER (p_partkey % 4 = 0) AS n_given, CAST(0 AS BIGINT) AS n_moved FROM part",
    "question_flags": """WITH q AS (SELECT p_partkey, p_partkey % 17 > 0 AS asked, ['cotton', 'onion'][(p_partkey // 2) % 2 + 1] AS crop, ['cotton', 'cotton', 'onion', NULL][p_partkey % 4 + 1] AS named, p_partkey % 4 = 1 AS local,
 ['Thrips', 'Wilt', NULL][p_size % 3 + 1] AS pest, (p_partkey // 4) % 2 = 0 AS banned FROM part)
SELECT p_partkey, asked AND named IS NOT NULL AND named <> crop AS crop_mismatch, CASE WHEN asked THEN banned END AS banned_mention, asked AND local AS local_terms,
asked AND coalesce((crop, pest) IN (('cotton', 'Thrips'), ('onion', 'Thrips'), ('cotton', 'Wilt')), false) AS matchable FROM q""",
    "contradicting_lines": "SELECT l_partkey, l_suppkey, count(*) AS n_rows, count(DISTINCT l_returnflag || '|' || l_linestatus) AS n_ways FROM lineitem GROUP BY 1, 2 HAVING n_ways > 1",
    "contradictions_listed": """WITH f AS (SELECT l_partkey FROM lineitem WHERE l_partkey < 100 GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1), l AS (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey < 120)
SELECT coalesce(l_partkey, p_partkey) AS l_partkey, CASE WHEN p_partkey IS NULL THEN 'unlisted' WHEN l_partkey IS NULL THEN 'unfounded' ELSE 'confirmed' END AS state FROM f FULL JOIN l ON l_partkey = p_partkey""",
    "options_replayed": f"WITH {_OPTIONS} SELECT item_id, position, verdict FROM v",
    "items_to_rerun": f"WITH {_OPTIONS} SELECT item_id, count(*) AS n_options, array_to_string(list_sort(list(DISTINCT verdict)), ';') AS verdicts FROM v WHERE verdict <> 'fine' GROUP BY 1",
    "removals_judged": f"""WITH {_OPTIONS}, r AS (SELECT CASE WHEN position % 2 = 0 THEN 'unregistered' ELSE 'dose' END AS reason, verdict <> 'unregistered' AS known FROM v WHERE dose > 30)
SELECT reason, CASE WHEN reason = 'unregistered' AND known THEN 'false_positive' ELSE 'right' END AS judged, count(*) AS n FROM r GROUP BY 1, 2""",
    "residuals_by_verdict": f"WITH {_OPTIONS} SELECT verdict, count(*) AS n_options, count(DISTINCT item_id) AS n_items FROM v WHERE verdict <> 'fine' AND dose <= 30 GROUP BY 1",
    "changed_since_snapshot": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'lost' ELSE 'changed' END AS change FROM part WHERE p_partkey % 11 = 0 OR (p_partkey % 13 = 0 AND p_size <> 0) UNION ALL SELECT -1, 'gained'""",
    "ranges_compared": """WITH p AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS low, p_size * 1.0::DOUBLE + p_partkey % 4 AS top, CASE WHEN p_partkey % 2 = 0 THEN 40.0::DOUBLE ELSE 20.0::DOUBLE END AS b FROM part)
SELECT p_partkey, low >= 20 * 0.95::DOUBLE AND top <= b * 1.05::DOUBLE AS tolerant, low = 20 AND top = b AS exact, low >= 20 * 0.92::DOUBLE AND top <= b * 1.08::DOUBLE AS banded FROM p""",
    "paired_sign_test": """WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1),
c AS (SELECT count(*) AS n, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties FROM m WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT n, wins, losses, ties, round(least(1.0, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))))), 6) AS p_value FROM c""",
    "constructed_buckets": f"""WITH n(c, p) AS (VALUES {_values(_none)}), r(p, c) AS (VALUES ('acephate', 'onion'), ('acephate', 'tomato'), ('monocrotophos', 'grape')), h(c, p, o) AS (VALUES {_values(_hard)}), f(c, p) AS (VALUES {_values(_rich)}),
a AS (SELECT 'no_chemistry' AS bucket, c, p, 'What can be sprayed against ' || p || ' on ' || c || '?' AS q, true AS e FROM n UNION ALL SELECT 'refusal', c, p, 'How much ' || p || ' should I use on ' || c || '?', true FROM r
 UNION ALL SELECT 'hard', c, p, 'Is it ' || p || ' or ' || o || ' on my ' || c || ', and what helps?', false FROM h UNION ALL SELECT 'expansion', c, p, p || ' on ' || c || ', what helps?', false FROM f)
SELECT bucket || ':' || c || ':' || p AS item_id, bucket, c AS crop_slug, p AS canonical, q AS query_text, e AS escalate, CAST(CASE WHEN e THEN 0 ELSE 1 END AS INTEGER) AS n_options FROM a""",
    "sorted_slices": "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders QUALIFY (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) - 1) % 25 = 0",
    "torn_lines_read": "SELECT p_partkey, p_name FROM part",
    "unique_keys": "SELECT p_brand, count(*) AS n FROM part GROUP BY 1",
    "difference_histogram": """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '<row>' END AS r, o_orderkey % 9 > 0 AND o_orderkey % 8 = 0 AND o_orderstatus <> 'X' AS s, o_orderkey % 9 > 0 AND round(o_totalprice, 2) <> round(round(o_totalprice, 2), 0) AS p FROM orders)
SELECT '<row>' AS field, count(*) AS n FROM d WHERE r IS NOT NULL UNION ALL SELECT 'o_orderstatus', count(*) FROM d WHERE s UNION ALL SELECT 'price', count(*) FROM d WHERE p""",
}
