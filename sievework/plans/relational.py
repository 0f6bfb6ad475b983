"""Queries on the star schema, events and labels: joins, windows, samples, aggregates; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import aggregates, audits, filters, joins, sets, windows


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slice_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "ANSWERABLE").when(F.col("o_orderstatus") == "O", "NO_REGISTERED_CHEMISTRY").otherwise("PEST_UNKNOWN")
    rows = _t(spark, sf_dir, "orders").withColumn("slice", filters.slice_number(F.col("o_orderpriority") == "1-URGENT", state))
    return rows.groupBy("slice").agg(F.count("*").alias("n"))


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = {"click": 20, "error": 5, "view": 30}
    return sets.quota_sample(_t(spark, sf_dir, "events"), "event_type", quota, 7, "event_id", F.when(F.col("value") > 50, 0).otherwise(1)).select("event_id", "event_type")


def quota_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = {"click": 20, "none such": 5}
    return sets.quota_shortfall(sets.quota_sample(_t(spark, sf_dir, "events"), "event_type", quota, 7, "event_id"), "event_type", quota).select("event_type", F.col("got").cast("bigint").alias("got"), "quota")


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.round_robin(_t(spark, sf_dir, "events"), "event_type", [sets.hash_order(3, "event_id"), "event_id"], 33).select("event_id", "event_type")


def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.every_nth(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 5).select("o_custkey", "o_orderkey")


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.uniform_sample(_t(spark, sf_dir, "part"), 50, 11, "p_partkey").select("p_partkey")


def mandatory_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.mandatory_and_fill(_t(spark, sf_dir, "part"), "p_partkey", [3, 14, 159], 25, 5).select("p_partkey")


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    edges = [(0, "0"), (5, "1-5"), (15, "6-15"), (40, "16-40")]
    return n.groupBy(V.bucket(F.col("n"), edges, "41+").alias("bucket")).agg(F.count("*").alias("n_groups"))


def bag_union_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice"))
    return sets.upserted(orders, new, ["o_orderkey"]).groupBy((F.col("o_totalprice") == 0).alias("is_new")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return joins.first_of_key(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"])


def prioritised_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    by_both = joins.first_of_key(part.where("p_size < 10"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_type", F.col("p_size").alias("found"))
    by_brand = joins.first_of_key(part.where("p_size < 2"), ["p_brand"], ["p_partkey"]).select("p_brand", F.col("p_size").alias("found"))
    got = joins.prioritised(part.select("p_partkey", "p_brand", "p_type"), [("both", by_both, ["p_brand", "p_type"]), ("brand", by_brand, ["p_brand"])], ["found"], "how")
    return got.select("p_partkey", "found", "how")


def narrow_if_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem")
    got = joins.narrow(rows, ["l_orderkey"], [F.col("l_returnflag") == "R", F.col("l_quantity") > 25])
    return got.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def crosswalk_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(0, 10, "small"), (10, 25, "middle"), (25, 40, "large")], "low int, high int, band string")
    return joins.range_lookup(_t(spark, sf_dir, "part"), "p_size", bands, "low", "high", 10).groupBy(F.coalesce("band", F.lit("none")).alias("band")).agg(F.count("*").alias("n"))


def band_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(V.band_of(F.col("p_size"), [5, 10, 20, 30, 40]).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def subset_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array(F.col("p_size").cast("double"), F.col("p_retailprice") % 60)).alias("mids"))
    return joins.subset_assignment(rows, "mids", [5.0, 15.0, 25.0, 35.0, 45.0, 55.0]).select("p_partkey", F.array_join(F.col("bands").cast("array<string>"), ";").alias("bands"))


def fragments_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the order of the SQL, in which nulls are last; of lines that it leaves equal only the status matters, so it decides."""
    order = [F.col(c).asc_nulls_last() for c in ("l_linenumber", "l_partkey", "l_quantity", "l_linestatus")]
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(windows.Window.partitionBy("l_orderkey").orderBy(*order)).alias("pos"), F.col("l_linestatus").alias("status"), F.col("l_partkey").cast("string").alias("cell"))
    return joins.appended_to_previous(rows, ["l_orderkey"], ["pos"], F.col("status") == "F", ["cell"]).select("l_orderkey", "pos", "cell")


def percentile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.spread(_t(spark, sf_dir, "events"), ["event_type"], "value").withColumn("median", F.round("median", 6))


def shape_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.shape_histogram(_t(spark, sf_dir, "part"), ["p_brand"], "p_type")


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.most_frequent(_t(spark, sf_dir, "lineitem"), ["l_partkey"], 20)


def json_prop_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("greatest"))


def json_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return _t(spark, sf_dir, "events").groupBy(F.coalesce(F.array_join(F.array_sort(keys), ","), F.lit("none")).alias("shape")).agg(F.count("*").alias("n"))


def weighted_present_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"a": F.when(F.col("l_returnflag") == "A", F.col("l_discount")), "b": F.when(F.col("l_linestatus") == "F", F.col("l_tax")), "c": F.when(F.col("l_quantity") > 30, F.lit(1.0))}
    got = _t(spark, sf_dir, "lineitem").select(V.weighted_mean({"a": 0.3, "b": 0.25, "c": 0.1}, cols).alias("m"))
    return got.agg(F.round(F.avg("m"), 6).alias("mean"), F.count(F.when(F.col("m") == 1, 1)).alias("n_ones"))


def consensus_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R")
    by_order = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(V.consensus_agg(verdict).alias("verdict"))
    return by_order.groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    pairs = joins.paired(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "v")
    got = aggregates.sign_counts(pairs)
    return got.select("n", "wins", "losses", "ties", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "mean_diff")])


def arm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.arm_table(_t(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", ["A", "N", "R"], "l_quantity")
    return got.select("l_linestatus", *[F.round(c, 6).alias(c.lower()) for c in ("A", "N", "R", "delta")])


def block_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.with_block_share(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 25, "shaped")
    return got.groupBy("shaped").agg(F.count("*").alias("n"))


def in_all_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.in_all_arms(_t(spark, sf_dir, "events"), "user_id", "event_type", 5)


def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return sets.symmetric_difference(o.where("o_orderstatus = 'F'"), o.where("o_orderpriority = '5-LOW'"), ["o_custkey"])


def common_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = n.select("s_nationkey", F.col("l_quantity").cast("int").alias("quantity"), "l_returnflag")
    return sets.common_to_all(rows, "s_nationkey", "quantity", "l_returnflag").groupBy("s_nationkey").agg(F.count("*").alias("n"))


def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.capped(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], 3).select("o_custkey", "o_orderkey", "rows_available")


def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return windows.best_attempt(rows, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F")


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.regexp_extract("o_orderpriority", r"^\d-(\w+)", 1)
    return aggregates.reason_histogram(_t(spark, sf_dir, "orders"), "o_custkey", reason)


def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    other = c.where("c_custkey % 10 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 4 == 0, 99).otherwise(F.col("c_nationkey")))
    return audits.differences(c, other, ["c_custkey"], ["c_mktsegment", "c_nationkey"]).groupBy("field").agg(F.count("*").alias("n"))


def per_acre(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = F.when(F.col("p_type") == "ECONOMY", "per_ha").otherwise("per_tree")
    return _t(spark, sf_dir, "part").select("p_partkey", V.per_acre(F.col("p_retailprice"), basis).alias("per_acre"))


def exclusion_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("no_price", F.col("p_retailprice") < 901), ("big", F.col("p_size") > 40), ("economy", F.col("p_type") == "ECONOMY")]
    kept, out = filters.cascade(_t(spark, sf_dir, "part"), rules)
    return kept.withColumn("exclusion_reason", F.lit("kept")).unionByName(out).groupBy("exclusion_reason").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        slice_partition, quota_sample, quota_shortfall, round_robin_sample, every_nth, uniform_sample, mandatory_and_fill, bucket_counts, bag_union_upsert, first_of_key, prioritised_join, narrow_if_nonempty, crosswalk_range_join,
        band_assignment, subset_assignment, fragments_appended, percentile_stats, shape_modes, top_values, json_prop_extract, json_shape, weighted_present_mean, consensus_fold, paired_arms, arm_table, block_share, in_all_arms,
        symmetric_difference, common_members, capped_rows, best_attempt, reason_histogram, field_differences, per_acre, exclusion_cascade,
    )
}

_hash = lambda seed, key: f"sha256('{seed}|' || CAST({key} AS VARCHAR))"
_rn = "row_number() OVER (PARTITION BY"

SQL = {
    "slice_partition": """SELECT CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 WHEN o_orderstatus = 'O' THEN 5 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS INTEGER) AS slice, count(*) AS n FROM orders GROUP BY 1""",
    "quota_sample": f"""SELECT event_id, event_type FROM events QUALIFY {_rn} event_type ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, {_hash(7, 'event_id')}, event_id)
<= CASE event_type WHEN 'click' THEN 20 WHEN 'error' THEN 5 WHEN 'view' THEN 30 ELSE 0 END""",
    "quota_shortfall": "SELECT 'none such' AS event_type, CAST(0 AS BIGINT) AS got, CAST(5 AS INTEGER) AS quota",
    "round_robin_sample": f"""WITH r AS (SELECT *, {_rn} event_type ORDER BY {_hash(3, 'event_id')}, event_id) AS turn FROM events) SELECT event_id, event_type FROM r ORDER BY turn, event_type LIMIT 33""",
    "every_nth": f"SELECT o_custkey, o_orderkey FROM orders QUALIFY ({_rn} o_custkey ORDER BY o_orderkey) - 1) % 5 = 0",
    "uniform_sample": f"SELECT p_partkey FROM part ORDER BY {_hash(11, 'p_partkey')}, p_partkey LIMIT 50",
    "mandatory_and_fill": f"SELECT p_partkey FROM part ORDER BY CASE WHEN p_partkey IN (3, 14, 159) THEN 0 ELSE 1 END, {_hash(5, 'p_partkey')}, p_partkey LIMIT 25",
    "bucket_counts": """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag)
SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 15 THEN '6-15' WHEN n <= 40 THEN '16-40' ELSE '41+' END AS bucket, count(*) AS n_groups FROM g GROUP BY 1""",
    "bag_union_upsert": "SELECT o_orderkey % 7 = 0 AS is_new, count(*) AS n, round(sum(CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1",
    "first_of_key": f"SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY {_rn} l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) = 1",
    "prioritised_join": """WITH a AS (SELECT p_brand, p_type, arg_min(p_size, p_partkey) AS f FROM part WHERE p_size < 10 GROUP BY 1, 2), b AS (SELECT p_brand, arg_min(p_size, p_partkey) AS f FROM part WHERE p_size < 2 GROUP BY 1)
SELECT p_partkey, coalesce(a.f, b.f) AS found, CASE WHEN a.f IS NOT NULL THEN 'both' WHEN b.f IS NOT NULL THEN 'brand' END AS how FROM part p LEFT JOIN a ON p.p_brand = a.p_brand AND p.p_type = a.p_type LEFT JOIN b ON p.p_brand = b.p_brand""",
    "narrow_if_nonempty": """WITH a AS (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS any1 FROM lineitem), b AS (SELECT * FROM a WHERE l_returnflag = 'R' OR NOT any1),
c AS (SELECT *, bool_or(l_quantity > 25) OVER (PARTITION BY l_orderkey) AS any2 FROM b) SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM c WHERE l_quantity > 25 OR NOT any2 GROUP BY 1""",
    "crosswalk_range_join": "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 25 THEN 'middle' WHEN p_size >= 25 AND p_size < 40 THEN 'large' ELSE 'none' END AS band, count(*) AS n FROM part GROUP BY 1",
    "band_assignment": "SELECT CAST((p_size >= 5)::INT + (p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 30)::INT + (p_size >= 40)::INT AS INTEGER) AS band, count(*) AS n FROM part GROUP BY 1",
    "subset_assignment": """WITH m AS (SELECT p_partkey, list_sort([CAST(p_size AS DOUBLE), p_retailprice % 60]) AS m FROM part), c(i, c) AS (VALUES (0, 5.0), (1, 15.0), (2, 25.0), (3, 35.0), (4, 45.0), (5, 55.0))
SELECT p_partkey, a.i || ';' || b.i AS bands FROM m JOIN c a ON true JOIN c b ON a.i < b.i QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY CAST(abs(m[1] - a.c) AS DOUBLE) + CAST(abs(m[2] - b.c) AS DOUBLE), a.i, b.i) = 1""",
    "fragments_appended": """WITH r AS (SELECT l_orderkey, l_linestatus, CAST(l_partkey AS VARCHAR) AS cell, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS pos FROM lineitem),
b AS (SELECT *, sum(CASE WHEN l_linestatus = 'F' AND pos > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) AS blk FROM r)
SELECT l_orderkey, CAST(min(pos) AS INTEGER) AS pos, string_agg(cell, ' ' ORDER BY pos) AS cell FROM b GROUP BY l_orderkey, blk""",
    "percentile_stats": "SELECT event_type, count(value) AS n, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS greatest FROM events GROUP BY 1",
    "shape_modes": "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) = 1 AS is_mode FROM c",
    "top_values": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20",
    "json_prop_extract": "WITH k AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS greatest FROM k GROUP BY 1",
    "json_shape": "SELECT coalesce(array_to_string(list_sort(json_keys(props)), ','), 'none') AS shape, count(*) AS n FROM events GROUP BY 1",
    "weighted_present_mean": """WITH v AS (SELECT CASE WHEN l_returnflag = 'A' THEN l_discount END AS a, CASE WHEN l_linestatus = 'F' THEN l_tax END AS b, CASE WHEN l_quantity > 30 THEN 1.0 END AS c FROM lineitem),
w AS (SELECT coalesce(a * 0.3, 0) + coalesce(b * 0.25, 0) + coalesce(c * 0.1, 0) AS num, (a IS NOT NULL)::INT * CAST(0.3 AS DOUBLE) + (b IS NOT NULL)::INT * CAST(0.25 AS DOUBLE) + (c IS NOT NULL)::INT * CAST(0.1 AS DOUBLE) AS den FROM v),
m AS (SELECT CASE WHEN den > 0 THEN round(num / den, 6) ELSE 1.0 END AS m FROM w) SELECT round(avg(m), 6) AS mean, count(*) FILTER (WHERE m = 1) AS n_ones FROM m""",
    "consensus_fold": """WITH o AS (SELECT l_orderkey, bool_and(l_returnflag = 'R') FILTER (WHERE l_returnflag <> 'N') AS a, bool_or(l_returnflag = 'R') FILTER (WHERE l_returnflag <> 'N') AS b FROM lineitem GROUP BY 1)
SELECT CASE WHEN a IS NULL THEN 'none' WHEN a THEN 'TRUE' WHEN NOT b THEN 'FALSE' ELSE 'AMBIGUOUS' END AS verdict, count(*) AS n FROM o GROUP BY 1""",
    "paired_arms": """WITH e AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), p AS (SELECT a.v AS a, b.v AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view')
SELECT count(*) AS n, count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, count(*) FILTER (WHERE a = b) AS ties, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS mean_diff FROM p""",
    "arm_table": """SELECT l_linestatus, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS a, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS n, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS r,
round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R') - avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS delta FROM lineitem GROUP BY 1""",
    "block_share": "WITH s AS (SELECT avg((l_quantity > 25)::INT) OVER (PARTITION BY l_orderkey) >= 0.5 AS shaped FROM lineitem) SELECT shaped, count(*) AS n FROM s GROUP BY 1",
    "in_all_arms": "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5",
    "symmetric_difference": """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
SELECT o_custkey, 'a' AS side FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b) UNION ALL SELECT o_custkey, 'b' FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""",
    "common_members": """WITH r AS (SELECT s_nationkey, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f FROM supplier JOIN lineitem ON s_suppkey = l_suppkey), w AS (SELECT s_nationkey, count(DISTINCT f) AS k FROM r GROUP BY 1),
g AS (SELECT s_nationkey, q, count(DISTINCT f) AS k FROM r GROUP BY 1, 2) SELECT g.s_nationkey, count(*) AS n FROM g JOIN w ON g.s_nationkey = w.s_nationkey AND g.k = w.k GROUP BY 1""",
    "capped_rows": f"WITH r AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS rows_available, {_rn} o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey, rows_available FROM r WHERE rn <= 3",
    "best_attempt": f"SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY {_rn} o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderkey DESC) = 1",
    "reason_histogram": "SELECT regexp_extract(o_orderpriority, '^\\d-(\\w+)', 1) AS reason, count(DISTINCT o_custkey) AS n_items FROM orders GROUP BY 1",
    "field_differences": """SELECT '<row>' AS field, count(*) AS n FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'c_nationkey', count(*) FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 4 = 0""",
    "per_acre": "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN round(p_retailprice / 2.4711, 4) END AS per_acre FROM part",
    "exclusion_cascade": "SELECT CASE WHEN p_retailprice < 901 THEN 'no_price' WHEN p_size > 40 THEN 'big' WHEN p_type = 'ECONOMY' THEN 'economy' ELSE 'kept' END AS exclusion_reason, count(*) AS n FROM part GROUP BY 1",
}
