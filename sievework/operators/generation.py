"""Building training and benchmark items: kinds, mock answers, retries, gold records, difficulty, merging by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain
from .filters import is_off_topic
from .graph import cut
from .sets import upserted

#: Rounds at most, the mock's hundredths that are always and at first broken, placeholder questions.
MAX_ATTEMPTS = 3
BROKEN, BROKEN_FIRST = 5, 10
PLACEHOLDER_QUESTIONS = (
    "can you provide more details about the problem", "can you provide more details", "can you give more details", "what symptoms do you see",
    "please provide more information", "can you describe the problem",
)


def item_kind(slice_number: Column, answerability: Column, text: Column) -> Column:
    """What kind of item a question becomes."""
    off = is_off_topic(text)
    return (
        F.when(slice_number == 1, "DOSE")
        .when(slice_number == 2, F.when(off, "OFFTOPIC").otherwise("CLARIFY"))
        .when(slice_number == 5, "NOCHEM")
        .when(slice_number == 3, F.when(answerability == "ANSWERABLE", "REFUSAL_DOSE").when(answerability == "NO_REGISTERED_CHEMISTRY", "REFUSAL_NOCHEM").when(off, "OFFTOPIC").otherwise("REFUSAL_CLARIFY"))
    )


def split_by_date(df: DataFrame, time: str, cutoff: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows before the cutoff, rows from it on whose text doesn't occur before)."""
    from .joins import without_leaks

    at = F.to_timestamp_ntz(F.lit(cutoff))
    train, test = df.where(F.col(time) < at), df.where(F.col(time) >= at)
    return train, without_leaks(test, train, key)


def scope_context(df: DataFrame, crop: str = "crop_slug") -> DataFrame:
    """Adds the crop's possible targets, pairs that are easily confused, and what people call the targets."""
    spark = df.sparkSession
    targets = spark.createDataFrame([(c, [(n, t, r) for n, t, r in ts]) for c, ts in domain.TARGETS.items()], f"{crop} string, possible_targets array<struct<canonical:string,type:string,chem:string>>")
    pairs = spark.createDataFrame([(c, [list(p) for p in domain.CONFUSABLE if c in (p[0], p[2])]) for c in domain.CROPS], f"{crop} string, confusable_pairs array<array<string>>")
    hints = [(c, {k: v for k, v in domain.SYNONYMS.items() if v in {n for n, _, _ in domain.TARGETS[c]}}) for c in domain.CROPS]
    return df.join(targets, crop, "left").join(pairs, crop, "left").join(spark.createDataFrame(hints, f"{crop} string, synonym_hints map<string,string>"), crop, "left")


def mock_bucket(key: Column) -> Column:
    """The SHA-256 digest of a key, as a number, modulo 100: digit by digit."""
    digest = F.sha2(key.cast("string"), 256)
    step = lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("int")) % 100
    return F.aggregate(F.filter(F.split(digest, ""), lambda d: d != ""), F.lit(0), step)


def mock_state(key: Column, attempt: Column) -> Column:
    """Whether the mock answers well, always badly, or badly at first."""
    b = mock_bucket(key)
    return F.when(b < BROKEN, "broken").when((b < BROKEN_FIRST) & (attempt == 0), "broken").otherwise("good")


def retried(items: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame], rounds: int = MAX_ATTEMPTS) -> DataFrame:
    """Answers, judges and tries again what isn't accepted: (key, attempts, outcome, output, reasons).

    ``answer`` adds ``output`` to items with ``attempt`` and ``prior_failures``;
    ``judge`` adds ``passed``, ``excluded`` and ``reasons``. An excluded item is
    final, a failed one is tried ``rounds`` times. Each round is cut off, so an
    answer isn't asked for twice.
    """
    pending = items.withColumns({"attempt": F.lit(0), "prior_failures": F.array().cast("array<string>")})
    done = None
    for n in range(rounds):
        seen = cut(judge(answer(pending)))
        last = n == rounds - 1
        settled = seen if last else seen.where("passed or excluded")
        outcome = F.when(F.col("passed"), "accepted").when(F.col("excluded"), "excluded").otherwise("rejected_after_retries")
        part = settled.select(key, F.lit(n + 1).alias("attempts"), outcome.alias("outcome"), F.when(F.col("passed"), F.col("output")).alias("output"), "reasons")
        done = part if done is None else done.unionByName(part)
        if last:
            break
        pending = seen.where("not passed and not excluded").withColumns({"attempt": F.lit(n + 1), "prior_failures": F.col("reasons")}).select(*pending.columns)
        if pending.isEmpty():
            break
    return done


def resumed(items: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Items that have to be done: accepted and rejected ones are final, excluded ones are tried again."""
    final = log.where(~F.coalesce(F.col("outcome_reason"), F.lit("")).startswith("excluded")).select(*keys).distinct()
    return items.join(final, keys, "left_anti")


merged_records = upserted


def gold_option(row: str = "") -> Column:
    """A label row as an option of the record."""
    c = lambda n: F.col(f"{row}.{n}" if row else n)
    dose = F.struct(
        c("dose_formulation_basis").alias("basis"), c("dose_formulation_value_min").alias("value_min"), c("dose_formulation_value_max").alias("value_max"),
        c("dose_formulation_unit").alias("unit"), c("dose_formulation_raw").alias("raw"),
    )
    none = F.lit(None).cast("int")
    return F.struct(
        c("active_ingredient").alias("active_ingredient"), c("active_ingredient").alias("formulation"), dose.alias("dose"), none.alias("spray_volume_min_l_per_acre"), none.alias("spray_volume_max_l_per_acre"),
        c("phi_days").alias("phi_days"), F.coalesce(c("phi_not_applicable"), F.lit(False)).alias("phi_not_applicable"), F.lit("Follow the label; observe the stated waiting period before harvest.").alias("caution"),
    )


def _disease(crop: Column, canonical: Column) -> Column:
    """Whether the domain's list has a target of that name as a disease, on the crop or, if the crop lacks it, on any."""
    kinds = {(c, name): kind for c, targets in domain.TARGETS.items() for name, kind, _ in targets}
    table = F.create_map(*[F.lit(x) for (c, name), kind in kinds.items() for x in (f"{c}|{name}", kind)])
    anywhere = sorted({name for (_, name), kind in kinds.items() if kind == "disease"})
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", crop, canonical)) == "disease", canonical.isin(*anywhere))


def gold_records(rows: DataFrame, practices: DataFrame | None = None) -> DataFrame:
    """Gold answers for label rows with their ``canonical``: the row's option; escalated if any row of the triple leaves the period unknown.

    ``practices`` is (crop_slug, canonical, non_chemical array<string>, evidence), one
    row for each target; a target that it lacks has no such measures and no evidence.
    """
    triple = Window.partitionBy("crop_slug", "canonical", "ai_set")
    unknown = F.bool_or(F.col("phi_days").isNull() & ~F.coalesce("phi_not_applicable", F.lit(False))).over(triple)
    if practices is None:
        known = rows.withColumns({"_measures": F.array().cast("array<string>"), "_evidence": F.lit("")})
    else:
        known = rows.join(practices.select("crop_slug", "canonical", F.col("non_chemical").alias("_measures"), F.col("evidence").alias("_evidence")), ["crop_slug", "canonical"], "left")
    kind = F.when(_disease(F.col("crop_slug"), F.col("canonical")), "disease").otherwise("pest")
    cause = F.struct(F.col("canonical").alias("name"), kind.alias("type"), F.lit(0.9).alias("confidence"), F.coalesce("_evidence", F.lit("")).alias("evidence"))
    gold = F.struct(
        F.lit(True).alias("in_scope"), F.lit(True).alias("query_understood"), F.lit(None).cast("string").alias("clarifying_question"), F.array(cause).alias("likely_causes"),
        F.coalesce("_measures", F.array().cast("array<string>")).alias("non_chemical_first"), F.array(gold_option()).alias("chemical_options"),
        F.array(F.lit("Wear protective equipment.")).alias("safety"), unknown.alias("escalate_to_expert"),
    )
    return known.withColumn("gold", gold).drop("_measures", "_evidence")


def difficulty(record: Column) -> Column:
    """edge_case, hard or standard, the first that holds."""
    options = record["chemical_options"]
    unknown = F.exists(options, lambda o: o["phi_days"].isNull() & ~F.coalesce(o["phi_not_applicable"], F.lit(False)))
    spread = F.exists(options, lambda o: F.coalesce(o["dose"]["value_max"] != o["dose"]["value_min"], o["dose"]["value_max"].isNotNull()))
    return F.when(record["escalate_to_expert"] & unknown, "edge_case").when(spread | (F.size(record["likely_causes"]) > 1), "hard").otherwise("standard")


def ordered_candidates(rows: DataFrame, seed: int, used: DataFrame | None = None) -> DataFrame:
    """Ranks usable rows (label_idx, crop_slug, canonical, ai_set, phi_days, n_canonicals) for an item of their pair.

    Unused ingredients first, then rows with a period, then those of one pest only,
    then by hash. A used ingredient is a later choice, not none.
    """
    from .sets import hash_order

    marked = rows.join(used.select("ai_set").distinct().withColumn("_used", F.lit(1)), "ai_set", "left") if used is not None else rows.withColumn("_used", F.lit(None).cast("int"))
    order = [F.coalesce("_used", F.lit(0)), F.col("phi_days").isNull(), F.col("n_canonicals") > 1, hash_order(seed, "label_idx"), "label_idx"]
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("crop_slug", "canonical").orderBy(*order))).drop("_used")


def spread_over_ingredients(ranked: DataFrame, quota: int) -> DataFrame:
    """The best row of each ingredient of a pair, ``quota`` of them: no ingredient is taken twice."""
    one = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("crop_slug", "canonical", "ai_set").orderBy("rank"))).where("_n = 1")
    return one.withColumn("_q", F.row_number().over(Window.partitionBy("crop_slug", "canonical").orderBy("rank"))).where(F.col("_q") <= quota).drop("_n", "_q")


def query_targets(df: DataFrame, quota: int, holdout: int, seed: int) -> DataFrame:
    """Synthetic queries (target, query): by hash up to a quota for each target, the first ``holdout`` of them for testing."""
    from .sets import hash_order

    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy(hash_order(seed, "target", "query"), "query"))).where(F.col("_n") <= quota)
    return ranked.withColumn("split", F.when(F.col("_n") <= holdout, "test").otherwise("train")).drop("_n")


def question_is_specific(question: Column) -> Column:
    """Whether a question back is long enough and no placeholder."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(question, F.lit("")))), "[?.!]", "")
    return (F.length(F.trim(F.coalesce(question, F.lit("")))) >= 15) & ~plain.isin(*PLACEHOLDER_QUESTIONS)


def free_text_doses_known(options: DataFrame, facts: DataFrame, item: str) -> DataFrame:
    """Options (item, ai_set, basis, raw) with a free-text dose that no fact of their ingredient prints like that."""
    return options.where("basis = 'free_text'").join(facts.select(item, "ai_set", "raw").distinct(), [item, "ai_set", "raw"], "left_anti")


def common_ingredients(facts: DataFrame, item: str) -> DataFrame:
    """Ingredient sets that are registered for all of an item's pests: (item, ai_set)."""
    from .sets import common_to_all

    return common_to_all(facts, item, "ai_set", "canonical")
