"""The guard on answers: options that label facts don't bear out are removed, uncertain answers go to an expert."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, values
from ..functions.records import UNKNOWN_PERIOD, check_record
from ..session import ready
from .graph import cut
from .joins import content_union, keep_if_any
from .retrieval import resolved_keys, retrieved
from .verification import Labels

#: The band around a dose, and the verdicts that are only noted.
BAND = 0.08
NOTED = {"UNIT_MISMATCH": "unit_mismatch", "BASIS_MISMATCH": "basis_mismatch", "UNVERIFIABLE": "unverifiable", "NOT_IN_SHEET": "dose_unmatched"}
_PLAIN_FLAG = '"escalate_to_expert":false'


def guardable(text: str | None) -> tuple[dict, bool] | None:
    """(the answer, whether it escalates) if it is valid, or invalid only for not escalating an unknown period."""
    got = check_record(text)
    if got["is_valid"]:
        return json.loads(text), json.loads(got["record"])["escalate_to_expert"]
    if got["is_json"] and len(got["errors"]) == 1 and UNKNOWN_PERIOD in got["errors"][0]:
        return json.loads(text), False
    return None


def escalated_text(text: str) -> str:
    """The text with its escalation flag set and nothing else changed, byte by byte where the flag stands there once."""
    before = json.loads(text)
    swapped = text.replace(_PLAIN_FLAG, _PLAIN_FLAG.replace("false", "true")) if text.count(_PLAIN_FLAG) == 1 else ""
    wanted = {**before, "escalate_to_expert": True}
    if swapped and json.loads(swapped) == wanted:
        return swapped
    return json.dumps(wanted, ensure_ascii=False, separators=(",", ":"))


def reference_rows(keys: DataFrame, row_id: str, labels: Labels) -> DataFrame:
    """Label rows for each key, uncapped; for a key without a pest those of all the crop's pests, once each by content."""
    one = retrieved(keys.where("canonical is not null"), row_id, labels, None)
    pests = labels.pests.join(labels.rows.select("label_idx", "crop_slug"), "label_idx").select("crop_slug", "canonical").distinct()
    wide = keys.where("canonical is null and crop_slug is not null").drop("canonical").join(pests, "crop_slug")
    # A crop-wide key is retrieved pest by pest, so that each narrows by method on its own.
    each = wide.withColumn("_key", F.struct(row_id, "canonical"))
    got = retrieved(each.select(F.to_json("_key").alias("_k"), row_id, "crop_slug", "canonical", "method"), "_k", labels, None).drop("_k")
    content = ["active_ingredient", "dose_formulation_raw", "dose_formulation_basis", "dose_formulation_value_min", "dose_formulation_value_max", "dose_formulation_unit", "phi_days", "phi_not_applicable", "phi_raw", "application_method", "biological"]
    keyed = content_union(got.select(row_id, *content, "canonical", "label_idx"), [row_id], ["canonical", "label_idx"]).select(row_id, "label_idx")
    return one.select(row_id, "label_idx").unionByName(keyed).distinct().join(labels.rows, "label_idx")


def dose_verdict(basis: Column, said: Column) -> tuple[Column, Column]:
    """(verdict, percent off) of a stated dose against a label row's columns."""
    row_basis = F.col("dose_formulation_basis")
    acre = (basis == "per_acre") & (row_basis == "per_ha")
    pick = lambda end: F.when(acre, F.col(f"dose_formulation_per_acre_{end}")).otherwise(F.col(f"dose_formulation_value_{end}"))
    unit = F.when(F.col("dose_formulation_unit") != "", F.col("dose_formulation_unit"))
    low, high = values.in_base_unit(pick("min"), unit), values.in_base_unit(pick("max"), unit)
    mine, top = values.in_base_unit(said["value_min"], said["unit"]), values.in_base_unit(said["value_max"], said["unit"])
    over = F.try_divide(F.greatest(mine, top), F.coalesce(high, low)) - 1
    under = F.try_divide(F.least(mine, top), low) - 1
    verdict = (
        F.when(basis.isNull() | (basis == "unstated") | said["value_min"].isNull(), "NO_STATED_DOSE")
        .when(F.coalesce(row_basis, F.lit("")).isin("", "free_text", "unstated"), "UNVERIFIABLE")
        .when(~acre & (basis != row_basis), "BASIS_MISMATCH")
        .when(pick("min").isNull() | low.isNull() | mine.isNull(), "UNVERIFIABLE")
        .when(values.unit_kind(said["unit"]) != values.unit_kind(unit), "UNIT_MISMATCH")
        .when(over > BAND, "HIGH").when(under < -BAND, "LOW").otherwise("OK")
    )
    return verdict, F.when(verdict == "LOW", under * 100).otherwise(over * 100)


def judged_options(options: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """(row_id, position, registered, verdict, pct, tier, n_candidates) of options (row_id, position, option, method).

    An option's product is looked for by its name, then by components, code and
    strength; then its method and its period narrow if that leaves some. The dose
    is fine if it fits any candidate, else the first one's verdict counts.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9.]", "")
    name = F.col("option.active_ingredient")
    o = options.withColumns({"o_set": cells.ingredient_set(name), "o_key": cells.formulation_key(name), "o_name": plain(name)})
    met = o.join(rows.withColumn("r_name", plain(F.col("active_ingredient"))).withColumnRenamed("application_method", "row_method"), row_id)
    same = met.where((F.size("o_set") > 0) & (F.col("o_set") == F.col("ai_set"))).select(row_id, "position").distinct().withColumn("registered", F.lit(True))
    tier = F.when(F.col("o_name") == F.col("r_name"), 1).when((F.col("o_set") == F.col("ai_set")) & F.col("o_key").eqNullSafe(F.col("form_key")), 2)
    cand = met.withColumn("tier", tier).where("tier is not null")
    by = [row_id, "position"]
    cand = keep_if_any(cand, by, F.col("tier") == 1)
    cand = keep_if_any(cand, by, (F.coalesce("method", F.lit("")) != "") & (F.col("row_method") == F.col("method")))
    cand = keep_if_any(cand, by, F.col("phi_days").eqNullSafe(F.col("option.phi_days")))
    verdict, pct = dose_verdict(F.col("option.dose.basis"), F.col("option.dose"))
    cand = cand.withColumns({"verdict": verdict, "pct": pct})
    best = F.struct((F.col("verdict") != "OK").alias("_bad"), "label_idx")
    judged = cand.groupBy(*by).agg(F.min_by(F.struct("verdict", "pct"), best).alias("_j"), F.min("tier").alias("tier"), F.count("*").alias("n_candidates"))
    out = o.select(*by).join(same, by, "left").join(judged, by, "left")
    return out.select(*by, F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("_j.verdict", F.lit("NOT_IN_SHEET")).alias("verdict"), "_j.pct", "tier", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def guarded_text(text: str | None, crop: str | None, pest: str | None, n_rows: int, verdicts: dict[int, dict]) -> tuple[str | None, list[str], bool, bool]:
    """(text, actions, guardable, changed). ``verdicts`` maps an option's position to its judgement."""
    parsed = guardable(text)
    if parsed is None:
        return text, ["unparseable"], False, False
    answer, escalates = parsed
    options, actions, keep = answer.get("chemical_options") or [], [], []
    if crop and pest and not n_rows and options:
        actions.append("no_label_rows")
    for i, option in enumerate(options):
        seen = verdicts.get(i, {"registered": False, "verdict": "NOT_IN_SHEET"})
        if crop and not seen["registered"]:
            actions.append(f"removed_unregistered:{i}")
        elif crop and seen["verdict"] in ("HIGH", "LOW"):
            actions.append(f"removed_dose:{i}:{seen['verdict']}")
        else:
            if crop and seen["verdict"] in NOTED:
                actions.append(f"{NOTED[seen['verdict']]}:{i}")
            keep.append(option)
    why = []
    if any(o.get("phi_days") is None and not o.get("phi_not_applicable", False) for o in keep):
        why.append("forced_escalation")
    if options and not keep:
        why.append("all_removed_escalation")
    if options and not crop:
        why.append("unvalidated_escalation")
    flip = bool(why) and not escalates
    removed = len(keep) < len(options)
    actions += why if flip else []
    if not removed and not flip:
        return text, actions, True, False
    if removed:
        new = json.dumps({**answer, "chemical_options": keep} | ({"escalate_to_expert": True} if flip else {}), ensure_ascii=False, separators=(",", ":"))
    else:
        new = escalated_text(text)
    if not check_record(new)["is_valid"]:
        return text, [*actions, "guard_failed"], True, False
    return new, actions, True, True


def guard(responses: DataFrame, labels: Labels, row_id: str = "item_id", response: str = "raw_response", query: str = "query_text") -> DataFrame:
    """Each response with ``guarded``, ``actions``, ``guardable``, ``changed`` and the key resolved from its question."""
    keys = cut(resolved_keys(responses, row_id, query, labels.synonyms, views=labels.views))
    rows = cut(reference_rows(keys, row_id, labels))
    shape = "struct<chemical_options:array<struct<active_ingredient:string,dose:struct<basis:string,value_min:double,value_max:double,unit:string>,phi_days:int>>>"
    said = responses.select(row_id, F.posexplode(F.from_json(response, shape)["chemical_options"]).alias("position", "option")).join(keys.select(row_id, "method"), row_id)
    judged = judged_options(said, rows, row_id).groupBy(row_id).agg(F.to_json(F.collect_list(F.struct("position", "registered", "verdict"))).alias("_verdicts"))
    n_rows = rows.groupBy(row_id).agg(F.count("*").alias("_n_rows"))
    met = responses.join(keys, row_id).join(judged, row_id, "left").join(n_rows, row_id, "left")

    ready(responses.sparkSession)

    @F.pandas_udf("struct<guarded:string,actions:array<string>,guardable:boolean,changed:boolean>")
    def run(texts: pd.Series, crops: pd.Series, pests: pd.Series, n: pd.Series, verdicts: pd.Series) -> pd.DataFrame:
        out = []
        for t, c, p, k, v in zip(texts, crops, pests, n, verdicts, strict=True):
            seen = {x["position"]: x for x in json.loads(v)} if isinstance(v, str) else {}
            out.append(guarded_text(t, c, p, int(k), seen))
        return pd.DataFrame(out, columns=["guarded", "actions", "guardable", "changed"])

    got = met.withColumn("_g", run(response, "crop_slug", "canonical", F.coalesce("_n_rows", F.lit(0)), "_verdicts"))
    return got.select(*responses.columns, "crop_slug", "canonical", "method", "_g.guarded", "_g.actions", "_g.guardable", "_g.changed")
