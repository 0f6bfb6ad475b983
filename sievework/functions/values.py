"""Numbers, arrays and maps: folds over verdicts, weighted means, unit conversions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Acres in a hectare, places kept, and the scale and dimension of units.
ACRES = 2.4711
PLACES = 4
UNIT_SCALE = {"g": 1.0, "kg": 1000.0, "ml": 1.0, "l": 1000.0, "%": 1.0}
UNIT_KIND = {"g": "mass", "kg": "mass", "ml": "volume", "l": "volume", "%": "percent"}


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def per_acre(value: Column, basis: Column) -> Column:
    """A per-hectare figure per acre; null for any other basis."""
    return F.when(basis == "per_ha", F.round(value / ACRES, PLACES))


def in_base_unit(value: Column, unit: Column) -> Column:
    """The value in g, ml or percent; null for an unknown unit."""
    return value * _lookup(UNIT_SCALE, unit)


def unit_kind(unit: Column) -> Column:
    return _lookup(UNIT_KIND, unit)


def consensus(all_true: Column, any_true: Column, graded: Column) -> Column:
    """TRUE if all agree that it is right, FALSE if none does, AMBIGUOUS if some do, null if nothing was graded."""
    return F.when(graded == 0, F.lit(None).cast("string")).when(all_true, F.lit("TRUE")).when(~any_true, F.lit("FALSE")).otherwise(F.lit("AMBIGUOUS"))


def consensus_agg(verdict: Column) -> Column:
    """``consensus`` as an aggregate over a group's boolean verdicts, nulls ignored."""
    return consensus(F.bool_and(verdict), F.bool_or(verdict), F.count(verdict))


def weighted_mean(weights: dict[str, float], values: dict[str, Column]) -> Column:
    """Mean of the values that are present, by weight, to 6 places; 1 if none is."""
    num = sum((F.when(v.isNotNull(), v * weights[k]).otherwise(0.0) for k, v in values.items() if k in weights), F.lit(0.0))
    den = sum((F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in values.items() if k in weights), F.lit(0.0))
    return F.when(den > 0, F.round(num / den, 6)).otherwise(1.0)


def present_map(values: dict[str, Column]) -> Column:
    """A map of the values that aren't null: an absent key means not applicable."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def top_by(items: Column, rank: str, k: int) -> Column:
    """The ``k`` structs with the largest ``rank`` field, equal ones in their order."""
    keyed = F.transform(items, lambda x, i: F.struct((-x[rank]).alias("down"), i.alias("pos"), x.alias("item")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["item"])


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def violations(rules: Iterable[tuple[str, Column]]) -> Column:
    """Messages of the rules broken, in order. A rule that can't be judged (null) isn't broken."""
    return F.filter(F.array(*[F.when(bad, F.lit(msg)) for msg, bad in rules]), lambda m: m.isNotNull())


def bucket(value: Column, edges: Iterable[tuple[int, str]], last: str) -> Column:
    """The label of the first edge that the value doesn't exceed, else ``last``; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(value <= edge, F.lit(label))
    return out.otherwise(F.lit(last))


def band_of(value: Column, cuts: Iterable[float]) -> Column:
    """Which of the intervals between ascending cuts holds the value, from 0; a value on a cut is above it."""
    return sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))
