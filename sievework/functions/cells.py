"""Reading the other cells of label tables: waiting periods, methods, formulations, ingredients. All native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed

#: Vulgar fractions, cells that state nothing, words for units of time and their days.
FRACTIONS = {"½": "5", "¼": "25", "¾": "75"}
STATES_NOTHING = ("", "-", "--", "---", "----", "na", "n/a", "nil", "none", "not applicable")
TIME_WORDS = {"day": "day", "days": "day", "week": "week", "weeks": "week", "month": "month", "months": "month", "year": "year", "years": "year", "hour": "hour", "hours": "hour", "hr": "hour", "hrs": "hour"}
DAYS = {"day": 1, "week": 7, "month": 30}
#: Words in a row that tell that a cell is something else than a waiting period.
OTHER_THAN_PERIOD = (
    "dilution in water", "litre ha", "liter ha", "lit ha", "litres ha", "liters ha", "litre per ha", "liter per ha", "lit per ha", "kg seed", "seed tuber of", "seed tubers of", "residue", "residues",
    "re entry", "reentry", "aeration", "detector strips", "% emergence", "earhead", "dusting", "petal fall", "bud swell", "buds swell", "application", "applications",
)
#: Application methods in the order in which they are tried.
METHODS = (("soil_drench", r"(?i)soil\s*drench|\bdrench\b"), ("seed_treatment", r"(?i)seed\s*(?:treatment|dress\w*)"), ("foliar", r"(?i)foliar"), ("nursery", r"(?i)\bnursery\b|\bseedlings?\b"))
#: Formulation codes, liquid and solid, and what ends the part that is searched for them.
LIQUID = "SC EC AS FS ZC SE OD SL CS DC AF ES EW LF ME OS WSL".split()
SOLID = "WP WG WS WDG SP SG DP DF GR CG WSP CB DS RB".split()
TAIL_WORDS = "STRAIN ACCESSION CFU POTENCY SEROTYPE HOUSE SPORE POB IU LTD".split()
STRAIN_WORDS = ("STRAIN", "ACCESSION", "ISOLATE")
COUNT_WORDS = ("CFU", "POTENCY")


def _spaced(text: Column) -> Column:
    """Lower-case words, numbers and percent signs, each between blanks."""
    apart = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9%]+", " "), "(?<=[0-9])(?=[a-z])|(?=%)|(?<=%)", " ")
    return F.concat(F.lit(" "), squeezed(apart), F.lit(" "))


def _upper_words(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("([A-Z]+)"), 1)


def _literals(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def waiting_period(raw: Column) -> Column:
    """(days, outcome) of a waiting-period cell; outcome is resolved, not_applicable or raised.

    Of several numbers the greatest counts, as the longer wait is the safe one.
    Hours are rounded up to whole days. Days are null unless resolved; 0 is a value.
    """
    cell = F.trim(F.replace(F.coalesce(raw, F.lit("")), F.lit("\n"), F.lit(" ")))
    blank = F.replace(F.lower(cell), F.lit("."), F.lit("")).isin(*STATES_NOTHING)
    s = reduce(lambda c, kv: F.regexp_replace(F.regexp_replace(c, rf"(\d)\s*{kv[0]}", rf"$1.{kv[1]}"), kv[0], f"0.{kv[1]}"), FRACTIONS.items(), cell)
    table = F.create_map(*[F.lit(x) for kv in TIME_WORDS.items() for x in kv])
    units = F.array_distinct(F.filter(F.transform(F.split(_spaced(s), " "), lambda w: F.try_element_at(table, w)), lambda u: u.isNotNull()))
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    most = F.array_max(numbers)
    unit = F.get(units, F.lit(0))
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DAYS.items() for x in kv]), unit), F.lit(1))
    days = F.when(unit == "hour", F.greatest(F.lit(1), F.ceil(most / 24))).otherwise(F.floor(most * factor)).cast("int")
    words = _spaced(s)
    several = s.rlike("[0-9] +[0-9]") & ~s.rlike("[^0-9 ]")
    standard = words.rlike(" is [0-9]") & s.contains("IS")
    wrong = reduce(lambda a, b: a | b, [words.contains(f" {p} ") for p in OTHER_THAN_PERIOD]) | several | standard | F.array_contains(units, "year") | (F.size(units) > 1)
    outcome = F.when(blank | (F.size(numbers) == 0), "not_applicable").when(wrong, "raised").otherwise("resolved")
    return F.struct(F.when(outcome == "resolved", days).alias("days"), outcome.alias("outcome"))


def application_method(text: Column) -> Column:
    """The method that a cell or question names; null, not a default, if it names none."""
    t = squeezed(text)
    return reduce(lambda c, m: c.when(t.rlike(m[1]), F.lit(m[0])), METHODS[1:], F.when(t.rlike(METHODS[0][1]), F.lit(METHODS[0][0])))


def _code(words: Column) -> Column:
    return F.try_element_at(F.filter(words, lambda w: w.isin(*LIQUID, *SOLID)), F.lit(-1))


def formulation_unit(ingredient: Column) -> Column:
    """ml for a liquid product, g for a solid one, null if no code tells. What follows on a strain, count or maker doesn't count."""
    words = _upper_words(ingredient)
    ends = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*TAIL_WORDS), i)), lambda i: i.isNotNull())
    head = F.slice(words, 1, F.coalesce(F.array_min(ends), F.size(words)))
    said = F.array_join(head, " ")
    code = _code(head)
    by_word = F.when(said.contains("LIQUID FORMULATION") | said.contains("L F"), "ml").when(F.array_contains(head, "TABLET"), "g")
    by_volume = F.replace(F.upper(F.coalesce(ingredient, F.lit(""))), F.lit(" "), F.lit("")).rlike("[0-9]G/L")
    return F.when(by_volume, "ml").when(code.isin(*LIQUID), "ml").when(code.isin(*SOLID), "g").otherwise(by_word)


def _bare_name(part: Column) -> Column:
    head = F.regexp_replace(part, r"(?s)\s*\d.*$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(head, r"[^A-Za-z\- ]", " "), r"\s+", " ")))


def restricted_name(name: Column) -> Column:
    """An ingredient's name without strength and code."""
    return _bare_name(F.coalesce(name, F.lit("")))


def ingredient_set(name: Column) -> Column:
    """The sorted names of a product's components; a part that starts with a digit gives none."""
    parts = F.transform(F.split(F.coalesce(name, F.lit("")), r"\+"), _bare_name)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def strain_key(name: Column) -> Column:
    """The strain that a product names: its letters and digits, 16 at most; empty for none.

    Of the parts between brackets and commas the first that tells of a strain counts:
    what follows on the word for it, or the whole part if that states a count.
    """
    told = F.filter(F.split(F.coalesce(name, F.lit("")), "[(),]"), lambda part: F.arrays_overlap(_upper_words(part), _literals(STRAIN_WORDS + COUNT_WORDS)))
    part = F.upper(F.coalesce(F.get(told, F.lit(0)), F.lit("")))
    after = F.regexp_replace(part, "^.*?\\b(?:" + "|".join(STRAIN_WORDS) + ")\\b(?:[ .]*NO\\b)?", "")
    counted = F.arrays_overlap(_upper_words(part), _literals(COUNT_WORDS))
    return F.substring(F.regexp_replace(F.when(counted, part).otherwise(after), "[^A-Z0-9]", ""), 1, 16)


def formulation_key(text: Column) -> Column:
    """(code, strength to one place) of a product."""
    up = F.upper(F.coalesce(text, F.lit("")))
    strength = F.regexp_extract(up, r"(\d+(?:\.\d+)?)\s*%", 1)
    return F.struct(_code(_upper_words(text)).alias("code"), F.when(strength != "", F.round(strength.cast("double"), 1)).alias("strength"))


def single_strength(ingredient: Column) -> Column:
    """The percentage of a product that names exactly one, over 0 and up to 100."""
    found = F.regexp_extract_all(F.coalesce(ingredient, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)\s*%"), 1)
    value = F.get(found, F.lit(0)).cast("double")
    return F.when((F.size(found) == 1) & (value > 0) & (value <= 100), value)


def strength_check(ai: Column, form: Column, strength: Column, liquid: Column, tolerance: float = 0.10, floor: float = 1.0, density: tuple[float, float] = (0.80, 1.35)) -> Column:
    """Whether a dose of ingredient fits a product's dose and strength: consistent, density_explained or mismatch.

    Both doses are in base units. For a liquid, a ratio inside the band of plausible
    densities explains a gap. Null where a figure is missing.
    """
    expected = form * strength / 100
    gap = F.abs(ai - expected)
    ratio = F.try_divide(ai, expected)
    fits = gap <= F.greatest(F.lit(floor), tolerance * expected)
    return F.when(fits, "consistent").when(gap.isNull(), F.lit(None).cast("string")).when(liquid & ratio.between(*density), "density_explained").otherwise("mismatch")
