"""Text expressions: counting, normal forms, scripts, whole-word terms. All native."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as part of a word, the same in Java's and RE2's regular expressions.
WORD = r"\p{L}\p{N}_"
#: Code point blocks of the scripts told apart, in the order that breaks ties.
SCRIPTS = {
    "latin": r"[\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{24F}]",
    "devanagari": r"[\x{900}-\x{97F}]",
    "telugu": r"[\x{C00}-\x{C7F}]",
    "kannada": r"[\x{C80}-\x{CFF}]",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; written out, it would be worked out in each step of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeezed(text: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"(?U)\s+", " "))


def word_count(text: Column | str) -> Column:
    """Words between white space; 0 for null and blank texts."""
    parts = F.split(F.coalesce(_col(text), F.lit("")), r"(?U)\s+")
    return F.size(F.filter(parts, lambda w: w != ""))


def char_count(text: Column | str) -> Column:
    """Code points; 0 for null."""
    return F.length(F.coalesce(_col(text), F.lit("")))


def normalized(text: Column | str) -> Column:
    """Lower case, whatever is no word character or white space a blank, blanks squeezed; null as empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), rf"[^{WORD}\s]", " ")
    return squeezed(bare)


def folded(text: Column | str) -> Column:
    """Lower case and squeezed, punctuation kept: the key of the leakage check."""
    return F.lower(squeezed(text))


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the normal form."""
    return F.sha2(normalized(text), 256)


def dominant_script(text: Column | str) -> Column:
    """The script with the most letters; ties go to the first listed; ``other`` without any."""
    counts = {k: F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(p)) for k, p in SCRIPTS.items()}
    most = F.greatest(*counts.values())
    chain = reduce(lambda c, item: c.when(item[1] == most, F.lit(item[0])), counts.items(), F.when(most == 0, F.lit("other")))
    return chain.otherwise(F.lit("other"))


def collapsed_repeat(text: Column | str) -> Column:
    """A cell whose tokens are all the same as that token once; others as they are."""
    parts = F.split(squeezed(text), " ")
    return F.when((F.size(parts) > 1) & (F.size(F.array_distinct(parts)) == 1), parts[0]).otherwise(_col(text))


def has_term(text: Column, term: Column) -> Column:
    """Whether a normal form contains a normal term between word borders."""
    return (F.length(term) > 0) & F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), term, F.lit(" ")))


def word_shingles(text: Column | str, k: int = 3) -> Column:
    """Distinct runs of ``k`` words of the normal form; a shorter text is one run, an empty one none."""
    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.filter(F.array_distinct(let(F.split(normalized(text), " "), runs)), lambda s: s != "")


def merged_single_letters(tokens: Column) -> Column:
    """Joins a one-letter token to the next one, from the left, each token used once."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, tok: Column) -> Column:
        joined = F.struct(F.concat(acc["out"], F.array(F.concat(acc["held"], tok))).alias("out"), F.lit("").alias("held"))
        held = F.struct(acc["out"].alias("out"), tok.alias("held"))
        kept = F.struct(F.concat(acc["out"], F.array(tok)).alias("out"), F.lit("").alias("held"))
        return F.when(acc["held"] != "", joined).when(F.length(tok) == 1, held).otherwise(kept)

    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["held"] != "", F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"]))


def first_difference(a: Column, b: Column) -> Column:
    """The first place, from 0, where two strings differ; null if they are equal."""
    shorter = F.least(F.length(a), F.length(b))
    letters = lambda c: F.split(F.substring(c, F.lit(1), shorter), "")
    place = F.array_position(F.zip_with(letters(a), letters(b), lambda x, y: x != y), True)
    return F.when(a == b, F.lit(None).cast("int")).when(shorter == 0, F.lit(0)).when(place > 0, place.cast("int") - 1).otherwise(shorter)


def is_prose_cell(text: Column | str) -> Column:
    """Over 40 characters and not led by a quantity; an ordinal leads prose."""
    t = squeezed(text)
    ordinal = t.rlike(r"(?i)^[(\[]?\s*\d+\s*(st|nd|rd|th)\b")
    return (F.length(t) > 40) & (ordinal | ~t.rlike(r"^[(\[]?\s*\d"))


def leading_marker(line: Column | str) -> Column:
    """(marker, body) of a footnote line: the leading run of asterisks and the text after it; null without either."""
    s = F.trim(_col(line))
    # A possessive run, so that an asterisk after a shorter marker isn't taken for text.
    found = s.rlike(r"^\*++\s*[^\s*].*$") | s.rlike(r"^\*++\s+\S")
    return F.when(found, F.struct(F.regexp_extract(s, r"^(\*++)", 1).alias("marker"), F.trim(F.regexp_extract(s, r"(?s)^\*++(.*)$", 1)).alias("body")))


#: The wording that gives away a dose or advice, in the scripts of the corpus.
DOSE_WORDING = (
    r"(?i)\p{Nd}\s*(?:%|g(?!\p{L})|gm(?!\p{L})|gms(?!\p{L})|gram|grm|kg(?!\p{L})|ml(?!\p{L})|mls(?!\p{L})|l(?!\p{L})|lit(?!\p{L})|ltr(?!\p{L})|litre|liter"
    r"|ग्राम|ग्रॅम|ग्रा|मिली|मिलि|मिलीलीटर|मिलिलीटर|लीटर|लिटर|किलो|ગ્રામ|મિલી|લિટર|గ్రాములు|మిల్లి|లీటర్ల|ಗ್ರಾಂ|ಮಿಲಿ|ಲೀಟರ್)"
)
ADVICE_WORDING = (
    r"(?i)\b(?:spray|sprey|spraying|apply|application|applied|drench|drenching|treat|treatment|dust|dusting|broadcast|soak|soaking|mix|mixing"
    r"|recommend|recommended|suggest|suggested|advised)\b"
    r"|फवारणी|फवार|छिड़काव|छिडकाव|स्प्रे|आळवणी|ड्रेंचिंग|छिड़के|છંટકાવ|પંપ|పిచికారి|చల్లాలి|ಸಿಂಪಡಿಸಿ"
)


def advice_reasons(text: Column | str, named: Column | None = None) -> Column:
    """What makes an answer advice, joined by ``+``: a named substance, a dose, a verb. Empty for none."""
    t = F.coalesce(_col(text), F.lit(""))
    named = named if named is not None else F.lit(False)
    return F.concat_ws("+", F.when(named, "chemical"), F.when(t.rlike(DOSE_WORDING), "dose"), F.when(t.rlike(ADVICE_WORDING), "verb"))
