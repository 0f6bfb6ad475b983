"""Language identification by fusing evidence in Bayes' way.

For each text and language the log odds add up

* the text's likelihood under a naive Bayes model of hashed character trigrams,
* the declared markup language, which is right with a given probability,
* the prior of the host, smoothed towards its domain's, that towards its address
  suffix's, and that towards all rows'.

The prior comes from grouped sums, over all rows, of what the text alone says. A
row's share counts once in them: at its host, whose rows are left out of its domain's
sum, as the domain's are of the suffix's and the suffix's of the whole; and a row's own
share is taken out before it is judged. The languages compete with ``und``, under
which all trigrams are equally likely.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_BYTES, cut, ready

_BITS = 16
BUCKETS = 1 << _BITS
UND = "und"
_PIECE = 1 << 20


def trigrams(text: str):
    """Buckets of the character trigrams of the lower-case text, runs of what isn't a letter reduced to one blank; in pieces."""
    tail = np.empty(0, dtype=np.uint32)  # the last two characters of the piece before
    for at in range(0, len(text), _PIECE):
        codes = np.frombuffer(text[at : at + _PIECE].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = (codes >= 97) & (codes <= 122) | (codes >= 192) & (codes != 215) & (codes != 247) & ~((codes >= 0x2000) & (codes <= 0x2BFF))
        codes = np.concatenate([tail, np.where(letter, codes, np.uint32(32))])
        letter = codes != 32
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = letter[1:] | letter[:-1]
        codes = codes[keep]
        tail = codes[-2:]
        codes = codes.astype(np.uint64)
        if len(codes) >= 3:
            h = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
            yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class LanguageModel:
    """Log probabilities of the trigram buckets, a row for each language, ``und`` last."""

    languages: list[str]
    logs: np.ndarray  # (languages, buckets)

    def evidence(self, text: str, weight: float = 200.0) -> np.ndarray:
        """The log likelihoods, tempered as if no text had over ``weight`` trigrams, as trigrams aren't independent."""
        total, n = np.zeros(len(self.languages)), 0
        for buckets in trigrams(text):
            total += np.take(self.logs, buckets, axis=1).sum(axis=1)
            n += len(buckets)
        return total * min(1.0, weight / max(n, 1))


def train_language(df: DataFrame, text: str = "text", lang: str = "lang", rows: int = 1000, languages: int = 64, smooth: float = 0.1) -> LanguageModel:
    """A model from at most ``rows`` texts of each language, those whose hash comes first; copies count once.

    The ``languages`` with the most rows are learned. Null or empty texts and languages
    are left out. Whole texts are counted on the executors; the driver gets the sums,
    whose size doesn't depend on the data.
    """
    import pyarrow as pa

    spark = ready(df.sparkSession)
    own = df.where(F.col(text).isNotNull() & (F.col(text) != "") & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("draw"))
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw").alias("texts")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    kinds = sorted(r["lang"] for r in sizes)
    if not kinds:
        return LanguageModel([UND], np.full((1, BUCKETS), -np.log(BUCKETS)))
    # Draws are even, so the first ``rows`` are in a share of them that the number of texts tells: four times what is
    # needed, as that is an estimate. So no language is gathered in one place. Texts are read again by their draws.
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 4.0 * rows / max(1, r["texts"])))])
    own = own.where(F.col("lang").isin(*kinds) & ((F.col("draw") + 2.0**63) / 2.0**64 <= F.element_at(share, F.col("lang"))))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    picked = F.broadcast(own.select("lang", "draw").distinct().withColumn("place", place).where(F.col("place") <= rows).select("lang", "draw"))
    drawn = own.join(picked, ["lang", "draw"], "left_semi").dropDuplicates(["lang", "draw"]).select("lang", "text")

    def run(batches):
        sums = {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(k, np.zeros(BUCKETS, dtype=np.int64))
                for buckets in trigrams(t):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for k, n in sums.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], names=["lang", "bucket", "n"])

    counts = drawn.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(kinds) + 1, BUCKETS), smooth)
    table[-1] = 1.0
    at = {k: i for i, k in enumerate(kinds)}
    for r in counts.toLocalIterator():
        table[at[r["lang"]], r["bucket"]] += r["n"]
    return LanguageModel([*kinds, UND], np.log(table / table.sum(axis=1, keepdims=True)))


def page_evidence(html: Column, url: Column) -> tuple[Column, Column]:
    """(declared language, host) of a page: the lang attribute of its first html tag outside comments, and its address's host."""
    declared = F.lower(F.regexp_extract(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(declared != "", declared), F.when(host != "", host)


def page_text(html: Column) -> Column:
    """The text of a page, without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[A-Za-z0-9#]{1,8};", " ")


def identify_language(
    df: DataFrame,
    model: LanguageModel,
    text: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    right: float = 0.9,
    pull: float = 20.0,
    accept: float = 0.5,
    weight: float = 200.0,
) -> DataFrame:
    """All columns of ``df`` but ``text``, and language, probability, accepted, text_language, declared, host.

    ``language`` is the most probable one, the first by name among equals;
    ``accepted`` is false where that is ``und`` or its probability is under
    ``accept``. ``right`` is the probability that a declared language is right; an
    unknown or null one says nothing. ``pull`` is the weight in rows of the level
    above a host, domain or suffix. A null host has the prior of all rows. ``weight``
    is how many trigrams a text counts as at most. A text without
    trigrams says nothing itself, so only the other evidence counts; it is accepted
    only if that reaches ``accept``. Repeated rows are judged each and all count in
    the sums. Columns named as the new ones are replaced, in any case of letters.
    """
    import pyarrow as pa

    spark = ready(df.sparkSession)
    new = ["language", "probability", "accepted", "text_language", "declared", "host"]
    names = model.languages
    size = len(names)
    old = [c for c in df.columns if c != text and c.lower() not in new]
    null = F.lit(None).cast("string")
    # The frame's own columns go by numbers, so that no name can clash.
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(old)]
    rows = df.select(*own, F.col(text).alias("text"), (null if declared is None else declared).alias("said"), (null if host is None else host).alias("host"))
    where = rows.columns.index("text")
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            logs = np.array([model.evidence(x or "", weight) for x in batch.column(where).to_pylist()]).reshape(-1, size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(logs) + 1) * size, pa.int32()), pa.array(logs.ravel(), pa.float64()))
            rest = [i for i in range(batch.num_columns) if i != where]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], lists], names=[*[batch.schema.names[i] for i in rest], "logs"])

    heard = cut(rows.mapInArrow(run, rows.drop("text").withColumn("logs", F.lit(None).cast("array<double>")).schema))
    odds = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
    heard = heard.withColumn("odds", odds).withColumn("share", F.transform("odds", lambda x: x / F.aggregate("odds", F.lit(0.0), lambda a, y: a + y))).drop("odds")

    # Sums by host; domains and suffixes are summed from those of the hosts. A level that is the same as the one below it is none.
    each = lambda c: [F.sum(F.col(c)[i]) for i in range(size)]
    labels = F.split("host", r"\.")
    hosts = heard.where("host is not null").groupBy("host").agg(F.array(*each("share")).alias("n"))
    hosts = cut(hosts.withColumn("domain", F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), "."))).withColumn("suffix", F.when(F.size(labels) > 1, F.element_at(labels, -1))))
    total = heard.agg(F.array(*[F.coalesce(x, F.lit(0.0)) for x in each("share")]).alias("n")).first()["n"]
    by = lambda key, to: hosts.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*each("n")).alias(to))
    known = hosts.join(by("domain", "n_domain"), "domain", "left").join(by("suffix", "n_suffix"), "suffix", "left")
    less = lambda n, m: F.zip_with(n, m, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    whole = F.array(*[F.lit(float(x)) for x in total])
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smoothed = lambda n, above: F.zip_with(n, above, lambda x, p: (x + pull * p) / (add(n) + pull))
    base = lambda n: F.transform(n, lambda x: (x + 1) / (add(n) + size))
    inner = F.coalesce("n_domain", "n")
    known = known.withColumns({"all": base(less(whole, F.coalesce("n_suffix", "n"))), "s": F.when(F.col("n_suffix").isNotNull(), less(F.col("n_suffix"), inner)), "d": F.when(F.col("n_domain").isNotNull(), less(F.col("n_domain"), F.col("n")))})
    known = known.withColumn("above", F.when(F.col("s").isNotNull(), smoothed(F.col("s"), F.col("all"))).otherwise(F.col("all")))
    known = known.withColumn("above", F.when(F.col("d").isNotNull(), smoothed(F.col("d"), F.col("above"))).otherwise(F.col("above")))
    known = cut(known.select("host", "n", "above"))
    if known.count() * 16 * (size + 8) <= BROADCAST_BYTES:
        known = F.broadcast(known)  # else Spark shuffles, and splits the rows of common hosts
    out = heard.join(known, "host", "left")
    prior = F.when(F.col("n").isNotNull(), smoothed(less(F.col("n"), F.col("share")), F.col("above"))).otherwise(base(less(whole, F.col("share"))))

    kinds = F.array(*[F.lit(x) for x in names])
    said = F.lower("said")
    counts = F.array_contains(F.array(*[F.lit(x) for x in names[:-1]] or [F.lit("")]), said)
    wrong = (1 - right) / max(1, size - 1)
    tell = F.transform(kinds, lambda k: F.when(F.coalesce(counts, F.lit(False)), F.when(k == said, F.lit(right)).otherwise(F.lit(wrong))).otherwise(F.lit(1.0)))
    out = out.withColumn("prior", prior).withColumn("score", F.zip_with("logs", F.zip_with("prior", tell, lambda p, t: F.log(p) + F.log(t)), lambda x, y: x + y))
    place = F.array_position(F.col("score"), F.array_max("score"))
    text_place = F.array_position(F.col("logs"), F.array_max("logs"))
    probability = 1 / add(F.transform("score", lambda x: F.exp(x - F.array_max("score"))))
    language = F.element_at(kinds, place.cast("int"))
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(old)],
        language.alias("language"),
        probability.alias("probability"),
        ((language != UND) & (probability >= accept)).alias("accepted"),
        F.when(F.array_max("logs") != F.array_min("logs"), F.element_at(kinds, text_place.cast("int"))).alias("text_language"),
        F.col("said").alias("declared"),
        "host",
    )
