"""Joins and lookups: prioritised, narrowing, theta and alignment joins.

Sides are small or large as the data are; no operator here forces a broadcast,
so Spark decides by size.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_term, let, normalized


#: Up to so many words that terms begin with are looked for before runs are formed.
_FIRST_WORDS = 2000


def first_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``: what a lookup keeps when keys repeat."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def prioritised(df: DataFrame, views: Iterable[tuple[str, DataFrame, list[str]]], out: list[str], how: str = "confidence") -> DataFrame:
    """Left joins tried in order; the first view with a hit gives ``out`` and its name as ``how``.

    A view is (name, frame, key columns that both sides have); its keys are unique.
    """
    names, hits = [], []
    for i, (name, view, keys) in enumerate(views):
        hit = f"_hit{i}"
        side = view.select(*[F.col(k).alias(f"_{i}_{k}") for k in keys], F.struct(*out).alias(hit))
        cond = [df[k] == side[f"_{i}_{k}"] for k in keys] if not i else [F.col(k) == F.col(f"_{i}_{k}") for k in keys]
        df = df.join(side, cond, "left").drop(*[f"_{i}_{k}" for k in keys])
        names.append((name, hit))
        hits.append(F.col(hit))
    best = F.coalesce(*hits)
    label = F.lit(None).cast("string")
    for name, hit in reversed(names):
        label = F.when(F.col(hit).isNotNull(), F.lit(name)).otherwise(label)
    return df.withColumns({c: best[c] for c in out} | {how: label}).drop(*[h for _, h in names])


def keep_if_any(df: DataFrame, group: list[str], hit: Column) -> DataFrame:
    """Narrows each group to its hits where it has some; a group without a hit stays whole."""
    w = Window.partitionBy(*group)
    marked = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return marked.withColumn("_any", F.max("_hit").over(w)).where("_hit or not _any").drop("_hit", "_any")


def narrow(df: DataFrame, group: list[str], hits: Iterable[Column]) -> DataFrame:
    """``keep_if_any`` for each condition in turn. Groups of one row stay as they are, as no condition can empty them."""
    for hit in hits:
        df = keep_if_any(df, group, hit)
    return df


def term_matches(texts: DataFrame, terms: DataFrame, text_id: str, text: str, term: str, key: str | None = None, longest: int = 8) -> DataFrame:
    """Pairs of a text and a term that it contains between word borders.

    Texts and terms are compared in normal form. Runs of up to ``longest`` words meet
    the terms by an equi-join; the rare terms with more words are looked for in the
    texts that hold their first ``longest`` words. Where the terms begin with few
    words, ``_FIRST_WORDS`` at most, only runs that begin with one of them are formed.
    With ``key``, both sides must agree in that column.
    """
    keys = [key] if key else []
    known = terms.withColumn("_term", normalized(term)).where("_term <> ''").withColumn("_size", F.size(F.split("_term", " ")))
    known = known.withColumn("_run", F.array_join(F.slice(F.split("_term", " "), 1, longest), " "))
    firsts = [r[0] for r in known.select(F.substring_index("_term", " ", 1)).distinct().limit(_FIRST_WORDS + 1).collect()]
    begins = (lambda w: w.isin(*firsts)) if len(firsts) <= _FIRST_WORDS else (lambda w: F.lit(True))

    def runs(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(begins(w), i + 1)), lambda i: i.isNotNull())
        return F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice(words, i, n), " ")))))

    # An outer explode, as Spark would work the words out once more to filter texts without a run.
    asked = texts.select(text_id, *keys, F.explode_outer(let(F.split(normalized(text), " "), runs)).alias("_run")).where("_run is not null")
    met = asked.join(known, [*keys, "_run"])
    if known.where(F.col("_size") > longest).isEmpty():
        return met.drop("_run", "_term", "_size")
    # Only for terms of more words are the whole texts looked at again.
    long = met.where(F.col("_size") > longest).join(texts.select(text_id, normalized(text).alias("_plain")), text_id)
    long = long.where(has_term(F.col("_plain"), F.col("_term"))).drop("_plain")
    return met.where(F.col("_size") <= longest).unionByName(long).drop("_run", "_term", "_size")


def longest_term(matches: DataFrame, text_id: str, term: str) -> DataFrame:
    """Of each text's terms the longest, equal ones by the term itself."""
    w = Window.partitionBy(text_id).orderBy(F.length(term).desc(), term)
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def term_list(matches: DataFrame, text_id: str, term: str, out: str = "terms") -> DataFrame:
    """Each text's terms, sorted and joined by ``;``."""
    return matches.groupBy(text_id).agg(F.array_join(F.array_sort(F.collect_set(term)), ";").alias(out))


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Left join to the half-open ranges [low, high) that hold the value.

    Both sides go through cells of ``width``, so it's an equi-join with a check
    and not a nested loop. Ranges must be bounded.
    """
    cells = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    side = ranges.select("*", cells.alias("_cell"))
    here = df.withColumn("_at", F.floor(F.col(value) / width))
    cond = (F.col("_at") == F.col("_cell")) & (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    return here.join(side, cond, "left").drop("_at", "_cell")


def applicable_restrictions(parts: DataFrame, restrictions: DataFrame, hard: Iterable[str] = ("banned", "refused_registration")) -> DataFrame:
    """Restrictions that hit a named component on a crop.

    ``parts`` is (.., component, crop_slug); ``restrictions`` has a normalised
    ``name``, ``tier`` and the array ``crops``. Hard tiers and empty crop lists hit
    everywhere.
    """
    met = parts.join(restrictions, F.col("component") == F.col("name"))
    crop = F.lower(F.trim(F.coalesce(F.col("crop_slug"), F.lit(""))))
    return met.where(F.col("tier").isin(*hard) | (F.size("crops") == 0) | F.array_contains("crops", crop))


def preferred_hit(hits: DataFrame, group: list[str], preferred: Column, order: list[str]) -> DataFrame:
    """One hit for each group: one that is preferred if there is one, else the first by ``order``."""
    rest = [c for c in hits.columns if c not in group]
    rank = F.struct((~F.coalesce(preferred, F.lit(False))).alias("_p"), *order)
    return hits.groupBy(*group).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(*group, "_row.*")


def must_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails at run time where a left row has no partner."""
    side = right.withColumn("_there", F.lit(True))
    message = F.concat(F.lit("no partner for "), F.concat_ws(",", *keys))
    joined = left.join(side, keys, "left")
    return joined.where(F.coalesce(F.col("_there"), F.raise_error(message).cast("boolean"))).drop("_there")


def _digest(key: Column) -> Column:
    return F.unhex(F.sha2(key.cast("string"), 256))


def leaked(test: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """Rows of ``test`` whose key also occurs in ``train``. Digests are compared, so long keys don't travel; a null key never leaks."""
    seen = train.select(_digest(key).alias("_key")).distinct()
    return test.withColumn("_key", _digest(key)).join(seen, "_key", "left_semi").drop("_key")


def without_leaks(test: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """The other rows of ``test``."""
    seen = train.select(_digest(key).alias("_key")).distinct()
    return test.withColumn("_key", _digest(key)).join(seen, "_key", "left_anti").drop("_key")


def with_responses(items: DataFrame, responses: DataFrame, key: str = "item_id") -> DataFrame:
    """All items with their responses; ``missing`` marks those without. An unknown response id fails at run time."""
    known = items.select(key).withColumn("_known", F.lit(True))
    marked = responses.join(known, key, "left")
    checked = marked.where(F.coalesce(F.col("_known"), F.raise_error(F.concat(F.lit("unknown response id: "), F.col(key).cast("string"))).cast("boolean"))).drop("_known")
    return items.join(checked.withColumn("_there", F.lit(True)), key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, diff) of the items that both arms have."""
    one, two = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return one.join(two, key).withColumn("diff", F.col("a") - F.col("b"))


def appended_to_previous(df: DataFrame, group: list[str], order: list[str], is_fragment: Column, columns: list[str]) -> DataFrame:
    """Fragment rows are appended, cell by cell, to the row before them and dropped.

    Several fragments in a row all go to the last row that is none. A group that
    begins with a fragment keeps it as a row. A cell is null where none of its parts
    has a value.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    marked = df.withColumn("_frag", F.coalesce(is_fragment, F.lit(False)) & (F.row_number().over(w) > 1)).withColumn("_pos", F.row_number().over(w))
    block = marked.withColumn("_block", F.sum(F.when(F.col("_frag"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = [c for c in df.columns if c not in columns and c not in group]
    cells = lambda c: F.array_sort(F.collect_list(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_pos", F.col(c).alias("v")))))
    parts = block.groupBy(*group, "_block").agg(*[F.min_by(c, "_pos").alias(c) for c in rest], *[F.when(F.count(c) > 0, F.array_join(F.transform(cells(c), lambda x: x["v"]), " ")).alias(c) for c in columns])
    return parts.select(*df.columns)


def segments_to_columns(df: DataFrame, segments: str, columns: list[str], out: str = "segment_columns") -> DataFrame:
    """For each segment the first column, not yet used, that holds exactly its text; null if there is none."""
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("got"))

    def step(acc: Column, seg: Column) -> Column:
        hit = F.coalesce(*[F.when((F.col(c) == seg) & ~F.array_contains(acc["used"], c), F.lit(c)) for c in columns], F.lit(None).cast("string"))
        return F.struct(F.when(hit.isNotNull(), F.concat(acc["used"], F.array(hit))).otherwise(acc["used"]).alias("used"), F.concat(acc["got"], F.array(hit)).alias("got"))

    return df.withColumn(out, F.aggregate(F.coalesce(F.col(segments), F.array().cast("array<string>")), start, step, lambda acc: acc["got"]))


def content_union(parts: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows of each group once by content, the first by ``order`` kept."""
    content = F.sha2(F.to_json(F.struct(*[c for c in parts.columns if c not in group and c not in order])), 256)
    w = Window.partitionBy(*group, "_content").orderBy(*order)
    return parts.withColumn("_content", content).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_content", "_n")


def subset_assignment(df: DataFrame, mids: str, centers: list[float], out: str = "bands") -> DataFrame:
    """Puts a row's k segments, left to right, into k of the given bands with the least total distance.

    ``mids`` is the array of the segments' middles. All increasing choices of bands
    are a fixed list, 2 to the power of the number of bands, that each row reduces
    on its own. Of equal costs the first choice in dictionary order wins. More
    segments than bands give null, none an empty array.
    """
    from itertools import combinations

    n = len(centers)
    combos = {k: F.array(*[F.array(*[F.lit(i) for i in c]) for c in combinations(range(n), k)]) for k in range(1, n + 1)}
    places = F.array(*[F.lit(float(c)) for c in centers])
    m = F.col(mids)
    cost = lambda combo: F.aggregate(F.zip_with(m, combo, lambda x, i: F.abs(x - F.get(places, i))), F.lit(0.0), lambda a, x: a + x)
    chain = F.when(F.size(m) == 0, F.array().cast("array<int>"))
    for k, options in combos.items():
        ranked = F.transform(options, lambda combo, i: F.struct(cost(combo).alias("cost"), i.alias("i"), combo.alias("combo")))
        chain = chain.when(F.size(m) == k, F.array_min(ranked)["combo"])
    return df.withColumn(out, chain)
