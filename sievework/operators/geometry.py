"""Table rows from cell geometry: segments, bands, row kinds, fills, guards, fragments and page audits.

Segments of a row are ``array<struct<x0:double,x1:double,text:string>>``, left to right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_prose_cell, leading_marker
from ..functions.values import band_of
from .aggregates import with_block_share
from .filters import cascade
from .joins import subset_assignment
from .windows import filled_forward

#: The six columns of a label table, those that hold doses, and the footer's form.
COLUMNS = ("crop", "pest_or_disease", "dose_ai", "dose_formulation", "dilution_water", "waiting_period_phi")
GUARDED = ("dose_ai", "dose_formulation", "dilution_water")
FOOTER = r"^\(?\d{1,4}\)?$"
NUMBERISH = r"^[\d.,%/+–—-]+$"


def merged_segments(cells: Column) -> Column:
    """Cells (x0, x1, text, right) as segments: cells without a rule at their right go on in the next one."""
    start = F.struct(F.array().cast("array<struct<x0:double,x1:double,text:string>>").alias("out"), F.lit(True).alias("closed"))

    def step(acc: Column, c: Column) -> Column:
        text = F.trim(F.replace(F.coalesce(c["text"], F.lit("")), F.lit("\n"), F.lit(" ")))
        fresh = F.struct(c["x0"].alias("x0"), c["x1"].alias("x1"), text.alias("text"))
        last = F.try_element_at(acc["out"], F.lit(-1))
        joined = F.struct(last["x0"].alias("x0"), c["x1"].alias("x1"), F.trim(F.concat_ws(" ", last["text"], text)).alias("text"))
        out = F.when(acc["closed"], F.concat(acc["out"], F.array(fresh))).otherwise(F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(joined)))
        return F.struct(out.alias("out"), F.coalesce(c["right"], F.lit(False)).alias("closed"))

    return F.aggregate(cells, start, step, lambda acc: acc["out"])


def content(segments: Column) -> Column:
    return F.filter(segments, lambda s: F.coalesce(s["text"], F.lit("")) != "")


def row_kind(segments: Column, bold: Column | None = None, least_bold: float = 0.9) -> Column:
    """What a row is by its segments with text; a bold row of two or more is a column header."""
    n = F.size(content(segments))
    first = F.coalesce(F.get(segments, F.lit(0))["text"], F.lit("")) != ""
    header = (n >= 2) & F.coalesce(bold >= least_bold, F.lit(False)) if bold is not None else F.lit(False)
    return (
        F.when(n == 0, "blank").when(header, "column_header").when((n == 1) & first, "chemical_header").when(n == 6, "ordinal_6").when(n < 6, "fallback_subset").otherwise("residual_over6")
    )


def merged_first_cell(segments: Column, boundaries: list[float]) -> Column:
    """Whether the first segment begins in the crop's band and reaches past the pest's."""
    first = F.get(segments, F.lit(0))
    return (F.coalesce(first["text"], F.lit("")) != "") & (F.size(content(segments)) >= 2) & (first["x0"] < boundaries[0]) & (first["x1"] > boundaries[1])


def assigned_columns(df: DataFrame, segments: str, centers: list[float], boundaries: list[float] | None = None, kind: str = "kind") -> DataFrame:
    """Adds the six columns of each row: by order if there are six segments, else by the nearest increasing bands.

    With ``boundaries`` a first cell that has swallowed the pest's keeps the crop's
    place, and the others share the bands from the third on.
    """
    full = df.withColumn("_c", content(F.col(segments))).withColumn("_mids", F.transform("_c", lambda s: (s["x0"] + s["x1"]) / 2))
    full = subset_assignment(full, "_mids", centers, "_bands")
    swallowed = F.lit(False)
    if boundaries is not None:
        swallowed = merged_first_cell(F.col(segments), boundaries) & (F.size("_c") <= len(centers) - 1)
        full = subset_assignment(full.withColumn("_tail", F.slice("_mids", F.lit(2), F.greatest(F.size("_mids") - 1, F.lit(0)))), "_tail", centers[2:], "_rest")
        full = full.withColumn("_bands", F.when(swallowed, F.concat(F.array(F.lit(0)), F.transform("_rest", lambda b: b + 2))).otherwise(F.col("_bands")))
    bands = F.when(F.col(kind) == "ordinal_6", F.sequence(F.lit(0), F.lit(5))).when((F.col(kind) == "fallback_subset") | swallowed, F.col("_bands"))
    full = full.withColumn("_bands", bands)
    cell = lambda i: F.coalesce(F.get("_c", F.array_position("_bands", i).cast("int") - 1)["text"], F.lit(""))
    pick = lambda i: F.when(F.array_contains("_bands", i), cell(i)).otherwise(F.lit(""))
    return full.withColumns({c: F.coalesce(pick(i), F.lit("")) for i, c in enumerate(COLUMNS)}).drop("_c", "_mids", "_bands", "_tail", "_rest")


def filled_crops(df: DataFrame, group: list[str], order: list[str], truncated: Column | None = None) -> DataFrame:
    """Fills crop and ingredient down the rows.

    A new section clears both; a chemical header names the ingredient and clears the
    crop. Column headers, rows of over six segments and truncated rows neither
    give nor get a value.
    """
    carries = ~F.col("kind").isin("column_header", "residual_over6") & ~F.coalesce(truncated if truncated is not None else F.lit(False), F.lit(False))
    first = F.col("section").eqNullSafe(F.lag("section").over(Window.partitionBy(*group).orderBy(*order))) & F.col("subsection").eqNullSafe(F.lag("subsection").over(Window.partitionBy(*group).orderBy(*order)))
    marked = df.withColumns({"_carries": carries, "_new": ~first, "_head": carries & (F.col("kind") == "chemical_header")})
    marked = marked.withColumns({"_crop": F.when(F.col("crop") != "", F.col("crop")), "_chem": F.when(F.col("_head"), F.get(content(F.col("segments")), F.lit(0))["text"])})
    out = filled_forward(marked, group, order, "_chem", "active_ingredient", reset=F.col("_new"), carries=F.col("_carries"))
    out = filled_forward(out, group, order, "_crop", "_filled", reset=F.col("_new") | F.col("_head"), carries=F.col("_carries"))
    return out.withColumns({"crop": F.coalesce("_filled", F.lit("")), "active_ingredient": F.coalesce("active_ingredient", F.lit(""))}).drop("_carries", "_new", "_head", "_crop", "_chem", "_filled")


def guarded_cells(df: DataFrame, block: list[str]) -> DataFrame:
    """Prose that landed in a dose column goes to ``method`` where its block is of that shape; elsewhere the row is marked ``guard_violation``.

    A block is of that shape if at least half of its rows have such prose.
    """
    prose = F.lit(False)
    for c in GUARDED:
        prose = prose | is_prose_cell(c)
    out = with_block_share(df.withColumn("_prose", prose), block, F.col("_prose"), "_shape")
    moved = F.concat_ws(" ", *[F.when(is_prose_cell(c), F.col(c)) for c in GUARDED])
    cleaned = {c: F.when(F.col("_shape") & is_prose_cell(c), F.lit("")).otherwise(F.col(c)) for c in GUARDED}
    return out.withColumn("method", F.when(F.col("_shape"), moved).otherwise(F.lit(""))).withColumn("guard_violation", F.col("_prose") & ~F.col("_shape")).withColumns(cleaned).drop("_prose", "_shape")


def quarantined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that go on, rows in quarantine with the first reason)."""
    return cascade(df, [("residual_over6", F.col("kind") == "residual_over6"), ("truncated_cell", F.coalesce(F.col("truncated"), F.lit(False))), ("type_guard", F.col("guard_violation"))], "reason_code")


def column_calibration(tables: DataFrame, group: list[str]) -> DataFrame:
    """(group, centers, boundaries): medians of the columns' middles and of the gaps between them over tables of six columns.

    ``tables`` has ``cols array<struct<x0:double,x1:double>>``.
    """
    clean = tables.where(F.size("cols") == 6)
    mids = [F.percentile((F.col("cols")[i]["x0"] + F.col("cols")[i]["x1"]) / 2, F.lit(0.5)) for i in range(6)]
    gaps = [F.percentile((F.col("cols")[i]["x1"] + F.col("cols")[i + 1]["x0"]) / 2, F.lit(0.5)) for i in range(5)]
    return clean.groupBy(*group).agg(F.count("*").alias("n_clean"), F.array(*mids).alias("centers"), F.array(*gaps).alias("boundaries"))


def evaluated_tables(tables: DataFrame, boundaries: list[float]) -> DataFrame:
    """Whether each table's populated columns (cols, populated) fall into the six bands one by one and in order."""
    bands = F.transform("cols", lambda c: band_of((c["x0"] + c["x1"]) / 2, boundaries))
    used = F.filter(F.zip_with(bands, "populated", lambda b, p: F.when(p, b)), lambda b: b.isNotNull())
    ordered = used == F.array_sort(used)
    return tables.withColumns({"band_of_col": bands, "monotonic": ordered, "resolves_cleanly": ordered & (F.array_distinct(used) == F.sequence(F.lit(0), F.lit(5))), "n_concat": F.size(used) - F.size(F.array_distinct(used))})


def collapsed_columns(row: Column, band_of_col: Column, bands: int = 6) -> Column:
    """A row's cells joined band by band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.concat_ws(" ", F.filter(F.zip_with(row, band_of_col, lambda c, i: F.when((i == b) & (F.trim(c) != ""), F.trim(F.replace(c, F.lit("\n"), F.lit(" "))))), lambda c: c.isNotNull())))


def cell_presence(rows: DataFrame, group: list[str], value: str, edges: str, start: float, tolerance: float = 25.0) -> DataFrame:
    """Whether a column exists in a table: any row's value says so, else an edge close to where it starts."""
    held = F.bool_or((F.trim(F.coalesce(F.col(value), F.lit(""))) != "") & (F.col("kind") != "column_header"))
    near = F.bool_or(F.exists(edges, lambda x: F.abs(x - start) <= tolerance) & (F.array_max(edges) >= start + 10))
    return rows.groupBy(*group).agg(F.when(held, F.lit(True)).otherwise(F.coalesce(near, F.lit(False))).alias("present"))


def footnotes(lines: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """(group, marker, definition): marked lines and the plain lines that follow, up to a footer or blank line; the last one of a marker counts.

    The first page holds no footnotes and is left out; ``lines`` has page and text.
    """
    body = lines.where("page > 1").withColumn("_m", leading_marker("text")).withColumn("_t", F.trim("text"))
    stops = (F.col("_t") == "") | F.col("_t").rlike(FOOTER) | (F.col("_t").rlike(r"^\*+$"))
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    part = body.withColumn("_block", F.sum((F.col("_m").isNotNull() | stops).cast("int")).over(w)).where(~stops)
    pos = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*order))
    text = part.withColumn("_p", pos).groupBy(*group, "_block").agg(F.max("_m.marker").alias("marker"), F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_m.body", "_t").alias("t")))).alias("_parts"))
    found = text.where("marker is not null").select(*group, "marker", "_block", F.array_join(F.transform("_parts", lambda x: x["t"]), " ").alias("definition"))
    return found.groupBy(*group, "marker").agg(F.max_by("definition", "_block").alias("definition"))


def with_footnotes(rows: DataFrame, notes: DataFrame, group: list[str], text: str) -> DataFrame:
    """Attaches the definitions of the markers in a text; ``unresolved_marker`` if one has none."""
    marks = rows.withColumn("_marks", F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\*{1,4})"), 1)))
    known = notes.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("marker", "definition"))).alias("_notes"))
    out = marks.join(known, group, "left").withColumn("_notes", F.coalesce("_notes", F.create_map().cast("map<string,string>")))
    found = F.filter(F.transform("_marks", lambda m: F.try_element_at("_notes", m)), lambda d: d.isNotNull())
    return out.withColumns({"footnote_text": F.array_join(found, " "), "unresolved_marker": F.size(found) < F.size("_marks")}).drop("_marks", "_notes")


def own_columns(df: DataFrame, raw: str = "raw_row_text", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Adds ``own_columns``: those whose value is one of the row's own segments and not filled in."""
    segs = F.split(F.coalesce(F.col(raw), F.lit("")), r" \|\| ")
    return df.withColumn("own_columns", F.filter(F.array(*[F.when((F.col(c) != "") & F.array_contains(segs, F.col(c)), F.lit(c)) for c in columns]), lambda c: c.isNotNull()))


def phantom_rows(df: DataFrame, group: list[str], page: str, order: str) -> DataFrame:
    """First rows of a page that go on with the row before: a dose column is empty and the crop isn't their own."""
    w = Window.partitionBy(*group).orderBy(F.col(page).cast("int"), order)
    first = F.row_number().over(Window.partitionBy(*group, page).orderBy(order)) == 1
    no_dose = F.lit(False)
    for c in GUARDED:
        no_dose = no_dose | (F.coalesce(F.col(c), F.lit("")) == "")
    previous = F.lag(F.col("kind")).over(w)
    fragment = first & previous.isNotNull() & ~F.col("kind").isin("chemical_header", "column_header") & no_dose & ~F.array_contains("own_columns", "crop")
    return own_columns(df).withColumns({"is_phantom": F.coalesce(fragment, F.lit(False)), "fragment_column": F.when(F.size("own_columns") == 1, F.get("own_columns", F.lit(0)))})


def line_zone(top: Column, bottom: Column, inside: Column, boxes: Column) -> Column:
    """Where a line lies against the union of boxes (x0, top, x1, bottom)."""
    middle = (top + bottom) / 2
    return (
        F.when(inside, "inside").when(F.coalesce(F.size(boxes), F.lit(0)) <= 0, "no-box")
        .when(middle < F.array_min(F.transform(boxes, lambda b: b["top"])), "above").when(middle > F.array_max(F.transform(boxes, lambda b: b["bottom"])), "below").otherwise("beside")
    )


def in_any_box(x: Column, y: Column, boxes: Column, pad: float = 2.0) -> Column:
    return F.exists(boxes, lambda b: x.between(b["x0"] - pad, b["x1"] + pad) & y.between(b["top"] - pad, b["bottom"] + pad))


def line_class(text: Column, zone: Column, has_rules: Column) -> Column:
    """Whether a line outside the tables is benign."""
    t = F.trim(text)
    words = F.split(t, r"\s+")
    numbers = F.size(F.filter(words, lambda w: w.rlike(NUMBERISH)))
    return (
        F.when(zone == "no-box", F.when(has_rules, "REAL").otherwise("benign-no-table-page")).when(t.rlike(FOOTER), "benign-footer")
        .when((zone == "above") & (F.size(words) <= 12) & (numbers <= 1), "benign-outside-table").otherwise("REAL")
    )


def has_grid(rules: Column) -> Column:
    """Whether a page's thin rules (w, h) make a grid: two or more in both directions."""
    across = F.size(F.filter(rules, lambda r: (r["h"] < 2) & (r["w"] > 50)))
    down = F.size(F.filter(rules, lambda r: (r["w"] < 2) & (r["h"] > 20) & ~((r["h"] < 2) & (r["w"] > 50))))
    return (across >= 2) & (down >= 2)


def bold_fraction(chars: Column) -> Column:
    """The share of a row's glyphs (text, font) in a bold font; null without glyphs."""
    seen = F.filter(chars, lambda c: F.trim(c["text"]) != "")
    return F.try_divide(F.size(F.filter(seen, lambda c: c["font"].contains("Bold"))).cast("double"), F.size(seen).cast("double"))


def row_bucket(cells: Column) -> Column:
    """What a row looks like by which of its cells hold text."""
    held = F.filter(F.transform(cells, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", i)), lambda i: i.isNotNull())
    return F.when(F.size(held) == 0, "empty").when(F.size(held) == 1, "full_width").when(F.array_contains(held, 0) & F.array_contains(held, 1), "distinct").otherwise("continuation")


def section_map(lines: DataFrame, group: list[str]) -> DataFrame:
    """The section of each page: its last heading, else the one before; the first page has none. ``lines`` is (page, line, heading)."""
    heads = lines.groupBy(*group, "page").agg(F.max_by("heading", F.when(F.col("heading").isNotNull(), F.col("line"))).alias("heading"))
    heads = heads.withColumn("heading", F.when(F.col("page") > 1, F.col("heading")))
    return filled_forward(heads, group, ["page"], "heading", "section").drop("heading")
