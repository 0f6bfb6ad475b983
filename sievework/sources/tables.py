"""Readers with declared schemas and the refusals that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RequiredInputMissing(RuntimeError):
    """A dimension without which nothing may be graded is absent, empty or malformed."""


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a heading, all columns strings; an empty cell is ``''`` and not null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    return raw.na.fill("")


def read_csv_typed(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV read as text and cast column by column; what doesn't cast, or is empty, is null."""
    raw = read_csv_text(spark, path, list(types))
    return raw.select(*[(F.col(c) if t == "string" else F.when(F.col(c) != "", F.col(c)).try_cast(t)).alias(c) for c, t in types.items()])


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Label facts from Parquet; a CSV is refused, as it can't tell 0 from nothing."""
    if not path.rstrip("/").lower().endswith(".parquet"):
        raise ValueError(f"label facts must be Parquet, got {path!r}")
    return spark.read.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_json_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_resumable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an interrupted run: a file's last line may be torn and is dropped, any other broken line fails.

    Files are read in splits; lines are ordered by their split's place in the file and
    their place in the split, and only the greatest of each file is forgiven.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("_at"), F.col("value").alias("_line"))
    parsed = lines.where("trim(_line) <> ''").withColumn("_row", F.from_json("_line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    parsed = parsed.withColumn("_torn", F.col("_row._corrupt_record").isNotNull())
    files = parsed.groupBy("_file").agg(F.count(F.when(F.col("_torn"), 1)).alias("_n"), F.max(F.when(F.col("_torn"), F.col("_at"))).alias("_last_torn"), F.max("_at").alias("_last"))
    broken = (F.col("_n") > 1) | ((F.col("_n") == 1) & (F.col("_last_torn") != F.col("_last")))
    fine = F.when(broken, F.raise_error(F.concat(F.lit("broken line in "), F.col("_file"))).cast("boolean")).otherwise(~F.col("_torn"))
    return parsed.join(files, "_file").where(fine).select("_row.*").drop("_corrupt_record")


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """``df``, failing at run time on a repeated key."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n"))
    return df.join(twice, key).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n").select(*df.columns)


def hashed_rows(df: DataFrame, parts: list[str], digest: str) -> DataFrame:
    """``df``, failing at run time where the digest of its parts isn't the recorded one."""
    good = F.sha2(F.concat(*[F.coalesce(F.col(p), F.lit("")) for p in parts]), 256) == F.col(digest)
    return df.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("a row doesn't match its digest")).cast("boolean")))


def required_dimension(spark: SparkSession, path: str, columns: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    """A small table that must be there; missing, empty or malformed it stops everything before a plan is built."""
    try:
        df = read_csv_text(spark, path, columns)
        bad = df.agg(F.count("*").alias("n"), *[F.count(F.when(~cond, 1)).alias(f"c{i}") for i, (_, cond) in enumerate(checks)]).first()
    except Exception as e:
        raise RequiredInputMissing(f"{path}: {str(e).splitlines()[0]}") from e
    if not bad["n"]:
        raise RequiredInputMissing(f"{path} has no rows")
    for i, (name, _) in enumerate(checks):
        if bad[f"c{i}"]:
            raise RequiredInputMissing(f"{path}: {bad[f'c{i}']} rows fail {name}")
    return df


def restriction_list(spark: SparkSession, path: str) -> DataFrame:
    columns = ["active_ingredient", "tier", "restricted_crops", "instrument", "date", "notes"]
    tier = F.lower(F.trim("tier")).isin("banned", "refused_registration", "restricted_use")
    return required_dimension(spark, path, columns, [("the list of tiers", tier)])


def optional_dimension(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A small table that may be absent: then it has no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return read_csv_text(spark, path, columns) if there else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))


def require_counts(counts: dict[str, int], found: dict[str, int]) -> None:
    """A stage's precondition: exact row counts of its inputs."""
    wrong = {k: (n, found.get(k)) for k, n in counts.items() if found.get(k) != n}
    if wrong:
        raise RuntimeError(f"row counts differ (expected, found): {wrong}")


def html_tables(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """The rows of the tables of HTML pages: (page_id, table, row, cells).

    The local stand-in for tables in other documents. Pages without a table give no
    rows; nested tables are read as part of the outer one.
    """
    import pandas as pd

    def run(batches):
        from html.parser import HTMLParser

        class Cells(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.depth, self.rows, self.held, self.tables = 0, [], None, []

            def handle_starttag(self, tag, attrs):
                if tag == "table":
                    self.depth += 1
                elif self.depth and tag == "tr":
                    self.rows.append([])
                elif self.depth and tag in ("td", "th") and self.rows:
                    self.held = []

            def handle_endtag(self, tag):
                if tag in ("td", "th") and self.held is not None:
                    self.rows[-1].append(" ".join("".join(self.held).split()))
                    self.held = None
                elif tag == "table" and self.depth:
                    self.depth -= 1
                    if not self.depth:
                        self.tables.append(self.rows)
                        self.rows = []

            def handle_data(self, data):
                if self.held is not None:
                    self.held.append(data)

        for pdf in batches:
            out = []
            for pid, text in zip(pdf["page_id"], pdf["html"], strict=True):
                if text and "<table" in text.lower():
                    parser = Cells()
                    parser.feed(text)
                    out += [(pid, t, r, cells) for t, rows in enumerate(parser.tables) for r, cells in enumerate(rows)]
            yield pd.DataFrame(out, columns=["page_id", "table", "row", "cells"])

    kind = dict(pages.dtypes)[page_id]
    return pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).mapInPandas(run, f"page_id {kind}, table int, row int, cells array<string>")


def html_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"&[A-Za-z0-9#]{1,8};", " "), r"\s+", " "))
