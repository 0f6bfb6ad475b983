"""Readers, writers and streams."""

import pytest
from pyspark.sql import functions as F

from sievework.sources import sinks, tables
from sievework.streaming import streams


def test_csv_keeps_empty_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,\n2,"x ""y"""\n')
    got = tables.read_csv_text(spark, str(tmp_path / "a.csv"), ["k", "v"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("1", ""), ("2", 'x "y"')]
    typed = tables.read_csv_typed(spark, str(tmp_path / "a.csv"), {"k": "int", "v": "string"}).orderBy("k").collect()
    assert [tuple(r) for r in typed] == [(1, ""), (2, 'x "y"')]


def test_refusals(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_facts(spark, "facts.csv")
    with pytest.raises(tables.RequiredInputMissing):
        tables.restriction_list(spark, str(tmp_path / "none.csv"))
    (tmp_path / "bad.csv").write_text("active_ingredient,tier,restricted_crops,instrument,date,notes\nX,odd,,,,\n")
    with pytest.raises(tables.RequiredInputMissing):
        tables.restriction_list(spark, str(tmp_path / "bad.csv"))
    assert tables.optional_dimension(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0


def test_torn_last_line_is_dropped(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"item_id": "a"}\n{"item_id": "b"}\n{"item_')
    assert tables.read_resumable(spark, str(tmp_path / "ok.jsonl"), "item_id string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"item_\n{"item_id": "b"}\n')
    with pytest.raises(Exception, match="broken line"):
        tables.read_resumable(spark, str(tmp_path / "bad.jsonl"), "item_id string").collect()


def test_html_tables(spark):
    page = spark.createDataFrame([(1, "<p>x</p><table><tr><th>a</th><td>b &amp; c</td></tr><tr><td>d</td></tr></table>"), (2, None)], "page_id bigint, html string")
    assert [(r["row"], r["cells"]) for r in tables.html_tables(page).orderBy("row").collect()] == [(0, ["a", "b & c"]), (1, ["d"])]


def test_replace_and_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(3), path)
    sinks.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        sinks.write(spark.range(1), path)
    m = str(tmp_path / "m.json")
    sinks.run_manifest(spark, m, {"model": "x"}, {"n": 1})
    assert len(sinks.run_manifest(spark, m, {"model": "x"}, {"n": 2})["sessions"]) == 2
    with pytest.raises(RuntimeError):
        sinks.run_manifest(spark, m, {"model": "y"}, {})


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.table_stream(spark, str(tmp_path / "in"), events.schema)
    got = streams.drained(streams.first_within(stream, "ts", "400 days", "user_id", "event_type"), "firsts")
    assert got.count() == events.select("user_id", "event_type").distinct().count()
    counts = streams.drained(streams.windowed_counts(stream, "ts", "1 hour", "1 day", ["event_type"]), "counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
