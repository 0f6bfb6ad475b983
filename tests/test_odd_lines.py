"""fragments_appended and its operator on lines that the given tables don't have."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import agree, tables
from pyspark.sql import functions as F

from sievework.operators import joins
from sievework.plans import registry

COLUMNS = {"l_orderkey": pa.int64(), "l_linenumber": pa.int32(), "l_partkey": pa.int64(), "l_quantity": pa.float64(), "l_linestatus": pa.string()}


def written(folder, rows):
    folder.mkdir()
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(COLUMNS.items())}), str(folder / "lineitem.parquet"))
    return str(folder)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, None, 10, 1.0, "O"), (1, 1, 20, 1.0, "F"), (1, 2, 30, 1.0, "F")],
        [(1, 1, None, 1.0, "O"), (1, 1, 20, 1.0, "F"), (1, 1, 30, 1.0, "O")],
        [(1, 1, 10, None, "O"), (1, 1, 10, 2.0, "F"), (1, 2, 30, 1.0, "F")],
        [(1, 1, None, 1.0, "O"), (1, 2, None, 1.0, "F"), (2, 1, None, 1.0, "F"), (2, 2, 20, 1.0, "F")],
        [(None, 1, 10, float("nan"), None), (None, 1, 10, None, "F"), (None, 1, 10, 5.0, None)],
    ],
)
def test_fragments_with_nulls_equal_sql(spark, tmp_path, rows):
    folder = written(tmp_path / "t", rows)
    assert agree(spark, folder, registry.queries()["fragments_appended"], registry.oracle_sql()["fragments_appended"], tables(folder))


def test_fragments_do_not_depend_on_the_order_of_equal_lines(spark, tmp_path):
    """What the SQL leaves open: DuckDB gives either order, so one is wanted here."""
    rows = [(1, 1, 5, 1.0, "O"), (1, 2, 7, 3.0, "O"), (1, 2, 7, 3.0, "F"), (1, 3, 9, 1.0, "F")]
    for i, some in enumerate((rows, rows[::-1])):
        got = registry.queries()["fragments_appended"](spark, written(tmp_path / str(i), some)).collect()
        assert sorted(map(tuple, got)) == [(1, 1, "5 7"), (1, 3, "7 9")]


def test_rows_of_equal_order_stay_rows(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 1, "b"), ("g", 2, "c")], "g string, o int, v string")
    got = joins.appended_to_previous(df, ["g"], ["o"], F.col("v") == "c", ["v"])
    assert sorted(map(len, (r["v"] for r in got.collect()))) == [1, 3]
