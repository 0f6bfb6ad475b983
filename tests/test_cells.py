"""Cells of label tables: waiting periods, products and pests, as printed and as read."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import cells
from sievework.functions.names import split_pests
from sievework.plans.fixtures import PEST_CELLS

DAYS = [
    ("0", 0), ("-", None), ("N/A", None), ("Not less than 21 weeks", 147), ("3 months", 90), ("4 weeks", 28), ("14-21", 21), ("3.5-4  months", 120), ("Sunday", None), ("3 Sunday", 3), ("2weeks", 14),
    ("10days", 10), ("3½ months", 105), ("½ month", 15), ("2¼ weeks", 15), ("1¾ months", 52), ("12 hrs", 1), ("24 hours", 1), ("48 hours", 2), ("1 hour", 1), ("Not less than7  weeks", 49), ("90day s", 90),
]
RAISED = ["5 years", "03 (day) or 48 (Hrs) Re-  entry period after each  application", "Aeration is waiting  Period 07 days to  be checked PH3 ", "IS:6313- 2001  (Part-2)", "Dilution in  water- 500  liter/ha", "90 %  Emergence  of earhead", "0 7"]
PESTS = [
    *PEST_CELLS, ("Fruit borer (Helicoverpa armigera) Thrips", ["Fruit borer (Helicoverpa armigera)", "Thrips"]), ("Jassids; Aphids/Thrips", ["Jassids", "Aphids", "Thrips"]),
    ("Anthracnose: Colletotrichum gloeosporioides", ["Anthracnose (Colletotrichum gloeosporioides)"]), ("Downy and Powdery mildew.", ["Downy mildew", "Powdery mildew"]), ("Alternaria spp. leaf spot", ["Alternaria spp leaf spot"]), (None, []),
]


def test_waiting_periods(spark):
    rows = [(c, d) for c, d in DAYS] + [(c, -1) for c in RAISED]
    got = spark.createDataFrame(rows, "c string, d int").select("c", "d", cells.waiting_period(F.col("c")).alias("p")).collect()
    assert [(r["c"], r["p"]["days"] if r["p"]["outcome"] != "raised" else -1) for r in got] == rows


@pytest.mark.parametrize("cell,names", PESTS)
def test_pests(cell, names):
    assert split_pests(cell) == names


def test_products(spark):
    rows = [("Bacillus 1.50% AS ( MTCC Accession no. 5786)", "ml", "5786"), ("Trichoderma viride 1% WP (Strain: TNAU-TV1)", "g", "TNAUTV1"), ("Beauveria 1.15% WP 1x10 CFU", "g", "BEAUVERIA115WP1X"), ("Plain 5% EC", "ml", ""), (None, None, "")]
    df = spark.createDataFrame(rows, "n string, u string, k string")
    assert [tuple(r) for r in df.select("n", cells.formulation_unit(F.col("n")), cells.strain_key(F.col("n"))).collect()] == rows
