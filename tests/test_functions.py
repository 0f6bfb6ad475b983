"""Expressions and small operators on hand-made rows."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sievework.functions import cells, names, records, text, values
from sievework.operators import aggregates, audits, geometry, joins, sets, windows


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,count", [(" a  b c ", 3), ("", 0), (None, 0), ("a b", 2)])
def test_word_count(spark, raw, count):
    assert one(spark, raw, text.word_count) == count


@pytest.mark.parametrize("raw,script", [("abc", "latin"), ("कपास ab", "devanagari"), ("కా a", "telugu"), ("123", "other"), (None, "other")])
def test_dominant_script(spark, raw, script):
    assert one(spark, raw, text.dominant_script) == script


def test_normal_forms(spark):
    assert one(spark, " A-b_c,  D\t!", text.normalized) == "a b_c d"
    assert one(spark, " A-b  C ", text.folded) == "a-b c"
    assert one(spark, None, text.normalized) == ""


def test_merged_single_letters(spark):
    merge = lambda c: text.merged_single_letters(F.split(c, " "))
    assert one(spark, "t omato a b c", merge) == ["tomato", "ab", "c"]


@pytest.mark.parametrize("a,b,place", [("abc", "abd", 2), ("ab", "abc", 2), ("", "x", 0), ("same", "same", None)])
def test_first_difference(spark, a, b, place):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(text.first_difference(F.col("a"), F.col("b")).alias("x")).first()["x"] == place


@pytest.mark.parametrize("line,marker,body", [("** note", "**", "note"), ("***", None, None), ("plain", None, None), ("*x*", "*", "x*")])
def test_leading_marker(spark, line, marker, body):
    got = one(spark, line, text.leading_marker)
    assert (got and (got["marker"], got["body"])) == (marker and (marker, body))


def test_prose_cell(spark):
    assert one(spark, "Apply the stuff at 50 gm per sq.m at the time of planting", text.is_prose_cell)
    assert not one(spark, "108 (Spiropidion 60 + Acetamiprid 48) - 135 (Spiropidion 75)", text.is_prose_cell)
    assert one(spark, "(1st spray when the insects reach their level. Repeat after 10 days)", text.is_prose_cell)


def test_per_acre_is_for_areas_only(spark):
    df = spark.createDataFrame([(3750.0, "per_ha"), (3750.0, "per_tree"), (None, "per_ha")], "v double, b string")
    assert [r[0] for r in df.select(values.per_acre(F.col("v"), F.col("b"))).collect()] == [1517.5428, None, None]


def test_consensus_and_weights(spark):
    df = spark.createDataFrame([(1, True), (1, True), (2, False), (3, True), (3, False), (4, None)], "k int, v boolean")
    got = dict(df.groupBy("k").agg(values.consensus_agg(F.col("v"))).collect())
    assert got == {1: "TRUE", 2: "FALSE", 3: "AMBIGUOUS", 4: None}
    assert spark.range(1).select(values.weighted_mean({"a": 1.0}, {"a": F.lit(None).cast("double")})).first()[0] == 1.0


@pytest.mark.parametrize("raw,unit", [("Acephate 75%SP", "g"), ("Chlorfenapyr 240 g/LSC", "ml"), ("Dazomet", None), (None, None), ("Bacillus 1.50% AS ( MTCC Accession no. 5786)", "ml"), ("Fenamidone 4.44%+ Fosetyl-AL 66.7%WDG", "g")])
def test_formulation_unit(spark, raw, unit):
    assert one(spark, raw, cells.formulation_unit) == unit


@pytest.mark.parametrize("raw,key", [("Downey mildew", "downy mildew"), ("podborer", "pod borer"), ("Thrips spp.", "thrips spp"), ("Early-blight!!", "early blight"), ("", "")])
def test_pest_key(spark, raw, key):
    assert one(spark, raw, names.pest_key) == key


def test_record_rules():
    dose = {"basis": "per_ha", "value_min": "5", "value_max": None, "unit": "g", "raw": ""}
    option = {"active_ingredient": "a", "formulation": "a", "dose": dose, "phi_days": None, "caution": ""}
    answer = {"in_scope": "yes", "query_understood": 1, "chemical_options": [option], "escalate_to_expert": False}
    import json

    got = records.check_record(json.dumps(answer))
    assert got["errors"] == ["answer: unknown PHI requires escalate_to_expert=True"]
    assert records.check_record(json.dumps(answer | {"escalate_to_expert": True}))["is_valid"]
    assert not records.check_record("[]")["is_valid"] and records.check_record("5")["is_json"]
    assert not records.check_record(None)["is_json"]
    assert len(records.check_record(json.dumps(answer | {"in_scope": "maybe"}))["errors"]) == 1
    assert records.unwrapped('{"Advisory": {"a": 1}}') == '{"a": 1}' and records.unwrapped('{"Advisory": 1}') is None


def test_subset_assignment_prefers_near_bands(spark):
    df = spark.createDataFrame([(1, [12.0, 52.0]), (2, []), (3, [float(i) for i in range(7)])], "k int, m array<double>")
    got = dict(joins.subset_assignment(df, "m", [5.0, 15.0, 25.0, 35.0, 45.0, 55.0]).select("k", "bands").collect())
    assert got == {1: [1, 5], 2: [], 3: None}


def test_lines_by_their_first_word(spark):
    words = spark.createDataFrame([(1, 10.0, 5.0, 9.0, "b"), (1, 12.0, 0.0, 4.0, "a"), (1, 14.5, 0.0, 3.0, "c")], "page int, top double, x0 double, x1 double, text string")
    got = [(r["line"], r["text"]) for r in windows.lines_of_words(words, ["page"]).orderBy("line").collect()]
    assert got == [(0, "a b"), (1, "c")]


def test_sign_test_and_bootstrap(spark):
    assert aggregates.sign_test(0, 0) == 1.0 and math.isclose(aggregates.sign_test(8, 2), 0.109375)
    df = spark.createDataFrame([("x", i, float(i % 3)) for i in range(60)], "g string, i int, diff double")
    row = aggregates.bootstrap_interval(df, ["g"], ["i"], 500).first()
    assert row["n"] == 60 and row["low"] < 1.0 < row["high"]


def test_sign_test_of_many_pairs():
    def whole(wins, losses):
        n = wins + losses
        term = tail = 1
        for k in range(min(wins, losses)):
            term = term * (n - k) // (k + 1)
            tail += term
        return float(min(Fraction(1), Fraction(2 * tail, 2**n)))

    for wins, losses in [(501, 500), (499, 501), (502, 500), (900, 102), (1001, 1), (1002, 0), (2600, 2400), (10300, 9700), (1, 19_999)]:
        assert math.isclose(aggregates.sign_test(wins, losses), whole(wins, losses), rel_tol=1e-15)
    # So many that term by term no test ends: against the normal distribution, which is off by about 1 / n.
    assert math.isclose(aggregates.sign_test(4_503_000, 4_497_000), math.erfc(5999 / math.sqrt(18e6)), rel_tol=1e-6)


def test_merged_parts_refuse_repeats(spark):
    part = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    assert sets.merged_parts([part.where("k = 1"), part.where("k = 2")], "k", "p", {"a": 1}).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        sets.merged_parts([part, part], "k", "p").collect()


def test_segments_and_kinds(spark):
    cells_type = "array<struct<x0:double,x1:double,text:string,right:boolean>>"
    df = spark.createDataFrame([(1, [(0.0, 1.0, "a", False), (1.0, 2.0, "b", True), (2.0, 3.0, "", True)])], f"k int, c {cells_type}")
    row = df.select(geometry.merged_segments(F.col("c")).alias("s")).withColumn("kind", geometry.row_kind(F.col("s"))).first()
    assert [tuple(s) for s in row["s"]] == [(0.0, 2.0, "a b"), (2.0, 3.0, "")] and row["kind"] == "chemical_header"


def test_dose_error_classes(spark):
    rows = [(500.0, None, "g", 390.0, None, "g", 1.3, "WRONG_HIGH"), (390.0, None, "ml", 390.0, None, "g", 1.0, "UNIT_DIMENSION_MISMATCH"), (405.0, None, "g", 390.0, None, "g", 0.4, "WITHIN_8PC_ROUNDING_EDGE"), (975.0, None, "g", 395.0, None, "g", 1.0, "PER_HA_NUMBER_LABELLED_PER_ACRE")]
    df = spark.createDataFrame(rows, "s double, t double, su string, l double, h double, u string, o double, want string")
    got = df.select(audits.dose_error(*[F.col(c) for c in ("s", "t", "su", "l", "h", "u", "o")]).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


def test_gold_records_without_practices(spark):
    from sievework.operators import generation
    from sievework.plans import fixtures

    lab = fixtures.labels(spark)
    got = generation.gold_records(lab.pests.join(lab.rows.where("label_idx = 9"), "label_idx")).select("gold").collect()
    cause = got[0]["gold"]["likely_causes"][0]
    assert (cause["type"], cause["evidence"], got[0]["gold"]["non_chemical_first"]) == ("disease", "", [])


def test_transcription_and_survey(spark):
    names = spark.createDataFrame([("A-b 1",), ("zz",), ("",), ("longer name",)], "n string")
    text = spark.createDataFrame([("x ab1 y",), ("Longer, name!",), (None,)], "t string")
    assert dict(audits.transcription_check(names, "n", text, "t").collect()) == {"A-b 1": True, "zz": False, "": True, "longer name": True}
    df = spark.createDataFrame([(str(i % 8), i % 2) for i in range(40)], "v string, p int")
    got = audits.survey(df, "v", F.col("p"), examples=3).orderBy("pattern").collect()
    assert [(r["n_values"], r["n_rows"], r["examples"]) for r in got] == [(4, 20, ["0", "2", "4"]), (4, 20, ["1", "3", "5"])]


def test_cosine_pairs_in_blocks(spark):
    import numpy as np

    from sievework.operators import dedup

    rng = np.random.default_rng(6)
    rows = [(i, int(i % 7 == 0), [float(x) for x in rng.normal(size=4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, k int, v array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    key = {i: k for i, k, _ in rows}
    cos = {(i, j): float(unit[i] @ unit[j]) for i in unit for j in unit if i < j and key[i] == key[j]}
    wanted = {p for p, c in cos.items() if c > 0.6}
    got = dedup.cosine_pairs(df, "k", "id", "v", 0.6, top=None, block_rows=7)
    assert {(r["a"], r["b"]) for r in got.collect()} == wanted
    near = {i: sorted((j for j in unit if key[j] == key[i]), key=lambda j: (-unit[i] @ unit[j], j))[:4] for i in unit}
    top = {p for p in wanted if p[1] in near[p[0]] or p[0] in near[p[1]]}
    assert {(r["a"], r["b"]) for r in dedup.cosine_pairs(df, "k", "id", "v", 0.6, top=4, block_rows=7).collect()} == top


def test_terms_by_their_first_words(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one two three four five"), (2, "Two, three"), (3, None), (1, "five one")], "id int, t string")
    terms = spark.createDataFrame([("two three",), ("one two three four five",), ("five",), ("three five",), ("",)], "term string")
    wanted = sorted([(1, "two three"), (1, "one two three four five"), (1, "five"), (2, "two three"), (1, "five")])
    for most in (2000, 0):
        monkeypatch.setattr(joins, "_FIRST_WORDS", most)
        assert sorted(tuple(r) for r in joins.term_matches(texts, terms, "id", "t", "term", longest=2).select("id", "term").collect()) == wanted


def test_tightened_schema():
    from sievework.operators.reviews import tightened

    schema = {"type": "object", "title": "x", "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"title": {"type": "string", "default": ""}}}}, "b": {"type": "string"}}}
    inner = {"type": "object", "properties": {"title": {"type": "string"}}, "additionalProperties": False, "required": ["title"]}
    assert tightened(schema) == {"type": "object", "properties": {"a": {"type": "array", "items": inner}, "b": {"type": "string"}}, "additionalProperties": False, "required": ["a", "b"]}


def test_refilled_doses_report_what_moved(spark):
    from sievework.operators.reviews import refilled_doses

    df = spark.createDataFrame([(1, "500", "A 5% EC"), (2, "500 g", "A 5% EC"), (3, None, None), (4, "5", None)], "k int, c string, i string")
    kept, moved = refilled_doses(df, "k", "c", "i")
    assert sorted((r["k"], r["dose_unit"], r["dose_code"]) for r in kept.collect()) == [(1, "ml", ""), (2, "g", ""), (3, "", "UNRECOGNISED"), (4, "", "NEEDS_UNIT")]
    assert moved.count() == 0
