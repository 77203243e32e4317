import pytest
from hypothesis import given

import quasirisk.plans.lookup as lookup
from quasirisk import (
    cell_information_gain,
    gain_long,
    gain_matrix,
    gain_summary,
    gain_totals,
    information_gain,
    personal_information_factor,
)
from quasirisk.functions import safe_level
from tests.brute_force import cell_gains, percentile
from tests.test_risk import SCHEMA, SLOW, plain, small

QI = ["fee", "branch", "genre"]


def test_loans(loans):
    rows = {r["id"]: r for r in cell_information_gain(loans, QI, "id").collect()}
    first = rows[0]
    assert [round(first[f"cig_{c}"], 6) for c in QI] == [0.584963, 1.0, 0.0]
    assert [round(rows[i]["RIG"], 6) for i in range(6)] == [1.584963, 4.169925, 2.584963, 3.377444, 4.169925, 2.377444]


@SLOW
@given(rows=small)
def test_gains_against_definition(spark, rows):
    qi = ["a", "b", "c"]
    expected = cell_gains(plain(rows), qi)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + SCHEMA)
    for r in cell_information_gain(df, qi, "id").collect():
        want = expected[r["id"]]
        assert [r[f"cig_{c}"] for c in qi] == pytest.approx([want[c] for c in qi], abs=1e-9)
        assert r["RIG"] >= 0
    gains = information_gain(df, qi)
    rig = [sum(g.values()) for g in expected]
    pif = personal_information_factor(gains, 90).first()["pif"]
    assert pif == pytest.approx(percentile(rig, 0.9), abs=1e-9)
    totals = {r["column"]: r["total"] for r in gain_totals(gains).collect()}
    assert totals == pytest.approx({c: sum(g[c] for g in expected) for c in qi}, abs=1e-9)


def test_heavy_keys_take_both_ways(spark, monkeypatch):
    """One combination holds a third of the rows; nothing fits the broadcast limit."""
    rows = [(i, 0, "x") for i in range(100)] + [(100 + i, i % 40, f"v{i % 30}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a long, b string")
    plain_result = {r["id"]: r["RIG"] for r in cell_information_gain(df, ["a", "b"], "id").collect()}
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "HOT_SHARE", 4)
    split = {r["id"]: r["RIG"] for r in cell_information_gain(df, ["a", "b"], "id").collect()}
    assert len(split) == 300
    assert split == pytest.approx(plain_result)


def test_signed_zero_and_null_keys_without_broadcast(spark, monkeypatch):
    rows = [(0, 0.0, None), (1, -0.0, None), (2, 0.0, "x"), (3, None, "x"), (4, float("nan"), "x"), (5, 1.0, "y")]
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "HOT_SHARE", 1)
    df = spark.createDataFrame(rows, "id long, a double, b string")
    plain_rows = [{"a": None if a != a else a, "b": b} for _, a, b in rows]
    want = [sum(g.values()) for g in cell_gains(plain_rows, ["a", "b"])]
    got = {r["id"]: r["RIG"] for r in cell_information_gain(df, ["a", "b"], "id").collect()}
    assert [got.get(i) for i in range(6)] == pytest.approx(want, abs=1e-9)


def test_masks(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, 1, "-999"), (2, 2, None), (3, -999, "y")], "id long, a long, b string")
    nulls = {r["id"]: r for r in cell_information_gain(df, ["a", "b"], "id", mask_nulls=True).collect()}
    assert nulls[0]["cig_a"] == 0.0 and nulls[2]["cig_b"] == 0.0 and nulls[1]["cig_a"] > 0
    assert nulls[0]["RIG"] == nulls[0]["cig_b"]
    numbers = {r["id"]: r for r in cell_information_gain(df, ["a", "b"], "id", mask_values=[-999]).collect()}
    assert numbers[3]["cig_a"] == 0.0 and numbers[1]["cig_b"] > 0 and numbers[0]["cig_a"] > 0
    text = {r["id"]: r for r in cell_information_gain(df, ["a", "b"], "id", mask_values=["-999"]).collect()}
    assert text[1]["cig_b"] == 0.0 and text[3]["cig_a"] > 0


def test_summary_and_matrix(spark):
    gains = spark.createDataFrame([(i, float(i), float(i * i), 0.0) for i in range(5)], "id long, cig_x double, cig_y double, RIG double")
    got = {r["column"]: r for r in gain_summary(gains, weight=None).collect()}
    assert set(got) == {"x", "y"}
    x = got["x"]
    assert [x[c] for c in ("mean", "min", "p25", "p50", "p75", "max")] == [2.0, 0.0, 1.0, 2.0, 3.0, 4.0]
    assert x["std"] == pytest.approx(1.5811388300841898)
    assert (x["is_top"], got["y"]["is_top"]) == (False, True)
    shown = {r["column"]: r for r in gain_summary(gains, weight=None, digits=2).collect()}
    assert (shown["x"]["std"], shown["x"]["mean"], shown["y"]["is_top"]) == (1.58, 2.0, True)
    assert gain_matrix(gains, "id").columns == ["id", "x", "y"]
    assert gain_long(gains, ["id"]).count() == 10


def test_percentile_of_given_scores(spark):
    scores = spark.createDataFrame([(float(i),) for i in range(5)], "RIG double")
    row = personal_information_factor(scores, 50, weight=None).first()
    assert (row["pif"], row["safe_level"]) == (2.0, 1)
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            personal_information_factor(scores, bad, weight=None)


def test_safe_levels(spark):
    values = [2.0, 1.0, 0.99, 0.33, 0.32, 0.11, 0.1, 0.04, 0.03, 0.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(safe_level(df.v)).collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, None]
