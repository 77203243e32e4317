import math

import numpy as np
import pytest
from hypothesis import given
from pyspark.sql import functions as F

import quasirisk.operators.search as search
import quasirisk.operators.suda as suda
import quasirisk.plans.lookup as lookup
from quasirisk import (
    attribute_contributions,
    attribute_level_contributions,
    category_codes,
    encode_categories,
    minimal_sample_uniques,
    record_contributions,
    rounded,
    suda_record_table,
    suda_scores,
)
from quasirisk.operators.suda import msu_weights
from tests.brute_force import msus
from tests.test_risk import SCHEMA, SLOW, plain, small

QI = ["fee", "branch", "genre"]


def found_sets(df, qi, **options):
    found = {}
    for r in minimal_sample_uniques(df, qi, "id", **options).collect():
        found.setdefault(r["id"], set()).add(tuple(r["msu"].split(", ")))
    return found


def test_loans(loans):
    assert found_sets(loans, QI) == {
        0: {("fee", "genre")}, 2: {("fee", "genre"), ("branch", "genre")}, 3: {("branch",)}, 5: {("fee", "branch")},
    }
    scores = {r["id"]: r for r in suda_scores(loans, QI, "id").collect()}
    assert [scores[i]["score"] for i in range(6)] == [1.0, 0.0, 2.0, 2.0, 0.0, 1.0]
    theta = 0.2 * 4 / (0.2 * 4 + 1.6)
    assert scores[2]["dis_score"] == round(2 * theta * 4 / 6, 4)


@SLOW
@given(rows=small)
def test_msus_against_definition(spark, rows):
    qi = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + SCHEMA)
    expected = {i: set(s) for i, s in msus(plain(rows), qi).items() if s}
    assert found_sets(df, qi) == expected
    usable = lambda row, col: row[col] is not None
    expected = {i: set(s) for i, s in msus(plain(rows), qi, usable).items() if s}
    assert found_sets(df, qi, missing_nulls=True) == expected


@pytest.mark.parametrize("class_rows", [50_000, 6])
def test_recursive_search_agrees(spark, monkeypatch, class_rows):
    rows = [(i, i % 2, i % 3, i % 5, i // 4, None if i % 7 == 0 else i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a long, b long, c long, d long, e long")
    qi = list("abcde")
    expected = {i: set(s) for i, s in msus([dict(zip(["id", *qi], r)) for r in rows], qi).items() if s}
    assert found_sets(df, qi) == expected
    capped = {i: {s for s in sets if len(s) <= 2} for i, sets in expected.items()}
    capped = {i: s for i, s in capped.items() if s}
    monkeypatch.setattr(suda, "ONE_PASS_SUBSETS", 0)
    monkeypatch.setattr(search, "CLASS_ROWS", class_rows)
    assert found_sets(df, qi) == expected
    assert found_sets(df, qi, max_size=2) == capped


def ten_columns(spark, rows=1500):
    """Ten columns of very different numbers of values, with NULLs and repeated rows."""
    sizes = (2, 3, 3, 4, 5, 7, 11, 20, 60, 400)
    values = [f"IF(pmod(hash(id, {100 + i}), 17) = 0, NULL, pmod(hash(id, {i}), {n})) AS q{i}" for i, n in enumerate(sizes)]
    df = spark.range(rows).selectExpr("id", *values).withColumn("q3", F.col("q3").cast("string"))
    return df.withColumn("q4", F.col("q4").cast("decimal(9,2)")).withColumn("q5", F.date_add(F.lit("2020-01-01"), F.col("q5")))


@pytest.mark.parametrize(("class_rows", "task_rows"), [(50_000, 50_000), (100, 64), (1, 1)])
def test_search_equals_the_lattice_on_ten_columns(spark, monkeypatch, class_rows, task_rows):
    rows = 1500 if class_rows > 1 else 60
    df, qi = ten_columns(spark, rows).cache(), [f"q{i}" for i in range(10 if rows > 60 else 6)]
    monkeypatch.setattr(search, "CLASS_ROWS", class_rows)
    monkeypatch.setattr(search, "TASK_ROWS", task_rows)
    for nulls in (False, True):
        got = {}
        for limit in (10**9, 0):
            monkeypatch.setattr(suda, "ONE_PASS_SUBSETS", limit)
            found = suda.special_uniques(df, qi, "id", max_size=4 if rows > 60 else None, missing_nulls=nulls)
            got[limit] = {r["rid"]: sorted(r["msus"]) for r in found.table.collect()}
        assert got[0] == got[10**9] and got[0]


def test_no_rows_are_sent_for_sets_of_the_greatest_size(spark, monkeypatch):
    """pairs inside large classes are counted in the tasks; their rows are not copied for each pair."""
    monkeypatch.setattr(suda, "ONE_PASS_SUBSETS", 0)
    monkeypatch.setattr(search, "CLASS_ROWS", 5)
    sent, refined = [], search._refined
    monkeypatch.setattr(search, "_refined", lambda rows, *more: sent.append(rows.count()) or refined(rows, *more))
    rows = [(i, i % 2, i % 3, i % 4, i // 45) for i in range(90)] + [(90, 0, 1, 9, 1)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int, d int")
    assert found_sets(df, ["a", "b", "c", "d"], max_size=2) == {90: {("c",)}}
    assert sum(sent) == 1


def test_row_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(suda, "ONE_PASS_SUBSETS", 0)
    df = spark.createDataFrame([("x", 1, 1), ("y", 1, 2), ("z", 2, 2)], "id string, a int, b int")
    assert found_sets(df, ["a", "b"]) == {"x": {("b",)}, "y": {("a", "b")}, "z": {("a",)}}
    assert found_sets(df.limit(0), ["a", "b"]) == {}


def test_minimal_masks(monkeypatch):
    rng = np.random.default_rng(2)
    for step in (1, 1 << 22):
        monkeypatch.setattr(search, "COMPARED", step)
        for _ in range(20):
            masks = rng.integers(1, 1 << 9, int(rng.integers(1, 40)))
            want = {int(s) for s in masks if not any(t != s and t & s == t for t in masks)}
            assert set(search.minimal_masks(masks).tolist()) == want


def test_missing_sentinel(spark):
    df = spark.createDataFrame([(0, -999, "x"), (1, 1, "x"), (2, 1, "y")], "id long, a long, b string")
    assert found_sets(df, ["a", "b"])[0] == {("a",)}
    assert found_sets(df, ["a", "b"], missing_value=-999) == {2: {("b",)}, 1: {("a", "b")}}


def test_weights():
    assert msu_weights(4) == [math.factorial(4 - k) for k in (1, 2, 3, 4)]
    assert msu_weights(5, 3) == [4 * 3, 3, 1]


def test_contributions_add_up(spark):
    rows = [(i, i % 2, f"g{i % 3}", i % 5, i // 4) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, a long, b string, c long, d long")
    qi = list("abcd")
    shares = {r["variable"]: r["contribution"] for r in attribute_contributions(df, qi, "id").collect()}
    sets = msus([dict(zip(["id", *qi], r)) for r in rows], qi)
    weight = {i: {s: math.factorial(4 - len(s)) for s in found} for i, found in sets.items()}
    total = sum(sum(w.values()) for w in weight.values())
    for c in qi:
        mine = sum(v for w in weight.values() for s, v in w.items() if c in s)
        assert shares[c] == pytest.approx(100 * mine / total)
    levels = attribute_level_contributions(df, qi, "id").groupBy("variable").agg(F.sum("contribution").alias("s"))
    assert {r["variable"]: r["s"] for r in levels.collect()} == pytest.approx({c: s for c, s in shares.items() if s})
    for r in record_contributions(df, qi, "id").collect():
        w = weight[r["id"]]
        for c in qi:
            assert r[f"pct_{c}"] == pytest.approx(100 * sum(v for s, v in w.items() if c in s) / sum(w.values()))
    top = [r["contribution"] for r in rounded(attribute_contributions(df, qi, "id")).collect()]
    assert top == sorted(top, reverse=True)


def test_same_result_under_other_partitions(spark):
    rows = [(i, i % 2, i % 3, i // 5) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a long, b long, c long")
    results = [sorted(map(tuple, suda_scores(df.repartition(n), list("abc"), "id").collect())) for n in (1, 7)]
    assert results[0] == results[1]


def test_encoding(spark, loans):
    codes = {(r["variable"], r["value"]): r["code"] for r in category_codes(loans, ["branch", "visits"]).collect()}
    assert codes == {("branch", "Harbour"): 0, ("branch", "Hill"): 1, ("branch", "Mill"): 2}
    df = spark.createDataFrame([(0, "b", 5), (1, None, 6), (2, "a", None)], "id long, s string, n long")
    got = {r["id"]: (r["s"], r["n"]) for r in encode_categories(df, ["s", "n"], "id").collect()}
    assert got == {0: (1.0, 5.0), 1: (-1.0, 6.0), 2: (0.0, None)}
    numbers = encode_categories(df, ["n"], "id").collect()
    assert {r["id"]: r["n"] for r in numbers} == {0: 5.0, 1: 6.0, 2: None}


def test_encoding_without_broadcast(spark, monkeypatch):
    rows = [(i, "hot" if i < 60 else f"v{i % 37:02d}", None if i % 9 == 0 else f"w{i % 5}", i % 4) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, s string, t string, n long")
    values = [sorted({r[c] for r in rows if r[c] is not None}) for c in (1, 2)]
    expected = {r[0]: (*[float(v.index(x)) if x is not None else -1.0 for v, x in zip(values, r[1:3])], float(r[3])) for r in rows}
    for limit, share in ((lookup.BROADCAST_BYTES, lookup.HOT_SHARE), (0, 5)):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(lookup, "HOT_SHARE", share)
        got = encode_categories(df, ["s", "t", "n"], "id").collect()
        assert {r["id"]: (r["s"], r["t"], r["n"]) for r in got} == expected


def test_record_table(loans):
    got = {r["id"]: r for r in suda_record_table(loans, QI, "id").collect()}
    assert (got[2]["fee"], got[2]["branch"], got[2]["genre"], got[2]["score"]) == (120.0, 0.0, 1.0, 2.0)


def test_bad_arguments(loans):
    for size in (0, 4):
        with pytest.raises(ValueError):
            minimal_sample_uniques(loans, QI, "id", max_size=size)
    with pytest.raises(ValueError):
        suda_scores(loans, QI, "id", sample_fraction=0.0)
    with pytest.raises(ValueError):
        suda_scores(loans, [], "id")
