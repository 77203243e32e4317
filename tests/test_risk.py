from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import quasirisk.operators.influence as influence
from quasirisk import (
    attribute_contributions,
    collapse_table,
    column_influence,
    combination_contribution,
    gain_totals,
    information_gain,
    k_anonymity,
    l_diversity,
    risk_summary,
    unique_rows,
)
from quasirisk.functions import python_round
from tests.brute_force import uniques

QI = ["fee", "branch", "genre"]
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
small = st.lists(
    st.tuples(
        st.sampled_from([None, 1, 2]), st.sampled_from([None, "x", "y"]), st.sampled_from([None, 0.5, float("nan")])
    ),
    min_size=1,
    max_size=9,
)
SCHEMA = "a long, b string, c double"


def plain(rows):
    """NaN reads as NULL."""
    return [{"a": a, "b": b, "c": None if c != c else c} for a, b, c in rows]


def test_loans_summary(loans):
    row = risk_summary(loans.drop("id"), QI, "fee").first()
    assert row.asDict() == {
        "total_rows": 6, "total_columns": 4, "num_selected_columns": 3, "num_unique_rows": 4,
        "k_anonymity": 1, "l_diversity": 1,
    }
    assert risk_summary(loans, QI).first()["l_diversity"] is None
    assert unique_rows(loans, QI).first()[0] == 4
    assert k_anonymity(loans, ["genre"]).first()[0] == 3
    assert l_diversity(loans, ["branch"], "genre").first()[0] == 1


def test_empty_and_all_null_groups(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    row = risk_summary(nothing, ["a", "b"], "c").first()
    assert (row["total_rows"], row["num_unique_rows"], row["k_anonymity"], row["l_diversity"]) == (0, 0, None, None)
    nulls = spark.createDataFrame([(1, "x", None), (1, "x", None), (None, "y", 1.0)], SCHEMA)
    row = risk_summary(nulls, ["a", "b"], "c").first()
    assert (row["num_unique_rows"], row["k_anonymity"], row["l_diversity"]) == (1, 2, 0)


def test_loans_influence(loans):
    got = {r["column"]: tuple(r)[1:3] + (r["normalized_difference"],) for r in column_influence(loans, QI).collect()}
    assert got == {"fee": (2, 2, 0.7), "branch": (2, 2, 0.7), "genre": (2, 2, 1.0)}
    assert column_influence(loans, ["branch"]).count() == 0


def test_loans_combinations(loans):
    got = {r["combination"]: (r["unique_rows"], r["unique_rows_excluding"], r["score"])
           for r in combination_contribution(loans, QI, 1, 2).collect()}
    assert got == {
        "fee": (0, 2, None), "branch": (1, 2, 2.0), "genre": (0, 2, None), "fee, branch": (2, 0, 2.0),
        "fee, genre": (2, 1, 1.5), "branch, genre": (2, 0, 2.0),
    }
    full = combination_contribution(loans, QI, 3, 7).collect()
    assert [(r["unique_rows_excluding"], r["score"]) for r in full] == [(0, 1.0)]


@SLOW
@given(rows=small)
def test_counts_against_definition(spark, rows):
    df, expected = spark.createDataFrame(rows, SCHEMA), plain(rows)
    qi = ["a", "b", "c"]
    assert unique_rows(df, qi).first()[0] == uniques(expected, qi)
    influence = {r["column"]: r for r in column_influence(df, qi).collect()}
    for c in qi:
        rest = uniques(expected, [o for o in qi if o != c])
        distinct = len({r[c] for r in expected} - {None})
        assert influence[c]["unique_count_after_removal"] == rest
        assert influence[c]["difference"] == uniques(expected, qi) - rest
        assert influence[c]["distinct_values"] == distinct
        ratio = (uniques(expected, qi) - rest) / distinct if distinct else None
        assert influence[c]["normalized_difference"] == (None if ratio is None else round(ratio, 1))
    for r in combination_contribution(df, qi, 1, 3).collect():
        chosen = r["combination"].split(", ")
        mine = uniques(expected, chosen, True)
        rest = [c for c in qi if c not in chosen]
        without = uniques(expected, rest, True) if rest else 0
        score = (uniques(expected, qi, True) - without) / mine if mine else None
        assert (r["unique_rows"], r["unique_rows_excluding"]) == (mine, without)
        assert r["score"] == (None if score is None else pytest.approx(score))


def test_odd_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "`a.b` long, `it's-1` string")
    assert risk_summary(df, ["a.b", "it's-1"]).first()["num_unique_rows"] == 3
    names = [r["combination"] for r in combination_contribution(df, ["a.b", "it's-1"], 2, 2).collect()]
    assert names == ["a.b, it's-1"]


def test_python_round_is_correct(spark):
    values = [0.35, 0.25, 0.15, -0.35, 2.675, 1.005, 34.375, 12.625, 0.0, 1e9 + 0.05, 16 / 12, None]
    values += [i / 20 for i in range(-60, 60)] + [i / 7 for i in range(40)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for digits in (1, 2, 4):
        got = {r[0]: r[1] for r in df.select("i", python_round(df.v, digits)).collect()}
        for i, v in enumerate(values):
            assert got[i] == (None if v is None else round(v, digits)), (v, digits)


@pytest.mark.parametrize("qi", [[], ["nope"], ["branch", "branch"]])
def test_bad_columns(loans, qi):
    for call in (unique_rows, k_anonymity, risk_summary, column_influence, combination_contribution):
        with pytest.raises(ValueError):
            call(loans, qi)


def test_bad_sizes(loans):
    for low, high in ((0, 2), (3, 2), (4, 5)):
        with pytest.raises(ValueError):
            combination_contribution(loans, QI, low, high)


def test_collapsed_table_gives_the_same(spark):
    rows = [(i, i % 3, "x" if i < 20 else f"v{i % 7}", i % 4) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, a long, b string, s long")
    qi, w = ["a", "b"], {"weight": "group_rows"}
    once = collapse_table(df, [*qi, "s"], "id")
    assert once.columns == ["a", "b", "s", "group_rows", "id"]
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert same(risk_summary(once, qi, "s", **w), risk_summary(df, qi, "s"))
    assert same(column_influence(once, qi, **w), column_influence(df, qi))
    assert same(combination_contribution(once, qi, 1, 2, **w), combination_contribution(df, qi, 1, 2))
    left = {r["column"]: r["total"] for r in gain_totals(information_gain(once, qi, **w)).collect()}
    assert left == pytest.approx({r["column"]: r["total"] for r in gain_totals(information_gain(df, qi)).collect()})
    three = [*qi, "s"]
    assert same(attribute_contributions(once, three, "id", **w), attribute_contributions(df, three, "id"))
    with pytest.raises(ValueError):
        collapse_table(once, ["group_rows"])


def test_counts_from_minimal_sets_equal_the_lattice(spark, monkeypatch):
    """All sets of eight columns, with NULLs, weights and repeated rows."""
    sizes = (2, 3, 3, 4, 6, 9, 30, 200)
    values = [f"IF(pmod(hash(id, {100 + i}), 13) = 0, NULL, pmod(hash(id, {i}), {n})) AS q{i}" for i, n in enumerate(sizes)]
    df = spark.range(700).selectExpr(*values, "IF(id % 50 = 0, 2, 1) AS w").cache()
    qi = [f"q{i}" for i in range(8)]
    for low, high, weight in ((1, 8, None), (3, 7, "w"), (2, 2, None)):
        got = []
        for limit in (10**9, 0):
            monkeypatch.setattr(influence, "LATTICE_SUBSETS", limit)
            got.append(sorted(map(tuple, combination_contribution(df, qi, low, high, weight=weight).collect()), key=str))
        assert got[0] == got[1] and any(r[2] for r in got[0])
    assert combination_contribution(df.limit(0), qi, 3, 7).where("unique_rows > 0").count() == 0


def test_subsets_are_listed_without_the_driver(spark):
    listed = {(r["combination"], r["size"], r["mask"], r["rest"]) for r in influence.subset_table(spark, list("abcde"), 2, 4).collect()}
    want = {
        (", ".join(s), n, sum(1 << "abcde".index(c) for c in s), 31 - sum(1 << "abcde".index(c) for c in s))
        for n in (2, 3, 4) for s in combinations("abcde", n)
    }
    assert listed == want
