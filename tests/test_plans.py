"""Plans: what is read, and what must not appear."""

import pytest

from quasirisk import (
    cell_information_gain,
    column_influence,
    combination_contribution,
    k_anonymity,
    mad_outliers,
    risk_summary,
    suda_scores,
)
from quasirisk.plans import lattice
from quasirisk.plans.keys import collapse
from quasirisk.plans.lattice import subset_cells, subset_masks
from tests.brute_force import uniques

QI = ["l_returnflag", "l_linestatus", "l_tax"]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def plans(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part_qi = ["p_brand", "p_type", "p_size"]
    return {
        "risk_summary": risk_summary(lines, QI, "l_discount"),
        "k_anonymity": k_anonymity(lines, QI),
        "column_influence": column_influence(lines, QI),
        "combination_contribution": combination_contribution(lines, QI, 1, 3),
        "cell_information_gain": cell_information_gain(part, part_qi, "p_partkey"),
        "suda_scores": suda_scores(part, part_qi, "p_partkey"),
        "mad_outliers": mad_outliers(part, "p_retailprice", "p_partkey"),
    }


def test_no_cross_joins_or_python(spark, sf_dir):
    for name, df in plans(spark, sf_dir).items():
        plan = plan_of(df)
        for unwanted in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
            assert unwanted not in plan, name


def test_scans_read_only_what_is_needed(spark, sf_dir):
    made = plans(spark, sf_dir)
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string,l_linestatus:string>" in plan_of(made["k_anonymity"])
    assert "l_extendedprice" not in plan_of(made["column_influence"]).split("Physical Plan")[-1]
    # The subset counts are kept, one row each; the source is not read again.
    assert plan_of(made["combination_contribution"]).split("Physical Plan")[-1].count("Scan parquet") == 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_one_and_two_steps_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(lattice, "ONE_STEP_SUBSETS", limit)
    rows = [(i % 2, i % 3, None if i % 5 == 0 else i % 5, i // 6, None if i % 4 else i) for i in range(36)]
    names = list("abcde")
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    table = [dict(zip(names, r)) for r in rows]
    for r in combination_contribution(df, names, 1, 5).collect():
        chosen = r["combination"].split(", ")
        rest = [c for c in names if c not in chosen]
        assert r["unique_rows"] == uniques(table, chosen, True)
        assert r["unique_rows_excluding"] == (uniques(table, rest, True) if rest else 0)
    counted = subset_cells(collapse(df, names), 5, subset_masks(5)).groupBy("mask").sum("n").collect()
    assert {r[1] for r in counted} == {36} and len(counted) == 31
