import json
from datetime import datetime

import pytest

import quasirisk.sources.profile as profiles
from quasirisk import (
    attribute_contributions,
    by_distinct,
    cell_information_gain,
    column_influence,
    columns_of_kind,
    combination_contribution,
    combine_dictionary,
    describe_column,
    distinct_values,
    load_dictionary,
    load_table,
    preview,
    profile,
    project,
    rounded,
    sensitive_attribute,
    sort_table,
    suda_record_table,
    with_row_id,
)
from quasirisk.plans.materialize import materialize
from quasirisk.sources import sinks

QI = ["fee", "branch", "genre"]


def write(path, text):
    path.write_text(text)
    return str(path)


def test_load_csv(spark, tmp_path):
    text = ' id , name,score,flag,code,none\n1, Ann,1.5,True,007,\n2,"B, ""x""",,False,1e3,NA\n3,n/a,2,True,-4,null\n'
    df = load_table(spark, write(tmp_path / "t.csv", text))
    assert df.columns == ["id", "name", "score", "flag", "code", "none"]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "boolean", "double", "string"]
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [
        (1, " Ann", 1.5, True, 7.0, None), (2, 'B, "x"', None, False, 1000.0, None), (3, None, 2.0, True, -4.0, None),
    ]


def test_load_tsv_and_schema(spark, tmp_path):
    path = write(tmp_path / "T.TSV", "a\tb\n 1\t1,5\n2d\tx\n")
    assert [tuple(r) for r in load_table(spark, path).collect()] == [(" 1", "1,5"), ("2d", "x")]
    typed = load_table(spark, write(tmp_path / "u.csv", "a,b\n 1,2\n"), schema=spark.createDataFrame([], "b double, a int").schema)
    assert [tuple(r) for r in typed.collect()] == [(2.0, 1)]
    with pytest.raises(ValueError):
        load_table(spark, path, schema=spark.createDataFrame([], "nope int").schema)


def test_profile(spark, loans):
    wide = spark.range(46).selectExpr("id", "id % 45 AS few", "cast(null as string) AS nothing", "cast('NaN' as double) AS x")
    got = {r["column"]: (r["n_distinct"], r["kind"]) for r in profile(wide).collect()}
    assert got == {
        "id": (46, "Continuous"), "few": (45, "Categorical"), "nothing": (0, "Categorical"), "x": (0, "Categorical"),
    }
    flipped = profile(wide, {"id": "Categorical", "few": "Continuous"})
    assert {r["column"] for r in columns_of_kind(flipped, "Continuous").collect()} == {"few"}
    assert by_distinct(profile(wide)).first()["column"] == "id"
    rough = {r["column"]: r["n_distinct"] for r in profile(loans, approximate=True).collect()}
    assert rough["branch"] == 3
    for bad in ({"nope": "Continuous"}, {"id": "Other"}):
        with pytest.raises(ValueError):
            profile(wide, bad)


def test_wide_profile(spark, monkeypatch):
    """Values counted as rows give the same as one count per column, whatever their type."""
    rows = [(i, None if i % 5 == 0 else i % 3, "x" if i % 2 else None, -0.0 if i % 4 else 0.0, i % 2 == 0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "`a.b` long, n long, s string, d double, b boolean, nothing string").selectExpr(
        "*", "double('nan') AS nan", "timestamp_seconds(`a.b` * 1800 + 1729990000) AS t", "date_add(date'2024-01-01', int(n)) AS day",
        "cast(s AS binary) AS raw", "cast(n AS decimal(20, 3)) AS dec", "array(n) AS list", "float(n) / 3 AS f",
    )
    narrow = [tuple(r) for r in profile(df).collect()]
    monkeypatch.setattr(profiles, "WIDE_COLUMNS", 2)
    assert [tuple(r) for r in profile(df).collect()] == narrow
    assert {r[0]: r[1] for r in narrow}["t"] == 60 and {r[0]: r[1] for r in narrow}["nothing"] == 0
    assert [r[1] for r in profile(df.limit(0)).collect()] == [0] * len(df.columns)


@pytest.mark.parametrize("held", [4, 500_000])
def test_wide_profile_sends_different_values_only(spark, monkeypatch, held):
    """tasks pass on each value of a column about once, not once a row; long lists in parts."""
    monkeypatch.setattr(profiles, "HELD_VALUES", held)
    df = spark.range(4000, numPartitions=2).selectExpr(*[f"id % {n} AS c{n}" for n in range(1, 40)], "id", "double(id) / 4 AS x")
    got = {r["column"]: r["n_distinct"] for r in profile(df).collect()}
    assert got == {**{f"c{n}": n for n in range(1, 40)}, "id": 4000, "x": 4000}
    plan = profile(df)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate explode(array(struct" not in plan


def test_small_helpers(spark, loans):
    assert project(loans, ["visits", "branch"]).columns == ["visits", "branch"]
    assert preview(spark.range(50)).count() == 10
    assert sensitive_attribute([("a", False), ("b", True), ("c", True)]) == "b"
    assert sensitive_attribute([("a", False)]) is None
    df = spark.createDataFrame([("10",), ("9",), ("x",), (None,), ("1.5",)], "v string")
    assert [r[0] for r in sort_table(df, ["v"]).collect()] == ["1.5", "9", "10", "x", None]
    assert [r[0] for r in sort_table(df, ["v"], [True]).collect()] == ["10", "9", "1.5", "x", None]
    assert distinct_values(df, "v").count() == 4
    assert distinct_values(df, "v", with_null=True).count() == 5


def test_dictionary(spark, tmp_path, loans):
    entries = {"branch": {"Description": "home", "Levels": {"a": 1}}, "other": {"x": 2}}
    path = write(tmp_path / "dictionary.json", json.dumps(entries, indent=2))
    dictionary = load_dictionary(spark, path)
    assert json.loads(describe_column(dictionary, "branch").first()["metadata"]) == entries["branch"]
    assert describe_column(dictionary, "visits").first()["metadata"] == "not available"
    joined = {r["column"]: r["metadata"] for r in combine_dictionary(profile(loans), dictionary).collect()}
    assert json.loads(joined["branch"]) == entries["branch"] and joined["visits"] == "not available"


def test_row_ids(spark, tmp_path):
    spark.range(100, numPartitions=5).selectExpr("id * 2 AS v").write.parquet(str(tmp_path / "p"))
    df = with_row_id(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(r["row_id"] for r in df.collect()) == list(range(100))
    lines = write(tmp_path / "lines.csv", "v\n" + "\n".join(str(i) for i in range(50)) + "\n")
    assert with_row_id(load_table(spark, lines)).where("v <> row_id").count() == 0
    kept = with_row_id(materialize(spark.range(30, numPartitions=3).repartition(4)))
    assert sorted(r["row_id"] for r in kept.collect()) == list(range(30))


def header_and_rows(path):
    from pathlib import Path

    lines = [p.read_text().splitlines() for p in sorted(Path(path).glob("part-*"))]
    return lines[0][0], [x for part in lines for x in part[1:]]


def test_sinks(spark, tmp_path, loans):
    out = lambda name: str(tmp_path / name)
    gains = cell_information_gain(loans, QI, "id")
    header, rows = header_and_rows(sinks.write_gains(gains, "id", out("gains.csv")))
    assert header == "id,fee,branch,genre,RIG" and rows[0].startswith(("1,", "4,"))
    records = suda_record_table(loans, QI, "id")
    header, rows = header_and_rows(sinks.write_suda_records(records, "id", out("suda.csv")))
    assert header == "fee,branch,genre,dis-score,score" and rows[0].startswith(("120.0,0.0,1.0", "95.0,2.0,0.0"))
    shares = rounded(attribute_contributions(loans, QI, "id"))
    header, rows = header_and_rows(sinks.write_contributions(shares, out("shares.csv"), QI))
    assert header == "index,variable,contribution" and [r.split(",")[0] for r in rows] == ["0", "1", "2"]
    header, rows = header_and_rows(sinks.write_influence(column_influence(loans, QI), out("influence.csv")))
    assert header == "Column,Unique Rows After Removal,Difference in Unique Rows,Normalized Difference"
    assert rows[0] == "genre,2,2,1.0"
    path = sinks.write_combinations(combination_contribution(loans, QI, 1, 2), out("results"))
    header, rows = header_and_rows(path)
    assert header == "Combination,Unique Rows,Unique Rows Excluding Columns,Score" and len(rows) == 6
    assert sinks.default_name("suda", datetime(2024, 5, 6, 7, 8, 9)) == "sudaresult_20240506_070809.csv"
