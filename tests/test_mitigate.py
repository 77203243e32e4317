import math
import random

import pytest
from pyspark.sql import functions as F

import quasirisk.operators.recode as recoding
import quasirisk.plans.ids as ids
import quasirisk.plans.lookup as lookup
from quasirisk import (
    AddNoise,
    CombineSelected,
    DropColumn,
    RemoveDecimals,
    RoundNearest,
    RoundUp,
    apply_recipe,
    combine_values,
    compare_versions,
    compose_history,
    generalisation_levels,
    generalisation_tree,
    history_table,
    recode,
    revert,
    suppress_above,
    suppress_rows,
    unique_rows,
    with_content_key,
)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_round_up(loans):
    assert column(apply_recipe(loans, [RoundUp("visits", 1)]), "visits") == [20, 30, 20, 40, 30, 40]


def test_rounding_rules(spark):
    values = [15.0, 25.0, -15.0, 14.9, -0.5, 1.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    assert column(apply_recipe(df, [RoundNearest("v", 1)]), "v") == [20.0, 20.0, -20.0, 10.0, 0.0, 0.0, None]
    assert column(apply_recipe(df, [RemoveDecimals("v")]), "v") == [15, 25, -15, 14, 0, 1, None]
    assert column(apply_recipe(df, [RoundUp("v", 1)]), "v") == [20, 30, -10, 20, 0, 10, None]
    for precision in (0, 7):
        with pytest.raises(ValueError):
            apply_recipe(df, [RoundNearest("v", precision)])


@pytest.mark.parametrize("kind, variance", [("laplacian", 2.0), ("gaussian", 1.0), ("normal", 1.0)])
def test_noise(spark, kind, variance):
    df = spark.range(20000).withColumnRenamed("id", "key").selectExpr("key AS id", "0 AS v")
    step = AddNoise("v", kind, 5, "id")
    noise = column(apply_recipe(df, [step]), "v")
    assert noise == column(apply_recipe(df.repartition(7), [step]), "v")
    assert noise != column(apply_recipe(df, [AddNoise("v", kind, 6, "id")]), "v")
    mean = sum(noise) / len(noise)
    assert abs(mean) < 6 * math.sqrt(variance / len(noise))
    assert sum(x * x for x in noise) / len(noise) == pytest.approx(variance, rel=0.1)
    assert all(math.isfinite(x) and x != 0 for x in noise)
    loose = column(apply_recipe(df, [AddNoise("v", kind, 5)]), "v")
    assert sum(x * x for x in loose) / len(loose) == pytest.approx(variance, rel=0.1)
    # Laplace has heavier tails than Normal of the same variance: P(|x| > 3 s) is 0.0144 or 0.0027.
    for drawn in (noise, loose):
        tail = sum(abs(x) > 3 * math.sqrt(variance) for x in drawn) / len(drawn)
        assert 0.011 < tail < 0.018 if kind == "laplacian" else tail < 0.0045


def test_noise_by_content(spark, monkeypatch):
    """Equal rows get different noise, the same after any partitioning; large groups in pieces."""
    rows = [("x", 1.0, None)] * 50 + [("y", None, 2)] * 3 + [("x", 1.0, 7), (None, -0.0, 1), ("it's", float("nan"), 1)]
    df = spark.createDataFrame(rows, "`a.b` string, v double, id long")
    runs = []
    for copies, parts in ((100_000, 1), (100_000, 5), (8, 3)):
        monkeypatch.setattr(ids, "COPIES", copies)
        noisy = apply_recipe(df.repartition(parts), [AddNoise("v", "laplacian", 3)])
        assert noisy.columns == df.columns
        runs.append(sorted((tuple(r) for r in noisy.collect()), key=str))
        keyed = with_content_key(df.repartition(parts))
        assert keyed.count() == keyed.select("content_key").distinct().count() == len(rows)
    assert runs[0] == runs[1] == runs[2] or str(runs[0]) == str(runs[1]) == str(runs[2])
    assert len({r[1] for r in runs[0] if r[0] == "x"}) == 51 and sum(r[1] is None for r in runs[0]) == 3
    assert apply_recipe(df.limit(0), [AddNoise("v")]).count() == 0
    with pytest.raises(ValueError):
        with_content_key(spark.range(1).selectExpr("map(1, id) AS m"))


def test_copies_are_written_out_by_many_tasks(spark, monkeypatch):
    """few different rows with many copies do not all come out of one task."""
    monkeypatch.setattr(ids, "COPIES", 1000)
    keyed = with_content_key(spark.range(20_000).selectExpr("id % 2 AS v"))
    by_task = [r["count"] for r in keyed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 20_000 and max(by_task) <= 12_000
    assert keyed.select("content_key").distinct().count() == 20_000


def test_steps_check_their_column(loans):
    for step in (RoundUp("branch", 1), AddNoise("nope"), RemoveDecimals("branch"), DropColumn("nope"),
                 CombineSelected("branch", ("Hill",), "x"), CombineSelected("branch", ("a", "b"), "")):
        with pytest.raises(ValueError):
            apply_recipe(loans, [step])


def test_revert(loans):
    steps = [RoundUp("visits", 1), CombineSelected("branch", ("Hill", "Mill"), "Uphill"), AddNoise("visits")]
    back = apply_recipe(loans, revert(steps, "visits"))
    assert column(back, "visits") == [14, 22, 14, 31, 22, 31]
    assert column(back, "branch") == ["Harbour", "Uphill", "Harbour", "Uphill", "Uphill", "Harbour"]
    with pytest.raises(ValueError):
        revert(steps, "fee")


def test_combine_values_history(spark):
    df = spark.createDataFrame([(0, " a"), (1, "b "), (2, "c"), (3, None)], "id long, v string")
    once, history = combine_values(df, {}, "v", ["'a'", " b"], '"ab"')
    assert column(once, "v") == ["ab", "ab", "c", None]
    assert history == {"v": [(["a", "b"], "ab")]}
    twice, longer = combine_values(once, history, "v", ["ab", "c"], "all")
    assert column(twice, "v") == ["all", "all", "all", None]
    assert history == {"v": [(["a", "b"], "ab")]} and len(longer["v"]) == 2
    # A later replacement value that an earlier combination covers is replayed, too.
    again, _ = combine_values(df, history, "v", ["c"], "a")
    assert column(again, "v") == ["ab", "ab", "a", None]
    other = spark.createDataFrame([(0, "c", "y")], "id long, v string, w string")
    both, _ = combine_values(other, longer, "w", ["y"], "z")
    assert both.first().asDict() == {"id": 0, "v": "all", "w": "z"}


def test_combine_selected_reads_text(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, None)], "id long, v long")
    assert column(apply_recipe(df, [CombineSelected("v", ("1", "2"), "few")]), "v") == ["few", "few", "3", None]


def test_tree(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None)], "id long, v string")
    combined, history = combine_values(df, {}, "v", ["a", "b"], "it's")
    edges = lambda tree: {tuple(r) for r in tree.collect()}
    made = {("v", "it's"), ("it's", "a"), ("it's", "b")}
    assert edges(generalisation_tree(combined, "v", history)) == made | {("v", "c")}
    assert edges(generalisation_tree(df, "v", history)) == made | {("v", "a"), ("v", "b"), ("v", "c")}
    assert edges(generalisation_tree(df, "v", history, hide_combined=True)) == made | {("v", "c")}
    assert edges(generalisation_tree(df, "v", {})) == {("v", "a"), ("v", "b"), ("v", "c")}


def replayed(value, steps):
    for values, replacement in steps:
        value = replacement if value in values else value
    return value


def test_composed_history(spark, monkeypatch):
    """One function for the whole history, on every way of looking it up."""
    draw = random.Random(5)
    names = [f"v{i}" for i in range(30)]
    steps = [(draw.sample(names, draw.randint(1, 6)), draw.choice(names)) for _ in range(40)]
    final = compose_history(steps)
    assert {v: final.get(v, v) for v in names} == {v: replayed(v, steps) for v in names}
    rows = [(i, "v1" if i % 3 == 0 else None if i % 7 == 0 else f"v{i % 40}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v string, _new long")
    want = [None if v is None else replayed(v, steps) for _, v, _ in rows]
    extra = df.withColumnRenamed("_new", "value")
    assert column(recode(extra, "v", final), "v") == want
    monkeypatch.setattr(recoding, "LITERAL_VALUES", 0)
    for limit, share in ((lookup.BROADCAST_BYTES, lookup.HOT_SHARE), (0, 5)):
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(lookup, "HOT_SHARE", share)
        found = recode(extra, "v", final)
        assert found.columns == extra.columns and column(found, "v") == want
        assert recode(extra.limit(0), "v", final).count() == 0
    assert recode(extra, "v", {}) is extra
    with pytest.raises(ValueError):
        recode(extra, "id", final)


def test_plan_does_not_grow_with_the_history(spark):
    df = spark.createDataFrame([(0, "a0"), (1, "z")], "id long, v string")
    lengths = []
    for n in (300, 3000):
        history = {"v": [([f"a{i}"], f"a{i + 1}") for i in range(n)]}
        found, _ = combine_values(df, history, "v", ["z"], "y")
        assert column(found, "v") == [f"a{n}", "y"]
        lengths.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert lengths[1] < 1.2 * lengths[0]


def levels(tree):
    return {tuple(r) for r in tree.collect()}


def test_levels(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None), (4, "d")], "id long, v string")
    steps = [(["a", "b"], "ab"), (["ab", "c"], "abc"), (["gone"], "new"), (["d", "d"], "d")]
    assert levels(generalisation_levels(df, "v", history_table(spark, steps))) == {
        (1, "ab", "a", 3), (1, "ab", "b", 3), (2, "abc", "ab", 2), (2, "abc", "c", 2), (None, "v", "abc", 1),
        (None, "v", "new", 1), (None, "v", "d", 1),
    }
    assert levels(generalisation_levels(df, "v", history_table(spark, []))) == {(None, "v", x, 1) for x in "abcd"}
    # a -> b -> a: the second a is another node, and there is no cycle.
    back = [(["a"], "b"), (["b"], "a")]
    two = df.where("v = 'a'")
    assert levels(generalisation_levels(two, "v", history_table(spark, back))) == {
        (1, "b", "a", 3), (2, "a", "b", 2), (None, "v", "a", 1)
    }


def test_levels_of_a_long_chain(spark):
    steps = [([f"n{i}"], f"n{i + 1}") for i in range(40)]
    df = spark.createDataFrame([("n0",), ("n0",)], "v string")
    want = {(i + 1, f"n{i + 1}", f"n{i}", 41 - i) for i in range(40)} | {(None, "v", "n40", 1)}
    assert levels(generalisation_levels(df, "v", history_table(spark, steps))) == want


def test_suppression(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None)], "id long, r double")
    assert column(suppress_above(df, "r", 4.0), "id") == [0, 2]
    assert column(suppress_rows(df, df.where("r = 5"), "id"), "id") == [0, 2]


def test_comparison(loans):
    versions = {"before": loans, "after": apply_recipe(loans, [RoundUp("visits", 2)])}
    got = compare_versions(versions, lambda df: unique_rows(df, ["branch", "visits"])).collect()
    assert {r["version"]: r["num_unique_rows"] for r in got} == {"before": 2, "after": 1}


def test_recipe_on_a_stream(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 3 AS v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    query = (
        apply_recipe(stream, [RoundUp("v", 1)]).writeStream.format("memory").queryName("recipe_out")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert column(spark.table("recipe_out"), "v") == [0, 10, 10, 10, 20]
