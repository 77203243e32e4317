import bisect
import math
import random

import pytest

import quasirisk.plans.quantile as quantile
from quasirisk import approximate_percentiles, boxplot_statistics, mad_outliers
from quasirisk.plans.quantile import exact_percentiles
from tests.brute_force import percentile


def table(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")


def expected(values, k, two_sided=False, fallback=True):
    kept = {i: v for i, v in enumerate(values) if v is not None and v == v}
    if len(kept) < 5:
        return {}
    median = percentile(kept.values(), 0.5)
    mad = percentile([abs(v - median) for v in kept.values()], 0.5)
    if mad == 0 and fallback:
        kept = {i: v for i, v in kept.items() if v != 0}
        if len(kept) < 5:
            return {}
        median = percentile(kept.values(), 0.5)
        mad = percentile([abs(v - median) for v in kept.values()], 0.5)
        if mad == 0:
            return {}
    z = {i: (v - median) / (mad / 0.6745) if mad else math.copysign(math.inf, v - median) for i, v in kept.items() if mad or v != median}
    return {i: s for i, s in z.items() if (abs(s) if two_sided else s) > k}


CASES = {
    "plain": [1.0, 2.0, 2.5, 3.0, 3.5, 40.0, -50.0],
    "mostly zero": [0.0] * 9 + [1.0, 2.0, 3.0, 4.0, 5.0, 90.0],
    "few non-zero": [0.0] * 9 + [1.0, 2.0],
    "constant non-zero": [0.0] * 9 + [4.0] * 6,
    "too few": [1.0, 2.0, 3.0, 100.0],
    "nulls and nan": [None, float("nan"), 1.0, 1.5, 2.0, 2.5, 3.0, 30.0],
}


@pytest.mark.parametrize("ranked", [10**6, 4])
@pytest.mark.parametrize("name", CASES)
def test_outliers(spark, monkeypatch, name, ranked):
    monkeypatch.setattr(quantile, "RANKED_VALUES", ranked)
    df = table(spark, CASES[name])
    for two_sided in (False, True):
        got = {r["id"]: r["z_score"] for r in mad_outliers(df, "v", "id", 2.2414, two_sided).collect()}
        assert got == pytest.approx(expected(CASES[name], 2.2414, two_sided))


def test_zero_mad_without_fallback(spark):
    values = CASES["mostly zero"]
    got = {r["id"]: r["z_score"] for r in mad_outliers(table(spark, values), "v", "id", 2.0, True, False).collect()}
    assert got == expected(values, 2.0, True, False)
    assert set(got.values()) == {math.inf}


def test_unknown_column(spark):
    with pytest.raises(ValueError):
        mad_outliers(table(spark, [1.0]), "nope", "id")


def test_boxplot(spark):
    row = boxplot_statistics(table(spark, CASES["plain"]), "v", 2.5).first()
    scale = 1.0 / 0.6745
    z = sorted((v - 2.5) / scale for v in CASES["plain"])
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx(tuple(percentile(z, f) for f in (0.25, 0.5, 0.75)))
    assert (row["n_values"], row["n_fliers"]) == (7, 2)
    assert (row["whisker_low"], row["whisker_high"]) == pytest.approx(((1.0 - 2.5) / scale, (3.5 - 2.5) / scale))
    far = boxplot_statistics(table(spark, [0.0, 1.0, 2.0, 30.0, 40.0, 50.0]), "v", 0.5).first()
    assert (far["whisker_low"], far["whisker_high"]) == (-0.5, 0.5)
    assert boxplot_statistics(table(spark, CASES["too few"]), "v").count() == 0


@pytest.mark.parametrize("ranked", [10**6, 4])
def test_percentiles(spark, monkeypatch, ranked):
    monkeypatch.setattr(quantile, "RANKED_VALUES", ranked)
    rng = random.Random(3)
    rows = [(g, round(rng.gauss(0, 5), 1), rng.randint(1, 4)) for g in ("p", "q", "r") for _ in range(150)]
    rows += [("r", None, 5)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    fractions = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    for r in exact_percentiles(df, "v", fractions, "w", ["g"]).collect():
        values = [v for g, v, w in rows if g == r["g"] and v is not None for _ in range(w)]
        assert r["total"] == len(values)
        assert [r[f"p{i}"] for i in range(6)] == pytest.approx([percentile(values, f) for f in fractions])
    whole = exact_percentiles(df, "v", [0.5]).first()
    assert whole["p0"] == pytest.approx(percentile([v for _, v, _ in rows if v is not None], 0.5))
    assert exact_percentiles(df.where("v > 1000"), "v", [0.5]).count() == 0


@pytest.mark.parametrize("ranked", [10**6, 4])
def test_percentiles_with_infinities(spark, monkeypatch, ranked):
    monkeypatch.setattr(quantile, "RANKED_VALUES", ranked)
    values = [0.0, 1.0, 2.0, *[math.inf] * 6]
    row = exact_percentiles(table(spark, values), "v", [0.0, 0.2, 0.5, 0.75]).first()
    assert (row["p0"], row["p1"], row["p2"], row["p3"]) == pytest.approx((0.0, 1.6, math.inf, math.inf))
    low = exact_percentiles(table(spark, [-math.inf, 3.0]), "v", [0.5]).first()
    assert low["p0"] == -math.inf


def test_ranked_range_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quantile, "RANKED_VALUES", 50)
    monkeypatch.setattr(quantile, "BUCKETS", 16)
    seen = []
    original = quantile._inside
    monkeypatch.setattr(quantile, "_inside", lambda counts, ranges, by: seen.append(ranges) or original(counts, ranges, by))
    df = spark.range(3000).selectExpr("id", "CAST(id * id AS double) AS v")
    assert exact_percentiles(df, "v", [0.5]).first()["p0"] == pytest.approx((1499.0**2 + 1500.0**2) / 2)
    assert all(0 < df.where(f"v BETWEEN {low!r} AND {high!r}").count() <= 50 for _, low, high in seen[-1])


def test_selection_takes_few_passes_whatever_the_values(spark, monkeypatch):
    passes = []
    original = quantile._histogram
    monkeypatch.setattr(quantile, "_histogram", lambda *args: passes.append(1) or original(*args))
    values = [(-1.0) ** k * 2.0 ** (k - 600) * (1 + k * 2.0**-50) for k in range(1200)] + [1 + k * 2.0**-52 for k in range(3000)]
    values += [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = exact_percentiles(df, "v", fractions).first()
    ordered = sorted(values)
    for i, p in enumerate(fractions):
        low, share = divmod(p * (len(values) - 1), 1)
        a, b = ordered[int(low)], ordered[min(int(low) + 1, len(values) - 1)]
        assert got[f"p{i}"] == (a if a == b or share == 0 or abs(a) == float("inf") else a + (b - a) * share)
    assert len(passes) <= 7


@pytest.mark.parametrize("shape", ["spread", "ties", "powers"])
def test_approximate_percentiles_keep_their_bound(spark, shape):
    draw = random.Random(shape)
    values = {
        "spread": [draw.lognormvariate(0, 3) * draw.choice((-1, 1)) for _ in range(1500)],
        "ties": [draw.choice((0.0, -0.0, 1.0, 1.0, 7.5, -3.0)) for _ in range(300)],
        "powers": [2.0**e * draw.choice((1, 1 + 2**-52, 1 - 2**-53)) for e in range(-1070, 1020)] + [math.inf, -math.inf],
    }[shape]
    weights = [draw.randint(1, 4) for _ in values]
    rows = [*zip(values, weights), (None, 3), (float("nan"), 2)]
    df = spark.createDataFrame(rows, "v double, w long").repartition(5)
    whole = sorted(v for v, w in zip(values, weights) for _ in range(w))
    fractions = [0.0, 0.01, 0.25, 0.5, 0.77, 0.95, 1.0]
    for r in approximate_percentiles(df, "v", fractions, "w").collect():
        position = r["fraction"] * (len(whole) - 1)
        for rank in (math.floor(position), math.ceil(position)):
            assert r["low"] <= whole[rank] <= r["high"] and r["low"] <= r["value"] <= r["high"]
        below, upto = bisect.bisect_left(whole, r["value"]), bisect.bisect_right(whole, r["value"])
        away = max(0, below - math.ceil(position), math.floor(position) - upto) / len(whole)
        assert away <= r["rank_error"] <= 1
        if shape == "ties":
            assert r["value"] == percentile(whole, r["fraction"]) and r["rank_error"] in (0.0, r["rank_error"])
    assert approximate_percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_approximate_outliers(spark):
    draw = random.Random(1)
    rows = [(i, draw.gauss(100, 5) if i % 50 else draw.choice((300.0, -200.0))) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v double")
    ids = lambda **o: {r["id"] for r in mad_outliers(df, "v", "id", 8.0, two_sided=True, **o).collect()}
    assert ids() == ids(approximate=True) == {i for i in range(0, 1000, 50)}
    zeros = df.selectExpr("id", "IF(id % 10 > 3, 0.0, v) AS v")
    assert mad_outliers(zeros, "v", "id", 8.0, approximate=True).count() == mad_outliers(zeros, "v", "id", 8.0).count() > 0
    assert mad_outliers(df.limit(4), "v", "id", approximate=True).count() == 0
