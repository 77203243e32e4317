"""Percentiles of a column of any size, with frequency weights.

Selection by histograms: one combinable aggregate counts the weight below each power of two
(and sign), the driver picks the bucket that holds each wanted rank, and the next aggregate
splits just those buckets into equal parts, until few values are left, which are ranked.
Values in one bucket share their exponent, so 52 bits of fraction need at most five more
passes.  A pass shuffles bucket sums, never values, however many there are; the driver
receives at most BUCKETS rows for each group and rank.  The approximate form stops after one
histogram and says how far off its ranks can be.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quasirisk.plans.keys import clean, col
from quasirisk.plans.materialize import Measured, materialize_measured

# Parts a range is split into, and values of a range that the driver ranks.
BUCKETS = 4096
RANKED_VALUES = 1024


def weighted_values(df: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Non-null values ``x`` with weight ``n`` (and the ``by`` columns)."""
    n = col(weight) if weight else F.lit(1)
    values = df.select(*by, clean(df, value).cast("double").alias("x"), n.cast("long").alias("n"))
    return values.where(F.col("x").isNotNull())


def value_counts(df: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> Measured:
    """Materialised distinct non-null values ``x`` with total weight ``n`` (per ``by`` group)."""
    counts = weighted_values(df, value, weight, by).groupBy(*by, "x").agg(F.sum("n").alias("n"))
    return materialize_measured(counts)


def _octave(x: Column) -> Column:
    """A number that never falls as x rises: sign and power of two.

    The logarithm need not be exact at powers of two, only monotone, which it is.
    """
    power = F.when(F.abs(x) == inf, F.lit(4000)).otherwise(F.floor(F.log2(F.abs(x))) + 2000)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * power).cast("long")


def _split(low: Column, high: Column, x: Column) -> Column:
    """Which of BUCKETS equal parts of [low, high] holds x; subtraction and division are monotone."""
    part = F.floor((x - low) / (high - low) * BUCKETS)
    return F.when((low == high) | (x == high), F.lit(BUCKETS - 1)).otherwise(F.least(part, F.lit(BUCKETS - 1))).cast("long")


def _histogram(rows: DataFrame, bucket: Column, keys: list[str]) -> list:
    """Weight, rows and bounds of each bucket, in order."""
    counted = rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    return sorted(counted.collect(), key=lambda r: r["bucket"])


def _inside(rows: DataFrame, ranges: list[tuple], by: list[str]) -> DataFrame:
    """Rows of ranges (number, by.., lo, hi), which do not overlap, with the number and the bounds."""
    group = [rows.schema[b] for b in by]
    fields = ["range int", *[f"`{f.name}_` {f.dataType.simpleString()}" for f in group], "range_lo double", "range_hi double"]
    # At most two ranges for each group and fraction.
    wanted = F.broadcast(rows.sparkSession.createDataFrame(ranges, ", ".join(fields)))
    here = (F.col("range_lo") <= F.col("x")) & (F.col("x") <= F.col("range_hi"))
    for f in group:
        here = col(f.name).eqNullSafe(col(f"{f.name}_")) & here
    return rows.join(wanted, here)


def _value_at(histogram: list, before: int, rank: int):
    """The bucket that holds the rank, and the weight below it."""
    for r in histogram:
        if rank < before + r["n"]:
            return r, before
        before += r["n"]
    raise ValueError("rank beyond the histogram")


def select_ranks(rows: DataFrame, fractions: Sequence[float], by: Sequence[str] = ()) -> dict[tuple, tuple[int, list[float]]]:
    """Total weight and percentiles of each ``by`` group of rows (by.., x, n), x not NULL.

    ``by`` must name few groups, such as the columns of a table.  Rows may repeat a value.
    Read once per pass: pass a stored table, or a projection of one.
    """
    by = list(by)
    groups: dict[tuple, list] = {}
    for r in _histogram(rows, _octave(F.col("x")), by):
        groups.setdefault(tuple(r[b] for b in by), []).append(r)
    totals = {g: sum(r["n"] for r in h) for g, h in groups.items()}
    ranks = {g: sorted({k for p in fractions for k in (floor(p * (t - 1)), ceil(p * (t - 1)))}) for g, t in totals.items()}
    # The range each (group, rank) lies in, with the weight before it.
    places = {(g, k): _value_at(groups[g], 0, k) for g, ks in ranks.items() for k in ks}
    values: dict[tuple, float] = {}
    while True:
        values |= {key: r["lo"] for key, (r, _) in places.items() if r["lo"] == r["hi"]}
        places = {key: place for key, place in places.items() if key not in values}
        if not places:
            break
        ranges = {key[0] + (r["lo"], r["hi"]): None for key, (r, _) in places.items()}
        ranges = {key: i for i, key in enumerate(ranges)}
        found = _inside(rows, [(i, *key) for key, i in ranges.items()], by)
        last = max(r["cells"] for r, _ in places.values()) <= RANKED_VALUES
        bucket = F.col("x") if last else _split(F.col("range_lo"), F.col("range_hi"), F.col("x"))
        parts: dict[int, list] = {}
        for r in _histogram(found, bucket, ["range"]):
            parts.setdefault(r["range"], []).append(r)
        places = {
            key: _value_at(parts[ranges[key[0] + (r["lo"], r["hi"])]], before, key[1]) for key, (r, before) in places.items()
        }

    def percentile(g: tuple, position: float) -> float:
        low, high = values[g, floor(position)], values[g, ceil(position)]
        # Equal or infinite ends stand for themselves.
        return low if low == high or abs(low) == inf else low + (high - low) * (position - floor(position))

    return {g: (t, [percentile(g, p * (t - 1)) for p in fractions]) for g, t in totals.items()}


def percentiles_of_counts(counts: Measured, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated percentiles p0, p1, ... and ``total`` from value counts.

    One row per ``by`` group (``by`` must name few groups, such as the columns of a table);
    none for an empty group.
    """
    table = counts.table
    found = [(*g, total, *points) for g, (total, points) in select_ranks(table, fractions, by).items()]
    fields = [f"`{b}` {table.schema[b].dataType.simpleString()}" for b in by]
    fields += ["total long", *[f"p{i} double" for i in range(len(fractions))]]
    return table.sparkSession.createDataFrame(found, ", ".join(fields))


def exact_percentiles(
    df: DataFrame,
    value: str,
    fractions: Sequence[float],
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact percentiles of ``value``: ``by``.., total, p0, p1, ...; NULLs are left out."""
    if any(not 0 <= p <= 1 for p in fractions):
        raise ValueError("Fractions must be between 0 and 1.")
    return percentiles_of_counts(value_counts(df, value, weight, by), fractions, by)


# Parts of each power of two in the approximate histogram: a bucket is at most 1/64 wide.
APPROXIMATE_PARTS = 64


def _log_linear(x: Column) -> Column:
    """A bucket number that never falls as x rises, with APPROXIMATE_PARTS equal parts per power of two.

    A logarithm that is off by one at a power of two gives the same number: part 64 of one
    power is part 0 of the next.
    """
    power = F.floor(F.log2(F.abs(x)))
    part = F.floor(F.abs(x) / F.pow(F.lit(2.0), power.cast("double")) * APPROXIMATE_PARTS)
    number = F.when(F.abs(x) == inf, F.lit(4000 * APPROXIMATE_PARTS)).otherwise((power + 2000) * APPROXIMATE_PARTS + part)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * number).cast("long")


@dataclass(frozen=True)
class Approximate:
    """A percentile from one histogram: the exact one lies in [low, high].

    ``rank_error`` is the share of the rows in that range, so it bounds how far the rank of
    ``value`` is from the wanted one.
    """

    value: float
    low: float
    high: float
    rank_error: float


def approximate_ranks(rows: DataFrame, fractions: Sequence[float]) -> tuple[int, list[Approximate]]:
    """Total weight and approximate percentiles of rows (x, n), x not NULL, in one aggregate.

    Nothing is stored or sorted; a task sends one row per bucket it met.  Buckets are at most
    1/64 of their values wide, and a value that repeats alone in its bucket is exact.
    """
    histogram = _histogram(rows, _log_linear(F.col("x")), [])
    total = sum(r["n"] for r in histogram)
    if not total:
        return 0, []

    def percentile(p: float) -> Approximate:
        position = p * (total - 1)
        first, before = _value_at(histogram, 0, floor(position))
        last, below = _value_at(histogram, 0, ceil(position))
        low, high = first["lo"], last["hi"]
        if low == high or abs(low) == inf or abs(high) == inf:
            return Approximate(low, low, high, 0.0 if low == high else (below + last["n"] - before) / total)
        one, other = ((r["lo"] + (r["hi"] - r["lo"]) / 2) for r in (first, last))
        value = one + (other - one) * (position - floor(position))
        return Approximate(value, low, high, (below + last["n"] - before) / total)

    return total, [percentile(p) for p in fractions]


def approximate_percentiles(
    df: DataFrame, value: str, fractions: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Percentiles from one pass: fraction, value, low, high, rank_error; NULLs are left out.

    The exact percentile lies in [low, high].  No rows for a table without values.
    """
    if any(not 0 <= p <= 1 for p in fractions):
        raise ValueError("Fractions must be between 0 and 1.")
    _, found = approximate_ranks(weighted_values(df, value, weight), fractions)
    rows = [(float(p), a.value, a.low, a.high, a.rank_error) for p, a in zip(fractions, found)]
    return df.sparkSession.createDataFrame(rows, "fraction double, value double, low double, high double, rank_error double")
