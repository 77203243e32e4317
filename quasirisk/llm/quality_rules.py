"""Quality rules whose cutoffs are chosen under a guaranteed rate of false rejection.

Each rule rejects a text whose score is above a cutoff.  Cutoffs are chosen per stratum on
labelled holdouts: one is eligible only if the exact binomial test shows, at a level
corrected for all strata and rules, that at most a given share of good documents is
rejected by it.  Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quasirisk.llm.store import Store
from quasirisk.llm.text import WORD, words_column

#: Cutoffs are multiples of 1 / GRID.
GRID = 64
#: Up to so many rows of cutoffs are broadcast; more are joined with salted keys.
BROADCAST_ROWS = 10_000
SALTS = 32

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column, n_words: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` words that occur twice or more, first ones included.

    Only texts that repeat a window at all sort their windows by hash; the positions of
    repeated ones then cover min(width, distance to the next) words each.
    """

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(width), b - a))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def positions(ranked: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            above, below = F.get(ranked, i - 1)["h"], F.get(ranked, i + 1)["h"]
            return ((i > 0) & above.eqNullSafe(x["h"])) | below.eqNullSafe(x["h"])

        return F.array_sort(F.transform(F.filter(ranked, repeated), lambda x: x["i"]))

    def by_hash(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
        many = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(many, _bind(ranked, lambda r: _bind(positions(r), covered))).otherwise(F.lit(0).cast("long"))

    windows = _bind(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width))))
    return F.when(n_words >= width, _bind(windows, by_hash)).otherwise(F.lit(0).cast("long"))


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts the rules need; NULL has none, so every count is 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("words_", words_column(F.col(text)))
    df = df.withColumn("lines_", F.filter(F.split(body, "\n", -1), lambda line: line.rlike(WORD)))
    size = lambda name: F.size(name).cast("long")
    less = lambda pattern: (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("long")
    return df.withColumns({
        "n_words": size("words_"),
        "word_chars": F.length(F.array_join("words_", "")).cast("long"),
        "n_symbols": less(r"[#*$%&|<>]+"),
        "n_capitals": less(r"\p{Lu}+"),
        "n_lines": size("lines_"),
        "n_dup_lines": size("lines_") - F.size(F.array_distinct("lines_")),
        "n_repeat_words": _repeat_words(F.col("words_"), F.size("words_")),
    }).drop("words_", "lines_")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


#: Scores from 0 to 1; higher is worse.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: _share("n_symbols", "word_chars"),
    "capitals": lambda: _share("n_capitals", "word_chars"),
    "dup_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeats": lambda: _share("n_repeat_words", "n_words"),
}


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def _bin(rule: str) -> Column:
    return F.least(F.lit(GRID), F.floor(RULES[rule]() * GRID)).cast("int")


def _ln_factorial(n: Column) -> Column:
    """Exact up to 20; beyond, Stirling's series is exact to double precision."""
    x = n.cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    stirling = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + series
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for n trials at ``rate``, summed downwards from k; 1 where k >= n * rate.

    Below the mean the terms fall, and twelve deviations away they no longer count.
    """
    top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)
    top = top + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, (64 + 12 * F.sqrt(n.cast("double"))).cast("long")))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j
        term = acc["term"] * i * (1 - rate) / ((n - i + 1) * rate)
        return F.struct(term.alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    tail = F.exp(top + F.log(F.aggregate(steps, start, add, lambda acc: acc["sum"])))
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def choose_cutoffs(labelled: DataFrame, store: Store, max_loss: float, level: float) -> DataFrame:
    """Cutoffs from rows of (stratum, good, one bin per rule): stratum, rule, cutoff.

    The share of good documents that a rule may reject is ``max_loss`` over the number of
    rules, so all rules together reject at most ``max_loss`` of a stratum's good ones.
    Every (stratum, rule) is tested at ``level`` over their number; along the cutoffs of
    one rule the losses are nested, so going from lenient to strict needs no further
    correction.  Among eligible cutoffs the one with the most rejected bad documents less
    ten times the good ones is taken, the lenient one on ties; without a gain the rule does
    not apply, as in strata with too few labels to prove anything.
    """
    long_form = labelled.select("stratum", "good", F.explode(F.create_map(
        *[x for r in RULES for x in (F.lit(r), F.col(r))])).alias("rule", "bin"))
    histogram = store.keep(long_form.groupBy("stratum", "rule", "bin").agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")), "histogram")
    tests = max(1, histogram.select("stratum").distinct().count() * len(RULES))
    # At most GRID + 1 rows in each window.
    of_rule = Window.partitionBy("stratum", "rule")
    above = of_rule.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    losses = histogram.select(
        "stratum", "rule", F.col("bin").alias("cutoff"), F.sum("good").over(of_rule).alias("n"),
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("caught"),
    )
    chance = binomial_tail(F.col("lost"), F.col("n"), max_loss / len(RULES))
    eligible = losses.filter((F.col("n") > 0) & (chance <= level / tests))
    gain = F.struct((F.col("caught") - 10 * F.col("lost")).alias("gain"), "cutoff")
    best = eligible.groupBy("stratum", "rule").agg(F.max(gain).alias("best")).filter(F.col("best.gain") > 0)
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def judge(
    docs: DataFrame, labels: DataFrame, carry: Sequence[str], stratum: str, max_loss: float = 0.04, level: float = 0.05
) -> DataFrame:
    """Columns ``carry`` of ``docs`` in a struct ``doc``, counts, ``base_failed`` and ``kept``.

    ``labels`` has doc_id and quality (1 good, 0 bad); ids with NULL, or with labels that
    disagree, count as unlabelled.  A NULL stratum is a stratum of its own.  Without labels
    only the base rules reject.  NULL and empty texts fail the base rules.
    """
    store = Store(docs.sparkSession, "quality")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col("doc_id").alias("id"), F.col("text").alias("text_"),
        F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("\0")).alias("stratum"),
    )
    measured = with_features(whole, "text_").drop("text_")
    measured = measured.withColumn("base_failed", base_failed())
    measured = store.keep(measured.withColumns({r: _bin(r) for r in RULES}), "measured")

    agreed = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    agreed = agreed.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    labelled = measured.filter(~F.col("base_failed")).select(F.col("id").alias("doc_id"), "stratum", *RULES)
    labelled = labelled.join(agreed, "doc_id").select("stratum", (F.col("high") == 1).alias("good"), *RULES)
    cutoffs = choose_cutoffs(labelled, store, max_loss, level)
    wide = cutoffs.groupBy("stratum").agg(*[
        F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES
    ])
    wide = store.keep(wide, "cutoffs")
    if wide.count() <= BROADCAST_ROWS:
        joined = measured.join(F.broadcast(wide), "stratum", "left")
    else:
        salted = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
        joined = measured.withColumn("salt", own).join(salted, ["stratum", "salt"], "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return joined.select("doc", *FEATURES, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits: float) -> DataFrame:
    """doc_id, counts, base_failed and kept, one row per input row; texts are not stored."""
    return judge(docs, labels, ["doc_id"], stratum, **limits).select("doc.doc_id", *FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return judge(docs, labels, docs.columns, stratum, **limits).filter("kept").select("doc.*")
