"""Comparing two classifiers over several seeded runs.

Per item and level the runs of each model are reduced to a majority verdict
(A4, a partially aggregated group-by), the two models' verdicts are aligned by
an equi-join on (item, level) (J7), and the 2x2 contingency table is four
``count_if`` aggregates (A5). The McNemar p-value is closed-form arithmetic on
that single row (M11), computed with Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# ---------------------------------------------------------------- fixed values
ALPHAS = (0.05, 0.01)
EXACT_MAX_DISCORDANT = 25
# Chebyshev fit of erfc (fractional error < 1.2e-7), coefficients low to high order
ERFC_COEFFS = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(z: Column) -> Column:
    """Complementary error function of a non-negative column."""
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(ERFC_COEFFS[-1])
    for c in reversed(ERFC_COEFFS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def majority_vote(runs: DataFrame, keys: list[str], correct: str | dict[int, str] = "correct") -> DataFrame:
    """A4: per key, correct when more than half of the runs are correct. With a verdict column
    for each level (``{level: column}``) one group-by on ``keys`` sums all levels, and they become
    rows (``level``) only afterwards."""
    if isinstance(correct, str):
        return runs.groupBy(*keys).agg(
            ((F.sum(F.col(correct).cast("int")) * 2) > F.count("*")).alias("majority_correct"))
    g = runs.groupBy(*keys).agg(*[F.sum(F.col(c).cast("int")).alias(f"sum_{k}_") for k, c in correct.items()], F.count("*").alias("n_"))
    return g.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(k).alias("level"), (F.col(f"sum_{k}_") * 2 > F.col("n_")).alias("majority_correct")) for k in correct])))


def contingency(a: DataFrame, b: DataFrame, keys: list[str], flag: str = "majority_correct") -> DataFrame:
    """Align two models' verdicts on ``keys`` and count the 2x2 table:
    n11 both correct, n10 only the first, n01 only the second, n00 neither."""
    j = a.select(*keys, F.col(flag).alias("a_")).join(b.select(*keys, F.col(flag).alias("b_")), keys)
    return j.agg(F.count_if(F.col("a_") & F.col("b_")).cast("long").alias("n11"),
                 F.count_if(F.col("a_") & ~F.col("b_")).cast("long").alias("n10"),
                 F.count_if(~F.col("a_") & F.col("b_")).cast("long").alias("n01"),
                 F.count_if(~F.col("a_") & ~F.col("b_")).cast("long").alias("n00"))


def paired_contingency_wide(runs: DataFrame, keys: list[str], correct: dict[int, str], model: str, first: str,
                            second: str) -> DataFrame:
    """A4+J7+A5 on runs with one verdict column per level: one group-by on ``keys`` sums
    the verdicts of all levels, and the levels become rows only afterwards."""
    is_a, is_b = F.col(model) == first, F.col(model) == second
    sums = [F.sum(F.when(who, F.col(c).cast("int"))).alias(f"{name}_{k}_")
            for k, c in correct.items() for name, who in (("a", is_a), ("b", is_b))]
    g = runs.groupBy(*keys).agg(*sums, F.count(F.when(is_a, 1)).alias("na_"), F.count(F.when(is_b, 1)).alias("nb_"))
    g = g.where((F.col("na_") > 0) & (F.col("nb_") > 0)).select(F.inline(F.array(*[
        F.struct((F.col(f"a_{k}_") * 2 > F.col("na_")).alias("a_"), (F.col(f"b_{k}_") * 2 > F.col("nb_")).alias("b_"))
        for k in correct])))
    return g.agg(F.count_if(F.col("a_") & F.col("b_")).cast("long").alias("n11"),
                 F.count_if(F.col("a_") & ~F.col("b_")).cast("long").alias("n10"),
                 F.count_if(~F.col("a_") & F.col("b_")).cast("long").alias("n01"),
                 F.count_if(~F.col("a_") & ~F.col("b_")).cast("long").alias("n00"))


#: Up to so many terms the binomial tail is summed from its first term; beyond, downwards from its last.
TAIL_FROM_START = 2000
#: Largest number of discordant pairs whose tail is summed (about 9 * sqrt(n) terms matter).
TAIL_MAX_PAIRS = 10 ** 10


def _stirling(m: Column) -> Column:
    """ln(m!) less its leading Stirling terms, for m >= 1000 to double precision."""
    m = m.cast("double")
    return 1 / (12 * m) - 1 / (360 * F.pow(m, 3))


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) for X ~ Bin(n, 1/2) and k <= n / 2.

    Small tails are summed from term 0 in log space. Long ones start at term k, from
    Stirling's formula with its difference terms by log1p, and go down: terms further
    than 9 * sqrt(n) below k add less than 1e-30 of it.
    """
    n, k = n.cast("long"), k.cast("long")
    ln_t0 = -n.cast("double") * F.lit(0.6931471805599453)
    up = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(F.least(k, F.lit(TAIL_FROM_START)), F.lit(1)).cast("long")),
        F.struct(ln_t0.alias("lt"), F.exp(ln_t0).alias("s")),
        lambda acc, i: F.struct((acc["lt"] + F.ln(n - i + 1) - F.ln(i)).alias("lt"),
                                (acc["s"] + F.exp(acc["lt"] + F.ln(n - i + 1) - F.ln(i))).alias("s")))["s"]
    x = (n - 2 * k).cast("double") / n
    rest = n - k
    ln_tk = (-(k * F.log1p(-x) + rest * F.log1p(x))
             + 0.5 * F.ln(n.cast("double") / (2 * 3.141592653589793 * k) / rest) + _stirling(n) - _stirling(k) - _stirling(rest))
    terms = F.least(k, F.ceil(9 * F.sqrt(n.cast("double"))) + 60).cast("long")
    down = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1).cast("long"))),
                       F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                       lambda acc, i: F.struct((acc["t"] * (k - i + 1) / (rest + i)).alias("t"),
                                               (acc["s"] + acc["t"] * (k - i + 1) / (rest + i)).alias("s")))["s"]
    return F.when(k == 0, F.exp(ln_t0)).when(k <= TAIL_FROM_START, up).otherwise(F.exp(ln_tk) * down)


def mcnemar(table: DataFrame, exact: bool | None = None) -> DataFrame:
    """McNemar test on the contingency row.

    ``exact=None`` (default): exact binomial test when the discordant pairs
    ``b + c`` are at most 25, else chi-square with continuity correction.
    ``exact=True`` always uses the binomial test (the reference's effective
    behaviour), ``exact=False`` always chi-square. The tail of the binomial test is only
    summed where it is chosen (else ``p_exact`` is NULL); beyond TAIL_MAX_PAIRS it is
    the normal tail with continuity correction, which agrees to 1e-9 there.
    """
    b, c = F.col("n10"), F.col("n01")
    n = b + c
    k = F.least(b, c)
    chi2 = F.when(n == 0, F.lit(0.0)).otherwise(F.pow(F.abs(b - c) - 1, 2) / n)
    p_chi2 = F.when(n == 0, F.lit(1.0)).otherwise(erfc(F.sqrt(chi2 / 2)))
    if exact is None:
        use_exact = n <= EXACT_MAX_DISCORDANT
    else:
        use_exact = F.lit(bool(exact))
    tail = F.when(n <= TAIL_MAX_PAIRS, 2 * binomial_tail(n, k)).otherwise(p_chi2)
    p_exact = F.when(use_exact, F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail)))
    out = table.select("*", k.alias("stat_exact"), chi2.alias("stat_chi2"),
                       p_exact.alias("p_exact"), p_chi2.alias("p_chi2"), use_exact.alias("exact"))
    out = out.withColumn("p_value", F.when(F.col("exact"), F.col("p_exact")).otherwise(F.col("p_chi2")))
    for a in ALPHAS:
        out = out.withColumn(f"reject_{str(a).replace('.', '')}", F.col("p_value") <= a)
    return out
