"""Column builders shared by the operators. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\f\u000b ﻿"


def strip(c: Column) -> Column:
    """Trim blanks, tabs, line ends, no-break spaces and byte order marks on both sides."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_symbol(c: Column) -> Column:
    """Trimmed, upper-cased symbol; a blank one is null, so that it belongs to no series."""
    s = F.upper(strip(c.cast("string")))
    return F.when(s != "", s)


def finite(c: Column) -> Column:
    """The value where it is a finite number, else null. NaN and infinities count as not measured."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def measured(c: Column) -> Column:
    """The value where it is neither null nor NaN, else null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def div(a: Column, b: Column) -> Column:
    """Null instead of an error where the denominator is zero."""
    return F.try_divide(a, b)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null on constant input (plain corr raises under ANSI mode)."""
    both = F.when(a.isNotNull() & b.isNotNull(), F.lit(1))
    x, y = F.when(both.isNotNull(), a), F.when(both.isNotNull(), b)
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def skew_unbiased(c: Column) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurt_unbiased(c: Column) -> Column:
    """Pearson kurtosis (normal = 3), bias-corrected."""
    n = F.count(c)
    return F.when(
        n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) + 3
    )


def array_split_segment(pos: Column, n: Column, parts: int) -> Column:
    """Segment of position ``pos`` (0-based) when ``n`` items are cut into ``parts`` near-equal runs, longer ones first."""
    base, rem = F.floor(n / parts), n % parts
    head = rem * (base + 1)
    return F.when(pos < head, F.floor(pos / (base + 1))).otherwise(
        rem + F.floor((pos - head) / F.greatest(base, F.lit(1)))
    )


def wilder_weight(i: Column, n: Column, window: int) -> Column:
    """Weight of the i-th (1-based) of n deltas in Wilder's smoothed mean at the last one."""
    q = 1.0 - 1.0 / window
    return F.when(i <= window, F.pow(F.lit(q), n - window) / window).otherwise(
        F.pow(F.lit(q), n - i) / window
    )


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function to double precision (rational approximation after Hart), inside the JVM."""
    # fixed values: coefficients of numerator and denominator, highest power first
    top = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
    low = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
    a = F.abs(x)

    def horner(coefficients: list[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + F.lit(c)
        return out

    tail = F.exp(-a * a / 2) * horner(top) / horner(low)
    far = F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        far = F.lit(k) / (a + far)
    beyond = F.exp(-a * a / 2) / ((a + far) * F.lit(2.506628274631))
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, tail).otherwise(beyond)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def bucket_of(pos: Column, n: Column, k: Column) -> Column:
    """Which of ``k`` contiguous buckets of ``n`` positions holds ``pos``; bounds are i * n / k, half to even."""
    bound = lambda b: F.bround(b * n / k)
    guess = F.floor(pos * k / n)
    return F.when(pos >= bound(guess + 1), guess + 1).when(pos < bound(guess), guess - 1).otherwise(guess).cast("int")


def scalar(one_row: DataFrame) -> Column:
    """The single row of an aggregate as a struct to compute with: an uncorrelated scalar subquery, no join."""
    return one_row.select(F.struct("*").alias("s")).scalar()
