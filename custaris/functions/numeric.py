"""Numeric helpers shared by the Spark plans and their DuckDB oracles.

Statistics computed by two engines differ in the last bits (summation order,
partial aggregation).  Results are therefore reported at six significant
digits.  The rounding is written as one SQL text that both Spark and DuckDB
evaluate with the same IEEE operations (multiply/divide by an exact power of
ten, add 0.5, floor), so equal inputs always round to equal outputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIG_DIGITS = 6


def sig_sql(x: str, digits: int = SIG_DIGITS) -> str:
    """SQL text rounding ``x`` to ``digits`` significant digits (half up)."""
    v = f"CAST(({x}) AS DOUBLE)"
    e = f"(floor(log10(abs({v}))) - {digits - 1})"
    return (
        f"(CASE WHEN {v} IS NULL THEN NULL "
        f"WHEN isnan({v}) OR {v} = 0 OR abs({v}) > 1e300 THEN {v} "
        f"WHEN {e} >= 0 THEN floor({v} / pow(10, {e}) + 0.5) * pow(10, {e}) "
        f"ELSE floor({v} * pow(10, -{e}) + 0.5) / pow(10, -{e}) END)"
    )


def sig(c: str | Column, digits: int = SIG_DIGITS) -> Column:
    """Column version of :func:`sig_sql`; accepts a column name or Column."""
    if isinstance(c, Column):
        return sig_col(c, digits)
    return F.expr(sig_sql(f"`{c}`", digits))


def sig_col(c: Column, digits: int = SIG_DIGITS) -> Column:
    """Six-significant-digit rounding of an arbitrary Column expression."""
    v = c.cast("double")
    e = F.floor(F.log10(F.abs(v))) - F.lit(digits - 1)
    up = F.floor(v / F.pow(F.lit(10.0), e) + 0.5) * F.pow(F.lit(10.0), e)
    down = F.floor(v * F.pow(F.lit(10.0), -e) + 0.5) / F.pow(F.lit(10.0), -e)
    return (F.when(v.isNull(), F.lit(None).cast("double"))
            .when(F.isnan(v) | (v == 0) | (F.abs(v) > 1e300), v)
            .when(e >= 0, up.cast("double"))
            .otherwise(down.cast("double")))


def signed_log1p(c: Column) -> Column:
    """sign(x)·log1p(|x|)."""
    return F.signum(c) * F.log1p(F.abs(c))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null instead of raising under ANSI mode."""
    return F.try_divide(num, den)


FIX_SCALE = 1e9


def fix_sql(x: str) -> str:
    """SQL text: absolute rounding to 1e-9 for dimensionless statistics
    (skewness, correlations), so float noise around zero becomes exactly 0."""
    return f"(floor(CAST(({x}) AS DOUBLE) * {FIX_SCALE:.0e} + 0.5) / {FIX_SCALE:.0e})"


def fix_col(c: Column) -> Column:
    return (F.floor(c.cast("double") * FIX_SCALE + 0.5) / FIX_SCALE).cast("double")
