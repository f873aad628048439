"""Reusable DuckDB text fragments for the oracles."""

from __future__ import annotations

from ..functions.numeric import fix_sql


def corr_sql(x: str, y: str) -> str:
    """Pairwise-complete Pearson r by DuckDB's own ``corr``; null when a side is constant."""
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    xs = f"(CASE WHEN {both} THEN CAST({x} AS DOUBLE) END)"
    ys = f"(CASE WHEN {both} THEN CAST({y} AS DOUBLE) END)"
    return f"(CASE WHEN min({xs}) < max({xs}) AND min({ys}) < max({ys}) THEN corr({xs}, {ys}) END)"


def pair_count_sql(x: str, y: str) -> str:
    return f"CAST(count_if(({x}) IS NOT NULL AND ({y}) IS NOT NULL) AS BIGINT)"


def pairs_sql(pairs, source: str = "c360") -> str:
    """Long (feature_a, feature_b, r, n) for the given column pairs, one scan."""
    items = ", ".join(
        f"{{'feature_a': '{a}', 'feature_b': '{b}', 'r': {fix_sql(corr_sql(a, b))}, 'n': {pair_count_sql(a, b)}}}"
        for a, b in pairs)
    return f"SELECT unnest(l, recursive := true) FROM (SELECT [{items}] AS l FROM {source})"
