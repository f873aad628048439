"""Scalar feature functions as native Spark expressions.

The reference runs several of these row by row in Python (date parsing, IP
flags, season mapping); here each is a Catalyst expression, so it stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values shared with the reference -------------------------------------------
# Ordinal maps (training: unknown → null; scoring defaults applied separately).
AGE_CATEGORY_ORDER = {"18-24": 0, "25-34": 1, "35-44": 2, "45-54": 3, "55-64": 4, "65+": 5}
TIME_OF_DAY_ORDER = {"Nuit": 0, "Matin": 1, "Midi": 2, "Après-midi": 3, "Soir": 4}
# Older ordinal maps (legacy variant).
SPENDING_ORDER = {"Low": 0, "Medium": 1, "High": 2, "VIP": 3}
BASKET_ORDER = {"Petit": 0, "Moyen": 1, "Grand": 2, "Inconnu": 3}
# Ordinal columns when scoring: map and the default of an unknown or missing value.
SCORING_ORDINALS = {"AgeCategory": (AGE_CATEGORY_ORDER, 3), "PreferredTimeOfDay": (TIME_OF_DAY_ORDER, 2),
                    "SpendingCategory": (SPENDING_ORDER, 1), "BasketSizeCategory": (BASKET_ORDER, 1)}
# Seasons by month.
SEASON_MONTHS = {"Hiver": (12, 1, 2), "Printemps": (3, 4, 5), "Été": (6, 7, 8), "Automne": (9, 10, 11)}
# Sentinels replaced by null.
TICKET_SENTINELS = (-1, 999)
SATISFACTION_SENTINELS = (-1, 99)
# Risk bands and revenue tiers.
RISK_BANDS = ((0.25, "Faible"), (0.50, "Moyen"), (0.75, "Élevé"))
RISK_TOP = "Critique"
REVENUE_TIERS = ((200, "Low"), (800, "Medium"), (2000, "High"))


# --- F1: mixed-format dates ------------------------------------------------------------

def parse_mixed_date(c: Column) -> Column:
    """ISO first, then month-first, then day-first; anything else → null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-M-d")),
                      F.try_to_timestamp(c, F.lit("M/d/yyyy")),
                      F.try_to_timestamp(c, F.lit("d/M/yyyy")))


def date_parts(c: Column, prefix: str = "Reg") -> list[Column]:
    """RegYear / RegMonth / RegDay / RegWeekday (Mon=0) of a parsed date."""
    return [F.year(c).alias(f"{prefix}Year"), F.month(c).alias(f"{prefix}Month"),
            F.dayofmonth(c).alias(f"{prefix}Day"), F.weekday(c).alias(f"{prefix}Weekday")]


# --- F2, F3: IP address features -------------------------------------------------------

def _octets(ip: Column) -> list[Column]:
    quad = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"  # no leading zeros
    m = F.regexp_extract(ip, quad, 0)
    parts = [F.regexp_extract(ip, quad, i).try_cast("int")
             for i in range(1, 5)]
    return [F.when(m != "", p) for p in parts]


def ipv4_valid(ip: Column) -> Column:
    a, b, c, d = _octets(ip)
    return (a.isNotNull() & (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255))


def is_private_ip(ip: Column, unparseable: int = -1) -> Column:
    """1 if the address is in a non-global IPv4 block, 0 if global,
    ``unparseable`` otherwise.

    Covers the special-purpose blocks treated as private by Python's
    ``ipaddress`` module: 0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.0.0/24
    (but 192.0.0.9 and 192.0.0.10), 192.0.2/24, 192.168/16, 198.18/15,
    198.51.100/24, 203.0.113/24 and 240/4.  100.64/10 is not one of them.
    IPv6: unspecified, loopback, link-local, unique-local, documentation.
    """
    a, b, c, d = _octets(ip)
    v4_private = (
        (a == 0) | (a == 10) | (a == 127)
        | ((a == 169) & (b == 254)) | ((a == 172) & (b >= 16) & (b <= 31))
        | ((a == 192) & (b == 0) & (((c == 0) & (d != 9) & (d != 10)) | (c == 2))) | ((a == 192) & (b == 168))
        | ((a == 198) & ((b == 18) | (b == 19))) | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113)) | (a >= 240)
    )
    low = F.lower(F.trim(ip))
    v6 = low.rlike("^[0-9a-f:]+$") & low.contains(":")
    v6_private = low.isin("::", "::1") | low.rlike("^2001:0?db8:") | low.rlike("^fe[89ab][0-9a-f]:") | low.rlike("^f[cd][0-9a-f]{2}:")
    return (F.when(ipv4_valid(ip), F.when(v4_private, 1).otherwise(0))
            .when(v6, F.when(v6_private, 1).otherwise(0))
            .otherwise(unparseable))


def ip_class(ip: Column) -> Column:
    """A=1 (1-126), B=2 (128-191), C=3 (192-223), else 0, from the first octet."""
    first = F.split(ip, r"\.").getItem(0).try_cast("int")
    return (F.when(first.between(1, 126), 1).when(first.between(128, 191), 2)
            .when(first.between(192, 223), 3).otherwise(0))


# --- F5, F6, P26 -----------------------------------------------------------------------

def null_sentinels(c: Column, sentinels) -> Column:
    """sentinel values → null."""
    return F.when(c.isin(*sentinels), F.lit(None)).otherwise(c)


def ordinal(c: Column, mapping: dict[str, int], default: int | None = None) -> Column:
    """map lookup; a missing key or a null gives ``default`` (null in training)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(m, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def scoring_ordinals(df: DataFrame) -> DataFrame:
    """F6 when scoring: every ordinal column that is present, with its default; absent ones stay absent."""
    return df.withColumns({c: ordinal(F.col(c), m, d) for c, (m, d) in SCORING_ORDINALS.items() if c in df.columns})


def month_to_season(m: Column) -> Column:
    """Month number → season name (null outside 1-12)."""
    out = None
    for name, months in SEASON_MONTHS.items():
        out = (F.when(m.isin(*months), name) if out is None else out.when(m.isin(*months), name))
    return out


# --- F31-F33: bands and labels ---------------------------------------------------------

def risk_band(p: Column) -> Column:
    """left-closed bands: <.25 Faible, <.50 Moyen, <.75 Élevé, else Critique."""
    out = None
    for cut, name in RISK_BANDS:
        out = F.when(p < cut, name) if out is None else out.when(p < cut, name)
    return out.otherwise(RISK_TOP)


def revenue_tier(v: Column, cap: Column) -> Column:
    """F32: <200 Low, <800 Medium, <2000 High, <cap Premium, else Enterprise."""
    out = None
    for cut, name in REVENUE_TIERS:
        out = F.when(v < cut, name) if out is None else out.when(v < cut, name)
    return out.when(v < cap, "Premium").otherwise("Enterprise")


def churn_label(pred: Column) -> Column:
    """label text from the 0/1 prediction."""
    return F.when(pred == 1, "Churn").otherwise("Fidèle")


def money(c: Column, symbol: str = "£") -> Column:
    """whole pounds with thousands separators, half to even; null stays null."""
    return F.concat(F.lit(symbol), F.format_number(F.bround(c.cast("double"), 0), 0))


def half_even(c: Column, digits: int) -> Column:
    """numpy/Python rounding (half to even)."""
    return F.bround(c, digits)
