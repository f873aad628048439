"""Stand-in customer attributes for the customer-360 builder.

The star schema has no age, login IP, registration string or segment labels,
so the builder derives them from the customer key and its own aggregates
(FIXTURES.md section 4).  Each rule is one SQL CASE text that Spark evaluates
through ``F.expr`` and the DuckDB oracle evaluates verbatim, so both sides
agree by construction.  Operators downstream treat these columns as ordinary
data and never use the rules.
"""

from __future__ import annotations


def age_category(a: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN 'Inconnu' WHEN {a} < 25 THEN '18-24' "
            f"WHEN {a} < 35 THEN '25-34' WHEN {a} < 45 THEN '35-44' WHEN {a} < 55 THEN '45-54' "
            f"WHEN {a} < 65 THEN '55-64' ELSE '65+' END")


def time_of_day(h: str) -> str:
    return (f"CASE WHEN {h} < 6 THEN 'Nuit' WHEN {h} < 12 THEN 'Matin' WHEN {h} < 14 THEN 'Midi' "
            f"WHEN {h} < 18 THEN 'Après-midi' ELSE 'Soir' END")


def spending_category(m: str) -> str:
    return (f"CASE WHEN {m} < 1000000 THEN 'Low' WHEN {m} < 1500000 THEN 'Medium' "
            f"WHEN {m} < 2500000 THEN 'High' ELSE 'VIP' END")


def basket_size(m: str, n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN 'Inconnu' WHEN {m} / {n} < 150000 THEN 'Petit' "
            f"WHEN {m} / {n} < 200000 THEN 'Moyen' ELSE 'Grand' END")


def diversity_band(p: str) -> str:
    return f"CASE WHEN {p} < 30 THEN 'Spécialisé' WHEN {p} < 45 THEN 'Modéré' ELSE 'Diversifié' END"


def account_status(seg: str) -> str:
    return (f"CASE WHEN {seg} = 'HOUSEHOLD' THEN 'Inactive' WHEN {seg} = 'MACHINERY' THEN 'Suspended' "
            f"ELSE 'Active' END")


def customer_type(recency: str, tenure: str, n: str) -> str:
    return (f"CASE WHEN {recency} IS NULL OR {recency} > 270 THEN 'Perdu' WHEN {tenure} < 365 THEN 'Nouveau' "
            f"WHEN {n} >= 15 THEN 'Hyperactif' WHEN {n} >= 8 THEN 'Régulier' ELSE 'Occasionnel' END")


def churn_risk(recency: str) -> str:
    return (f"CASE WHEN {recency} IS NULL OR {recency} > 270 THEN 'Élevé' "
            f"WHEN {recency} > 120 THEN 'Moyen' ELSE 'Faible' END")


def stand_in_ip(k: str) -> str:
    c = f"CAST(({k} * 7) % 256 AS STRING)"
    d = f"CAST(1 + {k} % 254 AS STRING)"
    b = f"CAST(({k} * 11) % 256 AS STRING)"
    return (f"CASE WHEN {k} % 89 = 0 THEN 'n/a' "
            f"WHEN {k} % 7 = 0 THEN '10.' || {b} || '.' || {c} || '.' || {d} "
            f"WHEN {k} % 7 = 1 THEN '172.' || CAST(16 + {k} % 16 AS STRING) || '.' || {c} || '.' || {d} "
            f"WHEN {k} % 7 = 2 THEN '192.168.' || {c} || '.' || {d} "
            f"ELSE CAST(1 + ({k} * 37) % 223 AS STRING) || '.' || {b} || '.' || {c} || '.' || {d} END")


def registration_string(k: str, d: str, dialect: str) -> str:
    if dialect == "spark":
        iso, us, eu = (f"date_format({d}, 'yyyy-MM-dd')", f"date_format({d}, 'MM/dd/yyyy')",
                       f"date_format({d}, 'dd/MM/yyyy')")
    else:
        iso, us, eu = (f"strftime({d}, '%Y-%m-%d')", f"strftime({d}, '%m/%d/%Y')",
                       f"strftime({d}, '%d/%m/%Y')")
    return (f"CASE WHEN {d} IS NULL THEN NULL WHEN {k} % 97 = 0 THEN 'bad' "
            f"WHEN {k} % 3 = 0 THEN {iso} WHEN {k} % 3 = 1 THEN {us} ELSE {eu} END")


def month_to_season(m: str) -> str:
    """P26 rule, also used for FavoriteSeason (see functions.scalar)."""
    return (f"CASE WHEN {m} IN (12, 1, 2) THEN 'Hiver' WHEN {m} IN (3, 4, 5) THEN 'Printemps' "
            f"WHEN {m} IN (6, 7, 8) THEN 'Été' WHEN {m} IN (9, 10, 11) THEN 'Automne' END")


def categorical_columns(dialect: str) -> list[tuple[str, str]]:
    """(name, SQL) of the categorical columns, over the numeric core's names."""
    return [
        ("NewsletterSubscribed", "'Yes'"),
        ("RegistrationDate", registration_string("CustomerID", "_first_date", dialect)),
        ("LastLoginIP", stand_in_ip("CustomerID")),
        ("WeekendPreference", "CASE WHEN WeekendPurchaseRatio > 0.5 THEN 'Weekend' ELSE 'Semaine' END"),
        ("ProductDiversity", diversity_band("UniqueProducts")),
        ("Gender", "CASE WHEN CustomerID % 2 = 0 THEN 'F' ELSE 'M' END"),
        ("AccountStatus", account_status("_segment")),
        ("AgeCategory", age_category("Age")),
        ("PreferredTimeOfDay", time_of_day("PreferredHour")),
        ("SpendingCategory", spending_category("MonetaryTotal")),
        ("BasketSizeCategory", basket_size("MonetaryTotal", "Frequency")),
        ("FavoriteSeason", month_to_season("PreferredMonth")),
        ("CustomerType", customer_type("Recency", "CustomerTenureDays", "Frequency")),
        ("ChurnRiskCategory", churn_risk("Recency")),
        ("Churn", "CAST(CASE WHEN Recency IS NULL OR Recency > 270 THEN 1 ELSE 0 END AS INTEGER)"),
    ]
