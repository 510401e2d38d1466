"""SQL building blocks of the comparison queries.

They are written independently of the DataFrame code: window ranks instead of
ranged counts, FILTER aggregates instead of conditional ones.
"""

from __future__ import annotations

from riskframe.operators import features as f
from riskframe.operators.metrics import THRESHOLDS
from riskframe.plans.registry import near_sql as n

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LINE_STATUS = ["F", "O"]


def q(name: str) -> str:
    return '"' + name + '"'


def no_nan(expression: str) -> str:
    return f"CASE WHEN NOT isnan({expression}) THEN {expression} END"


def ratio(a: str, b: str) -> str:
    """a / b with signed infinity for x/0 and NULL for 0/0."""
    return (
        f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) WHEN {b} = 0 AND {a} > 0 THEN CAST('inf' AS DOUBLE) "
        f"WHEN {b} = 0 AND {a} < 0 THEN CAST('-inf' AS DOUBLE) END"
    )


def dummies(column: str, values: list[str], null_category: bool = False) -> list[str]:
    out = [f"CAST(COALESCE({column} = '{v}', FALSE) AS INTEGER) AS {q(column + '_' + v)}" for v in values]
    if null_category:
        out.append(f"CAST({column} IS NULL AS INTEGER) AS {q(column + '_nan')}")
    return out


# --------------------------------------------------------------------------
# Applications


def first_seen_code(column: str, source: str, order: str) -> str:
    return (
        f"SELECT {column} AS v, row_number() OVER (ORDER BY min({order})) - 1 AS code "
        f"FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}"
    )


_APP_RATIOS = ", ".join(
    f"{n(ratio(a if a != 'DAYS_EMPLOYED' else 'nullif(DAYS_EMPLOYED, 365243)', b))} AS {name}"
    for name, (a, b) in f.APPLICATION_RATIOS.items()
)
APPLICATION_FEATURES = {
    # Labelled rows come first, then the others: the order of first appearance.
    "apps": "SELECT *, CASE WHEN TARGET IS NULL THEN 1 ELSE 0 END * 1000000000000 + SK_ID_CURR AS seen "
    "FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'",
    "code_g": first_seen_code("CODE_GENDER", "apps", "seen"),
    "code_c": first_seen_code("FLAG_OWN_CAR", "apps", "seen"),
    "code_r": first_seen_code("FLAG_OWN_REALTY", "apps", "seen"),
    "features": f"""
SELECT SK_ID_CURR, TARGET, CAST(COALESCE(code_g.code, -1) AS INTEGER) AS CODE_GENDER,
  CAST(COALESCE(code_c.code, -1) AS INTEGER) AS FLAG_OWN_CAR, CAST(COALESCE(code_r.code, -1) AS INTEGER) AS FLAG_OWN_REALTY,
  DAYS_BIRTH, nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED, {n('AMT_INCOME_TOTAL')} AS AMT_INCOME_TOTAL,
  {n('AMT_CREDIT')} AS AMT_CREDIT, {n('AMT_ANNUITY')} AS AMT_ANNUITY, {n('CNT_FAM_MEMBERS')} AS CNT_FAM_MEMBERS,
  {', '.join(dummies('NAME_INCOME_TYPE', SEGMENTS) + dummies('NAME_REGION', REGIONS))}, {_APP_RATIOS}
FROM apps LEFT JOIN code_g ON CODE_GENDER = code_g.v LEFT JOIN code_c ON FLAG_OWN_CAR = code_c.v
  LEFT JOIN code_r ON FLAG_OWN_REALTY = code_r.v""",
}


# --------------------------------------------------------------------------
# Aggregate specs


def aggregate_list(spec: dict, prefix: str, when: str | None = None) -> list[str]:
    where = f" FILTER (WHERE {when})" if when else ""
    out = []
    for column, hows in spec.items():
        for how in hows:
            name = q(f"{prefix}{column}_{how.upper()}")
            c = q(column)
            if how in ("min", "max"):
                e = f"{how}({c}){where}"
            elif how == "mean":
                e = f"avg({c}){where}"
            elif how == "median":
                e = f"median(CAST({c} AS DOUBLE)){where}"
            elif how == "var":
                e = no_nan(f"var_samp(CAST({c} AS DOUBLE)){where}")
            elif how == "sum":
                e = f"coalesce(sum(CAST({c} AS DOUBLE)){where}, 0)"
                e = f"CASE WHEN count(*){where} > 0 THEN {e} END" if when else e
            elif how == "size":
                e = f"nullif(count(*){where}, 0)" if when else "count(*)"
            else:
                e = f"count(DISTINCT {c})"
            out.append(f"{n(e)} AS {name}")
    return out


def shares(column: str, values: list[str], prefix: str) -> list[str]:
    out = [
        f"{n(f'avg(CASE WHEN {column} = {chr(39)}{v}{chr(39)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS {q(f'{prefix}{column}_{v}_MEAN')}"
        for v in values
    ]
    out.append(
        f"{n(f'avg(CASE WHEN {column} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS {q(f'{prefix}{column}_nan_MEAN')}"
    )
    return out


BALANCE_AGG = (
    "SELECT SK_ID_BUREAU, "
    + ", ".join(aggregate_list(f.BALANCE_SPEC, "") + shares("STATUS", LINE_STATUS, ""))
    + " FROM bureau_balance GROUP BY SK_ID_BUREAU"
)
BALANCE_EXACT = (
    "SELECT SK_ID_BUREAU, min(MONTHS_BALANCE) AS MONTHS_BALANCE_MIN, max(MONTHS_BALANCE) AS MONTHS_BALANCE_MAX, "
    "count(*) AS MONTHS_BALANCE_SIZE, median(MONTHS_BALANCE) AS MONTHS_BALANCE_MEDIAN, "
    + ", ".join(
        f"avg(CASE WHEN STATUS = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS STATUS_{v}_MEAN" for v in LINE_STATUS
    )
    + ", avg(CASE WHEN STATUS IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS STATUS_nan_MEAN"
    + " FROM bureau_balance GROUP BY SK_ID_BUREAU"
)
BUREAU_JOINED = {
    "balance": BALANCE_EXACT,
    "joined": "SELECT bureau.*, balance.* EXCLUDE (SK_ID_BUREAU) FROM bureau LEFT JOIN balance USING (SK_ID_BUREAU)",
}
_STATUS_MEANS = {f"STATUS_{v}_MEAN": ["mean"] for v in [*LINE_STATUS, "nan"]}
BUREAU_FEATURES = {
    **BUREAU_JOINED,
    "bureau_features": "SELECT SK_ID_CURR, "
    + ", ".join(
        aggregate_list(f.BUREAU_SPEC, "BURO_")
        + shares("CREDIT_ACTIVE", ["Active", "Closed", "Sold"], "BURO_")
        + shares("CREDIT_TYPE", PRIORITIES, "BURO_")
        + aggregate_list(_STATUS_MEANS, "BURO_")
        + aggregate_list(f.BUREAU_SPEC, "ACTIVE_", "CREDIT_ACTIVE = 'Active'")
        + aggregate_list(f.BUREAU_SPEC, "CLOSED_", "CREDIT_ACTIVE = 'Closed'")
    )
    + " FROM joined GROUP BY SK_ID_CURR",
}
PREVIOUS_FEATURES = {
    "previous_plus": f"SELECT *, {ratio('AMT_APPLICATION', 'AMT_CREDIT')} AS APP_CREDIT_PERC FROM previous",
    "previous_features": "SELECT SK_ID_CURR, "
    + ", ".join(
        aggregate_list(f.PREVIOUS_SPEC, "PREV_")
        + shares("NAME_CONTRACT_STATUS", ["Approved", "Canceled", "Refused"], "PREV_")
        + shares("NAME_CONTRACT_TYPE", LINE_STATUS, "PREV_")
        + aggregate_list(f.PREVIOUS_SPEC, "APPROVED_", "NAME_CONTRACT_STATUS = 'Approved'")
        + aggregate_list(f.PREVIOUS_SPEC, "REFUSED_", "NAME_CONTRACT_STATUS = 'Refused'")
    )
    + " FROM previous_plus GROUP BY SK_ID_CURR",
}
POS_FEATURES = {
    "pos_features": "SELECT SK_ID_CURR, "
    + ", ".join(
        aggregate_list(f.POS_SPEC, "POS_")
        + shares("NAME_CONTRACT_STATUS", EVENT_TYPES, "POS_")
        + [f"{n('count(*)')} AS POS_COUNT"]
    )
    + " FROM pos GROUP BY SK_ID_CURR"
}
INSTALMENT_FEATURES = {
    "instalment_features": "SELECT SK_ID_CURR, "
    + ", ".join(aggregate_list(f.INSTALMENT_SPEC, "INSTAL_") + [f"{n('count(*)')} AS INSTAL_COUNT"])
    + " FROM instalment_columns GROUP BY SK_ID_CURR"
}
_CARD_HOWS = ["min", "max", "mean", "sum", "var", "median"]
_CARD_DUMMIES = [f"NAME_CONTRACT_STATUS_{v}" for v in [*EVENT_TYPES, "nan"]]
CARD_FEATURES = {
    "card_wide": "SELECT SK_ID_CURR, MONTHS_BALANCE, AMT_BALANCE, AMT_DRAWINGS_CURRENT, "
    + ", ".join(dummies("NAME_CONTRACT_STATUS", EVENT_TYPES, True))
    + " FROM card",
    "card_features": "SELECT SK_ID_CURR, "
    + ", ".join(
        aggregate_list(
            {c: _CARD_HOWS for c in ["MONTHS_BALANCE", "AMT_BALANCE", "AMT_DRAWINGS_CURRENT", *_CARD_DUMMIES]}, "CC_"
        )
        + [f"{n('count(*)')} AS CC_COUNT"]
    )
    + " FROM card_wide GROUP BY SK_ID_CURR",
}


# --------------------------------------------------------------------------
# Ranks, samples, scores on the loans role

LOAN_FEATURES = ["score", "amount", "age", "grade", "flat", "noise_band"]


def long_form(features: list[str], source: str, keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS feature, CAST({q(c)} AS DOUBLE) AS value FROM {source} WHERE {q(c)} IS NOT NULL"
        for c in features
    )


def average_rank(partition: str, value: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {partition} ORDER BY {value}) "
        f"+ (count(*) OVER (PARTITION BY {partition}, {value}) - 1) / 2.0::DOUBLE)"
    )


SPEARMAN_LONG = {
    "cells": long_form(LOAN_FEATURES, "loans", "loan_id, y"),
    "ranked": f"SELECT feature, {average_rank('feature', 'value')} AS rx, {average_rank('feature', 'y')} AS ry FROM cells",
    "spearman": "SELECT feature, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN abs(corr(rx, ry)) ELSE 0 END "
    "AS spearman FROM ranked GROUP BY feature",
}


def md5_rank(key: str, partition: str = "", seed: str = "42") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return f"row_number() OVER ({part}ORDER BY md5({key} || ':{seed}'), {key})"


CLASS_RANKS = {
    "placed": f"SELECT *, {md5_rank('loan_id', 'y')} AS r, count(*) OVER (PARTITION BY y) AS class_n, "
    "count(*) OVER () AS total FROM loans"
}
SAMPLE_ROWS = {
    **CLASS_RANKS,
    "ideal": "SELECT y, any_value(class_n) * least(500, any_value(total)) / CAST(any_value(total) AS DOUBLE) AS share, "
    "least(500, any_value(total)) AS wanted FROM placed GROUP BY y",
    "quota": "SELECT y, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, y) "
    "<= wanted - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS take FROM ideal",
    "sampled": "SELECT placed.* FROM placed JOIN quota USING (y) WHERE r <= take",
}


def auc_sql(source: str, by: str | None = None, score: str = "score", y: str = "y") -> dict[str, str]:
    part = f"PARTITION BY {by} " if by else ""
    partition = f"{by}, {score}" if by else score
    group = f"{by}, " if by else ""
    return {
        "auc_ranked": f"SELECT {group}{y} AS y, rank() OVER ({part}ORDER BY {score}) "
        f"+ (count(*) OVER (PARTITION BY {partition}) - 1) / 2.0::DOUBLE AS rk FROM {source}",
        "auc_by": f"SELECT {group}sum(y) AS n_pos, sum(1 - y) AS n_neg, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN "
        "(sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) "
        "/ (CAST(sum(y) AS DOUBLE) * sum(1 - y)) ELSE 0 END AS auc FROM auc_ranked" + (f" GROUP BY {by}" if by else ""),
    }


AUC_BY_PRIORITY = auc_sql("loans", "priority")
THRESHOLD_VALUES = ", ".join(f"({t!r}::DOUBLE)" for t in THRESHOLDS)
SWEEP = {
    "grid": f"SELECT * FROM (VALUES {THRESHOLD_VALUES}) AS g(threshold)",
    "outcomes": "SELECT threshold, count(*) FILTER (WHERE y = 0 AND score < threshold) AS tn, "
    "count(*) FILTER (WHERE y = 0 AND score >= threshold) AS fp, "
    "count(*) FILTER (WHERE y = 1 AND score < threshold) AS fn, "
    "count(*) FILTER (WHERE y = 1 AND score >= threshold) AS tp FROM grid CROSS JOIN loans GROUP BY threshold",
    "share": "SELECT avg(y) AS pos FROM loans",
    "swept": "SELECT threshold, tn, fp, fn, tp, CAST(2 * tp + tn - fp - 10 * fn AS DOUBLE) AS cost, "
    "CAST(2 * tp + tn - fp - 10 * fn AS DOUBLE) * (1.0::DOUBLE / greatest(1, tn + fp + fn + tp)) "
    "* (1.0::DOUBLE / greatest(pos, 1e-9::DOUBLE)) AS normalized_cost FROM outcomes CROSS JOIN share",
}
