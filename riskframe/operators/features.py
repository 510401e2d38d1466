"""Feature tables of the credit-history domain.

Column names of the input tables are the data model this engine reads; the
specs below are fixed values of that model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import clamp_positive, col, differs, safe_ratio, sentinel_to_null, string_columns
from riskframe.operators.aggregate import aggregate, aggregate_all, star_join
from riskframe.operators.encode import categories, factorize, one_hot
from riskframe.operators.ranks import HOT_ROWS

KEY = "SK_ID_CURR"
TARGET = "TARGET"

# ---- Fixed values: names, sentinel and aggregate specs of the data model ----
DAY_SENTINEL = 365243
BINARY_COLUMNS = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
SENTINEL_COLUMNS_PREVIOUS = [
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
]
APPLICATION_RATIOS = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
}
BALANCE_SPEC = {"MONTHS_BALANCE": ["min", "max", "size", "median"]}
BUREAU_SPEC = {
    "DAYS_CREDIT": ["min", "max", "mean", "var", "median"],
    "DAYS_CREDIT_ENDDATE": ["min", "max", "mean", "median"],
    "DAYS_CREDIT_UPDATE": ["mean", "median"],
    "CREDIT_DAY_OVERDUE": ["max", "mean", "median"],
    "AMT_CREDIT_MAX_OVERDUE": ["mean", "median"],
    "AMT_CREDIT_SUM": ["max", "mean", "sum", "median"],
    "AMT_CREDIT_SUM_DEBT": ["max", "mean", "sum", "median"],
    "AMT_CREDIT_SUM_OVERDUE": ["mean", "median"],
    "AMT_CREDIT_SUM_LIMIT": ["mean", "sum", "median"],
    "AMT_ANNUITY": ["max", "mean", "median"],
    "CNT_CREDIT_PROLONG": ["sum"],
    "MONTHS_BALANCE_MIN": ["min"],
    "MONTHS_BALANCE_MAX": ["max"],
    "MONTHS_BALANCE_SIZE": ["mean", "sum", "median"],
}
RANGE_AND_CENTRE = ["min", "max", "mean", "median"]
PREVIOUS_SPEC = {
    "AMT_ANNUITY": RANGE_AND_CENTRE,
    "AMT_APPLICATION": RANGE_AND_CENTRE,
    "AMT_CREDIT": RANGE_AND_CENTRE,
    "APP_CREDIT_PERC": ["min", "max", "mean", "var", "median"],
    "AMT_DOWN_PAYMENT": RANGE_AND_CENTRE,
    "AMT_GOODS_PRICE": RANGE_AND_CENTRE,
    "HOUR_APPR_PROCESS_START": RANGE_AND_CENTRE,
    "RATE_DOWN_PAYMENT": RANGE_AND_CENTRE,
    "DAYS_DECISION": RANGE_AND_CENTRE,
    "CNT_PAYMENT": ["mean", "sum"],
}
POS_SPEC = {
    "MONTHS_BALANCE": ["max", "mean", "size", "median"],
    "SK_DPD": ["max", "mean", "median"],
    "SK_DPD_DEF": ["max", "mean", "median"],
}
TOTALS = ["max", "mean", "sum", "median"]
TOTALS_AND_SPREAD = ["max", "mean", "sum", "var", "median"]
INSTALMENT_SPEC = {
    "NUM_INSTALMENT_VERSION": ["nunique"],
    "DPD": TOTALS,
    "DBD": TOTALS,
    "PAYMENT_PERC": TOTALS_AND_SPREAD,
    "PAYMENT_DIFF": TOTALS_AND_SPREAD,
    "AMT_INSTALMENT": TOTALS,
    "AMT_PAYMENT": ["min", *TOTALS],
    "DAYS_ENTRY_PAYMENT": TOTALS,
}
BUREAU_SLICES = {"ACTIVE_": ("CREDIT_ACTIVE", "Active"), "CLOSED_": ("CREDIT_ACTIVE", "Closed")}
PREVIOUS_SLICES = {
    "APPROVED_": ("NAME_CONTRACT_STATUS", "Approved"),
    "REFUSED_": ("NAME_CONTRACT_STATUS", "Refused"),
}
# ------------------------------------------------------------------------------


def _slices(table):
    return {prefix: col(name) == F.lit(value) for prefix, (name, value) in table.items()}


def application_features(train: DataFrame, test: DataFrame, null_category: bool = False) -> DataFrame:
    """Union of labelled and unlabelled applications with codes, dummies and ratios."""
    side = "__side"
    df = train.withColumn(side, F.lit(0)).unionByName(test.withColumn(side, F.lit(1)), allowMissingColumns=True)
    df = df.where(differs(col("CODE_GENDER"), "XNA"))
    df = factorize(df, BINARY_COLUMNS, order_by=[side, KEY]).drop(side)
    df = one_hot(df, null_category=null_category)
    df = df.withColumn("DAYS_EMPLOYED", sentinel_to_null(col("DAYS_EMPLOYED"), DAY_SENTINEL))
    return df.withColumns({n: safe_ratio(col(a), col(b)) for n, (a, b) in APPLICATION_RATIOS.items()})


def balance_features(bureau_balance: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return aggregate(
        bureau_balance, "SK_ID_BUREAU", BALANCE_SPEC, shares=string_columns(bureau_balance), hot_rows=hot_rows
    )


def bureau_features(bureau: DataFrame, bureau_balance: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Credit-bureau records per client, in total and for active / closed credits."""
    balance = balance_features(bureau_balance, hot_rows)
    balance_shares = [c for c in balance.columns if c.endswith("_MEAN")]
    cats = categories(bureau)
    joined = bureau.join(balance, "SK_ID_BUREAU", "left").drop("SK_ID_BUREAU")
    return aggregate(
        joined,
        KEY,
        BUREAU_SPEC,
        prefix="BURO_",
        shares=cats,
        more={c: ["mean"] for c in balance_shares},
        slices=_slices(BUREAU_SLICES),
        hot_rows=hot_rows,
        sizes_from=bureau,
    )


def previous_features(previous: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Earlier applications per client, in total and for approved / refused ones."""
    present = [c for c in SENTINEL_COLUMNS_PREVIOUS if c in previous.columns]
    df = previous.withColumns({c: sentinel_to_null(col(c), DAY_SENTINEL) for c in present})
    df = df.withColumn("APP_CREDIT_PERC", safe_ratio(col("AMT_APPLICATION"), col("AMT_CREDIT")))
    return aggregate(
        df,
        KEY,
        PREVIOUS_SPEC,
        prefix="PREV_",
        shares=string_columns(previous),
        slices=_slices(PREVIOUS_SLICES),
        hot_rows=hot_rows,
    )


def pos_features(pos: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return aggregate(
        pos, KEY, POS_SPEC, prefix="POS_", shares=string_columns(pos), count_name="POS_COUNT", hot_rows=hot_rows
    )


def instalment_columns(instalments: DataFrame) -> DataFrame:
    """Payment ratio and difference, days past due and days before due."""
    late = col("DAYS_ENTRY_PAYMENT") - col("DAYS_INSTALMENT")
    early = col("DAYS_INSTALMENT") - col("DAYS_ENTRY_PAYMENT")
    return instalments.withColumns(
        {
            "PAYMENT_PERC": safe_ratio(col("AMT_PAYMENT"), col("AMT_INSTALMENT")),
            "PAYMENT_DIFF": col("AMT_INSTALMENT") - col("AMT_PAYMENT"),
            "DPD": clamp_positive(late),
            "DBD": clamp_positive(early),
        }
    )


def instalment_features(instalments: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return aggregate(
        instalment_columns(instalments),
        KEY,
        INSTALMENT_SPEC,
        prefix="INSTAL_",
        shares=string_columns(instalments),
        count_name="INSTAL_COUNT",
        hot_rows=hot_rows,
    )


def card_features(card: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    return aggregate_all(card.drop("SK_ID_PREV"), KEY, "CC_", count_name="CC_COUNT", hot_rows=hot_rows)


def feature_table(application: DataFrame, children: Sequence[DataFrame]) -> DataFrame:
    """The wide table: applications left-joined with every child feature set."""
    return star_join(application, children, KEY)
