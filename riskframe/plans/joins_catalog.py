"""Joins, aggregates and the feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import features as f
from riskframe.operators.aggregate import aggregate, aggregate_all, left_join_aggregate, star_join
from riskframe.operators.clean import class_balance, null_profile
from riskframe.operators.select import power_log_features
from riskframe.plans import roles
from riskframe.plans import sqltext as s
from riskframe.plans.columns_catalog import CLEAN_INPUT, CLEAN_ROLES, clean_input
from riskframe.plans.registry import near, near_sql, register, tidy, tidy_all

KEY = f.KEY


@register("left_join_child_agg", f"SELECT SK_ID_BUREAU, SK_ID_CURR, AMT_CREDIT_SUM, MONTHS_BALANCE_MIN, MONTHS_BALANCE_MAX, "
          f"MONTHS_BALANCE_SIZE, {near_sql('MONTHS_BALANCE_MEDIAN')} AS MONTHS_BALANCE_MEDIAN, "
          f"{near_sql('STATUS_O_MEAN')} AS STATUS_O_MEAN FROM joined",
          ["bureau", "bureau_balance"], s.BUREAU_JOINED)
def left_join_child_agg(spark, sf_dir):
    joined = left_join_aggregate(
        roles.bureau(spark, sf_dir), f.balance_features(roles.bureau_balance(spark, sf_dir)), "SK_ID_BUREAU"
    )
    return tidy(
        joined.select(
            "SK_ID_BUREAU", "SK_ID_CURR", "AMT_CREDIT_SUM", "MONTHS_BALANCE_MIN", "MONTHS_BALANCE_MAX",
            "MONTHS_BALANCE_SIZE", "MONTHS_BALANCE_MEDIAN", "STATUS_O_MEAN",
        ),
        exact=["AMT_CREDIT_SUM"],
    )


SLICE_SPEC = {"AMT_CREDIT_SUM": ["max", "mean", "sum", "size"], "DAYS_CREDIT": ["min"]}


@register(
    "left_join_slice_aggs",
    "SELECT * FROM total LEFT JOIN active USING (SK_ID_CURR) LEFT JOIN closed USING (SK_ID_CURR)",
    ["bureau"],
    {
        # The plain form: three aggregates joined on the key.
        "total": f"SELECT SK_ID_CURR, {', '.join(s.aggregate_list(SLICE_SPEC, 'BURO_'))} FROM bureau GROUP BY SK_ID_CURR",
        "active": f"SELECT SK_ID_CURR, {', '.join(s.aggregate_list(SLICE_SPEC, 'ACTIVE_'))} FROM bureau "
        "WHERE CREDIT_ACTIVE = 'Active' GROUP BY SK_ID_CURR",
        "closed": f"SELECT SK_ID_CURR, {', '.join(s.aggregate_list(SLICE_SPEC, 'CLOSED_'))} FROM bureau "
        "WHERE CREDIT_ACTIVE = 'Closed' GROUP BY SK_ID_CURR",
    },
)
def left_join_slice_aggs(spark, sf_dir):
    df = roles.bureau(spark, sf_dir)
    slices = {"ACTIVE_": F.col("CREDIT_ACTIVE") == "Active", "CLOSED_": F.col("CREDIT_ACTIVE") == "Closed"}
    return tidy_all(aggregate(df, KEY, SLICE_SPEC, "BURO_", slices=slices), KEY)


@register(
    "star_left_join",
    """
SELECT c_custkey, n_orders, n_events, max_line FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON c_custkey = o_custkey
LEFT JOIN (SELECT user_id, count(*) AS n_events FROM events GROUP BY 1) e ON c_custkey = user_id
LEFT JOIN (SELECT o_custkey AS k, max(l_quantity) AS max_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) l
  ON c_custkey = l.k""",
)
def star_left_join(spark, sf_dir):
    customers = roles.table(spark, sf_dir, "customer").select("c_custkey")
    orders = roles.table(spark, sf_dir, "orders")
    lines = roles.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return star_join(
        customers,
        [
            orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders")),
            roles.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_events")),
            lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("l_quantity").alias("max_line")),
        ],
        "c_custkey",
    )


@register(
    "hconcat",
    f"SELECT loan_id, amount, {near_sql('sqrt(abs(amount))')} AS amount_pow0_5, {near_sql('amount * amount')} AS amount_pow2, "
    f"{near_sql('ln(abs(amount) + 1e-6::DOUBLE)')} AS amount_log FROM loans",
    ["loans"],
)
def hconcat(spark, sf_dir):
    df = roles.loans(spark, sf_dir).select("loan_id", "amount")
    return tidy(power_log_features(df, ["amount"]), exact=["amount"])


@register(
    "membership_filter",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def membership_filter(spark, sf_dir):
    wanted = roles.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi")


@register(
    "anti_drop",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def anti_drop(spark, sf_dir):
    unwanted = roles.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(unwanted, "o_custkey", "left_anti")


# --------------------------------------------------------------------------
# Single aggregates: per applicant over the previous applications


def _group_query(key: str, spec: dict):
    @register(
        key,
        f"SELECT SK_ID_CURR, {', '.join(s.aggregate_list(spec, 'PREV_'))} FROM previous_plus GROUP BY SK_ID_CURR",
        ["previous"],
        {"previous_plus": s.PREVIOUS_FEATURES["previous_plus"]},
    )
    def query(spark, sf_dir):
        df = roles.previous(spark, sf_dir)
        df = df.withColumn("APP_CREDIT_PERC", f.safe_ratio(F.col("AMT_APPLICATION"), F.col("AMT_CREDIT")))
        return tidy_all(aggregate(df, KEY, spec, "PREV_"), KEY)

    return query


_group_query("group_min", {"AMT_CREDIT": ["min"], "RATE_DOWN_PAYMENT": ["min"], "APP_CREDIT_PERC": ["min"]})
_group_query("group_max", {"AMT_CREDIT": ["max"], "RATE_DOWN_PAYMENT": ["max"], "APP_CREDIT_PERC": ["max"]})
_group_query("group_mean", {"AMT_CREDIT": ["mean"], "CNT_PAYMENT": ["mean"], "APP_CREDIT_PERC": ["mean"]})
_group_query("group_sum", {"AMT_CREDIT": ["sum"], "AMT_ANNUITY": ["sum"], "CNT_PAYMENT": ["sum"]})
_group_query("group_var", {"AMT_CREDIT": ["var"], "AMT_DOWN_PAYMENT": ["var"], "APP_CREDIT_PERC": ["var"]})
_group_query("group_median", {"AMT_CREDIT": ["median"], "AMT_ANNUITY": ["median"], "DAYS_DECISION": ["median"]})
_group_query("group_size", {"AMT_CREDIT": ["size"]})
_group_query("group_nunique", {"HOUR_APPR_PROCESS_START": ["nunique"], "RATE_DOWN_PAYMENT": ["nunique"]})


@register(
    "category_share",
    "SELECT SK_ID_CURR, "
    + ", ".join(
        s.shares("NAME_CONTRACT_STATUS", ["Approved", "Canceled", "Refused"], "PREV_")
        + s.shares("NAME_CONTRACT_TYPE", s.LINE_STATUS, "PREV_")
    )
    + " FROM previous GROUP BY SK_ID_CURR",
    ["previous"],
)
def category_share(spark, sf_dir):
    df = roles.previous(spark, sf_dir)
    return tidy(aggregate(df, KEY, {}, "PREV_", shares=["NAME_CONTRACT_STATUS", "NAME_CONTRACT_TYPE"]))


MIXED_SPEC = {
    "l_quantity": ["min", "max", "mean", "sum", "var", "median", "size", "nunique"],
    "l_extendedprice": ["mean", "sum", "var", "median"],
}


@register(
    "agg_spec",
    f"SELECT l_orderkey, {', '.join(s.aggregate_list(MIXED_SPEC, 'LINE_'))} FROM lineitem GROUP BY l_orderkey",
)
def agg_spec(spark, sf_dir):
    return tidy_all(aggregate(roles.table(spark, sf_dir, "lineitem"), "l_orderkey", MIXED_SPEC, "LINE_"), "l_orderkey")


ALL_HOWS = ["min", "max", "mean", "sum", "var", "median"]


@register(
    "agg_all_columns",
    "SELECT SK_ID_CURR, "
    + ", ".join(s.aggregate_list({c: ALL_HOWS for c in ["MONTHS_BALANCE", "AMT_BALANCE", "AMT_DRAWINGS_CURRENT"]}, "CC_"))
    + " FROM card GROUP BY SK_ID_CURR",
    ["card"],
)
def agg_all_columns(spark, sf_dir):
    df = roles.card(spark, sf_dir).drop("SK_ID_PREV", "NAME_CONTRACT_STATUS")
    return tidy_all(aggregate_all(df, KEY, "CC_"), KEY)


@register(
    "agg_two_level",
    f"""
SELECT SK_ID_CURR, min(MONTHS_BALANCE_MIN) AS BURO_MONTHS_BALANCE_MIN_MIN,
  {near_sql('avg(MONTHS_BALANCE_SIZE)')} AS BURO_MONTHS_BALANCE_SIZE_MEAN,
  {near_sql('avg(STATUS_F_MEAN)')} AS BURO_STATUS_F_MEAN_MEAN, {near_sql('avg(STATUS_O_MEAN)')} AS BURO_STATUS_O_MEAN_MEAN,
  {near_sql('avg(STATUS_nan_MEAN)')} AS BURO_STATUS_nan_MEAN_MEAN
FROM joined GROUP BY SK_ID_CURR""",
    ["bureau", "bureau_balance"],
    s.BUREAU_JOINED,
)
def agg_two_level(spark, sf_dir):
    balance = f.balance_features(roles.bureau_balance(spark, sf_dir))
    joined = left_join_aggregate(roles.bureau(spark, sf_dir).select("SK_ID_BUREAU", KEY), balance, "SK_ID_BUREAU")
    means = {c: ["mean"] for c in balance.columns if c.endswith("_MEAN")}
    spec = {"MONTHS_BALANCE_MIN": ["min"], "MONTHS_BALANCE_SIZE": ["mean"], **means}
    return tidy(aggregate(joined, KEY, spec, "BURO_"))


PREV_SLICE_SPEC = {"AMT_ANNUITY": ["mean", "median"], "AMT_CREDIT": ["sum", "size"], "CNT_PAYMENT": ["sum", "nunique"]}


@register(
    "agg_slices",
    "SELECT * FROM t LEFT JOIN a USING (SK_ID_CURR) LEFT JOIN r USING (SK_ID_CURR)",
    ["previous"],
    {
        "t": f"SELECT SK_ID_CURR, {', '.join(s.aggregate_list(PREV_SLICE_SPEC, 'PREV_'))} FROM previous GROUP BY SK_ID_CURR",
        "a": f"SELECT SK_ID_CURR, {', '.join(s.aggregate_list(PREV_SLICE_SPEC, 'APPROVED_'))} FROM previous "
        "WHERE NAME_CONTRACT_STATUS = 'Approved' GROUP BY SK_ID_CURR",
        "r": f"SELECT SK_ID_CURR, {', '.join(s.aggregate_list(PREV_SLICE_SPEC, 'REFUSED_'))} FROM previous "
        "WHERE NAME_CONTRACT_STATUS = 'Refused' GROUP BY SK_ID_CURR",
    },
)
def agg_slices(spark, sf_dir):
    df = roles.previous(spark, sf_dir)
    slices = {
        "APPROVED_": F.col("NAME_CONTRACT_STATUS") == "Approved",
        "REFUSED_": F.col("NAME_CONTRACT_STATUS") == "Refused",
    }
    return tidy_all(aggregate(df, KEY, PREV_SLICE_SPEC, "PREV_", slices=slices), KEY)


# --------------------------------------------------------------------------
# Feature tables


@register("features_bureau", "SELECT * FROM bureau_features", ["bureau", "bureau_balance"], s.BUREAU_FEATURES)
def features_bureau(spark, sf_dir):
    return tidy_all(f.bureau_features(roles.bureau(spark, sf_dir), roles.bureau_balance(spark, sf_dir)), KEY)


@register("features_previous", "SELECT * FROM previous_features", ["previous"], s.PREVIOUS_FEATURES)
def features_previous(spark, sf_dir):
    return tidy_all(f.previous_features(roles.previous(spark, sf_dir)), KEY)


@register("features_pos", "SELECT * FROM pos_features", ["pos"], s.POS_FEATURES)
def features_pos(spark, sf_dir):
    return tidy_all(f.pos_features(roles.pos(spark, sf_dir)), KEY)


@register(
    "features_instalments", "SELECT * FROM instalment_features", ["instalments", "instalment_columns"], s.INSTALMENT_FEATURES
)
def features_instalments(spark, sf_dir):
    return tidy_all(f.instalment_features(roles.instalments(spark, sf_dir)), KEY)


@register("features_card", "SELECT * FROM card_features", ["card"], s.CARD_FEATURES)
def features_card(spark, sf_dir):
    return tidy_all(f.card_features(roles.card(spark, sf_dir)), KEY)


@register("features_application", "SELECT * FROM features", ["application"], s.APPLICATION_FEATURES)
def features_application(spark, sf_dir):
    return tidy(f.application_features(*roles.application_sides(spark, sf_dir)))


def wide_table(spark, sf_dir):
    """All child feature sets joined to the applications."""
    children = [
        f.bureau_features(roles.bureau(spark, sf_dir), roles.bureau_balance(spark, sf_dir)),
        f.previous_features(roles.previous(spark, sf_dir)),
        f.pos_features(roles.pos(spark, sf_dir)),
        f.instalment_features(roles.instalments(spark, sf_dir)),
        f.card_features(roles.card(spark, sf_dir)),
    ]
    return f.feature_table(f.application_features(*roles.application_sides(spark, sf_dir)), children)


@register(
    "feature_table",
    "SELECT * FROM features "
    + " ".join(
        f"LEFT JOIN {t} USING (SK_ID_CURR)"
        for t in ["bureau_features", "previous_features", "pos_features", "instalment_features", "card_features"]
    ),
    ["application", "bureau", "bureau_balance", "previous", "pos", "instalments", "instalment_columns", "card"],
    {
        **s.APPLICATION_FEATURES,
        **s.BUREAU_FEATURES,
        **s.PREVIOUS_FEATURES,
        **s.POS_FEATURES,
        **s.INSTALMENT_FEATURES,
        **s.CARD_FEATURES,
    },
)
def feature_table(spark, sf_dir):
    df = wide_table(spark, sf_dir)
    main = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "DAYS_BIRTH", "DAYS_EMPLOYED", "TARGET"]
    keep = {KEY, *main, *[c for c in df.columns if c.startswith(("NAME_INCOME_TYPE_", "NAME_REGION_"))]}
    return df.select(*[f.col(c) if c in keep else near(f.col(c)).alias(c) for c in df.columns])


# --------------------------------------------------------------------------

PROFILE_COLUMNS = ["SK_ID_CURR", "TARGET", "INCOME", "CREDIT", "BIRTH", "FLAT", "FAMILY", "USAGE"]


@register(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_present, {near_sql(f'100.0::DOUBLE * count({c}) / count(*)')} AS completeness "
        "FROM clean_input"
        for c in PROFILE_COLUMNS
    ),
    CLEAN_ROLES,
    CLEAN_INPUT,
)
def null_profile_query(spark, sf_dir):
    return tidy(null_profile(clean_input(spark, sf_dir)))


@register(
    "class_balance",
    f"SELECT toxic, count(*) AS n, {near_sql('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share FROM labels GROUP BY toxic",
)
def class_balance_query(spark, sf_dir):
    return tidy(class_balance(roles.table(spark, sf_dir, "labels"), "toxic"))
