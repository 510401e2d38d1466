"""Projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.functions import expr
from riskframe.operators import clean, score
from riskframe.operators.aggregate import aggregate
from riskframe.operators.encode import factorize, one_hot
from riskframe.operators.features import DAY_SENTINEL, SENTINEL_COLUMNS_PREVIOUS, instalment_columns
from riskframe.operators.select import power_log_features, project_required
from riskframe.plans import roles
from riskframe.plans.registry import near, near_sql, register, tidy
from riskframe.plans.sqltext import REGIONS, SEGMENTS, dummies, first_seen_code, ratio


@register(
    "filter_not_equal_keep_null",
    "SELECT SK_ID_CURR, FLAG_OWN_REALTY FROM application WHERE FLAG_OWN_REALTY IS DISTINCT FROM 'N'",
    ["application"],
)
def filter_not_equal_keep_null(spark, sf_dir):
    df = roles.application(spark, sf_dir).select("SK_ID_CURR", "FLAG_OWN_REALTY")
    return df.where(expr.differs(F.col("FLAG_OWN_REALTY"), "N"))


@register(
    "factorize",
    """
SELECT SK_ID_CURR, CAST(COALESCE(g.code, -1) AS INTEGER) AS CODE_GENDER, CAST(COALESCE(c.code, -1) AS INTEGER) AS FLAG_OWN_CAR,
  CAST(COALESCE(r.code, -1) AS INTEGER) AS FLAG_OWN_REALTY
FROM application LEFT JOIN g ON CODE_GENDER = g.v LEFT JOIN c ON FLAG_OWN_CAR = c.v LEFT JOIN r ON FLAG_OWN_REALTY = r.v""",
    ["application"],
    {
        "g": first_seen_code("CODE_GENDER", "application", "SK_ID_CURR"),
        "c": first_seen_code("FLAG_OWN_CAR", "application", "SK_ID_CURR"),
        "r": first_seen_code("FLAG_OWN_REALTY", "application", "SK_ID_CURR"),
    },
)
def factorize_query(spark, sf_dir):
    columns = ["CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
    df = roles.application(spark, sf_dir).select("SK_ID_CURR", *columns)
    return factorize(df, columns, ["SK_ID_CURR"])


@register(
    "one_hot",
    f"SELECT SK_ID_CURR, {', '.join(dummies('NAME_INCOME_TYPE', SEGMENTS) + dummies('NAME_REGION', REGIONS))} FROM application",
    ["application"],
)
def one_hot_query(spark, sf_dir):
    return one_hot(roles.application(spark, sf_dir).select("SK_ID_CURR", "NAME_INCOME_TYPE", "NAME_REGION"))


@register(
    "one_hot_null_category",
    f"SELECT SK_ID_CURR, {', '.join(dummies('NAME_INCOME_TYPE', SEGMENTS, True) + dummies('NAME_REGION', REGIONS, True))} "
    "FROM application",
    ["application"],
)
def one_hot_null_category(spark, sf_dir):
    df = roles.application(spark, sf_dir).select("SK_ID_CURR", "NAME_INCOME_TYPE", "NAME_REGION")
    return one_hot(df, null_category=True)


@register(
    "sentinel_to_null",
    "SELECT SK_ID_CURR, " + ", ".join(f"nullif({c}, 365243) AS {c}" for c in SENTINEL_COLUMNS_PREVIOUS) + " FROM previous",
    ["previous"],
)
def sentinel_to_null(spark, sf_dir):
    df = roles.previous(spark, sf_dir)
    return df.select(
        "SK_ID_CURR",
        *[expr.sentinel_to_null(F.col(c), DAY_SENTINEL).cast("long").alias(c) for c in SENTINEL_COLUMNS_PREVIOUS],
    )


@register(
    "ratio_feature",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {near_sql(ratio('l_tax', 'l_discount'))} AS tax_ratio FROM lineitem",
)
def ratio_feature(spark, sf_dir):
    df = roles.table(spark, sf_dir, "lineitem")
    return df.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        near(expr.safe_ratio(F.col("l_tax"), F.col("l_discount"))).alias("tax_ratio"),
    )


@register(
    "difference_feature",
    f"""SELECT SK_ID_CURR, {near_sql('AMT_INSTALMENT - AMT_PAYMENT')} AS payment_diff,
  DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS days_late FROM instalments""",
    ["instalments"],
)
def difference_feature(spark, sf_dir):
    df = roles.instalments(spark, sf_dir)
    return df.select(
        "SK_ID_CURR",
        near(expr.difference(F.col("AMT_INSTALMENT"), F.col("AMT_PAYMENT"))).alias("payment_diff"),
        expr.difference(F.col("DAYS_ENTRY_PAYMENT"), F.col("DAYS_INSTALMENT")).alias("days_late"),
    )


@register("clamp_positive", "SELECT SK_ID_CURR, CAST(DPD AS DOUBLE) AS DPD, CAST(DBD AS DOUBLE) AS DBD FROM instalment_columns",
          ["instalments", "instalment_columns"])
def clamp_positive(spark, sf_dir):
    return instalment_columns(roles.instalments(spark, sf_dir)).select("SK_ID_CURR", "DPD", "DBD")


@register(
    "category_slice",
    "SELECT SK_ID_BUREAU, CREDIT_ACTIVE, AMT_CREDIT_SUM FROM bureau WHERE CREDIT_ACTIVE IN ('Active', 'Closed')",
    ["bureau"],
)
def category_slice(spark, sf_dir):
    df = roles.bureau(spark, sf_dir)
    active = df.where(F.col("CREDIT_ACTIVE").isin("Active", "Closed"))
    return active.select("SK_ID_BUREAU", "CREDIT_ACTIVE", "AMT_CREDIT_SUM")


@register(
    "bool_to_int",
    "SELECT loan_id, CAST(y = 1 AS INTEGER) AS is_default, CAST(age > 1000 AS INTEGER) AS is_old FROM loans",
    ["loans"],
)
def bool_to_int(spark, sf_dir):
    df = roles.loans(spark, sf_dir)
    return expr.bool_to_int(df.select("loan_id", (F.col("y") == 1).alias("is_default"), (F.col("age") > 1000).alias("is_old")))


@register(
    "int_to_double",
    "SELECT loan_id, CAST(age AS DOUBLE) AS age, CAST(grade AS DOUBLE) AS grade, amount FROM loans",
    ["loans"],
)
def int_to_double(spark, sf_dir):
    df = roles.loans(spark, sf_dir).select("loan_id", "age", "grade", "amount")
    return expr.int_to_double(df, exclude=["loan_id"])


@register(
    "select_numeric",
    """SELECT SK_ID_CURR, TARGET, DAYS_BIRTH, DAYS_EMPLOYED, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, CNT_FAM_MEMBERS
FROM application""",
    ["application"],
)
def select_numeric(spark, sf_dir):
    return expr.select_numeric(roles.application(spark, sf_dir))


RAW_TEXT = (
    "SELECT loan_id, CASE loan_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'nan' WHEN 2 THEN NULL "
    "WHEN 3 THEN CAST(age AS VARCHAR) ELSE CAST(grade AS VARCHAR) || '.25' END AS raw FROM loans"
)


def raw_text(spark, sf_dir):
    k = F.col("loan_id") % 5
    return roles.loans(spark, sf_dir).select(
        "loan_id",
        F.when(k == 0, "unknown")
        .when(k == 1, "nan")
        .when(k == 3, F.col("age").cast("string"))
        .when(k == 4, F.concat(F.col("grade").cast("string"), F.lit(".25")))
        .alias("raw"),
    )


@register(
    "to_numeric_coerce",
    "SELECT loan_id, CASE WHEN raw <> 'nan' THEN TRY_CAST(raw AS DOUBLE) END AS parsed FROM texts",
    ["loans"],
    {"texts": RAW_TEXT},
)
def to_numeric_coerce(spark, sf_dir):
    return raw_text(spark, sf_dir).select("loan_id", expr.to_double(F.col("raw")).alias("parsed"))


@register("drop_columns", "SELECT client_id, amount, age, grade, score FROM loans", ["loans"])
def drop_columns(spark, sf_dir):
    return expr.drop_columns(
        roles.loans(spark, sf_dir), ["loan_id", "y", "flat", "priority", "status", "noise_band", "not_there"]
    )


@register(
    "prefix_rename",
    f"""SELECT l_suppkey, min(l_quantity) AS SUPP_l_quantity_MIN, max(l_quantity) AS SUPP_l_quantity_MAX,
  {near_sql('avg(l_discount)')} AS SUPP_l_discount_MEAN, count(*) AS SUPP_COUNT FROM lineitem GROUP BY l_suppkey""",
)
def prefix_rename(spark, sf_dir):
    df = roles.table(spark, sf_dir, "lineitem")
    return tidy(
        aggregate(df, "l_suppkey", {"l_quantity": ["min", "max"], "l_discount": ["mean"]}, "SUPP_", count_name="SUPP_COUNT")
    )


# --------------------------------------------------------------------------
# Cleaning: a frame with sparse rows, a sparse column and a constant


def clean_input(spark, sf_dir):
    k = F.col("SK_ID_CURR")
    filled = k % 9 != 0
    usage = roles.pos(spark, sf_dir).groupBy("SK_ID_CURR").agg(F.max("SK_DPD").alias("USAGE"))
    df = roles.application(spark, sf_dir).join(usage, "SK_ID_CURR", "left")
    return df.select(
        "SK_ID_CURR",
        "TARGET",
        F.when(filled, F.col("AMT_INCOME_TOTAL")).alias("INCOME"),
        F.when(filled, F.col("AMT_CREDIT")).alias("CREDIT"),
        F.when(filled & (k % 50 != 3), F.col("DAYS_BIRTH")).alias("BIRTH"),
        F.when(filled, F.lit(5.0)).alias("FLAT"),
        F.when(filled, F.col("CNT_FAM_MEMBERS")).alias("FAMILY"),
        F.col("USAGE"),
    )


CLEAN_INPUT = {
    "clean_input": """
SELECT SK_ID_CURR, TARGET, CASE WHEN SK_ID_CURR % 9 <> 0 THEN AMT_INCOME_TOTAL END AS INCOME,
  CASE WHEN SK_ID_CURR % 9 <> 0 THEN AMT_CREDIT END AS CREDIT,
  CASE WHEN SK_ID_CURR % 9 <> 0 AND SK_ID_CURR % 50 <> 3 THEN DAYS_BIRTH END AS BIRTH,
  CASE WHEN SK_ID_CURR % 9 <> 0 THEN 5.0::DOUBLE END AS FLAT,
  CASE WHEN SK_ID_CURR % 9 <> 0 THEN CNT_FAM_MEMBERS END AS FAMILY, USAGE
FROM application LEFT JOIN (SELECT SK_ID_CURR, max(SK_DPD) AS USAGE FROM pos GROUP BY SK_ID_CURR) u USING (SK_ID_CURR)"""
}
CLEAN_ROLES = ["application", "pos"]


@register(
    "drop_sparse_columns",
    "SELECT SK_ID_CURR, TARGET, INCOME, CREDIT, BIRTH, FLAT, FAMILY FROM clean_input",
    CLEAN_ROLES,
    CLEAN_INPUT,
)
def drop_sparse_columns(spark, sf_dir):
    return clean.drop_sparse_columns(clean_input(spark, sf_dir), "TARGET", 80)


FILLED = " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in ["SK_ID_CURR", "TARGET", "INCOME", "CREDIT", "BIRTH", "FLAT", "FAMILY"])
KEPT = {**CLEAN_INPUT, "kept": f"SELECT * EXCLUDE (USAGE) FROM clean_input WHERE 100.0 * ({FILLED}) / 7 >= 40"}


@register("drop_sparse_rows", "SELECT * FROM kept", CLEAN_ROLES, KEPT)
def drop_sparse_rows(spark, sf_dir):
    return clean.drop_sparse_rows(clean.drop_sparse_columns(clean_input(spark, sf_dir), "TARGET", 80), 80)


def imputed(how: str) -> str:
    fills = {"median": "median(CAST({c} AS DOUBLE))", "mean": "avg({c})", "zero": "0 * count(*)"}[how]
    columns = ["INCOME", "CREDIT", "BIRTH", "FLAT", "FAMILY", "USAGE"]
    parts = ", ".join(
        near_sql(f"coalesce(CAST({c} AS DOUBLE), (SELECT {fills.format(c=c)} FROM clean_input))") + f" AS {c}" for c in columns
    )
    return f"SELECT SK_ID_CURR, TARGET, {parts} FROM clean_input"


def impute_query(spark, sf_dir, how):
    filled = clean.impute(clean_input(spark, sf_dir), "TARGET", how)
    return filled.select(
        "SK_ID_CURR", "TARGET", *[near(F.col(c)).alias(c) for c in ["INCOME", "CREDIT", "BIRTH", "FLAT", "FAMILY", "USAGE"]]
    )


@register("impute_median", imputed("median"), CLEAN_ROLES, CLEAN_INPUT)
def impute_median(spark, sf_dir):
    return impute_query(spark, sf_dir, "median")


@register("impute_mean", imputed("mean"), CLEAN_ROLES, CLEAN_INPUT)
def impute_mean(spark, sf_dir):
    return impute_query(spark, sf_dir, "mean")


@register("impute_zero", imputed("zero"), CLEAN_ROLES, CLEAN_INPUT)
def impute_zero(spark, sf_dir):
    return impute_query(spark, sf_dir, "zero")


VARIATION_COLUMNS = ["INCOME", "CREDIT", "BIRTH", "FLAT", "FAMILY", "RATIO"]
VARIATION = {
    **CLEAN_INPUT,
    "wide": f"SELECT *, {ratio('INCOME', 'FAMILY')} AS RATIO FROM clean_input",
    "cvs": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN isnan(s) OR isinf(s) OR isinf(m) OR m = 0 THEN 0 ELSE coalesce(s / abs(m), 0) END AS cv "
        f"FROM (SELECT avg({c}) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS s FROM wide)"
        for c in VARIATION_COLUMNS
    ),
}


@register(
    "drop_low_cv",
    f"SELECT feature, {near_sql('cv')} AS cv, CAST(cv > 0.05 AS INTEGER) AS kept FROM cvs",
    CLEAN_ROLES,
    VARIATION,
)
def drop_low_cv(spark, sf_dir):
    """The decision of the filter as a long table; inf and constant columns go."""
    df = clean_input(spark, sf_dir).withColumn("RATIO", expr.safe_ratio(F.col("INCOME"), F.col("FAMILY")))
    df = df.select("TARGET", *VARIATION_COLUMNS).persist()
    cvs = clean.variation(df, VARIATION_COLUMNS)
    kept = clean.drop_low_variation(df, "TARGET", 0.05).columns
    df.unpersist()
    table = spark.createDataFrame(
        [(c, float(cvs[c]), int(c in kept)) for c in VARIATION_COLUMNS], "feature string, cv double, kept int"
    )
    return tidy(table)


@register(
    "target_clean",
    "SELECT SK_ID_CURR, CAST(TARGET AS INTEGER) AS TARGET, INCOME FROM clean_input WHERE TARGET IS NOT NULL",
    CLEAN_ROLES,
    CLEAN_INPUT,
)
def target_clean(spark, sf_dir):
    return clean.clean_target(clean_input(spark, sf_dir).select("SK_ID_CURR", "TARGET", "INCOME"), "TARGET")


OUTLIERS = {
    "measured": "SELECT loan_id, y, CASE WHEN loan_id % 7 <> 0 THEN amount END AS amount, age, grade FROM loans",
    "complete": "SELECT * FROM measured WHERE amount IS NOT NULL",
    "limits": ", ".join(
        ["SELECT 1 AS one"]
        + [
            f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}_{side}"
            for c in ["loan_id", "amount", "age", "grade"]
            for side, p in (("lo", 0.01), ("hi", 0.99))
        ]
    )
    + " FROM complete",
}


@register(
    "remove_outliers_2sided",
    """
SELECT loan_id, y, measured.amount, age, grade FROM measured, limits
WHERE measured.amount IS NULL OR NOT (loan_id < loan_id_lo OR loan_id > loan_id_hi OR amount < amount_lo OR amount > amount_hi
  OR age < age_lo OR age > age_hi OR grade < grade_lo OR grade > grade_hi)""",
    ["loans"],
    OUTLIERS,
)
def remove_outliers_2sided(spark, sf_dir):
    loans = roles.loans(spark, sf_dir)
    df = loans.select(
        "loan_id", "y", F.when(F.col("loan_id") % 7 != 0, F.col("amount")).alias("amount"), "age", "grade"
    )
    return clean.remove_outliers(df, 1.0, "y")


def sanitized(side: str, condition: str) -> str:
    where = f"FROM wide WHERE {condition}"
    parts = ", ".join(
        near_sql(
            f"coalesce(CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END, "
            f"(SELECT median(CAST({c} AS DOUBLE)) {where} AND isfinite(CAST({c} AS DOUBLE))))"
        )
        + f" AS {c}"
        for c in ["INCOME", "BIRTH", "RATIO"]
    )
    return f"SELECT '{side}' AS side, SK_ID_CURR, {parts} {where}"


@register(
    "sanitize_inf",
    sanitized("train", "TARGET IS NOT NULL") + " UNION ALL " + sanitized("test", "TARGET IS NULL"),
    CLEAN_ROLES,
    {k: VARIATION[k] for k in ("clean_input", "wide")},
)
def sanitize_inf(spark, sf_dir):
    """Train and test are each filled with their own medians."""
    df = clean_input(spark, sf_dir).withColumn("RATIO", expr.safe_ratio(F.col("INCOME"), F.col("FAMILY")))
    sides = []
    for name, part in (("train", df.where("TARGET IS NOT NULL")), ("test", df.where("TARGET IS NULL"))):
        fixed = clean.sanitize(part.select("SK_ID_CURR", "INCOME", "BIRTH", "RATIO"), keep=["SK_ID_CURR"])
        sides.append(tidy(fixed).select(F.lit(name).alias("side"), "*"))
    return sides[0].unionByName(sides[1])


# --------------------------------------------------------------------------


@register(
    "power_log_features",
    "SELECT loan_id, "
    + ", ".join(
        f"{near_sql(f'sqrt(abs({c}))')} AS {c}_pow0_5, {near_sql(f'CAST({c} AS DOUBLE) * {c}')} AS {c}_pow2, "
        f"{near_sql(f'ln(abs({c}) + 1e-6::DOUBLE)')} AS {c}_log"
        for c in ["amount", "grade"]
    )
    + " FROM loans",
    ["loans"],
)
def power_log(spark, sf_dir):
    df = roles.loans(spark, sf_dir).select("loan_id", "amount", "grade")
    return tidy(power_log_features(df, ["amount", "grade", "absent"]).drop("amount", "grade"))


@register("project_required", "SELECT age, amount, grade, y FROM loans", ["loans"])
def project_required_query(spark, sf_dir):
    return project_required(roles.loans(spark, sf_dir), ["age", "amount", "grade"], "y")


@register(
    "coerce_payload",
    """
SELECT loan_id, coalesce(CASE WHEN raw <> 'nan' THEN TRY_CAST(raw AS DOUBLE) END, 0.0::DOUBLE) AS raw,
  0.0::DOUBLE AS absent FROM texts""",
    ["loans"],
    {"texts": RAW_TEXT},
)
def coerce_payload(spark, sf_dir):
    payload = raw_text(spark, sf_dir).select("loan_id", F.create_map(F.lit("raw"), F.col("raw")).alias("features"))
    return score.expand_payload(payload, ["raw", "absent"], default=0.0)


@register(
    "label_map",
    """
SELECT loan_id, CASE y WHEN 0 THEN 'No Default' WHEN 1 THEN 'Default' END AS label,
  CASE WHEN score >= 0.4::DOUBLE THEN 'High Risk (Default)' ELSE 'Low Risk (No Default)' END AS status FROM loans""",
    ["loans"],
)
def label_map(spark, sf_dir):
    df = roles.loans(spark, sf_dir)
    return df.select(
        "loan_id",
        expr.label_text(F.col("y")).alias("label"),
        expr.status_text((F.col("score") >= 0.4).cast("int")).alias("status"),
    )


RECORD_FEATURES = ["DAYS_BIRTH", "AMT_CREDIT", "PAYMENT_RATE", "FLAG_OWN_CAR", "SK_ID_CURR_pow2", "EXT_SOURCE_2"]
RECORD_SQL = {
    "DAYS_BIRTH": "-20000.0::DOUBLE + {u} * 20000.0::DOUBLE",
    "AMT_CREDIT": "{u} * 1000000.0::DOUBLE",
    "PAYMENT_RATE": "{u}",
    "FLAG_OWN_CAR": "CASE WHEN {u} < 0.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END",
    "SK_ID_CURR_pow2": "{u} * 100.0::DOUBLE",
    "EXT_SOURCE_2": "{u} * 10.0::DOUBLE",
}


def unit_sql(text: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE)"


@register(
    "synthetic_records",
    "SELECT c_custkey, "
    + ", ".join(
        near_sql(RECORD_SQL[c].format(u=unit_sql(f"c_custkey || ':{c}:42'"))) + f" AS {c}" for c in RECORD_FEATURES
    )
    + " FROM customer",
)
def synthetic_records(spark, sf_dir):
    return tidy(score.synthetic_records(roles.table(spark, sf_dir, "customer"), "c_custkey", RECORD_FEATURES))
