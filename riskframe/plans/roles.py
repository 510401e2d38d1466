"""The sample tables in the roles of the credit-history model.

Each role is given twice: as a DataFrame and as SQL text for the comparison
engine. The sample tables hold no missing values and no loan columns, so the
roles derive both from keys and amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days_between(ts, day: str):
    return F.date_diff(ts.cast("date"), F.lit(day).cast("date"))


# --------------------------------------------------------------------------


def application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clients; TARGET is missing for every fifth one."""
    k, balance = F.col("c_custkey"), F.abs(F.col("c_acctbal"))
    joined = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        k.alias("SK_ID_CURR"),
        F.when(k % 5 != 0, (F.col("c_acctbal") < 0).cast("int")).alias("TARGET"),
        F.when(k % 50 == 7, "XNA").when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("CODE_GENDER"),
        F.when(k % 3 == 0, "Y").otherwise("N").alias("FLAG_OWN_CAR"),
        F.when(k % 13 == 0, None).when(k % 4 < 3, "Y").otherwise("N").alias("FLAG_OWN_REALTY"),
        F.when(k % 17 != 0, F.col("c_mktsegment")).alias("NAME_INCOME_TYPE"),
        F.col("r_name").alias("NAME_REGION"),
        (-(7000 + (k * 7919) % 18000)).cast("int").alias("DAYS_BIRTH"),
        F.when(k % 6 == 0, 365243).otherwise(-((k * 104729) % 9000)).cast("int").alias("DAYS_EMPLOYED"),
        (F.lit(20000.0) + balance * 10.0).alias("AMT_INCOME_TOTAL"),
        (F.lit(50000.0) + balance * 25.0 + F.col("c_nationkey") * 1000.0).alias("AMT_CREDIT"),
        F.when(k % 19 != 0, F.lit(2500.0) + balance * 1.25 + (k % 7) * 100.0).alias("AMT_ANNUITY"),
        F.when(k % 29 == 0, 0.0).when(k % 23 != 0, (1 + k % 4).cast("double")).alias("CNT_FAM_MEMBERS"),
    )


APPLICATION_SQL = """
SELECT c_custkey AS SK_ID_CURR,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_acctbal < 0 AS INTEGER) END AS TARGET,
  CASE WHEN c_custkey % 50 = 7 THEN 'XNA' WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
  CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 4 < 3 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
  CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS NAME_INCOME_TYPE,
  r_name AS NAME_REGION,
  CAST(-(7000 + (c_custkey * 7919) % 18000) AS INTEGER) AS DAYS_BIRTH,
  CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 104729) % 9000) END AS INTEGER) AS DAYS_EMPLOYED,
  20000.0::DOUBLE + abs(c_acctbal) * 10.0::DOUBLE AS AMT_INCOME_TOTAL,
  50000.0::DOUBLE + abs(c_acctbal) * 25.0::DOUBLE + c_nationkey * 1000.0::DOUBLE AS AMT_CREDIT,
  CASE WHEN c_custkey % 19 <> 0
    THEN 2500.0::DOUBLE + abs(c_acctbal) * 1.25::DOUBLE + (c_custkey % 7) * 100.0::DOUBLE END AS AMT_ANNUITY,
  CASE WHEN c_custkey % 29 = 0 THEN 0.0::DOUBLE
    WHEN c_custkey % 23 <> 0 THEN CAST(1 + c_custkey % 4 AS DOUBLE) END AS CNT_FAM_MEMBERS
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def application_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows and, without a TARGET column, the others."""
    df = application(spark, sf_dir)
    return df.where(F.col("TARGET").isNotNull()), df.where(F.col("TARGET").isNull()).drop("TARGET")


# --------------------------------------------------------------------------


def bureau(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    days = days_between(F.col("o_orderdate"), "2001-08-02")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        k.alias("SK_ID_BUREAU"),
        F.when(F.col("o_orderstatus") == "O", "Active")
        .when(F.col("o_orderstatus") == "F", "Closed")
        .otherwise("Sold")
        .alias("CREDIT_ACTIVE"),
        F.when(k % 31 != 0, F.col("o_orderpriority")).alias("CREDIT_TYPE"),
        days.alias("DAYS_CREDIT"),
        F.when(k % 9 != 0, days + (k % 1000).cast("int")).alias("DAYS_CREDIT_ENDDATE"),
        (days + (k % 30).cast("int")).alias("DAYS_CREDIT_UPDATE"),
        (k % 5).cast("int").alias("CREDIT_DAY_OVERDUE"),
        F.when(k % 3 != 0, price * 0.01).alias("AMT_CREDIT_MAX_OVERDUE"),
        price.alias("AMT_CREDIT_SUM"),
        F.when(F.col("o_orderstatus") != "P", price * 0.4).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(k % 10 == 0, price * 0.05).otherwise(0.0).alias("AMT_CREDIT_SUM_OVERDUE"),
        F.when(k % 4 != 0, price * 1.5).alias("AMT_CREDIT_SUM_LIMIT"),
        F.when(k % 8 != 0, price * 0.06).alias("AMT_ANNUITY"),
        (k % 3).cast("int").alias("CNT_CREDIT_PROLONG"),
    )


BUREAU_SQL = """
SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
  CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE,
  CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS CREDIT_TYPE,
  date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) AS DAYS_CREDIT,
  CASE WHEN o_orderkey % 9 <> 0
    THEN date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) + o_orderkey % 1000 END AS DAYS_CREDIT_ENDDATE,
  date_diff('day', DATE '2001-08-02', CAST(o_orderdate AS DATE)) + o_orderkey % 30 AS DAYS_CREDIT_UPDATE,
  o_orderkey % 5 AS CREDIT_DAY_OVERDUE,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * 0.01::DOUBLE END AS AMT_CREDIT_MAX_OVERDUE,
  o_totalprice AS AMT_CREDIT_SUM,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 0.4::DOUBLE END AS AMT_CREDIT_SUM_DEBT,
  CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 0.05::DOUBLE ELSE 0.0::DOUBLE END AS AMT_CREDIT_SUM_OVERDUE,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 1.5::DOUBLE END AS AMT_CREDIT_SUM_LIMIT,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice * 0.06::DOUBLE END AS AMT_ANNUITY,
  o_orderkey % 3 AS CNT_CREDIT_PROLONG
FROM orders
"""


def bureau_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        (-F.col("l_linenumber")).alias("MONTHS_BALANCE"),
        F.when(F.col("l_partkey") % 37 != 0, F.col("l_linestatus")).alias("STATUS"),
    )


BUREAU_BALANCE_SQL = """
SELECT l_orderkey AS SK_ID_BUREAU, -l_linenumber AS MONTHS_BALANCE,
  CASE WHEN l_partkey % 37 <> 0 THEN l_linestatus END AS STATUS
FROM lineitem
"""


# --------------------------------------------------------------------------


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, cut = F.col("l_extendedprice"), F.col("l_discount")
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    days = days_between(F.col("l_shipdate"), "2002-01-01")
    return joined.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.when(F.col("l_returnflag") == "A", "Approved")
        .when(F.col("l_returnflag") == "R", "Refused")
        .otherwise("Canceled")
        .alias("NAME_CONTRACT_STATUS"),
        F.when(F.col("l_partkey") % 41 != 0, F.col("l_linestatus")).alias("NAME_CONTRACT_TYPE"),
        F.when(F.col("l_tax") > 0, price * F.col("l_tax")).alias("AMT_ANNUITY"),
        price.alias("AMT_APPLICATION"),
        F.when((F.col("l_quantity") == 2) & (F.col("l_orderkey") % 10 == 0), 0.0)
        .when(F.col("l_quantity") != 1, price * (F.lit(1.0) - cut))
        .alias("AMT_CREDIT"),
        F.when(cut > 0, price * cut).alias("AMT_DOWN_PAYMENT"),
        price.alias("AMT_GOODS_PRICE"),
        (F.col("l_linenumber") + 8).alias("HOUR_APPR_PROCESS_START"),
        F.when(cut > 0, cut).alias("RATE_DOWN_PAYMENT"),
        days.alias("DAYS_DECISION"),
        F.when(F.col("l_quantity") != 7, F.col("l_quantity")).alias("CNT_PAYMENT"),
        F.when(F.col("l_quantity") == 50, 365243).otherwise(days + 30).alias("DAYS_FIRST_DRAWING"),
        F.when(F.col("l_quantity") == 49, 365243).otherwise(days + 60).alias("DAYS_FIRST_DUE"),
        F.when(F.col("l_quantity") == 48, 365243).otherwise(days + 300).alias("DAYS_LAST_DUE_1ST_VERSION"),
        F.when(F.col("l_quantity") == 47, 365243).otherwise(days + 330).alias("DAYS_LAST_DUE"),
        F.when(F.col("l_quantity") == 46, 365243).otherwise(days + 400).alias("DAYS_TERMINATION"),
    )


PREVIOUS_SQL = """
SELECT o_custkey AS SK_ID_CURR,
  CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
  CASE WHEN l_partkey % 41 <> 0 THEN l_linestatus END AS NAME_CONTRACT_TYPE,
  CASE WHEN l_tax > 0 THEN l_extendedprice * l_tax END AS AMT_ANNUITY,
  l_extendedprice AS AMT_APPLICATION,
  CASE WHEN l_quantity = 2 AND l_orderkey % 10 = 0 THEN 0.0::DOUBLE
    WHEN l_quantity <> 1 THEN l_extendedprice * (1.0::DOUBLE - l_discount) END AS AMT_CREDIT,
  CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount END AS AMT_DOWN_PAYMENT,
  l_extendedprice AS AMT_GOODS_PRICE,
  l_linenumber + 8 AS HOUR_APPR_PROCESS_START,
  CASE WHEN l_discount > 0 THEN l_discount END AS RATE_DOWN_PAYMENT,
  date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) AS DAYS_DECISION,
  CASE WHEN l_quantity <> 7 THEN l_quantity END AS CNT_PAYMENT,
  CASE WHEN l_quantity = 50 THEN 365243 ELSE date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) + 30 END AS DAYS_FIRST_DRAWING,
  CASE WHEN l_quantity = 49 THEN 365243 ELSE date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) + 60 END AS DAYS_FIRST_DUE,
  CASE WHEN l_quantity = 48 THEN 365243 ELSE date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) + 300 END AS DAYS_LAST_DUE_1ST_VERSION,
  CASE WHEN l_quantity = 47 THEN 365243 ELSE date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) + 330 END AS DAYS_LAST_DUE,
  CASE WHEN l_quantity = 46 THEN 365243 ELSE date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) + 400 END AS DAYS_TERMINATION
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def instalments(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    paid = F.col("l_quantity") != 50
    return joined.select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("l_linenumber").cast("double").alias("NUM_INSTALMENT_VERSION"),
        days_between(F.col("o_orderdate"), "2002-01-01").cast("double").alias("DAYS_INSTALMENT"),
        F.when(paid, days_between(F.col("l_shipdate"), "2002-01-01").cast("double")).alias("DAYS_ENTRY_PAYMENT"),
        F.when((F.col("l_quantity") == 3) & (F.col("l_orderkey") % 10 == 1), 0.0).otherwise(price).alias("AMT_INSTALMENT"),
        F.when(paid, price * (F.lit(1.0) - F.col("l_discount"))).alias("AMT_PAYMENT"),
    )


INSTALMENTS_SQL = """
SELECT o_custkey AS SK_ID_CURR, CAST(l_linenumber AS DOUBLE) AS NUM_INSTALMENT_VERSION,
  CAST(date_diff('day', DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS DAYS_INSTALMENT,
  CASE WHEN l_quantity <> 50
    THEN CAST(date_diff('day', DATE '2002-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) END AS DAYS_ENTRY_PAYMENT,
  CASE WHEN l_quantity = 3 AND l_orderkey % 10 = 1 THEN 0.0::DOUBLE ELSE l_extendedprice END AS AMT_INSTALMENT,
  CASE WHEN l_quantity <> 50 THEN l_extendedprice * (1.0::DOUBLE - l_discount) END AS AMT_PAYMENT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

INSTALMENT_COLUMNS_SQL = """
SELECT *, CASE WHEN AMT_INSTALMENT <> 0 THEN AMT_PAYMENT / AMT_INSTALMENT
    WHEN AMT_INSTALMENT = 0 AND AMT_PAYMENT > 0 THEN CAST('inf' AS DOUBLE)
    WHEN AMT_INSTALMENT = 0 AND AMT_PAYMENT < 0 THEN CAST('-inf' AS DOUBLE) END AS PAYMENT_PERC,
  AMT_INSTALMENT - AMT_PAYMENT AS PAYMENT_DIFF,
  CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT > 0 THEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT ELSE 0 END AS DPD,
  CASE WHEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT > 0 THEN DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT ELSE 0 END AS DBD
FROM instalments
"""


def pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("SK_ID_CURR"),
        days_between(F.col("ts"), "2024-02-01").alias("MONTHS_BALANCE"),
        F.floor("value").cast("int").alias("SK_DPD"),
        (F.col("event_id") % 7).cast("int").alias("SK_DPD_DEF"),
        F.when(F.col("event_id") % 43 != 0, F.col("event_type")).alias("NAME_CONTRACT_STATUS"),
    )


POS_SQL = """
SELECT user_id AS SK_ID_CURR, date_diff('day', DATE '2024-02-01', CAST(ts AS DATE)) AS MONTHS_BALANCE,
  CAST(floor(value) AS INTEGER) AS SK_DPD, CAST(event_id % 7 AS INTEGER) AS SK_DPD_DEF,
  CASE WHEN event_id % 43 <> 0 THEN event_type END AS NAME_CONTRACT_STATUS
FROM events
"""


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("SK_ID_PREV"),
        F.col("user_id").alias("SK_ID_CURR"),
        days_between(F.col("ts"), "2024-02-01").alias("MONTHS_BALANCE"),
        F.col("value").alias("AMT_BALANCE"),
        F.when(F.col("event_type") != "error", F.col("value") * 0.5).alias("AMT_DRAWINGS_CURRENT"),
        F.when(F.col("event_id") % 43 != 0, F.col("event_type")).alias("NAME_CONTRACT_STATUS"),
    )


CARD_SQL = """
SELECT event_id AS SK_ID_PREV, user_id AS SK_ID_CURR,
  date_diff('day', DATE '2024-02-01', CAST(ts AS DATE)) AS MONTHS_BALANCE, value AS AMT_BALANCE,
  CASE WHEN event_type <> 'error' THEN value * 0.5::DOUBLE END AS AMT_DRAWINGS_CURRENT,
  CASE WHEN event_id % 43 <> 0 THEN event_type END AS NAME_CONTRACT_STATUS
FROM events
"""


# --------------------------------------------------------------------------


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order rows with a label, a score with ties and a few numeric features."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    label = (price < 40000).cast("int")
    noise = F.conv(F.substring(F.md5(F.concat_ws(":", k.cast("string"), F.lit("7"))), 1, 3), 16, 10).cast("double")
    return table(spark, sf_dir, "orders").select(
        k.alias("loan_id"),
        F.col("o_custkey").alias("client_id"),
        label.alias("y"),
        (noise / 8192.0 + label * 0.25).alias("score"),
        F.floor(noise / 16).alias("noise_band"),
        (price * 0.001).alias("amount"),
        days_between(F.col("o_orderdate"), "1995-01-01").alias("age"),
        (k % 11).cast("int").alias("grade"),
        F.lit(3.0).alias("flat"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


LOANS_SQL = """
SELECT o_orderkey AS loan_id, o_custkey AS client_id, CAST(o_totalprice < 40000 AS INTEGER) AS y,
  CAST(CAST('0x' || substr(md5(o_orderkey || ':7'), 1, 3) AS BIGINT) AS DOUBLE) / 8192.0::DOUBLE
    + CAST(o_totalprice < 40000 AS INTEGER) * 0.25::DOUBLE AS score,
  CAST(floor(CAST('0x' || substr(md5(o_orderkey || ':7'), 1, 3) AS BIGINT) / 16.0) AS BIGINT) AS noise_band,
  o_totalprice * 0.001::DOUBLE AS amount,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS age,
  CAST(o_orderkey % 11 AS INTEGER) AS grade, 3.0::DOUBLE AS flat,
  o_orderpriority AS priority, o_orderstatus AS status
FROM orders
"""

SQL = {
    "application": APPLICATION_SQL,
    "bureau": BUREAU_SQL,
    "bureau_balance": BUREAU_BALANCE_SQL,
    "previous": PREVIOUS_SQL,
    "instalments": INSTALMENTS_SQL,
    "instalment_columns": INSTALMENT_COLUMNS_SQL,
    "pos": POS_SQL,
    "card": CARD_SQL,
    "loans": LOANS_SQL,
}


def with_roles(query: str, *roles: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with the CTEs of the roles it reads."""
    parts = [f"{name} AS ({SQL[name].strip()})" for name in roles]
    parts += [f"{name} AS ({text.strip()})" for name, text in (extra or {}).items()]
    return (f"WITH {', '.join(parts)}\n" if parts else "") + query.strip()
