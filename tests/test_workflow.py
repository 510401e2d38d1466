"""The stages in a row, from CSV files to processed train and test frames."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift
from riskframe.operators.runs import compare_runs, runs_table
from riskframe.plans import roles, workflow
from riskframe.sources import io


@pytest.fixture(scope="module")
def raw(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    train, test = roles.application_sides(spark, sf_dir)
    tables = {
        "application_train": train,
        "application_test": test,
        "bureau": roles.bureau(spark, sf_dir),
        "bureau_balance": roles.bureau_balance(spark, sf_dir),
        "previous_application": roles.previous(spark, sf_dir),
        "POS_CASH_balance": roles.pos(spark, sf_dir),
        "installments_payments": roles.instalments(spark, sf_dir),
        "credit_card_balance": roles.card(spark, sf_dir),
    }
    for name, df in tables.items():
        io.write_csv(df, f"{folder}/{name}.csv")
    return folder, {n: d.schema for n, d in tables.items()}


def test_stages(spark, raw, tmp_path):
    folder, schemas = raw
    table = workflow.ingest(spark, folder, str(tmp_path / "global"), schemas)
    assert table.count() == 147 and len(table.columns) > 350
    clean = workflow.preprocess(table, str(tmp_path / "clean"), 60, "median", 0.01, 0.0)
    assert clean.where(F.col("TARGET").isNull()).count() == 0 and clean.count() > 50
    assert len(clean.columns) < len(table.columns)
    narrow = clean.select("SK_ID_CURR", "TARGET", *[c for c in clean.columns if c not in ("SK_ID_CURR", "TARGET")][:14])
    record = workflow.quick_evaluation(narrow)
    assert 0.0 <= record[2]["roc_auc"] <= 1.0
    train, test, processed = workflow.engineer(
        narrow, str(tmp_path / "out"), n_select=6, cor_val=0.6, numTrees=5, maxDepth=4
    )
    assert processed[2]["train_rows"] + processed[2]["test_rows"] == clean.count()
    assert train.columns == test.columns
    again = workflow.read_processed(spark, str(tmp_path / "out"))
    assert again[0].count() == train.count()
    assert compare_runs(runs_table(spark, [processed]), "roc_auc_test").first()["position"] == 1
    sides = drift.drift_inputs(*again)
    names = [c for c in train.columns if c not in ("SK_ID_CURR", "TARGET")]
    report = drift.drift_report(sides, names, ["TARGET"])
    assert report.count() == len(names) + 1


def test_debug_mode_and_inferred_types(spark, raw):
    tables = workflow.read_raw(spark, raw[0], debug=True)
    assert dict(tables["bureau"].dtypes)["AMT_CREDIT_SUM"] == "double"
    assert tables["bureau_balance"].count() == 6000


def test_one_class_is_recorded_as_zero(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(5)], "SK_ID_CURR long, a double, TARGET int")
    assert workflow.quick_evaluation(df)[2]["roc_auc"] == 0.0


def test_clean_up_removes_stored_tables(spark):
    import os

    from riskframe import session

    before = session._MADE.pop(spark.sparkContext.applicationId, [])
    try:
        df = session.materialize(spark.range(5), "scrap")
        path = session._MADE[spark.sparkContext.applicationId][0].removeprefix("file://")
        assert df.count() == 5 and os.path.isdir(path)
        assert session.clean_up(spark) == 1 and not os.path.exists(path)
        assert session.clean_up(spark) == 0
    finally:
        session._MADE[spark.sparkContext.applicationId] = before
