import numpy as np
import pandas as pd
import pytest

from riskframe.operators import select


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 40, 600).astype(float)
    pdf = pd.DataFrame({"id": np.arange(600) % 7, "a": a, "b": a**2 + rng.integers(0, 300, 600), "c": rng.normal(size=600), "flat": 3.0})
    return spark.createDataFrame(pdf).repartition(4).persist(), pdf


@pytest.mark.parametrize("few_values", [0, 100, 300_000])
def test_matrix_needs_no_key(table, monkeypatch, few_values):
    """Rows are counted as they are: a repeated key merges none of them; broadcast and shuffled ranks give the same."""
    df, pdf = table
    monkeypatch.setattr(select, "FEW_VALUES", few_values)
    columns = ["a", "b", "c", "flat"]
    matrix = select.spearman_matrix(df, "id", columns)
    for x in "abc":
        for y in "abc":
            assert matrix[x, y] == pytest.approx(abs(pdf[x].rank().corr(pdf[y].rank())), abs=1e-9)
        assert matrix[x, "flat"] == matrix["flat", x] == 0.0
    assert len(matrix) == 16


def test_ranks_of_few_values_move_no_rows(table):
    plan = select.rank_columns(table[0], ["a", "b"], 1)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_missing_cells_are_refused(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, 3.0, 3.0)], "id long, a double, b double")
    with pytest.raises(ValueError):
        select.spearman_matrix(df, "id", ["a", "b"])
