"""describe against pandas, and its plan."""

import pandas as pd
import pytest

from corpuskit.operators import profile as PR


def _rows(spark):
    long = "x" * 100
    rows = [(i, float(i * i % 17), ["a", "b", None, "b"][i % 4], long + str(i // 2)) for i in range(40)] + [(None, None, None, None)]
    return spark.createDataFrame(rows, "n long, v double, s string, t string"), pd.DataFrame(rows, columns=["n", "v", "s", "t"])


@pytest.mark.parametrize("first", [None, 11])
def test_describe_equals_pandas(spark, first):
    df, plain = _rows(spark)
    if first is not None:
        df = df.where("n is not null")
        plain = plain.dropna(subset=["n"]).head(first)
    got = {(r.column, r.stat): r.value_num if r.value_str is None else r.value_str for r in PR.describe_columns(df, first=first, order="n").collect()}
    for c in ("n", "v"):
        d = plain[c].astype(float).describe()
        for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
            assert got[c, stat] == pytest.approx(d[stat], abs=1e-6), (c, stat)
    for c in ("s", "t"):
        counts = plain[c].dropna().value_counts()
        assert (got[c, "count"], got[c, "unique"], got[c, "freq"]) == (counts.sum(), len(counts), counts.max())
        assert got[c, "top"] == min(counts[counts == counts.max()].index)  # ties: the smallest, beyond the first characters too


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, None)], "n long, s string")
    got = {(r.column, r.stat): (r.value_num, r.value_str) for r in PR.describe_columns(df).collect()}
    assert got["n", "count"] == got["s", "count"] == got["s", "unique"] == (0.0, None) and got["s", "top"] == got["s", "freq"] == (None, None)


def test_three_scans_and_no_nested_loop(spark, tmp_path):
    df, _ = _rows(spark)
    df.write.parquet(str(tmp_path / "t"))
    plan = PR.describe_columns(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    tree = plan.split("== Initial Plan ==")[-1]
    assert sum(str(tmp_path) in line for line in tree.splitlines() if "Scan parquet" in line) <= 2  # the third wrote the histogram
