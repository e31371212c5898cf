from pyspark.sql import functions as F

from millrace.operators import tables


def keys(df):
    return sorted(r["key"] for r in df.collect())


def test_low_quality_by_unknown_codes(spark):
    rows = [(d, i, i < bad, "x" if i < unknown else "k") for d, bad, unknown in ((1, 3, 6), (2, 2, 6), (3, 3, 5), (4, 6, 0)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc long, i long, bad boolean, code string")
    assert keys(tables.low_quality(df, "doc", F.col("bad"), 5, F.col("code"), F.col("code") == "x")) == [1, 4]
    assert keys(tables.low_quality(df, "doc", F.col("bad"))) == [4]


def test_row_arithmetic_with_common_ratio_dose_and_shares(spark):
    rows = [(1, i, 1000.0, 2.0, 1.0, 2400.0, 400.0, 2000.0) for i in range(3)] + [(1, 3, 1000.0, 2.0, 1.0, 9000.0, 0.0, 0.0), (2, 4, 1000.0, 2.0, 1.0, 2400.0, 0.0, 0.0)]
    rows += [(2, 5, 1000.0, 2.0, 3.0, 6000.0, 0.0, 0.0), (2, 6, 1000.0, 2.0, None, 2000.0, 500.0, 300.0)]
    df = spark.createDataFrame(rows, "doc long, i long, price double, n double, dose double, total double, own double, paid double")
    assert keys(tables.row_arithmetic(df, "i", ["price", "n"], "total", doc="doc", dose="dose", shares=["own", "paid"])) == [3, 4, 6]


def test_dates_and_table_sums(spark):
    rows = [(1, "2020-01-02", "2020-01-01", "2021-01-01"), (2, "1899-12-31", None, None), (3, "2020-01-01", "2020-01-02", "2020-01-01"), (4, "2020-01-01", "2020-01-02", "2020-02-01"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "i long, a string, b string, issued string").selectExpr("i", "cast(a as date) a", "cast(b as date) b", "cast(issued as date) issued")
    assert keys(tables.date_checks(df, "i", ["a", "b", "issued"], [("a", "b")], "issued")) == [1, 2, 3]
    assert keys(tables.date_checks(df, "i", ["a", "b", "issued"], [("a", "b")], "issued", ("b",))) == [1, 2]
    sums = spark.createDataFrame([(1, False, 100.0), (1, False, 900.0), (1, True, 1000.0), (2, False, 100.0), (2, True, 700.0), (3, False, 5.0)], "doc long, total boolean, x double")
    assert keys(tables.sum_table(sums, "doc", ["x"], F.col("total"))) == [2]
