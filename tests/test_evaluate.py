import pytest
from helpers import day
from pyspark.sql import functions as F

from barloom.operators import evaluate


def curve(spark, values, name="x"):
    return spark.createDataFrame([(name, day(i), float(v)) for i, v in enumerate(values)], "curve string, trading_date date, equity double")


def test_small_curve(spark):
    m = evaluate.curve_metrics(curve(spark, [100, 110, 99, 121]), "curve").first()
    assert m["total_return"] == pytest.approx(0.21) and m["max_drawdown"] == pytest.approx(-0.1) and m["longest_drawdown"] == 1
    assert m["best_year"] == m["worst_year"] == pytest.approx(0.21)


def test_rising_curve_has_infinite_ratios(spark):
    m = evaluate.curve_metrics(curve(spark, [100, 110, 121]), "curve").first()
    assert m["calmar"] == float("inf") and m["sortino"] == float("inf") and m["max_drawdown"] == 0


def test_first_year_drops_out(spark):
    c = spark.createDataFrame([("x", day(0, "2020-06-01"), 100.0), ("x", day(0, "2021-06-01"), 110.0), ("x", day(0, "2022-06-01"), 99.0)], "curve string, trading_date date, equity double")
    assert [(r["year"], round(r["year_return"], 6)) for r in evaluate.calendar_year_returns(c, "curve").orderBy("year").collect()] == [(2021, 0.1), (2022, -0.1)]


def test_fold_summary_ties(spark):
    f = spark.createDataFrame([("x", 1, 0.1), ("x", 2, -0.2), ("x", 3, -0.2), ("x", 4, 0.1)], "curve string, fold int, excess double")
    r = evaluate.fold_summary(f, "curve").first()
    assert (r["worst_fold"], r["best_fold"], r["positive_share"]) == (2, 4, 0.5) and r["median_excess"] == pytest.approx(-0.05)


def test_concentration_without_gains_is_one(spark):
    a = spark.createDataFrame([("x", day(0), -0.1)], "curve string, trading_date date, active double")
    assert evaluate.gain_concentration(a, 3, "curve").first()["concentration"] == 1


def test_chained_curve_starts_each_fold_flat(spark):
    c = curve(spark, [100, 110]).withColumn("fold", F.lit(1)).unionByName(curve(spark, [50, 25]).withColumn("trading_date", F.date_add("trading_date", 10)).withColumn("fold", F.lit(2)))
    assert [r["chained"] for r in evaluate.chained_oos_curve(c, "curve").orderBy("fold", "trading_date").collect()] == pytest.approx([100000, 110000, 110000, 55000])


def test_outcomes(spark):
    e = spark.createDataFrame([(False, True), (True, True), (True, False), (True, None)], "ok boolean, t boolean")
    assert [r["outcome"] for r in evaluate.outcome_classification(e, "ok", "t").collect()] == ["INVALID", "ROBUST", "NO_EVIDENCE", "NO_EVIDENCE"]


def test_curves_with_other_dates_are_refused(spark):


    rows = lambda name, days: [(name, day(i), 100.0 + i * i) for i in days]
    schema = "curve string, trading_date date, equity double"
    base = spark.createDataFrame(rows("all", range(5)), schema).withColumn("fold", F.lit(1)).drop("curve")
    curve = lambda days: spark.createDataFrame(rows("c", days), schema).withColumn("fold", F.lit(1))
    args = (("curve", "fold"), ("fold",))
    assert evaluate.relative_metrics(curve(range(5)), base, *args, strict=True).first()["tracking_error"] == 0
    for days in (range(1, 5), range(6), (0, 1, 2, 4)):
        with pytest.raises(Exception, match="other dates: c 1"):
            evaluate.relative_metrics(curve(days), base, *args, strict=True).collect()
        assert evaluate.relative_metrics(curve(days), base, *args).count() == 1
