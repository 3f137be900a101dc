"""Profile, readers and cleaning rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from autostat.operators import cleaning, profile
from autostat.sources.tables import read_csv, read_table, snapshot, write_results


def test_profile_and_structure(spark, orders, events):
    assert profile.detect_structure(orders) == ("time_series", "o_orderdate")
    assert profile.detect_structure(events) == ("time_series", "ts")
    assert profile.detect_structure(orders.drop("o_orderdate")) == ("cross_sectional", None)
    rows = {r["column"]: r for r in profile.profile(orders).collect()}
    assert rows["o_orderdate"].is_time and rows["o_totalprice"].type == "numerical"


def test_structure_rules(spark):
    df = spark.createDataFrame([("2020-01-0%d" % i, float(i), i, "x") for i in range(1, 8)], "tanggal string, runtime double, year int, holiday string")
    assert profile.detect_structure(df, ["tanggal"]) == ("time_series", "tanggal")
    # A word inside another word is no time name; a number is a date only when it can be a year.
    assert profile.detect_structure(df, ["runtime", "holiday"]) == ("cross_sectional", None)
    assert profile.detect_structure(df, ["year"]) == ("cross_sectional", None)
    years = spark.range(2000, 2010).select(F.col("id").alias("year"))
    assert profile.detect_structure(years) == ("time_series", "year")


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,score,name,flag,day\n1,2.5,"a, b",true,2020-01-01\n2,NA,n/a,false,2020-01-02\n3,1e3,"line\nbreak",true,\n')
    df = read_table(spark, str(path))
    kinds = dict(df.dtypes)
    assert kinds == {"id": "bigint", "score": "double", "name": "string", "flag": "boolean", "day": "string"}
    rows = df.orderBy("id").collect()
    assert [r.score for r in rows] == [2.5, None, 1000.0]
    assert [r["name"] for r in rows] == ["a, b", None, "line\nbreak"]
    assert rows[2].day is None
    typed = read_csv(spark, str(path), "id long, score double, name string, flag boolean, day string")
    assert typed.count() == 3


def test_formats(spark, orders, tmp_path):
    for ext, fmt in ((".parquet", "parquet"), (".json", "json"), (".orc", "orc")):
        path = str(tmp_path / f"o{ext}")
        orders.select("o_orderkey", "o_totalprice").write.format(fmt).save(path)
        assert read_table(spark, path).count() == orders.count()
    with pytest.raises(ValueError, match="unsupported"):
        read_table(spark, str(tmp_path / "book.xlsx"))


def test_snapshot_and_results(spark, orders, tmp_path):
    stored = snapshot(orders, str(tmp_path / "in"), "r1")
    assert stored.count() == orders.count()
    with pytest.raises(Exception, match="exist"):
        snapshot(orders, str(tmp_path / "in"), "r1")
    for run in ("r1", "r2"):
        write_results({"a": orders.groupBy("o_orderstatus").count()}, str(tmp_path / "out"), run)
    back = spark.read.parquet(str(tmp_path / "out" / "a"))
    assert back.count() == 2 * orders.select("o_orderstatus").distinct().count()
    assert back.select("run_id").distinct().count() == 2


@pytest.mark.parametrize("bad,kind", [(1, "numerical"), (2, "categorical")])
def test_type_rule_is_strictly_below_a_fifth(spark, bad, kind):
    cells = ["x"] * bad + [str(i) for i in range(10 - bad)]
    d = cleaning.convert_types(spark.createDataFrame([(c,) for c in cells], "c string"), ["c"])
    assert d.types["c"] == kind


def test_missing_rules(spark):
    n = 100
    pdf = pd.DataFrame({"few": np.arange(n, dtype=float), "many": np.arange(n, dtype=float), "text": ["b", "a"] * (n // 2)})
    df = spark.createDataFrame(pdf).select(
        F.when(F.col("few") >= 4, F.col("few")).alias("few"),
        F.when(F.col("many") >= 5, F.col("many")).alias("many"),
        F.when(F.col("many") % 10 != 0, F.col("text")).alias("text"),
        F.lit(None).cast("double").alias("empty"), F.lit(None).cast("string").alias("none"),
    )
    report = {r["column"]: r for r in cleaning.missing_report(df, df.columns).collect()}
    assert report["few"].strategy == "drop" and report["many"].strategy == "impute" and report["few"].percent == 4.0
    out = cleaning.fill_missing(df, df.columns, {"few": "numerical", "many": "numerical", "text": "categorical", "empty": "numerical", "none": "categorical"})
    got = out.frame.toPandas()
    assert len(got) == 96 and got.notna().all().all()
    # The median is taken after the drop: rows 5..99 are left.
    assert got.many.min() == 5.0 and (got.many == 52.0).sum() == 2
    assert (got["empty"] == 0.0).all() and (got["none"] == "Unknown").all()
    log = {(r.step, r.column): r for r in out.log}
    assert log[("missing", "text")].imputed_value == "a"


@pytest.mark.parametrize("buckets", ["1000000", "50"])
def test_outliers_sequential(spark, buckets):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.exponential(5, 800), "b": rng.normal(size=800)})
    pdf["b"] += (pdf.a > 15) * 30
    spark.conf.set("spark.autostat.bucketRows", buckets)
    try:
        out = cleaning.iqr_filter(spark.createDataFrame(pdf), ["a", "b"])
        got, log = out.frame.toPandas(), out.log_frame().collect()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    want = pdf
    removed = []
    for c in ("a", "b"):
        q1, q3 = want[c].quantile([0.25, 0.75])
        keep = want[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        removed.append(int((~keep).sum()))
        want = want[keep]
    assert len(got) == len(want) and got.a.sum() == pytest.approx(want.a.sum())
    assert [r.n_rows for r in log] == removed


def test_zero_width_fence_and_few_rows(spark):
    same = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    assert cleaning.iqr_filter(same, ["v"]).frame.count() == 9
    three = spark.createDataFrame([(1.0,), (2.0,), (99.0,)], "v double")
    assert cleaning.iqr_filter(three, ["v"]).frame.count() == 3


def test_fences_reach_the_scan(spark, tmp_path, orders):
    orders.write.parquet(str(tmp_path / "o.parquet"))
    kept = cleaning.iqr_filter(spark.read.parquet(str(tmp_path / "o.parquet")), ["o_totalprice"]).frame
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_totalprice" in plan


def test_missing_column_is_named(spark, orders):
    with pytest.raises(ValueError, match="absent"):
        cleaning.convert_types(orders, ["absent"])
