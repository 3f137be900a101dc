"""Queries: (spark, folder of parquet tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import restore_keys
from autostat.operators import cleaning, compare, correlate, mediate, plotdata, profile, regress
from autostat.operators import series as ordered
from autostat.operators import timeseries as ts
from autostat.operators.describe import describe, group_moments, group_summary
from autostat.operators.gram import correlation_matrix
from autostat.operators.instrument import instrument
from autostat.operators.kendall import kendall
from autostat.operators.normality import normality
from autostat.plans.analysis import analyze
from autostat.plans.routing import Comparison, auto_test
from autostat.plans.spec import AnalysisSpec
from autostat.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round doubles for comparison across engines (`special`: digits per column); counts as BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, special.get(f.name, digits))
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- inputs derived from the tables ---


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    o, k, price = table(spark, folder, "orders"), F.col("o_orderkey"), F.col("o_totalprice")
    return o.select(
        "o_orderkey", "o_orderstatus",
        F.when(k % 50 != 0, price).alias("y_drop"),
        F.when(k % 7 != 0, price).alias("y_impute"),
        F.when(k % 7 != 0, F.col("o_orderpriority")).alias("s_impute"),
        F.when(k % 10 == 0, "abc").otherwise(price.cast("string")).alias("txt_numeric"),
        F.when(k % 4 == 0, "abc").otherwise(price.cast("string")).alias("txt_text"),
    )


def charged(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.col("l_extendedprice").alias("price"),
        "l_discount", disc.alias("discounted"), (disc * (1 + F.col("l_tax"))).alias("charge"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    c = charged(spark, folder)
    return c.select(
        (F.col("price") / 1000).alias("item_price"), (F.col("discounted") / 1000).alias("item_discounted"),
        (F.col("charge") / 1000).alias("item_charge"), F.col("l_quantity").alias("item_quantity"),
    )


ITEMS = ["item_price", "item_discounted", "item_charge", "item_quantity"]


def halves(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    half = F.when(F.to_date("o_orderdate") < F.to_date(F.lit("1998-01-01")), "before").otherwise("from")
    return o.groupBy("o_custkey", half.alias("half")).agg(F.avg("o_totalprice").alias("price"))


def two_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").where(F.col("o_orderstatus").isin("F", "O"))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.sum("value"), 2).alias("y"), F.count(F.lit(1)).cast("double").alias("x")
    )


def daily_by_type(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("y"))


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice") / 1000, 3).alias("y"))


def running_total(spark: SparkSession, folder: str) -> DataFrame:
    """A trending series: day number plus the day's mean value."""
    d = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return d.agg(F.avg("o_totalprice").alias("v")).select(
        "day", (F.unix_date("day") * 100 + F.round(F.col("v") / 1000, 3)).cast("double").alias("y")
    )


# --- queries ---

TEST = {"p_value": 6, "statistic": 4, "effect_size": 6, "df2": 4, "df1": 4}


def test_row(df: DataFrame, *keys: str, **digits: int) -> DataFrame:
    names = ["test", "statistic", "df1", "df2", "p_value", "is_significant", "effect_name", "effect_size", "higher_group", "method", "decision"]
    return tidy(df.select(*keys, *names), **{**TEST, **digits})


def profile_orders(spark, folder):
    return tidy(profile.profile(table(spark, folder, "orders")))


def detect_structure_events(spark, folder):
    e = table(spark, folder, "events")
    structure, column = profile.detect_structure(e)
    return e.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(structure).alias("structure"), F.lit(column).alias("time_col"), "n_rows")


def convert_types(spark, folder):
    d = cleaning.convert_types(dirty_orders(spark, folder), ["txt_numeric", "txt_text"])
    kinds = [F.lit(d.types[c]).alias(f"{c}_type") for c in ("txt_numeric", "txt_text")]
    return d.frame.select("o_orderkey", "txt_numeric", "txt_text", *kinds)


DIRTY = ["y_drop", "y_impute", "s_impute", "o_orderstatus"]


def missing_report(spark, folder):
    return tidy(cleaning.missing_report(dirty_orders(spark, folder), DIRTY), 2)


def drop_sparse_missing(spark, folder):
    return cleaning.drop_sparse_missing(dirty_orders(spark, folder), DIRTY).select("o_orderkey", "y_drop", "y_impute")


def impute_median(spark, folder):
    types = {"y_impute": "numerical"}
    return cleaning.fill_missing(dirty_orders(spark, folder), ["y_impute"], types).frame.select("o_orderkey", "y_impute")


def impute_mode(spark, folder):
    types = {"s_impute": "categorical"}
    return cleaning.fill_missing(dirty_orders(spark, folder), ["s_impute"], types).frame.select("o_orderkey", "s_impute")


def iqr_filter_one(spark, folder):
    return cleaning.iqr_filter(table(spark, folder, "events"), ["value"]).frame.select("event_id", "value")


def amounts(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("rebate"),
        (F.col("l_extendedprice") * F.col("l_quantity")).alias("volume"), "l_quantity",
    )


def iqr_filter_sequential(spark, folder):
    kept = cleaning.iqr_filter(amounts(spark, folder), ["volume", "rebate", "l_quantity"]).frame
    return tidy(kept.select("l_orderkey", "l_linenumber", "l_partkey", "rebate", "volume"), 4)


def iqr_filter_simultaneous(spark, folder):
    kept = cleaning.iqr_filter(amounts(spark, folder), ["volume", "rebate"], simultaneous=True).frame
    return tidy(kept.select("l_orderkey", "l_linenumber", "l_partkey", "rebate", "volume"), 4)


CLEAN = ["y_drop", "y_impute", "s_impute", "txt_numeric"]


def clean_orders(spark, folder):
    return cleaning.clean(dirty_orders(spark, folder), CLEAN, carry=["o_orderkey"]).frame.select("o_orderkey", *CLEAN)


def cleaning_log(spark, folder):
    return cleaning.clean(dirty_orders(spark, folder), CLEAN).log_frame()


def describe_lineitem(spark, folder):
    return tidy(describe(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4, variance=2)


def describe_by_nation(spark, folder):
    return tidy(describe(table(spark, folder, "customer"), ["c_acctbal"], ["c_nationkey"]), 4, variance=2)


def describe_by_supplier(spark, folder):
    return tidy(describe(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_suppkey"]), 4, variance=1)


def group_summary_orders(spark, folder):
    return tidy(group_summary(table(spark, folder, "orders"), "o_totalprice", "o_orderstatus", ["o_orderpriority"]), 4)


def group_guard_suppliers(spark, folder):
    s = table(spark, folder, "supplier").select("s_nationkey", "s_acctbal")
    moments = group_moments(s, "s_acctbal", "s_nationkey")
    return compare.group_guard(moments, "s_nationkey")


def instrument_items(spark, folder):
    return tidy(instrument(items(spark, folder), ITEMS), 6)


def normality_orders(spark, folder):
    return tidy(normality(table(spark, folder, "orders"), "o_totalprice"), 7, p_value=6)


def normality_by_priority(spark, folder):
    return tidy(normality(table(spark, folder, "orders"), "o_totalprice", ["o_orderpriority"]), 7, p_value=6)


def shapiro_by_customer(spark, folder):
    return tidy(normality(table(spark, folder, "orders"), "o_totalprice", ["o_custkey"]), 6, p_value=5)


def welch_t(spark, folder):
    return test_row(compare.welch_t(group_moments(two_status(spark, folder), "o_totalprice", "o_orderstatus"), "o_orderstatus"))


def paired_t(spark, folder):
    return test_row(compare.paired_t(compare.pair_rows(halves(spark, folder), "price", "half", "o_custkey")))


def wilcoxon(spark, folder):
    return test_row(compare.signed_rank(compare.pair_rows(halves(spark, folder), "price", "half", "o_custkey")))


def _parts(df, y, group, **more):
    return Comparison(df, AnalysisSpec(y, "compare", group=group, **more).validated())


def mann_whitney(spark, folder):
    c = _parts(two_status(spark, folder), "o_totalprice", "o_orderstatus")
    return test_row(compare.mann_whitney(c.facts, c.facts, "__group"))


def mann_whitney_by_priority(spark, folder):
    c = _parts(two_status(spark, folder), "o_totalprice", "o_orderstatus", keys=["o_orderpriority"])
    return test_row(restore_keys(compare.mann_whitney(c.facts, c.facts, "__group", c.keys), c.names), "o_orderpriority")


def mann_whitney_exact(spark, folder):
    """Did the eight dearest orders come later than the rest? Eight rows against all others, exact at any size."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    dearest = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8).select("o_orderkey", F.lit("dearest").alias("side"))
    sides = o.join(F.broadcast(dearest), "o_orderkey", "left").select("o_orderkey", F.coalesce("side", F.lit("rest")).alias("side"))
    c = _parts(sides, "o_orderkey", "side")
    return test_row(compare.mann_whitney(c.facts, c.facts, "__group")).drop("effect_size")


def welch_constant_groups(spark, folder):
    flat = two_status(spark, folder).select("o_orderstatus", F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(2.0).alias("y"))
    return test_row(compare.welch_t(group_moments(flat, "y", "o_orderstatus"), "o_orderstatus"))


def constant_by_type(spark, folder):
    """A number that the event type alone decides."""
    value = F.length("event_type") * 1000 + F.ascii("event_type")
    return group_moments(table(spark, folder, "events").select("event_type", value.alias("y")), "y", "event_type")


def anova_constant_groups(spark, folder):
    return test_row(compare.anova(constant_by_type(spark, folder), "event_type"))


def tukey_constant_groups(spark, folder):
    return tidy(compare.tukey_hsd(constant_by_type(spark, folder), "event_type"), 5)


def kruskal_events(spark, folder):
    c = _parts(table(spark, folder, "events"), "value", "event_type")
    return test_row(compare.kruskal(c.facts, c.facts, "__group"))


def kruskal_quantity(spark, folder):
    """Heavy ties: 50 values over all line items."""
    c = _parts(table(spark, folder, "lineitem"), "l_quantity", "l_returnflag")
    return test_row(compare.kruskal(c.facts, c.facts, "__group"))


def anova_events(spark, folder):
    return test_row(compare.anova(group_moments(table(spark, folder, "events"), "value", "event_type"), "event_type"))


def anova_by_segment(spark, folder):
    keys = ["o_orderpriority"]
    return test_row(compare.anova(group_moments(table(spark, folder, "orders"), "o_totalprice", "o_orderstatus", keys), "o_orderstatus", keys), *keys)


def tukey_events(spark, folder):
    t = compare.tukey_hsd(group_moments(table(spark, folder, "events"), "value", "event_type"), "event_type")
    return tidy(t, 5)


def pairwise_mann_whitney(spark, folder):
    p = compare.pairwise_mann_whitney(table(spark, folder, "events"), "value", "event_type")
    return tidy(p, 5)


def ols_simple(spark, folder):
    return tidy(regress.regression(charged(spark, folder), "charge", ["price"]).drop("is_model_significant", "model"), 5, t=3, f_statistic=0, std_err=6)


def ols_multi(spark, folder):
    t = regress.regression(charged(spark, folder), "price", ["l_quantity", "l_discount"])
    return tidy(regress.coefficients(t), 4, p_value=5)


def ols_fit_by_flag(spark, folder):
    keys = ["l_returnflag"]
    t = regress.regression(charged(spark, folder), "price", ["l_quantity", "l_discount"], keys)
    return tidy(regress.fit_summary(t, keys), 6, f_statistic=4, p_value=5)


def vif_eliminate(spark, folder):
    return tidy(regress.vif_log(charged(spark, folder), "charge", ["l_quantity", "price", "discounted"]), 3)


def pearson_table(spark, folder):
    return tidy(correlate.pearson(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 6)


def spearman_table(spark, folder):
    return tidy(correlate.spearman(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 6)


def spearman_by_brand(spark, folder):
    return tidy(correlate.spearman(table(spark, folder, "part"), "p_retailprice", ["p_size"], ["p_brand"]), 6)


def kendall_table(spark, folder):
    return tidy(kendall(table(spark, folder, "lineitem"), "l_quantity", ["l_discount", "l_tax", "l_linenumber"]), 6)


def kendall_by_brand(spark, folder):
    parts = table(spark, folder, "part").select("p_brand", "p_size", F.round(F.col("p_retailprice") / 50).alias("price"))
    return tidy(kendall(parts, "price", ["p_size"], ["p_brand"]), 6)


def corr_matrix(spark, folder):
    return tidy(correlation_matrix(charged(spark, folder), ["charge", "price", "l_quantity"]), 6)


def mediation_full(spark, folder):
    m = mediate.mediation(charged(spark, folder), "charge", "price", "discounted")
    return tidy(mediate.mediation_paths(m), 5, statistic=2)


def mediation_none(spark, folder):
    m = mediate.mediation(charged(spark, folder), "price", "l_discount", "l_quantity")
    return tidy(mediate.mediation_paths(m), 4)


def moderation(spark, folder):
    t = mediate.moderation(charged(spark, folder), "price", "l_quantity", "l_discount")
    return tidy(regress.coefficients(t), 4, p_value=5)


def moderation_collinear(spark, folder):
    """The moderator is twice the predictor: the smallest of the equally good coefficients are reported."""
    li = charged(spark, folder).withColumn("twice", F.col("l_quantity") * 2)
    return tidy(regress.coefficients(mediate.moderation(li, "price", "l_quantity", "twice")), 4, p_value=5)


def auto_compare(spark, folder):
    return test_row(auto_test(table(spark, folder, "orders"), AnalysisSpec("o_totalprice", "compare", group="o_orderstatus")))


def auto_compare_by_segment(spark, folder):
    spec = AnalysisSpec("o_totalprice", "compare", group="o_orderstatus", keys=("o_orderpriority",))
    return test_row(auto_test(table(spark, folder, "orders"), spec), "o_orderpriority")


def auto_compare_small_segments(spark, folder):
    """One test per customer: small groups are reported, not tested."""
    spec = AnalysisSpec("o_totalprice", "compare", group="o_orderstatus", keys=("o_custkey",))
    t = auto_test(table(spark, folder, "orders"), spec)
    tested = F.coalesce("is_normal", F.lit(False)).alias("is_normal")
    return tidy(t.select("o_custkey", "n_groups", tested, "status", "test"))


def auto_influence(spark, folder):
    return test_row(auto_test(charged(spark, folder), AnalysisSpec("price", "influence", xs=("l_quantity", "l_discount"))))


def auto_correlate(spark, folder):
    return test_row(auto_test(charged(spark, folder), AnalysisSpec("price", "correlate", xs=("l_quantity", "l_discount"))))


def auto_mediate(spark, folder):
    spec = AnalysisSpec("charge", "mediate", xs=("price",), mediator="discounted")
    return test_row(auto_test(charged(spark, folder), spec), statistic=2)


def analyze_orders(spark, folder):
    """Flagship: the whole analysis, cleaning to decision."""
    spec = AnalysisSpec("o_totalprice", "compare", group="o_orderstatus")
    return test_row(analyze(table(spark, folder, "orders"), spec)["test_result"])


def scatter_grid(spark, folder):
    return plotdata.scatter_grid(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", 40)


def box_stats(spark, folder):
    return tidy(plotdata.box_stats(table(spark, folder, "events"), "value", "event_type"), 4)


def trend_line(spark, folder):
    return tidy(plotdata.trend_line(charged(spark, folder), "charge", "price", ["l_returnflag"]), 5)


def difference_series(spark, folder):
    s = ordered.place(daily_by_type(spark, folder), "day", ["y"], ["event_type"])
    return tidy(ordered.differences(s, "y", 2), 2)


def seasonal_difference(spark, folder):
    s = ordered.place(daily(spark, folder), "day", ["y"])
    return tidy(ordered.seasonal_difference(s, "y", 7), 2)


def _stationarity(frame, keys=()):
    return ts.Stationarity(ordered.place(frame, "day", ["y"], keys), "y").tests()


def adf_t(spark, folder):
    t = _stationarity(daily_orders(spark, folder))
    return tidy(t.select("d", "n", "adf_stat", "adf_lag"), 3)


def adf_trend(spark, folder):
    """Unit-root tests of a steep trend, whose levels are far larger than its steps."""
    c = table(spark, folder, "customer")
    y = (F.col("c_custkey") * 100 + F.round(F.col("c_acctbal") / 1000, 3)).cast("double")
    t = _stationarity(c.select(F.col("c_custkey").alias("day"), y.alias("y")))
    return tidy(t.select("d", "n", "adf_stat", "adf_lag"), 3)


def kpss_eta(spark, folder):
    t = _stationarity(daily_by_type(spark, folder), ["event_type"])
    return tidy(t.select("event_type", "d", "n", "kpss_stat", "kpss_lag", "kpss_p"), 5)


def stationarity_log(spark, folder):
    return tidy(ts.stationarity_log(_stationarity(running_total(spark, folder))), 4)


def arima_fit(spark, folder):
    """Model of every event type's daily series: order, information criteria."""
    return tidy(ts.analyze_series(daily_by_type(spark, folder), "day", "y", (), ["event_type"])["model"], 4)


def forecast5(spark, folder):
    return tidy(ts.analyze_series(daily_by_type(spark, folder), "day", "y", (), ["event_type"])["forecast"], 4)


def var_fit(spark, folder):
    return tidy(ts.analyze_series(daily(spark, folder), "day", "y", ["x"])["coefficients"], 4)


def var_forecast(spark, folder):
    return tidy(ts.analyze_series(daily(spark, folder), "day", "y", ["x"])["history"], 4)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        profile_orders, detect_structure_events, convert_types, missing_report, drop_sparse_missing, impute_median,
        impute_mode, iqr_filter_one, iqr_filter_sequential, iqr_filter_simultaneous, clean_orders, cleaning_log,
        describe_lineitem, describe_by_nation, describe_by_supplier, group_summary_orders, group_guard_suppliers,
        instrument_items, normality_orders, normality_by_priority, shapiro_by_customer, welch_t, paired_t, wilcoxon,
        mann_whitney, mann_whitney_by_priority, mann_whitney_exact, welch_constant_groups, anova_constant_groups,
        tukey_constant_groups, moderation_collinear, kruskal_events, kruskal_quantity, anova_events, anova_by_segment,
        tukey_events, pairwise_mann_whitney, ols_simple, ols_multi, ols_fit_by_flag, vif_eliminate, pearson_table,
        spearman_table, spearman_by_brand, kendall_table, kendall_by_brand, corr_matrix, mediation_full, mediation_none, moderation, auto_compare,
        auto_compare_by_segment, auto_compare_small_segments, auto_influence, auto_correlate, auto_mediate,
        analyze_orders, box_stats, scatter_grid, trend_line, difference_series, seasonal_difference, adf_t, adf_trend, kpss_eta,
        stationarity_log, arima_fit, forecast5, var_fit, var_forecast,
    )
}
