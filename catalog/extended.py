"""Queries of data preparation, effect sizes and smoothing, each beside the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autostat.operators import cleaning, compare, outliers, smoothing
from autostat.operators import series as ordered
from autostat.functions.columns import NA_TOKENS
from autostat.operators.describe import group_moments
from autostat.sources.checkpoints import delete_at_exit, new_path
from autostat.sources.tables import read_csv
from autostat.plans.analysis import analyze
from autostat.plans.routing import Comparison
from autostat.plans.spec import AnalysisSpec
from catalog.oracle import XS, DIRTY, anova_sql, correlation_table, f_p_4, fences, kruskal_sql, phi, ranked, spearman_rows
from catalog.queries import daily_by_type, dirty_orders, running_total, table, test_row, tidy
from catalog.series_oracle import BY_TYPE, SERIES_ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


# --- outliers ---

MAD = """SELECT {k}count(*) AS n, round(median({y}),6) AS median, round(median(abs({y} - m)),6) AS mad
FROM (SELECT {k}{y}, median({y}) OVER ({w}) AS m FROM {t})"""


@query(MAD.format(k="event_type, ", y="value", w="PARTITION BY event_type", t="events") + " GROUP BY event_type")
def mad_by_type(spark, folder):
    return tidy(outliers.median_deviation(table(spark, folder, "events"), "value", ["event_type"]))


@query(MAD.format(k="", y="l_extendedprice", w="", t="lineitem"))
def mad_price(spark, folder):
    return tidy(outliers.median_deviation(table(spark, folder, "lineitem"), "l_extendedprice"))


@query("""WITH m AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM events),
d AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY event_type) AS mad FROM m)
SELECT event_id, round(0.6745*(value - m)/mad,6) AS score FROM d WHERE abs(0.6745*(value - m)/mad) > 3.5""")
def mad_outliers(spark, folder):
    rows = outliers.robust_scores(table(spark, folder, "events"), "value", ["event_type"])
    return tidy(rows.where("is_outlier").select("event_id", "score"))


@query("""SELECT event_id, round(s,6) AS score FROM (SELECT event_id, (value - avg(value) OVER ())/stddev_samp(value) OVER () AS s FROM events) WHERE abs(s) > 3""")
def z_outliers(spark, folder):
    return tidy(outliers.z_scores(table(spark, folder, "events"), "value").where("is_outlier").select("event_id", "score"))


@query("""SELECT event_id, round(greatest(least(value, hi), lo),6) AS value FROM events
JOIN (SELECT event_type, quantile_cont(value,0.05) AS lo, quantile_cont(value,0.95) AS hi FROM events GROUP BY 1) USING (event_type)""")
def winsorized_events(spark, folder):
    return tidy(outliers.winsorized(table(spark, folder, "events"), "value", ["event_type"]).select("event_id", "value"))


@query("SELECT o_orderkey, round(ln(o_totalprice),9) AS o_totalprice FROM orders")
def logged_orders(spark, folder):
    return tidy(outliers.logged(table(spark, folder, "orders"), ["o_totalprice"]).select("o_orderkey", "o_totalprice"), 9)


# --- missing values and duplicates ---


@query(f"WITH {DIRTY} SELECT o_orderkey, round(coalesce(y_impute, (SELECT avg(y_impute) FROM dirty)),4) AS y_impute FROM dirty")
def impute_mean(spark, folder):
    filled = cleaning.fill_missing(dirty_orders(spark, folder), ["y_impute"], {"y_impute": "numerical"}, centre="mean")
    return tidy(filled.frame.select("o_orderkey", "y_impute"), 4)


@query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_supplies(spark, folder):
    return cleaning.drop_duplicates(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")).frame


FIRST_ORDERS = """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1"""


@query(FIRST_ORDERS)
def cheapest_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return cleaning.drop_duplicates(orders, ["o_custkey"], ["o_totalprice"]).frame


@query(f"""WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT count(*) AS k FROM ({FIRST_ORDERS}))
SELECT 'duplicates' AS step, 'o_custkey' AS "column", 'drop' AS action, n - k AS n_rows, round(100.0::DOUBLE*(n - k)/n, 2) AS percent,
  NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::VARCHAR AS imputed_value FROM n, k""")
def duplicates_log(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return cleaning.drop_duplicates(orders, ["o_custkey"], ["o_totalprice"]).log_frame()


# --- effect sizes ---

OMEGA = anova_sql("events", "value", "event_type", f_p_4).replace("'Eta-squared'", "'Omega-squared'")
OMEGA = OMEGA.replace("ssb/(ssb+ssw)", "greatest((ssb-(k-1)*ssw/(nn-k))/(ssb+ssw+ssw/(nn-k)), 0.0)")


def labelled(sql: str, small: float, medium: float, large: float) -> str:
    return f"""SELECT test, effect_name, effect_size, CASE WHEN abs(effect_size) >= {large} THEN 'large' WHEN abs(effect_size) >= {medium} THEN 'medium'
  WHEN abs(effect_size) >= {small} THEN 'small' ELSE 'negligible' END AS effect_label FROM ({sql})"""


@query(labelled(OMEGA, 0.01, 0.06, 0.14))
def omega_squared(spark, folder):
    of_groups = group_moments(table(spark, folder, "events"), "value", "event_type")
    rows = compare.with_effect_label(compare.anova(of_groups, "event_type", effect="Omega-squared"))
    return tidy(rows.select("test", "effect_name", "effect_size", "effect_label"))


@query("""WITH g AS (SELECT l_linestatus AS s, l_returnflag AS l, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem
  WHERE l_returnflag IN ('A', 'N') GROUP BY ALL),
d AS (SELECT a.s, coalesce((a.m-b.m)/sqrt(((a.n-1)*a.v+(b.n-1)*b.v)/(a.n+b.n-2)), 0.0) AS d FROM g a JOIN g b ON a.s = b.s AND a.l = 'A' AND b.l = 'N')
SELECT s AS l_linestatus, 'Cohen''s d' AS effect_name, round(d,6) AS effect_size,
  CASE WHEN abs(d) >= 0.8 THEN 'large' WHEN abs(d) >= 0.5 THEN 'medium' WHEN abs(d) >= 0.2 THEN 'small' ELSE 'negligible' END AS effect_label FROM d""")
def effect_labels(spark, folder):
    li = table(spark, folder, "lineitem").where(F.col("l_returnflag").isin("A", "N"))
    of_groups = group_moments(li, "l_extendedprice", "l_returnflag", ["l_linestatus"])
    rows = compare.with_effect_label(compare.welch_t(of_groups, "l_returnflag", ["l_linestatus"]))
    return tidy(rows.select("l_linestatus", "effect_name", "effect_size", "effect_label"))


# --- smoothing ---

SMOOTHED = f"""WITH RECURSIVE {BY_TYPE},
pos AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY day) AS t, y FROM src),
st AS (SELECT g, i/20.0::DOUBLE AS alpha, t, y, y AS expected, y AS level, 0.0::DOUBLE AS sse FROM pos, range(1, 20) r(i) WHERE t = 1
  UNION ALL SELECT st.g, alpha, pos.t, pos.y, level, alpha*pos.y + (1 - alpha)*level, sse + pow(pos.y - level, 2) FROM st JOIN pos ON pos.g = st.g AND pos.t = st.t + 1),
fit AS (SELECT g, alpha, sse, level, t AS n FROM st QUALIFY t = max(t) OVER (PARTITION BY g)),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY g ORDER BY sse, alpha) = 1)"""


def _daily(spark, folder):
    return ordered.place(daily_by_type(spark, folder), "day", ["y"], ["event_type"])


@query(f"""{SMOOTHED} SELECT g AS event_type, t AS pos, round(y,4) AS value, round(expected + 1e-7,4) AS expected, round(level + 1e-7,4) AS level
FROM st WHERE EXISTS (SELECT 1 FROM best WHERE best.g = st.g AND best.alpha = st.alpha)""")
def smoothing_levels(spark, folder):
    series = _daily(spark, folder)
    rows = smoothing.smoothed(series, "y", smoothing.smoothing_fits(series, "y"))
    # Decimal inputs give many exact halves in the fifth place, which engines round as their last bits fall.
    return tidy(rows.withColumns({c: F.col(c) + 1e-7 for c in ("expected", "level")}), 4)


@query(f"{SMOOTHED} SELECT g AS event_type, alpha, n, round(sse,2) AS sse, step::BIGINT AS step, round(level,4) AS value FROM best, range(1, 6) s(step)")
def smoothing_forecast(spark, folder):
    fits = smoothing.smoothing_fits(_daily(spark, folder), "y")
    later = smoothing.smoothing_forecast(fits, ["event_type"]).join(fits.where("best").select("event_type", "alpha", "n", "sse"), "event_type")
    return tidy(later.select("event_type", "alpha", "n", "sse", "step", "value"), 4, sse=2)


# --- the whole analysis ---

KEPT = f"""{fences("events", "value", "f")}, kept AS (SELECT event_id, event_type, value FROM events, f WHERE value BETWEEN lo AND hi)"""


@query(kruskal_sql("kept", "value", "event_type", 2).replace("WITH ", f"WITH {KEPT}, ", 1))
def analyze_events(spark, folder):
    """Compare after outlier rows have gone."""
    found = analyze(table(spark, folder, "events"), AnalysisSpec("value", "compare", group="event_type"))
    return test_row(found["test_result"])


@query(f"""WITH {KEPT}, n AS (SELECT count(*) AS n FROM events), k AS (SELECT count(*) AS k FROM kept)
SELECT step, "column", action, n_rows FROM (SELECT 'outliers' AS step, 'value' AS "column", CASE WHEN n > k THEN 'filter' ELSE 'none' END AS action, n - k AS n_rows FROM n, k)""")
def analyze_events_log(spark, folder):
    found = analyze(table(spark, folder, "events"), AnalysisSpec("value", "compare", group="event_type"))
    return found["cleaning_log"].where("step = 'outliers'").select("step", "column", "action", "n_rows")


@query(SERIES_ORACLE["stationarity_log"])
def analyze_series_route(spark, folder):
    """A time column sends the goal `influence` to the series path; no row is removed there."""
    found = analyze(running_total(spark, folder), AnalysisSpec("y", "influence", xs=(), time_col="day"))
    return tidy(found["stationarity_log"], 4)


@query("WITH " + correlation_table(spearman_rows("lineitem", "l_extendedprice", XS), "Spearman Rank Correlation"))
def analyze_correlate(spark, folder):
    spec = AnalysisSpec("l_extendedprice", "correlate", xs=tuple(XS), filter_outliers=False)
    return tidy(analyze(table(spark, folder, "lineitem"), spec)["correlation"], 6)


SHIFTED = """shifted AS (SELECT o_orderpriority, o_orderstatus, (o_totalprice * CASE o_orderstatus WHEN 'O' THEN 2 ELSE 1 END)::DOUBLE AS y FROM orders)"""


@query(f"""WITH {SHIFTED}, sig AS (SELECT o_orderpriority FROM ({kruskal_sql("shifted", "y", "o_orderstatus", 1, "o_orderpriority")}) WHERE is_significant),
pr AS (SELECT DISTINCT a.o_orderpriority, a.o_orderstatus AS group1, b.o_orderstatus AS group2 FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM shifted) a
  JOIN (SELECT DISTINCT o_orderpriority, o_orderstatus FROM shifted) b ON a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus < b.o_orderstatus JOIN sig ON sig.o_orderpriority = a.o_orderpriority),
src AS (SELECT pr.*, o_orderstatus, y FROM pr JOIN shifted s ON s.o_orderpriority = pr.o_orderpriority AND o_orderstatus IN (group1, group2)),
rk AS ({ranked("src", "y", "o_orderpriority, group1, group2")}),
s AS (SELECT o_orderpriority, group1, group2, count_if(o_orderstatus=group1)::DOUBLE AS n1, count_if(o_orderstatus=group2)::DOUBLE AS n2, sum(CASE WHEN o_orderstatus=group1 THEN rk END) AS r1,
  sum(tied*tied-1.0) AS ties, avg(CASE WHEN o_orderstatus=group1 THEN y END) - avg(CASE WHEN o_orderstatus=group2 THEN y END) AS md FROM rk GROUP BY ALL),
u AS (SELECT *, r1-n1*(n1+1)/2 AS u, n1+n2 AS nn FROM s),
z AS (SELECT *, (greatest(u,n1*n2-u)-n1*n2/2-0.5)/sqrt(n1*n2/12*((nn+1)-ties/(nn*(nn-1)))) AS z FROM u),
p AS (SELECT *, least(1.0, least(1.0, 2*(1-{phi("z")}))*3) AS p FROM z)
SELECT o_orderpriority, group1, group2, round(md,4) AS mean_diff, round(p,5) AS p_corrected, p < 0.05 AS is_significant FROM p""")
def post_hoc_by_priority(spark, folder):
    """Pairs of groups in every segment whose test found a difference."""
    dearer = F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "O", 2.0).otherwise(1.0)
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_orderstatus", dearer.alias("y"))
    spec = AnalysisSpec("y", "compare", group="o_orderstatus", keys=("o_orderpriority",)).validated()
    return tidy(Comparison(orders, spec).post_hoc(), 5, mean_diff=4)


# --- files ---

TOKENS = ", ".join("'" + t + "'" for t in NA_TOKENS)


@query(f"""SELECT doc_id, CASE WHEN lang NOT IN ({TOKENS}) THEN lang END AS lang, n_chars, md5(text) AS text FROM
(SELECT doc_id, lang, n_chars, CASE WHEN text NOT IN ({TOKENS}) THEN text END AS text FROM documents)""")
def csv_round_trip(spark, folder):
    """Texts with line breaks and quotes, written as CSV and read back by ranges of the files."""
    path = f"{new_path(spark, 'csv')}.csv"
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    keep = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(header=True, **keep).csv(path)
    delete_at_exit(spark, path)
    back = read_csv(spark, path, docs.schema)
    return back.select("doc_id", "lang", "n_chars", F.md5(F.col("text").cast("binary")).alias("text"))
