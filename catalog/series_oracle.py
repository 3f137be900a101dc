"""SQL of the unit-root, ARIMA and VAR queries.

All regressions are Gauss-Jordan steps over a moment matrix held in a list column of a recursive CTE. The state after
k steps holds the fit on the first k columns, so one run gives every nested lag model.
"""

from __future__ import annotations

from catalog.oracle import kpss_sql, phi, stationarity_frame

BY_TYPE = "src AS (SELECT event_type AS g, CAST(ts AS DATE) AS day, round(sum(value),2) AS y FROM events GROUP BY 1, 2)"
ALL_EVENTS = "src AS (SELECT 1 AS g, CAST(ts AS DATE) AS day, round(sum(value),2) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY ALL)"
ORDERS = "src AS (SELECT 1 AS g, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice)/1000,3) AS y FROM orders GROUP BY ALL)"
RUNNING = """src AS (SELECT 1 AS g, CAST(o_orderdate AS DATE) AS day,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))*100 + round(avg(o_totalprice)/1000,3) AS DOUBLE) AS y FROM orders GROUP BY CAST(o_orderdate AS DATE))"""

TREND = "src AS (SELECT 1 AS g, c_custkey AS day, CAST(c_custkey*100 + round(c_acctbal/1000,3) AS DOUBLE) AS y FROM customer)"


def eliminated(name: str, rows: str, left: int) -> str:
    """From `rows` (g, d, m, x: m values per observation) to the states (g, d, m, k, mat) of the elimination; the last
    `left` columns are responses. Once column i is a predictor, its row holds its coefficients."""
    step = f"""list_transform(range(0, m*m), lambda c: CASE WHEN c // m = k THEN mat[c+1]/mat[k*m+k+1]
    ELSE mat[c+1] - mat[(c // m)*m+k+1]*mat[k*m + c%m + 1]/mat[k*m+k+1] END)"""
    return f"""{name}_c AS (SELECT g, d, m, unnest(range(0, m*m)) AS c, unnest(list_transform(range(0, m*m), lambda c: x[c // m + 1]*x[c % m + 1])) AS v FROM {rows}),
{name}_s AS (SELECT g, d, m, c, sum(v) AS v FROM {name}_c GROUP BY ALL),
{name} AS (SELECT g, d, m, CAST(0 AS BIGINT) AS k, list(v ORDER BY c) AS mat FROM {name}_s GROUP BY g, d, m
  UNION ALL SELECT g, d, m, k + 1, {step} FROM {name} WHERE k < m - {left})"""


def unit_root_rows(spec: str, lags: str) -> str:
    """Columns 1, the lagged differences, the level before, and the difference now, as far as `lags` allows."""
    return f"""SELECT g, d, {lags} + 3 AS m, [1.0::DOUBLE] || list_transform(range(1, {lags} + 1), lambda i: e[t-i] - e[t-i-1]) || [e[t-1], e[t] - e[t-1]] AS x
  FROM (SELECT *, unnest(range({lags} + 2, n + 1)) AS t FROM {spec})"""


RSS = "(mat[m*m] - pow(mat[(m-1)*m],2)/mat[(m-1)*m-1])"


def adf_cte(inner: str) -> str:
    """`adf` (g, d, n, lag, t): the lag by AIC on the common sample, the t-ratio on the longest sample that lag allows."""
    return f"""{stationarity_frame(inner, "g")},
cen AS (SELECT g, d, t, z, z - avg(z) OVER (PARTITION BY g, d) AS e FROM zz),
ser AS (SELECT *, CAST(greatest(0, least(ceil(12*pow(n/100.0,0.25)), floor(n/2.0)-2)) AS BIGINT) AS longest
  FROM (SELECT g, d, count(*) AS n, list(e ORDER BY t) AS e, list(z ORDER BY t) AS z FROM cen GROUP BY g, d)),
ur AS ({unit_root_rows("ser", "longest")}), {eliminated("ue", "ur", 2)},
us AS (SELECT g, d, k - 1 AS lag, n - longest - 1 AS rws, {RSS} AS rss FROM ue JOIN ser USING (g, d) WHERE k > 0),
pick AS (SELECT g, d, arg_min(lag, rws*ln(greatest(rss,1e-300)/rws) + 2*(lag+2)) AS lag FROM us WHERE rws > lag + 2 GROUP BY g, d),
sel AS (SELECT * FROM ser JOIN pick USING (g, d)),
fr AS ({unit_root_rows("sel", "lag")}), {eliminated("fe", "fr", 2)},
adf AS (SELECT g, d, n, lag, mat[(m-1)*m]/mat[(m-1)*m-1]/sqrt({RSS}/(n-lag-1-(lag+2))/mat[(m-1)*m-1]) AS t FROM fe JOIN sel USING (g, d) WHERE k = m - 2)"""


def tests_cte(inner: str) -> str:
    """`tests` (g, d, n, lag, t, adf_p, kpss_stat, kpss_lag, kpss_p, ok) and `deg` (g, degree)."""
    # P-value surface of the unit-root statistic with a constant (MacKinnon 1994).
    small, large = "(2.1659 + 1.4412*t + 0.038269*t*t)", "(1.7339 + 0.93202*t - 0.12745*t*t - 0.010368*t*t*t)"
    return f"""{adf_cte(inner)},
surface AS (SELECT *, CASE WHEN t <= -1.61 THEN {small} ELSE {large} END AS s FROM adf),
kp AS ({kpss_sql(inner, "g", 12)}),
tests AS (SELECT a.*, k.kpss_stat, k.kpss_lag, k.kpss_p, adf_p < 0.05 AND k.kpss_p >= 0.05 AS ok
  FROM (SELECT g, d, n, lag, t, CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 THEN 0.0 ELSE {phi("s")} END AS adf_p FROM surface) a
  JOIN kp k ON a.g = k.g AND a.d = k.d),
deg AS (SELECT g, coalesce(min(CASE WHEN ok THEN d END), 2) AS degree FROM tests GROUP BY g)"""


def arma_cte(inner: str) -> str:
    """`best` (g, d, p, q, used, aic, bic, s2, and what the forecast needs): residuals of a long autoregression, then
    nine regressions on up to two lags of values and residuals. The nine are told apart by a code in place of d."""
    return f"""{tests_cte(inner)},
long AS (SELECT s.*, CAST(greatest(1, least(ceil(pow(ln(n),1.5)), floor(n/4.0), longest + 1)) AS BIGINT) AS ord FROM ser s JOIN deg ON s.g = deg.g AND s.d = degree),
lr AS (SELECT g, d, ord + 2 AS m, [1.0::DOUBLE] || list_transform(range(1, ord + 1), lambda i: e[t-i]) || [e[t]] AS x
  FROM (SELECT *, unnest(range(ord + 1, n + 1)) AS t FROM long)), {eliminated("le", "lr", 1)},
res AS (SELECT l.*, list_transform(range(1, n + 1), lambda t: CASE WHEN t > ord THEN
    e[t] - mat[m] - list_sum(list_transform(range(1, ord + 1), lambda i: mat[i*m+m]*e[t-i])) END) AS r FROM long l JOIN le USING (g, d) WHERE k = m - 1),
orders_ AS (SELECT p, q FROM range(0, 3) a(p), range(0, 3) b(q)),
ar AS (SELECT g, d*100 + p*10 + q AS d, (d = 0)::BIGINT + p + q + 1 AS m,
    (CASE WHEN d = 0 THEN [1.0::DOUBLE] ELSE []::DOUBLE[] END) || list_slice([z[t-1], z[t-2]], 1, p) || list_slice([r[t-1], r[t-2]], 1, q) || [z[t]] AS x
  FROM (SELECT *, unnest(range(ord + 3, n + 1)) AS t FROM res), orders_), {eliminated("ae", "ar", 1)},
fit AS (SELECT g, d // 100 AS d, d // 10 % 10 AS p, d % 10 AS q, m, mat, mat[m*m] AS rss FROM ae WHERE k = m - 1),
crit AS (SELECT f.*, res.n, z, r, res.n - res.ord - 2 AS used, greatest(rss/(res.n - res.ord - 2), 1e-300) AS s2 FROM fit f JOIN res ON f.g = res.g),
best AS (SELECT *, used*(ln(2*pi()*s2)+1) + 2*m AS aic, used*(ln(2*pi()*s2)+1) + m*ln(used) AS bic FROM crit
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY used*(ln(2*pi()*s2)+1) + 2*m, p, q) = 1)"""


def levels(steps: str) -> str:
    """Undo the differencing of f1..f5: running values from the last two levels y0 (last) and yp."""
    out, last, before = [], "y0", "yp"
    for i in range(1, 6):
        out.append(f"(SELECT *, CASE d WHEN 0 THEN f{i} WHEN 1 THEN f{i} + {last} ELSE f{i} + 2*{last} - {before} END AS v{i} FROM ")
        last, before = f"v{i}", last
    return "".join(reversed(out)) + steps + ")" * 5


def five_rows(source: str, key: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {key}CAST({i} AS BIGINT) AS step, round(v{i},4) AS value FROM {source}" for i in range(1, 6))


def arma_forecast(inner: str) -> str:
    at = lambda i: f"mat[({i})*m+m]"
    shift = "(d = 0)::BIGINT"
    return f"""WITH RECURSIVE {arma_cte(inner)},
ends AS (SELECT g, max(t) AS size, arg_max(y, t) AS y0, arg_max(y, t, 2)[2] AS yp FROM pos GROUP BY g),
c AS (SELECT b.g, d, y0, yp, z[n] AS z0, z[n-1] AS zp, r[n] AS r0, r[n-1] AS rp, CASE WHEN d = 0 THEN mat[m] ELSE 0.0 END AS c,
  CASE WHEN p >= 1 THEN {at(shift)} ELSE 0.0 END AS a1, CASE WHEN p >= 2 THEN {at(shift + " + 1")} ELSE 0.0 END AS a2,
  CASE WHEN q >= 1 THEN {at(shift + " + p")} ELSE 0.0 END AS b1, CASE WHEN q >= 2 THEN {at(shift + " + p + 1")} ELSE 0.0 END AS b2
  FROM best b JOIN ends ON b.g = ends.g),
s1 AS (SELECT *, c + a1*z0 + a2*zp + b1*r0 + b2*rp AS f1 FROM c), s2_ AS (SELECT *, c + a1*f1 + a2*z0 + b2*r0 AS f2 FROM s1),
s3 AS (SELECT *, c + a1*f2 + a2*f1 AS f3 FROM s2_), s4 AS (SELECT *, c + a1*f3 + a2*f2 AS f4 FROM s3),
s5 AS (SELECT *, c + a1*f4 + a2*f3 AS f5 FROM s4), lev AS ({levels("s5")})
{five_rows("lev", "g AS event_type, ")}"""


def var_cte(inner: str) -> str:
    """`chosen` (lags, used, mat): both columns on up to three lags of both, lags by AIC of the residual determinant."""
    diff = lambda c: f"""CASE degree WHEN 0 THEN {c} WHEN 1 THEN list_transform(range(2, n+1), lambda t: {c}[t] - {c}[t-1])
    ELSE list_transform(range(3, n+1), lambda t: {c}[t] - 2*{c}[t-1] + {c}[t-2]) END"""  # noqa: E731
    return f"""{tests_cte(inner)},
two AS (SELECT g, count(*) AS n, list(y ORDER BY day) AS y, list(x ORDER BY day) AS x FROM src GROUP BY g),
vd AS (SELECT two.*, degree, {diff("y")} AS a, {diff("x")} AS b FROM two JOIN deg USING (g)),
vr AS (SELECT g, degree AS d, 9 AS m, [1.0::DOUBLE, a[t-1], b[t-1], a[t-2], b[t-2], a[t-3], b[t-3], a[t], b[t]] AS x
  FROM (SELECT *, unnest(range(4, n - degree + 1)) AS t FROM vd)), {eliminated("ve", "vr", 2)},
vs AS (SELECT g, (k - 1) // 2 AS lags, n - degree - 3 AS used, mat FROM ve JOIN vd USING (g) WHERE k IN (3, 5, 7)),
chosen AS (SELECT *, 1 + 2*lags AS wide FROM vs
  QUALIFY row_number() OVER (ORDER BY ln((mat[71]*mat[81] - mat[72]*mat[80])/(used*used)) + 4.0*(1 + 2*lags)/used, lags) = 1)"""


def var_coefficients(inner: str) -> str:
    term = "CASE WHEN i = 0 THEN 'const' ELSE 'L' || ((i + 1) // 2) || CASE WHEN i % 2 = 1 THEN '.y' ELSE '.x' END END"
    return f"""WITH RECURSIVE {var_cte(inner)}
SELECT o.name AS equation, {term} AS term, round(mat[i*9 + 8 + o.place],4) AS coefficient
FROM (SELECT *, unnest(range(0, wide)) AS i FROM chosen), (VALUES ('y', 0), ('x', 1)) o(name, place)"""


def var_history(inner: str) -> str:
    following = lambda at: f"mat[{at}] + list_sum(list_transform(range(1, wide), lambda i: mat[i*9 + {at}]*past[i]))"
    return f"""WITH RECURSIVE {var_cte(inner)},
path AS (SELECT 0 AS step, mat, wide, NULL::DOUBLE AS f, [a[n-degree], b[n-degree], a[n-degree-1], b[n-degree-1], a[n-degree-2], b[n-degree-2]] AS past FROM chosen JOIN vd USING (g)
  UNION ALL SELECT step + 1, mat, wide, {following(8)}, [{following(8)}, {following(9)}] || past[1:4] FROM path WHERE step < 5),
steps AS (SELECT {", ".join(f"max(CASE WHEN step = {i} THEN f END) AS f{i}" for i in range(1, 6))} FROM path),
lev AS ({levels("(SELECT *, degree AS d, y[n] AS y0, y[n-1] AS yp FROM steps, vd)")}),
future AS ({five_rows("lev")})
SELECT CAST(t AS BIGINT) AS pos, round(y,4) AS value, 'history' AS kind FROM pos
UNION ALL SELECT CAST((SELECT max(t) FROM pos) + step AS BIGINT), value, 'forecast' FROM future"""


SERIES_ORACLE: dict[str, str] = {
    "adf_t": f"""WITH RECURSIVE {adf_cte(ORDERS)}
SELECT CAST(d AS BIGINT) AS d, n, round(t,3) AS adf_stat, CAST(lag AS BIGINT) AS adf_lag FROM adf""",
    "adf_trend": f"""WITH RECURSIVE {adf_cte(TREND)}
SELECT CAST(d AS BIGINT) AS d, n, round(t,3) AS adf_stat, CAST(lag AS BIGINT) AS adf_lag FROM adf""",
    "stationarity_log": f"""WITH RECURSIVE {tests_cte(RUNNING)}
SELECT CAST(d AS BIGINT) AS d, n, round(t,4) AS adf_stat, CAST(lag AS BIGINT) AS adf_lag, round(adf_p,4) AS adf_p, round(kpss_stat,4) AS kpss_stat,
 CAST(kpss_lag AS BIGINT) AS kpss_lag, round(kpss_p,4) AS kpss_p, ok AS is_stationary, CASE WHEN ok THEN 'stationary' ELSE 'not stationary (unit root)' END AS label
FROM tests JOIN deg USING (g) WHERE d <= degree""",
    "arima_fit": f"""WITH RECURSIVE {arma_cte(BY_TYPE)}
SELECT g AS event_type, 'ARIMA' AS model, CAST(p AS BIGINT) AS p, CAST(d AS BIGINT) AS d, CAST(q AS BIGINT) AS q, CAST(used AS BIGINT) AS n_used,
 round(aic,4) AS aic, round(bic,4) AS bic, round(s2,4) AS sigma2 FROM best""",
    "forecast5": arma_forecast(BY_TYPE),
    "var_fit": var_coefficients(ALL_EVENTS),
    "var_forecast": var_history(ALL_EVENTS),
}
