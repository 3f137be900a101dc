"""SQL with the same result as each query, for an engine that shares no code with this package.

Ranks come from window functions, quantiles from `quantile_cont`, regressions from normal equations,
p-values from series or numerical integration; none of it uses the package's own formulas.
"""

from __future__ import annotations

from statistics import NormalDist

# --- distribution tails as SQL expressions ---


def phi(z: str) -> str:
    """Normal distribution function by its Taylor series (|z| < 7)."""
    series = f"list_sum(list_transform(range(0, 120), lambda k: exp((2*k+1)*ln(greatest(abs({z}),1e-12)) + (k+1)*ln(2.0) + lgamma(k+2.0) - lgamma(2.0*k+3.0))))"
    value = f"(0.5 + sign({z}) * exp(-0.5*({z})*({z})) / sqrt(2*pi()) * {series})"
    return f"(CASE WHEN {z} > 7 THEN 1.0 WHEN {z} < -7 THEN 0.0 ELSE {value} END)"


def two_sided_normal(z: str) -> str:
    return f"least(1.0, 2*(1 - {phi(f'abs({z})')}))"


def t_p(t: str, dof: str) -> str:
    """Two-sided t tail by Simpson's rule: over the angle atan(|t|/sqrt(dof)) for few degrees of freedom,
    over the density up to |t| = 14 (beyond it nothing is left) for many."""
    weight = "(CASE WHEN i=0 OR i=2000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)"
    scale = f"exp(lgamma(({dof}+1)/2.0)-lgamma(({dof})/2.0))"
    top = f"least(abs({t}), 14.0)"
    density = f"exp(-({dof}+1)/2.0*ln(1 + pow(i/2000.0*{top},2)/({dof})))"
    many = f"1 - 2*{scale}/sqrt(({dof})*pi())*list_sum(list_transform(range(0, 2001), lambda i: {weight}*{density}))*{top}/6000.0"
    angle = f"atan(abs({t})/sqrt({dof}))"
    few = f"1 - 2*{scale}/sqrt(pi())*list_sum(list_transform(range(0, 2001), lambda i: {weight}*pow(cos(i/2000.0*{angle}),({dof})-1)))*{angle}/6000.0"
    return f"(CASE WHEN {dof} < 30 THEN greatest(0.0, {few}) ELSE greatest(0.0, {many}) END)"


def chi2_p_even(x: str, half: int) -> str:
    """Chi-squared tail with 2*half degrees of freedom, a finite sum."""
    terms = " + ".join(f"pow({x}/2,{i})/gamma({i}+1.0)" for i in range(half))
    return f"exp(-({x})/2)*({terms})"


def f_p_2(f: str, d2: str) -> str:
    return f"pow({d2}/({d2}+2*{f}), {d2}/2.0)"


def f_p_4(f: str, d2: str) -> str:
    x = f"({d2}/({d2}+4*{f}))"
    return f"pow({x},{d2}/2.0)*(1+{d2}/2.0*(1-{x}))"


def rank_z_effect(p: str, z: str, n: str) -> str:
    """|z|/sqrt(n) where p is the two-sided tail of z, so the quantile of p/2 is z again."""
    return f"(CASE WHEN {p} >= 1 THEN 0.0 ELSE greatest({z},0.0)/sqrt({n}) END)"


DECISION = "CASE WHEN p < 0.05 THEN 'H1 accepted' ELSE 'H0 retained' END"

# --- inputs ---

DIRTY = """dirty AS (SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS y_drop,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS y_impute,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS s_impute,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS txt_numeric,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS txt_text
  FROM orders)"""

CHARGED = """charged AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice AS price, l_discount,
  l_extendedprice*(1-l_discount) AS discounted, l_extendedprice*(1-l_discount)*(1+l_tax) AS charge FROM lineitem)"""

HALVES = """halves AS (SELECT o_custkey, CASE WHEN o_orderdate < DATE '1998-01-01' THEN 'before' ELSE 'from' END AS half,
  avg(o_totalprice) AS price FROM orders GROUP BY 1, 2),
pairs AS (SELECT o_custkey, min(CASE WHEN half='before' THEN price END) AS y1, min(CASE WHEN half='from' THEN price END) AS y2
  FROM halves GROUP BY 1 HAVING count(*) = 2)"""

AMOUNTS = """amounts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice*l_discount AS rebate,
  l_extendedprice*l_quantity AS volume, l_quantity FROM lineitem)"""


def fences(source: str, column: str, name: str) -> str:
    return f"""{name} AS (SELECT q1 - 1.5*(q3-q1) AS lo, q3 + 1.5*(q3-q1) AS hi FROM (
  SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}))"""


DAILY = """daily AS (SELECT CAST(ts AS DATE) AS day, round(sum(value),2) AS y, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1)"""
DAILY_BY_TYPE = """typed AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value),2) AS y FROM events GROUP BY 1, 2)"""


def ranked(source: str, value: str, keys: str = "") -> str:
    """Mid-ranks and tie sizes by plain windows."""
    part = f"PARTITION BY {keys}" if keys else ""
    both = f"PARTITION BY {keys + ', ' if keys else ''}{value}"
    return f"""SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER ({both}) - 1)/2.0 AS rk,
  count(*) OVER ({both}) AS tied FROM {source}"""


def describe_sql(columns: list[str], source: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    parts = [
        f"""SELECT {k}'{c}' AS "column", count(*) AS "count", round(avg({c}),4) AS mean, round(median({c}),4) AS median,
  round(max(CASE WHEN pick = 1 THEN {c} END),4) AS mode, round(stddev_samp({c}),4) AS std,
  round(var_samp({c}),__V__) AS variance, round(max({c})-min({c}),4) AS "range", round(min({c}),4) AS "min", round(max({c}),4) AS "max"
  FROM (SELECT *, row_number() OVER (PARTITION BY {k}1 ORDER BY same DESC, {c}) AS pick
    FROM (SELECT {k}{c}, count(*) OVER (PARTITION BY {k}{c}) AS same FROM {source})) {f"GROUP BY {key}" if key else ""}"""
        for c in columns
    ]
    return "\nUNION ALL\n".join(parts)


def group_test(source: str, y: str, g: str, keys: str = "") -> str:
    """Group rows with moments, medians and rank sums: the common table of the comparison oracles."""
    k = f"{keys}, " if keys else ""
    return f"""ranked AS ({ranked(source, y, keys)}),
g AS (SELECT {k}{g} AS label, count(*) AS n, avg({y}) AS m, var_samp({y}) AS v, median({y}) AS med, sum(rk) AS r,
  sum(tied*tied - 1.0) AS ties FROM ranked GROUP BY ALL)"""


def two_groups(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    pick = [f"{f}({c}, label) AS {c}{i}" for c in ("n", "m", "v", "med", "r") for i, f in ((1, "arg_min"), (2, "arg_max"))]
    by = f"GROUP BY {keys}" if keys else ""
    return f"two AS (SELECT {k}min(label) AS l1, max(label) AS l2, {', '.join(pick)}, sum(ties) AS ties FROM g {by})"


def test_columns(test, statistic, df1, df2, effect, size, higher, method) -> str:
    d1 = f"round(CAST({df1} AS DOUBLE),4)" if df1 else "CAST(NULL AS DOUBLE)"
    d2 = f"round(CAST({df2} AS DOUBLE),4)" if df2 else "CAST(NULL AS DOUBLE)"
    return f"""'{test}' AS test, round({statistic},4) AS statistic, {d1} AS df1, {d2} AS df2, round(p,6) AS p_value,
  p < 0.05 AS is_significant, '{effect}' AS effect_name, round({size},6) AS effect_size, {higher} AS higher_group,
  {method} AS method, {DECISION} AS decision"""


def mann_whitney_sql(source: str, y: str, g: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    cols = test_columns(
        "Mann-Whitney U Test", "u", "", "", "r (Z/sqrt(N))", rank_z_effect("p", "z", "n1+n2"),
        "CASE WHEN med1 > med2 THEN l1 ELSE l2 END", "'normal approximation'",
    )
    return f"""WITH {group_test(source, y, g, keys)}, {two_groups(keys)},
s AS (SELECT *, r1 - n1*(n1+1)/2.0 AS u, n1+n2 AS nn FROM two),
z AS (SELECT *, (greatest(u, n1*n2-u) - n1*n2/2.0 - 0.5)/sqrt(n1*n2/12.0*((nn+1) - ties/(nn*(nn-1.0)))) AS z FROM s),
p AS (SELECT *, least(1.0, 2*(1-{phi("z")})) AS p FROM z)
SELECT {k}{cols} FROM p"""


def exact_rank_sum_sql() -> str:
    """The eight dearest orders against the rest. The exact tail of U is a discrete Fourier sum: the transform of the
    counts is a product of sine ratios; with a number of points free of factors up to 8 no ratio is 0/0."""
    wave = " * ".join(f"(sin((n2+{i})*h)*{i}/(sin({i}*h)*(n2+{i})))" for i in range(1, 9))
    free = " AND ".join(f"x % {f} <> 0" for f in (2, 3, 5, 7))
    cols = test_columns(
        "Mann-Whitney U Test", "u", "", "", "r (Z/sqrt(N))", "NULL::DOUBLE",
        "CASE WHEN med1 > med2 THEN l1 ELSE l2 END", "'exact'",
    )
    return f"""WITH src AS (SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= 8 THEN 'dearest' ELSE 'rest' END AS side FROM orders),
{group_test("src", "o_orderkey", "side")}, {two_groups()},
s AS (SELECT *, r1 - n1*(n1+1)/2.0 AS u, n1*n2 AS nn FROM two),
w AS (SELECT *, nn - 2*least(u, nn-u) - 1 AS inside, (SELECT min(x) FROM range(1, 40) r(k), LATERAL (SELECT s.nn + k AS x) WHERE {free}) AS points FROM s),
f AS (SELECT CAST(j AS DOUBLE)*pi()/points AS h, n2, inside, points FROM w, LATERAL (SELECT unnest(range(1, CAST(points AS BIGINT))) AS j)),
e AS (SELECT (max(inside) + sum({wave} * sin(inside*h)/sin(h)))/max(points) AS within FROM f),
p AS (SELECT w.*, CASE WHEN inside <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - within)) END AS p FROM w, e)
SELECT {cols.replace("round(NULL::DOUBLE,6) AS effect_size, ", "")} FROM p"""


def studentized_range(source: str) -> str:
    """`tail` (q, p): P(Q > q) for the distinct (q, k, v) of `source`, by Simpson's rule over z in [-8, 8] and over the
    scale within ten standard deviations of 1."""
    simpson = lambda i, last: f"(CASE WHEN {i} IN (0, {last}) THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END)"
    return f"""z AS (SELECT i*0.05 - 8 AS z, {simpson("i", 320)}*0.05/3 AS w FROM range(0, 321) r(i)),
sc AS (SELECT q, k, v, greatest(1e-8, 1 - 10/sqrt(2*v)) AS lo, 1 + 10/sqrt(2*v) + 2/v AS hi, unnest(range(0, 61)) AS j FROM (SELECT DISTINCT q, k, v FROM {source})),
s AS (SELECT *, lo + (hi-lo)*j/60 AS s, {simpson("j", 60)}*(hi-lo)/180 AS ws FROM sc),
inn AS (SELECT q, s, ws, v, k*sum(w*exp(-0.5*z*z)/sqrt(2*pi())*pow(greatest({phi("z")} - {phi("(z-q*s)")}, 0.0), k-1)) AS inside FROM s, z GROUP BY q, s, ws, v, k),
tail AS (SELECT q, greatest(0.0, least(1.0, 1 - sum(ws*inside*exp(0.5*v*ln(v) - lgamma(v/2) - (v/2-1)*ln(2.0) + (v-1)*ln(s) - 0.5*v*s*s)))) AS p FROM inn GROUP BY q)"""


def kruskal_sql(source: str, y: str, g: str, half: int, keys: str = "", extra: str = "") -> str:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    cols = test_columns(
        "Kruskal-Wallis Test", "h", "k-1", "", "Epsilon-squared", "h*(nn+1)/(nn*nn-1.0)", "top", "'chi-squared distribution'"
    )
    return f"""WITH {group_test(source, y, g, keys)},
s AS (SELECT {k}count(*) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(r*r/n) AS q, sum(ties) AS ties, arg_max(label, med) AS top FROM g {by}),
h AS (SELECT *, (12.0/(nn*(nn+1))*q - 3*(nn+1))/(1 - ties/(nn*nn*nn-nn)) AS h FROM s),
p AS (SELECT *, {chi2_p_even("h", half)} AS p FROM h)
SELECT {k}{cols}{extra} FROM p"""


def anova_sql(source: str, y: str, g: str, tail, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    cols = test_columns(
        "One-Way ANOVA", "f", "k-1", "nn-k", "Eta-squared", "ssb/(ssb+ssw)", "top", "'F distribution'"
    )
    return f"""WITH g AS (SELECT {k}{g} AS label, count(*) AS n, avg({y}) AS m, var_samp({y})*(count(*)-1) AS ss FROM {source} GROUP BY ALL),
a AS (SELECT {k}avg({y}) AS grand FROM {source} {by}),
s AS (SELECT {k}count(*) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(ss) AS ssw, sum(n*pow(m-grand,2)) AS ssb, arg_max(label, m) AS top
  FROM g JOIN a {on} {by}),
f AS (SELECT *, (ssb/(k-1))/(ssw/(nn-k)) AS f FROM s),
p AS (SELECT *, {tail("f", "(nn-k)")} AS p FROM f)
SELECT {k}{cols} FROM p"""


def ols_two_sql(y: str, a: str, b: str, source: str, key: str = "") -> str:
    """Normal equations of y on a and b from centred sums, per segment."""
    k = f"{key}, " if key else ""
    by = f"GROUP BY {key}" if key else ""
    pairs = [("yy", y, y), ("aa", a, a), ("bb", b, b), ("ab", a, b), ("ay", a, y), ("by", b, y)]
    sums = ", ".join(f"covar_samp({p},{q})*(count(*)-1) AS s{n}" for n, p, q in pairs)
    return f"""m AS (SELECT {k}count(*) AS n, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, {sums} FROM {source} {by}),
d AS (SELECT *, saa*sbb - sab*sab AS det FROM m),
c AS (SELECT *, (say*sbb - sby*sab)/det AS ba, (sby*saa - say*sab)/det AS bb FROM d),
e AS (SELECT *, ba*say + bb*sby AS sse, syy - ba*say - bb*sby AS rss, my - ba*ma - bb*mb AS b0 FROM c),
fit AS (SELECT *, rss/(n-3) AS s2, (sse/2)/(rss/(n-3)) AS f FROM e)"""


def correlation_table(rows: str, method: str, keys: str = "") -> str:
    """Finish (keys, position, variable, n, r)."""
    k = f"{keys}, " if keys else ""
    p = t_p("t", "n-2")
    return f"""t AS (SELECT *, CASE WHEN 1-r*r < 1e-14 THEN 1e9 ELSE r*sqrt((n-2)/(1-r*r)) END AS t FROM ({rows})), p AS (SELECT *, {p} AS p, round(abs(r),12) AS s FROM t)
SELECT {k}CAST(position AS BIGINT) AS position, variable, '{method}' AS method, n, round(r,6) AS r, round(p,6) AS p_value,
  p < 0.05 AS is_significant,
  CASE WHEN s<0.2 THEN 'very weak' WHEN s<0.4 THEN 'weak' WHEN s<0.6 THEN 'moderate' WHEN s<0.8 THEN 'strong' ELSE 'very strong' END AS strength,
  CASE WHEN r>0 THEN 'positive' ELSE 'negative' END AS direction FROM p"""


XS = ["l_quantity", "l_discount", "l_tax"]


def kendall_sql(source: str, y: str, xs: list[str], keys: str = "") -> str:
    """tau-b from the contingency table of discrete columns, every pair of cells compared."""
    k, using = (f"{keys}, ", f"USING ({keys}, position)") if keys else ("", "USING (position)")
    rows = " UNION ALL ".join(f"SELECT {k}{i} AS position, '{x}' AS variable, {x} AS a, {y} AS b FROM {source}" for i, x in enumerate(xs))
    tied = lambda of, out: f"""{out} AS (SELECT {k}position, sum(t*(t-1)) AS {out}2, sum(t*(t-1)*(t-2)) AS {out}3, sum(t*(t-1)*(2*t+5)) AS {out}v
FROM (SELECT {k}position, sum(c)::DOUBLE AS t FROM cell GROUP BY {k}position, {of}) GROUP BY {k}position)"""  # noqa: E731
    return f"""WITH cell AS (SELECT {k}position, variable, a, b, count(*)::DOUBLE AS c FROM ({rows}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
s AS (SELECT {k}position, sum(p.c*q.c*sign(p.a-q.a)*sign(p.b-q.b))/2 AS s FROM cell p JOIN cell q {using} GROUP BY {k}position),
n AS (SELECT {k}position, variable, sum(c) AS n FROM cell GROUP BY {k}position, variable), {tied("a", "x")}, {tied("b", "y")},
m AS (SELECT *, coalesce(s/nullif(sqrt((n*(n-1)-x2)*(n*(n-1)-y2))/2, 0), 0.0) AS r,
  CASE WHEN s = 0 THEN 0.0 ELSE s/sqrt((n*(n-1)*(2*n+5)-xv-yv)/18 + x2*y2/(2*n*(n-1)) + x3*y3/(9*n*(n-1)*(n-2))) END AS z
  FROM n JOIN s {using} JOIN x {using} JOIN y {using}),
p AS (SELECT *, 2*(1 - {phi("abs(z)")}) AS p, round(abs(r),12) AS s_ FROM m)
SELECT {k}CAST(position AS BIGINT) AS position, variable, 'Kendall Rank Correlation' AS method, n::BIGINT AS n, round(r,6) AS r, round(p,6) AS p_value,
  p < 0.05 AS is_significant,
  CASE WHEN s_<0.2 THEN 'very weak' WHEN s_<0.4 THEN 'weak' WHEN s_<0.6 THEN 'moderate' WHEN s_<0.8 THEN 'strong' ELSE 'very strong' END AS strength,
  CASE WHEN r>0 THEN 'positive' ELSE 'negative' END AS direction FROM p"""


def spearman_rows(source: str, y: str, xs: list[str], keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    by = f"GROUP BY {keys}" if keys else ""

    def mid(c):
        tie = f"PARTITION BY {k}{c}"
        return f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({tie})-1)/2.0"

    return " UNION ALL ".join(
        f"SELECT {k}{i} AS position, '{x}' AS variable, count(*) AS n, corr(rx, ry) AS r FROM (SELECT {k}{mid(x)} AS rx, {mid(y)} AS ry FROM {source}) {by}"
        for i, x in enumerate(xs)
    )


def mediation_cte(x: str, m: str, y: str) -> str:
    s = ", ".join(
        f"covar_samp({p},{q}) AS {n}" for n, p, q in (("xx", x, x), ("mm", m, m), ("yy", y, y), ("xm", x, m), ("xy", x, y), ("my", m, y))
    )
    return f"""WITH {CHARGED}, q AS (SELECT count(*) AS n, {s} FROM charged),
r AS (SELECT *, xm/xx AS a, xy/xx AS c, (my*xx - xm*xy)/(xx*mm - xm*xm) AS b, (xy*mm - my*xm)/(xx*mm - xm*xm) AS cp FROM q),
u AS (SELECT *, (yy - b*my - cp*xy)*(n-1)/(n-3) AS s2 FROM r),
v AS (SELECT *, sqrt((mm - a*xm)*(n-1)/(n-2)/(xx*(n-1))) AS sa, sqrt((yy - c*xy)*(n-1)/(n-2)/(xx*(n-1))) AS sc,
  sqrt(s2/((mm - xm*xm/xx)*(n-1))) AS sb, sqrt(s2/((xx - xm*xm/mm)*(n-1))) AS sp FROM u),
v2 AS (SELECT *, a*b/sqrt(b*b*sa*sa + a*a*sb*sb) AS sz FROM v),
v3 AS (SELECT *, {two_sided_normal("sz")} AS sp2, {t_p("(cp/sp)", "n-3")} AS pcp FROM v2),
w AS (SELECT *, CASE WHEN sp2 >= 0.05 THEN 'none' WHEN pcp < 0.05 THEN 'partial' ELSE 'full' END AS kind FROM v3)"""


def mediation_sql(x: str, m: str, y: str, digits: int, z_digits: int) -> str:
    rows = []
    for path, coef, se, dof in (("a", "a", "sa", "n-2"), ("b", "b", "sb", "n-3"), ("c_prime", "cp", "sp", "n-3"), ("c", "c", "sc", "n-2")):
        rows.append(
            f"SELECT n, kind, '{path}' AS path, {coef} AS k, {se} AS s, {coef}/{se} AS z, {t_p(f'({coef}/{se})', dof)} AS p FROM w"
        )
    rows.append("SELECT n, kind, 'indirect', a*b, NULL, sz, sp2 FROM w")
    return f"""{mediation_cte(x, m, y)},
o AS ({" UNION ALL ".join(rows)})
SELECT n, kind AS mediation_type, path, round(k,{digits}) AS coefficient, round(s,{digits}) AS std_err, round(z,{z_digits}) AS statistic,
  round(p,{digits}) AS p_value, p < 0.05 AS is_significant FROM o"""


# Fixed points of the Lilliefors p-value, written for the range these tables fall in.
LILLIEFORS_P = """exp(-7.01256*pow(dd,2)*(nn+2.78019) + 2.99587*dd*sqrt(nn+2.78019) - 0.122119 + 0.974598/sqrt(nn) + 1.67997/nn)"""


def lilliefors_sql(key: str = "") -> str:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    by = f"GROUP BY {key}" if key else ""
    return f"""WITH s AS (SELECT {k}o_totalprice AS y, row_number() OVER ({part} ORDER BY o_totalprice) AS i, count(*) OVER ({part}) AS n,
  avg(o_totalprice) OVER ({part}) AS m, stddev_samp(o_totalprice) OVER ({part}) AS sd FROM orders),
z AS (SELECT *, (y-m)/sd AS z FROM s), f AS (SELECT *, {phi("z")} AS f FROM z),
d AS (SELECT {k}max(n) AS n, max(greatest(i/CAST(n AS DOUBLE) - f, f - (i-1)/CAST(n AS DOUBLE))) AS d FROM f {by}),
e AS (SELECT *, d*pow(n/100.0,0.49) AS dd, 100.0 AS nn FROM d), p AS (SELECT *, {LILLIEFORS_P} AS p FROM e)
SELECT {k}'o_totalprice' AS "column", 'Kolmogorov-Smirnov (Lilliefors)' AS test_name, n, round(d,7) AS statistic, round(p,6) AS p_value, p >= 0.05 AS is_normal FROM p"""


def ordered_weights(n: int) -> list[float]:
    """Shapiro-Wilk weights: the outermost one or two from the published polynomials, the rest scaled to unit length."""
    # Corrections of the largest and second largest weight (Royston 1995), powers 1 to 5 of 1/sqrt(n).
    corrections = (
        (0.221157, -0.147981, -2.07119, 4.434685, -2.706056),
        (0.042981, -0.293762, -1.752461, 5.682633, -3.582633),
    )
    m = [NormalDist().inv_cdf((8 * i - 3) / (8 * n + 2)) for i in range(1, n + 1)]
    length = sum(v * v for v in m) ** 0.5
    outer = [
        m[n - 1 - j] / length + sum(c * n ** (-power / 2) for power, c in enumerate(corrections[j], start=1))
        for j in range(1 if n <= 5 else 2)
    ]
    middle = m[len(outer) : n - len(outer)]
    share = ((1 - 2 * sum(w * w for w in outer)) / sum(v * v for v in middle)) ** 0.5
    return [*(-w for w in outer), *(v * share for v in middle), *reversed(outer)]


def weight_rows() -> str:
    return ", ".join(f"({n},{i},{w!r})" for n in range(5, 30) for i, w in enumerate(ordered_weights(n), start=1))


SHAPIRO_P = f"""CASE WHEN n <= 11 AND lw >= -2.273+0.459*n THEN 1e-99 ELSE 1 - {
    phi('''((CASE WHEN n <= 11 THEN (-ln(greatest(-2.273+0.459*n-lw,1e-300)) - (0.544-0.39978*n+0.025054*n*n-6.714e-4*n*n*n))/exp(1.3822-0.77857*n+0.062767*n*n-0.0020322*n*n*n)
 ELSE (lw - (-1.5861-0.31082*ln(n)-0.083751*pow(ln(n),2)+0.0038915*pow(ln(n),3)))/exp(-0.4803-0.082676*ln(n)+0.0030302*pow(ln(n),2)) END))''')
} END"""

SHAPIRO = f"""a(wn, wi, w) AS (VALUES {weight_rows()}),
s AS (SELECT o_custkey, o_totalprice AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
w AS (SELECT o_custkey, max(n) AS n, least(1.0, pow(sum(w*y),2)/(var_samp(y)*(max(n)-1))) AS w FROM s JOIN a ON a.wn = n AND a.wi = i GROUP BY 1),
lw AS (SELECT *, ln(greatest(1-w,1e-19)) AS lw FROM w), p AS (SELECT *, {SHAPIRO_P} AS p FROM lw)"""


def stationarity_frame(inner: str, key: str = "") -> str:
    """(key, d, t, z): a daily series and its first two differences, numbered inside each."""
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return f"""{inner},
pos AS (SELECT {k}row_number() OVER ({part} ORDER BY day) AS t, y FROM src),
dif AS (SELECT {k}t, y, y - lag(y) OVER ({part} ORDER BY t) AS d1, y - 2*lag(y) OVER ({part} ORDER BY t) + lag(y,2) OVER ({part} ORDER BY t) AS d2 FROM pos),
zz AS (SELECT {k}0 AS d, t, y AS z FROM dif UNION ALL SELECT {k}1, t-1, d1 FROM dif WHERE d1 IS NOT NULL UNION ALL SELECT {k}2, t-2, d2 FROM dif WHERE d2 IS NOT NULL)"""


def kpss_sql(inner: str, key: str, digits: int = 5) -> str:
    """Level-stationarity statistic with the automatic bandwidth; autocovariances by an offset self-join."""
    return f"""WITH {stationarity_frame(inner, key)},
e AS (SELECT {key}, d, t, count(*) OVER (PARTITION BY {key}, d) AS n, z - avg(z) OVER (PARTITION BY {key}, d) AS e FROM zz),
c AS (SELECT a.{key}, a.d, a.t - b.t AS h, max(a.n) AS n, sum(a.e*b.e) AS s FROM e a JOIN e b ON a.{key}=b.{key} AND a.d=b.d AND b.t <= a.t GROUP BY ALL),
b AS (SELECT {key}, d, max(n) AS n, sum(CASE WHEN h=0 THEN s/n WHEN h <= floor(pow(n,2.0/9)) THEN s/(n/2.0) ELSE 0 END) AS s0,
  sum(CASE WHEN h BETWEEN 1 AND floor(pow(n,2.0/9)) THEN h*s/(n/2.0) ELSE 0 END) AS s1 FROM c GROUP BY 1,2),
w AS (SELECT *, least(CAST(floor(1.1447*pow(pow(s1/s0,2),1.0/3)*pow(n,1.0/3)) AS BIGINT), n-1) AS bw FROM b),
lr AS (SELECT w.{key}, w.d, max(w.n) AS n, max(bw) AS bw, sum(CASE WHEN h=0 THEN s WHEN h<=bw THEN 2*s*(1-h/(bw+1.0)) ELSE 0 END)/max(w.n) AS lr
  FROM w JOIN c ON w.{key}=c.{key} AND w.d=c.d GROUP BY 1,2),
u AS (SELECT {key}, d, sum(pow(c,2)) AS u FROM (SELECT {key}, d, sum(e) OVER (PARTITION BY {key}, d ORDER BY t) AS c FROM e) GROUP BY 1,2),
k AS (SELECT lr.*, u/(CAST(n AS DOUBLE)*n)/lr AS k FROM lr JOIN u ON lr.{key}=u.{key} AND lr.d=u.d)
SELECT {key}, CAST(d AS BIGINT) AS d, n, round(k,{digits}) AS kpss_stat, bw AS kpss_lag, round(CASE WHEN k<=0.347 THEN 0.10 WHEN k<=0.463 THEN 0.10+(k-0.347)/(0.463-0.347)*(0.05-0.10)
  WHEN k<=0.574 THEN 0.05+(k-0.463)/(0.574-0.463)*(0.025-0.05) WHEN k<=0.739 THEN 0.025+(k-0.574)/(0.739-0.574)*(0.01-0.025) ELSE 0.01 END,{digits}) AS kpss_p FROM k"""


def ols_term(term: str, position: int, b: str, se: str, dof: str, is_const: bool = False, digits: int = 4) -> str:
    t = f"({b})/({se})"
    side = "CAST(NULL AS VARCHAR)" if is_const else f"CASE WHEN {b} > 0 THEN 'positive' ELSE 'negative' END"
    return f"""SELECT '{term}' AS term, CAST({position} AS BIGINT) AS position, round({b},{digits}) AS coefficient, round({se},{digits}) AS std_err,
  round({t},{digits}) AS t, round({t_p(f"({t})", dof)},5) AS p_value, {t_p(f"({t})", dof)} < 0.05 AS is_significant, {side} AS direction FROM fit"""


CONST_SE = "sqrt(s2*(1.0/n + (ma*ma*sbb - 2*ma*mb*sab + mb*mb*saa)/det))"

ORACLE: dict[str, str] = {
    "profile_orders": """SELECT CAST(i AS BIGINT) AS position, c AS "column", t AS "type", n AS n_rows, CAST(0 AS BIGINT) AS n_null, c = 'o_orderdate' AS is_time
FROM (VALUES (0,'o_orderkey','numerical'),(1,'o_custkey','numerical'),(2,'o_orderstatus','categorical'),(3,'o_totalprice','numerical'),
 (4,'o_orderdate','categorical'),(5,'o_orderpriority','categorical')) v(i,c,t), (SELECT count(*) AS n FROM orders)""",
    "detect_structure_events": "SELECT 'time_series' AS structure, 'ts' AS time_col, count(*) AS n_rows FROM events WHERE ts IS NOT NULL",
    "convert_types": f"""WITH {DIRTY} SELECT o_orderkey, txt_numeric, CASE WHEN o_orderkey % 4 = 0 THEN 'abc' ELSE CAST(o_totalprice AS VARCHAR) END AS txt_text,
 'numerical' AS txt_numeric_type, 'categorical' AS txt_text_type FROM dirty JOIN orders USING (o_orderkey)""",
    "missing_report": f"""WITH {DIRTY}, c AS (SELECT count(*) AS n, count_if(y_drop IS NULL) AS a, count_if(y_impute IS NULL) AS b, count_if(s_impute IS NULL) AS s FROM dirty),
r AS (SELECT 0 AS position, 'y_drop' AS c, a AS m, n FROM c UNION ALL SELECT 1, 'y_impute', b, n FROM c UNION ALL SELECT 2, 's_impute', s, n FROM c UNION ALL SELECT 3, 'o_orderstatus', 0, n FROM c)
SELECT CAST(position AS BIGINT) AS position, c AS "column", CAST(m AS BIGINT) AS n_missing, round(m*100.0/n,2)::DOUBLE AS percent,
 CASE WHEN m=0 THEN 'none' WHEN m*100.0/n < 5 THEN 'drop' ELSE 'impute' END AS strategy FROM r""",
    "drop_sparse_missing": f"WITH {DIRTY} SELECT o_orderkey, y_drop, y_impute FROM dirty WHERE y_drop IS NOT NULL",
    "impute_median": f"WITH {DIRTY} SELECT o_orderkey, coalesce(y_impute, (SELECT median(y_impute) FROM dirty)) AS y_impute FROM dirty",
    "impute_mode": f"""WITH {DIRTY}, m AS (SELECT s_impute FROM dirty WHERE s_impute IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s_impute LIMIT 1)
SELECT o_orderkey, coalesce(s_impute, (SELECT s_impute FROM m)) AS s_impute FROM dirty""",
    "iqr_filter_one": f"WITH {fences('events', 'value', 'f')} SELECT event_id, value FROM events, f WHERE value BETWEEN lo AND hi",
    "iqr_filter_sequential": f"""WITH {AMOUNTS}, {fences('amounts', 'volume', 'f1')}, a1 AS (SELECT * EXCLUDE (lo, hi) FROM amounts, f1 WHERE volume BETWEEN lo AND hi),
{fences('a1', 'rebate', 'f2')}, a2 AS (SELECT * EXCLUDE (lo, hi) FROM a1, f2 WHERE rebate BETWEEN lo AND hi), {fences('a2', 'l_quantity', 'f3')}
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(rebate,4) AS rebate, round(volume,4) AS volume FROM a2, f3 WHERE l_quantity BETWEEN lo AND hi""",
    "iqr_filter_simultaneous": f"""WITH {AMOUNTS}, {fences('amounts', 'volume', 'f1')}, {fences('amounts', 'rebate', 'f2')}
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(rebate,4) AS rebate, round(volume,4) AS volume FROM amounts, f1, f2
WHERE volume BETWEEN f1.lo AND f1.hi AND rebate BETWEEN f2.lo AND f2.hi""",
}

CLEANED = f"""{DIRTY}, kept AS (SELECT * FROM dirty WHERE y_drop IS NOT NULL),
mode_row AS (SELECT s_impute AS s FROM kept WHERE s_impute IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s_impute LIMIT 1),
fill AS (SELECT o_orderkey, y_drop, coalesce(y_impute, (SELECT median(y_impute) FROM kept)) AS y_impute,
 coalesce(s_impute, (SELECT s FROM mode_row)) AS s_impute, coalesce(txt_numeric, (SELECT median(txt_numeric) FROM kept)) AS txt_numeric FROM kept),
{fences('fill', 'y_drop', 'f1')}, c1 AS (SELECT * EXCLUDE (lo, hi) FROM fill, f1 WHERE y_drop BETWEEN lo AND hi),
{fences('c1', 'y_impute', 'f2')}, c2 AS (SELECT * EXCLUDE (lo, hi) FROM c1, f2 WHERE y_impute BETWEEN lo AND hi),
{fences('c2', 'txt_numeric', 'f3')}, c3 AS (SELECT * EXCLUDE (lo, hi) FROM c2, f3 WHERE txt_numeric BETWEEN lo AND hi)"""


def _step(column: str, before: str, after: str, f: str) -> str:
    return f"""SELECT 'outliers', '{column}', CASE WHEN b.n > a.n THEN 'filter' ELSE 'none' END, b.n - a.n, NULL,
 CASE WHEN b.n > a.n THEN round(lo,4) END, CASE WHEN b.n > a.n THEN round(hi,4) END, NULL
 FROM (SELECT count(*) AS n FROM {before}) b, (SELECT count(*) AS n FROM {after}) a, {f}"""


ORACLE |= {
    "clean_orders": f"WITH {CLEANED} SELECT o_orderkey, y_drop, y_impute, s_impute, txt_numeric FROM c3",
    "cleaning_log": f"""WITH {CLEANED}, k AS (SELECT count(*) AS n, count_if(y_drop IS NULL) AS a, count_if(y_impute IS NULL) AS b, count_if(s_impute IS NULL) AS s, count_if(txt_numeric IS NULL) AS t FROM dirty),
l AS (SELECT count_if(y_impute IS NULL) AS b, count_if(s_impute IS NULL) AS s, count_if(txt_numeric IS NULL) AS t, median(y_impute) AS mb, median(txt_numeric) AS mt FROM kept),
log(step, "column", action, n_rows, percent, lower, upper, imputed_value) AS (
 SELECT 'types', 'txt_numeric', 'converted to number', 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::VARCHAR
 UNION ALL SELECT 'missing', 'y_drop', 'drop', a::BIGINT, round(a*100.0/n,2), NULL, NULL, NULL FROM k
 UNION ALL SELECT 'missing', 'y_impute', 'impute', l.b::BIGINT, round(k.b*100.0/n,2), NULL, NULL, mb::VARCHAR FROM k, l
 UNION ALL SELECT 'missing', 's_impute', 'impute', l.s::BIGINT, round(k.s*100.0/n,2), NULL, NULL, (SELECT s FROM mode_row) FROM k, l
 UNION ALL SELECT 'missing', 'txt_numeric', 'impute', l.t::BIGINT, round(k.t*100.0/n,2), NULL, NULL, mt::VARCHAR FROM k, l
 UNION ALL {_step('y_drop', 'fill', 'c1', 'f1')} UNION ALL {_step('y_impute', 'c1', 'c2', 'f2')} UNION ALL {_step('txt_numeric', 'c2', 'c3', 'f3')})
SELECT * FROM log""",
    "describe_lineitem": describe_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem").replace("__V__", "2"),
    "describe_by_nation": describe_sql(["c_acctbal"], "customer", "c_nationkey").replace("__V__", "2").replace(
        "SELECT c_nationkey, 'c_acctbal'", "SELECT c_nationkey::BIGINT AS c_nationkey, 'c_acctbal'"
    ),
    "describe_by_supplier": describe_sql(["l_extendedprice", "l_quantity"], "lineitem", "l_suppkey").replace("__V__", "1"),
    "group_summary_orders": """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice),4) AS mean, round(median(o_totalprice),4) AS median
FROM orders GROUP BY 1, 2""",
    "group_guard_suppliers": """WITH g AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)
SELECT count(*) AS n_groups, min(n) AS smallest_n, CASE WHEN count(*) < 2 THEN 'fewer than 2 groups' WHEN min(n) < 5
 THEN 'group below 5 rows: ' || (SELECT s_nationkey::VARCHAR FROM g ORDER BY n, s_nationkey LIMIT 1) ELSE 'ok' END AS status FROM g""",
    "instrument_items": f"""WITH {CHARGED}, i AS (SELECT price/1000 AS a, discounted/1000 AS b, charge/1000 AS c, l_quantity AS d FROM charged),
t AS (SELECT count(*) AS n, 4/3.0*(1-(var_samp(a)+var_samp(b)+var_samp(c)+var_samp(d))/var_samp(a+b+c+d)) AS alpha,
 corr(a,b+c+d) AS ra, corr(b,a+c+d) AS rb, corr(c,a+b+d) AS rc, corr(d,a+b+c) AS rd FROM i),
r AS (SELECT 0 AS position, 'item_price' AS item, ra AS r, alpha, n FROM t UNION ALL SELECT 1, 'item_discounted', rb, alpha, n FROM t
 UNION ALL SELECT 2, 'item_charge', rc, alpha, n FROM t UNION ALL SELECT 3, 'item_quantity', rd, alpha, n FROM t)
SELECT position::BIGINT AS position, item, round(r,6) AS r, round({t_p("(r*sqrt((n-2)/(1-r*r)))", "n-2")},6) AS p_value, r >= 0.3 AS is_valid,
 CASE WHEN r >= 0.3 THEN 'valid' ELSE 'invalid' END AS item_label, round(alpha,6) AS cronbach_alpha, alpha >= 0.6 AS is_reliable,
 CASE WHEN alpha >= 0.6 THEN 'reliable' ELSE 'unreliable' END AS instrument_label, n FROM r""",
    "normality_orders": lilliefors_sql(),
    "normality_by_priority": lilliefors_sql("o_orderpriority"),
    "shapiro_by_customer": f"""WITH {SHAPIRO} SELECT o_custkey, 'o_totalprice' AS "column", 'Shapiro-Wilk' AS test_name, n, round(w,6) AS statistic,
 round(p,5) AS p_value, p >= 0.05 AS is_normal FROM p""",
    "welch_t": f"""WITH src AS (SELECT * FROM orders WHERE o_orderstatus IN ('F','O')), {group_test("src", "o_totalprice", "o_orderstatus")}, {two_groups()},
t AS (SELECT *, (m1-m2)/sqrt(v1/n1+v2/n2) AS t, pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1)) AS dof FROM two),
p AS (SELECT *, {t_p("t", "dof")} AS p FROM t)
SELECT {test_columns("Independent Samples T-Test", "t", "dof", "", "Cohen''s d", "(m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2))", "CASE WHEN m1 > m2 THEN l1 ELSE l2 END", "'t distribution'")} FROM p""",
    "paired_t": f"""WITH {HALVES}, s AS (SELECT count(*) AS n, avg(y1-y2) AS m, stddev_samp(y1-y2) AS sd, avg(y1) AS m1, avg(y2) AS m2 FROM pairs),
t AS (SELECT *, m*sqrt(n)/sd AS t FROM s), p AS (SELECT *, {t_p("t", "(n-1)")} AS p FROM t)
SELECT {test_columns("Paired Samples T-Test", "t", "n-1", "", "Cohen''s d", "m/sd", "CASE WHEN m1 > m2 THEN 'before' ELSE 'from' END", "'t distribution'")} FROM p""",
    "wilcoxon": f"""WITH {HALVES}, d AS (SELECT abs(y1-y2) AS a, y1 > y2 AS up FROM pairs WHERE y1 <> y2), rk AS ({ranked("d", "a")}),
s AS (SELECT count(*) AS n, sum(CASE WHEN up THEN rk ELSE 0 END) AS plus, sum(tied*tied-1.0) AS ties FROM rk),
m AS (SELECT count(*) AS pairs, median(y1) AS m1, median(y2) AS m2 FROM pairs),
z AS (SELECT *, least(plus, n*(n+1)/2.0-plus) AS t, (n*(n+1)/4.0 - least(plus, n*(n+1)/2.0-plus))/sqrt(n*(n+1)*(2*n+1)/24.0 - ties/48) AS z FROM s, m),
p AS (SELECT *, {two_sided_normal("z")} AS p FROM z)
SELECT {test_columns("Wilcoxon Signed-Rank Test", "t", "", "", "r (Z/sqrt(N))", rank_z_effect("p", "z", "2*pairs"), "CASE WHEN m1 > m2 THEN 'before' ELSE 'from' END", "'normal approximation'")} FROM p""",
    "mann_whitney": mann_whitney_sql("(SELECT * FROM orders WHERE o_orderstatus IN ('F','O'))", "o_totalprice", "o_orderstatus"),
    "mann_whitney_by_priority": mann_whitney_sql(
        "(SELECT * FROM orders WHERE o_orderstatus IN ('F','O'))", "o_totalprice", "o_orderstatus", "o_orderpriority"
    ),
    "kruskal_events": kruskal_sql("events", "value", "event_type", 2),
    "kruskal_quantity": kruskal_sql("lineitem", "l_quantity", "l_returnflag", 1),
    "anova_events": anova_sql("events", "value", "event_type", f_p_4),
    "anova_by_segment": anova_sql("orders", "o_totalprice", "o_orderstatus", f_p_2, "o_orderpriority"),
    "tukey_events": f"""WITH g AS (SELECT event_type AS l, count(*) AS n, avg(value) AS m, var_samp(value)*(count(*)-1) AS ss FROM events GROUP BY 1),
e AS (SELECT sum(ss)/(sum(n)-count(*)) AS mse, CAST(count(*) AS DOUBLE) AS k, CAST(sum(n)-count(*) AS DOUBLE) AS v FROM g),
q AS (SELECT a.l AS group1, b.l AS group2, a.m-b.m AS d, abs(a.m-b.m)/sqrt(mse/2*(1.0/a.n+1.0/b.n)) AS q, k, v FROM g a JOIN g b ON a.l < b.l, e),
{studentized_range("q")}
SELECT group1, group2, round(d,5) AS mean_diff, round(q,5) AS statistic, round(p,5) AS p_corrected, p < 0.05 AS is_significant FROM q JOIN tail USING (q)""",
    "pairwise_mann_whitney": f"""WITH k AS (SELECT DISTINCT event_type AS l FROM events),
pr AS (SELECT a.l AS group1, b.l AS group2 FROM k a JOIN k b ON a.l < b.l),
src AS (SELECT group1, group2, event_type, value FROM pr JOIN events ON event_type = group1 OR event_type = group2),
rk AS ({ranked("src", "value", "group1, group2")}),
s AS (SELECT group1, group2, count_if(event_type=group1)::DOUBLE AS n1, count_if(event_type=group2)::DOUBLE AS n2, sum(CASE WHEN event_type=group1 THEN rk END) AS r1,
 sum(tied*tied-1.0) AS ties, avg(CASE WHEN event_type=group1 THEN value END) - avg(CASE WHEN event_type=group2 THEN value END) AS md FROM rk GROUP BY 1,2),
u AS (SELECT *, r1-n1*(n1+1)/2 AS u, n1+n2 AS nn FROM s),
z AS (SELECT *, (greatest(u,n1*n2-u)-n1*n2/2-0.5)/sqrt(n1*n2/12*((nn+1)-ties/(nn*(nn-1)))) AS z FROM u),
p AS (SELECT *, least(1.0, least(1.0, 2*(1-{phi("z")}))*(SELECT count(*) FROM pr)) AS p FROM z)
SELECT group1, group2, round(md,5) AS mean_diff, round(u,5) AS statistic, round(z,5) AS z, round(p,5) AS p_corrected, p < 0.05 AS is_significant FROM p""",
    "ols_simple": f"""WITH {CHARGED}, s AS (SELECT count(*) AS n, regr_slope(charge,price) AS b, regr_intercept(charge,price) AS b0, regr_r2(charge,price) AS r2,
 regr_sxx(charge,price) AS sxx, regr_syy(charge,price) AS syy, avg(price) AS mx FROM charged),
fit AS (SELECT *, (1-r2)*syy/(n-2) AS s2, r2*syy/((1-r2)*syy/(n-2)) AS f FROM s),
x AS (SELECT *, b/sqrt(s2/sxx) AS t1, b0/sqrt(s2*(1.0/n+mx*mx/sxx)) AS t0 FROM fit),
r AS (SELECT 'const' AS term, 0 AS position, b0 AS k, sqrt(s2*(1.0/n+mx*mx/sxx)) AS se, t0 AS t, {t_p("t0", "(n-2)")} AS p, * EXCLUDE (b, b0) FROM x
 UNION ALL SELECT 'price', 1, b, sqrt(s2/sxx), t1, {t_p("t1", "(n-2)")}, * EXCLUDE (b, b0) FROM x)
SELECT term, position::BIGINT AS position, round(k,5) AS coefficient, round(se,6) AS std_err, round(t,3) AS t, round(p,5) AS p_value, n, round(r2,5) AS r_squared,
 round(1-(1-r2)*(n-1)/(n-2),5) AS adj_r_squared, round(f,0) AS f_statistic, 0.0::DOUBLE AS f_p_value, 1::BIGINT AS n_predictors, p < 0.05 AS is_significant,
 CASE WHEN term = 'const' THEN NULL WHEN k > 0 THEN 'positive' ELSE 'negative' END AS direction, round(r2*100,5) AS explained_pct FROM r""",
    "ols_multi": f"""WITH {CHARGED}, {ols_two_sql("price", "l_quantity", "l_discount", "charged")},
o AS ({ols_term("const", 0, "b0", CONST_SE, "n-3", True)} UNION ALL {ols_term("l_quantity", 1, "ba", "sqrt(s2*sbb/det)", "n-3")}
 UNION ALL {ols_term("l_discount", 2, "bb", "sqrt(s2*saa/det)", "n-3")}) SELECT * FROM o""",
    "ols_fit_by_flag": f"""WITH {CHARGED}, {ols_two_sql("price", "l_quantity", "l_discount", "charged", "l_returnflag")}
SELECT l_returnflag, 'Multiple Linear Regression' AS model, n, 2::BIGINT AS n_predictors, round(sse/syy,6) AS r_squared,
 round(1-(rss/syy)*(n-1)/(n-3),6) AS adj_r_squared, round(f,4) AS f_statistic, round({f_p_2("f", "(n-3)")},5) AS p_value,
 {f_p_2("f", "(n-3)")} < 0.05 AS is_significant, round(100*sse/syy,6) AS explained_pct FROM fit""",
    "vif_eliminate": f"""WITH {CHARGED}, c AS (SELECT corr(l_quantity,price) AS qp, corr(l_quantity,discounted) AS qd, corr(price,discounted) AS pd FROM charged),
d AS (SELECT *, 1 + 2*qp*qd*pd - qp*qp - qd*qd - pd*pd AS det FROM c),
v AS (SELECT *, (1-pd*pd)/det AS v1, (1-qd*qd)/det AS v2, (1-qp*qp)/det AS v3 FROM d),
w AS (SELECT 1 AS round, 'l_quantity' AS variable, v1 AS vif, v1 > 10 AND v1 >= v2 AND v1 >= v3 AS gone FROM v
 UNION ALL SELECT 1, 'price', v2, v2 > 10 AND v2 > v1 AND v2 >= v3 FROM v UNION ALL SELECT 1, 'discounted', v3, v3 > 10 AND v3 > v1 AND v3 > v2 FROM v
 UNION ALL SELECT 2, x, CASE WHEN v3 > v2 THEN 1/(1-qp*qp) ELSE 1/(1-qd*qd) END, false FROM v, (SELECT unnest(['l_quantity', CASE WHEN v3 > v2 THEN 'price' ELSE 'discounted' END]) AS x FROM v))
SELECT round::BIGINT AS round, variable, round(vif,3) AS vif, gone AS eliminated FROM w""",
    "pearson_table": "WITH "
    + correlation_table(
        " UNION ALL ".join(f"SELECT {i} AS position, '{x}' AS variable, count(*) AS n, corr({x}, l_extendedprice) AS r FROM lineitem" for i, x in enumerate(XS)),
        "Pearson Correlation",
    ),
    "spearman_table": "WITH " + correlation_table(spearman_rows("lineitem", "l_extendedprice", XS), "Spearman Rank Correlation"),
    "spearman_by_brand": "WITH " + correlation_table(spearman_rows("part", "p_retailprice", ["p_size"], "p_brand"), "Spearman Rank Correlation", "p_brand"),
    "kendall_table": kendall_sql("lineitem", "l_quantity", ["l_discount", "l_tax", "l_linenumber"]),
    "kendall_by_brand": kendall_sql("(SELECT p_brand, p_size, round(p_retailprice/50) AS price FROM part)", "price", ["p_size"], "p_brand"),
    "corr_matrix": f"WITH {CHARGED} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS "row", '{b}' AS "col", round(corr({a},{b}),6) AS r FROM charged"""
        for a in ("charge", "price", "l_quantity") for b in ("charge", "price", "l_quantity")
    ),
    "mediation_full": mediation_sql("price", "discounted", "charge", 5, 2),
    "mediation_none": mediation_sql("l_discount", "l_quantity", "price", 4, 4),
    "auto_mediate": f"""{mediation_cte("price", "discounted", "charge")}, p AS (SELECT *, sp2 AS p FROM w)
SELECT 'Path Analysis (Simple Mediation)' AS test, round(sz,2) AS statistic, NULL::DOUBLE AS df1, NULL::DOUBLE AS df2, round(p,6) AS p_value,
 p < 0.05 AS is_significant, 'indirect effect' AS effect_name, round(a*b,6) AS effect_size, NULL::VARCHAR AS higher_group, NULL::VARCHAR AS method, {DECISION} AS decision FROM p""",
    "moderation": f"""WITH {CHARGED}, x AS (SELECT price AS y, l_quantity AS x1, l_discount AS x2, l_quantity*l_discount AS x3 FROM charged),
a AS (SELECT *, x2 - avg(x2) OVER () - regr_slope(x2,x1) OVER () * (x1 - avg(x1) OVER ()) AS e2 FROM x),
c AS (SELECT *, x3 - avg(x3) OVER () - regr_slope(x3,x1) OVER () * (x1 - avg(x1) OVER ()) - regr_slope(x3,e2) OVER () * e2 AS e3 FROM a),
s AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, regr_slope(y,x1) AS d1, regr_slope(y,e2) AS d2, regr_slope(y,e3) AS d3,
 regr_slope(x2,x1) AS g21, regr_slope(x3,x1) AS g31, regr_slope(x3,e2) AS g32, regr_sxx(y,x1) AS s1, regr_sxx(y,e2) AS s2q, regr_sxx(y,e3) AS s3, regr_syy(y,x1) AS syy FROM c),
b AS (SELECT *, d2 - d3*g32 AS b2, d1 - d2*g21 - d3*g31 + d3*g32*g21 AS b1, (syy - d1*d1*s1 - d2*d2*s2q - d3*d3*s3)/(n-4) AS s2, m2-g21*m1 AS k2, m3-g31*m1-g32*(m2-g21*m1) AS k3 FROM s),
fit AS (SELECT *, my - b1*m1 - b2*m2 - d3*m3 AS b0 FROM b),
o AS ({ols_term("const", 0, "b0", "sqrt(s2*(1.0/n + m1*m1/s1 + k2*k2/s2q + k3*k3/s3))", "n-4", True)}
 UNION ALL {ols_term("l_quantity", 1, "b1", "sqrt(s2*(1/s1 + g21*g21/s2q + pow(g32*g21-g31,2)/s3))", "n-4")}
 UNION ALL {ols_term("l_discount", 2, "b2", "sqrt(s2*(1/s2q + g32*g32/s3))", "n-4")} UNION ALL {ols_term("l_quantity*l_discount", 3, "d3", "sqrt(s2/s3)", "n-4")}) SELECT * FROM o""",
    "auto_compare": kruskal_sql("orders", "o_totalprice", "o_orderstatus", 1),
    "auto_compare_by_segment": kruskal_sql("orders", "o_totalprice", "o_orderstatus", 1, "o_orderpriority"),
    "analyze_orders": kruskal_sql("orders", "o_totalprice", "o_orderstatus", 1),
    "auto_compare_small_segments": f"""WITH {SHAPIRO}, g AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1,2),
k AS (SELECT o_custkey, count(*) AS k, min(n) AS least, arg_min(s, lpad(n::VARCHAR, 9, '0') || s) AS who FROM g GROUP BY 1),
q AS (SELECT k.*, p >= 0.05 AS is_normal, CASE WHEN k < 2 THEN 'fewer than 2 groups' WHEN least < 5 THEN 'group below 5 rows: ' || who ELSE 'ok' END AS status FROM k LEFT JOIN p USING (o_custkey))
SELECT o_custkey, k AS n_groups, coalesce(is_normal, false) AS is_normal, status, CASE WHEN status <> 'ok' THEN NULL WHEN k = 2 AND is_normal THEN 'Independent Samples T-Test' WHEN k = 2 THEN 'Mann-Whitney U Test'
 WHEN is_normal THEN 'One-Way ANOVA' ELSE 'Kruskal-Wallis Test' END AS test FROM q""",
    "auto_influence": f"""WITH {CHARGED}, {ols_two_sql("price", "l_quantity", "l_discount", "charged")}, p AS (SELECT *, {f_p_2("f", "(n-3)")} AS p FROM fit)
SELECT {test_columns("Multiple Linear Regression", "f", "2", "n-3", "R-squared", "sse/syy", "NULL::VARCHAR", "NULL::VARCHAR")} FROM p""",
    "auto_correlate": f"""WITH {CHARGED}, r AS ({spearman_rows("charged", "price", ["l_quantity", "l_discount"])}),
t AS (SELECT *, r*sqrt((n-2)/(1-r*r)) AS t FROM r), q AS (SELECT *, {t_p("t", "(n-2)")} AS p FROM t), p AS (SELECT * FROM q ORDER BY p, position LIMIT 1)
SELECT {test_columns("Spearman Rank Correlation", "r", "", "", "r", "r", "NULL::VARCHAR", "NULL::VARCHAR")} FROM p""",
    "scatter_grid": """WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT CAST(least(floor((l_quantity - a) / (b - a) * 40), 39) AS BIGINT) AS x_bin, CAST(least(floor((l_extendedprice - c) / (d - c) * 40), 39) AS BIGINT) AS y_bin, count(*) AS n
FROM lineitem, e GROUP BY 1, 2""",
    "box_stats": """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(value,0.25) AS q1, median(value) AS md, quantile_cont(value,0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, max(n) AS n, round(max(q1),4) AS q1, round(max(md),4) AS median, round(max(q3),4) AS q3,
 round(min(CASE WHEN value BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) THEN value END),4) AS whisker_low,
 round(max(CASE WHEN value BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1) THEN value END),4) AS whisker_high,
 count_if(value NOT BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1))::BIGINT AS n_fliers FROM events JOIN q USING (event_type) GROUP BY 1""",
    "trend_line": f"""WITH {CHARGED} SELECT l_returnflag, count(*) AS n, round(regr_slope(charge,price),5) AS slope, round(regr_intercept(charge,price),5) AS intercept,
 round(min(price),5) AS x_min, round(max(price),5) AS x_max FROM charged GROUP BY 1""",
    "difference_series": f"""WITH {DAILY_BY_TYPE}, p AS (SELECT event_type, row_number() OVER w AS pos, y - 2*lag(y) OVER w + lag(y,2) OVER w AS y FROM typed WINDOW w AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, pos, round(y,2) AS y FROM p WHERE y IS NOT NULL""",
    "seasonal_difference": f"""WITH {DAILY}, p AS (SELECT row_number() OVER w AS pos, y - lag(y,7) OVER w AS y FROM daily WINDOW w AS (ORDER BY day))
SELECT pos, round(y,2) AS y FROM p WHERE y IS NOT NULL""",
    "welch_constant_groups": f"""SELECT {test_columns("Independent Samples T-Test", "'-inf'::DOUBLE", "1", "", "Cohen''s d", "0.0::DOUBLE", "'O'", "'t distribution'")}
FROM (SELECT 0.0::DOUBLE AS p FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 2)""",
    "anova_constant_groups": f"""SELECT {test_columns("One-Way ANOVA", "'inf'::DOUBLE", "k-1", "n-k", "Eta-squared", "1.0::DOUBLE", "top", "'F distribution'")}
FROM (SELECT count(DISTINCT event_type) AS k, count(*) AS n, arg_max(event_type, length(event_type) * 1000 + ascii(event_type)) AS top, 0.0::DOUBLE AS p FROM events)""",
    "tukey_constant_groups": """WITH g AS (SELECT event_type AS l, length(event_type) * 1000 + ascii(event_type) AS m FROM events GROUP BY 1)
SELECT a.l AS group1, b.l AS group2, CAST(a.m - b.m AS DOUBLE) AS mean_diff, CASE WHEN a.m <> b.m THEN 'inf'::DOUBLE END AS statistic,
 CASE WHEN a.m <> b.m THEN 0.0::DOUBLE END AS p_corrected, a.m <> b.m AS is_significant FROM g a JOIN g b ON a.l < b.l""",
    "moderation_collinear": f"""WITH {CHARGED}, sq AS (SELECT price, l_quantity AS q, l_quantity * l_quantity AS qq FROM charged), {ols_two_sql("price", "q", "qq", "sq")},
o AS ({ols_term("const", 0, "b0", CONST_SE, "n-3", True)} UNION ALL {ols_term("l_quantity", 1, "ba/5", "sqrt(s2*sbb/det)/5", "n-3")}
 UNION ALL {ols_term("twice", 2, "2*ba/5", "2*sqrt(s2*sbb/det)/5", "n-3")} UNION ALL {ols_term("l_quantity*twice", 3, "bb/2", "sqrt(s2*saa/det)/2", "n-3")}) SELECT * FROM o""",
    "mann_whitney_exact": exact_rank_sum_sql(),
    "kpss_eta": kpss_sql("src AS (SELECT event_type, CAST(ts AS DATE) AS day, round(sum(value),2) AS y FROM events GROUP BY 1, 2)", "event_type"),
}

