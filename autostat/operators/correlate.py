"""Correlation of each predictor with the outcome: Pearson or Spearman."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autostat.functions.columns import by_segment, direction, join_on, numeric_frame, ratio, strength
from autostat.functions.tails import t_p
from autostat.operators.order import Layout, attach, bucket_rows, bucketed, midrank, ordered_counts, plan_layout
from autostat.sources.checkpoints import cut_lineage

# Values of a predictor (in all segments) whose ranks may be broadcast.
LOOKUP_VALUES = 100_000


def _report(df: DataFrame, keys: Sequence[str], method: str, alpha: float) -> DataFrame:
    """Finish rows of (keys, position, variable, n, raw)."""
    dof = (F.col("n") - 2).cast("double")
    raw = F.when(F.col("raw").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("raw"))))
    t = F.when(F.abs(raw) >= 1, F.lit(1e150)).otherwise(raw * F.sqrt(dof / (1 - raw * raw)))
    usable = raw.isNotNull() & (F.col("n") > 2)
    p = F.when(usable, t_p(F.when(usable, t), F.when(usable, dof))).otherwise(1.0)
    r = F.coalesce(raw, F.lit(0.0))
    return df.withColumn("p_value", p).select(
        *keys, "position", "variable", F.lit(method).alias("method"), "n", r.alias("r"), "p_value",
        (F.col("p_value") < alpha).alias("is_significant"), strength(r).alias("strength"), direction(r).alias("direction"),
    )


def _pair(x: str, y: str) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return ratio(F.covar_samp(a, b), F.sqrt(F.var_samp(a) * F.var_samp(b)))


@by_segment
def pearson(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """All predictors in one aggregation."""
    known = [x for x in dict.fromkeys(xs) if x in df.columns]
    rows = numeric_frame(df, list(dict.fromkeys([y, *known])), keys)
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.lit(x).alias("variable"),
            F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), _pair(x, y).alias("raw"),
        )
        for i, x in enumerate(known)
    ]
    flat = rows.groupBy(*keys).agg(F.array(*cells).alias("c")).select(*keys, F.inline("c"))
    return _report(flat, keys, "Pearson Correlation", alpha)


def _rank_rows(pairs: DataFrame, seg: Sequence[str]) -> DataFrame:
    """(seg, n, raw) of few pairs: each row gets its two mid-ranks."""
    ranked = pairs
    for column, out in (("x", "rx"), ("y", "ry")):
        ties = F.count(F.lit(1)).over(Window.partitionBy(*seg, column))
        first = F.rank().over(Window.partitionBy(*seg).orderBy(column))
        ranked = ranked.withColumn(out, first + (ties - 1) / 2)
    return ranked.groupBy(*seg).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.covar_samp("rx", "ry"), F.sqrt(F.var_samp("rx") * F.var_samp("ry"))).alias("raw"),
    )


def _rank_sums(rows: DataFrame, ranks: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, y, c0, s0, c1, s1, ..): per distinct y and predictor the complete pairs and the sum of their x-ranks.

    `rows` has (keys, y, x0, x1, ..), `ranks` (keys, position, x, rx, cnt). Predictors of few values look their ranks
    up in a broadcast, all in one pass; each of the others joins its complete pairs (see `attach`)."""
    per_predictor = ranks.groupBy("position").agg(F.count(F.lit(1)).alias("values"), F.sum("cnt").alias("n"))
    sizes = {r["position"]: r for r in per_predictor.collect()}
    few = [i for i in range(k) if i not in sizes or sizes[i]["values"] <= LOOKUP_VALUES]

    def sums(part: DataFrame, held: Sequence[int]) -> DataFrame:
        cells = {}
        for i in range(k):
            rank = F.col(f"r{i}") if i in held else F.lit(None).cast("double")
            cells |= {f"c{i}": F.when(rank.isNotNull(), 1).otherwise(0).cast("long"), f"s{i}": F.coalesce(rank, F.lit(0.0))}
        return part.select(*keys, "y", *[c.alias(name) for name, c in cells.items()])

    def of(i: int) -> DataFrame:
        return ranks.where(F.col("position") == i).select(*keys, F.col("x").alias(f"x{i}"), F.col("rx").alias(f"r{i}"), "cnt")

    parts, wide = [], rows
    for i in few:
        wide = join_on(wide, F.broadcast(of(i).drop("cnt")), [*keys, f"x{i}"], "left")
    if few:
        parts.append(sums(wide, few))
    for i in (i for i in range(k) if i not in few):
        pairs = rows.where(F.col(f"x{i}").isNotNull()).select(*keys, "y", f"x{i}")
        layout = Layout(sizes[i]["n"], bucket_rows(rows))
        parts.append(sums(attach(pairs, of(i), [*keys, f"x{i}"], layout, "cnt", [f"r{i}"]), [i]))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys, "y").agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(k) for c in "cs"])


def _rank_buckets(rows: DataFrame, pairs: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(seg, n, raw) of many pairs, from one ordering of the distinct y for all predictors.

    Ranks of x are looked up and summed per distinct y (`_rank_sums`). Inside a bucket of y its ranks are known up to the
    pairs in earlier buckets, so a bucket is reduced to a few sums: for a rank local + o, the products with x-ranks are
    sum(s local) + o sum(s), and squares about the bucket's mean follow from its ties."""
    k, seg = len(names), [*keys, "position"]
    counts = cut_lineage(pairs.groupBy(*seg, "x").agg(F.count(F.lit(1)).alias("cnt")))
    centred = (midrank() - (F.col("total") + 1) / 2).alias("rx")
    ranks = cut_lineage(ordered_counts(counts, "x", seg, (), plan_layout(counts, "x"), "cnt").select(*seg, "x", centred, "cnt"))
    spread_x = ranks.groupBy(*seg).agg(F.sum(F.col("cnt") * F.col("rx") * F.col("rx")).alias("sxx"))

    by_y = cut_lineage(_rank_sums(rows, ranks, keys, k))
    # A row holds all predictors: a bucket of fewer rows holds as many cells.
    cut = bucketed(by_y, "y", keys, plan_layout(by_y, "y", limit=max(1, bucket_rows(by_y) // (k + 1))))
    running = Window.partitionBy(*keys, "__bucket").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = cut.withColumns({f"u{i}": F.sum(f"c{i}").over(running) for i in range(k)})
    ties = lambda n: n.cast("double") * n * n - n
    cells = []
    for i, name in enumerate(names):
        c, s, local = F.col(f"c{i}"), F.col(f"s{i}"), F.col(f"u{i}") - (F.col(f"c{i}") - 1) / 2
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("variable"), F.sum(c).alias("c"), F.sum(ties(c)).alias("t"),
            F.sum(s).alias("s"), F.sum(s * local).alias("sl"),
        ))
    buckets = ordered.groupBy(*keys, "__bucket").agg(F.array(*cells).alias("cells"))
    buckets = buckets.select(*keys, "__bucket", F.inline("cells")).where(F.col("c") > 0)

    whole = Window.partitionBy(*seg)
    earlier = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before, n = F.coalesce(F.sum("c").over(earlier), F.lit(0)), F.sum("c").over(whole)
    buckets = buckets.withColumns({"o": before - (n + 1) / 2, "mean": before + (F.col("c") - n) / 2})
    c, o, mean = F.col("c"), F.col("o"), F.col("mean")
    flat = buckets.groupBy(*seg, "variable").agg(
        F.sum("c").alias("n"), F.sum(F.col("sl") + o * F.col("s")).alias("sxy"),
        F.sum((ties(c) - F.col("t")) / 12 + c * mean * mean).alias("syy"),
    )
    flat = join_on(flat, spread_x, seg)
    return flat.withColumn("raw", ratio(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))))


@by_segment
def spearman(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Rank correlation of all predictors in one job over complete pairs.

    Few pairs are ranked in long form (variable, x, y). Of many, the values of each predictor are ranked first, and
    one ordering of the outcome's distinct values serves all predictors."""
    known = [x for x in dict.fromkeys(xs) if x in df.columns]
    rows = numeric_frame(df, list(dict.fromkeys([y, *known])), keys)
    rows = rows.select(*keys, F.col(y).alias("y"), *[F.col(x).alias(f"x{i}") for i, x in enumerate(known)]).where("y IS NOT NULL")
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(x).alias("variable"), F.col(f"x{i}").alias("x"))
        for i, x in enumerate(known)
    ]
    pairs = rows.select(*keys, "y", F.inline(F.array(*cells))).where(F.col("x").isNotNull())
    complete = rows.agg(*[F.count(f"x{i}") for i in range(len(known))]).first()
    if sum(complete) <= bucket_rows(rows):
        flat = _rank_rows(pairs, [*keys, "position", "variable"])
    else:
        flat = _rank_buckets(rows, pairs, keys, known)
    return _report(flat, keys, "Spearman Rank Correlation", alpha)


@by_segment
def correlation_summary(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per segment: any predictor significant, and the smallest (uncorrected) p with its predictor."""
    best = F.min(F.struct("p_value", "position", "variable"))
    return table.groupBy(*keys).agg(
        F.max("method").alias("test"), F.bool_or("is_significant").alias("is_significant"),
        best["p_value"].alias("p_value"), best["variable"].alias("variable"), F.max_by("r", -F.col("p_value")).alias("r"),
    )


def both_methods(
    df: DataFrame, y: str, xs: Sequence[str], normal: DataFrame, keys: Sequence[str], alpha: float
) -> DataFrame:
    """Pearson where the segment's outcome is normal, Spearman elsewhere."""
    # Rows are parted before any is ranked.
    known = [x for x in dict.fromkeys(xs) if x in df.columns]
    rows = numeric_frame(df, list(dict.fromkeys([y, *known])), keys)
    flag = normal.select(*keys, F.col("n").alias("__size"), F.col("is_normal").alias("__normal"))
    rows = attach(rows, flag, keys, plan_layout(rows, y), "__size", ["__normal"])
    a = pearson(rows.where("__normal").drop("__normal"), y, known, keys, alpha)
    b = spearman(rows.where(~F.col("__normal")).drop("__normal"), y, known, keys, alpha)
    return a.unionByName(b)
