"""Counts between all pairs of groups from one ordering of the values.

For every value in order, the running totals of all groups say how many members of each lie below. One walk along the
values therefore gives, for every pair (a, b), how often a member of a exceeds one of b, ties counting half:

    U(a, b) = sum over values v of c_a(v) * (C_b(< v) + c_b(v) / 2)

A large segment is walked bucket by bucket, each starting from zero; a second walk, over the buckets' group totals,
adds what lies in earlier buckets. Rows are read once, whatever the number of groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import join_on
from autostat.operators.order import Layout, bucketed

#: Cells (values x groups) looked at together.
CELLS = 1 << 20


def walked(group: np.ndarray, value: np.ndarray, count: np.ndarray, groups: int, ties: float) -> tuple[np.ndarray, np.ndarray]:
    """U as above with `ties` in place of 1/2, and the sums of c_a(v)^2 c_b(v); both groups x groups."""
    order = np.argsort(value, kind="stable")
    group, value, count = group[order], value[order], count[order].astype(float)
    place = np.cumsum(np.r_[0, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
    above, cross, below = np.zeros((groups, groups)), np.zeros((groups, groups)), np.zeros(groups)
    step = max(1, CELLS // groups)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [first, first + step])
        rows = (place[a:b] - first, group[a:b])
        cells = np.zeros((int(rows[0][-1]) + 1, groups))
        np.add.at(cells, rows, count[a:b])
        so_far = np.cumsum(cells, axis=0)
        lower = below + so_far - cells + ties * cells
        # Each row of the input meets the totals at its value once: rows x groups, also where most cells are empty.
        by_group = np.argsort(rows[1], kind="stable")
        at, mine, weight = rows[0][by_group], rows[1][by_group], count[a:b][by_group, None]
        starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        above[mine[starts]] += np.add.reduceat(weight * lower[at], starts)
        cross[mine[starts]] += np.add.reduceat(weight * cells[at, mine, None] * cells[at], starts)
        below = below + so_far[-1]
    return above, cross


def _walk(keys: Sequence[str], group: str, value: str, ties: float, fields: T.StructType) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        coded = rows[group].combine_chunks().dictionary_encode()
        names, k = coded.dictionary, len(coded.dictionary)
        above, cross = walked(coded.indices.to_numpy(), rows[value].to_numpy(), rows["cnt"].to_numpy(), k, ties)
        # `above` of (a, b) and (b, a) are two rows; the caller takes the one with the smaller label first.
        one, two = np.nonzero((above != 0) | (cross != 0) | (cross.T != 0))
        out = [pa.array([rows[c][0].as_py()] * len(one), rows.schema.field(c).type) for c in keys]
        out += [names.take(pa.array(x)) for x in (one, two)]
        out += [pa.array(above[one, two]), pa.array((cross + cross.T)[one, two] if ties else np.zeros(len(one)))]
        return pa.Table.from_arrays(out, fields.fieldNames())

    return run


def pair_counts(collapsed: DataFrame, value: str, group: str, keys: Sequence[str], layout: Layout) -> DataFrame:
    """(keys, group1, group2, u, cross) for label 1 < label 2: U of group 1, and the sum over values of
    c1^2 c2 + c1 c2^2. `collapsed` has one row (keys, group, value, cnt); pairs with only zeros may be absent."""
    keys = list(keys)
    kinds = {f.name: f.dataType for f in collapsed.schema.fields}
    fields = T.StructType([
        *[T.StructField(k, kinds[k]) for k in keys], T.StructField("group1", kinds[group]), T.StructField("group2", kinds[group]),
        T.StructField("u", T.DoubleType()), T.StructField("cross", T.DoubleType()),
    ])
    rows = bucketed(collapsed, value, keys, layout)
    inside = rows.select(*keys, "__bucket", group, value, "cnt").groupBy(*keys, "__bucket")
    found = inside.applyInArrow(_walk(keys, group, value, 0.5, fields), fields)
    if not layout.single:
        totals = rows.where(F.col("__bucket") >= 0).groupBy(*keys, "__bucket", group).agg(F.sum("cnt").alias("cnt"))
        among = totals.withColumn("__whole", F.lit(0)).groupBy(*keys, "__whole")
        found = found.unionByName(among.applyInArrow(_walk(keys, group, "__bucket", 0.0, fields), fields))
    found = found.where(F.col("group1") < F.col("group2"))
    return found.groupBy(*keys, "group1", "group2").agg(F.sum("u").alias("u"), F.sum("cross").alias("cross"))


def group_pairs(summary: DataFrame, group: str, columns: Sequence[str], keys: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """All pairs of one segment's group rows (the table a post-hoc test reports), label 1 < label 2.

    An equi-join on the segment; each first row is dealt to one of `parts` parts, so many groups spread over tasks."""
    one = summary.select(*keys, F.col(group).alias("group1"), *[F.col(c).alias(f"{c}1") for c in columns])
    one = one.withColumn("__part", F.pmod(F.xxhash64("group1"), F.lit(parts)).cast("int"))
    two = summary.select(*keys, F.col(group).alias("group2"), *[F.col(c).alias(f"{c}2") for c in columns])
    two = two.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return join_on(one, two, [*keys, "__part"]).where(F.col("group1") < F.col("group2")).drop("__part")
