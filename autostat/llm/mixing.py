"""Mixing sources to target weights by Poisson replication.

A source with weight w (weights are scaled to sum 1) shall make up w of a mixture of `size` rows, so each of its n
documents is wanted size * w / n times on average. The number of copies of a document is the Poisson quantile, with
that mean, of a uniform number seeded by its id: independent of all other rows, the same on every run, and exact in
the mean. A mean above `PART` is the sum of equal smaller ones with a uniform number each, which has the same
distribution. Copies are exploded and ordered by a second hash over the whole mixture.

Only counts per source are gathered. They are broadcast while there are at most `broadcast_sources` sources; beyond
that they are joined by (source, salt), so that a source with a third of all rows is spread. Rows are the same.

Defined results: a null source is a source of its own; rows with a null id share their uniform numbers, and so do
rows that repeat an id; sources without a given weight weigh 0 and vanish; weights of sources without rows are left
out before scaling; an empty table gives an empty mixture; texts are not looked at; an input column named like one
of the added columns gives way to it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.llm.text import total

BROADCAST_SOURCES = 10_000
SALTS = 64
#: Largest mean inverted at once, and how far its distribution is followed (beyond: 1e-30).
PART = 8.0
STEPS = 64
#: A uniform number is the first 52 bits of an MD5 digest.
HEX_DIGITS = 13
ADDED = ("copies", "copy", "shuffle_key")


def uniform(seed: str, *parts: Column) -> Column:
    """In [0, 1), from the text of the parts."""
    texts = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *texts).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(HEX_DIGITS)), 16, 10).cast("double") / float(16**HEX_DIGITS)


def poisson(mean: Column, u: Column) -> Column:
    """Smallest k with P(X <= k) > u."""
    first = F.struct(F.lit(0).cast("long").alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("below"))

    def step(state: Column, _: Column) -> Column:
        term = state["term"] * mean / (state["k"] + 1)
        after = F.struct((state["k"] + 1).alias("k"), term.alias("term"), (state["below"] + term).alias("below"))
        return F.when(u < state["below"], state).otherwise(after)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda state: state["k"])


def source_means(docs: DataFrame, source: str, weights: Mapping[str, float] | None, power: float,
                 size: float | None) -> DataFrame:
    """(_source, _mean): copies per document. Without weights, a source weighs its count to `power`."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        weight = F.coalesce(F.try_element_at(given, F.col("_source")), F.lit(0.0))
    weighted = counts.withColumn("_weight", weight)
    rows, scale = weighted.agg(F.sum("_n"), F.sum("_weight")).first()
    wanted = float(size if size is not None else rows or 0)
    return weighted.select("_source", (F.lit(wanted) * F.col("_weight") / (scale or 1.0) / F.col("_n")).alias("_mean"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
          weights: Mapping[str, float] | None = None, power: float = 0.5, size: float | None = None,
          seed: str = "mix", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The columns of `docs` with `copies`, `copy` (1, 2, ...) and `shuffle_key`, in the order of the last: partition
    by partition, and sorted in each."""
    means = source_means(docs, source, weights, power, size).where("_mean > 0")
    row = F.struct(*[docs[c] for c in docs.columns if c not in ADDED]).alias("_row")
    rows = docs.select(row, docs[doc_id].alias("_id"), docs[source].alias("_key"))
    same = F.col("_key").eqNullSafe(F.col("_source"))
    if means.limit(broadcast_sources + 1).count() <= broadcast_sources:
        joined = rows.join(F.broadcast(means), same)
    else:
        salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS))
        spread = means.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_at", salt).join(spread, same & (F.col("_at") == F.col("_salt")))
    parts = F.ceil(F.col("_mean") / PART)
    draws = F.transform(
        F.sequence(F.lit(1).cast("long"), parts),
        lambda i: poisson(F.col("_mean") / parts, uniform(seed, F.col("_id"), i)),
    )
    copied = joined.withColumn("copies", total(draws)).where("copies > 0")
    copied = copied.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    keyed = copied.withColumn("shuffle_key", uniform(f"{seed}:order", F.col("_id"), F.col("copy")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionById(n, F.floor(F.col("shuffle_key") * n).cast("int"))
    return dealt.sortWithinPartitions("shuffle_key").select("_row.*", *ADDED)
