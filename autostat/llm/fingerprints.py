"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in Spark expressions only.

A paragraph is a line with a word; its digest is a 64-bit hash. A sketch has three tables of cells, and every digest of
a text is in one cell of each: a cell holds how many digests fell into it, their exclusive or, and the exclusive or
of their check hashes. Sketches of two versions are subtracted cell by cell, so what both have vanishes. Peeling
finds cells with exactly one digest left (count 1 or -1 and a fitting check hash), takes these out of their other
cells, and goes on; if nothing remains, all digests that differ have been recovered.

A fingerprint deals the digests to sections by hash, a power of two of them and at most `SECTION` digests each on
average, so work and size are in proportion to the paragraphs. Every section is one sketch, built again four times as
large until it can be peeled by itself (at most `RETRIES` times; what is stuck even then lists its digests). It
depends on the text's set of paragraphs only. Sections and cells are nested: neighbouring sections, and cells at equal
distance, add up to those of a smaller fingerprint. So any two published fingerprints can be compared: both are
brought to the smaller number of sections and to `CELLS` cells, subtracted and peeled; where too many digests differ for
that, both sides' sections are peeled at their full published size, which always recovers all.

The likeness of two fingerprints is the Jaccard similarity of their digests: with d recovered differences,
(|A| + |B| - d) / (|A| + |B| + d). `likeness` and `changes` need nothing but fingerprints (`parsed` reads published ones).

`versions` pairs every document with its successor by id without a global sort: ids are dealt into ranges, each range
is ordered by itself, and the first ids of the ranges close the gaps. Texts are shuffled once by id, and half of
them once more to their predecessor.

Defined results: a null or empty text has the empty sketch, and two empty sketches are alike (1.0); the successor of
the last document is the first, that of a single document itself; null ids come first; documents that share an id
follow each other by text hash; a row that repeats id and text gets the same result as the first; other columns are
ignored; no rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autostat.llm.text import let, total, whole
from autostat.sources.checkpoints import cut_lineage

TABLES = 3
#: Cells of a table on the first try, and in a comparison.
CELLS = 8
RETRIES = 3
#: Digests of a text in a section, at most, on average.
SECTION = 8
ROUNDS = 24
CHECK = 77
#: Sections are cut out of a range of so many hash values.
RANGE = 1 << 30


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def number(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def placed(keys: Column, cells: int | Column) -> Column:
    """Each digest with its check hash and its cells, counted over all tables."""

    def spots(k: Column) -> list[Column]:
        return [(F.pmod(F.xxhash64(k, F.lit(j)), number(cells)).cast("int") + number(cells) * j).alias(f"p{j}") for j in range(TABLES)]

    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k, F.lit(CHECK)).alias("c"), *spots(k)))


def cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def sketch(keys: Column, cells: int | Column) -> Column:
    """All cells, table after table."""
    empty = cell(F.lit(0), F.lit(0), F.lit(0))
    add = lambda a, x: cell(a["n"] + 1, a["k"].bitwiseXOR(x["k"]), a["c"].bitwiseXOR(x["c"]))
    one = lambda of, i: F.aggregate(of, empty, lambda a, x: F.when(within(x, i), add(a, x)).otherwise(a))
    return let(placed(keys, cells), lambda of: F.transform(F.sequence(F.lit(0), number(cells) * TABLES - 1), lambda i: one(of, i)))


def within(x: Column, i: Column) -> Column:
    """Whether a placed digest is in cell i."""
    return (x["p0"] == i) | (x["p1"] == i) | (x["p2"] == i)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: cell(x["n"] + y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def pure(now: Column) -> Column:
    """Digests that have a cell for themselves."""
    ones = F.filter(now, lambda x: (F.abs(x["n"]) == 1) & (x["c"] == F.xxhash64(x["k"], F.lit(CHECK))))
    return F.array_distinct(F.transform(ones, lambda x: x["k"]))


def peeled(cells: Column, size: int | Column) -> Column:
    """The digests in a sketch or a difference of two, with their signs; null if some stay hidden."""
    size = number(size)

    def without(now: Column, out: Column) -> Column:
        # A pure cell's sign is its own count; elsewhere the digest leaves with the sign it has there.
        less = lambda a, y: cell(a["n"] - y["n"], a["k"].bitwiseXOR(y["k"]), a["c"].bitwiseXOR(y["c"]))
        left = lambda x, i: F.aggregate(out, x, lambda a, y: F.when(within(y, i), less(a, y)).otherwise(a))
        return F.transform(now, left)

    def with_sign(now: Column, keys: Column) -> Column:
        sign = lambda k: F.element_at(F.filter(now, lambda x: (F.abs(x["n"]) == 1) & (x["k"] == k)), 1)["n"]
        spots = lambda y: [y[f"p{j}"].alias(f"p{j}") for j in range(TABLES)]
        return F.transform(placed(keys, size), lambda y: F.struct(y["k"].alias("k"), y["c"].alias("c"), *spots(y), sign(y["k"]).alias("n")))

    def step(state: Column, _: Column) -> Column:
        def taken(out: Column) -> Column:
            found = F.concat(state["found"], F.transform(out, lambda y: digest(y["k"], y["n"])))
            return F.struct(without(state["now"], out).alias("now"), found.alias("found"), F.lit(False).alias("done"))

        stop = F.struct(state["now"], state["found"], F.lit(True).alias("done"))
        go_on = lambda keys: F.when(F.size(keys) == 0, stop).otherwise(let(with_sign(state["now"], keys), taken))
        return F.when(state["done"], state).otherwise(let(pure(state["now"]), go_on))

    nothing = F.array().cast("array<struct<k:bigint,n:bigint>>")
    start = F.struct(cells.alias("now"), nothing.alias("found"), F.lit(False).alias("done"))
    empty = lambda now: ~F.exists(now, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(empty(s["now"]), s["found"]))


def digest(k: Column, n: Column) -> Column:
    return F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"))


def section(size: Column, cells: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), cells.alias("cells"))


def sketched(keys: Column) -> Column:
    """A section: the smallest sketch that can be peeled by itself. Size 0: one cell for each digest."""
    # Where each digest has a cell for itself, the first round takes all.
    peels = lambda c, s: F.when(F.size(pure(c)) == F.size(keys), F.lit(True)).otherwise(peeled(c, s).isNotNull())
    fits = lambda s: let(sketch(keys, s), lambda c: F.when(peels(c, s), section(s, c)))
    sizes = F.array(*[F.lit(CELLS * 4**i) for i in range(RETRIES + 1)])
    none = F.lit(None).cast("struct<size:int,cells:array<struct<n:bigint,k:bigint,c:bigint>>>")
    tried = F.aggregate(sizes, none, lambda done, s: F.when(done.isNull(), fits(s)).otherwise(done))
    each = F.transform(F.sort_array(keys), lambda k: cell(F.lit(1), k, F.xxhash64(k, F.lit(CHECK))))
    return F.coalesce(tried, section(F.lit(0), each))


def sections(keys: Column) -> Column:
    """The fingerprint of distinct digests: an array of sections. Digests are sorted by section once and cut there."""
    wanted = F.size(keys) / SECTION
    many = F.when(wanted <= 1, F.lit(1)).otherwise(F.pow(F.lit(2), F.ceil(F.log2(wanted)))).cast("int")

    def cut(n: Column) -> Column:
        place = lambda k: F.floor(F.pmod(F.xxhash64(k, F.lit(CHECK + 1)), F.lit(RANGE)) * n / RANGE).cast("int")
        entry = lambda g, k: F.struct(g.alias("g"), k.alias("k"))
        # An entry without digest opens each section, also an empty one; nulls sort first.
        opened = F.transform(F.sequence(F.lit(0), n - 1), lambda g: entry(g, F.lit(None).cast("long")))
        rows = F.sort_array(F.concat(opened, F.transform(keys, lambda k: entry(place(k), k))))

        def sliced(row: Column) -> Column:
            at = F.filter(F.transform(row, lambda x, i: F.when(x["k"].isNull(), i + 1)), lambda i: i.isNotNull())

            def part(ends: Column) -> Column:
                length = lambda i, g: F.get(ends, g + 1) - i - 1
                part_of = lambda i, g: F.transform(F.slice(row, i + 1, length(i, g)), lambda x: x["k"])
                return F.transform(F.slice(ends, F.lit(1), n), part_of)

            return let(F.concat(at, F.array(F.size(row) + 1)), part)

        return let(rows, sliced)

    return let(many, lambda n: F.transform(F.when(n == 1, F.array(keys)).otherwise(cut(n)), sketched))


def listed(members: Column) -> Column:
    """All digests of sections, each peeled by itself."""
    one = lambda m: F.when(m["size"] == 0, F.transform(m["cells"], lambda x: digest(x["k"], x["n"]))).otherwise(peeled(m["cells"], m["size"]))
    return F.transform(F.flatten(F.transform(members, one)), lambda x: x["k"])


def narrowed(m: Column) -> Column:
    """A section's cells, added up to `CELLS` a table (not of a section that lists its digests)."""
    none = cell(F.lit(0), F.lit(0), F.lit(0))
    at = lambda i, j: (F.floor(i / CELLS) * m["size"] + j * CELLS + i % CELLS + 1).cast("int")
    plus = lambda a, x: cell(a["n"] + x["n"], a["k"].bitwiseXOR(x["k"]), a["c"].bitwiseXOR(x["c"]))
    folds = F.sequence(F.lit(0), (m["size"] / CELLS - 1).cast("int"))
    fold = lambda i: F.aggregate(folds, none, lambda a, j: plus(a, F.element_at(m["cells"], at(i, j))))
    folded = F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), fold)
    return F.when(m["size"] == CELLS, m["cells"]).otherwise(folded)


def merged(members: Column) -> Column:
    """One sketch of `CELLS` a table for several sections; null if one of them lists its digests."""
    none = cell(F.lit(0), F.lit(0), F.lit(0))
    start = F.array_repeat(none, TABLES * CELLS)
    return F.aggregate(members, start, lambda a, m: F.when(m["size"] > 0, added(a, narrowed(m))))


def changes(a: Column, b: Column) -> Column:
    """The digests that are in one of two fingerprints only: n is 1 in the first, -1 in the second."""

    def only(x: Column, y: Column, sign: int) -> Column:
        return F.transform(F.array_except(x, y), lambda k: digest(k, F.lit(sign)))

    def compared(pair: Column) -> Column:
        """Of an array of both sides' sections; each step is written once for both sides."""
        small = let(F.transform(pair, merged), lambda m: peeled(subtracted(m[0], m[1]), CELLS))
        full = let(F.transform(pair, listed), lambda k: F.concat(only(k[0], k[1], 1), only(k[1], k[0], -1)))
        return F.coalesce(small, full)

    def each(n: Column) -> Column:
        of = lambda s, g: F.slice(s, (g * F.size(s) / n + 1).cast("int"), (F.size(s) / n).cast("int"))
        one = lambda g: let(F.array(of(a, g), of(b, g)), compared)
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), one))

    return let(F.least(F.size(a), F.size(b)), each)


def held(fingerprint: Column) -> Column:
    """Number of digests: the counts of each section's first table."""
    count = lambda m: total(F.transform(F.when(m["size"] == 0, m["cells"]).otherwise(F.slice(m["cells"], F.lit(1), m["size"])), lambda x: x["n"]))
    return total(F.transform(fingerprint, count))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the digests of two fingerprints."""
    alike = lambda n: F.when(n == 0, F.lit(1.0)).otherwise(let(F.size(changes(a, b)), lambda d: (n - d) / (n + d)))
    return let(held(a) + held(b), alike)


def published(fingerprint: Column) -> Column:
    """The fingerprint as text: sections with their size; count, digests and checks of each cell (0: an empty one)."""
    digits = lambda x: F.lower(F.hex(x))
    full = lambda x: F.concat_ws(".", x["n"].cast("string"), digits(x["k"]), digits(x["c"]))
    line = lambda x: F.when((x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0), F.lit("0")).otherwise(full(x))
    one = lambda m: F.concat(m["size"].cast("string"), F.lit(":"), F.array_join(F.transform(m["cells"], line), ","))
    return F.array_join(F.transform(fingerprint, one), ";")


def parsed(text: Column) -> Column:
    """The fingerprint of a published text."""
    value = lambda x, i: F.conv(F.get(x, F.lit(i)), 16, -10).cast("long")
    read = lambda x: let(F.split(x, r"\."), lambda p: F.when(F.size(p) == 3, cell(p[0], value(p, 1), value(p, 2))).otherwise(cell(F.lit(0), F.lit(0), F.lit(0))))
    one = lambda x: section(F.substring_index(x, ":", 1), F.transform(F.split(F.substring_index(x, ":", -1), ","), read))
    return F.transform(F.split(text, ";"), one)


def successors(ids: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows of `order`, each with the columns of the next one (named next_...)."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ids.select(*order).distinct().repartitionByRange(n, *order)
    stored = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    row = F.struct(*order)
    firsts = stored.groupBy("part").agg(F.min(row).alias("first"))
    parts = firsts.select("part", F.coalesce(  # one row per range
        F.lead("first").over(Window.orderBy("part")), F.first("first").over(Window.orderBy("part"))
    ).alias("after"))
    following = F.lead(row).over(Window.partitionBy("part").orderBy(*order))
    linked = stored.withColumn("next", following).join(parts, "part")
    chosen = F.when(F.col("next").isNotNull(), F.col("next")).otherwise(F.col("after"))
    return linked.select(*order, *[chosen[c].alias(f"next_{c}") for c in order])


def matched(left: DataFrame, right: DataFrame, names: dict[str, str], how: str = "inner") -> DataFrame:
    """Null-safe join; the right side's key columns go."""
    on = None
    for a, b in names.items():
        same = F.col(a).eqNullSafe(F.col(b))
        on = same if on is None else on & same
    return left.join(right, on, how).drop(*names.values())


def versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, edited (the last half replaced by the first half as long of the next text) and the next text's
    digests."""
    body = whole(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))
    sized = rows.select("doc_id", "h", F.floor(F.length("text") / 2).alias("half"))
    ring = cut_lineage(successors(sized, ["doc_id", "h", "half"]))
    before = ring.select(F.col("next_doc_id").alias("at_id"), F.col("next_h").alias("at_h"), F.col("doc_id").alias("to_id"),
                         F.col("h").alias("to_h"), "half")
    lent = matched(rows, before, {"doc_id": "at_id", "h": "at_h"}).select(
        "to_id", "to_h", F.substring(F.col("text"), F.lit(1), F.col("half").cast("int")).alias("lent"),
        digests(F.col("text")).alias("next_digests"),
    )
    lent = lent.groupBy("to_id", "to_h").agg(F.first("lent").alias("lent"), F.first("next_digests").alias("next_digests"))
    own = F.substring(F.col("text"), F.lit(1), (F.length("text") - F.floor(F.length("text") / 2)).cast("int"))
    return matched(rows, lent, {"doc_id": "to_id", "h": "to_h"}).select(
        "doc_id", "text", F.concat(own, F.col("lent")).alias("edited"), "next_digests"
    )


def fingerprinted(pairs: DataFrame) -> DataFrame:
    """Of the rows of `versions`: fingerprints of both texts as text, and likenesses to the edited and the next one's."""
    texts = F.array(digests(F.col("text")), digests(F.col("edited")), F.col("next_digests"))
    cut = pairs.select("doc_id", "text", "edited", F.transform(texts, sections).alias("prints"))
    own, others = F.col("prints")[0], F.slice("prints", 2, 2)
    near = cut.select(
        "doc_id", "text", "edited", published(own).alias("fingerprint"), published(F.col("prints")[1]).alias("edited_fingerprint"),
        F.transform(others, lambda x: likeness(own, x)).alias("near"),
    )
    return near.select(*[c for c in near.columns if c != "near"], F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))
