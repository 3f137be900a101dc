"""Exact Jaccard self-join of documents' word shingles, with skipping by set relations.

1. `heads`: one row per document: size and digest of its shingle set, eight minimum hashes and a small bitmap of the
   set. The same pass counts hash buckets of all shingles (a fixed number), which gives a rough global frequency
   order. Documents with equal sets are represented by the smallest id from here on.
2. Families: a representative joins the smallest representative that shares one of its minimum hashes and whose
   bitmap says they are similar. Inside a family all overlaps are derived from the differences to one member: with y
   and z written as "member without r, with a", |y & z| = |member| - |ry| - |rz| + |ry & rz| + |ay & az|. Only the
   differences enter the products, and a family gives a link per member, not per pair. Large families are dealt into
   blocks, and pairs of blocks are tasks.
3. Index: of every representative the tokens of its prefix (rarest first) that any set at the threshold must share
   one of. A token's list is sorted and cut into blocks; a pair of blocks is skipped if their largest remainders
   after the token's position cannot reach the overlap, their sizes are too far apart, or both lie in one family or
   one component, where the answers are known. Long lists are dealt into cells of blocks as well.
4. Candidates that are left pass an upper bound from their bitmaps and are then compared exactly.

Skipping never loses a link: frequency order, families and bitmaps only decide what work is done. Sets are compared by
64-bit hashes of shingles. Broadcast: bucket levels and id slots, of fixed size.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer words than a shingle make one
shingle of all words; equal texts are linked; rows that repeat an id are copies of one document each with its own
row; a row without id is linked with nothing and has no component; other columns are ignored; no rows, no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autostat.llm.graph import components
from autostat.llm.text import whole
from autostat.llm.tokens import followed, mixed, pieces, word_hashes
from autostat.sources.checkpoints import cut_lineage

WIDTH = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
MIN_HASHES = 8
#: Least estimated similarity inside a family. It decides where a pair is compared, not whether.
FAMILY = 0.3
BUCKETS, CHUNK = 1 << 20, 1 << 12
#: Slots of ids (a bitmap of 2 MB) that let a pass over all texts build sets of wanted documents only.
SLOTS = 1 << 24
#: Sets in a block of a family, and shingles in it; entries in a cell of a token's list, and in a block of it.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
CELL, BLOCK = 1 << 14, 32
COLUMNS = 4096


def least_overlap(x, y, percent: int = PERCENT):
    """Smallest intersection at which sets of these sizes are linked."""
    return -(-percent * (x + y) // (100 + percent))


def linked(both, x, y, percent: int = PERCENT):
    return 100 * both >= percent * (x + y - both)


def prefix_size(n, percent: int = PERCENT):
    """So many first tokens of a set of n, in a global order, that it shares one of them with each linked set."""
    return n - -(-percent * n // 100) + 1


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    h = mixed(words)
    full = max(len(words) - width + 1, 0)
    rolled = h[:full]
    for k in range(1, width):
        rolled = followed(rolled, words[k : full + k])
    out = []
    for a, n in zip(at[:-1], counts, strict=True):
        if n >= width:
            s = np.sort(rolled[a : a + n - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif n:
            one = h[a : a + 1]
            for k in range(1, n):
                one = followed(one, words[a + k : a + k + 1])
            out.append(one)
        else:
            out.append(h[:0])
    bounds = np.r_[0, np.cumsum([len(s) for s in out], dtype=np.int64)]
    return np.concatenate(out) if out else h[:0], bounds


def bitmap(s: np.ndarray) -> bytes:
    """Which remainders of the hashes occur, modulo a power of two of at least twice the set's size."""
    flags = np.zeros(max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64, bool)
    flags[(s & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def difference_bits(x: bytes, y: bytes) -> tuple[int, int]:
    """Bits in which two bitmaps differ, the longer folded to the shorter, and their length."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum()), 8 * size


HEADS = "doc_id {}, n long, d1 long, d2 long, mins array<long>, bits binary, chunk int, counts binary"


def heads(work: DataFrame, width: int) -> DataFrame:
    """A row per document, and the counts of hash buckets in chunks (rows with a chunk)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "d1", "d2", "mins", "bits", "chunk", "counts"]
        buckets, id_type = np.zeros(BUCKETS, np.int64), None
        for batch in pieces(batches, "text"):
            sets, at = shingle_sets(batch.column("text"), width)
            n, id_type = np.diff(at), batch.column("doc_id").type
            buckets += np.bincount((sets >> np.uint64(44)).astype(np.int64), minlength=BUCKETS)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64).reshape(-1, 2)
            mins = np.zeros((len(n), MIN_HASHES), np.uint64)
            if len(sets):
                for k in range(MIN_HASHES):
                    h = mixed(sets + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
                    mins[n > 0, k] = np.minimum.reduceat(h, at[:-1][n > 0])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, mins.size + 1, MIN_HASHES, dtype=np.int32)), pa.array(mins.ravel().view(np.int64)))
            bits = [bitmap(sets[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists, pa.array(bits, pa.binary()), *none], names)
        if id_type is not None:
            parts = buckets.reshape(-1, CHUNK)
            used = np.flatnonzero(parts.any(axis=1))
            packed = [zlib.compress(parts[i].astype(np.int64).tobytes(), 1) for i in used]
            none = [pa.nulls(len(used), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(used.astype(np.int32)), pa.array(packed, pa.binary())], names)

    return work.mapInArrow(rows, HEADS.format(work.schema["doc_id"].dataType.simpleString()))


def bucket_levels(counted: DataFrame) -> np.ndarray:
    """Of each bucket a quarter of a doubling per level; a byte for each of a fixed number of buckets."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch["chunk"], batch["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        level = lambda x: np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes()
        yield pd.DataFrame({"chunk": list(sums), "levels": [level(x) for x in sums.values()]})

    out = np.zeros(BUCKETS, np.uint8)
    for r in counted.repartition(16, "chunk").mapInPandas(rows, "chunk int, levels binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return out


def slot(column: str = "doc_id"):
    return F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")


def wanted_sets(work: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, set) of the documents in `ids` (one column doc_id), and of a few more that share their slots."""
    spots = ids.select(slot().alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("at"))
    marked = spots.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot") % 64)).alias("bits"))
    flags = np.zeros(SLOTS // 64, np.int64)
    found = marked.toPandas()  # at most SLOTS / 64 rows
    flags[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    shared = work.sparkSession.sparkContext.broadcast(flags.view(np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            at = batch.column("slot").to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            if hit.any():
                some = batch.filter(pa.array(hit))
                sets, ends = shingle_sets(some.column("text"), width)
                blobs = [sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(blobs, pa.binary())], ["doc_id", "set"])

    kind = work.schema["doc_id"].dataType.simpleString()
    return work.withColumn("slot", slot()).mapInArrow(rows, f"doc_id {kind}, set binary").dropDuplicates(["doc_id"])


def families(reps: DataFrame) -> DataFrame:
    """(doc_id, family) of representatives that share a minimum hash with a similar one; the family's first member
    included."""
    mins = reps.select("doc_id", F.posexplode("mins").alias("k", "v"))
    first = mins.groupBy("k", "v").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("c")).where("c > 1")
    pairs = mins.join(first, ["k", "v"]).where("doc_id <> pivot").select("doc_id", "pivot").distinct()
    pivots = reps.select(F.col("doc_id").alias("pivot"), F.col("n").alias("pn"), F.col("bits").alias("pbits"))
    sized = pairs.join(reps.select("doc_id", "n", "bits"), "doc_id").join(pivots, "pivot")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = []
            for n, bits, pn, pbits in zip(b["n"], b["bits"], b["pn"], b["pbits"], strict=True):
                differ, size = difference_bits(bits, pbits)
                gap = -size / 2 * np.log1p(-2 * differ / size) if 2 * differ < size else n + pn
                near.append((n + pn - gap) >= FAMILY * (n + pn + gap))
            yield b.loc[near, ["doc_id", "pivot"]]

    kind = reps.schema["doc_id"].dataType.simpleString()
    near = sized.mapInPandas(rows, f"doc_id {kind}, pivot {kind}").groupBy("doc_id").agg(F.min("pivot").alias("family"))
    for _ in range(2):
        near = cut_lineage(near)
        up = near.select(F.col("doc_id").alias("family"), F.col("family").alias("higher"))
        near = near.join(up, "family", "left").select("doc_id", F.coalesce("higher", "family").alias("family"))
    near = cut_lineage(near)
    return near.union(near.select("family", "family").distinct()).dropDuplicates(["doc_id"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """All intersections' sizes, derived from the differences to the first set."""
    base, n = sets[0], np.array([len(s) for s in sets])
    removed = [np.flatnonzero(~np.isin(base, s, assume_unique=True)) for s in sets]
    added = [np.setdiff1d(s, base, assume_unique=True) for s in sets]
    gone = np.array([len(r) for r in removed])
    both = (len(base) - gone[:, None] - gone[None, :]).astype(np.float64)
    for parts in (removed, added):
        owner = np.repeat(np.arange(len(sets)), [len(p) for p in parts])
        tokens, column, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        np.fill_diagonal(both, np.diag(both) + np.bincount(owner[count[column] == 1], minlength=len(sets)))
        place = np.cumsum(count > 1) - 1
        shared = count[column] > 1
        owner, column = owner[shared], place[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for start in range(0, int((count > 1).sum()), COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            grid = np.zeros((len(sets), COLUMNS), np.float32)
            grid[owner[a:b], column[a:b] - start] = 1
            both += grid @ grid.T
    assert (np.diag(both) == n).all()
    return both


def roots(link: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each, of a symmetric boolean matrix."""
    at = np.arange(len(link))
    while True:
        low = np.minimum(at, np.where(link, at[None, :], len(at)).min(axis=1))
        low = low[low]
        if (low == at).all():
            return at
        at = low


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a link for each member that has one, inside families."""
    sizes = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("s") / BLOCK_SHINGLES))
    dealt = members.join(sizes, "family").withColumn("blocks", blocks.cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("doc_id", "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = members.schema["doc_id"].dataType.simpleString()

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        each = [np.frombuffer(x, np.uint64) for x in group["set"]]
        n = np.array([len(s) for s in each], np.float64)
        at = roots(linked(overlaps(each), n[:, None], n[None, :], percent))
        ids = group["doc_id"].to_numpy()
        return pd.DataFrame({"a": ids[at], "b": ids})[at != np.arange(len(at))]

    return cells.join(sets, "doc_id").groupBy("family", "i", "j").applyInPandas(links, f"a {kind}, b {kind}")


def prefixes(work: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, n, tokens, cells): the prefix of each set, and into how many blocks a token's list is dealt."""
    shared = work.sparkSession.sparkContext.broadcast(levels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets, at = shingle_sets(batch.column("text"), width)
            level = shared.value[(sets >> np.uint64(44)).astype(np.int64)]
            chosen = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                order = np.argsort(level[a:b], kind="stable")  # equal levels stay in order of the hash
                chosen.append(a + order[: prefix_size(b - a, percent) if b > a else 0])
            ends = np.r_[0, np.cumsum([len(c) for c in chosen])].astype(np.int32)
            take = np.concatenate(chosen) if chosen else np.empty(0, np.int64)
            dealt = np.ceil(2.0 ** ((level[take] + 1) / 4) / CELL).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (sets[take].view(np.int64), dealt)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), *lists], ["doc_id", "n", "tokens", "cells"])

    kind = work.schema["doc_id"].dataType.simpleString()
    return work.mapInArrow(rows, f"doc_id {kind}, n long, tokens array<long>, cells array<int>")


def list_pairs(key: np.ndarray, n: np.ndarray, left: np.ndarray, family: np.ndarray, comp: np.ndarray, percent: int):
    """Positions (x, y) of pairs in one list that may be linked and are not yet known to be or not to be.
    `key` numbers the lists; `left` is the number of tokens from the entry's own on."""

    def open_(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        need = least_overlap(n[x], n[y], percent)
        return (np.minimum(left[x], left[y]) >= need) & (family[x] != family[y]) & (comp[x] != comp[y])

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    end = np.repeat(starts + sizes, sizes)
    short = np.repeat(sizes <= BLOCK, sizes)
    at = np.flatnonzero(short & (np.arange(len(key)) + 1 < end))
    shift = 1
    while len(at):
        ok = open_(at, at + shift)
        yield at[ok], at[ok] + shift
        shift += 1
        at = at[at + shift < end[at]]
    for a, size in zip(starts[sizes > BLOCK], sizes[sizes > BLOCK], strict=True):
        cut = np.arange(a, a + size, BLOCK)
        least, most, rest = (f.reduceat(v[a : a + size], cut - a) for f, v in ((np.minimum, n), (np.maximum, n), (np.maximum, left)))
        one = lambda v: np.where(np.minimum.reduceat(v[a : a + size], cut - a) == np.maximum.reduceat(v[a : a + size], cut - a), v[cut], -1)  # noqa: B023, E731
        same = [one(family), one(comp)]
        for i in range(len(cut)):
            js = np.arange(i, len(cut))
            small, large = np.minimum(most[i], most[js]), np.maximum(least[i], least[js])
            skip = 100 * small < percent * large
            skip |= np.minimum(rest[i], rest[js]) < least_overlap(least[i], least[js], percent)
            for s in same:
                skip |= (s[js] == s[i]) & (s[i] >= 0)
            for j in js[~skip]:
                x, y = np.meshgrid(np.arange(cut[i], min(cut[i] + BLOCK, a + size)), np.arange(cut[j], min(cut[j] + BLOCK, a + size)), indexing="ij")
                x, y = x[x < y], y[x < y]
                ok = open_(x, y)
                yield x[ok], y[ok]


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, from the sorted lists of all tokens."""

    def found(t: pd.DataFrame) -> pd.DataFrame:
        key = (t["token"].to_numpy(), t["cell"].to_numpy())
        changed = np.r_[False, (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])]
        ids, n = t["doc_id"].to_numpy(), t["n"].to_numpy()
        family = t["family"].to_numpy()
        pairs = list(list_pairs(np.cumsum(changed), n, t["rest"].to_numpy(), family, t["comp"].to_numpy(), percent))
        x, y = (ids[np.concatenate([p[k] for p in pairs])] if pairs else ids[:0] for k in (0, 1))
        both = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
        return both[both["a"] < both["b"]].drop_duplicates()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            token, cell = batch["token"].iloc[-1], batch["cell"].iloc[-1]
            whole_lists = ~((batch["token"] == token) & (batch["cell"] == cell)).to_numpy()
            if whole_lists.any():
                yield found(pd.concat([*held, batch[whole_lists]], ignore_index=True))
                held = []
            held.append(batch[~whole_lists])
        if held:
            yield found(pd.concat(held, ignore_index=True))

    kind = entries.schema["doc_id"].dataType.simpleString()
    at = F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    dealt = entries.withColumn("block", at).withColumn("other", other)
    cell = F.least("block", "other") * F.col("cells") + F.greatest("block", "other")
    alone = F.when(F.col("comp") == F.col("doc_id"), F.lit(-1)).otherwise(F.col("comp"))
    keyed = dealt.select("token", cell.alias("cell"), "doc_id", "n", "rest", "family", "comp")
    ordered = keyed.repartition("token", "cell").sortWithinPartitions("token", "cell", alone, "n", "rest")
    return ordered.mapInPandas(rows, f"a {kind}, b {kind}").distinct()


def verified(work: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that are linked."""
    side = lambda c, names: reps.select(F.col("doc_id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in names])
    kind = reps.schema["doc_id"].dataType.simpleString()

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            may = []
            for x, y, p, q in zip(b["a_n"], b["b_n"], b["a_bits"], b["b_bits"], strict=True):
                may.append(linked((x + y - difference_bits(p, q)[0]) // 2, x, y, percent))
            yield b.loc[may, ["a", "b"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yes = []
            for p, q in zip(b["p"], b["q"], strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                yes.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield b.loc[yes, ["a", "b"]]

    named = pairs.join(side("a", ["n", "bits"]), "a").join(side("b", ["n", "bits"]), "b")
    likely = cut_lineage(named.mapInPandas(bounded, f"a {kind}, b {kind}"))
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    sets = cut_lineage(wanted_sets(work, ids, width).join(ids, "doc_id", "left_semi"))
    p, q = (sets.select(F.col("doc_id").alias(c), F.col("set").alias(s)) for c, s in (("a", "p"), ("b", "q")))
    return likely.join(p, "a").join(q, "b").mapInPandas(exact, f"a {kind}, b {kind}")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
           percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    work = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    head = cut_lineage(heads(work, width))
    rows, linkable = head.where("chunk is null"), F.col("doc_id").isNotNull() & (F.col("n") > 0)
    levels = bucket_levels(head.where("chunk is not null").select("chunk", "counts"))
    one = F.min(F.struct("doc_id", "n", "mins", "bits")).alias("r")
    reps = cut_lineage(rows.where(linkable).groupBy("d1", "d2").agg(one).select("d1", "d2", "r.*"))
    known = work.where(F.col("doc_id").isNotNull())

    family = cut_lineage(families(reps.select("doc_id", "n", "mins", "bits")))
    members = family.join(reps.select("doc_id", "n"), "doc_id")
    within = cut_lineage(family_links(members, wanted_sets(known, family.select("doc_id"), width), percent))
    comp = components(within)

    placed = reps.select("doc_id").join(family, "doc_id", "left").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    placed = placed.select("doc_id", F.coalesce("family", "doc_id").alias("family"), F.coalesce("component", "doc_id").alias("comp"))
    lists = prefixes(known, levels, width, percent).join(placed, "doc_id")
    entries = lists.select("doc_id", "n", "family", "comp", F.posexplode(F.arrays_zip("tokens", "cells")).alias("at", "e"))
    entries = entries.select("doc_id", F.col("n").cast("int").alias("n"), "family", "comp", F.col("e.tokens").alias("token"),
                             F.col("e.cells").alias("cells"), (F.col("n") - F.col("at")).cast("int").alias("rest"))
    across = cut_lineage(candidates(entries, percent))
    links = within.union(verified(known, across, reps, width, percent))
    final = components(links)

    named = reps.select("d1", "d2", F.col("doc_id").alias("rep")).join(final.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("d1", "d2", F.coalesce("component", "rep").alias("found"))
    out = rows.select("doc_id", "n", "d1", "d2", linkable.alias("ok")).join(named, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("ok"), F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its component, one row per id; rows without id stay."""
    found = joined(docs, doc_id, text, width, percent).where("doc_id = component_id")
    first = cut_lineage(found.select(F.col("doc_id").alias("_kept")).distinct())
    named = docs.where(F.col(doc_id).isNotNull())
    chosen = named.join(first, named[doc_id] == first["_kept"], "left_semi").dropDuplicates([doc_id])
    return chosen.unionByName(docs.where(F.col(doc_id).isNull()))
