"""Prefix trie of conversations by vertical bitmaps.

Conversations are cut into shards: blocks of up to `BLOCK` neighbouring ids, times chunks of `CHUNK` depths, so neither
a popular beginning nor a very long conversation makes a large shard. In a shard, every (position, turn) is indexed to
the bitset of the conversations that have this turn there. The shard's part of the trie is found depth first: from a
node's bitset the lowest conversation is taken, the AND with the posting of its next turn is a child, and what is left
goes on until the bitset is empty; the popcount is the node's number of members, the bits that stop are its end list.

A node is known everywhere by its depth and 128 bits of rolling hash (exclusive or of hashes of position and turn), so
a chunk's first hashes are known before the chunks above it are walked. Nodes of all shards are merged by that key:
members are added up, the smallest conversation is the node's name, and children are counted. Sums over subtrees need
no walk from level to level: a node's value is booked in the one shard that holds its smallest member, every shard sums
up its own part of each subtree, and these sums are added. Conversations that go on in another chunk carry the sum of
their later chunks to the node where they leave.

Turns are numbered by a range-partitioned sort, whose partitions may cut a conversation. Only hashes and word counts
are shuffled, never texts. End lists are hashed in a stream, block after block.

`rebuilt` makes conversations that share beginnings: the first h turns of conversation c - c % FAMILY, then c's own
turns after its first h; h is crc32 of the decimal id, modulo HEADS.

Defined results: turns are ordered by turn (null first) and, where these tie, by a hash of role and text; a turn logged
twice counts twice; null and empty roles and texts are the same; a row without conversation id belongs to no
conversation and is left out; % keeps the sign of the id; other columns are ignored; no conversations, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autostat.llm.text import whole, words
from autostat.sources.checkpoints import cut_lineage

BLOCK, CHUNK = 4096, 256
FAMILY, HEADS = 20, 4


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (part, conv, position of the first of n equal turns in the part, n, t1, t2, words), and the parts of
    conversations (part, conv, start, n_turns, block): `start` turns come in earlier parts."""
    spoken, said = whole(role), whole(text)
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        *[F.xxhash64(F.lit(s), spoken, said).alias(f"t{s}") for s in (1, 2)], F.size(words(said)).cast("long").alias("words"),
    )
    rows = rows.groupBy("conv", "turn", "t1", "t2").agg(F.max("words").alias("words"), F.count("*").alias("n"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("part", F.shiftright(place, 33)).withColumn("at", place.bitwiseAND(2**33 - 1)))
    inside = Window.partitionBy("part", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    of_conv = Window.partitionBy("conv")
    parts = dealt.groupBy("part", "conv").agg(F.sum("n").alias("own")).select(
        "part", "conv", F.sum("own").over(of_conv).alias("n_turns"), F.min("part").over(of_conv).alias("home"),
        F.coalesce(F.sum("own").over(of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    index = F.row_number().over(Window.partitionBy("home").orderBy("conv")) - 1
    block = F.shiftleft("home", 32) + F.floor(index / BLOCK)
    blocks = parts.where("part = home").select("conv", block.alias("block"))
    return rows, parts.join(blocks, "conv").select("part", "conv", "start", "n_turns", "block")


def rebuilt(rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (block, conv, n) and their turns (block, conv, n, depth, t1, t2, words) after rebuilding."""
    wanted = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    convs = parts.where("start = 0").select("conv", "block", "n_turns", wanted.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("head"))
    heads = convs.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("head"), F.col("n_turns").alias("n_head"))
    taken = F.least("h", F.coalesce("n_head", F.lit(0)))
    convs = convs.join(heads, "head", "left").withColumn("taken", taken)
    convs = cut_lineage(convs.withColumn("n", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))))
    where = parts.join(convs.select("conv", "h", "taken", "n"), "conv").select("part", "conv", "start", "block", "h", "taken", "n")
    first = F.col("start") + F.col("before") + 1
    spread = rows.select("part", "conv", "before", F.col("n").alias("times"), "t1", "t2", "words").join(where, ["part", "conv"])
    spread = spread.withColumn("position", F.explode(F.sequence(first, first + F.col("times") - 1)))
    own = spread.where("position > h").withColumn("depth", F.col("position") - F.col("h") + F.col("taken"))
    lent = spread.where((F.col("conv") % FAMILY == 0) & (F.col("position") < HEADS))
    lent = lent.select(F.col("conv").alias("head"), F.col("position").alias("depth"), "t1", "t2", "words")
    lent = lent.join(convs.select("head", "block", "conv", "n", "taken"), "head").where("depth <= taken")
    columns = ["block", "conv", "n", "depth", "t1", "t2", "words"]
    return convs.select("block", "conv", "n"), own.select(columns).unionByName(lent.select(columns))


def as_logged(rows: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same two tables of the conversations as they were logged."""
    first = F.col("start") + F.col("before") + 1
    spread = rows.select("part", "conv", "before", F.col("n").alias("times"), "t1", "t2", "words").join(parts, ["part", "conv"])
    turns = spread.withColumn("depth", F.explode(F.sequence(first, first + F.col("times") - 1)))
    turns = turns.select("block", "conv", F.col("n_turns").alias("n"), "depth", "t1", "t2", "words")
    return parts.where("start = 0").select("block", "conv", F.col("n_turns").alias("n")), turns


def sharded(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(block, chunk, conv, n, depth, g1, g2, words): the hashed turns, and before each conversation's first turn of a
    chunk a row of the depth above, with the rolling hash up to there."""
    hashes = [F.xxhash64(F.lit(s), "depth", "t1", "t2").alias(f"g{s}") for s in (1, 2)]
    chunk = F.floor((F.col("depth") - 1) / CHUNK)
    turns = cut_lineage(turns.select("block", chunk.alias("chunk"), "conv", "n", "depth", *hashes, "words"))
    long = turns.where(F.col("n") > CHUNK).groupBy("block", "chunk", "conv", "n").agg(*[F.bit_xor(g).alias(g) for g in ("g1", "g2")])
    above = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = long.select("block", "chunk", "conv", "n", (F.col("chunk") * CHUNK).alias("depth"),
                        *[F.bit_xor(g).over(above).alias(g) for g in ("g1", "g2")], F.lit(0).cast("long").alias("words"))
    zero = F.lit(0).cast("long")
    tops = convs.select("block", zero.alias("chunk"), "conv", "n", zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), zero.alias("words"))
    return turns.unionByName(tops).unionByName(later.where("chunk > 0"))


LOCAL = ("block long, chunk long, idx int, parent int, depth long, h1 long, h2 long, p1 long, p2 long, conv long, members long, "
         "words long, ends binary, goes_on array<bigint>")  # fmt: skip


def local_tree(shard: pa.Table) -> pa.Table:
    """The nodes of one shard, parents first, each with its members in this shard."""
    shard = shard.sort_by([("conv", "ascending"), ("depth", "ascending")])
    conv, depth, n, g1, g2 = (shard[c].to_numpy() for c in ("conv", "depth", "n", "g1", "g2"))
    base = int(depth.min())
    tops = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    sizes = np.diff(np.r_[tops, len(conv)])
    who = np.repeat(np.arange(len(tops)), sizes)
    rolled = []
    for g in (g1, g2):
        run = np.bitwise_xor.accumulate(g)
        rolled.append(run ^ np.repeat(run[tops] ^ g[tops], sizes))
    # Postings: the rows of one (position, turn), and their conversations as a bitset where there are several.
    turns = np.setdiff1d(np.arange(len(conv)), tops)
    order = turns[np.lexsort((g2[turns], g1[turns], depth[turns]))]
    new = np.any([x[order][1:] != x[order][:-1] for x in (depth, g1, g2)], axis=0)
    cuts = np.r_[0, np.flatnonzero(new) + 1, len(order)] if len(order) else np.zeros(1, np.int64)
    posting = np.empty(len(conv), np.int64)
    posting[order] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    shared = {}
    for p in np.flatnonzero(np.diff(cuts) > 1).tolist():
        shared[p] = sum(1 << i for i in who[order[cuts[p] : cuts[p + 1]]].tolist())
    posting, top, last = posting.tolist(), tops.tolist(), (base + sizes - 1).tolist()
    stops: dict[int, int] = {}
    for i, d in enumerate(last):
        stops[d] = stops.get(d, 0) | 1 << i
    row, parent, members, ends, goes_on = [], [], [], {}, {}

    def leave(node: int, bits: int) -> None:
        """Conversations whose last turn here is the node's: they end there, or go on in the next chunk."""
        here = []
        while bits:
            low = bits & -bits
            here.append(low.bit_length() - 1)
            bits ^= low
        at = np.array(here)
        over = n[tops[at]] == depth[row[node]]
        if over.any():
            ends[node] = conv[tops[at[over]]].astype(np.int64).tobytes()
        if not over.all():
            goes_on[node] = conv[tops[at[~over]]].tolist()

    starts = np.unique(np.stack([rolled[0][tops], rolled[1][tops]]), axis=1, return_inverse=True)[1].ravel()
    stack = []
    for s in range(int(starts.max()) + 1):
        bits = sum(1 << i for i in np.flatnonzero(starts == s).tolist())
        stack.append((-1, base, bits, None))
    while stack:
        above, d, bits, r = stack.pop()
        if bits & (bits - 1) == 0 and r is not None:  # one conversation: the rest of its turns is a chain
            i, k = bits.bit_length() - 1, len(row)
            chain = range(r, top[i] + last[i] - base + 1)
            row.extend(chain)
            parent.append(above)
            parent.extend(range(k, k + len(chain) - 1))
            members.extend([1] * len(chain))
            leave(len(row) - 1, bits)
            continue
        node = above
        if r is None and base == 0:
            r = top[(bits & -bits).bit_length() - 1]
        if r is not None:
            node = len(row)
            row.append(r)
            parent.append(above)
            members.append(bits.bit_count())
            stop = bits & stops.get(d, 0)
            if stop:
                leave(node, stop)
            bits ^= stop
        while bits:
            low = bits & -bits
            at = top[low.bit_length() - 1] + d + 1 - base
            child = bits & shared.get(posting[at], low)
            bits ^= child
            stack.append((node, d + 1, child, at))
    row = np.array(row, np.int64)
    above = np.maximum(row - 1, 0)
    size = len(row)
    columns = [
        pa.repeat(shard["block"][0], size), pa.repeat(shard["chunk"][0], size), np.arange(size, dtype=np.int32), np.array(parent, np.int32),
        depth[row], rolled[0][row], rolled[1][row], rolled[0][above], rolled[1][above], conv[row], np.array(members, np.int64),
        shard["words"].to_numpy()[row], pa.array([ends.get(k) for k in range(size)], pa.binary()),
        pa.array([goes_on.get(k) for k in range(size)], pa.list_(pa.int64())),
    ]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in LOCAL.split(", ")])


KEY = ["depth", "h1", "h2"]
SUMMED = "depth long, h1 long, h2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def subtree_sums(shard: pa.Table) -> pa.Table:
    """Of each node of one shard, the part of its subtree's sums that is booked here."""
    kind = shard["kind"].to_numpy()
    nodes = shard.filter(pa.array(kind == 0)).sort_by("idx")
    added, linked = (shard.filter(pa.array(kind == k)) for k in (1, 2))
    parent, depth, conv, name = (nodes[c].to_numpy() for c in ("parent", "depth", "conv", "conv_id"))
    sums = [nodes[c].to_numpy().copy() for c in ("leaf", "saved")]
    for total, c in zip(sums, ("leaf", "saved"), strict=True):
        np.add.at(total, added["idx"].to_numpy(), added[c].to_numpy())
        for d in np.unique(depth)[::-1]:
            at = np.flatnonzero((depth == d) & (parent >= 0))
            np.add.at(total, parent[at], total[at])
    above = dict(zip(linked["conv"].to_pylist(), linked["conv_id"].to_pylist(), strict=True))
    of_top = [above.get(c) for c in conv[parent < 0].tolist()]
    parents = pa.array(name[np.maximum(parent, 0)])
    if len(of_top):
        parents = pc.replace_with_mask(parents, pa.array(parent < 0), pa.array(of_top, pa.int64()))
    keys = [nodes[c].combine_chunks() for c in KEY]
    values = [nodes["conv_id"].combine_chunks(), parents, *[nodes[c].combine_chunks() for c in ("n_convs", "n_children")], *map(pa.array, sums)]
    return pa.Table.from_arrays([*keys, *values], [c.split()[0] for c in SUMMED.split(", ")])


def end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end list, from its lists in order of blocks."""
    key, digest, done = None, None, []

    def out() -> pa.RecordBatch:
        rows = [(*k, d.hexdigest()) for k, d in done]
        done.clear()
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*KEY, "ends_sha256"])

    for batch in batches:
        for *of, ends in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ends")], strict=True):
            text = ",".join(map(str, np.frombuffer(ends, np.int64).tolist())).encode()
            if of == key:
                digest.update(b"," + text)
            else:
                key, digest = of, hashlib.sha256(text)
                done.append((key, digest))
        if len(done) > 1:
            kept = done.pop()
            yield out()
            done.append(kept)
    if done:
        yield out()


def merged(shards: DataFrame) -> DataFrame:
    """The nodes of the whole trie from the rows of all shards."""
    local = cut_lineage(shards.groupBy("block", "chunk").applyInArrow(local_tree, LOCAL))
    nodes = local.groupBy(KEY).agg(
        F.min("conv").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    nodes = nodes.join(children.agg(F.count("*").alias("n_children")), KEY, "left").fillna(0, ["n_children"])
    known = local.drop("ends", "p1", "p2", "members").join(nodes.drop("p1", "p2"), KEY)
    booked = lambda value: F.when(F.col("conv") == F.col("conv_id"), value).otherwise(F.lit(0)).cast("long")
    known = cut_lineage(known.withColumns({
        "kind": F.lit(0), "leaf": booked((F.col("n_children") == 0).cast("long")),
        "saved": booked((F.col("n_convs") - 1) * F.col("words")),
    }))
    # Conversations that leave a chunk: what is booked on them in later chunks, and the node they come from.
    leaving = known.where("goes_on is not null").select("block", "chunk", "idx", F.explode("goes_on").alias("conv"), "conv_id")
    later = known.where((F.col("chunk") > 0) & (F.col("conv") == F.col("conv_id"))).groupBy("conv", "chunk")
    later = later.agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    after = Window.partitionBy("conv").orderBy(F.col("chunk").desc()).rangeBetween(Window.unboundedPreceding, -1)
    events = leaving.drop("conv_id").unionByName(later, allowMissingColumns=True)
    carried = events.select("block", "chunk", "idx", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in ("leaf", "saved")])
    carried = carried.where("idx is not null").withColumn("kind", F.lit(1))
    linked = leaving.select("block", (F.col("chunk") + 1).alias("chunk"), "conv", "conv_id", F.lit(2).alias("kind"))
    rows = known.drop("goes_on", "words").unionByName(carried, allowMissingColumns=True).unionByName(linked, allowMissingColumns=True)
    sums = rows.groupBy("block", "chunk").applyInArrow(subtree_sums, SUMMED)
    least, most = [[f(c).alias(c) for c in cs] for f, cs in ((F.min, ["conv_id", "parent_conv_id"]), (F.max, ["n_convs", "n_children"]))]
    whole_nodes = sums.groupBy(KEY).agg(*least, *most, *[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    ends = local.where("ends is not null").select(*KEY, "block", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "block")
    hashes = ends.drop("block").mapInArrow(end_hashes, "depth long, h1 long, h2 long, ends_sha256 string")
    return whole_nodes.join(hashes, KEY, "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def prefix_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rebuild: bool = True) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of
    every node of the trie of all conversations, as logged or rebuilt."""
    table = numbered(turns, conv_id, turn, role, text)
    return merged(sharded(*(rebuilt(*table) if rebuild else as_logged(*table))))
