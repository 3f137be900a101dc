"""Language-model scoring with a log-frequency Bloom filter.

The filter holds quantised n-gram counts: an n-gram of level q (its count on a logarithmic scale) is entered as the
pairs (n-gram, 1) .. (n-gram, q), and its level is read back by probing 1, 2, ... until a probe fails. Levels never
come out too low, and too high only by a false positive or where two pairs of a shard share a 32-bit hash.

Training. All words and all pairs of neighbours are counted and kept, at every size. They are dealt by hash to shards,
one for `CAPACITY` bytes of training text (up to `LARGEST`, where there would be more than `SHARDS`); a piece of text
sends each shard its distinct words and pairs with their counts, as differences in order. A shard keeps its words with
exact counts and enters its pairs in a filter of `BITS` bits an entry. No shard is collected or broadcast: a filter of
all pairs grows with the corpus.

Scoring. P(w | u) = (c(uw) + K P(w)) / (c(u) + K) with P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). Texts are stored in
pieces as hashed words; a piece sends each shard its distinct words and pairs, the shard answers them with its one filter in memory, and
the answers meet the piece again. The base score takes the exact counts of words alone.

Words are known by 64-bit hashes. Defined results: a null or empty text is the end token alone; a null id belongs
to the training part; repeated rows are counted and scored each; other columns are ignored; without training
tokens all counts are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.llm.text import whole
from autostat.llm.tokens import followed, mixed, pieces, word_hashes
from autostat.sources.checkpoints import cut_lineage

#: Bytes of training text for one shard: as many as give this number of shards, between two bounds.
SHARDS, CAPACITY, LARGEST = 1 << 12, 1 << 24, 1 << 27
#: Bits of a filter for each entered (pair, level).
BITS, PROBES = 16, 5
#: Counted keys of a shard that wait to be added up.
WAITING = 1 << 21
#: Counts between two levels differ by this factor.
STEP = 1.3
#: Weight of the word's own probability, in tokens of the context.
PRIOR = 20.0
#: The end of a text, as a token; no word is empty.
END = np.uint64(0x5851F42D4C957F2D)
#: What a key stands for, and the numbers it is sent as.
WORD, PAIR = 0, 1
SENT = (np.uint64, np.uint32)


def held_out(doc_id: str | Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id's text leaves `fold` when divided by `folds`."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(STEP)).astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """The count a level stands for; 0 for level 0."""
    return np.where(level > 0, np.ceil(STEP ** (level - 1.0)), 0.0)


class CountFilter:
    """Log-frequency Bloom filter."""

    def __init__(self, cells: np.ndarray, levels: int, probes: int = PROBES) -> None:
        self.cells, self.levels, self.probes, self.bits = cells, levels, probes, 8 * len(cells)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> CountFilter:
        """Keys of these counts, in as many bits as they need."""
        level = levels_of(counts)
        table = cls(np.zeros(int(level.sum()) * BITS // 8 + 1, np.uint8), int(level.max(initial=0)))
        for j in range(1, table.levels + 1):
            keys, level = keys[level >= j], level[level >= j]
            for at in table.places(keys, j):
                np.bitwise_or.at(table.cells, at >> np.uint64(3), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))
        return table

    def places(self, keys: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = followed(keys, np.uint64(level))
        step = mixed(h) | np.uint64(1)
        for i in range(self.probes):
            yield (h + np.uint64(i) * step) % np.uint64(self.bits)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level; 0 for a key that was not entered."""
        level = np.zeros(len(keys), np.uint8)
        alive, probe = np.arange(len(keys)), keys
        for j in range(1, self.levels + 1):
            there = np.ones(len(alive), bool)
            for at in self.places(probe, j):
                there &= (self.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive, probe = alive[there], probe[there]
            level[alive] = j
            if not len(alive):
                break
        return level


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of all texts, each text followed by the end token; bounds."""
    words, bounds = word_hashes(texts)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def pair_keys(tok: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring tokens of one text, and the position of the second of each."""
    second = np.ones(len(tok), bool)
    second[bounds[:-1]] = False
    at = np.flatnonzero(second)
    return followed(tok[at - 1], tok[at]), at


def found_in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted table, and which keys are there."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def dealt(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts keys of one shard together, ascending as the shard knows them; these keys; the shards, and
    where each begins (and the last ends)."""
    shard, known = (mixed(keys) >> np.uint64(32)) % np.uint64(shards), sent(kind, keys)
    order = np.lexsort((known, shard))
    shard = shard[order]
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.empty(0, np.int64)
    return order, known[order], shard[starts].astype(np.int32), np.r_[starts, len(keys)]


def sent(kind: int, keys: np.ndarray) -> np.ndarray:
    """Keys as a shard knows them. Pairs lose the half of their hash that chose the shard."""
    return keys if kind == WORD else mixed(keys).astype(np.uint32)


def planes(values: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, and so on: the upper bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def ascending(keys: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the differences of each stretch of ascending keys, in planes."""
    steps = np.diff(keys, prepend=keys[:1])
    steps[bounds[:-1]] = keys[bounds[:-1]]
    return pa.array([planes(steps[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())


def keys_of(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all values one after the other, and the bounds of each value's."""
    parts = [np.cumsum(from_planes(x.as_py(), kind), dtype=kind) for x in column]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def stretches(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of rows that agree in all columns begin and end."""
    if len(columns[0]):
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = np.flatnonzero(np.r_[True, new])
        yield from zip(starts.tolist(), [*starts[1:].tolist(), len(columns[0])], strict=True)


def by_shard(table: DataFrame, *then: str) -> DataFrame:
    return table.repartition("shard").sortWithinPartitions("shard", *then)


def counted(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, keys, n): distinct words and pairs of each piece of text, packed by shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            tok, bounds = tokens(batch.column("text"))
            for kind, all_ in ((WORD, tok), (PAIR, pair_keys(tok, bounds)[0])):
                keys, n = np.unique(all_, return_counts=True)
                order, known, shard, cuts = dealt(kind, keys, shards)
                times = n[order].astype(np.uint32)
                counts = [planes(times[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(np.full(len(shard), kind, np.int8)), ascending(known, cuts), pa.array(counts, pa.binary())],
                    ["shard", "kind", "keys", "n"],
                )

    return texts.mapInArrow(rows, "shard int, kind byte, keys binary, n binary")


SHARD = "shard int, words binary, counts binary, cells binary, levels int, n_words long, n_tokens long"


def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard, from rows of `counted` in order of shards."""
    shard, waiting = None, ([], [])

    def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
        parts = waiting[kind] or [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def row() -> pa.RecordBatch:
        words, counts = merged(WORD)
        table = CountFilter.of(*merged(PAIR))
        values = [shard, words.tobytes(), counts.tobytes(), table.cells.tobytes(), table.levels, len(words), int(counts.sum())]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    for batch in batches:
        shards, kinds = (batch.column(c).to_numpy() for c in ("shard", "kind"))
        for a, b in stretches(shards, kinds):
            if shard is not None and shards[a] != shard:
                yield row()
                waiting = ([], [])
            shard, kind, part = int(shards[a]), kinds[a], batch.slice(a, b - a)
            keys, n = keys_of(part["keys"], SENT[kind])[0], np.concatenate([from_planes(x.as_py(), np.uint32) for x in part["n"]])
            waiting[kind].append((keys.astype(np.uint64), n.astype(np.int64)))
            if len(waiting[kind]) > 1 and sum(len(k) for k, _ in waiting[kind][1:]) > WAITING:
                waiting[kind][:] = [merged(kind)]
    if shard is not None:
        yield row()


@dataclass
class Model:
    """A trained model: a stored table of `n_shards` bounded shards."""

    shards: DataFrame
    n_shards: int
    n_tokens: int
    n_words: int


def train(docs: DataFrame, text: str = "text", capacity: int | None = None) -> Model:
    """Count all texts of `docs` and build the filters, one for `capacity` bytes of text."""
    texts = docs.select(whole(text).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(0))).first()[0]
    n_shards = max(1, -(-size // (capacity or min(max(CAPACITY, size // SHARDS), LARGEST))))
    shards = cut_lineage(by_shard(counted(texts, n_shards), "kind").mapInArrow(built, SHARD))
    n_words, n_tokens = shards.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens")]).first()
    return Model(shards, n_shards, n_tokens, n_words)


PIECE = "ids array<{}>, bounds binary, words binary, codes binary"
ASKED = "shard int, kind byte, piece long, keys binary"
ANSWER = "piece long, shard int, kind byte, found binary"
SCORED = "doc_id {}, n_tokens long, n_known long, base_score double, score double"


def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a piece of text: its ids, where texts begin and end, its distinct words and the tokens' places there."""
    for batch in pieces(batches, "text"):
        tok, bounds = tokens(batch.column("text"))
        words, codes, n = np.unique(tok, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        codes = np.argsort(order).astype(np.uint32)[codes]
        planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T)  # frequent words have small numbers
        ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id"))
        data = [bounds.astype(np.int64).tobytes(), words[order].tobytes(), pa.compress(planes.tobytes(), "zstd", asbytes=True)]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array([d], pa.binary()) for d in data]], ["ids", "bounds", "words", "codes"])


def parts_of(piece: pa.RecordBatch | pa.Table, i: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of texts, distinct words, and the place of each token's word among them."""
    bounds = np.frombuffer(piece["bounds"][i].as_py(), np.int64)
    planes = pa.decompress(piece["codes"][i].as_buffer(), 4 * int(bounds[-1]), "zstd", asbytes=True)
    codes = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
    return bounds, np.frombuffer(piece["words"][i].as_py(), np.uint64), codes


def asked(stored: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, piece, keys): what pieces want to know of each shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bounds, words, codes = parts_of(batch, i)
                pairs = np.unique(pair_keys(words[codes], bounds)[0])
                for kind, keys in ((WORD, words), (PAIR, pairs)):
                    _, known, shard, cuts = dealt(kind, keys, shards)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard), pa.array(np.full(len(shard), kind, np.int8)),
                         pa.array(np.full(len(shard), batch["piece"][i].as_py(), np.int64)), ascending(known, cuts)],
                        ["shard", "kind", "piece", "keys"],
                    )

    return stored.select("piece", "bounds", "words", "codes").mapInArrow(rows, ASKED)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and levels of pairs, in the order of the keys; a shard's own row (kind -1) comes before its questions."""
    shard = None
    for batch in batches:
        shards, kinds = (batch.column(c).to_numpy() for c in ("shard", "kind"))
        for a, b in stretches(shards, kinds):
            part = batch.slice(a, b - a)
            if kinds[a] < 0:
                shard = shards[a]
                words, counts = (np.frombuffer(part[c][0].as_py(), k) for c, k in (("words", np.uint64), ("counts", np.int64)))
                table = CountFilter(np.frombuffer(part["cells"][0].as_py(), np.uint8), part["levels"][0].as_py())
                continue
            keys, bounds = keys_of(part["keys"], SENT[kinds[a]])
            keys = keys.astype(np.uint64)
            if shards[a] != shard:  # nothing was trained there
                values = np.zeros(len(keys), np.int64 if kinds[a] == WORD else np.uint8)
            elif kinds[a] == WORD:
                at, there = found_in(words, keys)
                values = np.zeros(len(keys), np.int64)
                values[there] = counts[at[there]]
            else:
                values = table.level(keys)
            found = pa.array([planes(values[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part["piece"], part["shard"], part["kind"], found], ["piece", "shard", "kind", "found"])


def scored(model: Model, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (both log10) of every text."""
    total, shards = model.n_tokens + 0.5 * (model.n_words + 1), model.n_shards

    def rows(piece: pa.Table, answers: pa.Table) -> pa.Table:
        bounds, words, codes = parts_of(piece)
        pair, second = pair_keys(words[codes], bounds)
        pairs, place = np.unique(pair, return_inverse=True)
        answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")])
        kinds = answers["kind"].to_numpy()

        def told(kind: int, keys: np.ndarray, dtype) -> np.ndarray:
            values = np.empty(len(keys), dtype)
            found = [from_planes(x.as_py(), dtype) for x in answers["found"].filter(pa.array(kinds == kind))]
            values[dealt(kind, keys, shards)[0]] = np.concatenate([np.empty(0, dtype), *found])
            return values

        count = told(WORD, words, np.int64)[codes]
        own = (count + 0.5) / total
        p, seen = own.copy(), count[second - 1]
        of_pair = np.minimum(middle(told(PAIR, pairs, np.uint8))[place], seen)
        p[second] = (of_pair + PRIOR * own[second]) / (seen + PRIOR)
        by_text = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has its end token
        return pa.Table.from_arrays(
            [piece["ids"][0].values, pa.array(np.diff(bounds)), pa.array(by_text((count > 0).astype(np.int64))),
             pa.array(by_text(np.log10(own))), pa.array(by_text(np.log10(p)))],
            ["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    work = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = work.schema["doc_id"].dataType.simpleString()
    stored = cut_lineage(work.mapInArrow(tokenised, PIECE.format(kind)).withColumn("piece", F.monotonically_increasing_id()))
    own = model.shards.select("shard", F.lit(-1).cast("byte").alias("kind"), "words", "counts", "cells", "levels")
    questions = asked(stored, shards).unionByName(own, allowMissingColumns=True)
    answers = by_shard(questions, "kind").mapInArrow(answered, ANSWER)
    return stored.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(rows, SCORED.format(kind))
