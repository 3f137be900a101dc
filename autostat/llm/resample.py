"""Importance resampling towards a target distribution, by bit-sliced aggregation.

Every run of one to three words is a feature and falls into one of `BUCKETS` buckets by crc32. A document's bucket
counts are kept as bit planes: plane i holds bit i of every bucket's count, so a document is a few planes of 10,000
bits. A bucket's gain (the log ratio of its share in the target and in the documents, in thousandths) is bit-sliced as
well, as two's complement: plane j stands for 2^j, the last one for its negative. A document's weight, the sum of
count times gain over its buckets, is then exactly the sum of 2^i * gain of plane j * popcount(count plane i AND gain
plane j): no product of counts and gains is ever taken.

A document's score is its weight plus Gumbel noise hashed from its id; the highest scores are a sample without
replacement in proportion to exp(weight / 1000).

One pass over the texts stores the planes; each task adds the bucket totals of its rows as one more row, so the totals
need no second pass. Only totals (a fixed number of buckets) reach the driver. Ranks come from a range-partitioned sort
of (score, id) and the row counts of its partitions.

The crc32 of a run is put together from those of its words (crc32 is linear, so a word's checksum is moved past the
bytes that follow by table lookups); only distinct words of a piece of text are read byte by byte.

Defined results: a null or empty text has no features, weight 0 and its noise as score; a null id is hashed as "null"
and comes last among ties; repeated rows are counted, scored and ranked each; other columns are ignored; a target
without features has total 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.llm.text import whole
from autostat.llm.tokens import pieces
from autostat.sources.checkpoints import cut_lineage

BUCKETS = 10_000
LONGEST_RUN = 3
PLANE_BYTES = BUCKETS // 8
#: Documents whose counts are held together, and words whose runs are hashed together.
TOGETHER, WORDS_AT_ONCE = 64, 1 << 20
#: Words up to this many bytes have a lookup table of their own; longer ones take one for every power of two.
TABLED = 64

#: Bytes of words after A-Z became a-z, and the polynomial of crc32.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
POLYNOMIAL = 0xEDB88320


@cache
def crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of one byte; of n zero bytes for n < TABLED; of 2^k zero bytes. The last two by byte of the checksum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    moved = [np.arange(256, dtype=np.uint32) << np.uint32(8 * np.arange(4)[:, None])]
    for _ in range(TABLED - 1):
        moved.append(one[moved[-1] & 0xFF] ^ (moved[-1] >> 8))
    powers = [moved[1]]
    for _ in range(31):
        powers.append(past(powers[-1], powers[-1]))
    return one, np.stack(moved), np.stack(powers)


def past(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Checksums moved past the zero bytes a table (4 x 256) stands for."""
    return table[0][crc & 0xFF] ^ table[1][(crc >> 8) & 0xFF] ^ table[2][(crc >> 16) & 0xFF] ^ table[3][crc >> 24]


def moved_past(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums, each moved past as many zero bytes as `lengths` says."""
    _, moved, powers = crc_tables()
    flat, at = moved.ravel(), np.minimum(lengths, TABLED - 1) * 1024
    out = flat[at + (crc & 0xFF)] ^ flat[at + 256 + ((crc >> 8) & 0xFF)]
    out ^= flat[at + 512 + ((crc >> 16) & 0xFF)] ^ flat[at + 768 + (crc >> 24)]
    far = np.flatnonzero(lengths >= TABLED)
    if len(far):
        rest = lengths[far] - (TABLED - 1)
        for k in range(int(rest.max()).bit_length()):
            odd = (rest >> k) & 1 == 1
            out[far[odd]] = past(powers[k], out[far[odd]])
    return out


def then_space(crc: np.ndarray) -> np.ndarray:
    """Checksums of the same strings followed by a space."""
    state = ~crc
    return ~(crc_tables()[0][(state ^ 0x20) & 0xFF] ^ (state >> 8))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 and byte length of every word of all texts, and where each text's words begin (and the last end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = LOWER[data]
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, inside[:-1]] & ~edge[:-1], np.r_[inside[1:], False] & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint32), lengths, bounds
    ends = np.r_[0, np.cumsum(lengths)]
    flat = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    coded = flat.dictionary_encode()
    known = np.fromiter(map(zlib.crc32, coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
    return known[coded.indices.to_numpy()], lengths, bounds


def runs(crc: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Checksums of the runs of 1, 2, ... words that begin at each word, as far as there are words."""
    spaced, run = then_space(crc), crc
    yield run
    for n in range(1, LONGEST_RUN):
        open_run = spaced if n == 1 else moved_past(open_run[:-1], lengths[n - 1 :] + 1) ^ spaced[n - 1 :]  # noqa: F821
        run = moved_past(open_run[:-1], lengths[n:]) ^ crc[n:]
        yield run


def counted(crc: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket counts (documents x BUCKETS) of documents whose words lie between consecutive bounds."""
    n_docs, ahead = len(bounds) - 1, LONGEST_RUN - 1
    counts = np.zeros(n_docs * BUCKETS, np.int64)
    for a in range(int(bounds[0]), int(bounds[-1]), WORDS_AT_ONCE):
        b = min(a + WORDS_AT_ONCE, int(bounds[-1]))
        doc = np.searchsorted(bounds, np.arange(a, b), side="right") - 1
        left = bounds[doc + 1] - np.arange(a, b)
        seen = slice(a, min(b + ahead, int(bounds[-1])))
        for n, run in enumerate(runs(crc[seen], lengths[seen]), 1):
            whole_run = np.flatnonzero(left >= n)
            counts += np.bincount(doc[whole_run] * BUCKETS + run[whole_run] % BUCKETS, minlength=len(counts))
    return counts.reshape(n_docs, BUCKETS)


def planes_of(counts: np.ndarray) -> list[bytes]:
    """Each document's counts as planes, from the lowest bit up to its highest."""
    if counts.max(initial=0) < 256:
        counts = counts.astype(np.uint8)
    highest = [int(m).bit_length() for m in counts.max(axis=1)]
    sliced = [np.packbits((counts >> i) & 1, axis=1) for i in range(max(highest, default=0))]
    return [b"".join(p[d].tobytes() for p in sliced[:h]) for d, h in enumerate(highest)]


PLANES = "doc_id {}, n_words long, n_features long, planes binary, totals array<bigint>"


def bit_planes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and planes of every row, and one row of bucket totals for each task."""
    work = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    kind = work.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, ids = np.zeros(BUCKETS, np.int64), None
        for batch in pieces(batches, "text"):
            ids = batch.column("doc_id").type
            crc, lengths, bounds = words(batch.column("text"))
            for a in range(0, batch.num_rows, TOGETHER):
                some = batch.column("doc_id").slice(a, TOGETHER)
                part = bounds[a : a + len(some) + 1]
                counts = counted(crc, lengths, part)
                totals += counts.sum(axis=0)
                n_words = np.diff(part)
                n_features = sum(np.maximum(n_words - n, 0) for n in range(LONGEST_RUN))
                planes = pa.array(planes_of(counts), pa.binary())
                yield table([some, pa.array(n_words), pa.array(n_features), planes, pa.nulls(len(some), pa.list_(pa.int64()))])
        if ids is not None:
            none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
            yield table([pa.nulls(1, ids), *none, pa.array([totals], pa.list_(pa.int64()))])

    table = lambda columns: pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "planes", "totals"])
    return work.mapInArrow(rows, PLANES.format(kind))


def bucket_totals(planes: DataFrame) -> np.ndarray:
    """Features in each bucket, over all rows of `bit_planes`."""
    summed = planes.where("totals is not null").select(F.posexplode("totals").alias("bucket", "n"))
    totals = np.zeros(BUCKETS, np.int64)
    for r in summed.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[r["bucket"]] = r["n"]
    return totals


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, in thousandths."""
    s, t = of_docs.astype(float), of_target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def words_of(planes: np.ndarray) -> np.ndarray:
    """Planes of PLANE_BYTES bytes as rows of 64-bit words."""
    wide = np.zeros((len(planes), -(-PLANE_BYTES // 8) * 8), np.uint8)
    wide[:, :PLANE_BYTES] = planes
    return wide.view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two's complement planes of the gains, and what a bit of each is worth."""
    bits = int(np.abs(gain).max(initial=0)).bit_length() + 1
    sliced = np.stack([np.packbits((gain >> j) & 1 == 1) for j in range(bits)])
    return words_of(sliced), np.array([*(1 << j for j in range(bits - 1)), -(1 << (bits - 1))], np.int64)


def weights_of(planes: pa.Array, gain: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Weight of each document: popcounts of its planes ANDed with the gains' planes."""
    n_planes = pc.binary_length(planes).to_numpy(zero_copy_only=False) // PLANE_BYTES
    weight = np.zeros(len(planes), np.int64)
    for a in range(0, len(planes), TOGETHER):
        some = slice(a, a + TOGETHER)
        rows = words_of(np.frombuffer(b"".join(planes[some].to_pylist()), np.uint8).reshape(-1, PLANE_BYTES))
        value = sum(w * np.bitwise_count(rows & g).sum(axis=1, dtype=np.int64) for g, w in zip(gain, worth, strict=True))
        doc = np.repeat(np.arange(len(n_planes[some])), n_planes[some])
        bit = np.arange(len(rows)) - np.repeat(np.cumsum(n_planes[some]) - n_planes[some], n_planes[some])
        np.add.at(weight[some], doc, value << bit)
    return weight


def weighted(planes: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    sliced, worth = gain_planes(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = pa.array(weights_of(batch.column("planes"), sliced, worth))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight], ["doc_id", "n_words", "n_features", "weight"])

    kind = planes.schema["doc_id"].dataType.simpleString()
    own = planes.where("totals is null").select("doc_id", "n_words", "n_features", "planes")
    return own.mapInArrow(rows, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from 32 hashed bits of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substr(F.sha2(name.cast("binary"), 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """`rows` with `rank` 1, 2, ... up to `limit`, highest score first and then smallest id; null beyond.

    Rows are dealt by ranges of (score, id), sorted in each, and stored with their place; a partition's ranks begin
    after the rows of the partitions before."""
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = cut_lineage(dealt.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND(2**33 - 1)))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    firsts, n = [], 0
    for part in sorted(sizes):
        firsts.append((part, n))
        n += sizes[part]
    first = spark.createDataFrame(firsts, "_part long, _first long")  # a row a partition
    rank = F.col("_first") + F.col("_at") + 1
    return placed.join(F.broadcast(first), "_part").withColumn("rank", F.when(rank <= limit, rank)).drop("_part", "_at", "_first")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
              percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row. The `percent` highest scores of the documents
    with at least `least_words` words are drawn and have a rank."""
    planes = cut_lineage(bit_planes(docs, doc_id, text))
    wanted = bucket_totals(bit_planes(target.select(F.col(target_text).alias("text"), F.lit(0).alias("id")), "id"))
    scored = weighted(planes, gains(bucket_totals(planes), wanted))
    scored = cut_lineage(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    large = F.col("n_words") >= least_words
    limit = percent * scored.where(large).count() // 100
    return ranked(scored.where(large), limit).unionByName(scored.where(~large).withColumn("rank", F.lit(None).cast("long")))
