"""Hashed words of texts in Arrow batches, for operators that run on arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text looked at together; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def followed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of the sequence hashed as x, followed by y."""
    return mixed(x * np.uint64(0x9E3779B97F4A7C15) + y)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and where each text's words begin and end (one more number than texts).
    A-Z count as a-z; words are what lies between spaces and \\t..\\r."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.values
    offsets = lists.offsets.to_numpy().astype(np.int64)
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    bounds = np.r_[0, np.cumsum(there)][offsets]
    coded = flat.filter(pa.array(there)).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64), bounds
