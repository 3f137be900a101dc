"""Byte-level BPE as a streaming transducer, and its decoder as an incremental state machine.

Encoding. For merges applied in rank order, a token sequence is the encoding of its bytes exactly if every two
neighbours are, and every prefix of a text has exactly one such sequence. So the last token of each prefix is found
from left to right: a vocabulary token that ends there and may stand beside the last token of the prefix it leaves.
`may_stand` decides a pair from the merge list alone: it follows both tokens down to the boundary and looks for a
merge across it that would have come first.

Streaming. A later token reaches back at most as far as the longest token of the merge list (`Merges.lookahead`
bytes), so all later encodings go through one of the last `lookahead` positions. Walking these back to where they
meet gives the tokens that no further input can change; they are emitted and forgotten. The state is what is not
yet stable, however long the word is. Words are cut from the text by an iterator, the text is never split as a whole.

Decoding joins a bounded number of tokens at a time and feeds the bytes to an incremental UTF-8 decoder, which holds
back an unfinished character; bytes that are not UTF-8 become U+FFFD as in the public library.

The tokenizer file is read once by the driver and broadcast: its size is that of a vocabulary, and checked.

Defined results: a null or empty text has no tokens and decodes to the empty text; strings of the file's added
tokens become these tokens; repeated rows give repeated rows; a null id stays; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autostat.llm.text import whole
from autostat.llm.tokens import pieces

LARGEST_FILE = 64 << 20
#: Encodings of words of at most CACHED_BYTES bytes are kept in a Python worker, the CACHED_WORDS last asked for and at
#: most as many older ones.
CACHED_BYTES, CACHED_WORDS = 48, 3 << 17
#: Kept at once: last tokens of prefixes of so many bytes, and decided pairs of tokens.
PREFIX_BYTES, PREFIXES, PAIRS = 12, 1 << 18, 1 << 19
#: Bytes of a word read, characters cut into words, and tokens decoded, at a time.
STEP, CUT, PIECE = 1 << 9, 1 << 14, 1 << 16
#: How byte-level tokenizers cut a text into words; letters and numbers are put in below.
AFTER_WORD = regex.compile(r"(?<=\S)\s")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The visible characters that stand for bytes in the file: a byte that is a visible Latin-1 character stands
    for itself, the others follow from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The tokens of a tokenizer file, as bytes."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.read(spec, vocab)

    def read(self, spec: dict, vocab: dict[str, int]) -> None:
        """What else is needed of the file."""

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens one after the other, and where each token's begin and how many they are."""
        sizes = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            sizes[i] = len(b)
        flat = b"".join(self.bytes[i] for i in sorted(self.bytes))
        return np.frombuffer(flat, np.uint8), np.cumsum(sizes) - sizes, sizes


class Merges(Vocabulary):
    """A vocabulary with its merge list."""

    def read(self, spec: dict, vocab: dict[str, int]) -> None:
        ids = {self.bytes[i]: i for i in vocab.values()}
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = vocab[a], vocab[b]
            self.rank_of_pair[left, right] = rank
            self.made.setdefault(vocab[a + b], (rank, left, right))
        #: Tokens by their bytes read backwards; -1 holds the token.
        self.backwards: dict = {}
        for b, i in ids.items():
            if len(b) > 1 and i not in self.made:
                continue
            node = self.backwards
            for byte in reversed(b):
                node = node.setdefault(byte, {})
            node[-1] = i
        self.lookahead = max(map(len, ids))
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, tuple[int, int]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens at one end (side 2: right, 1: left) of `token` while it is made: (token, rank that makes it,
        rank that takes it into the next)."""
        out, taken = [], float("inf")
        while token in self.made:
            rank = self.made[token][0]
            out.append((token, rank, taken))
            token, taken = self.made[token][side], rank
        return [*out, (token, -1, taken)]

    def may_stand(self, a: int, b: int) -> bool:
        """Whether the bytes of `a` and `b` together are encoded as these two tokens; kept in `pairs`, of which there
        are at most PAIRS. A merge across the boundary happens if both its tokens are there at its rank; of equal
        ranks the leftmost comes first."""
        crossing = (
            rank is not None and made_x < rank and made_y < rank and rank < taken_x and rank <= taken_y
            for x, made_x, taken_x in self.edge(a, 2)
            for y, made_y, taken_y in self.edge(b, 1)
            for rank in (self.rank_of_pair.get((x, y)),)
        )
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fits = self.pairs[a << 32 | b] = not any(crossing)
        return fits


class Transducer:
    """Feed bytes of one word; get the tokens that have become stable."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.buffer = bytearray()
        #: last[i]: last token and start of the prefix of i bytes of the buffer; the buffer begins at a token.
        self.last: list[tuple[int, int]] = [(-1, 0)]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), STEP):
            self._read(data[at : at + STEP])
            if len(self.buffer) > 2 * self.merges.lookahead:
                out += self._emit(self._stable())
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.buffer))

    def short(self, data: bytes) -> list[int]:
        """The tokens of a whole word of a few bytes: read at once, and emitted when it ends."""
        self._read(data)
        return self._upto(len(data))

    def _read(self, data: bytes) -> None:
        merges, last = self.merges, self.last
        pairs, prefixes, root = merges.pairs, merges.prefixes, merges.backwards
        first = len(self.buffer)
        self.buffer += data
        buffer = bytes(self.buffer)
        if len(prefixes) >= PREFIXES:
            prefixes.clear()
        known = PREFIX_BYTES if last[0][0] < 0 else 0  # the last token of a prefix depends on its bytes alone
        for end in range(first, len(buffer)):
            if end < known and (found := prefixes.get(buffer[: end + 1])):
                last.append(found)
                continue
            node, at, ending = root, end, []
            while at >= 0 and (node := node.get(buffer[at])) is not None:
                if -1 in node:
                    ending.append((node[-1], at))
                at -= 1
            while ending:  # the longest first: it fits most often, and only one does
                found = ending.pop()
                before = last[found[1]][0]
                fits = before < 0 or pairs.get(before << 32 | found[0])
                if fits is None:
                    fits = merges.may_stand(before, found[0])
                if fits:
                    last.append(found)
                    if end < known:
                        prefixes[buffer[: end + 1]] = found
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def _stable(self) -> int:
        """The last position that every encoding of a longer word goes through."""
        open_ = set(range(max(0, len(self.buffer) - self.merges.lookahead), len(self.buffer) + 1))
        while len(open_) > 1:
            latest = max(open_)
            open_.discard(latest)
            open_.add(self.last[latest][1])
        return open_.pop()

    def _emit(self, upto: int) -> list[int]:
        """Tokens up to a position, which are dropped. The last of them stays as the neighbour of what follows."""
        if not upto:
            return []
        out, neighbour = self._upto(upto), self.last[upto][0]
        del self.buffer[:upto]
        self.last = [(neighbour, 0), *((token, start - upto) for token, start in self.last[upto + 1 :])]
        return out

    def _upto(self, at: int) -> list[int]:
        """The tokens of the buffer up to a position."""
        out, last = [], self.last
        while at:
            token, at = last[at]
            out.append(token)
        return out[::-1]


@functools.cache
def disputed() -> dict[int, str]:
    """Code points on which Unicode versions differ, with the class (L, N or other) that the public library gives
    them: asked of it where `regex` and the standard library disagree."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    out = {}
    for code in itertools.chain(range(0x80, 0xD800), range(0xE000, 0x110000)):
        c = chr(code)
        here = "L" if letter.match(c) else "N" if number.match(c) else ""
        if here != (there if (there := unicodedata.category(c)[0]) in "LN" else ""):
            theirs = "L" if len(cut("a" + c)) == 1 else "N" if len(cut("1" + c)) == 1 else ""
            if theirs != here:
                out[code] = theirs
    return out


def ranges(codes: Iterable[int]) -> str:
    out, run = [], []
    for c in sorted(codes):
        if run and c == run[1] + 1:
            run[1] = c
        else:
            run = [c, c]
            out.append(run)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


def latin_pattern() -> re.Pattern:
    """WORD_PATTERN for texts in Latin-1, with its classes written out: the standard library matches these faster."""
    of = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c)))
    letters, numbers, space = (of(kind) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    classes = WORD_PATTERN.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")
    return re.compile(classes.replace("{L}", f"[{letters}]").replace("{N}", f"[{numbers}]").replace("{l}{n}", letters + numbers))


def word_patterns(other: dict[int, str]) -> tuple[re.Pattern, regex.Pattern]:
    """For texts in Latin-1, and for all."""
    names = {}
    for kind in "LN":
        out, into = (ranges(c for c, k in other.items() if (k == kind) == inside) for inside in (False, True))
        names[kind] = rf"[\p{{{kind}}}{f'--[{out}]' if out else ''}]"
        names[kind] = f"[{names[kind]}||[{into}]]" if into else names[kind]
    full = r"(?V1)" + WORD_PATTERN.replace(r"[^\s{l}{n}]", r"[[^\s]--{L}--{N}]").format(**names)
    return latin_pattern(), regex.compile(full)


class Words(dict):
    """Encodings of words by word, made when first asked for. A full table becomes the older one; words found there
    come back, so frequent words are never made again."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            transducer, data = Transducer(self.merges), word.encode()
            if len(data) > CACHED_BYTES:
                ids = transducer.feed(data) + transducer.finish()
                return struct.pack(f"<{len(ids)}I", *ids)
            ids = transducer.short(data)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHED_WORDS:
            self.older = {}
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed


class Encoder:
    """Texts to token ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, data: bytes, other: dict[int, str]) -> None:
        self.merges = merges = Merges(data)
        self.patterns = word_patterns(other)
        self.words = Words(merges)
        contents = sorted(merges.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, contents))) if contents else None

    def ordinary(self, text: str) -> Iterator[bytes]:
        """Piece by piece; a space after something else always begins a word, so a piece may end before it."""
        at = 0
        while at < len(text):
            cut = AFTER_WORD.search(text, at + CUT)
            piece = text[at : cut.start() if cut else len(text)]
            at += len(piece)
            try:
                piece.encode("latin-1")
                pattern = self.patterns[0]
            except UnicodeEncodeError:
                pattern = self.patterns[1]
            yield b"".join(map(self.words.__getitem__, pattern.findall(piece)))

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        for match in self.special.finditer(text) if self.special else ():
            out += [*self.ordinary(text[at : match.start()]), struct.pack("<I", self.merges.special[match[0]])]
            at = match.end()
        return b"".join([*out, *self.ordinary(text[at:])])


def decode_all(vocabulary: Vocabulary, texts: list[bytes]) -> list[str]:
    """The texts of packed ids, PIECE tokens at a time whichever texts they belong to. A text that ends in another piece
    goes through an incremental decoder."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    ends = np.cumsum([len(x) // 4 for x in texts], dtype=np.int64)
    flat, starts, sizes = vocabulary.table
    out, parts, machine, text = [], [], None, 0
    for a in range(0, len(ids), PIECE):
        piece = ids[a : a + PIECE]
        size = sizes[piece]
        upto = np.cumsum(size)
        total = int(upto[-1])
        data = flat[np.repeat(starts[piece] - (upto - size), size) + np.arange(total)].tobytes()
        begin = 0
        while text < len(ends) and ends[text] <= a + len(piece):
            end = int(upto[ends[text] - a - 1]) if ends[text] > a else 0
            if machine is None:
                out.append(data[begin:end].decode("utf-8", "replace"))
            else:
                out.append("".join([*parts, machine.decode(data[begin:end], final=True)]))
                parts, machine = [], None
            begin, text = end, text + 1
        if begin < total:
            machine = machine or codecs.getincrementaldecoder("utf-8")("replace")
            parts.append(machine.decode(data[begin:]))
    return out + [""] * (len(ends) - len(out))


_loaded: dict[type, tuple[bytes, object]] = {}


def loaded(kind: type, data: bytes, *more):
    """An object made from a file, once in this Python worker."""
    if kind not in _loaded or _loaded[kind][0] != data:
        _loaded[kind] = data, kind(data, *more)
    return _loaded[kind][1]


def shared_file(df: DataFrame, path: str):
    with open(path, "rb") as f:
        data = f.read(LARGEST_FILE + 1)
    if len(data) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return df.sparkSession.sparkContext.broadcast(data)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text, packed as little-endian unsigned 32-bit integers."""
    data, other = shared_file(docs, path), disputed()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = loaded(Encoder, data.value, other)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [encoder.encode(t) for t in batch["text"]]})

    work = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return work.mapInPandas(rows, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, ids binary")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, text): `encoded` followed by `decoded`, in one Python worker a task with one vocabulary, a few
    million bytes of text at a time."""
    data, other = shared_file(docs, path), disputed()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(Encoder, data.value, other)
        for piece in pieces(batches, "text"):
            ids = [encoder.encode(t.as_py()) for t in piece.column("text")]
            texts = pa.array(decode_all(encoder.merges, ids), pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(ids, pa.binary()), texts], ["doc_id", "ids", "text"])

    work = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    return work.mapInArrow(rows, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def decoded(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, ids, text) of packed token ids."""
    data = shared_file(tokens, path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = loaded(Vocabulary, data.value)
        for batch in batches:
            yield batch.assign(text=decode_all(vocabulary, [bytes(x) for x in batch["ids"]]))

    work = tokens.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    return work.mapInPandas(rows, f"doc_id {work.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
