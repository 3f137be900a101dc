"""Language identification with a bit-sliced Bloom filter of character n-grams.

N-grams are the runs of up to `LONGEST` characters inside a word with a mark before and after it; words are runs of
letters, in lower case. A language contains an n-gram if the n-gram makes up at least `LEAST_RATE` of all n-grams of
its training texts and at least `LEAST_SHARE` of the highest rate any language has for it. Rates do not depend on the
size of the corpus, and no language contains more than 1 / LEAST_RATE n-grams.

Filter. A cell is a mask with one bit a language, so one array of cells holds a Bloom filter for each of up to
`SLICE` languages. An n-gram enters its languages' bits in `PROBES` cells; the AND of these cells returns all languages
that contain it. More languages than `SLICE` take several filters, one after the other over the same rows, in one stage.

Prediction. Of a text's n-grams, the bits of each language are counted. A language whose bit is set in a share `fill`
of all cells answers falsely with probability fill ** PROBES, so of n n-grams with c answers (c / n - false) /
(1 - false) are taken to be contained. The language with the highest such share is predicted, and the share is the score.

Training is counted on distinct words of a piece of text and summed up by task before one shuffle of (language,
n-gram, count). The driver gets the chosen n-grams: at most SLICE / LEAST_RATE of one filter.

Defined results: a null text and a text without letter is "und" with score 0; so is everything if no language was
learned. A text none of whose n-grams is known gets the language with the most training n-grams and score 0. Ties go
to the name that sorts first. Rows with null text or null language teach nothing; a null id belongs to the training
part; repeated rows count and are predicted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autostat.llm.tokens import followed, mixed, pieces
from autostat.sources.checkpoints import cut_lineage

LONGEST = 4
LEAST_RATE = 1e-5
LEAST_SHARE = 0.25
#: Languages of one filter, cells an entry, and cells looked at for an n-gram.
SLICE, CELLS, PROBES = 64, 8, 4
#: Counted n-grams of a language that wait to be added up in a task.
WAITING = 1 << 20
UNDETERMINED = "und"
MARK = ord("_")


@dataclass
class Grams:
    """The n-grams of all distinct words of some texts: `keys` (distinct), `code` of each occurrence, the word of each
    occurrence; `tokens` are the texts' words and `bounds` where each text's begin."""

    keys: np.ndarray
    code: np.ndarray
    word: np.ndarray
    n_words: int
    tokens: np.ndarray
    bounds: np.ndarray


def grams(texts: pa.Array) -> Grams:
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, r"[^\pL]+", " "))
    flat = lists.values
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    bounds = np.r_[0, np.cumsum(there)][lists.offsets.to_numpy().astype(np.int64)]
    coded = flat.filter(pa.array(there)).dictionary_encode()
    n_words = len(coded.dictionary)
    if not n_words:
        none = np.empty(0, np.int64)
        return Grams(np.empty(0, np.uint64), none, none, 0, none, bounds)
    marked = f"_{'__'.join(coded.dictionary.to_pylist())}_"
    chars = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64) + 2
    word, left = np.repeat(np.arange(n_words), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
    key, keys, words = np.full(len(chars), MARK, np.uint64), [], []
    for n in range(1, LONGEST + 1):
        last = len(chars) - n + 1
        key = followed(key[:last], chars[n - 1 :])
        whole = np.flatnonzero((left[:last] >= n) if n > 1 else (chars != MARK))
        keys.append(key[whole])
        words.append(word[whole])
    distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
    return Grams(distinct, code, np.concatenate(words), n_words, coded.indices.to_numpy(), bounds)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of each one's counts."""
    keys, code = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(code, np.concatenate([n for _, n in parts])).astype(np.int64)


def counted(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each n-gram occurs in the texts of each language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(name: str) -> pa.RecordBatch:
            keys, n = summed(waiting.pop(name))
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(keys), np.int8)), pa.array([name])).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in pieces(batches, "text"):
            found, names = grams(batch.column("text")), batch.column("lang").dictionary_encode()
            of_token = np.repeat(names.indices.to_numpy(), np.diff(found.bounds))
            for i, name in enumerate(names.dictionary.to_pylist()):
                times = np.bincount(found.tokens[of_token == i], minlength=found.n_words)
                n = np.bincount(found.code, times[found.word], minlength=len(found.keys)).astype(np.int64)
                parts = waiting.setdefault(name, [])
                parts.append((found.keys[n > 0], n[n > 0]))
                if sum(len(k) for k, _ in parts[1:]) > WAITING:
                    parts[:] = [summed(parts)]
                    if len(parts[0][0]) > WAITING:
                        yield out(name)
        for name in list(waiting):
            yield out(name)

    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    found = known.mapInArrow(rows, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """Bloom filters of up to SLICE languages, a bit of every cell for each."""

    def __init__(self, names: list[str], keys: np.ndarray, masks: np.ndarray) -> None:
        self.names = names
        self.cells = np.zeros(1 << max(6, int(CELLS * len(keys)).bit_length()), np.uint64)
        for at in self.places(keys):
            np.bitwise_or.at(self.cells, at, masks)
        self.false = np.array([np.mean(self.cells >> np.uint64(i) & np.uint64(1)) for i in range(len(names))]) ** PROBES

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mixed(keys)
        step = mixed(h) | np.uint64(1)
        for i in range(PROBES):
            yield (h + np.uint64(i) * step) & np.uint64(len(self.cells) - 1)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        found = np.full(len(keys), ~np.uint64(0))
        for at in self.places(keys):
            found &= self.cells[at]
        return found

    def shares(self, found: Grams) -> np.ndarray:
        """Texts x languages: the corrected share of the text's n-grams in the language."""
        masks, asked = self.masks(found.keys), np.bincount(found.word, minlength=found.n_words)
        by_text = lambda of_word: np.diff(np.r_[0, np.cumsum(of_word[found.tokens])][found.bounds])
        n = np.maximum(by_text(asked), 1)
        out = np.empty((len(n), len(self.names)))
        for i in range(len(self.names)):
            bits = (masks >> np.uint64(i) & np.uint64(1))[found.code]
            answers = by_text(np.bincount(found.word[bits == 1], minlength=found.n_words))
            out[:, i] = (answers / n - self.false[i]) / (1 - self.false[i]) if self.false[i] < 1 else 0.0
        return out


@dataclass
class Model:
    filters: list[LanguageFilter]
    most_common: str | None


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn which n-grams the languages of `docs` contain."""
    counts = cut_lineage(counted(docs, text, lang))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    size = {r["lang"]: r["total"] for r in totals.collect()}
    rates = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    highest = rates.groupBy("gram").agg(F.max("rate").alias("highest"))
    often = rates.where(F.col("rate") >= LEAST_RATE).join(highest, "gram").where(F.col("rate") >= LEAST_SHARE * F.col("highest"))
    often = cut_lineage(often.select("lang", "gram"))
    names, filters = sorted(size), []
    for a in range(0, len(names), SLICE):
        some = names[a : a + SLICE]
        bits = np.left_shift(np.uint64(1), np.arange(len(some), dtype=np.uint64)).view(np.int64).tolist()
        bit = F.create_map(*[x for name, b in zip(some, bits, strict=True) for x in (F.lit(name), F.lit(b).cast("long"))])
        chosen = often.where(F.col("lang").isin(some)).withColumn("mask", bit[F.col("lang")])
        table = chosen.groupBy("gram").agg(F.bit_or("mask").alias("mask")).toArrow()
        keys, masks = (table[c].to_numpy().view(np.uint64) for c in ("gram", "mask"))
        filters.append(LanguageFilter(some, keys, masks))
    return Model(filters, max(sorted(size), key=size.get, default=None))


def predicted(model: Model, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    work = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    letters = F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & F.lit(model.most_common is not None)
    guess = F.when(letters, F.lit(model.most_common)).otherwise(F.lit(UNDETERMINED))
    work = work.withColumns({"lang_pred": guess, "score": F.lit(0.0)})
    kind = work.schema["doc_id"].dataType.simpleString()
    for of_slice in model.filters:
        shared = docs.sparkSession.sparkContext.broadcast(of_slice)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in pieces(batches, "text"):
                shares = own.shares(grams(batch.column("text")))
                best = shares.argmax(axis=1)
                top = np.minimum(shares[np.arange(len(best)), best], 1.0)
                before = batch.column("score").to_numpy()
                better = pa.array(top > before)
                names = pa.array(own.names).take(pa.array(best))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pc.if_else(better, names, batch.column("lang_pred")),
                     pa.array(np.maximum(top, before))], batch.schema.names,
                )

        work = work.mapInArrow(rows, f"doc_id {kind}, text string, lang_pred string, score double")
    return work.drop("text")
