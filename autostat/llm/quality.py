"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

`RULES` states which range of which ratio a document must keep to; `judged` measures every document in one
narrow pass (no shuffle, nothing outside the JVM) and turns the table into one boolean expression and a list of
the names of the broken rules.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged alike, one
result row per input row; a null id stays null; columns other than the id and the text are not read, whatever
their names; an empty table gives an empty table. The work per document is n log n in its words at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.llm.text import let, total, whole, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine er es für im ist mit nicht sich sie und von zu "
    "au ce dans de des elle en est et il la le les ou par pas pour que qui sur un une "
    "al como con del el ella en es la las lo los para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document keeps to the rule while `feature` lies in [least, most]."""

    name: str
    feature: str
    least: float | None = None
    most: float | None = None

    def broken(self) -> Column:
        value, tests = F.col(self.feature), []
        if self.least is not None:
            tests.append(value < self.least)
        if self.most is not None:
            tests.append(value > self.most)
        return tests[0] | tests[1] if len(tests) == 2 else tests[0]


#: The base rules reject by themselves; the others are the method's verdict on what is left.
BASE_RULES = (Rule("too_short", "n_words", least=50), Rule("repeated", "repeat_percent", most=50))
RULES = (
    Rule("word_length", "mean_word_chars", least=2.5, most=10.0),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("few_letters", "letter_word_ratio", least=0.7),
    Rule("capitals", "capital_ratio", most=0.4),
)


def repeated_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text.

    Windows are compared by 64-bit hash inside one document. A text without a repeated window is settled by one
    hash set; otherwise windows are sorted with their positions, equal neighbours are marked, and the marked
    positions cover min(3, distance to the next) words each.
    """

    def marked(sorted_windows: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(sorted_windows, k)["h"] == x["h"], F.lit(False))
        at = F.filter(sorted_windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(at, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))))

    def settled(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(ordered, lambda s: let(marked(s), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    def windows(hw: Column) -> Column:
        triples = F.transform(hw, lambda h, i: F.xxhash64(h, F.get(hw, i + 1), F.get(hw, i + 2)))
        return F.slice(triples, F.lit(1), F.greatest(F.size(hw) - 2, F.lit(1)))

    word_hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < 3, F.lit(0).cast("long")).otherwise(let(let(word_hashes, windows), settled))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts and ratios per document, beside its id and the whole input row as `row`."""
    t, ws, lines = F.col("_t"), F.col("_w"), F.col("_l")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"), whole(text).alias("_t"))
    split = rows.select(
        "doc_id", "row", "_t", words(t).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    counted = split.select(
        "doc_id", "row",
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        F.size(F.filter(ws, lambda w: w.isin(*STOP_WORDS, *map(str.capitalize, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
    )
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        "*",
        (100 * per_word("n_repeat_words")).alias("repeat_percent"),
        per_word("word_chars").alias("mean_word_chars"),
        per_word("n_symbols").alias("symbol_ratio"),
        per_word("n_stop_words").alias("stop_ratio"),
        per_word("n_letter_words").alias("letter_word_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_ratio"),
    )


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`measured` with base_failed, kept and the names of the broken rules."""
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | r.broken()
    names = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in (*base, *rules)]))
    table = measured(docs, doc_id, text).select("*", base_failed.alias("base_failed"), names.alias("broken_rules"))
    return table.withColumn("kept", F.size("broken_rules") == 0)


def passing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that break no rule.

    The verdict passes through a generator of one row: a filter on it would be moved below the projections, and every
    measure worked out again wherever a rule names it."""
    verdict = F.inline(F.array(F.struct(F.col("kept").alias("_kept"))))
    return judged(docs, doc_id, text).select("row", verdict).where("_kept").select("row.*")
