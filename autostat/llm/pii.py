"""Personal data by weak supervision, in Spark expressions only.

1. Patterns propose spans. The four base patterns with their checks give base spans, which are always kept; failed
   matches and looser patterns give further candidates of the same and of two more kinds.
2. Six labelers vote on every candidate (+, - or 0 for no opinion): its format, gazetteers (domains, country codes,
   card issuers, names), cue words to its left that speak for or against it, what it touches, and its length.
3. Votes are counted by kind and pattern: at most 3^6 rows a kind, whatever the size of the corpus. On these counts
   expectation-maximisation estimates how reliable each labeler is and how likely each pattern is personal data.
4. A logistic span classifier is trained on counts of span shapes (bounded likewise), with the estimated
   probabilities as soft labels, and compiled into one expression that decides on candidates that are not base spans.

Positions come from splitting the text at the matches: pieces and matches alternate, and running sums of their lengths
are the starts (in code points, and in bytes for cutting). Texts are not shuffled. Regular expressions are written so
that no start is tried twice (look-behind, possessive repeats), so a long run of one class stays linear.

Defined results: a null or empty text has no spans; a repeated row repeats its result, and its candidates count again
in training; a null id stays; other columns are ignored; without candidates nothing is trained and base spans alone are
kept; candidates that overlap a base span are dropped; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.llm.text import let, total, whole
from autostat.sources.checkpoints import cut_lineage

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "person")
#: Characters of context that labelers see.
LEFT, RIGHT = 48, 8
LABELERS = 6
STEPS, EPOCHS = 60, 400

#: Gazetteers of the labelers.
DOMAINS = "com org net edu gov mil int info biz io de fr es it uk nl at ch be pt pl eu us ca au br mx jp cn in".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91".split()
FIRST_NAMES = "Anna Ana Maria Marie Paul Peter Pierre Jean John James Mary Robert Michael David Thomas Hans Karl Carlos Juan José Luis Sophie Julia Laura Daniel".split()
TITLES = r"Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login|adresse|dirección|from)",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|account)",
    "phone": r"(?i)(?:phone|tel\b|tel\.|call|mobile|cell|fax|telefon|téléphone|teléfono|móvil)",
    "secret": r"(?i)(?:token|secret|passw|api.?key|key\b|credential|bearer)",
    "person": r"(?i)(?:name|dear|regards|sincerely|signed|author|liebe|cher|querid)",
}
AGAINST = r"(?i)(?:version|\bv|isbn|issn|order|invoice|page|section|figure|build|release|sha|commit|checksum)[ .:#]*$"


@dataclass(frozen=True)
class Source:
    """A pattern that proposes spans of a kind; `base` says which matches are base spans."""

    kind: str
    pattern: str
    guard: str
    base: bool = False


LOCAL, HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
SOURCES = (
    Source("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++", "@", True),
    Source("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True),
    Source("card", r"[0-9](?:[ -]?[0-9])++", "", True),
    Source("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", True),
    Source("email", rf"(?<!{LOCAL}){LOCAL}++ ?(?:\[at\]|\(at\)) ?{HOST}++(?: ?(?:\.|\[dot\]|\(dot\)) ?{HOST}++)++", "at"),
    Source("card", r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", ""),
    Source("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", ""),
    Source("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+", ""),
    Source("person", rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?+", ""),
)

CANDIDATE = (
    "struct<start:bigint,rank:int,end:bigint,kind:string,first:bigint,last:bigint,base:boolean,votes:string,"
    "size:int,digits:int,before:int,after:int,cue:int>"
)


def running(values: Column, join: Callable[[Column, Column], Column], start: int, block: int = 256) -> Column:
    """All earlier elements joined by an associative `join`; blocks keep the work near linear."""
    empty, first = F.array().cast("array<bigint>"), F.lit(start).cast("long")

    def joined(part: Column, begin: Column) -> Column:
        state = F.struct(begin.cast("long").alias("s"), empty.alias("a"))
        step = lambda t, x: F.struct(join(t["s"], x).cast("long").alias("s"), F.array_append(t["a"], t["s"]).alias("a"))
        return F.aggregate(part, state, step, lambda t: t["a"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")),
                        lambda b: F.slice(values, b * block + 1, F.lit(block)))
    spread = lambda ps: let(
        joined(F.transform(ps, lambda p: F.aggregate(p, first, lambda x, y: join(x, y))), first),
        lambda starts: F.flatten(F.transform(ps, lambda p, i: joined(p, F.get(starts, i)))),
    )
    return F.when(F.size(values) == 0, empty).otherwise(let(parts, spread))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    plain, doubled = (F.regexp_replace(back, "(.)(.?)", g) for g in ("$1", "$2"))
    each = F.filter(F.split(F.concat(plain, F.translate(doubled, "0123456789", "0246813579")), ""), lambda x: x != "")
    return total(F.transform(each, lambda x: x.cast("int"))) % 10 == 0


def octets(text: Column) -> Column:
    """Four numbers of at most 255."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return text.rlike(rf"^(?:{part}\.){{3}}{part}$")


def checked(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    d = digits_of(m)
    return {"email": F.lit(True), "ip": octets(m), "card": F.length(d).between(14, 19) & luhn(d),
            "phone": F.length(d).between(10, 15)}[kind]


def vote(yes: Column, no: Column | None = None) -> Column:
    """+ or -, or 0 where neither holds."""
    return F.when(yes, "+").when(no if no is not None else ~yes, "-").otherwise("0")


def votes(kind: str, m: Column, left: Column, right: Column) -> Column:
    """The labelers' votes as one string."""
    d, n = digits_of(m), F.length(m)
    none = F.lit(False)
    shape = {
        "email": vote(m.rlike(r"^[A-Za-z0-9][^@]*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,24}$") | m.rlike("[(\\[]at[)\\]]")),
        "ip": vote(octets(m) & ~m.rlike(r"(?:^|\.)0[0-9]")),
        "card": vote(F.length(d).between(14, 19) & luhn(d)),
        "phone": vote(F.length(d).between(10, 15) & m.rlike(r"[ ().-]"), ~F.length(d).between(10, 15)),
        "secret": vote(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), ~m.rlike("[0-9]")),
        "person": vote(m.rlike(r" \S+ \S+$"), none),
    }[kind]
    listed = {
        "email": vote(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(*DOMAINS)),
        "ip": vote(m.rlike(r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\."), m.rlike(r"^0")),
        "card": vote(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"), ~d.rlike("^[2-6]")),
        "phone": vote(m.rlike(rf"^\+(?:{'|'.join(COUNTRY_CODES)})") | m.rlike(r"^\(?[2-9]"), none),
        "secret": vote(m.rlike("^(?:sk|pk|ghp|gho|AKIA|xox[abp])[-_A-Z0-9]"), none),
        "person": vote(m.rlike(rf" (?:{'|'.join(FIRST_NAMES)})(?: |$)"), none),
    }[kind]
    least, most = {"email": (6, 64), "ip": (7, 15), "card": (14, 23), "phone": (10, 20), "secret": (28, 128), "person": (5, 40)}[kind]
    open_ = r"[\s\"'(<\[:=]$"
    return F.concat(
        shape, listed, vote(left.rlike(CUES[kind]), none), F.when(left.rlike(AGAINST), "-").otherwise("0"),
        vote(((left == "") | left.rlike(open_)) & ((right == "") | right.rlike(r"^[\s\"')>\].,;:!?]")), left.rlike(r"\p{L}$") | right.rlike(r"^\p{L}")),
        vote(n.between(least, most)),
    )


def touching(text: Column, pattern_end: bool) -> Column:
    """0 nothing or space, 1 letter or digit, 2 closing or opening mark, 3 other."""
    at = "$" if pattern_end else "^"
    put = (lambda c: c + at) if pattern_end else (lambda c: at + c)
    return F.when((text == "") | text.rlike(put(r"\s")), 0).when(text.rlike(put(r"[\p{L}\p{N}]")), 1).when(
        text.rlike(put(r"[\"'()\[\]<>.,;:!?=]")), 2).otherwise(3)


def found(text: Column, source: Source) -> Column:
    """All leftmost non-overlapping matches of a pattern as candidates."""

    def one(m: Column, piece: Column, after: Column, start: Column, first: Column) -> Column:
        left, right = F.right(piece, F.lit(LEFT)), F.left(after, F.lit(RIGHT))
        share = F.length(digits_of(m)) / F.length(m)
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(source.kind)).alias("rank"), (start + F.length(m)).alias("end"),
            F.lit(source.kind).alias("kind"), first.alias("first"), (first + F.octet_length(m)).alias("last"),
            (checked(source.kind, m) if source.base else F.lit(False)).alias("base"),
            votes(source.kind, m, left, right).alias("votes"),
            F.least(F.floor(F.log2(F.length(m))), F.lit(7)).cast("int").alias("size"),
            F.floor(share * 4).cast("int").alias("digits"), touching(left, True).alias("before"),
            touching(right, False).alias("after"), left.rlike(CUES[source.kind]).cast("int").alias("cue"),
        )

    def listed(ms: Column, ps: Column, starts: Column, firsts: Column) -> Column:
        def at(m: Column, i: Column) -> Column:
            piece = F.get(ps, i)
            start, first = F.get(starts, i) + F.length(piece), F.get(firsts, i) + F.octet_length(piece)
            return one(m, piece, F.get(ps, i + 1), start, first)

        return F.transform(ms, at)

    def steps(ms: Column, ps: Column, size) -> Column:
        return running(F.transform(ms, lambda m, i: (size(m) + size(F.get(ps, i))).cast("long")), lambda x, y: x + y, 0)

    body = let(F.regexp_extract_all(text, F.lit(source.pattern), F.lit(0)), lambda ms: let(
        F.split(text, source.pattern, -1), lambda ps: let(steps(ms, ps, F.length), lambda starts: let(
            steps(ms, ps, F.octet_length), lambda firsts: listed(ms, ps, starts, firsts)))))
    may = text.rlike(source.pattern)
    may = F.contains(text, F.lit(source.guard)) & may if source.guard else may
    return F.when(may, body.cast(f"array<{CANDIDATE}>")).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def candidates(docs: DataFrame, text: str = "text", name: str = "candidates") -> DataFrame:
    """`docs` with a column of all candidates of each text, by start and kind; one for each kind, start and end."""
    body = whole(text)

    def once(c: Column) -> Column:
        # Of equal spans that several patterns find, the last in order: a base span, if one of them is.
        same = lambda x, y: (x["start"] == y["start"]) & (x["rank"] == y["rank"]) & (x["end"] == y["end"])
        return F.filter(c, lambda x, i: ~F.coalesce(same(x, F.get(c, i + 1)), F.lit(False)))

    return docs.withColumn(name, let(F.sort_array(F.concat(*[found(body, s) for s in SOURCES])), once))


@dataclass
class Classifier:
    """Log-odds of a span as a sum of weights by (kind, feature, value)."""

    weights: dict[str, float] = field(default_factory=dict)
    #: By kind: share of personal data, and P(vote | kind of span) of each labeler.
    reliabilities: dict[str, tuple[float, np.ndarray]] = field(default_factory=dict)

    def accepts(self, c: Column) -> Column:
        """Whether a candidate is personal data."""
        if not self.weights:
            return F.lit(False)
        table = F.create_map(*[F.lit(x) for pair in sorted(self.weights.items()) for x in pair])
        value = lambda f: F.concat_ws("|", c["kind"], F.lit(f), (c[f] if f != "kind" else F.lit("")).cast("string"))
        odds = [F.coalesce(F.try_element_at(table, value(f)), F.lit(0.0)) for f in FEATURES]
        return sum(odds[1:], odds[0]) > 0


FEATURES = ("kind", "size", "digits", "before", "after", "cue", "votes")
SIGNS = "+-0"


def reliabilities(patterns: list[str], counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation for one kind: P(personal | pattern), P(personal), P(vote | personal or not, labeler)."""
    code = np.array([[SIGNS.index(v) for v in p] for p in patterns])
    lean = (code == 0).sum(1) - (code == 1).sum(1)
    p = 1 / (1 + np.exp(-1.5 * (lean - 1.0)))
    # A labeler is taken to be right more often than not until the counts say otherwise.
    prior = np.array([[2.0, 4.0, 4.0], [4.0, 2.0, 4.0]])
    for _ in range(STEPS):
        share = (1 + (counts * p).sum()) / (2 + counts.sum())
        table = np.zeros((2, code.shape[1], 3))
        for y, q in enumerate((1 - p, p)):
            for j in range(code.shape[1]):
                t = np.bincount(code[:, j], weights=counts * q, minlength=3) + prior[y]
                table[y, j] = t / t.sum()
        like = np.log([1 - share, share])[:, None] + np.log(
            np.stack([[table[y, j, code[:, j]] for j in range(code.shape[1])] for y in (0, 1)])
        ).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    return p, share, table


def trained(found_: DataFrame, name: str = "candidates") -> Classifier:
    """Reliabilities and classifier from all candidates of a table of `candidates`."""
    each = found_.select(F.explode(name).alias("c")).select("c.*")
    shapes = each.groupBy("kind", "size", "digits", "before", "after", "cue", "votes").count().toPandas()
    if not len(shapes):
        return Classifier()
    out, soft = Classifier(), np.zeros(len(shapes))
    for kind, part in shapes.groupby("kind"):
        by_votes = part.groupby("votes")["count"].sum()
        p, share, table = reliabilities(list(by_votes.index), by_votes.to_numpy(float))
        out.reliabilities[kind] = share, table
        soft[part.index] = part["votes"].map(dict(zip(by_votes.index, p, strict=True)))
    values = [shapes["kind"] + f"|{f}|" + (shapes[f].astype(str) if f != "kind" else "") for f in FEATURES]
    names = sorted(set().union(*values))
    place = {v: i for i, v in enumerate(names)}
    x = np.zeros((len(shapes), len(names)))
    for v in values:
        x[np.arange(len(shapes)), v.map(place)] = 1
    weight = np.log1p(shapes["count"].to_numpy(float))
    weight /= weight.sum()
    w, step = np.zeros(len(names)), 8.0
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-x @ w))
        w -= step * (x.T @ (weight * (p - soft)) + 1e-4 * w)
    out.weights = dict(zip(names, w.tolist(), strict=True))
    return out


def spans(c: Column, model: Classifier) -> Column:
    """The candidates that are kept, by start and kind: base spans, and accepted ones that overlap none of them and lie
    in no other that starts earlier. Linear in the candidates: those before a candidate matter by their largest end, those
    after it by their smallest start."""
    zero, far = F.lit(0).cast("long"), 2**62
    last_end = lambda of: running(F.transform(c, lambda x: F.when(of(x), x["end"]).otherwise(zero)), F.greatest, 0)
    starts = F.reverse(F.transform(c, lambda x: F.when(x["base"], x["start"]).otherwise(F.lit(far))))

    def accepted(before: Column, after: Column) -> Column:
        clear = lambda x, i: (F.get(before, i) <= x["start"]) & (F.get(after, i) >= x["end"])
        return F.filter(c, lambda x, i: x["base"] | (model.accepts(x) & clear(x, i)))

    def outer(kept: Column) -> Column:
        ends = running(F.transform(kept, lambda x: x["end"]), F.greatest, 0)
        return let(ends, lambda e: F.filter(kept, lambda x, i: x["base"] | (F.get(e, i) < x["end"])))

    inside = let(last_end(lambda x: x["base"]), lambda before: let(
        F.reverse(running(starts, F.least, far)), lambda after: let(accepted(before, after), outer)))
    return F.when(F.size(c) == 0, c).otherwise(inside)


def tagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every text, trained on the texts themselves."""
    work = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut_lineage(candidates(work).select("doc_id", "candidates"))
    return rows.select("doc_id", spans(F.col("candidates"), trained(rows)).alias("spans"))


def cut_out(text: Column, kept: Column) -> Column:
    """The text with every stretch of spans replaced by the kind of its first span, as <EMAIL>."""
    data = text.cast("binary")
    stretch = "array<struct<first:bigint,last:bigint,kind:string>>"
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast(stretch).alias("out"))

    def step(state: Column, s: Column) -> Column:
        new = F.struct(state["upto"].alias("first"), s["first"].alias("last"), s["kind"].alias("kind"))
        out = F.when(s["first"] >= state["upto"], F.array_append(state["out"], new)).otherwise(state["out"])
        return F.struct(F.greatest(state["upto"], s["last"]).alias("upto"), out.alias("out"))

    def part(a: Column, b: Column) -> Column:
        return F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string")

    def joined(state: Column) -> Column:
        head = F.transform(state["out"], lambda s: F.concat(part(s["first"], s["last"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.concat(F.array_join(head, ""), part(state["upto"], F.octet_length(text).cast("long")))

    return F.when(F.size(kept) == 0, text).otherwise(let(F.aggregate(kept, start, step), joined))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with personal data cut out of the text. Texts are stored once beside their candidates, which serve for
    training and for cutting; nothing is shuffled."""
    name = "_candidates"
    while name in docs.columns:
        name = f"_{name}"
    marked = cut_lineage(candidates(docs, text, name))
    model = trained(marked, name)
    kept = let(spans(F.col(name), model), lambda s: cut_out(F.col(text), s))
    return marked.withColumn(text, F.when(F.size(name) == 0, F.col(text)).otherwise(kept)).select(*docs.columns)
