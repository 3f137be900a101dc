"""Resampling, language identification and the prefix trie against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from autostat.llm import language, lm, resample, trie

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text):
    w = WORD.findall(lower(text))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def resampled(rows, target, least=20, percent=5):
    of = [(i, *features(t)) for i, t in rows]
    s, t = (collections.Counter(bucket(f) for _, fs, _ in x for f in fs) for x in (of, [(0, *features(t)) for t in target]))
    scale = lambda b: (t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000))
    out = []
    for i, fs, n in of:
        weight = sum(math.floor(1000 * math.log(scale(bucket(f)))) for f in fs)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    large = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k for k, r in enumerate(large[: percent * len(large) // 100], 1)}
    return [(*r, ranks.get(id(r))) for r in out]


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_resampling(spark, odd_docs, no_docs):
    target = ["word1 word2 word3 word4", None, "ab ab\xe9", "x" * 300]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = resample.resampled(odd_docs, table, percent=60)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert plain(got.collect()) == plain(resampled(rows, target, percent=60))
    assert resample.resampled(no_docs, table).count() == 0
    nothing = resample.resampled(odd_docs, table.where("false"), percent=60).collect()
    assert plain(nothing) == plain(resampled(rows, [], percent=60))


def test_long_words_and_texts(monkeypatch):
    texts = [" ".join(f"{'a' * (i % 150)}{i}" for i in range(5000)), "", "b" * 100_000 + " c", None, "\xe9" * 63 + " " + "z" * 64]
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", 700)
    counts = resample.counted(*resample.words(pa.array(texts)))
    for text, row in zip(texts, counts, strict=True):
        assert {b: n for b, n in enumerate(row.tolist()) if n} == collections.Counter(map(bucket, features(text)[0]))


def test_planes_give_exact_weights():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (70, resample.BUCKETS)) * rng.integers(0, 2, (70, 1)) ** 3
    counts[3, 17] = 100_003
    gain = rng.integers(-9000, 4000, resample.BUCKETS)
    planes = pa.array(resample.planes_of(counts), pa.binary())
    assert (resample.weights_of(planes, *resample.gain_planes(gain)) == counts @ gain).all()
    assert (resample.weights_of(planes, *resample.gain_planes(np.zeros(resample.BUCKETS, np.int64))) == 0).all()


def test_ranks_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("doc_id"), (F.col("id") % 37).alias("score"))
    want = {r["doc_id"]: k for k, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["score"], r["doc_id"])), 1)}
    got = {r["doc_id"]: r["rank"] for r in resample.ranked(rows, 3000).collect()}
    assert got == {i: k if k <= 3000 else None for i, k in want.items()}


@pytest.fixture(scope="session")
def learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, language.train(docs.where(~lm.held_out("doc_id", 4, 2)))


def test_languages_held_out(spark, learned):
    docs, model = learned
    found = language.predicted(model, docs).join(docs.select("doc_id", "lang"), "doc_id").where(lm.held_out("doc_id", 4, 2)).collect()
    assert len(found) > 30 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def word_grams(text):
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        marked = f"_{word}_"
        yield from word
        for n in (2, 3, 4):
            yield from (marked[i : i + n] for i in range(len(marked) - n + 1))


def test_languages_by_exact_sets(learned):
    """The filters answer like exact sets, but for their false positives; corrected shares agree."""
    docs, model = learned
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    seen = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and text and lang:
            seen[lang].update(word_grams(text))
    rate = {name: {g: n / sum(c.values()) for g, n in c.items()} for name, c in seen.items()}
    top = collections.Counter()
    for r in rate.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    known = {name: {g for g, x in r.items() if x >= language.LEAST_RATE and x >= language.LEAST_SHARE * top[g]} for name, r in rate.items()}
    assert model.filters[0].names == sorted(known)
    for i, text, _ in rows[:60]:
        grams = list(word_grams(text))
        want = [sum(g in known[name] for g in grams) / max(len(grams), 1) for name in sorted(known)]
        assert model.filters[0].shares(language.grams(pa.array([text])))[0] == pytest.approx(want, abs=0.01)


def test_filter_answers():
    rng = np.random.default_rng(2)
    keys, masks = rng.integers(0, 2**63, 4000).astype(np.uint64), rng.integers(1, 2**5, 4000).astype(np.uint64)
    table = language.LanguageFilter(list("abcde"), keys, masks)
    assert (table.masks(keys) & masks == masks).all()
    other = table.masks(rng.integers(0, 2**63, 100_000).astype(np.uint64))
    for i in range(5):
        assert np.mean(other >> np.uint64(i) & np.uint64(1)) == pytest.approx(table.false[i], rel=0.3, abs=2e-4)


def test_languages_odd(spark, odd_docs, no_docs, learned, monkeypatch):
    got = {r["doc_id"]: r for r in language.predicted(learned[1], odd_docs).collect()}
    assert len(got) == 14 and [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert all(got[i]["lang_pred"] in {"de", "en", "es", "fr"} for i in (4, 9, 11))
    assert language.predicted(learned[1], no_docs).count() == 0
    untaught = language.train(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.predicted(untaught, odd_docs).collect()} == {"und"}
    # More languages than one filter holds, each with letters of its own.
    monkeypatch.setattr(language, "SLICE", 3)
    rows = [(i, chr(ord("a") + i) * 3 + " \n" + chr(ord("a") + i) * 2, f"l{i:02}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.filters) == 4
    assert {r["doc_id"]: r["lang_pred"] for r in language.predicted(model, docs).collect()} == {i: name for i, _, name in rows}


def nodes(rows, rebuild=True):
    logged = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            logged[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in logged.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        turns = {c: turns.get(c - int(math.fmod(c, 20)), [])[: h[c]] + ts[h[c] :] for c, ts in turns.items()}
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved, out = {}, {}, []
    for path, m in sorted(members.items(), key=lambda x: -len(x[0])):
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        n_words = len([w for w in re.split(r"[\x20\x09-\x0D]+", path[-1][1]) if w]) if path else 0
        saved[path] = (len(m) - 1) * n_words + sum(saved[x] for x in children[path])
        ends = ",".join(str(c) for c in m if len(turns[c]) == len(path))
        out.append((m[0], len(path), members[path[:-1]][0] if path else None, len(m), len(children[path]), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def trie_of(df, **kw):
    return sorted(map(tuple, trie.prefix_trie(df, **kw).collect()), key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string, n long, block string"


def random_turns(seed):
    r = random.Random(seed)
    rows = {}
    for c in [*range(-3, 60), 10**12]:
        for _ in range(r.randint(1, 12)):
            turn = r.choice([None, *range(30)])
            rows[c, turn] = (c if c < 55 else None, turn, r.choice(["u", "a", None]), r.choice(["a b", "c", "", "d e f", None]))
    return list({(x[0], x[1]): x for x in rows.values()}.values())


@pytest.mark.parametrize(("block", "chunk"), [(4096, 256), (4, 2), (64, 3)])
def test_trie(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    long = [(c, t, "u", "x y" if t < 20 else str(c % 3)) for c in range(30) for t in range(21 + c % 4)]
    repeated = [(5, 1, "u", "a"), (7, 1, "u", "a"), (None, 1, "u", "a")] * 5
    for rows in (random_turns(1), long, repeated):
        table = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
        assert trie_of(table) == nodes(rows)
        assert trie_of(table, rebuild=False) == nodes(rows, rebuild=False)


def test_trie_without_conversations(spark):
    none = spark.createDataFrame([(None, 1, "u", "a", 1, "x")], TURNS)
    assert trie_of(none) == [] and trie_of(none.where("false")) == []


def test_trie_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert trie_of(table) == nodes(rows)
