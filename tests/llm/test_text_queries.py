"""Queries against SQL or brute force on the smallest tables, and operators on odd rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from autostat.llm import bpe, conversations, fingerprints, jaccard, lm, mixing, pii, quality, repeats, warc
from autostat.llm.queries import ORACLE, QUERIES, TOKENIZER

SMALL = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="session")
def texts(spark):
    t = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").toPandas()
    return dict(sorted(zip(t.doc_id, t.text, strict=True)))


def result(spark, name):
    return QUERIES[name](spark, SMALL).toPandas().set_index("doc_id")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLE[name]).df()
    plain = lambda t: sorted(repr([None if pd.isna(v) else v for v in r]) for r in t[sorted(t.columns)].astype(object).values.tolist())
    number = lambda rows: [re.sub(r"(\d)\.0\b", r"\1", r) for r in rows]
    assert number(plain(ours)) == number(plain(theirs))


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        doubled = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 14 <= len(d) <= 19 and doubled % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(kind, m[0]))


def test_pii(spark, texts):
    r = result(spark, "op1_pii")
    for i, t in texts.items():
        found = base_spans(t)
        named = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in found]
        assert r.base_sha256[i] == sha(",".join(named).encode())
        assert set(named) <= set(r.spans[i].split(","))
        assert [r[f"n_{BASE[k][0]}"][i] for k in range(4)] == [sum(f[1] == k for f in found) for k in range(4)]


def test_redaction(spark):
    t = "mail é a.b@mail1.example.com, host 10.20.30.40; b@c.de_d@e.fr end"
    docs = spark.createDataFrame([(i, t, 5) for i in range(5)] + [(9, None, 6)], "doc_id long, text string, candidates int")
    rows = pii.redacted(docs).collect()
    assert rows[0]["text"] == "mail é <EMAIL>, host <IP>; <EMAIL><EMAIL> end"
    assert rows[5]["text"] is None and rows[0]["candidates"] == 5


def test_phones_without_hyphen(spark):
    numbers = ["(415) 555 0132", "415.555.0132", "415 555 0132", "(415) 555.0132", "415-555-0132"]
    docs = spark.createDataFrame([(i, f"call {n} now") for i, n in enumerate(numbers)], "doc_id long, text string")
    for r in pii.candidates(docs).collect():
        phones = [(c["start"], c["end"]) for c in r["candidates"] if c["kind"] == "phone"]
        assert phones == [(5, 5 + len(numbers[r["doc_id"]]))]


def components(sets):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in sets}


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(spark, texts):
    r = result(spark, "op2_ngram_jaccard")
    sets = {i: shingles(t) for i, t in texts.items()}
    assert {i: r.n_shingles[i] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id[i] for i in sets} == components(sets)


def test_jaccard_odd(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(odd_docs).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[None][1] is None
    assert [got[i][1] for i in (4, 5, 6, 10)] == [4] * 4 and got[8] == (1, 7)
    assert jaccard.joined(no_docs).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard.one_of_each(odd_docs).collect()) == sorted(map(str, [1, 2, 3, 4, 7, 9, 11, 12, 13, None]))


def test_repeats(spark, texts):
    r = result(spark, "op5_suffix_dedup")
    check_repeats(texts, lambda i: (r.n_bytes[i], r.n_removed[i], r.n_spans[i], r.kept_sha256[i]))


def check_repeats(texts, got):
    seen = set()
    for i, t in texts.items():
        b = (t or "").encode()
        windows = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        n = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        assert got(i) == (len(b), len(b) - len(kept), n, sha(kept)), i


def test_repeats_in_small_blocks(odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in repeats.without_repeats(docs, block_bytes=500).collect()}
    plain = dict(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    check_repeats(plain, lambda i: (rows[i]["n_bytes"], rows[i]["n_bytes"] - len(rows[i]["kept"]), len(rows[i]["spans"]), sha(bytes(rows[i]["kept"]))))
    assert repeats.without_repeats(odd_docs).count() == 15 and repeats.without_repeats(no_docs).count() == 0


def test_groups_of_digits_grow_with_the_blocks():
    assert [repeats.group_bits(n) for n in (0, 1, 68, 1024, 1025, 4096, 1 << 30)] == [8, 8, 8, 8, 9, 10, 16]
    digits = np.sort(np.random.default_rng(4).integers(0, 1 << 64, 3000, dtype=np.uint64))
    for bits in (8, 10, 16):
        t = repeats.sent(digits, bits)
        assert len(t) == len(set((digits >> np.uint64(64 - bits)).tolist())) and not len(repeats.sent(digits[:0], bits))
        back = np.concatenate([repeats.received(g, d, bits) for g, d in zip(t["group"], t["digits"], strict=True)])
        assert np.array_equal(back, repeats.cut_digits(digits, bits)) and len(set(back.tolist())) == 3000


def test_ranges_join_inside_one_text():
    ends = np.array([0, 5, 5, 9, 20])
    starts, stops = np.array([12, 7, 3, 1, 5, 10, 16]), np.array([14, 9, 5, 3, 6, 13, 18])
    joined, cuts = repeats.joined_up(starts, stops, ends)
    assert joined.tolist() == [[1, 5], [5, 6], [7, 9], [10, 14], [16, 18]] and cuts.tolist() == [0, 1, 1, 3, 5]
    none = np.empty(0, np.int64)
    assert repeats.joined_up(none, none, ends)[1].tolist() == [0] * 5


def test_digits_in_several_blocks_take_one_sort():
    rng = np.random.default_rng(3)
    few = [rng.integers(0, 40, n, dtype=np.uint64) for n in (0, 5, 1, 30, 0, 12)]
    times = collections.Counter(np.concatenate(few).tolist())
    assert [np.frombuffer(b, np.uint64).tolist() for b in repeats.in_several(few)] == [[x for x in f.tolist() if times[x] > 1] for f in few]
    pool = rng.integers(0, 1 << 56, 10**6, dtype=np.uint64)
    blocks = [rng.choice(pool, 2000) for _ in range(1000)]  # with a search for each block this takes minutes
    began = time.process_time()
    repeats.in_several(blocks)
    assert time.process_time() - began < 10


def test_scores(spark, texts):
    r = result(spark, "op6_lm_scoring")
    tokens = {i: [*words(t), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n = sum(c.values())
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in t)
        assert r.base_score[i] == pytest.approx(base, rel=1e-9) and r.held_out[i] == held[i]
        assert (r.n_tokens[i], r.n_known[i], r.train_tokens[i]) == (len(t), sum(c[w] > 0 for w in t), n)
    out = r[r.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_rare_words_are_joined(spark, texts, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    train = docs.where(~lm.held_out("doc_id"))
    few, all_ = (lm.scored(lm.train(train, capacity=c), docs).toPandas().set_index("doc_id") for c in (50, 1 << 20))
    assert (few.n_known - all_.n_known).abs().max() == 0
    assert (few.base_score - all_.base_score).abs().max() < 1e-6
    assert lm.scored(lm.train(no_docs), odd_docs).count() == 15


def test_scores_hold_every_pair(spark, texts, odd_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tokens = {i: [*words(t), b""] for i, t in texts.items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(t, t[1:]))
    n = sum(c.values())
    own = lambda w: (c[w] + 0.5) / (n + 0.5 * (len(c) + 1))
    level = lambda k: math.ceil(1.3 ** math.floor(math.log(k) / math.log(1.3))) if k else 0
    after = lambda u, w: (level(pairs[u, w]) + 20 * own(w)) / (c[u] + 20)
    scores = {i: sum(map(math.log10, [own(t[0]), *map(after, t, t[1:])])) for i, t in tokens.items()}
    for capacity in (50, 1000, 1 << 20):
        r = lm.scored(lm.train(docs.where(~lm.held_out("doc_id")), capacity=capacity), docs).toPandas().set_index("doc_id")
        assert all(r.score[i] == pytest.approx(scores[i], rel=0.02) for i in scores)
    assert lm.scored(lm.train(odd_docs, capacity=50), odd_docs).count() == 15


def test_rare_words_count_in_score(spark):
    docs = spark.createDataFrame([(i, "common " * 50 + f"rare{i % 40}") for i in range(120)], "doc_id long, text string")
    model = lm.train(docs, capacity=50)
    alone = spark.createDataFrame([(7, "rare7"), (8, "never")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lm.scored(model, alone).collect()}
    total = 120 * 52 + 0.5 * 43
    own, end = (3 + 0.5) / total, (120 + 0.5) / total
    assert score[7] == pytest.approx(math.log10(own) + math.log10((3 + 20 * end) / (3 + 20)), abs=1e-9)
    assert score[8] == pytest.approx(math.log10(0.5 / total) + math.log10(end), abs=1e-9)


def test_mixing(odd_docs, no_docs):
    row = lambda t: sorted((str(r["doc_id"]), r["copy"], r["shuffle_key"]) for r in t.collect())
    many = mixing.mixed(odd_docs, size=400)
    assert row(many) == row(mixing.mixed(odd_docs, size=400, broadcast_sources=0)) and 250 < many.count() < 550
    assert mixing.mixed(no_docs).count() == 0
    only = mixing.mixed(odd_docs, weights={"s1": 1.0}, size=200)
    assert {r["source"] for r in only.collect()} == {"s1"}


def test_bpe(spark, texts):
    r, tokenizer = result(spark, "op8_bpe"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens[i], r.ids_sha256[i], r.decoded_sha256[i]) == (len(ids), sha(packed), sha(decoded.encode()))


def test_bpe_streams_in_constant_memory(odd_docs):
    with open(TOKENIZER, "rb") as f:
        merges = bpe.Merges(f.read())
    data = b"abcdefgh" * 20_000
    transducer, ids = bpe.Transducer(merges), []
    for at in range(0, len(data), 1000):
        ids += transducer.feed(data[at : at + 1000])
        assert len(transducer.buffer) < 8 * merges.lookahead
    ids += transducer.finish()
    assert ids == Tokenizer.from_file(TOKENIZER).encode(data.decode()).ids
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(odd_docs, TOKENIZER), TOKENIZER).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in odd_docs.collect())
    steps = bpe.decoded(bpe.encoded(odd_docs, TOKENIZER), TOKENIZER)
    once = bpe.round_trip(odd_docs, TOKENIZER)
    assert once.columns == steps.columns and sorted(map(repr, once.collect())) == sorted(map(repr, steps.collect()))
    assert not bpe.round_trip(odd_docs.limit(0), TOKENIZER).collect()


def paragraphs(text):
    return {x for x in text.split("\n") if x.split()}


def test_fingerprints(spark, texts):
    r, ids = result(spark, "op9_fingerprints"), list(texts)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert (r.n_chars[i], r.edited_sha256[i]) == (len(own), sha(edited.encode()))
        assert r.near_edited[i] == pytest.approx(like(paragraphs(own), paragraphs(edited)))
        assert r.near_next[i] == pytest.approx(like(paragraphs(own), paragraphs(after)))


def test_fingerprints_odd(odd_docs, no_docs):
    rows = fingerprints.fingerprinted(fingerprints.versions(odd_docs)).collect()
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(r["fingerprint"])
    assert len(rows) == 15 and all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprinted(fingerprints.versions(no_docs)).count() == 0


def test_quality_odd(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in quality.judged(odd_docs).collect()}
    assert rows[1]["base_failed"] and rows[1]["n_words"] == 0 and rows[12]["n_repeat_words"] == 4000
    assert quality.judged(no_docs).count() == 0
    assert quality.passing(odd_docs).columns == odd_docs.columns


def test_snapshots(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", "bye"),
             (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "bye"), (4, None, None, None), (4, 9000, "user", "hi"),
             (5, 0, "user", "hi"), (5, 0, "user", "hi"), (None, 0, "user", "")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for r in sorted(conversations.rendered(table).collect(), key=lambda r: r["position"]):
        got[r["conv_id"]].append(r["segment"])
    assert set(got) == {2, 4, None} and len(got[2]) == 3 and got[4][0] == "<||>\n\n<|end|>\n"
    assert conversations.rendered(table.where("false")).count() == 0


def test_archives(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, "b c", "same"), (3, None, None), (4, "d", ""), (5, "e", "WARC/1.0\r\n\r\n\r\nx"), (None, "f", "same")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.archived(warc.resolved(warc.records(table)), str(tmp_path / "w"))
    rows = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert {i: (r["type"], r["refers_to"]) for i, r in rows.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2),
    }
    assert rows[5]["payload"] == pages[4][2] and rows[2]["uri"] == "b%20c"
    warc.archived(warc.resolved(warc.records(table.where("false"))), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).toPandas()
    judged = result(spark, "op3_quality_rules")
    kept = {i: t for i, t in texts.items() if judged.kept[i]}
    reps = {i for i, c in components({i: shingles(t) for i, t in kept.items()}).items() if i == c}
    assert set(rows.doc_id) <= reps and len(rows) > len(reps) / 2
    for r in rows.drop_duplicates("doc_id").itertuples():
        assert not any(k == 0 for _, k, _ in base_spans(r.text)), r.doc_id
        if not base_spans(texts[r.doc_id]) and "<" not in r.text:
            assert r.text == texts[r.doc_id]


def test_decoding_in_pieces(monkeypatch):
    """Texts that begin and end anywhere in a piece, characters cut by it, and empty texts."""
    with open(TOKENIZER, "rb") as f:
        data = f.read()
    encoder = bpe.Encoder(data, bpe.disputed())
    texts = ["", "é中\U0001f600" * 9, "", "plain words here", "x", "", "\U0001f680\U0001f680 end", ""]
    ids = [encoder.encode(t) for t in texts]
    broken = encoder.encode("中")[:4]  # a token that holds a part of a character
    for piece in (1, 2, 3, 7, 1 << 16):
        monkeypatch.setattr(bpe, "PIECE", piece)
        assert bpe.decode_all(encoder.merges, ids) == texts
        cut = bpe.decode_all(encoder.merges, [broken, *ids])
        assert cut[1:] == texts and cut[0] == Tokenizer.from_file(TOKENIZER).decode([int.from_bytes(broken, "little")])
    assert bpe.decode_all(encoder.merges, []) == [] and bpe.decode_all(encoder.merges, [b""]) == [""]


def test_words_stay_known(monkeypatch):
    with open(TOKENIZER, "rb") as f:
        words_ = bpe.Words(bpe.Merges(f.read()))
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    first = [words_[w] for w in "abcdefgh"]
    assert [words_[w] for w in "hgfedcba"] == first[::-1] and len(words_) <= 3 and len(words_.older) <= 3


def test_spans_once(spark):
    """A span that two patterns find is one candidate, and no kept span lies in another that starts before it."""
    t = "pay 4111 1111 1111 1112 or 4111 1111 1111 1111, call +1 415 555 0132 or 415 555 0132; key sk-abcdefghij1234567890abcd12"
    docs = spark.createDataFrame([(i, t) for i in range(40)] + [(99, None), (98, "")], "doc_id int, text string")
    for r in pii.candidates(docs).collect():
        found = [(c["kind"], c["start"], c["end"]) for c in r["candidates"]]
        assert len(found) == len(set(found))
    rows = {r["doc_id"]: r["spans"] for r in pii.tagged(docs).collect()}
    assert rows[98] == rows[99] == [] and rows[0]
    for a in rows[0]:
        assert a["base"] or not any(b["start"] <= a["start"] and a["end"] <= b["end"] for b in rows[0] if b != a)
        assert a["base"] or not any(b["base"] and b["start"] < a["end"] and a["start"] < b["end"] for b in rows[0])
    assert pii.tagged(docs.where("false")).collect() == []


def test_spans_grow_linearly(spark):
    """Twice the e-mails and failed addresses of one text take about twice the time, not four times."""
    import time

    model, seconds = pii.Classifier({"ip|kind|": 1.0}), []
    for n in (2000, 8000):
        text = " ".join(f"a{i}@b.cc 1.2.3.{300 + i % 9}" for i in range(n))
        found = pii.candidates(spark.createDataFrame([(text,)], "text string")).select("candidates").cache()
        assert found.select(F.size("candidates")).first()[0] > 2 * n
        start = time.perf_counter()
        assert found.select(F.size(pii.spans(F.col("candidates"), model))).first()[0] == 2 * n
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 8 * max(seconds[0], 1.0), seconds


def test_passing_measures_once(spark, odd_docs):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(quality.passing(odd_docs)).count("split(") == plan(quality.judged(odd_docs)).count("split(") == 2
    kept = quality.judged(odd_docs).where("kept").select("row.*").collect()
    assert sorted(map(repr, quality.passing(odd_docs).collect())) == sorted(map(repr, kept))


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Every stage takes null, empty and repeated rows, and no rows at all."""
    import corpus_pipeline

    documents = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.select(documents).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd_docs.collect()} and (name == "odd" or not rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs.select(documents), "").columns == documents


def test_words_of_latin_texts():
    """The written-out classes cut every mixture of Latin-1 characters like the pattern for all texts."""
    import random

    latin, every = bpe.word_patterns(bpe.disputed())
    rng, odd = random.Random(3), [*map(chr, (9, 10, 0x1C, 0x1F, 0x20, 0x20, 0x27, 0x2D, 0x30, 0x41, 0x73, 0x74, 0x85, 0xA0, 0xB2, 0xE9))]
    for _ in range(20_000):
        text = "".join(rng.choice(odd) if rng.random() < 0.8 else chr(rng.randrange(256)) for _ in range(9))
        assert latin.findall(text) == every.findall(text)


def test_stored_fingerprints_name_the_changed_paragraphs(spark):
    """Published texts are enough: they give the digests that differ and the likeness, for any sizes of both."""
    lines = lambda n, tag="line": [f"{tag} {i}" for i in range(n)]
    pairs = [([], []), ([], ["a"]), (["a", "a", " "], ["a"]), (lines(40), lines(40)[:-1] + ["new"]), (lines(9), lines(200)),
             (lines(300), lines(150) + lines(90, "other")), (lines(12), lines(12, "other"))]
    docs = spark.createDataFrame([("\n".join(a), "\n".join(b)) for a, b in pairs], "a string, b string")
    keyed = docs.select("a", "b", *[fingerprints.digests(F.col(c)).alias(f"d{c}") for c in "ab"])
    cut = keyed.select("*", *[fingerprints.published(fingerprints.sections(F.col(f"d{c}"))).alias(f"p{c}") for c in "ab"])
    read = cut.select("*", *[fingerprints.parsed(F.col(f"p{c}")).alias(f"s{c}") for c in "ab"])
    got = read.select("a", "b", "da", "db", fingerprints.changes(F.col("sa"), F.col("sb")).alias("d"), fingerprints.likeness(F.col("sa"), F.col("sb")).alias("near"))
    for r in got.collect():
        a, b = set(r["da"]), set(r["db"])
        assert {(x["k"], x["n"]) for x in r["d"]} == {(k, 1) for k in a - b} | {(k, -1) for k in b - a}
        assert len(r["d"]) == len(a ^ b)
        assert r["near"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_sections_that_cannot_be_peeled_list_their_digests(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RETRIES", 0)
    monkeypatch.setattr(fingerprints, "SECTION", 40)
    docs = spark.createDataFrame([(list(range(1, 40)), list(range(20, 90))), ([5], list(range(60)))], "a array<bigint>, b array<bigint>")
    cut = docs.select("a", "b", *[fingerprints.sections(F.col(c)).alias(f"s{c}") for c in "ab"])
    for r in cut.select("a", "b", "sa", "sb", fingerprints.likeness(F.col("sa"), F.col("sb")).alias("near")).collect():
        a, b = set(r["a"]), set(r["b"])
        assert any(s["size"] == 0 for s in [*r["sa"], *r["sb"]])
        assert r["near"] == pytest.approx(len(a & b) / len(a | b))
