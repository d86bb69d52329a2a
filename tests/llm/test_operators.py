"""The ten operators against plain versions, with the awkward rows of every kind."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from sequora.llm import bpe_codec, common, embedding_dedup, language_id, pii, quality_model, quality_rules, simhash_dedup, source_mixing, suffix_dedup, token_counts, xxh

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and ation ing ther ould quick brown fox jumps over lazy dog again morning".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n))


def awkward():
    """Nulls in every column, empty and long texts, copies, near copies, ties, repeated rows."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace("fox", "cat", 1), None, None, None),
        (4, None, "en", "a", None), (5, "", "fr", "b", 0), (None, prose(2, 80), None, None, None), (None, base + " end", "en", "b", 3),
        (6, prose(3, 5000), "en", "b", 9), (7, prose(2, 80), "de", "c", 9), (8, "  \t\n\x0b ", "de", "c", 2), (9, "one two", "en", "c", 2),
        (10, "line a\nline a\n\n\nline b\nline a", "en", "c", 2), (11, "é😀 ß " * 40, "fr", "b", 2), (12, prose(4, 30) + " " + base[100:300] + " x", "en", "a", 2),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# -- shared pieces


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_xxh64(strings):
    import xxhash

    data, sizes = b"".join(strings), np.array([*map(len, strings)])
    got = xxh.xxh64(data, np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in strings]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 2000 + i) for i in range(50)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    want = brute.union(len(names), [(at[a], at[b]) for a, b in pairs])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: names[want[at[x]]] for x in linked if names[want[at[x]]] != x}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 mixing


def test_mixing_meets_budget_and_limits(spark):
    rows = [(i, "big", 10) for i in range(900)] + [(1000 + i, "mid", 7) for i in range(200)] + [(2000 + i, "small", 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    out = source_mixing.mixture(df, budget=10_460.0, max_repeats=4.0).cache()
    drawn = {r.source: (r.w, r.t, r.most, r.least) for r in out.groupBy("source").agg(F.max("weight").alias("w"), F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    assert sum(w for w, *_ in drawn.values()) == pytest.approx(1, abs=1e-6)
    for source, (w, t, most, least) in drawn.items():
        assert most <= 5 and most - least <= 1
        assert w * 10_460 - 11 <= t <= w * 10_460 + 1, source  # within a document of the quota
    assert out.count() == len(rows)
    again = source_mixing.mixture(df.repartition(7), budget=10_460.0)
    assert rows_of(out, "doc_id", "copies", "block") == rows_of(again, "doc_id", "copies", "block")


def test_mixing_without_budget_draws_all_at_least_once(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b", 5) for i in range(100)], "doc_id long, source string, n_tokens long")
    out = source_mixing.mixture(df, max_repeats=3.0)
    assert {r.source: r.m for r in out.groupBy("source").agg(F.min("copies").alias("m")).collect()}.keys() == {"a", "b"}
    assert out.agg(F.min("copies")).first()[0] >= 1 and out.where("source = 'a'").agg(F.max("copies")).first()[0] == 1
    assert source_mixing.draw(out, ["doc_id"]).count() == out.agg(F.sum("copies")).first()[0]


def test_mixing_exponent(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "s string, tokens long")
    p = np.array([0.9, 0.09, 0.01])
    h = lambda a: float(-(p**a / (p**a).sum() * np.log(p**a / (p**a).sum())).sum())
    a, _ = source_mixing.solve_exponent(totals, 0.5, 1e9, 1000.0)
    assert h(a) == pytest.approx(h(1) + 0.5 * (np.log(3) - h(1)), abs=1e-6)
    a, _ = source_mixing.solve_exponent(totals, 1.0, 4.0, 1000.0)
    w = p**a / (p**a).sum()
    assert (w * 1000 / (p * 1000)).max() == pytest.approx(4.0, abs=1e-5)


def test_mixing_awkward(docs, none):
    counted = docs.withColumns({"n_tokens": source_mixing.word_count(F.col("text")), "copies": F.lit("mine"), "weight": F.lit(1)})
    out = source_mixing.mixture(counted)
    assert out.count() == docs.count() and dict(out.dtypes)["copies"] == "bigint"
    assert source_mixing.mixture(none.withColumn("n_tokens", F.lit(1))).count() == 0


# -- 2 quality rules


def test_rule_counts(docs):
    got = rows_of(quality_rules.rule_counts(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute.rule_counts(t)) for i, t, *_ in awkward()), key=repr)


@given(st.lists(st.text(alphabet="ab \n\t#", max_size=60), min_size=1, max_size=8))
@settings(max_examples=15, deadline=None)
def test_rule_counts_of_any_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = rows_of(quality_rules.rule_counts(df), "i", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute.rule_counts(t)) for i, t in enumerate(texts)), key=repr)


def test_hosts(spark, docs, none):
    bad, good = "w " * 3, prose(5, 40)
    rows = [(i, bad if i < 95 else good, "x", "spam", 1) for i in range(100)] + [(100 + i, bad if i < 5 else good, "x", f"h{i % 10}", 1) for i in range(300)]
    out = quality_rules.apply_quality_rules(quality_rules.rule_failures(quality_rules.rule_counts(spark.createDataFrame(rows, DOCS))))
    by = {r.source: r for r in out.select("source", "host_failed", "host_rate").distinct().collect()}
    assert by["spam"].host_failed and not by["h0"].host_failed and by["spam"].host_rate < 0.95
    assert out.where("source = 'spam' AND kept").count() == 0 and out.where("source <> 'spam' AND kept").count() == 295
    clash = docs.withColumns({"n_words": F.lit("mine"), "kept": F.lit(1)})
    again = quality_rules.apply_quality_rules(quality_rules.rule_failures(quality_rules.rule_counts(clash)))
    assert again.count() == docs.count() and again.where("kept IS NULL").count() == 0
    assert quality_rules.apply_quality_rules(quality_rules.rule_failures(quality_rules.rule_counts(none))).count() == 0


# -- 3 SimHash


def test_simhash(docs, none):
    rows = [(i, t) for i, t, *_ in awkward()]
    assert rows_of(simhash_dedup.simhash_components(docs), "doc_id", "fingerprint", "component_id") == sorted(brute.simhash(rows), key=repr)
    assert simhash_dedup.simhash_components(none).count() == 0


@pytest.mark.parametrize("tile", [8, 512])
def test_simhash_links_of_a_dense_group(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    rng = random.Random(tile)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(60)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    found = common.components(simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    got = {r.node: r.root for r in found.collect()}
    want = brute.union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    mine = [got.get(f, f) for f in signed]
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want)))


def test_one_document_of_each_group_stays(docs, none):
    rows = [(i, t) for i, t, *_ in awkward()]
    comp = {c for *_, c in brute.simhash(rows)}
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == comp and kept.count() == len(comp)
    clash = docs.withColumn("fp", F.lit("mine"))
    assert {r.fp for r in simhash_dedup.drop_near_copies(clash).collect()} == {"mine"}
    assert simhash_dedup.drop_near_copies(none).count() == 0


# -- 4 language


def test_suffix_automaton():
    text = "abcbcabba"
    start = language_id.suffix_automaton(text)

    def has(s):
        state = start
        for c in s:
            if c not in state:
                return False
            state = state[c]
        return True

    parts = {text[i:j] for i in range(len(text)) for j in range(i, len(text) + 1)}
    assert all(has(s) for s in parts)
    assert not any(has(a + b) for a in parts for b in "abc" if a + b not in parts)


def plain_phrases(running, sample):
    n = at = 0
    while at < len(running):
        size = 1
        while at + size < len(running) and running[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_are_greedy_longest_matches():
    for sample in (" ab abc cab ", " zz bca ", ""):
        start = language_id.suffix_automaton(sample)
        for running in (" abc ", " cabab bca ab abc cab ab ", " qabq ", " z ", "", " bcabca zz bca zz "):
            assert language_id.phrases(start, running) == plain_phrases(running, sample), (running, sample)


def test_op4_query(spark, tmp_path):
    rng = random.Random(9)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    parts = {"aa": ["ka", "ro", "ti", "mu"], "bb": ["sch", "lö", "en", "ge"], "cc": ["Ж", "я", "ми"]}
    rows = [(i, make(parts[g], rng.randrange(1, 60)), g) for i in range(60) for g in [sorted(parts)[i % 3]]]
    rows += [(60, None, "aa"), (61, "²½ⅷ 12 !", "bb"), (62, "", None), (63, "karo " * 200_000, "aa"), (64, make(parts["bb"], 5), None), (5, "karo tiMU", "aa")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string, lang string")
    samples = language_id.sample_texts(learned, "lang", "text", 48, 40_000)
    out = language_id.op4_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.held_out == held(r.doc_id) for r in out)
    want = []
    for i, text, _ in rows:
        words = language_id.words_of(text or "")
        running = f" {' '.join(words)} "[:20_000]
        best = sorted((plain_phrases(running, samples[k]), k) for k in samples)
        want.append((i, best[0][1] if words else "und", round(1 - best[0][0] / best[1][0], 6) if words else 0.0))
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in out)
    assert [g for g in got if g[0] != 63] == sorted(w for w in want if w[0] != 63)
    assert [g[1] for g in got if g[0] in (60, 61, 62, 63)] == ["und", "und", "und", "aa"]


def test_too_many_languages_are_an_error(spark):
    df = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.identify(df, df, most_langs=8)


def test_languages(spark, docs, none):
    rng = random.Random(1)
    make = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(n))
    parts = {"aa": ["ka", "ro", "ti", "mu"], "bb": ["sch", "lö", "en", "ge"]}
    rows = [(i, make(parts[g], 40), g, "s", 1) for i in range(40) for g in parts]
    df = spark.createDataFrame(rows, DOCS)
    out = language_id.identify(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1"))
    assert out.where("lang = lang_pred AND score > 0").count() == 40
    odd = language_id.identify(docs.withColumn("score", F.lit("mine")), df)
    assert rows_of(odd.where("lang_pred = 'und'"), "doc_id") == [(4,), (5,), (8,)] and odd.count() == docs.count()
    assert language_id.identify(none, df).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def test_a_rare_script_beside_large_ones():
    rng = random.Random(5)
    make = lambda low, letters, n: " ".join("".join(chr(low + min(rng.randrange(letters), rng.randrange(letters))) for _ in range(4)) for _ in range(n))
    scripts = {"aa": (0x4E00, 3000, 4000), "bb": (0x61, 26, 4000), "cc": (0x0430, 32, 4000), "rare": (0x10D0, 30, 120)}
    samples = {k: make(*v) for k, v in scripts.items()} | {"rarer": make(0x3041, 1500, 400)}
    ident = language_id.Identifier(samples)
    for lang, (low, letters, _) in scripts.items():
        assert ident.predict([make(low, letters, 40)])[0] == [lang]
    for lang, sample in samples.items():  # a cut from a language's own sample
        assert ident.predict([sample[100:160]])[0] == [lang]


# -- 5 and 10 tokens


ODD = "".join(map(chr, [9, 10, 11, 13, 0x1C, 0x85, 0xA0, 0x2003, 0x3000])) + " 'sdtrevml09AZaé½²٣中😀́-_<|"


@given(st.lists(st.text(alphabet=ODD, max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_tokens_equal_the_libraries(texts):
    texts = [*texts, "".join(texts) + "<|endoftext|>" + "".join(texts)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_counts.counter().count(texts) == [len(own.encode(t, add_special_tokens=False)) for t in texts]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.read_ranks(), special_tokens={})
    codec = bpe_codec.codec()
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_runs_and_full_caches():
    texts = [c * n for c in "a-=0 \n" for n in (1, 63, 64, 65, 200, 5000)] + ["x1" * 3000, prose(9, 3000)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counter = token_counts.Counter()
    counter.cache.most = 10
    want = [len(own.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.count(texts) == want and counter.count(texts[::-1]) == want[::-1]


def test_token_tables(docs, none):
    rows = [(i, t or "") for i, t, *_ in awkward()]
    out = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("mine")))
    assert rows_of(out, "doc_id", "n_bytes") == sorted(((i, len(t.encode())) for i, t in rows), key=repr)
    assert out.where("over_limit <> (n_tokens > 512)").count() == 0 and token_counts.count_tokens(none).count() == 0


def test_codec_tables(docs, none):
    out = bpe_codec.decode_ids(bpe_codec.encode_texts(docs.withColumn("ids", F.lit("mine")), offsets=True))
    assert out.where("NOT coalesce(text, '') <=> decoded_text").count() == 0
    r = out.where("doc_id = 11").first()
    assert len(r.starts) == len(r.ids) and r.starts == sorted(r.starts) and r.starts[0] == 0
    trip = bpe_codec.round_trip(docs)
    assert trip.where("decoded_sha256 <> sha2(coalesce(text, ''), 256)").count() == 0
    assert bpe_codec.round_trip(none).count() == 0


def test_split_characters(spark):
    ids = np.frombuffer(bpe_codec.codec().encode(["😀"])[0], "<u4").tolist()
    df = spark.createDataFrame([(ids[:1],), (ids,), (None,), ([],)], "ids array<int>")
    got = [r.decoded_text for r in bpe_codec.decode_ids(df).collect()]
    assert got[1:] == ["😀", "", ""] and "�" in got[0]


# -- 6 suffixes


def test_removed_bytes(docs, none):
    rows = [(i, t) for i, t, *_ in awkward()]
    got = rows_of(suffix_dedup.remove_repeats(docs, chunk_bytes=2000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.removed(rows), key=repr)
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed,how", [(0, {}), (1, {}), (2, {"bucket_bytes": 1}), (3, {"split": 0}), (4, {"split": 3}), (5, {"split": 1, "bucket_bytes": 1})])
def test_removed_bytes_of_patched_texts(spark, seed, how):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab é") for _ in range(rng.choice([30, 49, 50, 51, 90, 200]))) for _ in range(12)] + ["a" * 130, "ab" * 70]
    rows = [(rng.randrange(40), "".join(rng.choice(pool) + rng.choice(["", "", "#", "q"]) for _ in range(rng.randrange(6)))) for _ in range(50)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=700, with_bytes=True, **how)
    got = rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.removed(rows), key=repr)


def test_removed_bytes_of_a_key_in_ever_new_contexts(spark):
    rng = random.Random(9)
    line = "-" * 20 + "permission is granted free of charge"
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, noise(rng.choice([5, 40])) + line + noise(rng.choice([0, 3, 40]))) for i in range(60)]
    rows += [(100 + i, rows[i][1][: 70 + i]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (2, 2000):
        got = rows_of(suffix_dedup.remove_repeats(df, chunk_bytes=400, split=split), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(brute.removed(rows), key=repr)
    data = " ".join(t for _, t in rows).encode()
    key = suffix_dedup.anchors(data, np.array([len(data)]))[0]
    assert np.unique(key, return_counts=True)[1].max() > 20  # one key in pieces of many texts


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("bucket_bytes,most", [(8_000_000, 2.2), (2000, 2.5)])
def test_bytes_that_removal_shuffles(spark, bucket_bytes, most):
    """Chunks are dealt once, keys are of four bytes, and chunks share rows when there are many buckets."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("0123456789abcdef") for _ in range(5000))) for i in range(200)]
    rows[150:] = [(i, t[:2000] + rows[i - 150][1][500:3000]) for i, t in rows[150:]]
    before = shuffled(spark)
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), chunk_bytes=50_000, bucket_bytes=bucket_bytes)
    assert 50 * 2500 <= out.agg(F.sum("n_removed")).first()[0] < 50 * 2510  # letters beside a passage may agree by chance
    assert shuffled(spark) - before < most * sum(len(t) for _, t in rows)


def test_blind_trie_and_multikey_sort():
    rng = random.Random(2)
    strings = ["".join(rng.choice("ab") for _ in range(18)).encode() for _ in range(40)]
    trie = suffix_dedup.BlindTrie()
    classes = [trie.add(s) for s in strings + strings[::-1]]
    assert len(set(zip(classes, strings + strings[::-1]))) == len(set(classes)) == len(set(strings))
    head = ["x" * 32, "y" * 32]
    texts = [(rng.choice(head) + rng.choice(["p" * 17, "p" * 16 + "q"]) + rng.choice("rs")).encode() for _ in range(60)]
    data, start = b"".join(texts) + bytes(8), np.arange(60) * 50
    label = suffix_dedup.equal_strings(data, start, np.zeros(60, np.int64))
    assert len(set(zip(label.tolist(), texts))) == len(set(label.tolist())) == len(set(texts))


# -- 7 embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 24))
    rows = [(int(i), [float(x) for x in centre[i % 6] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.2])]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 24), (203, [1.0, None] * 12), (204, [float("nan")] * 24), (205, [float("inf")] * 24), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (3, rows[3][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("mine"))
    got = rows_of(embedding_dedup.embedding_components(df, block_bytes=24 * 8 * 20), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(brute.cosine_links(rows), key=repr)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_bounds_hold_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = np.linalg.qr(np.c_[x[0], rng.normal(size=16)])[0][:, 1]
    y = np.array([c * x[0] + np.sqrt(1 - c * c) * t for c in np.linspace(0.9499, 0.9501, 41)])
    assert (embedding_dedup.linked(x, y, 0.95) == (np.einsum("id,jd->ij", x, y) >= 0.95)).all()


def test_tiles_in_slices(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS", 7)
    monkeypatch.setattr(embedding_dedup, "COLUMNS", 16)
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(9, 12)), 10, axis=0) + 0.12 * rng.normal(size=(90, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = rng.integers(1, 4, 90)
    yes = v @ v.T >= 0.95
    for parts in ([slice(0, 90)], [slice(0, 33), slice(33, 90)]):
        want = yes.copy()
        np.fill_diagonal(want, False)
        if len(parts) > 1:  # a tile of two blocks has the links between them only
            want[:33, :33] = want[33:, 33:] = False
        links, label = embedding_dedup.tile_links([v[p] for p in parts], [m[p] for p in parts], 0.95)
        assert (links == want @ m).all() and 0 < want.sum() < want.size
        assert label.tolist() == brute.union(90, list(zip(*np.nonzero(want))))


# -- 8 personal data

PII_ALPHABET = "a.@-+ 0123456789()%_é"


@given(st.text(alphabet=PII_ALPHABET, max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute.base_spans(text)


@given(st.lists(st.sampled_from(["0" * 5000, "9" * 5000, "1.2.3", ".4", "12", " ", "+1", "-", "@a.b", "0" * 300 + "7"]), max_size=8).map("".join))
@settings(max_examples=60, deadline=None)
def test_base_spans_of_long_runs(text):
    assert pii.base_spans(text) == brute.base_spans(text)
    pii.Field([]).more_spans(text, pii.base_spans(text))


def test_a_long_text_of_numbers_takes_linear_memory():
    import tracemalloc

    rng = random.Random(3)
    text = " ".join(str(rng.randrange(10 ** rng.randrange(2, 12))) for _ in range(140_000))  # 1 MB
    tracemalloc.start()
    pii.Field([]).more_spans(text, pii.base_spans(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(text)


def test_op8_query(spark, tmp_path):
    texts = [*sample(), None, "", "same 4111 1111 1111 1111", "same 4111 1111 1111 1111", "x " * 500_000 + "a@b.co", "0" * 6000 + ".1.2.3"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kinds = ["email", "ip", "card", "phone"]
    field = pii.fit_field(df)
    for r in pii.op8_pii(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        base = brute.base_spans(text)
        shown = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for *_, k in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest()
        assert r.spans == shown(sorted(base + field.more_spans(text, base), key=lambda s: (s[0], s[2])))


def test_base_spans_of_cards():
    for text in ("4111 1111 1111 1111", "x4111-1111-1111-1111y", "4111111111111112", "+1 (523) 555-1055 a@b.co 8.8.8.8 300.1.1.1 1.2.3.4.5"):
        assert pii.base_spans(text) == brute.base_spans(text)
    assert [k for *_, k in pii.base_spans("4111 1111 1111 1111")] == [2]


def sample():
    return [f"{prose(i, 20)} +1 (52{i % 10}) 555-10{i % 90:02d} and {i}@mail.example.com at 10.0.{i}.7 for {i} days {prose(i + 500, 9)}" for i in range(60)]


def test_field_finds_a_repeated_number_and_leaves_prose_alone():
    field = pii.Field(sample())
    text = "Call +1 (523) 555-1055 now. " + prose(1, 30) + " Again: 1 (523) 555-1055 or 15235551055. Year 2024, 2024-01-05, 17 of 40."
    base = pii.base_spans(text)
    more = [text[a:b] for a, b, _ in field.more_spans(text, base)]
    assert any("(523) 555-1055" in x for x in more)
    assert all("2024" not in x and x != "17" for x in more)
    assert field.more_spans(prose(8, 50) + " 12 3,000 v1.2", []) == []


def test_pii_tables(spark, docs, none):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sample())], "doc_id long, text string")
    out = pii.find_pii(df, mask=True)
    assert out.agg(F.min("n_email"), F.min("n_ip"), F.min("n_phone")).first()[:] == (1, 1, 1)
    r = out.where("doc_id = 5").first()
    assert "<PHONE>" in r.masked and "<EMAIL>" in r.masked and "<IP>" in r.masked and "555" not in r.masked
    assert pii.find_pii(docs.withColumn("spans", F.lit(1))).where("spans <> ''").count() == 0
    assert pii.find_pii(none).count() == 0


# -- 9 quality classifier


def test_classifier(spark, docs, none):
    rng = random.Random(6)
    good = [(i, prose(i, 60), 1) for i in range(200)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split()) if rng.random() < 0.5 else " ".join(w + "***" for w in prose(i, 60).split()), 0) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + junk], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + junk if i % 3] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality_model.fit_quality(df, labels)
    out = {r.doc_id: r for r in quality_model.score_quality(df, model).collect()}
    held = [(i, y) for i, _, y in good + junk if i % 3 == 0]
    assert sum(out[i].predicted == y for i, y in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    again = quality_model.score_quality(docs.withColumn("score", F.lit("mine")), model)
    assert again.count() == docs.count() and again.where("score IS NULL").count() == 0
    assert quality_model.score_quality(none, quality_model.fit_quality(none, labels)).count() == 0


# -- near copies of the pipeline


def similar_groups(texts):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return brute.union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])


@pytest.mark.parametrize("tile, few", [(8, 4), (256, 64)])
def test_near_copies_are_all_found(spark, monkeypatch, tile, few):
    from sequora.llm import near_copies

    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "FEW", few)
    rng, texts = random.Random(tile), []
    for k in range(25):  # edited copies on both sides of the threshold, below a line that all texts share
        base = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(rng.randrange(20, 300))]
        for edits in (0, 0, 1, 2, len(base) // 60, len(base) // 45, len(base) // 40, len(base) // 30):
            copy = list(base)
            for at in rng.sample(range(len(base)), edits):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append("this line is licensed to all who read it and more " * (k % 3) + " ".join(copy))
    want = similar_groups(texts)
    kept = near_copies.drop_near_copies(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert len(set(want)) < len({c for *_, c in brute.simhash([*enumerate(texts)])})  # what fingerprints leave
