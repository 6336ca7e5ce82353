"""Toxicity, language, language model, packing, join and decontamination: brute force, round trips, held-out accuracy."""

import collections
import gc
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from lumenframe.llm import attention, decontamination, jaccard, language, packing, scoring, toxicity
from lumenframe.llm.common import fold, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(t.translate({i: i + 32 for i in range(65, 91)}))


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "some words here", "s"), (3, "...", "s"), (3, "...", "s")], "doc_id long, text string, score string")


def test_toxicity(spark, odd):
    rng = random.Random(2)
    clean = ["".join(rng.choice(["lo", "ra", "mi", "tu", "ne"]) for _ in range(3)) for _ in range(200)]
    text = lambda bad: " ".join([rng.choice(clean) for _ in range(rng.choice([20, 200]))] + [rng.choice(["vilescum", "vilescumer", "rottenpig"])] * bad)
    rows = [(i, text(i % 2), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows[300:]]) > 0.95
    unseen = toxicity.score(spark.createDataFrame([(0, "loramitu vilescummy ne")], "doc_id long, text string"), model).first()
    assert unseen.toxicity > 0.5
    assert toxicity.score(odd, model).count() == 5 and toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.query(docs.where("false"), labels).count() == 0 and toxicity.fit(docs, labels.where("false")).bias < 0


def test_language(spark, odd):
    docs = table(spark, SF, "documents")
    rows = language.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    model = language.fit(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd, model).collect()]
    assert [x[1] for x in got if x[0] in (1, 2, 3)] == ["und"] * 4 and all(0 <= x[2] <= 1 for x in got)
    assert language.identify(odd, language.train([])).where("lang_pred <> 'und'").count() == 0


def test_language_of_texts_without_letters_and_of_unseen_scripts():
    model = language.train([("fr", "bonjour le monde"), ("de", "guten tag")])
    assert [language.predict([t], model)[0] for t in ("½ ²", "①", "12", "", None)] == [("und", 0.0)] * 5
    assert language.predict(["日本"], model) == [("de", 0.5)] and language.words("x½Y_z") == ["x", "y", "z"]


def test_language_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 7))) for _ in range(30)), k) for i in range(60) for k, a in [(["en", "xx"][i % 2], ["abcde", "cdefg"][i % 2])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = collections.defaultdict(collections.Counter)
    for _, t, lang in rows:
        counts[lang].update(t.split())
    kinds = [{g: collections.Counter({w: c for w, c in x.items() if c >= 2}) for g, x in counts.items()}]
    for n in language.ORDERS:
        grams = {}
        for g, x in kinds[0].items():
            grams[g] = collections.Counter()
            for w, c in x.items():
                m = f"<{w}>" if n > 1 else w
                for i in range(len(m) - n + 1):
                    grams[g][m[i : i + n]] += c
        kinds.append(grams)

    def log(kind, key, g):
        return math.log((kind[g][key] + 0.5) / (sum(kind[g].values()) + 0.5 * len(set().union(*kind.values()))))

    def score(word, g):
        if any(word in x for x in kinds[0].values()):
            return log(kinds[0], word, g)
        for n, kind in zip(language.ORDERS, kinds[1:]):
            m = f"<{word}>" if n > 1 else word
            known = [m[i : i + n] for i in range(len(m) - n + 1) if any(m[i : i + n] in x for x in kind.values())]
            if known:
                return sum(log(kind, k, g) for k in known) / len(known)
        return 0.0

    texts = ["abc ccde zz", "gfgf cdc", "ddd", "long " * 30_000]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), language.fit(docs, sample=10**6)).collect()}
    for i, t in enumerate(texts):
        total = {g: sum(score(w, g) for w in t.split()) for g in ("en", "xx")}
        assert got[i].lang_pred == max(total, key=total.get)
        assert got[i].score == pytest.approx(1 / sum(math.exp(max(v - max(total.values()), -700)) for v in total.values()), rel=1e-3)


def test_backoff_takes_the_longest_known_grams():
    model = language.train([("a", "abcdef abcdef"), ("b", "uvwxyz")])
    assert (model.vector("abcdef") == model.logs[model.tables[0]["abcdef"]]).all()
    long = model.vector("xabcde")
    assert np.allclose(long, model.logs[[model.tables[1]["abcde"]]].mean(0))


def test_decontamination(spark):
    rng = random.Random(1)
    vocabulary = ["a", "b", "c", "é1"]
    made = lambda sizes: " ".join(rng.choice(vocabulary) for _ in range(rng.choice(sizes)))
    docs = [(i, made([0, 1, 3, 30, 200])) for i in range(80)] + [(90, "A-b C"), (91, "ab " * 300), (92, None)]
    items = [(i, made([0, 2, 5, 12, 20])) for i in range(12)] + [(50, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in docs:
        w, hit, found = words(t or ""), set(), set()
        for k, it in items:
            iw = words(it or "")
            n = min(10, len(iw))
            windows = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if iw else set()
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found.add(str(k))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontamination.contamination(d, b).collect()}
    assert got == want
    unnamed = spark.createDataFrame([(None, vocabulary[0] + " zz yy"), (None, None)], "item_id long, text string")
    found = decontamination.contamination(spark.createDataFrame([(1, "x A zz yy"), (1, "x A zz yy"), (None, None)], "doc_id long, text string"), unnamed).collect()
    assert sorted((str(r.doc_id), r.n_hit, r.n_items) for r in found) == [("1", 3, 1), ("1", 3, 1), ("None", 0, 0)]
    clashing = d.select("doc_id", "text", F.lit(1).alias("row"), F.lit("i").alias("items"), F.lit("i").alias("item_id"))
    assert decontamination.contamination(clashing, b.withColumn("doc_id", F.lit(1))).count() == len(docs) and decontamination.decontaminate(clashing, b).columns == clashing.columns
    long = spark.createDataFrame([(1, "p q " * 40_000 + " ".join(f"v{i}" for i in range(12)))], "doc_id long, text string")
    assert decontamination.contamination(long, spark.createDataFrame([(7, " ".join(f"v{i}" for i in range(12)))], "item_id long, text string")).first().n_hit == 12
    several = decontamination.find_matches(d, b, block_words=20).collect()  # one item or two in a block
    assert {r.doc_id: (r.n_words, sum(e - s for s, e in zip(r.starts, r.ends)), len(r["items"])) for r in several} == {k: v[:3] for k, v in want.items()}
    assert {r.doc_id for r in decontamination.decontaminate(d, b).collect()} == {k for k, v in want.items() if not v[1]}
    assert decontamination.contamination(d, b.where("false")).where("contaminated").count() == 0 and decontamination.contamination(d.where("false"), b).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 300):
        v = rng.integers(0, 3, n)
        assert decontamination.suffix_array(v).tolist() == sorted(range(n), key=lambda i: v[i:].tolist())


def brute_join(docs):
    sets = {}
    for d, t in docs:
        w = words(t or "")
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    group, links = {d: d for d in sets}, collections.Counter()
    def root(x):
        return x if group[x] == x else root(group[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {d: (root(d), links[d]) for d in sets}


def test_join(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(25):
        words_ = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(rng.choice([1, 2, 5, 90 if g == 0 else 3])):
            copy = list(words_)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One, two!"), (1004, "...")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    want = brute_join(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()} == want
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {v[0] for v in want.values()}
    assert jaccard.join(docs.where("false")).count() == 0


def test_sets_are_passed_on_slice_by_slice(spark):
    rng = random.Random(14)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(9_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(9_000), "text_key": range(9_000), "text": texts})
    tracemalloc.start()
    sizes = [b.num_rows for b in jaccard.made_sets(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 9_000 and max(sizes) < 1_000 and peak < 100e6


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4_000)  # some ten sets
    rng = random.Random(9)
    base_ = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base_[: (k := rng.randrange(100))], f"x{i % 50}", *base_[k + 1 :]])) for i in range(90)] + [(None, " ".join(base_)), (200, "w " * 60_000)]
    want = brute_join([(d if d is not None else -1, t) for d, t in rows])
    got = {r.doc_id: r.n_links for r in jaccard.join(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, size int")).collect()}
    assert got == {d if d >= 0 else None: n for d, (_, n) in want.items()}


def test_recall_of_the_whole_small_table(spark):
    """Against all pairs of the smallest table: no link is lost."""
    docs = table(spark, SF, "documents")
    want = brute_join([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()} == want


def test_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g")] * 3 + [(None, "x y"), (2, "a b c d e f g")]
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == ["1", "None"]


def test_keep_one_tells_rows_by_id_and_text(spark):
    words_ = [f"w{i}" for i in range(60)]
    text, near, nearer = " ".join(words_), " ".join([*words_, "more"]), " ".join([*words_, "less"])
    other, third = "unlike anything else in here at all", "of no id and near to no other one"
    rows = [(1, text), (5, near), (5, other), (7, "p q r s t u v"), (7, "p q r s t u v."), (None, nearer), (None, third), (None, third + "!"), (None, "?"), (None, "!")]
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (1, text) in got and (5, other) in got and (5, near) not in got and (None, nearer) not in got
    assert sum(d == 7 for d, _ in got) == 1 and sum(t.startswith(third) for _, t in got) == 1 and len(got) == 6


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "word, " * 5000)], "doc_id long, text string"))
    rows = packing.query(docs).collect()
    encode = Tokenizer.from_file(packing.tokenizer_path())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for d in docs.collect():
        ids = encode.encode(d.text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(i, len(ids[i : i + 2048]), zlib.crc32(np.array(ids[i : i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    alone = sum(r.length == 2048 for r in rows)
    assert len(used) <= alone + math.ceil(sum(r.length for r in rows if r.length < 2048) / 2048) + 1
    assert packing.query(odd).count() == 5 and packing.query(odd.where("false")).count() == 0


def test_pools_are_mixed_until_waste_is_one_sequence(spark):
    rng = random.Random(12)
    parts = spark.createDataFrame([(i, rng.choice([2048, *range(20, 1500)])) for i in range(3000)], "doc_id long, length long")
    rows = packing.pack(parts, pool=1000).collect()
    used = collections.defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    assert all(sum(n for _, n in x) <= 2048 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in used.values())
    alone = sum(r.length == 2048 for r in rows)
    assert len(used) <= alone + math.ceil(sum(r.length for r in rows if r.length < 2048) / 2048) + 2


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    whole, parts = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    rng = random.Random(3)
    chars = [*"abAB.,!?'\"s t re-_…“×÷Äßñȩ́́ \n\n\t\r\x0b\x1c ΣςİI12٣½中😀<|>&﻿", "'s", "'ll", "don't"]
    for _ in range(1500):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(next(iter(parts.encode([t.encode()]))), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_encoder_of_many_texts_with_special_tokens_and_a_small_cache(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 40)
    whole, parts = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    rng = random.Random(77)
    chars = [*"abAB.,!?'\"s t re-_…×Äßñȩ́ \n\t\x1c ΣςİI12½中😀<|>&\x00", "'ll", "<|endoftext|>", "<|EndOfText|>", "word ", "Wort. ", "Öl, "]
    for _ in range(400):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        got = [np.frombuffer(x, "<u4").tolist() for x in parts.encode([t.encode() for t in texts])]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts], texts


def test_a_task_leaves_no_words_behind():
    texts = [f"word{i}a word{i}b".encode() for i in range(20_000)]
    list(packing.Encoder(packing.tokenizer_path()).encode([b"a word, and another"]))  # imports
    tracemalloc.start()
    for _ in packing.Encoder(packing.tokenizer_path()).encode(texts):
        pass
    gc.collect()
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert left < 1e6


def test_genetic_packing_improves_on_best_fit():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(300, 1100, 120)]
    start = len(packing.best_fit(list(range(len(sizes))), sizes, [], 2048))
    best = packing.evolve(sizes, [], 2048, 20, 6, 1)[0]
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and max(sum(sizes[i] for i in b) for b in best) <= 2048
    assert math.ceil(sum(sizes) / 2048) <= len(best) <= start


def test_scoring(spark):
    docs = table(spark, SF, "documents")
    rows = scoring.query(docs).collect()
    texts = {r.doc_id: scoring.words((r.text or "").encode()) for r in docs.collect()}
    counts = collections.Counter()
    for d, w in texts.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update([*w, b""])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*texts[r.doc_id], b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score < 0


def test_trained_scores_beat_the_base_and_the_prior(spark, monkeypatch):
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    held = lambda: {r.doc_id: (r.score, r.base_score) for r in scoring.query(docs).where("held_out").collect()}
    trained = held()
    monkeypatch.setattr(attention, "train", lambda p, *a, **k: {n: np.zeros_like(x) for n, x in p.items()})
    prior = held()
    total = lambda x, i: sum(v[i] for v in x.values())
    assert total(trained, 0) > 0.99 * total(trained, 1) and total(trained, 0) > 0.97 * total(prior, 0), (total(trained, 0), total(prior, 0), total(trained, 1))


def test_scoring_of_odd_rows(spark, odd):
    assert scoring.query(odd).count() == 5 and scoring.query(odd.where("false")).count() == 0


def test_scoring_trains_on_all_documents_and_its_table_grows(spark):
    processor = scoring.tokenizer(None)
    some = [w for i in range(processor.get_piece_size()) if (w := processor.id_to_piece(i))[0] == "\u2581" and re.fullmatch("[a-z]{3,}", w[1:])][:1500]
    some = [w[1:] for w in some]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample(some, len(some)))) for i in range(120)]
    docs = spark.createDataFrame([*rows, (120, None)], "doc_id long, text string").repartition(3)
    model = scoring.fit(docs, scoring.word_counts(docs).cache())
    assert model.trained == sum(len(processor.encode(w)) for _, t in rows for w in t.split()) + 121
    assert model.vocabulary.size > 1500 and (model.vocabulary.compact[[processor.encode(w)[0] for w in some]] < model.vocabulary.size).all()


def test_pairs_across_words_are_counted(spark):
    processor = scoring.tokenizer(None)
    texts = ["good day to all", "", "day to day", "good"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    want = collections.Counter()
    for t in texts:
        ids = [processor.encode(w) for w in t.split()]
        want.update(zip([-1, *[x[-1] for x in ids]], [*[x[0] for x in ids], -1]))
    got = scoring.joints(docs, None).groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    assert {(r.a, r.b): r.n for r in got} == want


def test_attention_probabilities_sum_to_one_and_match_gradients():
    counts = np.array([50, 40, 30, 20, 10, 5, 1, 0], np.int64)
    vocabulary = attention.Vocabulary(counts, 3, size=2 * attention.MEMBERS)
    rng = np.random.default_rng(0)
    prior = attention.Prior(vocabulary, rng.random((vocabulary.size + 2, vocabulary.size + 1)))
    p = attention.fresh(vocabulary)
    text = rng.integers(0, 8, 40).astype(np.int32)
    inputs, targets, valid, first, _, _ = attention.blocks_of([text], vocabulary)
    total = np.zeros(inputs.shape)
    for t in range(vocabulary.size + 1):
        total += np.exp(attention.Scorer(p, prior).log_probabilities(inputs, np.full_like(targets, t), first))
    assert np.allclose(total[valid], 1, atol=1e-4)
    # Causal: what comes later changes nothing before it.
    other = text.copy()
    other[30] = (other[30] + 1) % 8
    a = attention.Scorer(p, prior).log_probabilities(inputs, targets, first).ravel()
    i2, t2, _, f2, _, _ = attention.blocks_of([other], vocabulary)
    b = attention.Scorer(p, prior).log_probabilities(i2, t2, f2).ravel()
    assert np.allclose(a[:30], b[:30])
    g = attention.gradients(p, prior, inputs, targets, valid, first)
    loss = lambda q: -(attention.Scorer(q, prior).log_probabilities(inputs, targets, first) * valid).sum(dtype=np.float64) / valid.sum()
    for name in ("query", "value", "back", "mix", "classes"):
        at = tuple(rng.integers(0, k) for k in p[name].shape)
        up, down = {k: x.copy() for k, x in p.items()}, {k: x.copy() for k, x in p.items()}
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(g[name][at], abs=2e-3)


def test_gradients_of_all_parameters_and_steps_on_one_vector():
    rng = np.random.default_rng(6)
    vocabulary = attention.Vocabulary(np.arange(1, 101)[::-1], 3, size=2 * attention.MEMBERS)
    prior = attention.Prior(vocabulary, rng.random((vocabulary.size + 2, vocabulary.size + 1)))
    p = attention.fresh(vocabulary)
    texts = [vocabulary.compact[rng.integers(0, 100, n)] for n in (0, 1, 70, 33)]
    inputs, targets, valid, first, _, _ = attention.blocks_of(texts, vocabulary)
    vector = attention.packed(p)
    views = attention.unpacked(vector, p)
    assert all(np.shares_memory(x, vector) and np.array_equal(x, p[k]) for k, x in views.items())
    g = attention.packed(attention.gradients(p, prior, inputs, targets, valid, first))
    loss = lambda q: -(attention.Scorer(q, prior).log_probabilities(inputs, targets, first) * valid).sum(dtype=np.float64) / valid.sum()
    for name in p:
        part = attention.unpacked(g, p)[name]
        at = np.unravel_index(np.argmax(np.abs(part)), part.shape)
        before, change = views[name][at], []
        for way in (1e-2, -1e-2):
            views[name][at] = before + np.float32(way)
            change.append(loss(views))
        views[name][at] = before
        assert (change[0] - change[1]) / 2e-2 == pytest.approx(part[at], rel=0.05, abs=1e-4), name
    # A step has the size of the rate times the sign of the gradient at first; the given parameters stay.
    start = {k: x.copy() for k, x in p.items()}
    ids = [x for x in texts if len(x) == 70]
    trained = attention.train(p, prior, ids, vocabulary, 1, 0.1)
    own = attention.gradients(p, prior, *attention.blocks_of(ids, vocabulary)[:4])
    for k in p:
        assert np.array_equal(p[k], start[k])
        sure = np.abs(own[k]) > 1e-3
        assert np.allclose((trained[k] - p[k])[sure], -0.1 / 20 / 2 * np.sign(own[k])[sure], rtol=0.02), k


def test_long_text_scores_like_its_parts_in_chunks():
    vocabulary = attention.Vocabulary(np.arange(1, 41)[::-1], 2, size=2 * attention.MEMBERS)
    prior = attention.Prior(vocabulary, np.ones((vocabulary.size + 2, vocabulary.size + 1)))
    p = attention.fresh(vocabulary)
    text = np.random.default_rng(2).integers(0, 40, attention.BLOCK * (attention.NARROW * 2 + 3)).astype(np.int32)
    inputs, targets, _, first, _, _ = attention.blocks_of([text], vocabulary)
    whole = attention.Scorer(p, prior).log_probabilities(inputs, targets, first)
    alone = attention.Scorer(p, prior)._output(attention.Scorer(p, prior).hidden(inputs, first, None), inputs.ravel(), targets.ravel()).reshape(whole.shape)
    assert np.allclose(whole, alone, atol=1e-3)
