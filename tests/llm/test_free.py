"""Decontamination, language-model scoring, quality, n-gram join and language id on small tables."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.brute import best_tiles, jaccard_components, shingle_set
from trailmark.llm import decontaminate, language_id, ngram_join, pseudo_likelihood, quality
from trailmark.llm.common import held_out, learnable

DOCS = "doc_id long, text string, lang string, set long, size long, score double, token long"
VOCABULARY = [f"w{i}" for i in range(400)]


def documents(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, 1, 2, 0.5, 3) for i, t in rows], DOCS).repartition(3)


# ------------------------------------------------------------------ decontamination


def test_tiles_match_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        item, doc = rng.integers(0, 4, rng.integers(1, 25)), rng.integers(0, 4, rng.integers(1, 50))
        tiles = decontaminate.tiles_of(item, doc, 3)
        for i, d, n in tiles:
            assert n >= 3 and (item[i : i + n] == doc[d : d + n]).all() and (item[i : i + n] > 0).all()
        assert len({k for i, _, n in tiles for k in range(i, i + n)}) == sum(n for *_, n in tiles)
        lengths = [n for *_, n in tiles]
        assert lengths == sorted(lengths, reverse=True)
        assert sum(lengths) == best_tiles(list(item), list(doc), 3)


def test_repetitive_texts_are_tiled_in_time():
    start = time.perf_counter()
    same = lambda n: np.ones(n, np.int64)
    assert decontaminate.tiles_of(same(100), same(20_000)) == [(0, 0, 100)]
    assert decontaminate.tiles_of(same(1_000), same(1_000_000)) == [(0, 0, 1_000)]
    assert sum(n for *_, n in decontaminate.tiles_of(same(5_000), np.tile([1, 1, 1, 1, 1, 1, 1, 2], 3_000))) == 5_000 // 7 * 7
    turns = np.tile([1, 2, 3], 40_000)
    assert sum(n for *_, n in decontaminate.tiles_of(turns[1:3_001], turns)) == 3_000
    assert time.perf_counter() - start < 20


def test_item_ids_of_any_type(spark):
    text = " ".join(VOCABULARY[:30])
    bench = spark.createDataFrame([("a-1", text), (None, text), ("b", "other words here")], "item_id string, text string")
    found = decontaminate.find_leaks(documents(spark, [(1, "x " + text), (2, "y")]), bench).collect()
    assert sorted((r.doc_id, r.item_id or "") for r in found) == [(1, ""), (1, "a-1")]


def test_leaks(spark):
    rng = random.Random(3)
    item = rng.choices(VOCABULARY, k=40)
    other = rng.choices(VOCABULARY, k=30)
    noise = lambda n: rng.choices(VOCABULARY, k=n)
    text = " ".join
    moved = noise(20) + item[20:] + noise(5) + item[:20]
    rows = [
        (1, text(noise(30) + item + noise(9))),
        (2, text(moved).upper() + "."),
        (3, text(noise(3000) + item[:10] + noise(50))),
        (4, text(noise(60))),
        (5, None),
        (6, ""),
        (7, text(item + other + item)),
        (7, text(item)),
        (None, text(item)),
        (8, text(noise(200_000) + item)),
        (9, text(w for pair in zip(item, noise(40)) for w in pair)),
    ]
    bench = spark.createDataFrame([(10, text(item), "x"), (11, text(other), "y"), (12, None, ""), (13, "w1 w2", ""), (10, text(item), "x")], "item_id long, text string, doc_id string")
    docs = documents(spark, rows)
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(0, 10)] * 2 + [(1, 10)] * 2 + [(2, 10)] * 2 + [(7, 10)] * 4 + [(7, 11)] + [(8, 10)] * 2
    blocks = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.find_leaks(docs, bench, block_chars=100).collect())
    assert blocks == got
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


# ------------------------------------------------------------------ n-gram join


def near_copies(rng):
    rows = []
    for group in range(6):
        base = rng.choices(VOCABULARY, k=rng.randrange(8, 80))
        for _ in range(rng.randrange(1, 25)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append(" ".join(w))
    passage = rng.choices(VOCABULARY, k=30)
    rows += [" ".join(rng.choices(VOCABULARY, k=10) + passage + rng.choices(VOCABULARY, k=10)) for _ in range(40)]
    return rows


@pytest.mark.parametrize("n,percent,rounds", [(3, 90, 2), (5, 80, 2), (2, 60, 0)])
def test_components_match_brute_force(spark, monkeypatch, n, percent, rounds):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
    rng = random.Random(n)
    texts = near_copies(rng)
    texts += [texts[0].upper(), None, "", "  \n", "a", "A", "a b", "w1 w2 " * 4000, "w1\x0bw2 " * 4001]
    ids = [*range(1000, 1000 + len(texts))]
    rng.shuffle(ids)
    roots, sizes = jaccard_components(texts, n, percent)
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min(i, least.get(r, i))
    expected = sorted((i, s, least[r]) for i, s, r in zip(ids, sizes, roots))
    docs = documents(spark, zip(ids, texts))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, n, percent).collect())
    assert got == expected
    kept = ngram_join.keep_one(docs, n, percent)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in expected if i == c)


@pytest.mark.parametrize("n,percent,block", [(3, 90, 256), (5, 80, 4), (2, 60, 3)])
def test_links_match_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    texts = near_copies(random.Random(n)) + [None, "", "a b", "A b"]
    texts += texts[:5]
    sets = [shingle_set(t, n) for t in texts]
    similar = lambda a, b: a != b and 100 * len(a & b) >= percent * len(a | b)
    expected = [(i, sum(bool(s and o) and similar(s, o) for o in set(sets))) for i, s in enumerate(sets)]
    docs = documents(spark, enumerate(texts))
    assert sorted((r.doc_id, r.links) for r in ngram_join.similar_groups(docs, n, percent).collect()) == expected


def test_shuffled_filters_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x"), (None, None), (3, "y")]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in ngram_join.similar_groups(docs).collect()))
    assert got == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one(docs).collect()) == [(0, ""), (0, "x"), (1, "a b c d e f"), (1, "a b c d e f"), (3, "y")]
    assert ngram_join.similar_groups(docs.limit(0)).count() == 0


def test_prefix_lengths_never_lose_a_pair():
    for size in range(1, 60):
        for percent in (60, 80, 90):
            need = ngram_join.first_tokens(size, percent)
            assert 1 <= need <= size and 100 * (size - need + 1) >= percent * size > 100 * (size - need)


def test_shingles_count_like_sets():
    hashes = ngram_join.WordHashes()
    for text in ("a b c a b c a b c", "A b", "", "x  y\tz\x0bz", "é É e"):
        assert len(ngram_join.shingles(text.encode(), 3, hashes)) == len(shingle_set(text, 3))


# ------------------------------------------------------------------ classifiers


def good_text(rng):
    return " ".join(rng.choice(["the", "of", "and", "house", "river", "stone", "walks", "into"]) for _ in range(rng.randrange(20, 60))) + "."


def bad_text(rng):
    return " ".join(rng.choice(["BUY", "NOW!!", "$$$", "click", "###", "win"]) for _ in range(rng.randrange(20, 60)))


def test_quality(spark):
    rng = random.Random(8)
    rows = [(i, good_text(rng) if i % 3 else bad_text(rng)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0, "z") for i in range(600)] + [(5, 1, 0, "z"), (9999, 0, 0, "z"), (3, None, None, None), (None, 1, 0, "")], "doc_id long, quality int, toxic int, text string")
    docs = documents(spark, rows + [(1000, None), (1001, ""), (None, "x"), (1002, "the " * 50_000)])
    model = quality.train(docs, labels)
    out = quality.rate(docs, model).withColumn("held", held_out(docs.doc_id, 3, 1)).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 for r in out)
    tested = [(r.score >= 0.5) == bool(r.doc_id % 3) for r in out if r.held and r.doc_id is not None and r.doc_id < 600]
    assert np.mean(tested) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 380 < kept.count() < 420
    assert quality.train(docs, labels) == model
    none = quality.train(docs.limit(0), labels)
    assert quality.rate(docs, none).count() == 604 and quality.rate(docs.limit(0), model).count() == 0


def prose(rng, words):
    return " ".join(rng.choice(words) for _ in range(rng.randrange(20, 200)))


def test_quality_of_long_texts_is_that_of_their_parts():
    rng = random.Random(5)
    both = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(3000)] for _ in range(2)]
    for share in (0.3, 0.7):
        sample = [(int(rng.random() < share), i) for i in range(900)]
        model = quality.fit([(q, prose(rng, both[q])) for q, _ in sample])
        features = model.features()
        score = lambda t: 1 / (1 + np.exp(-np.dot(features.of(t), model.weights)))
        for label in (0, 1):
            for length in (15_000, 300_000, 900_000):
                text = ""
                while len(text) < length:
                    text += prose(rng, both[label]) + " "
                assert (score(text) > 0.9) if label else (score(text) < 0.1)


def test_quality_calibrates_on_long_texts(spark):
    rows = [(i, "word%d " % (i % 7) * 4000) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    model = quality.train(documents(spark, rows), labels)
    assert model.weights != quality.fit([]).weights


def test_quality_learns_from_its_fold_only(spark):
    docs = documents(spark, [(i, good_text(random.Random(i))) for i in range(60)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    fold = {r.doc_id for r in docs.filter(learnable(docs.doc_id, 3, 1)).collect()}
    changed = docs.rdd.map(lambda r: (r.doc_id, r.text if r.doc_id in fold else "other")).toDF(["doc_id", "text"])
    assert quality.train(docs, labels) == quality.train(changed, labels)


def test_language(spark):
    rng = random.Random(9)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["stra", "übe", "cht"], "cc": ["дом", "ка", "сы"]}
    texts = [(i, lang, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 40)))) for i, lang in enumerate(rng.choices(list(parts), k=300))]
    rows = [(i, t, lang) for i, lang, t in texts] + [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "aa"), (903, "kalo", None), (None, "kalo", "aa"), (904, "Kalomi 77 " * 20_000, None)]
    docs = spark.createDataFrame([(i, t, g, "s") for i, t, g in rows], "doc_id long, text string, lang string, source string").repartition(3)
    model = language_id.train(docs)
    assert model.languages == ("aa", "bb", "cc")
    out = docs.select("doc_id", "lang", language_id.predict(model, docs.text).alias("p"), held_out(docs.doc_id, 5, 0).alias("held")).collect()
    assert np.mean([r.p.lang_pred == r.lang for r in out if r.held and r.doc_id < 300]) > 0.97
    odd = {r.doc_id: r.p for r in out if r.doc_id is None or r.doc_id >= 900}
    assert [odd[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r.p.score <= 1 for r in out)
    none = language_id.train(docs.limit(0))
    assert {r.p.lang_pred for r in docs.select(language_id.predict(none, docs.text).alias("p")).collect()} == {"und"}


def test_language_learns_beyond_the_start_of_a_text():
    junk, rng = "kxq " * 1000, random.Random(2)
    said = {"aa": ["kalo", "mika", "loka"], "bb": ["stra", "bert", "echt"]}
    sample = [(lang, junk + " ".join(rng.choices(said[lang], k=300))) for lang in ("aa", "bb") * 20]
    model, letters = language_id.fit(sample), language_id.letter_table()
    for at, lang in enumerate(model.languages):
        z = model.logits(" ".join(said[lang] * 20), letters)
        assert z[at] - z[1 - at] > 2


def test_language_hashes_slices_as_a_whole(monkeypatch):
    letters = language_id.letter_table()
    table = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 2)).astype(np.float32)
    model = language_id.LanguageModel(("a", "b"), table, np.zeros(2), 1.0, 0.0)
    text = "abc déf ghi " * 50
    whole = language_id.buckets_of(language_id.codes_of(text, letters))
    assert np.allclose(model.logits(text, letters), table[whole].mean(axis=0), atol=1e-3)


# ------------------------------------------------------------------ language model


def test_words_are_counted_as_split_whatever_is_held(monkeypatch):
    texts = [b"a B b", None, b"", b"c\x0bc a", " é É a ".encode(), b"A"] * 3
    expected = Counter(w for t in texts for w in pseudo_likelihood.words_of(t))
    # words are not made one by one in Python
    monkeypatch.setattr(pseudo_likelihood, "words_of", None)
    for flush, size in ((1, 1), (5, 4), (400_000, 4 << 20)):
        monkeypatch.setattr(pseudo_likelihood, "FLUSH", flush)
        monkeypatch.setattr(pseudo_likelihood, "SLICE", size)
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["_text"])
        told = Counter()
        for counted in pseudo_likelihood._counted([batch, batch.slice(0, 0)]):
            for word, count in zip(*(c.to_pylist() for c in counted.columns)):
                told[word] += count
        assert told == expected
    assert not list(pseudo_likelihood._counted([]))


def test_a_task_passes_a_rare_word_on_once_for_many_places():
    model = pseudo_likelihood.WindowModel((b"a",), pseudo_likelihood.first_weights([1], 2))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([7, 8]), pa.array([b"x y " * 400_000, b"y x a"])], ["row", "doc_id", "_text"])
    told = pa.Table.from_batches(pseudo_likelihood._scored(model, pa.int64())([batch])).to_pylist()
    assert sorted((r["word"], len(r["rows"]), sum(r["rows"])) for r in told if r["word"]) == [(b"x", 400_001, 1), (b"y", 400_001, 1)]


def test_a_step_of_any_size_is_the_mean_gradient():
    rng = np.random.default_rng(4)
    flat = rng.normal(0, 0.3, sum(int(np.prod(s)) for s in pseudo_likelihood.SHAPES))
    around, target = rng.integers(0, pseudo_likelihood.TOKENS, (4, 8)), rng.integers(0, pseudo_likelihood.TOKENS, 8)
    eight, twentyfour = flat.copy(), flat.copy()
    pseudo_likelihood.learn(pseudo_likelihood.unpacked(eight), around, target, 0.05)
    pseudo_likelihood.learn(pseudo_likelihood.unpacked(twentyfour), np.tile(around, 3), np.tile(target, 3), 0.05)
    assert np.abs(eight - flat).max() > 1e-4 and np.allclose(eight, twentyfour, rtol=0, atol=1e-12)


def test_pseudo_likelihood(spark):
    rng = random.Random(6)
    fixed = [" ".join("the cat sat on a mat by the door".split() * 20) for _ in range(150)]
    rows = list(enumerate(fixed)) + [(500, None), (501, ""), (None, "the cat"), (502, " ".join(rng.sample("the cat sat on a mat by the door".split() * 20, 180))), (503, "zzz " * 30_000)]
    docs = documents(spark, rows)
    out = {r.doc_id: r for r in pseudo_likelihood.score_documents(docs).collect()}
    assert len(out) == len(rows)
    assert (out[500].n_tokens, out[500].log_prob, out[500].mean_log_prob) == (0, 0.0, None) and out[503].n_tokens == 30_000
    assert out[0].mean_log_prob > out[502].mean_log_prob + 0.2
    assert pseudo_likelihood.score_documents(docs.limit(0)).count() == 0


def test_rounds_train_on_every_token_once():
    texts = [" ".join(VOCABULARY[:n]) for n in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["_text"])
    flat, seen = pseudo_likelihood.first_weights([], 0), 0
    for turn in range(pseudo_likelihood.ROUNDS):
        for told in pseudo_likelihood._trained((), flat, turn)([batch]):
            seen += told.column("tokens")[0].as_py()
    assert seen == sum(range(20))


def test_every_word_has_its_own_probability(spark, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "PLACES", 50)
    bucket = lambda w: zlib.crc32(w.encode()) % pseudo_likelihood.RARE
    one = "rare0"
    two = next(w for w in (f"rare{i}" for i in range(1, 5000)) if bucket(w) == bucket(one))
    frequent = [f"f{i}" for i in range(pseudo_likelihood.WORDS)]
    rows = [(i, " ".join(frequent * 10)) for i in range(4)] + [(10, f"f0 {one} f1"), (11, f"f0 {two} f1"), (12, f"{one} " * 4 + f"{two} x"), (None, f"f0 {two} f1"), (11, f"{two}")]
    out = {r.doc_id: r for r in pseudo_likelihood.score_documents(documents(spark, rows[:-1])).collect()}
    assert abs(out[10].log_prob - out[11].log_prob - np.log(5 / 3)) < 1e-4
    assert abs(out[11].log_prob - out[None].log_prob) < 1e-4
    counts = pseudo_likelihood.word_counts(documents(spark, rows))
    shares = {bytes(r.word).decode(): np.exp(r.within) for r in pseudo_likelihood.within_buckets(counts, tuple(f.encode() for f in frequent)).collect()}
    of = {b: sum(p for w, p in shares.items() if bucket(w) == b) for b in map(bucket, shares)}
    assert shares.keys() == {one, two, "x"} and all(abs(p - 1) < 1e-9 for p in of.values())


def test_scores_are_sums_of_conditionals():
    rng = np.random.default_rng(2)
    flat = rng.normal(0, 0.3, sum(int(np.prod(s)) for s in pseudo_likelihood.SHAPES)).astype(np.float32)
    model, tokens = pseudo_likelihood.WindowModel((b"a", b"b"), flat), pseudo_likelihood.TokenIds((b"a", b"b"))
    table, shift, output, bias = (p.astype(float) for p in pseudo_likelihood.unpacked(flat))
    ids = list(pseudo_likelihood.ids_of(b"a b c A b", tokens))
    total = 0.0
    for t, target in enumerate(ids):
        at = [ids[t + o] if 0 <= t + o < len(ids) else pseudo_likelihood.EDGE for o in pseudo_likelihood.OFFSETS]
        z = np.tanh(sum(table[k][a] for k, a in enumerate(at)) + shift) @ output + bias
        total += z[target] - np.log(np.exp(z).sum())
    count, got = model.log_probability(b"a b c A b", tokens, pseudo_likelihood.unpacked(flat))
    assert count == 5 and abs(got - total) < 1e-3


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(3)
    flat = rng.normal(0, 0.3, sum(int(np.prod(s)) for s in pseudo_likelihood.SHAPES))
    around, target = rng.integers(0, pseudo_likelihood.TOKENS, (4, 30)), rng.integers(0, pseudo_likelihood.TOKENS, 30)
    loss = lambda: -pseudo_likelihood.forward(pseudo_likelihood.unpacked(flat), around)[1][np.arange(30), target].mean()
    before = loss()
    pseudo_likelihood.learn(pseudo_likelihood.unpacked(flat), around, target, 0.05)
    assert loss() < before


def test_texts_in_slices_have_the_tokens_and_scores_of_single_texts(monkeypatch):
    looked_up = []
    monkeypatch.setattr(pseudo_likelihood.zlib, "crc32", lambda w, crc32=zlib.crc32: looked_up.append(w) or crc32(w))
    texts = [None, b"", b" \t\n ", b"  A b\x0bB\xc3\x84 \xff c ", b"rare " * 900, b"\x1c a\x85b", None, b"c rare a"]
    words, owners = pseudo_likelihood.split_words(pa.array(texts, pa.binary()))
    assert [(o, w) for o, w in zip(owners.tolist(), words.to_pylist())] == [(i, w) for i, t in enumerate(texts) for w in pseudo_likelihood.words_of(t)]
    ids = pseudo_likelihood.token_ids(words, pseudo_likelihood.TokenIds((b"a", b"b")))
    assert looked_up.count(b"rare") == 1
    assert ids.tolist() == [i for t in texts for i in pseudo_likelihood.ids_of(t, pseudo_likelihood.TokenIds((b"a", b"b")))]

    rng = np.random.default_rng(2)
    flat = rng.normal(0, 0.3, sum(int(np.prod(s)) for s in pseudo_likelihood.SHAPES)).astype(np.float32)
    model, kind = pseudo_likelihood.WindowModel((b"a", b"b"), flat), pa.int64()
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), kind), pa.array(range(8), kind), pa.array(texts, pa.binary())], ["row", "doc_id", "_text"])
    single = [model.log_probability(t, pseudo_likelihood.TokenIds(model.words), pseudo_likelihood.unpacked(flat)) for t in texts]
    trained = list(pseudo_likelihood._trained(model.words, flat, 0)([batch.select(["_text"])]))[0].column("weights").to_pylist()
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(pseudo_likelihood, "SLICE", size)
        told = pa.Table.from_batches(pseudo_likelihood._scored(model, kind)([batch]))
        scores = [r for r in told.to_pylist() if r["word"] is None]
        assert [r["n_tokens"] for r in scores] == [n for n, _ in single] and np.allclose([r["log_prob"] for r in scores], [p for _, p in single])
        rare = sorted((r["word"], row) for r in told.to_pylist() if r["word"] is not None for row in r["rows"])
        assert rare == sorted((w, i) for i, t in enumerate(texts) for w in pseudo_likelihood.words_of(t) if w not in model.words)
        again = list(pseudo_likelihood._trained(model.words, flat, 0)([batch.select(["_text"])]))[0].column("weights").to_pylist()
        assert again == trained
