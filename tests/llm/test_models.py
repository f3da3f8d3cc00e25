"""Classifiers, language model and near-duplicate classes: edge cases, held-out accuracy, brute force."""

import collections
import math
import pickle
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex

from millrace.llm import byte_bpe, language_id, lm_score, ngram_jaccard, quality, toxicity
from millrace.llm._components import components
from millrace.llm._common import Scratch

SF = "/root/testdata/sf0.01"
EN, FR = ["the cat sat on the mat and the dog", "this is that and those were there"], ["le chat est sur le tapis et le chien", "ceci est cela et ceux sont dans la"]


@pytest.fixture(scope="module")
def model():
    return language_id.Model.fit(EN * 4 + FR * 4, ["en"] * 8 + ["fr"] * 8)


def test_language_of_known_and_unseen_words(model):
    lang, score = model.predict(["the dog sat", "le chien est", "thatch", "", "123 ...", None or "", "the " * 300_000])
    assert lang[:2] == ["en", "fr"] and lang[3:6] == ["und"] * 3 and score[3:6] == [0.0] * 3 and lang[6] == "en"
    assert all(0 <= s <= 1 for s in score)


def test_language_without_labels():
    assert language_id.Model.fit([], []).predict(["abc"]) == (["und"], [0.0])


def test_language_held_out(spark):
    made = language_id.query(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = made[made.held_out].merge(docs, on="doc_id")
    assert len(made) == len(docs) and (held.lang == held.lang_pred).mean() > 0.97
    assert made.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in made.doc_id]


def test_identify_with_clashing_columns(spark, model):
    df = spark.createDataFrame([(1, "the dog", "x", 0.5, True), (2, None, "y", 0.1, False), (2, "le chat", "y", 0.1, False)], "doc_id long, text string, lang_pred string, score double, held_out boolean")
    made = language_id.identify(df, model, carry=tuple(df.columns)).collect()
    assert [(r.row.c0, r.row.c2, r.lang) for r in sorted(made, key=lambda r: (r.row.c0, r.row.c1 or ""))] == [(1, "x", "en"), (2, "y", "und"), (2, "y", "fr")]


CLEAN = [f"a fine calm day number {'abcdefghij'[i % 10]} by the river" for i in range(240)]
BAD = [f"you vileword {'abcdefghij'[i % 10]} by the river" for i in range(120)]


@pytest.fixture(scope="module")
def toxic():
    fair = [f"a vileword museum {'abcdefghij'[i % 10]}" for i in range(6)]
    labels = np.array([0] * 246 + [1] * 120)
    return toxicity.fit(CLEAN + fair + BAD, labels, {0: 246, 1: 120})


def test_toxicity_folds_lookalikes(toxic):
    score = toxic.score(["what vileword", "what V1L3W0RD", "what vilеwоrd", "what vilewords!", "a calm day", "", "fill " * 200_000 + "vileword"])
    assert all(s >= toxicity.THRESHOLD for s in score[:4]) and score[4] < toxicity.THRESHOLD and score[5] < toxicity.THRESHOLD
    assert score[6] < score[0]


def test_toxicity_exceptions(toxic):
    assert " vileword museum " in toxic.phrases
    assert toxic.score(["a vileword museum c"])[0] < toxicity.THRESHOLD


def test_toxicity_learns_short_words_whole():
    fair = [f"a zug museum {'abcdefghij'[i % 10]}" for i in range(6)]
    bad = [f"you {w} {'abcdefghij'[i % 10]} by the river" for w in ("zug", "坏人", "坏") for i in range(60)]
    model = toxicity.fit(CLEAN + fair + bad, np.array([0] * 246 + [1] * 180), {0: 246, 1: 180})
    score = model.score(["what zug", "what 坏人", "what 坏", "what zugabe", "what 坏人们", "a zug museum c"])
    assert {" zug ", " 坏人 ", " 坏 "} <= set(model.terms) and " zug museum " in model.phrases
    assert (score[:3] >= toxicity.THRESHOLD).all() and (score[3:] < toxicity.THRESHOLD).all()


def test_toxicity_of_one_label_only():
    assert toxicity.fit(["a"], np.array([0]), {0: 1}).score(["b"]).tolist() == [0.0]


def test_fold_keeps_numbers_apart():
    assert toxicity.fold(["It's 100 m4n! ÀB"])[0] == " it s man ab "


def test_quality_learns_noise():
    draw = np.random.default_rng(2)
    words = ["".join(draw.choice(list("abcdefghij"), 6)) for _ in range(200)]
    good = [" ".join(draw.choice(words, 40)) for _ in range(150)]
    noisy = [" ".join(f"{w}$$$" for w in draw.choice(words, 40)) for _ in range(40)] + [" ".join([w] * 40) for w in words[:20]]
    model = quality.fit(good + noisy, np.array([1] * 150 + [0] * 60), {1: 150, 0: 60})
    p = model.score([" ".join(draw.choice(words, 40)), f"{words[1]}$$$ {words[2]}$$$ {words[7]}$$$ " * 10, f"{words[150]} " * 40, "", "x " * 100_000])
    assert p[0] > quality.THRESHOLD > max(p[1], p[2]) and ((0 <= p) & (p <= 1)).all()


def test_quality_of_one_label_only():
    assert quality.fit(["a"], np.array([1]), {1: 1}).score(["b"]).tolist() == [1.0]
    assert quality.fit([], np.array([]), {}).score(["b"]).tolist() == [0.0]


def brute_scores(rows):
    count, ends = collections.Counter(), 0
    split = {i: (t or "").encode().lower().split() for i, t in rows}
    for i, w in split.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + (1 if ends else 0)
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    return {i: (len(w) + 1, sum(x in count for x in w) + (1 if ends else 0), n, sum(log(count[x]) for x in w) + log(ends)) for i, w in split.items()}


def test_lm_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "TOP", 6)
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on Mat{i % 5} the end") for i in range(40)] + [(100, None), (101, ""), (102, "unseen\tword ünseen"), (103, "the " * 3000)]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id long, text string, score double")
    got = lm_score.score_documents(df, P.path(byte_bpe.RANKS)).collect()
    expected = brute_scores(rows)
    assert len(got) == len(rows)
    for r in got:
        a = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == a[:3] and r.base_score == pytest.approx(a[3])
        assert r.score < 0 and math.isfinite(r.score)


def test_lm_scores_do_not_depend_on_what_is_shared(spark, monkeypatch):
    rows = [(i, f"the cat sat on mat{i % 5} by rare{i // 2} rare{i // 2} once{i}") for i in range(60)] + [(100, "never seen"), (101, "once3 once3 the rare4"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    for top in (1 << 18, 6, 0):
        monkeypatch.setattr(lm_score, "TOP", top)
        made.append({r.doc_id: r.score for r in lm_score.score_documents(df, P.path(byte_bpe.RANKS)).collect()})
    assert made[1] == pytest.approx(made[0], rel=1e-9) and made[2] == pytest.approx(made[0], rel=1e-9)


def test_lm_learns_from_long_texts_and_late_ids(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "TOKENS", 2000)
    draw = np.random.default_rng(5)
    cycle = ["red", "door", "blue", "house", "green", "tree"]
    train = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, " ".join(draw.choice(["a", "the", "of", "and"], 40))) for i in train[:300]]
    rows += [(i, " ".join(cycle * 2000)) for i in train[-40:]]
    rows += [(held[0], " ".join(cycle * 20)), *((i, " ".join(draw.permutation(cycle * 20))) for i in held[1:6])]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), P.path(byte_bpe.RANKS)).collect()}
    assert got[held[0]] > max(got[i] for i in held[1:6]) + 0.1


def test_lm_scores_held_out_texts_better_than_their_word_counts(spark):
    got = lm_score.query(spark, SF).toPandas()
    known = got[got.held_out & (got.n_known == got.n_tokens)]
    assert len(known) > 10 and known.score.sum() > known.base_score.sum()
    assert (got.score < 0).all()


def test_lm_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (5, None)], "doc_id long, text string")
    got = lm_score.score_documents(df, P.path(byte_bpe.RANKS)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 4, 4] and len({r.score for r in got if r.doc_id == 1}) == 1
    assert lm_score.score_documents(df.limit(0), P.path(byte_bpe.RANKS)).count() == 0


def test_lm_sums_around_ids_do_not_depend_on_their_parts():
    net, draw = lm_score.Network(50), np.random.default_rng(1)
    texts = [draw.integers(3, 50, n) for n in (1, 2, 3, 4, 200)]
    brute, index = np.zeros((50, lm_score.WIDTH)), net.index().astype(float)
    for x in texts:
        for i in range(len(x)):
            for j in range(max(0, i - 3), min(len(x), i + 4)):
                brute[x[i]] += index[x[j]] * (i != j)
    assert (net.around(texts) == brute).all() and (sum(net.around([x]) for x in texts) == brute).all()


def test_lm_classes():
    net, draw = lm_score.Network(400), np.random.default_rng(3)
    net.group(np.arange(400, 0, -1), draw.normal(0, 1, (400, lm_score.WIDTH)))
    assert len(set(net.kind[:96])) == 96 and not set(net.kind[:96]) & set(net.kind[96:]) and len(set(net.kind)) == 160


def test_lm_scores_every_id_once():
    net = lm_score.Network(60)
    draw = np.random.default_rng(0)
    net.shares(np.ones(60))
    texts = [draw.integers(3, 60, n) for n in (1, 15, 16, 17, 50)]
    together = net.logs(texts)
    assert len(together) == sum(map(len, texts))
    assert np.allclose(together, np.concatenate([net.logs([t]) for t in texts]), atol=1e-5)
    changed = [*texts[:-1], np.concatenate((texts[-1][:40], draw.integers(3, 60, 10)))]
    assert np.allclose(together[:-10], net.logs(changed)[:-10], atol=1e-5)


def test_lm_words_are_encoded_together_as_apart(monkeypatch):
    path = P.path(byte_bpe.RANKS)
    lm_score._words_table.cache_clear()
    table, size = lm_score._words_table(path)
    merges, pattern = byte_bpe.Merges(byte_bpe.read_ranks(path)), regex.compile(P.PATTERN)
    apart = lambda w: [i + 3 for x in pattern.findall(" " + w) for i in merges.encode(x.encode())]
    plain = ["can't", "\x1c", "\x00y", "日本語", "🎉🎉x", "e\u0301", "i\u0307stanbul", "'s", "\u0378z", "…!!", "12three", "\u200bq", "x" * 900]
    for words in (plain, plain + ["a\u00a0b", "\u00a0", "x\u00a0", "\x85"], plain + ["abc" * 1000], plain[:1]):
        ids, lengths = table.encoded(words)
        expected = [apart(w) for w in words]
        assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x] and ids.max() < size

    def slow(self, piece):
        raise AssertionError("words of usual length go through the library")

    monkeypatch.setattr(byte_bpe.Merges, "encode", slow)
    ids, words, sizes = lm_score._ids_of(["Never met words\tfollow", "", "À \u00a0 b"], path)
    assert [len(x) for x in sizes] == [5, 1, 4] and all(x[-1] == 0 for x in ids) and list(map(len, words)) == [4, 0, 3]


def test_lm_encodes_each_text_once(spark):
    rows = [(i, f"the cat sat on mat{i % 5} by rare{i}") for i in range(50)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(len(x))
            yield x

    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.score_documents(df.mapInPandas(counted, df.schema), P.path(byte_bpe.RANKS)).collect()
    assert len(got) == len(rows) and read.value <= 2 * len(rows)  # and once for the texts that the weights start from


def test_lm_texts_come_back_as_encoded():
    path = P.path(byte_bpe.RANKS)
    library = lm_score._words_table(path)[0].library
    texts = ["short One", "", "some words \u2003of a long\ttext " * 20_000, "é é last", "x" * 2000]
    made = lm_score.Encoded.read(lm_score.Encoded.of(texts, path).blobs())
    ids, size = made.texts()
    words = [t.encode().lower().decode().replace("\t", " ").split(" ") for t in texts]
    words = [[w for w in x if w] for x in words]
    known = {w: library.encode_ordinary(" " + w) for x in words for w in x}
    for got, expected in zip(ids, words, strict=True):
        assert got.tolist() == [i for w in expected for i in known[w]] + [lm_score.END]
    assert made.count.tolist() == [len(x) + 1 for x in words] and len(size) == made.count.sum()
    assert len(set(made.hashes().tolist())) == len(known) == len(made.size) - 1


def test_lm_scores_are_those_of_the_formula():
    net, draw = lm_score.Network(60), np.random.default_rng(4)
    net.shares(draw.integers(1, 9, 60))
    net.w = {k: draw.normal(0, 0.5, x.shape).astype(np.float32) for k, x in net.w.items()}
    w, wide = {k: x.astype(float) for k, x in net.w.items()}, lm_score.CONTEXT
    texts = [draw.integers(3, 60, n) for n in (1, 16, 50)]
    expected = []
    for text in texts:
        e = net.embed[np.append(lm_score.BOS, text)].astype(float)
        for i, y in enumerate(text):
            j = np.arange(max(0, i // wide * wide - wide + 1), i + 1)
            odds = np.exp((e[i] @ w["q"]) @ (e[j] @ w["k"]).T / np.sqrt(lm_score.WIDTH) + w["r"][i - j])
            z = np.exp(np.tanh(odds / odds.sum() @ (e[j] @ w["v"]) + e[i] @ w["u"]) @ w["c"] + w["b"])
            expected.append(np.log(z[net.kind[y]] / z.sum()) + net.share[y])
    assert np.allclose(net.logs(texts), expected, atol=1e-4)
    seen, target, _ = net.blocks(texts)
    assert np.allclose(lm_score.Steps(net).step(seen, target, 1e-9)[(target != lm_score.PAD).ravel()], expected, atol=1e-4)


def test_lm_steps_are_the_same_with_and_without_maxima(monkeypatch):
    draw = np.random.default_rng(7)
    texts = [draw.integers(3, 60, n) for n in (1, 15, 16, 17, 50, 700)]
    counts, made = np.bincount(np.concatenate(texts), minlength=60), []
    for safe in (lm_score.SAFE, -1.0):
        monkeypatch.setattr(lm_score, "SAFE", safe)
        net = lm_score.Network(60)
        net.classes(counts, texts)
        net.shares(counts)
        net.train(texts)
        made.append(net.logs(texts))
    assert np.allclose(made[0], made[1], atol=1e-4)


def test_lm_network_of_a_task_has_plain_types():
    net = pickle.loads(pickle.dumps(lm_score.Network(50)))
    assert all(x.dtype is np.dtype(x.dtype.type) for x in (net.embed, *net.w.values()))


def test_lm_gradient_lowers_loss(monkeypatch):
    monkeypatch.setattr(lm_score, "EPOCHS", 80)
    net = lm_score.Network(40)
    texts = [np.array([3, 4, 5, 6, 7] * 12) for _ in range(30)]
    net.classes(np.bincount(np.concatenate(texts), minlength=40), texts)
    net.shares(np.bincount(np.concatenate(texts), minlength=40))
    before = net.logs(texts).mean()
    net.train(texts)
    assert net.logs(texts).mean() > before + 3


def test_components(spark):
    draw = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in draw.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(12)] + [(200, 200 + i) for i in range(1, 30)]
    top = {}

    def root(i):
        top.setdefault(i, i)
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    made = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark))
    got = {r.node: r.component for r in made.collect()}
    assert got == {i: root(i) for i in top if any(i in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(4)), strict=False)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    draw = np.random.default_rng(6)
    words = np.array([f"v{i}" for i in range(3000)])
    rows, n = [], 0
    for size, copies, edits in ((120, 25, 2), (120, 25, 6), (40, 12, 1), (400, 10, 12), (9, 6, 1), (1, 3, 0), (3, 3, 0)):
        base = draw.choice(words, size)
        for _ in range(copies):
            made = base.copy()
            for k in draw.integers(0, size, edits):
                made[k] = draw.choice(words)
            if draw.random() < 0.3:
                made = made[: max(1, int(size * draw.uniform(0.8, 1)))]
            rows.append((n, " ".join(made)))
            n += 1
    passage = " ".join(draw.choice(words, 60))
    rows += [(n + i, f"{' '.join(draw.choice(words, 20))} {passage}") for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Same Words here now"), (904, "same words HERE\tnow"), (905, "É"), (906, "é"), (907, "rep " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(df).collect()}
    assert got == brute_classes(rows)
    kept = ngram_jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})


def test_near_duplicates_empty_table(spark):
    assert ngram_jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
