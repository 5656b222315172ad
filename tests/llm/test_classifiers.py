import math
import random
import zlib

import numpy as np
import pytest

from quire.llm import language, toxicity
from quire.llm.ftrl import FTRL

LETTERS = {"en": "etaoinshrdlu", "de": "enisratdhulcäöü", "fr": "esaitnrulodcéè"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def held(doc, k):
    return zlib.crc32(str(doc).encode()) % k


def test_language_of_held_out_rows(documents):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(5, 60)), lang) for i in range(600) for lang in [rng.choice(list(LETTERS))]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 ... \n", None), (1003, prose(rng, "de", 3000), None), (None, prose(rng, "fr", 40), "fr"), (5, rows[5][1], "en")]
    got = language.languages(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    right = [by_id[i].lang_pred == lang for i, _, lang in rows[:600] if held(i, 5) == 0]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 5) == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "de", "fr"]
    again = language.languages(documents(rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_language_edges(documents):
    assert language.languages(documents([])).collect() == []
    got = language.languages(documents([(1, "some text", None)])).collect()
    assert [tuple(r)[2:] for r in got] == [("und", 0.0)]
    one = [i for i in range(30) if held(i, 5)][:4]
    got = language.languages(documents([(i, "some text", "xx") for i in one])).collect()
    assert all(r.lang_pred == "xx" and r.score == 1.0 for r in got)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    truth = rng.normal(size=(4000, 3))
    p = np.exp(truth) / np.exp(truth).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert language._temperature(truth * 5, labels) == pytest.approx(5, rel=0.2)


def brute_ngrams(text):
    """Plain counts of hashed n-grams of one to three characters."""
    out = {}
    chars = "".join(c if c.isalpha() else " " for c in text.lower())
    if not chars.strip():
        return {}
    chars = f" {' '.join(chars.split())} "
    for size in (1, 2, 3):
        for i in range(len(chars) - size + 1):
            gram = chars[i : i + size]
            if gram == " ":
                continue
            code = 0
            for c in gram:
                code = code << 21 | ord(c)
            number = ((code + (size - 1) * 0x5851F42D) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48
            out[number] = out.get(number, 0) + 1
    return out


def test_ngrams_do_not_depend_on_parts():
    rng = random.Random(7)
    texts = ["Der schnelle, braune Fuchs 12 ä " * 9, "a", " a", "a ", "12 3", "ΑΣ ΑΣΑ İx", "  x  " * 20, "\ud800 é", "日本語 text"]
    texts += ["".join(rng.choice(["a", "É", " ", "1", "日"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    for text in texts:
        for part in (1, 2, 3, 7, 64, 1 << 18):
            numbers, counts = language.n_grams(text, part)
            assert dict(zip(numbers.tolist(), counts.tolist(), strict=True)) == brute_ngrams(text), (text, part)


def plain_ftrl(rows, classes, epochs_order, alpha, l1, l2, beta=1.0):
    """Follow the regularised leader, one number at a time, as the published algorithm has it."""
    z, n = {}, {}

    def weight(key):
        zk = z.get(key, 0.0)
        if abs(zk) <= l1:
            return 0.0
        return ((l1 if zk > 0 else -l1) - zk) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    for k in epochs_order:
        at, x, label = rows[k]
        w = {(i, c): weight((i, c)) for i in at for c in range(classes)}
        logits = [sum(v * w[i, c] for i, v in zip(at, x, strict=True)) for c in range(classes)]
        top = max(logits)
        e = [math.exp(v - top) for v in logits]
        for c in range(classes):
            gap = e[c] / sum(e) - (c == label)
            for i, v in zip(at, x, strict=True):
                g, old = v * gap, n.get((i, c), 0.0)
                z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, c]
                n[i, c] = old + g * g
    return weight


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(5)
    rows = [(sorted(rng.choice(30, 6, replace=False).tolist()), rng.random(6).tolist(), int(rng.integers(3))) for _ in range(200)]
    order = [int(k) for _ in range(2) for k in rng.permutation(200)]
    for alpha, l1, l2 in ((0.5, 0.1, 0.1), (2.0, 1.0, 0.0), (1.0, 0.0, 1.0)):
        fit = FTRL(30, 3, alpha=alpha, l1=l1, l2=l2)
        for k in order:
            at, x, label = np.array(rows[k][0]), np.array(rows[k][1]), rows[k][2]
            w = fit.weights(at)
            gap = language._softmax(x @ w)
            gap[label] -= 1
            fit.step(at, x[:, None] * gap, w)
        weight = plain_ftrl(rows, 3, order, alpha, l1, l2)
        want = np.array([[weight((i, c)) for c in range(3)] for i in range(30)])
        assert np.allclose(fit.weights(), want, atol=1e-9)
        assert ((fit.weights() == 0) == (want == 0)).all()


def test_predictions_match_a_plain_loop(documents):
    """Scores of the query against softmax and TF-IDF written out."""
    rng = random.Random(11)
    rows = [(i, prose(rng, lang, rng.randrange(5, 40)), lang) for i in range(120) for lang in [rng.choice(list(LETTERS))]]
    table = documents(rows)
    model = language.fit_language(table)
    got = {r.doc_id: r for r in language.languages(table).collect()}
    df, learnt = {}, [t for i, t, _ in rows if held(i, 5)]
    for t in learnt:
        for k in brute_ngrams(t):
            df[k] = df.get(k, 0) + 1
    for i, text, _ in rows:
        grams = brute_ngrams(text)
        x = {k: (1 + math.log(c)) * (math.log((1 + len(learnt)) / (1 + df.get(k, 0))) + 1) for k, c in grams.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v / norm * model.weights[k, c] for k, v in x.items()) + model.weights[-1, c] for c in range(3)]
        e = [math.exp((v - max(logits)) / model.temperature) for v in logits]
        best = max(range(3), key=lambda c: e[c])
        assert got[i].lang_pred == model.languages[best] and got[i].score == pytest.approx(e[best] / sum(e))


def toxic_rows(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, "en", rng.randrange(10, 80)).split()
        bad = rng.random() < 0.3
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "moron"]))
        if rng.random() < 0.3:
            words.insert(0, rng.choice(["women", "muslims", "gay"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_rows(documents, spark):
    rows, labels = toxic_rows(random.Random(2), 1500)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' text", "1D score")
    extra = [(5000, None), (5001, ""), (None, "you idiot"), (5002, "fine words " * 50_000), (7, rows[7][1])]
    df = documents(rows + extra)
    got = toxicity.toxicity(df, marks).collect()
    assert len(got) == len(rows) + len(extra)
    score = {r.doc_id: r for r in got}
    test = [(score[i].predicted, bad) for i, _, bad in labels if held(i, 3) == 1]
    assert np.mean([p == b for p, b in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id, 3) == 1) for r in got)
    assert score[5000].score == score[5001].score < 0.7
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_counterfactuals_lower_the_weight_of_identity_terms():
    """Labels that go with a group's name: the regulariser keeps the name from carrying the score."""
    rng = random.Random(4)
    examples = []
    for _ in range(1500):
        words = {f"w{rng.randrange(300)}" for _ in range(20)}
        bad = rng.random() < 0.4
        if bad:
            words.add("scum")
        if rng.random() < (0.8 if bad else 0.05):
            words.add("muslims")
        other = toxicity.swapped(words)
        examples.append((toxicity.features(words), None if other is None else toxicity.features(other), int(bad)))
    plain = toxicity.train(examples, swap_weight=0.0, l1=0.5)
    fair = toxicity.train(examples, swap_weight=3.0, l1=0.5)
    weight = lambda m, w: m.weights[list(toxicity.word_features(w))].sum()
    assert abs(weight(fair, "muslims") - weight(fair, "jews")) < 0.3 * abs(weight(plain, "muslims") - weight(plain, "jews"))
    assert weight(fair, "scum") > 2


def test_toxicity_scores_match_a_plain_loop(documents, spark):
    rows, labels = toxic_rows(random.Random(8), 300)
    rows += [(5000, None), (5001, ""), (5002, "Idiot! idiot idiot")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table = documents(rows)
    model = toxicity.fit_toxicity(table, marks)
    for r in toxicity.toxicity(table, marks).collect():
        words = set("".join(c if c.isalpha() else " " for c in (dict(rows)[r.doc_id] or "").lower()).split())
        numbers = {k for w in words for k in toxicity.word_features(w)}
        want = 1 / (1 + math.exp(-(sum(model.weights[k] for k in numbers) + model.constant)))
        assert r.score == pytest.approx(want)


def test_an_id_with_very_many_texts_stays_within_the_bound(documents, spark):
    rng = random.Random(1)
    rows = [(1, prose(rng, "en", 9)) for _ in range(400)] + [(i, prose(rng, "en", 9)) for i in range(2, 40)]
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    chosen = marks.select("doc_id", "toxic")
    got = toxicity._examples(documents(rows), chosen, "doc_id", "text", 60)
    assert 20 < len(got) < 110
    assert len(toxicity._examples(documents(rows), chosen, "doc_id", "text", 1000)) > 400


def test_toxicity_without_labels(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(documents([(1, "a"), (2, None)]), none).collect()
    assert [r.predicted for r in got] == [0, 0]
    assert toxicity.toxicity(documents([]), none).collect() == []
    assert toxicity.swapped({"plain", "words"}) is None and toxicity.swapped({"women"}) == {"men"}
