import random

import numpy as np

from loomline.llm import toxicity as t


BAD = ("idiot", "moron", "clown", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "stupid")
JUNK = ("$$$", "###", "lorem")


def corpus(n=900):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(rnd.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for w in rnd.sample(BAD, rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), w)
        if i % 4 == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(JUNK))
        docs.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, int(i % 4 != 0), int(toxic) if rnd.random() > 0.02 else 1))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(None, "idiot trash"), (2000, None), (2001, ""), (2002, "x " * 40_000 + "moron"), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, 0.5, "x", 7, 8) for r in [*docs, *extra]], "doc_id long, text string, tox_toxic double, _text string, toxic int, y int")
    lab = spark.createDataFrame([(*r, "idiot") for r in [*labels, (None, 1, 1), (5, None, None), (9999, 0, 1), labels[0], (0, None, 0)]], "doc_id long, quality int, toxic int, text string")
    chain = t.train(d, lab, t.label_categories())
    assert chain.names == ["low_quality", "low_and_toxic", "toxic"] and [len(w) - len(chain.words) for w in chain.weights] == [1, 2, 3]
    rows = t.score(d, chain).collect()
    assert len(rows) == len(docs) + len(extra)
    p = {r.doc_id: r.tox_toxic for r in rows}
    held = [i for i, _ in docs if i >= 600]
    assert np.mean([(p[i] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    assert p[2002] > 0.5 and p[None] > 0.5 and p[2000] == p[2001] < 0.5
    low = {r.doc_id: r.tox_low_quality for r in rows}
    assert np.mean([(low[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    again = t.train(d.repartition(7), lab, t.label_categories())
    assert all(np.allclose(a, b) for a, b in zip(chain.weights, again.weights, strict=True))


def test_newton_is_at_the_optimum():
    rnd = np.random.default_rng(0)
    x = (rnd.random((300, 5)) < 0.3).astype(float)
    y = (x[:, 0] + rnd.normal(0, 0.3, 300) > 0.5).astype(float)
    w = t.fit_linear(x, y)
    g = np.column_stack([x, np.ones(300)]).T @ (t._sigmoid(x @ w[:-1] + w[-1]) - y) + np.array([t.RIDGE] * 5 + [1e-6]) * w
    assert np.abs(g).max() < 1e-3


def plain_chain(x, y):
    """The chain by gradient steps of a Newton form that shares nothing with the operator's."""
    def fit(x, y):
        x = np.column_stack([x, np.ones(len(x))])
        ridge, w = np.diag([t.RIDGE] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.pinv(x.T @ np.diag(np.maximum(p * (1 - p), 1e-6)) @ x + ridge) @ (x.T @ (p - y) + ridge @ w)
        return w

    n, out, extra = len(x), [], []
    fold = np.random.default_rng(t.SEED).permutation(n) % t.FOLDS
    for k in range(y.shape[1]):
        now = np.column_stack([x, *extra])
        out.append(fit(now, y[:, k]))
        p = np.zeros(n)
        for f in range(t.FOLDS):
            w = fit(now[fold != f], y[fold != f, k])
            p[fold == f] = 1 / (1 + np.exp(-(now[fold == f] @ w[:-1] + w[-1])))
        extra.append(p)
    return out


def test_chain_against_plain_numpy():
    rnd = np.random.default_rng(4)
    x = (rnd.random((200, 6)) < 0.3).astype(np.float32)
    y = np.column_stack([rnd.random(200) < 0.2 + 0.6 * x[:, 0], rnd.random(200) < 0.1 + 0.5 * x[:, 1], rnd.random(200) < 0.1 + 0.7 * x[:, 2]]).astype(int)
    chain = t.fit_chain(x, y, ["a", "b", "c"], np.arange(6))
    for got, want in zip(chain.weights, plain_chain(x.astype(float), y), strict=True):
        assert np.allclose(got, want, atol=1e-4)


def test_words_against_counting(spark):
    docs, labels = corpus(600)
    rows = [(sorted(int(h) for h in t.word_set(x)), [int(q == 0), tox]) for (_, x), (_, q, tox) in zip(docs, labels, strict=False)]
    n, score = len(rows), {}
    for k in (0, 1):
        total = sum(y[k] for _, y in rows)
        for h in {h for w, _ in rows for h in w}:
            df, pos = sum(h in w for w, _ in rows), sum(h in w for w, y in rows if y[k])
            expect = df * total / n
            if df >= 5 and pos >= max(5, t.LEAST_SHARE * total) and pos / total >= t.LEAST_LIFT * (df - pos + 0.5) / (n - total + 1):
                score[h] = max(score.get(h, 0.0), (pos - expect) / max(expect, 1.0) ** 0.5)
    df = spark.createDataFrame(rows, "words array<int>, y array<int>")
    for m in (8, 1000):
        assert t.telling(df, 2, m).tolist() == sorted(sorted(score, key=lambda h: (-score[h], h))[:m])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    chain = t.train(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"), t.label_categories())
    assert t.score(none, chain).count() == 0
    assert t.score(spark.createDataFrame([(1, "idiot")], none.schema), chain).count() == 1
