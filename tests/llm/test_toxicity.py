import random

import numpy as np

from fernweave.llm import toxicity

from .conftest import ROWS


def corpus(n, seed):
    rng = random.Random(seed)
    mild, severe = ["grumbly", "snarky"], ["vileword", "nastyword", "hatefulx"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
        grade = rng.choice([0, 0, 0, 1, 2])
        for _ in range(2 if grade else 0):
            words.insert(rng.randrange(len(words)), rng.choice(mild if grade == 1 else severe) + rng.choice(["", ",", "s"]))
        out.append((i, " ".join(words), grade))
    return out


def test_grades_on_held_out_texts():
    train, test = corpus(1500, 1), corpus(400, 2)
    model = toxicity.fit([t for _, t, _ in train], [g for *_, g in train])
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    best, expected = model.grades(model.scores([t for _, t, _ in test]))
    truth = np.array([g for *_, g in test])
    assert ((expected >= toxicity.REJECT) == (truth > 0)).mean() > 0.97
    assert (best == truth).mean() > 0.85
    assert expected[truth == 2].mean() > expected[truth == 1].mean() > expected[truth == 0].mean()


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (200, 4))
    y = np.clip(np.digitize(x @ np.array([2.0, -1, 0.5, 0]) + rng.logistic(size=200), [0, 1.5]), 0, 2)
    rows = [np.flatnonzero(r) for r in x]
    w, theta = toxicity.fit_ordinal(rows, 4, y, 3, l2=0.01, steps=1500)

    def loss(w, theta):
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        s = x @ w
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return -np.log(sig(edge[y + 1] - s) - sig(edge[y] - s)).sum() + 0.005 * (w * w).sum()

    best = loss(w, theta)
    for i in range(4):
        for e in (-0.05, 0.05):
            assert loss(w + e * np.eye(4)[i], theta) > best
    for e in (-0.05, 0.05):
        assert loss(w, theta + np.array([e, 0])) > best and loss(w, theta + np.array([0, e])) > best


def test_one_kind_of_label():
    assert toxicity.fit(["a b"], [0]).grades(np.zeros(1))[1][0] < 0.01
    assert toxicity.fit(["a b"], [1]).grades(np.zeros(1))[1][0] > 0.99
    assert toxicity.fit([], []).grades(np.zeros(1))[1][0] < 0.01


def test_filter(spark, docs, empty):
    rows = corpus(600, 3)
    labelled = spark.createDataFrame([(i, int(g > 0), None) for i, _, g in rows] + [(None, 1, 1), (5, None, 1), (10**9, 1, 1)], "doc_id long, toxic int, quality int")
    source = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(source, labelled)
    left = {r["doc_id"] for r in toxicity.without_toxic(source, model).collect()}
    truth = {i for i, _, g in rows if g == 0}
    assert len(left ^ truth) <= 6
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert toxicity.without_toxic(empty, model).count() == 0
    assert toxicity.train(source, labelled.limit(0)).weights == {}
    again = toxicity.train(source.repartition(5), labelled)
    assert again.weights == model.weights
