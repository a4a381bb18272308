"""What classifiers are fitted on is bounded whatever keys and languages a table has; their parts against plain versions."""

import inspect
import math

import numpy as np
import pytest

from tallyframe.llm import language, quality


@pytest.mark.parametrize("key", ["null", "one"])
def test_repeated_keys_bring_no_more_rows(spark, monkeypatch, key):
    seen = []
    monkeypatch.setattr(language, "fit_ftrl", lambda model, rows, *a: seen.append(len(rows)))
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, *a: seen.append(len(rows)) or np.zeros(quality.BUCKETS))
    rows = [(None if key == "null" else 1, f"word{i % 7} and text", "en" if i % 2 else "fr") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    language.train(df, sample=100)
    quality.quality(df, sample=128)
    assert 0 < seen[0] <= 200 and 0 < seen[1] <= 128


def test_many_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "CLASSES", 5)
    monkeypatch.setattr(language, "TOTAL", 50)
    rows = [(i, f"text number {i}", f"l{min(i % 40, 20 + i % 3)}") for i in range(800)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.classes) == 5 and {"l20", "l21", "l22"} <= set(model.classes)


def test_ftrl_against_a_plain_walk():
    """Each weight by its own sums, one row after the other."""
    r = np.random.default_rng(0)
    rows = []
    for _ in range(60):
        at = np.sort(r.choice(30, 6, replace=False))
        x = r.random(6)
        rows.append((at, x / np.sqrt(x @ x), int(r.integers(3))))
    model = language.Model(["a", "b", "c"], np.ones(30), np.zeros((30, 3)))
    language.fit_ftrl(model, rows)
    p = {k: v.default for k, v in inspect.signature(language.fit_ftrl).parameters.items() if v.default is not inspect.Parameter.empty}
    z, n = {}, {}

    def weight(b, c):
        zi, ni = z.get((b, c), 0.0), n.get((b, c), 0.0)
        if abs(zi) <= p["l1"]:
            return 0.0
        return (np.sign(zi) * p["l1"] - zi) / ((p["beta"] + ni**0.5) / p["alpha"] + p["l2"])

    rng = np.random.default_rng(p["seed"])
    for i in [i for _ in range(p["epochs"]) for i in rng.permutation(len(rows)).tolist()]:
        at, x, y = rows[i]
        w = {(b, c): weight(b, c) for b in at for c in range(3)}
        logits = np.array([sum(xi * w[b, c] for b, xi in zip(at, x)) for c in range(3)])
        q = np.exp(logits - logits.max())
        q /= q.sum()
        for b, xi in zip(at, x):
            for c in range(3):
                g = xi * (q[c] - (c == y))
                before = n.get((b, c), 0.0)
                n[b, c] = before + g * g
                z[b, c] = z.get((b, c), 0.0) + g - (n[b, c] ** 0.5 - before**0.5) / p["alpha"] * w[b, c]
    want = np.array([[weight(b, c) for c in range(3)] for b in range(30)])
    assert np.allclose(model.weights[:30], want) and (want == 0).any() and (want != 0).any()


def test_em_against_a_plain_walk():
    """Each document by itself, probabilities multiplied as they are."""
    r = np.random.default_rng(1)
    good = r.random(300) < 0.7
    votes = [[(1 if g == (r.random() < 0.8) else -1) if r.random() < 0.8 else 0 for _ in range(quality.LABELLERS)] for g in good]
    counted = {}
    for v in votes:
        counted[tuple(v)] = counted.get(tuple(v), 0) + 1
    prior, table, p = quality.accuracies(np.array(list(counted)), np.array(list(counted.values()), dtype=float))
    q = [1 / (1 + math.exp(-sum(v))) for v in votes]
    for _ in range(200):
        pi = (sum(q) + 1) / (len(q) + 2)
        acc = {}
        for j in range(quality.LABELLERS):
            for c in (0, 1):
                w = [sum((x if c else 1 - x) for x, v in zip(q, votes) if v[j] == vote) + 0.5 for vote in (-1, 0, 1)]
                for vote, x in zip((-1, 0, 1), w):
                    acc[j, c, vote] = x / sum(w)
        new = []
        for v in votes:
            yes, no = pi, 1 - pi
            for j, vote in enumerate(v):
                yes, no = yes * acc[j, 1, vote], no * acc[j, 0, vote]
            new.append(yes / (yes + no))
        if max(abs(a - b) for a, b in zip(new, q)) < 1e-9:
            break
        q = new
    known = dict(zip(counted, p))
    assert np.allclose([known[tuple(v)] for v in votes], new, atol=1e-6) and abs(prior - pi) < 1e-6
    assert np.mean((np.array(new) > 0.5) == good) > 0.9
