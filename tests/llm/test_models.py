"""The learned models against plain recomputation: label paths, count ratios, and the hinge-loss optimum."""

import itertools
import math
import random
from collections import Counter

import numpy as np

from etlspec.llm import langid, quality


def test_labels_are_the_best_of_all_paths():
    rng = random.Random(11)
    pool = ["hello", "maison", "κόσμος", "дом", "ümlaut", "a", "zz", "Straße", "house", "ni"]
    numbers = np.random.default_rng(3)
    table = numbers.normal(-8, 2, (1 << langid.BITS, 3)).astype(np.float32)
    uses = np.ones((langid.SCRIPTS, 3), bool)
    read = langid.Reader()
    script = read(["κόσμος"]).script[0]
    uses[script] = [False, True, False]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(1, 7))) for _ in range(40)] + ["", "12 !", "κόσμος hello κόσμος"]
    switched = 0
    for penalty in (0.0, 3.0, 25.0):
        words = read(texts)
        got = langid.Model(["x", "y", "z"], table, uses, penalty).labels(words, len(texts))
        ends = [*words.first[1:].tolist(), len(words.keys)]
        scores = []
        for a, b, s in zip(words.first.tolist(), ends, words.script.tolist()):
            own = table[words.keys[a:b]].astype(float).sum(0)
            scores.append([own[k] if uses[s][k] else own.min() - 50 for k in range(3)])
        for d in range(len(texts)):
            mine = [i for i, doc in enumerate(words.doc.tolist()) if doc == d]

            def value(path):
                return sum(scores[i][k] for i, k in zip(mine, path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

            if mine:
                best = max(map(value, itertools.product(range(3), repeat=len(mine))))
                path = [int(got[i]) for i in mine]
                assert math.isclose(value(path), best, rel_tol=1e-4, abs_tol=1e-2)
                switched += len(set(path)) > 1
    assert switched > 10


def test_count_ratios_are_those_of_the_rows():
    rng = random.Random(5)
    rows = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 12)))) for _ in range(160)]
    y = np.array([int(r.min() + rng.randrange(10) < 8) for r in rows])
    model = quality.fit_rows(y, rows)
    train = [i for i in range(len(y)) if i % 4 != 3]
    counts = {k: Counter(x for i in train if y[i] == k for x in rows[i].tolist()) for k in (0, 1)}
    size = 1 << quality.BITS
    total = {k: sum(counts[k].values()) + size for k in (0, 1)}
    for g in range(60):
        want = math.log((counts[1][g] + 1) / total[1]) - math.log((counts[0][g] + 1) / total[0]) if counts[0][g] + counts[1][g] else 0.0
        assert math.isclose(math.sqrt(model.squares[g]), abs(want), abs_tol=1e-9)
    assert not model.squares[60:].any() and not model.weights[60:].any()
    order = sorted(range(len(y)), key=lambda i: model.weights[rows[i]].sum() / max(math.sqrt(model.squares[rows[i]].sum()), 1e-9))
    assert y[order[80:]].mean() > y[order[:80]].mean() and model.slope > 0


def test_coordinate_descent_reaches_the_hinge_loss_optimum():
    rng = np.random.default_rng(2)
    n, size = 80, 12
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x @ rng.normal(size=size) + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
    cost = rng.choice([0.5, 2.0], n)
    w = quality.dual_coordinate_descent([(np.arange(size), row) for row in x], y, cost, size, 3000)

    def loss(v):  # the bias is a weight like any other
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v[:size] + v[size]))).sum()

    assert all(loss(w + step * d) >= loss(w) - 1e-6 for step in (1e-4, 1e-2, 0.3) for d in rng.normal(size=(300, size + 1)))
