"""Training ends where the risk that it names has no slope, by finite differences of the risk written out."""

from itertools import product

import numpy as np


def slopes(f, w, h=1e-4):
    out = []
    for i in range(len(w)):
        up, down = w.copy(), w.copy()
        up[i] += h
        down[i] -= h
        out.append((f(up) - f(down)) / (2 * h))
    return np.array(out)


def test_positive_unlabelled_risk():
    from faultline.llm.toxicity import fit

    rng = np.random.default_rng(0)
    use = np.array([3, 8, 20, 21])
    positive = [use[rng.random(4) < p] for p in [(0.8, 0.5, 0.3, 0.5)] * 60]
    unlabelled = [use[rng.random(4) < p] for p in [(0.3, 0.5, 0.5, 0.4)] * 300]
    prior = 0.2
    model = fit(use, positive, unlabelled, prior, rounds=6000)
    x = lambda rows: np.array([[float(u in r) for u in use] + [1.0] for r in rows])
    xp, xu = x(positive), x(unlabelled)
    loss = lambda z: np.log1p(np.exp(-z)).mean()

    def risk(w):
        negative = loss(-(xu @ w)) - prior * loss(-(xp @ w))
        assert negative > 0  # the estimator's plain branch
        return prior * loss(xp @ w) + negative + 0.5e-5 * (w[:-1] ** 2).sum()

    w = np.array([*(model.weights[u] for u in use.tolist()), model.bias])
    assert np.abs(slopes(risk, w)).max() < 2e-3
    assert np.abs(slopes(risk, np.zeros(5))).max() > 0.05 and risk(w) < risk(np.zeros(5))


def test_negative_part_is_not_overfitted():
    """Where every unlabelled text could be told apart, the plain estimator falls without bound; this one does not."""
    from faultline.llm.toxicity import fit

    use = np.arange(40)
    positive = [np.array([i]) for i in range(10)]
    unlabelled = [np.array([10 + i]) for i in range(20)] + [np.array([i]) for i in range(10)]
    model = fit(use, positive, unlabelled, 0.5, rounds=3000)
    z = lambda rows: np.array([model.bias + sum(model.weights[int(f)] for f in r) for r in rows])
    negative = np.logaddexp(0, z(unlabelled)).mean() - 0.5 * np.logaddexp(0, z(positive)).mean()
    assert negative > -0.05 and np.isfinite(z(positive)).all()


def test_likelihood_of_the_field():
    from faultline.llm.html_crf import fit

    rng = np.random.default_rng(1)
    names = ["a", "b", "c"]
    pages = []
    for _ in range(12):
        n = int(rng.integers(1, 5))
        labels = rng.integers(0, 2, n).tolist()
        pages.append(([[x for x in names if rng.random() < (0.7 if y == (x == "a") else 0.3)] for y in labels], labels))
    field = fit(pages, steps=4000)
    index = [field.names[x] for x in names]
    w = np.concatenate([field.emit[index].ravel(), field.start, field.move.ravel()])

    def score(w, rows, y):
        emit, start, move = w[:6].reshape(3, 2), w[6:8], w[8:].reshape(2, 2)
        s = start[y[0]] + sum(move[a, b] for a, b in zip(y, y[1:]))
        return s + sum(emit[names.index(x), k] for row, k in zip(rows, y) for x in row)

    def risk(w):
        out = 1e-3 * (w**2).sum()
        for rows, y in pages:
            all_ = [score(w, rows, z) for z in product((0, 1), repeat=len(rows))]
            out += (np.log(np.exp(all_).sum()) - score(w, rows, y)) / len(pages)
        return out

    assert np.abs(slopes(risk, w)).max() < 2e-3
    assert np.abs(slopes(risk, np.zeros(12))).max() > 0.02 and risk(w) < risk(np.zeros(12))
