"""The classifier chain computed anew with dense matrices and plain loops."""

import random

import numpy as np

from fathomline.llm import toxicity_chain as tc
from fathomline.llm.textbatch import Texts


def plain_mix(x):
    full = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
    return x ^ (x >> 31)


def plain_logistic(features, y):
    """Adam on the penalised likelihood, rows of features with a one ahead."""
    a = np.hstack([np.ones((len(y), 1)), features])
    w, m, v = (np.zeros(a.shape[1]) for _ in range(3))
    for step in range(1, tc.ROUNDS + 1):
        g = a.T @ (y - 1 / (1 + np.exp(-(a @ w)))) / len(y)
        g[1:] -= tc.L2 * w[1:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + tc.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def sample(n=160):
    rng = random.Random(9)
    plain = ["river", "stone", "bread", "letter", "window", "garden", "paper", "music"]
    kinds = (["grubbo", "vilefoo", "snarl"], ["mockit", "sneerly", "jibeon"])
    texts, toxic = [], []
    for i in range(n):
        words = rng.sample(plain, 5)
        bad = i % 3 == 0
        if bad:
            words += rng.sample(kinds[i % 2], 2)
        rng.shuffle(words)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return list(range(1000, 1000 + n)), texts, np.array(toxic)


def test_chain_is_the_plain_one():
    ids, texts, toxic = sample()
    chain = tc.fit(ids, texts, toxic)
    y = toxic.astype(float)
    x = np.array([np.isin(chain.vocabulary, tc.word_pairs(Texts.of([t]))[0]) for t in texts], float)
    assert x.shape[1] > 4 and (x.sum(axis=0) > 0).all()

    # the two kinds: pure words, parted by the sign of the first component of their correlations among toxic documents
    both, bad = x.sum(axis=0), x[y > 0].sum(axis=0)
    pure = [j for j in range(x.shape[1]) if bad[j] >= tc.KIND_PURITY * both[j] and bad[j] >= tc.LEAST_DOCS]
    pure = sorted(sorted(pure, key=lambda j: (-bad[j], j))[: tc.KIND_WORDS])
    seen = x[:, pure] * y[:, None]
    side = np.linalg.eigh(np.corrcoef(seen[y > 0].T))[1][:, -1]
    side = side * np.sign(side[int(np.argmax(bad[pure]))])
    a, b = seen[:, side >= 0].sum(axis=1), seen[:, side < 0].sum(axis=1)
    targets = [y * ((a > 0) & (a >= b)), y * ((b > 0) & (b >= a)), y]
    assert 5 < targets[0].sum() < y.sum() and 5 < targets[1].sum() < y.sum()

    fold = np.array([plain_mix(i) % tc.FOLDS for i in ids])
    earlier = np.zeros((len(y), 0))
    for model, target in zip(chain.models, targets, strict=True):
        features = np.hstack([earlier, x])
        assert np.allclose(model, plain_logistic(features, target), atol=1e-6)
        unseen = np.zeros(len(y))
        for f in range(tc.FOLDS):
            w = plain_logistic(features[fold != f], target[fold != f])
            unseen[fold == f] = 1 / (1 + np.exp(-(w[0] + features[fold == f] @ w[1:])))
        earlier = np.hstack([earlier, unseen[:, None]])

    def f1(cut):
        found = earlier[:, -1] >= cut
        return 2 * (found & (y > 0)).sum() / (found.sum() + y.sum())

    values = sorted(set(earlier[:, -1]), reverse=True)
    best = max(range(len(values)), key=lambda i: (f1(values[i]), -i))
    logit = lambda p: np.log(p / (1 - p))
    below = values[min(best + 1, len(values) - 1)]
    want = min(0.5, 1 / (1 + np.exp(-(logit(values[best]) + logit(below)) / 2)))
    assert np.isclose(chain.threshold, want)


def test_prediction_feeds_earlier_probabilities():
    ids, texts, toxic = sample()
    chain = tc.fit(ids, texts, toxic)
    fresh = ["river grubbo snarl bread", "mockit jibeon letter", "garden window paper", ""]
    got = tc.predict(chain, Texts.of(fresh))
    for t, row in zip(fresh, got, strict=True):
        x = np.isin(chain.vocabulary, tc.word_pairs(Texts.of([t]))[0]).astype(float) if t else np.zeros(len(chain.vocabulary))
        p = []
        for w in chain.models:
            p.append(1 / (1 + np.exp(-(w[0] + np.dot(w[1 : 1 + len(p)], p) + x @ w[1 + len(p) :]))))
        assert np.allclose(row, p)
    assert got[0, -1] > chain.threshold > got[2, -1]
