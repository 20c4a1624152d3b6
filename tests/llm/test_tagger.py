"""The tagger scores each word once, however many slices and spellings there are."""

import numpy as np

from tallyforge.llm import crf, toxicity


def test_known_words_cost_nothing_again():
    rng = np.random.default_rng(4)
    model = crf.Model(rng.normal(size=toxicity.BUCKETS + 1), rng.normal(size=(2, 2)))
    tagger = toxicity.Tagger(model, np.array([1.0, 2.0, -1.0]))
    texts = ["Good day, GOOD Day", "", "a bad bad day " * 30, "good"]
    whole = tagger.scores(texts)
    table = tagger._table
    assert np.array_equal(whole, np.concatenate([tagger.scores([t]) for t in texts]))
    assert tagger._table is table and len(table) == 7
    own, before, after = toxicity.token_features("good")
    assert np.isclose(table[0, 0], model.weights[own].sum() + model.weights[toxicity.BUCKETS]) and table[0, 1] == model.weights[before] and table[0, 2] == model.weights[after]


def test_forward_and_backward_equal_all_labellings():
    rng = np.random.default_rng(6)
    model = crf.Model(np.zeros(1), rng.normal(size=(2, 2)))
    sizes = [3, 0, 5, 1]
    starts = np.r_[0, np.cumsum(sizes)]
    e = rng.normal(size=starts[-1])
    got = model.marginals(e, crf.Chains(starts))
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        total, hit = 0.0, np.zeros(hi - lo)
        for k in range(2 ** (hi - lo)):
            y = [k >> i & 1 for i in range(hi - lo)]
            w = np.exp(sum(e[lo + i] for i in range(hi - lo) if y[i]) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, hit = total + w, hit + w * np.array(y)
        assert np.allclose(got[lo:hi], hit / total)
