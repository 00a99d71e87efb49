"""The language model's sums in blocks of rows, and its steps of Adam."""

import numpy as np

from archivum.llm import lm


def network(side=5, seed=4):
    net = lm.Network(seed=seed, side=side)
    rng = np.random.default_rng(seed)
    net.weights = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.weights.items()}
    return net


def test_blocks_do_not_change_probabilities_or_gradients(monkeypatch):
    net, rng = network(), np.random.default_rng(1)
    states, targets = rng.standard_normal((37, lm.HIDDEN)), rng.integers(0, 25, 37).astype(np.int32)
    w = net.weights
    classes = states @ w["class"] + w["class_bias"]
    inner = np.einsum("nh,nhs->ns", states, w["word"][targets // 5]) + w["word_bias"][targets // 5]
    log = lambda x, k: x[np.arange(37), k] - np.log(np.exp(x).sum(axis=1))
    wanted = log(classes, targets // 5) + log(inner, targets % 5)
    tokens, after = rng.integers(0, 25, (6, 4)).astype(np.int32), rng.integers(0, 25, (6, 4)).astype(np.int32)
    grads, _ = net.gradients(tokens, after, np.zeros((6, 4), bool), np.zeros((4, lm.HIDDEN)))
    monkeypatch.setattr(lm, "ROWS", 5)
    assert np.allclose(net.log_probabilities(states, targets), wanted)
    blocks, _ = net.gradients(tokens, after, np.zeros((6, 4), bool), np.zeros((4, lm.HIDDEN)))
    assert all(np.allclose(grads[k], blocks[k]) for k in grads)


def test_steps_are_those_of_adam_and_leave_given_weights_alone():
    net = network()
    given = dict(net.weights)
    copies = {k: v.copy() for k, v in given.items()}
    tokens = np.random.default_rng(2).integers(0, 25, 24).astype(np.int32)
    twin, m, v = lm.Network(dict(copies)), {k: 0.0 for k in copies}, {k: 0.0 for k in copies}
    lm.Adam(net).fit(tokens, np.zeros(24, bool), 2, 12, 6, lambda step: 0.01 / step)
    lanes, state, fresh = tokens.reshape(2, 12).T, np.zeros((2, lm.HIDDEN), np.float32), np.zeros((12, 2), bool)
    fresh[0] = True
    inputs = np.where(fresh, 0, np.vstack((np.zeros((1, 2), np.int32), lanes[:-1])))
    for step, part in ((1, slice(0, 6)), (2, slice(6, 12))):
        grads, state = twin.gradients(inputs[part], lanes[part], fresh[part], state)
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            twin.weights[k] = twin.weights[k] - 0.01 / step * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    assert all(np.allclose(net.weights[k], twin.weights[k], atol=1e-6) for k in copies)
    assert all(np.array_equal(given[k], copies[k]) for k in copies)
