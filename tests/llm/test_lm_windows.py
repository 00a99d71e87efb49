"""Scoring and fitting do few NumPy calls for many tokens, with the same sums."""

import numpy as np
import pytest

from archivum.llm import lm


def test_a_long_document_is_scored_in_few_windows(monkeypatch):
    net, seen, real = lm.Network(seed=3), [], lm.Network.log_probabilities
    monkeypatch.setattr(lm.Network, "log_probabilities", lambda self, states, targets: (seen.append(len(targets)), real(self, states, targets))[1])
    documents = [np.arange(n, dtype=np.int32) % 1000 for n in (3, 20_000, 0, 7)]
    scores = net.score(documents)
    assert sum(seen) == sum(len(d) + 1 for d in documents) and len(seen) == 1
    assert scores == pytest.approx([net.score([d])[0] for d in documents])
    assert net.score([]).tolist() == []


@pytest.mark.parametrize("together, rows", [(1, 1), (9, 5), (200, 3), (5_000, 64)])
def test_scores_do_not_depend_on_windows(monkeypatch, together, rows):
    net, rng = lm.Network(seed=3, side=6), np.random.default_rng(5)
    documents = [rng.integers(2, 36, n).astype(np.int32) for n in (5, 0, 70, 33, 33, 1, 16, 15, 17)]
    wanted = net.score(documents)
    monkeypatch.setattr(lm, "STEPS", 2)
    monkeypatch.setattr(lm, "TOGETHER", together)
    monkeypatch.setattr(lm, "ROWS", rows)
    assert net.score(documents) == pytest.approx(wanted, rel=1e-5)


def test_parts_have_every_row_of_every_class_once(monkeypatch):
    monkeypatch.setattr(lm, "ROWS", 4)
    kinds = np.repeat(np.arange(6), [0, 9, 1, 0, 3, 0])
    made = []
    for part, found in lm.parts(np.cumsum(np.bincount(kinds, minlength=6)).tolist()):
        assert part.stop - part.start <= 4 and sum(x.stop - x.start for _, x in found) == part.stop - part.start
        made += [kind for kind, its in found for _ in range(part.start, part.stop)[its]]
    assert made == kinds.tolist() and [*lm.parts([0, 0])] == []
