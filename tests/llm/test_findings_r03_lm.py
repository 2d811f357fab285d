"""What the third round's check showed of LM scoring: it would have failed before."""

import numpy as np

from gaugeworks.llm import lm_score


def test_lm_work_by_class_is_one_update_and_few_rows_at_a_time(monkeypatch):
    r, classes = np.random.default_rng(2), 7
    leaf, size = r.integers(0, classes * classes, 5000), np.array([0, 3, 4000, 1, 996])
    ctx = lm_score.around(leaf, size)
    params = [x.astype(np.float64) for x in lm_score.start(classes)]
    most, real = [], lm_score._powers
    monkeypatch.setattr(lm_score, "_powers", lambda h, w: most.append(len(h)) or real(h, w))
    got = lm_score.log_probs(params, ctx, leaf)
    assert max(most) <= lm_score.ROWS < len(leaf)
    h = np.tanh(params[0][ctx].reshape(len(ctx), -1) @ params[1] + params[2]).astype(np.float32)
    h = np.append(h, np.ones((len(h), 1), np.float32), 1)
    softmax = lambda z: np.exp(z) / np.exp(z).sum(-1, keepdims=True)
    cls, place, rows = leaf // classes, leaf % classes, np.arange(len(leaf))
    of_class, of_leaf = softmax(h @ params[3]), softmax(np.einsum("ij,ijk->ik", h, params[4][cls]))
    np.testing.assert_allclose(got, np.log(of_class[rows, cls] * of_leaf[rows, place]), rtol=1e-5)
    grads = lm_score.Trainer(params).gradients(ctx, leaf)
    assert sorted(k for k, *_ in grads) == [0, 1, 2, 3, 4]  # all classes' leaves in one update
    of_leaf[rows, place] -= 1
    wanted = np.zeros_like(params[4])
    np.add.at(wanted, cls, h[:, :, None] * of_leaf[:, None, :] / len(leaf))
    np.testing.assert_allclose(next(g for k, g, _ in grads if k == 4), wanted, atol=1e-7)
