"""The tagger's bound on windows, and its scores for states that are far out."""

import itertools

import numpy as np

from trajloom.llm.bilstm import Tagger


def some_tagger(seed: int, outside: float, n_tags: int = 9) -> Tagger:
    model, rng = Tagger(n_tags, seed=seed), np.random.default_rng(seed)
    model.p["A"] = (2 * rng.standard_normal((n_tags, n_tags))).astype(np.float32)
    model.p["o"][0] = outside
    return model


def test_bound_on_windows_loses_none():
    """Windows that are left out of the Viterbi pass have no path better than tag 0 throughout, and some are."""
    ids = np.random.default_rng(2).integers(1, 100, (200, 4))
    left_out = tagged = 0
    for seed in range(12):
        model = some_tagger(seed, 0.5 * seed, 5)
        s, a = model.scores(ids), model.p["A"]
        may = model.may_hold(s)
        gains = [sum(s[t, y[t]] - s[t, 0] for t in range(4)) + sum(a[i, j] - a[0, 0] for i, j in zip((0, *y), (*y, 0), strict=True)) for y in itertools.product(range(5), repeat=4)]
        better = np.max(gains, axis=0) > 1e-3
        assert not (better & ~may).any()
        rows, _, _ = model.decode(ids)
        assert set(np.flatnonzero(better)) <= set(rows)
        left_out, tagged = left_out + (~may).sum(), tagged + better.sum()
    assert left_out and tagged


def test_windows_without_tags():
    rows, tags, gain = some_tagger(3, 1e3).decode(np.random.default_rng(1).integers(1, 100, (64, 40)))
    assert len(rows) == 0 and tags.shape == gain.shape == (0, 40)


def test_scores_of_large_states():
    """Gates far out overflow to 0 and 1 without a warning."""
    model = some_tagger(5, 0)
    for name in ("Wf", "Wb"):
        model.p[name] *= 500
    ids = np.random.default_rng(4).integers(1, 100, (50, 30))
    with np.errstate(all="raise", under="ignore"):
        got = model.scores(ids).transpose(0, 2, 1)
    assert np.isfinite(got).all() and np.allclose(got, model.emissions(ids), atol=1e-2)
