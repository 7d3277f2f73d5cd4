"""The tagger's gates: no exponential, whose passes were the largest part of the time, and the slope that training uses."""

import numpy as np

from trajloom.llm import bilstm


def test_scores_take_no_exponential(monkeypatch):
    model, ids = bilstm.Tagger(9), np.random.default_rng(1).integers(0, 100, (40, 30))

    def none(*_, **__):
        raise AssertionError("an exponential")

    for name in ("exp", "tanh"):
        monkeypatch.setattr(np, name, none)
    assert np.allclose(model.scores(ids).transpose(0, 2, 1), model.emissions(ids), atol=1e-4)


def test_slope_is_that_of_the_value():
    x, e = np.linspace(-6, 6, 241), 1e-6
    assert np.allclose((bilstm.bent(x + e) - bilstm.bent(x - e)) / (2 * e), bilstm.slope(bilstm.bent(x)), atol=1e-6)
    assert np.allclose((bilstm.gate(x + e) - bilstm.gate(x - e)) / (2 * e), bilstm.gate_slope(bilstm.gate(x)), atol=1e-6)
    assert (np.abs(bilstm.bent(x)) < 1).all() and (0 < bilstm.gate(x)).all()
