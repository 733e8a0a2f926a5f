"""The forward-backward pass, against plain recursions of each sequence, and the memory that lets many tokens run together."""

from __future__ import annotations

import tracemalloc

import numpy as np

from papertide.llm import hmm_lm


def drawn(rng, symbols):
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    s = hmm_lm.STATES
    return hmm_lm.Model(*[np.zeros(0)] * 3, 0, np.zeros(0), np.zeros(0), 0, 0, 0, norm(rng.random(s), 0), norm(rng.random((s, s)), 1), norm(rng.random((symbols, s)), 0))


def plain(sequence, model):
    alpha, beta = [model.start * model.emit[sequence[0]]], [np.ones(hmm_lm.STATES)]
    for x in sequence[1:]:
        alpha.append(alpha[-1] @ model.move * model.emit[x])
    for x in sequence[:0:-1]:
        beta.insert(0, model.move @ (model.emit[x] * beta[0]))
    whole = alpha[-1].sum()
    moves = sum((np.outer(a, model.emit[x] * b) * model.move / whole for a, x, b in zip(alpha, sequence[1:], beta[1:], strict=False)), np.zeros((hmm_lm.STATES,) * 2))
    counts = np.zeros(model.emit.shape)
    for x, a, b in zip(sequence, alpha, beta, strict=True):
        counts[x] += a * b / whole
    return alpha[0] * beta[0] / whole, moves, counts


def test_expected_counts_are_those_of_plain_recursions(monkeypatch):
    rng = np.random.default_rng(3)
    model = drawn(rng, 20)
    sequences = [rng.integers(0, 20, n) for n in (1, 7, 1, 30, 12, 12, 2, 25, 7)]
    want = [sum(x) for x in zip(*(plain(q, model) for q in sequences), strict=True)]
    for together, at_once in ((700_000, 1 << 17), (40, 9)):
        monkeypatch.setattr(hmm_lm, "TOGETHER_PASS", together)
        monkeypatch.setattr(hmm_lm, "AT_ONCE", at_once)
        got = hmm_lm.expected(np.concatenate(sequences), np.array([len(q) for q in sequences]), model)
        assert all(np.allclose(g, w, rtol=1e-4, atol=1e-5) for g, w in zip(got, want, strict=True))


def test_a_pass_holds_few_bytes_of_each_token():
    """So that long sequences, which are few at each step, run beside many others in the memory of a worker."""
    rng = np.random.default_rng(4)
    model, size = drawn(rng, 500), np.full(400, 1000)
    symbols = rng.integers(0, 500, size.sum())
    tracemalloc.start()
    hmm_lm.expected(symbols, size, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 * len(symbols)
