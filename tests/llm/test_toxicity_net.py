"""The network against a plain forward pass written out word by word, and its gradients against differences."""

import math

import numpy as np

from foliospark.llm import toxicity as T


def plain_logit(net, rows):
    """Logit of one window from its word vectors (none: the window is empty)."""
    p, k = net.p, T.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))

    def read(d, inputs):
        h, out = [0.0] * k, []
        for x in inputs:
            at = [sum(float(x[i]) * float(p[f"W{d}"][i, j]) for i in range(len(x))) + float(p[f"c{d}"][j]) for j in range(3 * k)]
            hu = [sum(h[i] * float(p[f"U{d}"][i, j]) for i in range(k)) for j in range(3 * k)]
            z, r = [sig(at[j] + hu[j]) for j in range(k)], [sig(at[k + j] + hu[k + j]) for j in range(k)]
            c = [math.tanh(at[2 * k + j] + r[j] * hu[2 * k + j]) for j in range(k)]
            h = [(1 - z[j]) * c[j] + z[j] * h[j] for j in range(k)]
            out.append(h)
        return out

    forward, backward = read("f", rows), read("b", rows[::-1])[::-1]
    states = [f + b for f, b in zip(forward, backward, strict=True)]
    e = [sum(s * float(v) for s, v in zip(h, p["v"], strict=True)) for h in states]
    a = [math.exp(x - max(e)) for x in e]
    pooled = [sum(w * h[j] for w, h in zip(a, states, strict=True)) / sum(a) for j in range(2 * k)]
    return sum(x * float(w) for x, w in zip(pooled, p["w"], strict=True)) + float(p["b"][0])


def net_and_windows(seed):
    g = np.random.default_rng(seed)
    net = T.Net(seed)
    for name in net.p:
        if name not in ("word", "char"):
            net.p[name] = (g.standard_normal(net.p[name].shape) * 0.4).astype(np.float32)
    vectors = (g.standard_normal((9, 2 * T.DIM)) * 0.5).astype(np.float32)
    vectors[-1] = 0
    ids = g.integers(0, 8, (5, T.WINDOW))
    return g, net, vectors, ids


def test_forward_as_plain_loops():
    for seed in range(3):
        _, net, vectors, ids = net_and_windows(seed)
        got = net.logits(vectors, ids)
        for w in range(len(ids)):
            assert abs(got[w] - plain_logit(net, [vectors[i] for i in ids[w]])) < 1e-3


def test_a_text_is_its_strongest_window():
    net = T.Net(3)
    words = [f"word{i % 17}" for i in range(150)]
    whole = net.document_logits([" ".join(words)])[0]
    starts = range(0, max(1, len(words) - T.WINDOW) + T.STRIDE, T.STRIDE)
    assert abs(whole - max(net.document_logits([" ".join(words[s : s + T.WINDOW])])[0] for s in starts if words[s : s + T.WINDOW])) < 0.05


def test_gradients_as_differences():
    g, net, vectors, ids = net_and_windows(5)
    label, weight = np.array([0, 1, 1, 0, 1], dtype=np.float32), np.array([1, 2, 1, 1, 0.5], dtype=np.float32)

    def loss():
        x = net.logits(vectors, ids).astype(np.float64)
        return float((weight * (np.log1p(np.exp(-np.abs(x))) + np.maximum(x, 0) - label * x)).sum() / len(ids))

    found, by_row = net.gradients(vectors, ids, label, weight)
    step = 1e-2
    for name, values in (*((n, net.p[n]) for n in found), ("rows", vectors)):
        mine = by_row if name == "rows" else found[name]
        for _ in range(6):
            at = tuple(int(g.integers(0, s)) for s in ((len(values) - 1, *values.shape[1:]) if name == "rows" else values.shape))
            held = values[at].copy()
            values[at] = held + step
            up = loss()
            values[at] = held - step
            down = loss()
            values[at] = held
            assert abs((up - down) / (2 * step) - mine[at]) < 2e-3 + 0.02 * abs(mine[at]), (name, at)
