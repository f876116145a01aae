"""Scores of the network against a plain loop over characters, words and windows."""

import math
import random

import numpy as np
import pyarrow as pa
import regex

from glossa.llm import toxicity

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def inputs(word, words, grams):
    """A word's vector, and the greatest coordinates of its n-grams' vectors."""
    value = [mix(ord(c) + 0xABCDEF & M) for c in f" {word} "]
    shift = 64 - toxicity.BITS
    whole = mix(sum(mix(v + k * 0x9E3779B97F4A7C15 & M) for k, v in enumerate(value)) & M) >> shift
    slots = []
    for n in toxicity.ORDERS:
        for k in range(len(value) - n + 1):
            code = value[k]
            for v in value[k + 1 : k + n]:
                code = code * 0x5851F42D4C957F2D + v & M
            slots.append(mix(code + n & M) >> shift)
    found = [grams[s] for s in slots]
    return [*words[whole], *(max(g[d] for g in found) if found else 0.0 for d in range(toxicity.CHAR_DIM))]


def gate(x):
    return 1 / (1 + math.exp(-x))


def states(xs, W, U, b):
    h, H, out = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN, []
    for x in xs:
        g, s = x @ W + b, h @ U
        z = np.array([gate(v) for v in g[:H] + s[:H]])
        r = np.array([gate(v) for v in g[H : 2 * H] + s[H : 2 * H]])
        n = np.tanh(g[2 * H :] + r * s[2 * H :])
        h = (1 - z) * n + z * h
        out.append(h)
    return out


def plain(text, p, words, grams):
    tokens = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
    if not tokens:
        return 0.0
    xs, best, first = [np.array(inputs(t, words, grams)) for t in tokens], -math.inf, 0
    while True:
        part = xs[first : first + toxicity.WINDOW]
        f, b = states(part, p["Wf"], p["Uf"], p["bf"]), states(part[::-1], p["Wb"], p["Ub"], p["bb"])[::-1]
        wide = [np.concatenate(w) for w in zip(f, b, part)]
        e = [np.tanh(w @ p["A"] + p["a"]) @ p["v"] for w in wide]
        weight = [math.exp(v - max(e)) for v in e]
        pooled = sum(w * a for w, a in zip(wide, weight)) / sum(weight)
        best = max(best, float(pooled @ p["o"] + p["c"][0]))
        if first + toxicity.WINDOW >= len(xs):
            return gate(best)
        first += toxicity.STRIDE


def test_scores_equal_a_plain_loop():
    rng, pick = np.random.default_rng(3), random.Random(3)
    p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.3) for k, v in toxicity.start_weights().items()}
    words, grams = (rng.standard_normal((1 << toxicity.BITS, 4)).astype(np.float32) for _ in range(2))
    make = lambda n: " ".join("".join(pick.choice("abcdeé日") for _ in range(pick.randint(1, 9))) for _ in range(n))
    texts = [None, "", " .,!", "a", "A b\tC.d", make(63), make(64), make(65), make(112), make(113), make(700), make(5) + "\n" + make(5), "x" * 3000]
    got = toxicity.score_texts({"weights": p, "word": words, "gram": grams}, pa.array(texts, pa.string()))
    assert np.allclose(got, [plain(t, p, words, grams) for t in texts], atol=2e-5)
    assert len(set(np.round(got, 6))) > 8
