"""Hints and short cuts of the secret scan lose no span."""

import re

import numpy as np
import pytest

pytest.importorskip("demandloom.llm")

from demandloom.llm import secrets  # noqa: E402


def spans_by_every_pattern(text):
    found = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), m.end(), "access") for m in secrets.ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in secrets.HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], secrets.KINDS.index(s[2]), s[1]))


def odd_texts(count=400):
    rng = np.random.default_rng(11)
    keys = ["PassWord", "passwd", "SECRET", "tokEn", "api_key", "ApiKey", "apiKey", "ſecret", "toKen", "paßword", "İ", "akia", "AKIA"]
    signs = [" = ", ":", "='", " ", "\n", "\t", "=>", '": "', "_", "+", "/", "."]
    parts = ["hunter22x", "deadbeef", "wiLd", "CAPS", "CAP", "x" * 23, "y" * 24, "Z" * 25, "é", "日本", "0", "word", "AKIA0123456789AB"]
    for _ in range(count):
        hexes = ["a1" * int(rng.integers(0, 40)) + "f" * int(rng.integers(0, 2)), "e" * int(rng.integers(29, 36))]
        choices = [keys, signs, parts, hexes]
        yield "".join(str(rng.choice(choices[rng.integers(4)])) for _ in range(int(rng.integers(0, 30))))


def test_hints_lose_no_pattern():
    texts = [*odd_texts(), *("." * k + "0f" * 16 + "!" * j for k in range(9) for j in range(5)), "", "a" * 31, "a" * 32]
    found = [secrets.pattern_spans(t) for t in texts]
    assert found == [spans_by_every_pattern(t) for t in texts]
    assert {kind for spans in found for _, _, kind in spans} == {"assign", "access", "hex"}


def test_patterns_run_only_where_a_hint_stands(monkeypatch):
    class Refused:
        def finditer(self, text):
            raise AssertionError("a text without a hint needs no search")

    monkeypatch.setattr(secrets, "ASSIGN", Refused())
    monkeypatch.setattr(secrets, "HEX", Refused())
    assert secrets.pattern_spans("plain words, one after the other, face to face " * 50) == []


def test_plain_tokens_are_those_without_a_trigger_anywhere():
    trigger = re.compile(r"[0-9_+/]|[a-z][A-Z]|[A-Z]{4}|[A-Za-z]{24}")
    rng = np.random.default_rng(12)
    tokens = ["".join(rng.choice(list("abcXYZ"), int(rng.integers(1, 30)))) for _ in range(300)]
    tokens += ["".join(rng.choice(list("abéA-._"), int(rng.integers(1, 30)))) for _ in range(300)]
    tokens += ["a" * n for n in range(1, 30)] + ["é" + "a" * n for n in range(22, 26)] + ["-".join(["a" * 23] * 2), "A+", "a1"]
    for token in tokens:
        assert bool(secrets.shape(token)) == bool(trigger.search(token))


def test_runs_of_a_text_are_those_of_its_lines():
    for text in odd_texts():
        at, expected = 0, []
        for line in text.split("\n"):
            expected += [([(a + at, b + at) for a, b in p], [f[:-1] for f in fs]) for p, fs in secrets.runs(line)]
            at += len(line) + 1
        assert [(p, [f[:-1] for f in fs]) for p, fs in secrets.runs(text)] == expected


def test_fit_takes_in_runs_of_every_length():
    examples = [e for t in odd_texts(150) for e in secrets.examples_of(t)]
    assert {len(tags) for _, tags in examples} >= {1, 2, 3}
    model = secrets.fit(examples, steps=30)
    hits = [(model.tags(features), tags) for features, tags in examples]
    assert sum(found == tags for found, tags in hits) > 0.6 * len(hits)
    # probabilities of the three tags add up: the gradient of a weight is zero where the tags are as expected
    assert model.trained and all(np.isfinite(w).all() for w in model.weights.values())
    x = np.random.default_rng(3).normal(size=(4, 5, 3, 3)) * 50
    for axis in (2, 3):
        assert np.allclose(secrets._logsum(x, axis), np.log(np.exp(x - x.max()).sum(axis)) + x.max())
