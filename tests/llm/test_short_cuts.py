"""Quicker forms of inner steps give what the plain ones give."""

import unicodedata

import numpy as np
import pytest

pytest.importorskip("demandloom.llm")

from demandloom.llm import jaccard, toxicity  # noqa: E402


def folded_letter_by_letter(text):
    marks = {chr(c) for c in range(0x300, 0x370)}
    low = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if c not in marks)
    shown = "".join(toxicity.LOOK_ALIKE.get(c, c) for c in low)
    return " " + " ".join("".join(c if c.isalpha() else " " for c in shown).split()) + " "


def test_folded_texts_equal_letter_by_letter():
    rng = np.random.default_rng(5)
    ascii_signs = [chr(c) for c in range(128)]
    texts = ["", " ", "\x00\x1f", "".join(ascii_signs), "é", "Straße 5", "привет, MоrØn", "ﬁ ½ ²", "日本_語"]
    texts += ["".join(rng.choice(ascii_signs, 40)) for _ in range(300)]
    texts += ["".join(rng.choice([*"aZ5_-! ", "é", "ñ", "о", "ß", "́"], 20)) for _ in range(300)]
    assert [toxicity.fold(t) for t in texts] == [folded_letter_by_letter(t) for t in texts]


def test_texts_of_ascii_are_folded_without_the_pattern(monkeypatch):
    class Refused:
        def sub(self, *_):
            raise AssertionError("bytes are enough")

    monkeypatch.setattr(toxicity, "_NOT_LETTERS", Refused())
    assert toxicity.fold("1d!0t  Mor3, café") == " idiot more cafe "


def test_order_of_signatures_equals_a_sort_by_all_columns():
    rng = np.random.default_rng(6)
    for n, most in ((0, 1), (1, 1), (2, 1), (500, 1), (500, 40), (500, 10**6)):
        keys = rng.integers(0, most, n).astype(np.uint64)
        owners, tags = rng.integers(-3, 3, n), rng.integers(0, 3, n).astype(np.uint8)
        by_all = np.lexsort((tags, owners, keys))
        order = jaccard._order(keys, owners, tags)
        assert sorted(order.tolist()) == list(range(n))
        for column in (keys, owners, tags):
            assert (column[order] == column[by_all]).all()


@pytest.mark.parametrize("buckets", [3, 255, 256, 65_535, 65_536, 70_000])
def test_blocks_hold_every_entry_in_its_bucket(buckets):
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    owners, tags = np.arange(3000), np.zeros(3000, np.uint8)
    found = jaccard._emit(keys.copy(), owners.copy(), tags.copy(), buckets)
    held = {}
    for bucket, block in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        n = len(block) // 15
        held |= dict.fromkeys(np.frombuffer(block, np.int64, n, 6 * n).tolist(), bucket)
    assert held == {k: int(key) % buckets for k, key in enumerate(keys)}
