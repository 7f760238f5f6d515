"""Where no reading can have a known feature nothing is decoded, and the features are those of decoding everything."""

import random
from collections import Counter

import numpy as np

from pathloom.llm import toxicity

KNOWN = {f: i for i, f in enumerate(["idiot", "idi", "los$", "stu", "stup", "scum$", "ass$", "öde", "hhe", "aa$", "o$"])}


def random_model(seed):
    rng = np.random.default_rng(seed)
    return np.log(rng.dirichlet(np.ones(toxicity.N), (toxicity.N, toxicity.N))).astype(np.float32)


def decoded(text, model):
    """All words restored, then their features."""
    count = Counter()
    for m in toxicity._SPACED.findall(text.lower()):
        for word in toxicity._WORDS.findall(toxicity.restore(m, model)):
            count.update(toxicity.features(toxicity.restored_words(word, model)))
    for token in text.lower().split():
        count.update(toxicity.features(toxicity.restored_words(token, model)))
    return count


def odd_texts(seed, n=1500):
    rng = random.Random(seed)
    letters = "abdiorstulhecmößñ" * 3 + "   .-_*~@$!|+(€£#%&'\"013456789²½٣İ\t\n\x1c"
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            word = list(rng.choice(["idiot", "los", "stupid", "scum", "ass", "öde", "that", "s t u p", ""]))
            word = [c * rng.choice([1, 1, 1, 2, 3, 11]) + rng.choice(["", "", "", ".", "-", "!", "#"]) for c in word]
            parts.append("".join(word) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 6))))
        yield " ".join(parts)


def test_features_are_those_of_decoding_everything():
    for seed in range(3):
        model = random_model(seed)
        some, every = toxicity._Tokens(model, KNOWN), toxicity._Tokens(model)
        for text in odd_texts(seed):
            expected = decoded(text, model)
            assert dict(toxicity.feature_counts(text, every)) == dict(expected), repr(text)
            assert toxicity.feature_set(text, every) == set(expected), repr(text)
            assert dict(toxicity.feature_counts(text, some)) == {KNOWN[f]: n for f, n in expected.items() if f in KNOWN}, repr(text)
            assert not toxicity._SPACED.search(text.lower()) or toxicity._SINGLES.search(text.lower()), repr(text)


def test_only_what_can_matter_is_decoded(monkeypatch):
    model, calls, restore = random_model(0), [], toxicity.restore
    monkeypatch.setattr(toxicity, "restore", lambda s, m: calls.append(s) or restore(s, m))
    tokens = toxicity._Tokens(model, KNOWN)
    toxicity.feature_counts("theeatble wasshndti, antiing### feel-good m00m " * 3, tokens)
    assert calls == []
    toxicity.feature_counts("iddiot l0s x.id-iot feel", tokens)
    assert sorted(calls) == ["iddiot", "l0s", "x.id-iot"]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "TOKEN_BYTES", 20_000)
    model = random_model(0)
    for known in (KNOWN, None):
        tokens = toxicity._Tokens(model, known)
        for i in range(2000):
            toxicity.feature_counts(f"w{'abcdefghij'[i % 10] * (i % 7 + 1)}x{i} idiot", tokens)
            assert len(tokens) + len(tokens.none) < 130
        assert tokens.held <= 20_000
