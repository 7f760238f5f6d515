"""Disguised words of any length."""

import numpy as np
import pyarrow as pa

from pathloom.llm import toxicity


def model():
    texts = ["the stupid idiot was a moron and a loser with all the trash", "what a pathetic clown you are", "is it the one that was there"] * 50
    counts = np.zeros(toxicity.N**3, np.int64)
    for b in toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]):
        counts[b.column(0).to_numpy()] += b.column(1).to_numpy()
    return toxicity.log_model(counts)


def test_lightly_disguised_words():
    m = model()
    for noisy, plain in (("st.upid", "stupid"), ("id-iot", "idiot"), ("tra_sh", "trash"), ("stuupid", "stupid"), ("stu..pid", "stupid"), ("all", "all")):
        assert toxicity.restored_words(noisy, m) == [plain], noisy
    assert all(toxicity._SIGNS.search(x) for x in ("a55", "a55,", "scu*", "scu#"))
    assert not any(toxicity._SIGNS.search(x) for x in ("one", "it's", "word.", "2024"))


def test_long_disguises():
    m = model()
    assert toxicity.restored_words("stu" + "u" * 30_000 + "pid", m) == ["stupid"]
    assert toxicity.restored_words(".".join("stupid" * 20), m)[:1] and "stupid" in " ".join(toxicity.restored_words(".".join("stupid" * 20), m))
    spelled = " ".join("youareastupididiot" * 300)
    assert "stupid" in toxicity.restored_text(spelled, m)
    found = toxicity.feature_counts(spelled, toxicity._Tokens(m))
    assert any(len(f) > 2 for f in found)
