"""Rules of the operators against plain versions, on made-up cases."""

import math
import random

import numpy as np
import pytest
import xxhash

pytest.importorskip("pathloom.llm")

from pathloom.llm import decontamination, html_text, near_dup, pii_surrogates, token_files  # noqa: E402

RUSSIAN = ["Вчера вечером жители города собрались перед ратушей, чтобы послушать речь мэра. " * 4, "Затем они отправились домой и обсуждали услышанное до поздней ночи. " * 4]


def test_pages_without_a_container():
    text = "This is the one paragraph of the page and it has as many as eighty characters."
    assert html_text.main_text(f"<h1>Title of it</h1><p>{text}</p>") == f"Title of it\n\n{text}"
    assert html_text.main_text("".join(f"<p>{x}</p>" for x in RUSSIAN)) == "\n\n".join(x.strip() for x in RUSSIAN)


def test_elements_in_a_line():
    page = lambda x: html_text.main_text(f"<article>{x}</article>")
    assert page('<p>Hello there my friend <span class="ad">BUY NOW</span> and the world.</p>') == "Hello there my friend and the world."
    assert page('<p><span class="ad">one <span>two</span> three</span> and the end.</p>') == "and the end."
    assert page("<p>Text of it.</p><a href=x><div>Read more stories about this and that</div></a><p>More.</p>") == "Text of it.\n\nMore."
    assert page("<p>One <b>two<p>three</b> four") == "One two\n\nthree four"
    assert page("<p>" + "word " * 200_000 + "</p>").count("word") == 200_000 and page("<p>x</p>" * 20_000).count("x") == 20_000


def test_second_pass_is_nearest_neighbours():
    rnd = random.Random(0)
    for _ in range(300):
        labels = [rnd.choice([html_text.GOOD, html_text.BAD, html_text.OPEN, html_text.OPEN]) for _ in range(rnd.randint(1, 9))]
        found = [html_text.Block("x", 0, False, rnd.random() < 0.2) for _ in labels]
        want = []
        for i, x in enumerate(labels):
            own = int(found[i].main)
            before = next((j for j in range(i, -1, -1) if labels[j] is not None), None)
            after = next((j for j in range(i, len(labels)) if labels[j] is not None), None)
            near = [j for j in (before, after) if j is not None]
            if x is None and own:
                x = html_text.GOOD
            elif x is None:
                least = min((abs(i - j) for j in near), default=0)
                votes = {labels[j] for j in near if abs(i - j) == least}
                x = votes.pop() if len(votes) == 1 else own
            want.append(x)
        assert html_text.second_pass(found, labels) == want


def test_empty_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("lengths", [(4, 5), (9, 10), (14, 15), (3, 10, 24, 25)])
def test_item_lengths(lengths):
    """Passages with as many substitutions as allowed, whatever other lengths the benchmark has."""
    rnd = random.Random(sum(lengths))
    items = [(i, " ".join(f"w{rnd.randrange(5000)}" for _ in range(lengths[i % len(lengths)]))) for i in range(40)]
    texts, hold = [], []
    for _ in range(400):
        i, x = rnd.choice(items)
        part = x.split()
        for at in rnd.sample(range(len(part)), decontamination.most_edits(len(part))):
            part[at] = f"n{rnd.randrange(10**6)}"
        around = [f"v{rnd.randrange(10**6)}" for _ in range(30)]
        texts.append(" ".join(around[:15] + part + around[15:]))
        hold.append(i)
    block = decontamination.Items(items)
    found = [{block.by_length[n][0][k] for n, k in x} for x in block.search(texts)]
    assert np.mean([i in x for i, x in zip(hold, found, strict=True)]) >= 0.95


def test_blocks_of_items(spark):
    docs = spark.createDataFrame([(i, f"a b c item number {'abcdef'[i]} of the list d e f", "x") for i in range(6)], "doc_id long, text string, searched string")
    bench = spark.createDataFrame([(i, f"item number {'abcde'[i]} of the list") for i in range(5)], "item_id long, text string")
    whole, parts = ({(r.doc_id, r.item_id) for r in decontamination.find(docs, bench, n).collect()} for n in (100, 2))
    assert whole == parts and {d for d, _ in whole} >= set(range(5))
    assert decontamination.clean(docs, bench, 2).columns == docs.columns and decontamination.clean(docs, bench, 2).count() == decontamination.clean(docs, bench).count()


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_reach_the_match_threshold(percent):
    """Coordinates agree as often as sets are similar, and the threshold stands below their spread."""
    rng = np.random.default_rng(percent)
    n, matches = 200, []
    both = math.ceil(2 * n * percent / (100 + percent))
    for _ in range(1500):
        pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
        matches.append(int((near_dup.signature(np.sort(pool[:n])) == near_dup.signature(np.sort(pool[n - both :]))).sum()))
    mean = np.mean(matches) / near_dup.COORDS
    assert abs(mean - both / (2 * n - both)) < 0.01
    assert np.std(matches) < 1.15 * math.sqrt(near_dup.COORDS * mean * (1 - mean))
    assert min(matches) >= near_dup.least_matches(percent)


def test_prefix_of_sets_loses_no_link():
    """Texts that link share one of the elements kept of each, whatever the order."""
    import pyarrow as pa

    rnd = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = f"n{rnd.randrange(50)}"
        texts.append(" ".join(t))

    class Counts:
        value = np.random.default_rng(1).integers(0, 9, near_dup.CELLS)

    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array([True] * 60), pa.array(texts)], ["rep", "comp", "x", "text"])
    by = {}
    for part in near_dup._rarest(Counts, 85)([batch]):
        for r in part.to_pylist():
            by.setdefault(r["rep"], {})[r["element"]] = r
    sets = [near_dup.shingles(t) for t in texts]
    for x in range(60):
        for y in range(x):
            if near_dup._linked(sets[x], sets[y], 85):
                least = math.ceil(85 * (len(sets[x]) + len(sets[y])) / 185 - 1e-9)
                assert any(min(by[k][e]["n"] - by[k][e]["at"] for k in (x, y)) >= least for e in by[x].keys() & by[y].keys())


def shifted(s, key, moves):
    out = ""
    for i, c in enumerate(s):
        p = pii_surrogates.LETTERS.find(c)
        if p >= 0:
            block = next(x for x in pii_surrogates.alphabets() if c in x)
            h = xxhash.xxh64_intdigest(key.encode(), seed=42)
            by = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=h)
            by -= (1 << 64) if by >> 63 else 0
            by = 1 + by % (len(block) - 1) if moves and i == 0 else by % len(block)
            c = block[(block.index(c) + by) % len(block)]
        out += c
    return out


def permuted(key, tweak, s):
    import hashlib

    sha = lambda *x: hashlib.sha256("|".join((key, *x)).encode()).hexdigest()
    half = math.ceil(len(s) / 2)
    left, right = s[:half], s[half:]
    for i in range(1, (1 if len(s) <= pii_surrogates.SHORT_WORD else pii_surrogates.FEISTEL_ROUNDS) + 1):
        tag = f"{tweak}|{len(s)}|{i}"
        left = shifted(left, sha(tag, "l", right), True)
        right = shifted(right, sha(tag, "r", left), False)
    return left + right


def test_permutation(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abcdeé0я-ώ") for _ in range(rnd.randint(1, 9))) for _ in range(400)} | {a + b for a in "aeb" for b in "cdio"})
    got = {r.s: r.p for r in spark.createDataFrame([(w,) for w in words], "s string").select("s", pii_surrogates.permuted("k", "t", F.col("s")).alias("p")).collect()}
    assert got == {w: permuted("k", "t", w) for w in words}
    assert len(set(got.values())) == len(got)
    assert all(got[w] != w for w in words if len(w) <= 6 and w[0] not in "-")


def test_no_name_stays(spark):
    names = ["Łęść", "Ώήύ", "Élodie Ôçé", "Åse Øå", "A Stone", "Иван Петров", "J. R. Tolkien", "Jo", "Ng"]
    rows = spark.createDataFrame([(i, f"saw Mr {n}, and +1 386-555-3733 or +13865553733.") for i, n in enumerate(names)] + [(None, "Mr Jo"), (99, "x " * 300_000 + "Mr Jo")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii_surrogates.replace(rows).collect()}
    for i, n in enumerate(names):
        left = got[i].text.split(",")[0].split()[2:]
        assert len(left) == len(n.split()) and not set(left) & set(n.split()), got[i].text
        a, b = got[i].text.split("and ")[1].rstrip(".").split(" or ")
        assert a.replace(" ", "").replace("-", "") == b != "+13865553733"
    assert got[None].text == got[99].text[-len(got[None].text) :] != "Mr Jo"


def test_ids_of_odd_texts():
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, rnd = Tokenizer.from_file(path), random.Random(1)
    alphabet = [*"abAB'stred \t\n\r\x0b\x0c\x1c\x85\xa0 ÉéİΣς한\U0001f600́\xad​0²½1@#.,-_!", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(3000)] + [None, "", "w" * 50_000]
    flat, counts = token_files.Encoder(path).encode(pa.array(texts), 2)
    assert flat.tolist() == [i for t in texts for i in [*own.encode(t or "", add_special_tokens=False).ids, 2]] and counts.sum() == len(flat)


def test_decontamination_words_of_bytes_and_flags_of_pairs(monkeypatch):
    """Latin-1 texts are cut as others are, and items are found alike with and without the table of pairs."""
    from pathloom.llm import decontamination as d

    every = "".join(map(chr, range(256)))
    for text in (every, every[::-1], "A_b  CÉé-µß\xa0x\x85y ", "_", ""):
        assert [w.decode("latin-1") for w in d.byte_words(text)] == d.words_of(text)
    assert d.byte_words("a ā") is None
    items = [(1, "Der Übel sieben große Köpfe im Haus am See"), (2, "one two three four five six seven eight nine ten eleven"), (3, "α β one two three four five"), (4, "solo")]
    texts = [None, "", "x der übel sieben große köpfe im haus am see y", "x der übel sieben große köpfe im haus am see — y", "one two three four five six seven 8 nine ten eleven", "Α Β ONE two three four five, solo", "_solo_"]
    got = d.Items(items).search(texts)
    monkeypatch.setattr(d, "PAIR_FLAGS", 0)
    assert got == d.Items(items).search(texts)
    assert [sorted(n for n, _ in x) for x in got] == [[], [], [9], [9], [11], [1, 7], [1]]
