"""Each operator against a plain version of its definition, on small tables with the odd rows that may occur."""

import collections
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("pathloom.llm")

from pathloom.llm import decontamination, html_text, mixing, near_dup, pii_surrogates, quality_rules, token_counts, token_files, toxicity, url_filter  # noqa: E402
from pathloom.llm.common import lower_ascii, words  # noqa: E402

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "Some TEXT, it's <|endoftext|> here 123 x y  z\n\n\nq"), (None, "lost words"), (7, "é İ Σ 한글 \U0001f600 don't\r\n x" * 20), (8, "w" * 30_000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, "src1", 0, "k", "r", "s") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def test_token_counts(odd, empty):
    path, own = tokenizer("byte_bpe_50k.json")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, path, head=5).collect()))
    want = sorted((i is None, i or 0, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ODD)
    assert got == want
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_files(spark, odd, empty):
    path, own = tokenizer("word_bpe_49k.json")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32, r.start) for r in token_files.token_digests(odd, path).collect()))
    start, want = 0, []
    for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), start))
        start += len(ids)
    assert got == sorted(want)
    assert token_files.token_digests(empty, path).count() == 0


def test_token_files_read_selectively(spark, tmp_path):
    import pyarrow.parquet as pq

    path, _ = tokenizer("word_bpe_49k.json")
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word number ', id) AS text", "'en' AS lang")
    token_files.write_tokens(docs, path, f"{tmp_path}/t", row_group_bytes=1 << 20, page_rows=64)
    part = token_files.read_tokens(spark, f"{tmp_path}/t", 100, 110, ("doc_id", "n_tokens"))
    assert [r.doc_id for r in part.orderBy("doc_id").collect()] == list(range(100, 111))
    plan = part._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    meta = pq.ParquetFile(next(tmp_path.glob("t/*.parquet"))).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)


def shingle_sets(rows):
    out = collections.defaultdict(set)
    for i, t in rows:
        w = words(lower_ascii(t or ""))
        n = min(5, len(w))
        out[i] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    return out


def components(sets, percent=85):
    own = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and own[a] != own[b]:
                lo, hi = sorted((own[a], own[b]))
                own = {k: lo if v == hi else v for k, v in own.items()}
    return own


def near_copies(n, seed):
    """A base and copies of copies, with one to four edits each."""
    rnd = random.Random(seed)
    texts = [[f"w{rnd.randrange(400)}" for _ in range(120)]]
    while len(texts) < n:
        t = list(rnd.choice(texts if rnd.random() < 0.3 else texts[:1]))
        for _ in range(rnd.randint(1, 4)):
            at = rnd.randrange(len(t))
            t[at : at + 1] = rnd.choice([[f"n{rnd.randrange(10**6)}"], [], [t[at], f"n{rnd.randrange(10**6)}"]])
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_near_duplicates(spark, odd, empty):
    rows = [*ODD, *enumerate(near_copies(150, 1), 100), *enumerate(near_copies(40, 2), 400), (900, "A B c d E f G")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs).collect()
    sets = shingle_sets([r for r in rows if r[0] is not None])
    want = components(sets)
    assert len(got) == len(rows)
    assert len(set(want.values())) > 20
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), r.doc_id == want[r.doc_id])
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.deduplicated(docs)
    assert kept.where("doc_id = 5").count() == 1


def test_differences_lose_no_link():
    """Of two documents that link, one not linked with the reference, the emitted elements share one that passes the place filter."""
    import math

    import pyarrow as pa

    texts = near_copies(60, 5)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 59), pa.array(range(1, 60)), pa.array([texts[0]] * 59), pa.array(texts[1:])], ["a", "b", "ta", "tb"])
    rows = next(near_dup._differences(85)([batch])).to_pylist()
    by = collections.defaultdict(dict)
    for r in rows:
        by[r["rep"]][r["element"]] = r
    sets = [near_dup.shingles(t) for t in texts]
    for x in range(1, 60):
        for y in range(1, 60):
            if x != y and near_dup._linked(sets[x], sets[y], 85) and not near_dup._linked(sets[0], sets[x], 85):
                common = [e for e in by[x].keys() & by[y].keys() if by[x][e]["x"] and by[y][e]["y"]]
                a, b = (next(iter(by[k].values())) for k in (x, y))
                least = math.ceil((a["size"] + b["size"] - 15 / 185 * (a["n"] + b["n"])) / 2 - 1e-9)
                assert any(min(a["size"] - by[x][e]["at"], b["size"] - by[y][e]["at"]) >= least for e in common)


def test_restoring():
    texts = ["the stupid idiot was a moron and a loser", "what a pathetic clown", "is it the one that was there"] * 50
    counts = np.zeros(toxicity.N**3, np.int64)
    import pyarrow as pa

    for b in toxicity._trigrams([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]):
        counts[b.column(0).to_numpy()] += b.column(1).to_numpy()
    model = toxicity.log_model(counts)
    for noisy, plain in (("1d10t", "idiot"), ("m0r0n", "moron"), ("st00pid", None), ("stuuuupid", "stupid"), ("cl0wn!", "clown"), ("l.o.s.e.r", "loser"), ("p@thet1c", "pathetic")):
        if plain:
            assert toxicity.restored_words(noisy, model)[:1] == [plain], noisy
    assert "stupid" in toxicity.restored_text("you are s t u p i d ok", model).split()
    assert toxicity.restored_text("that was the one", model) == "that was the one"


def test_viterbi_is_the_best_reading():
    rng = np.random.default_rng(0)
    model = np.log(rng.dirichlet(np.ones(toxicity.N), (toxicity.N, toxicity.N))).astype(np.float32)

    def readings(s, i=0):
        if i == len(s):
            yield "", 0.0
            return
        for out, to, cost in toxicity.arcs(s)[i]:
            for rest, more in readings(s, to):
                yield out + rest, cost + more

    def score(text, cost):
        a = b = 0
        total = -cost
        for c in text:
            z = toxicity.code(c)
            if z or b:
                total += float(model[a, b, z])
                a, b = b, z
        return total + float(model[a, b, 0]) * (b != 0)

    for s in ("1d10t", "aaab", "a.b-1", "s$s"):
        best = max(score(t, c) for t, c in readings(s))
        assert abs(max(score(t, c) for t, c in readings(s) if t == toxicity.restore(s, model)) - best) < 1e-4


def test_toxicity(spark, odd, empty):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        w = [rnd.choice("the and of with was that thing oned erth".split()) + rnd.choice(["", "er", "ly"]) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[rnd.randrange(60)] = rnd.choice(["stupid", "idiot", "moron", "lowei" + rnd.choice("abcdef")])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.Scorer(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in model.score(docs, ["doc_id", "toxic"]).select("*", toxicity.held_out().alias("held")).collect()}
    assert all(r.held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r.predicted == r.toxic for r in got.values() if r.held]) > 0.97
    out = model.score(odd, odd.columns, ("__s", "__p")).collect()
    assert len(out) == len(ODD) and all(0 <= r["__s"] <= 1 and r["__p"] == int(r["__s"] >= 0.5) for r in out)
    none = toxicity.Scorer(empty, docs.select("doc_id", "toxic").where("false"))
    assert none.score(odd, ["doc_id"]).count() == len(ODD)


def test_quality_statistics(spark, odd):
    rows = [*ODD, (20, "a b c a b c x y z\n# b\n# b\n \n"), (21, "x " * 300), (22, "good words of text " * 3 + "| |")]
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        w = words(t)
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        at = {k + j for k in range(len(w) - 2) if n[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at)] += 1
    assert got == want


def test_quality_rules(spark, odd, empty):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        w = [f"word{rnd.randrange(500)}" for _ in range(80)]
        bad = i % 5 == 0
        if bad:
            w = [x + ("|" if i % 10 else "!!") for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out, rules = quality_rules.judge(docs, lab)
    assert 1 <= len(rules) <= quality_rules.RULES
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in out.collect()]) > 0.99
    assert [r.kept for r in quality_rules.judge(odd, lab)[0].collect()] == [False] * len(ODD)
    assert quality_rules.judge(empty, lab.where("false"))[0].count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy the thing that is of use to you and the rest.</div>
<article><h1>A &amp; B</h1><p><b>First of the words<br>and  more.<br><p>One.</p><form><p>Your name</p></form><p>The second is a paragraph of the text &copy; with some of the words that are in it.</p>
<aside>Side</aside><div class="comments"><p>I think that this is the best of all the comments and that it is true.</p></div></article><footer>&copy; me</footer>"""


def test_html_text(spark):
    assert html_text.main_text(PAGE) == "A & B\n\nFirst of the words and more.\n\nOne.\n\nThe second is a paragraph of the text © with some of the words that are in it."
    plain = "<body><div>Home</div><div>" + "This is the text of a page and it is as long as it has to be for the rule. " * 4 + "</div><div>Short one.</div><div>" + "And the next of them is here with the words of the page. " * 5 + "</div><div><a href=x>Links of the page and more of them in a row</a></div></body>"
    assert html_text.main_text(plain).split("\n\n")[0].startswith("Home") and "Short one." in html_text.main_text(plain) and "Links" not in html_text.main_text(plain)
    for odd in (None, "", "<", "<!--", "<script>x", "<p", "a < b", "<p>" * 1000, "<div class='ad"):
        assert isinstance(html_text.main_text(odd), str)
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3 and all(r.n_chars == len(r.text) for r in got)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_decontamination(spark, odd, empty):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 12, 20, 21, 30])))) for i in range(30)] + [(90, None), (91, "...")]
    docs = []
    for i in range(150):
        t = [word() for _ in range(rnd.randint(5, 80))]
        if i % 3:
            part = rnd.choice(items[:30])[1].split()
            for _ in range(rnd.randint(0, len(part) // 4)):
                at = rnd.randrange(len(part))
                part[at : at + 1] = rnd.choice([[word()], [], [part[at], word()]]) or ["z"]
            at = rnd.choice([len(t), rnd.randrange(len(t))])
            t[at:at] = part
        docs.append((i, ", ".join(t).upper()))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word) for r in decontamination.find(df, bench).collect()}
    want = {}
    for d, t in docs:
        ws = decontamination.words_of(t)
        for i, x in items:
            w = decontamination.words_of(x)
            k = decontamination.most_edits(len(w))
            padded = ws + [None] * k
            found = [(e, s) for s in range(len(padded) - len(w) + 1) if w and (e := edit_distance(padded[s : s + len(w)], w)) <= k]
            if found:
                want[d, i] = min(found)
    assert not got.keys() - want.keys()
    assert len(got) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in want if want[k][0] == 0)
    left = decontamination.clean(df, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got} and left.columns == df.columns
    assert decontamination.clean(odd, bench).count() == len(ODD) and decontamination.find(empty, bench).count() == 0
    assert decontamination.find(df, bench.where("false")).count() == 0


def test_cgk_edits_match():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (50, 9)), rng.integers(0, 4, (50, 9))
    assert decontamination.edits(a, b).tolist() == [edit_distance(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_fill():
    assert mixing.fill(100, [("a", 1, 1000), ("b", 1, 1000)]) == {"a": 50, "b": 50}
    assert mixing.fill(100, [("a", 1, 10), ("b", 1, 1000), ("c", 2, 1000)]) == {"a": 10, "b": 30, "c": 60}
    assert mixing.fill(100, [("a", 1, 10), ("b", 0, 20)]) == {"a": 10, "b": 20}
    rnd = random.Random(1)
    for _ in range(200):
        parts = [(str(i), rnd.choice([0, 1, 2, 5]), rnd.randrange(50)) for i in range(rnd.randint(1, 6))]
        budget = rnd.randrange(150)
        got = mixing.fill(budget, parts)
        assert sum(got.values()) == min(budget, sum(m for _, _, m in parts)) and all(0 <= got[n] <= m for n, _, m in parts)


def test_mixing(spark, odd, empty):
    import hashlib

    rnd = random.Random(2)
    rows = [(i, " ".join(["x"] * rnd.randint(0, 40)), rnd.choice(["en", "de"]), f"src{rnd.choice([0, 1, 11, 17])}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = collections.defaultdict(list)
    for r in mixing.mix(docs, mixing.WEIGHTS, slices=16).collect():
        got[r.mix_domain, r.lang, r.source].append((r.mix_epoch, r.doc_id, r.mix_tokens, r.mix_take))
    kind = lambda s: "web" if int(s[3:]) < 10 else "books" if int(s[3:]) < 15 else "code"
    leaves = collections.defaultdict(list)
    for i, t, lang, s in rows:
        leaves[kind(s), lang, s].append((i, len(t.split())))
    total = sum(n for x in leaves.values() for _, n in x)
    plan = mixing.allocate([mixing.Leaf(k, sum(n for _, n in v)) for k, v in leaves.items()], mixing.WEIGHTS, int(0.9 * total), 2)
    for path, docs_ in leaves.items():
        size = sum(n for _, n in docs_)
        whole, rest = divmod(plan[path], size)
        want = [(e, i, n, n) for e in range(whole) for i, n in docs_]
        before = 0
        for _, i, n in sorted((int(hashlib.md5(f"mix-1|{whole}|{i}".encode()).hexdigest()[:15], 16), i, n) for i, n in docs_):
            if before < rest:
                want.append((whole, i, n, min(n, rest - before)))
            before += n
        assert sorted(got[path]) == sorted(want)
    assert sum(x[3] for v in got.values() for x in v) == int(0.9 * total)
    assert mixing.mix(odd, mixing.WEIGHTS).count() > 0 and mixing.mix(empty, mixing.WEIGHTS).count() == 0


def test_url_filter(spark):
    from datetime import datetime as d

    entries = spark.createDataFrame([("a", "domain", "Bad.com", d(2023, 1, 1), "add"), ("a", "domain", "bad.com", d(2023, 3, 1), "remove"), ("a", "domain", "bad.com", d(2023, 5, 1), "add"), ("b", "prefix", "x.org/p/q", d(2023, 1, 1), "add"), ("b", "prefix", "x.org/p/q", d(2023, 1, 1), "add"), ("c", "url", "http://y.net/?z", d(2023, 2, 1), "add"), ("c", "url", "http://y.net/?z", d(2023, 2, 1), "remove"), ("d", "host", "x.org", d(2024, 1, 1), "add")], "list string, kind string, pattern string, date timestamp, action string")
    rows = [(1, "http://www.bad.com/", d(2023, 2, 1)), (2, "http://BAD.com.:80/x", d(2023, 3, 1)), (3, "https://u@a.b.bad.com", d(2023, 6, 1)), (4, "http://notbad.com/", d(2023, 2, 1)), (5, "http://x.org/p/q/r", d(2023, 2, 1)), (5, "http://x.org/p/q/r", d(2023, 2, 1)), (6, "http://x.org/p/qq", d(2023, 2, 1)), (7, "http://y.net/?z", d(2023, 3, 1)), (8, None, d(2023, 3, 1)), (9, "no url", None), (10, "http://bad.com", None), (11, "http://bad.com/", d(2022, 12, 31))]
    got = sorted((r.page_id, r.lists) for r in url_filter.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetched timestamp"), entries).collect())
    assert got == [(1, "a"), (2, ""), (3, "a"), (4, ""), (5, "b"), (5, "b"), (6, ""), (7, ""), (8, ""), (9, ""), (10, ""), (11, "")]
    assert url_filter.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetched timestamp").where("false"), entries).count() == 0


def test_surrogates(spark, odd, empty):
    text = "Mail Anna.B@mail.example.com or anna.b@MAIL.example.com, call +1 (386) 555-3733 or +1-386-555-3733; card 4539 1488 0343 6467 from 10.20.30.40. Mrs Ann Miller and Mr Bob Miller met Frau Иванова."
    rows = [(1, text), (1, text), (2, "nothing here"), *[(i + 10, t) for i, t in ODD if i]]
    rows += [(1000 + i, f"Mr {n} Stone wrote to a{i}@x.org") for i, n in enumerate(f"N{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200))]
    got = {}
    for r in pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    a, b = got[1]
    assert a.text == b.text and (a.n_email, a.n_phone, a.n_card, a.n_ip, a.n_name) == (2, 2, 1, 1, 3)
    import re

    m = re.fullmatch(r"Mail (\S+) or (\S+), call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4}); card (\d{4} \d{4} \d{4} \d{4}) from (\d+\.\d+\.\d+\.\d+)\. Mrs (\w+) (\w+) and Mr (\w+) (\w+) met Frau (\w+)\.", a.text)
    assert m, a.text
    assert m[1].lower() == m[2].lower() and m[1].endswith(".com") and m[1][0].isupper()
    assert m.group(3, 4, 5) == m.group(6, 7, 8) and m[9][0] == "4" and all(int(x) < 256 for x in m[10].split("."))
    digits = [int(c) for c in m[9].replace(" ", "")]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert m[11] in pii_surrogates.GIVEN["latin"]["f"] and m[13] in pii_surrogates.GIVEN["latin"]["m"] and m[12] == m[14] != "Miller"
    assert all("а" <= c.lower() <= "я" for c in m[15]) and m[15] != "Иванова"
    assert got[2][0].text == "nothing here" and got[11][0].text is None
    names = [re.match(r"Mr (.+) wrote to (\S+)$", got[1000 + i][0].text).groups() for i in range(200)]
    assert len({n for n, _ in names}) == 200 and len({e for _, e in names}) == 200
    assert pii_surrogates.replace(empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, before, d).cache()
        assert docs.columns == before.columns, name
        if name == "near_duplicates":
            own = components(shingle_sets([(r.doc_id, r.text) for r in before.collect()]))
            assert {r.doc_id for r in docs.collect()} == set(own.values())
        before = docs
    out = corpus_pipeline.STAGES[-1][1](spark, before, d)
    assert out.count() == before.count()
