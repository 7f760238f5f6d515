"""Toxicity of noisy text: restore disguised words, then score the restored text.

1. A character trigram model with word ends is counted over every text of the corpus.
2. Tokens that show signs of disguise (digits or symbols beside letters, separators within them,
   letters repeated, single letters set apart) become a lattice: each character may stand for itself, for the
   letters it imitates, for one or two of a repeated run, or for nothing where it only
   separates. A Viterbi decode under the trigram model picks the restored words. Tokens
   without such signs have one path through the lattice, themselves.
   Once the features of 3. are known, tokens of which no reading can have one are not decoded.
3. A logistic regression on stem features of the restored words scores the text. Features are
   word beginnings of STEMS letters and short whole words; those that go with label 1 are kept
   by their chi-squared statistic. It is fitted on at most SAMPLE labelled rows, chosen by hash
   of doc_id, so what is broadcast and what reaches the driver is bounded.

Labels are read only for rows with crc32(doc_id as text) mod 5 other than 0; score inputs are
the text alone. Defined cases: null and empty texts get the score of a text without features;
a doc_id with several labels has the largest; rows with equal doc_id are scored each for
itself; without labelled rows, or with one class only, all scores are that class's rate;
in what is restored, runs of over RUN equal characters count as RUN; a null doc_id is not
held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import Bounded, blocks_of, fresh, table, tidied, written

SAMPLE = 40_000
FEATURES = 512
LEAST_TOXIC = 5
STEMS = (3, 4, 5, 6)
RUN = 8
HELD = 200_000
TOKEN_BYTES = 64 << 20

# Letters that a character can imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
SEPARATORS = " .-_*~"
SUBSTITUTE, SKIP, SHORTEN, JOIN = 1.0, 3.0, 1.0, 0.2

#: Symbols of the model: 0 word end, a-z, the letters of Latin-1, one for digits, one for all other letters.
N = 64
_DIGIT, _OTHER = 60, 61
_CODES = np.zeros(65_536, np.int32)
_CODES[[c for c in range(65_536) if chr(c).isalpha()]] = _OTHER
_CODES[97:123] = np.arange(1, 27)
_CODES[0xDF:0x100] = np.arange(27, 60)
_CODES[[0xD7, 0xF7]] = 0
_CODES[48:58] = _DIGIT
_CODES[0xD800:0xE000] = _OTHER

_SIGNS = re.compile(r"[^\W\d_][0-9@$!|+(€£*#]+[^\W\d_]|(?<![\w.])[0-9@$!|+(€£]+[^\W\d_]{2}|[^\W\d_][0-9@$!|+€£*#]++\W*+$|([^\W\d_])\1|[^\W\d_][.\-_*~]++[^\W\d_]")
_RUNS = re.compile(rf"(.)\1{{{RUN},}}", re.S)
_SPACED = re.compile(r"(?<![\w@$!|])(?:[^\W_]|[@$!|])(?:[ .\-_*~](?:[^\W_]|[@$!|])){2,}(?![\w@$!|])")
#: What each match of _SPACED has in it, found faster: its second and third letter.
_SINGLES = re.compile(r"[ .\-_*~][\w@$!|][ .\-_*~][\w@$!|](?![^\W_]|[@$!|])")
_WORDS = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"(.)\1+", re.S)


@lru_cache(4096)
def code(c: str) -> int:
    return int(_CODES[ord(c)]) if ord(c) < 65_536 else _OTHER


# The character model


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(N**3, np.int64)

    def count(text: str) -> None:
        c = _CODES[np.frombuffer(f" {text.lower()} ".encode("utf-16-le", "replace"), "<u2")]
        if len(c) > 2:
            counts[:] += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)

    for batch in batches:
        held, size = [], 0
        for text in batch.column(0):
            if t := text.as_py():
                held.append(t)
                size += len(t)
                if size > 1_000_000:
                    count(" ".join(held))
                    held, size = [], 0
        if held:
            count(" ".join(held))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(counts[at])], ["at", "n"])


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) as an array by a, b, c: trigrams, bigrams and letters in a fixed mixture. What stands before a word end doesn't count."""
    c = counts.reshape(N, N, N).astype(float)
    c[:, 0, :] = c[:, 0, :].sum(axis=0)
    two, one = c.sum(axis=0), c.sum(axis=(0, 1)) + 1.0
    p1 = one / one.sum()
    p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
    p3 = (c + 4 * p2[None]) / (c.sum(axis=2, keepdims=True) + 4)
    return np.log(0.9 * p3 + 0.1 * p2[None]).astype(np.float32)


def corpus_model(docs: DataFrame) -> np.ndarray:
    """The model over all texts; N**3 counts at most come to the driver."""
    counts = np.zeros(N**3, np.int64)
    for r in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(_trigrams), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.at] = r.n
    return log_model(counts)


# The lattice


def arcs(s: str) -> list[list[tuple[str, int, float]]]:
    """For each position of s: what it can be read as, the position after it, and the cost."""
    out: list[list[tuple[str, int, float]]] = []
    for i, c in enumerate(s):
        here: list[tuple[str, int, float]] = []
        if c.isalpha():
            here.append((c, i + 1, 0.0))
            r = 1
            if i == 0 or s[i - 1] != c:
                while i + r < len(s) and s[i + r] == c:
                    r += 1
            if r >= 2:
                here.append((c, i + r, SHORTEN if r > 2 else 3 * SHORTEN))
                if r > 2:
                    here.append((c + c, i + r, SHORTEN))
        else:
            here.extend((x, i + 1, SUBSTITUTE) for x in IMITATES.get(c, ""))
            if c in SEPARATORS:
                here.append(("", i + 1, JOIN))
            elif not c.isdigit():
                here.append(("", i + 1, SKIP))
            here.append((c if c.isdigit() else " ", i + 1, 0.0))
        out.append(here)
    return out


def _spelled(read: tuple) -> str:
    out = []
    while read:
        read, piece = read
        out.append(piece)
    return "".join(reversed(out))


def restore(s: str, model: np.ndarray) -> str:
    """The best reading of s (lower case) under the model."""
    s = _RUNS.sub(lambda m: m[1] * RUN, s)
    # Two letters are one number, a * N + b. What was read is a chain of pieces from the last to the first.
    log_p = model.reshape(-1).data
    best: list[dict[int, tuple[float, tuple]]] = [{} for _ in range(len(s) + 1)]
    best[0][0] = (0.0, ())
    for i, here in enumerate(arcs(s)):
        reached, best[i] = best[i], {}
        coded = [(out, best[to], cost, [code(c) for c in out]) for out, to, cost in here]
        for before, (score, read) in reached.items():
            for out, ahead, cost, letters in coded:
                two, total = before, score - cost
                for z in letters:
                    last = two % N
                    if z or last:  # word ends in a row are one
                        total += log_p[two * N + z]
                        two = last * N + z
                held = ahead.get(two)
                if held is None or held[0] < total:
                    ahead[two] = (total, (read, out))
    if not best[-1]:
        return s
    end = [(score + log_p[two * N] * (two % N != 0), read) for two, (score, read) in best[-1].items()]
    top = max(score for score, _ in end)
    return max(_spelled(read) for score, read in end if score == top)


def restored_words(token: str, model: np.ndarray) -> list[str]:
    """The words of a token in lower case, restored where it shows signs of disguise."""
    letters = token.isalpha()
    if (_TWICE if letters else _SIGNS).search(token):
        token = restore(token, model)
    elif letters:
        return [token]
    return _WORDS.findall(token)


def restored_text(text: str, model: np.ndarray) -> str:
    """The whole text in lower case with disguised words restored: what is scored."""
    text = _SPACED.sub(lambda m: restore(m[0], model), text.lower())
    return " ".join(w for token in text.split() for w in restored_words(token, model))


def features(words: list[str]) -> set[str]:
    out = set()
    for w in words:
        if len(w) <= max(STEMS):
            out.add(w + "$")
        out.update(w[:k] for k in STEMS if len(w) >= k)
    return out


class _Tokens(Bounded):
    """Features of a token, remembered; only those in known, if given. Tokens without features are in none."""

    def __init__(self, model: np.ndarray, known: dict[str, int] | None = None):
        super().__init__(TOKEN_BYTES)
        self.model, self.known = model, known
        self.none: set[str] = set()
        self.names: dict[str, str] = {}
        self.heads = {f.removesuffix("$")[: STEMS[0]] for f in known or ()}
        self.begins, self.whole = ({_TWICE.sub(r"\1", f.removesuffix("$")) for f in known or () if f.endswith("$") == end} for end in (False, True))
        self.starts = {f[:i] for f in self.begins | self.whole for i in range(1, len(f) + 1)}

    def clear(self) -> None:
        super().clear()
        self.none.clear()
        self.names.clear()

    def possible(self, token: str) -> bool:
        """Whether a reading of the token can have a known feature: runs of a letter count as one on both sides, so that false is certain."""
        plain, opens, live = token.isalpha(), True, set()
        for c in token:
            if c.isalpha():
                read, ahead = c, set()
            elif c.isalnum() and not c.isdecimal():
                return True
            elif live.isdisjoint(self.whole):
                read, ahead = IMITATES.get(c, ""), set(live)
            else:
                return True
            for x in read:
                for before in (*live, "") if opens else live:
                    word = before if before.endswith(x) else before + x
                    if word in self.begins:
                        return True
                    if word in self.starts:
                        ahead.add(word)
            live, opens = ahead, not c.isalpha()
            if plain and not live:
                return False
        return not live.isdisjoint(self.whole)

    def words(self, token: str) -> list[str]:
        """The restored words, or none where no reading has a known feature: then nothing is decoded."""
        if self.known is not None:
            if token.isalpha():
                if not _TWICE.search(token):
                    return [token] if token[: STEMS[0]] in self.heads else []
                if not self.possible(token):
                    return []
            elif _SIGNS.search(token) and not self.possible(token):
                return []
        return restored_words(token, self.model)

    def __missing__(self, token: str) -> tuple:
        words = self.words(token)
        if self.known is None:
            # Many tokens share a feature, which is held once.
            names, size, out = self.names, 48, []
            for f in features(words):
                if (held := names.get(f)) is None:
                    held = names[f] = f
                    size += 160 + len(f)
                out.append(held)
            out = tuple(out)
            size += 8 * len(out)
        else:
            known, found = self.known, set()
            for w in words:
                if w[: STEMS[0]] not in self.heads:
                    continue
                if len(w) <= STEMS[-1] and w + "$" in known:
                    found.add(known[w + "$"])
                for k in STEMS:
                    if len(w) < k:
                        break
                    if w[:k] in known:
                        found.add(known[w[:k]])
            out = tuple(sorted(found))
            size = 48 + 8 * len(out) if out else 0
        self.keep(token, out, size)
        if not out:
            del self[token]
            self.none.add(token)
        return out


def _spelled_words(text: str, tokens: _Tokens) -> Iterator[str]:
    """The words of letters set apart in a lower-case text."""
    if _SINGLES.search(text):
        for m in _SPACED.findall(text):
            yield from _WORDS.findall(restore(m, tokens.model))


def feature_counts(text: str, tokens: _Tokens) -> Counter:
    text = text.lower()
    count: Counter = Counter()
    for word in _spelled_words(text, tokens):
        count.update(tokens[word])
    all_words = text.split()
    found = {token: f for token in set(all_words).difference(tokens.none) if (f := tokens[token])}
    if found:
        for token, n in Counter(w for w in all_words if w in found).items():
            for f in found[token]:
                count[f] += n
    return count


def feature_set(text: str, tokens: _Tokens) -> set:
    """The features of feature_counts without their numbers."""
    text = text.lower()
    found: set = set()
    for word in _spelled_words(text, tokens):
        found.update(tokens[word])
    for token in set(text.split()).difference(tokens.none):
        found.update(tokens[token])
    return found


# The classifier


def _frequencies(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        tokens, yes, no = _Tokens(model.value), Counter(), Counter()

        def out():
            names = list(yes.keys() | no.keys())
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([yes[f] for f in names], pa.int64()), pa.array([no[f] for f in names], pa.int64())], ["feature", "yes", "no"])
            yes.clear()
            no.clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (yes if toxic else no).update(["", *feature_set(text.as_py() or "", tokens)])
                if len(yes) + len(no) > HELD:
                    yield out()
        yield out()

    return tidied(run)


def _rows(model, known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        tokens = _Tokens(model.value, known.value)
        for batch in batches:
            counts = [sorted(feature_counts(t.as_py() or "", tokens).items()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([[f for f, _ in c] for c in counts], pa.list_(pa.int32())), pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int32()))], ["toxic", "at", "n"])

    return tidied(run)


def _fit(rows: list, n_features: int, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on log(1 + count), by Adam on all rows; equal rows come with their number."""
    y = np.array([r.toxic for r in rows], float)
    weight = np.array([r["count"] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r["at"]) for r in rows])
    col = np.array([f for r in rows for f in r["at"]], int)
    val = np.log1p(np.array([n for r in rows for n in r["n"]], float))
    rate = (weight @ y) / weight.sum()
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log((rate + 1e-6) / (1 - rate + 1e-6))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    if 0 < rate < 1:
        for k in range(1, rounds + 1):
            z = np.bincount(row, theta[col] * val, len(rows)) + theta[-1]
            e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / weight.sum()
            g = np.append(np.bincount(col, e[row] * val, n_features) + l2 * theta[:-1], e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
    return theta[:-1], float(theta[-1])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scorer:
    """A fitted model: score(docs, keep) adds the score and the prediction, by names, to the columns in keep."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES):
        spark = docs.sparkSession
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.model = spark.sparkContext.broadcast(corpus_model(texts))
        seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out())
        seen = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        # At most `sample` pairs of 12 bytes: the one table that is broadcast.
        chosen = written(texts.join(F.broadcast(seen), "doc_id").select("text", "toxic"), "toxic-sample")
        freq = written(chosen.mapInArrow(_frequencies(self.model), "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where(f"yes >= {LEAST_TOXIC} or feature = ''"), "toxic-features")
        total = freq.where("feature = ''").first()
        yes, no = (total.yes or 0, total.no or 0) if total else (0, 0)
        a, b, n = F.col("yes").cast("double"), F.col("no").cast("double"), float(yes + no)
        chi = n * (a * (no - b) - b * (yes - a)) ** 2 / (F.lit(float(max(1, yes))) * float(max(1, no)) * (a + b) * (n - a - b + 1))
        best = freq.where("feature <> ''").where(a * max(1, no) > 2 * b * max(1, yes)).orderBy(chi.desc(), "feature").limit(n_features).select("feature").collect()
        self.known = spark.sparkContext.broadcast({r.feature: i for i, r in enumerate(best)})
        rows = chosen.mapInArrow(_rows(self.model, self.known), "toxic int, at array<int>, n array<int>").groupBy("toxic", "at", "n").count().collect()
        self.weights, self.bias = _fit(rows, len(best)) if rows else (np.zeros(0), 0.0)

    def score(self, docs: DataFrame, keep: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
        """The columns in keep, the score and the prediction of each row of docs."""
        model, known, weights, bias = self.model, self.known, self.weights, self.bias
        # The text travels once, with what is kept or before it.
        plain = "text" in keep and isinstance(docs.schema["text"].dataType, T.StringType)
        at = keep.index("text") if plain else 0

        def run(batches):
            tokens = _Tokens(model.value, known.value)
            for whole in batches:
                for batch in blocks_of(whole, at):
                    scores = []
                    for text in batch.column(at):
                        z = bias + sum(float(weights[f]) * float(np.log1p(n)) for f, n in feature_counts(text.as_py() or "", tokens).items())
                        scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
                    kept = batch.columns if plain else batch.columns[1:]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*out.names])

        own = [F.col(f"`{c}`") for c in keep]
        rows = docs.select(*own) if plain else docs.select(F.col("text").cast("string").alias(fresh(docs, "scored")), *own)
        out = T.StructType([*rows.schema.fields[0 if plain else 1 :], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
        return rows.mapInArrow(tidied(run), out)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = Scorer(docs, table(spark, sf_dir, "labels")).score(docs, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
