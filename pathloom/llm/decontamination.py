"""Benchmark decontamination by embedded edit distance.

Texts are words (runs of letters and digits, lower case), so punctuation, case and white space
don't count. A document holds a passage of an item of n words if some window of n words is
within floor(EDIT_SHARE * n) word edits of it; the document is taken as padded at its end with
words that match nothing.

1. Windows that could hold an item are found by counting: k edits spoil at most 2k of an item's
   n - 1 word pairs, so a window with fewer than n - 1 - 2k pairs from the benchmark is out; a
   text goes unsearched only if it has fewer than the least of these numbers, which isn't that of
   the shortest item. Nothing within the threshold is lost here.
2. The windows left and the items are embedded by the CGK random walk: over 3n steps a reader
   copies the current word and moves on when a random bit of (step, word) says so. Word edits
   become a small Hamming distance.
3. Bit-sampling LSH over WALKS walks with TABLES samples of POSITIONS embedded words each joins
   windows to items of the same size.
4. Each candidate's edit distance is computed exactly.

A window has exactly n words, so words added to a passage push as many of its own out and count
twice: of passages with floor(EDIT_SHARE * n) edits, those by substitution are found (0.995 and
more), those of insertions and deletions alone in 0.40 to 0.65 of cases (items of 5 to 50 words).

Items are held in blocks of at most ITEMS items and ITEM_CHARS characters (a longer item stands
alone) and taken to the executors block by block: what one block found is written before the next
is broadcast, so one block is held at a time however long the benchmark is. Nothing is shuffled.

Defined cases: null and empty texts hold nothing; items without words are held by nothing;
documents shorter than an item can hold it by the padding rule; each item counts once a document
(fewest edits, then first place); rows with equal doc_id are searched each for itself, as are
equal items; other columns pass through clean() and are ignored by find().
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import blocks_of, table, tidied, written

EDIT_SHARE = 0.2
WALKS, TABLES, POSITIONS = 6, 6, 2
ITEMS = 20_000
ITEM_CHARS = 4_000_000
#: Flags of a pair and a length that a block of items holds at most; beyond that each length's pairs are searched.
PAIR_FLAGS = 16_000_000
#: Windows that are embedded at once.
WINDOWS = 50_000

_WORD = re.compile(r"[^\W_]+")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


#: What the two steps of words_of make of each character below 256: its lower case, or a space between words.
_PLAIN = b"".join(c.lower().encode("latin-1") if _WORD.match(c) else b" " for c in map(chr, range(256)))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def byte_words(text: str) -> list[bytes] | None:
    """words_of a text of characters below 256, each in Latin-1; None for other texts."""
    try:
        return text.encode("latin-1").translate(_PLAIN).split()
    except UnicodeEncodeError:
        return None


def most_edits(n: int) -> int:
    return int(EDIT_SHARE * n)


def _bits(symbols: np.ndarray, step: int, walk: int) -> np.ndarray:
    h = (symbols.astype(np.uint64) + np.uint64(1)) * _STEP + np.uint64((step * 64 + walk) * 2 + 1 & 0xFFFF_FFFF)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def embed(rows: np.ndarray, walk: int, steps: list[int]) -> np.ndarray:
    """The embedded words of each row at the given steps, of a walk over 3n steps; -2 past the end."""
    count, n = rows.shape
    padded = np.concatenate([rows, np.full((count, 1), -2, rows.dtype)], axis=1).ravel()
    base, at = np.arange(count) * (n + 1), np.zeros(count, np.int64)
    wanted, out = {s: i for i, s in enumerate(steps)}, np.empty((count, len(steps)), rows.dtype)
    for step in range(max(steps) + 1):
        now = padded[base + at]
        if step in wanted:
            out[:, wanted[step]] = now
        at = np.minimum(at + _bits(now, step, walk), n)
    return out


def samples(n: int, walk: int) -> list[list[int]]:
    """The sampled steps of each table of a walk."""
    draw = np.random.Generator(np.random.PCG64(n * 1_000 + walk))
    # Early steps have met fewer edits; steps over 2n are mostly past the end.
    return [sorted(draw.choice(max(POSITIONS, 2 * n), POSITIONS, replace=False).tolist()) for _ in range(TABLES)]


def keys(rows: np.ndarray, walk: int) -> list[np.ndarray]:
    """A 64-bit key of each row for each table of a walk."""
    tables = samples(rows.shape[1], walk)
    steps = sorted({s for t in tables for s in t})
    seen, place = embed(rows, walk, steps), {s: i for i, s in enumerate(steps)}
    return [sum((seen[:, place[s]].astype(np.uint64) + np.uint64(3)) * _STEP * np.uint64(2 * i + 1) * _MIX for i, s in enumerate(t)) for t in tables]


def edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each row of a to the same row of b."""
    count, n = a.shape
    before = np.tile(np.arange(b.shape[1] + 1, dtype=np.int16), (count, 1))
    for i in range(n):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        cost = np.minimum(before[:, :-1] + (a[:, i : i + 1] != b), before[:, 1:] + 1)
        # now[j] = min over j' <= j of cost[j'] + (j - j')
        ramp = np.arange(b.shape[1] + 1, dtype=np.int16)
        now[:, 1:] = cost
        now = np.minimum.accumulate(now - ramp, axis=1) + ramp
        before = now
    return before[:, -1]


class Items:
    """A block of benchmark items, indexed by their number of words."""

    def __init__(self, items: list[tuple[int, str | None]]):
        split = [(i, words_of(t)) for i, t in items]
        split = [(i, w) for i, w in split if w]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        self.byte_vocabulary = {w.encode("latin-1"): k for w, k in self.vocabulary.items() if max(w) < "\u0100"}
        coded = [(i, np.array([self.vocabulary[w] for w in ws], np.int64)) for i, ws in split]
        size = len(self.vocabulary) + 1
        self.size = size
        self.pairs = np.unique(np.concatenate([w[:-1] * size + w[1:] for _, w in coded] or [np.empty(0, np.int64)]))
        self.by_length: dict[int, tuple[list[int], np.ndarray]] = {}
        for n in sorted({len(w) for _, w in coded}):
            own = [(i, w) for i, w in coded if len(w) == n]
            self.by_length[n] = ([i for i, _ in own], np.stack([w for _, w in own]))
        self.pairs_of = {n: np.unique(rows[:, :-1] * size + rows[:, 1:]) for n, (_, rows) in self.by_length.items()}
        # Which lengths have a pair, where that is a small table.
        self.has_pair = np.stack([np.isin(self.pairs, x, assume_unique=True) for x in self.pairs_of.values()]) if 0 < len(self.pairs) * len(self.pairs_of) <= PAIR_FLAGS else None
        self.tables = {n: [keys(rows, walk) for walk in range(WALKS)] for n, (_, rows) in self.by_length.items()}

    def near(self, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """window, item and edits of all pairs that share a key and are within the threshold."""
        ids, rows = self.by_length[n]
        found = []
        for walk in range(WALKS):
            for own, theirs in zip(self.tables[n][walk], keys(windows, walk), strict=True):
                order = np.argsort(own, kind="stable")
                lo, hi = np.searchsorted(own[order], theirs, "left"), np.searchsorted(own[order], theirs, "right")
                w = np.repeat(np.arange(len(theirs)), hi - lo)
                if len(w):
                    k = np.arange(len(w)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                    found.append(w * len(ids) + order[lo[w] + k])
        if not found:
            return (np.empty(0, np.int64),) * 3
        both = np.unique(np.concatenate(found))
        w, i = both // len(ids), both % len(ids)
        d = np.concatenate([edits(windows[w[k : k + 20_000]], rows[i[k : k + 20_000]]) for k in range(0, len(w), 20_000)])
        ok = d <= most_edits(n)
        return w[ok], i[ok], d[ok]

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[int, int]]]:
        """For each text: place of an item in its length's list, by (n, place) -> (edits, first word)."""
        out: list[dict] = [{} for _ in texts]
        if not self.by_length:
            return out
        shortest, longest = min(self.by_length), max(self.by_length)
        need = {n: n - 1 - 2 * most_edits(n) for n in self.by_length}
        # A window of n words is covered by ceil(n / shortest) stretches of the shortest length; one of them has its share of the pairs.
        least = min(need.values())
        dense = min(-(-need[n] // -(-n // shortest)) for n in need)
        starts: dict[int, list[tuple[int, np.ndarray]]] = {n: [] for n in self.by_length}
        coded: list[np.ndarray | None] = []
        for t, text in enumerate(texts):
            ws, code = byte_words(text) if text else [], self.byte_vocabulary.get
            if ws is None:
                ws, code = words_of(text), self.vocabulary.get
            coded.append(None)
            if not ws:
                continue
            c = np.fromiter(map(code, ws, repeat(0)), np.int64, len(ws))
            hits = np.flatnonzero((c[:-1] > 0) & (c[1:] > 0))
            if least > 0:
                if len(hits) < least:
                    continue
                both = c[hits] * self.size + c[hits + 1]
                hits = hits[_among(both, self.pairs)]
            mark = np.zeros(len(c) + longest + 1, np.int64)
            mark[hits + 1] = 1
            total = np.cumsum(mark)
            if dense > 0 and (total[shortest:] - total[:-shortest]).max() < dense:
                continue
            both = c[hits] * self.size + c[hits + 1]
            if self.has_pair is None:
                flags = counts = None
            else:
                at = np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)
                flags = self.has_pair[:, at] & (self.pairs[at] == both)
                counts = flags.sum(axis=1).tolist()
            for place, n in enumerate(self.by_length):
                if counts is not None and counts[place] < need[n]:
                    continue
                last = len(c) - n + most_edits(n) + 1 if len(c) >= n - most_edits(n) else 0
                if last <= 0:
                    continue
                if need[n] > 0:
                    own = hits[_among(both, self.pairs_of[n]) if flags is None else flags[place]]
                    if len(own) < need[n]:
                        continue
                    mark = np.zeros(len(c) + longest + 1, np.int64)
                    mark[own + 1] = 1
                    total = np.cumsum(mark)
                    # Word pairs that start in [s, s + n - 2].
                    s = np.flatnonzero(total[n - 1 : n - 1 + last] - total[:last] >= need[n])
                else:
                    s = np.arange(last)
                if len(s):
                    starts[n].append((t, s))
                    coded[t] = c
        pad = np.zeros(longest, np.int64)
        for n, found in starts.items():
            for part in _parts(found, WINDOWS):
                rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.concatenate([coded[t], pad]), n)[s] for t, s in part])
                doc, at = np.concatenate([np.full(len(s), t) for t, s in part]), np.concatenate([s for _, s in part])
                for w, i, d in zip(*self.near(n, rows), strict=True):
                    held, new = out[doc[w]], (int(d), int(at[w]))
                    if (n, int(i)) not in held or new < held[n, int(i)]:
                        held[n, int(i)] = new
        return out


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array that isn't empty."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _parts(found: list[tuple[int, np.ndarray]], size: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    held, total = [], 0
    for t, s in found:
        for k in range(0, len(s), size):
            held.append((t, s[k : k + size]))
            total += len(held[-1][1])
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def item_blocks(benchmark: DataFrame, size: int = ITEMS, chars: int = ITEM_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    held: list[tuple[int, str | None]] = []
    total = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        n = len(r.text or "")
        if held and (len(held) == size or total + n > chars):
            yield held
            held, total = [], 0
        held.append((r.item_id, r.text))
        total += n
    if held:
        yield held


def _matches(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        items = block.value
        for batch in batches:
            for part in blocks_of(batch, 1):
                rows = [(d, items.by_length[n][0][i], s, e, n) for d, found in zip(part.column(0).to_pylist(), items.search(part.column(1).to_pylist()), strict=True) for (n, i), (e, s) in sorted(found.items())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_word", "edits", "item_words"])

    return tidied(run)


def _in_turn(blocks: Iterator[list], search: Callable, name: str) -> Iterator[DataFrame]:
    """search(broadcast block) of each block; all but the last are written before the next is made."""
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        held = search(Items(block))
        if after is None:
            yield held[0]
        else:
            yield written(held[0], name)
            held[1].destroy()
        block = after


def find(docs: DataFrame, benchmark: DataFrame, size: int = ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, edits and item_words of each item that a document holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, edits long, item_words long"

    def search(items: Items):
        block = spark.sparkContext.broadcast(items)
        return rows.mapInArrow(_matches(block), schema), block

    out = spark.createDataFrame([], schema)
    for i, part in enumerate(_in_turn(item_blocks(benchmark, size), search, "found")):
        out = out.unionByName(part) if i else part
    return out


def _unheld(block, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        items = block.value
        for batch in batches:
            for part in blocks_of(batch, text):
                yield part.filter(pa.array([not x for x in items.search(part.column(text).to_pylist())], pa.bool_()))

    return tidied(run)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = ITEMS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    spark, left = docs.sparkSession, docs
    at = docs.columns.index("text")
    if not isinstance(docs.schema["text"].dataType, T.StringType):
        raise TypeError("text must be a string")

    def search(items: Items):
        block = spark.sparkContext.broadcast(items)
        return left.mapInArrow(_unheld(block, at), left.schema), block

    for part in _in_turn(item_blocks(benchmark, size), search, "unheld"):
        left = part
    return left


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
