"""Near duplicates by an inverted join on signature coordinates.

A document's set is its distinct five-word shingles; its signature has COORDS coordinates, each
the minimum of the set under a hash. Two documents agree on one with the probability of their
similarity, so those at the link threshold agree on least_matches() of them but for a chance of
MISSED. Documents are posted under each coordinate-value pair of a prefix of their signature:
with the values in one global order, those that few documents have first, a pair that agrees on
T coordinates shares a value among the first COORDS - T + 1 of both. How many documents have a
value is read from a table of CELLS counts over the whole corpus (any order is exact; this one
keeps the lists of passages that many documents share out of the prefix). Pairs whose set sizes
rule a link out are skipped; for the others collisions are counted over both whole signatures,
pairs below the match threshold go, and the rest are confirmed on the full sets.

No posting list is expanded into pairs. A list's hub, its document with the most widespread
signature (of a family of copies, the one nearest to what all have in common), is compared with
the others of the list; links make components. Lists that still hold several components get a
further hub outside the first one's component, which is compared with the documents outside its
own, and again, as long as this makes links in numbers. What is left are pairs within a list of
documents that no hub has drawn together: at least one of the two is outside the component of the
list's first hub. These meet by the prefix principle on their sets: with the shingles that the
fewest open documents hold first, a pair that links shares one among the first n - ceil(percent n
/ 100) + 1 of both, at places after which enough are left. Copies edit apart, so these lists are
short. Candidates are counted over the signatures and confirmed like the others.

No link between components is lost. Exact copies are one class from the start. Intermediate tables are deleted when the result's own are written.

Defined cases: null and empty texts, and texts of white space, have no set and no links; with
fewer than five words the whole sequence is the one shingle; rows with equal doc_id are one
node and each is returned; a null doc_id is never a node and is returned with a null component
and kept; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import Bounded, batches_of, blocks_of, drop_written, lower_ascii, table, tidied, words, written

COORDS = 64
#: The chance with which a pair at the link threshold agrees on too few coordinates.
MISSED = 1e-6
#: Counts of values, 4 bytes each, that are broadcast.
CELLS = 1 << 19
#: Lists get further hubs as long as this share of the comparisons makes links.
WORTH = 0.02
WORDS = 5
LINK_PERCENT = 85

_RANDOM = np.random.Generator(np.random.PCG64(20_240_601))
_A = _RANDOM.integers(0, 1 << 31, (COORDS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_BUFFER = np.empty((COORDS, 512), np.uint32)


def least_matches(percent: int) -> int:
    """The match threshold: the most coordinates on which a pair at the link threshold agrees but for a chance of MISSED."""
    p, below, least = percent / 100, 0.0, 0
    for k in range(COORDS):
        below += math.comb(COORDS, k) * p**k * (1 - p) ** (COORDS - k)
        if below > MISSED:
            break
        least = k + 1
    return max(1, least)


class _WordHash(Bounded):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self.keep(word, h, 36)
        return h


_hash = _WordHash()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    ws = words(lower_ascii(text)) if text else []
    if not ws:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash.__getitem__, ws), np.uint64, len(ws))
    n = min(WORDS, len(ws))
    h = np.full(len(ws) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _P + w[k : len(ws) - n + 1 + k]
    return np.unique(_mixed(h))


def signature(u: np.ndarray) -> np.ndarray:
    """COORDS values of a non-empty set, each a minimum."""
    x = (u >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 512):
        part = _BUFFER[:, : len(x[i : i + 512])]
        np.multiply(_A, x[None, i : i + 512], out=part)
        np.minimum(least, part.min(axis=1), out=least)
    return _mixed(least.astype(np.uint64) * _P + np.arange(COORDS, dtype=np.uint64)).view(np.int64)


def _cells(values):
    """Counts by cell over values(batch), 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in blocks_of(batch, 0) if pa.types.is_string(batch.schema.types[0]) else (batch,):
                counts += np.bincount(values(part).astype(np.int64) & (CELLS - 1), minlength=CELLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(counts[at])], ["cell", "n"])

    return tidied(run, _hash.clear)


def spread(df: DataFrame, values) -> np.ndarray:
    """How many rows of df (one column) have a value, by the value's cell; CELLS numbers at most come to the driver."""
    counts = np.zeros(CELLS, np.int32)
    found = df.mapInArrow(_cells(values), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[found["cell"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.int32).max)
    return counts


def _of_signatures(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False)


def _of_texts(batch: pa.RecordBatch) -> np.ndarray:
    return np.concatenate([*(shingles(t.as_py()) for t in batch.column(0)), np.empty(0, np.uint64)])


def _rarest(counts, percent: int):
    """rep, comp, x, n, element and at: the elements of each text (rep, comp, x, text) by which a link shows, those that the fewest hold first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks_of(batch, 3):
                elements, sizes, held = [], [], []
                for text in part.column(3):
                    u = shingles(text.as_py())
                    first = u[np.lexsort((u, counts.value[(u & np.uint64(CELLS - 1)).astype(np.int64)]))][: len(u) - -(-len(u) * percent // 100) + 1]
                    elements.append(first)
                    sizes.append(len(u))
                    held.append(len(first))
                take = pa.array(np.repeat(np.arange(len(held)), held))
                places = np.concatenate([*(np.arange(k, dtype=np.int32) for k in held), np.empty(0, np.int32)])
                flat = np.concatenate([*elements, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(sizes, pa.int64()).take(take), pa.array(flat), pa.array(places)], ["rep", "comp", "x", "n", "element", "at"])

    return tidied(run, _hash.clear)


def _prefixes(counts, size: int):
    """rep, n, score and the first `size` values of each row of rep, n, sig: those that the fewest have, then the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sig = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDS)
            n = counts.value[sig & (CELLS - 1)]
            first = np.take_along_axis(sig, np.lexsort((sig, n), axis=1)[:, :size], axis=1)
            score = (1000 * np.log2(n + 1)).astype(np.int64).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype="i4") * size), pa.array(first.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), lists], ["rep", "n", "score", "value"])

    return tidied(run)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks_of(batch, 1):
            sizes, classes, sigs = [], [], []
            for text in part.column(1):
                u = shingles(text.as_py())
                sizes.append(len(u))
                classes.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                sigs.append(signature(u) if len(u) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cls", "sig"])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows' numbers and the sets of their two texts; columns a, b, ta, tb, with runs of equal a."""
    held: dict[int, np.ndarray] = {}
    for i, a in enumerate(batch.column(0).to_pylist()):
        if a not in held:
            held = {a: shingles(batch.column(2)[i].as_py())}
        yield i, held[a], shingles(batch.column(3)[i].as_py())


def _linked(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(u) + len(v) - both)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array([i for i, u, v in _sets(batch) if _linked(u, v, percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(held), batch.column(1).take(held)], ["a", "b"])

    return run


DIFFERENCES = ["ref", "rep", "element", "at", "size", "n", "x", "y"]


def _differences(percent: int):
    """For references a and documents b, the first elements in which b differs from a: on any side (y), and on the side of one not linked with a (x)."""
    c = (100 - percent) / (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, elements, differing, sizes, on_x, on_y = [], [], [], [], [], [], []
            for i, u, v in _sets(batch):
                # Outside the reference first: there near copies differ from each other.
                e = np.concatenate([np.setdiff1d(v, u, assume_unique=True), np.setdiff1d(u, v, assume_unique=True)])
                size = len(e)
                y = size - max(1, math.ceil((size + c * (len(u) - len(v))) / 2 - 1e-9)) + 1
                x = 0
                if not _linked(u, v, percent):
                    x = size - max(1, math.ceil((size + (1 - c) - c * (len(u) + len(v))) / 2 - 1e-9)) + 1
                n = min(size, max(x, y))
                at += [i] * n
                places += range(n)
                elements.append(e[:n])
                differing += [size] * n
                sizes += [len(v)] * n
                on_x += [k < x for k in range(n)]
                on_y += [k < y for k in range(n)]
            take = pa.array(at, pa.int64())
            flat = np.concatenate([*elements, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(flat), pa.array(places, pa.int32()), pa.array(differing, pa.int32()), pa.array(sizes, pa.int64()), pa.array(on_x, pa.bool_()), pa.array(on_y, pa.bool_())], DIFFERENCES)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, comp for each node of links (a, b): its smallest reachable node. Alternates large stars and small stars until nothing changes."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # Large stars: each node hangs its larger neighbours on the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small stars: each node hangs its smaller neighbours and itself on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.where("u <> v").distinct(), "edges")
        drop_written(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now


def _likely(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures collide on `least` coordinates or more."""
    one, two = (sigs.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.join(one, "a").join(two, "b").where(same >= least).select("a", "b")


def _over_texts(pairs: DataFrame, texts: DataFrame, run, schema: str, name: str) -> DataFrame:
    """A written table of run over pairs (a, b) with their texts, rows of equal a together."""
    one, two = (texts.select(F.col("rep").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    full = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    with batches_of(pairs.sparkSession, 256):
        return written(full.mapInArrow(tidied(run, _hash.clear), schema), name)


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    spark, least = docs.sparkSession, least_matches(percent)
    held: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        held.append(written(df, name))
        return held[-1]

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batches_of(spark, 2048):
        sketches = written(docs.mapInArrow(tidied(_sketch, _hash.clear), "doc_id long, n_shingles long, cls binary, sig array<long>"), "sketches")
    found = sketches.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "sig", "n_shingles")).alias("x"))
    reps = written(found.select("cls", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig")), "classes")
    fits = lambda a, b: F.least(a, b) * 100 >= percent * F.greatest(a, b)

    # Postings of the signature prefix; lists of one document go at once.
    prefixes = reps.select("rep", "n", "sig").mapInArrow(_prefixes(spark.sparkContext.broadcast(spread(reps.select("sig"), _of_signatures)), COORDS - least + 1), "rep long, n long, score long, value array<long>")
    posts = prefixes.select("rep", "n", "score", F.explode("value").alias("value"))
    lists = posts.groupBy("value").agg(F.max(F.struct("score", (-F.col("rep")).alias("rep"), "n")).alias("h"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("value", (-F.col("h.rep")).alias("hub"), F.col("h.n").alias("hub_n"))
    posts = step(posts.join(lists, "value").select("value", "rep", "n", "score", "hub", "hub_n"), "postings")
    needed = posts.select("rep").distinct()
    sigs = reps.join(needed, "rep", "left_semi").select("rep", "sig")
    texts = step(docs.join(needed.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text"), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        return _over_texts(pairs, texts, _confirmed(percent), "a long, b long", "links")

    # Hubs against their lists.
    pairs = posts.where("rep <> hub").where(fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tested = step(_likely(pairs, sigs, least), "hub-pairs")
    links = linked(tested)
    held.append(links)
    comps = components(links)
    held.append(comps)
    comp_of = lambda: needed.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))

    # Further hubs: of each list that holds several components, one outside the component of its first.
    rest = posts.select("value", "rep", "n", "score", (F.col("rep") == F.col("hub")).alias("first"), (F.col("rep") == F.col("hub")).alias("done"))
    while True:
        rows = rest.join(comp_of(), "rep")
        best = F.max(F.when(~F.col("done"), F.struct("score", (-F.col("rep")).alias("rep"), "n")))
        lists = rows.groupBy("value", "comp").agg(best.alias("h"), F.max("first").alias("of_hub")).groupBy("value")
        lists = lists.agg(F.max(F.when(~F.col("of_hub"), F.struct("h.score", "h.rep", "h.n", "comp"))).alias("h"), F.max(F.when(F.col("of_hub"), F.col("comp"))).alias("hub_comp")).where("h.rep is not null")
        lists = lists.select("value", "hub_comp", (-F.col("h.rep")).alias("new"), F.col("h.n").alias("new_n"), F.col("h.comp").alias("new_comp"))
        # Lists of one component are done.
        rest = step(rows.join(lists, "value").withColumn("done", F.col("done") | (F.col("rep") == F.col("new"))), "open")
        pairs = rest.where("not done and comp <> new_comp").where(fits(F.col("n"), F.col("new_n"))).select(F.col("new").alias("a"), F.col("rep").alias("b")).distinct()
        tests = step(_likely(pairs, sigs, least), "hub-pairs")
        n_tests = tests.count()
        if not n_tests:
            break
        links = linked(tests)
        held.append(links)
        comps = components(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(links))
        held.append(comps)
        if links.count() < WORTH * n_tests:
            break
        rest = rest.select("value", "rep", "n", "score", "first", "done")

    # What is open: documents outside the component of a list's hub, and those that share the list with one.
    rows = rest.select("value", "rep", "first", "done").join(comp_of(), "rep")
    lists = rows.groupBy("value").agg(F.max(F.when(F.col("first"), F.col("comp"))).alias("hub_comp"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("value", "hub_comp")
    open_ = step(rows.where("not done").join(lists, "value").groupBy("rep").agg(F.min("comp").alias("comp"), F.max(F.col("comp") != F.col("hub_comp")).alias("x")), "open-documents")
    full = step(open_.join(texts, "rep").select("rep", "comp", "x", "text"), "open-texts")
    with batches_of(spark, 2048):
        counts = spark.sparkContext.broadcast(spread(full.select("text"), _of_texts))
        elements = step(full.mapInArrow(_rarest(counts, percent), "rep long, comp long, x boolean, n long, element long, at int"), "elements")
    side = lambda s: elements.select("element", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp", "n", "at", "x")))
    # From the first shared element on, enough others must be left in both.
    enough = F.ceil(percent * (F.col("n_1") + F.col("n_2")) / (100 + percent) - 1e-9)
    left = F.least(F.col("n_1") - F.col("at_1"), F.col("n_2") - F.col("at_2"))
    once = ~F.col("x_2") | (F.col("rep_1") < F.col("rep_2"))
    pairs = side("1").where("x_1").join(side("2"), "element").where((F.col("comp_1") != F.col("comp_2")) & once & (left >= enough))
    pairs = step(pairs.select(F.least("rep_1", "rep_2").alias("a"), F.greatest("rep_1", "rep_2").alias("b")).distinct(), "pairs")
    more = linked(step(_likely(pairs, sigs, least), "likely-pairs"))
    held.append(more)
    if not more.isEmpty():
        comps = components(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(more))
        held.append(comps)

    classes = written(reps.select("cls", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("comp", "rep").alias("component")), "components")
    for table_ in held:
        drop_written(table_)
    # Rows without a set go apart: they would all be one key.
    rows = sketches.select("doc_id", "n_shingles", "cls")
    out = rows.where("cls is not null").join(classes, "cls", "left").select("doc_id", "n_shingles", "component").unionByName(rows.where("cls is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    own_id = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.coalesce(F.col("doc_id") == own_id, F.lit(True)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def deduplicated(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one for rows equal in doc_id and text, with all their columns."""
    gone = written(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct(), "gone")
    out = docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    return out if repeated.isEmpty() else out.dropDuplicates(["doc_id", "text"])
