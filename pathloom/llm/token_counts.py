"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so the tokens of a text are the sum over its
pre-tokens. Pieces are counted once per distinct pre-token of the corpus; each document's
pre-token frequencies are joined to those counts and summed. The most frequent pre-tokens
(HEAD of them, at most HEAD_BYTES bytes each, so at most 8 MB) are broadcast and summed on the
map side: this keeps " the" and its like out of the join, which then has no hot key.

Defined cases: null and empty text have 0 bytes and 0 tokens; equal rows and rows with equal
doc_id are counted each for itself; special strings inside a text count as one token, as the
library does it by default; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import table, written

HEAD = 262_144
HEAD_BYTES = 32
#: Distinct pre-tokens that a task holds before it hands them on.
HELD = 150_000
TOKEN_LIMIT = 1024


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def pre_tokens_of(path: str) -> Callable[[str], list[str]]:
    """The function from a text without special strings to its pre-tokens, each a slice of the text."""
    import public_tokenizers
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    # Characters on whose class (space, letter, number) two Unicode tables could differ go to the library's own splitter.
    plain = regex.compile(r"[\n\r\t\x20-\x7e\xa1-ɏ‐-‧€]*+")
    own = tokenizer(path).pre_tokenizer

    def split(text: str) -> list[str]:
        if plain.fullmatch(text):
            return pattern.findall(text)
        return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]

    return split


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def counted(text: str, split: Callable[[str], list[str]], special: list[str]) -> tuple[Counter, int]:
    """Frequencies of a text's pre-tokens, and how many special strings it has."""
    if not any(s in text for s in special):
        return Counter(split(text)), 0
    import regex

    parts = regex.split("|".join(map(regex.escape, special)), text)
    out: Counter = Counter()
    for part in parts:
        out.update(split(part))
    return out, len(parts) - 1


def _distinct(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        split, special, held = pre_tokens_of(path), special_strings(path), Counter()

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pre", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                if t := text.as_py():
                    held.update(counted(t, split, special)[0])
                    if len(held) > HELD:
                        yield out()
        yield out()

    return run


def _pieces(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            ids = own.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int32())], ["pre", "n", "pieces"])

    return run


def _shares(path: str, head) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each document one row with its bytes and the sum over head pre-tokens, and a row for each other pre-token."""

    def run(batches):
        split, special, known = pre_tokens_of(path), special_strings(path), head.value
        for batch in batches:
            ids, keys, sizes, pres, nums = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                raw = text.encode()
                key = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                freq, total = counted(text, split, special)
                for pre, n in freq.items():
                    if pieces := known.get(pre):
                        total += n * pieces
                    else:
                        ids.append(doc_id)
                        keys.append(key)
                        sizes.append(None)
                        pres.append(pre)
                        nums.append(n)
                ids.append(doc_id)
                keys.append(key)
                sizes.append(len(raw))
                pres.append(None)
                nums.append(total)
                if len(ids) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pres, pa.string()), pa.array(nums, pa.int64())], ["doc_id", "key", "n_bytes", "pre", "num"])
                    ids, keys, sizes, pres, nums = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pres, pa.string()), pa.array(nums, pa.int64())], ["doc_id", "key", "n_bytes", "pre", "num"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text), by the tokenizer file at path."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    distinct = docs.select("text").mapInArrow(_distinct(path), "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    vocab = written(distinct.mapInArrow(_pieces(path), "pre string, n long, pieces int"), "pieces")
    top = vocab.where(F.octet_length("pre") <= HEAD_BYTES).orderBy(F.desc("n"), "pre").limit(head)
    known = spark.sparkContext.broadcast({r.pre: r.pieces for r in top.select("pre", "pieces").toLocalIterator()})
    shares = written(docs.mapInArrow(_shares(path, known), "doc_id long, key long, n_bytes long, pre string, num long"), "shares")
    rare = shares.where("pre is not null").join(vocab.select("pre", "pieces"), "pre").select("doc_id", "key", F.lit(None).cast("long").alias("n_bytes"), (F.col("num") * F.col("pieces")).alias("num"))
    own = shares.where("pre is null").select("doc_id", "key", "n_bytes", "num")
    # A row for each document: rows that agree in doc_id and text meet here, and are dealt out again.
    met = own.unionByName(rare).groupBy("doc_id", "key").agg(F.max("n_bytes").alias("n_bytes"), F.sum("num").alias("num"), F.count("n_bytes").alias("rows"))
    one = F.expr("cast(num div rows as long)")
    return met.select("doc_id", "n_bytes", one.alias("n_tokens"), (one > limit).alias("over_limit"), F.explode(F.expr("array_repeat(0, cast(rows as int))")).alias("_")).drop("_")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
