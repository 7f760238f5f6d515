"""Token ids in Parquet: list columns in doc_id order with controlled row groups and page indexes.

Rows are dealt by range of doc_id and sorted, so row groups and pages cover narrow id ranges
and a filter on doc_id skips the rest. Ids are dictionary encoded (two bytes an id or less);
doc_id and start are delta encoded; metadata columns are read without touching the ids.
Spark's own committer writes the files, so a lost executor costs the tasks it ran.

Defined cases: null text is empty and gets the end id alone; rows with equal doc_id stay
separate rows, in order of text; special strings inside a text become their ids, as the
library does it by default; columns of the input other than doc_id, text and the named
metadata are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import Bounded, blocks_of, table, tidied, work_path
from pathloom.llm.token_counts import special_strings, tokenizer

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 512
# The characters for which the tokenizer's splitting pattern is written out (Latin-1), and the pattern, in lower case.
_PLAIN = r"^[\t\n\x0b\x0c\r\x20-\x7e\x{a1}-\x{ff}]*$"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_APART = rf"('(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+)"
_ONE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[!-&(-/:-@\[-`{{-~]+")
# The characters that stand for bytes outside printable Latin-1.
_BYTES = {**{b: 290 + b - 128 for b in range(128, 161)}, 173: 323}
#: Bytes of text that are encoded at once.
BLOCK = 8 << 20


class Encoder:
    """The ids of texts as little-endian 32-bit integers, by a tokenizer that drops white space and never merges across it.

    Texts are cut and dictionary encoded in Arrow, so Python meets each distinct word of a block
    once: texts of Latin letters are cut into pre-tokens, others at white space. New pre-tokens
    go to the library's model, words of any other form through all of the library; those that a
    block holds twice are remembered.
    """

    def __init__(self, path: str):
        self.own, self.cache = tokenizer(path), Bounded()
        self.special = special_strings(path)

    def _new(self, words: list[str]) -> dict[str, bytes]:
        merged = self.own.model.tokenize
        out: dict[str, bytes] = {}
        rest = []
        for w in words:
            if _ONE.fullmatch(w) and w not in self.special:
                out[w] = array("i", [t.id for t in merged(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))]).tobytes()
            else:
                rest.append(w)
        for w, e in zip(rest, self.own.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[w] = array("i", e.ids).tobytes()
        return out

    def words(self, words: list[str], often: np.ndarray) -> list[bytes]:
        """The ids of each word; those marked as frequent are remembered."""
        found = list(map(self.cache.get, words))
        at = [i for i, x in enumerate(found) if x is None]
        new = self._new([words[i] for i in at])
        for i, keep in zip(at, often[at].tolist(), strict=True):
            found[i] = ids = new[words[i]]
            if keep:
                self.cache.keep(words[i], ids, len(ids) + 40)
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, each text's followed by `end`, and how many each has."""
        texts = texts.fill_null("")
        plain = pc.match_substring_regex(texts, _PLAIN)
        for s in self.special:
            plain = pc.and_not(plain, pc.match_substring(texts, s, ignore_case=True))
        cut = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, texts, "")), _APART, r" \1 ")
        split = pc.ascii_split_whitespace(pc.if_else(plain, cut, texts))
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids = self.words(coded.dictionary.to_pylist(), np.bincount(at, minlength=len(coded.dictionary)) > 1)
        lens = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        starts = np.cumsum(lens, dtype=np.int32) - lens
        table = np.frombuffer(b"".join(ids), "<i4")
        size, offsets = lens[at], split.offsets.to_numpy() - split.offsets[0].as_py()
        ends = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=ends[1:])
        counts = np.diff(ends[offsets]) + 1
        take = np.repeat(starts[at] - ends[:-1], size)
        take += np.arange(len(take), dtype=np.int32)
        flat = np.full(counts.sum(), end, "<i4")
        own = np.ones(len(flat), bool)
        own[np.cumsum(counts) - 1] = False
        flat[own] = table[take]
        return flat, counts.astype(np.int64)


def _encoded(path: str, end_id: int, meta: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder, start = Encoder(path), 0
        for batch in batches:
            for rows in blocks_of(batch, 2, BLOCK):
                flat, counts = encoder.encode(rows.column(2), end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(start + offsets[:-1]), pa.array(counts), lists, *(rows.column(3 + i).cast(t) for i, (_, t) in enumerate(meta))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids", *(n for n, _ in meta)],
                )
                start += int(offsets[-1])

    return tidied(run)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows with their part of `parts` ranges of doc_id, one partition a part; nulls come first. The bounds are read from doc_id alone."""
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / parts) for k in range(1, parts))), max(1_000, 100 * parts)).alias("b")).first().b if parts > 1 else None
    cuts = F.array(*(F.lit(b) for b in sorted(set(bounds or [])))).cast("array<long>")
    # A binary search: the number of bounds below doc_id.
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(bounds or []).bit_length())))))
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) < F.col("doc_id"), at + step).otherwise(at))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(below).cast("int"))
    return rows.repartitionById(parts, F.col("part"))


def write_tokens(docs: DataFrame, path: str, to: str, end_id: int = END_ID, meta: tuple[str, ...] = ("lang", "source"), row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write docs' ids, in ascending doc_id order, to the folder to."""
    meta = tuple(m for m in meta if m in docs.columns)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(m).cast("string").alias(m) for m in meta))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _dealt(rows, parts).sortWithinPartitions("doc_id", "text").select("doc_id", "part", "text", *meta)
    schema = "doc_id long, part int, part_start long, n_tokens long, ids array<int>" + "".join(f", {m} string" for m in meta)
    ids = rows.mapInArrow(_encoded(path, end_id, [(m, pa.string()) for m in meta]), schema)
    out = ids.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    for name in ("doc_id", "part_start", "n_tokens"):
        out = out.option(f"parquet.enable.dictionary#{name}", "false")
    out.parquet(to)


def read_tokens(spark: SparkSession, to: str, lowest: int | None = None, highest: int | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of write_tokens() with doc_id in [lowest, highest] and the columns asked for; the rest is skipped by statistics and column pruning."""
    df = spark.read.parquet(to)
    if lowest is not None:
        df = df.where(F.col("doc_id") >= lowest)
    if highest is not None:
        df = df.where(F.col("doc_id") <= highest)
    return df.select(*columns) if columns else df


def part_starts(spark: SparkSession, to: str) -> DataFrame:
    """part, base: ids in all parts before it. As many rows as files, so small enough to hold on the driver."""
    totals = spark.read.parquet(to).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for r in totals:
        bases.append((r.part, total))
        total += r.n
    return spark.createDataFrame(bases, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("base", T.LongType())]))


@tidied
def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype("i8")), pa.array(crcs, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, to: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the written files."""
    rows = read_tokens(spark, to, columns=("doc_id", "part", "part_start", "ids")).mapInArrow(_crcs, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    starts = F.broadcast(part_starts(spark, to))
    return rows.join(starts, "part").select("doc_id", (F.col("part_start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    to = work_path(spark, "tokens")
    write_tokens(docs, path, to, end_id)
    return digests(spark, to)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
