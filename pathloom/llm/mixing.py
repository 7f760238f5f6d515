"""Mixing sources to target weights under a token budget.

Weights stand on a tree of domains, languages and sources. The budget flows down: at each node
it is shared among the children by weight, a child that cannot use its share (its leaves' tokens
times the most epochs) takes what it can, and what it leaves goes to its siblings by weight. A
node passes a shortage on to its own siblings only when all its children are full. Each leaf
then gives whole epochs and, for the rest, the token prefix of one more epoch, in which the
documents stand in an order seeded by leaf epoch: by md5 of seed, epoch and doc_id.

Only leaf totals (at most LEAVES of them) reach the driver. A prefix is found without sorting a
leaf: tokens are summed by leaf and slice of the order (SLICES of them), slices before the cut
are taken whole, and only the slice with the cut is sorted.

Tokens are words between ASCII white space. Defined cases: null texts have no tokens; null lang
or source is a leaf of its own; a leaf without tokens gets no budget; equal rows are separate
documents, next to each other in the order; nodes without a weight weigh 1; a document that
straddles the end of a prefix is selected, with take_tokens up to the end; other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import table, written

LEAVES = 100_000
SLICES = 4_096
MOST_EPOCHS = 2
SEED = "mix-1"
#: The production recipe: weights by node (its path from the root); others weigh 1.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("web",): 5, ("books",): 3, ("code",): 2,
    ("web", "en"): 5, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 1,
    ("books", "en"): 2, ("code", "en"): 3,
}
#: Columns that mix() adds; a document's own columns of these names are left out.
MADE = ("mix_domain", "mix_epoch", "mix_tokens", "mix_take")
#: The budget as a share of the corpus.
BUDGET_SHARE = 0.9


def n_tokens() -> Column:
    return F.coalesce(F.size(F.filter(F.split(F.translate(F.col("text").cast("string"), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")), F.lit(0)).cast("long")


def domain() -> Column:
    """A source's domain, where no table gives one: by its number, src0-src9 web, src10-src14 books, others code."""
    k = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    return F.when(k < 10, "web").when(k < 15, "books").otherwise("code")


@dataclass(frozen=True)
class Leaf:
    path: tuple[str, str, str]
    tokens: int


def fill(budget: int, parts: list[tuple[str, float, int]]) -> dict[str, int]:
    """Share budget among (name, weight, most) by weight; what a full part leaves goes to the others. Whole tokens, the remainder by name."""
    out = {name: 0 for name, _, _ in parts}
    left = min(budget, sum(most for _, _, most in parts))
    open_ = [(n, w, m) for n, w, m in sorted(parts) if w > 0 and m > 0]
    idle = [(n, 1.0, m) for n, w, m in sorted(parts) if w <= 0 and m > 0]
    while left > 0 and (open_ or idle):
        if not open_:
            open_, idle = idle, []
        total = sum(w for _, w, _ in open_)
        full = [(n, w, m) for n, w, m in open_ if left * w >= m * total]
        if full:
            for n, _, m in full:
                out[n] = m
                left -= m
            open_ = [x for x in open_ if x not in full]
            continue
        shares = {n: int(left * w / total) for n, w, _ in open_}
        rest = left - sum(shares.values())
        for n, _, m in open_:
            extra = min(rest, m - shares[n], 1) if rest > 0 else 0
            out[n] = shares[n] + extra
            rest -= extra
        break
    return out


def allocate(leaves: list[Leaf], weights: Mapping[tuple[str, ...], float], budget: int, epochs: int) -> dict[tuple[str, str, str], int]:
    """Each leaf's tokens."""

    def down(prefix: tuple[str, ...], own: list[Leaf], share: int) -> dict:
        if len(prefix) == 3:
            return {prefix: share}
        children: dict[str, list[Leaf]] = {}
        for x in own:
            children.setdefault(x.path[len(prefix)], []).append(x)
        got = fill(share, [(name, weights.get((*prefix, name), 1.0), epochs * sum(x.tokens for x in xs)) for name, xs in children.items()])
        return {k: v for name, xs in children.items() for k, v in down((*prefix, name), xs, got[name]).items()}

    return down((), leaves, budget) if leaves else {}


def _order(seed: str, epoch: Column, doc_id: Column) -> Column:
    """60 bits of md5 of seed, epoch and doc_id."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Mapping[tuple[str, ...], float], budget: int | None = None, share: float = BUDGET_SHARE, epochs: int = MOST_EPOCHS, seed: str = SEED, slices: int = SLICES) -> DataFrame:
    """docs' rows as often as they are selected, with mix_domain, mix_epoch, mix_tokens (the document's) and mix_take (those within the budget)."""
    spark = docs.sparkSession
    names = [F.coalesce(domain(), F.lit("")).alias("mix_domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("mix_lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source")]
    leaf = ["mix_domain", "mix_lang", "mix_source"]
    narrow = written(docs.select("doc_id", *names, n_tokens().alias("mix_tokens")), "mix-tokens")
    totals = narrow.groupBy(*leaf).agg(F.sum("mix_tokens").alias("n")).limit(LEAVES + 1).collect()
    if len(totals) > LEAVES:
        raise ValueError(f"more than {LEAVES} leaves")
    leaves = [Leaf((r.mix_domain, r.mix_lang, r.mix_source), r.n) for r in totals]
    total = sum(x.tokens for x in leaves)
    gets = allocate(leaves, weights, int(share * total) if budget is None else budget, epochs)
    size = {x.path: x.tokens for x in leaves}
    plan = [(*path, n // size[path], n % size[path]) for path, n in gets.items() if n > 0]
    # As many rows as leaves: bounded, so it is broadcast.
    plan_df = F.broadcast(spark.createDataFrame(plan, "mix_domain string, mix_lang string, mix_source string, whole long, rest long"))
    place = _order(seed, F.col("whole"), F.col("doc_id"))
    width = (1 << 60) // slices
    before = Window.partitionBy(*leaf).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.join(plan_df, leaf).where("rest > 0").groupBy(*leaf, "rest", F.floor(place / width).cast("int").alias("slice")).agg(F.sum("mix_tokens").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where("before < rest").groupBy(*leaf).agg(F.max_by(F.struct("slice", "before"), "slice").alias("cut"))
    cuts = F.broadcast(written(sums.select(*leaf, F.col("cut.slice").alias("cut_slice"), F.col("cut.before").alias("cut_before")), "mix-cuts"))

    # The documents' own columns travel in a struct, so none of their names can clash.
    own = [c for c in docs.columns if c not in MADE]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), *names, n_tokens().alias("mix_tokens")).join(plan_df, leaf).join(cuts, leaf, "left")
    place = _order(seed, F.col("whole"), F.col("row.doc_id"))
    rows = rows.withColumn("slice", F.floor(place / width).cast("int"))
    times = F.col("whole") + F.coalesce((F.col("slice") < F.col("cut_slice")).cast("int"), F.lit(0))
    keep = ["row.*", "mix_domain", "mix_epoch", "mix_tokens", "mix_take"]
    all_of = rows.where(times > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).withColumn("mix_take", F.col("mix_tokens"))
    # The slice with the cut: about 1 / slices of a leaf.
    before = Window.partitionBy(*leaf).orderBy("place", "row.doc_id", "row.text").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("slice = cut_slice").withColumn("place", place).withColumn("before", F.col("cut_before") + F.coalesce(F.sum("mix_tokens").over(before), F.lit(0))).where("before < rest")
    edge = edge.withColumn("mix_epoch", F.col("whole")).withColumn("mix_take", F.least("mix_tokens", F.col("rest") - F.col("before")))
    return all_of.select(*keep).unionByName(edge.select(*keep))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "mix_domain", "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_take").alias("take_tokens"))
