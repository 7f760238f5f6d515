"""Quality verdicts by a learned decision list, in DataFrame expressions only.

Statistics of every text are computed inside its row, without a shuffle: three-word windows
are sorted next to each other within the document, and neighbours that agree mark repeats.
Sequential covering then learns rules for the low-quality label from labelled rows: a rule
grows by the threshold condition with the largest gain among rows that no earlier rule covers,
and is pruned from its end on rows kept apart. Each step is one count by statistic, interval
and label; only those counts reach the driver. The list becomes an ordered CASE WHEN.

Defined cases: null text has no words; a text without words fails the base rules (under 50
words); ratios of such texts are null and meet no condition; a doc_id with several labels has
the smallest; without labels the list is empty and all that pass the base rules are kept; rows
with equal doc_id are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import table, written

LEAST_WORDS = 50
REPEAT_PERCENT = 50
RULES = 10
CONDITIONS = 3
#: A rule must be right this often, on the rows it grew from and on those kept apart.
PRECISION = 0.9
LEAST_COVERED = 8
QUANTILES = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.995, 0.999]
STATISTICS = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "bang_rate", "bar_rate", "digit_rate"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's counts and the rates in STATISTICS, of each row of docs."""
    white = "\t\n\x0b\x0c\r"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split(F.translate("text", white, " " * 5), " "), lambda w: w != "").alias("ws"), F.filter(F.split("text", "\n"), lambda x: F.translate(x, white + " ", "") != "").alias("ls"))
    n = F.size("ws")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))).otherwise(F.array().cast("array<string>"))
    length = lambda c: F.length(c).cast("long")
    without = lambda x: length("text") - length(F.translate("text", x, ""))
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        length(F.translate("text", white + " ", "")).alias("word_chars"),
        without("#*$%&|<>").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.size("ls").alias("n_lines"),
        windows.alias("win"),
        F.size(F.array_distinct("ws")).alias("n_distinct"),
        (length("text") - length(F.regexp_replace("text", r"\p{Lu}", ""))).alias("n_upper"),
        without("!?").alias("n_bang"),
        without("|").alias("n_bar"),
        without("0123456789").alias("n_digit"),
    )
    # Documents whose windows all differ need no sort.
    rows = rows.withColumn("win", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("win", lambda s, j: F.coalesce(F.get("win", j - 1)["x"] == s["x"], F.lit(False)) | F.coalesce(F.get("win", j + 1)["x"] == s["x"], F.lit(False)))
    rows = rows.withColumn("win", F.array_sort(F.transform(twice, lambda s: s["i"])))
    covered = F.aggregate("win", F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "n_words").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
        rate("n_distinct", "n_words").alias("distinct_rate"), rate("n_upper", "word_chars").alias("upper_rate"), rate("n_bang", "n_words").alias("bang_rate"), rate("n_bar", "n_words").alias("bar_rate"), rate("n_digit", "word_chars").alias("digit_rate"),
    )


@dataclass(frozen=True)
class Condition:
    """statistic > threshold, or statistic <= threshold."""

    statistic: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def rule_sql(rule: Rule) -> str:
    return " AND ".join(c.sql() for c in rule)


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered CASE WHEN: the first rule that holds rejects, what none covers is kept."""
    out = None
    for rule in rules:
        test = F.expr(rule_sql(rule))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], list[int]]:
    """(statistic, interval) -> rows by kept apart and label: grow good, grow bad, prune good, prune bad. Interval k is over cuts[k-1] and up to cuts[k]."""
    cells = F.array(*(F.struct(F.lit(s).alias("s"), sum((F.col(s) > t).cast("int") for t in cut).alias("k")) for s, cut in cuts.items() if cut))
    out: dict[tuple[str, int], list[int]] = {}
    for r in rows.select("apart", "bad", F.explode(cells).alias("c")).where("c.k is not null").groupBy("c.s", "c.k", "apart", "bad").count().collect():
        out.setdefault((r.s, r.k), [0, 0, 0, 0])[2 * int(r.apart) + r.bad] = r["count"]
    return out


def _best(counts: dict[tuple[str, int], list[int]], cuts: dict[str, list[float]], good: int, bad: int) -> tuple[float, Condition, list[int]] | None:
    """The condition of the largest gain over what the rule covers so far."""
    base, found = math.log2(bad / (good + bad)), None
    for s, cut in cuts.items():
        column = [counts.get((s, k), [0, 0, 0, 0]) for k in range(len(cut) + 1)]
        for k, t in enumerate(cut):
            for above in (True, False):
                part = column[k + 1 :] if above else column[: k + 1]
                total = [sum(x[i] for x in part) for i in range(4)]
                if total[1] >= LEAST_COVERED:
                    gain = total[1] * (math.log2(total[1] / (total[0] + total[1])) - base)
                    if found is None or gain > found[0]:
                        found = (gain, Condition(s, above, t), total)
    return found


def learn(labelled: DataFrame) -> list[Rule]:
    """An ordered list of rules for rows with bad = 1, from the columns in STATISTICS, bad and apart."""
    quantiles = [F.percentile_approx(s, F.array(*map(F.lit, QUANTILES)), 2000).alias(s) for s in STATISTICS]
    cuts: dict[str, list[float]] = {s: sorted({float(t) for r in labelled.groupBy("bad").agg(*quantiles).collect() for t in r[s] or ()}) for s in STATISTICS}
    rules: list[Rule] = []
    left = labelled
    if not any(cuts.values()):
        return rules
    for _ in range(RULES):
        rule: Rule = ()
        steps: list[tuple[int, int]] = []
        rows = left
        for _ in range(CONDITIONS):
            counts = _counts(rows, cuts)
            own = [sum(v[i] for (s, _), v in counts.items() if s == "n_words") for i in range(4)]
            if own[1] < LEAST_COVERED or (rule and own[0] == 0):
                break
            best = _best(counts, cuts, own[0], own[1])
            if best is None or best[0] <= 0:
                break
            rule += (best[1],)
            steps.append((best[2][2], best[2][3], best[2][0], best[2][1]))
            rows = rows.where(best[1].sql())
        if not rule:
            break
        # Prune: the shortest beginning with the best balance on the rows kept apart.
        worth = [(b - g) / (b + g) if b + g else -1.0 for g, b, _, _ in steps]
        keep = worth.index(max(worth)) + 1
        g, b, grown_good, grown_bad = steps[keep - 1]
        if b < PRECISION * (g + b) or grown_bad < PRECISION * (grown_good + grown_bad) or b == 0:
            break
        rules.append(rule[:keep])
        left = left.where(f"NOT coalesce({rule_sql(rule[:keep])}, false)")
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """The contract's columns for each row of docs, and the rules behind kept. labels: doc_id, quality (1 good, 0 bad)."""
    stats = written(statistics(docs), "statistics")
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("bad"))
    # The base rules come first, so the list is learned on what they pass.
    labelled = written(stats.where(~base_failed()).join(seen, "doc_id").select(*STATISTICS, "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart")), "labelled")
    rules = learn(labelled)
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
    return out, rules


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]
