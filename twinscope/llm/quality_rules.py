"""Quality rules: a decision list learned from labelled statistics.

Sequential covering: grow a conjunction of thresholds condition by condition (by the
information each adds on the growing rows), prune its tail on rows held back for that,
accept it while it stays precise there, take the rows it covers out and go on. The
result is an ordered list of rules, emitted as one chain of Spark conditionals.

Everything is DataFrame functions: the statistics are column expressions, each step of
the covering is one grouped count over the binned statistics of the labelled rows, and
only those counts (features x bins, a fixed size) reach the driver.

Edge cases: a null text has no words (all counts 0, fails the base rule); null labels
and labels of unknown documents teach nothing; a table without labelled rows of both
classes yields an empty list, which rejects nothing; repeated rows each count; extra
columns of ``docs`` pass through :func:`apply_rules` unless they clash with a statistic,
in which case the statistic replaces them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.llm import shared

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_word_kinds")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text (COUNTS and MORE, all long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.drop(*COUNTS, *MORE).withColumns(
        {"_w": shared.words_of(F.col(text)), "_l": F.filter(F.split(whole, "\n"), lambda x: F.trim(F.translate(x, shared.GAP_CHARS, "")) != "")}
    )
    starts = F.size("_w") - F.lit(WINDOW - 1)
    step = step.withColumn(
        "_h",
        F.when(starts >= 2, F.transform(F.sequence(F.lit(1), starts), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    )
    # A text in which all hashes differ repeats nothing; only the others are sorted by the windows themselves.
    step = step.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(starts, F.lit(1))),
        lambda i: F.struct(F.array_join(F.slice("_w", i, WINDOW), " ").alias("w"), i.alias("i")),
    )
    step = step.withColumn("_s", F.when(F.col("_again"), F.array_sort(windows)))
    n = F.size("_s")
    shared_starts = F.filter(
        F.col("_s"),
        lambda x, k: ((k > 0) & (F.get("_s", k - 1)["w"] == x["w"])) | ((k + 1 < n) & (F.get("_s", k + 1)["w"] == x["w"])),
    )
    step = step.withColumn("_p", F.when(F.col("_again"), F.array_sort(F.transform(shared_starts, lambda x: x["i"]))))
    covered = F.aggregate(
        F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b, a + WINDOW) - a, F.lit(WINDOW))),
        F.lit(0),
        lambda total, x: total + x,
    )
    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.translate(whole, shared.GAP_CHARS, "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.when(F.col("_again"), covered).otherwise(0),
        "n_lines": F.size("_l"),
        "n_upper": F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "n_word_kinds": F.size(F.array_distinct("_w")),
    }
    return step.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_w", "_l", "_h", "_again", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The statistics that rules may test, as expressions over the counts."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "word_length": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_share": per_word("n_repeat_words"),
        "upper_share": per_char("n_upper"),
        "words": F.col("n_words").cast("double"),
        "kinds_per_word": per_word("n_word_kinds"),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def expr(self) -> Column:
        at = features()[self.feature]
        return at > self.cut if self.above else at <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def expr(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.expr()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules that reject; a row that none covers is kept."""

    rules: tuple[Rule, ...]

    def expr(self) -> Column:
        """The number of the first rule that covers the row, null if none does."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules) - 1, -1, -1):
            out = F.when(self.rules[k].expr(), F.lit(k + 1)).otherwise(out)
        return out


def learn(
    labelled: DataFrame,
    label: str = "quality",
    bins: int = 32,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_covered: int = 3,
    key: str = "doc_id",
) -> DecisionList:
    """Learn rules for rows whose ``label`` is 0 from rows that have the counts.

    All labelled rows take part. Rows are dealt to growing (2/3) and pruning (1/3) by a
    hash of ``key``. A rule is accepted while it covers ``min_covered`` bad pruning rows
    with ``min_precision`` or more, so that clean rows stay.
    """
    names = list(features())
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        (F.col(label) == 0).alias("bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("held"), *[v.alias(k) for k, v in features().items()]
    )
    rows = shared.stash(rows, "labelled-statistics")
    grid = [(i + 1) / bins for i in range(bins - 1)]
    at = rows.agg(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(n)), grid, 2000).alias(f"{n}_{int(b)}") for n in names for b in (False, True)]).first()
    cuts = {n: sorted({float(x) for b in (0, 1) for x in (at[f"{n}_{b}"] or [])}) for n in names}
    binned = rows.select("bad", "held", *[sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(n) for n in names])
    # One row for each combination of bins: the covering reads these counts again and again.
    left = shared.stash(binned.groupBy("bad", "held", *names).agg(F.count("*").alias("n")).coalesce(1 + len(names)), "binned-statistics")

    def inside(conditions) -> Column:
        out = F.lit(True)
        for name, above, k in conditions:
            out = out & (F.col(name) > k if above else F.col(name) <= k)
        return out

    def counts(df: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        each = df.select("bad", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("b")) for i, n in enumerate(names)])).alias("x"))
        out: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in names}
        for f, b, p, q in each.groupBy("x.f", "x.b").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n")))).collect():
            out[names[f]][b] = (p, q)
        return out

    def bits(p: int, q: int) -> float:
        return math.log2((p + 1e-9) / (p + q + 1e-9))

    rules: list[Rule] = []
    while len(rules) < max_rules:
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < max_conditions:
            table = counts(left.where(~F.col("held") & inside(grown)))
            total = next(iter(table.values()))
            p0, q0 = sum(x[0] for x in total.values()), sum(x[1] for x in total.values())
            if p0 == 0 or q0 == 0:
                break
            best, gain = None, 0.0
            for name in names:
                under_p = under_q = 0
                for k in range(len(cuts[name])):
                    p, q = table[name].get(k, (0, 0))
                    under_p, under_q = under_p + p, under_q + q
                    for above, (p, q) in ((False, (under_p, under_q)), (True, (p0 - under_p, q0 - under_q))):
                        g = p * (bits(p, q) - bits(p0, q0)) if p else 0.0
                        if g > gain * (1 + 1e-12):
                            best, gain = (name, above, k), g
            if best is None:
                break
            grown.append(best)
        if not grown:
            break
        held = left.where(F.col("held"))
        found = held.agg(*[F.sum(F.when(inside(grown[: k + 1]) & (F.col("bad") == b), F.col("n")).otherwise(0)).alias(f"c{k}_{int(b)}") for k in range(len(grown)) for b in (True, False)]).first()
        tails = [(found[f"c{k}_1"] or 0, found[f"c{k}_0"] or 0, k + 1) for k in range(len(grown))]
        p, q, size = max(tails, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1] + 1), -x[2]))
        if p < min_covered or p < min_precision * (p + q):
            break
        chosen = grown[:size]
        rules.append(Rule(tuple(Condition(n, above, cuts[n][k]) for n, above, k in chosen), p + q, p / (p + q)))
        left = left.where(~inside(chosen))
    return DecisionList(tuple(rules))


def apply_rules(counted: DataFrame, rules: DecisionList) -> DataFrame:
    """``counted`` with base_failed, rule (the first that rejects, or null) and kept."""
    out = counted.withColumns({"base_failed": base_failed(), "rule": rules.expr()})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", with_text: bool = False, **options) -> DataFrame:
    """Count every text of ``docs``, learn rules from those with a label, judge all.

    The counts (with the texts only if ``with_text``) are written to the shared folder
    once, as learning and judging both read them. Returns ``docs``, without its text
    unless ``with_text``, with the counts and the verdict.
    """
    counted = with_counts(docs, text)
    counted = shared.stash(counted if with_text else counted.drop(text), "text-counts")
    taught = labels.groupBy(F.col(key).alias("_taught")).agg(F.min(label).alias("_label"))
    numbers = counted.select(key, *COUNTS, *MORE)
    rules = learn(numbers.join(taught, numbers[key] == taught["_taught"]), "_label", key=key, **options)
    return apply_rules(counted, rules)
