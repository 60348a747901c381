"""Quality rules: a learned decision list over whole-text statistics.

The main path is one scan with DataFrame expressions. Learning is sequential
covering on the driver over the statistics of a bounded sample of labelled documents: grow a
conjunction of thresholds, prune it on held-back rows, drop what it covers, repeat.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table
from .text_stats import count_of, duplicate_lines, word_stats

#: Bound on the labelled rows that learning takes to the driver.
MAX_LABELLED = 8_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_distinct"]
#: What rules may test: name and how it follows from the counts (numerator, denominator).
FEATURES = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "distinct_share": ("n_distinct", "n_words"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        value, limit = feature(self.feature), F.lit(float(self.threshold))
        return value > limit if self.above else value <= limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Test, ...]


def feature(name: str) -> Column:
    over, under = FEATURES[name]
    value = F.col(over).cast("double")
    return value if under is None else F.when(F.col(under) > 0, value / F.col(under)).otherwise(F.lit(0.0))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS (long) and base_failed; columns with these names are replaced.

    NULL and empty texts have 0 everywhere and fail. Whole texts, no shuffle.
    """
    docs = docs.drop(*COUNTS, "base_failed")
    t, s = F.col(text), free_name(docs, "_stats")
    docs = docs.withColumn(s, word_stats(t)).withColumns(
        {
            "n_symbols": count_of(t, r"[#*$%&|<>]").cast("long"),
            "n_dup_lines": duplicate_lines(t).cast("long"),
            "n_upper": count_of(t, r"\p{Lu}").cast("long"),
            "n_marks": count_of(t, r"[!?]").cast("long"),
            "n_lines": (count_of(t, "\n") + 1).cast("long"),
        }
        | {c: F.col(s)[c] for c in ("n_words", "word_chars", "n_repeat_words", "n_distinct")}
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.withColumn("base_failed", failed).drop(s)


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents, those of least hash.

    Of documents that share an id one stands for all, that of least features.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
    chosen = chosen.groupBy("doc_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most limit ids
    found = with_statistics(known).where(~F.col("base_failed")).select("doc_id", "_label", F.struct(*(feature(f).alias(f) for f in FEATURES)).alias("x"))
    rows = found.groupBy("doc_id", "_label").agg(F.min("x").alias("x")).collect()  # a row for each id chosen, at most
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r.doc_id)), str(r.doc_id)))
    x = {f: np.array([r.x[f] for r in rows], float) for f in FEATURES}
    return x, np.array([r["_label"] for r in rows], int)


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (t.holds(x) for t in rule), np.ones(n, bool))


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    seen = np.unique(values)
    if len(seen) > most:
        seen = np.unique(np.quantile(values, np.linspace(0, 1, most + 1)))
    return np.round((seen[1:] + seen[:-1]) / 2, 6)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int) -> Rule:
    """Adds the test of best information gain until no good document is covered."""
    rule: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < max_tests and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        before = np.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))
        best, best_gain = None, 1e-6
        for f, values in x.items():
            v, b = values[inside], bad[inside]
            for cut in _cuts(v):
                high = v > cut
                for above, m in ((True, high), (False, ~high)):
                    p = int((m & b).sum())
                    if p and (gain := p * (np.log2(p / m.sum()) - before)) > best_gain:
                        best, best_gain = Test(f, above, float(cut)), gain
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest prefix that is best on held-back rows by (p - n) / (p + n)."""
    def worth(k: int) -> float:
        m = _covers(rule[:k], x, len(bad))
        p, n = (m & bad).sum(), (m & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn_rules(x: dict[str, np.ndarray], y: np.ndarray, min_precision: float = 0.97, min_covered: int = 3, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """Conjunctions that cover bad documents (label 0), in order.

    Two thirds of the rows grow rules, every third prunes them. A rule stays if, on all rows
    left, it covers ``min_covered`` bad ones at ``min_precision``. One class only: no rules.
    """
    bad = y == 0
    if not bad.any() or bad.all():
        return []
    left = np.ones(len(y), bool)
    third = np.arange(len(y)) % 3 == 2
    pick = lambda m: ({f: v[m] for f, v in x.items()}, bad[m])
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & bad & ~third).any():
        rule = _prune(_grow(*pick(left & ~third), max_tests), *pick(left & third))
        m = _covers(rule, x, len(y)) & left
        p, n = int((m & bad).sum()), int((m & ~bad).sum())
        if not rule or p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        left &= ~m
    return rules


def decision(rules: list[Rule]) -> Column:
    """Ordered conditional: the 1-based rule that rejects a document, else 0."""
    verdict: Column | None = None
    for k, rule in enumerate(rules, 1):
        holds = reduce(lambda a, b: a & b, (t.column() for t in rule))
        verdict = F.when(holds, F.lit(k)) if verdict is None else verdict.when(holds, F.lit(k))
    return F.lit(0) if verdict is None else verdict.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the statistics, base_failed, rule (0: none) and kept to each row.

    A document is kept if it passes the base checks and no rule covers it. NULL and empty
    texts fail; repeated rows get the same verdict; other columns pass through.
    """
    found = with_statistics(docs, text).withColumn("rule", decision(rules))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    return learn_rules(*labelled_statistics(docs, labels, limit=limit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
