"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. Each model sees which words and word beginnings of its vocabulary a text has and the
log-odds of the categories before it. While fitting, those are out-of-fold predictions,
so a later model learns from probabilities as good as it will get.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, table
from .decontamination import words_of
from .linear import Logistic, Rows, fit_logistic, fit_platt, sigmoid

#: Bound on the labelled documents that fitting takes to the driver.
MAX_LABELLED = 8_000
MAX_VOCABULARY = 512
FOLDS = 5
#: Lengths of word beginnings, in characters, that are signs of their own.
PREFIXES = (3, 5, 7)
#: A flag needs this probability.
THRESHOLD = 0.65


@dataclass
class Link:
    """One category's model: word weights, weights of earlier categories, calibration."""

    category: str
    words: dict[int, float]
    earlier: list[float]
    bias: float
    a: float
    b: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def logits(self, present: set[int]) -> list[float]:
        """Calibrated log-odds of each category, in order."""
        out: list[float] = []
        for k in self.links:
            z = k.bias + sum(k.words[h] for h in present & k.words.keys()) + sum(w * x for w, x in zip(k.earlier, out, strict=True))
            out.append(k.a * z + k.b)
        return out


def word_signs(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings, which many inflected or compound forms share."""
    chars = word.decode("utf-8", "surrogatepass")
    signs = [word, *(b"^" + chars[:k].encode("utf-8", "surrogatepass") for k in PREFIXES if len(chars) >= k)]
    return [_signed(xxhash.xxh3_64_intdigest(x)) for x in signs]


def word_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct signs of the words; case and punctuation don't matter."""
    return np.unique(np.array([h for w in set(words_of(text)) for h in word_signs(w)], np.int64))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def select_words(rows: list[np.ndarray], y: np.ndarray, most: int = MAX_VOCABULARY, min_docs: int = 3, min_score: float = 3.0) -> np.ndarray:
    """Words that more positive documents have than chance allows: the highest z of their log-odds."""
    if not y.any() or y.all():
        return np.empty(0, np.int64)
    count = lambda pick: np.unique(np.concatenate([r for r, p in zip(rows, pick, strict=True) if p] or [np.empty(0, np.int64)]), return_counts=True)
    words, n_pos = count(y > 0)
    neg_words, neg = count(y == 0)
    n_neg = np.zeros(len(words))
    at = np.searchsorted(neg_words, words)
    hit = (at < len(neg_words)) & (neg_words[np.minimum(at, len(neg_words) - 1)] == words) if len(neg_words) else np.zeros(len(words), bool)
    n_neg[hit] = neg[at[hit]]
    p, q = (n_pos + 0.5) / (y.sum() + 1), (n_neg + 0.5) / ((y == 0).sum() + 1)
    z = (np.log(p / (1 - p + 1e-9)) - np.log(q / (1 - q + 1e-9))) / np.sqrt(1 / (n_pos + 0.5) + 1 / (n_neg + 0.5))
    keep = (n_pos >= min_docs) & (z >= min_score)
    order = np.lexsort((words, -z))
    return words[order[keep[order]]][:most]


def _design(rows: list[np.ndarray], words: np.ndarray, earlier: np.ndarray) -> Rows:
    """Presence of the words, then the earlier log-odds."""
    order = np.argsort(words)
    ranked = words[order]
    out = []
    for i, r in enumerate(rows):
        at = np.searchsorted(ranked, r)
        hit = (at < len(ranked)) & (ranked[np.minimum(at, max(len(ranked) - 1, 0))] == r) if len(ranked) else np.zeros(len(r), bool)
        columns = np.concatenate([order[at[hit]], len(words) + np.arange(earlier.shape[1])])
        out.append((columns, np.concatenate([np.ones(int(hit.sum())), earlier[i]])))
    return Rows.of(out)


def _fit(rows: list[np.ndarray], y: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, Logistic]:
    words = select_words(rows, y)
    size = len(words) + earlier.shape[1]
    return words, fit_logistic(_design(rows, words, earlier), y.astype(float), size, l2=2e-3, steps=300)


def fit_chain(rows: list[np.ndarray], targets: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """``targets``: 0/1 of each row by category, in the order of the chain."""
    n = len(rows)
    chain, earlier = Chain(), np.zeros((n, 0))
    fold = np.arange(n) % folds
    for category, y in targets.items():
        out = np.zeros(n)
        for f in range(folds):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            words, model = _fit([rows[i] for i in train], y[train], earlier[train])
            out[test] = model.logit(_design([rows[i] for i in test], words, earlier[test]))
        a, b = fit_platt(out, y)
        words, model = _fit(rows, y, earlier)
        w = model.weights
        chain.links.append(Link(category, {int(h): float(x) for h, x in zip(words, w, strict=False)}, [float(x) for x in w[len(words) :]], float(model.bias), float(a), float(b)))
        earlier = np.column_stack([earlier, a * out + b])
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("toxic",), limit: int = MAX_LABELLED) -> Chain:
    """Learns from at most ``limit`` labelled documents, those of least hash of doc_id.

    ``categories`` are 0/1 columns of ``labels``, in the order of the chain; NULL counts as 0. Of documents that
    share an id one stands for all. Without labels the chain finds nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.coalesce(*(F.col(c) for c in categories)).isNotNull())
    known = known.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"_y{k}") for k, c in enumerate(categories)))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most limit ids

    def make():
        return lambda text: (word_hashes(text).tobytes(),)

    hashed = append_columns(sample, [T.StructField("_words", T.BinaryType())], make, ["text"]).drop("text")
    ys = [f"_y{k}" for k in range(len(categories))]
    hashed = hashed.groupBy("doc_id", *ys).agg(F.min("_words").alias("_words")).collect()  # a row for each id chosen, at most
    hashed.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r.doc_id)), str(r.doc_id)))
    rows = [np.frombuffer(r["_words"], np.int64) for r in hashed]
    targets = {c: np.array([r[y] for r in hashed], int) for c, y in zip(categories, ys, strict=True)}
    return fit_chain(rows, targets)


class _Known(dict):
    """Those signs of each word that a model knows; kept for so many words."""

    def __init__(self, known: frozenset[int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        signs = self[word] = tuple(h for h in word_signs(word) if h in self.known)
        return signs


def predict(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """Adds p_<category> and is_<category> for each category of the chain to each row.

    Whole texts, one scan, no shuffle; the models' size is bounded. NULL and empty texts have no
    words and get the probability of a text without signs. Repeated rows get the same;
    columns named like an output are replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    fields = [f for k in chain.links for f in (T.StructField(f"p_{k.category}", T.DoubleType()), T.StructField(f"is_{k.category}", T.BooleanType()))]

    def make():
        c = shared.value
        known = _Known(frozenset(h for k in c.links for h in k.words))

        def of(text):
            present = set(itertools.chain.from_iterable(map(known.__getitem__, set(words_of(text)))))
            out: list = []
            for p in sigmoid(np.array(c.logits(present))).tolist():
                out += [p, p >= threshold]
            return tuple(out)

        return of

    return append_columns(docs, fields, make, ["text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain low_quality → toxic: both are columns of ``labels``, and junk tells something of abuse."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return predict(docs, fit(docs, labels.withColumn("low_quality", 1 - F.col("quality")), ("low_quality", "toxic"))).drop("text")
