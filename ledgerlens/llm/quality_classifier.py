"""Quality classifier by co-training of two views.

The text view sees the content: hashed endings, hashed whole words, immediate repeats, lines and shares of character classes.
The metadata view sees only what is stored with a page: source, language, their pair and the stated length. Both are fitted on the driver,
on a bounded sample of the labelled pages and on what all pseudo-labelled pages add up to; over some rounds
each scores every unlabelled page and hands its most confident pseudo-labels to the other. Then each is calibrated on labelled
rows that no fit has seen, and the sum of the calibrated log-odds scores every document.
"""

from __future__ import annotations

import itertools
import operator
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, materialize, table
from .linear import Logistic, Rows, fit_logistic, fit_platt, sigmoid

#: Bound on the labelled documents that fitting uses.
MAX_LABELLED = 4_000
#: Ids of labelled documents that one broadcast may hold.
MAX_BROADCAST_IDS = 1_000_000
ROUNDS = 4
#: Share of the pool that a view hands over in a round, and how sure it must be.
HANDED = 0.05
SURE = 0.9
#: Weight of a pseudo-labelled document; all of a view weigh at most so much of its labelled ones.
PSEUDO = 0.5
#: Levels of log-odds by which a hand-over is cut, so many to 1, and groups in which features are summed.
LEVELS, PER_UNIT = 1 << 12, 128
GROUPS = 8
#: Sums are integers, the same in any order.
UNIT = 1 << 24
#: Good held-out documents that the threshold may reject.
CLEAN_LOSS = 0.003

ENDINGS, WORDS = 1 << 12, 1 << 13
#: After them: the share of words that equal the one before, and what is measured on the whole text.
REPEATED = ENDINGS + WORDS
SHAPE = REPEATED + 1
#: Deleting these leaves the rest, whose length tells the share of the class.
_CLASSES = [bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b".,;:", b"#*$%&|<>", b"\n", b" "]
TEXT_SIZE = SHAPE + 3 + len(_CLASSES)
LANGS, SOURCES, PAIRS, LENGTHS = 16, 64, 256, 24
META_SIZE = LANGS + SOURCES + PAIRS + LENGTHS


def shape(text: str | None) -> list[float]:
    """Length of lines, lines, share of bytes beyond ASCII, and shares of the character classes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size, lines = max(len(raw), 1), raw.count(b"\n") + 1
    return [np.log1p(size / lines) / 10, np.log1p(lines) / 10, (len(raw) - len(text or "")) / size, *((len(raw) - len(raw.translate(None, c))) / size for c in _CLASSES)]


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed endings and words with their share of the words, and the text's shape; a text without words has only that."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    at = np.array([f for w in words for f in _word_features(w)], np.int64)
    found, n = np.unique(at, return_counts=True)
    rest = [_repeated(words) if words else 0.0, *shape(text)]
    return np.concatenate([found, np.arange(REPEATED, TEXT_SIZE)]).astype(np.int32), np.concatenate([n / max(len(words), 1), rest])


def _repeated(words: list[bytes]) -> float:
    return sum(map(operator.eq, words, itertools.islice(words, 1, None))) / len(words)


@lru_cache(1 << 17)
def _word_features(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word[-2:]) % ENDINGS, ENDINGS + zlib.crc32(word.lower()) % WORDS


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Which features are set; each is 0 or 1. A missing value is one of its own."""
    size = LENGTHS - 1 if n_chars is None else min(max(int(n_chars), 0).bit_length(), LENGTHS - 2)
    of = lambda value, slots: zlib.crc32(repr(value).encode("utf-8", "surrogatepass")) % slots
    return np.array([of(lang, LANGS), LANGS + of(source, SOURCES), LANGS + SOURCES + of((lang, source), PAIRS), LANGS + SOURCES + PAIRS + size])


@dataclass
class View:
    weights: np.ndarray
    bias: float
    a: float
    b: float


@dataclass
class Model:
    text: View
    meta: View
    prior: float
    threshold: float


def _scaled_fit(x: Rows, y: np.ndarray, size: int, weight: np.ndarray) -> Logistic:
    """Fit on features divided by their root mean square, rare ones less so."""
    square = np.bincount(x.at, weights=x.value**2, minlength=size) / max(len(x), 1)
    scale = 1.0 / np.sqrt(square + 1e-5)
    model = fit_logistic(Rows(x.at, x.value * scale[x.at], x.start), y, size, l2=1e-2, steps=80, weight=weight)
    return Logistic(model.weights * scale, model.bias)


#: Tasks whose sums are added up in one group.
FAN_IN = 64


class Pool:
    """All unlabelled documents, as features in a written table."""

    def __init__(self, features: DataFrame):
        self.features = features

    def levels(self, views: list[View]) -> np.ndarray:
        """For each view the number of documents at each level of its log-odds."""

        def run(batches):
            import pyarrow as pa

            n = np.zeros((2, LEVELS), np.int64)
            for batch in batches:
                for v, x in enumerate(_batch_views(batch)):
                    n[v] += np.bincount(_level(_log_odds(x, views[v])), minlength=LEVELS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.ravel()[at])], ["at", "n"])

        out = np.zeros(2 * LEVELS, np.int64)
        for r in self.features.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out.reshape(2, LEVELS)

    def sums(self, rounds: list[tuple[list[View], list[dict[int, int]]]]) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each view (label, documents, summed features) of what it was given up to now.

        Documents of one label are added up in groups of like log-odds of that view: the gradient of a group is then about that of its mean.
        """
        sizes, latest, fan = (TEXT_SIZE, META_SIZE), rounds[-1][0], FAN_IN

        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            n = np.zeros((2, 2 * GROUPS), np.int64)
            total = [np.zeros((2 * GROUPS, size), np.int64) for size in sizes]
            for batch in batches:
                xs = _batch_views(batch)
                given = _given(xs, rounds)
                for v, x in enumerate(xs):
                    group = np.clip(np.floor(_log_odds(x, latest[v]) / 2) + GROUPS // 2, 0, GROUPS - 1).astype(np.int64)
                    cell = np.where(given[v] >= 0, given[v] * GROUPS + group, -1)
                    n[v] += np.bincount(cell[cell >= 0], minlength=2 * GROUPS)
                    of = np.repeat(cell, np.diff(x.start))
                    np.add.at(total[v].reshape(-1), of[of >= 0] * sizes[v] + x.at[of >= 0], np.rint(x.value[of >= 0] * UNIT).astype(np.int64))
            task = TaskContext.get()
            part = (task.partitionId() if task else 0) // fan
            rows = [(v * 2 * GROUPS + int(c), part, int(n[v][c]), total[v][c].tobytes()) for v in (0, 1) for c in np.flatnonzero(n[v])]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["cell", "part", "n", "total"])

        def add(rows):
            import pyarrow as pa

            total = 0
            for t in rows.column("total"):
                total = total + np.frombuffer(t.as_buffer(), np.int64)
            return pa.table({"cell": rows["cell"][:1], "part": pa.array([rows["part"][0].as_py() // fan], pa.int32()), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

        wire = "cell int, part int, n long, total binary"
        sums, parts = self.features.mapInArrow(run, wire), -(-self.features.rdd.getNumPartitions() // fan)
        while True:  # as many neighbours a round, so a group never has more rows
            sums = sums.groupBy("cell", "part").applyInArrow(add, wire)
            if parts <= 1:
                break
            parts = -(-parts // fan)
        found = sums.collect()
        out: list[list[tuple[int, int, np.ndarray]]] = [[], []]
        for r in sorted(found, key=lambda r: r["cell"]):
            v, c = divmod(r["cell"], 2 * GROUPS)
            out[v].append((c // GROUPS, r["n"], np.frombuffer(r["total"], np.int64) / UNIT))
        return out


def _log_odds(x: Rows, view: View) -> np.ndarray:
    """Each row by itself, so that it's the same in any batch."""
    row = np.repeat(np.arange(len(x)), np.diff(x.start))
    return view.a * (np.bincount(row, weights=x.value * view.weights[x.at], minlength=len(x)) + view.bias) + view.b


def _level(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z * PER_UNIT).astype(np.int64) + LEVELS // 2, 0, LEVELS - 1)


def _cuts(n: np.ndarray, prior: float) -> dict[int, int]:
    """The level from which a view's documents are handed over as good, and that up to which as bad.

    The most confident HANDED of them all by the classes' shares, with those that are level with the last, and only sure ones.
    """
    sure = int(_level(np.array([np.log(SURE / (1 - SURE))]))[0])
    wanted = {k: max(1, int(HANDED * n.sum() * share)) for k, share in ((1, prior), (0, 1 - prior))}
    good = LEVELS - 1 - int(np.searchsorted(np.cumsum(n[::-1]), wanted[1]))
    return {1: max(good, sure + 1), 0: min(int(np.searchsorted(np.cumsum(n), wanted[0])), LEVELS - 2 - sure)}


def _given(xs: list[Rows], rounds: list[tuple[list[View], list[dict[int, int]]]]) -> list[np.ndarray]:
    """The pseudo-labels that each view was given, -1 for none: the first one stays."""
    given = [np.full(len(xs[0]), -1), np.full(len(xs[0]), -1)]
    for views, cuts in rounds:
        for v in (0, 1):
            level, other = _level(_log_odds(xs[v], views[v])), given[1 - v]
            other[(level >= cuts[v][1]) & (other < 0)] = 1
            other[(level <= cuts[v][0]) & (other < 0)] = 0
    return given


def co_train(views: tuple[Rows, Rows], y: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> Model:
    """``views``: text and metadata of the labelled rows; ``pool``: the unlabelled ones."""
    sizes = (TEXT_SIZE, META_SIZE)
    held = np.arange(len(y)) % 4 == 3
    fit_at, cal_at = np.flatnonzero(~held), np.flatnonzero(held)
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    found: list[View] = []
    given: list[list[tuple[int, int, np.ndarray]]] = [[], []]  # what the pseudo-labels each view was given add up to
    done: list[tuple[list[View], list[dict[int, int]]]] = []
    for step in range(rounds + 1):
        found = []
        for v in (0, 1):
            r = views[v]
            rows = [(r.at[r.start[i] : r.start[i + 1]], r.value[r.start[i] : r.start[i + 1]]) for i in fit_at]
            rows += [(at := np.flatnonzero(total), total[at] / n) for _, n, total in given[v]]
            labels = np.concatenate([y[fit_at], [k for k, _, _ in given[v]]]).astype(float)
            n = np.array([n for _, n, _ in given[v]], float)
            weight = np.concatenate([np.ones(len(fit_at)), PSEUDO * n * min(1.0, len(fit_at) / max(n.sum(), 1.0))])
            model = _scaled_fit(Rows.of(rows), labels, sizes[v], weight)
            found.append(View(model.weights, model.bias, *fit_platt(model.logit(r.take(cal_at)), y[cal_at])))
        if step == rounds or len(np.unique(y)) < 2:
            break
        levels = pool.levels(found)
        if not levels.any():
            break
        done.append((found, [_cuts(n, prior) for n in levels]))
        given = pool.sums(done)
    scores = combined(*(_log_odds(views[v].take(cal_at), w) for v, w in enumerate(found)), prior)
    return Model(*found, prior, choose_threshold(scores[y[cal_at] == 1], scores[y[cal_at] == 0]))


def choose_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """Where a document is as likely bad as good, as the views are calibrated; lower if that would cost more than CLEAN_LOSS of the held-out good rows.

    Without held-out rows of both classes nothing is rejected.
    """
    if not len(good) or not len(bad):
        return 0.0
    return min(0.5, float(np.sort(good)[int(CLEAN_LOSS * len(good))]))


def combined(text_logit, meta_logit, prior: float):
    """Log-odds of views that are independent given the class, as a probability."""
    return sigmoid(text_logit + meta_logit - np.log(prior / (1 - prior)))


FEATURES = [T.StructField(c, T.BinaryType()) for c in ("_at", "_share", "_meta_at", "_meta")]


def _with_features(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "_y", "text", *(F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))))

    def make():
        def of(text, lang, source, n_chars):
            at, share = text_features(text)
            some = meta_features(lang, source, n_chars)
            return at.astype("<u2").tobytes(), share.astype("<f4").tobytes(), some.astype("<u2").tobytes(), np.ones(len(some), "<f4").tobytes()

        return of

    return append_columns(docs, FEATURES, make, ["text", "lang", "source", "n_chars"]).select("doc_id", "_y", *(f.name for f in FEATURES))


def _views(cells: list[list[bytes]]) -> tuple[Rows, Rows]:
    """Rows of the text and the metadata view from the cells of FEATURES."""

    def rows(at: list[bytes], value: list[bytes]) -> Rows:
        start = np.concatenate([[0], np.cumsum([len(x) // 2 for x in at])]).astype(np.int64)
        return Rows(np.frombuffer(b"".join(at), "<u2").astype(np.int64), np.frombuffer(b"".join(value), "<f4").astype(float), start)

    return rows(*cells[:2]), rows(*cells[2:])


def _batch_views(batch) -> tuple[Rows, Rows]:
    return _views([batch.column(f.name).to_pylist() for f in FEATURES])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, labelled_from: DataFrame | None = None) -> Model:
    """Learns from at most so many labelled documents, those of least hash of doc_id, and from all unlabelled ones.

    ``labelled_from``: where the labelled rows are read, ``docs`` itself if not given; a pipeline's stage, whose input lost
    most of the bad ones, hands over the whole table. Of documents that share an id one stands for all.
    Without labels of both classes every document gets the prior and is kept.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    source = (docs if labelled_from is None else labelled_from).drop("_y")
    labelled = _with_features(source.join(F.broadcast(chosen), "doc_id"))  # at most the bound of ids
    names = [f.name for f in FEATURES]
    rows = labelled.groupBy("doc_id", "_y").agg(F.min(F.struct(*names)).alias("x")).collect()  # a row for each id chosen, at most
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id)))
    ids = known.select("doc_id")
    ids = F.broadcast(ids) if labels.count() <= MAX_BROADCAST_IDS else ids
    others = _with_features(docs.drop("_y").join(ids, "doc_id", "left_anti").withColumn("_y", F.lit(-1)))
    pool = Pool(materialize(others.select(*names), "unlabelled"))
    return co_train(_views([[bytes(r.x[c]) for r in rows] for c in names]), np.array([r["_y"] for r in rows], int), pool)


SCORES = [T.StructField("p_text", T.DoubleType()), T.StructField("p_meta", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]


class _WordWeights(dict):
    """What a word adds to the text view's log-odds, kept for so many words."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > 150_000:
            self.clear()
        a, b = _word_features(word)
        w = self[word] = float(self.weights[a] + self.weights[b])
        return w


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds p_text, p_meta, score (probability of good quality) and kept to each row.

    Whole texts, one scan, no shuffle; the model's size is fixed. NULL and empty texts have
    no words and are scored by shape and metadata; NULL metadata is a value of its own; missing metadata
    columns count as NULL. Repeated rows score alike; columns named like an output are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    meta = [c for c in ("lang", "source", "n_chars") if c in docs.columns]

    def make():
        m = shared.value
        words = _WordWeights(m.text.weights)

        def of(text, *cells):
            given = dict(zip(meta, cells, strict=True))
            found = text.encode("utf-8", "surrogatepass").split() if text else []
            z = m.text.bias
            if found:
                z += sum(map(words.__getitem__, found)) / len(found) + m.text.weights[REPEATED] * _repeated(found)
            z += float(np.dot(shape(text), m.text.weights[SHAPE:]))
            v = float(m.meta.weights[meta_features(given.get("lang"), given.get("source"), given.get("n_chars"))].sum()) + m.meta.bias
            z, v = m.text.a * z + m.text.b, m.meta.a * v + m.meta.b
            p = float(combined(z, v, m.prior))
            return float(sigmoid(z)), float(sigmoid(v)), p, p >= m.threshold

        return of

    return append_columns(docs, SCORES, make, ["text", *meta])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "p_text", "p_meta", "score", "kept")
