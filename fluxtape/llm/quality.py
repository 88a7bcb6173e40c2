"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each text.  How the votes agree
over all texts tells, by expectation-maximisation, how often each heuristic votes
what on good and on bad texts, without a single true label.  The posterior of a
text's votes is the soft label with which a linear scorer over hashed words is
trained, so that the score uses the words of a text and not only the heuristics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import chunks, distinct, sigmoid, slices, word_features

#: Texts the scorer is trained on, at most about.
SAMPLE = 10_000
#: Weights of the scorer.
WIDTH = 1 << 18

#: The heuristics, in order of their votes.
LABELLERS = ("length", "word_length", "symbols", "digits", "sentences", "repeated_lines")

_GAPS, _SYMBOLS, _DIGITS, _STOPS, _CONTINUED = b" \t\n\r", b"#*$%&|<>{}=@~^", b"0123456789", b".!?", bytes(range(0x80, 0xC0))


def votes(texts: list[bytes]) -> np.ndarray:
    """A row of votes, 1 good, 0 bad, -1 nothing, for each text of UTF-8 bytes."""
    rows = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x]
        rows.append((len(t), *(len(t.translate(None, x)) for x in (_GAPS, _SYMBOLS, _DIGITS, _STOPS, _CONTINUED)), len(lines), len(set(lines))))
    size, gaps, symbols, digits, stops, points, lines, different = np.array(rows, np.int64).reshape(-1, 8).T
    gaps, symbols, digits, stops = (size - x for x in (gaps, symbols, digits, stops))
    n, chars = np.where(size > 0, gaps + 1, 0), points - gaps

    def vote(bad, good):
        return np.where(bad, 0, np.where(good, 1, -1))

    width = chars / np.maximum(n, 1)
    pace = n / np.maximum(stops, 1)
    good_pace = (stops > 0) & (pace >= 3) & (pace <= 60)
    columns = [
        vote(n < 30, n >= 120),
        vote((n == 0) | (width < 2.5) | (width > 12), (width >= 3.5) & (width <= 8)),
        vote(symbols > 0.04 * chars, symbols == 0),
        vote(digits > 0.08 * chars, digits < 0.01 * chars),
        vote(~good_pace, good_pace),
        vote((lines >= 4) & (different < 0.7 * lines), different == lines),
    ]
    return np.stack(columns, axis=1)


class Labellers:
    """Class share and each labeller's vote probabilities, by expectation-maximisation."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
        self.share = 0.7
        heuristics = patterns.shape[1] if len(patterns) else 0
        # votes on bad (row 0) and good (row 1) texts; the start says heuristics are right more often than not
        self.p = np.tile(np.array([[[0.5, 0.2, 0.3], [0.1, 0.6, 0.3]]]), (heuristics, 1, 1))
        for _ in range(rounds):
            good = self.posterior(patterns)
            self.share = float(np.clip((good @ counts) / max(counts.sum(), 1), 0.02, 0.98))
            for j in range(heuristics):
                for k, vote in enumerate((0, 1, -1)):
                    hit = patterns[:, j] == vote
                    self.p[j, 1, k] = (good[hit] @ counts[hit] + 1) / (good @ counts + 3)
                    self.p[j, 0, k] = ((1 - good[hit]) @ counts[hit] + 1) / ((1 - good) @ counts + 3)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        odds = np.full(len(patterns), np.log(self.share / (1 - self.share)))
        column = np.array([2, 0, 1])  # -1, 0, 1
        for j in range(patterns.shape[1] if len(patterns) else 0):
            k = column[patterns[:, j] + 1]
            odds += np.log(self.p[j, 1, k]) - np.log(self.p[j, 0, k])
        return sigmoid(odds)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * len(LABELLERS)).astype(np.int32)), pa.array(rows.ravel().astype(np.int32)))


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    row, feature = word_features(texts)
    return distinct(row, feature & np.uint32(WIDTH - 1))


def fit(features: list[np.ndarray], target: np.ndarray, steps: int = 120, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets; a text's features share one unit of weight."""
    w, bias, seen = np.zeros(WIDTH), 0.0, np.full(WIDTH, 1e-3)
    order = np.random.default_rng(5).permutation(len(features))
    if not len(order):
        return w.astype(np.float32), bias
    places = range(0, len(order), 500)
    for step in range(steps):  # as many for any sample
        lo = places[step % len(places)]
        some = order[lo : lo + 500]
        size = np.array([len(features[i]) for i in some])
        col = np.concatenate([features[i] for i in some]) if size.sum() else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(some)), size)
        scale = 1 / np.sqrt(np.maximum(size, 1))
        gap = sigmoid(bias + scale * np.bincount(row, w[col], len(some))) - target[some]
        grad = np.bincount(col, (gap * scale)[row], WIDTH) / len(some)
        seen += grad**2
        w -= rate * grad / np.sqrt(seen)
        bias -= rate * gap.mean()
    return w.astype(np.float32), float(bias)


def weak_label_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, weak_label, score, predicted`` of every row.

    ``weak_label`` is the posterior from the heuristics' votes, ``score`` the trained
    scorer's probability of good text, ``predicted`` 1 from ``threshold`` up.  Vote
    patterns are counted over all rows (3 to the power of the heuristics at most);
    the scorer is fitted on about SAMPLE rows, drawn by a hash of doc_id and text.
    Null and empty texts are voted bad and scored by the bias.  Null doc_ids are kept,
    repeated rows are scored each time, an empty table gives no rows, other columns
    are not read.
    """
    spark = docs.sparkSession
    texts_only = docs.select("text")

    def tally(batches):
        for batch in slices(batches):
            found, n = np.unique(votes(_bytes(batch)), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([_lists(found), pa.array(n)], ["votes", "n"])

    counted = texts_only.mapInArrow(tally, "votes array<int>, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([r.votes for r in counted], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([r.n for r in counted], np.float64)
    model = Labellers(patterns, counts)
    total = int(counts.sum())
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) <= min(1 << 20, int(SAMPLE / max(total, 1) * (1 << 20)))

    def gather(batches):
        for batch in slices(batches):
            texts = _bytes(batch)
            for lo, hi in chunks(texts):
                row, feature = _hashed(texts[lo:hi])
                cuts = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("o").slice(lo, hi - lo), _lists(votes(texts[lo:hi])), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.view(np.int32)))], ["o", "votes", "features"])

    def learn(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column("o").to_pylist(), batch.column("votes").to_pylist(), (x.values.to_numpy() for x in batch.column("features")))
        rows.sort(key=lambda r: r[0])  # the order of arrival says nothing
        weights, bias = fit([r[2] for r in rows], model.posterior(np.array([r[1] for r in rows], np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])

    sample = docs.where(drawn).select(F.xxhash64("text", "doc_id").alias("o"), "text").mapInArrow(gather, "o bigint, votes array<int>, features array<int>")
    learned = sample.repartition(1).mapInArrow(learn, "weights binary, bias double").first() if total else None  # one task, about SAMPLE texts
    weights, bias = (np.frombuffer(learned.weights, np.float32), learned.bias) if learned else (np.zeros(WIDTH, np.float32), 0.0)
    sent = spark.sparkContext.broadcast((weights, bias, model))  # WIDTH weights
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        w, b, em = sent.value
        for batch in slices(batches):
            texts = _bytes(batch)
            out = np.zeros(len(texts))
            for lo, hi in chunks(texts):
                row, feature = _hashed(texts[lo:hi])
                size = np.bincount(row, minlength=hi - lo)
                out[lo:hi] = np.bincount(row, w[feature], hi - lo) / np.sqrt(np.maximum(size, 1))
            out = sigmoid(out + b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(em.posterior(votes(texts))), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc_id", "weak_label", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, weak_label double, score double, predicted int")
