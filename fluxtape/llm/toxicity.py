"""Toxicity by non-negative positive-unlabelled learning.

The training data are confirmed toxic texts and unlabelled texts, of which a share,
the class prior, is toxic too.  With the logistic loss l, the risk is

    prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])

and where the second term would turn negative its gradient is reversed, so the model
can't gain by memorising unlabelled texts as clean.  The model is a numpy linear
scorer over hashed words and word prefixes.  Its features are those whose excess among
toxic texts is larger than chance gives to the luckiest of so many features (a
likelihood ratio against twice the logarithm of their number), and the FEWEST best ones
in any case; what evidence is asked of a feature so follows the sample by itself.  They
must also be several times commoner among toxic texts than among unlabelled ones, for
long clean texts would else add up many small weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import chunks, distinct, sigmoid, slices, word_features

#: Bounds of the training sample: confirmed toxic texts and unlabelled texts.
POSITIVES, UNLABELLED = 3000, 9000
#: Features of the model, at most and at least.
KEPT, FEWEST = 4096, 64


@dataclass
class Model:
    """Sorted features with their weights, and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.near = np.zeros(1 << 16, bool)
        self.near[self.features >> 16] = True

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of toxic for each text."""
        out = np.full(len(texts), self.bias)
        for lo, hi in chunks(texts):
            row, feature = word_features(texts[lo:hi])
            use = self.near[feature >> 16]
            row, feature = distinct(row[use], feature[use])
            at = np.minimum(np.searchsorted(self.features, feature), max(len(self.features) - 1, 0))
            if len(self.features):
                hit = self.features[at] == feature
                out[lo:hi] += np.bincount(row[hit], self.weights[at[hit]], hi - lo)
        return sigmoid(out)


_ODD = np.random.default_rng(5).integers(0, 1 << 31, 12, np.uint32) * np.uint32(2) + np.uint32(1)


def _without_copies(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The first of texts with nearly the same features, by three keys of four minima each: copies are no further evidence."""
    seen, out = set(), []
    for features in texts:
        if len(features):
            low = (features * _ODD[:, None] ^ (features >> np.uint32(15)) * _ODD[::-1, None]).min(axis=1).reshape(3, 4)
            keys = {(i, *k) for i, k in enumerate(low.tolist())}
            if keys & seen:
                continue
            seen |= keys
        out.append(features)
    return out


def _excess(p_n: np.ndarray, u_n: np.ndarray, p_all: int, u_all: int) -> np.ndarray:
    """Likelihood ratio (twice its logarithm) of a feature's rate among toxic texts being its own; 0 where it is not higher."""
    whole = (p_n + u_n + 0.5) / (p_all + u_all + 1)

    def gain(n: np.ndarray, of: int) -> np.ndarray:
        rate = np.clip(n / of, 1e-9, 1 - 1e-9)
        return n * np.log(rate / whole) + (of - n) * np.log((1 - rate) / (1 - whole))

    return np.where(p_n / p_all > u_n / u_all, 2 * (gain(p_n, p_all) + gain(u_n, u_all)), 0.0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 800, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Train from the distinct features of each text; without toxic texts everything is clean."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -4.0)
    positive, unlabelled = _without_copies(positive), _without_copies(unlabelled)
    p_all, p_n = np.unique(np.concatenate(positive), return_counts=True)
    u_all, u_n = np.unique(np.concatenate(unlabelled), return_counts=True)
    if not len(p_all):
        return Model(np.zeros(0, np.uint32), np.zeros(0), -4.0)
    in_u = np.zeros(len(p_all), np.int64)
    if len(u_all):
        at = np.minimum(np.searchsorted(u_all, p_all), len(u_all) - 1)
        in_u = np.where(u_all[at] == p_all, u_n[at], 0)
    excess = _excess(p_n, in_u, len(positive), len(unlabelled))
    # a feature of toxic texts alone has a lift of 1 / prior, one that says nothing has 1: cut half-way
    lift = (p_n / len(positive)) / ((in_u + np.sqrt(in_u)) / len(unlabelled) + 1e-12)
    excess[lift < prior**-0.5] = 0
    order = np.argsort(-excess, kind="stable")[:KEPT]
    sure = max(int((excess[order] > 2 * np.log(len(p_all))).sum()), FEWEST)
    best = order[:sure][excess[order[:sure]] > 0]
    features = np.sort(p_all[best])
    if not len(features):
        return Model(features, np.zeros(0), -4.0)
    # where a feature is of toxic texts alone, its rates tell the share of toxic texts among the unlabelled ones
    share = (in_u[best].sum() / len(unlabelled)) / (p_n[best].sum() / len(positive))
    prior = min(max(share, 0.005), prior)

    def rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        all_of = np.concatenate(lists)
        where = np.minimum(np.searchsorted(features, all_of), len(features) - 1)
        hit = features[where] == all_of
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists])[hit], where[hit]

    (p_row, p_col), (u_row, u_col) = rows(positive), rows(unlabelled)
    w, bias = np.zeros(len(features)), -2.0
    seen_w, seen_b = np.full(len(w), 1e-6), 1e-6
    for _ in range(steps):
        p_out = sigmoid(bias + np.bincount(p_row, w[p_col], len(positive)))
        u_out = sigmoid(bias + np.bincount(u_row, w[u_col], len(unlabelled)))
        negative = np.mean(-np.log1p(-np.minimum(u_out, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(p_out, 1 - 1e-12)))
        # gradients in the outputs: toxic as toxic, unlabelled as clean, toxic as clean
        plus = prior * (p_out - 1) / len(positive)
        minus_p, minus_u = -prior * p_out / len(positive), u_out / len(unlabelled)
        g_p, g_u = (plus + minus_p, minus_u) if negative >= 0 else (plus - minus_p, -minus_u)
        grad = np.bincount(p_col, g_p[p_row], len(w)) + np.bincount(u_col, g_u[u_row], len(w)) + decay * w / len(w)
        slope = g_p.sum() + g_u.sum()
        seen_w += grad**2
        seen_b += slope**2
        w -= rate * grad / np.sqrt(seen_w)
        bias -= rate * slope / np.sqrt(seen_b)
    return Model(features, w, float(bias))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(docs: DataFrame, some: DataFrame, most: int) -> DataFrame:
    """``toxic``, ``toss``, ``features``: the distinct features of the training texts, one row for equal tosses of a task."""
    toss = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_TOSS))
    rows = docs.where(~held_out()).select("doc_id", "text", toss.alias("toss")).join(F.broadcast(some), "doc_id", "left")  # POSITIVES rows at most
    rows = rows.where(F.col("toxic").isNotNull() | (F.col("toss") <= most)).select(F.coalesce("toxic", F.lit(0)).alias("toxic"), "toss", "text")

    def run(batches):
        seen = set()
        for batch in slices(batches):
            keys = list(zip(batch.column("toxic").to_pylist(), batch.column("toss").to_pylist()))
            fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                row, feature = distinct(*word_features(texts[lo:hi]))
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), pa.array(feature.view(np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("toxic", "toss")), lists], ["toxic", "toss", "features"])

    return rows.mapInArrow(run, "toxic int, toss bigint, features array<int>")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows outside the held-out third; labels are used for confirmed toxic rows and the prior.

    The sample follows from hashes of the rows, not from their order, and one task fits
    the model from it: about POSITIVES and UNLABELLED texts, however many there are.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("toxic").alias("n"), F.sum("toxic").alias("toxic")).first()
    prior = min(max((counts.toxic or 0) / max(counts.n, 1), 0.005), 0.5)
    some = known.where("toxic = 1").select("doc_id", F.lit(1).alias("toxic"), F.xxhash64("doc_id").alias("o")).orderBy("o").limit(POSITIVES).drop("o")
    most = _share(UNLABELLED, docs.count() * 2 // 3)

    def run(batches):
        texts = {}
        for batch in batches:
            for toxic, toss, features in zip(batch.column("toxic").to_pylist(), batch.column("toss").to_pylist(), batch.column("features")):
                texts[toxic, toss] = features.values.to_numpy().view(np.uint32)
        order = sorted(texts)
        model = fit([texts[k] for k in order if k[0]], [texts[k] for k in order if not k[0]], prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.features.astype(np.int64)]), pa.array([model.weights]), pa.array([model.bias])], ["features", "weights", "bias"])

    fitted = _sampled(docs, some, most).repartition(1).mapInArrow(run, "features array<bigint>, weights array<double>, bias double").first()
    if fitted is None:
        return fit([], [], prior)
    return Model(np.array(fitted.features, np.uint32), np.array(fitted.weights, float), fitted.bias)


#: Values of the hash that a row is drawn by.
_TOSS = 1 << 40


def _share(wanted: int, of: int) -> int:
    return _TOSS if of <= wanted else int(wanted / of * _TOSS)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc`` (the row as it was), ``score``, ``predicted`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # KEPT features at most
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(whole, F.col("text").alias("own"))
    kind = docs.select(whole).schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("own").cast(pa.binary()).to_pylist()]
            out = sent.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out), pa.array((out >= threshold).astype(np.int32))], ["doc", "score", "predicted"])

    return rows.mapInArrow(run, f"doc {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc``, ``score`` (0 to 1, higher is more toxic), ``predicted`` (score >= threshold), ``held_out``.

    Learns from at most POSITIVES labelled toxic rows and about UNLABELLED other rows,
    none of them held out (crc32 of doc_id as text, modulo 3, is 1); scores all rows
    by whole text.  Null and wordless texts score the bias alone, below the threshold
    unless most texts are toxic.  A null doc_id is not held out and is not labelled; of
    repeated labels the toxic one counts.  Without toxic labels all scores are low.
    Empty tables give no rows; other columns are carried in ``doc`` and not read.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    return score(docs, model, threshold).withColumn("held_out", F.coalesce(F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
