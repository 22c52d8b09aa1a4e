"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are a document's words and their beginnings (4, 5 and 6 letters), so that inflected and unseen
forms of a known stem count. Which of them matter is read from the labelled rows: counts of toxic and
other documents per feature, summed by Spark, ranked by the G statistic.

Labels have two values. The severity grades 0 (not toxic) and 1 to 3 split the toxic documents into thirds by how
many indicator words stand in them. The regression has one weight for each feature, shared by all thresholds:
P(grade > k) = logistic(w.x - threshold_k), the thresholds being ordered by construction.

Only the fit is bounded: ``SAMPLE`` labelled rows, chosen by a hash of their id, and ``FEATURES`` features.
Scoring reads every word of every text. One pass, no shuffle.

Defined results: a null or empty text has severity by its (no) features, which is near 0; without labels of
both kinds every severity is 0; repeated and conflicting labels of one id count as the larger; null labels are left out; other
columns pass through, and one called like an output is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import cut, per_row, text_of

SAMPLE = 10_000
FEATURES = 4_000
#: A feature has to occur in so many labelled documents.
SUPPORT = 3
#: ... and at least so large a G statistic (in nats).
LEAST_G = 3.0
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) >= n]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, keep: F.Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents, those with the smallest hash of their id; of rows that repeat an id, the smallest text."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        known = known.where(keep)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(limit)
    # The hint's side has at most ``limit`` rows of two numbers.
    sampled = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return sampled.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


class Severity:
    """The fitted model: a weight for each feature, and thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self._seen: dict[str, tuple[str, ...]] = {}

    def _known(self, word: str) -> tuple[str, ...]:
        known = self._seen.get(word)
        if known is None:
            if len(self._seen) > 100_000:
                self._seen.clear()
            known = self._seen[word] = tuple(f for f in features_of(word) if f in self.weights)
        return known

    def vector(self, text: str | None) -> dict[str, float]:
        """log(1 + count) of each known feature."""
        counts: Counter = Counter()
        for word, n in word_counts(text).items():
            for f in self._known(word):
                counts[f] += n
        return {f: math.log1p(n) for f, n in counts.items()}

    def exceed(self, text: str | None) -> list[float]:
        """P(grade > k) for k = 0, 1, ..."""
        if not self.thresholds:
            return [0.0] * GRADES
        score = sum(self.weights[f] * v for f, v in sorted(self.vector(text).items()))
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def _feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, other): labelled documents that hold it. Summed in each task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                (toxic if label else other).update({f for w in word_counts(text) for f in features_of(w)})
            names = sorted(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_pydict(
                {
                    "feature": pa.array(names, pa.string()),
                    "toxic": pa.array([toxic[f] for f in names], pa.int64()),
                    "other": pa.array([other[f] for f in names], pa.int64()),
                }
            )

    counted = sample.mapInArrow(run, "feature string, toxic bigint, other bigint")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _select_features(sample: DataFrame, n_toxic: int, n_other: int) -> list[tuple[str, float]]:
    """(feature, log odds) of the ``FEATURES`` with the largest G statistic."""
    a, b = F.col("toxic"), F.col("other")
    n = float(n_toxic + n_other)

    def part(seen: F.Column, row: F.Column, column: float) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)

    row = (a + b).cast("double")
    rest = n - row
    g = part(a, row, float(n_toxic)) + part(b, row, float(n_other))
    g = g + part(n_toxic - a, F.greatest(rest, F.lit(1e-9)), float(n_toxic)) + part(n_other - b, F.greatest(rest, F.lit(1e-9)), float(n_other))
    odds = F.log((a + 0.5) / (n_toxic - a + 0.5)) - F.log((b + 0.5) / (n_other - b + 0.5))
    ranked = _feature_counts(sample).where(a + b >= SUPPORT).select("feature", g.alias("g"), odds.alias("odds"))
    ranked = ranked.where(F.col("g") >= LEAST_G)
    best = ranked.orderBy(F.round("g", 9).desc(), "feature").limit(FEATURES).collect()
    return [(r.feature, r.odds) for r in best]


def _minimise(rows, columns, values, grades, n_features, steps=300, l2=2e-4):
    """Adam on the mean negative log likelihood; the sparse matrix is given as coordinate lists."""
    n = len(grades)
    params = np.zeros(n_features + GRADES)
    params[n_features:] = [2.0] + [0.0] * (GRADES - 1)  # first threshold, then logarithms of the gaps
    first, second = np.zeros_like(params), np.zeros_like(params)
    share = np.bincount(grades, minlength=GRADES + 1) / n
    balance = np.where(grades == 0, 0.5 / max(share[0], 1e-9), 0.5 / max(1 - share[0], 1e-9))
    balance /= balance.sum()

    def logistic(z):
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    for step in range(1, steps + 1):
        w, raw = params[:n_features], params[n_features:]
        thresholds = raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))
        score = np.bincount(rows, values * w[columns], n)
        above = logistic(score[:, None] - thresholds[None, :])  # P(grade > k)
        upper = np.concatenate((np.ones((n, 1)), above), axis=1)[np.arange(n), grades]
        lower = np.concatenate((above, np.zeros((n, 1))), axis=1)[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-9)
        slope = above * (1 - above)
        d_upper = np.concatenate((np.zeros((n, 1)), slope), axis=1)[np.arange(n), grades]
        d_lower = np.concatenate((slope, np.zeros((n, 1))), axis=1)[np.arange(n), grades]
        d_score = -balance * (d_upper - d_lower) / p
        gradient = np.zeros_like(params)
        gradient[:n_features] = np.bincount(columns, values * d_score[rows], n_features) + l2 * w
        d_thresholds = np.zeros(GRADES)
        for k in range(GRADES):
            d_thresholds[k] = (balance / p * slope[:, k] * ((grades == k + 1) * 1.0 - (grades == k))).sum()
        gaps = np.exp(raw[1:])
        gradient[n_features] = d_thresholds.sum()
        for k in range(1, GRADES):
            gradient[n_features + k] = gaps[k - 1] * d_thresholds[k:].sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    raw = params[n_features:]
    return params, (raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))).tolist()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, keep: F.Column | None = None) -> Severity:
    """The model of ``labels.toxic``, fitted on at most ``sample_rows`` labelled documents."""
    sample = cut(labelled_sample(docs, labels, "toxic", sample_rows, keep), "labelled")
    counts = {r.label > 0: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Severity({}, [])
    chosen = _select_features(sample, counts[True], counts[False])
    index = {f: i for i, (f, _) in enumerate(chosen)}
    indicators = {f for f, odds in chosen if odds >= 3}
    probe = Severity(dict.fromkeys(index, 0.0), [])
    shared = docs.sparkSession.sparkContext.broadcast((probe, indicators, index))

    def make():
        model, marked, place = shared.value

        def run(texts):
            known, amount, hits = [], [], []
            for text in texts:
                x = model.vector(text)
                names = sorted(x, key=place.__getitem__)
                known.append(np.array([place[f] for f in names], np.int32).tobytes())
                amount.append(np.array([x[f] for f in names], np.float32).tobytes())
                hits.append(sum(n for w, n in word_counts(text).items() if any(f in marked for f in features_of(w))))
            return known, amount, hits

        return run

    # A few numbers for each sampled row come to the driver, packed.
    fields = [("known", "binary"), ("amount", "binary"), ("hits", "bigint")]
    got = per_row(sample, ["text"], fields, make, ("text",)).sort("doc_id", "known", "amount").toArrow()
    hits = got["hits"].to_numpy()
    toxic = got["label"].to_numpy() > 0
    thirds = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + np.searchsorted(thirds, hits, side="left"), 0)
    packed = got["known"].to_pylist()
    rows = np.repeat(np.arange(len(packed), dtype=np.int32), [len(k) // 4 for k in packed])
    columns = np.frombuffer(b"".join(packed), np.int32)
    values = np.frombuffer(b"".join(got["amount"].to_pylist()), np.float32)
    params, thresholds = _minimise(rows, columns, values, grades, len(index))
    weights = {f: float(params[i]) for f, i in index.items() if abs(params[i]) > 1e-6}
    return Severity(weights, thresholds)


def with_severity(docs: DataFrame, model: Severity, threshold: float = 0.5, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``severity`` (expected grade, 0 to 3), ``toxic_probability`` and ``is_toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def run(texts):
            above = [fitted.exceed(t) for t in texts]
            return [sum(a) for a in above], [a[0] for a in above], [a[0] >= threshold for a in above]

        return run

    fields = [("severity", "double"), ("toxic_probability", "double"), ("is_toxic", "boolean")]
    return per_row(docs, ["text"], fields, make, drop)


def drop_toxic(docs: DataFrame, model: Severity, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` below the threshold, in their own columns."""
    names = [f"_in_{i}" for i, _ in enumerate(docs.columns)]
    renamed = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    scored = with_severity(renamed, model, threshold, ("text",))
    return scored.where("not is_toxic").select(*names).toDF(*docs.columns)
