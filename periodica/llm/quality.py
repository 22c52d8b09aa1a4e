"""Quality of whole texts by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Every passage is encoded by what its characters and words look like:
shares of character classes, of pairs of neighbouring classes, repeated and distinct words, word lengths.
A small network maps passages to hidden vectors, learns from document labels alone how much attention each
deserves (a tanh branch gated by a sigmoid branch, softmax over the bag), and scores the weighted mean.

Only the fit is bounded: ``SAMPLE`` labelled documents, chosen by a hash of their id, never one of the held-out fold.
The score is read from the text alone. One pass, no shuffle.

Defined results: a null, empty or blank text is a bag of one blank passage and gets its score; without labels of both kinds the
score is the share of label 1 (0.5 without labels); repeated labels of one id count as the larger, null labels are left out; other
columns pass through, and one called like an output is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import per_row
from periodica.llm.toxicity import labelled_sample

PASSAGE = 48
SAMPLE = 4_000
HIDDEN, GATE = 24, 16
PAIRS = 64
SHAPES = 12


def _classes() -> np.ndarray:
    """Class of each code point below 0x250: 0 space, 1 lower, 2 upper, 3 digit, 4 stops, 5 others, then each other ASCII mark."""
    kind = np.full(0x250, 5, np.int64)
    marks = 6
    for code in range(0x250):
        c = chr(code)
        if c.isspace() or code < 32:
            kind[code] = 0
        elif c.isdigit():
            kind[code] = 3
        elif c.isupper():
            kind[code] = 2
        elif c.isalpha():
            kind[code] = 1
        elif c in ".,;:'\"-()?":
            kind[code] = 4
        elif code < 128:
            kind[code] = marks
            marks += 1
    return kind


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
WIDTH = KINDS + PAIRS + SHAPES
_PAIR_BUCKET = np.random.default_rng(3).integers(0, PAIRS, KINDS * KINDS)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def passages(text: str | None) -> np.ndarray:
    """One row of ``WIDTH`` features for each passage, at least one row."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.where(codes < len(CLASS), CLASS[np.minimum(codes, len(CLASS) - 1)], 1)
    letters = kinds > 0
    starts = np.flatnonzero(letters & ~np.concatenate(([False], letters[:-1])))
    n_words = len(starts)
    if not n_words:
        return np.zeros((1, WIDTH), np.float32)
    ends = np.flatnonzero(letters & ~np.concatenate((letters[1:], [False]))) + 1
    n = -(-n_words // PASSAGE)
    first = starts[::PASSAGE]
    part = np.zeros(len(codes), np.int64)
    part[first[1:]] = 1
    part = np.cumsum(part)
    shares = np.bincount(part * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    chars = shares.sum(axis=1, keepdims=True)
    pair = _PAIR_BUCKET[kinds[:-1] * KINDS + kinds[1:]]
    pairs = np.bincount(part[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS) / chars
    # Words as sums of mixed letters and places: equal words have equal numbers.
    with np.errstate(over="ignore"):
        place = (np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes)))) if starts[0] == 0 else
                 np.arange(len(codes)) - np.concatenate((np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(codes)))))))
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _SPREAD
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * letters.astype(np.uint64), dtype=np.uint64)))
        words = sums[ends] - sums[starts]
    owner = np.arange(n_words) // PASSAGE
    per = np.bincount(owner, minlength=n).astype(float)
    lengths = (ends - starts).astype(float)
    again = np.concatenate(([False], words[1:] == words[:-1]))
    order = np.lexsort((words, owner))
    fresh = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
    runs = np.diff(np.append(np.flatnonzero(fresh), n_words))
    most = np.zeros(n)
    np.maximum.at(most, owner[order][fresh], runs)
    last = kinds[ends - 1]
    begins = kinds[starts]

    def mean(x):
        return np.bincount(owner, x, n) / per

    shape = np.stack(
        [
            np.log1p(per) / 4, mean(again), np.bincount(owner[order], fresh, n) / per, most / per, mean(lengths) / 8,
            np.sqrt(np.maximum(0, mean(lengths**2) - mean(lengths) ** 2)) / 8, mean(last > 4), mean(last == 4), mean(begins == 2),
            mean(lengths == 1), mean(lengths > 14), np.full(n, min(n, 64) / 64),
        ],
        axis=1,
    )
    return np.concatenate((shares / chars, pairs, shape), axis=1).astype(np.float32)


class BagModel:
    """Gated-attention pooling over passages; parameters are plain arrays."""

    def __init__(self, mean, scale, rng):
        self.mean, self.scale = mean, scale
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {
            "W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE),
            "a": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        """``x``: the passages of all bags, one after the other; ``starts``: where each bag begins."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -35, 35)))
        e = (t * g) @ p["a"]
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        w = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(w[:, None] * h, starts)
        s = z @ p["c"] + p["d"][0]
        return {"x": x, "h": h, "t": t, "g": g, "w": w, "bag": bag, "z": z, "y": 1 / (1 + np.exp(-np.clip(s, -35, 35)))}

    def backward(self, f: dict, target: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        ds = (f["y"] - target) / len(target)
        dz = ds[:, None] * p["c"]
        bag, w, h = f["bag"], f["w"], f["h"]
        dw = (dz[bag] * h).sum(axis=1)
        de = w * (dw - np.add.reduceat(w * dw, starts)[bag])
        dtg = de[:, None] * p["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = w[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - h**2)
        return {
            "W": f["x"].T @ dpre, "b": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ ds, "d": np.array([ds.sum()]),
        }

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
        return self.forward(np.concatenate(bags).astype(float), starts)["y"]


class Constant:
    """What is known without labels of both kinds."""

    def __init__(self, share: float):
        self.share = share

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.full(len(bags), self.share)


def train(bags: list[np.ndarray], target: np.ndarray, epochs: int = 25, batch: int = 64, decay: float = 1e-4) -> BagModel:
    rng = np.random.default_rng(5)
    count = sum(len(b) for b in bags)
    mean = sum(b.sum(0, dtype=float) for b in bags) / count
    spread = np.sqrt(np.maximum(0, sum((b.astype(float) ** 2).sum(0) for b in bags) / count - mean**2))
    model = BagModel(mean, spread + 1e-2, rng)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, steps = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), batch):
            chosen = order[at : at + batch]
            own = [bags[i] for i in chosen]
            starts = np.concatenate(([0], np.cumsum([len(b) for b in own])[:-1]))
            f = model.forward(np.concatenate(own).astype(float), starts)
            step += 1
            rate = 3e-3 * (1 - step / (steps + 1))
            for k, g in model.backward(f, target[chosen], starts).items():
                g = g + decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE):
    """The model of ``labels.quality``, fitted on at most ``sample_rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", sample_rows, ~held_out())

    def make():
        return lambda texts: ([passages(t).tobytes() for t in texts],)

    encoded = per_row(sample, ["text"], [("bag", "binary")], make, ("text",)).sort("doc_id", "bag").toArrow()
    target = (encoded["label"].to_numpy() > 0).astype(float)
    if len(set(target)) < 2:
        return Constant(float(target.mean()) if len(target) else 0.5)
    return train([np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in encoded["bag"].to_pylist()], target)


def with_scores(docs: DataFrame, model, threshold: float = 0.3, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def run(texts):
            scores = []
            for at in range(0, len(texts), 256):
                scores += fitted.score([passages(t) for t in texts[at : at + 256]]).tolist()
            return scores, [int(s >= threshold) for s in scores]

        return run

    return per_row(docs, ["text"], [("score", "double"), ("predicted", "int")], make, drop)
