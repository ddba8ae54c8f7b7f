"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x), with one weight vector for all
grades and thresholds that rise by construction (the first is free, the steps
between them are exponentials). x says which hashed words a text has, and some
facts of its form, hashed alike. The expected grade is the sum of the tail
probabilities P(grade >= k); the last one decides.

The fit reads at most SAMPLE_ROWS labelled documents, those with the smallest
hash of their doc_id; words enter only if their presence goes with the grade
well beyond chance. Scoring reads every document whole.

Defined results: a null text counts as empty; a null doc_id is a row like any
other; repeated rows each get a row; labels without a grade, without a
document, or repeated with the same grade change nothing; without labels every
text gets the prior grade; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
HASH_BITS = 22
#: A word enters the fit if so many sample texts have it and its count among low grades is so many standard errors off.
#: On held-out labels the fit is better with the screen than with every word (README).
MIN_DOCS = 5
MIN_Z = 5.0
REMEMBERED_BYTES = 48 << 20
STRIP = b".,;:!?\"'()[]{}"


class Hasher:
    def __init__(self):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.memo: dict[bytes, int] = {}
        self.held = 0

    def of(self, word: bytes) -> int:
        h = self.memo.get(word)
        if h is None:
            if self.held >= REMEMBERED_BYTES:
                self.memo.clear()
                self.held = 0
            h = self.digest(word.strip(STRIP) or word) & ((1 << HASH_BITS) - 1)
            if len(word) <= 256:
                self.memo[word] = h
                self.held += len(word) + 170
        return h

    def features(self, text: str | None) -> np.ndarray:
        """Distinct hashed words and facts of form, sorted."""
        words = (text or "").encode().lower().split()
        n = len(words)
        seen = set(words)
        signs = sum(w in (b"|", b"*", b"-", b"#", b"&", b"$") or w.strip(STRIP) == b"" for w in words)
        facts = [b"\0words %d" % min(n.bit_length(), 8), b"\0signs %d" % (20 * signs // max(n, 1)), b"\0variety %d" % (10 * len(seen) // max(n, 1))]
        run = sum(a == b for a, b in zip(words, words[1:]))
        facts.append(b"\0runs %d" % min(10 * run // max(n, 1), 5))
        of = self.of
        return np.unique(np.fromiter((of(w) for w in [*seen, *facts]), np.uint32))


_hasher: list[Hasher] = []


def hasher() -> Hasher:
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


@dataclass
class OrdinalModel:
    columns: np.ndarray  # hashes, sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, features: np.ndarray) -> float:
        if not len(self.columns):
            return 0.0
        at = np.minimum(np.searchsorted(self.columns, features), len(self.columns) - 1)
        return float(self.weights[at[self.columns[at] == features]].sum())

    def tails(self, z) -> np.ndarray:
        """P(grade >= k) for k = 1.., by row of z."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - np.asarray(z, float)[:, None]))


def _thresholds(p: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[p[:1], np.exp(p[1:])])


def fit_cumulative_link(owner: np.ndarray, column: np.ndarray, width: int, y: np.ndarray, grades: int, l2: float = 1e-3, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge on the weights, by Adam on the full sample.

    Row owner[i] has feature column[i], one of width; a row has few of them.
    """
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / max(len(y), 1), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + np.arange(grades - 1) * 1e-3)
    p = np.r_[start[:1], np.log(np.maximum(np.diff(start), 1e-3))]
    theta = np.r_[p, np.zeros(width)]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = grades - 1
    for step in range(1, rounds + 1 if len(y) else 1):
        cut, w = _thresholds(theta[:k]), theta[k:]
        z = np.bincount(owner, weights=w[column], minlength=len(y))
        edge = 1 / (1 + np.exp(np.clip(z[:, None] - cut[None, :], -30, 30)))  # P(y <= j)
        full = np.c_[np.zeros(len(y)), edge, np.ones(len(y))]
        p_y = np.maximum(full[np.arange(len(y)), y + 1] - full[np.arange(len(y)), y], 1e-9)
        slope = np.c_[np.zeros(len(y)), edge * (1 - edge), np.zeros(len(y))]
        up, low = slope[np.arange(len(y)), y + 1] / p_y, slope[np.arange(len(y)), y] / p_y
        g_cut = np.array([(up * (y == j)).sum() - (low * (y == j + 1)).sum() for j in range(k)]) / len(y)
        g_w = np.bincount(column, weights=(low - up)[owner], minlength=width) / len(y) - 2 * l2 * w
        rest = np.cumsum(g_cut[::-1])[::-1]
        g = np.r_[rest[:1], rest[1:] * np.exp(theta[1:k]), g_w]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[k:], _thresholds(theta[:k])


def fit(rows: list[tuple[int, np.ndarray]], grades: int) -> OrdinalModel:
    """(grade, features) of the sample -> model."""
    y = np.array([g for g, _ in rows], np.int64)
    n = len(y)
    if not n:
        return OrdinalModel(np.empty(0, np.uint32), np.empty(0), np.arange(grades - 1, dtype=float))
    flat = np.concatenate([f for _, f in rows])
    owner = np.repeat(np.arange(n), [len(f) for _, f in rows])
    columns, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    z = np.zeros(len(columns))
    for k in range(grades - 1):
        low = (y <= k).astype(float)
        share = low.mean()
        hits = np.bincount(at, weights=low[owner], minlength=len(columns))
        spread = np.sqrt(np.maximum(df * share * (1 - share) * (1 - df / n) + 0.5, 0.5))
        z = np.maximum(z, np.abs(hits - df * share) / spread)
    good = np.flatnonzero((df >= MIN_DOCS) & (z >= MIN_Z))
    place = np.full(len(columns), -1)
    place[good] = np.arange(len(good))
    use = place[at] >= 0
    weights, thresholds = fit_cumulative_link(owner[use], place[at[use]], len(good), y, grades)
    return OrdinalModel(columns[good], weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, grades: int = 3, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """docs(doc_id, text), labels(doc_id, grade) -> model. At most sample_rows documents reach the driver."""
    few = (
        labels.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = hasher()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "f": [h.features(t).tobytes() for t in pdf["text"]]})

    # few has sample_rows rows at most: a broadcast of bounded size.
    joined = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # One job over all partitions at once; toLocalIterator would run them one after another.
    sample = joined.mapInPandas(run, "doc_id long, grade int, f binary").collect()
    # Of the texts of one doc_id the one whose features come last in order counts, whatever order rows arrive in.
    rows = sorted({i: (g, f) for i, g, f in sorted((r["doc_id"], r["grade"], bytes(r["f"])) for r in sample)}.items())
    return fit([(g, np.frombuffer(f, np.uint32)) for _, (g, f) in rows], grades)


def graded(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> doc_id, expected_grade, p_ge_1.., kept: the last tail probability reaches threshold."""
    spark = docs.sparkSession
    k = len(model.thresholds)
    sent = spark.sparkContext.broadcast(model)  # a weight for some of the 2 ** HASH_BITS hashes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, m = hasher(), sent.value
        for pdf in batches:
            tails = m.tails([m.score(h.features(t)) for t in pdf["text"]])
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "expected_grade": tails.sum(1)})
            for i in range(k):
                out[f"p_ge_{i + 1}"] = tails[:, i]
            out["kept"] = tails[:, -1] >= threshold
            yield out

    schema = "doc_id long, expected_grade double, " + ", ".join(f"p_ge_{i + 1} double" for i in range(k)) + ", kept boolean"
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInPandas(run, schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> doc_id, grade: 0 toxic, 1 neither toxic nor good, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("grade"))
