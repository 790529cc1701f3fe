"""Quality classifier: regularised quadratic discriminant over statistics of a text.

Every text becomes a vector of transformed statistics. For each class the mean and covariance of the labelled texts are
summed up over all of them; a covariance is shrunk towards the pooled one and towards its own diagonal. The score comes
from the difference of the two log densities, with Mahalanobis distances by Cholesky factors that are computed once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.operators.tables import written

FEATURES = (
    "chars", "words", "word_length", "distinct_words", "top_word", "repeats", "upper", "symbols", "stops", "bars", "digits", "bangs", "lines", "line_repeats", "packed", "wide",
)
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.1, 0.05, 1e-3
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SYMBOLS, _STOPS, _DIGITS = b"#$%&*@^~<>{}[]\\/=+_", b".,;:?", b"0123456789"


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; null counts as empty. Shares are on a log scale, so that rare signs count."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    words = data.split()
    m = len(words)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    letters = n - len(data.translate(None, _LETTERS))
    share = lambda k, of: float(np.log((k + 0.2) / (of + 10)))
    count = lambda chars: n - len(data.translate(None, chars))
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        float(np.log1p(n / (m + 1))),
        float(np.log((len(counts) + 1) / (m + 1) ** 0.9)),
        share(max(counts.values(), default=0), m),
        share(sum(map(eq, words, words[1:])), m),
        share(count(_UPPER), letters),
        share(count(_SYMBOLS), n),
        share(count(_STOPS), n),
        share(data.count(b"|"), n),
        share(count(_DIGITS), n),
        share(data.count(b"!"), n),
        float(np.log1p(n / (len(lines) + 1))),
        share(len(lines) - len(set(lines)), len(lines)),
        float(np.log((len(zlib.compress(data, 1)) + 20) / (n + 60))),
        share(n - len(text or ""), n),
    ]


def _statistics(batches):
    for b in batches:
        rows = [statistics(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row's text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_statistics, "id long, x array<double>")


def _moments(batches):
    """One row per class and task: number of rows, sum and products."""
    p = len(FEATURES)
    sums = {0: [0, np.zeros(p), np.zeros((p, p))], 1: [0, np.zeros(p), np.zeros((p, p))]}
    for b in batches:
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
        y = b.column(1).to_numpy(zero_copy_only=False)
        for label, s in sums.items():
            own = x[y == label]
            s[0] += len(own)
            s[1] += own.sum(0)
            s[2] += own.T @ own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums)), pa.array([s[0] for s in sums.values()]), pa.array([s[1].tolist() for s in sums.values()]), pa.array([s[2].ravel().tolist() for s in sums.values()])],
        names=["label", "n", "s", "ss"],
    )


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors
    offsets: list[float]  # log prior - log determinant / 2

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(labelled: DataFrame, shrink_pooled: float = SHRINK_POOLED, shrink_diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    """From all rows (x, label). Sums per task and class come to the driver. A class without rows takes the pooled moments, so that only
    the prior decides; without any rows all scores are 0.5."""
    p = len(FEATURES)
    schema = "label long, n long, s array<double>, ss array<double>"
    parts = labelled.select("x", F.col("label").cast("long").alias("label")).mapInArrow(_moments, schema)
    # summed by Spark element by element: one row per class and entry
    flat = parts.select("label", "n", F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "ss")).alias("at", "v"))
    sums = {(r["label"], r["at"]): r["v"] for r in flat.groupBy("label", "at").agg(F.sum("v").alias("v")).collect()}
    n, s, ss = [], [], []
    for label in (0, 1):
        v = np.array([sums.get((label, i), 0.0) for i in range(1 + p + p * p)])
        n.append(v[0])
        s.append(v[1 : 1 + p])
        ss.append(v[1 + p :].reshape(p, p))
    total = sum(n)
    mean_all = (s[0] + s[1]) / max(total, 1)
    within = np.zeros((p, p))
    own = []
    for k in (0, 1):
        mean = s[k] / n[k] if n[k] else mean_all
        scatter = ss[k] - n[k] * np.outer(mean, mean) if n[k] else np.zeros((p, p))
        within += scatter
        own.append((mean, scatter))
    pooled = within / max(total - 2, 1) + FLOOR * np.eye(p)
    means, factors, offsets = [], [], []
    for k, (mean, scatter) in enumerate(own):
        few = shrink_pooled + (1 - shrink_pooled) * p / (p + n[k])  # the fewer rows, the more it leans on the pooled one
        cov = (1 - few) * scatter / max(n[k] - 1, 1) + few * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov)) + FLOOR * np.eye(p)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log((n[k] + 1) / (total + 2)) - np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, offsets)


def _score(model: Discriminant):
    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["id", "score"])

    return run


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in no fold."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted.

    Rows whose fold is held are not learned from. Labels other than 0 and 1, null ids and labels without a document are
    ignored; an id that labels repeats counts with its largest label. A null text is scored as an empty one. Rows with a
    null id are scored, not held out. Other columns have no effect. An empty table gives an empty result.
    """
    rows = written(features(docs, id_col, text_col))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).alias("label"))
    model = fit(rows.where(fold(F.col("id"), folds) != held).join(known, "id"))
    scored = rows.mapInArrow(_score(model), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
