"""Quality scores from statistics of whole texts by histogram gradient-boosted trees in flat arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, ship

#: Labelled documents that the trees are fitted on, about; they are dealt by hash, so reruns agree.
TRAIN_DOCS = 8000
THRESHOLD = 0.3
#: Parts of the learned documents that calibration leaves out in turn; the weight of leaves' penalty, and the share of the
#: statistics that each tree draws: the best of some by log loss over the documents left out, within the learning fold.
FOLDS, L2, DRAWN = 5, 0.1, 0.4
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
SLICE_CHARS = 1_000_000

_CLASS = np.zeros(256, np.int64)
for _i, _m in enumerate(MARKS):
    _CLASS[_m] = 6 + _i
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_KINDS = 6 + len(MARKS)
FEATURES = (
    ["log_chars", "log_words", "word_chars", "longest_word", "distinct_words", "distinct_lower", "top_word", "upper_words", "marked_words",
     "plain_words", "short_words", "log_lines", "line_chars", "distinct_lines", "ended_lines", "chars_per_byte"]
    + ["other_bytes", "lower_bytes", "upper_bytes", "digits", "blanks", "feeds"] + [f"mark_{chr(m)}" for m in MARKS]
)


def _of_words(text: str) -> list[float]:
    words = text.split()
    n = len(words) or 1
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    long = upper = marked = plain = short = chars = 0
    lower = set()
    for w, k in kinds.items():
        size = len(w)
        chars += size * k
        long = max(long, size)
        lower.add(w.lower())
        if w.isalpha():
            plain += k
            if size > 1 and w.isupper():
                upper += k
        elif not w[-1].isalnum():
            marked += k
            if w.isupper():
                upper += k
        if size <= 3:
            short += k
    lines = [x for x in text.split("\n") if x]
    m = len(lines) or 1
    ended = sum(x[-1] in ".!?…\"'" for x in lines)
    return [
        np.log1p(len(text)), np.log1p(len(words)), chars / n, np.log1p(long), len(kinds) / n, len(lower) / (len(kinds) or 1),
        max(kinds.values(), default=0) / n, upper / n, marked / n, plain / n, short / n, np.log1p(len(lines)), np.log1p(len(text) / m),
        len(set(lines)) / m, ended / m,
    ]


def features(texts: list[str]) -> np.ndarray:
    """One row of statistics per whole text; an empty text has zeros where there is nothing to count."""
    out = np.zeros((len(texts), len(FEATURES)))
    head = len(FEATURES) - _KINDS
    begin = chars = 0
    for i, text in enumerate(texts):
        out[i, : head - 1] = _of_words(text)
        chars += len(text)
        if chars >= SLICE_CHARS or i + 1 == len(texts):
            data = [t.encode("utf-8", "replace") for t in texts[begin : i + 1]]
            size = np.array([len(x) for x in data])
            kind = _CLASS[np.frombuffer(b"".join(data), np.uint8)] + np.repeat(np.arange(len(data)) * _KINDS, size)
            counts = np.bincount(kind, minlength=len(data) * _KINDS).reshape(-1, _KINDS)
            out[begin : i + 1, head - 1] = [len(t) for t in texts[begin : i + 1]] / np.maximum(size, 1)
            out[begin : i + 1, head:] = counts / np.maximum(size, 1)[:, None]
            begin, chars = i + 1, 0
    return out


def _with_distance(x: np.ndarray, bulk: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Four more statistics: the largest and the fifth largest distance from the bulk, their mean logarithm, the share of
    large ones."""
    z = np.abs(x - bulk[0]) / bulk[1]
    top = np.sort(np.minimum(z, 20), 1)
    return np.hstack([x, top[:, -1:], top[:, -5:-4], np.log1p(z).mean(1, keepdims=True), (z > 2).mean(1, keepdims=True)])


@dataclass
class Forest:
    """All trees in flat arrays: node i sends a row to left[i] if its feature is <= cut[i], else to left[i] + 1; a leaf has
    left[i] = i and its value. `roots` says where each tree begins. A score is the logistic of scale * margin + shift."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    base: float
    scale: float = 1.0
    shift: float = 0.0
    bulk: tuple[np.ndarray, np.ndarray] | None = None

    def margins(self, x: np.ndarray) -> np.ndarray:
        if self.bulk:
            x = _with_distance(x, self.bulk)
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                down = x[rows, self.feature[at]] > self.cut[at]
                leaf = self.left[at] == at
                at = np.where(leaf, at, self.left[at] + down)
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(x) + self.shift, -500, 500)))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8,
    drawn: float = 1.0,
) -> Forest:
    """Boosted trees for log loss: features are binned once by quantiles, splits come from histograms of gradients. Each tree
    looks at a share `drawn` of the features, so that no single one decides everything."""
    n, d = x.shape
    rng = np.random.default_rng(8)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, d), int)
    flat = binned + np.arange(d) * bins
    feature, cut, left, value, roots = [], [], [], [], []
    margin = np.full(n, base)

    def node() -> int:
        i = len(left)
        feature.append(0), cut.append(0.0), left.append(i), value.append(0.0)
        return i

    for _ in range(rounds if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        unseen = np.ones(d, bool)
        unseen[rng.permutation(d)[: max(1, round(drawn * d))]] = False
        level = [(roots[-1], np.arange(n))]
        for at in range(depth + 1):
            below = []
            for i, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                value[i] = -rate * g / (h + l2)
                best = None
                if at < depth and len(rows) >= 2 * least:
                    own = flat[rows].ravel()
                    gs = np.bincount(own, np.repeat(grad[rows], d), d * bins).reshape(d, bins).cumsum(1)
                    hs = np.bincount(own, np.repeat(hess[rows], d), d * bins).reshape(d, bins).cumsum(1)
                    ns = np.bincount(own, minlength=d * bins).reshape(d, bins).cumsum(1)
                    gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g * g / (h + l2)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    gain[unseen] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(cuts[j]):
                        best = (j, b)
                if best:
                    a, c = node(), node()
                    feature[i], cut[i], left[i], value[i] = int(best[0]), float(cuts[best[0]][best[1]]), a, 0.0
                    lower = binned[rows, best[0]] <= best[1]
                    below += [(a, rows[lower]), (c, rows[~lower])]
                else:
                    margin[rows] += value[i]
            level = below
    return Forest(np.array(roots, int), np.array(feature, int), np.array(cut), np.array(left, int), np.array(value), depth + 1, base)


def calibration(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(scale, shift) of the logistic that fits labels to margins, by Newton's method. A normal prior of unit width around
    (1, 0) keeps both finite where the margins part the labels wholly."""
    at = prior = np.array([1.0, 0.0])
    design = np.stack([margin, np.ones(len(margin))], 1)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ((w - prior) ** 2).sum() / 2)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        slope = design.T @ (p - y) + at - prior
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def unusual(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, spread) of each statistic over the good documents."""
    if not len(good):
        return np.zeros(x.shape[1]), np.ones(x.shape[1])
    middle = np.median(good, 0)
    return middle, np.maximum(np.quantile(np.abs(good - middle), 0.9, axis=0), 1e-3)


def fit_calibrated(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees whose scores are probabilities also where one label is rare.

    They also see how far a document is from the bulk of good ones, as junk of a kind that no label shows is at least
    unusual. The margins of documents that each of FOLDS forests hasn't seen, held against their labels, give scale and
    shift. Folds hold equal shares of either label."""

    def of(rows: np.ndarray) -> Forest:
        bulk = unusual(x, x[rows][y[rows] > 0])
        forest = fit(_with_distance(x[rows], bulk), y[rows], l2=L2, drawn=DRAWN)
        forest.bulk = bulk
        return forest

    forest = of(np.ones(len(y), bool))
    if min(y.sum(), len(y) - y.sum()) < FOLDS:
        return forest
    fold = np.zeros(len(y), int)
    for label in (0, 1):
        fold[y == label] = np.arange(int((y == label).sum())) % FOLDS
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[fold == k] = of(fold != k).margins(x[fold == k])
    scale, shift = calibration(margin, y)
    if scale > 0:  # else the margins say nothing of unseen documents
        forest.scale, forest.shift = scale, shift
    return forest


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hold("quality", lambda: None)
    for pdf in batches:
        x = features([t if isinstance(t, str) else "" for t in pdf["text"]])
        yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "x": list(x)})


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS) -> Forest:
    """Trees from about `most` labelled documents. Labels that contradict count by their majority, ties as 1; null labels
    and labels without a document count for nothing. Rows that repeat id and text count once; where one id has many texts,
    a share of them is drawn by hash, so that about `most` rows are learned from. With no label, or one kind only, the
    score is constant."""
    ship(docs.sparkSession)
    said = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    said = said.agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    n = said.count()

    def draw(of: Column, among: int) -> Column:
        return F.pmod(of, F.lit(1 << 30)) / float(1 << 30) < min(1.0, most / max(among, 1))

    # about `most` ids: a bounded number, so they may be broadcast
    said = F.broadcast(said.where(draw(F.xxhash64("id"), n)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(said, "id")
    rows = rows.select(F.xxhash64("id", "text").alias("k"), "y", "text")
    found = rows.select("k").distinct().count()
    rows = rows.where(draw(F.xxhash64("k", F.lit(8)), found)).dropDuplicates(["k"])
    got = rows.mapInPandas(_feature_rows, "k long, y int, x array<double>").toPandas().sort_values(["k", "y"], kind="stable")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit_calibrated(x, got["y"].to_numpy(float))


def scorer(spark, forest: Forest):
    """A column function text -> score."""
    sent = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def quality(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("quality", lambda: None)
        for texts in parts:
            yield pd.Series(sent.value.score(features([t if isinstance(t, str) else "" for t in texts])))

    return quality


def rate_quality(
    docs: DataFrame, training: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """docs with one more column quality_score in [0, 1], from trees learned on the labelled rows of `training`.

    Null texts score as empty ones. Equal texts score alike, so rows that repeat do and ties stay ties; very long ones are
    read whole. An empty table gives no rows. A column of docs with that name is replaced.
    """
    rate = scorer(docs.sparkSession, learn(training, labels, doc_id, text, label))
    return docs.withColumn("quality_score", rate(F.col(text).cast("string")))
