"""Quality rules: boosted trees over document statistics, flattened into arrays and scored batch by batch."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import fresh, odd, table

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_MARKS = b".,;:!?'\"()-"
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "adjacent", "distinct", "digits", "upper", "marks"]
#: Direction of the score in each feature: -1 may only fall as the feature grows.
DIRECTION = np.array([0, 0, -1, -1, -1, -1, 0, 0, 0, 0])
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_COEF = [odd(100 + i) for i in range(8)]


def _count(data: bytes, wanted: bytes) -> int:
    return len(data) - len(data.translate(None, wanted))


def statistics(text: str | None) -> tuple:
    """The five base counts and the features of one text; null and empty texts have zero everywhere."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if n == 0:
        return (0, 0, 0, 0, 0), [0.0] * len(FEATURES)
    joined = b"".join(words)
    chars = len(joined) - _count(joined, bytes(range(128, 192)))
    symbols = _count(data, _SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    repeats = 0
    if n > 8:
        grams = h[: n - 7] * _COEF[0]
        for i in range(1, 8):
            grams = grams + h[i : n - 7 + i] * _COEF[i]
        ordered = np.sort(grams)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams)
            step = np.zeros(n + 1, np.int64)
            step[at] += 1
            step[at + 8] -= 1
            repeats = int((np.cumsum(step)[:n] > 0).sum())
    adjacent = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    distinct = len(set(words)) / n
    size = len(joined)
    return (n, chars, symbols, dup, repeats), [
        float(n), chars / n, symbols / n, dup / len(lines), repeats / n, adjacent, distinct,
        _count(joined, _DIGITS) / size, _count(joined, _UPPER) / size, _count(joined, _MARKS) / size,
    ]


class Trees:
    """Binary boosted trees of one depth. Node arrays are in heap order: children of ``i`` are ``2i+1`` and ``2i+2``."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature, self.cut, self.leaf = [], [], []

    def flatten(self) -> "Trees":
        self.feature, self.cut, self.leaf = np.array(self.feature), np.array(self.cut), np.array(self.leaf)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, direction: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 64,
    rate: float = 0.2, ridge: float = 1.0, least: float = 1.0,
) -> Trees | None:
    """Gradient-boosted trees for ``P(y = 1)``; None unless both classes occur.

    ``direction`` is -1, 0 or 1 per feature. A split against its feature's direction is refused, and the middle of
    an accepted split bounds everything below it, so the whole score is monotonic.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    share = y.mean()
    model = Trees(depth, float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, inner = np.full(len(y), model.base), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for i in range(inner):
            low[2 * i + 1 : 2 * i + 3], high[2 * i + 1 : 2 * i + 3] = low[i], high[i]
            at = np.flatnonzero(node == i)
            best = (1e-9, None)
            total_g, total_h = grad[at].sum(), hess[at].sum()
            for f, own in enumerate(cuts) if len(at) else ():
                g = np.cumsum(np.bincount(code[at, f], grad[at], len(own) + 1))[:-1]
                h = np.cumsum(np.bincount(code[at, f], hess[at], len(own) + 1))[:-1]
                left, right = g / (h + ridge), (total_g - g) / (total_h - h + ridge)
                gain = g * left + (total_g - g) * right - total_g**2 / (total_h + ridge)
                gain[(h < least) | (total_h - h < least) | (direction[f] * (right - left) < 0)] = -1
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (gain[k], f, k, left[k], right[k])
            if best[1] is not None:
                _, f, k, left, right = best
                feature[i], cut[i] = f, cuts[f][k]
                if direction[f]:
                    middle = np.clip((left + right) / 2, low[i], high[i])
                    falls = direction[f] < 0
                    (low if falls else high)[2 * i + 1] = middle
                    (high if falls else low)[2 * i + 2] = middle
            node[at] = 2 * i + 1 + (x[at, feature[i]] > cut[i])
        slot = node - inner
        g, h = np.bincount(slot, grad, inner + 1), np.bincount(slot, hess, inner + 1)
        leaf = rate * np.clip(g / (h + ridge), low[inner:], high[inner:])
        margin += leaf[slot]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model.flatten()


def train_quality(docs: DataFrame, labels: DataFrame, most: int = 12_000, **options) -> Trees | None:
    """Fit on at most ``most`` labelled documents, the ones with the smallest hash of ``doc_id``; None without two classes.

    Rows with a null ``doc_id`` or label are left out; a document labelled twice counts once, with its larger label.
    """
    known = (
        labels.select("doc_id", F.col("quality").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def features(batches):
        for pdf in batches:
            rows = [statistics(t)[1] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"].astype(float), "x": rows})

    # The sample is bounded by ``most``, so its ids may be sent to every task.
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = sample.mapInPandas(features, "doc_id long, y double, x array<double>").toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    return fit_trees(np.array(rows["x"].tolist(), dtype=float), (rows["y"].to_numpy() > 0).astype(float), DIRECTION, **options)


def with_quality(docs: DataFrame, model: Trees | None, keep_at: float = 0.35, column: str = "__quality") -> DataFrame:
    """``docs`` with a struct column: the five counts, ``base_failed``, ``score`` and ``kept``.

    ``kept`` is false where the base rule fails (under 20 words, or over 30 % of the words in repeated 8-word windows)
    or the score is below ``keep_at``. Without a model only the base rule judges (score 1). Null and empty texts fail.
    No shuffle: each batch is judged where it is read.
    """

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    def judge(text: pd.Series) -> pd.DataFrame:
        both = [statistics(t) for t in text]
        out = pd.DataFrame([b[0] for b in both], columns=STATS, dtype="int64")
        out["base_failed"] = (out.n_words < 20) | (100 * out.n_repeat_words > 30 * out.n_words)
        x = np.array([b[1] for b in both], dtype=float).reshape(-1, len(FEATURES))
        out["score"] = np.ones(len(x)) if model is None else model.score(x)
        out["kept"] = ~out.base_failed & (out.score >= keep_at)
        return out

    return docs.withColumn(column, judge(docs["text"]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with all their columns."""
    own = fresh(docs, "quality")
    return with_quality(docs, train_quality(docs, labels), column=own).filter(F.col(own)["kept"]).drop(own)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return with_quality(docs.select("doc_id", "text"), model).select("doc_id", "__quality.*")
