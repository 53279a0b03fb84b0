"""Toxic spans and document scores: a linear-chain conditional random field over words."""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import WORD, table

_WORD = re.compile(WORD)
_BUCKETS = 1 << 19
_WIDTH = 11
_CACHED = 400_000
_EDGES = ".,;:!?\"'()[]{}<>*_-"
#: Marginals below this are noise and do not add up over a long document.
_FLOOR = 0.05


def features(word: str) -> list[int]:
    """Hashed features of one word: the word, its beginnings of 3 to 8 letters, its endings of 3 to 4, its length."""
    w = word.lower().strip(_EDGES)
    parts = [f"w{w}", f"l{min(len(w), 12)}"]
    parts += [f"p{w[:k]}" for k in range(3, 9) if len(w) >= k] + [f"s{w[-k:]}" for k in (3, 4) if len(w) > k]
    ids = [zlib.crc32(p.encode("utf-8", "surrogatepass")) % (_BUCKETS - 1) for p in parts]
    return ids + [_BUCKETS - 1] * (_WIDTH - len(ids))  # the last bucket stays zero


class Chain:
    """Two states, clean and toxic. ``weights`` score a toxic word by its features; ``step[i, j]`` scores state j after i."""

    def __init__(self):
        self.weights = np.zeros(_BUCKETS)
        self.bias, self.step, self.start = -4.0, np.array([[1.0, -1.0], [0.0, 0.0]]), np.array([0.0, 0.0])

    def matrices(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Transition times emission of each word, ``(4, words)`` as ``00, 01, 10, 11``; the first word of a text forgets."""
        e = np.exp(np.clip(emit + self.bias, -30, 30))
        t, s = np.exp(self.step), np.exp(self.start)
        m = np.empty((4, len(emit)))
        m[0], m[2] = t[0, 0], t[1, 0]
        m[1], m[3] = t[0, 1] * e, t[1, 1] * e
        m[0, first] = m[2, first] = s[0]
        m[1, first] = m[3, first] = s[1] * e[first]
        return m

    def passes(self, emit: np.ndarray, first: np.ndarray):
        """Normalised forward and backward messages of all texts laid end to end.

        The words are cut into about sqrt(n) blocks that advance side by side: a first pass multiplies each block's
        matrices, a short loop chains the blocks, a second pass fills in the messages.
        """
        n = len(emit)
        size = max(1, int(np.sqrt(n)))
        blocks = -(-n // size)
        m = np.zeros((4, blocks * size))
        m[0] = m[3] = 1.0
        m[:, :n] = self.matrices(emit, first)
        m = np.ascontiguousarray(m.reshape(4, blocks, size).transpose(2, 0, 1))
        ahead = self._run(m, blocks, size)
        # Backward: the same on transposed matrices, in reverse order; a text's end forgets since rows of a first word agree.
        flipped = np.ascontiguousarray(m[::-1, [0, 2, 1, 3], ::-1])
        back = self._run(flipped, blocks, size, shift=True)[::-1, :, ::-1]
        order = lambda x: x.transpose(1, 2, 0).reshape(2, -1)[:, :n]
        return order(ahead), order(back)

    @staticmethod
    def _run(m: np.ndarray, blocks: int, size: int, shift: bool = False) -> np.ndarray:
        a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
        for x in m:
            a, b, c, d = a * x[0] + b * x[2], a * x[1] + b * x[3], c * x[0] + d * x[2], c * x[1] + d * x[3]
            z = 1.0 / (a + b + c + d)
            a, b, c, d = a * z, b * z, c * z, d * z
        u, v = 0.5, 0.5
        left = np.empty((2, blocks))
        for k in range(blocks):
            left[0, k], left[1, k] = u, v
            u, v = u * a[k] + v * c[k], u * b[k] + v * d[k]
            u, v = u / (u + v), v / (u + v)
        out = np.empty((size, 2, blocks))
        u, v = left
        for i, x in enumerate(m):
            if shift:
                out[i] = u, v
            u, v = u * x[0] + v * x[2], u * x[1] + v * x[3]
            z = 1.0 / (u + v)
            u, v = u * z, v * z
            if not shift:
                out[i] = u, v
        return out

    def marginals(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each word is toxic; ``first`` marks the first word of each text."""
        if not len(emit):
            return np.zeros(0)
        ahead, back = self.passes(emit, first)
        p = ahead * back
        return p[1] / (p[0] + p[1])


def label_words(rows: np.ndarray, before: np.ndarray, doc: np.ndarray, toxic: np.ndarray, least: float = 16.0, spread: int = 8) -> np.ndarray:
    """Word labels from document labels: 1 for words of toxic documents with a feature that marks toxic documents.

    ``rows`` has the features of each word in its place, ``before`` the word before it, ``doc`` its document. A feature is a
    mark if its documents are toxic more often than chance allows (``least`` nats of evidence against the share of toxic documents) and
    nearly always, and if it follows different words: what is only copied from text to text has few neighbours.
    """

    def counts(key: np.ndarray, which: np.ndarray) -> np.ndarray:
        out = np.zeros(_BUCKETS, np.int64)
        for column in rows.T:  # one kind of feature at a time, to keep the arrays small
            out += np.bincount(np.unique(key[which] * _BUCKETS + column[which]) % _BUCKETS, minlength=_BUCKETS)
        return out

    bad = toxic[doc] > 0
    in_bad, in_good, neighbours = counts(doc, bad), counts(doc, ~bad), counts(before, bad)
    share = toxic.mean()
    part = in_bad / np.maximum(1, in_bad + in_good)
    with np.errstate(divide="ignore", invalid="ignore"):
        rest = np.where(part < 1, (1 - part) * np.log((1 - part) / (1 - share)), 0)
        evidence = (in_bad + in_good) * (np.where(part > 0, part * np.log(part / share), 0) + rest)
    # In how many toxic documents for each other one, as if both were equally many.
    often = in_bad / share >= 25 * (in_good + 0.2) / (1 - share)
    marks = (evidence >= least) & often & (neighbours >= np.clip(0.3 * in_bad, 4, spread))
    marks[-1] = False
    return (marks[rows].any(axis=1) & bad).astype(np.int64)


def fit_chain(texts: list[str], toxic: np.ndarray, rounds: int = 60, rate: float = 0.5, ridge: float = 2e-6) -> Chain | None:
    """Fit by adaptive gradient steps on the likelihood of the word labels; None unless both classes occur."""
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    index: dict[str, int] = {}
    words, first = [], []
    for t in texts:
        found = _WORD.findall(t or "")
        first += [True] * bool(found) + [False] * (len(found) - 1)
        words.append(np.array([index.setdefault(w, len(index)) for w in found], np.int64))
    if not index:
        return None
    table_ = np.array([features(w) for w in index], np.int32)
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    words, first = np.concatenate(words), np.array(first)
    before = np.where(first, -1, np.concatenate([[-1], words[:-1]])) + 1
    y = label_words(table_[words], before, doc, toxic)
    chain = Chain()
    if not y.any():
        return chain
    later = ~first
    prior = np.concatenate([[0], y[:-1]])
    want_step = np.array([[((prior == i) & (y == j) & later).sum() for j in (0, 1)] for i in (0, 1)], float)
    want_start = np.array([((y == j) & first).sum() for j in (0, 1)], float)
    seen, seen_bias, seen_step, seen_start = np.full(_BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)
    n = len(y)
    for _ in range(rounds):
        emit = chain.weights[table_].sum(axis=1)[words]
        ahead, back = chain.passes(emit, first)
        p = ahead * back
        p = p[1] / p.sum(axis=0)
        gap = y - p
        by_word = np.bincount(words, gap, len(index))
        grad = np.bincount(table_.ravel(), np.repeat(by_word, _WIDTH), _BUCKETS) / n - ridge * chain.weights
        grad[-1] = 0
        m = chain.matrices(emit, first)
        joint = np.stack([ahead[i, :-1] * m[2 * i + j, 1:] * back[j, 1:] for i in (0, 1) for j in (0, 1)])
        joint = joint / joint.sum(axis=0) * later[1:]
        step = (want_step - joint.sum(axis=1).reshape(2, 2)) / n
        start = (want_start - np.array([(1 - p)[first].sum(), p[first].sum()])) / n
        seen += grad**2
        seen_bias += gap.mean() ** 2
        seen_step += step**2
        seen_start += start**2
        chain.weights += rate * grad / np.sqrt(seen)
        chain.bias += rate * gap.mean() / np.sqrt(seen_bias)
        chain.step += rate * step / np.sqrt(seen_step)
        chain.start += rate * start / np.sqrt(seen_start)
    return chain


def train_toxicity(docs: DataFrame, labels: DataFrame, most: int = 2400, **options) -> Chain | None:
    """Fit on at most ``most`` labelled documents, half of them toxic if there are so many, by smallest hash of ``doc_id``.

    ``labels`` must hold the training rows only. Null ids, labels and texts are left out; a document labelled twice counts as toxic if
    one label says so, and equal texts count once. None without both classes.
    """
    known = labels.select("doc_id", F.col("toxic").alias("y")).dropna().groupBy("doc_id").agg(F.max(F.col("y") > 0).cast("int").alias("y"))
    half = [known.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for v in (0, 1)]
    # At most ``most`` ids, so they may be sent to every task.
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(half[0].unionAll(half[1])), "doc_id").select("doc_id", "text", "y").toPandas()
    rows = rows.sort_values("doc_id", kind="stable").drop_duplicates("text")
    return fit_chain(rows["text"].tolist(), rows["y"].to_numpy(np.int64), **options) if len(rows) else None


def with_toxicity(docs: DataFrame, chain: Chain | None, span_at: float = 0.5) -> DataFrame:
    """``doc_id, score, spans`` for every row: no shuffle, texts are scored where they are read.

    ``score`` is the chance that a word is toxic: the noisy-or of the marginals above a small floor, or the largest
    marginal; 0 for null and empty texts and without a model. ``spans`` are the words with a marginal of ``span_at`` or more, as ``start:end`` in code points, comma-joined.
    """

    def score(batches):
        known: dict[str, float] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 400):
                yield part(pdf.iloc[at : at + 400], known)

    def part(pdf: pd.DataFrame, known: dict) -> pd.DataFrame:
        texts = [t or "" for t in pdf["text"]]
        # Bytes split at ASCII white space only, as words are defined.
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        if len(known) > _CACHED:
            known.clear()
        new = list(set().union(*words).difference(known))
        if new and chain is not None:
            rows = np.array([features(w.decode("utf-8", "surrogatepass")) for w in new], np.int32)
            known.update(zip(new, chain.weights[rows].sum(axis=1).tolist()))
        out = pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": 0.0, "spans": ""})
        sizes = np.array([len(w) for w in words])
        total = int(sizes.sum())
        if chain is None or not total:
            return out
        look = known.__getitem__
        emit = np.fromiter((x for w in words for x in map(look, w)), float, total)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        first = np.zeros(total, bool)
        first[starts[sizes > 0]] = True
        p = chain.marginals(emit, first)
        clean = np.concatenate([[0.0], np.cumsum(np.log1p(-np.where(p >= _FLOOR, np.minimum(p, 1 - 1e-9), 0)))])
        any_ = np.clip(1 - np.exp(clean[ends] - clean[starts]), 0, 1)
        most = np.zeros(len(texts))
        most[sizes > 0] = np.maximum.reduceat(p, starts[sizes > 0])
        out["score"] = np.maximum(any_, most)
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(p >= span_at), side="right")).tolist():
            hit = set(np.flatnonzero(p[starts[k] : ends[k]] >= span_at).tolist())
            out.iat[k, 2] = ",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(_WORD.finditer(texts[k])) if i in hit)
        return out

    return docs.select("doc_id", "text").mapInPandas(score, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, spans string")


def _held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~_held_out("doc_id"))
    scored = with_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
