"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document.
Expectation-maximisation over the vote patterns of all documents estimates each
labeller's accuracy; the posterior of a document's pattern is its soft label. A
linear scorer on hashed features learns those labels from a bounded sample and
scores every document.

Defined cases: a null or empty text is bad with score 0; a document on which all
labellers abstain gets the prior; a text of any length is read whole; rows without
an id are sampled like others; ties of the sample go by id; repeated rows are each
scored; an empty table gives no rows; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, bounded_rows, table

_SYMBOL = re.compile(r"[#$%&*|!<>{}\[\]=~^\\]")
_SYMBOLS = re.compile(r"[#$%&*|!<>{}\[\]=~^\\]+")
GOOD, BAD, ABSTAIN = 1, -1, 0
BUCKETS = 1 << 12


def votes(text: str | None) -> tuple[int, ...]:
    """The labellers' votes on a whole text."""
    words = (text or "").split()
    n = len(words)
    if n == 0:
        return (BAD,) * len(LABELLERS)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text)) / chars
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    counts = Counter(words)
    top, distinct = counts.most_common(1)[0][1] / n, len(counts) / n
    mean = chars / n
    runs = sum(a == b for a, b in zip(words, words[1:])) / n
    closed = sum(x.rstrip()[-1:] in ".!?:;\"'" for x in lines) / len(lines)
    repeated = 1 - len(set(lines)) / len(lines)
    marked = len(_SYMBOLS.findall(text)) / n
    return (
        BAD if symbols > 0.04 else GOOD if symbols < 0.005 else ABSTAIN,
        BAD if upper > 0.3 else GOOD if upper < 0.05 else ABSTAIN,
        BAD if runs > 0.2 else GOOD if runs < 0.05 else ABSTAIN,
        ABSTAIN if n < 20 else BAD if top > 0.3 or distinct < 0.2 and n < 3000 or distinct < 0.05 else GOOD,
        BAD if mean > 8.5 or mean < 2.5 else GOOD if 4 <= mean <= 7 else ABSTAIN,
        ABSTAIN if len(lines) < 3 else BAD if repeated > 0.3 else GOOD if repeated < 0.1 else ABSTAIN,
        BAD if closed < 0.3 else GOOD if closed > 0.7 else ABSTAIN,
        BAD if marked > 0.2 else GOOD if marked < 0.02 else ABSTAIN,
    )


LABELLERS = ("symbols", "upper_case", "word_runs", "variety", "word_length", "repeated_lines", "closed_lines", "marked_words")


class LabelModel:
    """``accuracy[labeller, class, vote + 1]`` and the prior of good."""

    def __init__(self, accuracy: np.ndarray, prior: float):
        self.accuracy, self.prior = accuracy, prior

    def posterior(self, pattern) -> float:
        good, bad = np.log(self.prior), np.log1p(-self.prior)
        for k, v in enumerate(pattern):
            if v != ABSTAIN:
                bad += np.log(self.accuracy[k, 0, v + 1])
                good += np.log(self.accuracy[k, 1, v + 1])
        return float(1.0 / (1.0 + np.exp(np.clip(bad - good, -500, 500))))


def fit_labels(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.01) -> LabelModel:
    """EM from how often each pattern of votes occurs.

    It starts from labellers that are better than chance and seldom vote bad on a
    good document. That start also counts as ``prior`` of the documents in every
    round, so that votes which never occur keep a probability; the rest is estimated.
    """
    k = len(LABELLERS)
    if not patterns:
        return LabelModel(np.full((k, 2, 3), 1 / 3), 0.5)
    pats = np.array(list(patterns), dtype=int)
    n = np.array(list(patterns.values()), dtype=float)
    start = np.tile([[0.4, 0.3, 0.3], [0.02, 0.18, 0.8]], (k, 1, 1))
    model = LabelModel(start, 0.7)
    for _ in range(rounds):
        p = np.array([model.posterior(x) for x in pats])
        acc = max(1.0, prior * n.sum()) * start
        for v in (-1, 0, 1):
            m = pats == v
            acc[:, 1, v + 1] += (m * (n * p)[:, None]).sum(0)
            acc[:, 0, v + 1] += (m * (n * (1 - p))[:, None]).sum(0)
        model = LabelModel(acc / acc.sum(2, keepdims=True), float(np.clip(n @ p / n.sum(), 0.02, 0.98)))
    return model


def features(text: str | None) -> np.ndarray:
    """Hashed shares of a whole text's trigrams of letter classes, and a few shares of its words and lines."""
    words, lines = (text or "").split(), (text or "").split("\n")
    n = max(1, len(words))
    c = np.frombuffer(f"  {text or ''} ".encode().translate(_CLASSES), dtype=np.uint8).astype(np.int64)
    grams = ((c[:-2] * 31 + c[1:-1]) * 31 + c[2:]) % BUCKETS
    shares = np.bincount(grams, minlength=BUCKETS) / len(grams)
    runs = sum(a == b for a, b in zip(words, words[1:])) / n
    return np.concatenate([shares * 10, (1.0, len(set(words)) / n, runs, 1 - len(set(lines)) / len(lines), min(1.0, n / 500))])


#: Byte -> class: vowels, other letters by half, capitals, digits, bytes of other scripts; punctuation stands for itself.
_CLASSES = bytes(1 if chr(i) in "aeiou" else 2 if "a" <= chr(i) <= "m" else 3 if "n" <= chr(i) <= "z" else 4 if "A" <= chr(i) <= "Z" else 5 if "0" <= chr(i) <= "9" else 6 if i > 127 else i for i in range(256))


class Scorer:
    """Logistic regression on ``features``."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def score(self, text: str | None) -> float:
        if not (text or "").split():
            return 0.0
        return float(1.0 / (1.0 + np.exp(-np.clip(self.weights @ features(text), -50, 50))))


def fit_scorer(x: np.ndarray, soft: list[float], rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Scorer:
    """Adagrad from rows of ``features`` to the soft labels, all of the sample in each round."""
    w = np.zeros(BUCKETS + 5)
    if not len(x):
        return Scorer(w)
    y, g = np.array(soft), np.full(BUCKETS + 5, 1e-8)
    for _ in range(rounds):
        err = 1.0 / (1.0 + np.exp(-np.clip(x @ w.astype(np.float32), -50, 50))) - y
        step = err.astype(np.float32) @ x / len(y) + decay * w
        g += step * step
        w -= rate * step / np.sqrt(g)
    return Scorer(w)


def vote_patterns(docs: DataFrame, *, text_col: str = "text") -> dict[tuple[int, ...], int]:
    """Counts over all documents; at most 3 to the number of labellers patterns."""

    def run(batches):
        for b in batches:
            seen = Counter(map(votes, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["p", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "p array<int>, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return {tuple(p): n for p, n in bounded_rows(rows.orderBy("p"), 3 ** len(LABELLERS), "vote patterns")}


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_docs: int = 4000) -> tuple[LabelModel, Scorer]:
    """Label model from all documents; scorer from at most ``most_docs`` whole texts with the smallest id hashes.

    Features are taken on the executors: what reaches the driver is ``most_docs``
    rows of a fixed width, however long the texts are.
    """
    labels = fit_labels(vote_patterns(docs, text_col=text_col))
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("h"), F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    ids = rows.select("h", F.coalesce("i", F.lit("")).alias("i")).orderBy("h", "i").limit(most_docs)
    chosen = rows.withColumn("i", F.coalesce("i", F.lit(""))).join(F.broadcast(ids.distinct()), ["h", "i"], "left_semi")

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).astype("<f4").tobytes() for t in texts], pa.binary()), pa.array([list(votes(t)) for t in texts], pa.list_(pa.int32()))], ["h", "i", "x", "v"])

    found = chosen.select("h", "i", "t").mapInArrow(run, "h long, i string, x binary, v array<int>").orderBy("h", "i", "x").limit(most_docs).collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in found), "<f4").reshape(-1, BUCKETS + 5)
    return labels, fit_scorer(x, [labels.posterior(tuple(r["v"])) for r in found])


def classify(docs: DataFrame, labels: LabelModel, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each document: id, weak_label (posterior of its votes), score, keep."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((labels, scorer))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        labels, scorer = shared.value
        cache: dict[tuple[int, ...], float] = {}
        for b in batches:
            weak, score = [], []
            for t in b.column(1).to_pylist():
                v = votes(t)
                if v not in cache:
                    cache[v] = labels.posterior(v)
                weak.append(cache[v])
                score.append(scorer.score(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array([s >= threshold for s in score], pa.bool_())], ["doc_id", "weak_label", "score", "keep"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, weak_label double, score double, keep boolean")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label, score and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, *train(docs))
