"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, which a
forward pass computes; a text's is the product over its words. The piece
probabilities are fitted by expectation-maximisation on the same lattice.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language first in code-point order; repeated rows are each
predicted; an empty table gives an empty result. Words are maximal runs of
letters, lower-cased. A word of over ``MAX_WORD`` letters is scored as
consecutive parts of that length. Other columns of the input are kept as they
are unless they bear the name of a result column, which then replaces them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, bounded_rows, table

WORD = re.compile(r"[^\W\d_]+")
MAX_WORD = 64
UND = "und"
MARK = "▁"


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Pieces of the public sentencepiece model at ``path``: piece -> index."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    kept = sorted({p for p in pieces if p == MARK or WORD.fullmatch(p.removeprefix(MARK)) and p == p.lower()})
    return {p: i for i, p in enumerate(kept)}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def parts(word: str) -> list[str]:
    return [MARK + word] if len(word) < MAX_WORD else [(MARK if i == 0 else "") + word[i : i + MAX_WORD] for i in range(0, len(word), MAX_WORD)]


class Model:
    """``prob[piece, language]``; a letter that is no piece has the probability ``UNKNOWN``."""

    #: Probabilities are scaled by this for each letter so that products stay near one.
    SCALE = 16.0
    UNKNOWN = 1e-6
    #: Words times languages in memory at once, each with a probability at every position.
    CELLS = 40_000

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int], languages: list[str], prob: np.ndarray):
        self.vocab, self.languages, self.prob = vocab, languages, prob
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] | None = None

    def _by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Length -> sorted rolling hashes of its pieces, and their scaled probabilities."""
        if self._tables is None:
            self._tables = {}
            grouped: dict[int, list[tuple[str, int]]] = defaultdict(list)
            for p, i in self.vocab.items():
                grouped[len(p)].append((p, i))
            for n, items in grouped.items():
                codes = np.frombuffer("".join(p for p, _ in items).encode("utf-32-le"), dtype="<u4").reshape(-1, n)
                h = np.zeros(len(items), np.uint64)
                for k in range(n):
                    h = h * self.BASE + codes[:, k]
                order = np.argsort(h)
                ids = np.array([i for _, i in items])[order]
                self._tables[n] = h[order], self.prob[ids] * self.SCALE**n
        return self._tables

    def log_words(self, words: list[str]) -> np.ndarray:
        """log probability of each word in each language, all segmentations summed.

        One forward pass over all words at once: longest first, so that those that
        still have a position are a leading slice.
        """
        most = max(1, self.CELLS // max(1, len(self.languages)))
        if len(words) > most:
            return np.vstack([self.log_words(words[k : k + most]) for k in range(0, len(words), most)])
        items = [(k, s) for k, w in enumerate(words) for s in parts(w)]
        items.sort(key=lambda x: -len(x[1]))
        size, width, tables = len(items), len(self.languages), self._by_length()
        out = np.zeros((len(words), width))
        if not items:
            return out
        lengths = np.fromiter((len(s) for _, s in items), np.int64, size)
        longest = int(lengths[0])
        flat = np.frombuffer("".join(s.ljust(longest, "\0") for _, s in items).encode("utf-32-le"), dtype="<u4")
        codes = np.ascontiguousarray(flat.reshape(size, longest).T).astype(np.uint64)
        still = [int(np.searchsorted(-lengths, -j, side="right")) for j in range(longest + 1)]
        alpha = np.zeros((longest + 1, size, width))
        alpha[0] = 1.0
        for i in range(longest):
            h = np.zeros(still[i + 1], np.uint64)
            for j in range(i + 1, min(i + max(tables, default=1), longest) + 1):
                m = still[j]
                h = h[:m] * self.BASE + codes[j - 1, :m]
                if j - i in tables:
                    keys, probs = tables[j - i]
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    hit = np.flatnonzero(keys[at] == h)
                    if len(hit):
                        alpha[j, hit] += alpha[i, hit] * probs[at[hit]]
                if j == i + 1:
                    known = hit if 1 in tables else np.zeros(0, np.int64)
                    rest = np.ones(m, bool)
                    rest[known] = False
                    alpha[j, :m][rest] += alpha[i, :m][rest] * (self.UNKNOWN * self.SCALE)
        logs = np.log(alpha[lengths, np.arange(size)]) - (lengths * math.log(self.SCALE))[:, None]
        np.add.at(out, np.fromiter((k for k, _ in items), np.int64, size), logs)
        return out


class Lattice:
    """All segmentations of words into pieces, as edges between positions."""

    def __init__(self, words: list[str], vocab: dict[str, int]):
        longest, edges = max(map(len, vocab), default=1), []
        for k, w in enumerate(words):
            edges += [(k, i, j, vocab.get(w[i:j], -1)) for j in range(1, len(w) + 1) for i in range(max(0, j - longest), j) if i == j - 1 or w[i:j] in vocab]
        self.word, self.start, self.stop, self.piece = np.array(edges, np.int32).reshape(-1, 4).T
        self.ends = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(self.ends.max(initial=0)) + 1
        self.into, self.out_of = list(self._steps(self.stop)), list(self._steps(self.start))[::-1]

    def _steps(self, key: np.ndarray):
        """Edges by the position ``key`` that they lead to, those of a word together."""
        order = np.lexsort((self.word, key))
        stops = np.searchsorted(key[order], np.arange(self.width + 1))
        for at, (lo, hi) in enumerate(zip(stops, stops[1:])):
            if hi > lo:
                e = order[lo:hi]
                first = np.flatnonzero(np.concatenate([[True], self.word[e][1:] != self.word[e][:-1]]))
                yield at, e, self.word[e][first], first

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, given how often each language has each word."""
        pieces, languages = prob.shape
        # probabilities are scaled by letter so that products stay near one; the scale cancels out
        p = np.vstack([prob, np.full((1, languages), Model.UNKNOWN)])[self.piece] * Model.SCALE ** (self.stop - self.start)[:, None]
        ahead, back = (np.zeros((self.width, len(self.ends), languages)) for _ in range(2))
        ahead[0], back[self.ends, np.arange(len(self.ends))] = 1.0, 1.0
        for j, e, words, first in self.into:
            ahead[j, words] += np.add.reduceat(ahead[self.start[e], self.word[e]] * p[e], first)
        for i, e, words, first in self.out_of:
            back[i, words] += np.add.reduceat(back[self.stop[e], self.word[e]] * p[e], first)
        total = ahead[self.ends, np.arange(len(self.ends))]
        share = np.divide(counts, total, out=np.zeros_like(total), where=total > 0)
        known = self.piece >= 0
        w, i, j = self.word[known], self.start[known], self.stop[known]
        uses = share[w] * ahead[i, w] * p[known] * back[j, w]
        return np.stack([np.bincount(self.piece[known], uses[:, k], pieces) for k in range(languages)], axis=1)


def fit(counts: dict[str, dict[str, int]], vocab: dict[str, int], rounds: int = 3, prior: float = 50.0, words_at_once: int = 20_000) -> Model:
    """Expectation-maximisation of the piece probabilities from word counts by language.

    ``prior`` pseudo-observations spread over all languages' mean smooth each one.
    Long words count by their parts, as in scoring.
    """
    languages, width = sorted(counts), len(vocab)
    by_part: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for k, lang in enumerate(languages):
        for w, n in counts[lang].items():
            for part in parts(w):
                by_part[part][k] += n
    words = sorted(by_part, key=lambda w: (len(w), w))
    each = max(1, words_at_once * 4 // max(4, len(languages)))
    chunks = [words[k : k + each] for k in range(0, len(words), each)]
    lattices = [(Lattice(c, vocab), np.array([by_part[w] for w in c])) for c in chunks]
    prob = np.full((width, len(languages)), 1.0 / max(1, width))
    for _ in range(rounds):
        expected = np.zeros((width, len(languages)))
        for lattice, n in lattices:
            expected += lattice.expected(prob, n)
        mean = (expected.sum(1) + 0.01) / (expected.sum() + 0.01 * width)
        prob = (expected + prior * mean[:, None]) / (expected.sum(0) + prior)
    return Model(vocab, languages, prob)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 200, most_words: int = 20_000_000, max_languages: int = 512, vocab_path: str | None = None) -> Model:
    """Fit on a bounded sample: all words of at most ``docs_per_language`` whole texts of each language.

    Their ids have the smallest hashes, so that the sample doesn't depend on the
    order of rows. The sample's words with their counts reach the driver. More than
    ``max_languages`` labels or ``most_words`` distinct words are an error.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")).where("l is not null and t is not null")
    # the lowest of 65,536 ranges of hashes that hold enough documents, so that no task ranks a whole language
    hashed = rows.select("i", "l").withColumn("h", F.xxhash64("i")).withColumn("range", F.shiftright("h", 48))
    before = Window.partitionBy("l").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    low = hashed.groupBy("l", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("n") < docs_per_language)
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))
    ids = hashed.join(low.select("l", "range"), ["l", "range"], "left_semi").withColumn("r", rank).where(F.col("r") <= docs_per_language).select("i", "l")
    chosen = rows.join(F.broadcast(ids.distinct()), ["i", "l"], "left_semi")

    def count(batches):
        for b in batches:
            seen: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[lang].update(words_of(text))
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], ["l", "w", "n"])

    counted = chosen.select("l", "t").mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    by_lang: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, w, n in bounded_rows(counted, most_words, "training words"):
        by_lang[lang][w] = n
    if len(by_lang) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise the bound")
    return fit(by_lang, vocabulary(vocab_path))


class Scorer:
    """Scores texts; keeps the last ``most`` distinct words."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.most = model, most
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def _learn(self, words: list[str], clear: bool) -> None:
        if clear:
            self.index, self.logs = {}, np.zeros((0, len(self.model.languages)))
        start = len(self.index)
        if start + len(words) > len(self.logs):
            self.logs = np.vstack([self.logs, np.zeros((max(len(words), len(self.logs), 4096), self.logs.shape[1]))])
        self.logs[start : start + len(words)] = self.model.log_words(words)
        self.index.update((w, start + k) for k, w in enumerate(words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            counts, chars = [], 0
            while at < len(texts) and len(counts) < 1024 and chars < 4_000_000:
                counts.append(Counter(words_of(texts[at])) if texts[at] else Counter())
                chars += len(texts[at] or "")
                at += 1
            words = set().union(*counts)
            if new := [w for w in words if w not in self.index]:
                if len(self.index) + len(new) > self.most:
                    new = list(words)
                for lo in range(0, len(new), 20_000):
                    self._learn(new[lo : lo + 20_000], clear=lo == 0 and len(self.index) + len(new) > self.most)
            out.extend(map(self._one, counts))
        return out

    def _one(self, counts: Counter) -> tuple[str, float]:
        if not counts or not self.model.languages:
            return UND, 0.0
        ids = np.fromiter(map(self.index.__getitem__, counts), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        logs = n @ self.logs[ids]
        best = int(np.argmax(logs))
        # the posterior of a typical stretch of ten words: of the whole text it would be 0 or 1
        p = np.exp((logs - logs[best]) / max(1.0, n.sum() / 10.0))
        return self.model.languages[best], float(1.0 / p.sum())


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; a narrow pass over whole texts."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    where = kept.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "`lang_pred` string", "`score` double"])

    def run(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            found = scorer.predict(b.column(where).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*kept, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def is_held_out(id_col: str = "doc_id"):
    """The contract's fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
