"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is a bag of sentences.  A sentence's score is a logistic function of its words, a document's is their
noisy-or: 1 - (1 - s1)(1 - s2)...  Only documents have labels, so the likelihood of the noisy-or trains the sentence
scores; the sentences that carry a document's score are the offending ones, and ``offending`` returns their places.

A sentence without telling words has the score 0: the logistic function's value there is taken off, so that thousands of
such sentences don't add up.

A word counts once a sentence, by itself and by its first ``PREFIX`` letters, hashed to ``2 ** BITS`` weights; what is
in fewer than ``MIN_DOCS`` documents of the sample has no weight.  The model is fitted on a bounded sample: of the
labelled documents that may be learned from, the ``SAMPLE`` with the smallest hashes of their ids, texts of over
``SAMPLE_BYTES`` left out of it.  Every document is scored, from its whole text.

A sentence ends at . ! ? ... and their wide forms and at line ends; one of over ``LONGEST`` characters is cut where
white space allows.

Defined results: a null or empty text, and one without a letter, has no sentence and the score 0; null ids hash as '';
labels that are null or neither 0 nor 1 aren't learned from, and a document labelled both ways is toxic; of documents
that share an id one text is learned from, all are scored; without toxic or without other labels to learn from every
score is 0; repeated rows are scored each; a very long text is one row, its sentences stream; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import give_back, text_of, written

#: Labelled documents that the model is fitted on, and bytes of the longest text among them.
SAMPLE, SAMPLE_BYTES = 10_000, 1 << 20
BITS, PREFIX, MIN_DOCS, TELLING = 18, 5, 3, 4.5
#: Passes over the sample, step, pull of the weights to 0, and the sentence score's start.
PASSES, STEP, PULL, START = 150, 0.15, 1e-4, -6.0
#: Characters of a sentence, and words whose weights a worker remembers.
LONGEST, REMEMBERED = 400, 200_000
#: A sentence from this score on is offending.
OFFENDS = 0.5
#: One in FOLDS documents, by the hash of its id, is never learned from.
FOLDS = 5
_END = r"\n\r.!?…。！？  "
_SENTENCE = re.compile(rf"[^{_END}]{{1,{LONGEST}}}(?![^\s{_END}])|[^{_END}]{{1,{LONGEST}}}")
_WORD = re.compile(r"[^\W\d_]+")
REPORT = "score double, n_sentences long, n_offending long, worst_start long, worst_end long"
_FEATURES = "words array<int>, ends array<int>"


def held_out() -> F.Column:
    """Whether the document's id takes it out of learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features_of(word: str) -> tuple[int, int]:
    mask = (1 << BITS) - 1
    return zlib.crc32(word.encode("utf-8", "replace")) & mask, zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "replace")) & mask


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and words of each sentence that has a word."""
    for m in _SENTENCE.finditer(text):
        words = set(_WORD.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


def logistic(z: float) -> float:
    return 0.0 if z == -math.inf else 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


class Model:
    """Weights of the hashed features and the start value of a sentence."""

    def __init__(self, weights: np.ndarray, start: float):
        self.weights, self.start = weights.astype(np.float64), start
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self._known.get(word)
        if w is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            w = self._known[word] = float(sum(self.weights[k] for k in set(features_of(word))))
        return w

    def score(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence: what its words add to the score of a sentence without telling words."""
        out, none = [], logistic(self.start)
        for a, b, words in sentences(text):
            z = self.start + sum(sorted(map(self.weight, words)))  # sorted: the same sum in every process
            out.append((a, b, max(0.0, (logistic(z) - none) / (1 - none))))
        return out


def noisy_or(scores: list[float]) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-15)).sum())) if scores else 0.0


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature numbers of all sentences one after the other, and where each sentence ends."""
    for batch in batches:
        made = []
        for text in batch.column("text").to_pylist():
            ids, ends = [], []
            for _, _, words in sentences(text):
                ids += sorted({f for w in words for f in features_of(w)})
                ends.append(len(ids))
            made.append((ids, ends))
        columns = [pa.array([m[k] for m in made], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *columns], names=["doc_id", "toxic", "words", "ends"])
    give_back()


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The noisy-or model of bags (features, ends of sentences, label), by Adam over all bags at once."""
    bags = [b for b in bags if len(b[1])]
    y = np.array([b[2] for b in bags], dtype=np.float64)
    if not len(bags) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), -np.inf)
    seen = np.zeros((2, 1 << BITS))
    for words, _, label in bags:
        seen[label, np.unique(words)] += 1
    n = np.array([len(y) - y.sum(), y.sum()])
    both = seen.sum(axis=0) / n.sum()
    apart = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
    kept = np.flatnonzero((seen.sum(axis=0) >= MIN_DOCS) & (np.abs(apart) >= TELLING))
    number = np.full(1 << BITS, len(kept), dtype=np.int64)  # the last weight, of rare features, stays 0
    number[kept] = np.arange(len(kept))
    ids = number[np.concatenate([b[0] for b in bags])]
    sizes = np.concatenate([np.diff(np.r_[0, b[1]]) for b in bags])
    first = np.cumsum(sizes) - sizes
    n_sentences = np.array([len(b[1]) for b in bags])
    bag_first = np.cumsum(n_sentences) - n_sentences
    weigh = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) ** 0.5  # half way to equal classes
    w, start = np.zeros(len(kept) + 1), START
    m, v, ms, vs = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, PASSES + 1):
        z = np.clip(start + np.add.reduceat(w[ids], first), -30, 30)
        s = 1 / (1 + np.exp(-z))
        clean = np.exp(np.add.reduceat(np.log1p(-s), bag_first))  # 1 - the bag's score
        pull = weigh * np.where(y == 1, clean / np.maximum(1 - clean, 1e-12), -1.0)
        g = s * np.repeat(pull, n_sentences) / len(bags)
        gw, gs = np.bincount(ids, np.repeat(g, sizes), len(w)) - PULL * w, g.sum()
        m, v, ms, vs = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * ms + 0.1 * gs, 0.999 * vs + 0.001 * gs * gs
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w += STEP * (m / up) / (np.sqrt(v / down) + 1e-8)
        w[-1] = 0.0
        start += STEP * (ms / up) / (vs / down + 1e-16) ** 0.5
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[kept] = w[:-1]
    return Model(weights, start)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from labelled documents that aren't held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = written(known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample), "chosen")
    text = docs.select(F.col("doc_id").alias("of_doc"), text_of(docs).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = text.join(F.broadcast(chosen), F.col("of_doc") == F.col("doc_id"))  # at most ``sample`` rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(_sample_features, f"doc_id {kind}, toxic int, {_FEATURES}").toArrow().sort_by("doc_id")
    table = zip(*(made.column(c).combine_chunks() for c in ("words", "ends")), made.column("toxic").to_pylist())
    return fit([(w.values.to_numpy(), e.values.to_numpy(), y) for w, e, y in table])


def _shared(docs: DataFrame, model: Model) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.start))  # 2 ** BITS weights


_models: dict[int, Model] = {}


def _model(shared: Broadcast) -> Model:
    """The worker's model, with the words it remembers."""
    key = id(shared.value)
    if key not in _models:
        _models.clear()
        _models[key] = Model(*shared.value)
    return _models[key]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, n_offending, worst_start, worst_end (code points, of the highest sentence) for each row."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                got = model.score(text)
                worst = max(got, key=lambda g: (g[2], -g[0]), default=(None, None, 0.0))
                rows.append((noisy_or([g[2] for g in got]), len(got), sum(g[2] >= OFFENDS for g in got), worst[0], worst[1]))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", *(f.split()[0] for f in REPORT.split(", "))])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, {REPORT}")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end")


def offending(docs: DataFrame, model: Model, least: float = OFFENDS) -> DataFrame:
    """doc_id, start, end, score, sentence: a row for each sentence of at least that score, by place (code points, end exclusive)."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                got = [g for g in model.score(text) if g[2] >= least]
                if got:
                    ids = batch.column("doc_id").take(pa.array([k] * len(got)))
                    columns = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([float(g[2]) for g in got]), pa.array([text[g[0] : g[1]] for g in got])]
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "start", "end", "score", "sentence"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, start long, end long, score double, sentence string")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents, labels -> what ``scored`` gives, by a model of the labels that may be learned from."""
    return scored(docs, train(docs, labels))
