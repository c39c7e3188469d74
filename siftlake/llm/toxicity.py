"""Toxicity by non-negative positive-unlabelled learning, in numpy.

The learner sees confirmed toxic texts and unlabelled texts; which of the unlabelled ones are clean it is not told. With
the class prior p, the share of toxic texts among all, the risk of a scorer g is p * E_toxic[loss(g)] plus what
unlabelled texts cost if all were clean, less what the toxic ones among them have added to that: E_unlabelled[loss(-g)]
- p * E_toxic[loss(-g)]. The difference estimates the risk on clean texts and can't be negative; where a batch makes it
so, the scorer has fitted the unlabelled texts too well and the step goes the other way.

The features of a text say which words and which beginnings of words it has, once each, so that one insult in a long
text counts as much as in a short one. Those are kept that tell the toxic sample from the unlabelled one best, by the
difference of their shares in standard errors. Every text of the sample is also scored by a model that has not seen it;
the threshold is the one with the smallest estimated risk of errors on these scores, and a scale fitted by the same risk
turns the distance to it into a probability.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import ranges, slices, text_batches, text_list

#: Bounds of the sample: confirmed toxic texts, unlabelled texts, and characters of a sampled text.
TOXIC, UNLABELLED, SAMPLE_CHARS = 2_000, 8_000, 20_000
#: The class prior where no row is labelled as clean; its least and its greatest value.
PRIOR, LEAST_PRIOR, MOST_PRIOR = 0.1, 0.001, 0.9
#: Letters of the beginnings of words; features kept; texts of the sample and standard errors that a feature must have.
BEGINNINGS, FEATURES, LEAST_TEXTS, LEAST_ERRORS = (4, 5, 6, 7), 2_048, 4, 3.8
STEPS, RATE, SHRINK, FOLDS = 400, 0.05, 1e-4, 3
#: Pieces of text that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 500_000

LETTERS = regex.compile(r"\p{L}+")
SCORED = "doc_id long, score double, predicted int"


def word_features(word: str) -> list[str]:
    """The word, and its beginnings with a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if n <= len(word))]


class Coder:
    """Numbers for the features of the sample's texts."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}

    def features(self, text: str) -> np.ndarray:
        """The numbers of the features that the text has, each once."""
        found: set[int] = set()
        for word in set(LETTERS.findall(text.lower())):
            if word not in self.words:
                self.words[word] = [self.names.setdefault(f, len(self.names)) for f in word_features(word)]
            found.update(self.words[word])
        return np.fromiter(found, np.int32, len(found))


@dataclass
class Model:
    """score = sigmoid(scale * (bias + the weights of the features that a text has) + offset)."""

    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    scale: float = 1.0
    offset: float = 0.0
    #: What a worker knows the model by.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.bias + sums) + self.offset, -40, 40)))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _loss(z: np.ndarray) -> np.ndarray:
    """The logistic loss of a text of the class that z speaks for."""
    return np.logaddexp(0, -z)


def pu_risk(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk on toxic texts and the estimate of the risk on clean ones, from the scores of both samples."""
    positive = prior * _loss(toxic).mean()
    return positive, _loss(-unlabelled).mean() - prior * _loss(-toxic).mean()


def choose_features(toxic: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str]) -> np.ndarray:
    """The numbers of the features that tell the samples apart, the strongest first."""
    count = lambda texts: np.bincount(np.concatenate([np.zeros(0, np.int32), *texts]), minlength=len(names))
    a, b, n, m = count(toxic), count(unlabelled), max(1, len(toxic)), max(1, len(unlabelled))
    both = (a + b) / (n + m)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n + 1 / m))
    strength = np.where(a + b >= LEAST_TEXTS, np.abs(a / n - b / m) / error, 0)
    strong = np.flatnonzero(strength >= LEAST_ERRORS).tolist()
    return np.array(sorted(strong, key=lambda i: (-strength[i], names[i]))[:FEATURES], np.int64)


def _matrix(texts: list[np.ndarray], chosen: np.ndarray, n_names: int) -> np.ndarray:
    column = np.full(n_names, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for i, own in enumerate(texts):
        at = column[own]
        x[i, at[at >= 0]] = 1
    return x


def train(toxic: list[str], unlabelled: list[str], prior: float = PRIOR) -> Model:
    """Fit a model on the two samples; unlabelled texts are drawn from all texts, toxic ones included.

    Without toxic or unlabelled texts the model knows the prior alone and scores every text with it.
    """
    prior = min(max(prior, LEAST_PRIOR), MOST_PRIOR)
    if not toxic or not unlabelled:
        return Model(bias=_logit(prior))
    coder, texts = Coder(), [toxic, unlabelled]
    found = [[coder.features(t) for t in own] for own in texts]
    names = list(coder.names)
    # copies of a text are in one fold
    folds = [np.array([zlib.crc32(t.encode()) % FOLDS for t in own]) for own in texts]
    held = [np.zeros(len(own)) for own in texts]
    for k in range(FOLDS):
        seen = [[x for x, f in zip(own, fold, strict=True) if f != k] for own, fold in zip(found, folds, strict=True)]
        chosen, w, b = _fit(*seen, names, prior)
        for own, fold, score in zip(found, folds, held, strict=True):
            mine = np.flatnonzero(fold == k)
            score[mine] = _matrix([own[i] for i in mine], chosen, len(names)) @ w + b
    scale, offset = _calibrate(*held, prior)
    chosen, w, b = _fit(*found, names, prior)
    return Model({names[i]: k for k, i in enumerate(chosen.tolist())}, w, b, scale, offset)


def _fit(
    toxic: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str], prior: float
) -> tuple[np.ndarray, np.ndarray, float]:
    chosen = choose_features(toxic, unlabelled, names)
    return chosen, *_descend(*(_matrix(x, chosen, len(names)) for x in (toxic, unlabelled)), prior)


def _descend(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk with the sigmoid loss, which a text that is far on the wrong side can't dominate."""
    w, b = np.zeros(p.shape[1], np.float32), 0.0
    if not len(p) or not len(u):
        return w.astype(np.float64), _logit(prior)
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1):
        on_p, on_u = sigmoid(p @ w + b), sigmoid(u @ w + b)
        clean = on_u.mean() - prior * on_p.mean()
        # the loss of a score as clean is sigmoid(score), as toxic 1 - sigmoid(score)
        at_p, at_u = prior * on_p * (1 - on_p) / len(p), on_u * (1 - on_u) / len(u)
        at_p, at_u = (-2 * at_p, at_u) if clean >= 0 else (at_p, -at_u)
        grad = np.append(at_p @ p + at_u @ u + SHRINK * w, at_p.sum() + at_u.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = RATE * (1 - step / STEPS) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return w.astype(np.float64), b


def _calibrate(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The threshold with the smallest risk of errors, in the middle of the widest gap where several have it, and the
    scale with which the logistic risk is least. Without the bound at zero, so that all thresholds are told apart."""
    values, where = np.unique(np.concatenate([toxic, unlabelled]), return_inverse=True)
    below = lambda side: np.cumsum(np.bincount(side, minlength=len(values)))[:-1] / len(side)
    missed, passed = below(where[: len(toxic)]), below(where[len(toxic) :])
    if not len(missed):
        return 1.0, 0.0
    risk = prior * missed + (1 - passed) - prior * (1 - missed)
    gaps = np.where(risk <= risk.min() + 1e-12, np.diff(values), -1)
    at = int(gaps.argmax())
    middle = float(values[at] + values[at + 1]) / 2

    def logistic(scale: float) -> float:
        positive, clean = pu_risk(scale * (toxic - middle), scale * (unlabelled - middle), prior)
        return positive + max(clean, 0.0)

    scale = min(np.geomspace(0.3, 3, 21).tolist(), key=logistic)
    return scale, -scale * middle


def _in_fold(docs: DataFrame) -> DataFrame:
    """The rows that may be learnt from."""
    return docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


def _lowest(rows: DataFrame, rows_in: int, most: int, key: str) -> DataFrame:
    """rows with the smallest hashes of key, about most of them and not many more, by one cut of the hash's range."""
    share = min(1.0, (most + 4 * most**0.5) / max(1, rows_in))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return rows.where(F.xxhash64(F.lit("toxicity"), F.col(key)) <= bound)


def samples(docs: DataFrame, labels: DataFrame, most_toxic: int = TOXIC, most_unlabelled: int = UNLABELLED) -> tuple[list[str], list[str], float]:
    """Texts confirmed as toxic, texts whatever their label, and the share of toxic ones among labelled documents.

    Documents with several labels are toxic if one of them says so. The counts cover all rows; the texts are bounded by
    the parameters and chosen by a hash of doc_id, from texts that are not null and not longer than SAMPLE_CHARS.
    """
    judged = _in_fold(labels.where("toxic IS NOT NULL")).groupBy("doc_id").agg((F.max("toxic") > 0).alias("bad"))
    n, bad = judged.agg(F.count("*"), F.count_if("bad")).first()
    usable = _in_fold(docs).where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    by_hash = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    confirmed = _lowest(judged.where("bad"), bad, most_toxic, "doc_id").select("doc_id")
    # at most about most_toxic ids: their cut of the hash's range has so many of the distinct, evenly dealt ids
    toxic = usable.join(F.broadcast(confirmed), "doc_id", "left_semi").orderBy(by_hash, F.col("text")).limit(most_toxic)
    rows_in = usable.count()
    others = _lowest(usable, rows_in, most_unlabelled, "doc_id").orderBy(by_hash, F.col("text")).limit(most_unlabelled)
    prior = bad / n if 0 < bad < n else PRIOR
    return [r["text"] for r in toxic.collect()], [r["text"] for r in others.collect()], prior


class Scorer:
    """Scores of texts; what features a piece of text has is remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.begins, self.counts, self.flat = [], [], []

    def _learn(self, pieces: list[str]) -> None:
        for piece in pieces:
            own = {self.model.features.get(f, -1) for w in LETTERS.findall(piece.lower()) for f in word_features(w)} - {-1}
            self.index[piece] = len(self.counts)
            self.begins.append(len(self.flat))
            self.counts.append(len(own))
            self.flat += own

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.index) > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        words = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([p for p in pieces if p not in self.index])
        known = np.fromiter(map(self.index.get, pieces, repeat(0)), np.int64, len(pieces))
        begins, counts = np.array(self.begins, np.int64)[known], np.array(self.counts, np.int64)[known]
        telling = counts > 0
        code = coded.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(texts)), words)
        keep = telling[code] if len(code) else np.zeros(0, bool)
        pairs = np.unique(text[keep] * len(pieces) + code[keep])
        text, code = pairs // max(1, len(pieces)), pairs % max(1, len(pieces))
        flat = np.array(self.flat, np.int64)[ranges(begins[code], counts[code])]
        size = max(1, len(self.model.weights))
        has = np.unique(np.repeat(text, counts[code]) * size + flat)
        weights = np.append(self.model.weights, 0.0)
        return self.model.probabilities(np.bincount(has // size, weights[has % size], len(texts)))


_scorers: dict[str, Scorer] = {}


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every row of docs, from its whole text alone.

    Null texts are empty; they get the score of a text without features, as do texts without letters. Equal texts get
    equal scores; a null doc_id is passed on; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared, name = spark.sparkContext.broadcast(model), model.name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        scorer = _scorers[name]
        for batch in batches:
            texts = text_list(batch.column(1))
            for begin, end in slices(texts):
                score = scorer.score(texts[begin:end])
                columns = [batch.column(0)[begin:end], pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED)


def detect_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 5 is not 0, and score all; held_out marks the others.

    A null doc_id is neither learnt from nor held out.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    toxic, unlabelled, prior = samples(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    scored = score_toxicity(docs, train(toxic, unlabelled, prior))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
