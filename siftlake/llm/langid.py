"""Language identification with averaged hashed subword embeddings and a linear softmax.

A word is cut into its letter n-grams with markers at both ends; each n-gram hashes to a row of an embedding table; a
text is the mean over its words of the mean over their n-grams. The embeddings and the linear layer are trained together
by stochastic gradient descent in numpy, on a sample of labelled documents whose size is a parameter. A temperature,
fitted on a part of the sample that training did not see, makes the softmax a calibrated probability, and texts below
the threshold that keeps a stated share of that part correct are marked as not accepted.

As the model is linear after the mean, a word's share of the scores is a short vector that a worker works out once.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.common import slices, text_batches, text_list

NO_LANGUAGE = "und"
#: Bound of the labelled sample: documents per language, in all, and characters of a sampled document.
PER_LANGUAGE, SAMPLE, SAMPLE_CHARS = 500, 4_000, 20_000
GRAMS, BUCKETS, WIDTH = (1, 2, 3, 4), 1 << 15, 16
EPOCHS, RATE = 6, 0.5
#: The share of accepted texts that must be right on the part of the sample that training did not see.
WANTED = 0.99
#: Words that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 500_000

LETTERS = regex.compile(r"\p{L}+")
PREDICTED = "doc_id long, lang_pred string, score double, accepted boolean"


def grams(word: str) -> list[int]:
    """The rows of a word's n-grams, its two end markers included."""
    marked = f"<{word}>".encode("utf-32-le")
    return [
        zlib.crc32(marked[i : i + 4 * n]) % BUCKETS for n in GRAMS for i in range(0, len(marked) - 4 * n + 1, 4)
    ]


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def of_rows(self) -> np.ndarray:
        """Every embedding's share of the scores."""
        return self.embeddings @ self.weights

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = (scores + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the rows that occur and their weights, which add up to one."""
    known: dict[str, list[int]] = {}
    found = []
    for text in texts:
        words = words_of(text)
        rows = []
        for w in words:
            if w not in known:
                known[w] = grams(w)
            rows.append(known[w])
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((g for r in rows for g in r), np.int64, int(sizes.sum()))
        own, where = np.unique(flat, return_inverse=True)
        found.append((own, np.bincount(where.ravel(), np.repeat(1 / sizes, sizes), len(own)) / max(1, len(rows))))
    return found


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit a model; a fifth of the texts is kept for the temperature and the threshold. No text: a model of no use."""
    languages = sorted(set(labels)) or [NO_LANGUAGE]
    rng = np.random.default_rng(seed)
    model = Model(
        languages,
        rng.normal(0, 0.1, (BUCKETS, WIDTH)),
        rng.normal(0, 0.1, (WIDTH, len(languages))),
        np.zeros(len(languages)),
    )
    features, y = _features(texts), np.array([languages.index(x) for x in labels], np.int64)
    usable = np.array([i for i, (rows, _) in enumerate(features) if len(rows)], np.int64)
    order = rng.permutation(usable)
    apart, fitted = order[: len(order) // 5], order[len(order) // 5 :]
    share = np.bincount(y[fitted], minlength=len(languages)) if len(fitted) else np.ones(len(languages))
    weight = share.sum() / np.maximum(share, 1) / len(languages)
    steps, done = EPOCHS * max(1, len(fitted)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fitted):
            rows, parts = features[i]
            rate = RATE * (1 - done / steps) * min(weight[y[i]], 5.0)
            done += 1
            mean = parts @ model.embeddings[rows]
            z = mean @ model.weights + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = model.weights @ p
            model.weights -= rate * np.outer(mean, p)
            model.bias -= rate * 0.1 * p
            model.embeddings[rows] -= rate * 10 * np.outer(parts, back)
    if len(apart):
        scores = np.array([features[i][1] @ model.embeddings[features[i][0]] @ model.weights for i in apart])
        _calibrate(model, scores, y[apart])
    return model


def _calibrate(model: Model, scores: np.ndarray, y: np.ndarray) -> None:
    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(scores)[np.arange(len(y)), y], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.2, 20, 60).tolist(), key=loss)
    p = model.probabilities(scores)
    best, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-best)
    good = np.cumsum(right[order]) >= WANTED * np.arange(1, len(y) + 1)
    model.threshold = float(best[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample of docs, chosen by a hash of doc_id; what is collected is bounded too."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS))
    ranked = usable.select("lang", F.xxhash64("doc_id").alias("h"))
    by_hash = Window.partitionBy("lang").orderBy("h")
    first = ranked.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= per_language)
    first = first.orderBy("place", "h").limit(most).collect()
    bounds: dict[str, int] = {}
    for row in first:
        bounds[row["lang"]] = max(bounds.get(row["lang"], row["h"]), row["h"])
    if not bounds:
        return [], []
    last = F.lit(None).cast("long")
    for lang, h in bounds.items():
        last = F.when(F.col("lang") == lang, h).otherwise(last)
    rows = usable.where(F.xxhash64("doc_id") <= last).select("text", "lang").orderBy(F.xxhash64("doc_id"), "text").limit(most)
    rows = rows.collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


class Scorer:
    """Predictions for texts, with the scores of the pieces that have been met."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, model.of_rows()
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1 << 16, len(self.model.languages) + 1))  # the last column counts words

    def _learn(self, new: list[str]) -> np.ndarray:
        """Entries of new blank-separated pieces: the scores of their words added up, and how many words."""
        split = [words_of(x) for x in new]
        own = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
        rows = [grams(w) for w in own]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((g for r in rows for g in r), np.int64, int(sizes.sum()))
        means = np.zeros((1, self.rows.shape[1]))
        if len(rows):
            means = np.add.reduceat(self.rows[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter((own[w] for words in split for w in words), np.int64, int(counts.sum()))
        running = np.concatenate([np.zeros((1, means.shape[1])), np.cumsum(means[which], axis=0)])
        ends, begin = np.cumsum(counts), len(self.index)
        while begin + len(new) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[begin : begin + len(new), :-1] = running[ends] - running[ends - counts]
        self.sums[begin : begin + len(new), -1] = counts
        self.index.update(zip(new, range(begin, begin + len(new)), strict=True))
        return np.arange(begin, begin + len(new))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if len(self.index) > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            known[missing] = self._learn([words[i] for i in missing.tolist()])
        per_word = np.concatenate([self.sums[known[coded.indices.to_numpy()]], np.zeros((1, self.sums.shape[1]))])
        begins = np.cumsum(counts) - counts
        total = np.add.reduceat(per_word, begins, axis=0) if len(counts) else np.zeros((0, self.sums.shape[1]))
        total[counts == 0] = 0
        lettered = total[:, -1] > 0.5
        p = self.model.probabilities(total[:, :-1] / np.maximum(total[:, -1:], 1))
        best = p.argmax(1)
        names = [self.model.languages[k] if has else NO_LANGUAGE for k, has in zip(best.tolist(), lettered.tolist(), strict=True)]
        score = np.where(lettered, p.max(1), 0.0)
        return names, score, lettered & (score >= self.model.threshold)


_scorers: dict[str, Scorer] = {}


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted for every row of docs, from text alone.

    Texts that are null or have no letter get the language `und`, the score 0 and are not accepted. Equal texts get
    equal results; a null doc_id is passed on; an empty table gives no rows. Other columns are ignored. A model that no
    text trained knows the language `und` alone.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared, name = spark.sparkContext.broadcast(model), hashlib.sha256(pickle.dumps(model)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        scorer = _scorers[name]
        for batch in batches:
            texts = text_list(batch.column(1))
            for begin, end in slices(texts):
                names, score, accepted = scorer.predict(texts[begin:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:end], pa.array(names, pa.string()), pa.array(score), pa.array(accepted)],
                    names=[x.split()[0] for x in PREDICTED.split(", ")],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 3 is not 1, and predict all; held_out marks the others.

    A null doc_id is neither learnt from nor held out.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out)
    texts, labels = labelled_sample(seen.select("doc_id", "text", "lang"))
    predicted = predict_languages(docs, train(texts, labels))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
