"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words, their shapes (case, digits, marks around them),
pairs of neighbouring shapes, and marks of repetition. Term weights are damped
frequencies times inverse document frequency; a truncated singular value
decomposition of a labelled sample gives the latent space. The labelled vectors
are broadcast, every document is compared with all of them in blocks, and its
nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, held_out, mix64, table

#: Labelled texts of each class that the classifier is fitted on, at most: those with the smallest hashes.
SAMPLE_PER_CLASS = 1500
LATENT = 48
NEIGHBOURS = 25
#: A neighbour votes with its cosine to this power.
SHARPNESS = 4
PREDICT_AT = 0.3

#: Columns of the hashed term space, by kind of term.
SHAPES, PAIRS, WORDS = 256, 512, 1024
_TWIN = SHAPES + PAIRS + WORDS
_UNIQUE, _LINES, _SIZE = _TWIN + 11, _TWIN + 22, _TWIN + 33
TERMS = _SIZE + 24
#: Words for which repetition is measured together, and words that a worker remembers.
STRETCH, CACHE_WORDS = 64, 400_000


def shape(word: str) -> str:
    """Case and marks of a word; letters only count by their case."""
    core = word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    at = word.find(core) if core else len(word)
    if not core:
        kind = "-"
    elif core.isdigit():
        kind = "9"
    elif core.isupper():
        kind = "A" if len(core) == 1 else "AA"
    elif core.islower():
        kind = "a"
    else:
        kind = "Aa" if core[:1].isupper() and core[1:].islower() else "aA9"
    return f"{word[: min(at, 3)]}{kind}{word[at + len(core) :][:3]}"


class Features:
    """Term weights of texts, before the inverse document frequencies."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}  # number of a word's shape, and below it 32 bits of the word itself

    def _numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for w in [w for w in set(words) if w not in known]:
            known[w] = zlib.crc32(shape(w).encode()) % SHAPES << 32 | zlib.crc32(w.lower().encode())
        both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return both >> 32, both & 0xFFFFFFFF

    def weights(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), TERMS), np.float32)
        for row, text in zip(out, texts):
            text = text or ""
            words = text.split()
            n = len(words)
            row[_SIZE + min(n.bit_length(), 23)] = 0.2
            if not n:
                continue
            shapes, ids = self._numbers(words)
            row[:SHAPES] = np.sqrt(np.bincount(shapes, minlength=SHAPES) / n)
            if n > 1:
                pairs = (shapes[:-1] * 31 + shapes[1:]) % PAIRS
                row[SHAPES : SHAPES + PAIRS] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / n)
                row[_TWIN + int(10 * (ids[1:] == ids[:-1]).mean())] = 1
            row[SHAPES + PAIRS : _TWIN] = 0.5 * np.sqrt(np.bincount(ids % WORDS, minlength=WORDS) / n)
            row[_UNIQUE + int(10 * self._unique(ids))] = 1
            lines = [x for x in text.split("\n") if x.strip()]
            row[_LINES + int(10 * len(set(lines)) / max(len(lines), 1))] = 1
        return out

    @staticmethod
    def _unique(ids: np.ndarray) -> float:
        """Share of words that are new within their stretch; the last stretch may be shorter."""
        whole = len(ids) // STRETCH * STRETCH
        rows = np.sort(ids[:whole].reshape(-1, STRETCH), axis=1)
        new = len(rows) + (rows[:, 1:] != rows[:, :-1]).sum() + len(np.unique(ids[whole:]))
        return float(new / len(ids))


_FEATURES = Features()


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            cut = batch.slice(lo, 500)
            rows = [r.tobytes() for r in _FEATURES.weights(cut.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(rows, pa.binary()), cut.column(2).cast(pa.int32())], ["doc_id", "weights", "label"])


class Model:
    """Inverse document frequencies, the latent axes, and the labelled vectors."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        seen = (weights > 0).sum(axis=0)
        self.idf = (np.log((1 + len(weights)) / (1 + seen)) + 1).astype(np.float32)
        self.axes = self._axes(weights * self.idf)
        self.vectors = self.project(weights)

    @staticmethod
    def _axes(matrix: np.ndarray) -> np.ndarray:
        """The leading right singular vectors by randomised subspace iteration from fixed directions."""
        k = min(LATENT, *matrix.shape) if matrix.size else 0
        if not k:
            return np.zeros((matrix.shape[1], 1), np.float32)
        seeds = mix64(np.arange(matrix.shape[1] * (k + 8)), 1)
        basis = ((seeds >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5).reshape(-1, k + 8)
        for _ in range(5):
            basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
        _, _, right = np.linalg.svd(matrix @ basis, full_matrices=False)
        return (basis @ right.T)[:, :k].astype(np.float32)

    def project(self, weights: np.ndarray) -> np.ndarray:
        vectors = (weights * self.idf) @ self.axes
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norm > 0, norm, 1)

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1; without a similar neighbour the sample's share."""
        if not len(self.labels):
            return np.full(len(weights), self.prior)
        near = self.project(weights) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(near, -k, axis=1)[:, -k:]
        votes = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = votes.sum(axis=1)
        return np.where(total > 0, (votes * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, train, label: str = "quality", key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model from at most `per_class` labelled rows of each class, wherever `train` holds."""
    known = labels.filter(train & F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit("fit"))
    picked = [known.filter(F.col("label") == k).distinct().orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(chosen, "doc_id")
    got = rows.mapInArrow(_sample_task, "doc_id long, weights binary, label int").orderBy("doc_id", "weights").limit(4 * per_class).collect()
    weights = np.stack([np.frombuffer(r.weights, np.float32) for r in got]) if got else np.zeros((0, TERMS), np.float32)
    return Model(weights, np.array([r.label for r in got], np.int64))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 from PREDICT_AT on).

    A null text is an empty one; a text like no labelled one gets the sample's
    share of label 1, and so does every text if there are no labels. Repeated
    rows are judged alike; columns of the same names are replaced, all others
    pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, scores = batch.column(text).to_pylist(), []
            for lo in range(0, len(texts), 500):
                scores.append(shared.value.score(_FEATURES.weights(texts[lo : lo + 500])))
            found = np.clip(np.concatenate(scores), 0.0, 1.0)
            return [pa.array(found, pa.float64()), pa.array((found >= PREDICT_AT).astype(np.int32), pa.int32())]

        return step

    return annotate(docs, make, "score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 5, 0)
    model = fit(docs, table(spark, sf_dir, "labels"), ~held)
    return classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
