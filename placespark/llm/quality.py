"""Quality of texts by random-indexing word vectors, pooled per document, and a two-layer network trained in numpy.

Random indexing: every word has a sparse random index vector; the vector of a word is the sum of the index vectors of
the words around it, over the whole corpus. Words are hashed to ``BUCKETS`` rows, so the vectors are one matrix of fixed
size, summed up by tasks and then by Spark; it is what is broadcast. A document is the mean, spread and extremes of its
words' vectors, the mean likeness of neighbouring words, and its size. The network is fitted on at most ``max_train``
labelled documents, the smallest by hash (a bound for fitting only); a fifth of them sets the temperature that
calibrates the probabilities.

Labels, languages, sources and ids are no inputs. Null or empty text has the features of no words and still gets a
score; without labels of both kinds every score is the share of label 1, or 0.5. Null labels are left out; rows that
repeat are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.common import about, coded, hashed, mixed, slices, stored, strings, words

BUCKETS = 1 << 14
SIZE = 24
NONZERO = 4
REACH = 2
HIDDEN = 24
MAX_TRAIN = 20_000
FEATURES = 4 * SIZE + 6
STEP = 4 << 20


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold; null is taken as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _index(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and signs of the index vector of each bucket."""
    columns, signs = [], []
    for k in range(NONZERO):
        h = mixed(buckets.astype(np.uint64) * np.uint64(NONZERO) + np.uint64(k + 1))
        columns.append((h % np.uint64(SIZE)).astype(np.int64))
        signs.append(np.where(h >> np.uint64(63), 1, -1))
    return np.stack(columns, 1), np.stack(signs, 1)


_COLUMNS, _SIGNS = _index(np.arange(BUCKETS))
_INDEX = np.zeros((BUCKETS, SIZE), np.float32)
np.add.at(_INDEX, (np.arange(BUCKETS)[:, None], _COLUMNS), _SIGNS)


def _buckets(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word."""
    rows, found = words(strings(piece["text"]))
    codes, distinct = coded(found)
    return rows.astype(np.int64), (hashed(distinct) % np.uint64(BUCKETS)).astype(np.int64)[codes]


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The matrix of word vectors of the whole corpus, each of length 1, its own index vector added."""

    def task(batches):
        total = np.zeros(BUCKETS * SIZE)
        for batch in batches:
            for piece in slices(batch, "text", STEP):
                rows, of = _buckets(piece)
                for distance in range(1, REACH + 1):
                    near = rows[:-distance] == rows[distance:]
                    left, right = of[:-distance][near], of[distance:][near]
                    for a, b in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(a * SIZE + _COLUMNS[b, k], _SIGNS[b, k], BUCKETS * SIZE)
        found = total.reshape(BUCKETS, SIZE).astype(np.int64)
        seen = np.flatnonzero(found.any(axis=1))
        columns = [pa.array(seen, pa.int32()), *(pa.array(found[seen, i]) for i in range(SIZE))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"v{i}" for i in range(SIZE))])

    values = [f"v{i}" for i in range(SIZE)]
    schema = "bucket int, " + ", ".join(f"{v} long" for v in values)
    sums = documents.select("text").mapInArrow(task, schema).groupBy("bucket").agg(*(F.sum(v).alias(v) for v in values))
    found = sums.toArrow()  # BUCKETS rows at most
    vectors = np.zeros((BUCKETS, SIZE), np.float32)
    if found.num_rows:
        vectors[found["bucket"].to_numpy()] = np.stack([found[v].to_numpy() for v in values], 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)
    vectors += 0.5 * _INDEX
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-6)).astype(np.float32)


def features(documents: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, features) of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(vectors)

    def task(batches):
        v = shared.value
        for batch in batches:
            for piece in slices(batch, "text", STEP):
                n = piece.num_rows
                rows, of = _buckets(piece)
                count = np.bincount(rows, minlength=n)
                out = np.zeros((n, FEATURES), np.float32)
                if len(rows):
                    own = v[of]
                    full = np.flatnonzero(count)
                    starts = np.searchsorted(rows, full)
                    times = count[full, None]
                    mean = np.add.reduceat(own, starts) / times
                    spread = np.sqrt(np.maximum(np.add.reduceat(own * own, starts) / times - mean**2, 0))
                    top, low = np.maximum.reduceat(own, starts), np.minimum.reduceat(own, starts)
                    pairs = np.zeros(n)
                    near = rows[:-1] == rows[1:]
                    alike = np.einsum("ij,ij->i", own[:-1], own[1:])
                    pairs += np.bincount(rows[:-1][near], alike[near], n)
                    distinct = np.bincount(np.unique(rows * BUCKETS + of) // BUCKETS, minlength=n)
                    rest = [
                        pairs[full] / np.maximum(1, count[full] - 1), np.linalg.norm(mean, axis=1),
                        distinct[full] / count[full], np.log1p(count[full]), np.log1p(distinct[full]),
                        np.ones(len(full)),
                    ]
                    out[full] = np.concatenate([mean, spread, top, low, np.stack(rest, 1)], axis=1)
                flat = pa.array(out.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * FEATURES, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([piece["doc_id"], lists], ["doc_id", "features"])

    return documents.select("doc_id", "text").mapInArrow(task, "doc_id long, features array<float>")


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    @classmethod
    def constant(cls, share: float) -> Network:
        logit = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        zero = np.zeros(FEATURES)
        return cls(zero, zero + 1, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([logit]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, decay: float = 1e-4) -> Network:
        """Adam on four fifths of the rows, the temperature on the rest."""
        random = np.random.default_rng(5)
        if len(x) == 0 or y.min() == y.max():
            return cls.constant(float(y.mean()) if len(y) else 0.5)
        order = random.permutation(len(x))
        kept = order[: max(1, len(x) // 5)] if len(x) >= 50 else order
        own = order[len(kept) :] if len(x) >= 50 else order
        scale = x[own].std(axis=0)
        net = cls(
            x[own].mean(axis=0), np.where(scale > 1e-6, scale, 1), random.normal(0, 1 / FEATURES**0.5, (FEATURES, HIDDEN)),
            np.zeros(HIDDEN), random.normal(0, 1 / HIDDEN**0.5, HIDDEN), np.zeros(1),
        )
        values = [net.w1, net.b1, net.w2, net.b2]
        means, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        epochs = max(epochs, min(600, 60 * 2000 // len(own)))
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs)
            shuffled = random.permutation(own)
            for i in range(0, len(shuffled), batch):
                part = shuffled[i : i + batch]
                z = (x[part] - net.mean) / net.scale
                h = np.maximum(z @ net.w1 + net.b1, 0)
                p = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2[0], -60, 60)))
                error = (p - y[part]) / len(part)
                back = np.outer(error, net.w2) * (h > 0)
                grads = [z.T @ back + decay * net.w1, back.sum(0), h.T @ error + decay * net.w2, np.array([error.sum()])]
                step += 1
                for value, grad, mean, square in zip(values, grads, means, squares, strict=True):
                    mean += 0.1 * (grad - mean)
                    square += 0.01 * (grad * grad - square)
                    value -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        logits, target = net.logits(x[kept]), y[kept]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        losses = [np.logaddexp(0, np.where(target == 1, -logits, logits) / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
        return net


def fit(rows: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Network:
    """A network for (doc_id, features) rows outside the held-out fold and their labels."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("order")
    )
    known = about(known, "id", max_train).orderBy("order", "id", "label").limit(max_train)
    found = rows.join(known, F.col("doc_id") == F.col("id")).orderBy("order", "id", "label", "features").limit(max_train)
    found = found.select("features", "label").toArrow()
    x = np.array(pc.list_flatten(found["features"]).to_numpy(), np.float64).reshape(-1, FEATURES)
    return Network.fit(x, found["label"].to_numpy().astype(np.float64))


def score(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    rows = stored(features(documents, word_vectors(documents)), "quality-features")
    shared = documents.sparkSession.sparkContext.broadcast(fit(rows, labels, max_train))

    def task(batches):
        for batch in batches:
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            p = shared.value.probabilities(x)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(
        task, "doc_id long, held_out boolean, score double, predicted int"
    )
