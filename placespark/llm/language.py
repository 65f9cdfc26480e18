"""Language of texts by a byte convolutional network, trained in numpy.

A window of ``LENGTH`` bytes passes filters of several widths (each filter has a weight for every byte at every place),
the largest response of each filter in the window is kept, and a softmax over these gives the languages. A text is cut
into windows from front to end, the last one filled up with spaces, all windows are scored, and their probabilities are
averaged by bytes, so the whole text counts.

Training takes at most ``max_windows`` windows, two random ones of each of the texts with a language that come first by
the hash of their id: a documented bound for fitting only. Null text and text without a letter is `und` with score 0; null languages are never
learned from; without any labelled text everything is `und`. Rows that repeat are predicted each; ties go to the language
that sorts first; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.common import about, raw, slices, strings

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
MAX_WINDOWS = 12_000
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold; null is taken as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def windows(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each window, its bytes before filling up, windows as a matrix of bytes)."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // LENGTH))
    rows = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[rows] + nth * LENGTH
    sizes = np.minimum(LENGTH, offsets[rows + 1] - starts)
    at = starts[:, None] + np.arange(LENGTH)
    if not len(data):
        return rows, sizes, np.full(at.shape, 32, np.uint8)
    found = _LOWER[data[np.minimum(at, len(data) - 1)]]
    found[np.arange(LENGTH) >= sizes[:, None]] = 32
    return rows, sizes, found


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # for each width: [place, byte, filter]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> Network:
        random = np.random.default_rng(seed)
        filters = [random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        out = random.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        return cls(languages, filters, np.zeros(n, np.float32), out, np.zeros(len(languages), np.float32))

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each window and, if asked for, its place. Pairs of bytes are looked up at once."""
        pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        best, places = [], []
        for width, weights in zip(WIDTHS, self.filters, strict=True):
            n = LENGTH - width + 1
            total = None
            for i in range(0, width - 1, 2):
                both = (weights[i][:, None, :] + weights[i + 1][None, :, :]).reshape(-1, FILTERS)
                part = both[pairs[:, i : i + n]]
                total = part if total is None else total + part
            if width % 2:
                total = total + weights[-1][x[:, width - 1 : width - 1 + n]]
            best.append(total.max(axis=1))
            if where:
                places.append(total.argmax(axis=1))
        return np.concatenate(best, axis=1) + self.bias, np.concatenate(places, axis=1) if where else None

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 3):
        """Adam on cross entropy with classes of equal weight; gradients reach a filter at its largest response only."""
        random = np.random.default_rng(seed)
        weight = 1 / np.maximum(1, np.bincount(y, minlength=len(self.languages)))
        weight = (weight / weight[y].mean()).astype(np.float32)
        values = [*self.filters, self.bias, self.out, self.out_bias]
        means, squares, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(epochs):
            order = random.permutation(len(x))
            for begin in range(0, len(x), batch):
                own = order[begin : begin + batch]
                pooled, places = self.pooled(x[own], where=True)
                error = self.probabilities(pooled)
                error[np.arange(len(own)), y[own]] -= 1
                error *= weight[y[own]][:, None] / len(own)
                back = (error @ self.out.T) * (pooled > 0)
                grads = []
                for k, (width, weights) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    grad = np.zeros_like(weights)
                    part = slice(k * FILTERS, (k + 1) * FILTERS)
                    for i in range(width):
                        seen = np.take_along_axis(x[own], places[:, part] + i, axis=1)
                        np.add.at(grad[i], (seen, np.arange(FILTERS)[None, :]), back[:, part])
                    grads.append(grad)
                grads += [back.sum(axis=0), np.maximum(pooled, 0).T @ error, error.sum(axis=0)]
                step += 1
                for value, grad, mean, square in zip(values, grads, means, squares, strict=True):
                    mean += 0.1 * (grad - mean)
                    square += 0.01 * (grad * grad - square)
                    value -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)


def training_windows(labelled: DataFrame, max_windows: int = MAX_WINDOWS) -> tuple[np.ndarray, list[str]]:
    """At most max_windows windows with their languages, the smallest by hash."""

    def task(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                found = []
                for lang, text in zip(piece["lang"].to_pylist(), strings(piece["text"]), strict=True):
                    data = text.as_buffer()
                    key = xxhash.xxh3_64_intdigest(data)
                    for i in range(2):
                        mixed = xxhash.xxh3_64_intdigest(f"{key} {i}")
                        start = mixed % max(1, len(data) - LENGTH + 1)
                        found.append((lang, data.to_pybytes()[start : start + LENGTH], mixed - (1 << 63)))
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)],
                    ["lang", "bytes", "key"],
                )

    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        task, "lang string, bytes binary, key long"
    )
    found = rows.orderBy("key", "lang", "bytes").limit(max_windows).toArrow()
    _, _, x = windows(*raw(pc.cast(found["bytes"], pa.large_binary()).combine_chunks()))
    return x, found["lang"].to_pylist()


def fit(labelled: DataFrame, max_windows: int = MAX_WINDOWS) -> Network | None:
    """A network for the languages of these rows (doc_id, lang, text); None without any."""
    rows = about(labelled.select("doc_id", "lang", "text").filter("lang is not null"), "doc_id", max_windows // 2)
    x, names = training_windows(rows.filter(F.col("text").rlike(r"\p{L}")), max_windows)
    if not names:
        return None
    languages = sorted(set(names))
    network = Network.new(languages)
    network.train(x, np.searchsorted(np.array(languages), np.array(names)))
    return network


def predict(documents: DataFrame, network: Network | None, folds: int = 5, fold: int = 0) -> DataFrame:
    """Language and its mean probability for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def task(batches):
        model = shared.value
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                texts = strings(piece["text"])
                n = piece.num_rows
                known = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
                names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
                if model is not None:
                    rows, sizes, x = windows(*raw(texts))
                    total = np.zeros((n, len(model.languages)))
                    for i in range(0, len(x), 512):
                        found = model.probabilities(model.pooled(x[i : i + 512])[0]) * sizes[i : i + 512, None]
                        np.add.at(total, rows[i : i + 512], found)
                    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                    best = total.argmax(axis=1)
                    names[known] = np.array(model.languages, object)[best[known]]
                    scores[known] = np.clip(total[np.arange(n), best], 0, 1)[known]
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], piece["held_out"], pa.array(names, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = documents.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return rows.mapInArrow(task, PREDICTED)


def identify(documents: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Learn from the documents outside the held-out fold and predict all."""
    return predict(documents, fit(documents.filter(~held_out(F.col("doc_id"))), max_windows))
