"""Severity of toxicity by cumulative-link ordinal regression over sparse words.

P(grade > k) = sigmoid(x . w - threshold_k): one weight per word, shared by the ordered thresholds. The expected severity
is the sum of these probabilities over k. Labels are 0 or 1; grade 0 is label 0, and toxic documents get grade 1 to
``GRADES`` by how many words of the toxic vocabulary they hold, cut at equal shares of the toxic training documents.

- Features: words and their beginnings of ``STEMS`` characters (so that endings do not matter), each with five nested
  conditions: that a document has it once, twice, three times, and in one word of 400 and of 100. A word is A-Z
  lower-cased and stripped of what is no letter or digit at its ends. Used are those that set the labels apart by a
  chi-square of ``MIN_CHI`` or more and hold in ``MIN_DOCS`` or more documents, at most ``max_features`` of them.
- Fitting takes at most ``max_train`` labelled rows, the smallest by hash of the id (a bound for fitting only).
- Null or empty text has no words and the severity of the base rate; without labels of both kinds nothing is toxic. Null
  labels are left out; a doc_id with several labels counts as toxic if one says so; rows that repeat are scored each; an
  empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.llm.common import about, as_array, coded, slices, stored, strings, words

GRADES = 3
MIN_CHI = 20.0
MIN_DOCS = 4
MAX_FEATURES = 4096
MAX_TRAIN = 10_000
STEMS = (3, 5, 7)
#: Nested conditions of a feature: occurrences, or share of the document's words.
TIMES = (1, 2, 3)
SHARES = (1 / 400, 1 / 100)
LEVELS = len(TIMES) + len(SHARES)
LIMIT = 0.5
#: Bytes of text of one step; its words, beginnings and names take some fifty times as much.
STEP = 1 << 20
SCORED = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"


def _normal(found: pa.Array) -> pa.Array:
    return as_array(pc.replace_substring_regex(pc.ascii_lower(found), r"^[^\pL\pN]+|[^\pL\pN]+$", ""))


def document_features(piece: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(text, word or beginning, occurrences, words of the text) of all features of each text."""
    rows, found = words(strings(piece["text"]))
    rows = rows.astype(np.int64)
    size = np.bincount(rows, minlength=piece.num_rows)
    codes, distinct = coded(found)
    normal, values = coded(_normal(distinct))
    word = normal[codes] if len(codes) else codes
    length = pc.utf8_length(values).to_numpy(zero_copy_only=False)
    out_rows, out_names, out_times = [], [], []
    for stem in (None, *STEMS):
        if stem is None:
            names, of, kept = values, np.arange(len(values)), length > 0
        else:
            of, names = coded(as_array(pc.utf8_slice_codeunits(values, 0, stem)))
            kept = length > stem
            names = as_array(pc.binary_join_element_wise(names, _end(""), _end("*")))
        inside = kept[word] if len(word) else np.zeros(0, bool)
        many = len(names) + 1
        key, times = np.unique(rows[inside] * many + of[word[inside]], return_counts=True)
        out_rows.append(key // many)
        out_names.append(names.take(pa.array(key % many)))
        out_times.append(times)
    row = np.concatenate(out_rows)
    return row, pa.concat_arrays(out_names), np.concatenate(out_times), size[row]


def _end(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def met(times: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which conditions hold, for each feature of a text."""
    share = times / np.maximum(size, 1)
    return np.stack([*(times >= t for t in TIMES), *(share >= x for x in SHARES)], axis=1)


@dataclass
class Model:
    vocabulary: list[str]
    weights: np.ndarray  # of each feature and condition
    thresholds: np.ndarray  # increasing

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))

    def scores(self, piece: pa.RecordBatch) -> np.ndarray:
        """x . w of each text."""
        rows, names, times, size = document_features(piece)
        at = pc.index_in(names, pa.array(self.vocabulary, pa.large_string()))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        own = at >= 0
        each = (self.weights[at[own]] * met(times[own], size[own])).sum(axis=1)
        return np.bincount(rows[own], each, piece.num_rows)

    @classmethod
    def fit(cls, vocabulary: list[str], rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, steps: int = 800,
            decay: float = 2e-5) -> Model:
        """Adam on the likelihood of the grades, with columns = feature * LEVELS + condition; thresholds are a first one
        and steps that stay positive."""
        n = len(grades)
        share = [min(max(np.mean(grades > k), 0.5 / n), 1 - 0.5 / n) for k in range(GRADES)]
        start = -np.log(np.array(share) / (1 - np.array(share)))
        gaps = np.log(np.expm1(np.maximum(np.diff(start), 0.05)))
        w, t0 = np.zeros(len(vocabulary) * LEVELS), start[:1].copy()
        values = [w, t0, gaps]
        means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        at = np.arange(n)
        for step in range(1, steps + 1):
            score = np.bincount(rows, w[columns], n)
            thresholds = t0[0] + np.append(0, np.cumsum(np.logaddexp(0, gaps)))
            above = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -60, 60)))
            edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
            p = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
            slope = above * (1 - above)
            padded = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], axis=1)
            upper, lower = padded[at, grades] / p / n, padded[at, grades + 1] / p / n
            of_score = lower - upper  # of the negative log-likelihood
            of_threshold = np.bincount(grades, upper, GRADES + 1)[1:] - np.bincount(grades, lower, GRADES + 1)[:-1]
            grads = [
                np.bincount(columns, of_score[rows], len(w)) + decay * w, np.array([of_threshold.sum()]),
                np.cumsum(of_threshold[::-1])[::-1][1:] / (1 + np.exp(-gaps)),
            ]
            for value, grad, mean, square in zip(values, grads, means, squares, strict=True):
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                value -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(vocabulary, w.reshape(-1, LEVELS), t0[0] + np.append(0, np.cumsum(np.logaddexp(0, gaps))))


def fit(
    documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES
) -> Model | None:
    """A model of the labelled documents; None without labels of both kinds."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("label"))
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    known = about(known, "id", max_train).orderBy(order, "id").limit(max_train)
    known = stored(known, "toxicity-labels")  # at most max_train rows

    def task(batches):
        for batch in batches:
            for piece in slices(batch, "text", STEP):
                rows, names, times, size = document_features(piece)
                column = {c: piece[c].take(pa.array(rows)) for c in ("doc_id", "label")}
                yield pa.RecordBatch.from_arrays(
                    [column["doc_id"], column["label"], pc.cast(names, pa.string()), pa.array(times), pa.array(size)],
                    ["doc_id", "label", "feature", "times", "size"],
                )

    texts = documents.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    texts = stored(texts.select("doc_id", F.col("label").cast("int").alias("label"), "text"), "toxicity-train")
    found = texts.mapInArrow(task, "doc_id long, label int, feature string, times long, size long")
    docs = texts.select("doc_id", "label").distinct().orderBy("doc_id").limit(max_train).toArrow()
    label = docs["label"].to_numpy()
    toxic, clean = int((label == 1).sum()), int((label == 0).sum())
    if not toxic or not clean:
        return None
    share = F.col("times") / F.col("size")
    holds = [*(F.col("times") >= t for t in TIMES), *(share >= x for x in SHARES)]
    counts = found.groupBy("feature").agg(
        *(F.count_if(h & (F.col("label") == k)).alias(f"n{i}_{k}") for i, h in enumerate(holds) for k in (0, 1))
    )
    levels = F.explode(
        F.array(*(F.struct(F.lit(i).alias("level"), F.col(f"n{i}_1").alias("a"), F.col(f"n{i}_0").alias("b")) for i in range(LEVELS)))
    )
    counts = counts.filter(F.col("n0_0") + F.col("n0_1") >= MIN_DOCS).select("feature", levels.alias("c")).select("feature", "c.*")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (a * (clean - b) - b * (toxic - a)) ** 2 * (toxic + clean) / (
        (a + b) * F.greatest(F.lit(1.0), (toxic + clean) - (a + b)) * float(toxic) * float(clean)
    )
    chosen = (
        counts.filter((a + b >= MIN_DOCS) & (a * clean > b * toxic))  # what tells of toxicity; the rest is the base rate
        .withColumn("chi", chi)
        .filter(F.col("chi") >= MIN_CHI)
        .orderBy(F.desc("chi"), "feature", "level")
        .limit(max_features)
        .select("feature", "level")
        .toArrow()
    )
    names = sorted(set(chosen["feature"].to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    used = np.zeros((len(names), LEVELS), bool)
    for name, level in zip(chosen["feature"].to_pylist(), chosen["level"].to_pylist(), strict=True):
        used[place[name], level] = True
    vocabulary = documents.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    pairs = found.join(F.broadcast(vocabulary), "feature").select("doc_id", "feature", "times", "size").toArrow()
    at = pc.index_in(pairs["feature"], pa.array(names, pa.string())).to_numpy().astype(np.int64)
    ids = docs["doc_id"].to_numpy()
    holds = met(pairs["times"].to_numpy(), pairs["size"].to_numpy()) & used[at]
    pair, level = np.nonzero(holds)
    rows = np.searchsorted(ids, pairs["doc_id"].to_numpy())[pair]
    hits = np.bincount(rows, minlength=len(ids))
    cuts = np.quantile(hits[label == 1], [k / GRADES for k in range(1, GRADES)])
    grades = np.where(label == 1, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    return Model.fit(names, rows, at[pair] * LEVELS + level, grades)


def grade(documents: DataFrame, model: Model | None, limit: float = LIMIT) -> DataFrame:
    """Expected severity, most likely grade and verdict (P(grade > 0) of the limit or more) of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        model = shared.value
        for batch in batches:
            for piece in slices(batch, "text", STEP):
                n = piece.num_rows
                above = np.zeros((n, GRADES)) if model is None else model.above(model.scores(piece))
                edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
                toxic = above[:, 0] >= limit
                likely = (edges[:, :-1] - edges[:, 1:]).argmax(axis=1)
                likely = np.where(toxic, np.maximum(1, likely), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(likely), pa.array(toxic)],
                    ["doc_id", "severity", "p_toxic", "grade", "toxic"],
                )

    return documents.select("doc_id", "text").mapInArrow(task, SCORED)


def keep_clean(documents: DataFrame, model: Model | None, limit: float = LIMIT) -> DataFrame:
    """The documents that are not toxic, with all their columns; each row is judged by its own text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        model = shared.value
        for batch in batches:
            if model is None:
                yield batch
                continue
            for piece in slices(batch, "text", STEP):
                yield piece.filter(pa.array(model.above(model.scores(piece))[:, 0] < limit))

    return documents.mapInArrow(task, documents.schema)


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return grade(documents, fit(documents, labels))
