"""Mixture-controlled packing of documents into fixed windows.

Deficit round-robin over source queues: in each window every queue is served its share of the window's tokens, and
what a share lacks or exceeds of a whole token is carried on as the queue's deficit. As documents may be cut, the
number of tokens that a queue has been served before any window follows from the shares alone, so every task starts
with the deficits that a run from the first window on would have left, and no task waits for another.

- Queues: one for each source that gets at least one token a window; all smaller sources share one. A window thus has
  at most ``window`` queues. Within a queue documents follow each other by stored part and row.
- ``target`` (source -> weight) sets the proportions; sources it does not name share the rest queue, of weight ``rest``.
  None takes the corpus's own, so that all queues end together. Otherwise, when a queue runs dry, those that are left
  are served by their weights.
- Nothing is dropped: each token lies in one piece. Only the last window is not full.

Null text counts as empty (a document has its end token at least); a null source is a source of its own; rows that
repeat are packed each; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.common import as_array, byte_level_pieces, coded, slices, stored, strings

WINDOW = 2048
END = 1
#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


TOKENS = "doc_id long, source string, part int, source_start long, doc_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " source string"
)
#: Spaces that are not between two other characters; only texts without them are cut into words.
_LOOSE = r"^ | $|[\s\v\x1c-\x1f\x85\pZ] | [\s\v\x1c-\x1f\x85\p{Zl}\p{Zp}\p{Zs}]"


def _added_pattern(token: dict) -> str:
    """An added token, with the spaces that it takes along and the words that it must not be part of."""
    body = "(" + re.escape(token["content"]) + ")"
    if token.get("single_word"):
        body = rf"(?<!\w){body}(?!\w)"
    return (r"\s*" if token.get("lstrip") else "") + body + (r"\s*" if token.get("rstrip") else "")


class Encoder:
    """Ids of texts by a byte-level BPE file (JSON), distinct words once.

    Such a tokenizer never joins a character to a space after it, so a text with single spaces only is the sequence of
    its space-led words. Other texts are encoded whole. In these files the ids are the ranks of the merges, which is
    checked here, so the ranks are all that the encoder needs. Strings of the file's added tokens get those tokens' ids, as
    the file's own library does by default; with ``encode_special_tokens`` they are ordinary text.
    """

    def __init__(self, path: str, encode_special_tokens: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        if content.get("normalizer"):
            raise ValueError(f"{path}: texts would be normalised before they are encoded")
        added = [t for t in content.get("added_tokens", []) if not (encode_special_tokens and t["special"])]
        self._added = {t["content"]: t["id"] for t in added}
        self._cut = re.compile("|".join(map(_added_pattern, sorted(added, key=lambda t: -len(t["content"]))))) if added else None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merged = [model["vocab"][a + b] for a, b in pairs]
        if model["type"] != "BPE" or any(x >= y for x, y in pairwise(merged)):
            raise ValueError(f"{path}: not a byte-level BPE whose ids are ranks")
        ranks = dict(byte_level_pieces(path))
        self._encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> list[int]:
        """Ids of a text, cut at added tokens first."""
        out, at = [], 0
        for found in self._cut.finditer(text) if self._cut else ():
            out += self._encode(text[at : found.start()])
            out.append(self._added[found[found.lastindex]])
            at = found.end()
        return out + self._encode(text[at:])

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        loose = pc.match_substring_regex(texts, _LOOSE)
        for token in self._added:
            loose = pc.or_(loose, pc.match_substring(texts, token))
        lists = pc.split_pattern(pc.if_else(loose, "", texts), " ")
        ends = pc.cumulative_sum(pc.list_value_length(lists)).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        first = np.zeros(len(flat), bool)
        first[np.append(0, ends[:-1])] = True
        led = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(nothing, flat, space))
        codes, distinct = coded(as_array(led))
        pieces = [self._encode(w) for w in distinct.to_pylist()]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.append(0, np.cumsum(lengths))[:-1]
        all_ids = np.fromiter(chain.from_iterable(pieces), "<u4", int(lengths.sum()))
        begin = 0
        for whole, end, text in zip(loose.to_pylist(), ends.tolist(), texts, strict=True):
            if whole:
                yield np.array(self._whole(text.as_py()), "<u4")
            else:
                own = codes[begin:end]
                n = lengths[own]
                at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield all_ids[at]
            begin = end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokens(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Documents as ids with END added, with their place in their source within the task's part."""

    def task(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        at: dict[str | None, int] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, starts, lengths = [], [], []
                sources = piece["source"].to_pylist()
                for source, found in zip(sources, encode.ids(strings(piece["text"])), strict=True):
                    start = at.get(source, 0)
                    ids.append(found.tobytes() + END.to_bytes(4, "little"))
                    starts.append(start)
                    lengths.append(len(found) + 1)
                    at[source] = start + len(found) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"], piece["source"], pa.array([part] * len(ids), pa.int32()),
                        pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "source", "part", "source_start", "doc_tokens", "ids"],
                )

    return documents.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(task, TOKENS)


class Schedule:
    """How many tokens each queue has been served before each window.

    phases: (tokens before the phase, tokens served to each queue before it, tokens of each queue in it).
    """

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.window, self.total = window, sum(totals)
        self.windows = -(-self.total // window)
        self.starts: list[int] = []
        self.phases: list[tuple[int, list[int], list[int]]] = []
        left, served, begin = list(totals), [0] * len(totals), 0
        while any(left):
            live = [i for i, n in enumerate(left) if n]
            dry = min(live, key=lambda i: (left[i] * 10**6 // weights[i], i))
            part = [min(n, n and weights[i] * left[dry] // weights[dry]) for i, n in enumerate(left)]
            part[dry] = left[dry]
            bounds = [0]
            for n in part:
                bounds.append(bounds[-1] + n)
            self.starts.append(begin)
            self.phases.append((bounds[-1], list(served), bounds))
            served = [a + b for a, b in zip(served, part, strict=True)]
            left = [a - b for a, b in zip(left, part, strict=True)]
            begin += bounds[-1]

    def _shares(self, window: int, bounds_before: int) -> tuple[int, list[int], list[int], int]:
        n = min(window * self.window, self.total)
        p = max(0, bisect_right(self.starts, n) - 1)
        length, served, bounds = self.phases[p]
        return n - self.starts[p], served, bounds, length

    def before(self, queue: int, window: int) -> int:
        """Tokens that the queue was served before the window; its deficit is what its share lacks of that."""
        n, served, bounds, length = self._shares(window, queue)
        return served[queue] + n * bounds[queue + 1] // length - n * bounds[queue] // length

    def ahead(self, queue: int, window: int) -> int:
        """Tokens that queues of smaller number were served before the window."""
        n, served, bounds, length = self._shares(window, queue)
        return sum(served[:queue]) + n * bounds[queue] // length


def pack(
    documents: DataFrame, tokenizer: str, window: int = WINDOW, target: dict[str, float] | None = None,
    rest: float = 0.0,
) -> DataFrame:
    """Pieces of documents with their sequence and the offset there."""
    spark = documents.sparkSession
    docs = stored(tokens(documents, tokenizer), "packing-tokens")
    by_part = stored(docs.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n")), "packing-parts")
    by_source = by_part.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_part.agg(F.sum("n")).first()[0] or 0
    if target is None:
        large = by_source.filter(F.col("n") * window >= total).orderBy("source").collect()  # at most `window` rows
    else:
        large = by_source.filter(F.col("source").isin(list(target))).orderBy("source").collect()
    named = {row["source"]: i for i, row in enumerate(large)}
    totals = [row["n"] for row in large]
    over = total - sum(totals)
    rest_queue = len(totals)
    if over and target is None and over * window < total:
        rest_queue = min(range(len(totals)), key=totals.__getitem__)
        totals[rest_queue] += over
    elif over:
        totals.append(over)
    if target is None:
        weights = list(totals)
    else:
        share = [target[row["source"]] for row in large] + [rest] * (len(totals) - len(large))
        weights = [max(1, round(x * 10**9)) for x in share]
    schedule = Schedule(totals, weights, window)

    mapping = spark.createDataFrame(
        [(source, queue) for source, queue in named.items()], "source string, queue int"
    )
    queued = by_part.join(mapping, by_part["source"].eqNullSafe(mapping["source"]), "left").select(
        by_part["source"], "part", "n", F.coalesce("queue", F.lit(rest_queue)).alias("queue")
    )
    queued = stored(queued, "packing-queued")  # sources of a part follow each other, so running sums are two short ones
    inner = F.sum("n").over(Window.partitionBy("queue", "part").orderBy("source")) - F.col("n")
    parts = queued.groupBy("queue", "part").agg(F.sum("n").alias("of_part"))
    outer = F.sum("of_part").over(Window.partitionBy("queue").orderBy("part")) - F.col("of_part")
    parts = parts.select("queue", "part", outer.alias("before"))
    places = queued.withColumn("inner", inner).join(parts, ["queue", "part"])
    places = stored(places.select("source", "part", "queue", (F.col("before") + F.col("inner")).alias("base")), "packing-places")

    def task(batches):
        at: dict[int, int] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            columns = (batch[c].to_pylist() for c in ("doc_id", "source", "queue", "base", "source_start"))
            for doc, source, queue, base, start, ids in zip(*columns, batch["ids"], strict=True):
                data = ids.as_buffer()
                n = len(data) // 4
                begin, done = base + start, 0
                w = at.get(queue, 0)
                if schedule.before(queue, w) > begin:
                    w = 0
                if schedule.before(queue, w + 1) <= begin:
                    low = range(w, schedule.windows + 1)
                    w += bisect_right(low, begin, key=lambda k, q=queue: schedule.before(q, k)) - 1
                view = memoryview(data)
                while done < n:
                    first, last = schedule.before(queue, w), schedule.before(queue, w + 1)
                    length = min(n - done, last - begin - done)
                    if length > 0:
                        offset = schedule.ahead(queue, w + 1) - schedule.ahead(queue, w) + begin + done - first
                        crc = zlib.crc32(view[4 * done : 4 * (done + length)])
                        for values, value in zip(out, (doc, done, length, crc, n, w, offset, source), strict=True):
                            values.append(value)
                        done += length
                    if done < n:
                        w += 1
                at[queue] = w
            kinds = [pa.int64()] * 7 + [pa.string()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    joined = docs.join(
        places, (docs["part"] == places["part"]) & docs["source"].eqNullSafe(places["source"])
    ).select("doc_id", docs["source"], "queue", "base", "source_start", "ids")
    return joined.mapInArrow(task, PIECES)
