"""Counts of word-piece tokens by a linear longest-match automaton, without building the pieces.

The vocabulary is a trie over bytes. Each node has a failure link and the number of tokens that are popped when it is
followed: what greedy longest-match would cut off the front of the node's string, and the node of what is left. A word
is read byte by byte: each step goes down, or pops tokens along failure links until it can. All words of a batch step
together as numpy arrays, equal words once. Words longer than ``LONG`` bytes step alone.

A word is a run without space or tab to carriage return, read with a leading space as byte-level vocabularies write
the start of a word. A word that the vocabulary cannot spell is one (unknown) token. Null text and text without words
have no words and no tokens; rows are independent, so repeated rows and ties have their own counts; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placespark.llm.common import byte_level_pieces, coded, raw, slices, strings, words

LONG = 96
COUNTS = "doc_id long, n_words long, n_tokens long, max_word_tokens int"


def byte_level_vocabulary(path: str) -> list[bytes]:
    return [piece for piece, _ in byte_level_pieces(path)]


class Automaton:
    """goto[node, byte] (-1: none), fail[node] (-1: the word cannot be spelled), popped[node]."""

    def __init__(self, vocabulary: list[bytes]):
        pieces = sorted({p for p in vocabulary if p})
        parents, labels, depths, final = [-1], [0], [0], [False]
        path: list[int] = [0]
        last = b""
        for piece in pieces:  # sorted, so what a piece shares with the one before is on the path
            shared = 0
            while shared < min(len(last), len(piece)) and last[shared] == piece[shared]:
                shared += 1
            del path[shared + 1 :]
            for byte in piece[shared:]:
                parents.append(path[-1])
                labels.append(byte)
                depths.append(len(path))
                final.append(False)
                path.append(len(parents) - 1)
            final[path[-1]] = True
            last = piece
        n = len(parents)
        self.goto = np.full((n, 256), -1, np.int32)
        self.goto[parents[1:], labels[1:]] = np.arange(1, n)
        self.fail, self.popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        parent, label, depth, whole = (np.array(x) for x in (parents, labels, depths, final))
        for level in range(1, int(depth.max()) + 1):  # shorter strings first
            nodes = np.flatnonzero(depth == level)
            done = nodes[whole[nodes]]
            self.fail[done], self.popped[done] = 0, 1
            rest = nodes[~whole[nodes]]
            state, count = self.step(self.fail[parent[rest]], label[rest], self.popped[parent[rest]])
            self.fail[rest], self.popped[rest] = state, np.where(state < 0, 0, count)

    def step(self, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one byte in each state; a state of -1 stays."""
        count = count.copy()
        after = np.where(state >= 0, self.goto[state, byte], -1)
        open_ = np.flatnonzero((after < 0) & (state >= 0))
        state = state.copy()
        while len(open_):
            at = state[open_]
            count[open_] += self.popped[at]
            state[open_] = np.where(at == 0, -1, self.fail[at])  # at the root no piece begins with the byte
            open_ = open_[state[open_] >= 0]
            after[open_] = self.goto[state[open_], byte[open_]]
            open_ = open_[after[open_] < 0]
        return after, count

    def close(self, state: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Tokens of words that end in these states."""
        state, count = state.copy(), count.copy()
        open_ = np.flatnonzero(state > 0)
        while len(open_):
            count[open_] += self.popped[state[open_]]
            state[open_] = self.fail[state[open_]]
            open_ = open_[state[open_] > 0]
        return np.where(state < 0, 1, count)

    def counts(self, values: pa.Array) -> np.ndarray:
        """Tokens of each word."""
        offsets, data = raw(values)
        n = len(values)
        lengths = np.diff(offsets)
        first = int(self.goto[0, 0x20])
        state, count = np.full(n, first, np.int32), np.zeros(n, np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] <= LONG]
        ends = np.searchsorted(-lengths[order], -np.arange(1, LONG + 1), side="right")
        for i, end in enumerate(ends):
            if not end:
                break
            own = order[:end]
            state[own], count[own] = self.step(state[own], data[offsets[own] + i], count[own])
        for w in np.flatnonzero(lengths > LONG):
            state[w], count[w] = self._long(data[offsets[w] : offsets[w + 1]].tobytes(), first)
        return self.close(state, count)

    def _long(self, word: bytes, at: int) -> tuple[int, int]:
        goto, fail, popped, count = self.goto, self.fail, self.popped, 0
        for byte in word:
            after = goto[at, byte] if at >= 0 else -1
            while after < 0 and at >= 0:
                count += int(popped[at])
                at = int(fail[at]) if at else -1
                after = goto[at, byte] if at >= 0 else -1
            at = int(after)
        return at, count


_AUTOMATA: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = Automaton(byte_level_vocabulary(path))
    return _AUTOMATA[path]


def count_tokens(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Words, tokens and the most tokens of a word, for each document. The file must be where executors can read it."""

    def task(batches):
        machine = automaton(vocabulary)
        for batch in batches:
            for piece in slices(batch, "text"):
                rows, found = words(strings(piece["text"]))
                codes, distinct = coded(found)
                tokens = machine.counts(distinct)[codes] if len(distinct) else np.zeros(0, np.int64)
                n = piece.num_rows
                most = np.zeros(n, np.int32)
                np.maximum.at(most, rows, tokens.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["doc_id"], pa.array(np.bincount(rows, minlength=n), pa.int64()),
                        pa.array(np.bincount(rows, tokens, n).astype(np.int64)), pa.array(most),
                    ],
                    ["doc_id", "n_words", "n_tokens", "max_word_tokens"],
                )

    return documents.select("doc_id", "text").mapInArrow(task, COUNTS)
