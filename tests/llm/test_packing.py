import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from placespark.llm import packing
from placespark.llm.catalog import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "one two  three", "tab\tand \n newline \n", " lead", "trail ", "x  y z", "don't stop, it's",
    "same words", "same words", "wörter für  alle\n\nzeilen", "123 456,789 " * 900, "long " * 5000, "z" * 9000,
]
SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b <|endoftext|", "one two <|endoftext|>"]


def checked(rows, pieces, window):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == {r[0] for r in rows}
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            data = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p["length"]])
            assert p["ids_crc32"] == zlib.crc32(data)
            at += p["length"]
        assert at == len(ids)
    full = 0
    for number, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        full += at == window
        assert at == window or number == max(by_sequence)
    assert set(by_sequence) == set(range(len(by_sequence)))
    return by_sequence


@pytest.mark.parametrize("window", [16, 2048])
def test_round_trip_and_shares(docs, window):
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(TEXTS * 3, [None, "a", "b", "hot", "hot"] * 12))]
    pieces = packing.pack(docs(rows), PATH, window).collect()
    sequences = checked(rows, pieces, window)
    totals = defaultdict(int)
    for p in pieces:
        totals[p["source"]] += p["length"]
    everything = sum(totals.values())
    served = defaultdict(int)
    for n, number in enumerate(sorted(sequences)[:-1], 1):
        for p in sequences[number]:
            served[p["source"]] += p["length"]
        for source, total in totals.items():
            if total * window >= everything:
                assert abs(served[source] - n * window * total / everything) <= 2


def test_special_tokens(docs):
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(SPECIAL * 2)]
    checked(rows, packing.pack(docs(rows), PATH, 16).collect(), 16)
    assert [x.tolist() for x in packing.Encoder(PATH).ids(pa.array(SPECIAL[:1], pa.large_string()))] == [[31373, 220, 50256, 995]]


def test_special_tokens_as_text():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    texts = pa.array([t or "" for t in TEXTS + SPECIAL], pa.large_string())
    got = packing.Encoder(PATH, encode_special_tokens=True).ids(texts)
    assert [x.tolist() for x in got] == [x.ids for x in tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]


def test_target_then_the_rest(docs):
    rows = [(i, "word " * 300, "ab"[i % 4 == 0]) for i in range(40)] + [(99, "more " * 40, "c")]
    pieces = packing.pack(docs(rows), PATH, 64, {"a": 1.0, "b": 3.0}, rest=0.1).collect()
    sequences = checked(rows, pieces, 64)
    for number in range(10):
        of_b = sum(p["length"] for p in sequences[number] if p["source"] == "b")
        assert abs(of_b - 64 * 3 / 4.1) <= 2


def test_schedule_of_many_small_sources(docs):
    rows = [(i, "w", f"s{i}") for i in range(300)] + [(1000, "large " * 2000, "hot")]
    checked(rows, packing.pack(docs(rows), PATH, 8).collect(), 8)


def test_empty_and_repeated(docs):
    assert packing.pack(docs([]), PATH).count() == 0
    pieces = packing.pack(docs([(1, "twice"), (1, "twice"), (None, "id")]), PATH).collect()
    assert len(pieces) == 3
