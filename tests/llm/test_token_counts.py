import re

from hypothesis import given, settings
from hypothesis import strategies as st

from placespark.llm import token_counts
from placespark.llm.catalog import tokenizer_path
from placespark.llm.token_counts import Automaton

PATH = tokenizer_path("byte_bpe_50k.json")


def greedy(word: bytes, vocabulary: set[bytes]) -> int:
    """Longest match from the left; 1 where it gets stuck."""
    n, longest = 0, max(map(len, vocabulary))
    while word:
        for k in range(min(longest, len(word)), 0, -1):
            if word[:k] in vocabulary:
                word, n = word[k:], n + 1
                break
        else:
            return 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc ", min_size=1, max_size=5), max_size=25), st.lists(st.text("abcd", min_size=1), max_size=9))
def test_as_greedy(vocabulary, words):
    import pyarrow as pa

    pieces = {v.encode() for v in vocabulary} | {b" "}
    found = Automaton(list(pieces)).counts(pa.array(words, pa.large_string()))
    assert found.tolist() == [greedy(b" " + w.encode(), pieces) for w in words]


def test_documents(docs, spark):
    vocabulary = set(token_counts.byte_level_vocabulary(PATH))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "the same"), (4, "the same"), (5, "Wörter, für"), (6, "x" * 5000)]
    rows += [(7, "unbelievable tokenization " * 4000), (None, "no id"), (8, "ab cd")]
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(20).collect()
    rows += [(100 + r["doc_id"], r["text"]) for r in sample]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs(rows), PATH).collect()}
    for doc, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        each = [greedy(b" " + w, vocabulary) for w in words]
        assert got[doc]["n_words"] == len(words)
        assert got[doc]["n_tokens"] == sum(each)
        assert got[doc]["max_word_tokens"] == max(each, default=0)


def test_empty(docs):
    assert token_counts.count_tokens(docs([]), PATH).count() == 0
