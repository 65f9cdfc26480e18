import re
from collections import Counter

import duckdb
import pandas as pd

import check
from placespark.llm import quality_rules

COMMON = "Home  page 12 | Login"
LONG = " ".join("w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(70))
ROWS = [(i, f"{COMMON.replace('12', str(i))}\n{LONG} {i}\nhome page 7 | LOGIN", "hot") for i in range(30)]
ROWS += [(100 + i, f"{COMMON}\n{COMMON}\nfew", "hot") for i in range(3)] + [(200, COMMON + "\n" + LONG, "other")]
ROWS += [
    (300, None), (301, ""), (302, " \n \t\n"), (303, "a b c a b c a b c"), (304, "one two"), (305, LONG + "\n" + LONG),
    (306, "word\n" * 3000, None), (307, "long " * 30000), (308, LONG), (308, LONG), (None, LONG), (309, "ä # * é\n\né"),
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    counts = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))
    return *counts, len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_base_counts(docs):
    got = quality_rules.judge(docs(ROWS)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *base(r[1])) for r in ROWS)
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_same_as_sql(docs):
    df = docs(ROWS, extra=False)
    got = quality_rules.judge(df, 3, 0.01, 0.2).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(df.collect(), columns=df.columns))
    want = con.execute(quality_rules.oracle(3, 0.01, 0.2)).fetch_df()
    assert check.compare(got, want).startswith("ok")
    # digits are no difference, so the long line of all 30 documents is common as well as the last one
    assert got.set_index("doc_id").loc[5, "removed_lines"] == 2 and not got["kept"].all()


def test_empty(docs):
    assert quality_rules.judge(docs([])).count() == 0
