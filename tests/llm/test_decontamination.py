import re

from pyspark.sql import functions as F

from placespark.llm import decontamination as d

NAMES = r"[A-ZÄÖÜ][a-zäöüß]+"
ITEMS = [
    (1, "A train leaves Paris at 10 and runs 300 km north before it meets Anna and then Anna goes 20 km home"),
    (2, "ohne zahlen und namen steht hier eine frage die niemand je so gestellt hat bis heute"), (3, "too short"),
    (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, None), (2, "ohne zahlen und namen steht hier eine frage die niemand je so gestellt hat bis heute"),
]
PAD = " ".join(f"pad{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
RENAMED = "A train leaves Rome at 7 and runs 450 km north before it meets Berta and then Berta goes 33 km home"
BROKEN = RENAMED.replace("then Berta", "then Carla")
ROWS = [
    (0, ITEMS[0][1]), (1, f"{PAD} {ITEMS[0][1]}. {PAD}"), (2, f"{PAD}\n{RENAMED}"), (3, f"{PAD} {BROKEN}"), (4, PAD),
    (5, ITEMS[1][1] + " " + PAD + " " + ITEMS[1][1]), (6, "ohne zahlen und namen steht hier eine " + PAD), (7, None), (8, ""),
    (9, "5 6 7 8 9 10 11 12 13 14 15 16 17"), (10, RENAMED.upper()), (11, f"{PAD} {ITEMS[1][1]}"), (11, f"{PAD} {ITEMS[1][1]}"),
    (None, ITEMS[1][1]), (12, (PAD + " ") * 500 + RENAMED), (13, "x " + ITEMS[1][1][20:]),
]


def words(text):
    clean = "".join(c for c in text or "" if c.isalnum() or c.isspace()).split()
    out = []
    for w in clean:
        low = w.lower()
        if re.fullmatch(NAMES, w):
            out.append("@")
        elif re.fullmatch(r"\d+(st|nd|rd|th)?", low) or low in d.NUMBERS:
            out.append("#")
        elif re.fullmatch(rf"\d+({'|'.join(d.UNITS)})", low):
            out.append("#~")
        elif low in d.UNITS and out and out[-1] == "#":
            out.append("~")
        else:
            out.append(low)
    return [w.lower() for w in clean], out


def brute(rows, items):
    """All alignments of all documents and items; needs a window with enough literals that is equal."""
    leaks = {}
    for doc, text in set(rows):
        raw, mine = words(text)
        for item, question in set(items):
            item_raw, theirs = words(question)
            total = len(theirs) - d.WINDOW + 1
            for shift in range(-len(theirs), len(mine) + 1):
                equal = [k for k in range(len(theirs)) if 0 <= k + shift < len(mine) and mine[k + shift] == theirs[k]]
                same = set(equal)
                windows = [k for k in equal if all(k + j in same for j in range(d.WINDOW))]
                if total < 1 or len(windows) < 0.5 * total:
                    continue
                if not any(sum(w not in "#@#~" for w in theirs[k : k + d.WINDOW]) >= d.MIN_LITERALS for k in windows):
                    continue
                slots = {(item_raw[k], raw[k + shift]) for k in equal if theirs[k] in "#@#~"}
                if len({a for a, _ in slots}) == len({b for _, b in slots}) == len(slots):
                    found = (len(windows), -sum(a != b for a, b in slots), total)
                    leaks[doc, item] = max(leaks.get((doc, item), found), found)
    return {(doc, item, w, t, -c) for (doc, item), (w, c, t) in leaks.items()}


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' as doc_id", "1 as window_hash")


def test_against_brute_force(docs, spark):
    got = d.find_leaks(docs(ROWS), items(spark))
    assert set(map(tuple, got.collect())) == brute(ROWS, ITEMS)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert {(0, 1), (1, 1), (2, 1), (5, 2), (11, 2), (12, 1)} <= found and not {(3, 1), (4, 1), (6, 2)} & found


def test_documents_left(docs, spark):
    left = {r["doc_id"] for r in d.decontaminate(docs(ROWS), items(spark)).collect()}
    assert left == {None, 3, 4, 6, 7, 8, 9, 10} | ({13} - {doc for doc, *_ in brute(ROWS, ITEMS)})


def test_empty_tables(docs, spark):
    assert d.find_leaks(docs([]), items(spark)).count() == 0
    assert d.find_leaks(docs(ROWS), items(spark).limit(0)).count() == 0


def test_real_tables(spark):
    folder = "/root/testdata/sf0.001"
    documents, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(documents, benchmark).collect()}
    texts = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    whole = {(r["doc_id"], i) for r in documents.collect() for i, t in texts if t in (r["text"] or "")}
    assert whole <= got


def leaking(docs, spark, rows, questions):
    return {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(docs(rows), items(spark, questions)).collect()}


NAMES_ITEM = "Anna met Berta in Rome while Carl and Dora drove from Bonn to Paris with Emil and Fritz for 3 days"


def test_other_capitals(docs, spark):
    forms = [NAMES_ITEM.lower(), NAMES_ITEM.upper(), NAMES_ITEM.title(), NAMES_ITEM.lower().replace("3", "8")]
    got = leaking(docs, spark, [(i, f"{PAD} {t}") for i, t in enumerate(forms)] + [(9, PAD)], [(1, NAMES_ITEM)])
    assert {doc for doc, _ in got} == {0, 1, 2, 3} and got[0, 1]["windows"] == got[0, 1]["item_windows"]
    assert got[0, 1]["changed_slots"] == 0 and got[3, 1]["changed_slots"] == 1


def test_other_word_counts(docs, spark):
    item = "A train leaves New York at twenty five past noon and runs 450 km north before it meets the other train near the old mill"
    w = item.split()
    changed = item.replace("New York", "Paris").replace("twenty five", "7").replace("450 km", "300km")
    more = " ".join(w[:8] + ["just"] + w[8:16] + ["quietly"] + w[16:])
    apart = f"{' '.join(w[:9])} {(PAD + ' ') * 4} {' '.join(w[9:15])} {(PAD + ' ') * 4} {' '.join(w[15:])}"
    rows = [(0, changed), (1, f"{PAD} {changed} {PAD}"), (2, f"{PAD} {more}"), (3, apart)]
    got = leaking(docs, spark, rows, [(1, item)])
    assert set(got) == {(0, 1), (1, 1), (2, 1)} and got[0, 1]["windows"] == got[0, 1]["item_windows"] == len(w) - d.WINDOW + 1


def test_short_items_and_items_of_placeholders(docs, spark):
    short = ["who wrote the old red book", "who then sold the old red book", "name of the river", "7 8 9 2 4 4 1 0 3 5 7"]
    questions = list(enumerate(short, 1))
    rows = [(10 * i + at, f"{' '.join(PAD.split()[:at])} {t.upper()}, {PAD}") for i, t in questions for at in range(4)]
    rows += [(90, "name of a river"), (91, "7 8 9 2 4 4 1 0 3 5 8"), (92, "who wrote the new red book"), (93, short[2])]
    got = leaking(docs, spark, rows, questions)
    assert set(got) == {(10 * i + at, i) for i, _ in questions for at in range(4)} | {(93, 3)}
    assert all(r["windows"] == r["item_windows"] == max(1, len(short[i - 1].split()) - d.WINDOW + 1) for (_, i), r in got.items())


def test_slots_of_runs(docs, spark):
    item = "Anna buys 5 red apples and 3 green pears at the old market in Rome and then walks home to the small house where Berta waits for Anna"
    first = "Anna buys 5 red apples and 3 green pears at the old market in Rome and then walks home to the small"
    renamed = first.replace("Anna", "Emma").replace("Rome", "Paris")
    rows = [
        (0, f"{first} cat but Rome sees this Berta"), (1, f"{first} house where Carla waits for Dora"), (2, f"{renamed} cat but Emma sees for Berta"),
        (3, item.replace("5", "4").replace("3", "4").replace("Anna", "Emma").replace("Berta", "Carla").replace("Rome", "Bonn")),
        (4, item.replace("5", "4").replace("Anna", "Emma", 1).replace("Rome", "Bonn").replace("Berta", "Bonn").replace("apples", "plums")),
        (5, "Anna 5 Berta 6 Carla 7 Dora 8 " + item.split("old")[0]),
    ]
    assert {doc for doc, _ in leaking(docs, spark, rows, [(1, item)])} == {0, 1, 2, 3}


def test_long_runs_of_placeholders(docs, spark):
    names, numbers = " ".join(["Anna", "Berta"] * 30_000), " ".join(map(str, range(60_000)))
    units = "7 " + "km " * 60_000
    rows = [(i, f"{t} {ITEMS[1][1]} {t}") for i, t in enumerate((names, numbers, units))] + [(3, f"{names} {numbers}")]
    assert set(leaking(docs, spark, rows, ITEMS[1:2])) == {(0, 2), (1, 2), (2, 2)}


def test_collapsed_templates(spark):
    texts = {"# # # a @ @ b": "# a @ b", "# @ @ #": "# @ #", "#\n #\t#": "#", "~ ~ a": "~ a", "a # b #": "a # b #", "# #x # #": "# #x #", "# # #x": "# #x", "": ""}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", d._collapsed(F.col("t"))).collect()
    assert dict(map(tuple, got)) == texts
