"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so a question asked with other numbers or names keeps its template.
All windows of ``WINDOW`` template words of the benchmark are hash-joined with all windows of each document; each pair
of document and item found is aligned at its offsets and compared word by word. A leak must cover ``min_share`` of
the item's windows within a stretch of at most four times the item, whatever words are put in or left out between the
parts. Only runs of equal template words with consistent slots count: within a run, equal values stay equal and different
names stay different (new numbers may happen to be equal). What is there word for word counts whatever surrounds it.

- Words are cleaned of everything but letters and digits. Names: words of one capital and small letters. Windows are
  joined a second time in small letters, with names as they stand, so copies in other capitals are found; names that are
  changed as well are not known as names there.
- Placeholders of one kind in a row count as one, so ``New York`` has the template of ``Paris`` and ``twenty five`` that
  of ``7``; ``450km`` is read as ``450 km``. Windows are counted in words of the item as it stands.
- Windows of fewer than ``MIN_LITERALS`` words that are no placeholders are not joined, so lists of numbers find nothing.
- Items without a window that is joined (fewer words than a window, or hardly any but numbers and names) are leaked by
  documents that have all their words as they stand, in any capitals. An item of one word is leaked by all that have it.
- Null or empty text has no windows. Rows that repeat count once. A null
  doc_id is reported as such. Without rows in either table there are no leaks. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.common import stored

WINDOW = 6
MIN_LITERALS = 3
MIN_SHARE = 0.5
#: Flags by which words that the benchmark does not have are told.
CELLS = 1 << 16
#: Units and number words.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound"
    " pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days"
    " week weeks month months year years dollar dollars cent cents euro euros usd eur degree degrees percent mph kmh"
    " meter meters metre metres kilometer kilometers kilometre kilometres"
).split()
NUMBERS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    " nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice"
).split()
NUMBER, NAME, UNIT = "#", "@", "~"
#: What windows are made of: words with placeholders for names, or in small letters without them.
NAMED, FOLDED = FORMS = ("named", "folded")
#: The words as they stand in small letters, for items that have no window to be joined.
EXACT = "exact"


def cleaned(text: Column) -> Column:
    """Letters, digits and white space; a unit behind its number is a word of its own."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\s]+", "")
    return F.regexp_replace(clean, rf"(?<!\S)(\p{{N}}+)((?i:{'|'.join(UNITS)}))(?!\S)", "$1 $2")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def template(clean: Column, names: bool = True) -> Column:
    """The cleaned text in small letters with placeholders in place of words, as many words as before."""
    units = "|".join(UNITS)
    out = F.lower(F.regexp_replace(clean, r"(?<!\S)\p{Lu}\p{Ll}+(?!\S)", NAME) if names else clean)
    out = F.regexp_replace(out, rf"(?<!\S)(?:\p{{N}}+(?:st|nd|rd|th)?|{'|'.join(NUMBERS)})(?!\S)", NUMBER)
    return F.regexp_replace(out, rf"(?<!\S){NUMBER}(\s+)(?:{units})(?!\S)", rf"{NUMBER}$1{UNIT}")


def _placeholder(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def _collapsed(words: Column) -> Column:
    """A template with one placeholder for several equal ones in a row.

    The group is possessive: Java goes through it in a loop then, and otherwise one call deeper for each word of the row."""
    return F.regexp_replace(words, rf"(?<!\S)([{NUMBER}{NAME}{UNIT}])(?:\s+\1(?!\S))++", "$1")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _case(form: Column, value) -> Column:
    """value(f) for the form f of the row."""
    return F.coalesce(*[F.when(form == f, value(f)) for f in (*FORMS, EXACT)])


def _form_words(clean: Column, form: str) -> Column:
    if form == EXACT:
        return split_words(F.lower(clean))
    return split_words(_collapsed(template(clean, form == NAMED)))


def _tokens(clean: Column, form: str) -> Column:
    """Words of a form: token t, what stands there as v, its first and last place a and b among the words."""

    def built(s: Column, places: Column) -> Column:
        def token(a: Column, i: Column) -> Column:
            b = F.coalesce(F.get(places, i + 1) - 1, F.size(s["words"]))
            v = F.array_join(F.slice(s["raw"], a, b - a + 1), " ")
            return F.struct(F.get(s["words"], a - 1).alias("t"), v.alias("v"), a.alias("a"), b.alias("b"))

        return F.transform(places, token)

    def firsts(s: Column) -> Column:
        words = s["words"]
        return F.filter(
            F.transform(words, lambda w, i: F.when(~(_placeholder(w) & (i > 0) & (F.get(words, i - 1) == w)), i + 1)),
            lambda i: i.isNotNull(),
        )

    if form == EXACT:
        return F.transform(
            _form_words(clean, form), lambda w, i: F.struct(w.alias("t"), w.alias("v"), (i + 1).alias("a"), (i + 1).alias("b"))
        )
    return _let(
        F.struct(split_words(F.lower(clean)).alias("raw"), split_words(template(clean, form == NAMED)).alias("words")),
        lambda s: _let(firsts(s), lambda places: built(s, places)),
    )


def _marks(words: DataFrame) -> Column:
    """A constant of ``CELLS`` flags, set for the hash of each word; with many words all are set, and nothing is told apart."""
    cells = {r["cell"] for r in words.select(F.pmod(F.xxhash64("word"), F.lit(CELLS)).alias("cell")).distinct().collect()}  # CELLS at most
    text = ",".join(str(i in cells).lower() for i in range(CELLS))  # one constant for the optimizer, not CELLS of them
    return F.split(F.lit(text), ",").cast("array<boolean>")


def _windows(words: Column, form: str, marks: Column, length: int = WINDOW) -> Column:
    """Hashes of the windows of words that the benchmark has, with their first place; others cannot be joined."""
    last = F.size(words) - (length - 1)

    def full(flags: Column, i: Column) -> Column:
        out = F.get(flags, i + (length - 2))
        for k in reversed(range(length - 1)):
            out = out & F.get(flags, i + (k - 1))
        return out

    def hashed(flags: Column) -> Column:
        return F.transform(
            F.filter(F.when(last >= 1, F.sequence(F.lit(1), last)), lambda i: full(flags, i)),
            lambda i: F.struct(F.lit(form).alias("form"), i.alias("at"), F.xxhash64(F.slice(words, i, length)).alias("window_hash")),
        )

    found = _let(F.transform(words, lambda w: F.get(marks, F.pmod(F.xxhash64(w), F.lit(CELLS)).cast("int"))), hashed)
    return F.coalesce(found, F.array().cast("array<struct<form:string,at:int,window_hash:bigint>>"))


def _runs(places: Column) -> Column:
    """Runs of WINDOW increasing places or more without a gap, by their first and last place."""
    starts = F.transform(  # WINDOW places in a row end WINDOW - 1 higher
        F.filter(
            F.transform(places, lambda k, i: F.struct(k.alias("k"), F.get(places, i + (WINDOW - 1)).alias("end"))),
            lambda x: x["end"] == x["k"] + (WINDOW - 1),
        ),
        lambda x: x["k"],
    )
    return _let(
        starts,
        lambda w: F.zip_with(
            F.filter(w, lambda k, i: (i == 0) | (F.get(w, i - 1) != k - 1)),
            F.filter(w, lambda k, i: F.coalesce(F.get(w, i + 1) != k + 1, F.lit(True))),
            lambda x, y: F.struct(x.alias("first"), (y + (WINDOW - 1)).alias("last")),
        ),
    )


def _leaks(documents: DataFrame, benchmark: DataFrame, min_share: float) -> DataFrame:
    """(doc_id, text_hash, item_id, best) for each text and item that it leaks, for the stretch that has most of it."""
    clean = cleaned(F.col("text"))
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), _tokens(clean, f).alias("asked")) for f in (*FORMS, EXACT)]))
    items = benchmark.select("item_id", "text").distinct().select("item_id", F.size(split_words(clean)).alias("n"), forms.alias("f"))
    items = items.select("item_id", "n", "f.form", "f.asked").filter(F.col("n") >= 1).distinct()
    items = items.select("*", F.transform("asked", lambda x: x["t"]).alias("words"))
    places = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    window = F.slice("words", F.col("item_at"), WINDOW)
    seeds = stored(
        items.filter((F.col("form") != EXACT) & (F.size("words") >= WINDOW))
        .select("item_id", "form", "words", F.explode(places).alias("item_at"))
        .filter(F.size(F.filter(window, lambda w: ~_placeholder(w))) >= MIN_LITERALS)
        .select("item_id", "form", "item_at", F.xxhash64(window).alias("window_hash")),
        "leaks-seeds",
    )
    first = F.slice("words", 1, WINDOW)
    exact = stored(
        items.filter(F.col("form") == EXACT)
        .join(seeds.select("item_id").distinct(), "item_id", "left_anti")
        .select("item_id", "form", F.lit(1).alias("item_at"), F.xxhash64(first).alias("window_hash"), F.size(first).alias("length")),
        "leaks-exact",
    )
    lengths = sorted(r["length"] for r in exact.select("length").distinct().collect())  # WINDOW at most
    marks = _marks(items.select(F.explode("words").alias("word")).distinct())
    sizes = items.select("item_id", "form", F.size("words").alias("length")).distinct()
    seeds = stored(seeds.unionByName(exact.drop("length")).join(sizes, ["item_id", "form"]), "leaks-windows")

    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).filter(F.col("text").isNotNull())
    used = FORMS + ((EXACT,) if lengths else ())
    windows = [_windows(F.col(f), f, marks) for f in FORMS] + [_windows(F.col(EXACT), EXACT, marks, k) for k in lengths]
    probes = (
        texts.select("doc_id", "text_hash", *[_form_words(clean, f).alias(f) for f in used])
        .select("doc_id", "text_hash", F.explode(F.concat(*windows)).alias("w"))
        .select("doc_id", "text_hash", "w.form", "w.at", "w.window_hash")
    )
    met = probes.join(seeds, ["form", "window_hash"]).select(
        F.col("doc_id").alias("id"), F.col("text_hash").alias("same"), "item_id", "form", (F.col("at") - F.col("item_at")).alias("shift"), "length"
    )
    met = stored(met.distinct(), "leaks-met")
    met = met.groupBy("id", "same").agg(F.collect_list(F.struct("item_id", "form", "shift", "length")).alias("hits"))
    found = texts.join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("same")))

    def cut(hit: Column) -> Column:
        """A hit with the tokens that the item may stand at, so that no hit carries the whole document."""
        base = F.greatest(F.lit(1), hit["shift"] + 1)
        own = _case(hit["form"], lambda f: F.slice(F.col(f), base, hit["length"]))
        return F.struct(hit["item_id"].alias("item_id"), hit["form"].alias("form"), hit["shift"].alias("shift"), base.alias("base"), own.alias("tokens"))
    found = (
        found.select("doc_id", "text_hash", "hits", *[_tokens(clean, f).alias(f) for f in (*FORMS, EXACT)])
        .select("doc_id", "text_hash", F.explode(F.transform("hits", cut)).alias("hit"))
        .select("doc_id", "text_hash", "hit.*")
        .join(items, ["item_id", "form"])
    )

    def there(k: Column) -> Column:
        return F.get("tokens", k + F.col("shift") - F.col("base"))

    def asked(k: Column) -> Column:
        return F.get("asked", k - 1)

    equal = F.filter(
        F.sequence(F.lit(1), F.size("asked")),
        lambda k: F.when(k + F.col("shift") >= 1, (there(k)["t"] == asked(k)["t"]) | (there(k)["v"] == asked(k)["v"])),
    )
    def inner(run: Column) -> Column:
        """The run without placeholders at its ends, which may be another text's."""
        words = F.filter(F.sequence(run["first"], run["last"]), lambda k: ~_placeholder(asked(k)["t"]))
        return F.struct(F.get(words, 0).alias("first"), F.get(words, F.size(words) - 1).alias("last"))

    def runs(e: Column) -> Column:
        verbatim = F.filter(e, lambda k: there(k)["v"] == asked(k)["v"])
        found = _let(_runs(e), lambda r: F.concat(r, F.transform(F.filter(r, lambda x: F.size(slots(x)) > 0), inner), _runs(verbatim)))
        return F.filter(F.array_distinct(found), lambda x: x["last"] - x["first"] >= WINDOW - 1)

    def slots(run: Column) -> Column:
        places = F.filter(F.sequence(run["first"], run["last"]), lambda k: _placeholder(asked(k)["t"]))
        slot = lambda k: F.struct(asked(k)["t"].alias("kind"), asked(k)["v"].alias("asked"), there(k)["v"].alias("found"))
        return F.array_distinct(F.transform(places, slot))

    whole = F.when(F.size("equal") == F.col("n"), F.array(F.struct(F.lit(1).alias("first"), F.col("n").alias("last"))))
    kept = ("doc_id", "text_hash", "item_id", "form", "n", "shift", "base", "asked", "tokens")
    found = found.select(*kept, F.explode(F.array(equal)).alias("equal"))
    found = found.select(*kept, F.explode(F.when(F.col("form") == EXACT, whole).otherwise(runs(F.col("equal")))).alias("run"))
    found = found.select(*kept, "run", F.explode(F.array(slots(F.col("run")))).alias("slots"))
    names = F.filter("slots", lambda s: s["kind"] == NAME)
    consistent = (F.size(F.array_distinct("slots.asked")) == F.size("slots")) & (
        F.size(F.array_distinct(F.transform(names, lambda s: s["found"]))) == F.size(names)
    )
    start = asked(F.col("run.first"))["a"]  # an item shorter than a window is one window
    covered = F.sequence(start, F.greatest(start, asked(F.col("run.last"))["b"] - (WINDOW - 1)))
    changed = F.size(F.filter(F.array_distinct(F.flatten(F.collect_set("slots"))), lambda s: s["asked"] != s["found"]))
    windows = F.size(F.array_distinct(F.flatten(F.collect_set(covered))))
    item_windows = F.greatest(F.lit(1), F.col("n") - (WINDOW - 1))
    stretch = F.floor(there(F.col("run.first"))["a"] / (2 * F.col("n")))  # and the one before, so they overlap by half
    return (
        found.filter(consistent)
        .withColumn("stretch", F.explode(F.array(stretch - 1, stretch)))
        .groupBy("doc_id", "text_hash", "item_id", "n", "stretch")
        .agg(windows.alias("windows"), changed.alias("changed"), item_windows.alias("item_windows"))
        .filter(F.col("windows") >= min_share * F.col("item_windows"))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max(F.struct("windows", (-F.col("changed")).alias("kept_slots"), "item_windows")).alias("best"))
    )


def find_leaks(documents: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """A row for each document and item that it leaks, for the stretch that has most of it."""
    best = _leaks(documents, benchmark, min_share).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.windows").cast("long").alias("windows"), F.col("best.item_windows").cast("long").alias("item_windows"),
        (-F.col("best.kept_slots")).cast("long").alias("changed_slots"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Documents without those that leak an item, each judged by its own text. Rows without a doc_id stay, as nothing names
    them; `find_leaks` reports them."""
    leaks = _leaks(documents, benchmark, min_share).filter(F.col("doc_id").isNotNull())
    leaks = leaks.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("same")).distinct()
    rows = documents.select(F.struct(*documents.columns).alias("doc"), "doc_id", F.xxhash64("text").alias("text_hash"))
    return rows.join(leaks, (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("same")), "left_anti").select("doc.*")
