"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words become templates: numbers, names and units turn into typed placeholders. Windows of the templates of
documents and benchmark items are joined by their hash. A window is only made in a document around its
*anchor*, the longest word it has in the benchmark; no window of an item can occur without it. Windows that
lie alike in document and item are counted together, and their slots are checked: each value of the item
must stand for one value in the document, so a question asked anew with other numbers and names is found.
Windows that contradict this are dropped; the others must be enough.
Windows also agree where names are taken as words, so a copy is found in any letter case and any sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require_columns, stored

#: Words of a window; windows that must agree (all, if an item has fewer); plain words that a window must have.
WINDOW, AGREEING, PLAIN = 8, 5, 4
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Above so many anchor words, windows are made everywhere instead of around anchors; results are the same.
MOST_ANCHORS = 20_000

# Names of units, lower case. Short ones that are common words are left out.
UNITS = (
    "mm", "cm", "km", "mg", "kg", "ml", "meter", "meters", "metre", "metres", "mile", "miles", "foot", "feet", "inch", "inches",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "degree", "degrees", "kilometer", "kilometers", "kilometre", "kilometres",
)

# Numbers, and words that begin with a letter or mark. ASCII is named first, since Java looks properties up last.
_WORD = r"[a-zA-Z\p{L}\p{M}][a-zA-Z0-9\p{L}\p{M}\p{N}]*|[0-9\p{N}]+(?:[.,][0-9\p{N}]+)*"


def lower_words(text: Column) -> Column:
    """Lower-case words; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def marked_words(text: Column) -> Column:
    """The same words as written, each with the mark that ends a sentence if one follows."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?:{_WORD})[.!?:]?"), F.lit(0))


def _numeric(w: Column) -> Column:
    """Whether a word begins with a number; plain comparisons spare ASCII words the pattern."""
    return (w < ":") | ((w >= "\u0080") & w.rlike(r"^\p{N}"))


def _capital(w: Column) -> Column:
    return ((w < "a") | (w >= "{")) & w.rlike(r"^\p{Lu}\p{Ll}+")


def _kinds(low: str, marked: str) -> Column:
    """Per word its placeholder, or the word. Names begin with one capital, inside a sentence."""
    return F.transform(
        F.col(low),
        lambda w, i: F.when(_numeric(w), NUMBER)
        .when(w.isin(*UNITS), UNIT)
        .when((i > 0) & _capital(F.get(F.col(marked), i)) & ~F.get(F.col(marked), i - 1).rlike(r"[.!?:]$"), NAME)
        .otherwise(w),
    )


def _hash(template: Column) -> Column:
    return F.xxhash64(F.array_join(template, " "), F.size(template))


def _slots(start: Column, length: Column, names: bool = True) -> Column:
    """Values of the placeholders of a window, in order; without names, of its numbers and units."""
    at = F.filter(F.sequence(start, start + length - 1), lambda i: (F.get("kinds", i) != F.get("low", i)) & (F.lit(names) | (F.get("kinds", i) != NAME)))
    return F.transform(at, lambda i: F.get("low", i))


def _named(start: Column, length: Column) -> Column:
    return F.array_contains(F.slice("kinds", start + 1, length), NAME)


def _template(start: Column, length: Column) -> list[Column]:
    """Hash and slots of the template of a window."""
    return [_hash(F.slice("kinds", start + 1, length)).alias("h"), _slots(start, length).alias("slots")]


def _spelt(start: Column, length: Column) -> list[Column]:
    """The same with names as words: what is a name depends on letter case and on the sentence around it."""
    words = F.transform(F.sequence(start, start + length - 1), lambda i: F.when(F.get("kinds", i) == NAME, F.get("low", i)).otherwise(F.get("kinds", i)))
    return [_hash(words).alias("h"), _slots(start, length, names=False).alias("slots")]


def _verbatim(start: Column, length: Column) -> list[Column]:
    """The same with all words as they are."""
    return [_hash(F.slice("low", start + 1, length)).alias("h"), F.array().cast("array<string>").alias("slots")]


def _plain(start: Column, length: Column) -> Column:
    return F.filter(F.slice("kinds", start + 1, length), lambda w: ~w.isin(NUMBER, NAME, UNIT))


def _lettered(start: Column, length: Column) -> Column:
    return F.filter(F.slice("low", start + 1, length), lambda w: ~w.rlike(r"^\p{N}"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of items: item_id, windows (of the item), s (start), length, verbatim, h, item_slots, anchor.

    A window with names has a second row in which they are words. An item without a usable template has
    verbatim windows instead: all with a word that is not a number.
    """
    texts = benchmark.where("item_id is not null").select("item_id", lower_words(F.col("text")).alias("low"), marked_words(F.col("text")).alias("marked"))
    made = texts.where("size(low) > 0").select("item_id", "low", _kinds("low", "marked").alias("kinds"), F.least(F.size("low"), F.lit(WINDOW)).alias("length"))
    every, s, length = F.sequence(F.lit(0), F.size("low") - F.col("length")), F.col("s"), F.col("length")
    made = made.withColumn("usable", F.filter(every, lambda i: F.size(F.array_distinct(_plain(i, length))) >= F.least(F.lit(PLAIN), length)))
    made = made.withColumn("verbatim", F.size("usable") == 0)
    starts = made.select("*", F.explode(F.when(F.col("verbatim"), F.filter(every, lambda i: F.size(_lettered(i, length)) > 0)).otherwise(F.col("usable"))).alias("s"))
    template, spelt, verbatim = (F.struct(*f(s, length)) for f in (_template, _spelt, _verbatim))
    variants = F.when(F.col("verbatim"), F.array(verbatim)).when(_named(s, length), F.array(template, spelt)).otherwise(F.array(template))
    words = F.when(F.col("verbatim"), _lettered(s, length)).otherwise(_plain(s, length))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("k"), w.alias("w"))))["w"]
    cut = starts.select("item_id", "s", "length", "verbatim", longest.alias("anchor"), F.explode(variants).alias("v"))
    found = cut.select("item_id", "s", "length", "verbatim", "v.h", F.col("v.slots").alias("item_slots"), "anchor").distinct()
    count = found.groupBy("item_id").agg(F.count_distinct("s").alias("windows"))
    return stored(found.join(count, "item_id"), "benchmark-windows")


def _starts(length: int) -> Column:
    """Starts of the windows of this length that hold one of the places in the column hits."""
    last = F.size("low") - length
    around = F.transform("hits", lambda i: F.sequence(F.greatest(i - (length - 1), F.lit(0)), F.least(i, last)))
    return F.when(last >= 0, F.array_distinct(F.flatten(around))).otherwise(F.array().cast("array<int>"))


def _windows(length: int, verbatim: bool) -> Column:
    """Windows of this length: verbatim ones, or templates and, of those with names, also the spelt ones."""
    n, starts = F.lit(length), F.col(f"starts{length}")
    made = lambda starts, f: F.transform(starts, lambda s: F.struct(s.alias("begin"), *f(s, n)))
    if verbatim:
        return made(starts, _verbatim)
    return F.concat(made(starts, _template), made(F.filter(starts, lambda s: _named(s, n)), _spelt))


def document_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents (doc_id, text) that may be an item's: doc_id, k (hash of the text), begin, h, doc_slots."""
    lengths = sorted((r.length, r.verbatim) for r in windows.select("length", "verbatim").distinct().collect())
    anchors = [r.anchor for r in windows.select("anchor").distinct().limit(MOST_ANCHORS + 1).collect()]
    everywhere = len(anchors) > MOST_ANCHORS
    # Exploded from an array of one: Spark puts a condition on words below a projection that makes them, and then makes
    # them once for every mention.
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.explode(F.array(lower_words(F.col("text")))).alias("low"))
    rows = rows.where(F.lit(True) if everywhere else F.exists("low", lambda w: w.isin(anchors))).where("size(low) > 0")
    places = F.sequence(F.lit(0), F.size("low") - 1)
    hits = places if everywhere else F.filter(places, lambda i: F.get("low", i).isin(anchors))
    held = rows.select("doc_id", "text", "low", marked_words(F.col("text")).alias("marked"))
    held = held.select("doc_id", F.xxhash64("text").alias("k"), "low", _kinds("low", "marked").alias("kinds"), hits.alias("hits"))
    if not lengths:
        return held.select("doc_id", "k", F.lit(0).alias("begin"), F.lit(0).cast("long").alias("h"), F.array().cast("array<string>").alias("doc_slots")).limit(0)
    held = held.select("*", *[_starts(n).alias(f"starts{n}") for n in sorted({n for n, _ in lengths})])
    made = held.select("doc_id", "k", F.inline(F.flatten(F.array(*[_windows(*n) for n in lengths]))))
    return made.withColumnRenamed("slots", "doc_slots")


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, begin, n_windows, windows, n_slots, n_changed.

    ``begin`` is the word of the document where the item would begin, ``n_windows`` how many of the item's
    ``windows`` agree there, ``n_slots`` its distinct numbers, names and units in these and ``n_changed``
    those with other values in the document. Where a value of the item stands for several, only windows in
    which it stands for itself count; if it never does, AGREEING windows without it must follow each other.
    Clean documents have no row. Null or empty texts match
    nothing; rows with a null id, of either table, take no part. Repeated rows give one row. Items without
    PLAIN different plain words in any window are found word for word only, and those of numbers alone not
    at all. Other columns are not looked at.
    """
    require_columns(docs, id_col, text_col)
    require_columns(benchmark, item_col, item_text_col)
    items = item_windows(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")))
    found = document_windows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items)
    met = found.join(items.select("item_id", "windows", "s", "h", "item_slots"), "h").withColumn("begin", F.col("begin") - F.col("s"))
    pair = F.arrays_zip(F.col("item_slots").alias("item"), F.col("doc_slots").alias("doc"))
    windows = met.groupBy("doc_id", "k", "item_id", "windows", "begin").agg(F.collect_set(F.struct("s", pair.alias("pairs"))).alias("held"))
    every = F.array_distinct(F.flatten(F.transform("held", lambda x: x["pairs"])))
    several = F.array_distinct(F.transform(F.filter("every", lambda p: F.exists("every", lambda q: (q["item"] == p["item"]) & (q["doc"] != p["doc"]))), lambda p: p["item"]))
    fitting = F.filter("held", lambda x: F.forall(x["pairs"], lambda p: ~F.array_contains("several", p["item"]) | (p["item"] == p["doc"])))
    kept_at = F.array_distinct(F.transform("kept", lambda x: x["s"]))
    pairs = F.array_distinct(F.flatten(F.transform("kept", lambda x: x["pairs"])))
    judged = windows.withColumn("every", every).withColumn("several", several).withColumn("kept", fitting)
    judged = judged.select("*", kept_at.alias("at"), pairs.alias("pairs")).withColumn("n_windows", F.size("at").cast("long"))
    # Of a value with several others none of which is its own, no window counts; then AGREEING windows must follow each other.
    unkept = F.exists("several", lambda v: ~F.exists("every", lambda p: (p["item"] == v) & (p["doc"] == v)))
    in_a_row = F.exists("at", lambda i: F.forall(F.sequence(i, i + AGREEING - 1), lambda j: F.array_contains("at", j)))
    fits = judged.where((F.col("n_windows") >= F.least(F.lit(AGREEING), F.col("windows"))) & (~unkept | in_a_row))
    best = F.max_by(F.struct("begin", "n_windows", "windows", F.size("pairs").cast("long").alias("n_slots"), F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])).cast("long").alias("n_changed")), F.struct("n_windows", -F.col("begin")))
    return fits.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark item.

    Rows with a null id stay, and rows with a null or empty text. Repeated rows go or stay alike; all rows of
    an id go if one of its texts holds an item. An empty table gives an empty result, an empty benchmark
    all rows. Whole texts are searched, however long.
    """
    found = contaminations(docs, benchmark, id_col=id_col, text_col=text_col, **names).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs[id_col] == found["__found"], "left_anti")
