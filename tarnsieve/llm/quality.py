"""Quality rules: repetition and symbol rules, and divergence of histograms from language references.

A first pass over a clean set (documents labelled as good, or references fitted elsewhere) counts its words and
finds each language's `n_common` most frequent ones (in lower case, split at white space and marks).  A pass over all
texts gives each document's counts: the base figures, a histogram of character classes and one of its language's
frequent words.  It is written once.  The histograms summed over the clean set are a language's references,
a few numbers, and a document whose Jensen-Shannon distance from them is too large is not kept.  Guards:
a histogram of fewer than `min_chars` characters or `min_words` words is not judged, nor is one of a
language without references, and the allowed distance widens with the sampling error of short documents.

All expressions are native.  The repeated windows of a text are found by sorting its 3-gram hashes, each with its
position; those whose hash stands next to an equal one are then sorted by their words, which decide.

Nulls and ties: a null text has no words and fails the base rule; a language without clean documents has no
histograms to be compared with, and null is a language of its own; of equally frequent words the first by its bytes
counts; repeated rows are judged as often as they occur; other columns are ignored; an empty table gives no rows.
Very long texts are judged whole: a row's arrays hold its words, hashes and candidate windows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .words import grams, white_words

#: What stands between the words that are counted for a language.
BETWEEN = r"""[\x20\x09-\x0D.,;:!?"'()\[\]{}]+"""
#: Up to so many frequent words of all languages are given to tasks as the set of a membership test.
MOST_LISTED = 4096
_POSITION_BITS = 20
_LONGS = "array<bigint>"


def repeated_words(df: DataFrame, gram: str, n: int, size: str, name: str) -> DataFrame:
    """df with `name`: the words inside n-grams that stand twice or more.  gram: a column with their
    hashes in order; size: words of the text, which are in `words`.  Arrays that a lambda looks into are columns
    of their own, since an expression there would be evaluated for every element."""
    mask = (1 << _POSITION_BITS) - 1
    short = F.col(size) <= mask
    none, no_pairs = F.array().cast(_LONGS), F.array().cast("array<struct<h:bigint,i:bigint>>")
    packed = F.sort_array(F.transform(gram, lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
    # for texts with more words than the position bits count
    pairs = F.sort_array(F.transform(gram, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    staged = df.withColumns({"_packed": F.when(short, packed).otherwise(none), "_pairs": F.when(short, no_pairs).otherwise(pairs)}).drop(gram)

    def neighbours(column: str, key) -> Column:
        return F.filter(column, lambda x, i: (key(x) == key(F.get(column, i - 1))) | (key(x) == key(F.get(column, i + 1))))

    packed_places = F.transform(neighbours("_packed", lambda x: F.shiftright(x, _POSITION_BITS)), lambda x: x.bitwiseAND(F.lit(mask)))
    pair_places = F.transform(neighbours("_pairs", lambda x: x["h"]), lambda x: x["i"])
    # equal hashes stand together whatever else shares them, so these hold every repeated window; words have no spaces
    likely = staged.withColumn("_likely", F.concat(packed_places, pair_places)).drop("_packed", "_pairs")
    said = F.transform("_likely", lambda p: F.struct(F.array_join(F.slice("words", p.cast("int") + 1, n), " ").alias("w"), p.alias("i")))
    worded = likely.withColumn("_worded", F.sort_array(said)).drop("_likely")
    placed = worded.withColumn("_places", F.sort_array(F.transform(neighbours("_worded", lambda x: x["w"]), lambda x: x["i"]))).drop("_worded")
    whole = F.lit(n).cast("long")
    steps = F.transform("_places", lambda p, i: F.least(whole, F.coalesce(F.get("_places", i + 1) - p, whole)))
    return placed.withColumn(name, F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_places")


def _key() -> list[Column]:
    """A language as a key that is never null."""
    return [F.coalesce("lang", F.lit("")).alias("ref_lang"), F.col("lang").isNull().alias("ref_null")]


def _of_language(df: DataFrame, by_language: DataFrame, most_languages: int = 10_000, most_bytes: int = 16 << 20) -> DataFrame:
    """df with the columns of its language's row in by_language, which is broadcast if it is small, as its rows and
    the bytes of its words say."""
    n, size = by_language.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("ref_words", ""))), F.lit(0))).first()
    if n <= most_languages and size <= most_bytes:
        by_language = F.broadcast(by_language)
    return df.join(by_language, (F.coalesce("lang", F.lit("")) == F.col("ref_lang")) & (F.col("lang").isNull() == F.col("ref_null")), "left")


def _plain_words(text: Column) -> Column:
    """Lower-case words; the first or last may be empty."""
    return F.split(F.lower(text), BETWEEN)


def common_words(documents: DataFrame, n_common: int = 24, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(ref_lang, ref_null, ref_words) of each language: its most frequent words, the most frequent first.

    Words are counted with map-side combining; only n_common rows a language and task meet in the ranking.
    """
    docs = documents.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), _plain_words(F.col(f"`{text_col}`")).alias("words"))
    said = docs.select(*_key(), F.explode("words").alias("word")).where("word <> ''")
    counted = said.groupBy("ref_lang", "ref_null", "word").agg(F.count("*").alias("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("ref_lang", "ref_null").orderBy(F.desc("n"), "word"))).where(F.col("place") <= n_common)
    listed = F.sort_array(F.collect_list(F.struct("place", "word")))
    return written(first.groupBy("ref_lang", "ref_null").agg(F.transform(listed, lambda x: x["word"]).alias("ref_words")), "common-words")


def features(documents: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row of counts for each document; common: what `common_words` or `references` gave."""
    text, n = F.col("text"), F.col("n_words")
    docs = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    placed = _of_language(docs, common.select("ref_lang", "ref_null", "ref_words"))
    worded = placed.withColumn("words", white_words(text)).withColumn("n_words", F.size("words"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    plain, hits = _plain_words(text), F.filter("plain", lambda w: w != "")
    listed = common.select(F.explode("ref_words").alias("word")).distinct()
    if listed.count() <= MOST_LISTED:  # else each word is looked for in its language's list
        known = [r["word"] for r in listed.collect()]
        hits = F.filter("plain", lambda w: w.isin(*known))
    # each slot once more, so that every one has a first place among the sorted ones
    last = F.size("ref_words") + 1
    slots = F.concat(F.transform(hits, lambda w: F.array_position("ref_words", w)), F.sequence(F.lit(0).cast("long"), last.cast("long")))
    n_plain = F.size("plain") - F.size(F.filter(F.array(F.get("plain", F.lit(0)), F.when(F.size("plain") > 1, F.element_at("plain", -1))), lambda w: w == ""))
    worded = worded.withColumn("plain", F.when(F.col("ref_words").isNotNull(), plain))
    counted = worded.select(
        "doc_id", "lang", "n_words", "words",
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("n_symbols"),
        lines.alias("lines"), grams(F.col("words"), 3, n).alias("gram"),
        F.when(F.col("ref_words").isNotNull(), F.sort_array(slots)).alias("slots"), last.alias("last"), n_plain.alias("n_plain"),
        F.length(text).alias("chars"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("upper"),
        F.regexp_count(text, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(text, F.lit("[.,;:!?]")).alias("marks"),
    )
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("upper") - F.col("digits") - F.col("marks")
    classes = F.array(rest, "upper", "digits", "marks", "n_symbols", F.col("chars") - F.col("word_chars")).cast(_LONGS)
    starts = F.transform(F.sequence(F.lit(0), "last"), lambda k: F.array_position("slots", k.cast("long")))
    with_starts = counted.withColumn("starts", F.when(F.col("slots").isNotNull(), starts)).drop("slots")
    found = F.transform(F.slice("starts", 2, F.col("last") - 1), lambda at, k: F.get("starts", k + 2) - at - 1)
    bins = F.concat(F.array(F.col("n_plain") - F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x)), found)
    return repeated_words(with_starts, "gram", 3, "n_words", "repeats").select(
        "doc_id", "lang", n.cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeats").alias("n_repeat_words"),
        classes.alias("classes"), bins.alias("bins"),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (0 to 1, base 2) of two histograms of counts of equal length; null if either is empty."""

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def part(a, m):
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def share(x):
        return F.transform(x, lambda v: v / total(x))

    terms = F.zip_with(share(p), share(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / 2
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def references(counts: DataFrame, common: DataFrame, n_common: int = 24) -> DataFrame:
    """Summed histograms of each language and its words: one row a language.  counts: `features` of clean documents."""

    def summed(column, n):
        return F.filter(F.array(*(F.sum(F.get(column, i)) for i in range(n))), lambda x: x.isNotNull()).alias(f"ref_{column}")

    sums = counts.groupBy(*_key()).agg(summed("classes", 6), summed("bins", n_common + 1))
    return sums.join(common.select("ref_lang", "ref_null", "ref_words"), ["ref_lang", "ref_null"], "left")


def judge(documents: DataFrame, clean: DataFrame | None = None, refs: DataFrame | None = None, max_class_distance: float = 0.22, max_word_distance: float = 0.2, n_common: int = 24, min_chars: int = 200, min_words: int = 100, most_broadcast: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts of each document, its distances and whether it is kept.

    refs: what `references` gave elsewhere.  clean: the ids (`doc_id`) of documents whose histograms are the
    references.  Without either, those are all documents that pass the base rule, and the frequent words those of all documents.
    """
    if refs is not None:
        common = refs
    else:
        ids = None
        if clean is not None:
            ids = written(clean.select(F.col("doc_id")).distinct(), "clean-ids")
            ids = F.broadcast(ids) if ids.count() <= most_broadcast else ids
        chosen = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
        common = common_words(chosen if ids is None else chosen.join(ids, "doc_id", "left_semi"), n_common)
    counts = written(features(documents, common, id_col, text_col, lang_col), "quality")
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    if refs is None:
        good = counts.where(~base) if ids is None else counts.join(ids, "doc_id", "left_semi")
        refs = written(references(good, common, n_common), "quality-references")
    joined = _of_language(counts, refs)
    classes, words = jensen_shannon(F.col("classes"), F.col("ref_classes")), jensen_shannon(F.col("bins"), F.col("ref_bins"))
    joined = joined.withColumn("n_plain", F.coalesce(F.aggregate("bins", F.lit(0).cast("long"), lambda a, v: a + v), F.lit(0)))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, v: a + v)
    measured = joined.withColumns({"class_distance": F.when(chars >= min_chars, classes), "word_distance": F.when(F.col("n_plain") >= min_words, words)})
    # a sample's distance from its own source falls as one over the root of its length.  For words: 8 ln(2) n times
    # the squared distance goes as chi-squared of as many degrees as there are listed words, two deviations are allowed
    degrees = F.size("ref_bins") - 1
    error = (degrees + 2 * F.sqrt(2 * degrees)) / (8 * log(2) * F.greatest("n_plain", F.lit(1)))
    far_classes = F.coalesce("class_distance", F.lit(0.0)) > max_class_distance + 0.6 / F.sqrt(F.greatest(chars, F.lit(1)))
    far_words = F.coalesce(F.pow("word_distance", F.lit(2)) > max_word_distance**2 + error, F.lit(False))
    far = far_classes | far_words
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~far).alias("kept"), "class_distance", "word_distance")
