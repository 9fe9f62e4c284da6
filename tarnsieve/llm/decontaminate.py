"""Benchmark decontamination by winnowing, in native expressions.

Texts and benchmark items become words.  Of every `window - k + 1` neighbouring k-gram hashes the
least is kept (winnowing), on both sides, so any run of `window` words that a text shares with an
item holds a hash that both have kept.  Kept hashes of texts meet those of the items; a text without
a common one is clean and its words go no further.  In the others, the hits are extended: all windows
around a common hash's positions are compared with the items' windows, word for word, and the union of
equal ones is the contaminated part.  Items of fewer words than a window are windows themselves;
they are too short for the guarantee, so texts' runs of exactly their lengths are compared, from the places where the first
word of such an item stands; a text without any such word goes no further for their sake.

The benchmark's side is broadcast only below a counted bound; beyond it the same joins shuffle.  The
texts' side is written once: ids and word counts, and the words of texts with hits only.

Nulls and ties: a null text or item has no words; items without words match nothing; a null item id
is not reported, though its windows count; repeated items are reported once, repeated rows of a
document each; other columns are ignored; empty tables give no rows, or rows without hits.  Very long texts are
taken whole: a row's arrays hold its words and hashes.  A document lists every item that it shares a window with,
so a passage that stands in all items makes lists as long as the benchmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written
from .words import grams, letter_words, lower_ascii



def _worded(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    text = lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return df.select(F.col(f"`{id_col}`").alias(name), letter_words(text).alias("words")).withColumn("n_words", F.size("words"))


def _winnowed(df: DataFrame, window: int, k: int) -> DataFrame:
    """Adds `least`: of each run of window - k + 1 neighbouring k-gram hashes the least."""
    span = window - k + 1
    hashed = df.withColumn("hashes", grams(F.col("words"), k, F.col("n_words")))
    least = F.transform(F.slice("hashes", 1, F.greatest(F.size("hashes") - (span - 1), F.lit(0))), lambda h, i: F.least(h, *(F.get("hashes", i + j) for j in range(1, span))) if span > 1 else h)
    return hashed.withColumn("least", least)


def _runs(words: str, size: int):
    """The text of the run of `size` words at each position of an array of positions."""
    return lambda p: F.struct(p.alias("pos"), F.array_join(F.slice(words, p + 1, size), " ").alias("run"))


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, most_broadcast: int = 100_000, most_literals: int = 4096, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, the items found (sorted as strings) and the hit spans."""
    with scratch(documents.sparkSession) as keep:
        result = written(_found(documents, benchmark, window, k, most_broadcast, most_literals, id_col, text_col, item_col, item_text_col), "contamination")
        keep(result)
    return result


def _found(documents: DataFrame, benchmark: DataFrame, window: int, k: int, most_broadcast: int, most_literals: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    items = written(_worded(benchmark, item_col, item_text_col, "item_id"), "items")
    long_items, short_items = items.where(F.col("n_words") >= window), items.where(F.col("n_words").between(1, window - 1))

    # the benchmark's windows, each once, with the items it is from
    all_runs = F.transform(F.sequence(F.lit(0), F.col("n_words") - window), _runs("words", window))
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.array_join("words", " ").alias("run")))
    named = long_items.select("item_id", F.lit(window).alias("size"), F.explode(all_runs).alias("w")).union(short_items.select("item_id", F.col("n_words").alias("size"), F.explode(whole).alias("w")))
    windows = written(named.groupBy(F.col("w.run").alias("run"), "size").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")), "item-windows")
    prints = written(_winnowed(long_items, window, k).select(F.explode("least").alias("print")).distinct(), "item-prints")
    lengths = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # at most window - 1 values
    # first words of short items: so few that they are held beside each task, or more, which are joined
    begun = written(windows.where(F.col("size") < window).select("size", F.substring_index("run", " ", 1).alias("first")).distinct(), "first-words")
    few = begun.count() <= most_literals
    firsts = {n: sorted(r["first"] for r in begun.where(F.col("size") == n).select("first").collect()) for n in lengths} if few else {}
    begins = F.exists("words", lambda w: w.isin(sorted({w for some in firsts.values() for w in some}))) if firsts else F.lit(bool(lengths))
    n_prints, n_windows = prints.count(), windows.count()
    some = F.broadcast(windows) if n_windows <= most_broadcast else windows
    shared = F.broadcast(prints) if n_prints <= most_broadcast else prints
    # so few that they are best held beside each task, as the set of a membership test
    known = sorted(r["print"] for r in prints.collect()) if n_prints <= most_literals else None

    docs = _winnowed(_worded(documents, id_col, text_col, "doc_id"), window, k).drop("hashes").withColumn("row", F.monotonically_increasing_id())
    columns = ["row", "doc_id", F.col("n_words").cast("long").alias("n_words")]
    if known is not None:
        hit = F.exists("least", lambda h: h.isin(known)) if known else F.lit(False)
        docs = docs.withColumn("hit", hit)
        docs = written(docs.select(*columns, "hit", F.when(F.col("hit") | begins, F.col("words")).alias("words")), "texts")
    else:
        docs = written(docs, "texts")
        met = docs.select("row", F.explode(F.array_distinct("least")).alias("print")).join(shared, "print", "left_semi").select("row").distinct()
        docs = docs.join(met.withColumn("hit", F.lit(True)), "row", "left").select(*columns, F.coalesce("hit", F.lit(False)).alias("hit"), "words")

    # extend: the windows around the positions of common hashes
    hit = docs.where("hit").select("row", "words", F.size("words").alias("n"))
    placed = hit.select("row", "n", F.posexplode(grams(F.col("words"), k, F.col("n"))).alias("p", "print"))
    placed = placed.where(F.col("print").isin(known)) if known else placed.join(shared, "print", "left_semi")
    around = F.sequence(F.greatest(F.col("p") - (window - k), F.lit(0)), F.least(F.col("p"), F.col("n") - window))
    starts = placed.where(F.col("n") >= window).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list(around))).alias("starts"))
    tried = hit.join(starts, "row").select("row", F.lit(window).alias("size"), F.explode(F.transform("starts", _runs("words", window))).alias("w"))
    for size in lengths:
        places = F.sequence(F.lit(0), F.col("n_words").cast("int") - size)
        some_words = docs.where((F.col("n_words") >= size) & F.col("words").isNotNull())
        if few:
            some_words = some_words.withColumn("places", F.filter(places, lambda p: F.get("words", p).isin(firsts[size]))).where(F.size("places") > 0)
            runs_ = some_words.select("row", F.lit(size).alias("size"), F.explode(F.transform("places", _runs("words", size))).alias("w"))
        else:
            every = some_words.select("row", F.lit(size).alias("size"), F.explode(F.transform(places, _runs("words", size))).alias("w"))
            runs_ = every.withColumn("first", F.substring_index("w.run", " ", 1)).join(begun.where(F.col("size") == size).select("first"), "first", "left_semi").select("row", "size", "w")
        tried = tried.union(runs_)
    equal = tried.select("row", "size", F.col("w.pos").alias("pos"), F.col("w.run").alias("run")).join(some, ["run", "size"])
    found = equal.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.collect_set(F.struct("pos", F.col("size").alias("len"))).alias("places"))
    # the words inside any place, in order; a span begins where the word before is none of them
    covered = found.withColumn("covered", F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1))))))
    first = F.filter("covered", lambda p, i: ~F.get("covered", i - 1).eqNullSafe(p - 1))
    last = F.filter("covered", lambda p, i: ~F.get("covered", i + 1).eqNullSafe(p + 1))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    merged = covered.select("row", F.sort_array("items").alias("items"), F.size("covered").cast("long").alias("n_hit"), spans.alias("spans"))
    none = F.array().cast("array<string>")
    result = docs.select("row", "doc_id", "n_words").join(merged, "row", "left")
    return result.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
